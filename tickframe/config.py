"""Default dials. Results depend on them."""

TICK_SIZE = 0.25
INSTRUMENTS = {
    # symbol: (tick size, dollars per tick, dollars per point)
    "NQ": (0.25, 5.0, 20.0),
    "ES": (0.25, 12.5, 50.0),
}

TIMEFRAMES = {
    "15s": 15, "30s": 30, "1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800,
    "60m": 3600, "4h": 14400, "1d": 86400,
}

# Session windows in minutes of the US Eastern day, open on the left, closed on the right.
SESSIONS = (("Asia", 1080, 180), ("London", 180, 480), ("NY", 480, 1020))
EXCHANGE_ZONE = "America/New_York"
TRACKED_SESSIONS = ("London", "NY")

SCALE_WINDOW = 30 * 60
SCALE_MIN_BARS = 8

RIBBON_PERIODS = tuple(range(5, 165, 5))
NAMED_AVERAGES = (50, 100, 200)

REGIME_ALIGN = 0.60
REGIME_WIDTH_TREND = 5.0
REGIME_WIDTH_PINCH = 2.0
REGIME_CONFIRM = 3

RETRACE = 3.0

VALUE_AREA = 0.70
BINS_PER_SCALE = 8
MAX_CLOSED_PROFILES = 6
HVN_MIN_SHARE = 0.5
LVN_MAX_SHARE = 0.15

RECENT_WINDOW = 30 * 60
RECENT_MIN_BARS = 6

PERCENTILES = tuple(range(0, 101, 5))
SEALED_FROM = "2025-10-01 00:00:00"

SLIPPAGE_TICKS = 1
COMMISSION_PER_SIDE = 2.0
STARTING_CAPITAL = 50_000.0
BACKTEST_START = "2015-01-01 00:00:00"

IS_DAYS, OOS_DAYS, STEP_DAYS = 730, 180, 180
MIN_TRADES = 10


def seconds(timeframe: str) -> int:
    """Length of a timeframe such as ``15m`` in seconds."""
    units = {"s": 1, "m": 60, "h": 3600, "d": 86400}
    try:
        return int(timeframe[:-1]) * units[timeframe[-1]]
    except (KeyError, ValueError, IndexError):
        raise ValueError(f"not a timeframe: {timeframe!r}") from None
