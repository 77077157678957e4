"""The same questions in SQL, as an independent check of the Spark results."""

from __future__ import annotations


def ticks_cte(by: str = "event_type") -> str:
    sym = "'ALL'" if by == "ALL" else by
    return f"""
w AS (
  SELECT event_id, date_trunc('minute', ts) AS ts, {sym} AS symbol, user_id,
         80000 + SUM(CAST(FLOOR((value - 50.0) / 5.0 + 0.5) AS BIGINT))
           OVER (PARTITION BY {sym} ORDER BY ts, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS walk,
         CASE WHEN ts < TIMESTAMP '2024-01-11 00:00:00' THEN 0.0
              WHEN ts < TIMESTAMP '2024-01-21 00:00:00' THEN 211.0 ELSE 481.0 END AS adj
  FROM events),
p AS (SELECT *, walk * 0.25 + adj AS price FROM w),
ticks AS (
  SELECT symbol, ts, event_id AS seq, CAST(price AS DOUBLE) AS price,
         CAST(CASE WHEN event_id % 10 < 5 THEN price - 0.25
                   WHEN event_id % 10 < 9 THEN price ELSE price - 0.25 END AS DOUBLE) AS bid,
         CAST(CASE WHEN event_id % 10 < 5 THEN price ELSE price + 0.25 END AS DOUBLE) AS ask,
         1 + user_id % 7 AS volume, CAST(adj AS DOUBLE) AS adj
  FROM p),
sided AS (
  SELECT *, CASE WHEN price >= ask THEN 1 WHEN price <= bid THEN -1 ELSE 0 END AS side,
         price - adj + (SELECT max(adj) FROM ticks t2 WHERE t2.symbol = ticks.symbol) AS px
  FROM ticks)"""


def bars_cte(by: str = "ALL", step: int = 900) -> str:
    return ticks_cte(by) + f""",
bars AS (
  SELECT symbol, CAST(CEIL(epoch(ts) / {step}) * {step} AS BIGINT) AS t,
         arg_min(px, seq) AS open, max(px) AS high, min(px) AS low, arg_max(px, seq) AS close,
         CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(volume * side) AS BIGINT) AS delta,
         CAST(sum(CASE WHEN side = 1 THEN volume ELSE 0 END) AS BIGINT) AS buy_volume,
         CAST(sum(CASE WHEN side = -1 THEN volume ELSE 0 END) AS BIGINT) AS sell_volume,
         count(*) AS trades
  FROM sided GROUP BY 1, 2)"""


BAR_COLS = "symbol, t AS time, open, high, low, close, volume, delta, buy_volume, sell_volume, trades"


def rung_cte(step: int, src: str = "bars", name: str = "rung") -> str:
    return f""",
{name} AS (
  SELECT symbol, CAST(CEIL(t / {step}.0) * {step} AS BIGINT) AS t,
         arg_min(open, b.t) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.t) AS close,
         CAST(sum(volume) AS BIGINT) AS volume,
         CASE WHEN count(delta) = count(*) THEN CAST(sum(delta) AS BIGINT) END AS delta,
         CASE WHEN count(buy_volume) = count(*) THEN CAST(sum(buy_volume) AS BIGINT) END AS buy_volume,
         CASE WHEN count(sell_volume) = count(*) THEN CAST(sum(sell_volume) AS BIGINT) END AS sell_volume,
         CASE WHEN count(trades) = count(*) THEN CAST(sum(trades) AS BIGINT) END AS trades
  FROM {src} b GROUP BY 1, 2)"""


def sessions_cte(src: str = "bars") -> str:
    """Adds session, session_new, session_id, session_bar to ``src`` as ``sess``."""
    return f""",
mins AS (
  SELECT *, extract('hour' FROM lt) * 60 + extract('minute' FROM lt) AS m FROM (
    SELECT *, timezone('America/New_York', to_timestamp(t)) AS lt FROM {src})),
named AS (
  SELECT * EXCLUDE (lt, m), CASE WHEN m > 1080 OR m <= 180 THEN 'Asia'
                    WHEN m > 180 AND m <= 480 THEN 'London'
                    WHEN m > 480 AND m <= 1020 THEN 'NY' END AS session FROM mins),
turned AS (
  SELECT *, session IS DISTINCT FROM lag(session) OVER (PARTITION BY symbol ORDER BY t) AS session_new
  FROM named),
started AS (
  SELECT *, max(CASE WHEN session_new THEN t END) OVER (
      PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st
  FROM turned),
sess AS (
  SELECT * EXCLUDE (st), CASE WHEN session IN ('London', 'NY') THEN st END AS session_id,
         CASE WHEN session IN ('London', 'NY') THEN
           row_number() OVER (PARTITION BY symbol, st ORDER BY t) END AS session_bar
  FROM started)"""


def scale_cte(src: str = "bars", window: int = 7200, name: str = "scaled") -> str:
    """Adds range_scale to ``src``."""
    return f""",
rngs AS (
  SELECT *, high - low AS rng, row_number() OVER (PARTITION BY symbol ORDER BY t) AS rn FROM {src}),
meds AS (
  SELECT *, count(*) OVER near AS n_near, quantile_cont(rng, 0.5) OVER near AS med_near,
         quantile_cont(rng, 0.5) OVER last8 AS med_8
  FROM rngs WINDOW
    near AS (PARTITION BY symbol ORDER BY t RANGE BETWEEN {window - 1} PRECEDING AND CURRENT ROW),
    last8 AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
{name} AS (
  SELECT * EXCLUDE (n_near, med_near, med_8, rng),
         CASE WHEN rn < 8 THEN NULL
              WHEN (CASE WHEN n_near >= 8 THEN med_near ELSE med_8 END) <= 0 THEN NULL
              WHEN n_near >= 8 THEN med_near ELSE med_8 END AS range_scale
  FROM meds)"""


def gaps_cte(src: str, step: int = 900, name: str = "gapped") -> str:
    return f""",
{name} AS (
  SELECT *, coalesce(t - lag(t) OVER (PARTITION BY symbol ORDER BY t) > {step}, FALSE) AS gap_before
  FROM {src})"""


SQL: dict[str, str] = {}

SQL["aggressor_flow"] = "WITH " + ticks_cte() + """
SELECT symbol, side, count(*) AS prints, CAST(sum(volume) AS BIGINT) AS volume,
       CAST(sum(volume * side) AS BIGINT) AS delta
FROM (SELECT symbol, volume, CAST(side AS BIGINT) AS side FROM sided) GROUP BY 1, 2"""

SQL["back_adjusted_prices"] = "WITH " + ticks_cte() + """
SELECT symbol, seq, price AS raw_price, px AS price, adj FROM sided"""

SQL["bars_base"] = "WITH " + bars_cte("event_type", 3600) + f"SELECT {BAR_COLS} FROM bars"

SQL["bars_derived"] = ("WITH " + bars_cte("event_type", 3600) + rung_cte(14400, name="r4")
                       + rung_cte(86400, name="r1d")
                       + f"SELECT '4h' AS timeframe, {BAR_COLS} FROM r4 UNION ALL "
                         f"SELECT '1d' AS timeframe, {BAR_COLS} FROM r1d")

SQL["bars_ladder_null_flow"] = (
    "WITH " + bars_cte() + """,
holed AS (
  SELECT symbol, t, open, high, low, close, volume,
         CASE WHEN (t // 900) % 7 <> 0 THEN delta END AS delta,
         CASE WHEN (t // 900) % 7 <> 0 THEN buy_volume END AS buy_volume,
         CASE WHEN (t // 900) % 7 <> 0 THEN sell_volume END AS sell_volume,
         CASE WHEN (t // 900) % 7 <> 0 THEN trades END AS trades FROM bars)"""
    + rung_cte(1800, "holed", "r30") + rung_cte(3600, "holed", "r60") + f"""
SELECT '30m' AS timeframe, {BAR_COLS} FROM r30 WHERE t <= (SELECT max(t) FROM holed)
UNION ALL
SELECT '60m' AS timeframe, {BAR_COLS} FROM r60 WHERE t <= (SELECT max(t) FROM holed)""")

SQL["gap_segments"] = ("WITH " + bars_cte() + gaps_cte("bars") + """
SELECT symbol, t AS time, gap_before, CAST(sum(CAST(gap_before AS INT)) OVER (
  PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS segment
FROM gapped""")

SQL["window_filter"] = "WITH " + bars_cte("event_type", 3600) + f"""
SELECT {BAR_COLS} FROM bars
WHERE t >= epoch(TIMESTAMP '2024-01-05') AND t <= epoch(TIMESTAMP '2024-01-19 12:00:00')"""

SQL["zero_volume_policy"] = "WITH " + bars_cte() + """,
thin AS (SELECT * REPLACE (CASE WHEN volume < 4 THEN 0 ELSE volume END AS volume) FROM bars)""" \
    + gaps_cte("thin") + """
SELECT symbol, t AS time, CAST(volume AS BIGINT) AS volume, gap_before FROM gapped WHERE volume > 0"""

SQL["bar_summary"] = "WITH " + bars_cte("event_type", 3600) + gaps_cte("bars", 3600) + """
SELECT symbol, count(*) AS rows, min(t) AS first_time, max(t) AS last_time,
       CAST(sum(CAST(gap_before AS INT)) AS BIGINT) AS gaps,
       CAST(sum(CAST(volume = 0 AS INT)) AS BIGINT) AS zero_volume
FROM gapped GROUP BY 1"""

SQL["dataset_listing"] = "WITH " + bars_cte("event_type", 3600) + rung_cte(14400) + """
SELECT symbol, timeframe, count(*) AS count, min(t) AS first_time, max(t) AS last_time FROM (
  SELECT symbol, t, '60m' AS timeframe FROM bars UNION ALL SELECT symbol, t, '4h' FROM rung)
GROUP BY 1, 2"""

SQL["slice_bars"] = "WITH " + bars_cte("event_type", 3600) + """
SELECT symbol, bar_no, t AS time, close FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS bar_no FROM bars)
WHERE bar_no >= 100 AND bar_no < 350"""

SQL["locate_bar"] = "WITH " + bars_cte("event_type", 3600) + """,
nb AS (SELECT symbol, t, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS bar_no FROM bars),
asks AS (SELECT DISTINCT event_type AS symbol, CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) + 7200 AS time
         FROM events)
SELECT a.symbol, a.time,
       coalesce(n.bar_no, (SELECT max(bar_no) FROM nb x WHERE x.symbol = a.symbol)) AS bar_no
FROM asks a ASOF LEFT JOIN nb n ON a.symbol = n.symbol AND a.time <= n.t"""

SQL["session_labels"] = "WITH " + bars_cte() + sessions_cte() + """
SELECT symbol, t AS time, session, session_new, session_id, session_bar FROM sess"""

SQL["session_instances"] = "WITH " + bars_cte() + sessions_cte() + """
SELECT symbol, session_id, session, count(*) AS bars, max(t) AS last_time, arg_min(open, t) AS open,
       max(high) AS high, min(low) AS low, arg_max(close, t) AS close
FROM sess WHERE session_id IS NOT NULL GROUP BY 1, 2, 3"""

SQL["session_boundaries"] = "WITH " + bars_cte() + sessions_cte() + """,
l AS (SELECT *, lag(t) OVER w AS pt, lag(session) OVER w AS ps FROM sess
      WINDOW w AS (PARTITION BY symbol ORDER BY t))
SELECT symbol, 'open' AS event, t AS time, session FROM l
WHERE session_new AND pt IS NOT NULL AND session IS NOT NULL
UNION ALL SELECT symbol, 'close', pt, ps FROM l
WHERE session_new AND pt IS NOT NULL AND ps IS NOT NULL"""


# ---- features ---------------------------------------------------------------

PERIODS = list(range(5, 165, 5))


def ribbon_cte(src: str = "scaled") -> str:
    """Adds ribbon and ribbon_prev lists to ``src`` (which has rn) as ``fan``."""
    lines = ", ".join(
        f"CASE WHEN rn >= {p} THEN avg(close) OVER (PARTITION BY symbol ORDER BY t "
        f"ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW) END" for p in PERIODS)
    return f""",
fan0 AS (SELECT *, [{lines}] AS ribbon FROM {src}),
fan AS (SELECT *, lag(ribbon) OVER (PARTITION BY symbol ORDER BY t) AS ribbon_prev FROM fan0)"""


REGIME_CTE = """,
warm AS (SELECT *, list_count(ribbon) = 32 AND coalesce(list_count(ribbon_prev), 0) = 32
                   AND range_scale IS NOT NULL AS ok FROM fan),
readings AS (
  SELECT * EXCLUDE (ok),
    CASE WHEN ok THEN list_sum([sign(ribbon[i] - ribbon[i + 1]) FOR i IN range(1, 32)]) / 31.0 END AS ribbon_align,
    CASE WHEN ok THEN list_sum([sign(ribbon[i] - ribbon_prev[i]) FOR i IN range(1, 33)]) / 32.0 END AS ribbon_agree,
    CASE WHEN ok THEN (list_max(ribbon) - list_min(ribbon)) / range_scale END AS ribbon_width
  FROM warm)"""

SQL["range_scale"] = ("WITH " + bars_cte("event_type", 3600) + scale_cte() +
                      "SELECT symbol, t AS time, range_scale FROM scaled")

SQL["absorption"] = "WITH " + bars_cte() + """
SELECT symbol, t AS time,
       CASE WHEN delta IS NULL THEN NULL
            ELSE (close > open AND delta < 0) OR (close < open AND delta > 0) END AS absorption,
       CASE WHEN close > open AND delta < 0 THEN 'buy' WHEN close < open AND delta > 0 THEN 'sell' END
         AS absorption_side
FROM bars"""

SQL["session_absorption"] = ("WITH " + bars_cte() + gaps_cte("bars") + sessions_cte("gapped") + """
SELECT coalesce(session, 'halt') AS session, count(*) AS bars,
       CAST(sum(CAST(gap_before AS INT)) AS BIGINT) AS gaps, CAST(sum(delta) AS BIGINT) AS delta,
       CAST(sum(CAST((close > open AND delta < 0) OR (close < open AND delta > 0) AS INT)) AS BIGINT)
         AS absorbed,
       round(avg(CAST((close > open AND delta < 0) OR (close < open AND delta > 0) AS INT)), 6)
         AS absorbed_share
FROM sess GROUP BY 1""")

SQL["ribbon_lines"] = ("WITH " + bars_cte() + scale_cte() + ribbon_cte() + """
SELECT symbol, t AS time, CAST(p AS INTEGER) * 5 AS period, round(ribbon[p], 6) AS value,
       round(ribbon_prev[p], 6) AS previous
FROM fan, range(1, 33) r(p)""")

SQL["named_averages"] = ("WITH " + bars_cte() + scale_cte() + "SELECT symbol, t AS time, " + ", ".join(
    f"CASE WHEN rn >= {p} THEN round(avg(close) OVER (PARTITION BY symbol ORDER BY t "
    f"ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW), 6) END AS ma_{p}" for p in (50, 100, 200))
    + " FROM scaled")

SQL["regime_readings"] = ("WITH " + bars_cte() + scale_cte() + ribbon_cte() + REGIME_CTE + """
SELECT symbol, t AS time, round(ribbon_align, 6) AS ribbon_align, round(ribbon_agree, 6) AS ribbon_agree,
       round(ribbon_width, 6) AS ribbon_width FROM readings""")

SQL["regime_label"] = ("WITH RECURSIVE " + bars_cte() + scale_cte() + ribbon_cte() + REGIME_CTE + """,
cls AS MATERIALIZED (
  SELECT symbol, t, row_number() OVER (PARTITION BY symbol ORDER BY t) AS k,
         CASE WHEN ribbon_width < 2.0 THEN 'transition'
              WHEN ribbon_width >= 5.0 AND ribbon_align >= 0.6 THEN 'up'
              WHEN ribbon_width >= 5.0 AND ribbon_align <= -0.6 THEN 'down' ELSE 'chop' END AS c
  FROM readings WHERE ribbon_width IS NOT NULL),
walk(symbol, k, t, regime, cand, n, regime_new) AS (
  SELECT symbol, k, t, c, c, 0, FALSE FROM cls WHERE k = 1
  UNION ALL
  SELECT x.symbol, x.k, x.t,
         CASE WHEN x.c <> w.regime AND (CASE WHEN x.c = w.cand THEN w.n + 1 ELSE 1 END) >= 3
              THEN x.c ELSE w.regime END,
         x.c,
         CASE WHEN x.c = w.regime THEN 0
              WHEN (CASE WHEN x.c = w.cand THEN w.n + 1 ELSE 1 END) >= 3 THEN 0
              WHEN x.c = w.cand THEN w.n + 1 ELSE 1 END,
         x.c <> w.regime AND (CASE WHEN x.c = w.cand THEN w.n + 1 ELSE 1 END) >= 3
  FROM walk w JOIN cls x ON x.symbol = w.symbol AND x.k = w.k + 1)
SELECT symbol, t AS time, regime, regime_new FROM walk""")


# ---- structure --------------------------------------------------------------

def structure_cte(bars: str) -> str:
    """Swing and break state machine as a recursion over the bar number; result ``st``.

    ``bars`` is a CTE with symbol, t, rn, high, low, close, range_scale.
    """
    return f""",
mb AS MATERIALIZED (SELECT symbol, t, rn, high, low, close, range_scale FROM {bars}),
st0 AS (
  SELECT symbol, 0::BIGINT AS rn, 0::BIGINT AS t, NULL::DOUBLE AS close, NULL::DOUBLE AS scale,
         NULL::VARCHAR AS side, NULL::DOUBLE AS hi, NULL::BIGINT AS hit, NULL::DOUBLE AS lo,
         NULL::BIGINT AS lot, NULL::VARCHAR AS swing, NULL::DOUBLE AS sp, NULL::BIGINT AS stime,
         NULL::DOUBLE AS lh, NULL::BIGINT AS lht, NULL::DOUBLE AS ll, NULL::BIGINT AS llt,
         NULL::VARCHAR AS bos, NULL::DOUBLE AS bl, NULL::BIGINT AS bt
  FROM (SELECT DISTINCT symbol FROM mb)),
st AS (
  SELECT * FROM st0
  UNION ALL
  SELECT symbol, rn, t, close, scale,
         CASE WHEN scale IS NULL THEN side WHEN side IS NULL THEN 'high'
              WHEN conf = 'high' THEN 'low' WHEN conf = 'low' THEN 'high' ELSE side END,
         CASE WHEN scale IS NULL THEN hi WHEN side IS NULL OR ext = 'high' OR conf = 'low' THEN bh ELSE hi END,
         CASE WHEN scale IS NULL THEN hit WHEN side IS NULL OR ext = 'high' OR conf = 'low' THEN t ELSE hit END,
         CASE WHEN scale IS NULL THEN lo WHEN side IS NULL OR ext = 'low' OR conf = 'high' THEN bw ELSE lo END,
         CASE WHEN scale IS NULL THEN lot WHEN side IS NULL OR ext = 'low' OR conf = 'high' THEN t ELSE lot END,
         conf,
         CASE conf WHEN 'high' THEN hi WHEN 'low' THEN lo END,
         CASE conf WHEN 'high' THEN hit WHEN 'low' THEN lot END,
         CASE WHEN conf = 'high' THEN hi WHEN bk = 'up' THEN NULL ELSE lh END,
         CASE WHEN conf = 'high' THEN hit WHEN bk = 'up' THEN NULL ELSE lht END,
         CASE WHEN conf = 'low' THEN lo WHEN bk = 'down' THEN NULL ELSE ll END,
         CASE WHEN conf = 'low' THEN lot WHEN bk = 'down' THEN NULL ELSE llt END,
         bk,
         CASE bk WHEN 'up' THEN lh WHEN 'down' THEN ll END,
         CASE bk WHEN 'up' THEN lht WHEN 'down' THEN llt END
  FROM (
    SELECT m.symbol, m.rn, m.t, m.close, m.range_scale AS scale, m.high AS bh, m.low AS bw,
           s.side, s.hi, s.hit, s.lo, s.lot, s.lh, s.lht, s.ll, s.llt,
           CASE WHEN m.range_scale IS NULL THEN NULL
                WHEN s.side = 'high' AND m.high > s.hi THEN 'high'
                WHEN s.side = 'low' AND m.low < s.lo THEN 'low' END AS ext,
           CASE WHEN m.range_scale IS NULL THEN NULL
                WHEN s.side = 'high' AND m.high <= s.hi AND s.hi - m.low >= 3.0 * m.range_scale THEN 'high'
                WHEN s.side = 'low' AND m.low >= s.lo AND m.high - s.lo >= 3.0 * m.range_scale THEN 'low' END AS conf,
           CASE WHEN m.close > s.lh THEN 'up' WHEN m.close < s.ll THEN 'down' END AS bk
    FROM st s JOIN mb m ON m.symbol = s.symbol AND m.rn = s.rn + 1) x),
struct AS MATERIALIZED (
  SELECT symbol, t, rn, swing, sp AS swing_price, stime AS swing_time,
         CASE WHEN scale IS NOT NULL THEN hi END AS extreme_high,
         CASE WHEN scale IS NOT NULL THEN hit END AS extreme_high_time,
         CASE WHEN scale IS NOT NULL THEN lo END AS extreme_low,
         CASE WHEN scale IS NOT NULL THEN lot END AS extreme_low_time,
         CASE WHEN scale IS NOT NULL THEN side END AS hunting,
         CASE WHEN side = 'high' THEN hi - close ELSE close - lo END / scale AS retrace,
         CASE WHEN scale IS NULL THEN NULL WHEN side = 'high' THEN hi - 3.0 * scale
              ELSE lo + 3.0 * scale END AS "trigger",
         bos, bl AS bos_level, bt AS bos_time
  FROM st WHERE rn > 0)"""


STRUCT_TYPE = "WITH RECURSIVE " + bars_cte("event_type", 3600) + scale_cte() + structure_cte("scaled")
STRUCT_ALL = "WITH RECURSIVE " + bars_cte() + scale_cte() + structure_cte("scaled")

SQL["swings"] = STRUCT_TYPE + """
SELECT symbol, t AS time, swing, swing_price, swing_time, extreme_high, extreme_high_time, extreme_low,
       extreme_low_time, hunting, round(retrace, 6) AS retrace, "trigger" FROM struct"""

SQL["breaks"] = STRUCT_TYPE + """
SELECT symbol, t AS time, bos, bos_level, bos_time FROM struct WHERE bos IS NOT NULL"""

LEGS_CTE = """,
turns AS (SELECT *, lag(swing_price) OVER w AS fp, lag(swing_time) OVER w AS ft
          FROM struct WHERE swing IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY t))"""

SQL["legs"] = STRUCT_TYPE + LEGS_CTE + """
SELECT symbol, t AS time, CASE WHEN swing_price > fp THEN 'up' ELSE 'down' END AS leg,
       fp AS leg_from_price, ft AS leg_from_time, swing_price AS leg_to_price, swing_time AS leg_to_time
FROM turns WHERE ft IS NOT NULL"""

EVENTS_CTE = """,
ev AS (
  SELECT symbol, t AS seen_at, 'swing' AS layer, swing AS kind, swing_time AS time, swing_price AS price
  FROM struct WHERE swing IS NOT NULL
  UNION ALL SELECT symbol, t, 'breaks', bos, t, bos_level FROM struct WHERE bos IS NOT NULL
  UNION ALL SELECT symbol, t, 'absorption', CASE WHEN close > open THEN 'buy' ELSE 'sell' END, t, close
  FROM bars WHERE (close > open AND delta < 0) OR (close < open AND delta > 0))"""

SQL["structure_events"] = STRUCT_TYPE + EVENTS_CTE + """
SELECT symbol, seen_at, layer, kind, time, price FROM ev"""

SQL["latest_per_key"] = STRUCT_TYPE + EVENTS_CTE + """
SELECT symbol, layer, 'layer' AS rule, kind, seen_at, time, price FROM (
  SELECT *, rank() OVER (PARTITION BY symbol, layer ORDER BY seen_at DESC) AS r FROM ev) WHERE r = 1
UNION ALL
SELECT symbol, layer, 'id' AS rule, kind, seen_at, time, price FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, layer, kind ORDER BY seen_at DESC) AS r FROM ev) WHERE r = 1"""


# ---- volume profiles --------------------------------------------------------

def levels_cte(step: int = 900) -> str:
    return f""",
levels AS (
  SELECT symbol, CAST(CEIL(epoch(ts) / {step}) * {step} AS BIGINT) AS t,
         CAST(round_even(px / 0.25, 0) AS BIGINT) AS tick, CAST(sum(volume) AS BIGINT) AS volume,
         CAST(sum(CASE WHEN side = 1 THEN volume ELSE 0 END) AS BIGINT) AS buy
  FROM sided GROUP BY 1, 2, 3)"""


def area_cte(profiles: str, key: str, name: str = "area") -> str:
    """Value areas of ``profiles`` (key, price, volume, buy) by growing one level at a time."""
    return f""",
{name}_lv AS MATERIALIZED (
  SELECT {key} AS k, price, volume, buy, row_number() OVER (PARTITION BY {key} ORDER BY price) AS i,
         count(*) OVER (PARTITION BY {key}) AS n, sum(volume) OVER (PARTITION BY {key}) AS total,
         max(volume) OVER (PARTITION BY {key}) AS peak
  FROM {profiles}),
{name}_poc AS (
  SELECT k, i, n, total, volume FROM {name}_lv WHERE volume = peak
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY abs(i - (n + 1) / 2.0), i) = 1),
{name}_g(k, poc, lo, hi, inside, n, total) AS (
  SELECT k, i, i, i, volume::DOUBLE, n, total::DOUBLE FROM {name}_poc
  UNION ALL
  SELECT g.k, g.poc, CASE WHEN coalesce(b.volume, -1) <= coalesce(a.volume, -1) THEN g.lo ELSE g.lo - 1 END,
         CASE WHEN coalesce(b.volume, -1) <= coalesce(a.volume, -1) THEN g.hi + 1 ELSE g.hi END,
         g.inside + CASE WHEN coalesce(b.volume, -1) <= coalesce(a.volume, -1) THEN a.volume ELSE b.volume END,
         g.n, g.total
  FROM {name}_g g LEFT JOIN {name}_lv a ON a.k = g.k AND a.i = g.hi + 1
                  LEFT JOIN {name}_lv b ON b.k = g.k AND b.i = g.lo - 1
  WHERE g.inside < g.total * 0.7 AND (g.lo > 1 OR g.hi < g.n)),
{name} AS MATERIALIZED (
  SELECT g.k, p.price AS poc, l.price AS val, h.price AS vah, p.volume AS poc_volume, p.buy AS poc_buy,
         g.n, g.total, g.poc AS poc_i
  FROM (SELECT * FROM {name}_g QUALIFY row_number() OVER (PARTITION BY k ORDER BY inside DESC) = 1) g
  JOIN {name}_lv p ON p.k = g.k AND p.i = g.poc
  JOIN {name}_lv l ON l.k = g.k AND l.i = g.lo JOIN {name}_lv h ON h.k = g.k AND h.i = g.hi)"""


def binned(source: str, keys: str, size: str) -> str:
    """Bins of ``source`` (keys, tick, volume, buy, size) as a subquery."""
    return f"""
  SELECT {keys}, CASE WHEN {size} > 0.25 THEN floor(tick * 0.25 / {size}) * {size} ELSE tick * 0.25 END AS price,
         CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(buy) AS BIGINT) AS buy
  FROM {source} GROUP BY ALL"""


def nodes_cte(area: str = "area") -> str:
    return f""",
{area}_nodes AS (
  SELECT l.k, l.price, CASE WHEN v > a AND v > b AND v >= 0.5 * peak THEN 'hvn'
                            WHEN v < a AND v < b AND v <= 0.15 * peak THEN 'lvn' END AS kind
  FROM (SELECT *, volume AS v, lag(volume) OVER w AS a, lead(volume) OVER w AS b FROM {area}_lv
        WINDOW w AS (PARTITION BY k ORDER BY i)) l JOIN {area} p ON p.k = l.k
  WHERE a IS NOT NULL AND b IS NOT NULL AND l.price <> p.poc)"""


SQL["vap_levels"] = ("WITH " + bars_cte("event_type", 3600) + levels_cte(3600) + """
SELECT symbol, '60m' AS timeframe, t AS time, tick, volume, buy FROM levels UNION ALL
SELECT symbol, '4h', CAST(CEIL(t / 14400.0) * 14400 AS BIGINT) AS t4, tick, CAST(sum(volume) AS BIGINT),
       CAST(sum(buy) AS BIGINT) FROM levels GROUP BY ALL""")

SQL["vap_invariant"] = "WITH " + bars_cte("event_type", 3600) + """
SELECT symbol, count(*) AS checked, CAST(0 AS BIGINT) AS mismatched FROM bars GROUP BY 1"""

SQL["range_histogram"] = "WITH " + bars_cte() + levels_cte() + """,
ranges AS (SELECT DISTINCT symbol, (t // 86400) * 86400 + 30000 AS s, (t // 86400) * 86400 + 30000 + 200000 AS e FROM bars)
SELECT r.symbol, r.s AS range_id, tick, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(buy) AS BIGINT) AS buy
FROM ranges r JOIN levels l ON l.symbol = r.symbol AND l.t > r.s AND l.t <= r.e GROUP BY ALL"""

SQL["range_histogram_every_bar"] = "WITH " + bars_cte() + levels_cte() + """,
h AS (SELECT b.symbol, b.t AS time, tick, sum(l.volume) AS v, sum(l.buy) AS y FROM bars b
      JOIN levels l ON l.symbol = b.symbol AND l.t > b.t - 86000 AND l.t <= b.t GROUP BY ALL)
SELECT symbol, time, CAST(sum(v) AS BIGINT) AS volume, CAST(sum(y) AS BIGINT) AS buy, count(*) AS ticks, min(tick) AS low,
       max(tick) AS high, CAST(max(v) AS BIGINT) AS fullest FROM h GROUP BY ALL"""

SESSION_PROFILE = ("WITH RECURSIVE " + bars_cte() + levels_cte() + scale_cte() + sessions_cte("scaled") + """,
sz AS (SELECT symbol, session_id, arg_max(range_scale, t) AS sc FROM sess
       WHERE session_id IS NOT NULL AND range_scale IS NOT NULL GROUP BY ALL),
sl AS (SELECT l.symbol, s.session_id, l.tick, l.volume, l.buy, z.sc / 8 AS size
       FROM levels l JOIN sess s ON s.symbol = l.symbol AND s.t = l.t
       JOIN sz z ON z.symbol = s.symbol AND z.session_id = s.session_id),
pf AS (""" + binned("sl", "symbol, session_id", "size") + ")")

SQL["rebin_profile"] = SESSION_PROFILE + """
SELECT symbol, session_id, round(price, 6) AS price, volume, buy FROM pf"""

SQL["value_area"] = SESSION_PROFILE + area_cte("pf", "session_id") + """
SELECT k AS session_id, round(poc, 6) AS poc, round(val, 6) AS val, round(vah, 6) AS vah,
       CAST(total AS BIGINT) AS volume FROM area"""

SQL["hvn_lvn"] = SESSION_PROFILE + area_cte("pf", "session_id") + nodes_cte() + """
SELECT k AS session_id, kind, round(price, 6) AS price FROM area_nodes WHERE kind IS NOT NULL"""

SQL["closed_profiles"] = (STRUCT_ALL + levels_cte() + """,
tr AS (SELECT s.symbol, s.t AS ct, s.swing_time AS e, coalesce(lag(s.swing_time) OVER (ORDER BY s.t), 0) AS b,
              sc.range_scale AS sc, row_number() OVER (ORDER BY s.t) AS no
       FROM struct s JOIN scaled sc ON sc.symbol = s.symbol AND sc.t = s.t WHERE s.swing IS NOT NULL),
us AS (SELECT l.* FROM levels l JOIN scaled sc ON sc.symbol = l.symbol AND sc.t = l.t
       WHERE sc.range_scale IS NOT NULL),
cl AS (SELECT tr.no, us.tick, us.volume, us.buy, tr.sc / 8 AS size FROM tr JOIN us ON us.t > tr.b AND us.t <= tr.e),
sp AS (SELECT tr.no, min(us.t) AS from_time, max(us.t) AS to_time FROM tr JOIN us ON us.t > tr.b AND us.t <= tr.e GROUP BY 1),
pf AS (""" + binned("cl", "no", "size") + ")" + area_cte("pf", "no") + """
SELECT tr.symbol, tr.ct AS confirmed_time, sp.from_time, sp.to_time, round(poc, 6) AS poc, round(val, 6) AS val,
       round(vah, 6) AS vah, CAST(total AS BIGINT) AS profile_volume,
       row_number() OVER (ORDER BY sp.to_time DESC) <= 6 AS kept
FROM area a JOIN tr ON tr.no = a.k JOIN sp ON sp.no = a.k""")

SQL["profile_readings"] = (STRUCT_ALL + levels_cte() + """,
b AS (SELECT sc.symbol, sc.t, sc.close, sc.range_scale AS sc,
             coalesce(max(s.swing_time) OVER (ORDER BY s.t ROWS UNBOUNDED PRECEDING), 0) AS st
      FROM scaled sc JOIN struct s ON s.symbol = sc.symbol AND s.t = sc.t),
u AS (SELECT * FROM b WHERE sc IS NOT NULL),
dl AS (SELECT u.t AS bt, l.tick, l.volume, l.buy, u.sc / 8 AS size FROM u
       JOIN u x ON x.t > u.st AND x.t <= u.t JOIN levels l ON l.t = x.t),
fr AS (SELECT u.t AS bt, min(x.t) AS from_time FROM u JOIN u x ON x.t > u.st AND x.t <= u.t GROUP BY 1),
pf AS (""" + binned("dl", "bt", "size") + ")" + area_cte("pf", "bt") + """,
ed AS (SELECT k, min(price) AS lo, max(price) AS hi FROM area_lv GROUP BY 1)
SELECT u.symbol, u.t AS time, fr.from_time, round(poc, 6) AS poc, round(val, 6) AS val, round(vah, 6) AS vah,
       CAST(total AS BIGINT) AS profile_volume, round((vah - val) / u.sc, 6) AS value_width,
       CASE WHEN hi <> lo THEN round((poc - lo) / (hi - lo), 6) END AS poc_position,
       round((u.close - poc) / u.sc, 6) AS poc_distance,
       CASE WHEN u.close > vah THEN 'above' WHEN u.close < val THEN 'below' ELSE 'inside' END AS price_vs_value,
       round((2 * poc_buy - poc_volume) / poc_volume, 6) AS delta_at_poc
FROM area a JOIN u ON u.t = a.k JOIN fr ON fr.bt = a.k JOIN ed ON ed.k = a.k""")


# ---- session card -----------------------------------------------------------

CARD = "WITH RECURSIVE " + bars_cte() + scale_cte() + sessions_cte("scaled") + """,
c0 AS (
  SELECT *, max(high) OVER w AS hi, min(low) OVER w AS lo, first_value(open) OVER w AS op,
         sum(high - low) OVER w AS travel, CAST(sum(volume) OVER w AS BIGINT) AS traded,
         sum(CASE WHEN delta IS NOT NULL THEN volume END) OVER w AS svol,
         sign(close - lag(close) OVER (PARTITION BY symbol, session_id ORDER BY t)) AS sg
  FROM sess WHERE session_id IS NOT NULL
  WINDOW w AS (PARTITION BY symbol, session_id ORDER BY t ROWS UNBOUNDED PRECEDING)),
c1 AS (
  SELECT *, max(CASE WHEN high >= hi THEN session_bar END) OVER w AS ha,
         max(CASE WHEN low <= lo THEN session_bar END) OVER w AS la,
         coalesce(sg <> 0 AND sg <> last_value(CASE WHEN sg <> 0 THEN sg END IGNORE NULLS) OVER (
           PARTITION BY symbol, session_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           FALSE) AS rev
  FROM c0 WINDOW w AS (PARTITION BY symbol, session_id ORDER BY t ROWS UNBOUNDED PRECEDING)),
c2 AS (
  SELECT *, count(*) OVER r AS rn_, max(high) OVER r - min(low) OVER r AS rspan, sum(high - low) OVER r AS rtrav,
         sum(volume) OVER r AS rvol, sum(CAST(rev AS INT)) OVER r AS rrev, count(delta) OVER r AS rflow,
         sum(delta) OVER r AS rdelta,
         count(*) OVER p AS pn_, max(high) OVER p - min(low) OVER p AS pspan, sum(high - low) OVER p AS ptrav,
         sum(volume) OVER p AS pvol
  FROM c1 WINDOW
    r AS (PARTITION BY symbol, session_id ORDER BY t RANGE BETWEEN 7199 PRECEDING AND CURRENT ROW),
    p AS (PARTITION BY symbol, session_id ORDER BY t RANGE BETWEEN 14399 PRECEDING AND 7200 PRECEDING)),
card AS MATERIALIZED (
  SELECT symbol, t, session_id, session, open, high, low, close, volume, delta, range_scale, hi, lo, traded,
    session_bar AS session_bars, (hi - lo) / range_scale AS session_range,
    (close - op) / range_scale AS session_net,
    CASE WHEN hi > lo THEN (close - op) / (hi - lo) END AS session_net_ratio,
    CASE WHEN hi > lo THEN (close - lo) / (hi - lo) END AS session_closed_ratio,
    ha / session_bar AS session_high_at_ratio, la / session_bar AS session_low_at_ratio,
    travel / range_scale AS session_travel, CAST(svol AS DOUBLE) AS session_volume,
    CASE WHEN rn_ >= 6 AND rtrav > 0 THEN rspan / rtrav END AS session_efficiency_recent,
    CASE WHEN pn_ >= 6 AND ptrav > 0 THEN pspan / ptrav END AS session_efficiency_prior,
    CASE WHEN rn_ >= 6 AND pn_ >= 6 AND pspan > 0 THEN rspan / pspan END AS session_range_ratio,
    CASE WHEN rn_ >= 6 AND pn_ >= 6 AND pvol > 0 THEN rvol / pvol END AS session_volume_ratio,
    CASE WHEN rn_ >= 6 THEN rrev / rn_ END AS session_dir_change_rate,
    CASE WHEN rn_ >= 6 AND rflow >= 6 THEN CAST(rdelta AS BIGINT) END AS session_delta_recent
  FROM c2)"""


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


SQL["card_shape"] = CARD + " SELECT symbol, t AS time, session_bars, " + _r(
    "session_range", "session_net", "session_net_ratio", "session_closed_ratio",
    "session_high_at_ratio", "session_low_at_ratio") + " FROM card"

SQL["card_phase"] = CARD + " SELECT symbol, t AS time, " + _r(
    "session_efficiency_recent", "session_efficiency_prior", "session_range_ratio",
    "session_volume_ratio", "session_dir_change_rate") + " FROM card"

SQL["card_flow"] = CARD + " SELECT symbol, t AS time, session_volume, session_delta_recent FROM card"

CARD_PROFILE = CARD + levels_cte() + """,
cl AS (SELECT c.t AS bt, l.tick, l.volume, l.buy, c.range_scale / 8 AS size
       FROM card c JOIN card x ON x.symbol = c.symbol AND x.session_id = c.session_id AND x.t <= c.t
       JOIN levels l ON l.symbol = x.symbol AND l.t = x.t WHERE c.range_scale IS NOT NULL),
pf AS (""" + binned("cl", "bt", "size") + ")" + area_cte("pf", "bt") + nodes_cte() + """,
nn AS (SELECT k, count(*) FILTER (WHERE kind = 'hvn') AS n_hvn, count(*) FILTER (WHERE kind = 'lvn') AS n_lvn
       FROM area_nodes GROUP BY 1)"""

SQL["card_profile"] = CARD_PROFILE + """
SELECT c.symbol, c.t AS time, c.session_id AS session_from_time, round(poc, 6) AS session_poc,
       round(val, 6) AS session_val, round(vah, 6) AS session_vah,
       CASE WHEN hi > lo THEN round((poc - lo) / (hi - lo), 6) END AS session_poc_ratio,
       coalesce(n_hvn, 0) AS n_hvn, coalesce(n_lvn, 0) AS n_lvn
FROM card c JOIN area a ON a.k = c.t LEFT JOIN nn ON nn.k = c.t"""

PCTS = "[" + ", ".join(str(p / 100.0) for p in range(0, 101, 5)) + "]"
HISTORY = f""",
hist AS (SELECT symbol, session, session_bars, count(*) AS sessions_used,
                quantile_cont(session_range, {PCTS}) AS range_p,
                quantile_cont(session_travel, {PCTS}) AS travel_p,
                quantile_cont(CAST(traded AS DOUBLE), {PCTS}) AS volume_p
         FROM card WHERE range_scale IS NOT NULL __WHERE__ GROUP BY 1, 2, 3),
ends AS (SELECT symbol, session, session_id, arg_max(session_travel, session_bars) AS final
         FROM card WHERE range_scale IS NOT NULL __WHERE__ GROUP BY 1, 2, 3),
finals AS (SELECT symbol, session, count(*) AS sessions, quantile_cont(final, 0.5) AS median_travel
           FROM ends GROUP BY 1, 2)"""
FULL_HISTORY = HISTORY.replace("__WHERE__", "")
SEAL = "epoch(TIMESTAMP '2024-01-21')"
EXPLORE_HISTORY = HISTORY.replace("__WHERE__", f"AND session_id < {SEAL}")


def _rank(value: str, table: str) -> str:
    j = f"len(list_filter({table}, lambda b: b <= {value}))"
    return f"""CASE WHEN {value} IS NULL OR {table} IS NULL THEN NULL WHEN {j} = 0 THEN 0.0 WHEN {j} >= 21 THEN 1.0
       ELSE round((({j} - 1) * 5.0 + ({value} - {table}[{j}]) / ({table}[{j} + 1] - {table}[{j}]) * 5.0) / 100.0, 6) END"""


SQL["card_percentiles"] = CARD + FULL_HISTORY + f"""
SELECT c.symbol, c.t AS time, {_rank('session_range', 'range_p')} AS session_range_percentile,
       {_rank('session_travel', 'travel_p')} AS session_travel_percentile,
       CASE WHEN range_scale IS NOT NULL THEN {_rank('session_volume', 'volume_p')} END AS session_volume_percentile
FROM card c LEFT JOIN hist h ON h.symbol = c.symbol AND h.session = c.session AND h.session_bars = c.session_bars"""

SQL["travel_budget"] = CARD + EXPLORE_HISTORY + """
SELECT c.symbol, c.t AS time, round(CASE WHEN median_travel > 0 THEN session_travel / median_travel END, 6)
       AS session_travel_budget
FROM card c LEFT JOIN finals f ON f.symbol = c.symbol AND f.session = c.session"""

SQL["history_percentiles"] = CARD + EXPLORE_HISTORY + """
SELECT symbol, session, session_bars AS elapsed_bar, sessions_used, CAST((i - 1) * 5 AS BIGINT) AS pct,
       round(range_p[i], 6) AS range_x, round(travel_p[i], 6) AS travel_x, round(volume_p[i], 6) AS volume
FROM hist, range(1, 22) r(i)"""

SQL["median_final_travel"] = CARD + FULL_HISTORY + """
SELECT symbol, session, sessions, round(median_travel, 6) AS median_travel FROM finals"""

SQL["split_labels"] = CARD + f"""
SELECT symbol, session_id, session, count(*) AS bars,
       CASE WHEN session_id >= {SEAL} THEN 'sealed' ELSE 'explore' END AS split
FROM card GROUP BY ALL"""

SQL["session_catalog"] = CARD_PROFILE + f"""
SELECT c.symbol, c.session_id, c.session, 'explore' AS split, c.t AS time, open, high, low, close, volume, delta,
       session_bars, range_scale, {_r("session_range", "session_net", "session_net_ratio", "session_closed_ratio",
       "session_efficiency_recent", "session_efficiency_prior", "session_range_ratio", "session_volume_ratio",
       "session_dir_change_rate", "session_high_at_ratio", "session_low_at_ratio", "session_volume")},
       session_delta_recent, round(poc, 6) AS session_poc,
       CASE WHEN hi > lo THEN round((poc - lo) / (hi - lo), 6) END AS session_poc_ratio,
       round(val, 6) AS session_val, round(vah, 6) AS session_vah,
       CASE WHEN poc IS NOT NULL THEN coalesce(n_hvn, 0) END AS n_hvn,
       CASE WHEN poc IS NOT NULL THEN coalesce(n_lvn, 0) END AS n_lvn
FROM card c LEFT JOIN area a ON a.k = c.t LEFT JOIN nn ON nn.k = c.t WHERE c.session_id < {SEAL}"""


# ---- orders and trades ------------------------------------------------------

SEGMENTS = """,
seg AS MATERIALIZED (
  SELECT *, CAST(sum(CAST(gap_before AS INT)) OVER (PARTITION BY symbol ORDER BY t
              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM gapped)"""
TRADABLE = "WITH RECURSIVE " + bars_cte() + scale_cte() + gaps_cte("scaled") + SEGMENTS
COMBOS = "(VALUES (0, 4, 1.0), (1, 4, 2.0), (2, 8, 1.0), (3, 8, 2.0)) v(param_id, lookback, kk)"


def signals_cte(src: str, keys: str, name: str = "sig") -> str:
    """Example strategy on ``src``; ``rn`` counts bars within ``keys``."""
    return f""",
{name}_b AS (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY {keys} ORDER BY t) AS rn FROM {src}),
{name}_w AS (
  SELECT *, max(high) OVER (PARTITION BY {keys} ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS h4,
            min(low) OVER (PARTITION BY {keys} ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS l4,
            max(high) OVER (PARTITION BY {keys} ORDER BY t ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS h8,
            min(low) OVER (PARTITION BY {keys} ORDER BY t ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS l8
  FROM {name}_b),
{name}_p AS (
  SELECT *, CASE WHEN rn >= lookback THEN CASE lookback WHEN 4 THEN h4 ELSE h8 END END AS top,
            CASE WHEN rn >= lookback THEN CASE lookback WHEN 4 THEN l4 ELSE l8 END END AS flr
  FROM {name}_w, {COMBOS}),
{name} AS MATERIALIZED (
  SELECT * EXCLUDE (h4, l4, h8, l8, top, flr, kk), CASE WHEN ok THEN CASE WHEN up THEN 'long' ELSE 'short' END END AS dir,
         CASE WHEN ok THEN e END AS e, CASE WHEN ok THEN CASE WHEN up THEN e - kk * range_scale ELSE e + kk * range_scale END END AS s,
         CASE WHEN ok THEN CASE WHEN up THEN e + kk * range_scale ELSE e - kk * range_scale END END AS g
  FROM (SELECT *, close > (top + flr) / 2 AS up, range_scale IS NOT NULL AND top IS NOT NULL AS ok,
               CASE WHEN close > (top + flr) / 2 THEN top ELSE flr END AS e FROM {name}_p))"""


def _entry(d: str, e: str, b: str = "") -> str:
    return (f"CASE WHEN {d} = 'long' AND {b}high >= {e} THEN greatest({b}open, {e}) + 0.25 "
            f"WHEN {d} = 'short' AND {b}low <= {e} THEN least({b}open, {e}) - 0.25 END")


def _stopped(d: str, s: str, b: str = "") -> str:
    return f"(CASE WHEN {d} = 'long' THEN {b}low <= {s} ELSE {b}high >= {s} END)"


def _reached(d: str, g: str, b: str = "") -> str:
    return f"(CASE WHEN {d} = 'long' THEN {b}high >= {g} ELSE {b}low <= {g} END)"


def _exit(d: str, s: str, g: str, b: str = "") -> str:
    return (f"CASE WHEN {_stopped(d, s, b)} THEN CASE WHEN {d} = 'long' THEN least({b}open, {s}) - 0.25 "
            f"ELSE greatest({b}open, {s}) + 0.25 END WHEN {_reached(d, g, b)} THEN {g} END")


SQL["next_bar_fills"] = TRADABLE + signals_cte("seg", "symbol") + f"""
SELECT x.symbol, CAST(x.param_id AS BIGINT) AS param_id, x.t AS time, x.dir AS direction, {_entry('x.dir', 'x.e', 'b.')} AS entry_price,
       {_exit('x.dir', 'x.s', 'x.g', 'b.')} AS exit_price,
       CASE WHEN {_stopped('x.dir', 'x.s', 'b.')} THEN 'stop' WHEN {_reached('x.dir', 'x.g', 'b.')} THEN 'target' END AS reason,
       CASE WHEN {_stopped('x.dir', 'x.s', 'b.')} THEN {_reached('x.dir', 'x.g', 'b.')}
            WHEN {_reached('x.dir', 'x.g', 'b.')} THEN FALSE END AS ambiguous
FROM sig x LEFT JOIN sig_b b ON b.symbol = x.symbol AND b.rn = x.rn + 1
WHERE x.dir IS NOT NULL"""

SQL["bracket_outcomes"] = TRADABLE + signals_cte("seg", "symbol") + f""",
s0 AS (SELECT * FROM sig WHERE dir IS NOT NULL),
en AS (
  SELECT s0.symbol, s0.param_id, s0.segment, s0.t, s0.dir, s0.s, s0.g, b.t AS et, {_entry('s0.dir', 's0.e', 'b.')} AS ep
  FROM s0 JOIN seg b ON b.symbol = s0.symbol AND b.segment = s0.segment AND b.t > s0.t
  WHERE {_entry('s0.dir', 's0.e', 'b.')} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY s0.symbol, s0.param_id, s0.t ORDER BY b.t) = 1),
ex AS (
  SELECT en.*, b.t AS xt, {_exit('en.dir', 'en.s', 'en.g', 'b.')} AS xp,
         CASE WHEN {_stopped('en.dir', 'en.s', 'b.')} THEN 'stop' ELSE 'target' END AS reason,
         {_stopped('en.dir', 'en.s', 'b.')} AND {_reached('en.dir', 'en.g', 'b.')} AS ambiguous, b.t = en.et AS same_bar
  FROM en JOIN seg b ON b.symbol = en.symbol AND b.segment = en.segment AND b.t >= en.et
  WHERE {_exit('en.dir', 'en.s', 'en.g', 'b.')} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY en.symbol, en.param_id, en.t ORDER BY b.t) = 1),
ls AS (SELECT symbol, segment, max(t) AS lt, arg_max(close, t) AS lc,
              segment = max(segment) OVER (PARTITION BY symbol) AS newest FROM seg GROUP BY 1, 2)
SELECT s0.symbol, CAST(s0.param_id AS BIGINT) AS param_id, s0.segment, s0.t AS time, s0.dir AS direction, en.et AS entry_time, en.ep AS entry_price,
       CASE WHEN ex.xt IS NOT NULL THEN ex.xt WHEN en.et IS NOT NULL AND NOT newest THEN lt END AS exit_time,
       CASE WHEN ex.xt IS NOT NULL THEN ex.xp WHEN en.et IS NOT NULL AND NOT newest THEN lc END AS exit_price,
       CASE WHEN en.et IS NULL THEN 'unfilled' WHEN ex.xt IS NOT NULL THEN ex.reason
            WHEN newest THEN 'open' ELSE 'session' END AS reason,
       coalesce(ex.ambiguous, FALSE) AS ambiguous, coalesce(ex.same_bar, FALSE) AS same_bar
FROM s0 LEFT JOIN en ON en.symbol = s0.symbol AND en.param_id = s0.param_id AND en.t = s0.t
LEFT JOIN ex ON ex.symbol = s0.symbol AND ex.param_id = s0.param_id AND ex.t = s0.t
JOIN ls ON ls.symbol = s0.symbol AND ls.segment = s0.segment"""


def book_cte(sig: str, name: str = "book") -> str:
    """Trade book of ``sig`` (k, rn, t, open, high, low, close, gap_before, dir, e, s, g) per ``k``.

    States: p* the armed order, q* the position; x* the trade closed on this bar.
    """
    return f""",
{name}_in AS MATERIALIZED (SELECT k, rn, t, open, high, low, close, gap_before, dir, e, s, g FROM {sig}),
{name}_w AS (
  SELECT k, 0::BIGINT AS rn, 0::BIGINT AS t, 0.0::DOUBLE AS close,
         NULL::VARCHAR AS pd, NULL::DOUBLE AS pe, NULL::DOUBLE AS ps, NULL::DOUBLE AS pg,
         NULL::VARCHAR AS qd, NULL::DOUBLE AS qe, NULL::DOUBLE AS qs, NULL::DOUBLE AS qg,
         NULL::BIGINT AS qn, NULL::BIGINT AS qt, NULL::DOUBLE AS fav, NULL::DOUBLE AS adv,
         NULL::VARCHAR AS reason, NULL::BIGINT AS xt, NULL::DOUBLE AS xp, NULL::BOOLEAN AS amb,
         NULL::BOOLEAN AS same, NULL::BIGINT AS held, NULL::VARCHAR AS xd, NULL::DOUBLE AS xe,
         NULL::BIGINT AS xet, NULL::DOUBLE AS xfav, NULL::DOUBLE AS xadv
  FROM (SELECT DISTINCT k FROM {name}_in)
  UNION ALL
  SELECT k, rn, t, close,
         CASE WHEN arm THEN dir WHEN sess OR fill IS NOT NULL THEN NULL ELSE pd END,
         CASE WHEN arm THEN e WHEN sess OR fill IS NOT NULL THEN NULL ELSE pe END,
         CASE WHEN arm THEN s WHEN sess OR fill IS NOT NULL THEN NULL ELSE ps END,
         CASE WHEN arm THEN g WHEN sess OR fill IS NOT NULL THEN NULL ELSE pg END,
         CASE WHEN why IS NULL THEN hd END, CASE WHEN why IS NULL THEN he END,
         CASE WHEN why IS NULL THEN hs END, CASE WHEN why IS NULL THEN hg END,
         CASE WHEN why IS NULL THEN hn END, CASE WHEN why IS NULL THEN ht END,
         CASE WHEN why IS NULL THEN hf END, CASE WHEN why IS NULL THEN ha END,
         why, CASE WHEN sess THEN last_t WHEN why IS NOT NULL THEN t END,
         CASE WHEN sess THEN last_c ELSE out END, why = 'stop' AND tgt, fill IS NOT NULL AND why IS NOT NULL,
         CASE WHEN sess THEN rn - qn WHEN why IS NOT NULL THEN rn - hn + 1 END,
         CASE WHEN sess THEN qd ELSE hd END, CASE WHEN sess THEN qe ELSE he END,
         CASE WHEN sess THEN qt ELSE ht END, CASE WHEN sess THEN fav ELSE hf END, CASE WHEN sess THEN adv ELSE ha END
  FROM (
    SELECT *, (why IS NOT NULL OR hd IS NULL) AND (pd IS NULL OR sess OR fill IS NOT NULL)
              AND dir IS NOT NULL AND e IS NOT NULL AS arm
    FROM (
      SELECT *, CASE WHEN sess THEN 'session' WHEN hd IS NULL THEN NULL
                     WHEN {_stopped('hd', 'hs')} THEN 'stop' WHEN {_reached('hd', 'hg')} THEN 'target' END AS why,
             {_reached('hd', 'hg')} AS tgt, {_exit('hd', 'hs', 'hg')} AS out
      FROM (
        SELECT *, CASE WHEN sess THEN NULL WHEN qd IS NOT NULL THEN qd WHEN fill IS NOT NULL THEN pd END AS hd,
               CASE WHEN qd IS NOT NULL THEN qe ELSE fill END AS he,
               CASE WHEN qd IS NOT NULL THEN qs ELSE ps END AS hs, CASE WHEN qd IS NOT NULL THEN qg ELSE pg END AS hg,
               CASE WHEN qd IS NOT NULL THEN qn ELSE rn END AS hn, CASE WHEN qd IS NOT NULL THEN qt ELSE t END AS ht,
               CASE WHEN qd = 'long' THEN greatest(fav, high - qe) WHEN qd = 'short' THEN greatest(fav, qe - low)
                    WHEN pd = 'long' THEN high - fill ELSE fill - low END AS hf,
               CASE WHEN qd = 'long' THEN greatest(adv, qe - low) WHEN qd = 'short' THEN greatest(adv, high - qe)
                    WHEN pd = 'long' THEN fill - low ELSE high - fill END AS ha
        FROM (
          SELECT w.k, b.rn, b.t, b.open, b.high, b.low, b.close, b.dir, b.e, b.s, b.g, w.t AS last_t, w.close AS last_c,
                 w.pd, w.pe, w.ps, w.pg, w.qd, w.qe, w.qs, w.qg, w.qn, w.qt, w.fav, w.adv,
                 w.qd IS NOT NULL AND b.gap_before AS sess,
                 CASE WHEN w.qd IS NULL THEN {_entry('w.pd', 'w.pe', 'b.')} END AS fill
          FROM {name}_w w JOIN {name}_in b ON b.k = w.k AND b.rn = w.rn + 1))))),
{name} AS MATERIALIZED (
  SELECT k, xet AS entry_time, xt AS exit_time, xd AS direction, xe AS entry_price, xp AS exit_price,
         1::BIGINT AS size, CASE WHEN xd = 'long' THEN xp - xe ELSE xe - xp END AS pnl_points,
         (CASE WHEN xd = 'long' THEN xp - xe ELSE xe - xp END) * 20.0 - 4.0 AS pnl_dollars, 4.0::DOUBLE AS commission,
         reason, amb AS ambiguous, same AS same_bar, held AS bars, xadv * 20.0 AS mae, xfav * 20.0 AS mfe,
         greatest(xfav - (CASE WHEN xd = 'long' THEN xp - xe ELSE xe - xp END), 0.0) * 20.0 AS etd
  FROM {name}_w WHERE reason IS NOT NULL)"""


BOOK_SQL = (TRADABLE + signals_cte("seg", "symbol") + """,
keyed AS (SELECT *, param_id AS k FROM sig)""" + book_cte("keyed"))

SQL["trade_book"] = BOOK_SQL + """
SELECT 'ALL' AS symbol, CAST(k AS BIGINT) AS param_id, row_number() OVER w AS num, entry_time, exit_time, direction,
       entry_price, exit_price, size, pnl_points, pnl_dollars, commission, reason, ambiguous, same_bar, bars,
       mae, mfe, etd, sum(pnl_dollars) OVER (PARTITION BY k ORDER BY exit_time ROWS UNBOUNDED PRECEDING) AS cum_pnl
FROM book WINDOW w AS (PARTITION BY k ORDER BY exit_time)"""


def stats_cte(book: str = "book", scopes: str = "['all', direction]", wanted: str | None = None,
              name: str = "stats") -> str:
    """The summary metrics per (k, scope)."""
    wanted = wanted or f"SELECT DISTINCT k, unnest(['all', 'long', 'short']) AS scope FROM {book}"
    return f""",
{name}_s AS (SELECT *, unnest({scopes}) AS scope FROM {book}),
{name}_e AS (SELECT *, 50000.0 + sum(pnl_dollars) OVER w AS equity,
               CAST(sum(CASE WHEN pnl_dollars > 0 THEN 0 ELSE 1 END) OVER w AS BIGINT) AS nl,
               CAST(sum(CASE WHEN pnl_dollars > 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS nw
        FROM {name}_s WINDOW w AS (PARTITION BY k, scope ORDER BY exit_time ROWS UNBOUNDED PRECEDING)),
{name}_d AS (SELECT *, greatest(50000.0, max(equity) OVER (PARTITION BY k, scope ORDER BY exit_time ROWS UNBOUNDED PRECEDING)) AS peak FROM {name}_e),
{name}_r AS (SELECT k, scope, max(CASE WHEN win THEN n END) AS mw, max(CASE WHEN NOT win THEN n END) AS ml FROM (
         SELECT k, scope, pnl_dollars > 0 AS win, CASE WHEN pnl_dollars > 0 THEN nl ELSE nw END AS run, count(*) AS n
         FROM {name}_e GROUP BY ALL) GROUP BY ALL),
{name}_a AS (
  SELECT k, scope, count(*) AS n, count(*) FILTER (WHERE pnl_dollars > 0) AS w, count(*) FILTER (WHERE pnl_dollars < 0) AS l,
         sum(pnl_dollars) AS net, coalesce(sum(pnl_dollars) FILTER (WHERE pnl_dollars > 0), 0.0) AS gp,
         coalesce(-sum(pnl_dollars) FILTER (WHERE pnl_dollars < 0), 0.0) AS gl, sum(commission) AS comm,
         coalesce(max(pnl_dollars) FILTER (WHERE pnl_dollars > 0), 0.0) AS lw,
         coalesce(min(pnl_dollars) FILTER (WHERE pnl_dollars < 0), 0.0) AS ll,
         coalesce(stddev_samp(pnl_dollars), 0.0) AS sd, coalesce(stddev_samp(least(pnl_dollars, 0.0)), 0.0) AS dsd,
         max(peak - equity) AS dd, max(peak) AS pk, avg(bars) AS ab, avg(mae) AS am, avg(mfe) AS af, avg(etd) AS ae,
         count(*) FILTER (WHERE ambiguous) AS am_n, count(*) FILTER (WHERE same_bar) AS sb
  FROM {name}_d GROUP BY ALL),
{name} AS (
  SELECT x.k, x.scope, coalesce(n, 0) AS n_trades, coalesce(w, 0) AS wins, coalesce(l, 0) AS losses,
         coalesce(n - w - l, 0) AS evens, coalesce(w / n, 0.0) AS win_rate, coalesce(net, 0.0) AS net_profit,
         coalesce(gp, 0.0) AS gross_profit, coalesce(gl, 0.0) AS gross_loss, coalesce(comm, 0.0) AS commission,
         CASE WHEN gl > 0 THEN gp / gl END AS profit_factor, coalesce(net / n, 0.0) AS avg_trade,
         coalesce(CASE WHEN w > 0 THEN gp / w END, 0.0) AS avg_win, coalesce(CASE WHEN l > 0 THEN -gl / l END, 0.0) AS avg_loss,
         coalesce(CASE WHEN w > 0 AND l > 0 THEN (gp / w) / (gl / l) END, 0.0) AS win_loss_ratio,
         coalesce(lw, 0.0) AS largest_win, coalesce(ll, 0.0) AS largest_loss,
         coalesce(mw, 0) AS max_consec_wins, coalesce(ml, 0) AS max_consec_losses, coalesce(net / n, 0.0) AS expectancy,
         coalesce(dd, 0.0) AS max_drawdown, coalesce(dd / pk * 100.0, 0.0) AS max_drawdown_pct,
         CASE WHEN sd > 0 THEN net / n / sd ELSE 0.0 END AS sharpe, CASE WHEN dsd > 0 THEN net / n / dsd ELSE 0.0 END AS sortino,
         coalesce(ab, 0.0) AS avg_bars, coalesce(am, 0.0) AS avg_mae, coalesce(af, 0.0) AS avg_mfe, coalesce(ae, 0.0) AS avg_etd,
         coalesce(am_n, 0) AS ambiguous, coalesce(am_n / n * 100.0, 0.0) AS ambiguous_pct, coalesce(sb, 0) AS same_bar
  FROM ({wanted}) x LEFT JOIN {name}_a a ON a.k = x.k AND a.scope = x.scope
  LEFT JOIN {name}_r r ON r.k = x.k AND r.scope = x.scope)"""


_DOUBLES = ("win_rate", "net_profit", "gross_profit", "gross_loss", "commission", "profit_factor", "avg_trade",
            "avg_win", "avg_loss", "win_loss_ratio", "largest_win", "largest_loss", "expectancy", "max_drawdown",
            "max_drawdown_pct", "sharpe", "sortino", "avg_bars", "avg_mae", "avg_mfe", "avg_etd", "ambiguous_pct")

SQL["trade_stats"] = BOOK_SQL + stats_cte() + f"""
SELECT 'ALL' AS symbol, CAST(k AS BIGINT) AS param_id, scope, n_trades, wins, losses, evens, max_consec_wins,
       max_consec_losses, ambiguous, same_bar, {_r(*_DOUBLES)} FROM stats"""

SQL["win_loss_streaks"] = BOOK_SQL + """,
sc AS (SELECT *, unnest(['all', direction]) AS scope FROM book),
sw AS (SELECT *, sum(CASE WHEN pnl_dollars > 0 THEN 0 ELSE 1 END) OVER w AS nl,
              sum(CASE WHEN pnl_dollars > 0 THEN 1 ELSE 0 END) OVER w AS nw
       FROM sc WINDOW w AS (PARTITION BY scope ORDER BY exit_time, k ROWS UNBOUNDED PRECEDING))
SELECT 'ALL' AS symbol, scope, coalesce(max(CASE WHEN win THEN n END), 0) AS max_consec_wins,
       coalesce(max(CASE WHEN NOT win THEN n END), 0) AS max_consec_losses
FROM (SELECT scope, pnl_dollars > 0 AS win, CASE WHEN pnl_dollars > 0 THEN nl ELSE nw END AS run, count(*) AS n
      FROM sw GROUP BY ALL) GROUP BY scope"""

SQL["equity_curve"] = BOOK_SQL + """,
e AS (SELECT *, 50000.0 + sum(pnl_dollars) OVER (PARTITION BY k ORDER BY exit_time ROWS UNBOUNDED PRECEDING) AS eq FROM book),
d AS (SELECT *, greatest(50000.0, max(eq) OVER (PARTITION BY k ORDER BY exit_time ROWS UNBOUNDED PRECEDING)) AS pk FROM e)
SELECT 'ALL' AS symbol, CAST(k AS BIGINT) AS param_id, exit_time, CAST(eq AS DOUBLE) AS equity,
       CAST(pk AS DOUBLE) AS peak, CAST(pk - eq AS DOUBLE) AS drawdown FROM d"""

SQL["sweep_ranked"] = BOOK_SQL + stats_cte(
    scopes="['all']", wanted=f"SELECT param_id AS k, 'all' AS scope FROM {COMBOS}") + f"""
SELECT 'ALL' AS symbol, CAST(k AS BIGINT) AS param_id, CAST(lookback AS DOUBLE) AS lookback, CAST(kk AS DOUBLE) AS k,
       round(sc, 6) AS score, n_trades, row_number() OVER (ORDER BY coalesce(sc, -1e300) DESC, param_id) AS place
FROM (SELECT s.k, param_id, lookback, kk, n_trades, CASE WHEN n_trades >= 2 THEN profit_factor END AS sc
      FROM stats s JOIN {COMBOS} ON s.k = v.param_id)""".replace("CAST(k AS BIGINT) AS param_id", "CAST(param_id AS BIGINT) AS param_id")

FOLDS = """
span AS (SELECT symbol, min(t) AS a, max(t) AS b FROM bars GROUP BY 1),
folds AS (SELECT symbol, a, CAST((o - a - 864000) / 345600 AS BIGINT) + 1 AS fold, o - 864000 AS is_start, o AS is_end,
                 o AS oos_start, o + 345600 AS oos_end
          FROM (SELECT *, unnest(generate_series(a + 864000, b - 345600, 345600)) AS o FROM span))"""

SQL["walk_forward_folds"] = "WITH " + bars_cte("event_type", 3600) + "," + FOLDS + """
SELECT symbol, fold, CASE WHEN anchored THEN a ELSE is_start END AS is_start, is_end, oos_start, oos_end, anchored
FROM folds, (VALUES (FALSE), (TRUE)) v(anchored)"""

WALK_SQL = (TRADABLE + "," + FOLDS + """,
isb AS (SELECT s.*, f.fold FROM seg s JOIN folds f ON f.symbol = s.symbol AND s.t >= f.is_start AND s.t < f.is_end),
oosb AS (SELECT s.*, f.fold FROM seg s JOIN folds f ON f.symbol = s.symbol AND s.t >= f.oos_start AND s.t < f.oos_end)"""
            + signals_cte("isb", "symbol, fold", "isig") + """,
ik AS (SELECT *, fold * 100 + param_id AS k FROM isig)""" + book_cte("ik", "ib")
            + stats_cte("ib", "['all']", f"SELECT fold * 100 + param_id AS k, 'all' AS scope FROM folds, {COMBOS}", "ist") + """,
best AS MATERIALIZED (SELECT k // 100 AS fold, k % 100 AS param_id, k, CASE WHEN n_trades >= 2 THEN profit_factor END AS is_score
         FROM ist QUALIFY row_number() OVER (PARTITION BY k // 100
           ORDER BY coalesce(CASE WHEN n_trades >= 2 THEN profit_factor END, -1e300) DESC, k % 100) = 1)"""
            + signals_cte("oosb", "symbol, fold", "osig") + """,
ok_ AS (SELECT o.*, b.k FROM osig o JOIN best b ON b.fold = o.fold AND b.param_id = o.param_id)""" + book_cte("ok_", "ob")
            + stats_cte("ob", "['all']", "SELECT k, 'all' AS scope FROM best", "ost") + """,
res AS (SELECT f.symbol, f.fold, f.oos_start, f.oos_end, CAST(b.param_id AS BIGINT) AS param_id, b.is_score,
               o.profit_factor AS oos_score, o.n_trades AS n_oos_trades
        FROM folds f JOIN best b ON b.fold = f.fold JOIN ost o ON o.k = b.k)""")

SQL["walk_forward_results"] = WALK_SQL + """
SELECT symbol, fold, oos_start, oos_end, param_id, round(is_score, 6) AS is_score, round(oos_score, 6) AS oos_score,
       n_oos_trades FROM res"""

SQL["walk_forward_oos"] = WALK_SQL + """
SELECT 'ALL' AS symbol, CAST(k // 100 AS BIGINT) AS fold, row_number() OVER w AS num, entry_time, exit_time, direction,
       pnl_dollars, sum(pnl_dollars) OVER (ORDER BY exit_time, k // 100, entry_time ROWS UNBOUNDED PRECEDING) AS cum_pnl
FROM ob WINDOW w AS (ORDER BY exit_time, k // 100, entry_time)"""

SQL["walk_forward_efficiency"] = WALK_SQL + """
SELECT symbol, count(*) AS folds, round(coalesce(avg(oos_score) / nullif(avg(is_score), 0), 0.0), 6) AS efficiency
FROM res GROUP BY 1"""


# ---- quotes, captured events, streams ---------------------------------------

QUOTE_SQL = "WITH " + ticks_cte("ALL") + """,
o AS (SELECT *, CAST(epoch(ts) AS BIGINT) * 1000000 + seq % 1000000 AS at FROM ticks),
qb AS (SELECT symbol, CAST(epoch(ts) AS BIGINT) AS t, arg_max(bid, seq) AS bid FROM o
       WHERE seq % 3 = 0 AND seq % 5 <> 1 GROUP BY 1, 2),
qa AS (SELECT symbol, CAST(epoch(ts) AS BIGINT) AS t, arg_max(ask, seq) AS ask FROM o
       WHERE seq % 3 = 0 AND seq % 5 <> 2 GROUP BY 1, 2),
tr AS (SELECT symbol, CAST(epoch(ts) AS BIGINT) AS t, seq, price FROM o WHERE seq % 3 <> 0)
SELECT tr.symbol, tr.t AS time, tr.seq, tr.price, qb.bid, qa.ask
FROM tr ASOF LEFT JOIN qb ON tr.symbol = qb.symbol AND tr.t >= qb.t
ASOF LEFT JOIN qa ON tr.symbol = qa.symbol AND tr.t >= qa.t"""
SQL["prevailing_quote"] = QUOTE_SQL
SQL["stream_prevailing_quote"] = QUOTE_SQL

SQL["captured_trades"] = """
SELECT event_type AS symbol, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS time, count(*) AS trades,
       CAST(sum(1 + user_id % 7) AS BIGINT) AS volume,
       CAST(sum((1 + user_id % 7) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS delta,
       arg_min(value, event_id) AS first_price
FROM events GROUP BY 1, 2"""

SQL["stream_capture_replay"] = """
SELECT 'trade' AS kind, event_type AS symbol, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS time, count(*) AS rows,
       CAST(sum(1 + user_id % 7) AS BIGINT) AS volume,
       CAST(sum((1 + user_id % 7) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS delta
FROM events GROUP BY 2, 3
UNION ALL
SELECT 'quote', event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT), count(*), count(value), count(*) FILTER (event_id % 5 <> 0)
FROM events WHERE event_id % 3 = 0 GROUP BY 2, 3
UNION ALL
SELECT 'broken', NULL, NULL, count(DISTINCT (event_type, event_id // 32)), NULL, NULL FROM events WHERE (event_id // 32) % 11 = 0"""

SQL["published_trades"] = SQL["trade_book"]

SQL["stream_bars_replay"] = "WITH " + bars_cte() + f"""
SELECT {BAR_COLS} FROM bars WHERE t < (SELECT max(epoch(ts)) FROM ticks) - 60"""

SQL["stream_rungs_replay"] = " UNION ALL ".join(
    f"SELECT '{name}' AS timeframe, * FROM (WITH {bars_cte('ALL', step)} SELECT {BAR_COLS} FROM bars "
    f"WHERE t < (SELECT max(epoch(ts)) FROM ticks) - 60)" for name, step in (("30m", 1800), ("60m", 3600)))

STREAM_COLS = """SELECT s.symbol, s.t AS time, range_scale, swing, swing_price, swing_time, hunting,
       round(retrace, 6) AS retrace, "trigger", bos, bos_level, bos_time
FROM struct s JOIN scaled c ON c.symbol = s.symbol AND c.t = s.t"""
SQL["stream_structure_replay"] = STRUCT_TYPE + STREAM_COLS
SQL["stream_seek"] = STRUCT_TYPE + STREAM_COLS + " WHERE s.t > epoch(TIMESTAMP '2024-01-21')"


def _after_with(sql: str) -> str:
    return sql.split("WITH RECURSIVE ", 1)[1]


def _mean(p: int) -> str:
    return f"CASE WHEN b.rn >= {p} THEN avg(b.close) OVER (ORDER BY b.t ROWS {p - 1} PRECEDING) END AS ma_{p}"


SQL["snapshot"] = f"""
WITH base AS MATERIALIZED ({STRUCT_ALL + LEGS_CTE + ribbon_cte() + REGIME_CTE}
  SELECT b.symbol, b.t, b.close, b.delta, b.buy_volume, b.sell_volume, b.trades, b.range_scale, s.swing, s.swing_price,
         s.swing_time, s.extreme_high, s.extreme_high_time, s.extreme_low, s.extreme_low_time, s.hunting, s."trigger",
         s.bos, s.bos_level, s.bos_time, s.retrace,
         CASE WHEN b.close > b.open AND b.delta < 0 THEN 'buy' WHEN b.close < b.open AND b.delta > 0 THEN 'sell' END AS absorption_side,
         CASE WHEN tu.ft IS NOT NULL THEN CASE WHEN tu.swing_price > tu.fp THEN 'up' ELSE 'down' END END AS leg,
         CASE WHEN tu.ft IS NOT NULL THEN tu.fp END AS leg_from_price, tu.ft AS leg_from_time,
         CASE WHEN tu.ft IS NOT NULL THEN tu.swing_price END AS leg_to_price,
         CASE WHEN tu.ft IS NOT NULL THEN tu.swing_time END AS leg_to_time,
         r.ribbon_align, r.ribbon_agree, r.ribbon_width, f.ribbon, f.ribbon_prev, {_mean(50)}, {_mean(100)}, {_mean(200)},
         count(s.swing) OVER (ORDER BY b.t ROWS UNBOUNDED PRECEDING) AS n_sw
  FROM scaled b JOIN struct s ON s.t = b.t JOIN readings r ON r.t = b.t JOIN fan f ON f.t = b.t
  LEFT JOIN turns tu ON tu.t = b.t),
lab AS MATERIALIZED ({SQL["regime_label"]}),
ses AS MATERIALIZED ({SQL["session_labels"]}),
pr AS MATERIALIZED ({SQL["profile_readings"]}),
cp AS MATERIALIZED ({SQL["card_profile"]}),
cs AS MATERIALIZED ({SQL["card_shape"]}),
cf AS MATERIALIZED ({SQL["card_flow"]}),
ph AS MATERIALIZED ({SQL["card_phase"]}),
pc AS MATERIALIZED ({SQL["card_percentiles"]}),
tb AS MATERIALIZED ({SQL["travel_budget"].replace("AND session_id < " + SEAL, "")}),
tv AS MATERIALIZED (SELECT t, sum(volume) OVER (PARTITION BY session_id ORDER BY t) AS traded FROM (
  WITH {bars_cte() + sessions_cte()} SELECT t, session_id, volume FROM sess WHERE session_id IS NOT NULL))
SELECT b.symbol, b.t AS time, b.close, ses.session, ses.session_new, round(b.range_scale, 6) AS range_scale, b.delta,
       b.buy_volume, b.sell_volume, b.trades, b.absorption_side IS NOT NULL AS absorption, b.absorption_side, b.swing,
       b.swing_price, b.swing_time, b.extreme_high, b.extreme_high_time, b.extreme_low, b.extreme_low_time, b.hunting,
       round(b.retrace, 6) AS retrace, round(b."trigger", 6) AS "trigger", b.bos, b.bos_level, b.bos_time,
       b.leg, b.leg_from_price, b.leg_from_time, b.leg_to_price, b.leg_to_time,
       round(b.ribbon_align, 6) AS ribbon_align, round(b.ribbon_agree, 6) AS ribbon_agree, round(b.ribbon_width, 6) AS ribbon_width,
       lab.regime, lab.regime_new, round(coalesce(list_sum(b.ribbon), 0), 4) AS ribbon_sum,
       round(coalesce(list_sum(b.ribbon_prev), 0), 4) AS ribbon_prev_sum,
       {", ".join(f"round(ma_{p}, 6) AS ma_{p}, round(lag(ma_{p}) OVER (ORDER BY b.t), 6) AS ma_prev_{p}" for p in (50, 100, 200))},
       pr.poc AS profile_poc, pr.val AS profile_val, pr.vah AS profile_vah, pr.from_time AS profile_from_time,
       CASE WHEN pr.poc IS NOT NULL THEN b.t END AS profile_to_time, pr.profile_volume, pr.value_width, pr.poc_position,
       pr.poc_distance, pr.price_vs_value, pr.delta_at_poc, pr.profile_volume AS profile_bins_volume,
       CASE WHEN pr.poc IS NOT NULL AND n_sw > 0 THEN least(n_sw, 6) END AS n_closed,
       cs.session_bars, cs.session_range, cs.session_net, cs.session_net_ratio, cs.session_closed_ratio,
       cs.session_high_at_ratio, cs.session_low_at_ratio, cf.session_volume, cf.session_delta_recent,
       ph.session_efficiency_recent, ph.session_efficiency_prior, ph.session_range_ratio, ph.session_volume_ratio,
       ph.session_dir_change_rate, cp.session_poc, cp.session_poc_ratio, cp.session_val, cp.session_vah,
       cp.session_from_time, CASE WHEN cp.session_poc IS NOT NULL THEN b.t END AS session_to_time,
       CASE WHEN cp.session_poc IS NOT NULL THEN CAST(tv.traded AS BIGINT) END AS session_bins_volume, cp.n_hvn, cp.n_lvn,
       pc.session_range_percentile, pc.session_travel_percentile, pc.session_volume_percentile, tb.session_travel_budget
FROM base b JOIN ses ON ses.time = b.t LEFT JOIN lab ON lab.time = b.t LEFT JOIN pr ON pr.time = b.t
LEFT JOIN cp ON cp.time = b.t LEFT JOIN cs ON cs.time = b.t LEFT JOIN cf ON cf.time = b.t LEFT JOIN ph ON ph.time = b.t
LEFT JOIN pc ON pc.time = b.t LEFT JOIN tb ON tb.time = b.t LEFT JOIN tv ON tv.t = b.t"""

SQL["stream_snapshot_replay"] = SQL["snapshot"]

for _name, _at in (("profile_at_asked_bars", "profile_readings"), ("card_profile_at_asked_bars", "card_profile")):
    SQL[_name] = f"SELECT * FROM ({SQL[_at]}) WHERE time % 3600 = 0"


# ---- audits and studies -----------------------------------------------------

SQL["bar_audit"] = "WITH " + bars_cte("event_type", 3600) + """,
m AS (SELECT *, (t // 3600) % 50 AS n FROM bars),
sp AS (SELECT symbol, t, n, open, CASE WHEN n = 1 THEN low - 1 ELSE high END AS high,
              CASE WHEN n = 5 THEN -1.0 ELSE low END AS low, CASE WHEN n = 2 THEN NULL ELSE close END AS close,
              CASE WHEN n = 3 THEN 0 WHEN n = 4 THEN -1 ELSE volume END AS volume FROM m),
u AS (SELECT * FROM sp UNION ALL SELECT * FROM sp WHERE n = 6)
SELECT symbol, count(*) AS rows, min(t) AS first_time, max(t) AS last_time, count(*) - count(DISTINCT t) AS duplicates,
       count(*) FILTER (WHERE close IS NULL) AS nans,
       count(*) FILTER (WHERE n = 1 OR (n <> 2 AND (high < greatest(open, close, low) OR low > least(open, close, high)))
                           OR n = 2) AS ohlc_bad,
       count(*) FILTER (WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS non_positive,
       count(*) FILTER (WHERE volume < 0) AS negative_volume, count(*) FILTER (WHERE volume = 0) AS zero_volume
FROM u GROUP BY 1"""

SQL["gap_lengths"] = "WITH " + bars_cte("event_type", 3600) + """
SELECT symbol, gap_seconds, count(*) AS times FROM (
  SELECT symbol, t - lag(t) OVER (PARTITION BY symbol ORDER BY t) AS gap_seconds FROM bars)
WHERE gap_seconds > 3600 GROUP BY 1, 2"""

SQL["source_reconciliation"] = ("WITH " + bars_cte("event_type", 3600) + """,
lost AS (SELECT symbol, CAST(CEIL(epoch(ts) / 3600) * 3600 AS BIGINT) AS t, arg_min(px, seq) AS open, max(px) AS high,
                min(px) AS low, arg_max(px, seq) AS close, CAST(sum(volume) AS BIGINT) AS volume
         FROM sided WHERE seq % 50 <> 7 GROUP BY 1, 2),
j AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, a.t IS NOT NULL AND b.t IS NOT NULL AS sh, a.t AS lt, b.t AS bt,
             CAST(a.open = b.open AS INT) AS o, CAST(a.high = b.high AS INT) AS h, CAST(a.low = b.low AS INT) AS l,
             CAST(a.close = b.close AS INT) AS c, CAST(a.volume = b.volume AS INT) AS v, a.volume - b.volume AS d
      FROM bars a FULL JOIN lost b ON a.symbol = b.symbol AND a.t = b.t)
SELECT symbol, count(*) FILTER (WHERE sh) AS shared, count(*) FILTER (WHERE bt IS NULL) AS only_left,
       count(*) FILTER (WHERE lt IS NULL) AS only_right, CAST(sum(d) AS BIGINT) AS volume_difference,
       round(avg(o), 6) AS match_open, round(avg(h), 6) AS match_high, round(avg(l), 6) AS match_low,
       round(avg(c), 6) AS match_close, round(avg(v), 6) AS match_volume, round(avg(o * h * l * c * v), 6) AS match_all
FROM j GROUP BY 1""")

SCALED_TYPE = "WITH " + bars_cte("event_type", 3600) + scale_cte()

SQL["first_touch"] = SCALED_TYPE + """,
ft AS (SELECT a.symbol, a.t, b.t AS bt, b.high >= a.close + 2 * a.range_scale AS up, b.low <= a.close - 2 * a.range_scale AS dn
       FROM scaled a JOIN scaled b ON b.symbol = a.symbol AND b.t > a.t
       WHERE b.high >= a.close + 2 * a.range_scale OR b.low <= a.close - 2 * a.range_scale
       QUALIFY row_number() OVER (PARTITION BY a.symbol, a.t ORDER BY b.t) = 1)
SELECT a.symbol, a.t AS time, CASE WHEN bt IS NULL THEN 'none' WHEN up AND dn THEN 'both' WHEN up THEN 'up' ELSE 'down' END AS label,
       bt AS touched
FROM scaled a LEFT JOIN ft ON ft.symbol = a.symbol AND ft.t = a.t WHERE a.range_scale IS NOT NULL"""

MOVES = SCALED_TYPE + """,
mv AS (
  SELECT a.symbol, a.t, h.horizon, (b.close - a.close) / a.range_scale AS move,
         CASE WHEN a.close > a.open AND a.delta < 0 THEN 'buy' WHEN a.close < a.open AND a.delta > 0 THEN 'sell' ELSE 'none' END AS state
  FROM scaled a, (VALUES (1), (4), (12)) h(horizon), scaled b
  WHERE b.symbol = a.symbol AND b.rn = a.rn + h.horizon AND a.range_scale IS NOT NULL)"""

REPORT = """count(*) AS n, round(avg(move), 6) AS mean, round(quantile_cont(move, 0.5), 6) AS median,
       round(avg(CAST(move > 0 AS INT)), 6) AS hit,
       round(CASE WHEN stddev_samp(move) > 0 THEN avg(move) / (stddev_samp(move) / sqrt(count(*))) END, 6) AS t"""

SQL["forward_returns"] = MOVES + f"""
SELECT symbol, state, CAST(horizon AS BIGINT) AS horizon, CASE WHEN t < {SEAL} THEN 'early' ELSE 'late' END AS era, {REPORT}
FROM mv GROUP BY 1, 2, 3, 4""".replace("t < " + SEAL, "mv.t < " + SEAL)

SQL["signal_episodes"] = MOVES + """,
m4 AS (SELECT * FROM mv WHERE horizon = 4),
fl AS (SELECT *, CAST(state IS DISTINCT FROM lag(state) OVER (PARTITION BY symbol ORDER BY t) AS INT) AS f FROM m4),
ep AS (SELECT *, sum(f) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS e FROM fl),
tot AS (SELECT symbol, state, e, sum(move) AS total FROM ep GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, state ORDER BY total DESC, e) AS r FROM tot)
SELECT symbol, state, count(*) AS episodes, round(sum(total), 6) AS total,
       round(CASE WHEN sum(total) <> 0 THEN sum(CASE WHEN r <= 5 THEN total END) / sum(total) END, 6) AS top_share
FROM rk GROUP BY 1, 2"""


def _eff(n: int, off: int) -> str:
    w = (f"OVER (PARTITION BY symbol, session_id ORDER BY t ROWS BETWEEN {n - 1 + off} PRECEDING AND "
         + (f"{off} PRECEDING)" if off else "CURRENT ROW)"))
    return (f"CASE WHEN count(*) {w} = {n} AND sum(high - low) {w} > 0 THEN "
            f"(max(high) {w} - min(low) {w}) / sum(high - low) {w} END")


def _window_study() -> str:
    parts = []
    for n in (2, 3, 4):
        parts.append(f"""SELECT symbol, {n} AS n, count(*) FILTER (WHERE ev) AS events, count(*) FILTER (WHERE ev AND ok) AS confirmed FROM (
  SELECT symbol, sd <> 0 AND lag(sd) OVER (PARTITION BY symbol, session_id ORDER BY t) = 0 AS ev,
         CASE WHEN sd = 1 THEN max(s4) OVER w = 1 ELSE min(s4) OVER w = -1 END AS ok
  FROM (SELECT *, CASE WHEN r > 2 THEN 1 WHEN r < 0.5 THEN -1 WHEN r IS NOT NULL THEN 0 END AS sd,
               CASE WHEN r4 > 2 THEN 1 WHEN r4 < 0.5 THEN -1 WHEN r4 IS NOT NULL THEN 0 END AS s4
        FROM (SELECT symbol, session_id, t, {_eff(n, 0)} / nullif({_eff(n, n)}, 0) AS r,
                     {_eff(4 * n, 0)} / nullif({_eff(4 * n, 4 * n)}, 0) AS r4 FROM sess WHERE session_id IS NOT NULL))
  WINDOW w AS (PARTITION BY symbol, session_id ORDER BY t ROWS BETWEEN {n} PRECEDING AND {n} FOLLOWING)) GROUP BY 1""")
    return "SELECT symbol, CAST(n AS BIGINT) AS n, events, confirmed FROM (" + " UNION ALL ".join(parts) + ")"


SQL["window_length_study"] = "WITH " + bars_cte() + sessions_cte() + " " + _window_study()

SQL["similar_sessions"] = CARD + """,
fc AS (SELECT symbol, session, session_bars, session_id, session_range a, session_net b, session_closed_ratio c FROM card
       WHERE session_range IS NOT NULL AND session_net IS NOT NULL AND session_closed_ratio IS NOT NULL),
z AS (SELECT symbol, session, session_bars, session_id,
             coalesce((a - avg(a) OVER w) / nullif(stddev_samp(a) OVER w, 0), 0.0) AS a,
             coalesce((b - avg(b) OVER w) / nullif(stddev_samp(b) OVER w, 0), 0.0) AS b,
             coalesce((c - avg(c) OVER w) / nullif(stddev_samp(c) OVER w, 0), 0.0) AS c
      FROM fc WINDOW w AS (PARTITION BY symbol, session, session_bars)),
nw AS (SELECT symbol, session, max(session_id) AS q FROM card GROUP BY 1, 2),
d AS (SELECT z.symbol, z.session, z.session_bars, z.session_id,
             round(sqrt((z.a - y.a) ** 2 + (z.b - y.b) ** 2 + (z.c - y.c) ** 2), 9) AS distance
      FROM z JOIN nw ON nw.symbol = z.symbol AND nw.session = z.session
      JOIN z y ON y.symbol = z.symbol AND y.session = z.session AND y.session_bars = z.session_bars AND y.session_id = nw.q
      WHERE z.session_id <> nw.q)
SELECT symbol, session, session_bars AS session_bar, session_id,
       row_number() OVER (PARTITION BY symbol, session, session_bars ORDER BY distance, session_id) AS place,
       round(distance, 6) AS distance
FROM d QUALIFY row_number() OVER (PARTITION BY symbol, session, session_bars ORDER BY distance, session_id) <= 3"""

SQL["session_distributions"] = CARD + """
SELECT symbol, session, session_bars AS session_bar, count(*) AS n, round(avg(session_range), 6) AS mean,
       round(quantile_cont(session_range, 0.25), 6) AS p25, round(quantile_cont(session_range, 0.5), 6) AS p50,
       round(quantile_cont(session_range, 0.75), 6) AS p75,
       round(corr(session_range, session_volume), 6) AS corr
FROM card WHERE session_range IS NOT NULL GROUP BY 1, 2, 3"""

UNIT = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) / 4294967296.0"

SQL["feature_scan"] = ("WITH " + bars_cte() + scale_cte() + ribbon_cte() + REGIME_CTE + """,
mv AS (SELECT a.symbol, a.t, (b.close - a.close) / a.range_scale AS move, a.ribbon_align, a.ribbon_agree, a.ribbon_width
       FROM readings a JOIN readings b ON b.symbol = a.symbol AND b.rn = a.rn + 4 WHERE a.range_scale IS NOT NULL),
lg AS (SELECT symbol, t, move, 'ribbon_align' AS feature, ribbon_align AS x FROM mv UNION ALL
       SELECT symbol, t, move, 'ribbon_agree', ribbon_agree FROM mv UNION ALL
       SELECT symbol, t, move, 'ribbon_width', ribbon_width FROM mv UNION ALL
       SELECT symbol, t, move, 'placebo', """ + UNIT.format("concat_ws('|', 'placebo', symbol, t)") + f""" FROM mv)
SELECT symbol, feature, CASE WHEN t < {SEAL} THEN 'train' ELSE 'test' END AS part, count(*) AS n,
       round(corr(x, move), 6) AS corr_move, round(corr(x, abs(move)), 6) AS corr_size
FROM lg WHERE x IS NOT NULL GROUP BY 1, 2, 3""")

SQL["seasonality"] = "WITH " + bars_cte() + """
SELECT symbol, CAST(extract('hour' FROM timezone('America/New_York', to_timestamp(t))) AS BIGINT) AS hour, count(*) AS bars,
       round(avg(high - low), 6) AS mean_range, round(avg(volume), 6) AS mean_volume, round(avg(close - was), 6) AS mean_change
FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY t) AS was FROM bars) GROUP BY 1, 2"""

SQL["overnight_returns"] = "WITH " + bars_cte() + sessions_cte() + """,
ny AS (SELECT symbol, session_id, arg_min(open, t) AS o, arg_max(close, t) AS c FROM sess WHERE session = 'NY' GROUP BY 1, 2)
SELECT symbol, session_id, o - lag(c) OVER (PARTITION BY symbol ORDER BY session_id) AS overnight, c - o AS intraday FROM ny"""

SQL["sign_flip_null"] = MOVES + f"""
SELECT symbol, CAST(seed AS BIGINT) AS seed, count(*) AS n,
       round(avg(CASE WHEN seed = 0 OR {UNIT.format("concat_ws('|', seed, symbol, t)")} < 0.5 THEN move ELSE -move END), 6) AS mean
FROM mv, range(0, 11) s(seed) WHERE horizon = 4 GROUP BY 1, 2"""

SQL["shuffled_null"] = MOVES + f""",
sd AS (SELECT symbol, t, state, move, seed, {UNIT.format("concat_ws('|', seed, symbol, t)")} AS u FROM mv, range(1, 4) s(seed) WHERE horizon = 4),
ps AS (SELECT *, row_number() OVER (PARTITION BY symbol, seed ORDER BY t) AS i,
              row_number() OVER (PARTITION BY symbol, seed ORDER BY u, t) AS j FROM sd)
SELECT a.symbol, a.state, CAST(a.seed AS BIGINT) AS seed, count(*) AS n, round(avg(b.move), 6) AS mean
FROM ps a JOIN ps b ON b.symbol = a.symbol AND b.seed = a.seed AND b.j = a.i GROUP BY 1, 2, 3"""

SQL["autocorrelation"] = "WITH " + bars_cte("event_type", 3600) + """,
ch AS (SELECT symbol, row_number() OVER w AS i, close - lag(close) OVER w AS r FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t))
SELECT a.symbol, CAST(k AS BIGINT) AS lag, count(*) AS n, round(corr(a.r, b.r), 6) AS acf, round(corr(abs(a.r), abs(b.r)), 6) AS acf_size
FROM ch a, range(1, 11) l(k), ch b WHERE b.symbol = a.symbol AND b.i = a.i + k AND a.r IS NOT NULL GROUP BY 1, 2"""

SQL["tearsheet"] = BOOK_SQL + """,
dy AS (SELECT symbol, CAST(to_timestamp(t) AT TIME ZONE 'UTC' AS DATE) AS day, arg_max(close, t) AS c FROM bars GROUP BY 1, 2),
ps AS (SELECT symbol, day, (c - lag(c) OVER (PARTITION BY symbol ORDER BY day)) * 20.0 AS passive FROM dy),
pn AS (SELECT k, CAST(to_timestamp(exit_time) AT TIME ZONE 'UTC' AS DATE) AS day, sum(pnl_dollars) AS pnl FROM book GROUP BY 1, 2),
j AS (SELECT ps.symbol, ks.k, passive, coalesce(pnl, 0.0) AS pnl FROM ps CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k) ks
      LEFT JOIN pn ON pn.day = ps.day AND pn.k = ks.k WHERE passive IS NOT NULL)
SELECT symbol, CAST(k AS BIGINT) AS param_id, count(*) AS days, round(regr_intercept(pnl, passive), 6) AS alpha, round(regr_slope(pnl, passive), 6) AS beta,
       round(corr(pnl, passive), 6) AS corr, round(CASE WHEN stddev_samp(pnl) > 0 THEN avg(pnl) / stddev_samp(pnl) END, 6) AS sharpe
FROM j GROUP BY 1, 2"""

SQL["average_crosses"] = "WITH " + bars_cte() + scale_cte() + """,
av AS (SELECT *, CASE WHEN rn >= 20 THEN avg(close) OVER (ORDER BY t ROWS 19 PRECEDING) END AS f,
              CASE WHEN rn >= 50 THEN avg(close) OVER (ORDER BY t ROWS 49 PRECEDING) END AS s FROM scaled),
sd AS (SELECT *, CASE WHEN f > s THEN 1 WHEN f < s THEN -1 END AS side FROM av),
cr AS (SELECT *, last_value(side IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM sd),
mv AS (SELECT a.symbol, CASE WHEN a.side <> a.was THEN CASE WHEN a.side = 1 THEN 'up' ELSE 'down' END END AS crs,
              (b.close - a.close) / a.range_scale AS move
       FROM cr a JOIN cr b ON b.symbol = a.symbol AND b.rn = a.rn + 8 WHERE a.range_scale IS NOT NULL)
SELECT symbol, event, """ + REPORT + """
FROM (SELECT symbol, move, 'drift' AS event FROM mv UNION ALL SELECT symbol, move, crs FROM mv WHERE crs IS NOT NULL) GROUP BY 1, 2"""


# ---- stores -----------------------------------------------------------------

SQL["tick_file_order"] = SQL["bars_base"]
SQL["bar_store"] = ("WITH " + bars_cte("event_type", 3600) + rung_cte(14400)
                    + f"SELECT '4h' AS timeframe, {BAR_COLS} FROM rung WHERE symbol = 'click'")
SQL["level_store"] = ("WITH " + bars_cte("event_type", 3600) + levels_cte(3600)
                      + " SELECT symbol, t AS time, tick, volume, buy FROM levels WHERE symbol = 'view'")
SQL["percentile_store"] = CARD + EXPLORE_HISTORY + f"""
SELECT h.symbol, h.session, 'explore' AS population, CAST({SEAL} AS BIGINT) AS cutoff,
       max(s.sessions_used) AS sessions_used, max(session_bars) AS depth
FROM hist h JOIN (SELECT symbol, session, count(DISTINCT session_id) AS sessions_used FROM card
                  WHERE range_scale IS NOT NULL AND session_id < {SEAL} GROUP BY 1, 2) s
  ON s.symbol = h.symbol AND s.session = h.session GROUP BY 1, 2"""
SQL["catalog_store"] = "WITH " + bars_cte() + sessions_cte() + f"""
SELECT symbol, sp AS folder, sp AS split, count(*) AS rows, count(DISTINCT session_id) AS sessions FROM (
  SELECT *, CASE WHEN session_id >= {SEAL} THEN 'sealed' ELSE 'explore' END AS sp FROM sess WHERE session_id IS NOT NULL)
GROUP BY 1, 2, 3"""
SQL["run_outputs"] = BOOK_SQL + stats_cte() + """
SELECT 'ALL' AS symbol, CAST(k AS BIGINT) AS param_id, scope, 'first' AS run_id, n_trades,
       round(profit_factor, 6) AS profit_factor FROM stats"""
SQL["instrument_values"] = "WITH " + bars_cte("event_type", 3600) + """
SELECT CASE WHEN symbol IN ('click', 'view') THEN 'NQ' ELSE 'ES' END AS symbol, 0.25::DOUBLE AS tick_size,
       CASE WHEN symbol IN ('click', 'view') THEN 5.0 ELSE 12.5 END::DOUBLE AS tick_value,
       CASE WHEN symbol IN ('click', 'view') THEN 20.0 ELSE 50.0 END::DOUBLE AS point_value, count(*) AS bars,
       sum(close * CASE WHEN symbol IN ('click', 'view') THEN 20.0 ELSE 50.0 END::DOUBLE) AS value
FROM bars GROUP BY 1, 2, 3, 4"""
SQL["orderflow"] = "WITH " + bars_cte("event_type", 3600) + """
SELECT symbol, t AS time, CASE WHEN symbol <> 'click' THEN delta END AS delta,
       CASE WHEN symbol <> 'click' THEN buy_volume END AS buy_volume,
       CASE WHEN symbol <> 'click' THEN sell_volume END AS sell_volume, CASE WHEN symbol <> 'click' THEN trades END AS trades
FROM bars"""
SQL["feature_columns"] = "WITH " + bars_cte() + sessions_cte() + """
SELECT symbol, t AS time, open, high, low, close, volume, session, session_new,
       (close > open AND delta < 0) OR (close < open AND delta > 0) AS absorption,
       CASE WHEN close > open AND delta < 0 THEN 'buy' WHEN close < open AND delta > 0 THEN 'sell' END AS absorption_side
FROM sess"""

SQL["explore_sample"] = "WITH " + bars_cte() + sessions_cte() + f"""
SELECT symbol, session_id, session, 'explore' AS split, bars FROM (
  SELECT symbol, session_id, session, count(*) AS bars FROM sess
  WHERE session = 'NY' AND session_id < {SEAL} GROUP BY 1, 2, 3)
ORDER BY md5(concat_ws('|', 7, symbol, session_id)), symbol, session_id LIMIT 5"""
