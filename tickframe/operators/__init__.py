"""DataFrame operators over ticks, bars, levels, sessions, orders and trades."""
