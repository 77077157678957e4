"""Readers and writers for ticks, bars, levels, captured events and results."""
