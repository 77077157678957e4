"""Compositions of operators: snapshot, sweep, walk-forward, registered queries."""
