"""Relational operators over structures, intervals, hits, markers and signals.

Intervals are 0-based and half-open throughout. Windows partition by sequence or object,
never by nothing, except over aggregates of bounded size.
"""
