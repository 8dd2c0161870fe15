"""Operators on DataFrames: pair joins, roll-ups, metrics, lexicon building, dictionary scans, search analytics."""
