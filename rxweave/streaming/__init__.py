"""Request metrics over event time: one definition for batch and for Structured Streaming."""
