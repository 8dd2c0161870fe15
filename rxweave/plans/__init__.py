"""Helpers that shape plans: session defaults, checkpoints, checked broadcasts, skew-safe joins."""
