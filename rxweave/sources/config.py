"""Settings from a YAML file with dotted look-ups; a missing or unreadable file leaves the defaults."""

from __future__ import annotations

import os
from typing import Any

DEFAULTS: dict[str, Any] = {
    "extraction": {"similarity_threshold": 0.85, "fuzzy_threshold": 0.75, "most_candidates": 600},
    "severity": {"gate": "learned"},
    "confidence": {"low": 0.7, "intervals": [0.95, 0.99]},
}


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


class Settings:
    def __init__(self, path: str | None = None):
        read: Any = None
        if path and os.path.exists(path):
            try:
                import yaml

                with open(path, encoding="utf-8") as f:
                    read = yaml.safe_load(f)
            except Exception:  # no YAML library, or no YAML
                read = None
        self.values = merged(DEFAULTS, read) if isinstance(read, dict) else DEFAULTS

    def get(self, dotted: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in dotted.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def gate(self) -> str:
        """The severity gate: the environment beats the file; an unknown mode is ``regex``."""
        mode = os.environ.get("SEVERITY_GATE") or self.get("severity.gate", "regex")
        return mode if mode in ("none", "regex", "learned") else "regex"
