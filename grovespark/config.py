"""Settings in sections: later files win over earlier ones, a job's section over the defaults, the command line over all."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any


def read_file(path: str) -> dict[str, Any]:
    """A JSON file, or a YAML one where a YAML reader is installed."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML settings need PyYAML; JSON is always read") from e
        found = yaml.safe_load(text)
    if not isinstance(found or {}, dict):
        raise ValueError(f"{path}: settings must be a mapping")
    return found or {}


def merged(first: dict[str, Any], second: dict[str, Any]) -> dict[str, Any]:
    """Values of ``second`` over those of ``first``; mappings are merged in depth."""
    out = dict(first)
    for key, value in second.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


class Config:
    def __init__(self, *layers: dict[str, Any]):
        self.values: dict[str, Any] = {}
        for layer in layers:
            self.values = merged(self.values, layer)

    @classmethod
    def load(cls, paths: Sequence[str], overrides: dict[str, Any] | None = None) -> Config:
        return cls(*map(read_file, paths), overrides or {})

    def section(self, *names: str) -> dict[str, Any]:
        """The named sections merged, the last one over the others; missing ones are empty."""
        out: dict[str, Any] = {}
        for name in names:
            value: Any = self.values
            for part in name.split("."):
                value = value.get(part, {}) if isinstance(value, dict) else {}
            out = merged(out, value if isinstance(value, dict) else {})
        return out
