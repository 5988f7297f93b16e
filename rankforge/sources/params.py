"""Parameter files: JSON in which strings that look like numbers are numbers."""

from __future__ import annotations

import json


def coerce(value):
    """Strings become int or float where they can, in lists and dicts too; booleans and null are errors."""
    if isinstance(value, dict):
        return {k: coerce(v) for k, v in value.items()}
    if isinstance(value, list):
        return [coerce(v) for v in value]
    if isinstance(value, bool) or value is None:
        raise ValueError(f"{value!r} is no parameter value")
    if isinstance(value, str):
        for kind in (int, float):
            try:
                return kind(value)
            except ValueError:
                pass
    return value


def read_parameters(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return coerce(json.load(f))
