"""Settings from the environment; what a caller gives explicitly goes first."""

from __future__ import annotations

import os

#: Names of environment variables and what holds without them.
DEFAULTS = {"QUARRY_INDEX": "data/index", "QUARRY_EMBEDDER": "hashing", "QUARRY_LOG_LEVEL": "WARN"}


def setting(name: str, given: str | None = None) -> str:
    """given, else the variable QUARRY_<name>, else its default; empty ones count as unset."""
    key = f"QUARRY_{name.upper()}"
    return given or os.environ.get(key) or DEFAULTS[key]
