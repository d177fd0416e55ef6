"""Settings of a job from a small TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import fields
from pathlib import Path
from typing import TypeVar

Found = TypeVar("Found")


def from_toml(kind: type[Found], path: str | None) -> Found:
    """``kind``, a dataclass, with the file's values; without a file its defaults. Unknown names are errors."""
    given = tomllib.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    unknown = given.keys() - {item.name for item in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    for item in fields(kind):
        if item.name in given and type(given[item.name]) is not type(item.default):
            raise ValueError(f"{item.name} is a {type(item.default).__name__}")
    return kind(**given)
