"""Small helpers for names of runs, options and configurations."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(c: Column, digits: int = 8) -> Column:
    """The first hexadecimal digits of the text's SHA-1."""
    return F.left(F.sha1(c), F.lit(digits))


def short_hash_of(text: str, digits: int = 8) -> str:
    return hashlib.sha1(text.encode("utf-8")).hexdigest()[:digits]


def snake(c: Column) -> Column:
    """CamelCase as camel_case; a run of capitals counts as one word."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def snake_of(name: str) -> str:
    return re.sub("([a-z0-9])([A-Z])", r"\1_\2", re.sub("([A-Z]+)([A-Z][a-z])", r"\1_\2", name)).lower()


def in_order(needs: Mapping[str, Iterable[str]]) -> list[str]:
    """Names so that each stands after all that it needs, otherwise by name; a circle is an error."""
    waiting = {k: set(v) for k, v in needs.items()}
    for v in list(waiting.values()):
        for name in v:
            waiting.setdefault(name, set())
    out: list[str] = []
    while waiting:
        ready = sorted(k for k, v in waiting.items() if not v)
        if not ready:
            raise ValueError(f"these need each other: {', '.join(sorted(waiting))}")
        out += ready
        waiting = {k: v - set(ready) for k, v in waiting.items() if k not in ready}
    return out
