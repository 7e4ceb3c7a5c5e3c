"""Patterns of identifiers, matched with offsets by expressions only.

Java's (?imuU) gives word boundaries and digits as Unicode has them. The k-th match starts after the k first pieces between
matches and the matches before it, so one fold over both arrays gives all offsets, in code points, in one pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GROUPS = r"\.?\d{3}\.?\d{3}"  # the last six digits of an identity number, in dotted threes or not
_GAP = r"[-\s]?"
_CONTROL = "[A-HJ-NP-TV-Z]"  # letters that close a DNI: all but I, O and U
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_HEX = "[0-9A-F]{1,4}"
_SEP = r"[-\s/.]"
_PAIR = r"[-\s.]?\d{2}"


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    confidence: float
    hint: str  # a cheap regular expression that every text with a match satisfies
    checked: bool = False


PATTERNS = (
    Pattern("DNI", rf"\b\d{{1,2}}{_GROUPS}{_GAP}{_CONTROL}\b", 0.95, r"(?U)\d{3}", True),
    Pattern("CIF", rf"\b[A-HJNP-SW]{_GAP}\d{{2}}{_GROUPS}[0-9A-J]?\b", 0.90, r"(?U)\d{3}", True),
    Pattern("NIE", rf"\b[XYZ]{_GAP}\d{{1,2}}{_GROUPS}{_GAP}[A-Z]\b", 0.92, r"(?U)\d{3}", True),
    Pattern("NSS", rf"\b\d{{2}}{_SEP}?(?:\d{{10}}|\d{{8}}{_SEP}?\d{{2}}\b)", 0.85, r"(?U)\d{8}"),
    Pattern("EMAIL", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", 0.80, "@"),
    Pattern("PHONE", "|".join((rf"(?:\+34|0034){_GAP}\d{{3}}(?:[-\s]\d{{3}}){{2}}", rf"\+34{_GAP}\d{{9}}", rf"\b[6789]\d{{2}}(?:{_PAIR}){{3,4}}\b", r"\b[6789]\d{2}(?:[-\s.]\d{3}){2}\b")), 0.88, r"(?U)\d{2}"),
    Pattern("IBAN", rf"\b[A-Z]{{2}}\d{{2}}(?:{_SEP}?[A-Z0-9]{{4}}){{3,6}}(?:{_SEP}?[A-Z0-9]{{1,4}})?\b", 0.90, r"(?iuU)[A-Z]{2}\d{2}"),
    Pattern("IPV4", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", 0.88, r"[0-9]\.[0-9]"),
    Pattern("IPV6", rf"\b(?:{_HEX}:){{7}}{_HEX}\b|(?:{_HEX}:)*::(?:{_HEX}:)*{_HEX}\b", 0.85, ":"),
)
BY_NAME = {p.name: p for p in PATTERNS}
FLAGS = "(?imuU)"
_WORD = "[0-9A-Za-z_]"


def re2(regex: str) -> str:
    """The regex with its flags as RE2, and so DuckDB, reads it under (?im): words, digits and white space of ASCII only, no vertical tab.

    Letters fold by Unicode's simple folding (the long s is an S, the Kelvin sign a K, dotless i no I); letters have to stand in classes.
    """

    def folded(m: re.Match) -> str:
        also = "".join(code for letter, code in (("S", "\\u017F"), ("K", "\\u212A")) if re.fullmatch(m[0], letter, re.IGNORECASE))
        return "[" + also + m[0][1:].replace(r"\s", r"\t\n\f\r ")

    first = re.sub(r"\\b(\\d|\[[^]]+\])", r"(?=\1)\\b\1", regex)  # most places fail by their character, before the costlier boundary
    return "(?im)" + re.sub(r"\[[^]]+\]", folded, first).replace(r"\b", f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))")


def matches(text: Column, regex: str) -> Column:
    """array<struct<start,stop,match>> of all matches; the pattern must not match the empty string."""
    pieces = F.arrays_zip(F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("m"), F.split(text, regex, -1).alias("s"))
    none = F.array().cast("array<struct<start:int,stop:int,match:string>>")

    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + F.length(x["s"])
        stop = at + F.length(x["m"])
        return F.struct(stop.alias("pos"), F.array_append(acc["out"], F.struct(at.alias("start"), stop.alias("stop"), x["m"].alias("match"))).alias("out"))

    found = F.filter(pieces, lambda x: x["m"].isNotNull())
    return F.aggregate(found, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])


def _typed(p: Pattern):
    return lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), m["match"].alias("match"), F.lit(p.name).alias("entity_type"), F.lit(p.confidence).alias("base"))


def spans(text: Column, names: tuple[str, ...] | None = None, ascii_words: bool = False) -> Column:
    """array<struct<start,stop,match,entity_type,base>> of the named patterns (all), by pattern, then position; ascii_words: as re2() reads them.

    A cheap hint and a search without groups come first, so texts without a match are scanned once and never split.
    """
    out = []
    for p in PATTERNS:
        if names is None or p.name in names:
            regex = re2(p.regex) if ascii_words else FLAGS + p.regex
            found = F.transform(matches(text, regex), _typed(p))
            hint = text.contains(p.hint) if len(p.hint) == 1 else text.rlike(p.hint)
            out.append(F.when(hint & text.rlike(regex), found).otherwise(F.array().cast("array<struct<start:int,stop:int,match:string,entity_type:string,base:double>>")))
    return F.flatten(F.array(*out))


def full_match(text: Column, name: str) -> Column:
    return text.rlike(rf"{FLAGS}\A(?:{BY_NAME[name].regex})\z")


def described(spark: SparkSession) -> DataFrame:
    """name, regex, confidence, validated of every pattern; a few rows."""
    return spark.createDataFrame([(p.name, p.regex, p.confidence, bool(p.checked)) for p in PATTERNS], "name string, regex string, confidence double, validated boolean")
