"""Span types and the names they go by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("entity_type", T.StringType()),
    T.StructField("id", T.StringType()), T.StructField("replacement", T.StringType()), T.StructField("confidence", T.DoubleType()),
])

#: Canonical types of each detector family, and the labels its models use for them.
FAMILIES = {
    "REGEX": (("DNI", "CIF", "NIE", "NSS", "EMAIL", "PHONE", "IBAN", "IPV4", "IPV6"), {}),
    "SPACY": (("NAME", "COMPANY", "ADDRESS"), {"PER": "NAME", "ORG": "COMPANY", "LOC": "ADDRESS"}),
    "GLINER": (("NAME", "COMPANY", "ADDRESS"), {"PERSON": "NAME", "ORGANISATION": "COMPANY", "ORGANIZATION": "COMPANY", "STREET": "ADDRESS", "CITY": "ADDRESS"}),
    "HOSTED": (("NAME", "ADDRESS", "COMPANY"), {"PERSON": "NAME", "COMPANY_NAME": "COMPANY", "STREET": "ADDRESS", "CITY": "ADDRESS"}),
}


def merged_aliases(families: dict = FAMILIES) -> dict[str, str]:
    """Alias to canonical type over all families; contradictions and remapped canonical names are errors."""
    out: dict[str, str] = {t: t for types, _ in families.values() for t in types}
    for family, (types, aliases) in families.items():
        for alias, target in aliases.items():
            if target not in types:
                raise ValueError(f"{family}: {alias} stands for {target}, which is not one of its types")
            if out.setdefault(alias, target) != target:
                raise ValueError(f"{family}: {alias} stands for {target} here and for {out[alias]} elsewhere")
    return out


ALIASES = merged_aliases()


def _lookup(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def canonical(name: Column) -> Column:
    """Upper case, aliases resolved; unknown names stay."""
    up = F.upper(F.trim(name))
    return F.coalesce(F.element_at(_lookup(ALIASES), up), up)


def of_family(label: Column, family: str) -> Column:
    """The family's type for a model's label, null if it has none."""
    types, aliases = FAMILIES[family]
    return F.element_at(_lookup({t: t for t in types} | aliases), F.upper(F.trim(label)))
