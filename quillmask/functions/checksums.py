"""Control characters of Spanish identity numbers, as expressions. Dots are not removed: a dotted number is not valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CIF_LETTERS = "JABCDEFGHI"


def cleaned(identifier: Column) -> Column:
    return F.replace(F.replace(F.upper(F.trim(identifier)), F.lit("-"), F.lit("")), F.lit(" "), F.lit(""))


def _letter(table: str, at: Column) -> Column:
    return F.substring(F.lit(table), at.cast("int") + 1, F.lit(1))


def dni(identifier: Column) -> Column:
    c = cleaned(identifier)
    number = F.try_to_number(F.substring(c, 1, 8), F.lit("99999999")).cast("int")
    return c.rlike(r"\A[0-9]{8}[A-HJ-NP-TV-Z]\z") & F.coalesce(F.substring(c, 9, 1) == _letter(DNI_LETTERS, number % 23), F.lit(False))


def nie(identifier: Column) -> Column:
    """X, Y, Z stand for a leading 0, 1, 2 of a DNI."""
    c = cleaned(identifier)
    return c.rlike(r"\A[XYZ][0-9]{7}[A-Z]\z") & dni(F.concat(F.translate(F.substring(c, 1, 1), "XYZ", "012"), F.substring(c, 2, 8)))


def cif(identifier: Column) -> Column:
    c = cleaned(identifier)
    digit = lambda i: F.ascii(F.substring(c, i, 1)) - 48
    odd = sum((F.floor(2 * digit(i) / 10) + (2 * digit(i)) % 10 for i in (2, 4, 6, 8)), F.lit(0))
    control = (10 - (odd + digit(3) + digit(5) + digit(7)) % 10) % 10
    wanted = F.when(F.substring(c, 1, 1).isin(*"NPQRSW"), _letter(CIF_LETTERS, control)).otherwise(control.cast("int").cast("string"))
    return c.rlike(r"\A[A-HJNP-SW][0-9]{7}[0-9A-J]\z") & (F.substring(c, 9, 1) == wanted)


CHECKS = {"DNI": dni, "NIE": nie, "CIF": cif}


def valid(entity_type: Column, identifier: Column) -> Column:
    """By type, any case; false for types without a check."""
    out = F.lit(False)
    for name, check in CHECKS.items():
        out = F.when(F.upper(entity_type) == name, check(identifier)).otherwise(out)
    return out


def extracted(entity_type: Column, identifier: Column) -> Column:
    """The cleaned identifier if it is valid, else null."""
    return F.when(valid(entity_type, identifier), cleaned(identifier))


def confidence(entity_type: Column, base: Column, match: Column) -> Column:
    """Half the base for a checked type whose control character is wrong; such spans are kept."""
    return F.when(entity_type.isin(*CHECKS) & ~valid(entity_type, match), base * 0.5).otherwise(base)
