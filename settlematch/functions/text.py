"""Identifiers in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from settlematch.functions.distance import damerau_levenshtein, damerau_levenshtein_of_many

__all__ = ["damerau_levenshtein", "damerau_levenshtein_of_many", "extract_utrs", "find_id_like", "is_truncation_of", "normalise_id", "one_edit_apart"]

# How a bank reference and an invoice number look.
UTR = r"\b[A-Z]{4}\d{6,12}\b"
INVOICE = r"INV-\d{4}-\d{4,6}"
#: A token shorter than this is no evidence of a longer one.
SHORTEST_PREFIX = 10


def extract_utrs(text: Column) -> Column:
    """Distinct UTR-shaped tokens of the upper-cased text, longest first, then by first appearance."""
    found = F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(UTR), F.lit(0)))
    keyed = F.transform(found, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))
    return F.transform(F.sort_array(keyed), lambda x: x["t"])


def is_truncation_of(part: Column, whole: Column) -> Column:
    return (F.length(part) >= SHORTEST_PREFIX) & (F.length(part) < F.length(whole)) & whole.startswith(part)


def normalise_id(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def find_id_like(text: Column, pattern: str = INVOICE) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def one_edit_apart(a: Column, b: Column) -> Column:
    """Strings of one length that differ in one place, or in two neighbouring ones whose characters are swapped."""

    def at(text: Column, i: Column) -> Column:
        return text.substr(i, F.lit(1))

    places = F.when(F.length(a) > 0, F.sequence(F.lit(1), F.length(a))).otherwise(F.expr("cast(array() as array<int>)"))
    off = F.filter(places, lambda i: at(a, i) != at(b, i))

    def one(found: Column) -> Column:
        i, j = F.get(found, F.lit(0)), F.get(found, F.lit(1))
        swapped = (j == i + 1) & (at(a, i) == at(b, j)) & (at(a, j) == at(b, i))
        return (F.size(found) == 1) | ((F.size(found) == 2) & swapped)

    return (F.length(a) == F.length(b)) & (a != b) & F.get(F.transform(F.array(off), one), F.lit(0))
