"""Complexity of exam names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the measures.
PREPOSITIONS = ("of", "with", "without", "during", "using", "via", "through", "under", "over")
CONJUNCTIONS = (" and ", " or ", " with ", " plus ", " including ")
ADJECTIVES = (r"\w+ed\b", r"\w+al\b", r"\w+ic\b", r"\w+ous\b")
CLASSICAL = ("graph", "scopy", "metry", "plasty", "ectomy", "ostomy")
SEPARATORS = (r"\+", r"\&", "w/", "with")
LAST_AND = r"and\s+\w+$"
NUMERIC = (r"\d+\s*phase", r"\d+\s*view", r"\d+\s*slice", r"x\d+")
COMPLEX_NAME, SIMPLE_INPUT = 0.67, 0.3


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.greatest(F.size(words(text)), F.lit(1))


def total(columns) -> Column:
    columns = list(columns)
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def structural(text: Column) -> Column:
    low = F.lower(text)
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    prepositions = total(padded.contains(f" {p} ").cast("int") for p in PREPOSITIONS)
    conjunctions = total(low.contains(c).cast("int") for c in CONJUNCTIONS)
    adjectives = total(F.regexp_count(low, F.lit(p)) for p in ADJECTIVES)
    return F.least(
        F.least(prepositions / n_words(low) * 2.0, F.lit(0.3)) + F.least(conjunctions * 0.15, F.lit(0.3)) + F.least(adjectives / n_words(low) * 0.4, F.lit(0.25)),
        F.lit(1.0),
    )


def terminology(text: Column) -> Column:
    low = F.lower(text)
    hyphens = F.regexp_count(low, F.lit(r"\b\w+-\w+\b"))
    long = F.size(F.filter(words(low), lambda w: (F.length(w) > 8) & w.rlike(r"^\p{L}+$")))
    roots = total(low.contains(c).cast("int") for c in CLASSICAL)
    return F.least(F.least(hyphens * 0.2, F.lit(0.4)) + F.least(long / n_words(low) * 0.5, F.lit(0.3)) + F.least(roots * 0.15, F.lit(0.3)), F.lit(1.0))


def qualifier(text: Column) -> Column:
    low = F.lower(text)
    separators = total(F.regexp_count(low, F.lit(p)) for p in (*SEPARATORS, LAST_AND))
    capitals = F.regexp_count(text, F.lit(r"\b[A-Z]{2,}\b"))
    numeric = total(low.rlike(p).cast("int") for p in NUMERIC)
    brackets = F.regexp_count(low, F.lit(r"\([^)]+\)"))
    return F.least(
        F.least(separators * 0.25, F.lit(0.5)) + F.least(capitals / n_words(text) * 0.3, F.lit(0.25)) + F.least(numeric * 0.2, F.lit(0.3)) + F.least(brackets * 0.15, F.lit(0.2)),
        F.lit(1.0),
    )


def total_complexity(text: Column) -> Column:
    return F.least(structural(text) + terminology(text), F.lit(1.0))


def appropriateness(q: Column, fsn: Column, primary: Column) -> Column:
    """From the input's qualifier complexity and the names' total complexities."""
    hidden = F.greatest(F.lit(0.0), fsn - primary)
    simple = F.when(hidden >= 0.2, F.greatest(F.lit(0.2), 1 - hidden * 2)).otherwise(1.0)
    return F.when(q < 0.3, simple).when(q > 0.5, F.least(F.lit(1.0), 0.7 + hidden * 0.5)).otherwise(F.greatest(F.lit(0.3), 1 - F.abs(fsn - q)))
