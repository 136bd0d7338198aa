"""Column functions that put names, attributes and scores into classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from graphloom import rules as R
from graphloom.functions.text import contains_any, strings


def entity_class_basic(name: Column) -> Column:
    chain = F
    for label, words in R.BASIC_CLASSES:
        chain = chain.when(contains_any(name, words), F.lit(label))
    return chain.when(_short_with_surname(name, R.BASIC_SURNAMES), F.lit("Person")).otherwise(F.lit("Other"))


def entity_class(name: Column, given: Column | None = None) -> Column:
    """Eight-way class of a name; a known given type wins, an unknown one counts as Other."""
    chain = F
    for label, words in R.FULL_CLASSES_BEFORE_PERSON:
        chain = chain.when(contains_any(name, words), F.lit(label))
    digits = F.regexp_replace(name, "[.,]", "").rlike(r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]+\z")
    by_name = (
        chain.when(_short_with_surname(name, R.SURNAMES), F.lit("Person"))
        .when(contains_any(name, R.DATE_WORDS), F.lit("Date"))
        .when(digits | contains_any(name, R.NUMBER_WORDS), F.lit("Number"))
        .when(contains_any(name, R.EVENT_WORDS), F.lit("Event"))
        .when(contains_any(name, R.PRODUCT_WORDS), F.lit("Product"))
        .otherwise(F.lit("Other"))
    )
    if given is None:
        return by_name
    return F.when(given.isNull(), by_name).when(given.isin(*R.FULL_CLASS_NAMES), given).otherwise(F.lit("Other"))


def _short_with_surname(name: Column, surnames: str) -> Column:
    return (F.length(name) <= 4) & name.rlike(f"[{surnames}]")


def attribute_class(attribute: Column) -> Column:
    chain = F
    for names, label in R.ATTRIBUTE_CLASSES:
        chain = chain.when(attribute.isin(*names), F.lit(label))
    return chain.otherwise(F.lit(R.ATTRIBUTE_CLASS_DEFAULT))


def gap_sources(entity_type: Column, attribute: Column) -> Column:
    chain = F
    for etype, names, source in R.GAP_EXTRA_SOURCES:
        chain = chain.when((entity_type == etype) & attribute.isin(*names), strings([source]))
    return F.concat(strings(R.GAP_SOURCES), chain.otherwise(F.array().cast("array<string>")))


def confidence_tier(confidence: Column) -> Column:
    return F.when(confidence > 0.8, F.lit("high")).when(confidence > 0.6, F.lit("medium")).otherwise(F.lit("low"))


def confidence_bin(confidence: Column) -> Column:
    """Index 0..4 of the five histogram bins, each closed above."""
    chain = F
    for i, (_, _, upper) in enumerate(R.HISTOGRAM_BINS[:-1]):
        chain = chain.when(confidence <= upper, F.lit(i))
    return chain.otherwise(F.lit(len(R.HISTOGRAM_BINS) - 1))


def type_similarity(type_a: Column, type_b: Column, compat: bool = False) -> Column:
    """Similarity of two entity types.

    ``compat`` keeps the published lookup, which sorts the pair first and so
    finds only the keys that were stored in sorted order.
    """
    chain = F
    matched = False
    for a, b, value in R.TYPE_SIMILARITY:
        if compat and a > b:
            continue
        pair = (type_a == a) & (type_b == b) | (type_a == b) & (type_b == a)
        chain = chain.when(pair, F.lit(value))
        matched = True
    default = F.lit(R.TYPE_SIMILARITY_DEFAULT)
    return chain.otherwise(default) if matched else default


def good_type_pair(type_a: Column, type_b: Column, pairs=R.GOOD_TYPE_PAIRS) -> Column:
    hits = [((type_a == a) & (type_b == b)) | ((type_a == b) & (type_b == a)) for a, b in pairs]
    return reduce(lambda x, y: x | y, hits, F.lit(False))
