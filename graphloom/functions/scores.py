"""Score formulas as column expressions, written in the order that fixes their double rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def completeness(length: Column, n_mentions: Column, n_cues: Column) -> Column:
    zero = F.lit(0.0)
    score = (
        F.when(length > 10, 0.3).otherwise(zero)
        + F.when(n_mentions >= 2, 0.3).otherwise(zero)
        + F.when(n_cues >= 1, 0.4).otherwise(zero)
    )
    return F.least(score, F.lit(1.0))


def consistency(n_conflicts: Column, n_format: Column) -> Column:
    return F.greatest(F.lit(1.0) - n_conflicts * F.lit(0.2) - n_format * F.lit(0.1), F.lit(0.0))


def relevance(noise: Column) -> Column:
    return F.when(noise, F.greatest(F.lit(0.8) - F.lit(0.3), F.lit(0.0))).otherwise(F.lit(0.8))


def quality(complete: Column, consistent: Column, relevant: Column) -> Column:
    return F.round(F.lit(0.4) * complete + F.lit(0.4) * consistent + F.lit(0.2) * relevant, 3)


def completion_confidence(n_completions: Column, n_corrections: Column) -> Column:
    raw = F.lit(0.8) - n_completions * F.lit(0.05) + n_corrections * F.lit(0.1)
    return F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), raw)), 3)


def triple_confidence(head_found: Column, tail_found: Column, good_pair: Column) -> Column:
    found = (
        F.when(head_found & tail_found, F.lit(0.85) + F.lit(0.1))
        .when(head_found | tail_found, F.lit(0.85) + F.lit(0.05))
        .otherwise(F.lit(0.85))
    )
    return F.least(F.when(good_pair, found + F.lit(0.05)).otherwise(found), F.lit(1.0))


def cooccurrence(pos_a: Column, pos_b: Column, length: Column) -> Column:
    """Closeness of two 1-based first positions; 0 when either is missing (position 0)."""
    near = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(pos_a - pos_b) / length)
    return F.when((pos_a > 0) & (pos_b > 0), near).otherwise(F.lit(0.0))


def pair_strength(direct: Column, cooc: Column, type_sim: Column) -> Column:
    return F.when(direct, F.lit(0.8)).otherwise(F.lit(0.0)) + cooc * F.lit(0.3) + type_sim * F.lit(0.2)


def causal_likelihood(n_causal: Column, n_common: Column, n_union: Column) -> Column:
    return F.least(F.lit(1.0), n_causal * F.lit(0.3) + (n_common / (n_union + 1)) * F.lit(0.7))


def inverse_frequency(n_entities: int, frequency: Column) -> Column:
    return F.log(F.lit(float(n_entities)) / (frequency + 1))


def quality_band(score: Column) -> Column:
    return F.when(score < 50, F.lit("0-50")).when(score < 80, F.lit("50-80")).otherwise(F.lit("80-100"))
