"""Rule-based quality of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom import rules as R
from graphloom.functions import scores, text as tx
from graphloom.rules import RulePack
from graphloom.session import compute_once

QUALITY_COLUMNS = (
    "quality_score", "is_high_quality", "completeness", "consistency", "relevance", "issues", "recommendation",
)


def drop_blank(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.filter(tx.not_blank(F.col(text)))


def assess_quality(docs: DataFrame, pack: RulePack = R.ZH, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """Add the scores, the gate, the ordered issue list and the advice. Map-only.

    Every text is scanned once per rule; the scan results are columns of their
    own, so no score repeats a regular expression.
    """
    t = F.col(text)
    scanned = compute_once(
        docs,
        tx.stripped_length(t).alias("_length"),
        F.size(tx.mentions(t, pack.mention_patterns)).alias("_n_mentions"),
        F.size(tx.present_cues(t, pack)).alias("_n_cues"),
        tx.conflict_messages(t, pack).alias("_conflicts"),
        tx.format_issues(t, pack).alias("_format"),
        tx.is_noise(t, pack).alias("_noise"),
    )
    scored = scanned.select(
        "*",
        scores.completeness(F.col("_length"), F.col("_n_mentions"), F.col("_n_cues")).alias("completeness"),
        scores.consistency(F.size("_conflicts"), F.size("_format")).alias("consistency"),
        scores.relevance(F.col("_noise")).alias("relevance"),
        tx.issue_list(
            F.col("_length"), F.col("_n_mentions"), F.col("_n_cues"), F.col("_conflicts"), F.col("_format")
        ).alias("issues"),
    )
    judged = scored.withColumn(
        "quality_score", scores.quality(F.col("completeness"), F.col("consistency"), F.col("relevance"))
    )
    return judged.select(
        *docs.columns,
        "quality_score",
        (F.col("quality_score") >= threshold).alias("is_high_quality"),
        "completeness",
        "consistency",
        "relevance",
        "issues",
        tx.recommendation(F.col("quality_score"), F.col("issues"), threshold).alias("recommendation"),
    )


def quality_gate(assessed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that pass the gate, and rows that need completion."""
    return assessed.filter("is_high_quality"), assessed.filter("not is_high_quality")
