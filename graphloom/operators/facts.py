"""Look-ups against a fact table (subject, relation, object)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom import rules as R


def _facts_as(facts: DataFrame, *names: str) -> DataFrame:
    # one object per (subject, relation), whatever the table holds
    unique = facts.groupBy("subject", "relation").agg(F.max("object").alias("object"))
    return unique.toDF(*names)


def query_fact(df: DataFrame, facts: DataFrame, subject: str, relation: str, out: str = "fact") -> DataFrame:
    """Add the object of (subject, relation), null when unknown."""
    dim = _facts_as(facts, "_fs", "_fr", out)
    hit = (F.col(subject) == F.col("_fs")) & (F.col(relation) == F.col("_fr"))
    return df.join(dim, hit, "left").drop("_fs", "_fr")


def verify_fact(
    df: DataFrame, facts: DataFrame, subject: str, predicate: str, obj: str, out: str = "check", located_in: str = "country"
) -> DataFrame:
    """Add a struct that says whether (subject, predicate, object) agrees with the facts.

    An unknown subject or predicate counts as correct with low confidence.
    """
    dim = _facts_as(facts.filter(F.col("relation") == located_in), "_fs", "_fr", "_known").drop("_fr")
    joined = df.join(dim, F.col(subject) == F.col("_fs"), "left")
    testable = F.col(predicate).isin(*R.LOCATED_PREDICATES) & F.col("_known").isNotNull()
    same = F.col(obj) == F.col("_known")
    message = F.concat(F.col(subject), F.lit("属于"), F.col("_known"), F.lit("，不是"), F.col(obj))
    check = F.when(testable, _check(same, F.lit(0.95), F.col("_known"), F.when(same, F.lit("")).otherwise(message))).otherwise(
        _check(F.lit(True), F.lit(0.1), F.lit(None).cast("string"), F.lit(""))
    )
    return joined.withColumn(out, check).drop("_fs", "_known")


def _check(ok: Column, confidence: Column, value: Column, message: Column) -> Column:
    return F.struct(
        ok.alias("is_correct"), confidence.alias("confidence"), value.alias("correct_value"), message.alias("correction_message")
    )


def query_fact_chain(df: DataFrame, bases: list[DataFrame], subject: str, relation: str, out: str = "fact") -> DataFrame:
    """First answer of several fact tables, in order of preference."""
    for i, facts in enumerate(bases):
        df = query_fact(df, facts, subject, relation, f"_fact{i}")
    names = [f"_fact{i}" for i in range(len(bases))]
    return df.withColumn(out, F.coalesce(*[F.col(n) for n in names])).drop(*names)


def verify_fact_chain(
    df: DataFrame, primary: DataFrame, fallback: DataFrame, subject: str, predicate: str, obj: str, out: str = "check"
) -> DataFrame:
    """Use the fallback when the primary is unsure (confidence < 0.5) and the fallback is surer."""
    both = verify_fact(verify_fact(df, primary, subject, predicate, obj, "_p"), fallback, subject, predicate, obj, "_q")
    surer = (F.col("_p.confidence") < 0.5) & (F.col("_q.confidence") > F.col("_p.confidence"))
    return both.withColumn(out, F.when(surer, F.col("_q")).otherwise(F.col("_p"))).drop("_p", "_q")
