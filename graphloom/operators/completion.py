"""Repair of low-quality documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom import rules as R
from graphloom.functions import scores, text as tx
from graphloom.hooks import Completer, KnowledgeBase, run_completer
from graphloom.rules import RulePack
from graphloom.session import compute_once, stored
from graphloom.sources.facts import conflict_rules, default_facts


def verified_rules(rules: DataFrame, facts: DataFrame | KnowledgeBase) -> DataFrame:
    """Conflict rules the facts disprove, with the right object and the message to report."""
    base = facts if isinstance(facts, KnowledgeBase) else KnowledgeBase(facts)
    checked = base.verify(rules, "subject", "predicate", "wrong_object")
    wrong = checked.filter(~F.col("check.is_correct") & F.col("check.correct_value").isNotNull())
    return wrong.select(
        "rule_id",
        "subject",
        "wrong_object",
        F.col("check.correct_value").alias("right_object"),
        F.concat(F.lit("修正"), "conflict_type", F.lit("："), F.col("check.correction_message")).alias("correction"),
    )


def _packed_rules(pack: RulePack) -> list[tuple]:
    """The pack's own rules, verified against the default facts."""
    known = {s: o for s, rel, o in R.FACTS if rel == "country"}
    rows = []
    for r in sorted(pack.conflicts, key=lambda r: r.rule_id):
        right = known.get(r.subject)
        if r.predicate in R.LOCATED_PREDICATES and right and right != r.wrong_object:
            message = R.CORRECTION_MESSAGE.format(type=r.conflict_type, subject=r.subject, right=right, wrong=r.wrong_object)
            rows.append((r.rule_id, r.subject, r.wrong_object, right, message))
    return rows


def _fold_rules(text: Column, rules: Column) -> Column:
    return F.aggregate(
        rules, text, lambda acc, r: tx.apply_correction(acc, r["subject"], r["wrong_object"], r["right_object"])
    )


def _correct_with_literals(df: DataFrame, verified: list[tuple], active: Column, text: str) -> DataFrame:
    t = F.col(text)
    if not verified:
        return df.withColumn("_fixed", t).withColumn("_fix_notes", tx.strings([]))
    names = ("rule_id", "subject", "wrong_object", "right_object", "correction")
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in verified])
    hits = F.filter(table, lambda r: F.contains(t, r["subject"]) & F.contains(t, r["wrong_object"]))
    matched = df.withColumn("_rules", F.when(active, hits))
    return matched.select(
        *df.columns,
        F.when(active, _fold_rules(t, F.col("_rules"))).otherwise(t).alias("_fixed"),
        F.when(active, F.transform("_rules", lambda r: r["correction"])).otherwise(tx.strings([])).alias("_fix_notes"),
    )


def match_rules(docs: DataFrame, verified: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, rule) rows where both words of a rule occur in the text.

    The first two characters of the rule's subject serve as an equi-join key on
    the distinct character pairs of the text, so no document meets a rule it
    cannot match. Exact for subjects of any length: one-character subjects use
    the single characters.
    """
    t = F.col(text)
    grams = F.array_distinct(
        F.concat(
            F.regexp_extract_all(t, F.lit("(?s)(?=(..))"), F.lit(1)),
            F.regexp_extract_all(t, F.lit("(?s)(.)"), F.lit(1)),
        )
    )
    # only keys meet the rules; the text comes back for the few that are left. The rules are a table of
    # known size and the keys are merged, so that the driver never builds a table of all documents
    ids = stored(verified.distinct().withColumn("_rule", F.monotonically_increasing_id()))
    grams_of = ids.select("_rule", F.substring("subject", 1, 2).alias("_gram"))
    met = docs.select(key, F.explode(grams).alias("_gram")).join(grams_of, "_gram").drop("_gram").distinct()
    hits = met.hint("merge").join(docs.select(key, text).hint("merge"), key).join(ids, "_rule")
    return hits.filter(t.contains(F.col("subject")) & t.contains(F.col("wrong_object"))).select(key, *verified.columns)


def _correct_with_table(df: DataFrame, verified: DataFrame, active: Column, text: str, key: str) -> DataFrame:
    matched = match_rules(df.filter(active).select(key, text), verified, text, key)
    # bounded by the rules one text can hold
    per_doc = matched.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("rule_id", "subject", "wrong_object", "right_object", "correction"))).alias("_rules")
    )
    joined = df.join(per_doc, key, "left")
    rules = F.coalesce(F.col("_rules"), F.array().cast(per_doc.schema["_rules"].dataType))
    return (
        joined.withColumn("_fixed", _fold_rules(F.col(text), rules))
        .withColumn("_fix_notes", F.transform(rules, lambda r: r["correction"]))
        .drop("_rules")
    )


def complete_knowledge(
    docs: DataFrame,
    pack: RulePack = R.ZH,
    text: str = "text",
    rules: DataFrame | None = None,
    facts: DataFrame | KnowledgeBase | None = None,
    key: str = "doc_id",
    completer: Completer | None = None,
    only: str | None = None,
) -> DataFrame:
    """Add ``enhanced_data``, ``completions``, ``corrections``, ``confidence`` and ``changed``.

    Needs the ``issues`` column of ``assess_quality``. Steps in order: conflict
    corrections by rule id, format, implicit notes, confidence, and last the text
    as ``completer`` returns it (for the rows where the column ``only`` is true).
    ``rules`` default to the pack's, ``facts`` (a table or a ``KnowledgeBase``) to
    the known ones. With neither given the plan is map-only; otherwise the rules
    are verified against the facts and joined (``match_rules``).
    """
    issues = F.col("issues")
    conflicted = tx.any_issue_with(issues, R.CONFLICT_WORD)
    if rules is None and facts is None:
        fixed = _correct_with_literals(docs, _packed_rules(pack), conflicted, text)
    else:
        spark = docs.sparkSession
        table = conflict_rules(spark, pack.conflicts) if rules is None else rules
        known = default_facts(spark) if facts is None else facts
        fixed = _correct_with_table(docs, verified_rules(table, known), conflicted, text, key)

    t = F.col("_fixed")
    reformat = tx.any_issue_with(issues, R.FORMAT_WORD)
    shaped = compute_once(
        fixed,
        F.when(reformat, tx.normalise_format(t, pack)).otherwise(t).alias("enhanced_data"),
        F.concat(
            F.col("_fix_notes"), tx.keep_present(F.when(reformat & tx.needs_period(t, pack), F.lit(R.PERIOD_ADDED)))
        ).alias("corrections"),
    )
    noted = shaped.withColumn("completions", tx.implicit_notes(F.col("enhanced_data"), pack))
    if completer is not None:
        noted = run_completer(noted, completer, "enhanced_data", only)
    return noted.select(
        *docs.columns,
        "enhanced_data",
        "completions",
        "corrections",
        scores.completion_confidence(F.size("completions"), F.size("corrections")).alias("confidence"),
        (F.col("enhanced_data") != F.col(text)).alias("changed"),
    )


def complete_failing(assessed: DataFrame, pack: RulePack = R.ZH, text: str = "text", **kwargs) -> DataFrame:
    """``complete_knowledge`` for rows under the gate; rows that pass keep their text and get nulls."""
    gate = F.col("is_high_quality")
    failing = assessed.withColumn("_failing", ~gate)
    done = complete_knowledge(failing, pack, text, only="_failing", **kwargs)
    return done.select(
        *assessed.columns,
        F.when(gate, F.col(text)).otherwise(F.col("enhanced_data")).alias("processed_text"),
        *[F.when(~gate, F.col(c)).alias(c) for c in ("completions", "corrections", "confidence")],
    )
