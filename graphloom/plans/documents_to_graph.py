"""From documents to scored triples and a report per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom import rules as R
from graphloom.functions.classify import entity_class, good_type_pair
from graphloom.functions import scores
from graphloom.hooks import Extractor, run_extractor
from graphloom.operators.completion import complete_failing
from graphloom.operators.quality import assess_quality
from graphloom.operators.triples import build_graph
from graphloom.rules import RulePack
from graphloom.session import compute_once
from graphloom.sources.documents import reject_reason


def processed_documents(docs: DataFrame, pack: RulePack = R.ZH, threshold: float = 0.5, **completion) -> DataFrame:
    """Quality scores, and the text to extract from: repaired where it is under the gate."""
    return complete_failing(assess_quality(docs, pack, threshold), pack, **completion)


def extract_by_rules(processed: DataFrame, pack: RulePack = R.ZH) -> DataFrame:
    """Add ``entities``, ``relations`` and ``triples`` by the pack's triple rule, row by row.

    One pass of the regular expression per text; its distinct matches are then
    split. Both ends of a triple stand in the text by construction.
    """
    p = pack.triple_pattern
    group = lambda h, i: F.regexp_extract(h, p, i)
    hits = F.array_distinct(F.regexp_extract_all("processed_text", F.lit(pack.triple_guard + p), F.lit(0)))
    # each step names its result before it is used again: a lambda body is evaluated as written
    parts = F.transform(
        hits, lambda h: F.struct(group(h, 1).alias("head"), group(h, 2).alias("relation"), group(h, 3).alias("tail"))
    )
    typed = F.transform(
        parts, lambda t: F.struct(t.alias("t"), entity_class(t["head"]).alias("head_type"), entity_class(t["tail"]).alias("tail_type"))
    )
    with_triples = compute_once(processed, typed.alias("_typed"))
    ends = F.flatten(
        F.transform(
            "_typed",
            lambda t: F.array(
                F.struct(t["t"]["head"].alias("name"), t["head_type"].alias("type")),
                F.struct(t["t"]["tail"].alias("name"), t["tail_type"].alias("type")),
            ),
        )
    )
    triples = F.transform(
        "_typed",
        lambda t: F.struct(
            t["t"]["head"].alias("head"),
            t["t"]["relation"].alias("relation"),
            t["t"]["tail"].alias("tail"),
            scores.triple_confidence(F.lit(True), F.lit(True), good_type_pair(t["head_type"], t["tail_type"])).alias("confidence"),
        ),
    )
    return with_triples.select(
        *processed.columns,
        # distinct strings are hashed, distinct structs would be compared pair by pair
        F.transform(
            F.array_distinct(F.transform(ends, lambda e: F.concat_ws("\u0001", e["type"], e["name"]))),
            lambda s: F.struct(
                F.regexp_replace(s, "(?s)^[^\u0001]*\u0001", "").alias("name"), F.substring_index(s, "\u0001", 1).alias("type")
            ),
        ).alias("entities"),
        F.array_distinct(F.transform("_typed", lambda t: t["t"]["relation"])).alias("relations"),
        triples.alias("triples"),
    )


def extract_from_responses(processed: DataFrame) -> DataFrame:
    """Same columns from ``entity_response`` and ``triple_response`` in the row."""
    return build_graph(processed, "processed_text")


def documents_to_graph(
    docs: DataFrame,
    pack: RulePack = R.ZH,
    threshold: float = 0.5,
    responses: bool = False,
    extractor: Extractor | None = None,
    **completion,
) -> DataFrame:
    """Assess, repair, extract, score: one row per document with its graph and a ``reject_reason``.

    Extraction is by the pack's rules, from the ``responses`` in the row, or by an
    ``extractor`` that is asked about the repaired texts; a text it fails on is
    rejected with the failure as the reason. The whole plan is map-only: no
    shuffle between a document and its triples.
    """
    processed = processed_documents(docs, pack, threshold, **completion)
    if extractor is not None:
        built = extract_from_responses(run_extractor(processed, extractor, "processed_text"))
    else:
        built = extract_from_responses(processed) if responses else extract_by_rules(processed, pack)
    error = F.col("error") if "error" in built.columns else None
    return built.withColumn("reject_reason", reject_reason(F.col("text"), F.size("entities"), F.size("triples"), error))


def document_reports(graphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, success, report): the stages and the summary of every document as JSON."""
    gate = F.col("is_high_quality")
    n = F.size("triples")
    total = F.aggregate("triples", F.lit(0.0), lambda acc, t: acc + t["confidence"])
    mean = F.when(n > 0, total / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))
    quality = F.struct("quality_score", "is_high_quality", "completeness", "consistency", "relevance", "issues", "recommendation")
    completion = F.struct(
        gate.alias("skipped"),
        F.when(gate, F.lit(R.SKIP_REASON)).alias("reason"),
        "completions",
        "corrections",
        "confidence",
    )
    graph = F.struct(
        F.size("entities").alias("entities_count"),
        F.size("relations").alias("relations_count"),
        n.alias("triples_count"),
        F.transform("entities", lambda e: e["name"]).alias("entities"),
        F.col("relations"),
        mean.alias("average_confidence"),
    )
    summary = F.struct(
        F.col("text").alias("original_text"),
        F.col("processed_text"),
        (~gate).alias("quality_improved"),
        F.size("entities").alias("final_entities"),
        n.alias("final_triples"),
    )
    stages = F.struct(quality.alias("quality_assessment"), completion.alias("knowledge_completion"), graph.alias("knowledge_graph"))
    ok = F.col("reject_reason").isNull()
    done = F.to_json(F.struct(F.lit(True).alias("success"), F.col("text").alias("input_text"), stages.alias("stages"), summary.alias("summary")))
    failed = F.to_json(
        F.struct(
            F.lit(False).alias("success"),
            F.col("reject_reason").alias("error"),
            F.when(F.col("reject_reason") == R.REJECT_NOTHING_FOUND, F.lit(R.REJECT_SUGGESTION)).alias("suggestion"),
        )
    )
    return graphs.select(key, ok.alias("success"), F.when(ok, done).otherwise(failed).alias("report"))


def write_reports(reports: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One report per line, accepted and rejected documents apart."""
    reports.select("success", F.col("report").alias("value")).write.mode(mode).partitionBy("success").text(path)


def refine(docs: DataFrame, pack: RulePack = R.ZH, threshold: float = 0.5, rounds: int = 3, **completion) -> DataFrame:
    """Assess and repair again while a text fails, at most ``rounds`` times (an extension).

    Each round is a conditional column on the rows that still fail, so the rounds
    stay one map-only plan. Adds ``rounds_used`` and ``passed``.
    """
    state = docs.withColumn("rounds_used", F.lit(0))
    for _ in range(rounds):
        done = complete_failing(assess_quality(state, pack, threshold), pack, **completion)
        state = done.select(
            *[F.col("processed_text").alias("text") if c == "text" else F.col(c) for c in docs.columns],
            (F.col("rounds_used") + F.when(F.col("is_high_quality"), 0).otherwise(1)).alias("rounds_used"),
        )
    final = assess_quality(state, pack, threshold)
    return final.select(*state.columns, "quality_score", F.col("is_high_quality").alias("passed"))
