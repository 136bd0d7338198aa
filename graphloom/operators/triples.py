"""Triples: reading, typing, scoring, merging, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom import rules as R
from graphloom.functions import scores, text as tx
from graphloom.functions.classify import entity_class, good_type_pair
from graphloom.functions.responses import TRIPLE_LINE, explode_triples, with_entities
from graphloom.rules import RulePack
from graphloom.session import compute_once


# --- sources --------------------------------------------------------------

def read_entities(responses: DataFrame, response: str = "response") -> DataFrame:
    """(keys…, seq, name, type) rows of entity responses. Map-only: a response is one row."""
    keys = [c for c in responses.columns if c not in (response, "kind")]
    parsed = with_entities(responses, response, "_found")
    return parsed.select(*keys, F.inline("_found")).withColumnRenamed("pos", "seq")


def read_triples(responses: DataFrame, mode: str = "strict", response: str = "response") -> DataFrame:
    keys = [c for c in responses.columns if c not in (response, "kind")]
    return explode_triples(responses, response, mode).select(*keys, "seq", "head", "relation", "tail")


def merge_entity_parts(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entities of documents answered in several parts: first position and last type per name."""
    return entities.groupBy(key, "name").agg(F.min("seq").alias("seq"), F.max_by("type", "seq").alias("type"))


def rule_triples(docs: DataFrame, pack: RulePack = R.ZH, text: str = "text", typed: bool = True) -> DataFrame:
    """Triples found by the pack's (entity)(cue)(entity) rule, one row each, scored. Map-only.

    Both ends stand in the text by construction, so the text is read once, by
    the regular expression, and never searched again per triple.
    """
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pack.triple_guard + pack.triple_pattern), F.lit(0)))
    keys = [c for c in docs.columns if c != text]
    hits = docs.select(*keys, F.posexplode(found).alias("seq", "_hit"))
    group = lambda i: F.regexp_extract("_hit", pack.triple_pattern, i)
    split = hits.select(
        *keys, F.col("seq").cast("bigint").alias("seq"), group(1).alias("head"), group(2).alias("relation"), group(3).alias("tail")
    )
    good = good_type_pair(entity_class(F.col("head")), entity_class(F.col("tail"))) if typed else F.lit(False)
    return split.withColumn("confidence", scores.triple_confidence(F.lit(True), F.lit(True), good))


# --- entities of triples --------------------------------------------------

def triple_ends(triples: DataFrame, keys=("doc_id",)) -> DataFrame:
    return triples.select(*keys, F.explode(F.array("head", "tail")).alias("name")).distinct()


def backfill_entities(entities: DataFrame, triples: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Entities plus the triple ends missing among them, the latter as ``Other``."""
    on = [*keys, "name"]
    given = entities.select(*on, "type")
    missing = triple_ends(triples, keys).join(given, on, "left_anti").withColumn("type", F.lit("Other"))
    return given.unionByName(missing)


def with_end_types(triples: DataFrame, entities: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Add ``head_type`` and ``tail_type``, ``Other`` when the end is not an entity."""
    out = triples
    for end in ("head", "tail"):
        types = entities.select(*keys, F.col("name").alias(end), F.col("type").alias(f"{end}_type"))
        out = out.join(types, [*keys, end], "left")
    return out.fillna("Other", ["head_type", "tail_type"])


def score_triples(triples: DataFrame, docs: DataFrame, entities: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Add ``confidence`` from the document's text and the entity types."""
    typed = with_end_types(triples, entities, (key,))
    t = F.col(text)
    return typed.join(docs.select(key, text), key).select(
        *triples.columns,
        scores.triple_confidence(
            t.contains(F.col("head")), t.contains(F.col("tail")), good_type_pair(F.col("head_type"), F.col("tail_type"))
        ).alias("confidence"),
    )


def merge_triples(triples: DataFrame, keys=("doc_id",), seq: str = "seq") -> DataFrame:
    """One row per (head, relation, tail): highest confidence, first position.

    Leave ``keys`` empty to merge across documents. Partial aggregation runs
    before the shuffle, so a triple repeated everywhere costs one row per task.
    """
    return triples.groupBy(*keys, "head", "relation", "tail").agg(
        F.min(seq).alias(seq), F.max("confidence").alias("confidence")
    )


# --- row-local build ------------------------------------------------------

def build_graph(
    docs: DataFrame,
    text: str = "text",
    entity_response: str = "entity_response",
    triple_response: str = "triple_response",
) -> DataFrame:
    """Entities and scored, merged triples of documents that carry their extractor responses.

    Adds ``entities`` array<struct<name,type>>, ``triples``
    array<struct<head,relation,tail,confidence>> and ``relations``. Everything a
    document needs is in its row, so the plan has no shuffle.
    """
    t = F.col(text)
    keep = [c for c in docs.columns if c not in (entity_response, triple_response)]
    parsed = with_entities(docs, entity_response, "_given")
    # repeated lines go first, as strings: a hash set, linear in the response
    part = "\u0001"
    lines = F.array_distinct(
        F.transform(
            F.filter(F.split(triple_response, "\n"), lambda x: x.rlike(TRIPLE_LINE)),
            lambda x: F.concat_ws(part, *[tx.strip(F.regexp_extract(x, TRIPLE_LINE, g)) for g in (1, 2, 3)]),
        )
    )
    split = F.transform(
        lines,
        lambda x: F.struct(*[F.get(F.split(x, part), F.lit(i)).alias(n) for i, n in enumerate(("head", "relation", "tail"))]),
    )
    full = F.filter(split, lambda r: (r["head"] != "") & (r["relation"] != "") & (r["tail"] != ""))
    types = F.map_from_entries(F.transform("_given", lambda e: F.struct(e["name"], e["type"])))
    step = compute_once(parsed, full.alias("_found"), types.alias("_types"))
    type_of = lambda name: F.coalesce(F.try_element_at("_types", name), F.lit("Other"))
    given_names = F.transform("_given", lambda e: e["name"])
    ends = F.flatten(F.transform("_found", lambda r: F.array(r["head"], r["tail"])))
    names = F.array_distinct(F.concat(given_names, ends))
    scored = F.transform(
        "_found",
        lambda r: F.struct(
            r["head"].alias("head"),
            r["relation"].alias("relation"),
            r["tail"].alias("tail"),
            scores.triple_confidence(
                F.contains(t, r["head"]), F.contains(t, r["tail"]), good_type_pair(type_of(r["head"]), type_of(r["tail"]))
            ).alias("confidence"),
        ),
    )
    return step.select(
        *keep,
        F.transform(names, lambda n: F.struct(n.alias("name"), type_of(n).alias("type"))).alias("entities"),
        F.array_distinct(F.transform("_found", lambda r: r["relation"])).alias("relations"),
        scored.alias("triples"),
    )


def graph_triples(graphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long form of the ``triples`` column of ``build_graph``."""
    return graphs.select(key, F.posexplode("triples").alias("seq", "_t")).select(
        key, F.col("seq").cast("bigint").alias("seq"), "_t.*"
    )


def graph_entities(graphs: DataFrame, key: str = "doc_id") -> DataFrame:
    return graphs.select(key, F.posexplode("entities").alias("seq", "_e")).select(
        key, F.col("seq").cast("bigint").alias("seq"), "_e.*"
    )


# --- views of a triple ----------------------------------------------------

def triple_record(keep=()) -> list[Column]:
    return [*[F.col(k) for k in keep], F.struct("head", "relation", "tail", "confidence").alias("record")]


def triple_text() -> Column:
    return F.format_string("(%s, %s, %s)", "head", "relation", "tail")


def evidence_text(subject="head", predicate="relation", obj="tail") -> Column:
    return F.concat_ws("-", subject, predicate, obj)


# --- filters and statistics -----------------------------------------------

def found_something(docs: DataFrame, entities: DataFrame, triples: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Documents with at least one entity or triple, and the others."""
    found = entities.select(key).union(triples.select(key)).distinct()
    return docs.join(found, key, "left_semi"), docs.join(found, key, "left_anti")


def graph_statistics(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: distinct entities and relations, triple count, mean confidence (0 when empty).

    Entities are the given ones and the triple ends.
    """
    names = entities.select("name").union(triple_ends(triples, ())).agg(F.count_distinct("name").alias("total_entities"))
    rest = triples.agg(
        F.count_distinct("relation").alias("total_relations"),
        F.count("*").alias("total_triples"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"),
    )
    # two one-row tables
    return names.withColumn("_one", F.lit(1)).join(rest.withColumn("_one", F.lit(1)), "_one").drop("_one")


def type_counts(entities: DataFrame) -> DataFrame:
    """Entities per type; an entity counts once per type it was given."""
    return entities.select("name", "type").distinct().groupBy("type").agg(F.count("*").alias("n"))


def relation_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("relation").agg(F.count("*").alias("n"))


def document_summary(triples: DataFrame, entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: entity, relation and triple counts, and the mean confidence."""
    per_entity = entities.groupBy(key).agg(F.count_distinct("name").alias("entities_count"))
    per_triple = triples.groupBy(key).agg(
        F.count_distinct("relation").alias("relations_count"),
        F.count("*").alias("triples_count"),
        F.avg("confidence").alias("average_confidence"),
    )
    return per_entity.join(per_triple, key, "full").fillna(0)


def outcome_tally(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("success").agg(F.count("*").alias("n"))


def first_entities(entities: DataFrame, k: int = 20, order: str = "seq") -> DataFrame:
    """The first ``k`` entities and, on every row, how many more there are."""
    total = entities.agg(F.greatest(F.count("*") - k, F.lit(0)).alias("more")).withColumn("_one", F.lit(1))
    head = entities.orderBy(order).limit(k).withColumn("_one", F.lit(1))
    return head.join(F.broadcast(total), "_one").drop("_one")


def cap_entities(entities: DataFrame, triples: DataFrame, n: int = 50, keys=("doc_id",)) -> DataFrame:
    """At most ``n`` entities per graph, the best connected first, then by name."""
    degree = triples.select(*keys, F.explode(F.array("head", "tail")).alias("name")).groupBy(*keys, "name").agg(
        F.count("*").alias("degree")
    )
    ranked = entities.join(degree, [*keys, "name"], "left").fillna(0, ["degree"])
    w = Window.partitionBy(*keys).orderBy(F.desc("degree"), "name")
    # row_number() <= n is limited inside every task before the shuffle
    return ranked.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")
