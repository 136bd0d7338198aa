"""Attributes of single entities: extraction, gaps, rule errors, suggestions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from graphloom import rules as R
from graphloom.functions.classify import attribute_class, gap_sources
from graphloom.functions.text import strings
from graphloom.session import merged

ON = ["doc_id", "entity"]


def by_entity(rows: DataFrame) -> DataFrame:
    """Rows dealt once by document and entity: groups by attribute and joins of entities need no further exchange."""
    return rows.repartition(*ON)


def relation_attributes(edges: DataFrame) -> DataFrame:
    """(doc_id, entity, attribute, value) from edges; the last edge wins.

    Subject-side relations describe the source, object-side ones the target. The
    mapping is a literal, so each edge is read once and yields at most two rows.
    """
    as_subject, as_object = F, F
    for names, attribute in R.SUBJECT_PREDICATES:
        as_subject = as_subject.when(F.col("relation").isin(*names), F.lit(attribute))
    for names, attribute in R.OBJECT_PREDICATES:
        # an edge to itself is read from its subject side
        as_object = as_object.when(F.col("relation").isin(*names) & (F.col("source") != F.col("target")), F.lit(attribute))
    sides = F.array(
        F.struct(F.col("source").alias("entity"), as_subject.alias("attribute"), F.col("target").alias("value")),
        F.struct(F.col("target").alias("entity"), as_object.alias("attribute"), F.col("source").alias("value")),
    )
    rows = edges.select("doc_id", "rid", F.inline(sides)).filter(F.col("attribute").isNotNull())
    return by_entity(rows).groupBy(*ON, "attribute").agg(F.max_by("value", "rid").alias("value"))


def pattern_attributes(mentions: DataFrame, patterns=R.ATTRIBUTE_PATTERNS) -> DataFrame:
    """(doc_id, entity, attribute, value): first match of the type's patterns near the entity's first mention."""
    near = mentions.filter("near != ''").select("doc_id", F.col("name").alias("entity"), "type", "near")
    found = [
        F.struct(
            F.lit(attribute).alias("attribute"),
            F.when(
                (F.col("type") == etype) & F.col("near").rlike(pattern), F.regexp_extract("near", pattern, group)
            ).alias("value"),
        )
        for etype, attribute, pattern, group in patterns
    ]
    return near.select(*ON, F.inline(F.array(*found))).filter(F.col("value").isNotNull())


def entity_attributes(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """Attributes of the entities from edges and text; a pattern match overrides an edge."""
    from_edges = relation_attributes(edges).join(
        merged(mentions.select("doc_id", F.col("name").alias("entity")).distinct()), ON, "left_semi"
    )
    ranked = from_edges.withColumn("_p", F.lit(0)).unionByName(by_entity(pattern_attributes(mentions)).withColumn("_p", F.lit(1)))
    return ranked.groupBy(*ON, "attribute").agg(F.max_by("value", "_p").alias("value"))


@dataclass(frozen=True)
class Templates:
    """Wanted attributes per entity type; ``important`` narrows the optional ones (None: all)."""

    required: dict = None
    optional: dict = None
    important: frozenset | None = None

    def wanted(self):
        for etype, names in (self.required or R.REQUIRED_ATTRIBUTES).items():
            yield from ((etype, n, 0.9) for n in names)
        for etype, names in (self.optional or R.OPTIONAL_ATTRIBUTES).items():
            yield from ((etype, n, 0.6) for n in names if self.important is None or n in self.important)


def attribute_gaps(entities: DataFrame, attributes: DataFrame, templates: Templates = Templates()) -> DataFrame:
    """Wanted attributes an entity does not have."""
    per_type: dict[str, list] = {}
    for etype, attribute, confidence in templates.wanted():
        per_type.setdefault(etype, []).append(
            F.struct(F.lit(attribute).alias("missing_attribute"), F.lit(confidence).alias("confidence"))
        )
    wanted = F
    for etype, items in per_type.items():
        wanted = wanted.when(F.col("entity_type") == etype, F.array(*items))
    rows = entities.select("doc_id", F.col("name").alias("entity"), F.col("type").alias("entity_type"))
    rows = rows.filter(F.col("entity_type").isin(*per_type))
    # at most as many as there are wanted attributes; a row for each missing one is made after the join
    named = sorted({attribute for _, attribute, _ in templates.wanted()})
    have = attributes.filter(F.col("attribute").isin(*named)).groupBy(*ON).agg(F.collect_set("attribute").alias("_have"))
    missing = F.filter(wanted, lambda w: ~F.array_contains(F.coalesce("_have", strings([])), w["missing_attribute"]))
    return rows.join(merged(have), ON, "left").select("doc_id", "entity", "entity_type", F.inline(missing)).select(
        "doc_id",
        "entity",
        "entity_type",
        "missing_attribute",
        attribute_class(F.col("missing_attribute")).alias("attribute_type"),
        "confidence",
        gap_sources(F.col("entity_type"), F.col("missing_attribute")).alias("suggested_sources"),
    )


def rule_errors(
    entities: DataFrame,
    attributes: DataFrame,
    allowed_jobs: DataFrame | None = None,
    min_year: int = 1600,
    max_year: int = 2100,
) -> DataFrame:
    """Entities whose attributes break one of three rules (an extension: only the rule names are given).

    Profession against employer needs ``allowed_jobs(profession, employer)``; a
    place must not lie in itself; a founding year must lie in the given range.
    """
    wide = attributes.filter(F.col("attribute").isin("职业", "工作单位", "所属区域", "成立时间")).groupBy(*ON).agg(
        F.max(F.when(F.col("attribute") == "职业", F.col("value"))).alias("profession"),
        F.max(F.when(F.col("attribute") == "工作单位", F.col("value"))).alias("employer"),
        F.max(F.when(F.col("attribute") == "所属区域", F.col("value"))).alias("region"),
        F.max(F.when(F.col("attribute") == "成立时间", F.col("value"))).alias("founded"),
    )
    typed = entities.select("doc_id", F.col("name").alias("entity"), "type").join(merged(wide), ON)
    year = F.col("founded").try_cast("int")
    region_bad = (F.col("type") == "Location") & (F.col("region") == F.col("entity"))
    year_bad = (F.col("type") == "Organization") & F.col("founded").isNotNull() & (
        year.isNull() | ~year.between(min_year, max_year)
    )
    if allowed_jobs is not None:
        known = allowed_jobs.select("profession", "employer", F.lit(0).alias("_salt"), F.lit(True).alias("_ok")).distinct()
        # rows without both have no partner: they are spread, not sent to the one task of the null key
        asked = F.col("profession").isNotNull() & F.col("employer").isNotNull()
        typed = typed.withColumn("_salt", F.when(asked, 0).otherwise(F.xxhash64(*ON).bitwiseOR(F.lit(1))))
        typed = typed.join(known, ["profession", "employer", "_salt"], "left")
        job_bad = (
            (F.col("type") == "Person") & F.col("profession").isNotNull() & F.col("employer").isNotNull() & F.col("_ok").isNull()
        )
    else:
        job_bad = F.lit(False)
    checks = []
    for key, bad in (("profession", job_bad), ("region", region_bad), ("founding", year_bad)):
        label, message = R.RULE_ERRORS[key]
        checks.append(
            F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(label).alias("error_type"), F.lit(message).alias("suggested_fix")))
        )
    return typed.select(*ON, F.inline(F.array_compact(F.array(*checks))))


def suggestions(gaps: DataFrame, errors: DataFrame, associations: DataFrame) -> DataFrame:
    """One table of improvements: attributes to fill, errors to fix, relations to add."""
    sources = F.concat_ws(", ", "suggested_sources")
    fill = gaps.select(
        "doc_id",
        F.lit("属性补全").alias("type"),
        F.col("entity").alias("target"),
        F.concat(F.lit("补全"), "missing_attribute", F.lit("属性")).alias("action"),
        F.when(F.col("confidence") > 0.8, F.lit("高")).otherwise(F.lit("中")).alias("priority"),
        F.concat(F.lit("从"), sources, F.lit("中查询"), "entity", F.lit("的"), "missing_attribute").alias("implementation"),
    )
    fix = errors.select(
        "doc_id",
        F.lit("逻辑修正").alias("type"),
        F.col("entity").alias("target"),
        F.concat(F.lit("修正"), "error_type").alias("action"),
        F.lit("高").alias("priority"),
        F.col("suggested_fix").alias("implementation"),
    )
    strong = associations.filter((F.col("strength") > 0.7) & ~F.array_contains("association_types", R.LABEL_DIRECT))
    link = strong.select(
        "doc_id",
        F.lit("关系补全").alias("type"),
        F.concat_ws(", ", "entity1", "entity2").alias("target"),
        F.lit("添加潜在关系").alias("action"),
        F.lit("中").alias("priority"),
        F.concat(
            F.lit("基于"), F.concat_ws(", ", "association_types"), F.lit("添加"), "entity1", F.lit("与"), "entity2", F.lit("的关系")
        ).alias("implementation"),
    )
    return fill.unionByName(fix).unionByName(link)
