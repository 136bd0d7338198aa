"""Registered queries: entity details inside documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import rules as R
from graphloom.functions.classify import attribute_class, entity_class, gap_sources, type_similarity
from graphloom.operators import detail, pairs
from graphloom.operators.mentions import entity_mentions, stored_mentions
from graphloom.plans.detail_analysis import analyze_details
from graphloom.workloads import sql_text as q
from graphloom.workloads.registry import query
from graphloom.workloads.substrates import DOC_EDGES, DOC_EDGES_DUCK, DOC_ENTITIES, DOC_ENTITIES_DUCK, ZH_DOCS, plain, spark_rows

ENT, EDG = DOC_ENTITIES_DUCK, DOC_EDGES_DUCK
BASE = f"WITH docs AS MATERIALIZED (SELECT doc_id, text FROM ({q.ZH}) z), ent AS MATERIALIZED ({ENT}), edg AS MATERIALIZED ({EDG})"


def docs(spark, d):
    return spark_rows(spark, d, ZH_DOCS).select("doc_id", "text")


def entities(spark, d):
    return spark_rows(spark, d, DOC_ENTITIES)


def edges(spark, d):
    return spark_rows(spark, d, DOC_EDGES)


def mentions(spark, d):
    return entity_mentions(entities(spark, d), docs(spark, d))


def _gaps(spark, d, templates=detail.Templates()):
    attributes = detail.entity_attributes(mentions(spark, d), edges(spark, d))
    return detail.attribute_gaps(entities(spark, d), attributes, templates)


_WINDOW = """CASE WHEN strpos(text, name) > 0 THEN substr(text, greatest(1, strpos(text, name) - 50), strpos(text, name) + length(name) + 50 - greatest(1, strpos(text, name) - 50)) ELSE '' END"""


@query("txt_16_context_window", f"{BASE} SELECT doc_id, name, {_WINDOW} AS near FROM ent JOIN docs USING (doc_id)")
def txt_16(spark, d):
    return mentions(spark, d).select("doc_id", "name", "near")


def _pattern_sql():
    parts = [
        f"SELECT doc_id, name AS entity, '{a}' AS attribute, regexp_extract(near, {q.lit(p)}, {g}) AS value FROM near WHERE type = '{t}' AND regexp_matches(near, {q.lit(p)})"
        for t, a, p, g in R.ATTRIBUTE_PATTERNS
    ]
    return f"near AS (SELECT doc_id, name, type, {_WINDOW} AS near FROM ent JOIN docs USING (doc_id)), pat AS ({' UNION ALL '.join(parts)})"


def _relation_sql():
    s = " ".join(f"WHEN relation IN ({', '.join(q.lit(n) for n in names)}) THEN '{a}'" for names, a in R.SUBJECT_PREDICATES)
    o = " ".join(f"WHEN relation IN ({', '.join(q.lit(n) for n in names)}) THEN '{a}'" for names, a in R.OBJECT_PREDICATES)
    return f"""sides AS (SELECT doc_id, rid, source AS entity, CASE {s} END AS attribute, target AS value FROM edg
UNION ALL SELECT doc_id, rid, target, CASE {o} END, source FROM edg),
rel AS (SELECT doc_id, entity, attribute, arg_max(value, rid) AS value FROM sides WHERE attribute IS NOT NULL GROUP BY 1, 2, 3)"""


_ATTRS = f"""{BASE}, {_pattern_sql()}, {_relation_sql()},
attrs AS (SELECT doc_id, entity, attribute, arg_max(value, p) AS value FROM (SELECT *, 1 AS p FROM pat UNION ALL
  SELECT rel.*, 0 FROM rel WHERE EXISTS (SELECT 1 FROM ent WHERE ent.doc_id = rel.doc_id AND ent.name = rel.entity)) x GROUP BY 1, 2, 3)"""


@query("txt_17_pattern_attributes", f"{_ATTRS} SELECT doc_id, entity, attribute, value FROM pat")
def txt_17(spark, d):
    return detail.pattern_attributes(mentions(spark, d))


@query("jn_6_relation_attributes", f"{_ATTRS} SELECT doc_id, entity, attribute, value FROM rel")
def jn_6(spark, d):
    return detail.relation_attributes(edges(spark, d))


def _wanted_sql():
    rows = ", ".join(f"('{t}', '{a}', {c})" for t, a, c in detail.Templates().wanted())
    return f"(VALUES {rows}) w(entity_type, missing_attribute, confidence)"


def _class_sql(a):
    return "CASE " + " ".join(f"WHEN {a} IN ({', '.join(q.lit(n) for n in names)}) THEN '{c}'" for names, c in R.ATTRIBUTE_CLASSES) + f" ELSE '{R.ATTRIBUTE_CLASS_DEFAULT}' END"


def _sources_sql(t, a, sep):
    base = sep.join(R.GAP_SOURCES)
    cases = " ".join(f"WHEN {t} = '{et}' AND {a} IN ({', '.join(q.lit(n) for n in names)}) THEN '{base}{sep}{src}'" for et, names, src in R.GAP_EXTRA_SOURCES)
    return f"CASE {cases} ELSE '{base}' END"


_GAPS = f"""{_ATTRS}, gaps AS (SELECT doc_id, name AS entity, entity_type, missing_attribute, {_class_sql('missing_attribute')} AS attribute_type, confidence::DOUBLE AS confidence,
{_sources_sql('entity_type', 'missing_attribute', ', ')} AS suggested_sources FROM ent JOIN {_wanted_sql()} ON entity_type = type
WHERE NOT EXISTS (SELECT 1 FROM attrs WHERE attrs.doc_id = ent.doc_id AND attrs.entity = ent.name AND attribute = missing_attribute))"""


def _gap_columns(gaps):
    return gaps.withColumn("suggested_sources", F.concat_ws(", ", "suggested_sources"))


@query("jn_7_attribute_gaps", f"{_GAPS} SELECT * FROM gaps")
def jn_7(spark, d):
    return _gap_columns(_gaps(spark, d))


@query(
    "ext_3_important_optional_attributes",
    f"{_GAPS} SELECT missing_attribute, count(*) AS n FROM gaps WHERE confidence = 0.9::DOUBLE OR missing_attribute IN ('职业', '成立时间') GROUP BY ALL",
)
def ext_3(spark, d):
    few = detail.Templates(important=frozenset(["职业", "成立时间"]))
    gaps = _gaps(spark, d, few)
    return gaps.groupBy("missing_attribute").agg(F.count("*").alias("n"))


@query("txt_23_attribute_class", f"{_GAPS} SELECT attribute_type, count(*) AS n FROM gaps GROUP BY ALL")
def txt_23(spark, d):
    gaps = _gaps(spark, d)
    return gaps.groupBy(attribute_class(F.col("missing_attribute")).alias("attribute_type")).agg(F.count("*").alias("n"))


@query("txt_24_gap_sources", f"{_GAPS} SELECT entity_type, missing_attribute, suggested_sources, count(*) AS n FROM gaps GROUP BY ALL")
def txt_24(spark, d):
    gaps = _gaps(spark, d).drop("suggested_sources")
    listed = gaps.withColumn("suggested_sources", F.concat_ws(", ", gap_sources(F.col("entity_type"), F.col("missing_attribute"))))
    return listed.groupBy("entity_type", "missing_attribute", "suggested_sources").agg(F.count("*").alias("n"))


_ERRORS = f"""errors AS (
SELECT a.doc_id, a.entity, '人物职业一致性' AS error_type, '职业与工作单位不匹配' AS suggested_fix FROM attrs a JOIN attrs b ON a.doc_id = b.doc_id AND a.entity = b.entity AND a.attribute = '职业' AND b.attribute = '工作单位'
  JOIN ent ON ent.doc_id = a.doc_id AND ent.name = a.entity AND type = 'Person' WHERE NOT (a.value = '经理' AND b.value = '阿里公司')
UNION ALL SELECT a.doc_id, a.entity, '地理位置层次性', '地理位置层次关系错误' FROM attrs a JOIN ent ON ent.doc_id = a.doc_id AND ent.name = a.entity AND type = 'Location' WHERE attribute = '所属区域' AND value = entity
UNION ALL SELECT a.doc_id, a.entity, '组织成立时间合理性', '成立时间不合理' FROM attrs a JOIN ent ON ent.doc_id = a.doc_id AND ent.name = a.entity AND type = 'Organization' WHERE attribute = '成立时间' AND coalesce(NOT (TRY_CAST(value AS INT) BETWEEN 1900 AND 2000), true))"""


def _jobs(spark):
    return spark.createDataFrame([("经理", "阿里公司")], "profession string, employer string")


@query("ext_1_rule_errors", f"{_ATTRS}, {_ERRORS} SELECT * FROM errors")
def ext_1(spark, d):
    found = detail.entity_attributes(mentions(spark, d), edges(spark, d))
    return detail.rule_errors(entities(spark, d), found, _jobs(spark), 1900, 2000)


@query(
    "ext_4_entity_types",
    f"{BASE} SELECT type, count(*) AS n FROM (SELECT CASE WHEN type <> 'Other' THEN type ELSE {q.entity_class('name')} END AS type FROM ent) x GROUP BY ALL",
)
def ext_4(spark, d):
    given = F.when(F.col("type") != "Other", F.col("type"))
    return entities(spark, d).groupBy(entity_class(F.col("name"), given).alias("type")).agg(F.count("*").alias("n"))


# --- pairs ----------------------------------------------------------------

_COOC = "CASE WHEN p1 > 0 AND p2 > 0 THEN greatest(0.0, 1.0 - abs(p1 - p2)::DOUBLE / len) ELSE 0.0 END::DOUBLE"


def _pairs_sql(compat=False):
    return f"""pos AS (SELECT doc_id, seq, name, type, strpos(text, name) AS p, length(text) AS len FROM ent JOIN docs USING (doc_id)),
prs AS (SELECT a.doc_id, a.name AS entity1, b.name AS entity2, a.p AS p1, b.p AS p2, a.len AS len, {q.type_similarity('a.type', 'b.type', compat)} AS sim FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.seq < b.seq),
ev AS (SELECT doc_id, least(source, target) AS x, greatest(source, target) AS y, count(*) AS n FROM edg WHERE source <> target GROUP BY 1, 2, 3),
str AS (SELECT prs.doc_id, entity1, entity2, {_COOC} AS cooc, sim, coalesce(n, 0) AS n_evidence FROM prs LEFT JOIN ev ON ev.doc_id = prs.doc_id AND x = least(entity1, entity2) AND y = greatest(entity1, entity2)),
ass AS (SELECT *, CASE WHEN n_evidence > 0 THEN 0.8 ELSE 0.0 END::DOUBLE + cooc * 0.3::DOUBLE + sim * 0.2::DOUBLE AS strength,
 {q.present([("n_evidence > 0", R.LABEL_DIRECT), ("cooc > 0.5", R.LABEL_COOCCUR), ("sim > 0.7", R.LABEL_TYPE)])} AS labels FROM str)"""


_ASSOC = f"{BASE}, {_pairs_sql()} SELECT doc_id, entity1, entity2, round(strength, 6) AS strength, {q.joined('labels')} AS labels, n_evidence FROM ass WHERE strength > 0.3::DOUBLE"


def _associations(spark, d, **kw):
    return pairs.pair_associations(stored_mentions(entities(spark, d), docs(spark, d)), edges(spark, d), **kw)


def _shown(df):
    return df.select("doc_id", "entity1", "entity2", F.round("strength", 6).alias("strength"), F.concat_ws("|", "association_types").alias("labels"), "n_evidence")


@query("mth_9_pair_strength", _ASSOC)
def mth_9(spark, d):
    return _shown(_associations(spark, d))


@query(
    "mth_9_pair_strength_compat",
    f"{BASE}, {_pairs_sql(True)} SELECT doc_id, entity1, entity2, round(strength, 6) AS strength, {q.joined('labels')} AS labels, n_evidence FROM ass WHERE strength > 0.3::DOUBLE",
)
def mth_9_compat(spark, d):
    return _shown(_associations(spark, d, compat=True))


@query(
    "jn_8_near_pairs",
    f"{BASE}, {_pairs_sql()} SELECT doc_id, entity1, entity2 FROM str WHERE cooc * 0.3::DOUBLE + sim * 0.2::DOUBLE > 0.3::DOUBLE",
)
def jn_8(spark, d):
    return pairs.near_pairs(stored_mentions(entities(spark, d), docs(spark, d))).select("doc_id", "entity1", "entity2")


@query(
    "flt_4_strength_threshold",
    f"{BASE}, {_pairs_sql()} SELECT doc_id, entity1, entity2 FROM ass WHERE strength > 0.32::DOUBLE AND n_evidence = 0",
)
def flt_4(spark, d):
    return _associations(spark, d, threshold=0.32).filter("n_evidence = 0").select("doc_id", "entity1", "entity2")


@query("mth_7_cooccurrence", f"{BASE}, {_pairs_sql()} SELECT doc_id, entity1, entity2, round(cooc, 6) AS cooccurrence FROM ass WHERE strength > 0.3::DOUBLE")
def mth_7(spark, d):
    return _associations(spark, d).select("doc_id", "entity1", "entity2", F.round("cooccurrence", 6).alias("cooccurrence"))


@query("mth_8_type_similarity", f"{BASE} SELECT doc_id, rid, {q.type_similarity('a.type', 'b.type')} AS similarity FROM edg JOIN ent a USING (doc_id) JOIN ent b USING (doc_id) WHERE a.name = source AND b.name = target")
def mth_8(spark, d):
    e = entities(spark, d)
    a = e.select("doc_id", F.col("name").alias("source"), F.col("type").alias("t1"))
    b = e.select("doc_id", F.col("name").alias("target"), F.col("type").alias("t2"))
    joined = edges(spark, d).join(a, ["doc_id", "source"]).join(b, ["doc_id", "target"])
    return joined.select("doc_id", "rid", type_similarity(F.col("t1"), F.col("t2")).alias("similarity"))


@query(
    "jn_9_direct_evidence",
    f"""{BASE} SELECT edg.doc_id, CASE WHEN a.seq < b.seq THEN source ELSE target END AS entity1, CASE WHEN a.seq < b.seq THEN target ELSE source END AS entity2, rid,
source || '-' || relation || '-' || target AS evidence FROM edg JOIN ent a ON a.doc_id = edg.doc_id AND a.name = source JOIN ent b ON b.doc_id = edg.doc_id AND b.name = target WHERE source <> target""",
)
def jn_9(spark, d):
    return pairs.direct_evidence(entities(spark, d), edges(spark, d))


@query(
    "ext_2_triangles",
    f"""{BASE}, u AS (SELECT DISTINCT doc_id, least(source, target) AS x, greatest(source, target) AS y FROM edg WHERE source <> target)
SELECT p.doc_id, p.x AS a, p.y AS b, r.y AS c FROM u p JOIN u r ON r.doc_id = p.doc_id AND r.x = p.y JOIN u s ON s.doc_id = p.doc_id AND s.x = p.x AND s.y = r.y""",
)
def ext_2(spark, d):
    return pairs.triangles(edges(spark, d))


_SUGGEST = f"""{_GAPS}, {_ERRORS}, {_pairs_sql()},
sug AS (SELECT doc_id, '属性补全' AS type, entity AS target, '补全' || missing_attribute || '属性' AS action, CASE WHEN confidence > 0.8 THEN '高' ELSE '中' END AS priority,
 '从' || suggested_sources || '中查询' || entity || '的' || missing_attribute AS implementation FROM gaps
UNION ALL SELECT doc_id, '逻辑修正', entity, '修正' || error_type, '高', suggested_fix FROM errors
UNION ALL SELECT doc_id, '关系补全', entity1 || ', ' || entity2, '添加潜在关系', '中', '基于' || {q.joined('labels', ', ')} || '添加' || entity1 || '与' || entity2 || '的关系' FROM ass WHERE strength > 0.7::DOUBLE AND n_evidence = 0)"""


def _analysis(spark, d):
    return analyze_details(entities(spark, d), edges(spark, d), docs(spark, d), allowed_jobs=_jobs(spark), min_year=1900, max_year=2000)


@query("set_5_suggestions", f"{_SUGGEST} SELECT * FROM sug")
def set_5(spark, d):
    return _analysis(spark, d).suggestions


@query(
    "pipe_6_detail_analysis",
    f"""{_SUGGEST} SELECT 'gaps' AS part, count(*) AS n FROM gaps UNION ALL SELECT 'errors', count(*) FROM errors
UNION ALL SELECT 'associations', count(*) FROM ass WHERE strength > 0.3::DOUBLE UNION ALL SELECT 'suggestions', count(*) FROM sug""",
)
def pipe_6(spark, d):
    a = _analysis(spark, d)
    tables = {"gaps": a.gaps, "errors": a.errors, "associations": a.associations, "suggestions": a.suggestions}
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
