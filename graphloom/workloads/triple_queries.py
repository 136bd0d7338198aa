"""Registered queries: responses, triples, reports, hooks and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import hooks, rules as R, schemas
from graphloom.functions.classify import entity_class, entity_class_basic, confidence_tier
from graphloom.operators import triples as tr
from graphloom.operators.graph import collapse_undirected, neighbour_preview, undirected_degrees
from graphloom.plans import report
from graphloom.session import run_dir, spread, stored
from graphloom.sources import graph_json, relational
from graphloom.sources.graph_table import GraphTable, buckets_for
from graphloom.streaming import incremental
from graphloom.workloads import sql_text as q
from graphloom.workloads.registry import query
from graphloom.workloads.substrates import ANSWERED, RESPONSES, TRIPLES, ZH_DOCS, plain, spark_rows, table

RESP, TRIP, ANSW = plain(RESPONSES), plain(TRIPLES), plain(ANSWERED)
ORDER = ("doc_id", "seq", "relation", "confidence")


def triples(spark, d):
    return spark_rows(spark, d, TRIPLES)


def _order():
    return F.struct(*ORDER)


def _r(name="confidence"):
    return F.round(name, 6).alias(name)


# --- sources --------------------------------------------------------------

@query(
    "src_2_graph_json",
    """SELECT c_custkey AS graph_id, eid::BIGINT AS eid, name, type, descr FROM (
SELECT c_custkey, 0 AS eid, c_name AS name, 'account' AS type, c_mktsegment AS descr FROM customer
UNION ALL SELECT c_custkey, 1, 'N' || c_nationkey, 'unknown', NULL FROM customer) x""",
)
def src_2(spark, d):
    entities = graph_json.graph_entities(graph_json.parse_graph_json(_customer_graphs(spark, d), "json"))
    return entities.select("graph_id", "eid", "name", "type", F.try_element_at("attributes", F.lit("描述")).alias("descr"))


def _customer_graphs(spark, d):
    # every customer row as a graph text with a repeated entity, the later one winning
    quoted = lambda *c: F.concat(F.lit('"'), *c, F.lit('"'))
    text = F.concat(
        F.lit('{"entities":[{"name":'), quoted("c_name"), F.lit(',"type":"old"},{"name":'), quoted(F.lit("N"), "c_nationkey"),
        F.lit('},{"name":'), quoted("c_name"), F.lit(',"type":"account","attributes":{"描述":'), quoted("c_mktsegment"),
        F.lit('}}],"relations":[{"name":"in","source":'), quoted("c_name"), F.lit(',"target":'), quoted(F.lit("N"), "c_nationkey"), F.lit("}]}"),
    )
    return table(spark, d, "customer").select(F.col("c_custkey").alias("graph_id"), text.alias("json"))


@query(
    "src_2_graph_json_edges",
    "SELECT c_custkey AS graph_id, 0::BIGINT AS rid, 'in' AS name, c_name AS source, 'N' || c_nationkey AS target, 'unknown' AS type, 0 AS n_attributes FROM customer",
)
def src_2_edges(spark, d):
    edges = graph_json.graph_edges(graph_json.parse_graph_json(_customer_graphs(spark, d), "json"))
    return edges.select("graph_id", "rid", "name", "source", "target", "type", F.size("attributes").alias("n_attributes"))


@query(
    "src_2_graph_json_files",
    """SELECT count(*) AS graphs, count(DISTINCT c_custkey) AS ids, 3 * count(*) AS entities, count(*) AS edges FROM customer""",
)
def src_2_files(spark, d):
    # the same graphs written as lines of files and read back: ids are places
    path = run_dir(spark, "graphs")
    _customer_graphs(spark, d).select("json").write.text(path)
    graphs = graph_json.read_graph_json(spark, path, multi_line=False)
    return graphs.agg(
        F.count("*").alias("graphs"),
        F.count_distinct("graph_id").alias("ids"),
        F.sum(F.size("entities")).alias("entities"),
        F.sum(F.size("relations")).alias("edges"),
    )


_ENT_LINES = f"""SELECT doc_id, rid, arg_max(type, pos) AS type, name FROM (
SELECT doc_id, rid, pos, trim(split_part(line, '|', 1)) AS name, trim(split_part(line, '|', 2)) AS type
FROM (SELECT doc_id, rid, unnest(string_split(entity_response, chr(10))) AS line, generate_subscripts(string_split(entity_response, chr(10)), 1) AS pos
  FROM (SELECT *, row_number() OVER () AS rid FROM ({{src}}) s) r) l
WHERE contains(line, '|')) e WHERE name <> '' GROUP BY doc_id, rid, name"""


@query(
    "src_3_entity_lines",
    f"SELECT doc_id, name, type, count(*) AS n FROM ({_ENT_LINES.format(src=RESP)}) x GROUP BY ALL",
)
def src_3(spark, d):
    responses = spark_rows(spark, d, RESPONSES).select("doc_id", "part", F.col("entity_response").alias("response"))
    return tr.read_entities(responses).groupBy("doc_id", "name", "type").agg(F.count("*").alias("n"))


_P = r"\(([^,]+),\s*([^,]+),\s*([^)]+)\)"
_TRIPLE_LINES = f"""SELECT doc_id, part, pos - 1 AS seq, trim(regexp_extract(line, '{_P}', 1)) AS head, trim(regexp_extract(line, '{_P}', 2)) AS relation, trim(regexp_extract(line, '{_P}', 3)) AS tail
FROM (SELECT doc_id, part, unnest(string_split(triple_response, chr(10))) AS line, generate_subscripts(string_split(triple_response, chr(10)), 1) AS pos FROM ({RESP}) r) l
WHERE regexp_matches(line, '{_P}')"""


def _responses(spark, d):
    return spark_rows(spark, d, RESPONSES).select("doc_id", "part", F.col("triple_response").alias("response"))


@query("src_4a_triple_lines_strict", f"SELECT doc_id, part, seq, head, relation, tail FROM ({_TRIPLE_LINES}) t WHERE head <> '' AND relation <> '' AND tail <> ''")
def src_4a(spark, d):
    return tr.read_triples(_responses(spark, d))


@query("src_4b_triple_lines_lenient", _TRIPLE_LINES)
def src_4b(spark, d):
    return tr.read_triples(_responses(spark, d), "lenient")


@query(
    "ext_7_relational_triples",
    "SELECT 'C' || c_custkey AS head, 'in_nation' AS relation, 'N' || c_nationkey AS tail FROM customer UNION ALL SELECT 'C' || c_custkey, 'in_segment', c_mktsegment FROM customer",
)
def ext_7(spark, d):
    return relational.foreign_key_triples(
        table(spark, d, "customer"), "c_custkey", "C", {"c_nationkey": ("in_nation", "N"), "c_mktsegment": ("in_segment", "")}
    )


# --- build ----------------------------------------------------------------

_BUILT = f"""
given AS (SELECT DISTINCT doc_id, person AS name, 'Person' AS type FROM src UNION SELECT doc_id, company || '公司', 'Organization' FROM src UNION SELECT doc_id, city, 'Location' FROM src),
raw AS (SELECT doc_id, text, person AS head, '工作于' AS relation, company || '公司' AS tail FROM src UNION ALL SELECT doc_id, text, company || '公司', '位于', city FROM src UNION ALL SELECT doc_id, text, person, '认识', country FROM src),
typed AS (SELECT raw.*, coalesce(h.type, 'Other') AS ht, coalesce(t.type, 'Other') AS tt FROM raw LEFT JOIN given h ON h.doc_id = raw.doc_id AND h.name = head LEFT JOIN given t ON t.doc_id = raw.doc_id AND t.name = tail),
built AS (SELECT DISTINCT doc_id, head, relation, tail, ht, tt, {q.found_confidence('contains(text, head)', 'contains(text, tail)', q.good_pair('ht', 'tt'))} AS confidence FROM typed),
ends AS (SELECT doc_id, unnest([head, tail]) AS name FROM built),
all_entities AS (SELECT doc_id, name, type FROM given UNION SELECT doc_id, name, 'Other' FROM ends WHERE NOT EXISTS (SELECT 1 FROM given g WHERE g.doc_id = ends.doc_id AND g.name = ends.name))
"""
WITH_BUILT = f"WITH src AS ({plain(ZH_DOCS)}), {_BUILT}"


def answered(spark, d):
    return spark_rows(spark, d, ANSWERED)


def built(spark, d):
    return tr.build_graph(answered(spark, d))


@query("pipe_3_build_graph", f"{WITH_BUILT} SELECT doc_id, head, relation, tail, round(confidence, 6) AS confidence FROM built")
def pipe_3(spark, d):
    return tr.graph_triples(built(spark, d)).select("doc_id", "head", "relation", "tail", _r())


def _long(spark, d):
    """Documents, entities and triples of the answered documents as separate tables."""
    docs = answered(spark, d)
    entities = tr.read_entities(docs.select("doc_id", F.col("entity_response").alias("response")))
    found = tr.read_triples(docs.select("doc_id", F.col("triple_response").alias("response")))
    return docs.select("doc_id", "text"), entities, found


@query("mth_6_triple_confidence", f"{WITH_BUILT} SELECT doc_id, head, relation, tail, round(confidence, 6) AS confidence FROM built")
def mth_6(spark, d):
    docs, entities, found = _long(spark, d)
    scored = tr.score_triples(found, docs, entities)
    return tr.merge_triples(scored).select("doc_id", "head", "relation", "tail", _r())


@query("jn_5_backfill_entities", f"{WITH_BUILT} SELECT doc_id, name, type FROM all_entities")
def jn_5(spark, d):
    _, entities, found = _long(spark, d)
    return tr.backfill_entities(entities, found)


@query("jn_14_end_types", f"{WITH_BUILT} SELECT doc_id, head, tail, ht AS head_type, tt AS tail_type FROM built")
def jn_14(spark, d):
    _, entities, found = _long(spark, d)
    return tr.with_end_types(found, entities).select("doc_id", "head", "tail", "head_type", "tail_type").distinct()


@query("set_1_entity_union", f"{WITH_BUILT} SELECT DISTINCT name FROM all_entities")
def set_1(spark, d):
    _, entities, found = _long(spark, d)
    return entities.select("name").union(tr.triple_ends(found, ())).distinct()


@query(
    "flt_3_found_something",
    "WITH found AS (SELECT l_orderkey FROM lineitem) SELECT o_orderkey IN (FROM found) AS found, count(*) AS n FROM orders GROUP BY ALL",
)
def flt_3(spark, d):
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    found = triples(spark, d)
    entities = found.select("doc_id", F.col("head").alias("name"))
    kept, rejected = tr.found_something(docs, entities, found)
    both = kept.select(F.lit(True).alias("found")).unionByName(rejected.select(F.lit(False).alias("found")))
    return both.groupBy("found").agg(F.count("*").alias("n"))


@query("prj_1_triple_record", f"SELECT doc_id, head, relation, tail, round(confidence, 6) AS confidence FROM ({TRIP}) t")
def prj_1(spark, d):
    return triples(spark, d).select(*tr.triple_record(["doc_id"])).select("doc_id", "record.*").withColumn("confidence", F.round("confidence", 6))


@query(
    "prj_2_triple_text",
    f"SELECT doc_id, '(' || head || ', ' || relation || ', ' || tail || ')' AS shown, head || '-' || relation || '-' || tail AS evidence FROM ({TRIP}) t",
)
def prj_2(spark, d):
    return triples(spark, d).select("doc_id", tr.triple_text().alias("shown"), tr.evidence_text().alias("evidence"))


# --- sinks ----------------------------------------------------------------

@query(
    "snk_1_export_json",
    f"""{WITH_BUILT} SELECT doc_id, e.n AS entities, t.relations AS relations, t.n AS triples, t.total AS total FROM (SELECT doc_id, count(*) AS n FROM all_entities GROUP BY 1) e
JOIN (SELECT doc_id, count(*) AS n, count(DISTINCT relation) AS relations, round(sum(confidence), 6) AS total FROM built GROUP BY 1) t USING (doc_id)""",
)
def snk_1(spark, d):
    exported = graph_json.export_graph(built(spark, d))
    shape = "entities array<struct<id string, type string>>, relations array<string>, triples array<struct<head string, relation string, tail string, confidence double>>"
    g = exported.select("doc_id", F.from_json("graph", shape).alias("g"))
    total = F.aggregate("g.triples", F.lit(0.0), lambda acc, t: acc + t["confidence"])
    size = lambda c: F.size(c).cast("bigint")
    return g.select(
        "doc_id", size("g.entities").alias("entities"), size("g.relations").alias("relations"), size("g.triples").alias("triples"),
        F.round(total, 6).alias("total"),
    )


@query("snk_3_accumulate", f"SELECT relation, count(*) * 2 AS n FROM ({TRIP}) t GROUP BY ALL")
def snk_3(spark, d):
    path = run_dir(spark, "accumulate")
    rows = triples(spark, d)
    graph_json.append_graph(path, rows)
    graph_json.clear_graph(spark, path, rows.schema)
    for _ in range(2):
        graph_json.append_graph(path, rows)
    return tr.relation_counts(spark.read.schema(rows.schema).parquet(path))


@query(
    "snk_3_graph_table",
    f"SELECT relation, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM (SELECT head, relation, tail, max(confidence) AS confidence FROM ({TRIP}) t GROUP BY ALL) m GROUP BY ALL",
)
def snk_3_table(spark, d):
    # the first batch knows less of every triple; the second raises them, the third changes nothing
    rows = triples(spark, d)
    graph = GraphTable(spark, run_dir(spark, "table"), buckets_for(rows.count()))
    graph.merge(rows.withColumn("confidence", F.col("confidence") / 2), 0)
    for batch in (1, 2):
        graph.merge(rows, batch)
    return graph.relation_statistics().withColumn("avg_confidence", F.round("avg_confidence", 6))


# --- aggregates and reports -----------------------------------------------

@query(
    "agg_1_merge_triples",
    f"SELECT doc_id, head, relation, tail, min(seq) AS seq, round(max(confidence), 6) AS confidence FROM ({TRIP}) t GROUP BY ALL",
)
def agg_1(spark, d):
    return tr.merge_triples(triples(spark, d)).select("doc_id", "head", "relation", "tail", "seq", _r())


@query("agg_1_merge_across_documents", f"SELECT head, relation, tail, round(max(confidence), 6) AS confidence FROM ({TRIP}) t GROUP BY ALL")
def agg_1_corpus(spark, d):
    return tr.merge_triples(triples(spark, d), ()).select("head", "relation", "tail", _r())


_STATS = f"""SELECT (SELECT count(DISTINCT e) FROM (SELECT unnest([head, tail]) AS e FROM ({TRIP}) t) x) AS total_entities, count(DISTINCT relation) AS total_relations,
count(*) AS total_triples, round(avg(confidence), 6) AS average_confidence FROM ({TRIP}) t"""


@query("agg_2_graph_statistics", _STATS)
def agg_2(spark, d):
    rows = triples(spark, d)
    entities = rows.select(F.col("head").alias("name"))
    return tr.graph_statistics(rows, entities).withColumn("average_confidence", F.round("average_confidence", 6))


@query(
    "pipe_5_statistics_tool",
    f"""{WITH_BUILT} SELECT 'type' AS kind, type AS label, count(*) AS n FROM (SELECT DISTINCT name, type FROM all_entities) e GROUP BY ALL
UNION ALL SELECT 'relation', relation, count(*) FROM built GROUP BY ALL""",
)
def pipe_5(spark, d):
    # both counts read the graphs: a text is parsed once
    graphs = stored(built(spark, d).select("doc_id", "entities", "triples"))
    types = tr.type_counts(tr.graph_entities(graphs)).select(F.lit("type").alias("kind"), F.col("type").alias("label"), "n")
    relations = tr.relation_counts(tr.graph_triples(graphs)).select(F.lit("relation").alias("kind"), F.col("relation").alias("label"), "n")
    return types.unionByName(relations)


@query("agg_3_relation_distribution", f"SELECT relation, count(*) AS n FROM ({TRIP}) t GROUP BY ALL")
def agg_3(spark, d):
    return tr.relation_counts(triples(spark, d))


@query(
    "agg_4_type_distribution",
    f"{WITH_BUILT} SELECT type, count(*) AS n FROM (SELECT name, {q.entity_class('name')} AS type FROM (SELECT DISTINCT name FROM ends) e) c GROUP BY ALL",
)
def agg_4(spark, d):
    _, _, found = _long(spark, d)
    return report.type_distribution(found)


_BIN = "CASE WHEN confidence <= 0.2::DOUBLE THEN 0 WHEN confidence <= 0.4::DOUBLE THEN 1 WHEN confidence <= 0.6::DOUBLE THEN 2 WHEN confidence <= 0.8::DOUBLE THEN 3 ELSE 4 END"
_LABELS = "(VALUES " + ", ".join(f"({i}, '{b[0]}')" for i, b in enumerate(R.HISTOGRAM_BINS)) + ") l(bin, label)"


@query(
    "agg_5_confidence_histogram",
    f"SELECT l.bin, label, coalesce(n, 0) AS n FROM {_LABELS} LEFT JOIN (SELECT {_BIN} AS bin, count(*) AS n FROM ({TRIP}) t GROUP BY 1) c ON c.bin = l.bin",
)
def agg_5(spark, d):
    return report.confidence_histogram(triples(spark, d))


_SUMMARY = f"""SELECT count(*) AS triples, count(DISTINCT relation) AS relations, round(avg(confidence), 6) AS avg_confidence,
round(max(confidence), 6) AS max_confidence, round(min(confidence), 6) AS min_confidence FROM ({TRIP}) t"""


@query("agg_6_confidence_summary", _SUMMARY)
def agg_6(spark, d):
    s = report.confidence_summary(triples(spark, d))
    return s.select("triples", "relations", *[_r(c) for c in ("avg_confidence", "max_confidence", "min_confidence")])


_UND = f"""(SELECT least(head, tail) AS node1, greatest(head, tail) AS node2, arg_max(relation, k) AS relation, arg_max(confidence, k) AS confidence
FROM (SELECT *, {{'doc_id': doc_id, 'seq': seq, 'relation': relation, 'confidence': confidence}} AS k FROM ({TRIP}) t) s GROUP BY 1, 2)"""


def collapsed(spark, d):
    return collapse_undirected(triples(spark, d), _order())


@query("agg_7_relation_means", f"SELECT relation, round(avg(confidence), 6) AS avg_confidence FROM {_UND} u GROUP BY ALL")
def agg_7(spark, d):
    return report.relation_means(collapsed(spark, d)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("agg_9_undirected_collapse", f"SELECT node1, node2, relation, round(confidence, 6) AS confidence FROM {_UND} u")
def agg_9(spark, d):
    return collapsed(spark, d).withColumn("confidence", F.round("confidence", 6))


@query(
    "agg_14_document_summary",
    f"""SELECT doc_id, entities_count, relations_count, triples_count, average_confidence FROM (SELECT doc_id, count(DISTINCT relation) AS relations_count, count(*) AS triples_count,
round(avg(confidence), 6) AS average_confidence FROM ({TRIP}) t GROUP BY 1) a JOIN (SELECT doc_id, count(DISTINCT e) AS entities_count FROM (SELECT doc_id, unnest([head, tail]) AS e FROM ({TRIP}) t) x GROUP BY 1) b USING (doc_id)""",
)
def agg_14(spark, d):
    # one exchange by document serves all counts and the join
    rows = triples(spark, d).repartition("doc_id")
    summary = tr.document_summary(rows, tr.triple_ends(rows))
    return summary.withColumn("average_confidence", F.round("average_confidence", 6))


@query("set_3_distinct_relations", f"SELECT DISTINCT relation FROM ({TRIP}) t")
def set_3(spark, d):
    return triples(spark, d).select("relation").distinct()


@query(
    "top_5_first_entities",
    f"SELECT eid, name, greatest((SELECT count(*) FROM customer) - 20, 0) AS more FROM (SELECT c_custkey AS eid, c_name AS name FROM customer ORDER BY c_custkey LIMIT 20) x",
)
def top_5(spark, d):
    entities = table(spark, d, "customer").select(F.col("c_custkey").alias("eid"), F.col("c_name").alias("name"))
    return tr.first_entities(entities, 20, "eid")


def _preview_sql(k):
    return f"""WITH u AS (SELECT DISTINCT least(head, tail) AS a, greatest(head, tail) AS b FROM ({TRIP}) t), n AS (SELECT a AS node, b AS nb FROM u UNION ALL SELECT b, a FROM u WHERE a <> b),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY nb) AS i FROM n)
SELECT node, count(*) AS degree, string_agg(nb, ', ' ORDER BY i) FILTER (WHERE i <= {k}) AS preview, greatest(count(*) - {k}, 0) AS more FROM r GROUP BY node"""


@query("top_6_neighbour_preview", _preview_sql(3))
def top_6(spark, d):
    return neighbour_preview(collapsed(spark, d), 3)


@query(
    "win_1_confidence_trend",
    f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS idx, round(confidence, 6) AS confidence FROM ({TRIP}) t",
)
def win_1(spark, d):
    return report.confidence_trend(triples(spark, d)).withColumn("confidence", F.round("confidence", 6))


_NAMES = f"SELECT DISTINCT e AS name FROM (SELECT unnest([person, company || '公司', city, country, city || '大学', company || '系统', doc_id::VARCHAR, text]) AS e FROM ({q.ZH}) z) x"


def _names(spark, d):
    z = spark_rows(spark, d, ZH_DOCS)
    cols = [F.col("person"), F.concat("company", F.lit("公司")), F.col("city"), F.col("country"), F.concat("city", F.lit("大学")),
            F.concat("company", F.lit("系统")), F.col("doc_id").cast("string"), F.col("text")]
    return z.select(F.explode(F.array(*cols)).alias("name")).distinct()


@query("txt_18_entity_class_basic", f"SELECT name, {q.entity_class_basic('name')} AS type FROM ({_NAMES}) n")
def txt_18(spark, d):
    return _names(spark, d).select("name", entity_class_basic(F.col("name")).alias("type"))


@query(
    "txt_19_entity_class",
    f"SELECT name, CASE WHEN length(name) = 3 THEN 'Event' WHEN length(name) = 4 THEN 'Other' ELSE {q.entity_class('name')} END AS type FROM ({_NAMES}) n",
)
def txt_19(spark, d):
    # a given type wins; one outside the known classes counts as Other
    n = F.col("name")
    given = F.when(F.length(n) == 3, "Event").when(F.length(n) == 4, "Nonsense")
    return _names(spark, d).select("name", entity_class(n, given).alias("type"))


_TIER = "CASE WHEN confidence > 0.8::DOUBLE THEN 'high' WHEN confidence > 0.6::DOUBLE THEN 'medium' ELSE 'low' END"


@query("mth_15_confidence_tier", f"SELECT {_TIER} AS tier, count(*) AS n FROM ({TRIP}) t GROUP BY ALL")
def mth_15(spark, d):
    return triples(spark, d).groupBy(confidence_tier(F.col("confidence")).alias("tier")).agg(F.count("*").alias("n"))


@query(
    "mth_16_quality_band",
    f"SELECT round(s, 6) AS score, round(s - 80, 6) AS delta, CASE WHEN s < 50 THEN '0-50' WHEN s < 80 THEN '50-80' ELSE '80-100' END AS band, s >= 90 AS over_line FROM (SELECT avg(confidence) * 100 AS s FROM ({TRIP}) t) x",
)
def mth_16(spark, d):
    return report.quality_band(triples(spark, d)).select(_r("score"), _r("delta"), "band", "over_line")


def _report_line(name, key, value):
    return lambda df: df.select(F.lit(name).alias("report"), key.cast("string").alias("label"), F.round(value.cast("double"), 6).alias("value"))


@query(
    "pipe_9_report_tables",
    f"""SELECT 'nodes' AS report, {q.entity_class('node')} AS label, sum(degree)::DOUBLE AS value FROM ({_preview_sql(5)}) n GROUP BY ALL
UNION ALL SELECT 'edges', {_TIER}, count(*)::DOUBLE FROM {_UND} u GROUP BY ALL
UNION ALL SELECT 'relation_means', relation, round(avg(confidence), 6) FROM {_UND} u GROUP BY ALL
UNION ALL SELECT 'relation_distribution', relation, count(*)::DOUBLE FROM ({TRIP}) t GROUP BY ALL
UNION ALL SELECT 'histogram', label, coalesce(n, 0)::DOUBLE FROM {_LABELS} LEFT JOIN (SELECT {_BIN} AS bin, count(*) AS n FROM ({TRIP}) t GROUP BY 1) c ON c.bin = l.bin
UNION ALL SELECT 'type_distribution', {q.entity_class('name')}, count(*)::DOUBLE FROM (SELECT head AS name FROM ({TRIP}) t UNION SELECT tail FROM ({TRIP}) t) e GROUP BY ALL
UNION ALL SELECT 'trend', CAST(doc_id AS VARCHAR) || ':' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS VARCHAR), round(confidence::DOUBLE, 6) FROM ({TRIP}) t
UNION ALL SELECT 'summary', 'triples', triples::DOUBLE FROM ({_SUMMARY}) s
UNION ALL SELECT 'quality', CASE WHEN s < 50 THEN '0-50' WHEN s < 80 THEN '50-80' ELSE '80-100' END, round(s, 6)
    FROM (SELECT avg(confidence) * 100 AS s FROM ({TRIP}) t) x""",
)
def pipe_9(spark, d):
    t = report.report_tables(triples(spark, d), order=_order())
    col = F.col
    nodes = t["nodes"].groupBy("type").agg(F.sum("degree").alias("v"))
    edges = t["edges"].groupBy("tier").agg(F.count("*").alias("v"))
    parts = [
        _report_line("nodes", col("type"), col("v"))(nodes),
        _report_line("edges", col("tier"), col("v"))(edges),
        _report_line("relation_means", col("relation"), col("avg_confidence"))(t["relation_means"]),
        _report_line("relation_distribution", col("relation"), col("n"))(t["relation_distribution"]),
        _report_line("histogram", col("label"), col("n"))(t["histogram"]),
        _report_line("type_distribution", col("type"), col("n"))(t["type_distribution"]),
        _report_line("trend", F.concat_ws(":", "doc_id", "idx"), col("confidence"))(t["trend"]),
        _report_line("summary", F.lit("triples"), col("triples"))(t["summary"]),
        _report_line("quality", col("band"), col("score"))(t["quality"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "ext_8_entity_cap",
    f"""WITH e AS (SELECT DISTINCT head AS doc, tail AS name FROM ({TRIP}) t), g AS (SELECT head AS doc, tail AS name, count(*) AS degree FROM ({TRIP}) t GROUP BY 1, 2)
SELECT doc, name FROM (SELECT g.*, row_number() OVER (PARTITION BY doc ORDER BY degree DESC, name) AS i FROM g) x WHERE i <= 50""",
)
def ext_8(spark, d):
    # one graph per supplier, its parts as entities
    rows = triples(spark, d).select(F.col("head").alias("doc"), F.col("tail").alias("name"))
    links = rows.select("doc", F.lit("-").alias("head"), F.col("name").alias("tail"))
    return tr.cap_entities(rows.distinct(), links, 50, ("doc",)).select("doc", "name")


# --- hooks ----------------------------------------------------------------

@query(
    "udf_1_extractor",
    """SELECT doc_id, (len(string_split(t, ' of ')) - 1)::BIGINT AS cues FROM (SELECT doc_id, regexp_replace(text, '[\\s]+', ' ', 'g') AS t FROM conversations_docs) x""".replace(
        "conversations_docs", "(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"
    ),
)
def udf_1(spark, d):
    docs = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    flat = spread(docs).withColumn("text", F.regexp_replace("text", r"\s+", " "))
    # a stand-in for a model: answers with the number of cues
    out = hooks.run_extractor(flat, lambda texts: [("", str(t.count(" of "))) for t in texts])
    return out.select("doc_id", F.col("triple_response").cast("bigint").alias("cues"))


@query(
    "udf_2_knowledge_base",
    "SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'asked ' || o_custkey END AS fact FROM orders",
)
def udf_2(spark, d):
    customers = table(spark, d, "customer").filter("c_custkey % 2 = 0")
    facts = customers.select(F.col("c_custkey").cast("string").alias("subject"), F.lit("parity").alias("relation"), F.lit("even").alias("object"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").cast("string").alias("s"), F.lit("parity").alias("rel"))
    base = hooks.KnowledgeBase(facts, lambda misses: "asked " + misses["subject"])
    return base.query(orders, "s", "rel").select("doc_id", "fact")


@query("udf_4_completer", "SELECT conv_id * 1000 + turn AS doc_id, text || '|' || reverse(text) AS text FROM conversations")
def udf_4(spark, d):
    docs = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return hooks.run_completer(spread(docs), lambda texts: [t if t is None else f"{t}|{t[::-1]}" for t in texts])


# --- streaming ------------------------------------------------------------

_REPAIRED = f"""WITH {q.completed(q.DOCS, R.LATIN)}, done AS (SELECT doc_id, CASE WHEN is_high_quality THEN text ELSE enhanced_data END AS text
  FROM completed WHERE {q.not_blank('text')})"""


def _document_stream(spark, d):
    # a pattern, since a stream takes a plain path for a folder: the table may be a file or a folder of files
    return spark.readStream.schema(schemas.DOCUMENTS).parquet(f"{d}/documents.parque[t]")


@query(
    "str_1_incremental_graph",
    f"{_REPAIRED} SELECT head, relation, tail, round(max(confidence), 6) AS confidence FROM ({q.rule_triples('SELECT * FROM done', R.LATIN)}) t GROUP BY ALL",
)
def str_1(spark, d):
    path = run_dir(spark, "stream")
    docs = _document_stream(spark, d)
    found = incremental.stream_triples(docs, R.LATIN)
    incremental.append_stream(found, f"{path}/graph", f"{path}/progress", availableNow=True).awaitTermination()
    return incremental.current_graph(spark, f"{path}/graph").select("head", "relation", "tail", _r())


@query(
    "str_1_running_relation_counts",
    f"{_REPAIRED} SELECT relation, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM ({q.rule_triples('SELECT * FROM done', R.LATIN)}) t GROUP BY ALL",
)
def str_1_counts(spark, d):
    path = run_dir(spark, "counts")
    docs = _document_stream(spark, d)
    counts = incremental.stream_relation_counts(incremental.stream_triples(docs, R.LATIN))

    def publish(table, _):
        table.write.mode("overwrite").parquet(f"{path}/table")

    writer = counts.writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", f"{path}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/table").withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(
    "str_1_statistics_follow",
    f"""{_REPAIRED}, merged AS (SELECT head, relation, tail, max(confidence) AS confidence FROM ({q.rule_triples('SELECT * FROM done', R.LATIN)}) t GROUP BY ALL)
SELECT (SELECT count(DISTINCT e) FROM (SELECT unnest([head, tail]) AS e FROM merged) x) AS total_entities, count(DISTINCT relation) AS total_relations,
count(*) AS total_triples, round(avg(confidence), 6) AS average_confidence FROM merged""",
)
def str_1_statistics(spark, d):
    path = run_dir(spark, "follow")
    docs = _document_stream(spark, d)
    found = incremental.stream_triples(docs, R.LATIN)
    # the second run brings every document once more
    for first in (0, 1_000_000):
        incremental.merge_stream(found, f"{path}/graph", f"{path}/progress-{first}", 16, first, availableNow=True).awaitTermination()
    return GraphTable(spark, f"{path}/graph").statistics().withColumn("average_confidence", F.round("average_confidence", 6))
