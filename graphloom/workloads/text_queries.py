"""Registered queries: document text, quality, facts and completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import rules as R, schemas
from graphloom.functions import text as tx
from graphloom.hooks import KnowledgeBase
from graphloom.operators import completion, facts as fc
from graphloom.operators.quality import assess_quality, drop_blank
from graphloom.plans.documents_to_graph import document_reports, documents_to_graph, refine
from graphloom.sources.documents import read_documents, split_rejects
from graphloom.sources.facts import conflict_rules, default_facts
from graphloom.workloads import sql_text as q
from graphloom.workloads.registry import query
from graphloom.workloads.substrates import ZH_DOCS, spark_rows

JOIN = "|"


def zh(spark, d):
    return spark_rows(spark, d, ZH_DOCS)


def documents(spark, d):
    return read_documents(spark, f"{d}/documents.parquet")


def _joined(col):
    return F.concat_ws(JOIN, col)


@query("src_1_documents", f"SELECT doc_id, length(text) AS n FROM ({q.DOCS}) d")
def src_1(spark, d):
    return documents(spark, d).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("flt_1_drop_blank", f"SELECT doc_id FROM ({q.ZH}) z WHERE {q.not_blank('text')}")
def flt_1(spark, d):
    return drop_blank(zh(spark, d)).select("doc_id")


@query(
    "flt_2_quality_gate",
    f"WITH {q.assessed(q.DOCS, R.LATIN)} SELECT is_high_quality AS passed, count(*) AS n FROM assessed GROUP BY ALL",
)
def flt_2(spark, d):
    assessed = assess_quality(documents(spark, d), R.LATIN)
    return assessed.groupBy(F.col("is_high_quality").alias("passed")).agg(F.count("*").alias("n"))


@query("txt_1_stripped_length", f"SELECT doc_id, length({q.strip('text')}) AS n FROM ({q.ZH}) z")
def txt_1(spark, d):
    return zh(spark, d).select("doc_id", tx.stripped_length(F.col("text")).cast("bigint").alias("n"))


def _mention_query(key, pattern):
    @query(key, f"SELECT doc_id, {q.joined(f'regexp_extract_all(text, {q.lit(pattern)})')} AS found FROM ({q.ZH}) z")
    def run(spark, d):
        return zh(spark, d).select("doc_id", _joined(tx.mentions_of(F.col("text"), pattern)).alias("found"))


_mention_query("txt_2_person_mentions", R.PERSON_PATTERN)
_mention_query("txt_3_place_mentions", R.PLACE_PATTERN)
_mention_query("txt_4a_organisation_mentions", R.ORG_PATTERN)
_mention_query("txt_4b_organisation_mentions_completion", R.ORG_PATTERN_COMPLETION)


@query("txt_5_mentions", f"SELECT doc_id, {q.joined(q.mentions('text', R.ZH.mention_patterns))} AS found FROM ({q.ZH}) z")
def txt_5(spark, d):
    return zh(spark, d).select("doc_id", _joined(tx.mentions(F.col("text"), R.ZH.mention_patterns)).alias("found"))


@query("txt_6_relation_cues", f"SELECT doc_id, {q.joined(q.cues('text', R.ZH))} AS cues FROM ({q.ZH}) z")
def txt_6(spark, d):
    return zh(spark, d).select("doc_id", _joined(tx.present_cues(F.col("text"))).alias("cues"))


@query("txt_7_conflicts", f"SELECT doc_id, {q.joined(q.conflicts('text', R.ZH))} AS conflicts FROM ({q.ZH}) z")
def txt_7(spark, d):
    return zh(spark, d).select("doc_id", _joined(tx.conflict_messages(F.col("text"))).alias("conflicts"))


@query("txt_8_missing_mark", f"SELECT doc_id, NOT regexp_matches(text, '{R.LATIN.sentence_marks}') AS missing FROM ({q.DOCS}) z")
def txt_8(spark, d):
    return documents(spark, d).select("doc_id", tx.lacks_mark(F.col("text"), R.LATIN).alias("missing"))


@query("txt_9_letter_case", f"SELECT doc_id, {q.upper('text')} AS all_upper, {q.lower('text')} AS all_lower FROM ({q.DOCS}) z")
def txt_9(spark, d):
    t = F.col("text")
    return documents(spark, d).select("doc_id", tx.all_upper(t).alias("all_upper"), tx.all_lower(t).alias("all_lower"))


@query("txt_10_noise", f"SELECT doc_id, regexp_matches(text, {q.lit(R.NOISE_PATTERN)}) AS noise FROM ({q.DOCS}) z")
def txt_10(spark, d):
    return documents(spark, d).select("doc_id", tx.is_noise(F.col("text")).alias("noise"))


def _quality_query(key, columns, spark_cols, source="zh"):
    src, pack = (q.ZH, R.ZH) if source == "zh" else (q.DOCS, R.LATIN)

    @query(key, f"WITH {q.assessed(src, pack)} SELECT doc_id, {columns} FROM assessed")
    def run(spark, d):
        docs = zh(spark, d) if source == "zh" else documents(spark, d)
        return assess_quality(docs, pack).select("doc_id", *spark_cols())


def _r(name, digits=6):
    return F.round(name, digits).alias(name)


_quality_query("txt_11_issues", f"{q.joined('issues')} AS issues", lambda: [_joined("issues").alias("issues")])
_quality_query("txt_12_recommendation", "recommendation", lambda: ["recommendation"])
_quality_query("mth_1_completeness", "round(completeness, 6) AS completeness", lambda: [_r("completeness")])
_quality_query("mth_2_consistency", "round(consistency, 6) AS consistency", lambda: [_r("consistency")])
_quality_query("mth_3_relevance", "round(relevance, 6) AS relevance", lambda: [_r("relevance")], "documents")
_quality_query("mth_4_quality", "quality_score", lambda: ["quality_score"], "documents")
_quality_query(
    "pipe_1_assess_quality",
    f"quality_score, is_high_quality, round(completeness, 6) AS completeness, round(consistency, 6) AS consistency, "
    f"round(relevance, 6) AS relevance, {q.joined('issues')} AS issues, recommendation",
    lambda: ["quality_score", "is_high_quality", _r("completeness"), _r("consistency"), _r("relevance"), _joined("issues").alias("issues"),
     "recommendation"],
)


# --- facts ----------------------------------------------------------------

_FACTS_SQL = "(VALUES " + ", ".join(f"('{s}', '{r}', '{o}')" for s, r, o in R.FACTS) + ") f(subject, relation, object)"
_RULES_SQL = "(VALUES " + ", ".join(
    f"({r.rule_id}, '{r.subject}', '{r.wrong_object}', '{r.predicate}', '{r.conflict_type}', '{r.message}')" for r in R.CONFLICT_RULES
) + ") r(rule_id, subject, wrong_object, predicate, conflict_type, message)"


@query(
    "src_5_facts",
    f"SELECT f.subject, f.relation, f.object, count(*) AS used_by FROM {_FACTS_SQL} JOIN ({q.ZH}) z ON z.city = f.subject GROUP BY ALL",
)
def src_5(spark, d):
    facts = default_facts(spark)
    uses = zh(spark, d).groupBy(F.col("city").alias("subject")).agg(F.count("*").alias("used_by"))
    return facts.join(uses, "subject").select("subject", "relation", "object", "used_by")


@query(
    "jn_1_query_fact",
    f"SELECT doc_id, rel, object AS fact FROM (SELECT doc_id, city, CASE doc_id % 3 WHEN 0 THEN 'country' WHEN 1 THEN 'continent' ELSE 'mayor' END AS rel "
    f"FROM ({q.ZH}) z) LEFT JOIN {_FACTS_SQL} ON city = subject AND rel = relation",
)
def jn_1(spark, d):
    k = F.col("doc_id") % 3
    asked = zh(spark, d).select("doc_id", "city", F.when(k == 0, "country").when(k == 1, "continent").otherwise("mayor").alias("rel"))
    return fc.query_fact(asked, default_facts(spark), "city", "rel").select("doc_id", "rel", "fact")


_CLAIMS = f"SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN company ELSE city END AS s, CASE WHEN doc_id % 5 = 0 THEN '喜欢' ELSE '位于' END AS p, country AS o FROM ({q.ZH}) z"


def _claims(spark, d):
    return zh(spark, d).select(
        "doc_id",
        F.when(F.col("doc_id") % 4 == 3, F.col("company")).otherwise(F.col("city")).alias("s"),
        F.when(F.col("doc_id") % 5 == 0, "喜欢").otherwise("位于").alias("p"),
        F.col("country").alias("o"),
    )


@query(
    "jn_2_verify_fact",
    f"SELECT doc_id, CASE WHEN t THEN o = object ELSE true END AS is_correct, CASE WHEN t THEN 0.95 ELSE 0.1 END::DOUBLE AS confidence, "
    f"CASE WHEN t THEN object END AS correct_value, CASE WHEN t AND o <> object THEN s || '属于' || object || '，不是' || o ELSE '' END AS correction_message "
    f"FROM (SELECT c.*, f.object, f.object IS NOT NULL AND p = '位于' AS t FROM ({_CLAIMS}) c LEFT JOIN {_FACTS_SQL} ON s = subject AND relation = 'country')",
)
def jn_2(spark, d):
    return fc.verify_fact(_claims(spark, d), default_facts(spark), "s", "p", "o").select("doc_id", "check.*")


@query(
    "jn_3_fact_chain",
    f"SELECT doc_id, coalesce(a.object, b.object) AS fact, CASE WHEN b.object IS NOT NULL AND a.object IS NULL AND p = '位于' THEN o = b.object "
    f"WHEN a.object IS NOT NULL AND p = '位于' THEN o = a.object ELSE true END AS is_correct "
    f"FROM ({_CLAIMS}) c LEFT JOIN (SELECT * FROM {_FACTS_SQL} WHERE subject IN ('巴黎', '东京')) a ON s = a.subject AND a.relation = 'country' "
    f"LEFT JOIN (SELECT * FROM {_FACTS_SQL}) b ON s = b.subject AND b.relation = 'country'",
)
def jn_3(spark, d):
    both = default_facts(spark)
    first = both.filter(F.col("subject").isin("巴黎", "东京"))
    asked = _claims(spark, d).withColumn("rel", F.lit("country"))
    found = fc.query_fact_chain(asked, [first, both], "s", "rel")
    return fc.verify_fact_chain(found, first, both, "s", "p", "o").select("doc_id", "fact", "check.is_correct")


@query(
    "jn_4_conflict_resolution",
    f"SELECT doc_id, rule_id, object AS right_object FROM ({q.ZH}) z JOIN {_RULES_SQL} ON contains(text, r.subject) AND contains(text, wrong_object) "
    f"JOIN {_FACTS_SQL} ON f.subject = r.subject AND relation = 'country' AND object <> wrong_object",
)
def jn_4(spark, d):
    verified = completion.verified_rules(conflict_rules(spark), default_facts(spark))
    return completion.match_rules(zh(spark, d), verified).select("doc_id", "rule_id", "right_object")


@query(
    "txt_25_conflict_issue_parts",
    f"SELECT doc_id, conflict_type, subject, predicate, wrong_object FROM ({q.ZH}) z JOIN {_RULES_SQL} ON contains(text, subject) AND contains(text, wrong_object)",
)
def txt_25(spark, d):
    hits = zh(spark, d).select("doc_id", F.explode(tx.conflict_ids(F.col("text"))).alias("rule_id"))
    return hits.join(F.broadcast(conflict_rules(spark)), "rule_id").select(
        "doc_id", "conflict_type", "subject", "predicate", "wrong_object"
    )


# --- completion -----------------------------------------------------------

@query("txt_13_format", f"SELECT doc_id, {q.normalised('text')} AS shaped, {q.needs_period('text')} AS period_added FROM ({q.ZH}) z")
def txt_13(spark, d):
    t = F.col("text")
    return zh(spark, d).select("doc_id", tx.normalise_format(t).alias("shaped"), tx.needs_period(t).alias("period_added"))


@query("txt_14_correction", f"SELECT doc_id, {q.corrected('text', '柏林', '日本')} AS fixed FROM ({q.ZH}) z")
def txt_14(spark, d):
    fixed = tx.apply_correction(F.col("text"), F.lit("柏林"), F.lit("日本"), F.lit("德国"))
    return zh(spark, d).select("doc_id", fixed.alias("fixed"))


@query(
    "txt_15_implicit_notes",
    f"SELECT doc_id, {q.joined(q.present([(q.has('text', w), n) for w, n in R.IMPLICIT_NOTES]))} AS notes FROM ({q.ZH}) z",
)
def txt_15(spark, d):
    return zh(spark, d).select("doc_id", _joined(tx.implicit_notes(F.col("text"))).alias("notes"))


_COMPLETED = f"doc_id, enhanced_data, {q.joined('completions')} AS completions, {q.joined('corrections')} AS corrections, confidence, changed"


def _completed_columns(df):
    return df.select(
        "doc_id", "enhanced_data", _joined("completions").alias("completions"), _joined("corrections").alias("corrections"), "confidence", "changed"
    )


@query("mth_5_completion_confidence", f"WITH {q.completed(q.ZH)} SELECT doc_id, confidence FROM completed")
def mth_5(spark, d):
    return completion.complete_knowledge(assess_quality(zh(spark, d))).select("doc_id", "confidence")


@query("pipe_2_complete_knowledge", f"WITH {q.completed(q.ZH)} SELECT {_COMPLETED} FROM completed")
def pipe_2(spark, d):
    assessed = assess_quality(zh(spark, d))
    return _completed_columns(completion.complete_knowledge(assessed, rules=conflict_rules(spark), facts=default_facts(spark)))


def _country(misses):
    # a stand-in for a look-up service: the countries of the default facts
    known = {s: o for s, relation, o in R.FACTS if relation == "country"}
    return misses["subject"].map(known.get)


@query("udf_2_completion_base", f"WITH {q.completed(q.ZH)} SELECT {_COMPLETED} FROM completed")
def udf_2_completion(spark, d):
    # no fact is stored: every verdict on a rule comes from the look-up
    base = KnowledgeBase(spark.createDataFrame([], schemas.FACTS), _country)
    return _completed_columns(completion.complete_knowledge(assess_quality(zh(spark, d)), facts=base))


@query(
    "udf_4_completion_model",
    f"WITH {q.completed(q.ZH)} SELECT doc_id, CASE WHEN is_high_quality THEN text ELSE enhanced_data || '|' || reverse(enhanced_data) END AS processed_text FROM completed",
)
def udf_4_completion(spark, d):
    model = lambda texts: [f"{t}|{t[::-1]}" for t in texts]
    return completion.complete_failing(assess_quality(zh(spark, d)), completer=model).select("doc_id", "processed_text")


# --- documents to graph ---------------------------------------------------

_PROCESSED = f"WITH {q.completed(q.ZH)}, done AS (SELECT doc_id, text, is_high_quality, CASE WHEN is_high_quality THEN text ELSE enhanced_data END AS processed FROM completed)"
_RULE_TRIPLES = q.rule_triples("SELECT doc_id, processed AS text FROM done", R.ZH)


@query(
    "pipe_4_documents_to_graph",
    f"{_PROCESSED}, tr AS ({_RULE_TRIPLES}) SELECT doc_id, head, relation, tail, round(max(confidence), 6) AS confidence FROM tr GROUP BY ALL",
)
def pipe_4(spark, d):
    graphs = documents_to_graph(zh(spark, d))
    return graphs.select("doc_id", F.inline("triples")).withColumn("confidence", F.round("confidence", 6))


def _first_and_last(texts):
    # a stand-in for a model: links a text's first two characters to its last two, and refuses some texts
    if any("HELLO" in t for t in texts):
        raise ValueError("refused")
    return [(f"{t[:2]}|Person\n{t[-2:]}|Location", f"({t[:2]}, 连到, {t[-2:]})\nnone") for t in texts]


@query(
    "udf_1_extractor_to_graph",
    f"""{_PROCESSED}, asked AS (SELECT doc_id, CASE WHEN NOT {q.not_blank('text')} THEN {q.lit(R.REJECT_BLANK)} WHEN contains(processed, 'HELLO') THEN 'ValueError: refused' END AS reject_reason,
  CASE WHEN contains(processed, 'HELLO') THEN '' ELSE {q.strip('left(processed, 2)')} END AS head, CASE WHEN contains(processed, 'HELLO') THEN '' ELSE {q.strip('right(processed, 2)')} END AS tail FROM done),
found AS (SELECT *, head <> '' AND tail <> '' AS found, head <> tail AS apart FROM asked)
SELECT doc_id, reject_reason, CASE WHEN found THEN head END AS head, CASE WHEN found THEN '连到' END AS relation, CASE WHEN found THEN tail END AS tail,
CASE WHEN found THEN 0.95::DOUBLE + CASE WHEN apart THEN 0.05 ELSE 0 END END AS confidence FROM found""",
)
def udf_1_graph(spark, d):
    graphs = documents_to_graph(zh(spark, d), extractor=_first_and_last)
    return graphs.select("doc_id", "reject_reason", F.inline_outer("triples")).withColumn("confidence", F.round("confidence", 6))


_OUTCOME = f"""{_PROCESSED}, tr AS ({_RULE_TRIPLES}), n AS (SELECT doc_id, count(*) AS k FROM tr GROUP BY 1),
outcome AS (SELECT done.doc_id, CASE WHEN NOT {q.not_blank('text')} THEN {q.lit(R.REJECT_BLANK)} WHEN k IS NULL THEN {q.lit(R.REJECT_NOTHING_FOUND)} END AS reason
  FROM done LEFT JOIN n USING (doc_id))"""


@query(
    "snk_4_rejects",
    f"{_OUTCOME} SELECT doc_id, reason, CASE WHEN reason = {q.lit(R.REJECT_NOTHING_FOUND)} THEN {q.lit(R.REJECT_SUGGESTION)} END AS suggestion FROM outcome WHERE reason IS NOT NULL",
)
def snk_4(spark, d):
    _, rejects = split_rejects(documents_to_graph(zh(spark, d)))
    return rejects.select("doc_id", F.col("reject_reason").alias("reason"), "suggestion")


@query("agg_15_outcome_tally", f"{_OUTCOME} SELECT reason IS NULL AS success, count(*) AS n FROM outcome GROUP BY ALL")
def agg_15(spark, d):
    from graphloom.operators.triples import outcome_tally

    return outcome_tally(document_reports(documents_to_graph(zh(spark, d))))


@query(
    "snk_2_document_reports",
    f"""{_OUTCOME}, names AS (SELECT doc_id, count(DISTINCT e) AS entities FROM (SELECT doc_id, unnest([head, tail]) AS e FROM tr) x GROUP BY 1),
facts AS (SELECT doc_id, count(*) AS triples, count(DISTINCT relation) AS relations, round(avg(confidence), 6) AS confidence FROM tr GROUP BY 1)
SELECT doc_id, reason IS NULL AS success, CASE WHEN reason IS NULL THEN entities END AS entities, CASE WHEN reason IS NULL THEN relations END AS relations,
  CASE WHEN reason IS NULL THEN triples END AS triples, CASE WHEN reason IS NULL THEN confidence END AS confidence, reason AS error
FROM outcome LEFT JOIN names USING (doc_id) LEFT JOIN facts USING (doc_id)""",
)
def snk_2(spark, d):
    reports = document_reports(documents_to_graph(zh(spark, d)))
    graph = "$.stages.knowledge_graph."
    field = lambda n: F.get_json_object("report", graph + n)
    return reports.select(
        "doc_id",
        "success",
        field("entities_count").cast("bigint").alias("entities"),
        field("relations_count").cast("bigint").alias("relations"),
        field("triples_count").cast("bigint").alias("triples"),
        F.round(field("average_confidence").cast("double"), 6).alias("confidence"),
        F.get_json_object("report", "$.error").alias("error"),
    )


@query("ext_5_rule_triples", f"SELECT doc_id, head, relation, tail, count(*) AS n FROM ({q.rule_triples(q.DOCS, R.LATIN)}) t GROUP BY ALL")
def ext_5(spark, d):
    from graphloom.operators.triples import rule_triples

    found = rule_triples(documents(spark, d), R.LATIN)
    return found.groupBy("doc_id", "head", "relation", "tail").agg(F.count("*").alias("n"))


def _pass(n: int) -> str:
    """Round ``n`` of repair over the round before."""
    before = q.ZH if n == 1 else f"SELECT doc_id, text, used FROM pass{n - 1}"
    keep = "" if n == 1 else "used"
    used = "0" if n == 1 else "used"
    return f"""pass{n} AS MATERIALIZED (WITH {q.completed(before, extra=keep)} SELECT doc_id, CASE WHEN is_high_quality THEN text ELSE enhanced_data END AS text,
  {used} + CASE WHEN is_high_quality THEN 0 ELSE 1 END AS used FROM completed)"""




@query(
    "ext_6_refine",
    f"WITH {_pass(1)}, {_pass(2)}, {_pass(3)}, again AS (WITH {q.assessed('SELECT * FROM pass3', R.ZH, 'used')} SELECT doc_id, used::BIGINT AS rounds_used, text, quality_score, is_high_quality AS passed FROM assessed) SELECT * FROM again",
)
def ext_6(spark, d):
    out = refine(zh(spark, d).select("doc_id", "text"))
    return out.select("doc_id", F.col("rounds_used").cast("bigint").alias("rounds_used"), "text", "quality_score", "passed")
