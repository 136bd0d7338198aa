"""Documents: worked examples with known scores and repairs."""

import itertools

import pytest
from pyspark.sql import functions as F

from graphloom import rules as R
from graphloom.functions import text as tx
from graphloom.operators import completion
from graphloom.operators import facts as fc
from graphloom.operators.quality import assess_quality, drop_blank, quality_gate
from graphloom.plans.documents_to_graph import document_reports, documents_to_graph, processed_documents, write_reports
from graphloom.sources.documents import read_documents, split_rejects
from graphloom.sources.facts import conflict_rules, default_facts

TEXTS = {
    1: ("张三担任阿里巴巴公司的CEO", 1.0, 0.8, 0.8, 0.88),
    2: ("北京大学是中国著名的高等教育机构，位于北京市海淀区", 1.0, 0.9, 0.8, 0.92),
    3: ("苹果公司的CEO是蒂姆·库克", 0.7, 0.8, 0.8, 0.76),
    4: ("北京大学是中国著名的高等教育机构，位于北京市海淀区。", 1.0, 1.0, 0.8, 0.96),
    5: ("李华去巴黎", 0.4, 0.9, 0.8, 0.68),
    6: ("巴黎市是德国城市。", 0.7, 0.8, 0.8, 0.76),
    7: ("张三是阿里巴巴公司的CEO，阿里巴巴总部位于杭州。", 1.0, 0.9, 0.8, 0.92),
    8: ("李四在北京大学学习计算机科学，北京大学位于北京市海淀区。", 1.0, 1.0, 0.8, 0.96),
    9: ("王五担任腾讯公司的产品经理，腾讯公司在深圳有分公司。", 1.0, 1.0, 0.8, 0.96),
    10: ("张三是阿里巴巴的CEO", 0.7, 0.8, 0.8, 0.76),
    11: ("巴黎 德国", 0.0, 0.7, 0.8, 0.44),
    12: ("巴黎 德国 北京 日本", 0.3, 0.5, 0.8, 0.48),
    13: ("HELLO WORLD", 0.3, 0.8, 0.8, 0.60),
    14: ("hello world.", 0.3, 0.9, 0.8, 0.64),
    15: ("哈哈哈哈", 0.0, 0.9, 0.5, 0.46),
    16: ("　 \t", None, None, None, None),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t[0]) for i, t in TEXTS.items()], "doc_id bigint, text string")


def test_scores_and_gate(docs):
    rows = {r.doc_id: r for r in assess_quality(drop_blank(docs)).collect()}
    assert 16 not in rows
    for i, (_, complete, consistent, relevant, quality) in TEXTS.items():
        if quality is None:
            continue
        r = rows[i]
        got = (r.completeness, round(r.consistency, 6), r.relevance, r.quality_score)
        assert got == (complete, consistent, relevant, quality), i
        assert r.is_high_quality == (i not in (11, 12, 15))
    good, bad = quality_gate(assess_quality(drop_blank(docs)))
    assert good.count() == 12 and {r.doc_id for r in bad.collect()} == {11, 12, 15}
    assert rows[11].issues == ["实体信息不足", "缺少关系信息", "地理冲突：巴黎不在德国", "缺少标点符号"]
    assert rows[15].issues == ["数据过短", "实体信息不足", "缺少关系信息", "缺少标点符号"]
    assert rows[7].issues == ["全大写格式"]
    assert rows[11].recommendation.endswith("建议修正语义冲突")
    assert rows[1].recommendation == R.ADVICE_GOOD


def test_mentions(docs):
    found = {r.doc_id: r.m for r in docs.select("doc_id", tx.mentions(F.col("text"), R.ZH.mention_patterns).alias("m")).collect()}
    assert found[5] == ["李华去巴"]
    assert found[6] == ["巴黎市是德国城市", "黎市是德"]
    assert found[1] == ["张三担任", "张三担任阿里巴巴公司"]


CASES = [
    ("巴黎是德国城市。", ["地理冲突"], "巴黎是法国城市。", ["修正地理错误：巴黎属于法国，不是德国"], [], 0.9),
    ("德国巴黎", ["地理冲突"], "法国巴黎", ["修正地理错误：巴黎属于法国，不是德国"], [], 0.9),
    ("北京在日本", ["地理冲突"], "北京在中国", ["修正地理错误：北京属于中国，不是日本"], [], 0.9),
    ("巴黎市是德国城市。", ["地理冲突"], "巴黎市是德国城市。", ["修正地理错误：巴黎属于法国，不是德国"], [], 0.9),
    ("巴黎 德国 北京 日本", ["地理冲突"], "巴黎 德国 北京 日本",
     ["修正地理错误：巴黎属于法国，不是德国", "修正地理错误：北京属于中国，不是日本"], [], 1.0),
    ("HELLO  WORLD", ["全大写格式"], "HELLO WORLD。", ["添加句号"], [], 0.9),
    ("某大学的CEO", [], "某大学的CEO", [], ["隐性知识：CEO通常负责公司战略决策", "隐性知识：大学是教育机构"], 0.7),
]


@pytest.mark.parametrize("mode", ["pack", "table"])
def test_completion(spark, mode):
    rows = [(i, c[0], c[1]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, issues array<string>")
    extra = {} if mode == "pack" else {"rules": conflict_rules(spark), "facts": default_facts(spark)}
    out = {r.doc_id: r for r in completion.complete_knowledge(df, **extra).collect()}
    for i, (text, _, fixed, corrections, completions, confidence) in enumerate(CASES):
        r = out[i]
        assert (r.enhanced_data, r.corrections, r.completions, r.confidence) == (fixed, corrections, completions, confidence)
        assert r.changed == (fixed != text)


def test_facts(spark):
    claims = spark.createDataFrame(
        [("巴黎", "位于", "法国"), ("巴黎", "位于", "德国"), ("上海", "位于", "法国")], "s string, p string, o string"
    )
    got = {(r.s, r.o): tuple(r.check)[:3] for r in fc.verify_fact(claims, default_facts(spark), "s", "p", "o").collect()}
    assert got == {("巴黎", "法国"): (True, 0.95, "法国"), ("巴黎", "德国"): (False, 0.95, "法国"), ("上海", "法国"): (True, 0.1, None)}


def test_graph_and_reports(docs):
    graphs = documents_to_graph(docs)
    accepted, rejects = split_rejects(graphs)
    reasons = {r.doc_id: (r.reject_reason, r.suggestion) for r in rejects.collect()}
    assert reasons[16] == (R.REJECT_BLANK, None)
    assert reasons[15] == (R.REJECT_NOTHING_FOUND, R.REJECT_SUGGESTION)
    first = [r for r in accepted.collect() if r.doc_id == 7][0]
    assert [tuple(t)[:3] for t in first.triples] == [("张三", "是", "阿里巴巴公司的CEO"), ("阿里巴巴", "总部", "位于杭州")]
    assert document_reports(graphs).filter("success").count() == accepted.count()


def test_documents_to_graph_has_no_shuffle(docs):
    plan = documents_to_graph(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_failing_text_is_repaired(docs):
    out = {r.doc_id: r for r in processed_documents(drop_blank(docs)).collect()}
    assert out[11].processed_text == "巴黎 德国" and out[11].corrections == ["修正地理错误：巴黎属于法国，不是德国"]
    assert out[1].processed_text == TEXTS[1][0] and out[1].corrections is None


def test_sources_and_report_sink(spark, docs, tmp_path):
    kept = docs.filter("doc_id < 15")
    kept.write.json(f"{tmp_path}/j")
    kept.write.option("header", True).csv(f"{tmp_path}/c")
    kept.write.orc(f"{tmp_path}/o")
    kept.select("text").write.text(f"{tmp_path}/t")
    want = sorted(tuple(r) for r in kept.collect())
    for fmt, place in (("json", "j"), ("csv", "c"), ("orc", "o")):
        assert sorted(tuple(r) for r in read_documents(spark, f"{tmp_path}/{place}", fmt).collect()) == want
    assert sorted(r.text for r in read_documents(spark, f"{tmp_path}/t", "text").collect()) == sorted(t for _, t in want)
    named = {r.text: r.doc_id for r in read_documents(spark, f"{tmp_path}/j", "json", key_type="string").collect()}
    assert named == {t: str(i) for i, t in want}
    write_reports(document_reports(documents_to_graph(docs)), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 16


def test_strip_matches_python(spark):
    texts = ["a b", " \t a　", "\x1ca\x1f", " a ", "", "　"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", tx.strip(F.col("t")).alias("s"), tx.not_blank(F.col("t")).alias("n")).collect()
    assert all(r.s == r.t.strip() and r.n == bool(r.t.strip()) for r in got)


def test_places_do_not_depend_on_splits(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(500)))
    (tmp_path / "empty.txt").write_text("")
    default = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for size in (default, "700b", "64b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = read_documents(spark, str(tmp_path), "text").collect()
            found.append(sorted((r.doc_id.rsplit("/", 1)[1], r.text) for r in rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", default)
    assert found[0] == found[1] == found[2]
    assert found[0] == sorted((f"{n}.txt#{i}", f"{n}{i}") for n in "ab" for i in range(500))


def test_completion_takes_facts_and_a_model(spark):
    rows = [(i, c[0], c[1]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, issues array<string>")
    # other facts, other corrections
    moved = spark.createDataFrame([("巴黎", "country", "意大利")], "subject string, relation string, object string")
    plain = {r.doc_id: r for r in completion.complete_knowledge(df).collect()}
    other = {r.doc_id: r for r in completion.complete_knowledge(df, facts=moved).collect()}
    assert any("意大利" in c for r in other.values() for c in r.corrections)
    assert not any("法国" in c for r in other.values() for c in r.corrections)

    def model(texts):
        if any(t is None or "巴黎" in t for t in texts):
            raise ValueError
        return [t + "！" for t in texts]

    asked = df.withColumn("ask", F.when(F.col("doc_id") == 0, None).otherwise(F.col("doc_id") > 1))
    done = {r.doc_id: r for r in completion.complete_knowledge(asked, completer=model, only="ask").collect()}
    for i, r in plain.items():
        gets = i > 1 and "巴黎" not in r.enhanced_data
        assert done[i].enhanced_data == r.enhanced_data + ("！" if gets else "")
        assert (done[i].corrections, done[i].completions) == (r.corrections, r.completions)


def test_match_rules_broadcasts_no_documents(spark):
    # a small file of keys that many rows are made of: its expected size is far below the rules'
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('巴黎在德国', id) AS text")
    verified = completion.verified_rules(conflict_rules(spark), default_facts(spark))
    got = completion.match_rules(docs, verified)
    lines = got._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = itertools.takewhile(lambda x: depth(x) > depth(line), lines[at + 1 :])
            assert not any("Range" in x for x in below)
    assert {(r.doc_id, r.right_object) for r in got.collect()} == {(i, "法国") for i in range(3000)}
