import json
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphloom import hooks
from graphloom.operators import triples as tr
from graphloom.operators.graph import collapse_undirected, undirected_degrees
from graphloom.plans import report
from graphloom.sources import graph_json
from graphloom.sources.graph_table import GraphTable, buckets_for
from graphloom.streaming import incremental
from graphloom.session import run_dir, work_dir

ENTITIES = "张三|Person\nnoise\n 阿里巴巴 | Organization \n|Other\n张三|Other"
TRIPLES = "1. (张三, 工作于, 阿里巴巴)\n（李四，在，北京）\n(a,b)\n(x, ,y)\n(p,q,r,s)"


def test_entity_lines(spark):
    df = spark.createDataFrame([(1, "entities", ENTITIES)], "doc_id bigint, kind string, response string")
    got = sorted((r.seq, r.name, r.type) for r in tr.read_entities(df).collect())
    assert got == [(0, "张三", "Other"), (2, "阿里巴巴", "Organization")]


@pytest.mark.parametrize("mode,extra", [("strict", []), ("lenient", [("x", "", "y")])])
def test_triple_lines(spark, mode, extra):
    df = spark.createDataFrame([(1, TRIPLES)], "doc_id bigint, response string")
    got = [(r.head, r.relation, r.tail) for r in tr.read_triples(df, mode).collect()]
    assert sorted(got) == sorted([("张三", "工作于", "阿里巴巴"), ("p", "q", "r,s"), *extra])


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        tr.read_triples(spark.createDataFrame([(1, "")], "doc_id bigint, response string"), "other")


def test_confidence_backfill_and_merge(spark):
    docs = spark.createDataFrame(
        [(1, "张三是阿里巴巴的CEO", "张三|Person\n阿里巴巴|Organization",
          "(张三,任职,阿里巴巴)\n(张三,担任,CEO)\n(张三,认识,李四)\n(王五,认识,李四)\n(张三,任职,阿里巴巴)")],
        "doc_id bigint, text string, entity_response string, triple_response string",
    )
    g = tr.build_graph(docs).first()
    assert [(t.head, t.tail, round(t.confidence, 6)) for t in g.triples] == [
        ("张三", "阿里巴巴", 1.0), ("张三", "CEO", 0.95), ("张三", "李四", 0.9), ("王五", "李四", 0.85)]
    assert [(e.name, e.type) for e in g.entities] == [
        ("张三", "Person"), ("阿里巴巴", "Organization"), ("CEO", "Other"), ("李四", "Other"), ("王五", "Other")]
    exported = json.loads(graph_json.export_graph(tr.build_graph(docs)).first().graph)
    assert exported["entities"][0] == {"id": "张三", "type": "Person"} and len(exported["triples"]) == 4
    with pytest.raises(ValueError):
        graph_json.export_graph(tr.build_graph(docs), "xml")


def test_merge_keeps_first_place_and_best_confidence(spark):
    df = spark.createDataFrame([(1, 0, "a", "r", "b", 0.5), (1, 1, "c", "r", "d", 0.9), (1, 2, "a", "r", "b", 0.8)],
                               "doc_id bigint, seq bigint, head string, relation string, tail string, confidence double")
    got = sorted((r.seq, r.head, r.confidence) for r in tr.merge_triples(df).collect())
    assert got == [(0, "a", 0.8), (1, "c", 0.9)]


def test_histogram(spark):
    df = spark.createDataFrame([(c,) for c in (0.2, 0.4, 0.41, 0.8, 0.81, 1.0)], "confidence double")
    assert [r.n for r in report.confidence_histogram(df).orderBy("bin").collect()] == [1, 1, 1, 1, 2]


def test_sample_graph(spark):
    one = spark.createDataFrame([(1, 0, "李华", "实习于", "公司A", 1.0)],
                                "doc_id bigint, seq bigint, head string, relation string, tail string, confidence double")
    collapsed = collapse_undirected(one)
    assert {r.node: r.degree for r in undirected_degrees(collapsed).collect()} == {"李华": 1, "公司A": 1}
    assert {r.node: r.type for r in report.node_table(collapsed, basic=True).collect()} == {"李华": "Person", "公司A": "Other"}
    assert {r.node: r.type for r in report.node_table(collapsed).collect()}["公司A"] == "Organization"


def test_round_trip(spark):
    rows = [(i, f"h{i}", f"r{i % 3}", f"t{i % 7}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, head string, relation string, tail string")
    shown = df.select("doc_id", tr.triple_text().alias("response"))
    got = sorted((r.doc_id, r.head, r.relation, r.tail) for r in tr.read_triples(shown).collect())
    assert got == sorted(rows)


def test_graph_json_defaults_and_last_entity(spark, tmp_path):
    (tmp_path / "g.json").write_text(
        json.dumps({"entities": [{"name": "a", "type": "x"}, {"name": "b"}, {"name": "a", "type": "y"}],
                    "relations": [{"name": "r", "source": "a", "target": "b"}]}))
    graphs = graph_json.read_graph_json(spark, str(tmp_path))
    got = sorted((r.eid, r.name, r.type, r.attributes) for r in graph_json.graph_entities(graphs).collect())
    assert got == [(0, "a", "y", {}), (1, "b", "unknown", {})]
    assert graph_json.graph_edges(graphs).first().type == "unknown"


def test_extractor_failure_costs_one_row(spark):
    def fragile(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [(f"{t}|Other", "") for t in texts]

    docs = spark.createDataFrame([(i, "bad" if i == 3 else f"t{i}") for i in range(8)], "doc_id bigint, text string").coalesce(1)
    rows = {r.doc_id: r for r in hooks.run_extractor(docs, fragile, batch=4).collect()}
    assert rows[3].error.startswith("RuntimeError") and rows[3].entity_response == ""
    assert all(rows[i].error is None and rows[i].entity_response == f"t{i}|Other" for i in rows if i != 3)


def test_stream_equals_batch_and_repeats_change_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"张三在北京大学{'甲乙丙'[i % 3]}。") for i in range(9)], "doc_id bigint, text string")
    source = str(tmp_path / "in")
    docs.repartition(3).write.parquet(source)
    out = run_dir(spark, "test")

    def run(name):
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source)
        incremental.append_stream(incremental.stream_triples(stream), f"{out}/graph", f"{out}/{name}", availableNow=True).awaitTermination()
        return sorted(tuple(r) for r in incremental.current_graph(spark, f"{out}/graph").select("head", "relation", "tail", "confidence").collect())

    batch = sorted(tuple(r) for r in tr.merge_triples(tr.rule_triples(docs), ()).select("head", "relation", "tail", "confidence").collect())
    assert run("one") == batch
    assert run("two") == batch
    incremental.compact(spark, f"{out}/graph", f"{out}/packed")
    assert incremental.current_graph(spark, f"{out}/packed").count() == len(batch)


class _Session:
    """Stands in for a session on a cluster; records the checkpoint folder that is set."""

    def __init__(self, configured):
        self.conf, self.sparkContext, self.master, self.given = self, self, "yarn", None
        self._configured = configured

    def get(self, key, default):
        return self._configured if key == "spark.checkpoint.dir" and self._configured else default

    def getCheckpointDir(self):
        return self.given

    def setCheckpointDir(self, path):
        self.given = path


def test_work_folder_comes_from_the_session():
    cluster = _Session("hdfs://shared/work")
    assert work_dir(cluster) == cluster.given == "hdfs://shared/work"
    with pytest.raises(ValueError):
        work_dir(_Session(None))


def test_statistics_of_an_empty_graph(spark):
    empty = spark.createDataFrame([], "doc_id bigint, seq bigint, head string, relation string, tail string, confidence double")
    s = tr.graph_statistics(empty, empty.select(F.col("head").alias("name"))).first()
    assert (s.total_entities, s.total_triples, s.average_confidence) == (0, 0, 0.0)


def test_graph_table_follows_the_merged_graph(spark, tmp_path):
    rng = random.Random(5)
    columns = "head string, relation string, tail string, confidence double, seq bigint"

    def some(n):
        score = lambda: rng.choice([None, 0.25, 0.5, 0.75, 1.0])
        return [(f"h{rng.randrange(20)}", f"r{rng.randrange(3)}", f"t{rng.randrange(20)}", score(), i) for i in range(n)]

    batches = [some(80), some(200), [(None, "r0", "t", 0.5, 0), ("h", None, "t", 0.5, 0)], [], some(150)]
    batches.append(batches[0])
    table = GraphTable(spark, str(tmp_path / "graph"), 4)
    assert table.statistics().first().total_triples == 0 and table.relation_statistics().count() == 0
    seen = []
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, columns)
        table.merge(df, i)
        if i in (1, 5):
            # a batch that ran before
            table.merge(df, i)
        seen += rows
        want = tr.merge_triples(spark.createDataFrame(seen, columns).dropna(subset=["head", "relation", "tail"]), (), "seq")
        again = GraphTable(spark, str(tmp_path / "graph"), 99)
        assert again.buckets == 4
        assert sorted(map(repr, again.graph().select(want.columns).collect())) == sorted(map(repr, want.collect()))
        names = spark.createDataFrame([], "name string")
        assert again.statistics().collect() == tr.graph_statistics(want, names).collect()
        means = want.groupBy("relation").agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))
        assert sorted(again.relation_statistics().collect()) == sorted(means.collect())
    # the last batch brought nothing new
    assert spark.table(table.triples).filter("batch = 5").count() == 0
    small = table.compact(str(tmp_path / "compact"))
    assert small.statistics().collect() == table.statistics().collect()

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(table.graph())
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # the batch is merged and sent to the buckets; the stored side stays where it is
        moved = re.findall(r"Exchange .*?(ENSURE_REQUIREMENTS|REPARTITION_BY_NUM)", plan(table.changes(spark.createDataFrame(batches[0], columns), 9)))
        assert moved == ["REPARTITION_BY_NUM", "ENSURE_REQUIREMENTS"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)


def test_graph_table_outlives_its_catalog(spark, tmp_path):
    path = str(tmp_path / "graph")
    table = GraphTable(spark, path, 3)
    table.merge(spark.createDataFrame([("a", "r", "b", 0.5, 0)], "head string, relation string, tail string, confidence double, seq bigint"), 0)
    for name in (table.triples, table.names):
        spark.sql(f"DROP TABLE {name}")
    assert [tuple(r) for r in GraphTable(spark, path).graph().collect()] == [("a", "r", "b", 0.5, 0)]


def test_stream_statistics_of_repeated_documents(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"张三担任经理。李四位于北京{i % 3}") for i in range(9)], "doc_id bigint, text string")
    source, out = str(tmp_path / "docs"), str(tmp_path / "graph")
    for _ in range(3):
        docs.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source)
    incremental.merge_stream(incremental.stream_triples(stream), out, str(tmp_path / "progress"), 4, availableNow=True).awaitTermination()
    merged = tr.merge_triples(incremental.stream_triples(docs), (), "seq")
    assert merged.count() > 1
    table = GraphTable(spark, out)
    assert table.statistics().collect() == tr.graph_statistics(merged, spark.createDataFrame([], "name string")).collect()
    assert spark.table(table.triples).select("batch").distinct().count() == 1


@pytest.mark.parametrize("name", ["str_1_incremental_graph", "str_1_running_relation_counts", "str_1_statistics_follow"])
def test_streams_read_tables_that_are_folders(spark, tmp_path, name):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    run = entry.queries()[name]
    got, want = (sorted(map(tuple, run(spark, d).collect())) for d in (str(tmp_path), "/root/testdata/sf0.001"))
    assert got == want and any(got[0])


def test_buckets_hold_about_as_many_triples_at_any_size():
    assert buckets_for(0) == buckets_for(1000) == 16
    assert all(n / buckets_for(n) <= 200_000 for n in (3_200_001, 36_000_000, 216_000_000))


def test_statistics_tool_parses_a_text_once(spark):
    # what the counts read are stored graphs, not the orders
    read = entry.queries()["pipe_5_statistics_tool"](spark, "/root/testdata/sf0.001").inputFiles()
    assert read and not any("orders.parquet" in f for f in read)


def test_document_summary_exchanges_by_document_only(spark, tmp_path):
    rows = [(1, 7, 3, 1, "R", "F", 0.05), (1, 7, 3, 2, "A", "F", 0.01), (1, 8, 3, 3, "R", "F", None), (2, 7, 4, 1, "N", "O", 0.1), (None, 7, 4, 1, "N", "O", 0.1)]
    lines = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string, l_linestatus string, l_discount double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    df = entry.queries()["agg_14_document_summary"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^()]*), \d+\)", plan)
    assert keys and all(re.fullmatch(r"doc_id#\d+L?", k) for k in keys)
    got = {r.doc_id: (r.entities_count, r.relations_count, r.triples_count, r.average_confidence) for r in df.filter("doc_id > 0").collect()}
    assert got == {1: (3, 2, 3, 0.3), 2: (2, 1, 1, 1.0)}
