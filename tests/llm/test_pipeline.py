import random

import corpus_pipeline
from graphloom.llm import line_dedup, quality
from llm_data import empty, rows, write
from test_mixing import mixing
from test_packing import check
from test_quality import base
from test_simhash import shingles


def plain_clean(data):
    """Quality by plain Python for texts whose lines all pass the line rules."""
    return [r for r in data if not base(r[1])[5]]


def plain_lines(data, min_docs=10):
    holders = {}
    for doc_id, text, *_ in data:
        for line in text.split("\n"):
            holders.setdefault(line_dedup.line_key(line.encode()), set()).add(doc_id)
    drop = {k for k, ids in holders.items() if k and len(ids - {None}) >= min_docs}
    return [(r[0], "\n".join(x for x in r[1].split("\n") if line_dedup.line_key(x.encode()) not in drop), *r[2:]) for r in data]


def test_stages_by_plain_versions(spark, tmp_path):
    data = rows()
    folder = write(spark, tmp_path, data)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = plain_clean(data)
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and name
        got = sorted(((r.doc_id, r.text, r.lang, r.source) for r in out.collect()), key=repr)
        if at == 1:
            want = plain_lines(want)
        if at == 2:
            assert set(got) <= {r[:4] for r in want}
            kept = [shingles(r[1]) for r in got]
            alike = lambda a, b, least: len(a & b) >= least * len(a | b)
            assert not any(alike(a, b, 0.8) for i, a in enumerate(kept) for b in kept[:i])
            assert all(any(alike(shingles(r[1]), k, 0.7) for k in kept) for r in want)
            want = got
        if at == 3:
            texts = {}
            for r in want:
                texts.setdefault(r[0], []).append(r[1])
            assert all(any(t.startswith(r[1]) for t in texts[r[0]]) for r in got)
            total = sum(base(r[1])[0] for r in want)
            assert sum(base(r[1])[0] for r in got) >= min(total, 2 * total) - 1
        else:
            assert got == sorted((r[:4] for r in want), key=repr)
        docs = spark.createDataFrame(out.collect(), out.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    check(packed, [(r.doc_id, r.text) for r in docs.collect()])


def test_run_equals_its_stages(spark, tmp_path):
    data = rows(seed=9, n=24)
    random.Random(1).shuffle(data)
    folder = write(spark, tmp_path, data)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = lambda r: (r.doc_id is None, r.doc_id, r.start, r.length, bytes(r.ids))
    whole = lambda found: sum(r.length for r in found)
    got, want = corpus_pipeline.run(spark, folder).collect(), docs.collect()
    assert whole(got) == whole(want) and {key(r)[1] for r in got} == {key(r)[1] for r in want}


def test_no_documents(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert quality.MIN_WORDS and mixing.MAX_EPOCHS
