import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing
from llm_data import empty, frame, rows


def water(children, budget):
    """Children (name, ceiling, weight): the real-valued split of a budget."""
    share, open_ = {}, dict((n, (c, w)) for n, c, w in children)
    while open_:
        total = sum(w for _, w in open_.values())
        full = [n for n, (c, w) in open_.items() if c * total <= w * budget]
        if not full:
            return share | {n: budget * w / total for n, (_, w) in open_.items()}
        for n in full:
            share[n] = open_.pop(n)[0]
            budget -= share[n]
    return share


@pytest.mark.parametrize("seed", range(4))
def test_budget_split(spark, seed):
    rng = random.Random(seed)
    groups = {f"p{i}": [(f"c{j}", rng.choice([0, rng.randrange(1, 1000)]), rng.randrange(1, 9)) for j in range(rng.randrange(1, 8))] for i in range(6)}
    budgets = {p: rng.randrange(0, sum(c for _, c, _ in g) + 1) for p, g in groups.items()}
    table = spark.createDataFrame(
        [(p, n, c, w, budgets[p]) for p, g in groups.items() for n, c, w in g], "p string, c string, ceiling bigint, weight bigint, budget bigint"
    )
    got = defaultdict(dict)
    for r in mixing.split_budget(table, ["p"], "c").collect():
        got[r.p][r.c] = r.share
        assert 0 <= r.share <= r.ceiling
    for p, g in groups.items():
        want = water(g, budgets[p])
        assert sum(got[p].values()) == budgets[p]
        assert all(abs(got[p][n] - want[n]) < 1 for n in want)


def test_budget_is_met_by_whole_epochs_and_prefixes(spark):
    df = frame(spark, rows())
    total = df.select(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORD)))).first()[0]
    for percent in (0, 7, 60, 100, 150):
        got = mixing.mixed(df, budget_percent=percent, max_epochs=2).collect()
        spent = defaultdict(int)
        for r in got:
            spent[r.domain, r.lang, r.source, r.leaf_budget] += r.tokens_taken
            assert 0 <= r.tokens_taken <= r.copies * r.n_tokens and 1 <= r.copies <= 3
        # rows that repeat at the cut give equal whole prefixes
        assert all(abs(n - leaf[3]) <= 2 for leaf, n in spent.items())
        assert abs(sum(spent.values()) - min(percent * total // 100, 2 * total)) <= 2 * len(spent)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mixed(df.repartition(3), budget_percent=150, max_epochs=2).collect()))


def test_shortage_goes_to_siblings_first(spark):
    # one source of a language is short: its sibling takes more, the other language does not
    data = [(i, "w " * 10, lang, src, 0) for i, (lang, src) in enumerate([("en", "src0")] + [("en", "src4")] * 30 + [("de", "src8")] * 30)]
    got = mixing.mixed(frame(spark, data), budget_percent=40, weights={}, max_epochs=1).collect()
    budgets = {(r.lang, r.source): r.leaf_budget for r in got}
    assert budgets == {("en", "src0"): 10, ("en", "src4"): 112, ("de", "src8"): 122}


def test_mix_keeps_columns_and_repeats_rows(spark):
    df = frame(spark, rows())
    out = mixing.mix(df, budget_percent=200, max_epochs=2)
    # a blank text comes along with the epochs of its leaf
    assert out.columns == df.columns and out.count() == 2 * df.count()


def test_mix_ends_with_a_prefix(spark):
    data = [(i, f" w{i}a\tw{i}b\n\nw{i}c w{i}d " * (1 + i % 5), "en" if i % 2 else "de", f"src{i % 3}", 0) for i in range(60)]
    df = frame(spark, data)
    texts = {r[0]: r[1] for r in data}
    for percent in (33, 77, 130):
        budgets = {(r.domain, r.lang, r.source): r.leaf_budget for r in mixing.mixed(df, budget_percent=percent, max_epochs=2).collect()}
        spent = defaultdict(int)
        out = mixing.mix(df, budget_percent=percent, max_epochs=2).withColumn("domain", mixing.domain_of(F.col("source"))).collect()
        for r in out:
            spent[r.domain, r.lang, r.source] += len(r.text.split())
            assert r.text and texts[r.doc_id].startswith(r.text)
        assert spent == {leaf: n for leaf, n in budgets.items() if n}


def test_no_rows(spark):
    assert mixing.mixed(empty(spark)).count() == 0
