import re

import pytest

from graphloom.llm import quality, queries
from llm_data import empty, frame, rows, write

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    repeated = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def test_counts_equal_brute_force(spark, tmp_path):
    data = rows()
    got = queries.op8_line_quality(spark, write(spark, tmp_path, data)).collect()
    want = sorted(((r[0], *base(r[1])) for r in data), key=repr)
    assert sorted((tuple(r)[:7] for r in got), key=repr) == want
    assert all(not r.kept for r in got if r.base_failed)


@pytest.mark.parametrize(
    "line, reason",
    [
        ("A plain sentence with a few words.", None),
        ("password=a62b2e290a443f3fe4 stays here", None),
        ("", None),
        ("--- ***", "punctuation"),
        ("BUY!! NOW!! CHEAP!!", "punctuation"),
        ("THIS WHOLE LINE IS LOUD", "punctuation"),
        ("one*** two$$$ three&&& four", "punctuation"),
        ("Home | News | Sports | Contact", "navigation"),
        ("Home > News > Today", "navigation"),
        ("a comparison a > b in a line of many other words here", None),
        ("This work is licensed under the GNU General Public License, version 3.", "boilerplate"),
        ("All rights reserved.", "boilerplate"),
    ],
)
def test_line_rules(spark, line, reason):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(line,)], "line string").select(quality.line_verdict(F.col("line")).alias("v")).first().v
    assert got.reason == reason


def test_documents_that_lose_too_much_go(spark):
    good = " ".join(f"word{i}" for i in range(30)) + "."
    menu = " | ".join(f"item{i}" for i in range(12))
    data = [(1, f"{good}\n{menu}", "en", "s", 0), (2, f"{good}\n{menu}\n{menu.replace('item', 'x')}", "en", "s", 0), (3, None, "en", "s", 0)]
    df = frame(spark, data)
    kept = quality.clean(df)
    assert kept.columns == df.columns
    assert [(r.doc_id, r.text, r.n_chars) for r in kept.collect()] == [(1, good, len(good))]
    assert {r.row.doc_id: r.reasons for r in quality.judged(df).collect()} == {1: ["navigation"], 2: ["navigation"], 3: []}


def test_plan_has_no_shuffle_and_no_python(spark):
    plan = quality.judged(frame(spark, extra=False).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 1


def test_no_rows(spark):
    assert quality.judged(empty(spark)).count() == 0 and quality.clean(empty(spark)).count() == 0
