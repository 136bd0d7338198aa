import math
import random
from collections import Counter

import pytest

from graphloom.llm import ngram_lm, queries
from llm_data import empty, frame, rows, write


def words_of(text):
    return [w.decode("utf-8", "surrogateescape") for w in (text or "").encode().lower().split()]


def brute(data, backoff=0.4):
    uni, bi = Counter(), Counter()
    for w in [words_of(r[1]) for r in data]:
        uni.update(w)
        bi.update(zip(w, w[1:]))
    total = sum(len(words_of(r[1])) for r in data)
    out = []
    for d, t, *_ in data:
        w = words_of(t)
        own = Counter(zip(w, w[1:]))
        score = math.log(uni[w[0]] / total) if w else 0.0
        for pair in zip(w, w[1:]):
            others = bi[pair] - own[pair]
            score += math.log(others / uni[pair[0]]) if others else math.log(backoff * uni[pair[1]] / total)
        out.append((d, len(w), score))
    return sorted(out, key=repr)


def equal(got, want):
    got = sorted(got, key=lambda r: (repr(r[0]), r[1], r[2]))
    want = sorted(want, key=lambda r: (repr(r[0]), r[1], r[2]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and math.isclose(g[2], w[2], rel_tol=1e-9, abs_tol=1e-9)


def test_scores_equal_brute_force(spark, tmp_path):
    data = rows()
    got = queries.op7_bigram_scores(spark, write(spark, tmp_path, data)).collect()
    equal([tuple(r)[:3] for r in got], brute(data))
    assert all(r.mean_score is None or math.isclose(r.mean_score, r.log_score / r.n_words) for r in got)


@pytest.mark.parametrize("pack_words", [1, 500])
def test_small_packs(spark, pack_words):
    data = rows(seed=4)
    got = ngram_lm.scored(frame(spark, data), 0.7, pack_words=pack_words, most_sums=50 * pack_words, range_bytes=4000).selectExpr("row.doc_id", "n_words", "log_score").collect()
    equal(map(tuple, got), brute(data, 0.7))


def test_hot_words(spark):
    rng = random.Random(3)
    data = [(i, " ".join(rng.choice(["the", "the", "of", f"w{rng.randrange(30)}", f"x{rng.randrange(3000)}"]) for _ in range(rng.randrange(1, 80))), "en", "s", 1) for i in range(150)]
    data += [data[0], (900, "the", "en", "s", 1), (901, None, "en", "s", 1)]
    texts = frame(spark, data).selectExpr("cast(coalesce(text, '') as binary) AS text")
    hot, total = ngram_lm.hot_words(texts, 0.02)
    found = set(ngram_lm._hashes([b"the", b"of"]).tolist())
    assert found < set(hot.tolist()) and len(hot) <= 51 and total == sum(len(words_of(r[1])) for r in data)
    got = ngram_lm.scored(frame(spark, data), pack_words=700, range_bytes=1500).selectExpr("row.doc_id", "n_words", "log_score").collect()
    equal(map(tuple, got), brute(data))


def test_no_rows(spark):
    assert ngram_lm.scored(empty(spark)).count() == 0
