import math
import random
import zlib

import numpy as np
import pytest

from graphloom.llm import language_id, queries
from llm_data import empty, frame, rows, write

SOUNDS = {"aa": ("ka", "ri", "to", "mé", "su"), "bb": ("schl", "ung", "öd", "en", "ver"), "cc": ("да", "не", "ро", "ть", "ли")}


def labelled(seed, n=240):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        lang = rng.choice(list(SOUNDS))
        text = " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 300)))
        data.append((i, text, lang if rng.random() < 0.9 else None, "src1", len(text)))
    return data


def plain(net, text):
    """Whole network by loops over places, windows and filters."""
    data = text.encode()
    found = []
    for a in range(0, max(1, len(data)), language_id.WINDOW):
        window = data[a : a + language_id.WINDOW].ljust(language_id.WINDOW, b"\0")
        features = []
        for taps, bias in zip(net.filters, net.biases):
            answers = np.array([sum(net.table[window[t + k]].astype(float) @ taps[k] for k in range(len(taps))) for t in range(len(window) - len(taps) + 1)])
            features += list(np.maximum(answers.max(0) + bias, 0))
        scores = np.array(features) @ net.weights + net.offset
        found.append(np.exp(scores - scores.max()) / np.exp(scores - scores.max()).sum())
    return np.mean(found, 0)


def test_held_out_accuracy_and_plain_network(spark, tmp_path):
    data = labelled(1) + [(1000, None, "aa", "s", 0), (1001, "", "aa", "s", 0), (1002, "12 34 ?!", "bb", "s", 8), (None, "да нет", "cc", "s", 6), (1003, "kari tomé " * 3000, "aa", "s", 9)]
    data += [data[0], data[0]]
    folder = write(spark, tmp_path, data)
    query = queries.op12_language_id(spark, folder)
    assert query.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = query.collect()
    assert len(got) == len(data)
    texts = {d: (t, lang) for d, t, lang, *_ in data}
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        text, lang = texts[r.doc_id]
        letters = any(c.isalpha() for c in text or "")
        assert (r.lang_pred == "und" and r.score == 0) if not letters else r.lang_pred in SOUNDS
    judged = [(r.lang_pred, texts[r.doc_id][1]) for r in got if r.held_out and texts[r.doc_id][1] and r.lang_pred != "und"]
    assert len(judged) > 30 and sum(a == b for a, b in judged) >= 0.95 * len(judged)
    net = language_id.train(spark.read.parquet(f"{folder}/documents.parquet"))
    by_id = {r.doc_id: r for r in got}
    for doc_id in (0, 1, 2, 3, 4):
        want = plain(net, texts[doc_id][0])
        assert by_id[doc_id].lang_pred == net.languages[int(want.argmax())]
        assert math.isclose(by_id[doc_id].score, want.max(), abs_tol=1e-4)


def test_nothing_held_out_is_learned(spark):
    data = [(i, "kari", "aa", "s", 4) if zlib.crc32(str(i).encode()) % 5 else (i, "verung", "bb", "s", 6) for i in range(60)]
    net = language_id.train(frame(spark, data))
    assert net.languages == ["aa"]
    taken = language_id.sample(frame(spark, labelled(2)), most=5).collect()
    assert len(taken) == 15 and {r.lang for r in taken} == set(SOUNDS)


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    net = language_id.fit([b"abcabc", b"xyzxyz", b"abab"], ["a", "x", "a"], epochs=1)
    windows = rng.integers(1, 256, (5, language_id.WINDOW)).astype(np.uint8)
    wanted, share = np.array([0, 1, 0, 1, 1]), np.ones(5, np.float32)
    for p in net.parameters():
        p[...] = rng.normal(0, 0.3, p.shape)

    def loss():
        return -np.log(net.probabilities(windows).astype(float)[np.arange(5), wanted]).mean()

    for p, g in zip(net.parameters(), language_id._gradients(net, windows, wanted, share)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before = p[at]
        p[at] = before + 1e-3
        up = loss()
        p[at] = before - 1e-3
        down = loss()
        p[at] = before
        assert (up - down) / 2e-3 == pytest.approx(g[at], rel=0.1, abs=1e-3)


def test_windows_cover_the_text():
    for n in (0, 1, 255, 256, 257, 1000):
        text = bytes(1 + i % 255 for i in range(n))
        windows = language_id.windows_of(text)
        assert windows.tobytes().rstrip(b"\0") == text.rstrip(b"\0") and windows.shape[1] == language_id.WINDOW


def test_odd_rows_clashing_columns_and_no_labels(spark):
    df = frame(spark, rows()).selectExpr("*", "'x' AS window", "1 AS chance", "1 AS rank", "1 AS score", "true AS held_out")
    net = language_id.train(df)
    out = language_id.predicted(df, net)
    assert out.count() == len(rows()) and out.select("row.*").columns == df.columns
    none = language_id.train(df.withColumn("lang", df.lang.substr(1, 0)).where("lang IS NULL"))
    assert none is None
    assert {r.lang_pred for r in language_id.predicted(df, None).collect()} == {"und"}
    assert language_id.train(empty(spark)) is None
    assert language_id.predicted(empty(spark), net).count() == 0
