import hashlib
import random
import re

import pytest

from graphloom.llm import queries, window_dedup
from llm_data import empty, frame, rows, write

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(data, width):
    least = {}
    found = [(r[0], WORD.findall(r[1] or "")) for r in data]
    for doc_id, words in found:
        for i in range(len(words) - width + 1) if doc_id is not None else ():
            w = tuple(words[i : i + width])
            least[w] = min(doc_id, least.get(w, doc_id))
    out = []
    for doc_id, words in found:
        gone = set()
        for i in range(len(words) - width + 1) if doc_id is not None else ():
            if least[tuple(words[i : i + width])] < doc_id:
                gone.update(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_words_equal_brute_force(spark, tmp_path):
    data = rows()
    want = brute(data, 50)
    assert sum(r[2] > 0 for r in want) > 10
    got = queries.op3_repeated_windows(spark, write(spark, tmp_path, data)).collect()
    assert sorted(map(tuple, got), key=repr) == want


@pytest.mark.parametrize("width, pack_windows", [(3, 50), (7, 1_000), (50, 1)])
def test_small_packs_and_widths(spark, width, pack_windows):
    rng = random.Random(width)
    data = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(40))), "en", "s", 0) for i in range(80)] + rows()[-6:]
    got = window_dedup.remove_repeated_windows(frame(spark, data), width, pack_windows=pack_windows)
    got = got.selectExpr("row.doc_id", "n_words", "n_removed", "sha2(kept_text, 256)").collect()
    assert sorted(map(tuple, got), key=repr) == brute(data, width)


def test_intervals_are_maximal(spark):
    data = [(1, "a b c d e f g h", "", "", 0), (2, "x a b c d y e f g h", "", "", 0)]
    got = {r.row.doc_id: r.removed for r in window_dedup.remove_repeated_windows(frame(spark, data), 3).collect()}
    assert got == {1: [], 2: [[1, 5], [6, 10]]}


def test_no_rows(spark):
    assert window_dedup.remove_repeated_windows(empty(spark)).count() == 0
