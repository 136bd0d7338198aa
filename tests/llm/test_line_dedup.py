import hashlib
import zlib
from collections import defaultdict

import numpy as np

from graphloom.llm import line_dedup, queries
from llm_data import empty, frame, rows, write

SPACE = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(data, min_docs=10, min_chars=1):
    holders = defaultdict(set)
    for doc_id, text, *_ in data:
        for line in (text or "").split("\n"):
            if doc_id is not None:
                holders[line.strip(SPACE).translate(LOWER)].add(doc_id)
    drop = {k for k, ids in holders.items() if len(k) >= min_chars and len(ids) >= min_docs}
    out = []
    for doc_id, text, *_ in data:
        lines = (text or "").split("\n")
        kept = [x for x in lines if x.strip(SPACE).translate(LOWER) not in drop]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines_equal_brute_force(spark, tmp_path):
    data = rows()
    assert any(r[2] for r in brute(data))
    df = queries.op6_line_dedup(spark, write(spark, tmp_path, data))
    assert sorted(map(tuple, df.collect()), key=repr) == brute(data)


def test_other_thresholds_and_hot_line(spark):
    data = [(i, f"hot line\n{'cold' if i % 2 else 'Warm'}\nown {i}", "en", "s", 1) for i in range(400)]
    for least in (2, 150, 201, 401):
        got = line_dedup.drop_shared_lines(frame(spark, data), least, 5).selectExpr("row.doc_id", "n_lines", "n_dropped", "sha2(kept_text, 256)")
        assert sorted(map(tuple, got.collect()), key=repr) == brute(data, least, 5)


def test_bitmaps_tell_kept_lines(spark):
    data = [(i, f"a\nshared\n{i}", "en", "s", 1) for i in range(12)]
    for r in line_dedup.keep_bitmaps(frame(spark, data)).collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r.keep_bitmap), np.uint8), count=r.n_lines)
        assert bits.tolist() == [0, 0, 1] and r.n_dropped == 2


def test_no_rows(spark):
    assert line_dedup.drop_shared_lines(empty(spark)).count() == 0
