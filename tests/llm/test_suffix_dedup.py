import hashlib
import random

import numpy as np
import pytest

from graphloom.llm import queries, suffix_dedup
from llm_data import empty, frame, rows, write


def brute(data, length):
    counts = {}
    texts = [(r[1] or "").encode() for r in data]
    for t in texts:
        for i in range(len(t) - length + 1):
            counts[t[i : i + length]] = counts.get(t[i : i + length], 0) + 1
    out = []
    for r, t in zip(data, texts):
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        kept = bytes(c for c, m in zip(t, mask) if not m)
        spans = sum(m and (i == 0 or not mask[i - 1]) for i, m in enumerate(mask))
        out.append((r[0], len(t), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_bytes_equal_brute_force(spark, tmp_path):
    data = [r if len(r[1] or "") < 20_000 else (r[0], r[1][:20_000], *r[2:]) for r in rows()]
    want = brute(data, 400)
    assert sum(w[2] > 0 for w in want) > 15
    got = queries.op5_suffix_dedup(spark, write(spark, tmp_path, data)).collect()
    assert sorted(map(tuple, got), key=repr) == want


@pytest.mark.parametrize("length, letters", [(16, "ab"), (17, "abcd"), (40, "é a")])
def test_short_strings(spark, length, letters, monkeypatch):
    rng = random.Random(length)
    data = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(120))), "en", "s", 0) for i in range(60)]
    data += [(99, "a" * 300, "", "", 0), (100, data[3][1] * 3, "", "", 0), (101, data[3][1] + "x" + data[4][1], "", "", 0)]
    got = suffix_dedup.remove_repeated_bytes(frame(spark, data), length)
    got = got.selectExpr("row.doc_id", "n_bytes", "n_removed", "cast(size(removed) as bigint)", "sha2(kept_bytes, 256)").collect()
    assert sorted(map(tuple, got), key=repr) == brute(data, length)


def test_merge_of_runs_is_sorted_with_prefixes():
    rng = random.Random(8)
    for n_runs in (1, 2, 3, 7):
        lists = []
        for _ in range(n_runs):
            keys = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 40)))
            known, lengths, rest = suffix_dedup.front_coded(keys)
            assert list(suffix_dedup.decoded(known, lengths, rest)) == keys
            lists.append((keys, known.tolist()))
        out = [(key, p) for _, _, p, key in suffix_dedup.merged([(iter(keys), known) for keys, known in lists])]
        assert [k for k, _ in out] == sorted(k for keys, _ in lists for k in keys)
        for (a, _), (b, p) in zip(out, out[1:]):
            assert p == suffix_dedup.common_prefix(a, b, 0)


def test_pieces_of_a_long_text(monkeypatch):
    rng = random.Random(1)
    text = bytes(rng.choice(b"abcdef ") for _ in range(5_000))
    whole = suffix_dedup.owners(text, 60)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    cut = suffix_dedup.owners(text, 60)

    def by_window(found):
        return {p: s for s, a, b in zip(*(c.tolist() for c in found[:3])) for p in range(a, b + 1)}

    assert by_window(whole) == by_window(cut) and len(by_window(cut)) == len(text) - 59


def test_no_rows(spark):
    assert suffix_dedup.remove_repeated_bytes(empty(spark)).count() == 0


def test_parts_are_even():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 123, 3_000_000).astype(np.uint8).tobytes()
    hashes = suffix_dedup.owners(text, 400)[3]
    parts = ((hashes >> np.uint64(32)) * np.uint64(96)) >> np.uint64(32)
    sizes = np.bincount(parts.astype(np.int64), minlength=96)
    assert sizes.min() > 0 and sizes.max() <= 2 * sizes.mean()
