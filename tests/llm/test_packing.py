import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm import packing, queries
from llm_data import empty, frame, rows, write

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "it's we'll THE'RE don't", "Straße ÀÉÎ ÿ Ÿ ŒUVRE İstanbul ǰ J̌ é É", "a b c\x1cd\x0be",
    "漢字 かな 한국어 हिन्दी עברית 😀👍", "x²½٣ 12,345.67 3rd 1a2b", "<|endoftext|> <|startoftext|>x", "!!! ... --- @#$%^&*()", "a" * 5000,
    "word." * 40, "ﬁ ﬀ Å Ω K", "ΑΣ ΟΔΟΣ", "µ ª º × ÷ A×B", "﻿bom ​zero", "mail.a@b.example.com +1 (459) 555-7415",
]


def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_ids_by_words_equal_ids_of_texts(spark):
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice(ODD + ["The", "of,", "and.", "É", "äÖ;"]) for _ in range(30)) for _ in range(40)] + [r[1] or "" for r in rows()]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    own, whole = packing.word_tokenizer(PATH), tokenizer()
    for text in texts:
        assert np.frombuffer(own.ids(text.encode()), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids


def check(pieces, data, length=2048):
    """Pieces cover each document once and sequences without gaps."""
    t = tokenizer()
    want = sorted(((r[0], t.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in data), key=repr)
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id, p.doc_tokens].append(p)
    for found in sequences.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at and n > 0
            at += n
        assert at <= length and (at == length or at & (at - 1) == 0)
    starts = defaultdict(int)
    for doc_id, ids in want:
        starts[doc_id, len(ids)] += 1
    assert {k: sum(p.length for p in v) for k, v in docs.items()} == {k: n * k[1] for k, n in starts.items()}
    return want, docs


def test_pieces_of_query(spark, tmp_path):
    data = rows()
    pieces = queries.op1_curve_packing(spark, write(spark, tmp_path, data)).collect()
    want, docs = check(pieces, data)
    for doc_id, ids in want:
        own = [p for p in docs[doc_id, len(ids)] if zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32]
        assert {j for p in own for j in range(p.start, p.start + p.length)} == set(range(len(ids)))


@pytest.mark.parametrize("length", [1, 7, 64])
def test_other_lengths(spark, length):
    data = rows(n=12)[:14]
    pieces = packing.pack(frame(spark, data), PATH, length=length).collect()
    check(pieces, data, length) if length & (length - 1) == 0 else None
    assert max(p.offset + p.length for p in pieces) <= length


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = sorted(np.ndindex(*[1 << bits] * dims), key=lambda c: packing.hilbert_key(list(c), bits))
        assert sorted(packing.hilbert_key(list(c), bits) for c in cells) == list(range(1 << bits * dims))
        assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(cells, cells[1:]))


def test_no_rows(spark):
    assert packing.pack(empty(spark), PATH).count() == 0
