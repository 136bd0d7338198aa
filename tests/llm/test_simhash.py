import random
from collections import Counter

import xxhash

from graphloom.llm import queries, simhash
from graphloom.llm.links import components
from llm_data import empty, frame, rows, write


def prints_of(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def group(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def brute(data):
    found = [(r[0], prints_of(r[1])) for r in data]
    roots = group({f for _, f in found}, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for doc_id, f in found:
        if doc_id is not None:
            least[roots[f]] = min(doc_id, least.get(roots[f], doc_id))
    return sorted(((d, f"{f:016x}", least.get(roots[f])) for d, f in found), key=repr)


def test_components_equal_brute_force(spark, tmp_path):
    data = rows()
    want = brute(data)
    assert max(Counter(r[2] for r in want).values()) > 3
    got = queries.op9_simhash(spark, write(spark, tmp_path, data)).collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_pairs_of_near_fingerprints(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.add(base)
        for bits in (1, 2, 3, 4):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), bits)))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fingerprint bigint")
    for most in (0, 1, 2, 3):
        got = {frozenset(r) for r in simhash.near_fingerprints(df, most).collect()}
        values = [s for (s,) in signed]
        assert got == {frozenset((a, b)) for i, a in enumerate(values) for b in values[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= most}


def test_one_document_of_each_group_stays(spark):
    data = rows()
    df = frame(spark, data)
    kept = simhash.one_per_group(df)
    assert kept.columns == df.columns
    stay = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert stay == sorted({r[2] for r in brute(data) if r[2] is not None})


def test_components_of_chain_hub_and_random_links(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1001 + i) for i in range(200)]
    loose = [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(160)]
    links = chain + hub + loose + [(5000, 5000), (None, 3)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.component for r in components(df).collect()}
    nodes = {n for a, b in links if a is not None and a != b for n in (a, b)}
    near = {frozenset(x) for x in links}
    assert got == group(nodes, lambda a, b: frozenset((a, b)) in near)


def test_no_rows(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.one_per_group(empty(spark)).count() == 0


def shingles(text, width=5):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


def test_near_copies_by_jaccard(spark):
    rng = random.Random(11)
    data = []
    for i in range(400):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        near = list(words)
        for _ in range(rng.randrange(0, 1 + len(words) // 40)):
            near[rng.randrange(len(near))] = "changed"
        data += [(2 * i, " ".join(words), "en", "s", 0), (2 * i + 1, " ".join(near), "en", "s", 0)]
    data += [(None, "one two", "en", "s", 0), (9000, None, "en", "s", 0), (9001, "", "en", "s", 0), data[0]]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, data)).collect()}
    alike = []
    for i in range(400):
        a, b = shingles(data[2 * i][1]), shingles(data[2 * i + 1][1])
        if len(a & b) >= 0.8 * len(a | b):
            alike.append(got[2 * i] == got[2 * i + 1])
    assert len(alike) > 150 and sum(alike) >= 0.95 * len(alike)
    # texts of different pairs have nothing in common
    assert all(got[2 * i + k] in (2 * i, 2 * i + 1) for i in range(400) for k in (0, 1))
    assert got[9000] == got[9001] == 9000
    kept = simhash.first_of_groups(frame(spark, data), simhash.near_copies(frame(spark, data)))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for c in got.values() if c is not None})
    assert simhash.near_copies(empty(spark)).count() == 0


def test_reach_grows_with_the_number_of_texts():
    small, large = simhash.Reach(50_000), simhash.Reach(50_000_000)
    assert large.bits > small.bits and large.segments > small.segments
    assert small.most / (small.bits * small.segments) < 0.2


def test_near_copies_misses_no_pair_of_a_segment(spark):
    # variants of a few texts, far and near: buckets whose leader is near to some of their texts only
    rnd = random.Random(31)
    texts = []
    for _ in range(6):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
        for _ in range(60):
            words = list(base)
            for at in rnd.sample(range(300), rnd.randint(4, 16)):
                words[at] = f"w{rnd.randrange(10**6)}"
            texts.append(" ".join(words))
    reach = simhash.Reach(len(texts))
    cut = [simhash.segments_of(t.encode().split(), reach, 5) for t in texts]
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            bits = [int(x).bit_count() for x in cut[i][0] ^ cut[j][0]]
            first = ((cut[i][1] ^ cut[j][1]) & (2**64 - 1)).bit_count()
            if min(bits) <= 1 and sum(bits) <= reach.most and first <= reach.most_first:
                a, b = sorted((root(i), root(j)))
                top[b] = a
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    assert 6 < len(set(got.values())) < len(texts)


def test_segments_one_bit_apart_need_three_rows_each(spark):
    rng = random.Random(17)
    for n in (40, 3_000, 200_000_000):
        reach = simhash.Reach(n)
        values = {(part, rng.getrandbits(reach.bits)) for part in range(3) for _ in range(150)}
        values |= {(part, v ^ (1 << rng.randrange(reach.bits))) for part, v in list(values) for _ in range(2)} | {(0, 0), (0, (1 << reach.bits) - 1)}
        ball = simhash._ball(spark.createDataFrame(sorted(values), "part int, value bigint"), reach)
        got = sorted(map(tuple, ball.collect()))
        assert got == sorted((p, a, b) for p, a in values for q, b in values if p == q and a & b == a and (a ^ b).bit_count() == 1)
        # a row for each bit of a segment made the exchange a dozen times as large
        plan = ball._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(" not in plan and "shiftleft" not in plan
