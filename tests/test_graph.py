"""Graph operators against brute force on small random graphs."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom import rules as R, session
from graphloom.operators import block_pairs, causal, components, detail, graph, keywords, ordering, pairs, ranking, reach, reach_index
from graphloom.operators.mentions import entity_mentions, stored_mentions
from graphloom.plans.whole_graph import GlobalAnalysis


def edge_table(spark, links):
    return spark.createDataFrame([(i, "r", a, b) for i, (a, b) in enumerate(links)], "rid bigint, name string, source string, target string")


def entity_table(spark, names, text=None, types=None):
    rows = [(i, n, types[i] if types else "t", {"d": text[i]} if text else {}) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "eid bigint, name string, type string, attributes map<string,string>")


def closure(links):
    reach = {(a, b) for a, b in links}
    while True:
        more = {(a, d) for a, b in reach for c, d in links if b == c} - reach
        if not more:
            return reach
        reach |= more


def random_links(seed, n=14, m=22):
    rnd = random.Random(seed)
    return [(f"n{rnd.randrange(n):02d}", f"n{rnd.randrange(n):02d}") for _ in range(m)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    links = random_links(seed)
    reach = closure([x for x in links if x[0] != x[1]])
    want = set()
    for a, b in reach:
        if (b, a) in reach:
            group = {x for x in {p for e in reach for p in e} if (a, x) in reach and (x, a) in reach} | {a}
            if len(group) > 1:
                want.add((min(group), a, len(group)))
    got = {tuple(r) for r in components.strongly_connected_components(edge_table(spark, links)).collect()}
    assert got == want


def jobs_of(spark, run):
    """What ``run`` returns and the number of its checkpoints, each a chain of jobs."""
    cuts = []
    cut = components.stored
    for module in (components, ordering):
        module.stored = lambda df: cuts.append(1) or cut(df)
    try:
        return run(), len(cuts)
    finally:
        for module in (components, ordering):
            module.stored = cut


def test_long_ring_and_giant_component(spark):
    n = 20_000
    ring = [(f"r{i:05d}", f"r{(i + 1) % n:05d}") for i in range(n)]
    rnd = random.Random(2)
    # a ring of 400 with shortcuts, a chain that leads in and one that leads out
    giant = [(f"g{i:03d}", f"g{(i + 1) % 400:03d}") for i in range(400)] + [(f"g{rnd.randrange(400):03d}", f"g{rnd.randrange(400):03d}") for _ in range(150)]
    tails = [(f"a{i:04d}", f"a{i + 1:04d}") for i in range(3000)] + [("a3000", "g000"), ("g007", "z0000")] + [(f"z{i:04d}", f"z{i + 1:04d}") for i in range(3000)]
    found, cuts = jobs_of(spark, lambda: components.strongly_connected_components(edge_table(spark, ring + giant + tails)).groupBy("component", "size").count().collect())
    assert sorted(map(tuple, found)) == [("g000", 400, 400), ("r00000", n, n)]
    assert cuts < 60


def test_long_chain_and_tree_in_few_rounds(spark):
    n = 20_000
    chain = [(f"c{i:05d}", f"c{i + 1:05d}") for i in range(n)]
    # every node of a ladder has two before it that hang from one chain; a tree of width two
    tree = [(f"t{(i - 1) // 2:05d}", f"t{i:05d}") for i in range(1, 2000)]
    diamonds = [x for i in range(200) for x in ((f"d{i:03d}", f"u{i:03d}"), (f"d{i:03d}", f"v{i:03d}"), (f"u{i:03d}", f"d{i + 1:03d}"), (f"v{i:03d}", f"w{i:03d}"), (f"w{i:03d}", f"d{i + 1:03d}"))]
    (levels, complete), cuts = jobs_of(spark, lambda: ordering.dependency_levels(edge_table(spark, chain + tree + diamonds)))
    got = {r.node: r.level for r in levels.collect()}
    assert complete and cuts < 40
    assert all(got[f"c{i:05d}"] == i for i in range(n + 1))
    assert all(got[f"t{i:05d}"] == (i + 1).bit_length() - 1 for i in range(2000))
    assert all(got[f"d{i:03d}"] == 3 * i and got[f"w{i:03d}"] == 3 * i + 2 for i in range(200))
    assert not ordering.dependency_levels(edge_table(spark, chain + [("c20000", "c00000")]))[1]


def test_small_cycle(spark):
    e = edge_table(spark, ["ab", "bc", "cd", "db"])
    assert {tuple(r) for r in components.strongly_connected_components(e).collect()} == {("b", x, 3) for x in "bcd"}
    assert [r.finding for r in ordering.dependency_order(e).collect()] == ["no_topological_order"]
    gaps = reach.transitive_gaps(entity_table(spark, "abcd"), e).collect()
    assert [(r.source, r.target, r.path_length, r.intermediate_nodes) for r in gaps] == [
        ("a", "c", 3, ["b"]), ("a", "d", 4, ["b", "c"]), ("b", "d", 3, ["c"]), ("c", "b", 3, ["d"]), ("d", "c", 3, ["b"])]
    roles = {r.name: r.role for r in graph.hierarchy_roles(entity_table(spark, "abcd"), e).collect()}
    assert roles == {"a": "root_node", "b": "intermediate_node", "c": "intermediate_node", "d": "intermediate_node"}


def test_self_loop(spark):
    e = edge_table(spark, ["xx"])
    assert components.strongly_connected_components(e).count() == 0
    assert [r.finding for r in ordering.dependency_order(e).collect()] == ["no_topological_order"]
    triple = spark.createDataFrame([(0, "x", "r", "x", 1.0)], "seq bigint, head string, relation string, tail string, confidence double")
    assert graph.undirected_degrees(graph.collapse_undirected(triple)).first().degree == 2


@pytest.mark.parametrize("seed", [4, 5])
def test_order_of_acyclic_graphs(spark, seed):
    links = [(min(a, b), max(a, b)) for a, b in random_links(seed) if a != b]
    level = {n: 0 for e in links for n in e}
    for _ in level:
        for a, b in links:
            level[b] = max(level[b], level[a] + 1)
    got = ordering.dependency_order(edge_table(spark, links)).orderBy("position").collect()
    assert [(r.node, r.level) for r in got] == sorted(level.items(), key=lambda x: (x[1], x[0]))
    assert [r.position for r in got] == list(range(len(level)))


@pytest.mark.parametrize("seed", [6, 7])
def test_transitive_gaps(spark, seed):
    links = random_links(seed)
    names = [f"n{i:02d}" for i in range(14)]
    nxt = {n: sorted({b for a, b in links if a == n and b != n}) for n in names}
    want = []
    for s in names:
        dist, front = {s: 0}, [s]
        while front:
            front = [t for u in front for t in nxt[u] if t not in dist and dist.setdefault(t, dist[u] + 1)]
        want += [(s, t, dist[t] + 1) for t in names if dist.get(t, 0) >= 2]
    got = reach.transitive_gaps(entity_table(spark, names), edge_table(spark, links), 40, 2).collect()
    assert [(r.source, r.target, r.path_length) for r in got] == want[:40]
    for r in got:
        path = [r.source, *r.intermediate_nodes, r.target]
        assert len(path) == r.path_length and all(b in nxt[a] for a, b in zip(path, path[1:]))


def reached_pairs(members, ranges):
    of = {r.node: [] for r in members.collect()}
    for r in ranges.collect():
        of[r.node].append((r.from_rank, r.to_rank))
    at = {r["rank"]: r.name for r in members.collect()}
    return [(r.name, at[k]) for r in members.collect() for lo, hi in of[r.node] for k in range(lo, hi + 1)]


@pytest.mark.parametrize("seed,n,m", [(22, 30, 50)])
def test_reach_index(spark, seed, n, m):
    rnd = random.Random(seed)
    links = random_links(seed, n, m)
    # a hub with ways in and out, a long tail behind it, and names that are no entity
    links += [("n03", f"h{i}") for i in range(20)] + [(f"h{i}", f"h{i + 1}") for i in range(0, 18, 3)] + [("x1", "n03"), ("h4", "x2"), ("x2", "n05")]
    names = [f"n{i:02d}" for i in range(n)] + [f"h{i}" for i in range(20)] + ["alone"]
    rnd.shuffle(names)
    entities, edges = entity_table(spark, names), edge_table(spark, links)
    known = set(names)
    want = {(a, b) for a, b in closure(links) if a in known and b in known} | {(a, a) for a in names}
    members, ranges = reach_index.reach_index(entities, edges)
    got = reached_pairs(members, ranges)
    assert len(got) == len(set(got)) and set(got) == want
    gaps = Counter(a for a, b in want if a != b and (a, b) not in links)
    assert {names[r.eid]: r.gaps for r in reach_index.gap_counts(entities, edges).collect()} == dict(gaps)


def test_reach_index_of_long_chains_and_no_edges(spark):
    names = [f"n{i:04d}" for i in range(3000)]
    members, ranges = reach_index.reach_index(entity_table(spark, names), edge_table(spark, list(zip(names, names[1:]))))
    assert ranges.count() == 3000
    assert [r.name for r in members.orderBy("rank").collect()] == names
    empty = edge_table(spark, [])
    assert reach_index.gap_counts(entity_table(spark, "ab"), empty).count() == 0
    members, ranges = reach_index.reach_index(entity_table(spark, []), empty)
    assert members.count() == ranges.count() == 0


def test_category_gaps(spark):
    links = random_links(8)
    names = [f"n{i:02d}" for i in range(14)]
    types = ["u" if i % 3 else "v" for i in range(14)]
    entities, edges = entity_table(spark, names, types=types), edge_table(spark, links)
    linked = {frozenset(x) for x in links}
    want = {(types[i], a, b) for (i, a), (j, b) in itertools.combinations(enumerate(names), 2) if types[i] == types[j] and frozenset((a, b)) not in linked}
    got = {tuple(r) for r in graph.missing_partners(entities, entities, edges).collect()}
    assert got == want
    counts = {r.type: r.missing_pairs for r in graph.category_gap_counts(entities, edges).collect()}
    assert counts == Counter(t for t, _, _ in want)


def test_running_index_is_exact_for_any_slice(spark):
    rnd = random.Random(9)
    rows = [(g, v) for g in "ab" for v in rnd.sample(range(-1000, 1000), 200)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    want = {(g, v): sorted(x for h, x in rows if h == g).index(v) for g, v in rows}
    before = {(g, v): max((x for h, x in rows if h == g and x < v), default=None) for g, v in rows}
    for width in (3, 16, 1 << 21):
        assert {(r.g, r.v): r.i for r in ranking.running_index(df, ["g"], "v", "i", width).collect()} == want
        assert {(r.g, r.v): r.p for r in ranking.previous_value(df, ["g"], "v", "p", width).collect()} == before


@pytest.mark.parametrize("least", [0.05, 0.3, 0.8])
def test_similarity_finds_every_pair(spark, least):
    rnd = random.Random(10)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(40)]
    texts += [texts[0]] * 5
    bags = [t.split() for t in texts]
    freq = Counter(w for b in bags for w in b)
    vec = [{w: c / len(b) * math.log(len(bags) / (freq[w] + 1)) for w, c in Counter(b).items()} for b in bags]
    norm = [math.sqrt(sum(x * x for x in v.values())) for v in vec]
    first = {}
    rep = [first.setdefault(tuple(sorted(b)), i) for i, b in enumerate(bags)]
    want = Counter()
    for i, j in itertools.combinations(range(len(bags)), 2):
        if norm[i] and norm[j]:
            s = sum(vec[i][w] * vec[j].get(w, 0) for w in vec[i]) / norm[i] / norm[j]
            if s > least:
                want[tuple(sorted((rep[i], rep[j])))] += 1
    got = keywords.similar_entities(entity_table(spark, texts).withColumn("attributes", F.lit(None).cast("map<string,string>")), least)
    assert {(r.profile1, r.profile2): r.pairs for r in got.collect()} == dict(want)


def test_similarity_is_the_same_with_hot_tokens_in_parts(spark, monkeypatch):
    rnd = random.Random(18)
    e = entity_table(spark, [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 5))) for _ in range(60)])
    whole = sorted((r.profile1, r.profile2, round(r.score, 9)) for r in keywords.similar_entities(e).collect())
    monkeypatch.setattr(keywords, "TOKEN_ROWS", 3)
    assert whole and sorted((r.profile1, r.profile2, round(r.score, 9)) for r in keywords.similar_entities(e).collect()) == whole


def test_similarity_by_blocks_equals_leading_tokens(spark, monkeypatch):
    rnd = random.Random(27)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 6))) for _ in range(150)]
    e = entity_table(spark, texts + texts[:5])
    # repeated and null ids too
    e = e.unionByName(e.where("eid % 40 = 0")).unionByName(e.where("eid = 7").withColumn("name", F.lit("a z"))).unionByName(e.where("eid < 3").withColumn("eid", F.lit(None).cast("bigint")))
    shown = lambda common: sorted(
        (r.profile1, r.profile2, round(r.score, 9), r.pairs, *(r.common_keywords or ())) for r in keywords.similar_entities(e, 0.3, common=common).collect()
    )
    monkeypatch.setattr(block_pairs, "BLOCK_ROWS", 30)
    monkeypatch.setattr(block_pairs, "PACK_ROWS", 7)
    monkeypatch.setattr(block_pairs, "TILE_ROWS", 8)
    monkeypatch.setattr(block_pairs, "TILE_COLUMNS", 16)
    monkeypatch.setattr(keywords, "DENSE", 0)
    leading = shown(True)
    monkeypatch.setattr(keywords, "DENSE", 1e9)
    assert leading and shown(True) == leading
    assert [r[:4] for r in shown(False)] == [r[:4] for r in leading]


def test_similar_texts_move_no_row_for_each_pair(spark, monkeypatch):
    # half of all pairs share leading tokens: what is joined must not be pairs with their tokens
    rnd = random.Random(28)
    e = entity_table(spark, [" ".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(80)])
    plan = keywords.similar_entities(e)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_similar_queries_reach_the_default_threshold(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    parts = entry.queries()["mth_12_all_cosine_similarity"](spark, d)
    similar = entry.queries()["pipe_8_all_recommendations"](spark, d).where("type = 'similar_entity_relation'")
    assert parts.where("score <= 0.9").count() and similar.where("value <= 0.9").count()


def test_similar_entities_name_their_members(spark):
    e = entity_table(spark, ["x y", "y x", "x z", "w", "v", "u", "t"])
    similar, members = keywords.similar_entities_and_members(e, 0.1)
    of = {}
    for r in members.collect():
        of.setdefault(r.profile, set()).add(r.eid)
    assert of[0] == {0, 1} and sum(map(len, of.values())) == 7
    pairs = {(r.profile1, r.profile2): r.pairs for r in similar.collect()}
    assert pairs[0, 0] == 1 and pairs[0, 2] == len(of[0]) * len(of[2])


def test_pages_are_compared_by_their_text(spark, tmp_path):
    import __spark_entry__ as entry

    html = "<html><head><style>p{margin:0}</style><script>track()</script></head><!-- ad --><p>%s</p></html>"
    rows = [(0, "http://a.org/1", html % "red green blue"), (1, "http://b.com/2", html % "red green blue")]
    rows += [(i, f"http://c{i}.net/{i}", html % f"word{i} other{i}") for i in range(3, 14)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.profile1, r.profile2): r.common for r in entry.queries()["jn_10_page_text_keywords"](spark, str(tmp_path)).collect()}
    assert got[0, 1] == "blue|green|http|red"


def test_tfidf_example(spark):
    e = entity_table(spark, ["x y", "x z", "w", "v", "u"])
    got = keywords.similar_entities(e, 0.1).collect()
    assert [(r.profile1, r.profile2, round(r.score, 6)) for r in got] == [(0, 1, 0.237106)]
    assert keywords.similar_entities(e).count() == 0


@pytest.mark.parametrize("seed,limit", [(11, 10), (12, 400)])
def test_missing_causal_edges(spark, seed, limit):
    rnd = random.Random(seed)
    words = ["因为", "结果", "甲乙", "丙丁", "戊己", "庚辛"]
    names = [f"{i} " + " ".join(rnd.sample(words, rnd.randint(1, 3))) for i in range(24)]
    links = [(names[rnd.randrange(24)], names[rnd.randrange(24)]) for _ in range(60)]
    sets = [set(n.split()) for n in names]
    want = []
    for i, j in itertools.permutations(range(24), 2):
        if (names[i], names[j]) in links:
            continue
        c = len(sets[i] & set(R.CAUSAL_WORDS)) + len(sets[j] & set(R.CAUSAL_WORDS))
        s = min(1.0, c * 0.3 + len(sets[i] & sets[j]) / (len(sets[i] | sets[j]) + 1) * 0.7)
        if s > 0.3:
            want.append((i, j, round(s, 6)))
    e = entity_table(spark, names).withColumn("attributes", F.lit(None).cast("map<string,string>"))
    got = causal.missing_causal_edges(e, edge_table(spark, links), limit).collect()
    assert [(r.eid1, r.eid2, round(r.score, 6)) for r in got] == want[:limit]


@pytest.mark.parametrize("seed", [16, 17])
def test_all_missing_causal_edges(spark, seed):
    rnd = random.Random(seed)
    words = ["因为", "结果", "甲乙", "丙丁", "戊己", "庚辛"]
    # more pairs than any first few thousand
    names = [f"{i} " + " ".join(rnd.sample(words, rnd.randint(1, 3))) for i in range(120)]
    links = [(rnd.choice(names), rnd.choice(names)) for _ in range(600)]
    sets = [set(n.split()) for n in names]
    causes = [len(s & set(R.CAUSAL_WORDS)) for s in sets]
    want = set()
    for i, j in itertools.permutations(range(len(names)), 2):
        s = min(1.0, (causes[i] + causes[j]) * 0.3 + len(sets[i] & sets[j]) / (len(sets[i] | sets[j]) + 1) * 0.7)
        if s > 0.3 and (names[i], names[j]) not in links:
            want.add((i, j))
    e = entity_table(spark, names).withColumn("attributes", F.lit(None).cast("map<string,string>"))
    members, ranges = causal.missing_causal_ranges(e, edge_table(spark, links))
    at = {(r.want, r["rank"]): r.eid2 for r in members.collect()}
    got = [(r.eid1, at[r.want, k]) for r in ranges.collect() for k in range(r.from_rank, r.to_rank + 1)]
    got += [(r.eid1, r.eid2) for r in causal.missing_causal_pairs(e, edge_table(spark, links)).collect()]
    assert len(want) > 5000 and len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("rows_of_a_token", [4096, 3])
def test_missing_causal_profiles(spark, monkeypatch, rows_of_a_token):
    monkeypatch.setattr(causal, "TOKEN_ROWS", rows_of_a_token)
    rnd = random.Random(18)
    words = ["因为", "结果", "甲乙", "丙丁", "戊己", "庚辛", "壬癸"]
    # a third of all entities have the same tokens
    texts = ["甲乙 丙丁"] * 30 + [" ".join(rnd.sample(words, rnd.randint(1, 4))) for _ in range(57)] + ["", "因为", "因为 结果"]
    names = [f"{chr(0x3400 + i)}" for i in range(len(texts))]
    links = [(rnd.choice(names), rnd.choice(names)) for _ in range(400)] + [(names[0], names[1])] * 2
    e = entity_table(spark, names, texts)
    tokens = {r.eid: set(r.tokens) for r in causal.token_sets(e).collect()}
    causes = {i: len(s & set(R.CAUSAL_WORDS)) for i, s in tokens.items()}
    score = {
        (i, j): min(1.0, (causes[i] + causes[j]) * 0.3 + len(tokens[i] & tokens[j]) / (len(tokens[i] | tokens[j]) + 1) * 0.7)
        for i, j in itertools.permutations(tokens, 2)
    }
    want = {p for p, s in score.items() if s > 0.3 and (names[p[0]], names[p[1]]) not in links}
    few = {p for p in want if causes[p[0]] + causes[p[1]] < 2}
    edges = edge_table(spark, links)
    pairs, members, linked = causal.missing_causal_profiles(e, edges)
    of = {}
    for r in members.collect():
        of.setdefault(r.profile, []).append(r.eid)
    barred = {tuple(r) for r in linked.collect()}
    got = set()
    for r in pairs.collect():
        mine = {p for a in of[r.profile1] for b in of[r.profile2] for p in ((a, b), (b, a)) if a != b and p not in barred}
        assert len(mine) == r.missing and all(round(score[p], 9) == round(r.score, 9) for p in mine)
        assert not mine & got
        got |= mine
    assert got == few and len(few) > 800
    counts = {r.eid: r.missing for r in causal.missing_causal_counts(e, edges).collect()}
    assert counts == Counter(a for a, _ in want)


def test_causal_queries_do_not_list_the_pairs_of_one_shared_description(spark):
    # unique names and one description: as many sets of tokens as entities, one class
    n = 20_000
    e = spark.range(n).selectExpr("id AS eid", "concat('n', id) AS name", "'t' AS type", "map('d', '甲乙丙丁') AS attributes")
    edges = spark.range(n - 1).selectExpr("id AS rid", "'r' AS name", "concat('n', id) AS source", "concat('n', id + 1) AS target")
    profiles, classes = causal._token_classes(causal._few_causal(e, R.CAUSAL_WORDS, causal.tx.tokens))
    assert profiles.count() == n and classes.count() == 1
    counts = causal.missing_causal_counts(e, edges).groupBy("missing").count().collect()
    assert {tuple(r) for r in counts} == {(n - 2, n - 1), (n - 1, 1)}
    assert causal.linked_causal_pairs(e, edges).count() == n - 1
    assert causal.causal_members(e).filter("eid = profile").count() == n


def test_triangles(spark):
    links = random_links(13, 10, 30)
    und = {frozenset(x) for x in links if x[0] != x[1]}
    nodes = sorted({n for x in und for n in x})
    want = {t for t in itertools.combinations(nodes, 3) if all(frozenset(p) in und for p in itertools.combinations(t, 2))}
    e = edge_table(spark, links).withColumn("doc_id", F.lit(1))
    assert {(r.a, r.b, r.c) for r in pairs.triangles(e).collect()} == want


def test_near_pairs_of_one_large_document(spark):
    n = 50_000
    rows = spark.range(n).selectExpr(
        "1 AS doc_id", "id AS seq", "cast(id AS string) AS name", "if(id % 2 = 0, 'Person', 'Organization') AS type", "cast(id * 3 + 1 AS int) AS pos", f"{3 * n} AS len"
    )
    sizes = [r[1] for r in pairs.near_pairs(rows, 0.4195).groupBy(F.spark_partition_id()).count().collect()]
    # 0.3 (1 - d / len) + 0.2 * 0.6 > 0.4195 for places d / 3 apart
    reach = [k for k in range(1, n, 2) if 0.3 * (1 - 3 * k / (3 * n)) + 0.12 > 0.4195]
    assert sum(sizes) == sum(n - k for k in reach)
    assert len(sizes) > 1 and max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]


@pytest.mark.parametrize("compat,cell_rows", [(False, 256), (True, 256), (False, 2)])
def test_near_pairs_finds_every_pair(spark, monkeypatch, compat, cell_rows):
    monkeypatch.setattr(pairs, "CELL_ROWS", cell_rows)
    rnd = random.Random(14)
    names = [chr(0x4E00 + 7 * i) * 2 for i in range(30)]
    types = [rnd.choice(["Person", "Organization", "Location", "Product", "Other"]) for _ in names]
    order = rnd.sample(names, 28)
    text = "".join(n + "。" * rnd.randint(0, 9) for n in order)
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    ents = spark.createDataFrame([(1, i, n, t) for i, (n, t) in enumerate(zip(names, types))], "doc_id bigint, seq int, name string, type string")
    sim = {(a, b): s for a, b, s in R.TYPE_SIMILARITY if not (compat and a > b)}
    want = set()
    for i, j in itertools.combinations(range(30), 2):
        p, q = text.find(names[i]), text.find(names[j])
        s = sim.get((types[i], types[j]), sim.get((types[j], types[i]), 0.1))
        if p >= 0 and q >= 0 and (1 - abs(p - q) / len(text)) * 0.3 + s * 0.2 > 0.3:
            want.add((names[i], names[j]))
    got = {(r.entity1, r.entity2) for r in pairs.near_pairs(entity_mentions(ents, docs), 0.3, compat).collect()}
    assert got == want
    with pytest.raises(ValueError):
        pairs.near_pairs(entity_mentions(ents, docs), 0.01)


def test_detail_example(spark):
    docs = spark.createDataFrame([(1, "张三在北京大学")], "doc_id bigint, text string")
    ents = spark.createDataFrame([(1, 0, "张三", "Person"), (1, 1, "北京大学", "Organization")], "doc_id bigint, seq int, name string, type string")
    edges = spark.createDataFrame([(1, 0, "张三", "在", "北京大学")], "doc_id bigint, rid int, source string, relation string, target string")
    m = entity_mentions(ents, docs)
    for compat, strength in ((False, 1.091429), (True, 0.991429)):
        r = pairs.pair_associations(m, edges, compat=compat).first()
        assert round(r.strength, 6) == strength and r.association_types == ["直接关系", "高频共现"] and round(r.cooccurrence, 6) == 0.571429
    attributes = {(r.entity, r.attribute): r.value for r in detail.entity_attributes(m, edges).collect()}
    assert attributes[("张三", "地址")] == "北京大学"


def sample_graph(spark):
    entities = spark.createDataFrame(
        [(0, "用户登录", "流程", {"描述": "用户输入用户名和密码进行登录"}), (1, "身份验证", "服务", {"描述": "验证用户身份的服务"}),
         (2, "用户数据库", "数据源", {"描述": "存储用户信息的数据库"})],
        "eid bigint, name string, type string, attributes map<string,string>")
    edges = spark.createDataFrame([(0, "调用", "用户登录", "身份验证"), (1, "查询", "身份验证", "用户数据库")], "rid bigint, name string, source string, target string")
    return entities, edges


def test_global_analysis_example(spark):
    a = GlobalAnalysis(*sample_graph(spark))
    rows = a.findings().collect()
    by = {}
    for r in rows:
        by.setdefault(r.type, []).append(r)
    assert {r.entity for r in by["root_node"]} == {"用户登录"} and {r.entity for r in by["leaf_node"]} == {"用户数据库"}
    assert [r.entity for r in by["process_node"]] == ["身份验证"]
    assert by["process_node"][0].description == "身份验证 可能是流程中的处理节点"
    assert [r.entity for r in sorted(by["dependency_order"], key=lambda r: r.value)] == ["用户登录", "身份验证", "用户数据库"]
    gap = by["missing_direct_relation"][0]
    assert (gap.entity, gap.other, gap.value, gap.description) == ("用户登录", "用户数据库", 3.0, "身份验证")
    assert not {"category_group", "circular_dependency", "existing_causal_relation", "no_topological_order"} & set(by)
    assert {r.type for r in a.recommendations().collect()} <= {"similar_entity_relation", "add_logical_relation"}


def test_result_does_not_depend_on_partitioning(spark):
    links = random_links(15, 20, 60)
    one, many = edge_table(spark, links).coalesce(1), edge_table(spark, links).repartition(7)
    for fn in (graph.collapse_directed, components.strongly_connected_components, graph.directed_degrees):
        assert sorted(map(repr, fn(one).collect())) == sorted(map(repr, fn(many).collect()))


def test_hub_with_a_third_of_all_edges(spark):
    links = [("hub", f"a{i:03d}") for i in range(150)] + [(f"a{i:03d}", f"a{(i + 1) % 300:03d}") for i in range(300)]
    links += [("a007", "hub")]
    got = components.strongly_connected_components(edge_table(spark, links)).collect()
    assert len(got) == 301 and {r.component for r in got} == {"a000"} and {r.size for r in got} == {301}


def test_joins_over_all_documents_build_no_table_in_the_driver(spark):
    docs = spark.range(50).selectExpr("id AS doc_id", "'张伟担任经理' AS text")
    e = docs.selectExpr("doc_id", "inline(array(named_struct('seq', 0, 'name', '张伟', 'type', 'Person'), named_struct('seq', 1, 'name', '经理', 'type', 'Other')))")
    links = docs.selectExpr("doc_id", "1L AS rid", "'张伟' AS source", "'担任' AS relation", "'经理' AS target")
    mentions = entity_mentions(e, docs)
    found = detail.entity_attributes(mentions, links)
    allowed = spark.createDataFrame([("经理", "甲公司")], "profession string, employer string")
    for df in (found, detail.attribute_gaps(e, found), detail.rule_errors(e, found), pairs.triangles(links), pairs.direct_evidence(e, links)):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    # rows without a profession or an employer do not all go to one task
    assert detail.rule_errors(e, found, allowed).count() == 0


def test_mentions_are_stored_as_a_table(spark):
    docs = spark.createDataFrame([(1, "ann met bob")], "doc_id bigint, text string")
    entities = spark.createDataFrame([(1, 0, "ann", "Person"), (1, 1, "bob", "Person")], "doc_id bigint, seq int, name string, type string")
    kept = stored_mentions(entities, docs)
    assert kept.inputFiles() and sorted((r.name, r.pos) for r in kept.collect()) == [("ann", 1), ("bob", 9)]


def test_pairs_are_numbered_where_they_stand(spark, monkeypatch):
    pairs = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "c"), ("d", None), (None, "a"), ("", "d")]
    df = spark.createDataFrame(pairs, "source string, target string")
    whole = {p for p in pairs if None not in p}
    nodes, links = components.numbered(df)
    assert "Join" not in links._jdf.queryExecution().optimizedPlan().toString()
    for hashed in (True, False):
        if not hashed:
            # all names share a hash
            monkeypatch.setattr(components, "_number", lambda name: F.lit(5).cast("bigint"))
            nodes, links = components.numbered(df)
        names = {r.node: r["name"] for r in nodes.collect()}
        assert len(names) == 6 and set(names.values()) == {"a", "b", "c", "d", "", None}
        found = [(names[r.source], names[r.target]) for r in links.collect()]
        assert len(found) == len(whole) and set(found) == whole


def test_leading_tokens_that_cannot_reach_the_threshold_are_no_candidates(spark):
    # a rare token each and two of a group of 30: cosines of about 0.2, though the rest at a group's token is above 0.3
    e = entity_table(spark, [f"id{i} g{i % 5}a g{i % 5}b" for i in range(150)])
    unique, _ = keywords.profiles(keywords.entity_tokens(e))
    vectors = keywords.unit_vectors(unique, 150)
    assert max(r.n for r in block_pairs.leading_counts(vectors, 0.3).collect()) == 1
    assert "MapInArrow" not in keywords.similar_profiles(unique, 150)._jdf.queryExecution().executedPlan().toString()
    assert keywords.similar_profiles(unique, 150).isEmpty()
    assert keywords.similar_profiles(unique, 150, 0.15).count() == 5 * 30 * 29 // 2


def test_global_analysis_writes_its_tables_once(spark):
    e, links = entity_table(spark, ["a", "b", "c"]), edge_table(spark, [("a", "b"), ("a", "b"), ("b", "c")])
    found = GlobalAnalysis(e, links)
    for table in ("entities", "edges", "bags"):
        assert getattr(found, table).inputFiles() and getattr(found, table) is getattr(found, table)
    assert sorted((r.source, r.target, r.rid) for r in found.edges.collect()) == [("a", "b", 1), ("b", "c", 2)]


def test_pairs_of_a_document_meet_in_its_row(spark, monkeypatch):
    rnd = random.Random(23)
    types = ["Person", "Organization", "Location", "Product", "Other"]
    mentions, links = [], []
    for d in range(12):
        # names and places that repeat, places that are not found, numbers that repeat
        for i in range(rnd.randint(1, 9)):
            mentions.append((d, rnd.randrange(7), f"n{rnd.randrange(6)}", rnd.choice([*types, None]), rnd.choice([0, *range(1, 40)]), 40, "near"))
        links += [(d, r, f"n{rnd.randrange(7)}", "r", f"n{rnd.randrange(7)}") for r in range(rnd.randint(0, 6))]
    # one document with two texts, one without a length, and rows of no document
    mentions += [(20, 0, "a", "Person", 1, 10, ""), (20, 1, "b", "Person", 2, 90, ""), (21, 0, "a", "Person", 1, None, ""), (21, 1, "b", "Person", 2, None, "")]
    mentions += [(None, 0, "a", "Person", 1, 10, ""), (None, 1, "b", "Person", 2, 10, "")]
    m = spark.createDataFrame(mentions, "doc_id bigint, seq int, name string, type string, pos int, len int, near string")
    edges = spark.createDataFrame(links + [(20, 0, "a", "r", "b"), (None, 0, "a", "r", "b")], "doc_id bigint, rid int, source string, relation string, target string")

    def shown():
        return [Counter(map(str, df.collect())) for df in (pairs.pair_associations(m, edges), pairs.pair_associations(m, edges, 0.32, True), pairs.near_pairs(m))]

    rows, rest = pairs._by_size(m)
    assert rows.count() == 12 and {r.doc_id for r in rest.collect()} == {20, 21}
    in_rows = shown()
    assert all(in_rows)
    # every document by joins
    monkeypatch.setattr(pairs, "CELL_ROWS", 0.5)
    assert pairs._by_size(m)[0].isEmpty() and shown() == in_rows


def static_broadcasts(df):
    """Joins that the plan broadcasts by an estimate, before anything has run."""
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


def test_large_stored_tables_are_broadcast_by_measured_bytes_only(spark):
    # a file of 2 MB, with the default threshold of 10 MB; the rows have some tens of MB
    made = spark.range(200_000, numPartitions=1).select((F.col("id") % 7).alias("k"), F.xxhash64("id").alias("node"), F.lit("long " * 20).alias("text"))
    rows, few = session.stored(made), session.stored(spark.range(7).withColumnRenamed("id", "k"))
    assert rows.dtypes == made.dtypes and rows.count() == 200_000 and rows.inputFiles()
    assert static_broadcasts(rows.select("k").distinct().join(rows, "k")) == 0
    # a small table still goes to the rows
    met = rows.join(few, "k")
    assert static_broadcasts(met) == 1 and met.count() == 200_000


def test_gap_counts_build_no_entities_in_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_PACKED", 1 << 40)  # as if all stored tables were large
    links = [(f"n{i}", f"n{i // 2}") for i in range(2, 200)]
    entity_table(spark, [f"n{i}" for i in range(1, 200)]).write.parquet(str(tmp_path / "entities"))
    edge_table(spark, links).write.parquet(str(tmp_path / "edges"))
    counts = reach_index.gap_counts(spark.read.parquet(str(tmp_path / "entities")), spark.read.parquet(str(tmp_path / "edges")))
    # numbers of rows by partition are broadcast by a hint
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert static_broadcasts(counts) == plan.count("rightHint=(strategy=broadcast)")
    assert sum(r.gaps for r in counts.collect()) == sum(max((i).bit_length() - 2, 0) for i in range(1, 200))


def test_missing_attributes_become_rows_after_the_join(spark):
    rows = [(1, "ann", "Person"), (1, "ann", "Person"), (1, "bob", "Person"), (1, "x", "Other"), (1, None, "Person"), (2, "ann", "Person"), (2, "acme", "Organization"), (None, "ann", "Person"), (3, "y", None)]
    given = [(1, "ann", "年龄", "9"), (1, "ann", "年龄", "8"), (1, "ann", "年龄", None), (1, "bob", "其他", "z"), (2, "acme", "名称", "acme"), (None, "ann", "年龄", "9"), (1, None, "性别", "x")]
    entities = spark.createDataFrame(rows, "doc_id bigint, name string, type string")
    attributes = spark.createDataFrame(given, "doc_id bigint, entity string, attribute string, value string")
    gaps = detail.attribute_gaps(entities, attributes)
    wanted = list(detail.Templates().wanted())
    have = {g[:3] for g in given if None not in g[:2]}
    expected = Counter((d, n, a, c) for d, n, t in rows for kind, a, c in wanted if kind == t and (d, n, a) not in have)
    assert Counter((r.doc_id, r.entity, r.missing_attribute, r.confidence) for r in gaps.collect()) == expected
    # an entity is shuffled once, not once for each wanted attribute
    plan = gaps._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline(filter") < plan.index("Join LeftOuter")


def test_attributes_are_dealt_once_by_entity(spark):
    docs = spark.range(50).selectExpr("id AS doc_id", "'张伟担任经理' AS text")
    e = docs.selectExpr("doc_id", "inline(array(named_struct('seq', 0, 'name', '张伟', 'type', 'Person'), named_struct('seq', 1, 'name', '经理', 'type', 'Other')))")
    links = docs.selectExpr("doc_id", "1L AS rid", "'张伟' AS source", "'担任' AS relation", "'经理' AS target")
    found = detail.entity_attributes(entity_mentions(e, docs), links)
    exchanges = found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    # texts and entities by document, for names and for patterns; then names, patterns and edges by entity
    assert exchanges == 7
    assert {(r.attribute, r.value) for r in found.collect()} == {("职业", "经理")}
