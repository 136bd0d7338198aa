"""Strongly connected components: trimming, chain contraction and label rounds over changed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.session import stored


def pairs_of(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").distinct()


def _number(name: Column) -> Column:
    return F.xxhash64(name)


def numbered(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, name) and the distinct pairs as node numbers; pairs with a null have none.

    Rounds join and group on 8-byte numbers in place of names. A number is the
    64-bit hash of the name, so the pairs are numbered where they stand and only
    numbers are shuffled. Should two names share a hash, numbers come from running
    ids, whose hashes all differ, and the pairs are joined with them.
    """
    names = pairs.select(F.explode(F.array("source", "target")).alias("name")).distinct()
    nodes = stored(names.select(_number(F.col("name")).alias("node"), "name"))
    if nodes.groupBy("node").count().filter("count > 1").isEmpty():
        hashed = pairs.filter("source is not null and target is not null").select(*[_number(F.col(end)).alias(end) for end in ("source", "target")])
        return nodes, hashed.distinct()
    nodes = stored(nodes.select(F.xxhash64(F.monotonically_increasing_id()).alias("node"), "name"))
    out = pairs.distinct()
    for end in ("source", "target"):
        out = out.join(nodes.select(F.col("name").alias(end), F.col("node").alias(f"_{end}")), end)
    return nodes, out.select(F.col("_source").alias("source"), F.col("_target").alias("target"))


def _degrees(edges: DataFrame) -> DataFrame:
    """(node, o, i): edges that leave and enter a node."""
    ends = F.array(
        F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    return edges.select(F.inline(ends)).groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))


def follow(hops: DataFrame, **carry) -> tuple[DataFrame, DataFrame]:
    """Pointer jumping over hops(node, to, open, ...): the ends of walks, and rows that go round for ever.

    ``open`` tells that ``to`` has a hop of its own. ``carry`` names further
    columns and how a walk combines its own and the next value; ``least``, the
    smallest node met, is always carried. A job doubles all walks twice, so jobs
    grow with the logarithm of the longest one. Only cycles are left once no walk
    ends and no smallest node falls: their windows then all hold the smallest.
    """
    rules = {"least": F.least, **carry}
    state = stored(hops.withColumn("least", F.least("node", "to")).select("node", "to", "open", *rules))
    mark = None
    while True:
        now = state.filter("open").agg(F.count("*").alias("n"), F.sum(F.col("least").cast("decimal(38,0)"))).first()
        if not now.n or now == mark:
            return state.filter("not open"), state.filter("open")
        mark = now
        for _ in range(2):
            ahead = state.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("open").alias("_open"), *[F.col(c).alias(f"_{c}") for c in rules])
            met = state.filter("open").join(ahead, "to").select(
                "node", F.col("_to").alias("to"), F.col("_open").alias("open"), *[join(F.col(c), F.col(f"_{c}")).alias(c) for c, join in rules.items()]
            )
            state = met.unionByName(state.filter("not open"))
        state = stored(state)


def _marked(edges: DataFrame) -> DataFrame:
    """Edges whose ends both have edges in and out, and whether the ends (s, t) have exactly one of each."""
    degrees = _degrees(edges).filter("o > 0 and i > 0").select("node", ((F.col("o") == 1) & (F.col("i") == 1)).alias("inner"))
    for end, mark in (("source", "s"), ("target", "t")):
        edges = edges.join(degrees.withColumnsRenamed({"node": end, "inner": mark}), end)
    return edges


def _contract(marked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Take out the inner nodes of chains: (edges, (node, p, w) rows, (pivot, node) rows of pure rings).

    A node with one edge in and one out lies on a cycle exactly if the ends p and
    w of its chain do, so an edge from p to w stands for the chain. Chains that
    have lost an end in this turn lie on no cycle and find no end.
    """
    hops = marked.filter("s").select(F.col("source").alias("node"), F.col("target").alias("to"), F.col("t").alias("open"), F.col("source").alias("last"))
    ended, ring = follow(hops, last=lambda own, ahead: ahead)
    # a chain is known by its last node; its first one names the other end
    heads = marked.filter("t and not s").select(F.col("source").alias("p"), F.col("target").alias("node"))
    heads = heads.join(ended, "node").select("p", "last", F.col("to").alias("w"))
    bridges = heads.filter("p != w").select(F.col("p").alias("source"), F.col("w").alias("target"))
    left = marked.filter("not s and not t").select("source", "target").unionByName(bridges).distinct()
    bypassed = ended.select("node", "last").join(heads, "last").select("node", "p", "w")
    return left, bypassed, ring.select(F.col("least").alias("pivot"), "node")


class _Shrinking:
    """Edges that can lie on cycles, and what chains and rings have been taken out on the way."""

    def __init__(self):
        self.found: list[DataFrame] = []
        self.bypassed: list[DataFrame] = []

    def shrink(self, edges: DataFrame, size: int, gain: float = 0.1) -> tuple[DataFrame, int]:
        """Trim, and contract where trimming gains little, as long as a turn drops a tenth of the edges; the rest and its size."""
        while True:
            marked = stored(_marked(edges))
            n, inner = marked.agg(F.count("*"), F.count_if("s")).first()
            trimmed, size = n < size * (1 - gain), n
            edges = marked.select("source", "target")
            if trimmed and n:
                continue
            if inner <= n * gain:
                return edges, n
            left, bypassed, ring = _contract(marked)
            self.bypassed.append(bypassed)
            self.found.append(ring)
            edges = stored(left)
            size = edges.count()
            if not size:
                return edges, 0

    def members(self) -> DataFrame | None:
        """(pivot, node) rows of all components, chains put back, the last ones first."""
        if not self.found:
            return None
        found = self.found[0]
        for part in self.found[1:]:
            found = found.unionByName(part)
        found = stored(found)
        for rows in reversed(self.bypassed):
            ends = rows
            for end in ("p", "w"):
                ends = ends.join(found.select(F.col("node").alias(end), F.col("pivot").alias(f"pivot_{end}")), end, "left")
            pivot = F.coalesce("pivot_p", "p")
            met = ends.filter(pivot == F.coalesce("pivot_w", "w")).select(pivot.alias("pivot"), F.explode(F.array("node", "p")).alias("node"))
            found = stored(found.unionByName(met).distinct())
        return found


def strongly_connected_components(edges: DataFrame) -> DataFrame:
    """(component, node, size) rows of the components with more than one node.

    ``component`` is the smallest node name. Nodes that nothing points to, or that
    point nowhere, are trimmed, and chains are contracted by pointer jumping, so
    the rest has branches everywhere. There every node has a random number; a
    round spreads the smallest one forward and backward along the edges to the
    fixpoint. Nodes that received the same one both ways reach its owner and are
    reached from it: they are its component and leave the graph. Edges between
    nodes with different labels lie on no cycle and leave as well. A round splits
    the rest like a random pivot does, so the number of rounds grows with the
    logarithm of the graph.

    Messages are combined with ``min`` before they are shuffled, so a hub costs
    one row per task; every step starts from a checkpoint of the rows it changed.
    """
    nodes, links = numbered(edges.select("source", "target").filter("source != target"))
    way = _Shrinking()
    links = stored(links)
    rest, size = way.shrink(links, links.count())
    while size:
        labels = _spread_labels(rest)
        way.found.append(labels.filter("f = b").select(F.col("f").alias("pivot"), "node"))
        open_ = labels.filter("f != b").select("node", F.struct("f", "b").alias("l"))
        same = (
            rest.join(open_.withColumnsRenamed({"node": "source", "l": "_a"}), "source")
            .join(open_.withColumnsRenamed({"node": "target", "l": "_b"}), "target")
            .filter("_a = _b")
            .select("source", "target")
        )
        same = stored(same)
        rest, size = way.shrink(same, same.count())
    found = way.members()
    if found is None:
        return nodes.limit(0).select(F.col("name").alias("component"), F.col("name").alias("node"), F.lit(0).cast("bigint").alias("size"))
    sizes = found.groupBy("pivot").agg(F.count("*").alias("size")).filter("size > 1")
    members = found.join(sizes, "pivot").join(nodes, "node")
    first = members.groupBy("pivot").agg(F.min("name").alias("component"))
    return members.join(first, "pivot").select("component", F.col("name").alias("node"), "size")


# steps after which nodes look up the labels of the nodes they have heard of, and changed rows are merged into the state
_LOOK_UP = 4


def _spread_labels(edges: DataFrame) -> DataFrame:
    """(node, f, b): the smallest node among those that reach a node, and among those it reaches.

    Labels only fall, so a node's label is the least of all rows written for it. A
    step sends the rows that changed along the edges and writes what fell. Every
    few steps the rows written are merged, and each node looks up the labels of the
    nodes that it has heard of, which doubles the way a label has gone.
    """
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    base = changed = stored(nodes.select("node", F.col("node").alias("f"), F.col("node").alias("b")))
    none = F.lit(None).cast("bigint")
    late: list[DataFrame] = []
    while True:
        ahead = edges.join(changed.select(F.col("node").alias("source"), "f"), "source").select(F.col("target").alias("node"), F.col("f").alias("new_f"), none.alias("new_b"))
        back = edges.join(changed.select(F.col("node").alias("target"), "b"), "target").select(F.col("source").alias("node"), none.alias("new_f"), F.col("b").alias("new_b"))
        news = ahead.unionByName(back)
        # rows written since the last merge stand beside the news of their node: one exchange for both
        every = news.select("*", none.alias("f"), none.alias("b"))
        for rows in late:
            every = every.unionByName(rows.select("node", none.alias("new_f"), none.alias("new_b"), "f", "b"))
        heard = every.groupBy("node").agg(*[F.min(c).alias(c) for c in ("new_f", "new_b")], F.min("f").alias("late_f"), F.min("b").alias("late_b"))
        known = heard.join(base, "node").select("node", "new_f", "new_b", F.least("f", "late_f").alias("f"), F.least("b", "late_b").alias("b"))
        fell = known.filter("new_f < f or new_b < b").select("node", F.least("f", "new_f").alias("f"), F.least("b", "new_b").alias("b"))
        changed = stored(fell)
        if changed.isEmpty():
            return _merged(base, late)
        late.append(changed)
        if len(late) == _LOOK_UP:
            base, changed, late = _looked_up(stored(_merged(base, late)), changed)


def _merged(base: DataFrame, late: list[DataFrame]) -> DataFrame:
    for rows in late:
        base = base.unionByName(rows)
    return base.groupBy("node").agg(F.min("f").alias("f"), F.min("b").alias("b")) if late else base


def _looked_up(base: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Labels of the labels: a node takes what the node it has heard of knows; what fell counts as changed too."""
    far = base
    for c in ("f", "b"):
        far = far.join(base.select(F.col("node").alias(c), F.col(c).alias(f"far_{c}")), c)
    fell = stored(far.filter("far_f < f or far_b < b").select("node", F.col("far_f").alias("f"), F.col("far_b").alias("b")))
    return base, _merged(changed, [fell]), [fell]
