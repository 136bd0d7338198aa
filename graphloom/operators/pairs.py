"""Associations of entities inside one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom import rules as R
from graphloom.functions import scores
from graphloom.functions.classify import type_similarity
from graphloom.session import compute_once, cut_lineage, merged, stored

_ANY = "*"
# mentions of a document that are kept in one row, and of one cell of a larger document, about
CELL_ROWS = 256


def direct_evidence(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, name1, name2, rid, evidence) for edges between two entities, names in ``seq`` order."""
    pos = entities.select("doc_id", "name", "seq")
    ends = (
        edges.filter("source != target")
        .join(merged(pos.withColumnsRenamed({"name": "source", "seq": "_s"})), ["doc_id", "source"])
        .join(merged(pos.withColumnsRenamed({"name": "target", "seq": "_t"})), ["doc_id", "target"])
    )
    first = F.col("_s") < F.col("_t")
    return ends.select(
        "doc_id",
        F.when(first, F.col("source")).otherwise(F.col("target")).alias("entity1"),
        F.when(first, F.col("target")).otherwise(F.col("source")).alias("entity2"),
        "rid",
        F.concat_ws("-", "source", "relation", "target").alias("evidence"),
    )


def _by_size(positions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents as rows (doc_id, mentions), and the mentions of the documents that are too large for one row.

    A row holds up to ``CELL_ROWS`` mentions, all with the same length of the text.
    """
    sizes = positions.groupBy("doc_id").agg(F.count("*").alias("_n"), F.min("len").alias("_least"), F.max("len").alias("_most"), F.count("len").alias("_known"))
    # few documents, if any; a table, so that joins see its size
    large = stored(sizes.filter((F.col("_n") > CELL_ROWS) | (F.col("_known") < F.col("_n")) | (F.col("_least") != F.col("_most"))).select("doc_id"))
    rest = positions.filter("doc_id IS NOT NULL").join(large, "doc_id", "left_anti")
    rows = rest.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "name", "type", "pos", "len")).alias("_ms"))
    return rows, positions.join(large, "doc_id", "left_semi")


def _levels(threshold: float, compat: bool):
    """Type pairs with a similarity of their own, and the share of a text that pairs of a similarity may stand apart."""
    levels = [(min(a, b), max(a, b), s) for a, b, s in R.TYPE_SIMILARITY if not (compat and a > b)]
    highest = max([R.TYPE_SIMILARITY_DEFAULT, *[s for _, _, s in levels]])
    if threshold < 0.2 * highest:
        raise ValueError(f"threshold must be at least {0.2 * highest:.2f}: below it unrelated pairs pass as well")
    return levels, lambda s: (0.3 + 0.2 * s - threshold) / 0.3


def near_pairs(positions: DataFrame, threshold: float = 0.3, compat: bool = False) -> DataFrame:
    """Entity pairs of a document that can pass ``threshold`` without a direct relation.

    A document of up to ``CELL_ROWS`` mentions is one row, and its mentions meet
    there. Those of larger documents are joined on position, see ``_near_in_cells``.
    """
    _levels(threshold, compat)
    rows, rest = _by_size(positions.filter("pos > 0"))
    names = ("seq", "name", "type", "pos")
    lefts = rows.select("doc_id", "_ms", F.inline("_ms").alias(*[f"{c}1" for c in names], "len"))
    met = lefts.select("doc_id", "len", *[f"{c}1" for c in names], F.inline("_ms").alias(*[f"{c}2" for c in names], "_len"))
    close = met.filter("seq1 < seq2").filter(_near_strength(compat) > threshold)
    close = close.select("doc_id", F.col("name1").alias("entity1"), F.col("name2").alias("entity2"), "type1", "type2", "pos1", "pos2", "len")
    return close.unionByName(_near_in_cells(rest, threshold, compat))


def _near_strength(compat: bool):
    cooc = scores.cooccurrence(F.col("pos1"), F.col("pos2"), F.col("len"))
    return scores.pair_strength(F.lit(False), cooc, type_similarity(F.col("type1"), F.col("type2"), compat))


def _near_in_cells(rows: DataFrame, threshold: float, compat: bool) -> DataFrame:
    """The same pairs, by a sliding join.

    Such a pair has to stand close together: with type similarity s the distance,
    as a share of the text, is below (0.3 + 0.2 s - threshold) / 0.3. So this is
    a sliding join on position: for every similarity level the text is cut into
    cells, and a mention meets those of its own and the following cells up to that
    distance. Pairs further apart are never produced. In a document of many
    mentions the cells are finer, so that one holds about ``CELL_ROWS``: the
    document spreads over as many join keys as it has such parts.
    """
    levels, band = _levels(threshold, compat)
    rows = rows.withColumn("_share", F.col("pos") / F.col("len"))
    # a checkpoint, so that the join can be split at a document that holds many of the rows
    sizes = cut_lineage(rows.groupBy("doc_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > CELL_ROWS))
    rows = rows.join(sizes, "doc_id", "left")
    # every level an entity can take part in: its type's pairs, and the default level
    options = [
        F.when(F.col("type").isin(a, b), F.struct(F.lit(f"{a}|{b}").alias("level"), F.lit(max(band(s), 1e-9)).alias("width")))
        for a, b, s in levels
    ]
    options.append(F.struct(F.lit(_ANY).alias("level"), F.lit(max(band(R.TYPE_SIMILARITY_DEFAULT), 1e-9)).alias("width")))
    keyed = rows.select("*", F.inline(F.array_compact(F.array(*options))))
    keyed = keyed.withColumn("_parts", F.greatest(F.ceil(F.coalesce("_n", F.lit(0)) * F.col("width") / CELL_ROWS), F.lit(1)))
    keyed = keyed.withColumn("_cell", F.floor(F.col("_share") / F.col("width") * F.col("_parts")))
    names = ("seq", "name", "type", "pos")
    left = keyed.withColumn("_cell", F.explode(F.sequence("_cell", F.col("_cell") + F.col("_parts")))).select(
        "doc_id", "level", "_cell", "len", F.struct(*names).alias("a")
    )
    right = keyed.select("doc_id", "level", "_cell", F.struct(*names).alias("b"))
    # from the earlier to the later of two places; of equal places both are in the same cell
    ahead = (F.col("a.pos") < F.col("b.pos")) | ((F.col("a.pos") == F.col("b.pos")) & (F.col("a.seq") < F.col("b.seq")))
    pair_level = F.concat_ws("|", F.least("a.type", "b.type"), F.greatest("a.type", "b.type"))
    named = [f"{a}|{b}" for a, b, _ in levels]
    own_level = F.when(pair_level.isin(*named), pair_level).otherwise(F.lit(_ANY)) if named else F.lit(_ANY)
    met = left.join(merged(right), ["doc_id", "level", "_cell"]).filter(ahead & (F.col("level") == own_level) & (F.col("a.seq") != F.col("b.seq")))
    first = F.col("a.seq") < F.col("b.seq")
    pairs = met.select("doc_id", "len", *[
        F.when(first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).alias(f"{c}{i}") for i, (x, y) in ((1, "ab"), (2, "ba")) for c in names
    ])
    return pairs.filter(_near_strength(compat) > threshold).select(
        "doc_id", F.col("name1").alias("entity1"), F.col("name2").alias("entity2"), "type1", "type2", "pos1", "pos2", "len"
    )


def _evidence_in_rows(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, _direct): for each document the names of its ``direct_evidence`` and how many edges there are."""
    ends = edges.filter("source != target").select("doc_id", "source", "target").join(merged(rows), "doc_id")
    for end, seq in (("source", "_s"), ("target", "_t")):
        own = F.transform(F.filter("_ms", lambda m: m["name"] == F.col(end)), lambda m: m["seq"])
        ends = ends.select("*", F.explode(own).alias(seq))
    first = F.col("_s") < F.col("_t")
    names = F.when(first, F.col("source")).otherwise(F.col("target")).alias("entity1"), F.when(first, F.col("target")).otherwise(F.col("source")).alias("entity2")
    counted = ends.select("doc_id", *names).groupBy("doc_id", "entity1", "entity2").agg(F.count("*").alias("n"))
    # two mentions each: bounded as the mentions are
    return counted.groupBy("doc_id").agg(F.collect_list(F.struct("entity1", "entity2", "n")).alias("_direct"))


def _pairs_in_rows(rows: DataFrame, edges: DataFrame, threshold: float, compat: bool) -> DataFrame:
    """(doc_id, entity1, entity2, n_evidence, types, places): linked pairs and, of the others, those that stand close."""
    names = ("seq", "name", "type", "pos")
    both = rows.join(merged(_evidence_in_rows(rows, edges)), "doc_id", "left")
    lefts = both.select("doc_id", "_ms", "_direct", F.inline("_ms").alias(*[f"{c}1" for c in names], "len"))
    own = F.filter("_direct", lambda e: e["entity1"] == F.col("name1")).alias("_own")
    lefts = lefts.select("doc_id", "_ms", "len", *[f"{c}1" for c in names], own)
    met = lefts.select("doc_id", "len", *[f"{c}1" for c in names], "_own", F.inline("_ms").alias(*[f"{c}2" for c in names], "_len"))
    near = F.expr("seq1 < seq2 AND pos1 > 0 AND pos2 > 0") & (_near_strength(compat) > threshold)
    # few mentions have edges of their own: the others are settled before any list is searched
    met = met.filter((F.size("_own") > 0) | near)
    n = F.when(F.size("_own") > 0, F.get(F.filter("_own", lambda e: e["entity2"] == F.col("name2")), F.lit(0))["n"])
    met = compute_once(met, F.coalesce(n, F.lit(0).cast("bigint")).alias("n_evidence"))
    return met.filter((F.col("n_evidence") > 0) | near).select(
        "doc_id", F.col("name1").alias("entity1"), F.col("name2").alias("entity2"), "n_evidence", "type1", "pos1", "len", "type2", "pos2"
    )


def _pairs_by_joins(mentions: DataFrame, edges: DataFrame, threshold: float, compat: bool) -> DataFrame:
    """The same for documents of any size."""
    on = ["doc_id", "entity1", "entity2"]
    direct = direct_evidence(mentions, edges).groupBy(*on).agg(F.count("*").alias("n_evidence"))
    side = lambda i: mentions.select(
        "doc_id", *[F.col(c).alias(f"{n}{i}") for c, n in (("name", "entity"), ("type", "type"), ("pos", "pos"))],
        *(["len"] if i == 1 else []),
    )
    linked = direct.join(merged(side(1)), ["doc_id", "entity1"]).join(merged(side(2)), ["doc_id", "entity2"])
    close = _near_in_cells(mentions.filter("pos > 0"), threshold, compat).join(merged(direct.select(*on)), on, "left_anti")
    return linked.unionByName(close.withColumn("n_evidence", F.lit(0).cast("bigint")))


def pair_associations(
    mentions: DataFrame, edges: DataFrame, threshold: float = 0.3, compat: bool = False
) -> DataFrame:
    """Entity pairs above ``threshold`` with strength, labels and the number of direct relations.

    ``mentions`` comes from ``entity_mentions``; no text is read here. The
    evidence texts, of which a pair can have any number, are the rows of
    ``direct_evidence``. A document of up to ``CELL_ROWS`` mentions is one row,
    where its edges and pairs meet; only larger ones are joined by name and place.
    """
    on = ["doc_id", "entity1", "entity2"]
    _levels(threshold, compat)
    rows, rest = _by_size(mentions)
    both = _pairs_in_rows(rows, edges, threshold, compat).unionByName(_pairs_by_joins(rest, edges, threshold, compat))
    cooc = scores.cooccurrence(F.col("pos1"), F.col("pos2"), F.col("len"))
    sim = type_similarity(F.col("type1"), F.col("type2"), compat)
    has_direct = F.col("n_evidence") > 0
    labels = F.array_compact(
        F.array(
            F.when(has_direct, F.lit(R.LABEL_DIRECT)),
            F.when(cooc > 0.5, F.lit(R.LABEL_COOCCUR)),
            F.when(sim > 0.7, F.lit(R.LABEL_TYPE)),
        )
    )
    return both.select(
        *on,
        cooc.alias("cooccurrence"),
        sim.alias("type_similarity"),
        scores.pair_strength(has_direct, cooc, sim).alias("strength"),
        labels.alias("association_types"),
        "n_evidence",
    ).filter(F.col("strength") > threshold)


def triangles(edges: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Triangles a < b < c of the undirected edges, per document (an extension).

    Edges point from the less connected end to the better connected one, so a
    node opens wedges only over its better connected neighbours and a hub opens
    hardly any.
    """
    a, b = F.least("source", "target"), F.greatest("source", "target")
    und = edges.filter("source != target").select(*keys, a.alias("a"), b.alias("b")).distinct()
    degree = und.select(*keys, F.explode(F.array("a", "b")).alias("n")).groupBy(*keys, "n").agg(F.count("*").alias("d"))
    both = und.join(merged(degree.withColumnsRenamed({"n": "a", "d": "_da"})), [*keys, "a"]).join(
        merged(degree.withColumnsRenamed({"n": "b", "d": "_db"})), [*keys, "b"]
    )
    up = F.struct("_da", "a") < F.struct("_db", "b")
    oriented = both.select(
        *keys, F.when(up, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("hi")
    )
    x = oriented.withColumnsRenamed({"hi": "x"})
    y = oriented.withColumnsRenamed({"hi": "y"})
    wedges = x.join(merged(y), [*keys, "lo"]).filter("x < y")
    closed = wedges.join(merged(und.withColumnsRenamed({"a": "x", "b": "y"})), [*keys, "x", "y"], "left_semi")
    corner = F.array_sort(F.array("lo", "x", "y"))
    return closed.select(*keys, *[F.get(corner, F.lit(i)).alias(c) for i, c in enumerate(("a", "b", "c"))])
