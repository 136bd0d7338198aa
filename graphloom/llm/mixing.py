"""Mixing sources to target weights with column functions only.

A token budget runs down a tree, domain over language over source. Among the children
of a node it is split by weight; a child that cannot fill its part, even with all
epochs, is filled, and what it leaves goes to its siblings. Since a node's own
ceiling is the sum below it, a shortage reaches the node's siblings, and so the
ancestors' level, only when all its children are full.

A leaf takes whole epochs and a token prefix of one more, in the order of a seeded
hash. The prefix is summed over hash bins first, so only the one bin of a leaf in
which the budget ends is put in order, however many documents the leaf has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.llm.common import row_key, written
from graphloom.llm.quality import WORD

SPACE = r"[\x20\x09-\x0D]"

# hex digits of the seeded hash that make a bin
BIN_DIGITS = 3
LEVELS = ("domain", "lang", "source")
# domains are families of sources: the number at the end of the name, in four parts
DOMAINS = ("web", "books", "news", "forum")
DOMAIN_WEIGHTS = {"web": 4, "books": 3, "news": 3, "forum": 2}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 2}
MAX_EPOCHS = 2


def domain_of(source: Column) -> Column:
    """The family of a source, from the number at its end; without a number the first."""
    number = F.coalesce(F.expr("try_cast(right(regexp_extract(coalesce(source, ''), '[0-9]+$', 0), 9) AS int)"), F.lit(0))
    return F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (number % len(DOMAINS) + 1).cast("int"))


def _weight(name: Column, weights: Mapping[str, int]) -> Column:
    found = F.lit(1)
    for value, weight in weights.items():
        found = F.when(name == value, weight).otherwise(found)
    return found.cast("bigint")


def split_budget(children: DataFrame, parents: Sequence[str], child: str) -> DataFrame:
    """Add ``share``, whole tokens, to rows (parents..., child, ceiling, weight, budget of the parent).

    Children in the order of ceiling per weight: as long as a child's ceiling is
    no more than its part of what is left, it is full. The others split the rest
    by weight, rounded so that the parts add up.
    """
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = siblings.orderBy(F.col("ceiling") * 1.0 / F.col("weight"), child)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = children.select(
        "*",
        (F.col("budget") - F.sum("ceiling").over(upto) + F.col("ceiling")).alias("left"),
        (F.sum("weight").over(siblings) - F.sum("weight").over(upto) + F.col("weight")).alias("weights_left"),
    ).withColumn("full", F.col("ceiling") * F.col("weights_left") <= F.col("weight") * F.col("left"))
    # what is left, and for which weights, at the first child that is not full
    rest = ranked.select(
        "*",
        F.max(F.when(~F.col("full"), F.col("weights_left"))).over(siblings).alias("open_weights"),
        F.max(F.when(~F.col("full"), F.struct("weights_left", "left"))).over(siblings)["left"].alias("open_left"),
    ).withColumn("upto", F.col("open_weights") - F.col("weights_left") + F.col("weight"))
    part = lambda w: F.expr(f"open_left * ({w}) div open_weights")
    return rest.withColumn(
        "share", F.when(F.col("full"), F.col("ceiling")).otherwise(part("upto") - part("upto - weight")).cast("bigint")
    ).drop("left", "weights_left", "full", "open_weights", "open_left", "upto")


def leaf_budgets(leaves: DataFrame, budget: Column, weights: Mapping[str, Mapping[str, int]], max_epochs: int) -> DataFrame:
    """Rows (domain, lang, source, n_tokens, leaf_budget) from leaves (domain, lang, source, n_tokens)."""
    nodes = leaves.withColumn("ceiling", F.col("n_tokens") * max_epochs)
    top = nodes.groupBy("domain").agg(F.sum("ceiling").alias("ceiling"), F.sum("n_tokens").alias("n_tokens"))
    total = Window.partitionBy(F.lit(0))
    top = top.select("domain", "ceiling", F.sum("n_tokens").over(total).alias("n_tokens"), F.sum("ceiling").over(total).alias("most"))
    top = top.withColumn("budget", F.least(F.lit(budget) if not isinstance(budget, Column) else budget, F.col("most")).cast("bigint"))
    top = top.withColumn("weight", _weight(F.col("domain"), weights.get("domain", {})))
    domains = split_budget(top.select("domain", "ceiling", "weight", "budget"), (), "domain").select("domain", F.col("share").alias("budget"))
    langs = nodes.groupBy("domain", "lang").agg(F.sum("ceiling").alias("ceiling")).withColumn("weight", _weight(F.col("lang"), weights.get("lang", {})))
    langs = split_budget(langs.join(domains, "domain"), ("domain",), "lang").select("domain", "lang", F.col("share").alias("budget"))
    sources = nodes.withColumn("weight", _weight(F.col("source"), weights.get("source", {}))).join(langs, ["domain", "lang"])
    return split_budget(sources, ("domain", "lang"), "source").select("domain", "lang", "source", "n_tokens", F.col("share").alias("leaf_budget"))


def mixed(
    docs: DataFrame,
    budget_percent: int = 100,
    weights: Mapping[str, Mapping[str, int]] | None = None,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 42,
    row: Column | None = None,
) -> DataFrame:
    """Rows (row, domain, lang, source, n_tokens, leaf_budget, copies, tokens_taken, last_tokens), one per document taken.

    Tokens are words, runs without ASCII white space. The budget is
    ``budget_percent`` of all tokens, no more than ``max_epochs`` of them.
    ``copies`` counts the epochs that take the document, ``tokens_taken`` its
    tokens in them: in the last epoch of a leaf the last document may give a
    prefix only. ``last_tokens`` is what the last of the copies holds. Null language and source are the names '?'; a null text has no
    tokens and is taken with the epochs that reach it. ``row`` is what to carry,
    by default a struct of all columns. Ties of the seeded hash (repeated ids)
    go by the text; rows with equal id and text are taken together and, where the
    budget ends at them, give equal prefixes.
    """
    weights = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS} if weights is None else weights
    name = lambda c: F.coalesce(F.col(c), F.lit("?"))
    known = [
        F.coalesce(F.col("doc_id").cast("string"), F.lit("?")).alias("id_text"),
        row_key().alias("row_key"),
        domain_of(F.col("source")).alias("domain"),
        name("lang").alias("lang"),
        name("source").alias("source"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("n_tokens"),
    ]
    sizes = written(docs.select(*known), "mix-sizes")
    leaves = sizes.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n_tokens"))
    budgets = leaf_budgets(leaves, F.expr(f"n_tokens * {int(budget_percent)} div 100"), weights, max_epochs)
    per_leaf = budgets.select(
        *LEVELS,
        "leaf_budget",
        F.expr("CASE WHEN n_tokens = 0 THEN 0 ELSE leaf_budget div n_tokens END").alias("epochs"),
        F.expr("CASE WHEN n_tokens = 0 THEN 0 ELSE leaf_budget % n_tokens END").alias("rest"),
    )
    # one row per leaf, read from a file: Spark broadcasts it if the file is small
    per_leaf = written(per_leaf, "mix-leaves")
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("id_text"))).alias("place")
    placed = sizes.join(per_leaf, list(LEVELS)).where("rest > 0").select(*LEVELS, "row_key", "n_tokens", "rest", place)
    placed = placed.withColumn("bin", F.substring("place", 1, BIN_DIGITS))
    bins = placed.groupBy(*LEVELS, "bin", "rest").agg(F.sum("n_tokens").alias("bin_tokens"))
    before = Window.partitionBy(*LEVELS).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("bin_start", F.coalesce(F.sum("bin_tokens").over(before), F.lit(0)).cast("bigint"))
    # the bin of a leaf in which the budget ends
    last = bins.where("bin_start < rest AND bin_start + bin_tokens >= rest").select(*LEVELS, "bin", "bin_start")
    ends = placed.join(last, [*LEVELS, "bin"]).groupBy(*LEVELS, "rest", "bin_start", "place", "row_key")
    ends = ends.agg(F.sum("n_tokens").alias("group_tokens"), F.count("*").alias("group_rows"))
    in_bin = Window.partitionBy(*LEVELS).orderBy("place", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("start", F.col("bin_start") + F.coalesce(F.sum("group_tokens").over(in_bin), F.lit(0)))
    cuts = ends.where("start < rest").groupBy(*LEVELS).agg(
        F.max(F.struct("place", "row_key", "start", "group_tokens", "group_rows")).alias("cut")
    )
    plan = written(per_leaf.join(cuts, list(LEVELS), "left").select(*LEVELS, "leaf_budget", "epochs", "rest", "cut"), "mix-plan")

    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if row is None else row
    all_rows = docs.select(carried.alias("row"), *known).join(plan, list(LEVELS)).select("*", place)
    at = F.struct("place", "row_key")
    end = F.struct(F.col("cut.place"), F.col("cut.row_key"))
    reached = F.coalesce(at <= end, F.lit(False))
    part = F.when(at < end, F.col("n_tokens")).when(
        at == end, F.expr("least(n_tokens, (rest - cut.start) div cut.group_rows)")
    )
    return all_rows.select(
        "row", *LEVELS, "n_tokens", "leaf_budget",
        (F.col("epochs") + reached.cast("bigint")).alias("copies"),
        (F.col("epochs") * F.col("n_tokens") + F.coalesce(part, F.lit(0))).cast("bigint").alias("tokens_taken"),
        F.when(reached, part).otherwise(F.col("n_tokens")).cast("bigint").alias("last_tokens"),
    ).where("copies > 0")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, a row for each epoch that takes one.

    Where the budget ends inside a document, its last copy holds the first words
    that are left of the budget, with the white space before each; a copy of no
    words is no row, unless the document has none.
    """
    taken = mixed(docs, **options)
    copies = taken.select("row", "n_tokens", "last_tokens", "copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    cut = (F.col("copy") == F.col("copies")) & (F.col("last_tokens") < F.col("n_tokens"))
    begun = F.slice(F.regexp_extract_all("row.text", F.lit(rf"{SPACE}*{WORD}"), F.lit(0)), F.lit(1), F.col("last_tokens").cast("int"))
    text = F.when(cut, F.array_join(begun, "")).otherwise(F.col("row.text"))
    kept = copies.where(~cut | (F.col("last_tokens") > 0))
    return kept.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
