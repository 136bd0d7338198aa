"""Verbs, keywords and keyword similarity of entities(eid, name, type, attributes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from graphloom import rules as R
from graphloom.functions import scores, text as tx
from graphloom.functions.text import strings
from graphloom.operators.block_pairs import block_pairs, leading_counts
from graphloom.session import compute_once, stored

# rows of a token that one part of the similarity join holds of its left side
TOKEN_ROWS = 4096
# all pairs are scored if those that share a leading token, repeats counted, are more than one in so many
DENSE = 8


def entity_tokens(entities: DataFrame, tokenizer=tx.tokens) -> DataFrame:
    """(eid, name, tokens): the tokens of the name and the attribute values, repeats kept."""
    return entities.select("eid", "name", tokenizer(tx.entity_text(F.col("name"), F.col("attributes"))).alias("tokens"))


def token_rows(bags: DataFrame) -> DataFrame:
    return bags.select("eid", F.posexplode("tokens").alias("pos", "token"))


# --- verbs ----------------------------------------------------------------

def lexicon_tagger(verbs=R.VERBS):
    """The verbs among tokens, by a word list."""
    return lambda tokens: F.array_intersect(tokens, strings(verbs))


def entity_verbs(bags: DataFrame, verbs=R.VERBS, tagger=None) -> DataFrame:
    """(eid, name, verb) for the verbs among the tokens.

    ``tagger`` is a function from the column of tokens to the array of verbs among
    them, for instance a pandas UDF; by default the verb lexicon decides.
    """
    tagger = tagger or lexicon_tagger(verbs)
    return bags.select("eid", "name", F.explode(tagger(F.col("tokens"))).alias("verb"))


def missing_verbs(bags: DataFrame, verbs=R.VERBS, tagger=None) -> DataFrame:
    """Entities without any verb among their tokens. Map-only."""
    tagger = tagger or lexicon_tagger(verbs)
    return bags.filter(F.size(tagger(F.col("tokens"))) == 0).select("eid", "name")


def inferred_verbs(entities: DataFrame, edges: DataFrame, verbs=R.VERBS) -> DataFrame:
    """(name, verb) rows: lexicon verbs inside the names of an entity's outgoing edges."""
    hits = tx.keep_present(*[F.when(F.col("_rel").contains(v), F.lit(v)) for v in verbs])
    found = edges.select(F.col("source"), F.col("name").alias("_rel")).withColumn("verb", F.explode(hits))
    return found.select(F.col("source").alias("name"), "verb").distinct().join(entities.select("name"), "name", "left_semi")


# --- frequencies ----------------------------------------------------------

def keyword_counts(bags: DataFrame) -> DataFrame:
    return bags.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def top_keywords(counts: DataFrame, k: int = 20) -> DataFrame:
    return counts.orderBy(F.desc("n"), "token").limit(k)


# --- similarity -----------------------------------------------------------

def profiles(bags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with the same bag of tokens, folded into one profile.

    First table: (profile, members, tokens), where ``profile`` is the smallest
    ``eid`` of the group. Second table: (eid, profile). Copies would all score
    1 against each other; folding them keeps that result in one row. Bags are
    grouped by a 256-bit hash, so no task holds the tokens of its groups, and
    move once, in order and as text.
    """
    sorted_text = F.to_json(F.array_sort("tokens"))
    keyed = bags.select("eid", F.unhex(F.sha2(sorted_text, 256)).alias("_key"))
    groups = keyed.groupBy("_key").agg(F.min("eid").alias("profile"), F.count("*").alias("members"))
    firsts = groups.select(F.col("profile").alias("eid"), "members")
    unique = bags.select("eid", sorted_text.alias("_bag")).join(firsts, "eid").select(
        F.col("eid").alias("profile"), "members", F.from_json("_bag", "array<string>").alias("tokens")
    )
    return unique, keyed.select("eid", "_key").join(groups.select("_key", "profile"), "_key").select("eid", "profile")


def token_weights(unique: DataFrame, n_entities: int, keep=()) -> DataFrame:
    """(profile, token, n, len, frequency, weight): TF-IDF with the collection frequency.

    A token more frequent than there are entities gets a negative weight, as in
    the published formula; products of two weights of a token stay positive.
    Tokens are counted inside the sorted bag, so single tokens are shuffled once.
    """
    bags = (
        unique.select("profile", "members", F.size("tokens").alias("len"), "tokens")
        .filter("len > 0")
        .groupBy("profile", "members", "len")
        .agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("_all"))
    )
    at = lambda i: F.get("_all", i)
    places = F.sequence(F.lit(0), F.size("_all") - 1)
    starts = F.filter(places, lambda i: (i == 0) | ~at(i).eqNullSafe(at(F.greatest(i - 1, F.lit(0)))))
    counted = F.transform("_starts", lambda i, k: F.struct(at(i).alias("token"), (F.coalesce(F.get("_starts", k + 1), F.size("_all")) - i).cast("bigint").alias("n")))
    terms = compute_once(bags, starts.alias("_starts")).select("profile", "members", "len", F.inline(counted))
    frequency = terms.groupBy("token").agg(F.sum(F.col("n") * F.col("members")).alias("frequency"))
    return terms.join(frequency, "token").select(
        "profile",
        "token",
        "n",
        "len",
        "frequency",
        (F.col("n") / F.col("len") * scores.inverse_frequency(n_entities, F.col("frequency"))).alias("weight"),
        *keep,
    )


def unit_vectors(unique: DataFrame, n_entities: int) -> DataFrame:
    """(profile, tokens, n, len, frequencies, norm, w, bags): the tokens of a profile, their weights of length 1, and its bags.

    ``bags`` holds (members, tokens); tokens are null if they are those of the
    vector. Profiles without any weight are left out.
    """
    entry = F.struct("token", "frequency", F.col("n").cast("int").alias("n"), "len", "members")
    listed = token_weights(unique, n_entities, keep=("members",)).groupBy("profile").agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    weights = F.transform("_e", lambda e: e["n"] / e["len"] * scores.inverse_frequency(n_entities, e["frequency"]))
    weighed = compute_once(listed, weights.alias("_w"))
    normed = compute_once(weighed, F.sqrt(F.aggregate("_w", F.lit(0.0), lambda total, w: total + w * w)).alias("norm")).filter("norm > 0")
    # ids that repeat, with equal or other bags: few, if any
    bag = F.struct("members", F.array_sort(F.array_distinct("tokens")).alias("tokens"))
    several = unique.groupBy("profile").agg(F.collect_list(bag).alias("_bags")).filter(F.size("_bags") > 1)
    plain = F.array(F.struct(F.get("_e", F.lit(0))["members"].alias("members"), F.lit(None).cast("array<string>").alias("tokens")))
    field = lambda name: F.transform("_e", lambda e: e[name])
    return normed.join(several, "profile", "left").select(
        "profile",
        field("token").alias("tokens"),
        field("n").alias("n"),
        field("len").alias("len"),
        field("frequency").alias("frequencies"),
        "norm",
        F.transform("_w", lambda w: w / F.col("norm")).alias("w"),
        F.coalesce("_bags", plain).alias("bags"),
    )


def similar_profiles(unique: DataFrame, n_entities: int, min_score: float = 0.3, common: bool = True) -> DataFrame:
    """Profile pairs with cosine above ``min_score``, and one row for the copies inside a profile.

    Exact. With tokens in order of rising frequency, two vectors above the
    threshold share a token before either vector's rest falls under it, and the
    product of the two rests is not below it. Where few pairs share such a
    leading token, only they are scored, see
    ``_leading_pairs``; where they are a good part of all pairs, every two
    blocks of vectors are multiplied, which moves a vector once for each block.
    ``common=False`` leaves the common keywords null.
    """
    if min_score <= 0:
        raise ValueError("min_score must be positive")
    vectors = stored(unit_vectors(unique, n_entities))
    n = vectors.count()
    slack = min_score * (1 - 1e-9)
    met = leading_counts(vectors, slack).agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
    if met * DENSE > float(n) * n:
        across = block_pairs(vectors, n, n_entities, min_score, common)
    else:
        across = _leading_pairs(vectors, min_score)
    listed = vectors.select("profile", "tokens", F.inline("bags").alias("members", "_own"))
    tokens = F.array_sort(F.array_distinct(F.coalesce("_own", "tokens")))
    inside = listed.filter("members > 1").select(
        F.col("profile").alias("profile1"),
        F.col("profile").alias("profile2"),
        F.lit(1.0).alias("score"),
        (F.col("members") * (F.col("members") - 1) / 2).cast("bigint").alias("pairs"),
        tokens.alias("common_keywords"),
    )
    return across.unionByName(inside)


def _leading_pairs(vectors: DataFrame, min_score: float) -> DataFrame:
    """Pairs that share a leading token, scored on their full vectors.

    A shared token counts only if the two rests, bounded by their lengths, can
    still reach the threshold, so a row that cannot even with the token's longest
    rest is left out before the join. A token of many profiles is joined in parts
    of about ``TOKEN_ROWS`` left rows.
    """
    terms = vectors.select("profile", F.inline(F.arrays_zip("tokens", "frequencies", "w"))).withColumnsRenamed({"tokens": "token", "frequencies": "frequency"})
    unit = terms.filter("w != 0").select("profile", "token", "frequency", "w")
    rest = Window.partitionBy("profile").orderBy("frequency", "token").rowsBetween(0, Window.unboundedFollowing)
    slack = min_score * (1 - 1e-9)
    lead = unit.withColumn("rest", F.sqrt(F.sum(F.col("w") * F.col("w")).over(rest))).filter(F.col("rest") >= slack)
    lead = lead.join(lead.groupBy("token").agg(F.max("rest").alias("_longest")), "token").filter(F.col("rest") * F.col("_longest") >= slack)
    n_parts = F.ceil(F.count("*") / F.lit(TOKEN_ROWS))
    lead = lead.join(lead.groupBy("token").agg(n_parts.alias("parts")), "token")
    x = lead.select("token", F.pmod(F.xxhash64("profile"), "parts").alias("part"), F.col("profile").alias("p1"), F.col("rest").alias("r1"))
    y = lead.select("token", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.col("profile").alias("p2"), F.col("rest").alias("r2"))
    candidates = (
        x.join(y, ["token", "part"]).filter((F.col("p1") < F.col("p2")) & (F.col("r1") * F.col("r2") >= slack)).select("p1", "p2").distinct()
    )
    w1 = unit.select(F.col("profile").alias("p1"), "token", F.col("w").alias("w1"))
    w2 = unit.select(F.col("profile").alias("p2"), "token", F.col("w").alias("w2"))
    scored = (
        candidates.join(w1, "p1")
        .join(w2, ["p2", "token"])
        .groupBy("p1", "p2")
        .agg(F.sum(F.col("w1") * F.col("w2")).alias("score"))
        .filter(F.col("score") > min_score)
    )
    bags = vectors.select("profile", "tokens", F.inline("bags").alias("members", "_own")).select("profile", "members", F.coalesce("_own", "tokens").alias("tokens"))
    one = bags.withColumnsRenamed({"profile": "p1", "members": "_m1", "tokens": "_b1"})
    two = bags.withColumnsRenamed({"profile": "p2", "members": "_m2", "tokens": "_b2"})
    return scored.join(one, "p1").join(two, "p2").select(
        F.col("p1").alias("profile1"),
        F.col("p2").alias("profile2"),
        "score",
        (F.col("_m1") * F.col("_m2")).alias("pairs"),
        F.array_sort(F.array_intersect("_b1", "_b2")).alias("common_keywords"),
    )


def similar_entities(entities: DataFrame, min_score: float = 0.3, tokenizer=tx.tokens, common: bool = True) -> DataFrame:
    """Similar entities by keyword TF-IDF; see ``similar_profiles`` for the form of the result."""
    return similar_entities_and_members(entities, min_score, tokenizer, common)[0]


def similar_entities_and_members(entities: DataFrame, min_score: float = 0.3, tokenizer=tx.tokens, common: bool = True) -> tuple[DataFrame, DataFrame]:
    """The similar profiles, and the rows (eid, profile) that name the members of each."""
    unique, members = profiles(entity_tokens(entities, tokenizer))
    return similar_profiles(unique, entities.count(), min_score, common), members
