"""Line-first cleaning with column functions only.

Every line is judged by itself: punctuation, navigation and boilerplate rules. Failing
lines go, and a document that loses too many of its words by that, or that fails
the base rules on length and repetition, is rejected. All of it is one pass over
the text without a shuffle: arrays inside a row stand for words, lines and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.session import compute_once

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
# words that are a separator of a menu or a trail and nothing else
SEPARATOR = r"(^|[\x20\x09-\x0D])([|»›·•]|>{1,2}|::)($|[\x20\x09-\x0D])"
# a run of marks at the end of a word, as in "buy!!" or "what???"
MARK_RUN = r"[!?#*$%&]{2,}($|[\x20\x09-\x0D])"
BOILERPLATE = (
    r"(?i)(licensed under|creative commons|general public license|all rights reserved|©|copyright \(c\)|privacy policy"
    r"|terms of (use|service)|accept( all)? cookies|enable javascript|log ?in to continue|subscribe to our|lorem ipsum)"
)
BOILERPLATE_WORDS = 40
# shares of a line's words
SEPARATOR_PERCENT = 20
MARK_RUN_PERCENT = 30
# upper-case letters of a line, in percent of its letters, from this many words on
UPPER_PERCENT = 70
UPPER_WORDS = 5
# words that failing lines may take, in percent of the document's
LOST_PERCENT = 50
MIN_WORDS = 10
REPEAT_WINDOW = 5
REPEAT_PERCENT = 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_verdict(line: Column) -> Column:
    """Struct (n_words, reason): the first rule that the line fails, else null. Lines without words pass."""
    n = _count(line, WORD)
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
    reason = (
        F.when(n == 0, F.lit(None).cast("string"))
        .when(letters + _count(line, "[0-9]") == 0, "punctuation")
        .when(100 * _count(line, MARK_RUN) > MARK_RUN_PERCENT * n, "punctuation")
        .when((n >= UPPER_WORDS) & (100 * upper > UPPER_PERCENT * letters), "punctuation")
        .when(100 * _count(line, SEPARATOR) > SEPARATOR_PERCENT * n, "navigation")
        .when((n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE), "boilerplate")
    )
    return F.struct(n.alias("n_words"), reason.alias("reason"))


def repeated_words(windows: Column) -> Column:
    """Words in windows that occur twice or more; ``windows`` holds the hash of each window.

    Sorted (hash, position) pairs have equal windows next to each other, so no
    step compares all pairs of a long document. Documents without a repeat stop
    at the distinct count.
    """
    pairs = F.array_sort(F.transform(windows, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))
    same = lambda s, k, x: F.get(s, k).getField("h") == x.getField("h")
    # one-element arrays bind a computed array to a name
    bound = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    starts = bound(
        pairs,
        lambda s: F.array_sort(
            F.transform(
                F.filter(s, lambda x, k: F.coalesce((k > 0) & same(s, F.greatest(k - 1, F.lit(0)), x), F.lit(False)) | F.coalesce(same(s, k + 1, x), F.lit(False))),
                lambda x: x.getField("at"),
            )
        ),
    )
    steps = bound(
        starts,
        lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.when(k == 0, REPEAT_WINDOW).otherwise(F.least(F.lit(REPEAT_WINDOW), x - F.get(p, F.greatest(k - 1, F.lit(0)))))),
            F.lit(0),
            lambda total, x: total + x,
        ),
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(steps).cast("bigint")


def judged(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """Rows (row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost_words, clean_text, reasons, kept).

    One row per document; ``row`` is what to carry, by default a struct of all
    columns. A null text has no words. ``clean_text`` holds the lines that pass,
    ``reasons`` the rules that others failed. ``kept`` is false for fewer than
    10 words, for more than 20 % of the words in repeated windows of five, and
    where failing lines hold over half of the words.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if row is None else row
    texts = docs.select(carried.alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("judged_text"))
    text = F.col("judged_text")
    parts = compute_once(texts, words_of(text).alias("words"), F.split(text, "\n", -1).alias("lines"))
    n = F.size("words")
    word = lambda i: F.get("words", i)
    last = F.greatest(n - REPEAT_WINDOW, F.lit(0))
    windows = F.when(n < REPEAT_WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[word(i + k) for k in range(REPEAT_WINDOW)]))
    )
    lines = F.transform("lines", lambda x: F.struct(x.alias("line"), line_verdict(x).alias("verdict")))
    seen = compute_once(parts, windows.alias("windows"), lines.alias("verdicts"))
    worded = F.transform(F.filter("verdicts", lambda v: v["verdict"]["n_words"] > 0), lambda v: v["line"])
    failed = F.filter("verdicts", lambda v: v["verdict"]["reason"].isNotNull())
    counted = compute_once(
        seen,
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        _count(text, SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size(worded) - F.size(F.array_distinct(worded))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("windows")).alias("n_repeat_words"),
        F.aggregate(failed, F.lit(0), lambda total, v: total + v["verdict"]["n_words"]).cast("bigint").alias("n_lost_words"),
        F.array_join(
            F.transform(F.filter("verdicts", lambda v: v["verdict"]["reason"].isNull()), lambda v: v["line"]), "\n"
        ).alias("clean_text"),
        F.array_sort(F.array_distinct(F.transform(failed, lambda v: v["verdict"]["reason"]))).alias("reasons"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    lost = 100 * F.col("n_lost_words") > LOST_PERCENT * F.col("n_words")
    return counted.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "n_lost_words", "clean_text", "reasons", (~base & ~lost).alias("kept"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all columns, ``text`` without the lines that fail and ``n_chars``, if there, to match."""
    kept = judged(docs).where("kept")
    changed = {"text": F.col("clean_text")} | ({"n_chars": F.length("clean_text").cast("bigint")} if "n_chars" in docs.columns else {})
    return kept.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
