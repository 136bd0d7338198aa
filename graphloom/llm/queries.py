"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm import embedding_dedup, language_id, line_dedup, mixing, ngram_lm, packing, quality, simhash, suffix_dedup, surrogates, turn_repair, vector_codes, window_dedup
from graphloom.llm.common import documents
from graphloom.llm.registry import query

_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_curve_packing")
def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op2_surrogates")
def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = surrogates.with_surrogates(documents(spark, sf_dir), key="corpus", row=F.struct("doc_id"))
    return replaced.select("row.doc_id", "n_entities", F.array_join("kinds", ",").alias("kinds"), F.col("clean_text").alias("text"))


@query("op3_repeated_windows")
def op3_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = window_dedup.remove_repeated_windows(documents(spark, sf_dir), width=50, row=F.struct("doc_id"))
    return kept.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op4_vector_dedup")
def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.93)


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeated_bytes(documents(spark, sf_dir), length=400, row=F.struct("doc_id"))
    return kept.select("row.doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query(
    "op6_line_dedup",
    f"""
    WITH split AS MATERIALIZED (
        SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
    ), lines AS MATERIALIZED (
        SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
    ), keyed AS MATERIALIZED (
        SELECT doc_id, pos, line, {_LOWER.format(f"trim(line, {_WHITE})")} AS key FROM lines
    ), shared AS (
        SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
    )
    SELECT k.doc_id, count(*) AS n_lines, count(s.key) AS n_dropped,
           sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE s.key IS NULL), '')) AS kept_sha256
    FROM keyed k LEFT JOIN shared s ON k.key = s.key GROUP BY k.doc_id
    """,
)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_shared_lines(documents(spark, sf_dir), min_docs=10, min_chars=1, row=F.struct("doc_id"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_bigram_scores")
def op7_bigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.scored(documents(spark, sf_dir), backoff=0.4, row=F.struct("doc_id")).select("row.doc_id", "n_words", "log_score", "mean_score")


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(documents(spark, sf_dir), max_bits=3, width=3)
    return near.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


_QUALITY_SQL = rf"""
    WITH texts AS MATERIALIZED (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{quality.WORD}') AS words,
               string_split(coalesce(text, ''), chr(10)) AS lines
        FROM documents
    ), windows AS MATERIALIZED (
        SELECT doc_id, pos, words[pos:pos + 4] AS w FROM (
            SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS pos FROM texts WHERE len(words) >= 5
        )
    ), repeated AS (
        SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
    ), spans AS (
        SELECT doc_id, sum(least(5, coalesce(pos - before, 5))) AS n_repeat_words FROM (
            SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM repeated
        ) GROUP BY doc_id
    ), lines AS MATERIALIZED (
        SELECT doc_id, line, len(regexp_extract_all(line, '{quality.WORD}')) AS n,
               length(regexp_replace(line, '[^\p{{L}}]+', '', 'g')) AS letters,
               length(regexp_replace(line, '[^\p{{Lu}}]+', '', 'g')) AS upper,
               len(regexp_extract_all(line, '[0-9]')) AS digits,
               len(regexp_extract_all(line, '{quality.MARK_RUN}')) AS mark_runs,
               len(regexp_extract_all(line, '{quality.SEPARATOR}')) AS separators,
               regexp_matches(line, '{quality.BOILERPLATE}') AS boilerplate
        FROM (SELECT doc_id, unnest(lines) AS line FROM texts)
    ), judged AS (
        SELECT doc_id,
               count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines,
               coalesce(sum(n) FILTER (WHERE n > 0 AND (letters + digits = 0 OR 100 * mark_runs > {quality.MARK_RUN_PERCENT} * n
                   OR (n >= {quality.UPPER_WORDS} AND 100 * upper > {quality.UPPER_PERCENT} * letters)
                   OR 100 * separators > {quality.SEPARATOR_PERCENT} * n
                   OR (n <= {quality.BOILERPLATE_WORDS} AND boilerplate))), 0) AS n_lost_words
        FROM lines GROUP BY doc_id
    ), counted AS (
        SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
               len(regexp_extract_all(text, '{quality.SYMBOLS}')) AS n_symbols, n_dup_lines,
               CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, n_lost_words
        FROM texts JOIN judged USING (doc_id) LEFT JOIN spans USING (doc_id)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed,
           CAST(n_lost_words AS BIGINT) AS n_lost_words,
           NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words)
               AND 100 * n_lost_words <= {quality.LOST_PERCENT} * n_words AS kept
    FROM counted
"""


@query("op8_line_quality", _QUALITY_SQL)
def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(documents(spark, sf_dir), row=F.struct("doc_id"))
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost_words", "kept"
    )


def _cases(name: str, weights: dict[str, int]) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _split_sql(children: str, parents: str) -> str:
    """Shares of children by weight, full children first, as window sums."""
    by = f"PARTITION BY {parents}" if parents else ""
    child = {"": "domain", "domain": "lang", "domain, lang": "source"}[parents]
    upto = f"({by} ORDER BY ceiling * 1.0::DOUBLE / weight, {child} ROWS UNBOUNDED PRECEDING)"
    return f"""
        SELECT * EXCLUDE (left_, weights_left, is_full, open_weights, open_left), CAST(CASE WHEN is_full THEN ceiling ELSE
            open_left * (open_weights - weights_left + weight) // open_weights - open_left * (open_weights - weights_left) // open_weights END AS BIGINT) AS share
        FROM (
            SELECT *, max(CASE WHEN NOT is_full THEN weights_left END) OVER ({by}) AS open_weights,
                   max(CASE WHEN NOT is_full THEN left_ END) OVER ({by}) AS open_left
            FROM (
                SELECT *, ceiling * weights_left <= weight * left_ AS is_full FROM (
                    SELECT *, budget - sum(ceiling) OVER {upto} + ceiling AS left_,
                           sum(weight) OVER ({by}) - sum(weight) OVER {upto} + weight AS weights_left
                    FROM ({children})
                )
            )
        )
    """


_MIX_SQL = rf"""
    WITH sized AS MATERIALIZED (
        SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source,
               [{", ".join(f"'{d}'" for d in mixing.DOMAINS)}][1 + coalesce(try_cast(right(regexp_extract(coalesce(source, ''), '[0-9]+$'), 9) AS INT), 0) % {len(mixing.DOMAINS)}] AS domain,
               len(regexp_extract_all(coalesce(text, ''), '{quality.WORD}')) AS n_tokens
        FROM documents
    ), leaves AS MATERIALIZED (
        SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST({mixing.MAX_EPOCHS} * sum(n_tokens) AS BIGINT) AS ceiling
        FROM sized GROUP BY ALL
    ), domains AS MATERIALIZED (
        {_split_sql(f"SELECT domain, sum(ceiling) AS ceiling, {_cases('domain', mixing.DOMAIN_WEIGHTS)} AS weight, (SELECT sum(n_tokens) FROM leaves) AS budget FROM leaves GROUP BY domain", "")}
    ), langs AS MATERIALIZED (
        {_split_sql(f"SELECT l.domain, lang, sum(l.ceiling) AS ceiling, {_cases('lang', mixing.LANG_WEIGHTS)} AS weight, any_value(d.share) AS budget FROM leaves l JOIN domains d USING (domain) GROUP BY l.domain, lang", "domain")}
    ), plan AS MATERIALIZED (
        SELECT domain, lang, source, share AS leaf_budget, CASE WHEN n_tokens = 0 THEN 0 ELSE share // n_tokens END AS epochs,
               CASE WHEN n_tokens = 0 THEN 0 ELSE share % n_tokens END AS rest
        FROM ({_split_sql("SELECT l.domain, l.lang, source, n_tokens, l.ceiling, 1 AS weight, g.share AS budget FROM leaves l JOIN langs g USING (domain, lang)", "domain, lang")})
    ), placed AS (
        SELECT s.*, leaf_budget, epochs, rest,
               coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('42:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '?'))
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM sized s JOIN plan USING (domain, lang, source)
    )
    SELECT * FROM (
        SELECT doc_id, domain, lang, source, n_tokens, leaf_budget,
               CAST(epochs + CASE WHEN start < rest THEN 1 ELSE 0 END AS BIGINT) AS copies,
               CAST(epochs * n_tokens + least(n_tokens, greatest(rest - start, 0)) AS BIGINT) AS tokens_taken
        FROM placed
    ) WHERE copies > 0
"""


@query("op10_source_mix", _MIX_SQL)
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mixed(documents(spark, sf_dir), budget_percent=100, max_epochs=mixing.MAX_EPOCHS, seed=42, row=F.struct("doc_id"))
    return taken.select("row.doc_id", "domain", "lang", "source", "n_tokens", "leaf_budget", "copies", "tokens_taken")


@query("op11_vector_codes")
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=8, entries=16, rounds=6)
    digest = F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256")
    return vector_codes.with_label_error(codes).select("vec_id", "code", "error", "label_error", digest)


@query("op12_language_id")
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = language_id.train(docs, most=language_id.SAMPLE_DOCS, seed=42)
    return language_id.predicted(docs, net, row=F.struct("doc_id")).select("row.doc_id", "held_out", "lang_pred", "score")


@query("op13_turn_repair")
def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_report(turn_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
