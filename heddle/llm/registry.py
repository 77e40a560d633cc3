"""Thin queries over the operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import chat_format, decontaminate, language_id, lm_scoring, mixing, quality, secrets, simhash, surrogates, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """The tokenizer's file; it lies beside the installed package on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of an id as text, modulo; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), piece_model(), budget=4096)


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify_language(docs, fold("doc_id", 5) != 0)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"), fold("doc_id", 10) == 0)


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: A conversation that speaks in control strings, beside those of the table.
HOSTILE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame(HOSTILE, "conv_id long, turn long, role string, text string")
    turns = chat_format.format_turns(rows.unionByName(hostile), piece_model())
    return chat_format.digests(turns, piece_model())


ORACLE_SQL["op5_chat_format"] = r"""
WITH turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped AS (
    SELECT *, regexp_replace(regexp_replace(text, '(\\)', '\1\1', 'g'), '(▁)', '\\_', 'g') AS plain FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length('<s>[ROLE][TEXT]</s>') + length(role) + length(plain)
        + len(regexp_extract_all(plain, '</?s>|\[ROLE\]|\[TEXT\]|<unk>|<pad>|\[/?INST\]|<</?SYS>>'))) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


#: Domains of the labelled table, and their weights in the mixture.
DOMAIN = "concat('quality', quality, '_toxic', toxic)"
TARGETS = {"quality1_toxic0": 0.90, "quality1_toxic1": 0.02, "quality0_toxic0": 0.07, "quality0_toxic1": 0.01}


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.expr(DOMAIN), TARGETS)


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


ORACLE_SQL["op7_quality_rules"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        string_split(coalesce(text, ''), chr(10)) AS l
    FROM documents
), windows AS (
    SELECT rid, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS s FROM d, unnest(range(1, len(w) - 1)) AS t(i)
), repeated AS (
    SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, s) > 1
), covered AS (
    SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY rid
), lines AS (
    SELECT rid, unnest(l) AS x FROM d
), judged AS (
    SELECT rid, x, length(x) - length(replace(x, ' ', '')) AS gaps,
        length(x) - length(translate(x, '|»›•·', '')) AS bars,
        length(x) - length(translate(x, '#*$%&|<>', '')) AS symbols,
        length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS solid,
        length(x) - length(regexp_replace(x, '\p{Lu}', '', 'g')) AS capitals
    FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), passed AS (
    SELECT rid, count(*) - count(DISTINCT x) AS n_dup_lines,
        sum(CASE WHEN (bars >= 3 AND bars * 4 > gaps) OR symbols * 2 > gaps + 1 OR (solid >= 20 AND capitals * 2 > solid)
            OR (gaps < 3 AND NOT regexp_matches(x, '[.!?…:;"''”’»)\]][\x20\x09-\x0D]*\z'))
            OR len(list_filter([PHRASES], lambda b: contains(lower(x), b))) > 0
            THEN 0 ELSE solid END) AS kept_chars
    FROM judged GROUP BY rid
), counts AS (
    SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars
    FROM d LEFT JOIN passed USING (rid) LEFT JOIN covered USING (rid)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(kept_chars AS BIGINT) AS kept_chars,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * kept_chars >= 60 * word_chars AS kept
FROM counts
""".replace("PHRASES", ", ".join("'" + b.replace("'", "''") + "'" for b in quality.BOILERPLATE))


#: In `documents` a source owns its texts, and its texts in one language are a repository.
OWNER, REPOSITORY = "source", "concat_ws('/', source, lang)"


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), F.expr(OWNER), F.expr(REPOSITORY))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: In production the key comes from a vault; a fixed one keeps these results comparable.
SURROGATE_KEY = "heddle-demo-key"


@query
def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.surrogates(table(spark, sf_dir, "documents"), SURROGATE_KEY)
