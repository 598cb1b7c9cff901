"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.llm import (
    alignment, chat, decontaminate, forest, language, lemp, mixture, private, quality, recompression, suffixes, template,
    tokens,
)
from parity.llm.registry import query, table

BLANK_SET = "[^\\x20\\x09-\\x0D]+"


@query(
    "op10_quality_rules",
    f"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT k, doc_id, text, regexp_extract_all(text, '{BLANK_SET}') AS ws,
                 list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{BLANK_SET}')) AS ls FROM d),
    g AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
          FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
    r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS c FROM g) WHERE c > 1),
    n AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY k),
    m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                 length(regexp_replace(text, '\\P{{L}}', '', 'g')) AS n_letters,
                 len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                 len(list_filter(ls, lambda l: regexp_matches(l, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')))
                   AS n_ellipsis_lines,
                 coalesce(n.n, 0) AS n_repeat_words
          FROM w LEFT JOIN n USING (k))
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
           CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
           CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
           (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
                OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 3 * n_words OR word_chars > 12 * n_words
                OR 2 * n_letters < word_chars OR 10 * n_ellipsis_lines > 3 * n_lines) AS kept
    FROM m
    """,
)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policies(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("kept_base")).alias("base_failed"),
        F.col("kept_v2").alias("kept"),
    )


ITEM_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op9_benchmark_decontamination",
    f"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({LOW}, '{ITEM_WORD}') AS ws
               FROM documents),
    b AS (SELECT item_id, ws, least(len(ws), 10) AS n
          FROM (SELECT item_id, regexp_extract_all({LOW}, '{ITEM_WORD}') AS ws FROM benchmark) WHERE len(ws) > 0),
    g AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS gram
          FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM b)),
    s AS (SELECT k, n, i, array_to_string(ws[i:i + n - 1], ' ') AS gram
          FROM (SELECT k, ws, n, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS i
                FROM d, (SELECT DISTINCT n FROM g))),
    h AS (SELECT k, i, n, item_id FROM s JOIN g USING (n, gram)),
    c AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM h) GROUP BY k),
    t AS (SELECT k, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
          FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY k)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)
    """,
)
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op7_token_ids")
def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


@query("op4_personal_data")
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = private.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        "spans",
    )


@query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forest.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_class")


@query("op8_source_mixture")
def op8_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixture.report(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return rows.select(F.col("id").alias("doc_id"), "n_tokens", "topic", "ratio", "probability", "sampled")


@query("op2_html_extraction")
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = template.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recompression.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffixes.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.aligned(docs, tokenizer_path(), piece_model_path())[0]


@query(
    "op11_hard_negatives",
    """
    WITH v AS (SELECT row_number() OVER () AS k, vec_id,
                      CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.k AS anchor, a.vec_id AS anchor_id, b.k, b.vec_id, a.label = b.label AS same,
                 CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
          FROM v a JOIN v b ON a.k <> b.k WHERE a.vec_id % 50 = 0),
    p AS (SELECT * FROM (SELECT anchor, anchor_id, k AS positive, vec_id AS positive_id, score AS positive_score,
                                row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, k) AS n
                         FROM s WHERE same) WHERE n <= 5),
    n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                 row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.vec_id, s.k) AS rank
          FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same
            AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
    FROM n WHERE rank <= 3
    """,
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return lemp.mined(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


#: A conversation whose texts imitate the marks of the template.
TRICKY = "\\### Assistant: </turn> ok"


def longer(text: str) -> str:
    """SQL: the characters that escaping adds to a text."""
    return f"""(length({text}) - length(replace({text}, chr(92), ''))
                + (length({text}) - length(replace({text}, '</turn>', ''))) // 7
                + length(array_to_string(regexp_extract_all({text}, '#{{3,}}'), '')))"""


@query(
    "op12_chat_format",
    f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'),
    t AS (SELECT *, 4 + length(role) + {longer("role")} + length(role) - length(replace(role, ':', '')) + 2
                    + length(text) + {longer("text")} + 8 AS chars FROM c)
    SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
           CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
           CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id
    """,
)
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], rows.schema)
    log = chat.log_of_turns(rows.unionByName(planted), "conv_id", "turn", "role", "text")
    segments = chat.formatted(log, "conv_id", ["turn", "h", "row"], "place", "kind", "role", "text")
    return chat.read_back(chat.written(segments)).withColumnRenamed("conv", "conv_id")
