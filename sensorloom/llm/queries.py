"""The operators as named queries over the given tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorloom.llm.chat import SLICE_TURNS, format_chats
from sensorloom.llm.common import table
from sensorloom.llm.decontaminate import contaminated
from sensorloom.llm.exact_dedup import exact_duplicates
from sensorloom.llm.hard_negatives import hard_negatives
from sensorloom.llm.jaccard_join import near_duplicates
from sensorloom.llm.line_dedup import cut_repeats
from sensorloom.llm.packing import pack
from sensorloom.llm.prefix_trie import conversation_trie
from sensorloom.llm.private_data import personal_data
from sensorloom.llm.quality import grade_documents
from sensorloom.llm.sharding import shard_documents
from sensorloom.llm.url_filter import judge_urls
from sensorloom.llm.token_files import read_tokens, write_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query(
    "op8_exact_dedup",
    """
    WITH n AS (
      SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM n""",
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op6_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, parts = write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))
    return read_tokens(folder, parts)


@query("op5_shards")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents", "doc_id", "text"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op4_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))


@query(
    "op2_chat_format",
    f"""
    WITH t AS (
      SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
    r AS (
      SELECT *, row_number() OVER w AS j, count(*) OVER (PARTITION BY conv_id) AS n,
             string_agg(md5(role || chr(10) || text), '') OVER w AS prefix
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
    kept AS (
      SELECT min(conv_id) AS conv_id FROM r
      WHERE j = n AND prefix NOT IN (SELECT prefix FROM r WHERE j < n) GROUP BY prefix)
    SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn // {SLICE_TURNS}) - 1 AS INTEGER) AS part,
           CAST(count(*) AS INTEGER) AS turns,
           string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS text
    FROM t JOIN kept USING (conv_id) GROUP BY conv_id, turn // {SLICE_TURNS}""",
)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


@query("op3_url_filter")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


@query("op9_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return grade_documents(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


@query("op1_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


@query("op10_jaccard_join")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op7_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select(
        "doc_id",
        "text",
        F.col("__words").alias("n_words"),
        F.col("__removed").alias("removed_words"),
        F.col("__runs").alias("removed_runs"),
    )


@query(
    "op11_prefix_trie",
    """
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    own AS (
      SELECT *, md5(length(role) || ':' || role || text) AS hash,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS j
      FROM t),
    steps AS (
      SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS crc),
    c AS (
      SELECT conv_id,
             xor(4294967295, list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
               lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM own), steps),
    both_ AS (
      SELECT c.conv_id, 0 AS side, j, hash, text FROM c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 AND j <= h
      UNION ALL
      SELECT c.conv_id, 1, j, hash, text FROM c JOIN own o ON o.conv_id = c.conv_id AND j > h),
    r AS (
      SELECT conv_id, row_number() OVER w AS depth, string_agg(hash, '') OVER w AS prefix, length(text) AS n
      FROM both_ WINDOW w AS (PARTITION BY conv_id ORDER BY side, j ROWS UNBOUNDED PRECEDING)
      UNION ALL SELECT conv_id, 0, '', 0 FROM c),
    ends AS (SELECT prefix, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (
               SELECT conv_id, arg_max(prefix, depth) AS prefix FROM r GROUP BY conv_id) GROUP BY prefix),
    nodes AS (
      SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(n) AS saved FROM r GROUP BY prefix, depth),
    children AS (
      SELECT left(prefix, 32 * (depth - 1)) AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
    below AS (
      SELECT a.prefix, sum(v.saved) AS saved_tokens, count(*) FILTER (WHERE k.prefix IS NULL) AS n_leaves
      FROM nodes v JOIN r a ON a.conv_id = v.conv_id AND a.depth <= v.depth LEFT JOIN children k ON k.prefix = v.prefix
      GROUP BY a.prefix)
    SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n_children, 0) AS n_children,
           b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
    FROM nodes v JOIN below b USING (prefix) LEFT JOIN children k ON k.prefix = v.prefix LEFT JOIN ends e ON e.prefix = v.prefix
    LEFT JOIN nodes p ON p.prefix = left(v.prefix, 32 * (v.depth - 1)) AND v.depth > 0""",
)
def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


@query(
    "op12_hard_negatives",
    """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
      FROM v a, v b WHERE a.vec_id % 100 = 0),
    p AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5""",
)
def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


@query("op13_personal_data")
def private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))
