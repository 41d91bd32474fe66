"""The registered query of each operator, and the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.shared import table
from tickloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_groups(spark: SparkSession, sf: str) -> DataFrame:
    from tickloom.llm.simhash import simhash_groups
    return simhash_groups(table(spark, sf, "documents"), width=4, distance=4)


@query
def op2_bottom_k_sketches(spark: SparkSession, sf: str) -> DataFrame:
    from tickloom.llm.sketches import as_text, edited_fingerprints, resemblance
    rows = edited_fingerprints(table(spark, sf, "documents"))
    return rows.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))


@query
def op3_link_trust(spark: SparkSession, sf: str) -> DataFrame:
    from tickloom.llm.hosts import judge_pages
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return judge_pages(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


@query
def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    from tickloom.llm.langid import identify
    return identify(table(spark, sf, "documents").select("doc_id", "text", "lang"))


def vocabulary() -> str:
    """The path of the queries' tokenizer."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query
def op6_sum_of_squares_packing(spark: SparkSession, sf: str) -> DataFrame:
    from tickloom.llm.packing import pack
    pieces = pack(table(spark, sf, "documents"), vocabulary(), window=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op8_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    from tickloom.llm.mixing import mix, words
    sized = table(spark, sf, "documents").select("doc_id", "source", words(F.col("text")).alias("size"))
    return mix(sized, "doc_id", "source", "size").select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op8_source_mix"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 15))::BIGINT AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
      FROM d GROUP BY source),
w AS (SELECT *, source_size * 2e0 AS most, CAST([5, 2, 1][(place - 1) % 3 + 1] AS DOUBLE) AS weight FROM s),
c AS (SELECT *, most / weight AS ratio,
             coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
             sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others
      FROM w),
l AS (SELECT max(level) AS level FROM (
      SELECT ratio, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5e0 - spent) / others AS level FROM c) WHERE level < ratio),
t AS (SELECT source, source_size, least(most, weight * level) AS target FROM w, l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(round(t.target, 6)) AS BIGINT) AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0::BIGINT ELSE CAST(budget // source_size * size
       + greatest(0, least(size, budget % source_size - before)) AS BIGINT) END AS taken
FROM p"""


@query
def op9_chat_prefix_tree(spark: SparkSession, sf: str) -> DataFrame:
    from tickloom.llm.chat import prefix_tree, read_conversations
    marked = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", marked), (-7, 1, "assistant", marked)],
                                  "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    nodes, paths = prefix_tree(turns)
    return read_conversations(nodes, paths).select(
        "conv_id", "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars")


ORACLE["op9_chat_prefix_tree"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(10 + length(role) + length(text) + len(regexp_extract_all(role || chr(10) || text,
           '[<\[]\\*(/?s>|t>|\|[a-z_]+\|>|/?INST\]|/?SYS>>)'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


@query
def op10_token_files(spark: SparkSession, sf: str) -> DataFrame:
    from tickloom.llm.tokenfiles import read_tokens, write_tokens
    path = scratch_path(spark, "token-files")
    write_tokens(table(spark, sf, "documents"), path, vocabulary())
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op5_vector_groups(spark: SparkSession, sf: str) -> DataFrame:
    from tickloom.llm.vectors import vector_groups
    return vector_groups(table(spark, sf, "embeddings").select("vec_id", "embedding"), least=0.9)


ORACLE["op5_vector_groups"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       coalesce(e.vec_id = coalesce(c.component_id, e.vec_id), true) AS kept
FROM embeddings e LEFT JOIN c ON c.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id"""


@query
def op7_visible_text(spark: SparkSession, sf: str) -> DataFrame:
    from tickloom.llm.rendering import visible_text
    pages = table(spark, sf, "pages")
    return pages.select("page_id", visible_text(F.col("html")).alias("text")).withColumn(
        "n_chars", F.length("text").cast("bigint"))


@query
def op13_learned_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    from tickloom.llm.rulelists import judge
    return judge(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels").select("doc_id", "quality"))


@query
def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    from tickloom.llm.variants import spelling_variants
    return spelling_variants(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    from tickloom.llm.repair import damaged_turns, repair_conversations
    return repair_conversations(damaged_turns(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")))
