"""A query per operator over its whole table, with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from boxquery.llm import alignment, chat, decontaminate, hard_negatives, language_model, main_text, metric_join, sentencepiece, simhash, token_counts, toxicity, url_rules, warc
from boxquery.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return add


@register("op1_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


WORDS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@register(
    "op2_decontamination",
    f"""
    WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
    b AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM b)),
    dw AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g
           FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM bw))),
    hits AS (SELECT doc_id, item_id, s, k FROM dw JOIN bw USING (k, g)),
    n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
    i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)""",
)
def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judged(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), "contaminated"
    )


ESCAPED = r"length({0}) + length(regexp_replace({0}, '\\|<s>|</s>|\[INST\]|\[/INST\]', chr(1) || '\0', 'g')) - length({0})"
TURN_TABLE = """
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'"""


@register(
    "op3_chat_format",
    f"""
    WITH turns AS ({TURN_TABLE})
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
           CAST(sum(22 + {ESCAPED.format("role")} + {ESCAPED.format("text")}) AS BIGINT) AS formatted_chars
    FROM turns GROUP BY conv_id""",
)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_conversations(told.unionByName(own)))


@register("op4_sentencepiece")
def sentencepiece_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it; a null text has null ids.

    The given vocabulary is one of pair merges, whose scores only rank its pieces: the log scores of the search are
    those of Zipf's law for these ranks.
    """
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sentencepiece.encoded(docs, model, same_col="round_trip")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "score", "ids", "round_trip")


@register("op5_token_counts")
def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register(
    "op7_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    best AS (SELECT h, max(page_id) AS best FROM p GROUP BY h)
    SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)), '') AS payload_digest,
           CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> best THEN best END AS refers_to
    FROM p JOIN best USING (h)""",
)
def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives, root = warc.archive_pages(table(spark, sf_dir, "pages"))
    return warc.read_archives(archives, root)


@register("op6_simhash")
def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components. Trees are searched where their shard is: to broadcast those of all shards would
    send the fingerprints of all documents through the driver."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op8_language_model")
def language_model_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_scores(table(spark, sf_dir, "documents"))


@register(
    "op9_metric_join",
    """
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                         WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE list_dot_product(e, e) > 0),
    links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND len(a.e) = len(b.e)
                           WHERE a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
    reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
    least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
    counted AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN least ON vec_id = least.x LEFT JOIN counted ON vec_id = counted.x""",
)
def metric_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.range_join(table(spark, sf_dir, "embeddings"))


RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
FITS = " ".join(
    f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN {{}}"
    for _, host, path in sorted(RULES, key=lambda rule: -len(rule[1]))
)


@register(
    "op10_url_rules",
    f"""
    WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    s AS (SELECT page_id, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
    SELECT page_id, host, path,
           CASE {FITS.format(*[f"'{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1]))])} END AS rule,
           CASE {FITS.format(*[f"'{v}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1]))])} ELSE 'allow' END AS verdict
    FROM s""",
)
def url_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), RULES)


@register("op12_alignment")
def alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align_documents(table(spark, sf_dir, "documents"), a, b)


@register(
    "op11_hard_negatives",
    """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
               FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
               AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
           id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY rank <= 3""",
)
def hard_negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # rounding down gives a whole number for what is none; such components become null
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(finite(x), F.floor(256 * x).cast("double")))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), whole.alias("embedding"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


# The article of these pages, whose markup is h1, p, b and br, with the references that they use decoded.
DECODED = """replace(replace(replace(replace({}, '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>')"""
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]+"


@register(
    "op13_main_text",
    f"""
    WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS article FROM pages),
    b AS (SELECT page_id, url, list_transform(string_split_regex(replace(replace(article, '<br>', ' '), '<b>', ''), '</?(p|h1)>'),
              lambda x: trim(regexp_replace(regexp_replace({DECODED.format("x")}, '&amp;?', '&', 'g'), '{SPACE}', ' ', 'g'))) AS blocks FROM a),
    t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
    SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t""",
)
def main_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text.main_texts(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
