"""The registered query of each operator, and SQL where SQL can express it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, contamination, jaccard, language, neighbours, passages, pieces, secrets, token_counts, url_lists
from .common import read_table, ship, tidied

Query = Callable[[SparkSession, str], DataFrame]


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read_table(spark, sf_dir, "documents"))


#: A dated list, as production would load it: list, entry, action, day.
LIST_EVENTS = [
    ("spam", "d:cheap-pills.example.com", "add", "2023-02-01"),
    ("spam", "d:cheap-pills.example.com", "remove", "2023-09-15"),
    ("spam", "d:cheap-pills.example.com", "add", "2024-03-10"),
    ("spam", "d:tionsh.example.net", "add", "2023-11-01"),
    ("spam", "d:tionsh.example.net", "add", "2023-12-01"),
    ("spam", "d:tionsh.example.net", "remove", "2024-06-30"),
    ("adult", "d:blog.tionble.example.com", "add", "2023-05-05"),
    ("adult", "d:thther.example.org", "add", "2024-01-01"),
    ("adult", "d:thther.example.org", "remove", "2024-01-01"),
    ("mirror", "d:m.ththth.example.net", "add", "2022-01-01"),
    ("mirror", "d:www.ththwh.example.org", "add", "2024-07-01"),
    ("mirror", "d:example.org", "add", "2024-09-01"),
    ("mirror", "d:example.org", "remove", "2024-10-01"),
    ("language", "p:ththan.example.net/fr", "add", "2023-01-01"),
    ("language", "p:ththan.example.net/fr", "remove", "2024-02-02"),
    ("language", "p:blog.ththan.example.net/en", "add", "2023-08-08"),
]


def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages holds no fetch time: each page's stands in as 2023-01-01 plus page_id modulo 730 days."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(DATE'2023-01-01', cast(pmod(page_id, 730) as int))").alias("fetched_at"))
    events = spark.createDataFrame(LIST_EVENTS, "list string, entry string, action string, at string").withColumn("at", F.to_date("at"))
    return url_lists.judge(pages, events).withColumn("fetched_at", F.col("fetched_at").cast("string"))


OP5_SQL = r"""
WITH e(list, entry, action, day) AS (VALUES """ + ", ".join(f"('{a}', '{b}', '{c}', DATE '{d}')" for a, b, c, d in LIST_EVENTS) + r"""),
 s AS (SELECT *, lag(action, 1, 'remove') OVER (PARTITION BY list, entry ORDER BY day, action) AS before FROM e),
 v AS (SELECT list, entry, substr(entry, 3) AS name, action, day AS f, lead(day) OVER (PARTITION BY list, entry ORDER BY day, action) AS t FROM s WHERE action <> before),
 p AS MATERIALIZED (SELECT row_number() OVER () AS r, page_id, url, DATE '2023-01-01' + CAST(page_id % 730 AS INTEGER) AS day,
   nullif(regexp_replace(lower(regexp_extract(url, '^(?i:[a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', ''), '') AS host,
   regexp_replace(regexp_extract(url, '^(?i:[a-z][a-z0-9+.-]*)://[^/?#]+(/[^?#]*)?', 1), '/+', '/', 'g') AS path FROM pages),
 m AS (SELECT DISTINCT p.r, v.list FROM p JOIN v ON v.action = 'add' AND v.f <= p.day AND (v.t IS NULL OR v.t > p.day)
   AND (starts_with(v.entry, 'd:') AND (host = v.name OR ends_with(host, '.' || v.name)) OR starts_with(v.entry, 'p:') AND starts_with(host || path || '/', v.name || '/')))
SELECT p.page_id, any_value(p.host) AS host, CAST(p.day AS VARCHAR) AS fetched_at, coalesce(string_agg(m.list, ',' ORDER BY m.list), '') AS lists, count(m.list) AS n_lists
FROM p LEFT JOIN m ON p.r = m.r GROUP BY p.r, p.page_id, p.day
"""


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(read_table(spark, sf_dir, "documents"), with_ids=False)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat_digests(chat.format_chats(rows.unionByName(extra)))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text and the loss mask hold, read back from the operator's output."""
    ship(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 64) for whole in batches for i in range(0, whole.num_rows, 64)):
            out = []
            spans = [[x.values.to_numpy(zero_copy_only=False) for x in b.column(i)] for i in range(2, 5)]
            for text, starts, ends, on in zip(b.column(1).to_pylist(), *spans):
                turns = chat.parse(text)
                all_turns = "".join(f"{role}\n{said}\n" for role, said in turns)
                loss = "".join(chat.unescape(x) for x in chat.covered(text, starts, ends, on.astype(bool)))
                out.append((len(turns), hashlib.sha256(all_turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "token_starts", "token_ends", "loss_mask").mapInArrow(tidied(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
   WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
 r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT p.x, r.c FROM p JOIN r ON p.y = r.vec_id),
 m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id), k AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN m ON e.vec_id = m.vec_id LEFT JOIN k ON e.vec_id = k.x
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM i),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
 r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.x, r.c FROM l JOIN r ON l.y = r.doc_id),
 m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents d JOIN m ON d.doc_id = m.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""


#: What the digests must be, from the rows alone; only formatted_chars depends on the template: its marks, line feeds and escapes.
OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
 t AS (SELECT conv_id, turn, role AS r, text AS x, coalesce(role, '') AS role, coalesce(text, '') AS text, chr(92) AS b FROM c),
 f AS (SELECT *, replace(replace(role, b, b || b), '<|', '<' || b || '|') AS er, replace(replace(text, b, b || b), '<|', '<' || b || '|') AS et FROM t),
 g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST) AS said,
   coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST), '') AS loss,
   CAST(sum(8 + length(replace(er, chr(10), b || 'n')) + 1 + length(et) + 7 + 1) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_embedding_dedup, op2_secret_scan, op3_language_id, op4_substring_dedup, op5_url_lists, op6_jaccard_join, op7_token_counts, op8_sentencepiece, op9_decontamination, op10_chat_format)}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": OP1_SQL, "op5_url_lists": OP5_SQL, "op6_jaccard_join": OP6_SQL, "op9_decontamination": contamination.ORACLE, "op10_chat_format": OP10_SQL}
