"""Benchmark decontamination by winnowing, in DataFrame operations only.

A word is `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. Benchmark windows have `window`
words. Of the k-word hashes, the minimum of every run of window - k + 1 positions is kept, on both
sides; equal windows have equal minima, so every shared window shares a kept hash. Training
fingerprints meet the benchmark's in a join (the benchmark's side is broadcast only if its counted
size allows; beyond that, slices of 21 words are shuffled with the fingerprints), and each meeting
is extended word by word to both sides, which decides it exactly. Items with fewer than `window`
words are one window of their own length; for each such length that occurs, all runs of that many
words are looked up.

With a broadcast, a position is first looked up and then tested for being a minimum (the order of
the two doesn't change what stays). Only meetings and one row for each document are shuffled, and grouping is by document, so that a frequent passage
is no hot key.

Defined results: a null text has no words, no hits; items with null or empty text have no windows;
an item without an id counts in hits but is not listed; each row of the documents gives one row,
rows that repeat id and text too; an empty table on either side gives an
empty result or no hits; other columns are ignored. Whole texts of any length are used.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_or_whole, write_table

# What separates words, as the contract states it.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, K = 13, 5

#: A document among the working columns: its id, and a hash of its text.
KEY = ("doc_key", "text_key")


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # in plain ASCII lower() changes A-Z alone, and is faster
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def run_hash(words: Column, at: Column, length: int) -> Column:
    """Hash of the `length` words from position `at` on; null if they aren't all there."""
    return F.when((at >= 0) & (at + length <= F.size(words)), F.xxhash64(*(F.get(words, at + j) for j in range(length))))


def around(words: Column, at: Column, before: int, length: int) -> Column:
    """Up to `before` words in front of position `at` and `length` from it on."""
    start = F.greatest(at - before, F.lit(0))
    return F.slice(words, start + 1, at - start + length)


def unbroken(conditions: list[Column]) -> Column:
    """How many conditions hold before the first that doesn't."""
    first = F.array_position(F.array(*(F.coalesce(c, F.lit(False)) for c in conditions)), False)
    return F.when(first == 0, F.lit(len(conditions))).otherwise(first - 1).cast("int")


def winnowed(rows: DataFrame, words: str, at: str, window: int, k: int, also: Column | None = None) -> DataFrame:
    """Rows whose hash fp, of the k words at `at`, is the minimum of a window, that is of window - k + 1 positions in a row; and those of `also`."""
    reach = window - k
    no_less = lambda i: run_hash(F.col(words), F.col(at) + i, k) >= F.col("fp")
    left, right = unbroken([no_less(-i) for i in range(1, reach + 1)]), unbroken([no_less(i) for i in range(1, reach + 1)])
    return rows.withColumn("_left", left).withColumn("_right", right).where((F.col("_left") + F.col("_right") >= reach) | (F.lit(False) if also is None else also)).drop("_left", "_right")


def positions(rows: DataFrame, window: int, k: int) -> DataFrame:
    """A row for each k-word run of each text of at least `window` words: p and fp; and one with p = -1 for the text itself."""
    last = F.when(F.col("n") >= window, F.col("n") - k).otherwise(-1)
    rows = rows.withColumn("p", F.explode(F.sequence(F.lit(-1), last, F.lit(1))))
    return rows.withColumn("fp", F.when(F.col("p") >= 0, F.xxhash64(*(F.get("words", F.col("p") + j) for j in range(k)))))


def cut(rows: DataFrame, window: int, k: int, to: str) -> DataFrame:
    """The words around p in place of all words, and p's place among them.

    They come out of a generator, as nothing that filters on them later is then evaluated before rows are dropped.
    """
    reach = window - k
    words = F.when(F.col("p") >= 0, around(F.col("words"), F.col("p"), reach, window))
    both = F.array(F.struct(words.alias(f"{to}_words"), F.least(F.col("p"), F.lit(reach)).alias(f"{to}_at")))
    return rows.select(*(c for c in rows.columns if c != "words"), F.inline(both))


def fingerprints(items: DataFrame, window: int, k: int) -> DataFrame:
    """Each kept hash of each item: fp, item_id, the words around, and its place among them."""
    rows = cut(positions(items, window, k).where("p >= 0"), window, k, "item")
    return winnowed(rows, "item_words", "item_at", window, k).select("fp", "item_id", "item_words", "item_at").distinct()


def extended(rows: DataFrame, window: int, k: int) -> DataFrame:
    """Meetings grown to both sides; those of at least `window` equal words stay, as word positions start to end.

    The documents' own rows (p = -1) pass, with their number of words.
    """
    reach, own = window - k, F.col("p") < 0
    same = lambda i: F.get("doc_words", F.col("doc_at") + i) == F.get("item_words", F.col("item_at") + i)
    grown = rows.withColumn("same", unbroken([same(i) for i in range(k)]))
    grown = grown.withColumn("left", unbroken([same(-i) for i in range(1, reach + 1)])).withColumn("right", unbroken([same(i) for i in range(k, window)]))
    grown = grown.where(own | ((F.col("same") == k) & (F.col("left") + F.col("right") + k >= window)))
    start, end = F.col("p") - F.col("left"), F.col("p") + k - 1 + F.col("right")
    return grown.select(*KEY, F.when(own, F.col("n")).alias("n"), *(F.when(~own, c).alias(name) for c, name in ((F.col("item_id"), "item_id"), (start, "start"), (end, "end"))))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, broadcast_bytes: int | None = None, with_text_key: bool = False) -> DataFrame:
    """Each document's id, n_words, n_hit (words inside shared windows), n_items, digest of the items, and contaminated.

    with_text_key adds text_key, a hash of the text, which tells apart rows that repeat an id.
    """
    bench = items.select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("words")).withColumn("n", F.size("words"))
    index = write_table(fingerprints(bench, window, k), "fingerprints")
    limits = {} if broadcast_bytes is None else {"limit": broadcast_bytes}
    side = small_or_whole(index, 64 + 16 * (2 * window - k), **limits)

    d = docs.select(F.col(id_col).alias("doc_key"), F.xxhash64(text_col).alias("text_key"), words_of(F.col(text_col)).alias("words"))
    d = d.withColumn("n", F.size("words"))
    own, rows = F.col("p") < 0, positions(d, window, k)
    if side is index:  # too large for a broadcast: only fingerprints are shuffled, with the words around them
        met = winnowed(cut(rows, window, k, "doc"), "doc_words", "doc_at", window, k, also=own).join(side, "fp", "left").where(own | F.col("item_words").isNotNull())
    else:  # a lookup is cheaper than the test for a minimum, so the join comes first
        met = cut(rows.join(side, "fp", "left").where(own | F.col("item_words").isNotNull()), window, k, "doc")
        met = winnowed(met, "doc_words", "doc_at", window, k, also=own)
    hits = extended(met, window, k)
    for length in sorted(r["n"] for r in bench.where((F.col("n") > 0) & (F.col("n") < window)).select("n").distinct().collect()):
        short = positions(bench.where(F.col("n") == length), length, length).where("p = 0").select("fp", "item_id", F.col("words").alias("item_words")).distinct()
        runs = positions(d, length, length).where("p >= 0")
        runs = runs.select(*KEY, "p", "fp", F.slice("words", F.col("p") + 1, length).alias("doc_words"))
        found = runs.join(small_or_whole(short, 64 + 16 * length, **limits), "fp").where("doc_words = item_words")
        hits = hits.unionByName(found.select(*KEY, F.lit(None).cast("int").alias("n"), "item_id", F.col("p").alias("start"), (F.col("p") + length - 1).alias("end")))
    span = F.when(F.col("start").isNotNull(), F.struct("start", "end"))
    # n is there in a document's own rows only: one, or more if rows repeat id and text
    by_doc = hits.groupBy(*KEY).agg(F.max("n").alias("n"), F.count("n").alias("_times"), F.collect_set(span).alias("runs"), F.collect_set("item_id").alias("items"))
    covered = F.aggregate(
        F.array_sort("runs"),
        F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n")),
        lambda acc, r: F.struct(F.greatest(acc["end"], r["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"] - 1, acc["end"]))).alias("n")),
        lambda acc: acc["n"].cast("long"),
    )
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    counted = by_doc.select(F.col("doc_key").alias(id_col), "text_key", "_times", F.col("n").cast("long").alias("n_words"), covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"))
    names = [id_col, *["text_key"] * with_text_key, "n_words", "n_hit", "n_items", "items_sha256"]
    out = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*names)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs, same columns, without the contaminated ones."""
    found = decontaminate(docs, items, id_col, text_col, item_id, item_text, with_text_key=True)
    gone = write_table(found.where("contaminated").select(F.col(id_col).alias("_id"), "text_key").distinct(), "contaminated")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("text_key"))
    return docs.join(small_or_whole(gone, 24), same, "left_anti")


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
 b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
 bi AS (SELECT item_id, w, least(len(w), 13) AS l, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0),
 bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM bi),
 ls AS (SELECT DISTINCT l FROM bw),
 di AS (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l),
 dw AS (SELECT r, l, i, array_to_string(w[i:i + l - 1], ' ') AS g FROM di),
 h AS (SELECT r, item_id, i, l FROM dw JOIN bw USING (l, g)),
 p AS (SELECT DISTINCT r, unnest(range(i, i + l)) AS p FROM h),
 n AS (SELECT r, count(*) AS n_hit FROM p GROUP BY r),
 t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN t ON d.r = t.r
"""
