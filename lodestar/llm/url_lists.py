"""Temporal URL lists: dated entries become validity intervals, captures are judged as of their fetch time.

Events (list, entry, action, at) add an entry to a list or remove it. An entry is a domain
(`d:example.com`, which covers its subdomains) or a path prefix (`p:example.com/a`, which covers the
host's paths below it). Events in order of time give half-open intervals [valid_from, valid_to); at
one instant removals come last. Each entry's intervals meet in one sorted array, so that a capture's
key meets one row for each entry and the latest interval that began by the fetch time decides.

The entries' side is broadcast only if its counted size allows; otherwise it is a shuffle join by
key, in which a frequent host can be split, as the other side has one row for each key.

Defined results: a null or unparsable URL has no host and is on no list; a null fetch time is on no
list; events with a null list, entry or time, or an unknown action, are ignored, as are repeated ones; each
capture gives one row, those that repeat id, URL and time too; an empty table gives an empty result; other columns are
ignored. URLs of any length are used as a whole; `most_segments` bounds the path prefixes looked up
to the longest in the list, which loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_or_whole, write_table

# The parts of a URL, as text; user info and port are not part of the host.
URL = r"^(?i:[a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(/[^?#]*)?"


def host_of(url: Column) -> Column:
    """Lower-cased host without a final dot; null if there is none."""
    h = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1)), r"\.$", "")
    return F.when(h != "", h)


def intervals(events: DataFrame) -> DataFrame:
    """(list, entry, valid_from, valid_to): when each entry was on each list; valid_to is null if it still is."""
    e = events.where("list is not null and entry is not null and at is not null and action in ('add', 'remove')").select("list", "entry", "at", "action").distinct()
    by_entry = Window.partitionBy("list", "entry").orderBy("at", "action")
    e = e.withColumn("before", F.lag("action").over(by_entry)).where("action <> coalesce(before, 'remove')")
    e = e.withColumn("valid_to", F.lead("at").over(by_entry)).where("action = 'add' and (valid_to is null or valid_to > at)")
    return e.select("list", "entry", F.col("at").alias("valid_from"), "valid_to")


def keys_of(host: Column, url: Column, most_segments: int) -> Column:
    """Every entry that could cover a URL: its host and parent domains, and its path's prefixes."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    path = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2), "/"), lambda x: x != "")
    n = F.least(F.size(path), F.lit(most_segments))
    prefixes = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(path, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.concat(domains, prefixes)).otherwise(F.array().cast("array<string>"))


def judge(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Each capture's id, host, fetch time, the lists it was on then (sorted, comma-joined) and their number."""
    spans = write_table(intervals(events), "intervals")
    depth = spans.agg(F.coalesce(F.max(F.size(F.split("entry", "/")) - 1), F.lit(0))).first()[0]
    by_list = spans.groupBy("entry", "list").agg(F.array_sort(F.collect_list(F.struct("valid_from", "valid_to"))).alias("valid"))
    by_entry = write_table(by_list.groupBy(F.col("entry").alias("key")).agg(F.collect_list(F.struct("list", "valid")).alias("lists")), "entries")
    c = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("at")).withColumn("host", host_of(F.col("url")))
    # the null key is the row of the capture itself
    c = c.withColumn("key", F.explode(F.concat(keys_of(F.col("host"), F.col("url"), depth), F.array(F.lit(None).cast("string")))))
    met = c.join(small_or_whole(by_entry, 64), "key", "left").where("key is null or lists is not null")

    def active(entry: Column) -> Column:
        latest = F.element_at(F.filter(entry["valid"], lambda v: v["valid_from"] <= F.col("at")), -1)
        return F.coalesce(latest.isNotNull() & (latest["valid_to"].isNull() | (latest["valid_to"] > F.col("at"))), F.lit(False))

    on = F.transform(F.filter("lists", lambda x: F.when(F.exists(x["valid"], lambda v: v["valid_from"] <= F.col("at")), active(x)).otherwise(F.lit(False))), lambda x: x["list"])
    met = met.select("id", "url", "at", "host", F.when(F.col("lists").isNotNull(), on).alias("on"))
    # a capture's own row (the null key) is there once for each time that the capture is
    met = met.withColumn("_own", F.col("on").isNull())
    out = met.groupBy("id", "url", "at").agg(F.max("host").alias("host"), F.count_if("_own").alias("_times"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("on")))).alias("on"))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return out.select(F.col("id").alias(id_col), "host", F.col("at").alias(time_col), F.array_join("on", ",").alias("lists"), F.size("on").cast("long").alias("n_lists"))
