"""URL filters as a temporal list join.

Dated list entries (add or remove a host, a domain or an address prefix on a day) become validity
intervals; a capture meets the entries that were active on the day it was fetched.

Intervals: events of one entry are reduced to one state per day (adding wins over removing on the
same day), so a window over an entry holds at most one row per day of history.  The as-of join
runs on (kind, value, time bucket): an interval is repeated for each bucket it touches, so a
capture of a host with a long history meets only that bucket's intervals, and a hot host spreads
over its buckets (the planner's skew join splits what remains).  Distinct (address, day) pairs
are formed before the join.

Defined cases: an address without a host, or null, matches nothing and is not blocked; a capture
without a day matches nothing; events with a null list, kind, value, day or unknown action are
ignored; repeated captures give repeated rows; repeated events count once; hosts compare without
case and without user, port or a closing dot, in list values as in captures; a prefix's empty
segments are left out, and a bare host is a prefix of all its addresses; a host or domain value
with a path, or a value without a host, is ignored; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, free_name, materialize

BUCKET_DAYS = 64
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """Lower-cased host of an absolute address; null without one."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")
    return F.when(host != "", host)


def path_segments(url: Column) -> Column:
    """Non-empty segments of the address's path."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def domains_of(host: Column) -> Column:
    """The host and each of its parents."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def prefixes_of(host: Column, segments: Column, deepest: int) -> Column:
    """Host with the first 0, 1, .. ``deepest`` path segments."""
    n = F.least(F.size(segments), F.lit(deepest))
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.concat_ws("/", host, F.slice(segments, 1, i)))


def entry_value(kind: Column, value: Column) -> Column:
    """A list value under the rules of captures' hosts and segments; null if it can match none."""
    url = F.when(value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), value).otherwise(F.concat(F.lit("x://"), value))
    host, segments = host_of(url), F.transform(path_segments(url), F.lower)
    return F.when(host.isNotNull() & ((kind == "prefix") | (F.size(segments) == 0)), F.concat_ws("/", host, segments))


def intervals(events: DataFrame) -> DataFrame:
    """``list, policy, kind, value, since, until`` (``until`` excluded; null: still valid) from
    ``events (list, policy, kind, value, action, day)``."""
    known = events.where("list is not null and kind in ('host', 'domain', 'prefix') and value is not null and day is not null and action in ('add', 'remove')")
    known = known.withColumn("value", entry_value(F.col("kind"), F.col("value"))).where("value is not null")
    daily = known.groupBy("list", "kind", "value", F.col("day").cast("date").alias("since")).agg(
        F.max(F.col("action") == "add").alias("on"), F.max("policy").alias("policy"))
    order = Window.partitionBy("list", "kind", "value").orderBy("since")
    return (daily.withColumn("until", F.lead("since").over(order)).where("on")
            .select("list", "policy", "kind", "value", "since", "until"))


def judge(captures: DataFrame, events: DataFrame, url_col: str = "url", day_col: str = "fetch_day") -> DataFrame:
    """``captures`` with one more struct column, the last, named ``verdict`` or a free name:
    blocked, matches (number of active entries), rule (the first, as ``list:kind:value``), since
    (the earliest day from which one of them has been active)."""
    valid = materialize(intervals(events), "list-intervals")
    deepest = valid.where("kind = 'prefix'").agg(F.max(F.size(F.split("value", "/")) - 1).alias("d")).first()["d"] or 0
    asked = captures.select(col(captures, url_col).cast("string").alias("url"), col(captures, day_col).cast("date").alias("day")).where("url is not null and day is not null").distinct()
    host, seg = F.col("host"), F.col("segments")
    named = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    keys = F.concat(F.array(named("host")(host)), F.transform(domains_of(host), named("domain")), F.transform(prefixes_of(host, seg, int(deepest)), named("prefix")))
    bucket = lambda d: F.floor(F.unix_date(d) / F.lit(BUCKET_DAYS)).cast("int")
    asked = (asked.withColumn("host", host_of(F.col("url"))).where("host is not null").withColumn("segments", F.transform(path_segments(F.col("url")), F.lower))
             .select("url", "day", bucket(F.col("day")).alias("bucket"), F.explode(keys).alias("k")).select("url", "day", "bucket", "k.*"))
    last = captures.agg(F.max(col(captures, day_col).cast("date")).alias("d")).first()["d"]
    first = captures.agg(F.min(col(captures, day_col).cast("date")).alias("d")).first()["d"]
    from_, to = F.greatest("since", F.lit(first).cast("date")), F.least(F.coalesce(F.date_sub("until", 1), F.lit(last).cast("date")), F.lit(last).cast("date"))
    touched = (valid.where(from_ <= to).withColumn("bucket", F.explode(F.sequence(bucket(from_), bucket(to)))))
    active = asked.join(touched, ["kind", "value", "bucket"]).where((F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    rule = F.concat_ws(":", "list", "kind", "value")
    found = active.groupBy("url", "day").agg(
        (F.max((F.col("policy") == "block").cast("int")) * (1 - F.max((F.col("policy") == "allow").cast("int"))) == 1).alias("blocked"),
        F.count(F.lit(1)).alias("matches"), F.min(rule).alias("rule"), F.min("since").alias("since"))
    row = captures.select(F.struct(*[col(captures, c) for c in captures.columns]).alias("row"), col(captures, url_col).cast("string").alias("url"), col(captures, day_col).cast("date").alias("day"))
    verdict = F.struct(F.coalesce("blocked", F.lit(False)).alias("blocked"), F.coalesce("matches", F.lit(0)).cast("long").alias("matches"), F.col("rule"), F.col("since"))
    return row.join(found, ["url", "day"], "left").select("row.*", verdict.alias(free_name(captures, "verdict")))
