"""Resolving not-modified revisits of a web archive.

A revisit says that a URL had not changed since an earlier capture. Each one
is joined, as of its time, with the latest earlier full response of the same
canonical URL; its validators are compared with that response's, and the
headers that a 304 may update are merged over the stored ones.

A hot URL may hold any share of the records, so no URL is given to one task:
records are range-partitioned by (URL, time, record), each partition resolves
what it can from its own records, and what a partition lacks at its start
comes from the last response of the partitions before, of which there is one
row each.
"""

from __future__ import annotations

import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .shared import staged

#: Headers that a 304 response may bring up to date (RFC 9110, 15.4.5, and RFC 9111, 3.2).
UPDATABLE = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "warning", "server", "set-cookie")
#: Query parameters that only say where a visitor came from.
TRACKING = re.compile(r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)$", re.I)
#: Records of one partition, at least.
PARTITION_ROWS = 2_000_000


_ESCAPE = re.compile("%([0-9A-Fa-f]{2})")


def _plain(escape: re.Match) -> str:
    c = chr(int(escape[1], 16))
    return c if c.isascii() and (c.isalnum() or c in "-._~") else escape[0].upper()


def canonical_url(url: str | None) -> str | None:
    """Scheme, ``www.``, default port, fragment, tracking parameters and a final slash do
    not tell pages apart; host case does not, and parameters are sorted. In the path, escapes of
    characters that need none are written plainly; others stay, in upper case. Null for null."""
    if url is None:
        return None
    try:
        parts = urlsplit(url.strip())
        port = parts.port
    except ValueError:
        return url.strip()
    if not parts.netloc:
        return url.strip()
    host = (parts.hostname or "").removeprefix("www.")
    if port not in (None, 80, 443):
        host += f":{port}"
    if "@" in parts.netloc:
        host = f"{parts.netloc.rpartition('@')[0]}@{host}"
    path = re.sub(r"/{2,}", "/", _ESCAPE.sub(_plain, parts.path)).rstrip("/") or "/"
    query = "&".join(sorted(p for p in parts.query.split("&") if p and not TRACKING.match(p.split("=", 1)[0])))
    return host + path + ("?" + query if query else "")


@F.pandas_udf(StringType())
def canonical(urls: pd.Series) -> pd.Series:
    return urls.map(canonical_url, na_action="ignore")


def _headers(column: str) -> Column:
    """Headers by lower-case name; of names that differ in case alone the last in order counts."""
    entries = F.array_sort(F.map_entries(F.coalesce(column, F.create_map().cast("map<string,string>"))))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]))


def _weak(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each record: what a reader of the archive should see.

    ``records``: record_id long, url string, ts timestamp or long, status int,
    headers map<string,string>; other columns are not read. Status 304 makes a
    revisit, 200 a full response, anything else neither.

    Returns record_id, canonical_url, ts, kind (``response``, ``revisit``,
    ``other``), base_id (the response a revisit stands for), outcome and
    headers (the merged ones of a resolved revisit, else the record's own):

    - ``full``: not a revisit;
    - ``resolved``: validators agree: both entity tags if both sides have one,
      by weak comparison, else both Last-Modified if both have one;
    - ``unvalidated``: the latest earlier response shares no validator;
    - ``mismatch``: a shared validator differs, so the revisit stands for
      content that the archive lacks;
    - ``missing``: no earlier full response.

    base_id is null for all but ``resolved`` and ``unvalidated``. Earlier means
    a smaller (ts, record_id); rows that repeat both count as one instant and
    see only what is before it. A null URL, time or record_id is no part of any
    history: a response gives nothing, and a revisit is missing.
    """
    spark = records.sparkSession
    rows = records.select("record_id", canonical("url").alias("canonical_url"), "ts", "status", _headers("headers").alias("headers"))
    rows = rows.withColumn("kind", F.when(F.col("status") == 304, "revisit").when(F.col("status") == 200, "response").otherwise("other"))
    placed = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    size = max(1, int(records.count() // PARTITION_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["canonical_url", "ts", "record_id"]
    ordered = rows.repartitionByRange(size, *keys).withColumn("part", F.spark_partition_id())
    stored = staged(ordered, "records")
    full = F.when((F.col("kind") == "response") & placed, F.struct("record_id", "ts", "headers"))
    # Peers of one instant share a row number, so that the frame can stop before them.
    seen = stored.withColumn("at", F.dense_rank().over(Window.partitionBy("part", "canonical_url").orderBy("ts", "record_id")))
    before = Window.partitionBy("part", "canonical_url").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    local = seen.withColumn("base", F.last(full, ignorenulls=True).over(before))
    # What each partition hands on: the last response of its last URL.
    last_url = stored.where(placed).groupBy("part").agg(F.max("canonical_url").alias("u"), F.min("canonical_url").alias("first_u"))
    handed = stored.where(full.isNotNull()).groupBy("part", "canonical_url").agg(F.max_by(F.struct("record_id", "ts", "headers"), F.struct("ts", "record_id")).alias("last"))
    handed = last_url.join(handed, (last_url["part"] == handed["part"]) & (last_url["u"] == handed["canonical_url"]), "left").select(last_url["part"], "u", "first_u", "last")
    # A partition starts with what the latest one before it that knows a response of its first URL handed on.
    gives = handed.where("last is not null").select(F.col("u").alias("carried"), "part", F.lit(1).alias("gives"), "last")
    needs = handed.select(F.col("first_u").alias("carried"), "part", F.lit(0).alias("gives"), F.lit(None).cast(handed.schema["last"].dataType).alias("last"))
    earlier = Window.partitionBy("carried").orderBy("part", "gives").rowsBetween(Window.unboundedPreceding, -1)
    carried = needs.unionByName(gives).withColumn("carry", F.last("last", ignorenulls=True).over(earlier)).where("gives = 0 and carry is not null")
    carried = carried.select(F.col("part").alias("c_part"), F.col("carried").alias("c_url"), "carry")
    joined = local.join(F.broadcast(carried) if size <= 10_000 else carried, (F.col("part") == F.col("c_part")) & (F.col("canonical_url") == F.col("c_url")), "left")
    base = F.when((F.col("kind") == "revisit") & placed, F.coalesce("base", "carry"))
    joined = joined.withColumn("base", base)
    mine, theirs = F.col("headers"), F.col("base.headers")
    tags = [_weak(F.try_element_at(h, F.lit("etag"))) for h in (mine, theirs)]
    dates = [F.try_element_at(h, F.lit("last-modified")) for h in (mine, theirs)]
    both = lambda pair: pair[0].isNotNull() & pair[1].isNotNull()
    outcome = (
        F.when(F.col("kind") != "revisit", "full")
        .when(F.col("base").isNull(), "missing")
        .when(both(tags), F.when(tags[0] == tags[1], "resolved").otherwise("mismatch"))
        .when(both(dates), F.when(dates[0] == dates[1], "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    fresh = F.map_filter(mine, lambda k, v: k.isin(*UPDATABLE))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    out = joined.withColumn("outcome", outcome)
    used = F.col("outcome").isin("resolved", "unvalidated")
    return out.select("record_id", "canonical_url", "ts", "kind", F.when(used, F.col("base.record_id")).alias("base_id"), "outcome", F.when(F.col("outcome") == "resolved", merged).otherwise(mine).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl's record stream from the ``pages`` table, which has neither times nor headers.

    Each page is captured twice, a second apart from page to page: first in
    full (entity tag from its HTML), then, a thousand seconds later, by a
    conditional request. By the first hex digit of the URL's MD5 the second
    capture carries the same tag, a weak form of it, only a date, or another
    tag; and for one digit the first capture was an error.
    """
    digit = F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 1)
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    size = F.length(F.coalesce("html", F.lit(""))).cast("string")
    pair = lambda **x: F.create_map(*[y for k, v in x.items() for y in (F.lit(k.replace("_", "-")), v)])
    second = (
        F.when(digit.isin("0", "1"), pair(ETag=F.concat(F.lit("W/"), tag), Date=F.lit("later")))
        .when(digit == "2", pair(Last_Modified=F.lit("monday"), Expires=F.lit("soon")))
        .when(digit == "3", pair(ETag=F.lit('"changed"')))
        .when(digit == "4", pair(Server=F.lit("cache")))
        .otherwise(pair(ETag=tag, Cache_Control=F.lit("max-age=60"), Content_Length=F.lit("0")))
    )
    first = F.struct((F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("ts"), F.when(digit == "5", 503).otherwise(200).alias("status"), pair(ETag=tag, Last_Modified=F.lit("monday"), Content_Length=size).alias("headers"))
    again = F.struct((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") + 1000).alias("ts"), F.lit(304).alias("status"), second.alias("headers"))
    return pages.select(F.explode(F.array(first, again)).alias("r")).select("r.*")
