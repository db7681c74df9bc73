"""Not-modified revisits of web archives, resolved to the full response they refer to.

An as-of join by canonical URL finds the latest earlier full response.  Validators decide whether
the revisit really means that response; permitted headers of the revisit then replace the response's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticework.session import settled

# Header fields that a not-modified response may update (fixed values, lower case).
PERMITTED_HEADERS = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# Query parameters that do not name another resource (fixed values).
TRACKING = ["ref", "gclid", "fbclid"]

def canonical_url(url: Column) -> Column:
    """A URL without fragment, default port, tracking parameters and closing slash, its scheme dropped and host lower-cased, parameters sorted.

    Null stays null; without ``://`` the text counts as it is, up to its fragment.
    """
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    rest = F.regexp_replace(bare, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"(?s)^([^/?]*)", 1)), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("utm_")) & ~F.split(p, "=")[0].isin(TRACKING)))
    parameters = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(host, path, parameters)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit and full response: what each stands for.

    ``records`` has record_id (long), url, captured_at (long, any unit), kind (``response`` or ``revisit``; others and null are left out), etag,
    last_modified (strings) and headers (map of lower-case names); other columns are not read.  Returned: record_id, canonical_url,
    captured_at, kind, referred_id (the latest full response of that URL captured before, or null; ties by record_id),
    outcome and headers.  Outcome: ``full`` for responses; for revisits ``validated`` (an entity tag or, without one on both sides, a
    modification date agrees), ``mismatch`` (it differs), ``unchecked`` (nothing to compare) or ``orphan`` (no earlier response).
    Headers: the response's own; for validated and unchecked revisits the referred response's, replaced by the revisit's permitted ones;
    otherwise the revisit's own.  Rows without URL or time have no earlier response and serve none.  A
    missing map is an empty one.  Repeated rows are answered alike.
    """
    empty = F.create_map().cast("map<string,string>")
    rows = records.filter(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("captured_at").cast("bigint").alias("captured_at"), "kind", "etag", "last_modified",
        F.coalesce(F.col("headers"), empty).alias("headers"))
    rows = settled(rows, "captures")
    # With the square root of all rows as the number of time buckets, neither a hot URL's bucket nor its list of buckets grows large.
    span = rows.agg(F.min("captured_at").alias("low"), F.max("captured_at").alias("high"), F.count(F.lit(1)).alias("n")).first()
    low = span["low"] or 0
    width = max(1, -(-((span["high"] or 0) - low + 1) // max(1, math.isqrt(span["n"]))))
    placed = rows.withColumn("bucket", F.floor((F.col("captured_at") - low) / width))
    dated = placed.filter(F.col("canonical_url").isNotNull() & F.col("captured_at").isNotNull())
    full = F.when(F.col("kind") == "response", F.struct("captured_at", "record_id", "etag", "last_modified", "headers"))

    # The last response of each bucket, carried to the later buckets of its URL.
    lasts = dated.filter(F.col("kind") == "response").groupBy("canonical_url", "bucket").agg(
        F.max_by(F.struct("captured_at", "record_id", "etag", "last_modified", "headers"), F.struct("captured_at", "record_id")).alias("last"))
    seen = dated.select("canonical_url", "bucket").distinct().join(lasts, ["canonical_url", "bucket"], "left")
    carried = seen.withColumn("carried", F.last("last", ignorenulls=True).over(
        Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("canonical_url", "bucket", "carried")
    # Inside a bucket the frame ends before the revisit's own time.
    earlier = F.last(full, ignorenulls=True).over(
        Window.partitionBy("canonical_url", "bucket").orderBy("captured_at", F.when(F.col("kind") == "revisit", 0).otherwise(1), "record_id")
        .rowsBetween(Window.unboundedPreceding, -1))
    found = dated.withColumn("inside", earlier).join(carried, ["canonical_url", "bucket"]).withColumn("found", F.coalesce("inside", "carried")).drop("inside", "carried")
    undated = placed.filter(F.col("canonical_url").isNull() | F.col("captured_at").isNull())
    found = found.unionByName(undated, allowMissingColumns=True)

    tags = F.col("etag").isNotNull() & F.col("found.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("found.last_modified").isNotNull()
    outcome = (F.when(F.col("kind") == "response", "full").when(F.col("found").isNull(), "orphan")
               .when(tags, F.when(_opaque("etag") == _opaque("found.etag"), "validated").otherwise("mismatch"))
               .when(dates, F.when(F.col("last_modified") == F.col("found.last_modified"), "validated").otherwise("mismatch")).otherwise("unchecked"))
    new = F.map_filter("headers", lambda name, _: name.isin(PERMITTED_HEADERS))
    old = F.map_filter("found.headers", lambda name, _: ~F.array_contains(F.map_keys(new), name))
    judged = found.withColumn("outcome", outcome)
    return judged.select(
        "record_id", "canonical_url", "captured_at", "kind", F.when(F.col("kind") == "revisit", F.col("found.record_id")).alias("referred_id"), "outcome",
        F.when(F.col("outcome").isin("validated", "unchecked"), F.map_concat(old, new)).otherwise(F.col("headers")).alias("headers"))


def _opaque(name: str) -> Column:
    """An entity tag without its weakness mark: revisits compare weakly."""
    return F.regexp_replace(F.col(name), "^W/", "")
