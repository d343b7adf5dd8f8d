"""Revisit records of web archives: an as-of join to the latest earlier full response of the same canonical URL.

Captures have record_id, url, ts, kind ('response' or 'revisit'), etag, last_modified, digest and headers (a map). A revisit says "not modified": what
it stands for is the latest full response with a smaller ts; of several at that ts the one with the largest id. The first
validator that both have, entity tag (compared weakly), modification date or digest, in this order, decides whether the two agree. The merged headers
are those of the response, with the ones that a 304 answer may update replaced by the revisit's.

The join is by range slices of (url, ts), written once: a window in each slice, and per (url, slice) one row that carries the last response
on, so a URL with a third of all captures is spread over many tasks. Captures of one URL and ts stay together; per such
pair there is one candidate response. Null URLs match nothing, null times are never earlier or later. A revisit
without a match, without a common validator, or with another value is reported as such. Repeated rows are reported each.

Values of any length are compared whole, an empty table gives an empty one, and columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.session import settled

#: Header fields that a 304 answer may update; the others describe the stored body.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
_TRACKING = "([?&])(utm_[a-z]+|ref|sessionid)=[^&]*"


def canonical(url: Column) -> Column:
    """Host in lower case without www and default port, then path and query without tracking, fragment and last slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^www[0-9]*[.]|:(80|443)$", "")
    rest = F.regexp_replace(F.regexp_replace(bare, "^[^/?]*", ""), _TRACKING, "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "&&+", "&"), "[?]&+", "?")
    return F.concat(host, F.regexp_replace(F.regexp_replace(rest, "[?&]+$", ""), "/+$", ""))


def resolve(captures: DataFrame) -> DataFrame:
    """(record_id, url, refers_to, refers_ts, outcome, headers), one row per revisit.

    outcome: 'resolved', 'no_earlier', 'changed' or 'unverified'; refers_to is null unless resolved. headers are lines
    ``name: value`` in order, merged if resolved and the revisit's own otherwise.
    """
    lines = F.coalesce(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value")))),
                       F.expr("CAST(array() AS array<struct<name: string, value: string>>)"))
    rows = captures.select("record_id", "ts", "kind", "etag", "last_modified", "digest", lines.alias("lines"),
                           "url", canonical(F.col("url")).alias("site"))
    sliced = settled(rows.repartitionByRange(F.col("site").asc(), F.col("ts").asc()).withColumn("slice", F.spark_partition_id()))
    full = F.when((F.col("kind") == "response") & F.col("ts").isNotNull(),
                  F.struct("ts", "record_id", "etag", "last_modified", "digest", "lines"))
    # per URL one row for each slice it is in; a slice holds a fixed share of all captures
    carried = (sliced.where("site IS NOT NULL").groupBy("site", "slice").agg(F.max(full).alias("last"))
               .select("site", "slice", F.max("last").over(Window.partitionBy("site").orderBy("slice").rowsBetween(
                   Window.unboundedPreceding, -1)).alias("carried")))
    within = Window.partitionBy("site", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    seen = (sliced.withColumn("own", F.max(full).over(within)).where("kind = 'revisit'")
            .join(carried, ["site", "slice"], "left")
            .withColumn("base", F.when(F.col("site").isNotNull() & F.col("ts").isNotNull(), F.coalesce("own", "carried"))))

    def same(name: str, clean=lambda c: c) -> Column:
        return clean(F.col(name)) == clean(F.col(f"base.{name}"))  # null unless both have it

    def weak(c: Column) -> Column:
        return F.regexp_replace(c, '^W/', "")

    agrees = F.coalesce(same("etag", weak), same("last_modified"), same("digest"))
    outcome = (F.when(F.col("base").isNull(), "no_earlier").when(agrees.isNull(), "unverified")
               .when(agrees, "resolved").otherwise("changed"))
    permitted = [F.lit(n) for n in PERMITTED]
    update = F.filter("lines", lambda e: e["name"].isin(*PERMITTED))
    names = F.transform(update, lambda e: e["name"])
    kept = F.filter("base.lines", lambda e: ~(F.array_contains(F.array(*permitted), e["name"]) & F.array_contains(names, e["name"])))
    merged = F.when(F.col("outcome") == "resolved", F.array_sort(F.concat(kept, update))).otherwise(F.col("lines"))
    text = F.array_join(F.transform(merged, lambda e: F.concat(e["name"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")
    found = F.col("outcome") == "resolved"
    return seen.withColumn("outcome", outcome).select(
        "record_id", "url", F.when(found, F.col("base.record_id")).alias("refers_to"),
        F.when(found, F.col("base.ts")).alias("refers_ts"), "outcome", text.alias("headers"))
