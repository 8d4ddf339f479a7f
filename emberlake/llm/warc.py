"""WARC: resolves not-modified revisit records to the latest earlier full response of the same canonical URL.

records: record_id long, url string, ts long, kind 'response' or 'revisit', etag, last_modified, digest strings,
headers map. A revisit takes the response with the largest (ts, record_id) among those with ts before its own.
Validators are compared in the order etag (weak form), last_modified, digest; the first one the revisit carries
decides. Results: 'resolved', 'changed' (validator differs), 'unvalidated' (revisit carries none), 'missing'.
Headers of a resolved revisit are the response's, overlaid with the revisit's except those that describe the body.

The as-of join never gathers one URL in one task: time is cut into buckets, a window runs within (url, bucket),
and the last response of each bucket, one row, is carried to later buckets. Null urls or times never match
('missing'), not even each other; rows with null urls are dealt by record, not to one task. Of a repeated record every row is
resolved, alike; a null record_id ranks first among equal times; an empty table gives no rows. Other columns are not read; a long
url or header is a value like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers a not-modified answer may not change.
BODY_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")
#: Query parameters that do not select content.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Without scheme, leading www., fragment, tracking parameters and closing slash; parameters sorted."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    given = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))
    query = F.concat_ws("&", F.array_sort(given))
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def merge_headers(stored: Column, fresh: Column) -> Column:
    fresh = F.map_filter(F.coalesce(fresh, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*BODY_HEADERS))
    stored = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(fresh, k))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(stored, fresh))))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, bucket: int = 3600) -> DataFrame:
    """One row per revisit: record_id, url_key, target_id, status, headers. bucket: width of time buckets, in ts units."""
    r = records.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind", "etag", "last_modified", "digest", "headers",
        F.floor(F.col("ts") / bucket).alias("slot"),
    )
    full = F.when((F.col("kind") == "response") & F.col("ts").isNotNull() & F.col("url_key").isNotNull(), F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"))
    order = F.struct("ts", "record_id")
    last = r.where("kind = 'response' and ts is not null and url_key is not null").groupBy("url_key", "slot").agg(F.max_by(full, order).alias("end"))
    revisits = r.where("kind = 'revisit' and url_key is not null and slot is not null")
    slots = revisits.select("url_key", "slot").distinct().join(last, ["url_key", "slot"], "full")
    before = Window.partitionBy("url_key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select("url_key", "slot", F.last("end", ignorenulls=True).over(before).alias("carried"))
    dealt = F.when(F.col("url_key").isNull(), F.xxhash64("record_id"))
    within = Window.partitionBy("url_key", "slot", "dealt").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    # equal times: the largest record_id stands for them, so the frame's last value is well defined
    same = Window.partitionBy("url_key", "slot", "dealt", "ts", "kind").orderBy(F.desc("record_id"))
    dealt_out = r.withColumn("dealt", dealt).repartition("url_key", "slot", "dealt")  # once, for both windows
    seen = dealt_out.withColumn("first", F.row_number().over(same)).withColumn("here", F.last(F.when(F.col("first") == 1, full), ignorenulls=True).over(within))
    found = seen.where("kind = 'revisit'").join(carried, ["url_key", "slot"], "left").withColumn("got", F.coalesce("here", "carried"))
    got = F.col("got")
    same_value = (
        F.when(F.col("etag").isNotNull(), F.coalesce(_weak(F.col("etag")) == _weak(got["etag"]), F.lit(False)))
        .when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == got["last_modified"], F.lit(False)))
        .when(F.col("digest").isNotNull(), F.coalesce(F.col("digest") == got["digest"], F.lit(False)))
    )
    status = F.when(got.isNull(), "missing").when(same_value.isNull(), "unvalidated").when(same_value, "resolved").otherwise("changed")
    return found.select(
        "record_id", "url_key", got["record_id"].alias("target_id"), status.alias("status"),
        F.when(status == "resolved", merge_headers(got["headers"], F.col("headers"))).alias("headers"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """Capture log of the ``pages`` table: each page is a full response at time page_id, and is asked for again REVISIT_AFTER
    later; the answer carries the page's validator, or, where page_id is a multiple of 5, an outdated one."""
    digest = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    common = pages.select("page_id", "url", digest.alias("digest"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))
    body = F.create_map(F.lit("content-length"), F.col("size"), F.lit("content-type"), F.lit("text/html"), F.lit("etag"), F.col("digest"), F.lit("age"), F.lit("0"))
    etag = F.when(F.col("page_id") % 5 == 0, F.md5(F.concat(F.lit("old"), F.col("page_id").cast("string")).cast("binary"))).otherwise(F.col("digest"))
    light = F.create_map(F.lit("content-length"), F.lit("0"), F.lit("etag"), etag, F.lit("age"), (F.col("page_id") % 100).cast("string"))
    none = F.lit(None).cast("string").alias("last_modified")
    first = common.select((F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("ts"), F.lit("response").alias("kind"), F.col("digest").alias("etag"), none, "digest", body.alias("headers"))
    again = common.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") + REVISIT_AFTER).alias("ts"), F.lit("revisit").alias("kind"), etag.alias("etag"), none, F.lit(None).cast("string").alias("digest"), light.alias("headers"))
    return first.unionByName(again)


REVISIT_AFTER = 1000
