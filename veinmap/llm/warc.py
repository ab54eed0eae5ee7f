"""Not-modified revisits of a crawl, resolved to the captures that they stand for.

Records: (record_id, kind 'response' or 'revisit', url, at, status, headers map, payload digest). A revisit takes the
latest earlier full response (status 200) of the same canonical URL: an as-of join. Its validators must agree:
entity tags by weak comparison where both have one, else Last-Modified dates where both have one; without
common validator it isn't confirmed. A resolved revisit carries the stored response's headers, updated by those
that a not-modified answer may replace (``PERMITTED``); all others stay as stored.

All of it is native. Records are canonicalised once and written with a row number each. The as-of join moves only (row,
canonical, at, record_id): these are dealt by range of (canonical, at), so that a URL, however often captured, spreads over as
many partitions as it fills. Within a partition the last response before a revisit comes from a window of
the URL's rows there; what earlier partitions held is carried over a window of one row for each partition of a URL. Headers
and payloads are joined to what was found, by row number.

Canonical URL: scheme dropped, host in lower case without default port, fragment dropped, query
without ``DROPPED`` parameters and sorted, path without a trailing slash.

Defined results: a null URL or time never resolves (``no_capture``); of captures at the same time the one with
the largest record id is latest, and a response at a revisit's own time isn't earlier; null headers are none;
header names know no case and come out in lower case (of names that clash, one with a value before one without, then the last spelling in byte order);
repeated revisits resolve alike, repeated responses are one capture; empty input gives empty output; extra
columns aren't carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_table, let, shuffle_parts

# Query parameters that don't name another resource, and headers that a
# not-modified answer may replace.
DROPPED = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref")
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    args = F.array_sort(F.filter(F.split(query, "&"), lambda a: (a != "") & ~F.substring_index(a, "=", 1).isin(*DROPPED)))
    return F.concat(host, path, F.when(F.size(args) > 0, F.concat(F.lit("?"), F.array_join(args, "&"))).otherwise(F.lit("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def lower_names(headers: Column) -> Column:
    """The headers with their names in lower case, one of each."""

    def one_each(es: Column) -> Column:
        last = F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda x: F.lower(x["key"]) == F.lower(e["key"])))
        return F.map_from_entries(F.transform(last, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))

    entries = F.transform(F.map_entries(headers), lambda e: F.struct(e["value"].isNotNull().alias("said"), e["key"].alias("key"), e["value"].alias("value")))
    return F.when(F.forall(F.map_keys(headers), lambda k: k == F.lower(k)), headers).otherwise(let(F.array_sort(entries), one_each))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical, at, response_id, status, headers, payload.

    ``status`` is resolved, mismatch (validators differ), unconfirmed (none in common) or no_capture;
    response_id and headers are the stored response's only if resolved (headers else the revisit's own).
    """
    none = F.create_map().cast("map<string,string>")
    r = records.select(
        F.monotonically_increasing_id().alias("row"),
        "record_id",
        (F.col("kind") == "revisit").alias("revisit"),
        canonical_url(F.col("url")).alias("canonical"),
        F.col("at").cast("long").alias("at"),
        lower_names(F.coalesce("headers", none)).alias("headers"),
        "payload",
        F.coalesce((F.col("kind") == "response") & (F.col("status") == 200), F.lit(False)).alias("full"),
    )
    r = kept_table(r.filter("revisit or full"), "records")
    order = ["canonical", "at", F.col("full").cast("int"), "record_id", "row"]  # a time's own responses come after its revisits
    narrow = r.filter("canonical is not null and at is not null").select("row", "record_id", "canonical", "at", "full")
    dealt = kept_table(narrow.repartitionByRange(shuffle_parts(records.sparkSession), *order).withColumn("part", F.spark_partition_id()), "dealt")
    capture = F.struct("at", "record_id", "row")
    # the last response that each partition holds of a URL, and that of all partitions before
    ends = dealt.filter("full").groupBy("canonical", "part").agg(F.max(capture).alias("ended"))
    asked = dealt.filter("not full").select("canonical", "part").distinct()
    before = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.join(asked, ["canonical", "part"], "full_outer").withColumn("carried", F.last("ended", ignorenulls=True).over(before)).select("canonical", "part", "carried")
    carried = kept_table(carried.filter("carried is not null"), "carried")
    inside = Window.partitionBy("part", "canonical").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.withColumn("inside", F.last(F.when(F.col("full"), capture), ignorenulls=True).over(inside)).filter("not full").join(carried, ["canonical", "part"], "left")
    found = found.select("row", F.coalesce("inside", "carried").alias("hit")).filter("hit is not null").select("row", F.col("hit.row").alias("hit_row"), F.col("hit.record_id").alias("id"))
    stored = r.filter("full").select(F.col("row").alias("hit_row"), F.struct("headers", "payload").alias("stored"))
    found = r.filter("revisit").drop("payload").join(found, "row", "left").join(stored, "hit_row", "left").withColumn("hit", F.when(F.col("hit_row").isNotNull(), F.struct("id", "stored.headers", "stored.payload")))
    h, old = F.col("headers"), F.col("hit.headers")
    tags = h["etag"].isNotNull() & old["etag"].isNotNull()
    dates = h["last-modified"].isNotNull() & old["last-modified"].isNotNull()
    same = F.when(tags, _weak(h["etag"]) == _weak(old["etag"])).when(dates, h["last-modified"] == old["last-modified"])
    status = F.when(F.col("hit").isNull(), "no_capture").when(same.isNull(), "unconfirmed").when(same, "resolved").otherwise("mismatch")
    good = status == "resolved"
    allowed = F.map_filter(h, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)
    return found.select(
        "record_id",
        "canonical",
        "at",
        F.when(good, F.col("hit.id")).alias("response_id"),
        status.alias("status"),
        F.when(good, merged).otherwise(h).alias("headers"),
        F.when(good, F.col("hit.payload")).alias("payload"),
    )


def header_text(headers: Column) -> Column:
    """Headers as sorted ``name: value`` lines."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def records_of(pages: DataFrame) -> DataFrame:
    """A crawl log over ``pages``: each page is a response (some failed), and two revisits follow.

    Times are 10 * page_id for the response. The first revisit follows five later by another spelling of the URL;
    its entity tag is the page's, weak for some and stale for others. The second comes a long time later with only
    a date, which every seventh page doesn't have.
    """
    p = F.col("page_id").cast("long")
    digest = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    date = lambda c: F.concat(F.lit("day "), (c % 28).cast("string"))
    kv = lambda **x: F.map_filter(F.map_from_arrays(F.array(*[F.lit(k.replace("_", "-")) for k in x]), F.array(*x.values())), lambda k, v: v.isNotNull())
    response = F.struct(
        (p * 3).alias("record_id"), F.lit("response").alias("kind"), F.col("url").alias("url"), (p * 10).alias("at"), F.when(p % 13 == 0, 503).otherwise(200).alias("status"),
        kv(etag=quoted(digest), content_type=F.lit("text/html"), date=date(p), last_modified=F.when(p % 7 != 0, date(p + 1)), server=F.lit("s1")).alias("headers"), digest.alias("payload"),
    )
    first = F.struct(
        (p * 3 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.concat("url", F.lit("#again")).alias("url"), (p * 10 + 5).alias("at"), F.lit(304).alias("status"),
        kv(etag=F.when(p % 3 == 0, F.concat(F.lit("W/"), quoted(digest))).when(p % 5 == 0, F.lit('"stale"')).otherwise(quoted(digest)), content_type=F.lit("text/plain"), date=date(p + 2), last_modified=F.lit(None).cast("string"), server=F.lit("s2")).alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    second = F.struct(
        (p * 3 + 2).alias("record_id"), F.lit("revisit").alias("kind"), F.regexp_replace("url", "^http:", "https:").alias("url"), (p * 10 + 1_000_003).alias("at"), F.lit(304).alias("status"),
        kv(etag=F.lit(None).cast("string"), content_type=F.lit(None).cast("string"), date=date(p + 3), last_modified=date(p + 1), server=F.lit("s3")).alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    return pages.select(F.explode(F.array(response, first, second)).alias("r")).select("r.*")


def op5_warc_revisits(spark, sf_dir: str) -> DataFrame:
    out = resolve_revisits(records_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.select("record_id", "canonical", "response_id", "status", header_text(F.col("headers")).alias("headers"), "payload")
