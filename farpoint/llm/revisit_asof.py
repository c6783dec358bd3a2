"""Not-modified revisits of a crawl, resolved by an as-of join.

A revisit record carries a 304 answer without a body.  It stands for the latest earlier full
response of the same canonical URL, provided that their validators agree.  The answer's headers
update the stored ones where a 304 may do so.

The as-of join is two windows.  Time is cut into buckets; inside a bucket of one URL the latest
earlier response is found, and the latest response of all earlier buckets is handed in.  So a URL
with very many records is spread over its buckets.  Bodies take no part in either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds of one bucket.
BUCKET_SECONDS = 86_400
# Headers that a 304 does not change, and query parameters that name no other page.
BODY_HEADERS = ("content-length", "content-encoding", "content-type", "content-range", "transfer-encoding", "connection", "keep-alive", "trailer", "upgrade")
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|mc_cid|mc_eid|sessionid|phpsessid|jsessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and port, path, sorted query without tracking; null stays null.

    Scheme and fragment do not tell pages apart.  What has no host is only trimmed.
    """
    trimmed = F.regexp_replace(F.trim(url), "#.*$", "")
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d*)?([^?]*)(?:\?(.*))?$"
    host = F.regexp_replace(F.lower(F.regexp_extract(trimmed, parts, 1)), r"^www\d*\.|\.$", "")
    path = F.regexp_replace(F.regexp_extract(trimmed, parts, 2), r"^/?", "/")
    query = F.filter(F.split(F.regexp_extract(trimmed, parts, 3), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    whole = F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(""))
    return F.when(trimmed.rlike(parts), whole).otherwise(trimmed)


def lower_headers(headers: Column) -> Column:
    """A header map with names in lower case; of names that become equal the first is kept."""
    entries = F.transform(
        F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>")),
        lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")),
    )
    names = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1))


def _opaque(tag: Column) -> Column:
    """An entity tag for the weak comparison."""
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers, updated by those of a 304 that may update them; both maps have lower-case names."""
    permitted = F.map_filter(fresh, lambda k, v: ~k.isin(*BODY_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(permitted), k)), permitted)


def resolved(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row per revisit: ``record_id``, ``canonical``, ``time``, ``response_id``, ``matched_by`` and ``headers``.

    ``records`` has ``record_id``, ``url``, ``time`` (seconds, long), ``kind`` (``response`` or
    ``revisit``; others are left out) and ``headers`` (map).  Earlier means strictly earlier; of
    responses at one time the one with the greatest id counts.  ``matched_by`` is ``etag``,
    ``last-modified``, ``time`` (the revisit has no validator that the response has too),
    ``mismatch``, or ``nothing earlier``; the last two have no ``response_id`` and keep the
    revisit's headers.  An entity tag, where both have one, decides alone.  Records without URL
    or time are never found and find nothing.  Repeated rows give repeated rows.  Further
    columns are left out.
    """
    known = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id",
        canonical_url(F.col("url")).alias("canonical"),
        F.col("time").cast("long").alias("time"),
        "kind",
        lower_headers(F.col("headers")).alias("headers"),
    )
    placed = known.where("canonical is not null and time is not null").withColumn("bucket", F.floor(F.col("time") / bucket_seconds).cast("long"))
    stored = F.when(F.col("kind") == "response", F.struct("time", F.col("record_id").alias("id"), F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified")))
    line = placed.select("canonical", "bucket", "time", "record_id", "kind", "headers", stored.alias("stored"))
    ends = line.groupBy("canonical", "bucket").agg(F.max("stored").alias("held"))
    buckets = Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select("canonical", "bucket", F.max("held").over(buckets).alias("handed"))
    inside = Window.partitionBy("canonical", "bucket").orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    found = line.withColumn("inner", F.max("stored").over(inside)).where("kind = 'revisit'")
    latest = found.join(handed, ["canonical", "bucket"]).withColumn("latest", F.coalesce("inner", "handed")).drop("inner", "handed", "stored", "bucket", "kind")
    lost = known.where("kind = 'revisit' and (canonical is null or time is null)").select(
        "canonical", "time", "record_id", "headers", F.lit(None).cast(dict(latest.dtypes)["latest"]).alias("latest")
    )
    tag, modified = F.col("headers")["etag"], F.col("headers")["last-modified"]
    matched = (
        F.when(F.col("latest").isNull(), "nothing earlier")
        .when(tag.isNotNull() & F.col("latest.etag").isNotNull(), F.when(_opaque(tag) == _opaque(F.col("latest.etag")), "etag").otherwise("mismatch"))
        .when(modified.isNotNull() & F.col("latest.modified").isNotNull(), F.when(modified == F.col("latest.modified"), "last-modified").otherwise("mismatch"))
        .otherwise("time")
    )
    judged = latest.unionByName(lost.select(latest.columns)).withColumn("matched_by", matched)
    right = F.col("matched_by").isin("etag", "last-modified", "time")
    asked = judged.withColumn("response_id", F.when(right, F.col("latest.id"))).drop("latest")
    # ids repeat where rows do: one response an id
    answers = known.where("kind = 'response'").groupBy(F.col("record_id").alias("response_id")).agg(F.min(F.array_sort(F.map_entries("headers"))).alias("entries"))
    joined = asked.join(answers, "response_id", "left")
    whole = F.when(F.col("entries").isNotNull(), merged_headers(F.map_from_entries("entries"), F.col("headers"))).otherwise(F.col("headers"))
    return joined.select("record_id", "canonical", "time", "response_id", "matched_by", whole.alias("headers"))


def crawl_of(pages: DataFrame) -> DataFrame:
    """A crawl derived from ``pages``: a full response for each page and, later, a revisit of its URL.

    The revisit spells the URL in another way.  One in four sends a stale entity tag, one in five
    no validators at all.
    """
    at = F.lit(1_700_000_000) + F.pmod(F.col("page_id") * 7919, F.lit(1_000_003))
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    start = F.lit("1970-01-01").cast("timestamp_ntz")  # dates are in UTC whatever the session's zone is
    when = lambda t: F.date_format(start + F.make_dt_interval(secs=t), "yyyy-MM-dd HH:mm:ss")
    response = pages.select(
        F.concat(F.lit("r"), "page_id").alias("record_id"), "url", at.alias("time"), F.lit("response").alias("kind"),
        F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), when(at), F.lit("Content-Type"), F.lit("text/html"),
                     F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("Date"), when(at)).alias("headers"),
    )
    later = at + 3_600 * (1 + F.pmod(F.col("page_id"), F.lit(240)))
    sent = F.when(F.col("page_id") % 4 == 3, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), tag))
    plain = F.create_map(F.lit("Date"), when(later), F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=60"))
    spelled = F.concat(F.regexp_replace(F.regexp_replace("url", "#.*$", ""), r"^https?://([^/]*)", "HTTP://$1:80"), F.lit("#again"))
    revisit = pages.select(
        F.concat(F.lit("v"), "page_id").alias("record_id"), spelled.alias("url"), later.alias("time"), F.lit("revisit").alias("kind"),
        F.when(F.col("page_id") % 5 == 4, plain).otherwise(F.map_concat(plain, F.create_map(F.lit("etag"), sent))).alias("headers"),
    )
    return response.unionByName(revisit)
