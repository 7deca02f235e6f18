"""Not-modified revisits resolved against the latest earlier full response of the same URL.

An as-of join by canonical URL in DataFrame operations. Records are cut into time slices
with about equally many records each. Within a slice, a window over URL and time
carries the last full response forward; across slices, the last response of each (URL,
slice) is carried forward over one row per slice, and joined back. A URL with a third of
all records is thus spread over the slices, and no window holds more than one slice of
a URL. Only record ids, times and headers are moved, never payloads.

A record is earlier if its time is, or its time is equal and its id smaller. The first
validator that both sides have decides: ETag, compared weakly, then Last-Modified. Outcome:
``merged``, ``validator_mismatch``, ``no_common_validator`` or ``no_response``. Merged
headers are those of the response, with the ``PERMITTED`` ones of the revisit in their place.
Header names are compared in lower case. Null URLs or times never match; null headers count
as none. Of repeated record ids each row is resolved on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.llm.staging import staged

#: Time slices of the as-of join.
SLICES = 64

# Headers that a not-modified response may update, query parameters that do not name a page.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = "^(utm_[^=]*|gclid|fbclid|ref)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without end slash, sorted query without tracking, no fragment."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), "^www\\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&")
    params = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of names that then agree the smallest value stays."""
    entries = F.array_sort(F.transform(F.map_entries(F.coalesce(headers, F.create_map())), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    first = F.filter(entries, lambda e, i: (i == 0) | (e["key"] != F.get(entries, i - 1)["key"]))
    return F.map_from_entries(first)


def _slice_of(time: Column, bounds: list) -> Column:
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= time)) if bounds else F.lit(0)


def resolved(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row per revisit of ``records`` (record_id, url, captured, kind, headers).

    Returns record_id, canonical_url, response_id, outcome and headers (null unless merged).
    """
    slim = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "captured", "kind", _lowered(F.col("headers")).alias("headers"))
    usable = F.col("canonical_url").isNotNull() & F.col("captured").isNotNull()
    shares = [i / slices for i in range(1, slices)]
    cuts = records.agg(F.percentile_approx("captured", shares, 10 * slices)).first()[0]
    rows = slim.withColumn("slice", F.when(usable, _slice_of(F.col("captured"), sorted(set(cuts or [])))))
    full = F.struct("captured", "record_id", "headers")
    response = F.when(F.col("kind") == "response", full)
    within = Window.partitionBy("canonical_url", "slice").orderBy("captured", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.where(usable).withColumn("near", F.last(response, ignorenulls=True).over(within)).where("kind = 'revisit'")
    last = rows.where(usable & (F.col("kind") == "response")).groupBy("canonical_url", "slice").agg(F.max_by(full, F.struct("captured", "record_id")).alias("last"))
    needed = near.where("near is null").select("canonical_url", "slice").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType))
    steps = last.unionByName(needed).groupBy("canonical_url", "slice").agg(F.first("last", ignorenulls=True).alias("last"))
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = staged(steps.withColumn("far", F.last("last", ignorenulls=True).over(before)).where("far is not null").select("canonical_url", "slice", "far"), "carried")
    found = near.join(carried, ["canonical_url", "slice"], "left").withColumn("match", F.coalesce("near", "far"))
    apart = slim.where(~usable & (F.col("kind") == "revisit")).withColumn("match", F.lit(None).cast(found.schema["match"].dataType))
    names = ["record_id", "canonical_url", "headers", "match"]
    return _merged(found.select(*names).unionByName(apart.select(*names)))


def _merged(pairs: DataFrame) -> DataFrame:
    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    mine, theirs = F.col("headers"), F.col("match")["headers"]
    tags, dates = (weak(mine["etag"]), weak(theirs["etag"])), (mine["last-modified"], theirs["last-modified"])
    same = F.coalesce(tags[0] == tags[1], dates[0] == dates[1])
    outcome = F.when(F.col("match").isNull(), "no_response").when(same.isNull(), "no_common_validator").when(same, "merged").otherwise("validator_mismatch")
    updates = F.map_filter(mine, lambda k, _: k.isin(*PERMITTED))
    stored = F.map_filter(theirs, lambda k, _: ~F.map_contains_key(updates, k))
    return pairs.select(
        "record_id",
        "canonical_url",
        F.when(outcome == "merged", F.col("match")["record_id"]).alias("response_id"),
        outcome.alias("outcome"),
        F.when(outcome == "merged", F.map_concat(stored, updates)).alias("headers"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """A capture log from a page table: per page its full response and a later not-modified revisit.

    The revisit asks under another spelling of the URL. One in five has the ETag of another
    content, one in seven has no ETag, and the times interleave the pages.
    """
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    date = lambda t: F.concat(F.lit("day "), F.floor(t / 86400).cast("string"))
    at = F.col("page_id") * 977 % 1_000_003 * 60
    later = at + 3600 + F.col("page_id") % 13 * 86400
    pair = lambda k, v: (F.lit(k), v)
    full = F.create_map(*pair("Content-Type", F.lit("text/html")), *pair("ETag", tag), *pair("Last-Modified", date(at)), *pair("Cache-Control", F.lit("max-age=60")))
    stale = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit('W/"'), F.md5(F.reverse("html")), F.lit('"'))).otherwise(F.concat(F.lit("W/"), tag))
    with_tag = F.create_map(*pair("etag", stale), *pair("Date", date(later)), *pair("Cache-Control", F.lit("max-age=600")), *pair("Content-Type", F.lit("none")))
    without = F.create_map(*pair("last-modified", date(at)), *pair("Date", date(later)))
    spelled = F.when(F.col("page_id") % 2 == 0, F.concat(F.col("url"), F.lit("#again"))).otherwise(F.col("url"))
    responses = pages.select((F.col("page_id") * 2).alias("record_id"), "url", at.alias("captured"), F.lit("response").alias("kind"), full.alias("headers"))
    revisits = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), spelled.alias("url"), later.alias("captured"), F.lit("revisit").alias("kind"), F.when(F.col("page_id") % 7 == 0, without).otherwise(with_tag).alias("headers")
    )
    return responses.unionByName(revisits)


def digest(pages: DataFrame) -> DataFrame:
    """The registered query: the outcome of every revisit, headers as sorted lines."""
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return resolved(page_records(pages)).select("record_id", "canonical_url", "response_id", "outcome", lines.alias("headers"))


ORACLE = r"""
WITH records AS (
    SELECT page_id * 2 AS record_id, url, page_id * 977 % 1000003 * 60 AS captured, 'response' AS kind,
           '"' || md5(html) || '"' AS etag, 'day ' || (page_id * 977 % 1000003 * 60 // 86400) AS modified,
           NULL AS day, 'max-age=60' AS cache
    FROM pages
    UNION ALL
    SELECT page_id * 2 + 1, CASE WHEN page_id % 2 = 0 THEN url || '#again' ELSE url END,
           page_id * 977 % 1000003 * 60 + 3600 + page_id % 13 * 86400, 'revisit',
           CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '"' || md5(reverse(html)) || '"' ELSE '"' || md5(html) || '"' END,
           CASE WHEN page_id % 7 = 0 THEN 'day ' || (page_id * 977 % 1000003 * 60 // 86400) END,
           'day ' || ((page_id * 977 % 1000003 * 60 + 3600 + page_id % 13 * 86400) // 86400),
           CASE WHEN page_id % 7 = 0 THEN NULL ELSE 'max-age=600' END
    FROM pages
), parts AS (
    SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM records
), pieces AS (
    SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
           regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
           list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
                                 lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|gclid|fbclid|ref)(=|$)'))) AS params
    FROM parts
), named AS (
    SELECT *, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url,
           row_number() OVER (ORDER BY captured, record_id) AS place
    FROM pieces
), matched AS (
    SELECT v.*, r.record_id AS full_id, r.etag AS full_etag, r.modified AS full_modified, r.cache AS full_cache,
           coalesce(v.etag = r.etag, v.modified = r.modified) AS same
    FROM (SELECT * FROM named WHERE kind = 'revisit') v
    ASOF LEFT JOIN (SELECT * FROM named WHERE kind = 'response') r ON v.canonical_url = r.canonical_url AND v.place > r.place
)
SELECT record_id, canonical_url, CASE WHEN full_id IS NOT NULL AND same THEN full_id END AS response_id,
       CASE WHEN full_id IS NULL THEN 'no_response' WHEN same IS NULL THEN 'no_common_validator' WHEN same THEN 'merged' ELSE 'validator_mismatch' END AS outcome,
       CASE WHEN full_id IS NOT NULL AND same THEN
            'cache-control: ' || coalesce(cache, full_cache) || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || day || chr(10)
            || 'etag: ' || CASE WHEN etag IS NULL THEN full_etag ELSE 'W/' || etag END || chr(10)
            || 'last-modified: ' || coalesce(modified, full_modified) END AS headers
FROM matched
"""
