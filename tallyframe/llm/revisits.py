"""Not-modified revisits resolved to the full response they repeat.

A revisit record says that a page had not changed; its content is that of the
latest earlier full response of the same canonical URL.  The as-of join takes
that response, checks that the revisit's validators fit it (entity tag, weak
comparison; else the modification time; else the payload digest) and merges
the header fields that a not-modified answer may update.

Canonical URL: scheme and fragment dropped, host in lower case without
``www.`` and default ports, no trailing slash, tracking parameters dropped and
the others sorted.

Scale: records are range-sorted by (URL, time) and cut into slices of
``SLICE`` consecutive records.  The latest response is found by a window
within a slice; for URLs that go on over several slices (at most two a slice)
the last response of each slice is carried to the later ones.  So a URL that
holds a third of all records is spread over many tasks.

Defined results: records without a time are not before or after anything:
their responses are never used, their revisits stay unresolved; a null URL
matches nothing; a response at the revisit's own time is not earlier; among
responses of one time the larger record id counts as later; repeated records
are kept; null headers count as none; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import globally_numbered, staged, table

SLICE = 65_536
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(\?.*)?$"
TRACKING = r"^(utm_[a-z]*|ref|sid|sessionid|gclid|fbclid)(=|$)"
# Fields of a 304 answer that replace those of the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
COLUMNS = ("record_id", "kind", "url", "fetched", "status", "etag", "last_modified", "digest", "headers")


def canonical_url(url: Column) -> Column:
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, URL, 2))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, URL, 3), "/+$", "")
    given = F.split(F.substring(F.regexp_extract(bare, URL, 4), 2, 1 << 30), "&")
    kept = F.array_sort(F.filter(given, lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING))))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    whole = F.concat(host, F.when(path == "", "/").otherwise(path), query)
    return F.when(F.rlike(bare, F.lit(URL)), whole).otherwise(bare)


def opaque(tag: Column) -> Column:
    """An entity tag without its weakness mark."""
    return F.regexp_replace(tag, "^W/", "")


def outcome(earlier: Column) -> Column:
    fits = (
        F.when(F.col("etag").isNotNull(), F.coalesce(opaque(F.col("etag")) == opaque(earlier["etag"]), F.lit(False)))
        .when(
            F.col("last_modified").isNotNull(),
            F.coalesce(F.col("last_modified") == earlier["last_modified"], F.lit(False)),
        )
        .when(F.col("digest").isNotNull(), F.coalesce(F.col("digest") == earlier["digest"], F.lit(False)))
        .otherwise(F.lit(True))  # nothing to check
    )
    return F.when(earlier.isNull(), "no_earlier").when(fits, "resolved").otherwise("changed")


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored fields, the permitted ones replaced or added from the update; names in lower case."""
    none = F.expr("map()").cast("map<string,string>")

    def lower(m: Column) -> Column:
        """Of fields whose names are equal but for case, the last one counts."""
        m = F.coalesce(m, none)
        names = F.transform(F.map_keys(m), F.lower)
        fields = F.arrays_zip(names.alias("name"), F.map_values(m).alias("value"))
        last = F.filter(fields, lambda f, i: i == F.size(m) - F.array_position(F.reverse(names), f["name"]))
        return F.map_from_entries(last)

    allowed = F.map_filter(lower(update), lambda k, _: k.isin(*PERMITTED))
    untouched = F.map_filter(lower(stored), lambda k, _: ~F.map_contains_key(allowed, k))
    return F.map_concat(untouched, allowed)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every revisit with its response: (record_id, url, canonical, fetched,
    response_id, outcome, headers); the last three are null, a reason and null
    when there is none that fits.  ``records`` has the columns ``COLUMNS``:
    kind is 'response' or 'revisit', headers a map."""
    response = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    usable = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("fetched").isNotNull()
    rows = records.select(*[records[c] for c in COLUMNS]).filter(F.col("kind").isin("response", "revisit"))
    rows = rows.select(
        "*", canonical_url(F.col("url")).alias("canonical"), F.when(usable, response).alias("response"),
        (F.col("kind") == "response").alias("later"),  # revisits first at equal times
    )
    order = [F.col(c) for c in ("canonical", "fetched", "later", "record_id")]
    rows = globally_numbered(rows, order, "revisit-records").withColumn("slice", F.floor(F.col("idx") / SLICE))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    here = before.partitionBy("slice", "canonical").orderBy("idx")
    near = rows.withColumn("near", F.last("response", ignorenulls=True).over(here)).filter("kind = 'revisit'")
    # URLs that go on in another slice: the first and the last one of each slice.
    edge = rows.groupBy("slice").agg(F.min_by("canonical", "idx").alias("a"), F.max_by("canonical", "idx").alias("b"))
    edge = staged(edge.select("slice", F.explode(F.array("a", "b")).alias("canonical")).distinct(), "revisit-edges")
    over = edge.groupBy("canonical").agg(F.count("*").alias("n")).filter("n > 1").select("canonical")
    last = (
        rows.filter("response is not null").join(over, "canonical", "left_semi")
        .groupBy("canonical", "slice").agg(F.max_by("response", "idx").alias("last"))
    )
    carried = (
        edge.join(over, "canonical", "left_semi").join(last, ["canonical", "slice"], "left")
        .withColumn(
            "carried", F.last("last", ignorenulls=True).over(before.partitionBy("canonical").orderBy("slice"))
        )
        .select("canonical", "slice", "carried")
    )
    usable_here = F.col("fetched").isNotNull() & F.col("canonical").isNotNull()
    found = near.join(carried, ["canonical", "slice"], "left").withColumn(
        "earlier", F.when(usable_here, F.coalesce("near", "carried"))
    )
    state = outcome(F.col("earlier"))
    resolved = state == "resolved"
    return found.select(
        "record_id", "url", "canonical", "fetched",
        F.when(resolved, F.col("earlier.record_id")).alias("response_id"), state.alias("outcome"),
        F.when(resolved, merged_headers(F.col("earlier.headers"), F.col("headers"))).alias("headers"),
    )


def crawl_records(pages: DataFrame) -> DataFrame:
    """The pages as a crawl: each is fetched in full at second page_id, and asked
    for again a day later under another spelling of its URL.  The second answer
    carries the entity tag (of one page in five an outdated one), or of one page
    in seven only the modification time, or of one in eleven no validator."""
    page, url = F.col("page_id"), F.col("url")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    modified = page - F.pmod(page, F.lit(1000))
    stale = F.pmod(page, F.lit(5)) == 0
    dated, bare = F.pmod(page, F.lit(7)) == 0, F.pmod(page, F.lit(11)) == 0
    first = pages.select(
        (page * 2).alias("record_id"), F.lit("response").alias("kind"), url, page.alias("fetched"),
        F.lit(200).alias("status"), tag.alias("etag"), modified.alias("last_modified"),
        F.lit(None).cast("string").alias("digest"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length("html").cast("string"),
            F.lit("ETag"), tag, F.lit("Date"), page.cast("string"),
        ).alias("headers"),
    )
    again = pages.select(
        (page * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"),
        F.concat(F.regexp_replace(url, r"^https?://(www\.)?", "HTTP://WWW."), F.lit("#again")).alias("url"),
        (page + 86_400).alias("fetched"), F.lit(304).alias("status"),
        F.when(bare | dated, F.lit(None)).when(stale, F.lit('"old"')).otherwise(F.concat(F.lit("W/"), tag)).alias("etag"),
        F.when(dated & ~bare, modified).alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(
            F.lit("date"), (page + 86_400).cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"),
            F.lit("Content-Length"), F.lit("0"),
        ).alias("headers"),
    )
    return first.unionByName(again)


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All revisits of the pages' crawl, resolved."""
    found = resolve_revisits(crawl_records(table(spark, sf_dir, "pages")))
    fields = F.array_sort(F.transform(F.map_entries("headers"), lambda h: F.concat_ws("=", h["key"], h["value"])))
    return found.select("record_id", "canonical", "response_id", "outcome", F.array_join(fields, ";").alias("headers"))


OP3_SQL = r"""
WITH url AS (
  SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS bare FROM pages),
part AS (
  SELECT *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(\?.*)?$', 2)) AS host,
         regexp_replace(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(\?.*)?$', 3), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(\?.*)?$', 4)[2:], '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]*|ref|sid|sessionid|gclid|fbclid)(=|$)'))) AS q
  FROM url),
page AS (
  SELECT page_id, '"' || md5(coalesce(html, '')) || '"' AS tag, strlen(html) AS size, page_id - page_id % 1000 AS modified,
         regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || CASE WHEN path = '' THEN '/' ELSE path END
           || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical
  FROM part),
revisit AS (
  SELECT page_id * 2 + 1 AS record_id, canonical, page_id + 86400 AS fetched,
         CASE WHEN page_id % 11 = 0 OR page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '"old"' ELSE tag END AS etag,
         CASE WHEN page_id % 7 = 0 AND page_id % 11 <> 0 THEN modified END AS last_modified
  FROM page),
joined AS (
  SELECT v.*, p.page_id * 2 AS earlier, p.tag, p.size, p.modified
  FROM revisit v ASOF LEFT JOIN page p ON v.canonical = p.canonical AND v.fetched > p.page_id),
judged AS (
  SELECT *, CASE WHEN earlier IS NULL THEN 'no_earlier'
                 WHEN etag IS NOT NULL THEN CASE WHEN etag = tag THEN 'resolved' ELSE 'changed' END
                 WHEN last_modified IS NOT NULL THEN CASE WHEN last_modified = modified THEN 'resolved' ELSE 'changed' END
                 ELSE 'resolved' END AS outcome
  FROM joined)
SELECT record_id, canonical, CASE WHEN outcome = 'resolved' THEN earlier END AS response_id, outcome,
       CASE WHEN outcome = 'resolved' THEN 'cache-control=max-age=60;content-length=' || size
            || ';content-type=text/html;date=' || fetched || ';etag=' || tag END AS headers
FROM judged
"""
