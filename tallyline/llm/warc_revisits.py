"""Resolution of not-modified revisit records: an as-of join by canonical URL.

A revisit (a 304 answer) belongs to the latest full response of its canonical URL that was captured strictly before it. Its
validators must not contradict that response's: an entity tag, if both have one, decides (weakly compared); else the
last-modified date, if both have one; without any common validator nothing is contradicted. A resolved revisit gets the
response's headers, over which those go that a 304 may update (PERMITTED).

A URL's events are cut into stretches of time (quantiles of all events), each sorted on its own; what a stretch inherits is
the last response of the stretches before it, of which a URL has at most MOST_STRETCHES. So a hot URL is many tasks, whose number grows with the events.

Defined cases: a null or blank URL, or a null time, never matches (``no_response``); of responses at the same time the larger
record id counts as later; a revisit doesn't see a response of its own time; null headers are empty; of header names that differ in case alone the last
by code point stays, with the largest value; rows that repeat a
record id are resolved one by one; other columns are ignored; empty tables give an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stretches of time: one for each STRETCH_ROWS events, within these bounds.
STRETCHES, MOST_STRETCHES, STRETCH_ROWS = 64, 1024, 50_000
#: Versions that a page of captures() has over the whole table.
VERSIONS = 8
#: The header fields that a not-modified answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
_DROPPED = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, www., default port, trailing slashes and tracking parameters; host in lower case, parameters sorted; null for none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, "^([^/?]*)", 1)
    rest = F.substr(bare, F.length(host) + 1)
    clean = F.regexp_replace(F.regexp_replace(F.lower(host), r"^www[0-9]*\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^([^?]*)", 1), "/+$", "")
    parts = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(_DROPPED)))
    whole = F.concat(clean, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(F.lit("")))
    return F.when(whole != "", whole)


def lower_names(headers: Column) -> Column:
    """The headers with names in lower case; of those that differ in case alone the last one by name, then value."""
    one = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["key"].alias("own"), e["value"].alias("value"))))
    lasts = F.filter(one, lambda e, i: (i + 1 == F.size(one)) | (F.get(one, i + 1)["key"] != e["key"]))
    return F.map_from_entries(F.transform(lasts, lambda e: F.struct(e["key"], e["value"])))


def _etag(c: str) -> Column:
    return F.regexp_replace(F.col(c), "^W/", "")


def resolved(responses: DataFrame, revisits: DataFrame) -> DataFrame:
    """A row per revisit: record_id, url_key, status (resolved, validator_mismatch, no_response), response_id, headers.

    Both tables have record_id long, url, ts long, etag, last_modified and headers (map of string to string)."""
    common = lambda df, kind: df.select(
        F.lit(kind).alias("kind"), F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), F.col("etag").cast("string").alias("etag"), F.col("last_modified").cast("string").alias("last_modified"),
        F.coalesce(F.col("headers"), F.from_json(F.lit("{}"), "map<string,string>")).alias("headers"))
    events = common(responses, 1).where("url_key is not null and ts is not null").unionByName(common(revisits, 0))
    live = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    many = int(min(MOST_STRETCHES, max(STRETCHES, events.where(live).count() // STRETCH_ROWS)))
    marks = sorted(set(events.where(live).agg(F.percentile_approx("ts", [i / many for i in range(1, many)], 20 * many)).first()[0] or []))
    events = events.withColumn("stretch", F.size(F.filter(F.lit(marks) if marks else F.array().cast("array<long>"), lambda m: m < F.col("ts"))))
    response = F.when(F.col("kind") == 1, F.struct(F.col("record_id").alias("id"), F.col("etag").alias("tag"), F.col("last_modified").alias("modified"), F.col("headers").alias("stored")))
    order = Window.partitionBy("url_key", "stretch").orderBy("ts", "kind", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = events.where(live).withColumn("found", F.last(response, ignorenulls=True).over(order))
    last = events.where(live & (F.col("kind") == 1)).groupBy("url_key", "stretch").agg(F.max_by(response, F.struct("ts", "record_id")).alias("end"))
    # what each stretch of a URL with events inherits: at most MOST_STRETCHES rows a URL
    spans = events.where(live).select("url_key", "stretch").distinct().join(last, ["url_key", "stretch"], "left")
    carry = spans.select("url_key", "stretch", F.last("end", ignorenulls=True).over(Window.partitionBy("url_key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    found = inside.where("kind = 0").join(carry, ["url_key", "stretch"], "left").withColumn("response", F.coalesce("found", "carried")).drop("found", "carried")
    never = events.where(~F.coalesce(live, F.lit(False))).withColumn("response", F.lit(None).cast(found.schema["response"].dataType))
    both = found.unionByName(never.select(*found.columns))
    tag, modified = F.regexp_replace("response.tag", "^W/", ""), F.col("response.modified")
    agrees = F.when(F.col("etag").isNotNull() & tag.isNotNull(), _etag("etag") == tag).when(F.col("last_modified").isNotNull() & modified.isNotNull(), F.col("last_modified") == modified).otherwise(F.lit(True))
    status = F.when(F.col("response").isNull(), "no_response").when(agrees, "resolved").otherwise("validator_mismatch")
    update = F.map_filter(lower_names(F.col("headers")), lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(lower_names(F.col("response.stored")), lambda k, _: ~F.array_contains(F.map_keys(update), k))
    return both.withColumn("status", status).select("record_id", "url_key", "status", F.col("response.id").alias("response_id"), F.when(F.col("status") == "resolved", F.map_concat(kept, update)).alias("headers"))


def captures(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(responses, revisits) for a table of pages: with each page the first folder of its path was asked for, with the page's parameters and fragment, at time page_id.

    A hash of page_id says whether that was a full response or a not-modified answer, and whether it came with an entity tag. What was asked for has VERSIONS
    versions over the rows of the table, and another last-modified date with every second one."""
    rows = max(1, pages.count())
    dice = F.md5(F.col("page_id").cast("string"))
    front = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?[^/?#]*", 0)
    page = pages.select("url", "html", F.col("page_id").cast("long").alias("record_id"), F.col("page_id").cast("long").alias("ts"), F.concat(front, F.regexp_extract("url", "[?#].*$", 0)).alias("asked"), dice.alias("dice"))
    version = F.floor(F.col("ts") * VERSIONS / F.lit(rows))
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.concat_ws(" ", canonical_url(F.col("asked")), version.cast("string"))), 1, 16), F.lit('"'))
    page = page.withColumns({"etag": F.when(F.substring("dice", 2, 1) < "c", tag), "last_modified": F.concat(F.lit("v"), F.floor(version / 2).cast("string")), "revisit": F.substring("dice", 1, 1) < "6"})
    common = ("record_id", F.col("asked").alias("url"), "ts", "etag", "last_modified")
    date = F.concat(F.lit("t"), F.col("ts").cast("string"))
    full = F.map_concat(F.create_map(F.lit("Content-Length"), F.length("html").cast("string"), F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), date), F.when(F.col("etag").isNotNull(), F.create_map(F.lit("ETag"), F.col("etag"))).otherwise(F.from_json(F.lit("{}"), "map<string,string>")))
    brief = F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Date"), date, F.lit("Server"), F.lit("s"))
    return page.where(~F.col("revisit")).select(*common, full.alias("headers")), page.where("revisit").select(*common, brief.alias("headers"))


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id, length(html) AS n, md5(page_id::VARCHAR) AS dice, page_id * 8 // (SELECT count(*) FROM pages) AS version,
    regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/?[^/?#]*)', 1), '/+$', '') AS folder,
    list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS args FROM pages
), asked AS (
  SELECT page_id, n, dice, version, nullif(host || folder || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END, '') AS url_key FROM parts
), events AS (
  SELECT page_id, n, url_key, substr(dice, 1, 1) < '6' AS revisit, 'v' || (version // 2) AS modified,
    CASE WHEN substr(dice, 2, 1) < 'c' THEN '"' || substr(md5(concat_ws(' ', url_key, version)), 1, 16) || '"' END AS etag FROM asked
), found AS (
  SELECT v.page_id AS record_id, v.url_key, r.page_id AS response_id, r.n, r.etag AS old_tag,
    CASE WHEN v.etag IS NOT NULL AND r.etag IS NOT NULL THEN v.etag = r.etag ELSE v.modified = r.modified END AS agrees
  FROM (SELECT * FROM events WHERE revisit) v ASOF LEFT JOIN (SELECT * FROM events WHERE NOT revisit) r ON v.url_key = r.url_key AND v.page_id > r.page_id
)
SELECT record_id, url_key, CASE WHEN response_id IS NULL THEN 'no_response' WHEN agrees THEN 'resolved' ELSE 'validator_mismatch' END AS status, response_id,
  CASE WHEN response_id IS NOT NULL AND agrees THEN 'content-length:' || n || '|content-type:text/html|date:t' || record_id || CASE WHEN old_tag IS NULL THEN '' ELSE '|etag:' || old_tag END END AS headers
FROM found
"""
