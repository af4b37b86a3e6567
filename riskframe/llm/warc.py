"""WARC records: revisits that were answered "not modified", resolved to full responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.llm.common import column, table
from riskframe.session import materialize

# Headers that a "not modified" answer may bring up to date.
PERMITTED = (
    "age", "cache-control", "content-location", "date", "etag", "expires", "vary", "warning",
)
# Parameters of an address that do not choose its content.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)=|^$"


def canonical_url(url: Column) -> Column:
    """One form for all spellings of an address; null for a null or one without a host.

    Without scheme, user, fragment, default port, a leading "www." or "m.",
    trailing slashes and tracking parameters; host in lower case, parameters sorted.
    """
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(
        F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?:@]*)", 1)
    )
    port = F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?[^/?:@]*(:[0-9]+)", 1)
    path = F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    parameters = F.array_sort(
        F.filter(
            F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"),
            lambda p: ~F.regexp_like(p, F.lit(TRACKING)),
        )
    )
    whole = F.concat(
        F.regexp_replace(host, r"^(www|m)\.", ""),
        F.when(port.isin(":80", ":443"), F.lit("")).otherwise(port),
        F.regexp_replace(path, "/+$", ""),
        F.when(F.size(parameters) > 0, F.concat(F.lit("?"), F.array_join(parameters, "&"))).otherwise(
            F.lit("")
        ),
    )
    return F.when(host != "", whole)


def merge_headers(old: Column, new: Column) -> Column:
    """Headers of the response with those that the answer may replace.

    Names are compared, and returned, in lower case; of several spellings of a
    name in one map the last holds. A null map is empty.
    """

    def lowered(headers: Column) -> Column:
        entries = F.transform(
            F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
            lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
        )
        last = F.filter(
            entries,
            lambda e, i: ~F.exists(
                F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]
            ),
        )
        return F.map_from_entries(last)

    update = F.map_filter(lowered(new), lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(lowered(old), lambda k, _: ~F.map_contains_key(update, k))
    return F.map_concat(kept, update)


def same_validators(response: Column, revisit: Column) -> Column:
    """Whether the answer speaks of that response; null if it names no validator.

    An entity tag decides if the answer has one (weak and strong count alike),
    else the time of the last change. A payload digest, if named, must agree too.
    """

    def tag(c: Column) -> Column:
        return F.regexp_replace(c["etag"], r"^W/", "")

    by_validator = (
        F.when(revisit["etag"].isNotNull(), F.coalesce(tag(response) == tag(revisit), F.lit(False)))
        .when(
            revisit["last_modified"].isNotNull(),
            F.coalesce(response["last_modified"] == revisit["last_modified"], F.lit(False)),
        )
    )
    by_digest = F.when(
        revisit["digest"].isNotNull(), F.coalesce(response["digest"] == revisit["digest"], F.lit(False))
    )
    return F.when(by_validator.isNull(), by_digest).otherwise(
        by_validator & F.coalesce(by_digest, F.lit(True))
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each revisit beside the latest earlier full response of the same address.

    ``records`` has record_id, url, date (of any ordered type), kind ("response"
    for a full response, "revisit" for a "not modified" answer; others take no part), etag, last_modified,
    digest, headers (map of texts). Rows (record_id, url in its canonical form,
    date, outcome, response_id, response_date, digest, headers), one per revisit:

    * ``resolved``: the validators agree; the digest is that of the response, and
      the headers are the response's with permitted ones of the answer merged in.
    * ``unchecked``: the answer names no validator; resolved all the same.
    * ``changed``: the validators differ from that response's; ids only, since an
      older response would be a guess.
    * ``missing``: there is no earlier response, or address or date are null.

    Of records with the same address and date the smaller record_id is earlier,
    and null ids come first. Repeated rows each get a row.

    An address may own any part of the records: they are cut into ranges of
    (address, date, id), which split it. The latest response is looked up inside
    a range; only the response that a range begins with unknown is taken from
    the ranges before, one row each.
    """
    about = F.struct(
        column("record_id").alias("id"), column("date").alias("date"), "etag", "last_modified",
        "digest", "headers",
    )
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        canonical_url(F.col("url")).alias("url"), F.col("date"), F.col("record_id"),
        (F.col("kind") == "response").alias("full"), about.alias("about"),
    )
    placed = rows.where("url is not null and date is not null")
    order = ["url", "date", "record_id", "full"]
    placed = placed.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    placed = materialize(placed, "records")

    inside = Window.partitionBy("range", "url").orderBy(*order[1:])
    own = F.last(F.when(F.col("full"), F.col("about")), ignorenulls=True).over(
        inside.rowsBetween(Window.unboundedPreceding, -1)
    )
    ends = placed.groupBy("range").agg(F.min("url").alias("first"), F.max("url").alias("last"))
    ends = materialize(ends, "ranges")
    at_end = placed.join(
        ends.select(F.col("range").alias("_range"), F.col("last").alias("_last")),
        (F.col("range") == F.col("_range")) & (F.col("url") == F.col("_last")),
    ).groupBy("range", "url").agg(
        F.max_by(
            F.when(F.col("full"), F.col("about")),
            F.when(F.col("full"), F.struct("date", "record_id")),
        ).alias("about"),
    )
    nothing = F.lit(None).cast(at_end.schema["about"].dataType)
    marks = at_end.select("range", "url", F.lit(1).alias("side"), "about").union(
        ends.select("range", F.col("first").alias("url"), F.lit(0).alias("side"), nothing)
    )
    before = Window.partitionBy("url").orderBy("range", "side")
    carried = marks.withColumn(
        "carried",
        F.last("about", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)),
    ).where("side = 0 and carried is not null")
    carried = carried.select(
        F.col("range").alias("_range"), F.col("url").alias("_url"), "carried"
    )
    found = (
        placed.withColumn("own", own)
        .where(~F.col("full"))
        .join(carried, (F.col("range") == F.col("_range")) & (F.col("url") == F.col("_url")), "left")
        .select("record_id", "url", "date", "about", F.coalesce("own", "carried").alias("response"))
    )
    strays = rows.where("(url is null or date is null) and not full").select(
        "record_id", "url", "date", "about", F.lit(None).cast(found.schema["response"].dataType).alias("response")
    )
    agree = same_validators(F.col("response"), F.col("about"))
    outcome = (
        F.when(F.col("response").isNull(), F.lit("missing"))
        .when(agree.isNull(), F.lit("unchecked"))
        .when(agree, F.lit("resolved"))
        .otherwise(F.lit("changed"))
    )
    whole = F.col("outcome").isin("resolved", "unchecked")
    return (
        found.union(strays)
        .withColumn("outcome", outcome)
        .select(
            "record_id", "url", "date", "outcome",
            F.col("response.id").alias("response_id"),
            F.col("response.date").alias("response_date"),
            F.when(whole, F.col("response.digest")).alias("digest"),
            F.when(
                whole, merge_headers(F.col("response.headers"), F.col("about.headers"))
            ).alias("headers"),
        )
    )


def records_of(pages: DataFrame) -> DataFrame:
    """Records of a crawl over the given pages: a response, and two answers each.

    Page n is fetched in second 60 n. It is asked for again a day later, when
    every seventh page has changed and every fifth server sends no entity tag but
    the time of the last change; and half a minute before the fetch, which only
    an earlier page of the same address can answer.
    """
    number = F.col("page_id")
    digest = F.md5(F.coalesce("html", F.lit("")))
    tag = F.when(number % 5 != 0, F.concat(F.lit('"'), F.substring(digest, 1, 12), F.lit('"')))
    changed = F.when(number % 5 != 0, F.concat(F.lit('"'), F.substring(digest, 13, 12), F.lit('"')))
    modified = F.concat(F.lit("day "), (number % 28).cast("string"))
    full = F.struct(
        (number * 4).alias("record_id"), (number * 60).alias("date"), F.lit("response").alias("kind"),
        tag.alias("etag"), modified.alias("last_modified"), digest.alias("digest"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html"),
            F.lit("Content-Length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"),
            F.lit("Cache-Control"), F.concat(F.lit("max-age="), (number % 100).cast("string")),
        ).alias("headers"),
    )

    def answer(place: int, later: int) -> Column:
        return F.struct(
            (number * 4 + place).alias("record_id"), (number * 60 + later).alias("date"),
            F.lit("revisit").alias("kind"),
            F.when(number % 7 == 0, changed).otherwise(F.concat(F.lit("W/"), tag)).alias("etag"),
            modified.alias("last_modified"), F.lit(None).cast("string").alias("digest"),
            F.create_map(
                F.lit("cache-control"), F.lit("no-cache"), F.lit("content-length"), F.lit("0"),
                F.lit("Expires"), F.concat(F.lit("day "), (number % 9).cast("string")),
            ).alias("headers"),
        )

    records = F.array(full, answer(1, 86_400), answer(2, -30))
    return pages.select("url", F.explode(records).alias("r")).select("url", "r.*")


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisits of a crawl over all pages, with merged headers as sorted lines."""
    found = resolve_revisits(records_of(table(spark, sf_dir, "pages")))
    lines = F.array_sort(
        F.transform(
            F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])
        )
    )
    return found.withColumn("headers", F.array_join(lines, "\n"))


OP4_SQL = r"""
WITH plain AS (
    SELECT *, regexp_replace(trim(url), '#.*$', '') AS u FROM pages
), parts AS (
    SELECT *,
        lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?:@]*)', 1)) AS host,
        regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?[^/?:@]*(:[0-9]+)', 1) AS port,
        regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) AS path,
        list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
            lambda p: NOT regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|ref)=|^$'))) AS params
    FROM plain
), named AS (
    SELECT page_id AS n, coalesce(html, '') AS body, md5(coalesce(html, '')) AS d,
        CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '')
            || CASE WHEN port IN (':80', ':443') THEN '' ELSE port END
            || regexp_replace(path, '/+$', '')
            || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END
        END AS url
    FROM parts
), responses AS (
    SELECT n * 4 AS id, n * 60 AS date, url, d,
        CASE WHEN n % 5 <> 0 THEN '"' || d[1:12] || '"' END AS etag,
        'day ' || (n % 28) AS modified, octet_length(encode(body)) AS size
    FROM named WHERE url IS NOT NULL
), revisits AS (
    SELECT n * 4 + p.place AS record_id, n * 60 + p.later AS date, url, n,
        CASE WHEN n % 5 <> 0 THEN
            CASE WHEN n % 7 = 0 THEN '"' || d[13:24] || '"' ELSE '"' || d[1:12] || '"' END
        END AS etag,
        'day ' || (n % 28) AS modified
    FROM named, (VALUES (1, 86400), (2, -30)) p(place, later)
), matched AS (
    SELECT v.record_id, v.url, v.date, v.n, v.etag AS v_etag, v.modified AS v_modified, r.*
        EXCLUDE (url, date), r.date AS response_date,
        row_number() OVER (PARTITION BY v.record_id ORDER BY r.date DESC, r.id DESC) AS place
    FROM revisits v LEFT JOIN responses r ON r.url = v.url
        AND (r.date < v.date OR (r.date = v.date AND r.id < v.record_id))
), judged AS (
    SELECT *, CASE WHEN id IS NULL THEN 'missing'
        WHEN v_etag IS NOT NULL THEN
            CASE WHEN coalesce(etag = v_etag, false) THEN 'resolved' ELSE 'changed' END
        WHEN modified = v_modified THEN 'resolved' ELSE 'changed' END AS outcome
    FROM matched WHERE place = 1
)
SELECT record_id, url, date, outcome, id AS response_id, response_date,
    CASE WHEN outcome = 'resolved' THEN d END AS digest,
    CASE WHEN outcome = 'resolved' THEN 'cache-control: no-cache' || chr(10) || 'content-length: ' || size
        || chr(10) || 'content-type: text/html' || chr(10) || 'expires: day ' || (n % 9) END AS headers
FROM judged
"""
