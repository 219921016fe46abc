"""Resolving WARC revisit records of the profile server-not-modified.

A revisit is matched with the latest earlier full response of its canonical URL (an as-of join). Its validators must agree
with that response's: a weak comparison of ETags, else Last-Modified, else the payload digest. Where they do, the resolved
record has the response's status and payload and its headers, updated with those that a 304 response may bring.

The as-of join sorts all records by URL and time in ranges, and looks back within each range; what a range needs from before
it is one record for each URL and range, so a URL with any share of all captures is spread over as many tasks as it fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import kept

#: Header fields that a 304 response may bring (RFC 9110, 15.4.5; fixed values).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not tell pages apart (fixed values; utm_* too).
TRACKING = ("fbclid", "gclid", "ref", "sessionid")
RECORD = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, payload_digest string"


def canonical(url: Column) -> Column:
    """Scheme and `www.` dropped, host in lower case without its default port, no fragment, no tracking parameters, the
    others in order, no slash at the end. Null stays null."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(plain, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), "^www\\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "^[^?]*\\?(.*)$", 1)
    dropped = "^(utm_[^=]*|" + "|".join(TRACKING) + ")(=|$)"
    wanted = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(dropped)))
    return F.concat(host, path, F.when(F.size(wanted) > 0, F.concat(F.lit("?"), F.array_join(wanted, "&"))).otherwise(""))


def lowered(headers: Column) -> Column:
    """Headers with names in lower case; null as none. Of names that differ in case only, the last in order stays."""
    pairs = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    names = F.transform(pairs, lambda p: F.lower(p.key))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(F.lower(p.key).alias("key"), p.value.alias("value"), i.alias("i"))), lambda p: ~F.array_contains(F.slice(names, p.i + 2, F.size(names)), p.key))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p.key, p.value)))


def weak(etag: Column) -> Column:
    """An ETag for weak comparison."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """A row for each revisit (kind 'revisit') of `records` (the columns of RECORD; others are ignored): record_id, url_key,
    ts, matched_id, matched_ts, verdict, status, payload_digest, headers ('name: value' lines in order of names).

    Verdicts: resolved; no-response (none is earlier, or the URL or time is null: it matches nothing); etag-mismatch,
    date-mismatch, digest-mismatch; no-validator (the two share none). Only a resolved one has status, digest and headers.
    Full responses are kind 'response' with status 200; at equal times a response comes before a revisit, and of several the one with
    the largest record_id counts. Repeated revisits have a row each; an empty table gives none."""
    own = records.select("record_id", canonical(F.col("url")).alias("url_key"), "ts", F.col("kind") == "response", "status", lowered(F.col("headers")).alias("headers"), "payload_digest").toDF("record_id", "url_key", "ts", "full", "status", "headers", "payload_digest")
    own = own.filter(~F.col("full") | (F.col("status") == 200) & F.col("url_key").isNotNull() & F.col("ts").isNotNull())
    order = ["url_key", "ts", F.desc("full"), "record_id"]
    ranged = kept(own.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "captures")
    response = F.when(F.col("full"), F.struct(F.col("record_id").alias("id"), "ts", "status", "headers", "payload_digest"))
    within = Window.partitionBy("range", "url_key").orderBy("ts", F.desc("full"), "record_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = ranged.withColumn("match", F.last(response, ignorenulls=True).over(within))
    # the last response of each URL in each range, carried to the ranges after it
    lasts = ranged.groupBy("url_key", "range").agg(F.max_by(response, F.when(F.col("full"), F.struct("ts", "record_id"))).alias("last"))
    before = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.withColumn("carried", F.last("last", ignorenulls=True).over(before)).select(F.col("url_key").alias("u"), F.col("range").alias("r"), "carried").filter(F.col("carried").isNotNull())
    asked = seen.filter(~F.col("full"))
    found = asked.join(carried, (asked["url_key"] == carried["u"]) & (asked["range"] == carried["r"]), "left")
    known = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    found = found.withColumn("m", F.when(known, F.coalesce("match", "carried")))
    mine, theirs = F.col("headers"), F.col("m.headers")
    both = lambda name: mine[name].isNotNull() & theirs[name].isNotNull()
    verdict = (
        F.when(F.col("m").isNull(), "no-response")
        .when(both("etag"), F.when(weak(mine["etag"]) == weak(theirs["etag"]), "resolved").otherwise("etag-mismatch"))
        .when(both("last-modified"), F.when(mine["last-modified"] == theirs["last-modified"], "resolved").otherwise("date-mismatch"))
        .when(F.col("payload_digest").isNotNull() & F.col("m.payload_digest").isNotNull(), F.when(F.col("payload_digest") == F.col("m.payload_digest"), "resolved").otherwise("digest-mismatch"))
        .otherwise("no-validator")
    )
    update = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda p: F.concat_ws(": ", p.key, p.value)), "\n")
    done = F.col("verdict") == "resolved"
    out = found.withColumn("verdict", verdict)
    return out.select("record_id", "url_key", "ts", F.col("m.id").alias("matched_id"), F.col("m.ts").alias("matched_ts"), "verdict", F.when(done, F.col("m.status")).alias("status"), F.when(done, F.col("m.payload_digest")).alias("payload_digest"), F.when(done, lines).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """The table `pages` as a crawl that went over it three times: each page's response at time page_id; a revisit of it
    later, by another spelling of its URL, whose ETag is weak (every fifth one's is another page state's); and, before
    anything, a revisit of every seventh page, which has no response to refer to."""
    digest, fourth = F.md5(F.col("html").cast("binary")), F.pmod("page_id", F.lit(4))
    later = F.lit(1_000_000_000)
    etag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), F.pmod("page_id", F.lit(28)).cast("string"))
    none = F.lit(None).cast("string")
    response = pages.select((F.col("page_id") * 3).alias("record_id"), "url", F.col("page_id").alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), F.map_filter(F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length("html").cast("string"), F.lit("ETag"), F.when(fourth != 3, etag), F.lit("Last-Modified"), F.when(fourth != 2, day), F.lit("Date"), F.col("page_id").cast("string")), lambda k, v: v.isNotNull()).alias("headers"), digest.alias("payload_digest"))
    other = F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))
    sent = F.map_filter(F.create_map(F.lit("ETAG"), F.when(fourth != 3, F.when(F.pmod("page_id", F.lit(5)) == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), etag))), F.lit("last-modified"), F.when(fourth == 3, day), F.lit("Content-Length"), F.lit("0"), F.lit("Expires"), F.lit("soon"), F.lit("Date"), (F.col("page_id") + later).cast("string")), lambda k, v: v.isNotNull())
    revisit = pages.select((F.col("page_id") * 3 + 1).alias("record_id"), other.alias("url"), (F.col("page_id") + later).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), sent.alias("headers"), none.alias("payload_digest"))
    early = pages.filter(F.pmod("page_id", F.lit(7)) == 0).select((F.col("page_id") * 3 + 2).alias("record_id"), "url", F.lit(-1).cast("long").alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), sent.alias("headers"), none.alias("payload_digest"))
    return response.unionByName(revisit).unionByName(early)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: what each revisit of the crawl of all pages resolves to."""
    return resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")))


ORACLE_SQL = {
    "op3_warc_revisits": r"""
with p as (
  select page_id, url, md5(html) as digest, length(html) as n, '"' || substr(md5(html), 1, 16) || '"' as etag,
    'day ' || (page_id % 28) as day,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest
  from pages),
k as (
  select *, regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^www\.|:(80|443)$', '', 'g')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') as base,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'),
      lambda q: q <> '' and not regexp_matches(q, '^(utm_[^=]*|fbclid|gclid|ref|sessionid)(=|$)'))) as args
  from p),
c as (select *, base || case when len(args) > 0 then '?' || array_to_string(args, '&') else '' end as url_key from k),
latest as (select url_key, max(page_id) as page_id from c group by url_key),
m as (select c.* from c join latest using (url_key, page_id)),
later as (
  select r.page_id * 3 + 1 as record_id, r.url_key, r.page_id + 1000000000 as ts, m.page_id * 3 as matched_id, m.page_id as matched_ts,
    case when r.page_id % 4 <> 3 and m.page_id % 4 <> 3 then
        case when r.page_id % 5 <> 0 and r.etag = m.etag then 'resolved' else 'etag-mismatch' end
      when r.page_id % 4 = 3 and m.page_id % 4 <> 2 then case when r.day = m.day then 'resolved' else 'date-mismatch' end
      else 'no-validator' end as verdict,
    m.digest, m.n, r.page_id as own, r.etag as sent, m.day as stored_day, m.page_id as stored, r.day as own_day
  from c r join m using (url_key))
select record_id, url_key, ts, matched_id, matched_ts, verdict,
  cast(case when verdict = 'resolved' then 200 end as integer) as status,
  case when verdict = 'resolved' then digest end as payload_digest,
  case when verdict = 'resolved' then 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10)
    || case when own % 4 <> 3 then 'etag: W/' || sent || chr(10) else case when stored % 4 <> 3 then 'etag: ' || '"' || substr(digest, 1, 16) || '"' || chr(10) else '' end end
    || 'expires: soon'
    || case when own % 4 = 3 then chr(10) || 'last-modified: ' || own_day when stored % 4 <> 2 then chr(10) || 'last-modified: ' || stored_day else '' end
  end as headers
from later
union all
select page_id * 3 + 2, url_key, -1, null, null, 'no-response', null, null, null from c where page_id % 7 = 0
"""
}
QUERIES = {"op3_warc_revisits": query}
