"""WARC records: resolving not-modified revisits.

A ``revisit`` record holds no payload, only the headers of a 304 answer.  It is resolved
by an as-of join: by canonical URL, to the latest earlier full response (type
``response``, status 200).  The validators must agree: entity tags (weak comparison) where
both sides have one, else Last-Modified, else payload digests.  A resolved revisit gets
the response's payload by reference (its record id, digest and length; ``with_payload``
fetches it) and the response's headers, overlaid with those of the revisit that a 304 may
change.

The as-of join needs no self-join and no task per URL: rows are dealt by (URL, time bin),
bins being quantiles of the whole table's times; inside a bin a window finds the latest
earlier response, and where there is none, the last response of the bins before it, taken
from one row per URL and bin.  So a URL with a third of all rows is spread over the bins.

Outcomes: ``full`` (the record is no revisit), ``resolved``, ``unverified`` (a response,
but no validator on both sides), ``mismatch`` (the latest earlier response has other
validators), ``orphan`` (no earlier full response, or no URL or time).

Defined results: rows are kept one to one, repeated rows too; responses at the revisit's
own time are not earlier; of several latest ones the largest record id counts; header
names are compared in lower case, of a repeated name the last value counts; null headers
are no headers; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fewlabel.llm.common import pick

BINS = 64
#: Headers of the stored response that a 304 does not change (fixed values of RFC 9111 and RFC 9110).
NOT_UPDATED = (
    "content-length", "content-encoding", "content-type", "content-range", "transfer-encoding", "connection", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "upgrade",
)
#: Query parameters that name a visit, not a resource.
TRACKING = "^(utm_[^=]*|ref|gclid|fbclid|sessionid|sid|phpsessid|jsessionid)(=|$)"

COLUMNS = {"record_id": "string", "type": "string", "uri": "string", "fetched": "timestamp", "status": "int",
           "headers": "map<string,string>", "digest": "string", "length": "bigint"}


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without trailing slashes, sorted query without
    tracking parameters; no scheme, no fragment.  Null for a text without scheme and host."""
    start = "^[A-Za-z][A-Za-z0-9+.-]*://"
    host = F.lower(F.regexp_extract(url, start + "([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, start + "[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(url, start + "[^?#]*[?]([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING))
    kept = F.array_join(F.array_sort(kept), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _lower_keys(headers: Column) -> Column:
    """The map with lower-case names; of equal names the last one stays."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.expr("cast(map() as map<string,string>)"))),
                          lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def merged_headers(stored: Column, update: Column) -> Column:
    """``stored`` with the values of ``update`` that a 304 may change."""
    allowed = F.map_filter(update, lambda k, _: ~k.isin(*NOT_UPDATED))
    rest = F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(rest, allowed)


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve_revisits(records: DataFrame, bins: int = BINS) -> DataFrame:
    """record_id, uri, canonical_url, fetched, type, outcome, refers_to, headers, digest, length of every record."""
    r = pick(records, **COLUMNS).withColumn("headers", _lower_keys(F.col("headers")))
    r = r.withColumn("canonical_url", canonical_url(F.col("uri"))).withColumn("at", F.unix_micros("fetched"))
    known = F.col("canonical_url").isNotNull() & F.col("at").isNotNull()
    cuts = r.where(known).select(F.percentile_approx("at", [i / bins for i in range(1, bins)], 10_000)).first()[0] or []
    # rows without URL or time are dealt by their own id
    r = r.withColumn("key", F.when(known, F.concat(F.lit("u"), "canonical_url")).otherwise(F.concat(F.lit("x"), F.coalesce("record_id", F.lit("")))))
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    r = r.withColumn("bin", F.coalesce(F.size(F.filter(bounds, lambda c: c < F.col("at"))), F.lit(0)))
    full = (F.col("type") == "response") & (F.col("status") == 200) & known
    response = F.struct(F.col("record_id").alias("id"), F.col("headers").alias("h"), F.col("digest").alias("d"), F.col("length").alias("n"))
    r = r.withColumn("resp", F.when(full, response)).withColumn("ord", F.when(full, F.struct("at", "record_id")))

    earlier = Window.partitionBy("key", "bin").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("inside", F.max_by("resp", "ord").over(earlier))
    per_bin = (r.where(full).groupBy("key", "bin").agg(F.max("ord").alias("ord"), F.max_by("resp", "ord").alias("resp")))
    # the bins of a URL: at most one row each, so this window is bounded by the number of bins
    marks = r.where(F.col("type") == "revisit").groupBy("key", "bin").agg(F.count(F.lit(1)).alias("n")).drop("n")
    before = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = (marks.join(per_bin, ["key", "bin"], "full_outer")
             .withColumn("carried", F.max_by("resp", "ord").over(before)).where(F.col("carried").isNotNull())
             .select("key", "bin", "carried"))
    r = r.join(carry, ["key", "bin"], "left")

    revisit = F.col("type") == "revisit"
    base = F.coalesce("inside", "carried")
    r = r.withColumn("base", F.when(revisit & known, base))
    stored, own = F.col("base.h"), F.col("headers")
    checks = [(_tag(stored), _tag(own)), (stored["last-modified"], own["last-modified"]), (F.col("base.d"), F.col("digest"))]
    same = F.lit(None).cast("boolean")
    for a, b in reversed(checks):
        same = F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(same)
    outcome = (F.when(~F.coalesce(revisit, F.lit(False)), "full").when(F.col("base").isNull(), "orphan")
               .when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch"))
    ok = F.col("outcome").isin("resolved", "unverified")
    return (r.withColumn("outcome", outcome).select(
        "record_id", "uri", "canonical_url", "fetched", "type", "outcome", F.when(ok, F.col("base.id")).alias("refers_to"),
        F.when(ok, merged_headers(stored, own)).otherwise(own).alias("headers"),
        F.when(ok, F.col("base.d")).otherwise(F.col("digest")).alias("digest"),
        F.when(ok, F.col("base.n")).otherwise(F.col("length")).alias("length")))


def header_text(headers: Column) -> Column:
    """``name: value`` lines in order of the names."""
    lines = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return F.array_join(lines, "\n")


def with_payload(resolved: DataFrame, records: DataFrame, payload: str = "payload") -> DataFrame:
    """``resolved`` with the payload of the record itself or of the response it refers to (record ids are unique)."""
    bodies = records.select(F.col("record_id").alias("_id"), F.col(payload).alias("payload"))
    return resolved.join(bodies, F.coalesce("refers_to", "record_id") == F.col("_id"), "left").drop("_id")


def crawl_of_pages(pages: DataFrame) -> DataFrame:
    """The capture log of a crawl that fetched every page and came back: a full response per page and up to three
    revisits, under other spellings of its URL; some before the response, some of a page changed meanwhile."""
    p = pick(pages, page_id="bigint", url="string", html="string").where(F.col("page_id").isNotNull())
    body = F.coalesce("html", F.lit(""))
    p = p.select("page_id", "url", F.md5(body).alias("digest"), F.octet_length(body).cast("bigint").alias("length"))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    begin = 1_700_000_000 + F.col("page_id") * 7

    def headers(*pairs: tuple[str, Column]) -> Column:
        return F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])

    full = F.struct(F.lit(0).alias("visit"), begin.alias("s"), F.lit("response").alias("type"), F.lit(200).alias("status"),
                    F.col("url").alias("uri"), headers(
                        ("Content-Type", F.lit("text/html; charset=utf-8")), ("ETag", tag), ("Content-Length", F.col("length").cast("string")),
                        ("Date", begin.cast("string")), ("Cache-Control", F.lit("max-age=60"))).alias("headers"))

    def revisit(visit: int) -> Column:
        at = begin + F.lit(visit * 86_400) - F.when(F.col("page_id") % 11 == 3, 4 * 86_400).otherwise(0)
        uri = (F.col("url") if visit == 1 else F.regexp_replace("url", "^https?://", "HTTP://WWW.") if visit == 2
               else F.regexp_replace("url", "#.*$", ""))
        changed = F.when((F.col("page_id") + visit) % 7 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))
        return F.struct(F.lit(visit).alias("visit"), at.alias("s"), F.lit("revisit").alias("type"), F.lit(304).alias("status"),
                        uri.alias("uri"), headers(
                            ("etag", changed), ("Content-Length", F.lit("0")), ("Date", at.cast("string")),
                            ("Cache-Control", F.lit(f"max-age={60 * visit}"))).alias("headers"))

    visits = F.filter(F.array(full, *[revisit(v) for v in (1, 2, 3)]), lambda x: x["visit"] <= F.col("page_id") % 4)
    v = p.select("page_id", "digest", "length", F.explode(visits).alias("v"))
    is_full = F.col("v.visit") == 0
    return v.select(
        F.concat_ws("-", F.col("page_id").cast("string"), F.col("v.visit").cast("string")).alias("record_id"), "v.type", "v.uri",
        F.timestamp_seconds("v.s").alias("fetched"), "v.status", "v.headers",
        F.when(is_full, F.col("digest")).alias("digest"), F.when(is_full, F.col("length")).alias("length"))


def revisit_sql(pages: str = "pages") -> str:
    """DuckDB SQL of the query's rows: the same capture log, an ASOF join, headers as text."""
    start = "^[A-Za-z][A-Za-z0-9+.-]*://"
    return f"""
with p as (select page_id, url, md5(coalesce(html, '')) digest, strlen(coalesce(html, '')) length, 1700000000 + page_id * 7 b,
                  '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' tag from {pages} where page_id is not null),
v as (select *, unnest(range(0, page_id % 4 + 1)) visit from p),
rec as (select page_id::varchar || '-' || visit::varchar record_id, page_id, visit, digest, length, tag, url,
               b + visit * 86400 - case when visit > 0 and page_id % 11 = 3 then 345600 else 0 end s,
               case visit when 2 then regexp_replace(url, '^https?://', 'HTTP://WWW.') when 3 then regexp_replace(url, '#.*$', '') else url end uri,
               case when (page_id + visit) % 7 = 0 then '"changed"' else tag end own_tag from v),
parts as (select *, regexp_replace(regexp_replace(lower(regexp_extract(uri, '{start}([^/?#]*)', 1)), '^www[.]', ''), ':(80|443)$', '') host,
               regexp_replace(regexp_extract(uri, '{start}[^/?#]*([^?#]*)', 1), '/+$', '') path,
               array_to_string(list_sort([x for x in string_split(regexp_extract(uri, '{start}[^?#]*[?]([^#]*)', 1), '&')
                                          if x <> '' and not regexp_matches(lower(x), '{TRACKING}')]), '&') q from rec),
c as (select *, case when host <> '' then host || path || case when q <> '' then '?' || q else '' end end canonical_url from parts),
f as (select canonical_url, s, max(record_id) record_id from c where visit = 0 and canonical_url is not null group by all),
m as (select c.*, f.record_id fid from (select * from c where visit > 0) c asof left join f on c.canonical_url = f.canonical_url and c.s > f.s),
j as (select m.*, g.tag btag, g.digest bd, g.length bl from m left join c g on g.record_id = m.fid),
o as (select *, case when fid is null then 'orphan' when btag = own_tag then 'resolved' else 'mismatch' end outcome from j)
select record_id, canonical_url, s fetched_s, 'revisit' "type", outcome, case when outcome = 'resolved' then fid end refers_to,
       case when outcome = 'resolved'
            then 'cache-control: max-age=' || visit * 60 || chr(10) || 'content-length: ' || bl || chr(10) || 'content-type: text/html; charset=utf-8' || chr(10) || 'date: ' || s || chr(10) || 'etag: W/' || own_tag
            else 'cache-control: max-age=' || visit * 60 || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || s || chr(10) || 'etag: ' || case when own_tag = '"changed"' then own_tag else 'W/' || own_tag end end headers,
       case when outcome = 'resolved' then bd end digest, case when outcome = 'resolved' then bl end length from o
union all
select record_id, canonical_url, s, 'response', 'full', null,
       'cache-control: max-age=60' || chr(10) || 'content-length: ' || length || chr(10) || 'content-type: text/html; charset=utf-8' || chr(10) || 'date: ' || s || chr(10) || 'etag: ' || tag, digest, length
from c where visit = 0"""
