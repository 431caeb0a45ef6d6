"""URL filters: a temporal list join.

A list is a log of dated entries: a pattern is added or removed at a time.  Each
pattern's entries become validity intervals, and every capture is evaluated
against those in force when it was fetched (an as-of join).  A pattern is a
domain or host, which covers what lies below it, or a host with the first
segments of a path.

A capture has few patterns that could cover it, so the join is an equi-join on
the pattern.  Intervals are also dealt to spans of time, and captures meet only
those of their own span: neither a pattern with a long history nor one that
covers a third of all captures makes a task of its own, and Spark may split
either.  A list that is small by its counted bytes is broadcast instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Seconds of a span of time, and bytes of intervals up to which they are broadcast.
SPAN, BROADCAST_BYTES = 32 * 86_400, 32 << 20


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def patterns(url: Column) -> Column:
    """All patterns that cover a URL: its host and the domains above it of two
    labels or more, and its host with one and two path segments."""
    name = host(url)
    labels = F.split(name, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]+((?:/[^/?#]+){1,2})", 1)
    one = F.regexp_extract(path, r"^/[^/]+", 0)
    deep = F.array_distinct(F.filter(F.array(one, path), lambda p: p != ""))
    every = F.concat(above, F.transform(deep, lambda p: F.concat(name, p)))
    return F.when(name != "", every).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to): where a pattern is listed, from entries
    (pattern, action, effective_at).  Of entries of one moment a removal wins; an
    addition of what is listed, or a removal of what is not, changes nothing.
    Open intervals end in the year 9999; entries without pattern, time or a
    known action are left out."""
    known = entries.where("pattern is not null and effective_at is not null and action in ('add', 'remove')")
    # one row for each moment: 'remove' sorts after 'add'
    at = known.groupBy("pattern", "effective_at").agg(F.max("action").alias("action"))
    order = W.partitionBy("pattern").orderBy("effective_at")
    change = at.withColumn("before", F.lag("action").over(order)).where("action <> coalesce(before, 'remove')")
    end = F.lead("effective_at").over(order)
    spans = change.withColumn("valid_to", F.coalesce(end, F.lit("9999-12-31").cast("timestamp")))
    return spans.where("action = 'add'").select("pattern", F.col("effective_at").alias("valid_from"), "valid_to")


def _span(t: Column) -> Column:
    return F.floor(F.unix_timestamp(t) / SPAN)


def evaluate(captures: DataFrame, entries: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``captures`` (with url, fetched_at) with blocked, matched_pattern (the most
    specific in force: the longest, then the greatest) and n_matches.

    A null or unreadable URL, or a null time, is covered by nothing; repeated
    rows are judged once and each keeps its row; an empty list blocks nothing, and
    no captures give none; a URL of any length has the patterns of its host and
    first two path segments, whole;
    columns of the captures stay, those with the result's names are replaced.
    """
    keep = [c for c in captures.columns if c not in ("blocked", "matched_pattern", "n_matches")]
    captures = captures.select(*keep)
    valid = intervals(entries)
    # clip open ends to the time that captures span, so that an interval has a bounded number of spans
    reach = captures.agg(F.min("fetched_at").alias("lo"), F.max("fetched_at").alias("hi")).first()
    distinct = captures.where("url is not null and fetched_at is not null").select("url", "fetched_at").distinct()
    valid = valid.where((F.col("valid_to") > F.lit(reach["lo"])) & (F.col("valid_from") <= F.lit(reach["hi"])))
    first = _span(F.greatest("valid_from", F.lit(reach["lo"]).cast("timestamp")))
    last = _span(F.least("valid_to", F.lit(reach["hi"]).cast("timestamp")))
    valid = valid.withColumn("span", F.explode(F.sequence(first, last)))
    size = valid.agg(F.coalesce(F.sum(F.octet_length("pattern") + 64), F.lit(0))).first()[0]
    keyed = distinct.select("url", "fetched_at", F.explode(patterns(F.col("url"))).alias("pattern")).withColumn("span", _span(F.col("fetched_at")))
    met = keyed.join(F.broadcast(valid) if size <= broadcast_bytes else valid, ["pattern", "span"])
    met = met.where("valid_from <= fetched_at and fetched_at < valid_to")
    best = F.max(F.struct(F.length("pattern").alias("n"), F.col("pattern"))).getField("pattern")
    found = met.groupBy("url", "fetched_at").agg(best.alias("matched_pattern"), F.count(F.lit(1)).alias("n_matches"))
    out = captures.join(found, ["url", "fetched_at"], "left")
    return out.select(*keep, F.col("matched_pattern").isNotNull().alias("blocked"), "matched_pattern", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: each is fetched at a moment of 60 days that its number gives."""
    second = F.col("page_id") * 7919 % (60 * 86_400)
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + second).alias("fetched_at"))


def page_list(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own hosts, folders and domains: hosts whose
    name has a length that 3 divides are added, removed and added again; folders
    come and go once; every domain is listed for two days."""
    name = host(F.col("url"))
    folder = F.concat(name, F.regexp_extract("url", r"^[^:]+://[^/?#]+(/[^/?#]+)", 1))
    domain = F.regexp_extract(name, r"[^.]+\.[^.]+$", 0)
    n = F.length("pattern")
    hosts = pages.select(name.alias("pattern")).distinct().where((F.col("pattern") != "") & (n % 3 == 0))
    folders = pages.select(folder.alias("pattern")).distinct().where(F.col("pattern").contains("/") & (n % 4 == 1))
    domains = pages.select(domain.alias("pattern")).distinct().where("pattern <> ''")

    def log(of: DataFrame, *moves: tuple[str, Column]) -> DataFrame:
        day = lambda c: F.timestamp_seconds(F.lit(1_704_067_200) + c * 86_400)
        rows = F.array(*[F.struct(F.lit(a).alias("action"), day(c).alias("effective_at")) for a, c in moves])
        return of.select("pattern", F.explode(rows).alias("m")).select("pattern", "m.*")

    return (
        log(hosts, ("add", n % 20), ("remove", n % 20 + 15), ("add", n % 20 + 30))
        .unionByName(log(folders, ("add", n % 40), ("remove", n % 40 + 10)))
        .unionByName(log(domains, ("add", F.lit(50)), ("remove", F.lit(52))))
    )


#: The same as DuckDB SQL over ``pages``.
ORACLE = r"""
WITH p AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
         regexp_extract(url, '^[^:]+://[^/?#]+(/[^/?#]+)', 1) AS one,
         regexp_extract(url, '^[^:]+://[^/?#]+((/[^/?#]+)(/[^/?#]+)?)', 1) AS path,
         page_id * 7919 % 5184000 AS sec
  FROM pages),
listed AS (
  SELECT DISTINCT host AS pattern, 'h' AS kind FROM p WHERE host <> '' AND length(host) % 3 = 0
  UNION ALL SELECT DISTINCT host || one, 'f' FROM p WHERE one <> '' AND length(host || one) % 4 = 1
  UNION ALL SELECT DISTINCT regexp_extract(host, '[^.]+\.[^.]+$', 0), 'd' FROM p WHERE regexp_extract(host, '[^.]+\.[^.]+$', 0) <> ''),
valid AS (
  SELECT pattern, length(pattern) % 20 * 86400 AS a, (length(pattern) % 20 + 15) * 86400 AS b FROM listed WHERE kind = 'h'
  UNION ALL SELECT pattern, (length(pattern) % 20 + 30) * 86400, 1000000000 FROM listed WHERE kind = 'h'
  UNION ALL SELECT pattern, length(pattern) % 40 * 86400, (length(pattern) % 40 + 10) * 86400 FROM listed WHERE kind = 'f'
  UNION ALL SELECT pattern, 50 * 86400, 52 * 86400 FROM listed WHERE kind = 'd'),
keys AS (
  SELECT page_id, sec, host AS pattern FROM p WHERE host <> ''
  UNION SELECT page_id, sec, regexp_extract(host, '[^.]+\.[^.]+$', 0) FROM p
  UNION SELECT page_id, sec, regexp_extract(host, '[^.]+\.[^.]+\.[^.]+$', 0) FROM p
  UNION SELECT page_id, sec, host || one FROM p WHERE one <> ''
  UNION SELECT page_id, sec, host || path FROM p WHERE path <> ''),
met AS (SELECT DISTINCT k.page_id, k.pattern FROM keys k JOIN valid v ON k.pattern = v.pattern AND v.a <= k.sec AND k.sec < v.b),
best AS (
  SELECT page_id, pattern, count(*) OVER (PARTITION BY page_id) AS n,
         row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern DESC) AS r
  FROM met)
SELECT p.page_id, p.url, best.pattern IS NOT NULL AS blocked, best.pattern AS matched_pattern, coalesce(best.n, 0) AS n_matches
FROM p LEFT JOIN best ON p.page_id = best.page_id AND best.r = 1
"""
