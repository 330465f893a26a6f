"""URL filters by a sort-merge range join on reversed-host keys.

A host is keyed by its labels in reverse (``www.example.net`` -> ``net.example.www.``), so that a host and all its
subdomains form one interval of keys and the intervals of all rules are nested or disjoint.  Urls and rules meet in
one sort order.  A sweep over each sorted partition keeps a stack of the rule hosts whose interval is open; a url is
held only against the rules on that stack, longest path first.

Partitions are ranges of (host key, path, page_id), so a host that holds a third of all urls spreads over many of
them.  The split points come from a bounded sample of keys (``SAMPLE`` a partition).  A partition that begins inside
an interval gets the rules that are open there: the prefixes of its first key, joined with the rules by equality.

Defined results: a null url or one without ``://`` has an empty host and path and fits no rule; of rules that fit the
longest string wins, then the longer host, then block before allow; repeated rules and pages are kept as they are
(a page row stays one row, also with a null page_id); a very long url is a key like any other and its path is compared as a whole; an
empty rule table leaves the default verdict; other columns of either table are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, hash_sample, partitions, table

#: Rules of the query: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Keys sampled for each partition to find the split points.
SAMPLE = 64


def url_host(url: Column) -> Column:
    """What lies between the first :// and the next /, ? or #, with A-Z in lower case; empty if there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each ended by a dot: a host's key is a prefix of those of its subdomains only."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def split_points(keyed: DataFrame, n: int, urls: int) -> list[tuple[str, str, int]]:
    """n - 1 or fewer keys that cut the urls into ranges of similar size, from SAMPLE * n rows taken by hash."""
    if n < 2:
        return []
    pick = hash_sample(keyed.select("hkey", "path", "page_id"), SAMPLE * n, "page_id", "path", rows=urls)
    rows = sorted((r[0], r[1], r[2] if r[2] is not None else -(1 << 63)) for r in pick.collect())
    return sorted({rows[i * len(rows) // n] for i in range(1, n)}) if rows else []


def sweep(batches: Iterator[pa.RecordBatch], default: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (pid, hkey, kind, path): the rules (kind 0) of a host come before urls (kind 1) with that key."""
    stack: list[tuple[str, dict[str, tuple], list[int]]] = []  # open interval, its rules by path, lengths of their paths
    for batch in batches:
        ids, hosts, paths, verdicts, rules = [], [], [], [], []
        for kind, hkey, page, host, path, verdict in zip(*(batch.column(i).to_pylist() for i in range(6))):
            while stack and not hkey.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != hkey:
                    stack.append((hkey, {}, []))
                at = stack[-1]
                if path not in at[1]:
                    at[2].append(len(path))
                    at[1][path] = (host + path, len(host), verdict)
                    at[2].sort(reverse=True)
                elif verdict == "block":
                    at[1][path] = (host + path, len(host), verdict)
                continue
            best = None
            if host:
                for _, by_path, lengths in stack:
                    last = -1
                    for n in lengths:
                        if n == last or n > len(path):
                            continue
                        last = n
                        found = by_path.get(path[:n])
                        if found is not None:
                            if best is None or (len(found[0]), found[1]) > (len(best[0]), best[1]):
                                best = found
                            break
            ids.append(page)
            hosts.append(host)
            paths.append(path)
            rules.append(best[0] if best else None)
            verdicts.append(best[2] if best else default)
        if ids:
            yield batch_of(schema, ids, hosts, paths, rules, verdicts)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages (page_id, url) judged by rules (verdict, host, path): page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    urls = pages.select(F.col("page_id").cast("bigint").alias("page_id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    keyed = urls.withColumn("hkey", host_key(F.col("host")))
    rule_rows = rules.select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null and host <> ''").withColumn("hkey", host_key(F.col("host")))
    n = partitions(spark)
    points = split_points(keyed, n, pages.count())
    cuts = spark.sparkContext.broadcast(points)  # at most one for each partition

    def pid_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = cuts.value
        for b in batches:
            keys = zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("hkey", "from_path", "page_id")))
            pids = pa.array([bisect_right(at, (h, p, -(1 << 63) if i is None else i)) for h, p, i in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([pids, *b.columns[:-1]], names=["pid", *b.schema.names[:-1]])

    shape = "pid int, kind int, hkey string, page_id bigint, host string, path string, verdict string"
    null = lambda kind: F.lit(None).cast(kind)
    placed = keyed.select(F.lit(1).alias("kind"), "hkey", "page_id", "host", "path", null("string").alias("verdict"), F.col("path").alias("from_path")).mapInArrow(pid_of, shape)
    # A rule is needed where its interval begins, and in every partition that begins within it.
    rule_rows = rule_rows.select(F.lit(0).alias("kind"), "hkey", null("bigint").alias("page_id"), "host", "path", "verdict")
    begun = rule_rows.withColumn("from_path", F.lit("")).mapInArrow(pid_of, shape)
    firsts = spark.createDataFrame([(p[0], i + 1) for i, p in enumerate(points)], "first_key string, pid int")
    labels = F.split("first_key", "[.]")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda k: F.concat(F.array_join(F.slice(labels, 1, k), "."), F.lit(".")))
    opened = firsts.where("first_key <> ''").select("pid", F.explode(prefixes).alias("hkey"))
    carried = rule_rows.join(opened, "hkey").select("pid", *rule_rows.columns)
    events = begun.unionByName(carried)
    merged = placed.unionByName(events).repartitionById(len(points) + 1, F.col("pid")).sortWithinPartitions("hkey", "kind", "path", "page_id")
    out = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
    return merged.select("kind", "hkey", "page_id", "host", "path", "verdict").mapInArrow(lambda it: sweep(it, default, out), "page_id bigint, host string, path string, rule string, verdict string")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


OP1_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM u
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), m AS (
  SELECT p.page_id, p.host, p.path, r.verdict, r.rhost || r.rpath AS rule,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rhost || r.rpath) DESC, length(r.rhost) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
