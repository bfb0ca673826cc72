"""URL filters by a sort-merge range join (native: DataFrame and SQL functions only).

A host's labels are reversed, so that a rule for a host and its subdomains is an interval
of canonical keys (``com.example.`` up to ``com.example.`` + 0xFF), and a path prefix is one
too. Intervals of prefixes nest or are disjoint. A sorted sweep over starts, ends and points
keeps the stack of active intervals: the running sum of +1 and -1 is the stack's height, and
the stack's entry at level l is the last start seen at level l.

The sweep is distributed: events are range-partitioned by key and written; each part's
height change and its last start at each level are carried to later parts by a prefix over
one row per part (and level). Points are distinct keys, so a hot host or url is one point, and
there is no hot key.

Two sweeps follow each other: distinct hosts against rule hosts (all active levels), then
distinct (rule host, path) pairs against path prefixes (the innermost level); so neither
many rules on one host nor many urls meet in one task.

Defined results: null urls and urls without ``://`` have empty host and path, and no rule fits
them; the rule with the most characters wins; where rules repeat, block wins over allow; rules
with a null or empty host never fit; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyspark.llm import common as C

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DEFAULT = "allow"


def parts(url) -> tuple:
    """Host and path of a url, empty where it has none."""
    u = F.coalesce(url, F.lit(""))
    return C.ascii_lower(F.regexp_extract(u, URL, 1)), F.regexp_extract(u, URL, 2)


def reversed_host(host):
    """``www.example.com`` as ``com.example.www.``."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def stab(points: DataFrame, starts: DataFrame, every_level: bool) -> DataFrame:
    """points: (point, key binary), starts: (id, key binary), all distinct; an interval holds all keys that begin with its own.

    Rows (point, id): every interval that holds the point, or only the innermost."""
    n = max(8, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    nothing = F.lit(None).cast("string")
    events = (
        points.select("key", F.lit(2).alias("kind"), F.lit(0).alias("step"), "point", nothing.alias("id"))
        .unionByName(starts.select("key", F.lit(1).alias("kind"), F.lit(1).alias("step"), nothing.alias("point"), "id"))
        .unionByName(starts.select(F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(0).alias("kind"), F.lit(-1).alias("step"), nothing.alias("point"), nothing.alias("id")))
    )
    events = C.stored(events.repartitionByRange(n, "key", "kind").withColumn("part", F.spark_partition_id()), "sweep")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heights = events.groupBy("part").agg(F.sum("step").alias("change")).select("part", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("height_before"))
    order = Window.partitionBy("part").orderBy("key", "kind")
    high = F.col("height_before") + F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = events.where("kind > 0 OR step < 0").join(heights, "part").withColumn("height", high).where("height > 0 AND kind > 0")
    levels = F.sequence(F.lit(1), F.col("height").cast("int")) if every_level else F.array(F.col("height").cast("int"))
    asked = swept.withColumn("level", F.explode(F.when(F.col("kind") == 1, F.array(F.col("height").cast("int"))).otherwise(levels)))
    asked = C.stored(asked.select("part", "key", "kind", "point", "id", "level"), "levels")
    ends = asked.groupBy("part", "level").agg(F.max_by("id", F.when(F.col("kind") == 1, F.col("key"))).alias("last"))
    carried = ends.select("part", "level", F.last("last", True).over(Window.partitionBy("level").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = F.last("id", True).over(Window.partitionBy("part", "level").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = asked.withColumn("inside", inside).where("kind = 2").join(carried, ["part", "level"])
    return found.select("point", F.coalesce("inside", "carried").alias("id"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """rules: (verdict, host, path). One row per page: page_id, host, path, rule, verdict."""
    host, path = parts(F.col(url))
    base = C.stored(pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")), "urls")
    given = rules.where("host <> ''").groupBy("host", F.coalesce("path", F.lit("")).alias("path")).agg(F.max("verdict").alias("verdict"))
    hosts = base.where("host <> ''").select("host").distinct().select(F.col("host").alias("point"), F.encode(reversed_host(F.col("host")), "UTF-8").alias("key"))
    owners = given.select("host").distinct().select(F.col("host").alias("id"), F.encode(reversed_host(F.col("host")), "UTF-8").alias("key"))
    owned = stab(hosts, owners, True).select(F.col("point").alias("host"), F.col("id").alias("owner"))
    targets = base.where("host <> ''").select("host", "path").distinct().join(owned, "host")
    pair = lambda h, p: F.concat(h, F.lit("\0"), p)
    points = targets.select(pair("owner", "path").alias("point")).distinct().withColumn("key", F.encode("point", "UTF-8"))
    prefixes = given.select(pair("host", "path").alias("id")).withColumn("key", F.encode("id", "UTF-8"))
    fit = stab(points, prefixes, False)
    named = given.select(pair("host", "path").alias("id"), F.concat("host", "path").alias("rule"), "verdict")
    fit = fit.join(named, "id").select(F.col("point"), "rule", "verdict")
    # Owners of a url are as many as its host has labels; the longest rule among them wins.
    best = (
        targets.withColumn("point", pair("owner", "path")).join(fit, "point")
        .groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("owner"), F.col("rule"), F.col("verdict"))).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    return base.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every url of pages."""
    return judge(C.table(spark, sf_dir, "pages"), spark.createDataFrame(list(RULES), "verdict string, host string, path string"))


SQL = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT u.*, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
