"""URL filter by a path-template tree, with DataFrame functions only.

Paths are reduced to skeletons first (digits and long hex strings masked), and
all further work is on distinct skeletons, not pages. Prefix by prefix, a segment
that takes more than ``BRANCHES`` values under its host and prefix becomes a
wildcard. Under a prefix with no more skeletons than that nothing can, so its rows
are settled, and a crowded prefix goes on where its skeletons part: rounds follow
the crowded forks on a path, not its length. Branches of one parent whose labelled rates don't differ significantly
are merged. A template is rejected when its labelled purity, smoothed towards
its parents' and the corpus' rate, is over ``REJECT``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BRANCHES = 16
REJECT = 0.5
SMOOTH = 4.0
Z = 1.96
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query: (what, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null and without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest rule (host and path together) that fits, as struct rule, what; null if none does."""
    kind = "struct<rule:string,what:string>"
    found = F.lit(None).cast(kind)
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(what).alias("what"))).otherwise(found)
    return found


def skeleton(path: Column) -> Column:
    """Masked segments."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike("^[0-9a-fA-F-]{8,}$"), F.lit("{h}")).otherwise(F.regexp_replace(s, "[0-9]+", "{n}")))


def _first(n: str) -> Column:
    """The first ``n`` segments of the template as text."""
    return F.concat_ws("/", F.slice("tpl", F.lit(1), F.col(n)))


def templates(rows: DataFrame) -> DataFrame:
    """``host``, ``sk`` (skeleton as text), ``template`` and smoothed ``purity``, from ``rows(host, segs, bad)``; bad: 1, 0 or null."""
    base = rows.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("bad").alias("known"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    base = common.materialize(base.select("*", F.concat_ws("/", "segs").alias("sk"), F.col("segs").alias("tpl")))
    work, settled = base.withColumn("at", F.lit(0)), []
    # as many rounds as crowded prefixes lie on one path
    while True:
        group = ["host", "at", "pre"]
        keyed = work.withColumn("pre", _first("at"))
        crowded = keyed.groupBy(group).agg(F.count("*").alias("rows"), F.min("tpl").alias("lo"), F.max("tpl").alias("hi")).filter(F.col("rows") > BRANCHES)
        # the group's first and last template agree as far as all of them do
        differ = F.array_position(F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y)), False).cast("int")
        crowded = crowded.select(*group, F.when(differ > 0, differ - 1).otherwise(F.size("lo")).alias("same"))
        live = F.coalesce(F.size("tpl") > F.col("same"), F.lit(False))
        keyed = keyed.join(crowded, group, "left").withColumn("live", live).withColumn("at", F.when(F.col("live"), F.col("same")).otherwise(F.col("at")))
        # settled rows have no prefix to join on: their own skeleton spreads them
        keyed = keyed.withColumn("pre", F.when(F.col("live"), _first("at")).otherwise(F.concat(F.lit("//"), "sk"))).drop("same")
        values = keyed.filter("live").select(*group, F.element_at("tpl", F.col("at") + 1).alias("seg")).distinct().groupBy(group).agg(F.count("*").alias("values"))
        wide = values.filter(F.col("values") > BRANCHES).select(*group, F.lit(True).alias("wide"))
        starred = F.concat(F.slice("tpl", F.lit(1), F.col("at")), F.array(F.lit("*")), F.slice("tpl", F.col("at") + 2, F.size("tpl")))
        keyed = keyed.join(wide, group, "left").withColumn("tpl", F.when(F.col("wide"), starred).otherwise(F.col("tpl"))).drop("pre", "wide")
        keyed = common.materialize(keyed.withColumn("at", F.col("at") + 1))
        settled.append(keyed.filter("not live"))
        work = keyed.filter("live").drop("live")
        if work.isEmpty():
            break
    work = reduce(DataFrame.unionAll, settled).drop("at", "live").withColumn("template", F.concat_ws("/", "tpl"))
    leaves = work.groupBy("host", "template", "tpl").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    steps = leaves.select("*", F.explode(F.sequence(F.lit(0), F.size("tpl"))).alias("d")).withColumn("node", F.concat_ws("/", F.slice("tpl", 1, F.col("d"))))
    nodes = steps.groupBy("host", "node", "d").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"), F.first(F.concat_ws("/", F.expr("slice(tpl, 1, greatest(d - 1, 0))"))).alias("parent"))
    # a parent has few branches: more would have become a wildcard
    rate = (F.col("bad") + 0.5) / (F.col("known") + 1.0)
    by_rate = Window.partitionBy("host", "d", "parent").orderBy("rate", "node")
    nodes = nodes.withColumn("rate", rate).withColumns({"r0": F.lag("rate").over(by_rate), "k0": F.lag("known").over(by_rate)})
    pooled = (F.col("rate") + F.col("r0")) / 2
    noise = F.sqrt(pooled * (1 - pooled) * (1 / (F.col("known") + 1.0) + 1 / (F.col("k0") + 1.0)))
    differs = F.coalesce((F.col("rate") - F.col("r0") > Z * noise).cast("int"), F.lit(0))
    nodes = nodes.withColumn("branch", F.sum(differs).over(by_rate))
    merged = Window.partitionBy("host", "d", "parent", "branch")
    nodes = nodes.select("host", "node", "d", F.sum("known").over(merged).alias("mk"), F.sum("bad").over(merged).alias("mb"))
    prior = base.agg(((F.sum("bad") + 0.5) / (F.sum("known") + 1.0)).alias("prior"))  # one row
    chain = steps.select("host", "template", "d", "node").join(nodes, ["host", "node", "d"]).groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("d", "mk", "mb"))).alias("chain"))
    purity = F.aggregate("chain", F.col("prior"), lambda p, c: (c["mb"] + SMOOTH * p) / (c["mk"] + SMOOTH))
    judged = chain.crossJoin(F.broadcast(prior)).select("host", "template", purity.alias("purity"))
    return work.select("host", "sk", "template").join(judged, ["host", "template"]).select("host", "sk", "template", "purity")


def judge(pages: DataFrame, rules) -> DataFrame:
    """Per row of ``pages(page_id, url)``: page_id, host, path, rule, verdict, template, purity.

    Urls that rules decide are the labelled ones. Rows with one page_id are
    judged one by one; null urls have empty parts. Without labels every purity
    is one half and is rejected only by rules.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("r"), skeleton(F.col("path")).alias("segs"))
    rows = rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.what").alias("what"), "segs", F.concat_ws("/", "segs").alias("sk"))
    found = common.materialize(templates(rows.select("host", "segs", (F.col("what") == "block").cast("int").alias("bad"))))
    said = F.when(F.col("purity") > REJECT, "block").otherwise("allow")
    return rows.join(found, ["host", "sk"], "left").select("page_id", "host", "path", "rule", F.coalesce("what", said).alias("verdict"), "template", "purity")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"), RULES)
