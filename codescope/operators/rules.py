"""The rule layer: violations, waivers, verdicts, reports and layered configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codescope.functions import glob_regex

COLUMNS = ["rule", "file", "line", "symbol", "severity", "value", "threshold"]


def violations(df: DataFrame, rule: str, file: Column, value: Column, threshold: float, severity: str = "error", line: Column | None = None, symbol: Column | None = None, inclusive: bool = False, facts: dict[str, Column] | None = None) -> DataFrame:
    """Rows over a limit in the common violation shape; with ``facts`` also ``metadata``, a variant object of what the rule knows besides."""
    over = value >= threshold if inclusive else value > threshold
    none = F.lit(None)
    line = none if line is None else line
    symbol = none if symbol is None else symbol
    return df.filter(over).select(
        F.lit(rule).alias("rule"), file.cast("string").alias("file"), line.cast("long").alias("line"), symbol.cast("string").alias("symbol"),
        F.lit(severity).alias("severity"), value.cast("double").alias("value"), F.lit(float(threshold)).alias("threshold"), *([] if facts is None else [known(facts)]),
    )


def known(facts: dict[str, Column]) -> Column:
    """Facts of a violation as one variant object; rules with other facts fit into one table."""
    return F.to_variant_object(F.struct(*[c.alias(name) for name, c in facts.items()])).alias("metadata")


def waived(found: DataFrame, waivers: list[dict], today: str) -> DataFrame:
    """``found`` with the id of the first live waiver that covers each row, or null.

    A waiver covers rows of its rule (or ``*`` glob of rules) and path glob, with a
    value up to ``allow_up_to`` if it has one, through its expiry day. Waivers are
    configuration, few, and tried in order of declaration in one expression.
    """
    out = F.lit(None).cast("string")
    for w in reversed(waivers):
        if w.get("expires") and w["expires"] < today:
            continue
        path = F.col("file").rlike(glob_regex(w["path"])) | F.concat(F.lit("./"), F.col("file")).rlike(glob_regex(w["path"]))
        fits = F.col("rule").rlike(glob_regex(w["rule"])) & path
        if w.get("allow_up_to") is not None:
            fits &= F.coalesce(F.col("value") <= float(w["allow_up_to"]), F.lit(False))
        out = F.when(fits, F.lit(w["id"])).otherwise(out)
    return found.withColumn("waiver", out)


def recorded(found: DataFrame, waivers: list[dict]) -> DataFrame:
    """``found`` of :func:`waived` with ``waived_by``: id, reason, ceiling and last day of the waiver, null where there is none."""
    kind = "struct<id:string,reason:string,allow_up_to:double,expires:string>"
    out = F.lit(None).cast(kind)
    for w in reversed(waivers):
        ceiling = None if w.get("allow_up_to") is None else float(w["allow_up_to"])
        out = F.when(F.col("waiver") == w["id"], F.struct(F.lit(w["id"]).alias("id"), F.lit(w.get("reason")).cast("string").alias("reason"), F.lit(ceiling).cast("double").alias("allow_up_to"), F.lit(w.get("expires")).cast("string").alias("expires"))).otherwise(out)
    return found.withColumn("waived_by", out)


def verdicts(found: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Per rule of (name, severity): violations that aren't waived, waived ones, and status."""
    counts = found.groupBy("rule").agg(F.count_if(F.col("waiver").isNull()).alias("violations"), F.count_if(F.col("waiver").isNotNull()).alias("waived"))
    every = found.sparkSession.createDataFrame(rules, "rule string, severity string")
    both = F.broadcast(every).join(counts, "rule", "left").na.fill(0, ["violations", "waived"])
    return both.withColumn("status", F.when(F.col("violations") > 0, "fail").otherwise("pass"))


def run_verdict(per_rule: DataFrame) -> DataFrame:
    """One row: only violations of severity error fail a run."""
    errors = F.sum(F.when(F.col("severity") == "error", F.col("violations")).otherwise(0))
    rest = F.sum(F.when(F.col("severity") != "error", F.col("violations")).otherwise(0))
    total = per_rule.agg(errors.alias("violations"), rest.alias("advisories"), F.sum("waived").alias("waived"))
    return total.withColumn("result", F.when(F.col("violations") > 0, "fail").otherwise("pass"))


def top_n(found: DataFrame, n: int = 5) -> DataFrame:
    """The first rows of each rule and how many more there are; ranks are cut before the shuffle."""
    order = Window.partitionBy("rule").orderBy(F.desc("value"), "file")
    counts = found.groupBy("rule").agg(F.count("*").alias("total"))
    head = found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n)
    return head.join(F.broadcast(counts), "rule").withColumn("more", F.greatest(F.col("total") - n, F.lit(0)))


def effective(defaults: dict[str, dict], tables: dict[str, dict]) -> dict[str, dict]:
    """Layer configuration tables over defaults.

    A table whose name is a prefix of a rule hands on ``enabled`` and
    ``severity`` only; longer prefixes win over shorter, a rule's own table wins
    over all and may set everything.
    """
    out = {}
    for rule, base in defaults.items():
        merged = dict(base)
        for name in sorted((t for t in tables if rule.startswith(t + ".")), key=len):
            merged |= {k: v for k, v in tables[name].items() if k in ("enabled", "severity")}
        out[rule] = merged | tables.get(rule, {})
    return out


def layered(defaults: DataFrame, tables: DataFrame) -> DataFrame:
    """``rule``, ``enabled`` and ``severity`` of ``defaults`` under ``tables(name, enabled, severity)``: :func:`effective` for many rules.

    A table speaks for the rule of its name and for all whose names go on with a
    dot. The longest name that sets a key wins, for each key alone; what a table
    leaves null it doesn't set. Rules meet the tables of their own prefixes only.
    """
    parts = F.split("rule", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    hits = defaults.select("rule", F.explode(names).alias("name")).join(tables, "name")
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.length("name").alias("at"), F.col(c).alias("value")))).alias(f"_{c}")
    won = hits.groupBy("rule").agg(last("enabled"), last("severity"))
    return defaults.join(won, "rule", "left").select("rule", F.coalesce("_enabled.value", "enabled").alias("enabled"), F.coalesce("_severity.value", "severity").alias("severity"))


def config_rows(spark: SparkSession, config: dict[str, dict]) -> DataFrame:
    rows = [(r, bool(c["enabled"]), c["severity"]) for r, c in sorted(config.items())]
    return spark.createDataFrame(rows, "rule string, enabled boolean, severity string")
