"""Reports of a run: messages, statuses, categories, and the human, JSON and quiet forms.

Counts and the first rows of each rule are made by Spark; only those, whose number
is bounded by the rules, come to the driver. The JSON document streams through it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescope.operators import rules

#: By rule: what its value is called, and its unit.
WHAT = {
    "structural.complexity.cyclomatic": "CCX", "structural.complexity.cognitive": "CogC", "structural.complexity.npath": "NPath", "structural.class.complexity": "WMC", "structural.class.coupling": "CBO",
    "structural.class.inheritance.depth": "DIT", "structural.class.inheritance.children": "NOC", "structural.packages": "distance", "structural.deps": "cycle size", "structural.local_imports": "local imports",
    "structural.redundancy": "shared calls", "structural.types.sentinels": "literals", "structural.types.hidden_mutators": "mutations", "structural.types.escape_hatches": "escape density",
    "structural.duplication": "clones", "structural.god_module": "definitions", "structural.orphans": "references", "structural.hotspots": "score", "information.volume": "volume", "information.difficulty": "difficulty",
    "information.magic_literals": "magic literals", "information.section_comments": "dividers", "lexical.stutter": "repeated tokens", "lexical.verbosity": "mean tokens", "lexical.tersity": "short names",
}
EXIT = {"pass": 0, "fail": 1, "error": 2}


#: By rule: what is said after its value, from its metadata; a word in braces is a field, with ``:list`` a list, with ``:percent`` a share.
DETAILS = {
    "structural.complexity.cyclomatic": "{zone}", "structural.complexity.cognitive": "CCX {ccx}", "structural.complexity.npath": "{language}", "structural.class.complexity": "{method_count} methods, {kind}",
    "structural.class.coupling": "{kind}", "structural.class.inheritance.depth": "{kind} of {superclasses:list}", "structural.class.inheritance.children": "{kind}", "structural.packages": "zone {zone}, I {instability}, A {abstractness}",
    "structural.deps": "{cycle:list}", "structural.local_imports": "{module} inside {function}", "structural.redundancy": "{fn_a} (line {fn_a_line}) and {fn_b} (line {fn_b_line}): {shared_callees:list}",
    "structural.types.sentinels": "parameter {param_name}, {call_site_count} calls with texts: {call_site_literals:list}", "structural.types.hidden_mutators": "{mutated_params:list} by {methods:list}",
    "structural.types.escape_hatches": "{density:percent} of annotations, {escape_count} of {total_count}", "structural.god_module": "{loc} lines", "structural.orphans": "{confidence} confidence",
    "structural.hotspots": "{quadrant}, CCX {sum_ccx}, growth {loc_delta} lines", "information.volume": "raw {raw_volume}, effort {effort}", "information.difficulty": "effort {effort}", "information.magic_literals": "{literals:list}",
    "information.section_comments": "lines {divider_lines:list}", "lexical.stutter": "{overlap:list} of {scope_type} {scope_name}", "lexical.verbosity": "{total_tokens} tokens in {total_identifiers} names",
    "lexical.tersity": "{density:percent}, {short_count} of {total_identifiers}: {short_identifiers:list}",
}
CLUSTER, SHARE = "{clone_count} alike ({fingerprint})", "{clone_fraction:percent} of {functions_analyzed} functions in {cluster_count} clusters"


def _number(c: Column) -> Column:
    return F.when(c.isNotNull(), F.regexp_replace(F.format_string("%.4f", c), r"\.?0+$", ""))


def _detail(template: str) -> Column:
    """A template filled in from ``metadata``; what isn't there is left out."""

    def held(word: str) -> Column:
        name, _, kind = word.partition(":")
        place = f"$.{name}"
        if kind == "list":
            return F.array_join(F.coalesce(F.try_variant_get("metadata", place, "array<string>"), F.array().cast("array<string>")), ", ")
        number = F.try_variant_get("metadata", place, "double")
        if kind == "percent":
            return F.coalesce(F.concat(_number(number * 100), F.lit("%")), F.lit(""))
        return F.coalesce(_number(number), F.try_variant_get("metadata", place, "string"), F.lit(""))

    parts = re.split(r"\{([\w:]+)\}", template)
    return F.concat(*[held(p) if n % 2 else F.lit(p) for n, p in enumerate(parts) if p])


def message(rich: bool = True) -> Column:
    """One sentence for a violation: its value, its limit and, if ``rich``, what the rule's metadata say."""
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in WHAT.items() for x in kv])[F.col("rule")], F.lit("value"))
    limit = F.when(F.col("threshold").isNull(), "").otherwise(F.concat(F.lit(", limit "), _number(F.col("threshold"))))
    said = F.concat(name, F.coalesce(F.concat(F.lit(" "), _number(F.col("value"))), F.lit("")), limit)
    if not rich:
        return said
    more = F.lit(None).cast("string")
    for rule, template in DETAILS.items():
        more = F.when(F.col("rule") == rule, _detail(template)).otherwise(more)
    clone = F.when(F.try_variant_get("metadata", "$.fingerprint", "string").isNotNull(), _detail(CLUSTER)).otherwise(_detail(SHARE))
    more = F.when(F.col("rule") == "structural.duplication", clone).otherwise(more)
    means = interpretation(F.coalesce(*[F.try_variant_get("metadata", f"$.{k}", "string") for k in ("quadrant", "zone")]))
    more = F.when(means.isNull(), more).otherwise(F.concat(more, F.lit("; "), means))
    return F.when(more.isNull() | F.col("metadata").isNull(), said).otherwise(F.concat(said, F.lit(" ("), more, F.lit(")")))


def exceeded(values: dict[str, tuple[Column, float]]) -> Column:
    """Which limits a class is over, in words; within all of them it is said to be so."""
    said = {"cbo": "coupled with many classes", "dit": "deep below its ancestors", "noc": "ancestor of many", "wmc": "much decided in its methods"}
    over = F.array_compact(F.array(*[F.when(value > limit, F.lit(said[name])) for name, (value, limit) in values.items()]))
    return F.when(F.size(over) == 0, "within limits").otherwise(F.array_join(over, "; "))


def by_confidence(found: DataFrame) -> DataFrame:
    """How many unreferenced symbols of each confidence there are: high, medium, low, also where there is none."""
    from codescope.operators import tables

    rows = found.filter("rule = 'structural.orphans'").select(F.variant_get("metadata", "$.confidence", "string").alias("confidence"))
    return tables.histogram(rows, "confidence", ["high", "medium", "low"])


def interpretation(zone: Column) -> Column:
    """What a zone or quadrant means."""
    return (
        F.when(zone == "pain", "concrete and depended upon: hard to change").when(zone == "uselessness", "abstract and used by few").when(zone == "clean", "close to the main sequence")
        .when(zone == "hotspot", "complex and growing: simplify first").when(zone == "stable_complex", "complex but quiet").when(zone == "churning_simple", "growing but simple: watch it")
        .when(zone == "untestable", "too many paths to test").when(zone == "insufficient_data", "too few files to compare")
    )


def _rich(found: DataFrame) -> bool:
    return "metadata" in found.columns


def statuses(found: DataFrame, ran: dict[str, dict], errors: dict[str, str], checked: dict[str, int] | None = None) -> DataFrame:
    """Per rule of ``ran`` (name: settings): violations, waived, status, error and how many units were checked."""
    made = rules.verdicts(found, [(r, c["severity"]) for r, c in ran.items()])
    rows = [(r, errors.get(r), (checked or {}).get(r, 0)) for r in ran]
    more = found.sparkSession.createDataFrame(rows, "rule string, error string, checked long")
    # a rule that broke off is an error, even if what it found would pass
    return made.join(F.broadcast(more), "rule").withColumn("status", F.when(F.col("error").isNotNull(), "error").otherwise(F.col("status")))


def categories(per_rule: DataFrame) -> DataFrame:
    """Sums of the rules of a category, and the largest number of units checked."""
    category = F.regexp_replace("rule", r"\.[^.]+$", "")
    return per_rule.groupBy(category.alias("category")).agg(F.sum("violations").alias("violations"), F.sum("waived").alias("waived"), F.max("checked").alias("checked"), F.count_if(F.col("status") == "error").alias("errors"))


def verdict(per_rule: DataFrame, skipped: int = 0) -> dict:
    """Counts of the run and its result: error before fail before pass; warnings never fail."""
    total = rules.run_verdict(per_rule).first().asDict()
    bad = per_rule.filter("status = 'error'").count()
    return {"rules_checked": per_rule.count(), "rules_skipped": skipped, **total, "result": "error" if bad else total["result"]}


def plural(n: int, one: str, many: str = "") -> str:
    return f"{n} {one if n == 1 else many or one + 's'}"


def quiet(total: dict) -> str:
    """The last line of a report."""
    parts = [plural(total[k], *words) for k, *words in (("violations", "violation"), ("advisories", "advisory", "advisories"), ("waived", "waived", "waived")) if total[k]]
    return " | ".join([*(parts or ["no violations"]), plural(total["rules_checked"], "rule") + " checked", total["result"].upper()])


def human(found: DataFrame, per_rule: DataFrame, most: int = 5, skipped: int = 0) -> str:
    """Rules by category, each with its first ``most`` violations and how many more there are."""
    head = rules.top_n(found.filter("waiver is null").withColumn("message", message(_rich(found))), most).orderBy("rule", "nth").collect()
    lines: list[str] = []
    for r in per_rule.orderBy("rule").collect():
        lines.append(f"{r['rule']}: {r['status']}" + (f" ({plural(r['violations'], 'violation')})" if r["violations"] else "") + (f", {r['waived']} waived" if r["waived"] else ""))
        if r["error"]:
            lines.append(f"  ! {r['error']}")
        mine = [v for v in head if v["rule"] == r["rule"]]
        for v in mine:
            place = v["file"] + (f":{v['line']}" if v["line"] else "") + (f" {v['symbol']}" if v["symbol"] else "")
            lines.append(f"  {'x' if v['severity'] == 'error' else '!'} {place} - {v['message']}")
        if mine and mine[0]["more"]:
            lines.append(f"  ...and {mine[0]['more']} more")
    return "\n".join([*lines, quiet(verdict(per_rule, skipped))])


def as_rows(found: DataFrame) -> DataFrame:
    """One JSON text for each violation, waived ones marked: for ``write.text`` where a run has too many for one document."""
    return found.select("rule", F.to_json(F.struct(*found.columns, message(_rich(found)).alias("message"))).alias("value"))


def json_parts(found: DataFrame, per_rule: DataFrame, root: str, skipped: int = 0) -> Iterator[str]:
    """The whole run as one document, in pieces; the driver holds one partition of violations at a time."""
    held = found.withColumn("message", message(_rich(found)))
    if _rich(found):
        held = held.withColumn("metadata", F.to_json("metadata"))
    rows = held.orderBy("rule", F.col("waiver").isNotNull(), F.desc("value"), "file", "line").toLocalIterator()
    row, rules_ = next(rows, None), per_rule.orderBy("rule").collect()

    def shown(r) -> str:
        v = r.asDict(recursive=True)
        record = v.pop("waived_by", None)
        if "metadata" in v:
            v["metadata"] = json.loads(v["metadata"] or "{}") | ({"waiver": record} if record else {})
        return json.dumps({k: x for k, x in v.items() if k != "waiver" or x})

    yield f'{{"root": {json.dumps(root)}, "rules": {{'
    for n, r in enumerate(rules_):
        yield f'{", " if n else ""}{json.dumps(r["rule"])}: {{"status": {json.dumps(r["status"])}, "errors": {json.dumps([r["error"]] if r["error"] else [])}'
        while row is not None and row["rule"] < r["rule"]:  # of a rule that isn't reported
            row = next(rows, None)
        for name, is_waived in (("violations", False), ("waived_violations", True)):
            yield f', "{name}": ['
            first = True
            while row is not None and row["rule"] == r["rule"] and (row["waiver"] is not None) == is_waived:
                yield ("" if first else ", ") + shown(row)
                row, first = next(rows, None), False
            yield "]"
        yield "}"
    yield f'}}, "summary": {json.dumps(verdict(per_rule, skipped))}}}'


def as_json(found: DataFrame, per_rule: DataFrame, root: str, skipped: int = 0) -> str:
    """The pieces of :func:`json_parts` as one text: all violations come to the driver."""
    return json.dumps(json.loads("".join(json_parts(found, per_rule, root, skipped))), indent=2)
