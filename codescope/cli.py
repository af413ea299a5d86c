"""Command line: lint, check, rules and init.

``python -m codescope.cli lint ROOT [--log FILE] [--config FILE] [--profile NAME]
[--json | --quiet] [--most N] [--languages A,B]``; ``check RULE ROOT`` runs one rule, a prefix or a
former group. Exit: 0 pass, 1 fail, 2 error.
"""

from __future__ import annotations

import argparse
import sys

from codescope.plans import lint as lint_plan
from codescope.plans import report, settings


def main(args: list[str] | None = None, spark=None) -> int:
    top = argparse.ArgumentParser(prog="codescope")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("lint", "check"):
        p = sub.add_parser(name)
        if name == "check":
            p.add_argument("only")
        p.add_argument("root", nargs="?", default=".")
        p.add_argument("--log")
        p.add_argument("--config")
        p.add_argument("--profile", choices=list(settings.PROFILES), default="default")
        p.add_argument("--json", action="store_true")
        p.add_argument("--quiet", action="store_true")
        p.add_argument("--most", type=int, default=5)
        p.add_argument("--today", default="0001-01-01")
        p.add_argument("--languages", help="comma-separated; all if not given")
    sub.add_parser("rules")
    sub.add_parser("init").add_argument("profile", nargs="?", choices=list(settings.PROFILES), default="default")
    a = top.parse_args(args)
    if a.command == "rules":
        print("\n".join(f"{rule}  {c['severity']}  limit {c.get('threshold', '-')}" for rule, c in lint_plan.DEFAULTS.items()))
        return 0
    if a.command == "init":
        print(settings.written(lint_plan.DEFAULTS, a.profile))
        return 0
    try:
        raw, _ = settings.found(a.root, a.config)
        config, waivers = settings.settled(lint_plan.DEFAULTS, raw, a.profile)
        names = settings.selected(list(config), getattr(a, "only", None))
        asked = a.languages.split(",") if a.languages else raw.get("languages")
        kept, unread = settings.languages(asked, lint_plan.LANGUAGES)
        for name in unread:
            print(f"note: {name} isn't read", file=sys.stderr)
        for note in settings.former(raw):
            print(f"note: {note}", file=sys.stderr)
    except (OSError, ValueError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return report.EXIT["error"]
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("codescope").getOrCreate()
    run = lint_plan.run(spark, a.root, {n: config[n] for n in names}, waivers, a.today, log=a.log, excludes=raw.get("exclude"), languages=kept if asked else None)
    with run:
        total = report.verdict(run.per_rule, run.skipped)
        if a.json:
            for part in report.json_parts(run.found, run.per_rule, a.root, run.skipped):
                print(part, end="")
            print()
        else:
            print(report.quiet(total) if a.quiet else report.human(run.found, run.per_rule, a.most, run.skipped))
    return report.EXIT[total["result"]]


if __name__ == "__main__":
    sys.exit(main())
