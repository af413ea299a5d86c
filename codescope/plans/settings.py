"""Configuration: discovery, old names, profiles, waivers and rule selection. All of it is small and stays on the driver."""

from __future__ import annotations

import tomllib
from datetime import date
from pathlib import Path

from codescope.operators import rules

OWN_FILE, TABLE = ".codescope.toml", "codescope"

#: Former names of rules, and of groups of rules.
FORMER_RULES = {
    "complexity.cyclomatic": "structural.complexity.cyclomatic", "complexity.cognitive": "structural.complexity.cognitive", "complexity.weighted": "structural.class.complexity",
    "npath": "structural.complexity.npath", "hotspots": "structural.hotspots", "packages": "structural.packages", "deps": "structural.deps", "orphans": "structural.orphans",
    "class.coupling": "structural.class.coupling", "class.inheritance.depth": "structural.class.inheritance.depth", "class.inheritance.children": "structural.class.inheritance.children",
    "halstead.volume": "information.volume", "halstead.difficulty": "information.difficulty", "lexical.identifier_token_count": "lexical.verbosity", "lexical.short_identifier_density": "lexical.tersity",
}
FORMER_GROUPS = {
    "complexity": ["structural.complexity", "structural.class.complexity"], "halstead": ["information.volume", "information.difficulty"], "npath": ["structural.complexity.npath"],
    "hotspots": ["structural.hotspots"], "packages": ["structural.packages"], "deps": ["structural.deps"], "orphans": ["structural.orphans"],
    "class": ["structural.class.complexity", "structural.class.coupling", "structural.class.inheritance.depth", "structural.class.inheritance.children"],
}

_ON = {"enabled": "enabled", "severity": "severity"}
#: Published and former tables, the rules they speak of, and what their keys are called here. A key that isn't named goes nowhere.
KEYS: list[tuple[str, str, dict[str, str]]] = [
    ("structural.complexity", "structural.complexity.cyclomatic", {"cyclomatic_threshold": "threshold"}),
    ("structural.complexity", "structural.complexity.cognitive", {"cognitive_threshold": "threshold"}),
    ("structural.complexity", "structural.complexity.npath", {"npath_threshold": "threshold"}),
    ("structural.packages", "structural.packages", {"max_distance": "threshold"}),
    ("structural.deps", "structural.deps", {"fail_on_cycles": "fails"}),
    ("structural.redundancy", "structural.redundancy", {"min_score": "threshold"}),
    ("structural.types.sentinels", "structural.types.sentinels", {"max_cardinality": "threshold"}),
    ("structural.types.hidden_mutators", "structural.types.hidden_mutators", {"min_mutations": "threshold"}),
    ("information.volume", "information.volume", {"token_weight_alpha": "alpha"}),
    ("lexical.stutter", "lexical.stutter", {"min_overlap_tokens": "threshold"}),
    ("lexical.verbosity", "lexical.verbosity", {"max_mean_tokens": "threshold"}),
    ("lexical.tersity", "lexical.tersity", {"max_density": "threshold"}),
    ("complexity", "structural.complexity.cyclomatic", {**_ON, "cyclomatic_threshold": "threshold"}),
    ("complexity", "structural.complexity.cognitive", {**_ON, "cognitive_threshold": "threshold"}),
    ("complexity", "structural.class.complexity", {"weighted_threshold": "threshold"}),
    ("npath", "structural.complexity.npath", {**_ON, "npath_threshold": "threshold"}),
    ("halstead", "information.volume", {**_ON, "volume_threshold": "threshold"}),
    ("halstead", "information.difficulty", {**_ON, "difficulty_threshold": "threshold"}),
    ("hotspots", "structural.hotspots", {**_ON, "since": "since", "min_commits": "min_commits", "fail_on_quadrant": "fail_on_quadrant"}),
    ("packages", "structural.packages", {**_ON, "languages": "languages", "max_distance": "threshold", "fail_on_zone": "fail_on_zone"}),
    ("deps", "structural.deps", {**_ON, "fail_on_cycles": "fails"}),
    ("orphans", "structural.orphans", {**_ON, "min_confidence": "min_confidence"}),
    ("class", "structural.class.coupling", {**_ON, "coupling_threshold": "threshold"}),
    ("class", "structural.class.inheritance.depth", {"inheritance_depth_threshold": "threshold"}),
    ("class", "structural.class.inheritance.children", {"inheritance_children_threshold": "threshold"}),
    ("lexical", "lexical.verbosity", {"min_mean_tokens": "threshold"}),
    ("lexical", "lexical.tersity", {"max_density": "threshold"}),
]

#: What the profiles set; the default profile is :data:`codescope.plans.lint.DEFAULTS`.
PROFILES: dict[str, dict[str, dict]] = {
    "default": {},
    "lax": {
        "structural.complexity.cyclomatic": {"threshold": 20}, "structural.complexity.cognitive": {"threshold": 25}, "structural.class.complexity": {"threshold": 80}, "information.volume": {"threshold": 3000},
        "information.difficulty": {"threshold": 50}, "structural.complexity.npath": {"threshold": 1000}, "structural.hotspots": {"since": "90 days ago", "min_commits": 3}, "structural.packages": {"threshold": 0.85},
        "structural.class.coupling": {"threshold": 15}, "structural.class.inheritance.depth": {"threshold": 6}, "structural.class.inheritance.children": {"threshold": 20},
    },
    "strict": {
        "structural.complexity.cyclomatic": {"threshold": 6}, "structural.complexity.cognitive": {"threshold": 10}, "structural.class.complexity": {"threshold": 30}, "information.volume": {"threshold": 500},
        "information.difficulty": {"threshold": 20}, "structural.complexity.npath": {"threshold": 100}, "structural.hotspots": {"since": "7 days ago", "min_commits": 1, "fail_on_quadrant": ["hotspot", "churning_simple"]},
        "structural.packages": {"threshold": 0.5, "severity": "error"}, "structural.orphans": {"enabled": True}, "structural.class.coupling": {"threshold": 5},
        "structural.class.inheritance.depth": {"threshold": 3}, "structural.class.inheritance.children": {"threshold": 7},
    },
}


def current(rule: str) -> str:
    """A rule's name of today."""
    return FORMER_RULES.get(rule, rule)


def selected(known: list[str], only: str | None = None) -> list[str]:
    """The rules that ``only`` names: one rule, all below a prefix, or a former group; all for None. KeyError if none."""
    if only is None:
        return list(known)
    wanted = FORMER_GROUPS.get(only) or [current(only)]
    out = [r for r in known if any(r == w or r.startswith(w + ".") for w in wanted)]
    if not out:
        raise KeyError(only)
    return out


def flattened(table: dict, prefix: str = "") -> dict[str, dict]:
    """Nested tables by dotted name, each with its own plain values; former names become today's, which win over them."""
    old, new = {}, {}
    plain = {k: v for k, v in table.items() if not isinstance(v, dict)}
    if prefix and plain:
        for name in FORMER_GROUPS.get(prefix) or [current(prefix)]:
            (new if name == prefix else old)[name] = dict(plain)
    for k, v in table.items():
        if isinstance(v, dict):
            for name, values in flattened(v, f"{prefix}.{k}" if prefix else k).items():
                new[name] = new.get(name, {}) | values
    return {n: old.get(n, {}) | new.get(n, {}) for n in [*old, *(n for n in new if n not in old)]}


def migrated(tables: dict) -> dict[str, dict]:
    """What the tables' published and former keys mean for each rule, by today's names; of several tables the one named first in :data:`KEYS` wins."""
    out: dict[str, dict] = {}
    for name, rule, keys in reversed(KEYS):
        held = tables
        for part in name.split("."):
            held = held.get(part, {}) if isinstance(held, dict) else {}
        for old, new in keys.items():
            if isinstance(held, dict) and old in held and not isinstance(held[old], dict):
                if new == "fails":  # a rule that may not fail is off
                    out.setdefault(rule, {}).update({} if held[old] else {"enabled": False})
                else:
                    out.setdefault(rule, {})[new] = held[old]
    return out


def former(raw: dict) -> list[str]:
    """Tables and waived rules with former names, and what they are called now: for a note to the user."""
    tables, out = raw.get("rules", {}), []
    for name, now in {**{k: v for k, v in FORMER_GROUPS.items()}, **{k: [v] for k, v in FORMER_RULES.items() if "." in k}}.items():
        held = tables
        for part in name.split("."):
            held = held.get(part) if isinstance(held, dict) else None
        if isinstance(held, dict) and any(not isinstance(v, dict) for v in held.values()):
            out.append(f"[rules.{name}] is now {', '.join(now)}")
    for w in raw.get("waivers") or []:
        if isinstance(w, dict) and w.get("rule") in FORMER_RULES:
            out.append(f"waiver {w.get('id')}: {w['rule']} is now {FORMER_RULES[w['rule']]}")
    return out


def waivers(raw: object) -> list[dict]:
    """Checked waivers; ValueError says what is wrong with the first bad one."""
    if raw is None:
        return []
    if not isinstance(raw, list):
        raise ValueError("waivers must be an array of tables")
    out, ids = [], set()
    for nth, w in enumerate(raw, 1):
        if not isinstance(w, dict):
            raise ValueError(f"waiver {nth} must be a table")
        for key in ("id", "path", "rule", "reason"):
            if not isinstance(w.get(key), str) or not w[key].strip():
                raise ValueError(f"waiver {w.get('id') or nth} needs a {key}")
        if w["id"] in ids:
            raise ValueError(f"waiver id {w['id']} is used twice")
        ids.add(w["id"])
        most, until = w.get("allow_up_to"), w.get("expires")
        if most is not None and (isinstance(most, bool) or not isinstance(most, (int, float))):
            raise ValueError(f"waiver {w['id']}: allow_up_to must be a number")
        try:
            good = until is None or isinstance(until, str) and bool(date.fromisoformat(until))
        except ValueError:
            good = False
        if not good:
            raise ValueError(f"waiver {w['id']}: expires must be an ISO date")
        out.append({**w, "rule": current(w["rule"])})
    return out


def found(start: str, explicit: str | None = None) -> tuple[dict, str]:
    """The configuration and the file it is from ("" for none): an explicit file, else the nearest one upward."""
    if explicit:
        return tomllib.loads(Path(explicit).read_text()), explicit
    at = Path(start).resolve()
    for folder in [at, *at.parents]:
        own, project = folder / OWN_FILE, folder / "pyproject.toml"
        if own.is_file():
            return tomllib.loads(own.read_text()), str(own)
        if project.is_file() and TABLE in (tools := tomllib.loads(project.read_text()).get("tool", {})):
            return tools[TABLE], str(project)
    return {}, ""


def settled(defaults: dict[str, dict], raw: dict, profile: str = "default") -> tuple[dict[str, dict], list[dict]]:
    """Each rule's settings (defaults, profile, configuration) and the checked waivers."""
    base = {rule: values | PROFILES[profile].get(rule, {}) for rule, values in defaults.items()}
    tables, derived = flattened(raw.get("rules", {})), migrated(raw.get("rules", {}))
    # a rule's own key of today wins over what another one means for it
    named = {n: derived.get(n, {}) | tables.get(n, {}) for n in [*tables, *(d for d in derived if d not in tables)]}
    return rules.effective(base, named), waivers(raw.get("waivers"))


def written(defaults: dict[str, dict], profile: str = "default") -> str:
    """A configuration file of a profile, one table for each rule."""
    def text(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        return "[" + ", ".join(map(text, v)) + "]" if isinstance(v, list) else f'"{v}"' if isinstance(v, str) else str(v)

    config, _ = settled(defaults, {}, profile)
    return "\n".join(f"[rules.{rule}]\n" + "".join(f"{k} = {text(v)}\n" for k, v in values.items()) for rule, values in config.items())


def languages(requested: list[str] | None, supported: list[str], strict: bool = False) -> tuple[list[str], list[str]]:
    """Languages to read and those that can't be, both sorted; ValueError if none is left or, with ``strict``, any can't be."""
    if not requested:
        return sorted(supported), []
    wanted = {name.lower() for name in requested}
    kept, other = sorted(wanted & set(supported)), sorted(wanted - set(supported))
    if other and (strict or not kept):
        raise ValueError(f"no such language: {', '.join(other)}")
    return kept, other
