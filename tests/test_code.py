"""Metrics and rules over small source trees, with hand-counted values."""

import pytest

from codescope.plans import lint as lint_plan
from codescope.sources import code


def tree(tmp_path, **sources):
    for name, text in sources.items():
        p = tmp_path / (name.replace("_DIR_", "/") + ".py")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(tmp_path)


CLASSIFY = "def classify(x):\n    if x == 1:\n        return 1\n    elif x == 2:\n        return 2\n    elif x == 3:\n        return 3\n    elif x == 4:\n        return 4\n    elif x == 5:\n        return 5\n    else:\n        return 0\n"
NESTED = "def deep(a, b, c):\n    if a:\n        if b:\n            if c:\n                return 1\n    return a and b and c or a\n"
TEN = "def ten(x):\n" + "".join(f"    if x == {i}:\n        x += 1\n" for i in range(10)) + "    return x\n"


def test_function_metrics(spark, tmp_path):
    root = tree(tmp_path, a=CLASSIFY, b=NESTED, c=TEN, d="def broken(:\n")
    m = lint_plan.Metrics(spark, code.files(spark, root))
    got = {r["name"]: r for r in m.functions.select("name", "ccx", "cog", "npath").collect()}
    assert (got["classify"]["ccx"], got["classify"]["npath"]) == (6, 6)
    assert (got["deep"]["ccx"], got["deep"]["cog"]) == (7, 6 + 2)
    assert got["ten"]["npath"] == 1024
    assert m.facts.filter("kind = 'error'").count() == 1


def test_classes_and_edges(spark, tmp_path):
    chain = "class A: pass\nclass B(A): pass\nclass C(B): pass\nclass D(C): pass\nclass E(D):\n    def m(self):\n        return 1 if self else B\n"
    root = tree(tmp_path, k=chain, x="import y\n", y="import z\nimport json\n", z="import x\n", alone="import os\n")
    m = lint_plan.Metrics(spark, code.files(spark, root))
    got = {r["name"]: r for r in m.class_metrics().collect()}
    assert [got[n]["dit"] for n in "ABCDE"] == [0, 1, 2, 3, 4]
    assert (got["E"]["cbo"], got["E"]["wmc"], got["A"]["noc"]) == (2, 2, 1)
    assert {(r["src"], r["dst"]) for r in m.import_edges().collect()} == {("x.py", "y.py"), ("y.py", "z.py"), ("z.py", "x.py")}


def test_lint(spark, tmp_path):
    mutate = "def f(items: list, mode: str):\n    import os\n    items.append(1)\n    return os\n"
    many = "".join(f"def g{i}():\n    return {i}\n" for i in range(25))
    lits = "def h(a):\n    return a * 37 + 41 * 53 - 67 + 100 + 0\n"
    root = tree(tmp_path, c=TEN, m=mutate, many=many, lits=lits, x="import y\n", y="import x\n")
    found = lint_plan.lint(spark, root, {"lexical": {"enabled": False}, "structural.complexity.npath": {"threshold": 500}}, [{"id": "w", "path": "m*.py", "rule": "structural.god_module", "reason": "r"}], "2026-01-01").collect()
    by = {(r["rule"], r["file"]): r for r in found}
    assert by["structural.complexity.npath", "c.py"]["value"] == 1024
    assert by["structural.complexity.cyclomatic", "c.py"]["value"] == 11
    assert by["structural.types.hidden_mutators", "m.py"]["symbol"] == "f"
    assert by["structural.local_imports", "m.py"]["symbol"] == "f"
    assert by["structural.god_module", "many.py"]["waiver"] == "w"
    assert by["structural.deps", "x.py"]["value"] == 2
    assert by["information.magic_literals", "lits.py"]["value"] == 5
    assert not any(r["rule"].startswith("lexical") for r in found)


def test_commit_log(spark, tmp_path):
    log = tmp_path / "log.txt"
    log.write_text("\x1eaaa\x1f2026-01-02T10:00:00+00:00\x1fp1\n\n3\t1\ta.py\n-\t-\tb.bin\n\x1ebbb\x1f2026-01-03T10:00:00+00:00\x1fp1 p2\n\n5\t0\ta.py\n")
    commits, churn = code.commits(spark, str(log))
    assert sorted((r["commit"], r["parent_count"]) for r in commits.collect()) == [("aaa", 1), ("bbb", 2)]
    assert sorted((r["file"], r["insertions"], r["deletions"]) for r in churn.collect()) == [("a.py", 3, 1), ("a.py", 5, 0), ("b.bin", 0, 0)]


def test_packages_stutter_and_orphans(spark, tmp_path):
    root = tree(
        tmp_path, **{"p_DIR___init__": "", "p_DIR_one": "import q.two\nclass Base(ABC): pass\nclass Kind(Base): pass\n", "q_DIR___init__": "", "q_DIR_two": "class Other: pass\n"},
        node_vector="def node_vector_size(node_vector_len):\n    total_sum = 1\n    _node_vector = 2\n    return total_sum\n", user="from z import nothing_used\ndef lonely_name_here():\n    pass\n",
    )
    m = lint_plan.Metrics(spark, code.files(spark, root))
    got = {r["node"]: r for r in m.packages().collect()}
    assert (got["p"]["ce"], got["p"]["ca"], got["p"]["na"], got["p"]["nc"], got["p"]["instability"]) == (1, 0, 1, 1, 1.0)
    assert (got["q"]["ca"], got["q"]["zone"]) == (1, "pain")
    config = {"structural.orphans": {"enabled": True, "min_confidence": "medium"}}
    found = {(r["rule"], r["file"], r["symbol"]) for r in lint_plan.lint(spark, root, config).collect()}
    assert ("structural.packages", "q", None) in found and ("structural.packages", "p", None) not in found
    assert ("lexical.stutter", "node_vector.py", "node_vector_len") in found
    assert not any(s == "_node_vector" for _, _, s in found)
    assert ("structural.orphans", "user.py", "lonely_name_here") in found


def test_deep_sources_and_odd_bases(spark, tmp_path):
    long_sum = "def f(a):\n    return " + " + ".join(["a"] * 3000) + "\n"
    elifs = "def g(x):\n    if x == 0:\n        return 0\n" + "".join(f"    elif x == {i}:\n        return {i}\n" for i in range(1, 900))
    own = "import base\nclass Config(base.Config): pass\nclass A(B): pass\nclass B(C): pass\nclass C(A): pass\nclass D(A): pass\n"
    m = lint_plan.Metrics(spark, code.files(spark, tree(tmp_path, s=long_sum, e=elifs, o=own, ok="def h(): pass\n")))
    kinds = {r["file"] for r in m.facts.select("file").distinct().collect()}
    assert kinds == {"s.py", "e.py", "o.py", "ok.py"}
    got = {r["name"]: r["dit"] for r in m.class_metrics().collect()}
    assert got == {"Config": 0, "A": 2, "B": 2, "C": 2, "D": 3}
    m.close()


def test_hotspots_and_duplication(spark, tmp_path):
    src, log = tmp_path / "src", tmp_path / "log"
    body = "".join(f"    if x == {i}:\n        x += {i}\n" for i in range(5))
    src.mkdir()
    tree(src, **{f"m{k}": f"def f{k}(x):\n" + (body if k > 5 else "    return x\n") for k in range(9)})
    commits = [f"\x1ec{i}\x1f2026-01-0{i}T00:00:00+00:00\x1fp\n\n" + "".join(f"{50 if k == 8 else 1}\t0\tm{k}.py\n" for k in range(9)) + "1\t1\tgone.py\n" for i in (1, 2)]
    commits += ["\x1emerge\x1f2026-01-02T00:00:00+00:00\x1fp q\n\n900\t0\tm0.py\n", "\x1eold\x1f2020-01-02T00:00:00+00:00\x1fp\n\n900\t0\tm1.py\n"]
    log.write_text("".join(commits))
    only = {"structural.hotspots": lint_plan.DEFAULTS["structural.hotspots"], "structural.duplication": lint_plan.DEFAULTS["structural.duplication"]}
    with lint_plan.run(spark, str(src), only, log=str(log), now="2026-01-10") as run:
        rows = [(r["rule"], r["file"], r["value"], r["threshold"]) for r in run.found.collect()]
    assert sorted(r for r in rows if r[0] == "structural.hotspots") == [("structural.hotspots", f"m{k}.py", v, None) for k, v in ((6, 12.0), (7, 12.0), (8, 600.0))]
    assert sorted(r[1:] for r in rows if r[0] == "structural.duplication") == [(".", 0.333333, 0.05), ("m6.py", 3.0, 2.0)]  # three of all nine


def test_reports_and_error_isolation(spark, tmp_path, monkeypatch, capsys):
    from codescope import cli
    from codescope.plans import report

    def broken(m, c, name):
        raise ValueError("no such thing")

    monkeypatch.setitem(lint_plan.BRANCHES, "structural.deps", broken)
    root = tree(tmp_path, c=TEN, many="".join(f"def g{i}():\n    return {i}\n" for i in range(25)))
    (tmp_path / ".codescope.toml").write_text('[rules.lexical]\nenabled = false\n[rules.npath]\nthreshold = 500\n[[waivers]]\nid = "w"\npath = "many.py"\nrule = "structural.god_module"\nreason = "r"\n')
    assert cli.main(["lint", root], spark) == 2
    out = capsys.readouterr().out
    assert "structural.deps: error" in out and "ValueError: no such thing" in out and "c.py:1 ten - CCX 11, limit 10" in out and "NPath 1024, limit 500" in out
    assert out.strip().endswith("ERROR") and "1 waived" in out and "lexical" not in out
    assert cli.main(["check", "structural.complexity", root, "--quiet"], spark) == 1
    assert capsys.readouterr().out.strip() == "2 violations | 3 rules checked | FAIL"
    assert cli.main(["check", "structural.god_module", root, "--json"], spark) == 0
    import json

    doc = json.loads(capsys.readouterr().out)
    assert doc["summary"]["waived"] == 1 and doc["rules"]["structural.god_module"]["waived_violations"][0]["file"] == "many.py"
    assert cli.main(["check", "no.such.rule", root], spark) == 2
    assert report.plural(1, "rule") == "1 rule"


def test_settings(tmp_path):
    import tomllib

    from codescope.plans import settings

    known = list(lint_plan.DEFAULTS)
    assert settings.selected(known, "class") == [r for r in known if r.startswith("structural.class.")]
    assert settings.selected(known, "halstead.volume") == ["information.volume"]
    for bad in ("x", [1], [{"id": "a"}], [{"id": "a", "path": "p", "rule": "r", "reason": " "}], [{"id": "a", "path": "p", "rule": "r", "reason": "x", "expires": "soon"}], [{"id": "a", "path": "p", "rule": "r", "reason": "x", "allow_up_to": True}]):
        with pytest.raises(ValueError):
            settings.waivers(bad)
    assert settings.waivers([{"id": "a", "path": "p", "rule": "npath", "reason": "x"}])[0]["rule"] == "structural.complexity.npath"
    config, _ = settings.settled(lint_plan.DEFAULTS, {"rules": {"npath": {"threshold": 7}, "structural": {"severity": "warning", "complexity": {"npath": {"threshold": 9}}}}}, "strict")
    assert config["structural.complexity.npath"]["threshold"] == 9 and config["structural.complexity.npath"]["severity"] == "warning" and config["information.volume"]["threshold"] == 500
    again, _ = settings.settled(lint_plan.DEFAULTS, tomllib.loads(settings.written(lint_plan.DEFAULTS, "lax")))
    assert again == settings.settled(lint_plan.DEFAULTS, {}, "lax")[0]
    (tmp_path / "pyproject.toml").write_text("[tool.codescope]\nexclude = ['a']\n")
    (tmp_path / "sub").mkdir()
    assert settings.found(str(tmp_path / "sub"))[0] == {"exclude": ["a"]}
