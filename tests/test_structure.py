"""Open classes, packages of all languages, clones among all functions."""

import pytest

from codescope.operators import tables
from codescope.plans import lint as lint_plan
from codescope.sources import code
from codescope.sources.inventory import Inventory
from codescope.sources.tokens import tokens


def write(root, **sources):
    for name, text in sources.items():
        p = root / name.replace("_DIR_", "/").replace("_DOT_", ".")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


ANIMAL = "class Animal\n  def speak\n    raise NotImplementedError\n  end\n  def legs\n    if @custom\n      @custom_legs\n    else\n      4\n    end\n  end\nend\n"
AGAIN = "class Animal < Being\n  def lifespan\n    if @young\n      10\n    else\n      20\n    end\n  end\nend\nclass Being\nend\nclass Cat < Animal\nend\nclass Cat < Animal\nend\n"


def test_open_classes(spark, tmp_path):
    root = write(tmp_path, a_DOT_rb=ANIMAL, b_DOT_rb=AGAIN, c_DOT_py="class Twice:\n    def a(self): pass\nif 1:\n    class Twice:\n        def b(self): pass\n")
    m = lint_plan.Metrics(spark, code.files(spark, root))
    got = {r["name"]: r for r in m.class_metrics().filter("lang = 'ruby'").collect()}
    assert m.class_metrics().filter("lang = 'ruby'").count() == 3 and m.class_metrics().filter("name = 'Twice'").count() == 2
    animal = got["Animal"]
    assert (animal["wmc"], animal["method_count"], animal["bases"], animal["file"], animal["line"]) == (5, 3, ["Being"], "a.rb", 1)
    assert (animal["dit"], animal["noc"], got["Cat"]["dit"], got["Being"]["noc"]) == (1, 1, 2, 1)
    m.close()
    only = {"structural.class.complexity": {**lint_plan.DEFAULTS["structural.class.complexity"], "threshold": 4}}
    with lint_plan.run(spark, root, only) as run:
        assert [(r["file"], r["line"], r["symbol"], r["value"]) for r in run.found.collect()] == [("a.rb", 1, "Animal", 5.0)]


def test_merged_takes_nulls_and_ties(spark):
    rows = [("a", 2, 1, 5, ["x", None, "y"]), ("a", 1, None, 7, ["z", "x"]), ("a", 1, 4, 7, None), (None, 3, 1, None, []), (None, 4, 2, 2, ["q", "q"])]
    df = spark.createDataFrame(rows, "name string, at int, wmc int, cbo int, bases array<string>")
    got = {r["name"]: (r["wmc"], r["cbo"], r["bases"], r["at"]) for r in tables.merged(df, ["name"], ["at"], ["wmc"], ["cbo"], ["bases"], []).collect()}
    assert got == {"a": (5, 7, ["z", "x", "y"], 1), None: (3, 2, ["q"], 3)}
    assert tables.merged(df.limit(0), ["name"], ["at"], ["wmc"], ["cbo"], ["bases"], []).isEmpty()


#: Sources with the abstract and concrete types that they declare.
DECLARED = [
    ("java", "public interface IShape { double area(); }\npublic abstract class AbstractShape implements IShape {}\npublic class Circle extends AbstractShape { Class<?> c = Circle.class; }\npublic record Point(int x, int y) {}\n@interface Note {}\nenum E { A }\n// class No {}\n", "IShape AbstractShape", "Circle Point"),
    ("c_sharp", "namespace X { public interface IShape { } public abstract class Shape : IShape { } public class Circle<T> : Shape where T : class where U : struct { } public struct Point { } public record Person(string Name); record struct Q(int A); }", "IShape Shape", "Circle Point Person Q"),
    ("typescript", "export interface Shape { area(): number; }\nexport abstract class BaseShape implements Shape { abstract area(): number; }\nexport class Circle extends BaseShape { }\nconst x = class Named {};\nconst y = { interface: 1 };\n", "Shape BaseShape", "Circle"),
    ("javascript", "export class Circle {}\nexport default class Square extends Circle {}\nconst a = class B {};\n'class C {}'\n", "", "Circle Square"),
    ("rust", "pub trait Shape { fn area(&self) -> f64; }\npub struct Circle { r: f64 }\npub enum Color { Red }\nimpl Shape for Circle {}\n", "Shape", "Circle Color"),
    ("go", "package p\ntype A interface { M() }\ntype B struct { inner struct { x int } }\ntype C[T any] struct{}\ntype D int\ntype (\n\tE struct { F struct{} }\n\tG interface{}\n)\nvar x struct{ a int }\n", "A G", "B C E"),
    ("ruby", "module M\n  class A < B\n  end\n  class << self\n  end\nend\nx.class\nclass N::P\nend\n", "M", "A"),
    ("c", "struct a { int x; };\nstruct a y;\nenum e { E };\nunion u { int i; };\ntypedef struct { int z; } t;\ntypedef int (*fn)(int);\ntypedef int number, *pointer;\nstruct a f(struct a p) { return p; }\n", "", "a e u t number"),
    ("cpp", "class Forward;\nclass Shape { public: virtual double area() const = 0; };\nclass Circle final : public Shape { double area() const override { return 0; } int x = 0; };\nclass Last final { virtual void f() = 0; };\nstruct S { virtual void g() = 0; };\nenum class Kind : int { A };\ntemplate <class T, class U> class Box { };\nusing V = int;\ntypedef int W;\n", "Shape", "Circle Last S Kind Box W"),
    ("julia", "abstract type A end\nstruct B end\n", "", ""),
]


@pytest.mark.parametrize(("lang", "text", "abstract", "concrete"), DECLARED)
def test_declared_types(lang, text, abstract, concrete):
    found = Inventory(tokens(text, lang), lang).found()
    assert [n for n, _, a in found if a] == abstract.split() and [n for n, _, a in found if not a] == concrete.split()
    assert Inventory(tokens("", lang), lang).found() == []
    for cut in range(len(text)):  # half a file is no error
        Inventory(tokens(text[:cut], lang), lang).found()


def test_packages_of_all_languages(spark, tmp_path):
    sources = {
        "go_DIR_lib_DIR_a_DOT_go": "package lib\ntype A interface { M() }\ntype B struct {}\n", "go_DIR_cmd_DIR_main_DOT_go": '// main\npackage main\nimport "go/lib"\ntype C struct {}\n',
        "js_DIR_a_DIR_one_DOT_js": "import x from '../b/two.js'\nclass One {}\n", "js_DIR_b_DIR_two_DOT_js": "export class Two {}\n", "js_DIR_b_DIR_three_DOT_ts": "export interface Three { }\n",
        "plain_DIR_k_DOT_py": "class K: pass\n", "pk_DIR___init___DOT_py": "", "pk_DIR_k2_DOT_py": "import abc\nclass K2(abc.ABC): pass\nclass K3(metaclass=abc.ABCMeta): pass\nclass K4(Protocol[T]): pass\nclass K5: pass\n",
        "top_DOT_rs": "pub trait T {}\n", "r_DIR_m_DOT_rb": "module M\nend\n", "j_DIR_x_DOT_jl": "struct B end\n",
    }
    root = write(tmp_path, **sources)
    m = lint_plan.Metrics(spark, code.files(spark, root))
    got = {(r["lang"], r["node"]): r for r in m.packages().collect()}
    assert {k: (r["na"], r["nc"]) for k, r in got.items()} == {("go", "go/lib"): (1, 1), ("javascript", "js/a"): (0, 1), ("javascript", "js/b"): (0, 1), ("typescript", "js/b"): (1, 0), ("python", "pk"): (3, 1), ("rust", "."): (1, 0), ("ruby", "r"): (1, 0), ("julia", "j"): (0, 0)}
    assert (got["javascript", "js/a"]["ce"], got["javascript", "js/b"]["ca"], got["javascript", "js/b"]["zone"]) == (1, 1, "pain")
    assert got["julia", "j"]["zone"] == "unknown" and got["go", "go/lib"]["ca"] == 0
    mains = {(r["lang"], r["node"]): r["ca"] for r in m.packages(["go"], mains=True).collect()}
    assert set(mains) == {("go", "go/lib"), ("go", "go/cmd")}
    first = m.packages(most=1).collect()
    assert len(first) == 1 and first[0]["node"] == "js/b" and first[0]["truncated"] and first[0]["total"] == 8
    m.close()
    with lint_plan.run(spark, root, {"structural.packages": lint_plan.DEFAULTS["structural.packages"]}) as run:
        assert [(r["file"], r["value"]) for r in run.found.collect()] == [("js/b", 1.0)]


CLONE = "def {0}({1}, {2}):\n    {3} = 0\n    for {4} in {1}:\n        {3} = {3} + {4} * {2}\n    return {3}\n"


def test_share_of_clones_among_all(spark, tmp_path):
    tiny = "".join(f"def t{i}(x):\n    return x\n" for i in range(10))
    root = write(tmp_path, a_DOT_py=CLONE.format(*"process items factor total item".split()), b_DOT_py=CLONE.format(*"gather entries scale result entry".split()), c_DOT_py=tiny + "f = lambda x: x + 1\n", d_DOT_py="def ratio(a, b):\n    if b == 0:\n        return None\n    return a / b\n")
    rule = {"structural.duplication": lint_plan.DEFAULTS["structural.duplication"]}
    with lint_plan.run(spark, root, rule) as run:
        assert sorted((r["file"], r["value"], r["symbol"]) for r in run.found.collect()) == [(".", round(2 / 13, 6), None), ("a.py", 2.0, "process")]
    write(tmp_path, e_DOT_py="".join(f"def u{i}(x):\n    return x\n" for i in range(87)))
    with lint_plan.run(spark, root, rule) as run:  # 2 of 100
        assert sorted((r["file"], r["value"]) for r in run.found.collect()) == [("a.py", 2.0)]


def test_leaves_in_their_order(spark, tmp_path):
    root = write(tmp_path, a_DOT_py='def f(a):\n    """doc"""\n    x = -1.5 if a else None  # why\n    return f"{x}!" + \'\' + b"y"\n')
    m = lint_plan.Metrics(spark, code.files(spark, root))
    shape = m.functions.first()["shape"]
    assert " ".join(shape) == (
        "string_start string_content string_end identifier = - float if identifier else none comment return string_start { identifier } string_content string_end + string_start string_end + string_start string_content string_end"
    )
    m.close()


#: What each rule says besides.
FIELDS = {
    "structural.complexity.cyclomatic": "zone cog end_line", "structural.complexity.cognitive": "zone ccx end_line", "structural.complexity.npath": "end_line language", "structural.class.complexity": "kind method_count cbo",
    "structural.class.coupling": "kind dit noc wmc", "structural.class.inheritance.depth": "kind superclasses", "structural.class.inheritance.children": "kind", "structural.hotspots": "quadrant sum_ccx loc_delta commit_count last_seen",
    "structural.packages": "zone instability abstractness ca ce language", "structural.deps": "cycle", "structural.local_imports": "module language function", "structural.redundancy": "fn_a fn_b fn_a_line fn_b_line shared_callees score",
    "structural.types.sentinels": "param_name annotated call_site_literals call_site_count", "structural.types.hidden_mutators": "language mutations mutated_params", "structural.types.escape_hatches": "language escape_count total_count density",
    "structural.duplication": "", "structural.god_module": "language loc", "structural.orphans": "symbol_type confidence caveats", "information.volume": "raw_volume penalty difficulty effort vocabulary length end_line",
    "information.difficulty": "volume effort vocabulary length end_line", "information.magic_literals": "language literals distinct_count", "information.section_comments": "divider_lines language", "lexical.stutter": "scope_name scope_type overlap identifier_tokens",
    "lexical.verbosity": "total_identifiers total_tokens end_line language", "lexical.tersity": "short_identifiers short_count total_identifiers density",
}

PY = """from typing import Any
import b
class Base: pass
class Kid(Base):
    def m(self, mode: str, total_items_list: list) -> Any:
        import json
        # ----- part
        # ===== part
        total_items_list.append(37)
        if mode == 'x' and self:
            return Base
        return 41 + 43 * a
def one(a, q):
    load_it(a); store_it(q); check_it(a)
    return m('fast')
def two(a, q):
    load_it(a); store_it(q); check_it(q)
    return m('slow')
def lonely_thing(b: Any) -> Any:
    return b
def load_big_table(load_big_name):
    return load_big_name
"""


def test_every_rule_says_what_it_knows(spark, tmp_path):
    import json

    from codescope.plans import report

    src = tmp_path / "src"
    root = write(src, pk_DIR___init___DOT_py="", pk_DIR_a_DOT_py=PY, pk_DIR_b_DOT_py="import pk.a\n" + CLONE.format(*"process items factor total item".split()) + CLONE.format(*"gather entries scale result entry".split()), pk_DIR_c_DOT_py="import a\n")
    log = tmp_path / "log"
    log.write_text("".join(f"\x1ec{i}\x1f2026-01-0{i}T00:00:00+00:00\x1fp\n\n9\t0\tpk/a.py\n" for i in (1, 2)))
    low = {"min_shared": 1, "min_annotations": 1, "min_identifiers": 1, "min_confidence": "low", "fail_on_zone": ["pain", "unknown", "clean", "ok", "warning"], "fail_on_quadrant": ["insufficient_data"]}
    zero = {n: {**c, "enabled": True, "threshold": 99 if n.endswith(("sentinels", "orphans")) else 1 if n.endswith(("mutators", "stutter")) else 0} | {k: v for k, v in low.items() if k in c} for n, c in lint_plan.DEFAULTS.items()}
    waivers = [{"id": "w1", "rule": "structural.god_module", "path": "pk/*", "reason": "small", "allow_up_to": 50, "expires": "2030-01-01"}]
    with lint_plan.run(spark, root, zero, waivers, "2026-01-01", log=str(log), now="2026-01-10") as run:
        assert run.per_rule.filter("error is not null").collect() == []
        whole = json.loads(report.as_json(run.found, run.per_rule, root))
        text = report.human(run.found, run.per_rule)
        counts = {r["confidence"]: r["n"] for r in report.by_confidence(run.found).collect()}
        rows = [json.loads(r["value"]) for r in report.as_rows(run.found).collect()]
    by = {n: r["violations"] + r["waived_violations"] for n, r in whole["rules"].items()}
    missing = [n for n, v in by.items() if not v]
    assert missing == []
    for name, fields in FIELDS.items():
        for v in by[name]:
            assert set(fields.split()) <= set(v["metadata"]), (name, v)
    assert {frozenset(v["metadata"]) for v in by["structural.duplication"]} == {frozenset(["functions_analyzed", "clone_fraction", "cluster_count"]), frozenset(["fingerprint", "clone_count", "members"])}
    waived = whole["rules"]["structural.god_module"]["waived_violations"]
    assert waived and all(v["metadata"]["waiver"] == {"id": "w1", "reason": "small", "allow_up_to": 50.0, "expires": "2030-01-01"} for v in waived)
    meta = {(n, v["symbol"]): v["metadata"] for n, vs in by.items() for v in vs}
    assert meta["structural.types.sentinels", "m"]["call_site_literals"] == ["fast", "slow"] and meta["structural.types.sentinels", "m"]["call_site_count"] == 2
    assert meta["structural.redundancy", "one"]["shared_callees"] == ["check_it", "load_it", "store_it"] and meta["structural.redundancy", "one"]["fn_b"] == "two"
    assert meta["information.section_comments", "m"]["divider_lines"] == [7, 8] and meta["structural.local_imports", "m"]["module"] == "json"
    assert meta["structural.class.inheritance.depth", "Kid"]["superclasses"] == ["Base"] and meta["structural.types.hidden_mutators", "m"]["mutated_params"] == ["total_items_list"]
    assert sum(counts.values()) == len(by["structural.orphans"]) and set(counts) == {"high", "medium", "low"}
    assert "dividers 2, limit 0 (lines 7, 8)" in text and "local imports 1, limit 0 (json inside m)" in text
    assert len(rows) == sum(map(len, by.values())) and all("metadata" in r or r["rule"] for r in rows)


def test_ranked_in_total_orders(spark, tmp_path):
    ifs = lambda n, name: f"def {name}(x):\n" + "".join(f"    if x == {i}:\n        x += 1\n" for i in range(n)) + "    return x\n"
    root = write(tmp_path, a_DOT_py=ifs(3, "p") + ifs(1, "q"), b_DOT_py=ifs(3, "r") + "class A: pass\nclass B(A): pass\n", c_DOT_py=ifs(5, "s"), d_DOT_rb="x = 1\n")
    m = lint_plan.Metrics(spark, code.files(spark, root))
    for kind in ("complexity", "npath"):
        got = m.ranked(kind, 3).collect()
        assert [(r["name"], r["total"], r["truncated"]) for r in got] == [("s", 4, True), ("p", 4, True), ("r", 4, True)]
    assert [r["name"] for r in m.ranked("complexity").collect()] == ["s", "p", "r", "q"] and not m.ranked("complexity").first()["truncated"]
    assert [(r["file"], r["functions"], r["sum_ccx"]) for r in m.complexity_of_files(3).collect()] == [("c.py", 1, 6), ("a.py", 1, 4), ("b.py", 1, 4)]
    assert [r["name"] for r in m.ranked("halstead", 1).collect()] == ["s"] and [r["name"] for r in m.ranked("classes", 1).collect()] == ["B"]
    assert [(r["size"], r["name"], r["total"]) for r in m.ranked("clones", 5).collect()] == [(2, "p", 1)]
    ends = [r["distance"] for r in m.ranked("packages").collect()]
    assert ends == sorted(ends, key=lambda d: (d is None, -(d or 0)))
    assert m.ranked("complexity", 0).isEmpty()
    m.close()


def test_published_and_former_keys():
    from codescope.plans import settings

    def of(raw, profile="default"):
        return settings.settled(lint_plan.DEFAULTS, {"rules": raw}, profile)[0]

    new = of({"structural": {"complexity": {"cyclomatic_threshold": 7, "npath_threshold": 9}, "packages": {"max_distance": 0.4}, "deps": {"fail_on_cycles": False}}, "lexical": {"verbosity": {"max_mean_tokens": 2.5}, "tersity": {"max_density": 0.1}}, "information": {"volume": {"token_weight_alpha": 0.2}}})
    limit = lambda c, name: c[name]["threshold"]
    assert (limit(new, "structural.complexity.cyclomatic"), limit(new, "structural.complexity.cognitive"), limit(new, "structural.complexity.npath"), limit(new, "structural.packages")) == (7, 15, 9, 0.4)
    assert not new["structural.deps"]["enabled"] and of({"deps": {"fail_on_cycles": True}})["structural.deps"]["enabled"]
    assert (limit(new, "lexical.verbosity"), limit(new, "lexical.tersity"), new["information.volume"]["alpha"]) == (2.5, 0.1, 0.2)
    old = of({"complexity": {"cyclomatic_threshold": 5, "weighted_threshold": 30, "severity": "warning"}, "halstead": {"volume_threshold": 700, "enabled": False}, "class": {"coupling_threshold": 3, "inheritance_depth_threshold": 2}, "npath": {"npath_threshold": 50}, "lexical": {"max_density": 0.3, "severity": "error"}})
    assert (limit(old, "structural.complexity.cyclomatic"), limit(old, "structural.class.complexity"), limit(old, "information.volume"), limit(old, "structural.class.coupling"), limit(old, "structural.class.inheritance.depth"), limit(old, "structural.complexity.npath"), limit(old, "lexical.tersity")) == (5, 30, 700, 3, 2, 50, 0.3)
    assert old["structural.complexity.cyclomatic"]["severity"] == "warning" and not old["information.difficulty"]["enabled"] and old["lexical.stutter"]["severity"] == "error"
    both = of({"complexity": {"cyclomatic_threshold": 5}, "structural": {"complexity": {"cyclomatic_threshold": 6, "cyclomatic": {"threshold": 8}}}})
    assert limit(both, "structural.complexity.cyclomatic") == 8
    assert limit(of({"complexity": {"cyclomatic_threshold": 5}, "structural": {"complexity": {"cyclomatic_threshold": 6}}}), "structural.complexity.cyclomatic") == 6
    assert limit(of({"complexity": {"cyclomatic_threshold": 5}}, "strict"), "structural.complexity.cyclomatic") == 5
    notes = settings.former({"rules": {"halstead": {"volume_threshold": 1}, "structural": {"deps": {}}}, "waivers": [{"id": "w", "rule": "npath"}]})
    assert notes == ["[rules.halstead] is now information.volume, information.difficulty", "waiver w: npath is now structural.complexity.npath"]
    assert settings.former({}) == [] and settings.migrated({"complexity": 3}) == {}


def test_language_setting(spark, tmp_path, capsys):
    from codescope import cli
    from codescope.plans import report

    many = "".join(f"def g{i}():\n    return {i}\n" for i in range(25))
    go = "package p\n" + "".join(f"func G{i}() int {{ return {i} }}\n" for i in range(25))
    root = write(tmp_path, a_DOT_py=many + "import b\n", b_DOT_py="import a\n", c_DOT_go=go)
    rule = {n: lint_plan.DEFAULTS[n] for n in ("structural.god_module", "structural.deps")}
    for languages, want in ((None, {"a.py", "c.go"}), (["go"], {"c.go"})):
        with lint_plan.run(spark, root, rule, languages=languages) as run:
            rows = run.found.collect()
            assert {r["file"] for r in rows if r["rule"] == "structural.god_module"} == want
            assert [r["file"] for r in rows if r["rule"] == "structural.deps"] == ["a.py"]  # imports are those of all languages
            assert {r["rule"]: r["checked"] for r in run.per_rule.collect()} == {"structural.god_module": 3 if languages is None else 1, "structural.deps": 3}
    assert cli.main(["check", "structural.god_module", root, "--languages", "go,cobol"], spark) == 0
    out = capsys.readouterr()
    assert "c.go" in out.out and "a.py" not in out.out and "cobol isn't read" in out.err
    assert cli.main(["check", "structural.god_module", root, "--languages", "cobol"], spark) == 2
    meant = spark.createDataFrame([(1, 9, 0, 99), (0, 0, 0, 0)], "dit int, cbo int, noc int, wmc int")
    said = [r[0] for r in meant.select(report.exceeded({c: (meant[c], 8) for c in ("cbo", "dit", "noc", "wmc")})).collect()]
    assert said == ["coupled with many classes; much decided in its methods", "within limits"]


def test_stop_lists_by_language(spark, tmp_path):
    calls = "{ malloc(1); free(x); printf(y); memcpy(z); }"
    same = "{ load_it(1); store_it(x); check_it(y); malloc(2); }"
    root = write(tmp_path, a_DOT_c=f"void a(int x) {calls}\nvoid b(int x) {calls}\nvoid c(int x) {same}\nvoid d(int x) {same}\n", a_DOT_js=f"function a() {calls}\nfunction b() {calls}\n")
    with lint_plan.run(spark, root, {"structural.redundancy": lint_plan.DEFAULTS["structural.redundancy"]}) as run:
        assert sorted((r["file"], r["symbol"]) for r in run.found.collect()) == [("a.c", "c"), ("a.js", "a")]


def test_usages_of_a_symbol(spark, tmp_path):
    root = write(tmp_path, a_DOT_py="class Thing:\n    pass\nx = Thing()\n", b_DOT_py="# Things to do\nfrom a import Thing\n", c_DOT_txt="Thing\n", d_DOT_go="package d\ntype Thing struct{}\n")
    m = lint_plan.Metrics(spark, code.files(spark, root))
    got = [(r["kind"], r["file"], r["line"], r["symbol_type"]) for r in m.usages("Thing").collect()]
    assert got == [("definition", "a.py", 1, "class"), ("reference", "a.py", 3, None), ("reference", "b.py", 1, None), ("reference", "b.py", 2, None), ("reference", "c.txt", 1, None), ("definition", "d.go", 2, got[-1][3])]
    first = m.usages("Thing", definitions=False, most=2).collect()
    assert [(r["kind"], r["total"], r["truncated"]) for r in first] == [("reference", 6, True)] * 2
    assert m.usages("nothing").isEmpty()
    m.close()
