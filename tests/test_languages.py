"""Functions, classes, imports and rules over sources in ten more languages, with hand-counted values."""

import pytest

from codescope.operators import search, tables
from codescope.plans import lint as lint_plan
from codescope.plans import settings
from codescope.sources import code, imports
from codescope.sources.token_facts import read_file

CLASSIFY_C = "int classify(int x) {\n  if (x < 0) {\n    return -1;\n  } else if (x == 0) {\n    return 0;\n  } else if (x > 100 && x < 1000) {\n    return 2;\n  } else {\n    return 1;\n  }\n}\n"
SWITCH = "switch (x) {\n case 1: return 1;\n case 2: return 2;\n case 3: return 3;\n default: return 0;\n }\n"
JULIA = """function branchy(x, y)
    if x > 0 && y > 0
        while y > 0
            y -= 1
        end
    elseif x < 0
        for i in 1:abs(x)
            if i == 5
                continue
            end
        end
        return "neg"
    else
        return "zero"
    end
end
branchy2(x) = x > 0 ? (x > 10 ? "big" : "small") : "neg"
-(a::Int, b::Int) = a > b ? a : b
Base.show(io, p) = print(io, p)
v = [y for y in z if y > 1]
w = a[end]
"""
RUBY = """class A < B
  def self.create(spec) = Foo.new(spec)
  def ==(other); true; end
  def [](i); @arr[i]; end
  def classify(x)
    return 9 if x.nil?
    if x < 0
      -1
    elsif x == 0
      0
    elsif x > 100 && x < 1000
      2
    else
      1
    end
  end
end
xs.each do |x|
  puts x unless x.zero?
end
"""
RUST = "pub struct S<'a> { x: &'a str }\nimpl<'a> T for S<'a> { fn m(&self) -> i32 { match y { 1 => 2, 2 if z => { f() } _ => 0 }; loop { break; } let c = |q| q || r; 3 } }\n"
GO = "package m\nimport (\n\t\"fmt\"\n\tx \"a/helper\" // a ) here\n)\ntype S struct {\n\tBase\n\tn int\n}\nfunc (s *S) M(a int) (int, error) {\n\tif x := f(); x > 0 && a < 3 {\n\t\treturn 1, nil\n\t} else if a == 2 {\n\t\treturn 2, nil\n\t}\n\tswitch a {\n\tcase 1, 2:\n\t\treturn 1, nil\n\tdefault:\n\t\tg(func(y int) bool { return y > 0 || y < -3 })\n\t}\n\treturn 0, nil\n}\n"
JS = "class A extends B { constructor(x) { super(x) } get y() { return this.x ? 1 : 2 } }\nexport function foo(x) {\n  if (x) return 1\n  else if (x.y) { return 2 }\n  p.catch(q)\n  try { p() } catch (e) { q() }\n  const k = { m(a) { return a || b } }\n  return /a?b/.test(x) && y\n}\n"
JAVA = "public class A<T extends Z> extends C implements D {\n  public <T> List<T> m(String mode) throws E {\n    for (int i : xs) { if (i > 0 && b < 2 || c) { return; } }\n    xs.forEach(x -> x.y());\n    Runnable r = new Runnable() { public void run() { if (a) b(); } };\n    return b > 1 ? null : x;\n  }\n}\n"
CSHARP = 'namespace N { public class A : B, IC { public int P { get; set; } int M(string mode) => mode == "a" && b ? 1 : 2; void N() { switch (x) { case 1: case 2: break; default: break; } int? n = null; v?.Do(); } } }\n'
CPP = "class Animal : public Base<int> {\npublic:\n  Animal(int x) : a_(x), b_{2} { init(); }\n  ~Animal() { cleanup(); }\n  bool operator==(const Animal& o) const { return true; }\n};\nvoid Animal::walk() { if (a) return; }\ntemplate <typename T>\nT pick(T a, T b) { if (a > b && b > 0) return a; auto f = [](int q) { return q; }; return b; }\n"

CASES = [
    ("c", CLASSIFY_C, {"classify": (5, 7, 4)}),
    ("c", "int sw(int x) {\n" + SWITCH + "}\nint f(int a) { if (a) { g(); } if (a) { g(); } if (a) { g(); } return 0; }\ntypedef int (*cmp)(int);\n", {"sw": (5, 4, 4), "f": (4, 3, 8)}),
    ("javascript", "function sw(x) {\n" + SWITCH + "}\n", {"sw": (4, 3, 3)}),
    ("javascript", JS, {"constructor": (1, 0, 1), "y": (2, 1, 1), "foo": (5, 5, 6), "m": (2, 1, 1)}),
    ("typescript", "interface I { a(): string }\nfunction f(xs: number[], q?: string): void { xs?.map((x) => x > 1 && x < 3); }\n", {"f": (1, 0, 1), "<lambda>": (2, 1, 1)}),
    ("go", GO, {"M": (5, 5, 3), "<lambda>": (2, 1, 1)}),
    ("java", JAVA, {"m": (6, 6, 3), "<lambda>": (1, 0, 1), "run": (2, 1, 2)}),
    ("c_sharp", CSHARP, {"M": (3, 2, 1), "N": (3, 2, 2)}),
    ("rust", RUST, {"m": (4, 3, 6), "<lambda>": (2, 1, 1)}),
    ("cpp", CPP, {"Animal": (1, 0, 1), "~Animal": (1, 0, 1), "==": (1, 0, 1), "walk": (2, 1, 2), "pick": (3, 2, 2), "<lambda>": (1, 0, 1)}),
    ("ruby", RUBY, {"create": (1, 0, 1), "==": (1, 0, 1), "[]": (1, 0, 1), "classify": (6, 5, 4), "<lambda>": (2, 1, 1)}),
    ("julia", JULIA, {"branchy": (7, 10, 6), "branchy2": (3, 3, 1), "-": (2, 1, 1), "show": (1, 0, 1)}),
]


@pytest.mark.parametrize("lang,text,expected", CASES, ids=[f"{n}-{c[0]}" for n, c in enumerate(CASES)])
def test_counts(lang, text, expected):
    got = {r["name"]: (r["ccx"], r["cog"], int(r["npath"])) for r in read_file("x", text, lang) if r["kind"] == "function"}
    assert got == expected


@pytest.mark.parametrize("lang", lint_plan.LANGUAGES)
def test_odd_texts(lang):
    for text in ("", "}", "{", "((", "end", "end end", "if", "class", "function", "def", "case", "'", '"', "/*", "=begin", "a ? b", "\x00�", "fn f(", "=>", "x" * 5000, "{" * 3000, "if (a) {" * 1500):
        rows = read_file("x", text, lang)
        assert rows and all(r["file"] == "x" for r in rows)


def test_classes_and_parameters():
    got = {lang: {r["name"]: (r["bases"], r["definitions"]) for r in read_file("x", text, lang) if r["kind"] == "class"} for lang, text in (("java", JAVA), ("cpp", CPP), ("ruby", RUBY), ("rust", RUST), ("go", GO), ("c_sharp", CSHARP), ("javascript", JS))}
    assert got["java"] == {"A": (["C", "D"], 1)}
    assert got["cpp"] == {"Animal": (["Base"], 4)}
    assert got["ruby"] == {"A": (["B"], 4)}
    assert got["rust"] == {"S": ([], 1)}
    assert got["go"] == {"S": (["Base"], 1)}
    assert got["c_sharp"] == {"A": (["B", "IC"], 2)}
    assert got["javascript"] == {"A": (["B"], 2)}
    text = "void increment(int *p) { *p = *p + 1; }\nvoid update(struct P *q, const struct P *r, char *mode) { q->x = r->x; }\nint read_only(const int *p) { return *p; }\n"
    rows = {r["name"]: r for r in read_file("x", text, "c") if r["kind"] == "function"}
    assert [len(rows[n]["mutations"]) for n in ("increment", "update", "read_only")] == [1, 1, 0]
    assert rows["update"]["sentinels"] == [{"param": "mode", "annotated": True}]


def write(root, **files):
    for name, text in files.items():
        p = root / name.replace("_DIR_", "/").replace("_DOT_", ".")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


def test_imports_and_edges(spark, tmp_path):
    root = write(
        tmp_path, a_DOT_c='#include "lib/b.h"\n  # include <stdio.h>\n', lib_DIR_b_DOT_h='#include "a.h"\n', main_DOT_go=GO, helper_DOT_go='package h\nimport "m/main"\n',
        x_DOT_js="import {\n a\n} from './lib/y';\nimport './z.css'\nconst q = import('no')\n", lib_DIR_y_DOT_js='import x from "../x"\n', P_DOT_java="import static a.b.Q;\nimport c.d.*;\n", Q_DOT_java="",
        m_DOT_jl="using LinearAlgebra, helper\nimport Base: show\n", r_DOT_rb="require_relative './s'\n", s_DOT_rb="load('r.rb')\n", u_DOT_rs="use crate::a::b;\n    use not_here;\n", py_DOT_py="import pkg\nfrom . import s\n", pkg_DIR_mod_DOT_py="import py\n",
    )
    (tmp_path / "pkg" / "__init__.py").write_text("")
    m = lint_plan.Metrics(spark, code.files(spark, root))
    got = {(r["src"], r["module"]) for r in m.imports().select("src", "module").collect()}
    assert got == {
        ("a.c", "lib/b.h"), ("a.c", "stdio.h"), ("lib/b.h", "a.h"), ("main.go", "fmt"), ("main.go", "a/helper"), ("helper.go", "m/main"), ("x.js", "./lib/y"), ("x.js", "./z.css"), ("lib/y.js", "../x"), ("P.java", "a.b.Q"), ("P.java", "c.d"),
        ("m.jl", "LinearAlgebra"), ("m.jl", "helper"), ("m.jl", "Base"), ("r.rb", "./s"), ("s.rb", "r.rb"), ("u.rs", "crate::a::b"), ("py.py", "pkg"), ("pkg/mod.py", "py"),
    }
    edges = {(r["src"], r["dst"]) for r in m.import_edges().collect()}
    assert edges == {
        ("a.c", "lib/b.h"), ("main.go", "helper.go"), ("helper.go", "main.go"), ("x.js", "lib/y.js"), ("lib/y.js", "x.js"), ("P.java", "Q.java"), ("m.jl", "helper.go"), ("r.rb", "s.rb"), ("s.rb", "r.rb"), ("py.py", "pkg/__init__.py"), ("pkg/mod.py", "py.py"),
    }
    one = m.file_deps("helper.go").collect()
    assert [(r["path"], r["lang"], r["ca"], r["ce"], r["imports"], r["total"], r["truncated"]) for r in one] == [("helper.go", "go", 2, 1, ["m/main"], 1, False)]
    top = m.file_deps(most=1).collect()
    assert [(r["path"], r["total"], r["truncated"]) for r in top] == [("helper.go", 15, True)]
    assert {r["node"] for r in m.cycles("x.js").collect()} == {"x.js", "lib/y.js"}
    assert m.cycles("a.c").count() == 0
    m.close()


def test_rules_over_languages(spark, tmp_path):
    body = "".join(f"  if (a == {n}) {{ b(); }}\n" for n in range(11))
    root = write(tmp_path, big_DOT_c="int big(int a) {\n" + body + "  return 0;\n}\n", leaky_DOT_c="".join(f"void *f{n}(void *p);\n" for n in range(6)), far_DOT_cpp="void Shape::area() { if (a) { b(); } }\n", shape_DOT_hpp="class Shape {\n void one() { two(); }\n};\n", lit_DOT_rb="def f(a)\n  a * 37 + 41 * 53 - 67 + 0x1F\nend\n", in_DOT_c="int g(void) {\n#include \"t.inc\"\n  // ------\n  // ======\n  // ******\n  return 0;\n}\n")
    m = lint_plan.Metrics(spark, code.files(spark, root))
    assert {(r["file"], r["wmc"]) for r in m.class_metrics().collect()} == {("shape.hpp", 3)}
    assert {r["file"] for r in m.unused_modules(3).collect()} == {"big.c", "leaky.c", "far.cpp", "lit.rb"} | {"shape.hpp"}
    m.close()
    found = {(r["rule"], r["file"]) for r in lint_plan.lint(spark, root).collect()}
    assert {("structural.complexity.cyclomatic", "big.c"), ("structural.complexity.npath", "big.c"), ("structural.types.escape_hatches", "leaky.c"), ("information.magic_literals", "lit.rb"), ("structural.local_imports", "in.c"), ("information.section_comments", "in.c")} <= found


def test_search(spark):
    texts = spark.createDataFrame([("a", "one Two\ntwo (x)\n\nend two\n"), ("b", None), ("c", ""), ("d", "two")], "k string, t string")
    rows = search.search(texts, "k", "t", ["two", {"kind": "fixed", "value": "(x)"}], context=1).collect()
    assert sorted((r["k"], r["line"], r["pattern"], r["before"], r["after"]) for r in rows) == [("a", 2, "(x)", ["one Two"], [""]), ("a", 2, "two", ["one Two"], [""]), ("a", 4, "two", [""], []), ("d", 1, "two", [], [])]
    assert search.search(texts, "k", "t", ["TWO"], mode="fixed", case="insensitive").count() == 4
    assert search.search(texts, "k", "t", ["wo"], mode="fixed", whole_words=True).count() == 0
    assert search.search(texts, "k", "t", ["^$"]).count() == 1
    with pytest.raises(ValueError):
        search.search(texts, "k", "t", ["a"], mode="glob")
    capped = tables.capped(search.search(texts, "k", "t", ["two"]), ["k", "line"], 2).collect()
    assert [(r["k"], r["line"], r["total"], r["truncated"]) for r in capped] == [("a", 2, 3, True), ("a", 4, 3, True)]


def test_word_references(spark):
    stems = spark.createDataFrame([("f1", "node"), ("f2", "my-file"), ("f3", "none")], "o string, s string")
    lines = spark.createDataFrame([("f1", "node"), ("f2", "node node"), ("f3", "a node, my-file"), ("f3", "nodes my-files"), ("f4", "xmy-file")], "f string, t string")
    assert {(r["o"], r["refs"]) for r in search.word_references(stems, lines, "o", "s", "f", "t").collect()} == {("f1", 2), ("f2", 1), ("f3", 0)}


def test_history(spark, tmp_path):
    log = tmp_path / "log"
    log.write_text("\x1ea\x1f2026-01-02T10:00:00+00:00\x1fp\n\n3\t1\tsrc/a.py\n1\t0\tsrcs/b.py\n\x1eb\x1f2026-01-03T10:00:00+00:00\x1fp q\n\n5\t0\tsrc/a.py\n\x1ec\x1f2026-02-03T10:00:00+00:00\x1fp\n\n5\t0\tother.py\n")
    rows, churn = code.history(spark, str(log), "2026-01-01", "2026-01-31", prefixes=["src"])
    assert [r["commit"] for r in rows.collect()] == ["a"] and [r["file"] for r in churn.collect()] == ["src/a.py"]
    rows, churn = code.history(spark, str(log), "1 month ago", merges=True, now="2026-02-01")
    assert sorted(r["commit"] for r in rows.collect()) == ["a", "b", "c"] and churn.count() == 4
    plain = tmp_path / "names"
    plain.write_text("\x1ea\x1f2026-01-02T10:00:00+00:00\x1f\n\nx.py\ny z.py\n\x1eb\x1f2026-01-03T10:00:00+00:00\x1fp\n")
    assert sorted((r["commit"], r["file"]) for r in code.names(spark, str(plain)).collect()) == [("a", "x.py"), ("a", "y z.py")]
    (tmp_path / "empty").write_text("")
    states = [code.log_status(spark, str(tmp_path / name), cut).first()[:2] for name, cut in (("log", False), ("log", True), ("empty", False), ("gone", False))]
    assert states == [(True, "complete"), (True, "shallow"), (True, "empty"), (False, "missing")]
    assert code.log_command(start="14 days ago", paths=["a"])[-4:] == ["--no-merges", "--since=14 days ago", "--", "a"]
    with pytest.raises(ValueError):
        code.log_command(paths=["--output=x"])


def test_languages_and_names(spark):
    assert settings.languages(["Go", "cobol"], ["go", "c"]) == (["go"], ["cobol"])
    for bad in ((["cobol"], False), (["go", "cobol"], True)):
        with pytest.raises(ValueError):
            settings.languages(bad[0], ["go"], bad[1])
    paths = spark.createDataFrame([("a/b/__init__.py",), ("x.h",), ("a/n.d.ts",)], "p string")
    got = [set(r[0]) for r in paths.select(imports.names_of(paths["p"])).collect()]
    assert got == [{"a.b.__init__", "a/b/__init__", "a/b/__init__.py", "a.b", "a/b"}, {"x", "x.h"}, {"a.n.d", "a/n.d", "a/n.d.ts"}]


def test_patterns(spark):
    from codescope.operators import pattern
    from codescope.sources import nodes

    files = spark.createDataFrame(
        [("a.py", "python", "def get_x(a, b):\n    return é.get(set_y(1), get_x(2, 3))\n"), ("b.go", "go", GO), ("c.py", "python", "def ("), ("d.txt", None, "x"), ("e.py", "python", "")], "path string, lang string, content string"
    )
    n = nodes.nodes(files).cache()
    assert [r["file"] for r in n.filter("kind = 'error'").collect()] == ["c.py"]
    calls = pattern.match(n, "(Call func: (Name id: (identifier) @callee))")
    assert sorted(r["callee"]["text"] for r in calls.collect()) == ["get_x", "set_y"]
    assert [r["callee"]["line"] for r in pattern.match(n, '(Call func: (Name id: (identifier) @callee)) (#match? @callee "^get_")').collect()] == [2]
    assert [r["c"]["text"] for r in pattern.match(n, '(Call func: (_ (identifier) @c)) (#not-eq? @c "get")').filter("c.text = 'get_x'").collect()] == ["get_x"]
    two = pattern.match(n, "(Call args: (Constant) @x args: (Constant) @y) @call").collect()
    assert sorted((r["x"]["text"], r["y"]["text"]) for r in two) == [("2", "3")]  # in their order
    text = files.first()["content"]
    assert {text[r["call"]["start"] : r["call"]["stop"]] for r in two} == {"get_x(2, 3)"}
    assert [r["f"]["text"] for r in pattern.match(n, '(fn name: (identifier) @f body: (block (if)))', "go").collect()] == ["M"]
    for bad in ("", "(a", "a)", "(a) (b)", '(a) (#eq? @x "y")', '(a @b', '()', '(a) @x (#is? @x "y")'):
        with pytest.raises(ValueError):
            pattern.match(n, bad)
    n.unpersist()


def test_files(spark, tmp_path):
    names = ["a.py", "_x_DIR_b.py", "_x_DIR__y_DIR__c.py", "_x_DIR__y_DIR_d.py", "build_DIR_e.py", "sub_DIR_build_DIR_f.py", "sub_DIR_g.log", "sub_DIR_keep.log", "sub_DIR_deep_DIR_h.py", "top_DIR_i.py", "sub_DIR_top_DIR_j.py", "t1.c", "t2.c", "build_DIR_keep.log"]
    root = write(tmp_path, **{n.replace(".", "_DOT_"): "x = 1\n" for n in names}, empty_DOT_py="", **{"_DOT_gitignore": "# no\nbuild/\n*.log\n!keep.log\n/top\nt[!1].c\n", "sub_DIR__DOT_gitignore": "deep/**\n", "_DOT_hid_DIR_k_DOT_py": "x"})
    got = sorted(r["path"] for r in code.files(spark, root).select("path").collect())
    assert got == sorted(["a.py", "_x/b.py", "_x/_y/_c.py", "_x/_y/d.py", "empty.py", "sub/keep.log", "sub/top/j.py", "t1.c"])
    every = [r["path"] for r in code.files(spark, root, ignores=False).select("path").collect()]
    assert len(every) == len(set(every)) == len(names) + 1
    assert sorted(r["path"] for r in code.files(spark, root, globs=["*.py", "a*"], depth=1).collect()) == ["a.py", "empty.py"]
