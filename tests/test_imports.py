"""Imports by syntax: comments, texts and several lines, in each language."""

import pytest

from codescope.plans import lint as lint_plan
from codescope.sources import code, token_imports
from codescope.sources.tokens import tokens

CASES = [
    ("javascript", "// import a from 'no1'\n/*\nimport b from 'no2'\n*/\nconst s = `\nimport c from 'no3'\n`;\nimport d, {\n  e,\n  f,\n} from 'yes1';\nimport 'yes2'\nimport * as g from \"yes3\"; import h from 'yes4'\nconst i = import('no4')\nimport.meta.url\nexport { j } from 'no5'\nx.import('no6')\n", ["yes1", "yes2", "yes3", "yes4"]),
    ("typescript", "import type { A } from './a';\nimport B = require('no');\nlet s = \"import c from 'no'\";\n", ["./a"]),
    ("go", 'package p\n// import "no1"\n/*\nimport "no2"\n*/\nimport "yes1"\nimport (\n\t"yes2"\n\talias "yes3" // "no3"\n\t_ `no4`\n)\nvar s = `\nimport "no5"\n`\nfunc f() { g("no6") }\n', ["yes1", "yes2", "yes3"]),
    ("java", "package p;\n// import no.A;\n/* import no.B;\nimport no.C; */\nimport a.b.\n  C;\nimport static d.e.F.*; import g.H;\nclass X { String s = \"import no.D;\"; String t = \"\"\"\nimport no.E;\n\"\"\"; }\n", ["a.b.C", "d.e.F", "g.H"]),
    ("c_sharp", "// using No.A;\nusing A.B;\nglobal using static C.D;\nusing E = F.G;\nvar s = @\"\nusing No.B;\n\";\nclass X { void M() { using (var a = B()) { } using var c = D(); using Foo d = E(); } }\nusing System;\n", ["A.B", "C.D", "F.G", "System"]),
    ("julia", "# using No\n#=\nusing No2\n=#\nusing A, B.C,\n  D\nimport Base: show, print\ns = \"\"\"\nusing No3\n\"\"\"\nimport E\nx = 1; using F\n", ["A", "B.C", "D", "Base", "E", "F"]),
    ("c", '// #include "no1.h"\n/*\n#include "no2.h"\n*/\n#include "yes1.h"\n  #  include <yes2.h>\nchar *s = "\\\n#include <no3.h>";\n#define X "#include <no4.h>"\n', ["yes1.h", "yes2.h"]),
    ("cpp", "#include <vector>\n/* #include <no> */ #include <no2>\nint x = '\"';\n#include \"a/b.hpp\"\n", ["vector", "a/b.hpp"]),
    ("ruby", "# require 'no1'\n=begin\nrequire 'no2'\n=end\nrequire 'yes1'\nrequire_relative(\"./yes2\")\nload \"yes3.rb\" if x\ns = \"require 'no3'\"\nKernel.load 'no4'\ndef require(x) 'no5' end\nrequire \"a#{b}\"\nt = <<~TEXT\n  require 'no6'\nTEXT\n", ["yes1", "./yes2", "yes3.rb"]),
]


@pytest.mark.parametrize(("lang", "text", "want"), CASES, ids=[c[0] for c in CASES])
def test_what_looks_like_an_import(lang, text, want):
    assert [m for m, _ in token_imports.found(tokens(text, lang), text, lang)] == want
    for cut in range(len(text)):
        token_imports.found(tokens(text[:cut], lang), text[:cut], lang)


def test_imports_in_a_tree(spark, tmp_path):
    sources = {"a.js": "/*\nimport x from './no'\n*/\nimport {\n  y\n} from './b'\n", "b.js": "const t = `\nimport z from './a'\n`\n", "no.js": "", "r.rb": "def f\n  require 'set'\nend\nrequire './s'\n", "s.rb": "", "u.rs": "use crate::v;\n", "v.rs": "", "w.c": 'int f(void) {\n#include "x.h"\n  return 1;\n}\n', "x.h": ""}
    for name, text in sources.items():
        (tmp_path / name).write_text(text)
    m = lint_plan.Metrics(spark, code.files(spark, str(tmp_path)))
    assert sorted((r["src"], r["line"], r["module"]) for r in m.imports().collect()) == [("a.js", 4, "./b"), ("r.rb", 2, "set"), ("r.rb", 4, "./s"), ("u.rs", 1, "crate::v"), ("w.c", 2, "x.h")]
    assert {(r["src"], r["dst"]) for r in m.import_edges().collect()} == {("a.js", "b.js"), ("r.rb", "s.rb"), ("w.c", "x.h")}
    m.close()
    with lint_plan.run(spark, str(tmp_path), {"structural.local_imports": lint_plan.DEFAULTS["structural.local_imports"]}) as run:
        assert sorted((r["file"], r["line"], r["symbol"]) for r in run.found.collect()) == [("r.rb", 2, "f"), ("w.c", 2, "f")]
