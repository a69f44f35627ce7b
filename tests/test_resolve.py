"""Imports, calls and inheritance over small projects."""

from pyspark.sql import functions as F

from tracegrove.functions.comments import comments, masked
from tracegrove.operators import graph, relational, resolve
from tracegrove.sources import extract, references, scan

FILES = {
    "r/a/x.js": 'import {f as g, h} from "../b/z";\nimport y from \'./y\';\nconst q = require("./d");\nexport * from "/t.js";\n// import n from "./no"\nimport {\n  k\n} from "./y.ts";\nimport "react";', "r/b/z.ts": "", "r/a/y.ts": "", "r/a/d/index.mjs": "", "r/t.js": "",
    "r/p/m.py": "import p.q, os as o\nfrom .n import (a,\n b as c)\nfrom ..top import *\nfrom . import n\n", "r/p/q.py": "", "r/p/n.py": "", "r/top.py": "", "r/p/__init__.py": "",
    "r/src/main/java/c/e/Main.java": "import c.u.Helper;\nimport static c.u.*;\nimport java.util.List;\nimport u.Other;", "r/src/main/java/c/u/Helper.java": "", "r/lib/x/c/u/Helper.java": "", "r/lib/u/Other.java": "",
    "r/go.mod": "module ex.com/r\n", "r/g/main.go": 'package main\nimport (\n\t"fmt"\n\tz "ex.com/r/h/i"\n)\nimport "ex.com/r/h"', "r/h/i/i.go": "", "r/h/a_test.go": "", "r/h/b.go": "",
    "r/src/lib.rs": "use crate::net::http::{Req, Res as R};\npub mod net;\nuse std::io;\nuse self::net::X as Y;", "r/src/net.rs": "", "r/src/net/http.rs": "",
    "r/c/m.c": '#include "u.h"\n#include <v.h>\n#include "../w"\n', "r/c/u.h": "", "r/include/v.h": "", "r/w.hh": "", "r/cs/P.cs": "using A.B;\nusing T = C.Leaf;\n", "r/src/A/B/b.cs": "", "r/z/Leaf.cs": "", "r/rb/a.rb": "require_relative '../rb/b'\nrequire 'x'\n", "r/rb/b.rb": "",
}
WANT = [
    ("r/a/x.js", "../b/z", "r/b/z.ts"), ("r/a/x.js", "./d", "r/a/d/index.mjs"), ("r/a/x.js", "./y", "r/a/y.ts"), ("r/a/x.js", "./y.ts", "r/a/y.ts"), ("r/a/x.js", "/t.js", "r/t.js"), ("r/a/x.js", "react", None),
    ("r/c/m.c", "../w", "r/w.hh"), ("r/c/m.c", "<v.h>", "r/include/v.h"), ("r/c/m.c", "u.h", "r/c/u.h"), ("r/cs/P.cs", "A.B", "r/src/A/B/b.cs"), ("r/cs/P.cs", "C.Leaf", "r/z/Leaf.cs"),
    ("r/g/main.go", "ex.com/r/h", "r/h/b.go"), ("r/g/main.go", "ex.com/r/h/i", "r/h/i/i.go"), ("r/g/main.go", "fmt", None), ("r/p/m.py", ".", "r/p/__init__.py"), ("r/p/m.py", "..top", "r/top.py"), ("r/p/m.py", ".n", "r/p/n.py"), ("r/p/m.py", "os", None), ("r/p/m.py", "p.q", "r/p/q.py"),
    ("r/rb/a.rb", "../rb/b", "r/rb/b.rb"), ("r/src/lib.rs", "crate::net::http", "r/src/net/http.rs"), ("r/src/lib.rs", "net", "r/src/net.rs"), ("r/src/lib.rs", "self::net::X", "r/src/net.rs"), ("r/src/lib.rs", "std::io", None),
    ("r/src/main/java/c/e/Main.java", "c.u.*", "r/src/main/java/c/u/Helper.java"), ("r/src/main/java/c/e/Main.java", "c.u.Helper", "r/src/main/java/c/u/Helper.java"), ("r/src/main/java/c/e/Main.java", "java.util.List", None), ("r/src/main/java/c/e/Main.java", "u.Other", "r/lib/u/Other.java"),
]


def resolved(spark):
    rows = [(p, *i) for p, t in FILES.items() for i in references.imports(p, t)]
    imports = spark.createDataFrame(rows, "path string, " + references.IMPORTS)
    paths = spark.createDataFrame([(p,) for p in FILES], "path string")
    return resolve.resolve_imports(imports, paths, spark.createDataFrame([("r", "ex.com/r")], "root string, module string"))


def test_imports(spark):
    assert sorted((r.path, r.raw, r.target) for r in resolved(spark).collect()) == sorted(WANT, key=lambda x: (x[0], x[1]))
    assert resolved(spark).limit(0).count() == 0


def test_import_edges(spark):
    symbols = spark.createDataFrame([("s1", "f", "r/b/z.ts", 1), ("s2", "f", "r/b/z.ts", 2), (None, None, None, 3)], "id string, name string, file_path string, node_seq long")
    got = {(r.raw, r.imported_name): (r.target, r.alias, r.kind) for r in resolve.import_edges(resolved(spark), symbols).where("path in ('r/a/x.js', 'r/cs/P.cs')").collect()}
    assert got["../b/z", "f"] == ("s2", "g", "symbol") and got["../b/z", "h"] == ("file::r/b/z.ts", None, "symbol_not_found")
    assert got["/t.js", None][2] == "star" and got["C.Leaf", None] == ("file::r/z/Leaf.cs", "T", "module")


def test_calls_are_read_with_receivers():
    text = 'def f(x):\n  """g(1)"""\n  return a.b.c(h(x), "i(2)") # j(3)\n  if (k): pass\n'
    assert references.calls("a.py", text) == [(0, 3, "c", "b"), (1, 3, "h", None)]
    assert [c[2:] for c in references.calls("a.rs", "fn f() { A::b(c.d()); }")] == [("b", "A"), ("d", "c")]
    assert references.calls("a.md", "f(x)") == []


FUNCTIONS = "id string, name string, file_path string, class_name string, line_start int, line_end int"


def tier(spark, functions, calls, links=()):
    known = spark.createDataFrame(functions, FUNCTIONS)
    asked = resolve.calling_functions(spark.createDataFrame(calls, "path string, seq int, line int, callee string, receiver string"), known)
    edges = spark.createDataFrame(list(links), "file string, seq long, symbol string, at string, alias string")
    return {(r.source, r.callee, r.receiver): (r.target, r.tier) for r in resolve.resolve_calls(asked, known, edges).collect()}


def test_five_tiers(spark):
    f = [("A.foo", "foo", "A.py", None, 1, 9), ("B.foo", "foo", "B.py", None, 1, 9), ("C.bar", "bar", "A.py", "C", 20, 25), ("C.test", "test", "D.py", "C", 1, 9), ("B.bar", "bar", "B.py", None, 20, 29), ("one", "only", "B.py", None, 40, 41), ("E.m", "m", "E.py", "E", 1, 5), ("G.m", "m", "E.py", "G", 6, 9), ("H.m", "m", "H.py", "H", 1, 3)]
    assert tier(spark, f, [("A.py", 0, 5, "foo", None)]) == {("A.foo", "foo", None): ("A.foo", 3)}
    assert tier(spark, f, [("A.py", 0, 1, "foo", None), ("A.py", 1, 15, "foo", None)]) == {}  # a heading; outside of functions
    assert tier(spark, f, [("D.py", 0, 2, "bar", None)]) == {("C.test", "bar", None): ("C.bar", 4)}
    assert tier(spark, f, [("D.py", 0, 2, "only", "x")]) == {("C.test", "only", "x"): ("one", 2)}
    assert tier(spark, f, [("D.py", 0, 2, "m", "H")]) == {("C.test", "m", "H"): ("H.m", 5)}
    assert tier(spark, f, [("D.py", 0, 2, "m", "q")]) == {}
    links = [("D.py", 1, None, "B.py", None), ("D.py", 2, None, "E.py", "e")]
    assert tier(spark, f, [("D.py", 0, 2, "foo", None)], links) == {("C.test", "foo", None): ("B.foo", 1)}
    assert tier(spark, f, [("D.py", 0, 2, "m", "G")], links) == {("C.test", "m", "G"): ("G.m", 1)}
    assert tier(spark, f, [("D.py", 0, 2, "m", "e")], links) == {("C.test", "m", "e"): ("E.m", 1)}
    assert tier(spark, f, [("D.py", 0, 2, "foo", None)], [("D.py", 1, "A.foo", None, None)]) == {("C.test", "foo", None): ("A.foo", 1)}


def test_inheritance(spark):
    classes = spark.createDataFrame([("d", "D", "d.py", ["m.Base", "Near", "ns::Gone"], 1), ("b", "Base", "b.py", [], 2), ("n", "Near", "d.py", None, 3), ("o", "Near", "b.py", [], 0), ("x", "Base", "x.py", [], 0)], "id string, name string, file_path string, bases array<string>, node_seq long")
    links = spark.createDataFrame([("d.py", "b.py")], "src_file string, dst_file string")
    none = spark.createDataFrame([], "src string, name string")
    got = {(r.id, r.name): (r.base, r.cross_file) for r in resolve.resolve_bases(classes, links, none).collect()}
    assert got == {("d", "Base"): ("b", True), ("d", "Near"): ("n", False), ("d", "Gone"): (None, None)}
    assert resolve.resolve_bases(classes, links, spark.createDataFrame([("d", "Base")], "src string, name string")).count() == 2


def test_spans_meet_points_across_blocks(spark):
    points = spark.createDataFrame([("p", 1, 200), ("p", 2, 64), ("p", 3, 500), ("q", 4, 5)], "path string, k int, line int")
    spans = spark.createDataFrame([("p", 1, 400, "wide"), ("p", 190, 210, "tight"), ("p", 64, 64, "dot"), ("p", 9, 3, "bad"), ("p", None, 3, "none")], "path string, first int, last int, name string").withColumn("size", F.col("last") - F.col("first"))
    got = {r.k: r.name for r in resolve.enclosing(points, spans, ["k"], ["size"]).collect()}
    assert got == {1: "tight", 2: "dot"}


def test_comments_and_masks():
    assert comments("a.js", "x = '// no'; // yes\n/* a\n b */ `/* no */`\nr = /[/*]/g; // TODO") == [(1, "yes"), (2, "a"), (3, "b"), (4, "TODO")]
    assert comments("a.py", "s = '''# no'''\n# yes\n") == [(2, "yes")] and comments("a.sql", "-- q\nselect '--no'") == [(1, "q")]
    assert comments("a.rb", "#!x\n# y") == [(2, "y")] and comments("a", "") == []
    assert masked("a.py", "f('g(') # h(\nk") == "f(    )     \nk"


def test_sql_statements():
    got = extract.sql_rows("a.sql", "WITH q AS (SELECT x.a FROM s) INSERT INTO d SELECT q.a, ';' FROM q JOIN \"t\" ON q.a = t.b; -- x;\nMERGE INTO m USING n ON m.k = n.k WHEN MATCHED THEN DELETE;")
    assert [(r[1], r[2], r[3]) for r in got] == [("WITH", ["d"], ["s", "t", "d"]), ("MERGE", ["m"], ["n", "m"])]
    assert got[0][4].count("q.a") == 2 and "s" not in got[0][4]


def test_ignore_rules_and_paths():
    import re

    def hidden(path, rules):
        out = False
        for keep, pattern in scan.ignore_rules(rules):
            if re.search(pattern, path):
                out = not keep
        return out

    assert hidden("a/node_modules/x.js", scan.IGNORED) and hidden("x/y.min.js", scan.IGNORED) and not hidden("builds/x.js", scan.IGNORED)
    assert hidden("a/b/c.txt", ["/a/**/c.txt"]) and not hidden("x/a/c.txt", ["a/c.txt"]) and hidden("k.log", ["*.log"]) and not hidden("keep.log", ["*.log", "!keep.log"])
    assert scan.inside("a/./b/../c") == "a/c"
    for bad in ("../x", "/etc", "a/../../x", "C:\\x"):
        try:
            scan.inside(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_scan_tree_reads_ignore_files(spark, tmp_path):
    for p, t in {".gitignore": "*.gen.py\n!keep.gen.py\n", "a.py": "x", "b.gen.py": "x", "keep.gen.py": "x", "build/c.py": "x", "d.txt": "x", "e.py": "x"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    found = scan.scan_tree(spark, str(tmp_path), ["py"], hidden=spark.createDataFrame([("e.py",)], "relative_path string"))
    assert sorted(r.relative_path for r in found.collect()) == ["a.py", "keep.gen.py"]


def test_cycles_are_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("d", "e"), ("e", "d"), ("c", "d"), ("x", "x"), (None, "a")], "src string, dst string")
    assert {r.component: r.path for r in graph.cycles(edges).collect()} == {"c": ["c", "a", "b", "c"], "e": ["e", "d", "e"], "x": ["x", "x"]}


def test_running_sums_and_budget(spark):
    rows = spark.createDataFrame([(k, i, c, t) for k in "ab" for i, (c, t) in enumerate([(3, 3), (0, 2), (4, 4), (9, 9), (1, 1)])], "g string, i int, c int, t int")
    assert sorted((r.g, r.i, r.s) for r in relational.running_sums(rows, "g", ["i"], "c", "s").collect())[:5] == [("a", 0, 3), ("a", 1, 3), ("a", 2, 7), ("a", 3, 16), ("a", 4, 17)]
    assert sorted((r.g, r.i) for r in graph.budget_cut(rows, ["i"], "c", 8, "g", "t").collect()) == [(g, i) for g in "ab" for i in range(3)]
