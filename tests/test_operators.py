"""Relational helpers, orphans, resolution, sources, streams and the project object."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracegrove.api import INTENTS, Project, render_mermaid, search_tools, summarize_hotspots
from tracegrove.operators import orphans, resolve
from tracegrove.operators.relational import current_rows, first_by, positions
from tracegrove.operators.skew import skew_join
from tracegrove.schema import bounded
from tracegrove.sources import extract, references, scan
from tracegrove.streaming.debounce import KeptCurrent, change_feed, debounced

T = datetime(2025, 1, 1)


def test_positions_and_current_rows(spark):
    rd = random.Random(2)
    rows = [(rd.choice(["hot"] * 5 + ["a", "b", None]), rd.random(), i) for i in range(400)]
    got = positions(spark.createDataFrame(rows, "k string, x double, i long"), "k", ["x", "i"], partitions=7).collect()
    want = {}
    for k in {r[0] for r in rows}:
        for p, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])), 1):
            want[r[2]] = p
    assert {r.i: r.pos for r in got} == want
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", None, "y")], "id string, seq int, v string")
    assert sorted((r.id, r.v) for r in current_rows(df, "id", [F.col("seq")]).collect()) == [("a", None), ("b", "y")]
    assert first_by(df, ["id"], [F.col("seq")]).count() == 2
    assert current_rows(df.limit(0), "id", [F.col("seq")]).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join(spark, how):
    left = spark.createDataFrame([("hot", i) for i in range(60)] + [("a", 1), (None, 2), ("z", 3)], "k string, i int")
    right = spark.createDataFrame([("hot", "H"), ("a", "A"), ("b", "B")], "k string, v string")
    want = sorted((r.k or "", r.i, r.v or "") for r in left.join(right, "k", how).collect())
    assert sorted((r.k or "", r.i, r.v or "") for r in skew_join(left, right, "k", how, hot=10, salts=4).collect()) == want


EDGES = "edge_seq long, src string, dst string, edge_type string, loaded_at timestamp_ntz"
NODES = "node_seq long, id string, node_type string, file_path string, loaded_at timestamp_ntz, removed_at timestamp_ntz"
MESSAGES = "id string, thread_id string, ts long, deleted_at long"
THREADS = "id string, created_at long, updated_at long, deleted_at long"


def test_orphans(spark):
    late = T + timedelta(days=1)
    nodes = spark.createDataFrame(
        [(1, "file::a", "file", "a", T, None), (1, "f1", "function", "a", T, None), (2, "gone", "function", "a", T, None), (5, "gone", "function", "a", T, late), (3, "late", "function", "a", late, None), (4, "x1", "function", "missing", T, None), (6, "kid", "method", None, T, None), (7, "back", "function", "a", T, late), (9, "back", "function", "a", late, None)], NODES
    )
    edges = spark.createDataFrame([(1, "f1", "gone", "calls", T), (1, "f1", "gone", "calls", T), (2, "f1", "late", "calls", T), (3, "f1", None, "calls", T), (4, "F1", "f1", "calls", T), (5, "x1", "kid", "contains", late), (6, "f1", "back", "calls", T), (7, "kid", "f1", "calls", None)], EDGES)
    messages = spark.createDataFrame([("m1", "t1", 1_735_689_600, None), ("m2", "t2", None, None), ("m3", None, 1, None), ("m4", "t3", 5, None), ("m4", "t3", 5, 9), ("m5", "t4", 1_735_689_600_000, None)], MESSAGES)
    threads = spark.createDataFrame([("t1", 1_735_689_600_000, 1, None), ("t2", 1, 1, None), ("t2", 1, 2, 7), ("t4", 1_735_689_600_001, 1, None)], THREADS)
    got = sorted((r.ref_key, r.ref_field, r.cause) for r in orphans.direct_orphans(edges, nodes, messages, threads).collect())
    assert got == [("1", "dst", "removed"), ("2", "dst", "late"), ("4", "src", "missing"), ("m2", "thread_id", "removed"), ("m5", "thread_id", "late")]
    assert sorted((r.key, r.round) for r in orphans.fallen_nodes(nodes, edges).collect()) == [("kid", 2), ("x1", 1)]
    found = sorted((r.ref_key, r.ref_field) for r in orphans.cascade(edges, nodes, messages, threads).where("kind = 'inherited'").collect())
    assert found == [("5", "dst"), ("5", "src"), ("7", "src")]
    empty = [df.limit(0) for df in (edges, nodes, messages, threads)]
    assert orphans.cascade(*empty).count() == 0
    assert orphans.orphan_report(orphans.cascade(edges, nodes, messages, threads)).agg(F.sum("orphans")).first()[0] == 8


def test_import_resolution(spark):
    files = spark.createDataFrame([("r/a/x.js", 'import * as y from "./y";\nimport z from "lib";\n'), ("r/a/y.ts", ""), ("r/m.py", "import a.n\nfrom q import z\n"), ("r/a/n.py", "def f():\n    return g(1)\n\ndef g(x):\n    return 1\n"), ("r/a/b.c", '#include "c.h"\n'), ("r/c.h", ""), ("r/n", None)], "relative_path string, content string")
    rows = [(r.relative_path, *x) for r in files.collect() for x in references.imports(r.relative_path, r.content or "")]
    imports = spark.createDataFrame(rows, "path string, " + references.IMPORTS)
    found = resolve.resolve_imports(imports, files.select(F.col("relative_path").alias("path")), spark.createDataFrame([], "root string, module string"))
    assert sorted((r.path, r.target) for r in found.where("target is not null").collect()) == [("r/a/b.c", "r/c.h"), ("r/a/x.js", "r/a/y.ts"), ("r/m.py", "r/a/n.py")]


def test_call_cascade(spark):
    known = spark.createDataFrame([("A.foo", "foo", "A.py", None), ("B.foo", "foo", "B.py", None), ("C.bar", "bar", "A.py", "C"), ("B.bar", "bar", "B.py", None), ("one", "one", "Z.py", None), ("I.q", "q", "I.py", None), ("J.q", "q", "J.py", None)], "id string, name string, file_path string, class_name string")
    calls = spark.createDataFrame([("A.foo", "foo", "A.py", None), ("C.test", "bar", "A.py", "C"), ("A.foo", "one", "A.py", None), ("A.foo", "q", "A.py", None), ("A.foo", "no", "A.py", None)], "source string, callee string, path string, class_name string").withColumn("receiver", F.lit(None).cast("string"))
    imported = spark.createDataFrame([("A.py", 1, None, "I.py", None)], "file string, seq long, symbol string, at string, alias string")
    got = {(r.source, r.callee): (r.target, r.tier) for r in resolve.resolve_calls(calls, known, imported).collect()}
    assert got == {("A.foo", "foo"): ("A.foo", 3), ("C.test", "bar"): ("C.bar", 3), ("A.foo", "one"): ("one", 2), ("A.foo", "q"): ("I.q", 1)}


def test_extractors(spark):
    python = extract.python_symbols('@d\nclass A(B):\n    "doc"\n    async def m(self):\n        def inner(): pass\n\ndef main(): pass\n\nif __name__ == "__main__":\n    main()\n')
    assert [(s[0], s[1], s[2], s[-1]) for s in python] == [("class", "A", None, False), ("method", "m", "A", False), ("function", "main", None, True)]
    assert extract.python_symbols("def (") == []
    files = spark.createDataFrame([("a.sql", "CREATE TABLE s.t (a INT); -- x;\nINSERT INTO s.d SELECT * FROM s.t JOIN u ON 1=1;"), ("b.go", "package p\n\ntype T struct {\n}\n\nfunc (t *T) M() {\n}\n"), ("c.rs", None)], "relative_path string, content string")
    rows = [(kind, sorted(writes), sorted(reads)) for _, kind, writes, reads, _ in extract.sql_rows("a.sql", files.where("relative_path = 'a.sql'").first().content)]
    assert rows == [("CREATE", ["s.t"], ["s.t"]), ("INSERT", ["s.d"], ["s.d", "s.t", "u"])]
    found = files.select(F.explode(extract.declarations(F.col("relative_path"), F.col("content"))).alias("f")).select("f.*")
    assert sorted((r.kind, r.name) for r in found.collect()) == [("class", "T"), ("function", "M")]


def test_scan_and_snapshot(spark, tmp_path):
    tree = tmp_path / "tree"
    for name, text in {"a.py": b"x = 1\n", "node_modules/b.py": b"", "sub/c.PY": b"\xff", "sub/d.min.js": b"", "e.txt": b""}.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_bytes(text)
    got = scan.scan_tree(spark, str(tree), ["py", "js"], ["*.min.js"])
    assert sorted(r.relative_path for r in got.collect()) == ["a.py", "sub/c.PY"]
    nodes = spark.createDataFrame([("a", "file"), ("b", "class")], "id string, node_type string")
    edges = spark.createDataFrame([("a", "b", "contains")], "src string, dst string, edge_type string")
    scan.save_snapshot(nodes, edges, str(tmp_path / "snap"))
    loaded = scan.load_snapshot(spark, str(tmp_path / "snap"), got)
    assert loaded[0].count() == 2 and loaded[1].where("edge_type = 'contains'").count() == 1
    newer = got.withColumn("mtime", F.col("mtime") + 1e6)
    assert scan.load_snapshot(spark, str(tmp_path / "snap"), newer) is None
    span = scan.read_span(spark.createDataFrame([("f", "a\nb\nc\n")], "relative_path string, content string"), 3, 2).first().span
    assert span == "   2 | b\n   3 | c"


def test_streams(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("path string, ts timestamp")
    rows = [("a", T), ("a", T + timedelta(milliseconds=500)), ("a", T + timedelta(seconds=5)), ("b", T), ("c", T + timedelta(minutes=5))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = debounced(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.path, r.changes) for r in spark.table("bursts").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    files = StructType.fromDDL("relative_path string, content string, mtime double")
    changed = []
    kept = KeptCurrent(spark, str(tmp_path / "kept"), "relative_path", "mtime", "content", lambda df, n: changed.append((n, sorted(r.relative_path for r in df.collect()))))
    for k, part in enumerate([[("a.py", "1", 1.0), ("b.py", "1", 1.0), ("c.txt", "1", 1.0)], [("a.py", "2", 2.0), ("b.py", "0", 0.5)]]):
        spark.createDataFrame(part, files).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        kept.start(change_feed(spark, str(tmp_path / "feed"), files, ["py"]), str(tmp_path / "c2"), once=True).awaitTermination(120)
        assert changed[-1] == (k, [["a.py", "b.py"], ["a.py"]][k])
    assert {r.relative_path: r.content for r in kept.read(9).collect()} == {"a.py": "2", "b.py": "1"}


def test_project(spark, data, tmp_path):
    p = Project(spark, data)
    first = p.edges(["CALLS"]).select("src", "dst").where("src <> dst").orderBy("src", "dst").first()
    assert first.dst in {r.id for r in p.callees_of(first.src).collect()}
    assert first.src in {r.id for r in p.callers_of(first.dst).collect()}
    assert p.find_path(first.src, first.dst).first().hops == 1
    nodes, edges = p.subgraph([first.src], 1, "out")
    assert nodes.count() >= 2 and edges.count() >= 1
    name = p.nodes("name").where(F.col("id") == first.dst).first().name
    assert p.resolve_symbol(name).first().score >= 1.0
    assert p.semantic_search(name, 3).count() == 3
    assert p.search("", 5).count() == 5
    assert len(INTENTS) == 17
    text = render_mermaid(nodes, edges)
    assert text.startswith("graph TD") and "-->" in text
    info = p.function_info(first.dst).first()
    assert info.n_callers >= 1 and first.src in (info.callers or []) or info.n_callers > 10
    index = str(tmp_path / "index")
    assert p.build_index(index).count() == p.build_index(index).count() > 0
    assert p.index_meta(index).first().width == 64 and p.index_meta(index + "x") is None
    assert p.semantic_search(name, 3, index).count() == 3
    assert p.symbol_info(name).first().id and p.symbol_info("no such name at all").count() == 0
    assert p.intent("graph_dependency_tree", query="no such name at all")["tree"].count() == 0 and p.intent("graph_path", source="no such name", target=name)["path"].count() == 0
    path = p.files("mtime").orderBy("relative_path").first().relative_path
    assert p.read_file_raw(path, 10).select("truncated").count() == 1 and p.read_file_span(path, 2, 1).first().base_line == 1
    with pytest.raises(ValueError):
        p.read_file("../x")
    with pytest.raises(PermissionError):
        p.read_file("a/node_modules/x.js")
    report = spark.createDataFrame([("a", 1.0), ("b", 9.5)], "path string, total double")
    assert summarize_hotspots(report) == "- b: 9.50\n- a: 1.00" and summarize_hotspots(report.limit(0)) == "No hotspots."
    assert "find_path" in search_tools("shortest path")
    assert {k for k in p.intent("symbol_lookup", query=name)} == {"symbol", "around"}
    with pytest.raises(ValueError):
        p.search("x", 501)
    with pytest.raises(ValueError):
        p.intent("nothing")
    assert bounded("top_n", 200) == 200
