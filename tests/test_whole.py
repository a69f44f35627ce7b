"""Queries over small tables that hold what the given ones do not: deep graphs, copies of vectors."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tracegrove import api
from tracegrove.operators import orphans
from tracegrove.plans import CORE_ORACLES, CORE_QUERIES, search_queries

NODES = "node_seq long, id string, name string, node_type string, file_path string, relative_path string, line_start int, line_end int, docstring string, removed_at timestamp, decorators array<string>, meta map<string,string>"
EDGES = "edge_seq long, src string, dst string, edge_type string, weight double"


def write_graph(spark, folder, nodes, pairs):
    """nodes: id and type; pairs: src, dst, type."""
    rows = [(i, k, k, kind, "r/a.py", None, 1, 1, None, None, None, None) for i, (k, kind) in enumerate(nodes)]
    spark.createDataFrame(rows, NODES).write.parquet(f"{folder}/nodes.parquet")
    spark.createDataFrame([(i, *p, None) for i, p in enumerate(pairs)], EDGES).write.parquet(f"{folder}/edges.parquet")


def test_walks_reach_the_end_of_a_long_chain(spark, tmp_path):
    n, d = 7, str(tmp_path)
    chain = [f"r/f{i:02}" for i in range(n + 1)]
    calls = [f"r/g{i:02}" for i in range(n + 1)]
    pairs = [(a, b, "imports") for a, b in zip(chain, chain[1:])] + [("r/f00", "r/f02", "inherits"), ("r/f00", "r/x", "imports")]
    pairs += [(a, b, "calls") for a, b in zip(calls, calls[1:])] + [("r/h", calls[-1], "calls")]
    write_graph(spark, d, [(k, "file") for k in [*chain, "r/x"]] + [(k, "function") for k in [*calls, "r/h"]], pairs)
    run = lambda name: CORE_QUERIES[name](spark, d).collect()
    depths = {r.id: r.depth for r in run("reachable_set_whole")}
    assert depths == {"r/f00": 0, "r/x": 1, **{k: i - (i > 1) for i, k in enumerate(chain) if i}}
    typed = run("reachable_typed_whole")
    assert sum(r.n for r in typed) == n + 2 and max(r.depth for r in typed) == n
    assert {r.id: (r.hops, r.length) for r in run("shortest_path_length_whole")}[chain[-1]] == (n, n + 1)
    assert {r.id: r.hops for r in run("entrypoint_paths_len_whole")} == {"r/g00": n, "r/h": 1}


def test_copies_of_vectors_are_told_apart_by_id(spark, tmp_path):
    n = 60
    rows = [(i, 0, [0.0, 0.0] if i % 2 == 0 else [float(i), 1.0]) for i in reversed(range(n + 1))]
    for parts in (1, 4):
        d = f"{tmp_path}/{parts}"
        spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).repartition(parts).sortWithinPartitions("label", -F.col("vec_id")).write.parquet(f"{d}/embeddings.parquet")
        for name in ("knn_l2_topk", "knn_filtered_type"):
            got = sorted((r.rank, r.vec_id) for r in CORE_QUERIES[name](spark, d).collect())
            assert got == [(i, 2 * i) for i in range(1, 11)]


def test_query_vectors_in_blocks(spark, data, monkeypatch):
    order = lambda df: sorted(map(tuple, df.collect()))
    want = order(CORE_QUERIES["knn_l2_topk"](spark, data))
    monkeypatch.setattr(search_queries, "BLOCK", 2)
    monkeypatch.setattr(search_queries, "CHUNK", 9)
    assert order(CORE_QUERIES["knn_l2_topk"](spark, data)) == want


def test_every_entrypoint_is_scored_with_its_base(spark, tmp_path):
    d = str(tmp_path)
    nodes = [("main", "function"), *[(f"g{i}", "function") for i in range(60)], ("x", "function")]
    write_graph(spark, d, nodes, [("main", "x", "calls"), ("x", "main", "calls"), *[(f"g{i}", t, "calls") for i in range(60) for t in ("x", "main")]])
    base = {r.id: r.base for r in CORE_QUERIES["entrypoint_candidates"](spark, d).collect()}
    got = {r.id: (r.reach, r.score, r.place) for r in CORE_QUERIES["entrypoint_scores_whole"](spark, d).collect()}
    assert got == {"main": (2, round(0.7 * base["main"] + 0.006, 6), 1)} and len(base) == 1


def test_every_intent_is_routed_to(spark, tmp_path):
    known = search_queries.INTENTS
    assert set(known) == set(api.INTENTS)
    spark.createDataFrame([(k, v, None, 1, 1, None, None, None) for k, v in known.items()], "id string, title string, project_path string, created_at long, updated_at long, pinned_context string, summary string, deleted_at long").write.parquet(f"{tmp_path}/chat_threads.parquet")
    got = {r.id: (r.intent, r.score) for r in CORE_QUERIES["token_overlap_router"](spark, str(tmp_path)).collect()}
    # A phrase goes before the words that are shared: "unused" is dead code, "between" a path, "auth" security.
    for phrases, intent in search_queries.PHRASES:
        assert all(got[k] == (next(i for ps, i in search_queries.PHRASES if any(p in v for p in ps)), 0.9) for k, v in known.items() if any(p in v for p in phrases))
    assert all(got[k][0] == k for k, v in known.items() if not any(p in v for ps, _ in search_queries.PHRASES for p in ps))


def test_cascade_does_not_end_early_in_silence(spark):
    nodes = spark.createDataFrame([(i, k, "class", None, None) for i, k in enumerate("abc")], "node_seq long, id string, node_type string, file_path string, removed_at timestamp")
    edges = spark.createDataFrame([(a, b, "contains") for a, b in ("?a", "ab", "bc")], "src string, dst string, edge_type string")
    assert {r.key: r.round for r in orphans.fallen_nodes(nodes, edges).collect()} == {"a": 1, "b": 2, "c": 3}
    with pytest.raises(RuntimeError):
        orphans.fallen_nodes(nodes, edges, 2)


def test_missing_references_come_from_the_whole_cascade(spark, tmp_path, monkeypatch):
    """p5_found goes through every round, and both queries of problem 5 give the rows of their SQL on a deep graph with circles."""
    rng, t = random.Random(5), datetime(2025, 1, 1)
    names = [f"n{i}" for i in range(60)] + [f"file::f{i}" for i in range(8)]
    nodes = [(i, k, "file" if ":" in k else "class", None if ":" in k or rng.random() < 0.5 else f"f{rng.randrange(10)}", t + timedelta(days=rng.randrange(3)), t if rng.random() < 0.1 else None) for i, k in enumerate(names)]
    nodes += [(100 + i, f"c{i}", "class", None, t, None) for i in range(12)] + [(200, "c3", "class", None, t + timedelta(days=40), None)]
    pairs = [("?", "c0", "contains"), *((f"c{i}", f"c{i + 1}", "contains") for i in range(11)), ("c11", "c4", "contains")]  # c4 is held by c11 too: the chain ends there
    pairs += [("?", f"d{i}", "contains") for i in range(3)] + [(f"d{i}", f"d{i + 1}", "contains") for i in range(3)] + [("d3", "n0", "calls"), ("n0", "d3", "calls")]
    nodes += [(300 + i, f"d{i}", "class", None, t, None) for i in range(4)]
    pairs += [(rng.choice([*names, "?"]), rng.choice([*names, None]), rng.choice(["contains", "calls"])) for _ in range(150)]
    edges = [(i, *p, None if rng.random() < 0.1 else t + timedelta(days=rng.randrange(70))) for i, p in enumerate(pairs)]
    edges += rng.sample(edges, 40) + [(900, "d3", "d0", "calls", t + timedelta(days=d)) for d in (70, 5)]  # sent again, the last one with another time
    tables = {
        "nodes": (nodes, "node_seq long, id string, node_type string, file_path string, loaded_at timestamp_ntz, removed_at timestamp_ntz"),
        "edges": (edges, "edge_seq long, src string, dst string, edge_type string, loaded_at timestamp_ntz"),
        "chat_messages": ([("m1", "t1", 5, None), ("m2", "t2", 1_735_689_600, None)], "id string, thread_id string, ts long, deleted_at long"),
        "chat_threads": ([("t2", 1_735_689_600_001, 1, None)], "id string, created_at long, updated_at long, deleted_at long"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    fell, walk = [], orphans.fallen_nodes
    monkeypatch.setattr(orphans, "fallen_nodes", lambda *a: fell.append(walk(*a)) or fell[-1])
    for name in ("p5_found", "p5_report"):
        df = CORE_QUERIES[name](spark, str(tmp_path))
        want = con.execute(CORE_ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(want.fetchall(), key=repr)
    assert len(fell) == 2
    rounds = {r.key: r.round for r in fell[0].collect()}
    assert [rounds.get(f"c{i}") for i in range(5)] == [1, 2, 3, 4, None] and [rounds.get(f"d{i}") for i in range(4)] == [1, 2, 3, 4]
