"""Problem 7: every token is placed once, no container overflows, and the filling is close to what volume allows."""

import random

from tracegrove.llm import packing as P
from tracegrove.llm.tokens import token_counts


def check(spark, docs, kinds, path=None, most=P.OPEN):
    sizes = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(docs, ["doc_id"]).collect())
    placed = P.pack(docs, spark.createDataFrame(kinds, "container_kind string, capacity long"), most=most).collect()
    for kind, capacity in {k for k in kinds if k[0] and k[1] and k[1] > 0}:
        rows = [r for r in placed if r.container_kind == kind]
        used, pieces = {}, {}
        for r in rows:
            used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
            pieces.setdefault(r.doc_id or 0, []).append((r.start, r.n_tokens))
        assert max(used.values(), default=0) <= capacity
        assert sorted((d, sum(n for _, n in ps)) for d, ps in pieces.items()) == sizes
        for d, n in sizes:
            ps = sorted(pieces[d])
            assert len(ps) == max(1, -(-n // capacity)) and all(a + b == c for (a, b), (c, _) in zip(ps, ps[1:]))
    return placed


def test_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kinds = [(r.container_kind, r.capacity) for r in spark.read.parquet(f"{data}/containers.parquet").collect()]
    check(spark, docs, kinds)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a " * 700), (2, None), (3, ""), (4, "b"), (5, "c " * 10)], "doc_id long, text string").repartition(3)
    check(spark, docs, [("k", 16), ("x", None), (None, 5), ("z", 0)], most=2)
    empty = P.pack(docs.limit(0), spark.createDataFrame([("k", 16)], "container_kind string, capacity long"))
    assert empty.count() == 0


def test_packer_fills_well_and_keeps_its_bound():
    rd, packer = random.Random(5), P.Packer(1000, 64)
    sizes = [rd.randint(1, 700) for _ in range(20_000)]
    bins = {}
    for s in sizes:
        b = packer.put(s)
        bins[b] = bins.get(b, 0) + s
        assert packer.count <= 64
    assert max(bins.values()) <= 1000
    assert sum(sizes) / (1000 * len(bins)) > 0.97


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    p = P.Packer(10, 2)
    assert [p.put(6), p.put(7), p.put(3), p.put(4)] == [0, 1, 1, 0] and sorted(p.closed) == [0, 1]
    p = P.Packer(10, 2)
    assert [p.put(8), p.put(6), p.put(9)] == [0, 1, 2] and p.closed == [0]


def test_rounds_in_many_tasks(spark):
    """Few items a task: a tree of rounds, every piece placed once, no overflow, and the same bins each time."""
    rd = random.Random(9)
    docs = spark.createDataFrame([(i, "a " * rd.randint(1, 40)) for i in range(400)], "doc_id long, text string").repartition(8)
    kinds = [("k", 60), ("m", 200)]
    sizes = spark.createDataFrame(kinds, "container_kind string, capacity long")
    runs = []
    for _ in range(2):
        rows = P.pack(docs, sizes, most=4, items=20).collect()
        used = {}
        for r in rows:
            used[r.container_kind, r.container_id] = used.get((r.container_kind, r.container_id), 0) + r.n_tokens
        assert all(n <= dict(kinds)[k] for (k, _), n in used.items())
        assert sorted((r.container_kind, r.doc_id) for r in rows) == sorted((k, i) for k, _ in kinds for i in range(400))
        assert any(c.startswith("m1.1.") for _, c in used)
        runs.append(sorted((r.container_kind, r.container_id, r.doc_id) for r in rows))
    assert runs[0] == runs[1]
