"""Problem 1 against brute force, and its defined cases."""

import random

import pytest

from tracegrove.llm import conversations as C

SCHEMA = "id string, thread_id string, role string, content string, ts long, evidence_json string, deleted_at long"
T0 = 1_740_000_000_000


def rows_of(spark, rows):
    return spark.createDataFrame([(*r[:5], None, r[5]) for r in rows], SCHEMA)


def found(df):
    return sorted((r.thread_id, r.pos, r.message_id) for r in df.collect())


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    threads = {}
    for i, rs in by.items():
        if any(r[5] is not None for r in rs):
            continue
        _, thread, role, content, ts, _ = rs[0]
        if thread is None or content is None or not content.strip():
            continue
        unit = None if ts is None else ts * 1_000_000 if ts < 10**11 else ts * 1000 if ts < 10**14 else ts
        threads.setdefault(thread, []).append((unit, C.SPEAKERS.get((role or "").strip().lower()), i))
    out = []
    for t, ms in threads.items():
        if any(m is None or s is None for m, s, _ in ms):
            continue
        ms.sort()
        if C.alternates([s for _, s, _ in ms]):
            out += [(t, k + 1, i) for k, (_, _, i) in enumerate(ms)]
    return sorted(out)


def make(n, seed):
    rd, out = random.Random(seed), []
    for t in range(n):
        at = T0
        for k in range(rd.choice([2, 2, 4, 4, 3, 1, 6])):
            at += rd.choice([0, 1000, 5000])
            role = ["user", "agent"][k % 2] if rd.random() < 0.93 else rd.choice(["system", "Bot ", "??", None, "HUMAN"])
            ts = None if rd.random() < 0.01 else at if rd.random() < 0.9 else at * 1000
            row = (f"m{t}.{k}", f"t{t}" if rd.random() < 0.98 else None, role, rd.choice(["hi", "x", "hello", " \u00a0"]) if rd.random() < 0.1 else "hi", ts, None)
            out += [row] * rd.choice([1, 1, 1, 2])
            if rd.random() < 0.03:
                out.append((*row[:5], at))
    rd.shuffle(out)
    return out


@pytest.mark.parametrize("hot", [C.HOT, 3])
def test_against_brute_force(spark, hot):
    rows = make(120, 7)
    assert found(C.conversations(rows_of(spark, rows), hot=hot).select("thread_id", "pos", "message_id")) == brute(rows)


def test_defined_cases(spark):
    rows = [
        ("a1", "a", "user", "q", 1_740_000_000, None), ("a2", "a", "Assistant ", "r", 1_740_000_000_000, None), ("a0", "a", "system", "s", 1_740_000_000_000_000, None),
        ("b1", "b", "user", "q", T0, None), ("b2", "b", "agent", "\u3000\n", T0 + 1, None),
        ("c1", "c", "user", "q", T0, None), ("c2", "c", "agent", "r", None, None), ("d1", None, "user", "q", T0, None),
    ]
    assert found(C.conversations(rows_of(spark, rows)).select("thread_id", "pos", "message_id")) == [("a", 1, "a0"), ("a", 2, "a1"), ("a", 3, "a2")]
    assert found(C.conversations(rows_of(spark, [])).select("thread_id", "pos", "message_id")) == []


def test_clashing_columns(spark):
    rows = rows_of(spark, [("a1", "t", "user", "q", T0, None), ("a2", "t", "agent", "r", T0 + 1, None)])
    for c in ("key", "row", "gone", "moment", "speaker", "pos"):
        rows = rows.withColumn(c, rows["id"])
    assert C.conversations(rows).count() == 2


@pytest.mark.parametrize("hot", [C.HOT, 2])
def test_given_parents_and_cycles(spark, hot):
    rows = [("1", "t", "user", "q", T0 + 9, None, None), ("2", "t", "agent", "r", T0, "1", None), ("x", "u", "user", "q", T0, "y", None), ("y", "u", "agent", "r", T0 + 1, "x", None), ("3", "t", "user", "q", T0 + 1, "2", None), ("4", "t", "agent", "q", T0 + 2, "3", None)]
    df = spark.createDataFrame(rows, "id string, thread_id string, role string, content string, ts long, parent string, deleted_at long")
    assert found(C.conversations(df, "parent", hot)) == [("t", 1, "1"), ("t", 2, "2"), ("t", 3, "3"), ("t", 4, "4")]


def test_kahn_breaks_ties_by_time():
    assert C.kahn(["a", "b", "c"], [3, 1, 2], [1, 1, 1], [None, "a", "a"]) == [0, 1, 2]
    assert C.kahn(["a", "b"], [1, 2], [1, 2], ["b", "a"]) is None


def test_replies_are_linked_to_the_other_side():
    order = [0, 1, 2, 3, 4]
    assert C.answered([1, 2, 0, 1, 2], order) == [-1, 0, -1, 1, 3]
    assert C.answered([1, 1, 2, 2, 1], order) == [-1, -1, 1, 1, 3]


def forest(seed, threads=60):
    """Random reply forests: several roots, late parents, equal moments, parents elsewhere or missing, null ids, cycles."""
    rd, out = random.Random(seed), []
    for t in range(threads):
        n = rd.randint(1, 9)
        for k in range(n):
            parent = None if k == 0 or rd.random() < 0.15 else f"{t}.{rd.randrange(k)}" if rd.random() < 0.93 else f"{t}.{rd.randrange(n)}" if rd.random() < 0.6 else f"{rd.randrange(threads)}.0"
            role = ["user", "agent"][k % 2] if rd.random() < 0.9 else rd.choice(["system", "user", "agent"])
            out.append((None if rd.random() < 0.04 else f"{t}.{k}", f"t{t}", role, "hi", T0 + rd.choice([k, k, rd.randint(0, 9)]) * 1000, parent, None))
    rd.shuffle(out)
    return out


PARENTS = "id string, thread_id string, role string, content string, ts long, parent string, deleted_at long"


@pytest.mark.parametrize("seed", range(4))
def test_both_ways_of_ordering_agree_on_forests(spark, seed):
    df = spark.createDataFrame(forest(seed), PARENTS)
    whole = lambda hot: sorted(map(str, C.conversations(df, "parent", hot).collect()))
    want = whole(C.HOT)
    assert want and whole(0) == want


def test_trees_side_by_side_keep_the_order_of_time(spark):
    rows = [("1", "t", "user", "q", T0, None, None), ("2", "t", "agent", "r", T0 + 1, "1", None), ("3", "t", "user", "q", T0 + 2, None, None), ("4", "t", "agent", "r", T0 + 3, "3", None)]
    df = spark.createDataFrame(rows, PARENTS)
    for hot in (C.HOT, 1):
        assert found(C.conversations(df, "parent", hot)) == [("t", 1, "1"), ("t", 2, "2"), ("t", 3, "3"), ("t", 4, "4")]
