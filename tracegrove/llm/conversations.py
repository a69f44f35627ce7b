"""Problem 1: ordered conversations from unordered message rows.

A thread's reply graph has its messages as nodes. Where a ``parent`` column is given, a message answers the
message it names. Where none is given, an agent's message answers the nearest earlier one of the user, and
a user's the nearest earlier one of the agent (earlier: by moment, then speaker, then id); system messages
answer nothing. Kahn's algorithm releases messages whose parent is out, the earliest first: a reply counts
as no earlier than what it answers, so the place of a message is that of the latest message on its way to
the root, then its depth, then its own moment, speaker and id. Nodes left over lie on or behind a cycle: the
thread is broken and dropped. Then the speakers must alternate user, agent, ..., begin with user, end with
agent, and be at least two.

Threads of at most ``HOT`` rows are ordered by Kahn's algorithm inside tasks that read whole threads from a
sorted stream. A thread above it is never gathered: the latest message on the way to the root, the depth and
cycles are found by pointer doubling, and the same order is numbered over range-cut slices. Both give the
same rows (tested on random forests with ties, late parents and cycles).

Defined cases: rows with one id are one message, deleted if any row has ``deleted_at`` (of otherwise
differing rows the least is taken, column by column as one struct). Deleted messages and those with null or
white-space-only content are left out first; so is null ``thread_id``. A parent that is left out or lies in
another thread is none. A remaining message without moment or with an unreadable role drops its thread. Null
ids are one message each row. Equal moment and speaker: by id. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import positions
from ..operators.skew import skew_join
from ..session import cut

HOT = 20_000  # rows of a thread that one task may order
# How the speakers are spelled, in lower case and trimmed.
SPEAKERS = {"user": 1, "human": 1, "agent": 2, "assistant": 2, "bot": 2, "system": 0}
_BLANK = r"^[\s\p{Z}\x1c-\x1f\x{85}\x{180e}\x{200b}\x{2060}\x{feff}]*$"  # white space of any kind, and what has no width
COLUMNS = "thread_id string, pos int, message_id string, speaker int, moment long"


def moment(ts: Column) -> Column:
    """Epoch seconds, milliseconds, microseconds or nanoseconds, told by their size, as microseconds."""
    size = F.abs(ts)
    return F.when(size < 100_000_000_000, ts * 1_000_000).when(size < 100_000_000_000_000, ts * 1000).when(size < 100_000_000_000_000_000, ts).otherwise((ts / 1000).cast("long"))


def speaker(role: Column) -> Column:
    """0 system, 1 user, 2 agent; null if the role cannot be read."""
    name = F.lower(F.regexp_replace(role, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    out = F.lit(None).cast("int")
    for word, code in SPEAKERS.items():
        out = F.when(name == word, code).otherwise(out)
    return out


def live_messages(messages: DataFrame, parent: str | None = None) -> DataFrame:
    """One row per message that counts: key (never null), thread_id, id, moment, speaker (and parent)."""
    fields = [F.col("thread_id"), moment(F.col("ts")).alias("moment"), speaker(F.col("role")).alias("speaker"), (F.col("content").isNotNull() & ~F.col("content").rlike(_BLANK)).alias("said")]
    fields.append((F.col(parent).cast("string") if parent else F.lit(None).cast("string")).alias("parent"))
    slim = messages.select("id", F.struct(*fields).alias("row"), F.col("deleted_at").isNotNull().alias("gone"))
    # A null id names no other row: it gets a key of its own.
    slim = slim.withColumn("key", F.coalesce(F.concat(F.lit("="), "id"), F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))))
    one = slim.groupBy("key").agg(F.first("id").alias("id"), F.min("row").alias("row"), F.max("gone").alias("gone"))
    return one.where(~F.col("gone") & F.col("row.said") & F.col("row.thread_id").isNotNull()).select("key", "id", "row.thread_id", "row.moment", "row.speaker", "row.parent")


def answered(speakers: list, level: list[int]) -> list[int]:
    """For each message the one it answers, or -1: the nearest earlier message (in ``level``) of the other side."""
    out, last = [-1] * len(speakers), {1: -1, 2: -1}
    for i in level:
        side = int(speakers[i])
        if side:
            out[i] = last[3 - side]
            last[side] = i
    return out


def kahn(ids: list, moments: list, speakers: list, parents: list) -> list[int] | None:
    """The topological order of one reply graph, or None if nodes are left over (a cycle)."""
    n = len(ids)
    level = sorted(range(n), key=lambda i: (moments[i], speakers[i], ids[i] or "", parents[i] or ""))
    rank = [0] * n
    for r, i in enumerate(level):
        rank[i] = r
    if any(p is not None for p in parents):
        place = {m: i for i, m in enumerate(ids) if m is not None}
        above = [-1 if p is None else place.get(p, -1) for p in parents]
    else:
        above = answered(speakers, level)
    children: list[list[int]] = [[] for _ in range(n)]
    ready = []
    for i, p in enumerate(above):
        if p < 0:
            ready.append((rank[i], 0, rank[i], i))
        else:
            children[p].append(i)
    heapq.heapify(ready)
    order = []
    while ready:
        latest, depth, _, i = heapq.heappop(ready)
        order.append(i)
        for j in children[i]:
            heapq.heappush(ready, (max(latest, rank[j]), depth + 1, rank[j], j))
    return order if len(order) == n else None


def alternates(speakers: list[int]) -> bool:
    """user, agent, user, agent ..., at least two, system messages aside."""
    turns = [s for s in speakers if s]
    return len(turns) >= 2 and len(turns) % 2 == 0 and all(s == 1 + i % 2 for i, s in enumerate(turns))


def _order_threads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads rows sorted by thread; a thread cut by the end of a batch waits for the next one."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        last = batch["thread_id"].iat[-1]
        start = int(batch["thread_id"].searchsorted(last)) if len(batch) else 0
        rest = batch.iloc[start:]
        if start:
            yield _whole(batch.iloc[:start])
    if rest is not None and len(rest):
        yield _whole(rest)


def _whole(rows: pd.DataFrame) -> pd.DataFrame:
    threads, ids = rows["thread_id"].tolist(), rows["id"].tolist()
    moments, speakers, parents = rows["moment"].tolist(), rows["speaker"].tolist(), rows["parent"].tolist()
    out, at, n = [], 0, len(threads)
    while at < n:
        end = at
        while end < n and threads[end] == threads[at]:
            end += 1
        m, s = moments[at:end], speakers[at:end]
        if not any(x is None or x != x for x in m) and not any(x is None or x != x for x in s):
            order = kahn(ids[at:end], m, s, parents[at:end])
            if order is not None and alternates([int(s[i]) for i in order]):
                out += [(threads[at], k + 1, ids[at + i], int(s[i]), int(m[i])) for k, i in enumerate(order)]
        at = end
    return pd.DataFrame(out, columns=["thread_id", "pos", "message_id", "speaker", "moment"])


def _kept(numbered: DataFrame) -> DataFrame:
    """Drops threads whose speakers do not alternate, given each message's place among the turns."""
    bad = F.max(((F.col("speaker") > 0) & (F.col("speaker") != 2 - F.col("turn") % 2)).cast("int"))
    ok = numbered.groupBy("thread_id").agg(bad.alias("bad"), F.sum((F.col("speaker") > 0).cast("long")).alias("turns")).where("bad = 0 and turns >= 2 and turns % 2 = 0")
    return numbered.join(ok.select("thread_id"), "thread_id", "left_semi").select("thread_id", "pos", F.col("id").alias("message_id"), "speaker", "moment")


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """pos among all messages, turn among those of user and agent; no thread is gathered in one task."""
    placed = positions(rows, "thread_id", order)
    turns = positions(placed.where("speaker > 0"), "thread_id", ["pos"], "turn").select("thread_id", "pos", "turn")
    return placed.join(turns, ["thread_id", "pos"], "left")


def _deep_threads(rows: DataFrame, given: bool) -> DataFrame:
    """Threads too large for one task, in the order of ``kahn``."""
    bad = rows.where(F.col("moment").isNull() | F.col("speaker").isNull()).select("thread_id").distinct()
    rows = cut(rows.join(bad, "thread_id", "left_anti"))
    order = ["moment", "speaker", "id"]
    if given:
        # Pointer doubling: after k rounds ``up`` is the ancestor 2**k above, ``depth`` counts the steps to it and
        # ``latest`` is the latest message up to it. A message that still has one after as many rounds as its
        # thread's size allows lies on or behind a cycle.
        most = rows.groupBy("thread_id").count().agg(F.max("count")).first()[0] or 0
        own = F.struct("moment", "speaker", F.coalesce("id", F.lit("")).alias("id"), F.coalesce("parent", F.lit("")).alias("parent"))
        named = rows.where("id is not null").select("thread_id", F.col("id").alias("parent"), F.col("key").alias("up"))
        node = rows.withColumn("latest", own).join(named, ["thread_id", "parent"], "left")
        node = cut(node.select("key", "up", F.col("up").isNotNull().cast("long").alias("depth"), "latest"))
        for _ in range(max(1, most).bit_length()):
            above = node.select(F.col("key").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("latest").alias("latest2"))
            node = skew_join(node, above, "up", "left").select("key", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.greatest("latest", "latest2").alias("latest"))
            node = cut(node)
            if not node.where("up is not null").take(1):
                break
        rows = rows.join(node.select("key", "up", "depth", "latest"), "key")
        cyclic = rows.where(F.col("up").isNotNull()).select("thread_id").distinct()
        rows = rows.join(cyclic, "thread_id", "left_anti").withColumn("own", own)
        order = ["latest", "depth", "own"]
    return _kept(_numbered(rows, order))


def conversations(messages: DataFrame, parent: str | None = None, hot: int = HOT) -> DataFrame:
    """Every message of every kept conversation: thread_id, pos, message_id, speaker, moment."""
    live = live_messages(messages, parent)
    # Rows of a thread are at least as many as its messages; they are counted before anything is shuffled.
    large = cut(messages.groupBy("thread_id").count().where((F.col("count") > hot) & F.col("thread_id").isNotNull()).select("thread_id"))
    small, deep = live, None
    if large.take(1):
        small, deep = live.join(large, "thread_id", "left_anti"), live.join(large, "thread_id", "left_semi")
    out = small.repartition("thread_id").sortWithinPartitions("thread_id").mapInPandas(_order_threads, COLUMNS)
    return out if deep is None else out.unionByName(_deep_threads(deep, parent is not None))


def conversation_report(messages: DataFrame) -> DataFrame:
    """Why threads were kept or dropped: one row per outcome with threads and messages."""
    live = live_messages(messages)
    flags = live.groupBy("thread_id").agg(F.count("*").alias("messages"), F.max((F.col("moment").isNull() | F.col("speaker").isNull()).cast("int")).alias("unreadable"), F.sum((F.col("speaker") > 0).cast("long")).alias("turns"))
    kept = conversations(messages).select("thread_id").distinct().withColumn("kept", F.lit(True))
    outcome = F.when(F.col("kept"), "kept").when(F.col("unreadable") == 1, "unreadable").when(F.col("turns") < 2, "no_reply").otherwise("broken")
    return flags.join(kept, "thread_id", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("threads"), F.sum("messages").alias("messages"))
