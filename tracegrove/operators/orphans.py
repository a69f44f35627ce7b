"""Problem 5: references to records that do not exist, are removed, or came later.

A reference is a non-null key, compared exactly. It is a direct orphan if (a) no row has the key, (b) the
key's current row is removed, or (c) the key's earliest row is later than the reference.

Cascade: the children of an orphan are inherited orphans. ``cascade`` begins with the parents that do not live (round 0)
and goes down the foreign-key graph in rounds of semi-joins against the keys that fell in the round before, until no
key falls: a node whose file's node is missing or removed falls, nodes that are held (``contains``) only by fallen
nodes fall, and edges that refer to fallen nodes are inherited orphans. Threads have no parent in these tables, so
messages are direct orphans only.

Each join is a key against one row per key; hot keys on the referring side are spread over tasks
(``skew_join``). Null keys are no references; repeated rows of a reference count once; tables may be empty.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept, scratch_path
from .skew import skew_join


def moment(ts: Column) -> Column:
    """Epoch seconds, milliseconds, microseconds or nanoseconds, told by their size, as microseconds."""
    size = F.abs(ts)
    return F.when(size < 100_000_000_000, ts * 1_000_000).when(size < 100_000_000_000_000, ts * 1000).when(size < 100_000_000_000_000_000, ts).otherwise((ts / 1000).cast("long"))


def node_keys(nodes: DataFrame) -> DataFrame:
    """One row per node id: whether its current row (greatest ``node_seq``) is removed, and when its earliest row came."""
    return nodes.where("id is not null").groupBy(F.col("id").alias("key")).agg(
        F.max_by(F.col("removed_at").isNotNull(), "node_seq").alias("removed"), F.unix_micros(F.min("loaded_at").cast("timestamp")).alias("since")
    )


def thread_keys(threads: DataFrame) -> DataFrame:
    """One row per thread id: whether its current row (greatest ``updated_at``) is deleted, and when its earliest row was created."""
    return threads.where("id is not null").groupBy(F.col("id").alias("key")).agg(
        F.max_by(F.col("deleted_at").isNotNull(), F.struct(F.col("updated_at"), F.col("deleted_at"))).alias("removed"), F.min(moment(F.col("created_at"))).alias("since")
    )


def edge_references(edges: DataFrame) -> DataFrame:
    """ref_table, ref_key, ref_field, key, at: both ends of every edge, each once."""
    one = edges.where("edge_seq is not null").select(F.col("edge_seq").cast("string").alias("ref_key"), "src", "dst", F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("at"))
    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("ref_field"), F.col(c).alias("key")) for c in ("src", "dst")])).alias("end")
    return one.select(F.lit("edges").alias("ref_table"), "ref_key", ends, "at").select("ref_table", "ref_key", "end.ref_field", "end.key", "at").where("key is not null")


def message_references(messages: DataFrame) -> DataFrame:
    """The thread of every message that is not deleted; rows with one id are one message."""
    one = messages.where("id is not null").groupBy(F.col("id").alias("ref_key")).agg(
        F.min(F.struct("thread_id", moment(F.col("ts")).alias("at"))).alias("row"), F.max(F.col("deleted_at").isNotNull()).alias("gone")
    )
    return one.where("not gone and row.thread_id is not null").select(F.lit("chat_messages").alias("ref_table"), "ref_key", F.lit("thread_id").alias("ref_field"), F.col("row.thread_id").alias("key"), F.col("row.at").alias("at"))


def orphans_of(references: DataFrame, keys: DataFrame) -> DataFrame:
    """References without a living row at their time, with the cause: missing, removed or late; else ``parent`` if ``keys`` has a column ``fell`` that says so."""
    joined = skew_join(references, keys.withColumn("known", F.lit(True)), "key", "left")
    cause = F.when(F.col("known").isNull(), "missing").when(F.col("removed"), "removed").when(F.col("since") > F.col("at"), "late")
    cause = cause.when(F.col("fell"), "parent") if "fell" in keys.columns else cause
    return joined.withColumn("cause", cause).where(F.col("cause").isNotNull()).select(*references.columns, "cause")


def _orphans(edges: DataFrame, keys: DataFrame, messages: DataFrame, threads: DataFrame) -> DataFrame:
    """Orphans of both tables; a row sent again counts once. Of one key ``parent`` meets ``late`` alone, which comes first."""
    ends = orphans_of(edge_references(edges), keys)
    ends = ends.groupBy("ref_table", "ref_key", "ref_field", "key").agg(F.min("at").alias("at"), F.min("cause").alias("cause"))
    return ends.unionByName(orphans_of(message_references(messages), thread_keys(threads)))


def direct_orphans(edges: DataFrame, nodes: DataFrame, messages: DataFrame, threads: DataFrame) -> DataFrame:
    """All direct orphans: ref_table, ref_key, ref_field, key, at, cause; a row sent again counts once."""
    return _orphans(edges, node_keys(nodes), messages, threads)


def fallen_nodes(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Living nodes that inherit orphanhood: key and round. Semi-joins down the parents until nothing falls.

    A node's parent is the node of its file (``file::`` + file_path, for nodes that are no file), and each
    node that contains it. It falls in the round after one in which its file fell or all that contain it fell.
    With ``rounds`` it raises if nodes still fall in the last of them.
    """
    parent = F.when(F.col("node_type") != "file", F.concat(F.lit("file::"), "file_path")).alias("parent")
    current = nodes.where("id is not null").groupBy(F.col("id").alias("key")).agg(F.max_by(F.struct(parent, F.col("removed_at").isNotNull().alias("removed")), "node_seq").alias("row"))
    living = kept(current.where("not row.removed").select("key", "row.parent"))
    alive = living.select("key")
    held = edges.where("edge_type = 'contains' and src is not null and dst is not null and src <> dst").select(F.col("dst").alias("key"), F.col("src").alias("parent")).join(alive, "key", "left_semi").distinct()
    # A link to the file lets a node fall by itself (0); links to holders only if there are as many lost ones as holders.
    links = kept(living.where("parent is not null").withColumn("holders", F.lit(0).cast("long")).unionByName(held.withColumn("holders", F.count("*").over(Window.partitionBy("key")))))
    lost, fallen = (scratch_path(nodes.sparkSession, name) for name in ("lost", "fallen"))
    down = None
    hits = links.join(alive.withColumnRenamed("key", "parent"), "parent", "left_anti")  # parents without a living row
    for number in count(1) if rounds is None else range(1, rounds + 1):
        hits = kept(hits.select("key", "holders"), lost)
        falling = hits.groupBy("key").agg(F.count("*").alias("lost"), F.min("holders").alias("holders")).where("lost >= holders").select("key")
        falling = falling if down is None else falling.join(down, "key", "left_anti")
        down = kept(falling.select("key", F.lit(number).alias("round")), fallen)
        fresh = down.where(F.col("round") == number).select(F.col("key").alias("parent"))
        if not fresh.take(1):
            return down
        hits = links.join(fresh, "parent", "left_semi")
    raise RuntimeError(f"nodes still fell in the last of {rounds} rounds")


def cascade(edges: DataFrame, nodes: DataFrame, messages: DataFrame, threads: DataFrame) -> DataFrame:
    """Direct and inherited orphans: ref_table, ref_key, ref_field, at, kind, cause. It runs to its fixpoint.

    One join of the references with the state of their keys, fallen ones included, tells both kinds. A reference
    with a direct cause is no inherited orphan; where rows of one reference differ, its least key counts.
    """
    fell = fallen_nodes(nodes, edges).select("key", F.lit(True).alias("fell"))
    found = kept(_orphans(edges, node_keys(nodes).join(fell, "key", "left"), messages, threads))
    direct = found.where("cause <> 'parent'")
    ref = ["ref_table", "ref_key", "ref_field"]
    heirs = found.where("cause = 'parent'").select(*ref, "key").join(direct.select(*ref), ref, "left_anti")
    own = edge_references(edges).join(heirs.select(*ref).distinct(), ref, "left_semi").groupBy(*ref).agg(F.min("key").alias("key"), F.min("at").alias("at"))
    inherited = own.join(heirs, [*ref, "key"], "left_semi").withColumn("cause", F.lit("parent"))
    fields = [*ref, "at", "kind", "cause"]
    return direct.withColumn("kind", F.lit("direct")).select(*fields).unionByName(inherited.withColumn("kind", F.lit("inherited")).select(*fields))


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, field, month, kind and cause; period null where the reference has no moment."""
    period = F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("period")
    return found.groupBy("ref_table", "ref_field", period, "kind", "cause").agg(F.count("*").alias("orphans"))
