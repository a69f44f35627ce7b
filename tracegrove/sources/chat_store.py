"""Threads and messages of chats, written to Parquet folders.

Both tables only ever grow: a change of a thread is a further row of its id, and the row with the greatest
``updated_at`` counts (of equal ones that with a ``deleted_at``). Writers therefore never wait for readers, and
many may append at once. Only a hard deletion writes a table anew. Times are epoch milliseconds.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import current_rows

THREADS = "id string, title string, project_path string, created_at long, updated_at long, pinned_context string, summary string, deleted_at long"
MESSAGES = "id string, thread_id string, role string, content string, ts long, evidence_json string, deleted_at long"
ROLES = ("user", "agent", "system")
CLONED = 1000  # messages of a thread that a copy takes over


def _now() -> int:
    return int(time.time() * 1000)


def latest(threads: DataFrame) -> DataFrame:
    """The row of each thread that counts."""
    fields = [f.split()[0] for f in THREADS.split(", ")][1:]
    return current_rows(threads.where("id is not null"), "id", [F.col("updated_at"), F.col("deleted_at")], fields)


class ChatStore:
    """The chat tables under ``folder``; it is made on the first write."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # -- reading
    def _table(self, name: str, shape: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(f"{self.folder}/{name}")

    def threads(self) -> DataFrame:
        """Threads that are not deleted."""
        return latest(self._table("threads", THREADS)).where("deleted_at is null")

    def messages(self) -> DataFrame:
        return self._table("messages", MESSAGES)

    def get_thread(self, thread_id: str) -> DataFrame:
        return latest(self._table("threads", THREADS).where(F.col("id") == thread_id)).where("deleted_at is null")

    def list_threads(self, project_path: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        """Newest first; with a project also those of none."""
        return self._of(project_path, True).orderBy(F.desc("updated_at"), "id").offset(offset).limit(limit)

    def count_threads(self, project_path: str | None = None) -> int:
        return self._of(project_path, False).count()

    def _of(self, project_path: str | None, also_without: bool) -> DataFrame:
        rows = self.threads()
        if project_path:
            own = F.col("project_path") == project_path
            rows = rows.where(own | F.col("project_path").isNull() if also_without else own)
        return rows

    def list_messages(self, thread_id: str, limit: int = 200, offset: int = 0, include_deleted: bool = False) -> DataFrame:
        """In the order of time, ties by id, with the evidence read (null where it is none)."""
        rows = self._messages_of(thread_id, include_deleted).withColumn("evidence", F.from_json("evidence_json", "array<map<string,string>>"))
        return rows.orderBy("ts", "id").offset(offset).limit(limit)

    def count_messages(self, thread_id: str, include_deleted: bool = False) -> int:
        return self._messages_of(thread_id, include_deleted).count()

    def _messages_of(self, thread_id: str, include_deleted: bool) -> DataFrame:
        rows = self.messages().where(F.col("thread_id") == thread_id)
        return rows if include_deleted else rows.where("deleted_at is null")

    # -- writing
    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/{name}")

    def create_thread(self, title: str, project_path: str | None = None) -> str:
        thread_id, now = str(uuid.uuid4()), _now()
        self._append("threads", self.spark.createDataFrame([(thread_id, title, project_path, now, now, None, None, None)], THREADS))
        return thread_id

    def update_thread(self, thread_id: str, **fields: str | None) -> bool:
        """Sets title, project_path, pinned_context or summary; whether there was such a thread."""
        unknown = set(fields) - {"title", "project_path", "pinned_context", "summary"}
        if unknown:
            raise ValueError(f"no such fields: {sorted(unknown)}")
        return bool(fields) and self._touch(self.spark.createDataFrame([(thread_id, _now())], "id string, at long"), **fields)

    def _touch(self, changes: DataFrame, **fields: str | None) -> bool:
        """A further row of each thread in ``changes`` (id, at): updated at ``at`` or later, with the given fields."""
        own = latest(self._table("threads", THREADS).join(changes.select("id"), "id", "left_semi")).join(changes, "id")
        rows = own.withColumn("updated_at", F.greatest(F.col("updated_at") + 1, "at")).withColumns({k: F.lit(v).cast("string") for k, v in fields.items()})
        rows = self.spark.createDataFrame(rows.select(*[f.split()[0] for f in THREADS.split(", ")]).collect(), THREADS)
        if not rows.take(1):
            return False
        self._append("threads", rows)
        return True

    def delete_thread(self, thread_id: str, hard: bool = False) -> bool:
        """Marks the thread as deleted, or takes all its rows away; its messages stay either way."""
        rows = self._table("threads", THREADS)
        own = latest(rows.where(F.col("id") == thread_id)).collect()
        if not own:
            return False
        if hard:
            self._rewrite("threads", rows.where(~F.col("id").eqNullSafe(F.lit(thread_id))))
        else:
            self._append("threads", self.spark.createDataFrame([(*own[0][:-1], _now())], THREADS))
        return True

    def _rewrite(self, name: str, rows: DataFrame) -> None:
        """The table written beside itself and put in its place."""
        new, old = f"{self.folder}/{name}-{uuid.uuid4().hex}", f"{self.folder}/{name}"
        rows.write.parquet(new)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(old).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(path(old), True)
        fs.rename(path(new), path(old))

    def append_message(self, thread_id: str, role: str, content: str, evidence: list[dict] | None = None) -> str:
        return self.append_messages(thread_id, [{"role": role, "content": content, "evidence": evidence}])[0]

    def append_messages(self, thread_id: str, messages: list[dict]) -> list[str]:
        """Messages with role and content (and ts, evidence); the thread is updated at the latest of them or now."""
        now, rows = _now(), []
        for m in messages:
            if m["role"] not in ROLES:
                raise ValueError(f"role must be one of {ROLES}")
            evidence = m.get("evidence")
            rows.append((str(uuid.uuid4()), thread_id, m["role"], m["content"], int(m.get("ts") or now), json.dumps(evidence) if evidence else None, None))
        if rows:
            self._append("messages", self.spark.createDataFrame(rows, MESSAGES))
            self._touch(self.spark.createDataFrame([(thread_id, max(now, *[r[4] for r in rows]))], "id string, at long"))
        return [r[0] for r in rows]

    def append_frame(self, messages: DataFrame) -> None:
        """Many messages of many threads (columns of the table) at once; every thread is updated at its latest."""
        rows = messages.select(*[f.split()[0] for f in MESSAGES.split(", ")])
        last = rows.where("thread_id is not null").groupBy(F.col("thread_id").alias("id")).agg(F.max("ts").alias("at"))
        own = latest(self._table("threads", THREADS)).join(last, "id").withColumn("updated_at", F.greatest("updated_at", F.coalesce("at", "updated_at")))
        changed = own.select(*[f.split()[0] for f in THREADS.split(", ")])
        self._append("messages", rows)
        self._append("threads", changed)

    def clone_thread(self, thread_id: str) -> str | None:
        """A copy of the thread with its first ``CLONED`` messages, called ``(copy)``; None if there is no such thread."""
        own = self.get_thread(thread_id).collect()
        if not own:
            return None
        new = self.create_thread(f"{own[0]['title']} (copy)", own[0]["project_path"])
        rows = self.list_messages(thread_id, CLONED).select(F.expr("uuid()").alias("id"), F.lit(new).alias("thread_id"), "role", "content", "ts", "evidence_json", F.lit(None).cast("long").alias("deleted_at"))
        self._append("messages", rows)
        return new
