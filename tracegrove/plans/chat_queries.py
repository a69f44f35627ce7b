"""The chat store: threads and messages, soft deletion, counts, copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.orphans import moment
from ..operators.relational import current_rows
from ..sources.tables import table

PROJECT = "/srv/scan/b/brisk-harvest"  # the project whose chats are listed


def all_threads(spark, d):
    fields = ["title", "project_path", "created_at", "updated_at", "pinned_context", "summary", "deleted_at"]
    return current_rows(table(spark, d, "chat_threads").where("id is not null"), "id", [F.col("updated_at"), F.col("deleted_at")], fields)


def threads(spark, d):
    return all_threads(spark, d).where("deleted_at is null")


def messages(spark, d):
    """One row per message id; deleted if any of its rows is."""
    row = F.min(F.struct("thread_id", "role", "content", "ts")).alias("row")
    return table(spark, d, "chat_messages").where("id is not null").groupBy("id").agg(row, F.max("deleted_at").alias("deleted_at")).select("id", "row.*", "deleted_at")


def chat_list_threads(spark, d):
    """Second page of ten of the threads without or of one project, newest first."""
    page = threads(spark, d).where("project_path is null or project_path = '{}'".format(PROJECT)).orderBy(F.desc("updated_at"), "id")
    return page.offset(10).limit(10).select("id", "title", "updated_at")


def chat_counts(spark, d):
    """Threads and messages, alive and deleted."""
    a = all_threads(spark, d).agg(F.count("*").alias("n"), F.count("deleted_at").alias("gone")).select(F.lit("threads").alias("what"), "n", "gone")
    b = messages(spark, d).agg(F.count("*").alias("n"), F.count("deleted_at").alias("gone")).select(F.lit("messages").alias("what"), "n", "gone")
    return a.unionByName(b)


def chat_thread_updated_max(spark, d):
    """updated_at as appending the messages would leave it: the greatest moment, in milliseconds."""
    last = messages(spark, d).where("deleted_at is null and thread_id is not null").groupBy(F.col("thread_id").alias("id")).agg(F.max(F.floor(moment(F.col("ts")) / 1000)).alias("last_ts"), F.count("*").alias("n"))
    return threads(spark, d).join(last, "id").select("id", F.greatest("updated_at", F.coalesce("last_ts", F.col("updated_at"))).alias("updated_at"), "n")


def chat_list_messages(spark, d):
    """Messages of the threads of one project in order, ties by id."""
    mine = threads(spark, d).where("project_path = '{}'".format(PROJECT)).select(F.col("id").alias("thread_id"))
    rows = messages(spark, d).where("deleted_at is null").join(mine, "thread_id", "left_semi")
    return rows.select("thread_id", "id", moment(F.col("ts")).alias("moment"), F.lower("role").alias("role"))


def chat_clone(spark, d):
    """Copies of the threads that have a summary, with at most a thousand messages each."""
    from pyspark.sql import Window

    mine = threads(spark, d).where("summary is not null").select(F.col("id").alias("thread_id"), F.concat("title", F.lit(" (copy)")).alias("title"))
    rows = messages(spark, d).where("deleted_at is null").join(mine, "thread_id")
    n = F.row_number().over(Window.partitionBy("thread_id").orderBy(moment(F.col("ts")), "id"))
    return rows.withColumn("n", n).where("n <= 1000").groupBy(F.concat(F.lit("copy-"), "thread_id").alias("id"), "title").agg(F.count("*").alias("messages"))


def chat_soft_delete(spark, d):
    """What is left of the threads per project after deleting those without messages; messages stay."""
    used = messages(spark, d).where("deleted_at is null").select(F.col("thread_id").alias("id")).distinct()
    empty = threads(spark, d).join(used, "id", "left_anti").select("id")
    return threads(spark, d).join(empty, "id", "left_anti").groupBy("project_path").agg(F.count("*").alias("threads"))


def chat_scope_context(spark, d):
    """Threads by scope: with project, with pinned context, with summary."""
    return threads(spark, d).groupBy(F.col("project_path").isNotNull().alias("scoped"), F.col("pinned_context").isNotNull().alias("pinned"), F.col("summary").isNotNull().alias("summarised")).agg(F.count("*").alias("n"))


def chat_evidence(spark, d):
    """Records named in the evidence, with the number of readable rows; cut-off JSON counts as unreadable."""
    rows = table(spark, d, "chat_messages").where("evidence_json is not null").select("id", "evidence_json").distinct()
    parsed = rows.select(F.from_json("evidence_json", "array<struct<id string, line int>>", {"mode": "PERMISSIVE"}).alias("e"))
    ok = F.col("e").isNotNull() & F.exists(F.coalesce("e", F.array()), lambda x: x["id"].isNotNull())
    return parsed.groupBy(F.coalesce(ok, F.lit(False)).alias("readable")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (chat_list_threads, chat_counts, chat_thread_updated_max, chat_list_messages, chat_clone, chat_soft_delete, chat_scope_context, chat_evidence)}

_T = """with at as materialized (select * from (select *, row_number() over (partition by id order by updated_at desc, deleted_at desc nulls last) rn from chat_threads where id is not null) where rn = 1),
th as (select * from at where deleted_at is null),
ms as (select id, min(thread_id) thread_id, min(role) as role, min(content) as content, min(ts) ts, max(deleted_at) deleted_at from chat_messages where id is not null group by id)""".replace("with at as", "with alt as").replace("from at where", "from alt where")
_M = "case when abs(ts) < 100000000000 then ts * 1000000 when abs(ts) < 100000000000000 then ts * 1000 else ts end"

ORACLES = {
    "chat_list_threads": f"{_T} select id, title, updated_at from th where project_path is null or project_path = '{PROJECT}' order by updated_at desc, id limit 10 offset 10",
    "chat_counts": f"{_T} select 'threads' as what, count(*) n, count(deleted_at) gone from alt union all select 'messages', count(*), count(deleted_at) from ms",
    "chat_thread_updated_max": f"{_T}, l as (select thread_id, max({_M} // 1000) last_ts, count(*) n from ms where deleted_at is null and thread_id is not null group by 1) select id, greatest(updated_at, coalesce(last_ts, updated_at)) updated_at, n from th join l on l.thread_id = th.id",
    "chat_list_messages": f"{_T} select thread_id, id, {_M} as moment, lower(role) as role from ms where deleted_at is null and thread_id in (select id from th where project_path = '{PROJECT}')",
    "chat_clone": f"{_T} select 'copy-' || thread_id as id, title || ' (copy)' as title, least(count(*), 1000) messages from ms join (select id as tid, title from th where summary is not null) t on t.tid = ms.thread_id where deleted_at is null group by 1, 2",
    "chat_soft_delete": f"{_T} select project_path, count(*) threads from th where id in (select thread_id from ms where deleted_at is null and thread_id is not null) group by 1",
    "chat_evidence": "select readable, count(*) n from (select case when json_valid(evidence_json) then len(list_filter(json_extract_string(evidence_json, '$[*].id'), lambda x: x is not null)) > 0 else false end as readable from (select distinct id, evidence_json from chat_messages where evidence_json is not null)) group by 1",
    "chat_scope_context": f"{_T} select project_path is not null as scoped, pinned_context is not null as pinned, summary is not null as summarised, count(*) n from th group by 1, 2, 3",
}
