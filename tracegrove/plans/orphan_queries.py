"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import orphans
from ..sources.tables import table


def _tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in ("edges", "nodes", "chat_messages", "chat_threads")]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The direct orphans of the whole cascade; inherited ones are no cases."""
    return orphans.cascade(*_tables(spark, d)).where("kind = 'direct'").select("ref_table", "ref_key", "ref_field")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(orphans.cascade(*_tables(spark, d)))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}

_DIRECT = """
nk as (select id as key, arg_max(removed_at is not null, node_seq) removed, epoch_us(min(loaded_at)) since from nodes where id is not null group by id),
tk as (select id as key, arg_max(deleted_at is not null, updated_at) removed,
         min(case when abs(created_at) < 100000000000 then created_at * 1000000 when abs(created_at) < 100000000000000 then created_at * 1000 else created_at end) since
       from chat_threads where id is not null group by id),
ends as (
  select distinct 'edges' ref_table, cast(edge_seq as varchar) ref_key, 'src' ref_field, src as key, epoch_us(loaded_at) "at" from edges where src is not null
  union all select distinct 'edges', cast(edge_seq as varchar), 'dst', dst, epoch_us(loaded_at) from edges where dst is not null),
talk as (
  select 'chat_messages' ref_table, id ref_key, 'thread_id' ref_field, min(thread_id) as key,
    min(case when abs(ts) < 100000000000 then ts * 1000000 when abs(ts) < 100000000000000 then ts * 1000 else ts end) "at"
  from chat_messages where id is not null group by id having max(deleted_at) is null and min(thread_id) is not null),
direct as (
  select e.*, case when k.key is null then 'missing' when k.removed then 'removed' else 'late' end cause
  from ends e left join nk k on e.key = k.key where k.key is null or k.removed or k.since > e."at"
  union all
  select e.*, case when k.key is null then 'missing' when k.removed then 'removed' else 'late' end cause
  from talk e left join tk k on e.key = k.key where k.key is null or k.removed or k.since > e."at")
"""

_FELL = """
living as (select id, node_type, file_path from (select *, row_number() over (partition by id order by node_seq desc) rn from nodes where id is not null) where rn = 1 and removed_at is null),
lk as materialized (
  select id as key, 'file::' || file_path as parent, 'file' as kind from living where node_type <> 'file' and file_path is not null
  union all select distinct dst, src, 'holder' from edges where edge_type = 'contains' and src is not null and dst is not null and src <> dst and dst in (select id from living)),
hl as (select key, count(*) n from lk where kind = 'holder' group by 1),
dead as materialized (select distinct parent from lk where parent not in (select id from living)),
fell(key, round) using key (key) as (
  select lk.key, 1 from lk left join hl on hl.key = lk.key where parent in (select parent from dead) group by lk.key having bool_or(kind = 'file') or count(*) >= max(coalesce(hl.n, 0))
  union select lk.key, (select max(round) from fell) + 1 from lk left join hl on hl.key = lk.key
    where lk.key in (select l2.key from lk l2 join fell on fell.key = l2.parent) and lk.key not in (select key from recurring.fell)
      and (parent in (select parent from dead) or parent in (select key from recurring.fell))
    group by lk.key having bool_or(kind = 'file') or sum((kind = 'holder')::int) >= max(coalesce(hl.n, 0))),
own as (select ref_table, ref_key, ref_field, min(key) as key, min("at") as "at" from ends group by 1, 2, 3),
every as (
  select ref_table, ref_key, ref_field, min("at") as "at", 'direct' as kind, min(cause) as cause from direct group by 1, 2, 3
  union all select ref_table, ref_key, ref_field, "at", 'inherited', 'parent' from own where key in (select key from fell) and (ref_key, ref_field) not in (select (ref_key, ref_field) from direct where ref_table = 'edges'))
"""

ORACLES = {
    "p5_report": f"with recursive {_DIRECT}, {_FELL} select ref_table, ref_field, strftime(make_timestamp(\"at\"), '%Y-%m') as period, kind, cause, count(*) as orphans from every group by 1, 2, 3, 4, 5",
    "p5_found": f"with {_DIRECT} select ref_table, ref_key, ref_field from direct",
}
