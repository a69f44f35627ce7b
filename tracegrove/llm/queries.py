"""The queries of the training-data problems, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import spread, table
from . import conversations, invalid_sources, islands, layout, packing, reading_level, tokens


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "chat_messages")).select("thread_id", "pos", "message_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversation_report(table(spark, d, "chat_messages"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return invalid_sources.invalid_files(spread(table(spark, d, "files")))


def p2_failures(spark: SparkSession, d: str) -> DataFrame:
    return invalid_sources.check_files(spread(table(spark, d, "files"))).where("invalid")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return invalid_sources.invalid_rates(spread(table(spark, d, "files")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return islands.documented(table(spark, d, "nodes"), spread(table(spark, d, "files"))).select("id")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return islands.pairs(table(spark, d, "nodes"), spread(table(spark, d, "files")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return layout.not_hand_written(spread(table(spark, d, "files")), table(spark, d, "upstream_files"))


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    return layout.reason_counts(spread(table(spark, d, "files")), table(spark, d, "upstream_files"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(spread(table(spark, d, "documents")), ["doc_id"])


def p6_counts_by_source(spark: SparkSession, d: str) -> DataFrame:
    return tokens.counts_by(spread(table(spark, d, "documents")), "source")


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(spread(table(spark, d, "documents")), table(spark, d, "containers"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(spread(table(spark, d, "documents")), table(spark, d, "containers"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.reading_levels(spread(table(spark, d, "documents")), table(spark, d, "level_samples")).where("level is not null").select("doc_id", "level")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.level_profile(spread(table(spark, d, "documents")), table(spark, d, "level_samples"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_failures, p2_rates, p3_found, p3_pairs, p4_found, p4_reasons, p6_ids, p6_counts_by_source, p7_packing, p7_report, p8_found, p8_profile)}

_LIVE = """
one as (
  select id, min(thread_id) thread_id, min(ts) ts, min(role) role, min(content) content, max(deleted_at) deleted_at
  from chat_messages group by id),
live as (
  select id, thread_id,
    case when abs(ts) < 100000000000 then ts * 1000000 when abs(ts) < 100000000000000 then ts * 1000
         when abs(ts) < 100000000000000000 then ts else ts // 1000 end as moment,
    case when lower(regexp_replace(role, '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g')) = 'system' then 0
         when lower(regexp_replace(role, '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g')) in ('user', 'human') then 1
         when lower(regexp_replace(role, '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g')) in ('agent', 'assistant', 'bot') then 2 end as speaker
  from one
  where deleted_at is null and thread_id is not null and content is not null
    and not regexp_full_match(content, '[\\s\\v\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}]*')),
placed as (
  select *, row_number() over (partition by thread_id order by moment, speaker, id) pos from live),
turns as (
  select thread_id, speaker, row_number() over (partition by thread_id order by pos) turn from placed where speaker > 0),
unread as (select thread_id from live where moment is null or speaker is null),
kept as (
  select thread_id from turns group by thread_id
  having count(*) >= 2 and count(*) % 2 = 0 and max(case when speaker <> 2 - turn % 2 then 1 else 0 end) = 0)
"""

ORACLES = {
    "p1_found": f"with {_LIVE} select thread_id, cast(pos as integer) pos, id as message_id from placed where thread_id in (select thread_id from kept) and thread_id not in (select thread_id from unread)",
    "p1_report": f"""with {_LIVE},
        per as (select thread_id, count(*) messages, max(case when moment is null or speaker is null then 1 else 0 end) unreadable, sum(case when speaker > 0 then 1 else 0 end) turns from live group by thread_id)
        select case when p.thread_id in (select thread_id from kept) and unreadable = 0 then 'kept' when unreadable = 1 then 'unreadable' when coalesce(turns, 0) < 2 then 'no_reply' else 'broken' end as outcome,
          count(*) as threads, cast(sum(messages) as bigint) as messages from per p group by 1""",
}
