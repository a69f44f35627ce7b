"""The graph, the files and the chats as they stand now, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators.relational import current_rows
from ..sources.tables import spread, table


def nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Living nodes: the current row of each id (greatest ``node_seq``), unless it is removed."""
    wanted = [c for c in (columns or ("name", "node_type", "file_path", "relative_path", "line_start", "line_end", "docstring")) if c != "id"]
    now = current_rows(table(spark, d, "nodes").where("id is not null"), "id", [F.col("node_seq")], list(dict.fromkeys([*wanted, "node_seq", "removed_at"])))
    return now.where("removed_at is null").select("id", *wanted)


def all_edges(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """Every edge once (some rows are sent twice in full), with ``extra`` columns of one of its rows."""
    rows = table(spark, d, "edges").where("edge_seq is not null")
    best = F.min(F.struct("src", "dst", "edge_type", "weight")).alias("row")
    return rows.groupBy("edge_seq").agg(best, *[F.first(c, True).alias(c) for c in extra]).select("edge_seq", "row.*", *extra)


def edges(spark: SparkSession, d: str, *types: str) -> DataFrame:
    """Edges between living nodes, of the given types or of all."""
    ids = nodes(spark, d, "node_seq").select("id")
    rows = all_edges(spark, d)
    if types:
        rows = rows.where(F.col("edge_type").isin(*types))
    return rows.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def file_facts(spark: SparkSession, d: str, using: dict[str, Column] | None = None, **facts: Column) -> DataFrame:
    """The named expressions (which may build on those of ``using``) over the current row of each ``relative_path``: greatest ``mtime``, then greatest MD5 of the content.

    They are computed where the file is read, so the shuffle carries facts and no text.
    """
    rows = spread(table(spark, d, "files").where("relative_path is not null"))
    rows = rows.withColumns(using) if using else rows
    seen = rows.select("relative_path", F.col("mtime").alias("_at"), F.md5("content").alias("_hash"), *[c.alias(n) for n, c in facts.items()])
    return current_rows(seen, "relative_path", [F.col("_at"), F.col("_hash")], list(facts))


def file_rows(spark: SparkSession, d: str, helper: Callable[[str, str], list[tuple]], shape: str, *extensions: str) -> DataFrame:
    """``relative_path`` and the rows (of struct type ``shape``) that ``helper(path, text)`` reads from each current file.

    The helper runs in Arrow batches in the scan's task; the shuffle carries its rows, one array per file.
    """
    rows = table(spark, d, "files").where("relative_path is not null")
    if extensions:
        rows = rows.withColumn("content", F.when(T.extension(F.col("relative_path")).isin(*extensions), F.col("content")))
    names = [f.name for f in StructType.fromDDL(shape)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[dict(zip(names, row)) for row in helper(p, t)] if t else [] for p, t in zip(batch["relative_path"], batch["content"])]
            yield batch[["relative_path", "mtime", "_hash"]].assign(found=found)

    seen = spread(rows).select("relative_path", "mtime", F.md5("content").alias("_hash"), "content")
    seen = seen.mapInPandas(run, f"relative_path string, mtime double, _hash string, found array<struct<{shape}>>")
    return current_rows(seen, "relative_path", [F.col("mtime"), F.col("_hash")], ["found"]).select("relative_path", F.explode("found").alias("row")).select("relative_path", "row.*")


def files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Narrow columns of the current row of each ``relative_path``; what is read from the text belongs into ``file_facts``."""
    return file_facts(spark, d, **{c: F.col(c) for c in columns or ("mtime",)})


def functions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return nodes(spark, d, *dict.fromkeys(["node_type", *columns])).where("node_type in ('function', 'method')")


SQL = """
cn as (select * exclude (rn) from (select *, row_number() over (partition by id order by node_seq desc) rn from nodes where id is not null) where rn = 1 and removed_at is null),
ae as (select edge_seq, min(src) src, min(dst) dst, min(edge_type) edge_type, min(weight) weight from edges where edge_seq is not null group by edge_seq),
le as (select ae.* from ae where src in (select id from cn) and dst in (select id from cn)),
cf as (select * exclude (rn) from (select *, row_number() over (partition by relative_path order by mtime desc nulls last, md5(content) desc nulls last) rn from files where relative_path is not null) where rn = 1)
"""


def sql(text: str) -> str:
    """A query over cn (living nodes), ae (all edges), le (live edges) and cf (current files)."""
    return f"with recursive {SQL.strip()}{text}" if text.startswith(",") else f"with recursive {SQL} {text}"
