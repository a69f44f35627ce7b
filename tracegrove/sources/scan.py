"""Scanning a source tree, snapshots of the graph, and reading spans of files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# What is never scanned.
IGNORED = [".git/", ".venv/", "venv/", "__pycache__/", "node_modules/", ".idea/", ".vscode/", ".cache/", ".lancedb/", "*.pyc", "*.min.js", "*.map", "dist/", "build/"]
IGNORE_FILES = [".gitignore"]  # read at the root of a tree


def _glob(rule: str) -> str:
    """A glob as a regular expression: ``**`` spans folders, ``*`` and ``?`` do not."""
    out, at = "", 0
    while at < len(rule):
        c = rule[at]
        if rule.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif rule.startswith("**", at):
            out, at = out + ".*", at + 2
        elif c == "[" and (end := rule.find("]", at + 2)) > 0:
            body = rule[at + 1 : end]
            out, at = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        else:
            out, at = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), at + 1
    return out


def ignore_rules(patterns: list[str]) -> list[tuple[bool, str]]:
    """Ignore-file lines as (keep, regular expression over a file's relative path); the last rule that matches decides.

    A rule with a slash at its end matches folders only, one with a slash elsewhere is bound to the root.
    """
    out = []
    for line in patterns:
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        keep = rule.startswith("!")
        rule = rule[1:] if keep else rule
        folder = rule.endswith("/")
        anchored = "/" in rule.rstrip("/")
        out.append((keep, ("^" if anchored else "(?:^|/)") + _glob(rule.strip("/")) + ("/" if folder else "(?:/|$)")))
    return out


def read_ignore_rules(spark: SparkSession, root: str) -> list[str]:
    """Lines of the ignore files at the root of a tree; a missing file has none."""
    out = []
    for name in IGNORE_FILES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):  # Spark's readers pass over names that begin with a dot
            stream = fs.open(path)
            out += spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
            stream.close()
    return out


def without_paths(files: DataFrame, hidden: DataFrame) -> DataFrame:
    """``files`` without the paths of ``hidden`` (relative_path), as a version control system lists them; null paths stay."""
    return files.join(hidden.select("relative_path").distinct(), "relative_path", "left_anti")


def inside(path: str) -> str:
    """A relative path in plain form; one that leads out of the root is refused."""
    parts: list[str] = []
    for p in path.replace("\\", "/").split("/"):
        if p == "..":
            if not parts:
                raise ValueError(f"path {path!r} lies outside the root")
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    if path.startswith(("/", "~")) or re.match(r"^[A-Za-z]:", path):
        raise ValueError(f"path {path!r} lies outside the root")
    return "/".join(parts)


def ignored(path, patterns: list[str]):
    """Whether a relative path falls under the ignore rules, as a column."""
    out = F.lit(False)
    for keep, expression in ignore_rules(patterns):
        out = F.when(path.rlike(expression), F.lit(not keep)).otherwise(out)
    return out


def scan_tree(spark: SparkSession, root: str, extensions: list[str], patterns: list[str] | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """path, relative_path, content, content_hash and mtime of the files under ``root``.

    Bytes that are no UTF-8 are replaced. Left out are what the default rules, the ignore files at the root and
    ``patterns`` match (in that order; the last rule that matches decides) and the paths of ``hidden``.
    """
    base = root.rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", "^.*?" + re.escape(base), "")
    rows = found.withColumn("relative_path", relative).where(T.extension(F.col("path")).isin(*[e.lower() for e in extensions]))
    rows = rows.where(~ignored(F.col("relative_path"), IGNORED + read_ignore_rules(spark, root) + (patterns or [])))
    rows = without_paths(rows, hidden) if hidden is not None else rows
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return rows.select("path", "relative_path", text.alias("content"), F.sha2("content", 256).alias("content_hash"), (F.unix_micros("modificationTime").cast("double") / 1e6).alias("mtime"))


def save_snapshot(nodes: DataFrame, edges: DataFrame, path: str, version: str = "v1") -> None:
    """Nodes by type and edges by type, so that a typed traversal reads only its own partitions."""
    nodes.write.mode("overwrite").partitionBy("node_type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")
    spark = nodes.sparkSession
    spark.range(1).select(F.lit(version).alias("version"), F.unix_timestamp().cast("double").alias("written_at")).write.mode("overwrite").parquet(f"{path}/meta")


def load_snapshot(spark: SparkSession, path: str, files: DataFrame | None = None, tolerance: float = 1.0) -> tuple[DataFrame, DataFrame] | None:
    """The snapshot's nodes and edges, or None if a file is newer than it by more than ``tolerance`` seconds."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if files is not None and (files.agg(F.max("mtime")).first()[0] or 0) > meta["written_at"] + tolerance:
        return None
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def span(content: Column, start: int, end: int, max_chars: int = 20_000) -> Column:
    """Lines ``start`` to ``end`` (from 1, swapped and clamped), numbered, cut at ``max_chars`` with a mark."""
    low, high = max(1, min(start, end)), max(1, max(start, end))
    lines = F.slice(T.lines(content), low, high - low + 1)
    text = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + low).cast("string"), 4, " "), F.lit(" | "), x)), "\n")
    return F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit("\n[cut]"))).otherwise(text)


def _capped(text: Column, max_bytes: int) -> tuple[Column, Column]:
    """The text cut at ``max_bytes`` bytes (a character cut apart is replaced), and whether it was."""
    data = text.cast("binary")
    long = F.octet_length(text) > max_bytes
    return F.when(long, F.make_valid_utf8(F.substring(data, 1, max_bytes).cast("string"))).otherwise(text), long


def span_bytes(content: Column, start: int, end: int, context: int = 20, max_bytes: int = 200_000) -> Column:
    """Lines ``start`` to ``end`` with ``context`` lines around them: content, base_line, first, last, truncated."""
    every = T.lines(content)
    total = F.size(every)
    a, b = F.lit(max(1, start)), F.least(total, F.lit(end))
    first, last = F.least(a, b), F.greatest(a, b)
    base, stop = F.greatest(F.lit(1), first - context), F.least(total, last + context)
    text, long = _capped(F.array_join(F.slice(every, base, F.greatest(stop - base + 1, F.lit(0))), "\n"), max_bytes)
    return F.struct(text.alias("content"), base.alias("base_line"), first.alias("first"), last.alias("last"), long.alias("truncated"))


def numbered_file(content: Column) -> Column:
    """The whole text with its lines numbered."""
    return F.array_join(F.transform(T.numbered(T.lines(content)), lambda x: F.concat(F.lpad(x["n"].cast("string"), F.greatest(F.lit(4), F.length(x["n"].cast("string"))), F.lit(" ")), F.lit(" | "), x["text"])), "\n")


def raw_file(content: Column, max_bytes: int = 200_000) -> Column:
    """content up to ``max_bytes`` bytes, and whether it is truncated."""
    text, long = _capped(content, max_bytes)
    return F.struct(text.alias("content"), long.alias("truncated"))


def read_span(files: DataFrame, start: int, end: int, max_chars: int = 20_000) -> DataFrame:
    """``span`` of each file."""
    return files.where("content is not null").select("relative_path", span(F.col("content"), start, end, max_chars).alias("span"))


def list_directory(files: DataFrame) -> DataFrame:
    """Every folder with its entries: folder, name, is_file; folders first, then names without case."""
    parts = F.split("relative_path", "/")
    entries = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i - 1), "/").alias("folder"), parts[i - 1].alias("name"), (i == F.size(parts)).alias("is_file"))))
    return files.where("relative_path <> ''").select(entries.alias("e")).select("e.*").where(~F.col("name").startswith(".")).distinct()
