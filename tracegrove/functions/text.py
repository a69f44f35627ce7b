"""Column expressions over text, lines and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """Lines as an array: every line ending is known, and a last line break begins no further line."""
    return F.split(F.regexp_replace(F.regexp_replace(text, r"\r\n|\r", "\n"), r"\n$", ""), "\n")


def numbered(items: Column) -> Column:
    """Array of (n, text), n from 1."""
    return F.transform(items, lambda x, i: F.struct((i + 1).alias("n"), x.alias("text")))


def sections(text: Column, most: int) -> Column:
    """Markdown sections in order: section, title, level, line_start and content, cut at ``most`` characters with a mark.

    Text before the first heading is lost; a text without heading is one section ``Document`` of level 1 with
    number 0; headings inside fenced code count.
    """
    every = lines(F.regexp_replace(text, "^\ufeff", ""))
    heads = F.filter(F.transform(every, lambda x, i: F.when(x.rlike(r"^#{1,6}[ \t]+[^ \t]"), i)), lambda i: i.isNotNull())
    starts = F.when(F.size(heads) == 0, F.array(F.lit(0))).otherwise(heads)
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(every)))
    bare = F.size(heads) == 0

    def section(span: Column, i: Column) -> Column:
        own = F.slice(every, span["a"] + 1, span["b"] - span["a"])
        whole = F.array_join(own, "\n")
        title = F.regexp_replace(F.regexp_replace(own[0], r"^#+[ \t]+", ""), r"[ \t]+$", "")
        return F.struct(
            F.when(bare, F.lit(0)).otherwise(i + 1).cast("long").alias("section"), F.when(bare, F.lit("Document")).otherwise(title).alias("title"),
            F.when(bare, F.lit(1)).otherwise(F.length(F.regexp_extract(own[0], r"^(#+)", 1))).alias("level"), (span["a"] + 1).alias("line_start"),
            F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most), F.lit("\n[cut]"))).otherwise(whole).alias("content"),
        )

    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), section)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def anchor(title: Column) -> Column:
    return F.replace(F.trim(F.lower(title)), F.lit(" "), F.lit("-"))


def snippet(text: Column, length: int = 200) -> Column:
    """White space collapsed, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
    return F.when(F.length(flat) > length, F.concat(F.substring(flat, 1, length), F.lit("..."))).otherwise(flat)


def mermaid_id(name: Column) -> Column:
    """A name safe in diagrams: other characters become _; long ones end with a piece of their MD5."""
    safe = F.regexp_replace(name, r"[^\p{L}\p{N}]", "_")
    return F.when(F.length(safe) > 30, F.concat(F.substring(safe, 1, 20), F.lit("_"), F.substring(F.md5(safe), 1, 6))).otherwise(safe)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def line_hits(text_lines: Column, patterns: list[str]) -> Column:
    """Per line one hit for each matching pattern, repeated patterns counted as often as listed.

    Lines are first held against all patterns at once, so most lines cost one match.
    """
    anything = "|".join(f"(?:{p})" for p in dict.fromkeys(patterns))
    some = F.filter(text_lines, lambda x: x.rlike(anything))

    def hits(x: Column) -> Column:
        total = F.lit(0)
        for p in dict.fromkeys(patterns):
            total = total + x.rlike(p).cast("int") * patterns.count(p)
        return total

    return F.aggregate(F.transform(some, hits), F.lit(0), lambda acc, x: acc + x)
