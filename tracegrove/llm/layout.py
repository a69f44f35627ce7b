"""Problem 4: generated, minified, bundled, vendored and data files.

Layout statistics of each file (maximum and mean line length, white-space, alphanumeric and digit share, density of
literals, longest encoded run) are held against ``LIMITS``, tuned per language to how its hand-written code lies:
tabs or spaces, long names, wide strings. They find minified scripts and data saved as code. What layout cannot tell
is read from where a generator or a third party leaves its name: the comment at the head or at the foot of the file,
the folder, the file name. Copies are also found by content: five-word shingles of the code against the known
upstream files, containment of 0.8 or more of either side in the other.

Markers count only in comments before the first and after the last line of code, so code that prints or discusses a
marker is not a case.

Defined cases: null and empty content and ``md`` files are hand-written (reason null). The current row has the
greatest ``mtime``, then the greatest content hash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import current_rows
from ..operators.skew import skew_join
from .invalid_sources import LANGUAGES, language_of

UPSTREAM_BYTES = 32_000_000  # upstream content up to which its shingles are broadcast
SHINGLE, SIMILAR, LEAST = 5, 0.8, 20  # words, containment, shared shingles at least


class Limits(NamedTuple):
    """Beyond all of ``longest``, ``mean`` (characters of a line) and below ``white`` (share): minified, if letters and digits have a share under ``prose`` (else it is text).

    Data: digits above ``digits``, literals above ``literals``, or letters and digits below ``symbols`` (shares of what is not white).
    """

    longest: int
    mean: int
    white: float
    prose: float
    symbols: float
    digits: float
    literals: float


LIMITS = {
    "javascript": Limits(500, 120, 0.10, 0.90, 0.25, 0.30, 0.60), "typescript": Limits(500, 130, 0.10, 0.90, 0.25, 0.30, 0.60),  # minified by tools, so the least is allowed
    "python": Limits(1000, 200, 0.12, 0.90, 0.30, 0.30, 0.60),  # indentation is white space, so little of it is odd
    "java": Limits(800, 180, 0.10, 0.92, 0.30, 0.30, 0.60), "csharp": Limits(800, 180, 0.10, 0.92, 0.30, 0.30, 0.60),  # long names
    "go": Limits(800, 150, 0.08, 0.90, 0.28, 0.30, 0.60),  # a tab is one character of white space
    "rust": Limits(800, 160, 0.10, 0.90, 0.25, 0.30, 0.60), "c": Limits(800, 150, 0.10, 0.90, 0.25, 0.32, 0.65),  # tables of constants are hand-written more often
    "ruby": Limits(800, 160, 0.08, 0.92, 0.28, 0.30, 0.60), "sql": Limits(1000, 250, 0.10, 0.95, 0.30, 0.45, 0.75),  # statements with values are code
}
SHORT = 500  # characters below which a body is too short for its shares to tell
_WHITE, _DIGITS = b" \t\r\n\f\v", b"0123456789"
_ALNUM = bytes(c for c in range(256) if chr(c).isalnum() or c >= 128)  # letters beyond ASCII are no symbols
_ENCODED = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{120,}+|(?:\\x[0-9a-fA-F]{2}){40,}+|(?<![\w.,-])(?:0x[0-9a-fA-F]{1,8},\s*+){40,}+|(?<![\w.,-])(?:-?\d[\d.]*+,\s*+){60,}+")
_LITERAL = re.compile(r"(?<![\w.])(?:0[xX][0-9a-fA-F]+|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|\"[^\"\n]*\"|'[^'\n]*'")
_WORDISH = re.compile(r"[A-Za-z_]\w*")
_COMMENT = {"python": r"#[^\n]*", "ruby": r"#[^\n]*", "sql": r"--[^\n]*|/\*(?s:.*?)\*/"}
_SLASHES = r"//[^\n]*|/\*(?s:.*?)\*/|<!--(?s:.*?)-->|#![^\n]*"
_LEADING = {k: re.compile(rf"(?:\s+|{_COMMENT.get(k, _SLASHES)})*") for k in LIMITS}
_TRAILING = {k: re.compile(rf"(?m:^)(?:[ \t]*(?:{_COMMENT.get(k, _SLASHES)})[ \t]*(?:\n\s*|\Z))+\Z") for k in LIMITS}
_MARKS = ("//", "#", "--", "/*", "*", "<!--")
_FOOT = 2000  # characters at the end in which a comment of the foot begins
_ANY_COMMENT = {k: re.compile(rf"{_COMMENT.get(k, _SLASHES)}") for k in LIMITS}
_GENERATED = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?generated\b(?! method)|\bautomatisch erzeugt\b|\bgenerated (?:by|from|client|code|file|using|with|source|bindings)\b|\b(?:code|file|automatically|machine)[ -]generated\b|\bmachine-written\b"
    r"|\bdo not (?:edit|modify|change)\b|\bnicht bearbeiten\b|\bproduced by the .*(?:compiler|generator)|\bmanual changes will be lost\b|\boutput of the .*generator\b|\b(?:re)?built from \S+\.(?:tmpl|in|tpl)\b"
    r"|\bchanges made here do not survive\b|\bedits are overwritten\b|\bwill be overwritten\b|\bderived from \S+\.(?:proto|idl|xml|thrift|y|g4)\b|\b(?:generado|généré) automati",
    re.I,
)
_BY_HAND = re.compile(r"\bnot (?:auto-?)?generated\b|\bwritten by hand\b|\bhand-?written\b", re.I)
_THEIRS = re.compile(r"\btaken from (?P<a>\S+) v?\d|\bdistributed with the (?P<b>\S+) package\b|\bthis file is part of (?P<c>[\w.-]+?)\.?$|\b(?:vendored|copied|adapted) from (?P<d>\S+)|^[\s/*#-]*part of (?P<e>[\w-]+)\.?$", re.I | re.M)
# Folders that package managers and projects use for third-party copies, for build output and for generated code.
VENDOR_DIRS = frozenset("third_party third-party thirdparty 3rdparty external externals vendor vendored node_modules bower_components site-packages godeps deps jspm_packages pods".split())
GENERATED_DIRS = frozenset("generated generated-sources gen".split())  # not "generators": those are written by hand
_GENERATED_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h|rs)|_pb\.(?:js|rb|ts)|\.generated\.\w+|\.gen\.\w+|\.designer\.cs|\.g\.(?:cs|dart)|\.(?:yy|tab)\.[ch]|outerclass\.java|_generated\.(?:h|py|go|ts|rs|java|js|rb|cs))$|^zz_generated\.|^[A-Z]\w*Generated\.(?:java|cs)$", re.I)
_BUNDLE_NAME = re.compile(r"(?:\.|-)(?:min|bundle|prod)\.m?js$", re.I)


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def _encoded(text: str, digits: int) -> int:
    """Length of the longest encoded run; a text that cannot hold one is not searched."""
    solid = max(map(len, text.split()), default=0) >= 120
    listed = text.count(",") >= 40 and (text.count("0x") + text.count("0X") >= 40 or digits >= 60)
    return max((m.end() - m.start() for m in _ENCODED.finditer(text)), default=0) if solid or listed else 0


def layout(text: str) -> tuple[int, float, float, float, float, int]:
    """Maximum and mean line length, white-space, alphanumeric and digit share, length of the longest encoded run."""
    data = text.encode("utf-8", "replace")
    n = max(1, len(data))
    lines = [len(x) for x in text.splitlines() if x.strip()] or [0]
    digits = len(data) - len(data.translate(None, _DIGITS))
    return max(lines), sum(lines) / len(lines), 1 - len(data.translate(None, _WHITE)) / n, 1 - len(data.translate(None, _ALNUM)) / n, digits / n, _encoded(text, digits)


def _one_shape(body: str) -> bool:
    """Whether nine tenths of at least a dozen lines are alike once their literals are taken out (rows of a table, inserts)."""
    shapes = Counter(_LITERAL.sub("0", line.strip()) for line in body.splitlines() if line.strip())
    return sum(shapes.values()) >= 12 and shapes.most_common(1)[0][1] >= 0.9 * sum(shapes.values())


def reason(path: str, text: str | None) -> str | None:
    """minified, data, generated or vendored; null for hand-written files (copies without a sign are found by shingles)."""
    language = language_of(path)
    if not language or not text or not text.strip():
        return None
    parts = path.split("/")
    folders, name = [p.lower() for p in parts[1:-1]], parts[-1]
    body = _ANY_COMMENT[language].sub("", text)  # long comments are no sign of a machine
    why = by_layout(language, body)
    if why or language in ("javascript", "typescript") and _BUNDLE_NAME.search(name) and body.count(" ") < 0.15 * len(body):
        return why or "minified"
    head = _LEADING[language].match(text.removeprefix("\ufeff")).group()
    last = text.rstrip().rpartition("\n")[2].lstrip()
    foot = _TRAILING[language].search(text, max(0, len(text) - _FOOT)) if last.startswith(_MARKS) or last.endswith(("*/", "-->")) else None
    said = f"{head}\n{foot.group()}" if foot and foot.start() >= len(head) else head
    if not _BY_HAND.search(said) and _GENERATED.search(said):
        return "generated"
    if VENDOR_DIRS & set(folders):
        return "vendored"
    own = _plain(parts[0])
    for m in _THEIRS.finditer(said):
        if _plain(next(g for g in m.groups() if g)) != own:
            return "vendored"
    if not _BY_HAND.search(said) and (GENERATED_DIRS & set(folders) or _GENERATED_NAME.search(name)):
        return "generated"
    return None


def by_layout(language: str, body: str) -> str | None:
    """minified or data, by the statistics of the code without its comments alone."""
    limits = LIMITS[language]
    longest, mean, white, alnum, digits, encoded = layout(body)
    solid = max(1e-9, 1 - white)
    if longest > limits.longest and mean > limits.mean and white < limits.white and alnum < limits.prose * solid and encoded < 0.5 * len(body):
        return "minified"
    literals = sum(len(x) for x in _LITERAL.findall(body) if x.count(" ") < 8)  # a sentence is no datum
    if literals > 0.12 * len(body) and _one_shape(body):
        return "data"
    if encoded > 400 and encoded > 0.5 * len(body):
        return "data"
    if len(body) <= SHORT:
        return None
    if digits > limits.digits or alnum < limits.symbols * solid:
        return "data"
    if literals > limits.literals * solid * len(body) and sum(m.end() - m.start() for m in _WORDISH.finditer(_LITERAL.sub("", body))) < 0.12 * solid * len(body):
        return "data"
    return None


def shingles(language: str | None, text: str) -> np.ndarray:
    """Sorted distinct hashes of five successive words of the code, comments and spacing aside."""
    code = _ANY_COMMENT[language].sub(" ", text) if language in _ANY_COMMENT else text
    words = _WORD.findall(code)
    if not words:
        return np.zeros(0, np.uint64)
    if len(_CODES) > 500_000:
        _CODES.clear()
    codes = np.fromiter(map(_CODES.__getitem__, words), np.uint64, len(words))
    if len(codes) < SHINGLE:
        codes = np.concatenate([codes, np.zeros(SHINGLE - len(codes), np.uint64)])
    n = len(codes) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):  # a polynomial over the word codes, modulo 2**64
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n] + np.uint64(1)
    return np.unique(total)


_WORD = re.compile(r"\w+|[^\w\s]", re.A)


class _Codes(dict):
    """A number for each word, the same in every task."""

    def __missing__(self, word: str) -> int:
        code = self[word] = zlib.crc32(word.encode("utf-8", "replace"))
        return code


_CODES = _Codes()


class Known:
    """Shingles of the known upstream files, each with the files that hold it."""

    def __init__(self, known: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in known], np.int64)
        every = np.concatenate(known) if known else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(known)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.keys, self.first = np.unique(every[order], return_index=True)
        self.first = np.append(self.first, len(every))

    def copied(self, own: np.ndarray) -> bool:
        """Whether one of the files holds enough of ``own``, or ``own`` of it."""
        if not len(self.keys) or len(own) < LEAST:
            return False
        at = np.searchsorted(self.keys, own)
        at = at[self.keys[np.minimum(at, len(self.keys) - 1)] == own]
        if len(at) < LEAST:
            return False
        counts = self.first[at + 1] - self.first[at]
        places = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        shared = np.bincount(self.owner[places], minlength=len(self.sizes))
        return bool(((shared >= SIMILAR * np.minimum(len(own), self.sizes)) & (shared >= LEAST)).any())


def _reasons(known):
    """known: None, or a broadcast of ``Known``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upstream = known.value if known is not None else Known([])
        for batch in batches:
            out = []
            for path, text in zip(batch["relative_path"], batch["content"]):
                why = reason(path, text)
                if why is None and len(upstream.keys) and text and language_of(path) and upstream.copied(shingles(language_of(path), text)):
                    why = "vendored"
                out.append(why)
            yield batch[["relative_path", "mtime", "order_hash"]].assign(reason=out)

    return run


def _copies_by_join(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """Paths of copies when the upstream files are too many to broadcast: a join on shingles."""

    def explode(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                s = shingles(language_of(row.name), row.content or "").view(np.int64)
                if len(s):
                    yield pd.DataFrame({"name": row.name, "hash": row.hash, "shingle": s, "of": len(s)})

    shape = "name string, hash long, shingle long, of long"
    known = F.lower(F.regexp_extract("relative_path", r"([^.]*)\z", 1)).isin(*LANGUAGES)  # of ours only sources count; upstream files count whatever they are called
    ours = files.where(known).select(F.col("relative_path").alias("name"), F.col("order_hash").alias("hash"), "content").mapInPandas(explode, shape)
    theirs = upstream.select(F.col("file_name").alias("name"), F.col("upstream_id").cast("long").alias("hash"), "content").mapInPandas(explode, shape)
    theirs = theirs.select(F.col("hash").alias("upstream"), "shingle", F.col("of").alias("their_of"))
    shared = skew_join(ours, theirs, "shingle").groupBy("name", "hash", "upstream").agg(F.count("*").alias("n"), F.max(F.least("of", "their_of")).alias("least"))
    return shared.where((F.col("n") >= SIMILAR * F.col("least")) & (F.col("n") >= LEAST)).select(F.col("name").alias("relative_path"), F.col("hash").alias("order_hash")).distinct()


def classify_files(files: DataFrame, upstream: DataFrame, broadcast_bytes: int = UPSTREAM_BYTES) -> DataFrame:
    """One row per ``relative_path`` with the reason why its current content is not hand-written, or null."""
    spark = files.sparkSession
    rows = files.select("relative_path", "mtime", F.xxhash64("content").alias("order_hash"), "content").where(F.col("relative_path").isNotNull())
    shape = "relative_path string, mtime double, order_hash long, reason string"
    total = upstream.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    if total <= broadcast_bytes:
        known = [shingles(language_of(row.file_name), row.content) for row in upstream.select("file_name", "content").where("content is not null").collect()]
        seen = rows.mapInPandas(_reasons(spark.sparkContext.broadcast(Known(known))), shape)
    else:
        copies = _copies_by_join(rows, upstream).withColumn("copy", F.lit("vendored"))
        seen = rows.mapInPandas(_reasons(None), shape).join(copies, ["relative_path", "order_hash"], "left").withColumn("reason", F.coalesce("reason", "copy")).drop("copy")
    return current_rows(seen, "relative_path", [F.col("mtime"), F.col("order_hash")], ["reason"])


def not_hand_written(files: DataFrame, upstream: DataFrame) -> DataFrame:
    return classify_files(files, upstream).where(F.col("reason").isNotNull()).select("relative_path")


def reason_counts(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """Files per repository and reason (``hand_written`` where there is none)."""
    found = classify_files(files, upstream)
    return found.groupBy(F.split("relative_path", "/")[0].alias("repository"), F.coalesce("reason", F.lit("hand_written")).alias("reason")).agg(F.count("*").alias("files"))
