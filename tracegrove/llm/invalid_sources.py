"""Problem 2: source files that do not parse in the language of their extension.

Each file is cut into tokens and matched against its language's parsing-expression grammar by a packrat
parser that must consume the whole input. A failing file is reported with the furthest position reached and
its cause: conflict marks, binary bytes, markup, the end of the text, another language whose grammar takes the
whole text, brackets that nest too deep to follow (``NESTING``; such a file counts as invalid), else syntax.

Defined cases: null content, unknown and ``md`` extensions, empty and comment-only files are not invalid.
A file's current row is the one with the greatest ``mtime``; rows that tie differ at most in content, and
then the greater content hash counts. Contents are parsed before the shuffle, which carries verdicts only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import current_rows
from .grammars import grammar
from .lexers import tokens
from .peg import TooDeep

LANGUAGES = {
    "py": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "java": "java", "go": "go",
    "rs": "rust", "c": "c", "h": "c", "cs": "csharp", "rb": "ruby", "sql": "sql",
}
NESTING, PYTHON_NESTING = 100_000, 200  # brackets within brackets that are followed; Python's own parser stops at 200
CAUSES = ("conflict", "truncated", "other_format", "other_language", "binary", "too_deep", "syntax")
VERDICT = "language string, invalid boolean, line int, column int, found string, cause string"
_CONFLICT = re.compile(r"^(?:<{7}|>{7}|={7}|\|{7})(?: |$)", re.M)
_MARKUP = re.compile(r"\s*(?:<!doctype|<html|<\?xml|```)", re.I)


def language_of(path: str | None) -> str | None:
    return LANGUAGES.get((path or "").rpartition(".")[2].lower())


def _nesting(kinds: list[str]) -> tuple[int, int]:
    """How deep brackets nest, and the token that is the first to lie so deep."""
    depth = most = deepest = 0
    for i, k in enumerate(kinds):
        if k in _OPENING:
            depth += 1
            if depth > most:
                most, deepest = depth, i
        elif k in _CLOSING:
            depth -= 1
    return most, deepest


_OPENING, _CLOSING = frozenset(["(", "[", "{", "F{"]), frozenset([")", "]", "}", "F}"])


def _other_language(language: str, text: str) -> bool:
    """Whether another language's grammar takes the text (markup aside): it lies under the wrong extension."""
    for other in sorted(set(LANGUAGES.values()) - {language} - ({"javascript"} if language == "typescript" else set())):
        kinds, breaks, _ = tokens(other, text)
        if len(kinds) > 8 and "BAD" not in kinds and _nesting(kinds)[0] <= PYTHON_NESTING and grammar(other).parse(kinds, breaks) < 0:
            return True
    return False


def syntax_error(language: str, text: str) -> tuple[int, int, str, str] | None:
    """None if ``text`` is valid, else line and column (from 1) of the furthest failure, the token there and the cause."""
    kinds, breaks, at = tokens(language, text)
    if len(kinds) == 1 or all(k in ("NL", ";", "EOF") for k in kinds) and language in ("python", "ruby"):
        return None
    most, deepest = _nesting(kinds)
    if most > (PYTHON_NESTING if language == "python" else NESTING):
        failed, cause = deepest, "too_deep"
    else:
        try:
            failed, cause = grammar(language).parse(kinds, breaks), None
        except TooDeep:
            failed, cause = deepest, "too_deep"
    if failed < 0:
        return None
    clean = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    offset = at[failed]
    line = clean.count("\n", 0, offset) + 1
    column = offset - (clean.rfind("\n", 0, offset) + 1) + 1
    if cause:
        pass
    elif _CONFLICT.search(clean):
        cause = "conflict"
    elif "\x00" in clean:
        cause = "binary"
    elif _MARKUP.match(clean):
        cause = "other_format"
    elif kinds[failed] == "EOF" or clean[offset:].strip() == "":
        cause = "truncated"
    elif _other_language(language, clean):
        cause = "other_language"
    else:
        cause = "syntax"
    return line, column, kinds[failed], cause


def _verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, text in zip(batch["relative_path"], batch["content"]):
            language = language_of(path)
            error = syntax_error(language, text) if language and text else None
            rows.append((language, error is not None, *(error or (None, None, None, None))))
        out = pd.DataFrame(rows, columns=["language", "invalid", "line", "column", "found", "cause"], index=batch.index)
        yield pd.concat([batch[["relative_path", "mtime", "order_hash"]], out], axis=1)


def check_files(files: DataFrame) -> DataFrame:
    """One row per ``relative_path``: its language and whether, where and why its current content fails to parse."""
    rows = files.select("relative_path", "mtime", F.xxhash64("content").alias("order_hash"), "content").where(F.col("relative_path").isNotNull())
    seen = rows.mapInPandas(_verdicts, f"relative_path string, mtime double, order_hash long, {VERDICT}")
    return current_rows(seen, "relative_path", [F.col("mtime"), F.col("order_hash")], ["language", "invalid", "line", "column", "found", "cause"])


def invalid_files(files: DataFrame) -> DataFrame:
    return check_files(files).where("invalid").select("relative_path")


def invalid_rates(files: DataFrame) -> DataFrame:
    """Files and invalid files per repository and language, with the number of each cause."""
    checked = check_files(files).where(F.col("language").isNotNull())
    counts = [F.sum((F.col("cause") == c).cast("long")).alias(c) for c in CAUSES]
    bad = F.sum(F.col("invalid").cast("long"))
    return checked.groupBy(F.split("relative_path", "/")[0].alias("repository"), "language").agg(
        F.count("*").alias("files"), bad.alias("invalid_files"), (bad / F.count("*")).alias("rate"), *[F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(counts, CAUSES)]
    )
