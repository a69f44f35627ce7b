"""Problem 3: functions paired with their documentation.

An island grammar per language (``GRAMMARS``): of a source file only these islands are read, all else is water
and skipped:

    declaration <- documentation? annotation* signature body
    documentation <- block comment / run of line comments     (directly above the first line)
    body <- balanced braces / indented block (Python, opened by the documentation string) / until its end (Ruby)

Comments, strings and brackets are islands too, so that nothing inside a string or a comment is taken for a
signature and bodies balance. The grammar gives each declaration's lines, documentation and code; a node meets
its declaration by the first line (of the signature or of the annotations above it). Where a node's first line
is no declaration that the grammar knows, the comment directly above that line is its documentation.

Files are read before any shuffle; the join carries documentation, and code only where pairs are asked for.

Documentation is told from noise by what it says: lines of pragmas, licences, rulers, place-holders, to-dos,
tags without text, types and commented-out code are dropped; of the rest the words that the name, the
parameters, the types and the signature already say, and words that carry nothing, are taken away. What
remains must contain a word.

Defined cases: current row of a node id: greatest ``node_seq``; of a file: greatest ``mtime``, then content
hash. Null lines, lines outside the current content, removed nodes, null content: not found. An empty
docstring counts as given and says nothing. A comment or string that never ends is water from there on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import current_rows
from ..operators.skew import skew_join
from ..session import cut
from .invalid_sources import language_of

_STRING = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
_BLOCK, _SLASHES, _HASHES = r"(?P<block>/\*(?s:.*?)\*/)", r"(?P<line>//[^\n]*)", r"(?P<line>\#[^\n]*)"
_BRACES = r"(?P<open>[({\[])|(?P<close>[)}\]])|(?P<stop>;)"
_AT = r"(?m:^)[ \t]*(?P<note>@(?!interface\b)[\w.]+)"
_WORDS = r"(?:[A-Za-z_][\w.]*(?:<[^<>(){};\n]*(?:<[^<>(){};\n]*>[^<>(){};\n]*)*>)?(?:\[\])*[?*&]*[ \t*&]+)"
_NO_HEAD = r"(?!(?:return|if|else|for|foreach|while|switch|catch|throw|new|do|case|await|yield|in|using|lock|typeof|delete|goto|assert|package|import)\b)"


class Island(NamedTuple):
    """What is read of a language's files, and how its bodies end: by braces, by indentation or by the word end."""

    scan: re.Pattern
    ends: str = "braces"


def _islands(*parts: str, ends: str = "braces") -> Island:
    return Island(re.compile("|".join(parts)), ends)


# A signature (``head``) begins a line; its name is followed by parameters. Where a name alone could be a call, ``{`` must follow.
GRAMMARS = {
    "python": _islands(_HASHES, r'(?P<string>(?i:[rbuft]{0,3})(?:"""(?:[^\\]|\\(?s:.))*?"""|\'\'\'(?:[^\\]|\\(?s:.))*?\'\'\'|' + _STRING + "))", _AT, r"(?m:^)[ \t]*(?P<head>(?:async[ \t]+)?def[ \t]+(?P<name>\w+))", r"(?P<open>[({\[])|(?P<close>[)}\]])|(?P<stop>:)", ends="indent"),
    "javascript": _islands(_BLOCK, _SLASHES, r"`(?:[^`\\]|\\(?s:.))*`", _STRING, _AT, r"(?m:^)[ \t]*(?P<head>(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function\b[ \t]*\*?[ \t]*(?P<name>[\w$]+)|(?:(?:static|async|get|set)[ \t]+|\*[ \t]*)*" + _NO_HEAD + r"(?P<name2>#?[\w$]+)(?=\([^()\n;]*(?:\([^()\n]*\)[^()\n;]*)*\)[ \t]*\{)|(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<name3>[\w$]+)[ \t]*=[ \t]*(?:async[ \t]*)?(?=\([^()\n]*\)[ \t]*=>|function\b|[\w$]+[ \t]*=>))", _BRACES),
    "typescript": _islands(_BLOCK, _SLASHES, r"`(?:[^`\\]|\\(?s:.))*`", _STRING, _AT, r"(?m:^)[ \t]*(?P<head>(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:async[ \t]+)?function\b[ \t]*\*?[ \t]*(?P<name>[\w$]+)|(?:(?:public|private|protected|static|readonly|abstract|override|async|get|set)[ \t]+|\*[ \t]*)*" + _NO_HEAD + r"(?P<name2>#?[\w$]+)(?=\??(?:<[^()\n]*>)?\([^()\n;]*(?:\([^()\n]*\)[^()\n;]*)*\)[ \t]*(?::[^\n;={}]*(?:\{[^\n{}]*\}[^\n;={}]*)*)?[{;])|(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<name3>[\w$]+)[^=\n]*=[ \t]*(?:async[ \t]*)?(?=(?:<[^()\n]*>)?\([^()\n]*\)[^=\n]*=>|function\b|[\w$]+[ \t]*=>))", _BRACES),
    "java": _islands(_BLOCK, _SLASHES, r'"""(?s:.*?)(?<!\\)"""', _STRING, _AT, r"(?m:^)[ \t]*(?P<head>(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)[ \t]+)*(?:<[^(){};]*>[ \t]*)?" + _NO_HEAD + _WORDS + r"*" + _NO_HEAD + r"(?P<name>\w+)[ \t]*)(?=\()", _BRACES),
    "csharp": _islands(_BLOCK, _SLASHES, r'\$?@\$?"(?:[^"]|"")*"|\$*"""(?s:.*?)"""', r"\$?(?:" + _STRING + ")", r"(?m:^)[ \t]*(?P<note>\[(?=[A-Za-z_][\w.]*(?:[(:,\]]| )))", r"(?m:^)[ \t]*(?P<head>(?:(?:public|private|protected|internal|static|sealed|abstract|virtual|override|async|unsafe|extern|partial|readonly|new|required)[ \t]+)*" + _NO_HEAD + _WORDS + r"*" + _NO_HEAD + r"(?P<name>\w+)(?:<[^<>(){};\n]*>)?[ \t]*)(?=\()", _BRACES),
    "c": _islands(_BLOCK, _SLASHES, _STRING, r"(?m:^)[ \t]*\#(?:[^\n\\]|\\(?s:.))*", r"(?m:^)(?P<head>" + _NO_HEAD + r"(?:[A-Za-z_]\w*(?:[ \t*]+|\n(?=[A-Za-z_])))+" + _NO_HEAD + r"(?P<name>\w+)[ \t]*)(?=\()", _BRACES),
    "go": _islands(_BLOCK, _SLASHES, r"`[^`]*`", _STRING, r"(?m:^)(?P<head>func[ \t]+(?:\([^()\n]*\)[ \t]*)?(?P<name>\w+))", _BRACES),
    "rust": _islands(r"(?P<nested>/\*)", _SLASHES, r'b?r(?P<h>\#*)"(?s:.*?)"(?P=h)|"(?:[^"\\]|\\(?s:.))*"|\'(?:[^\'\\\n]|\\[^\n]{1,8})\'', r"(?m:^)[ \t]*(?P<note>\#!?\[)", r"(?m:^)[ \t]*(?P<head>(?:pub(?:\([^()\n]*\))?[ \t]+)?(?:(?:default|const|async|unsafe|extern(?:[ \t]+\"[^\"\n]*\")?)[ \t]+)*fn[ \t]+(?P<name>\w+))", _BRACES),
    "ruby": _islands(r"(?P<block>(?m:^)=begin\b(?s:.*?)(?m:^)=end\b[^\n]*)", _HASHES, _STRING, r"(?m:^)[ \t]*(?P<head>(?:(?:private|public|protected|module_function)[ \t]+)?def[ \t]+(?:self\.|\w+\.)?(?P<name>[\w]+[?!=]?|[-+*/%<>=!~\[\]&|^]+))", r"(?m:^)[ \t]*(?P<word>(?:class|module|if|unless|case|begin)\b(?![^\n]*\bend[ \t]*(?:\n|\Z))|(?:while|until|for)\b[^\n]*)|(?P<late>=[ \t]*(?:if|unless|case|begin|while)\b|\bdo\b(?=[ \t]*(?:\|[^|\n]*\|)?[ \t]*(?:\n|\Z)))|(?m:^)[ \t]*(?P<end>end)\b", ends="word"),
    "sql": _islands(_BLOCK, r"(?P<line>--[^\n]*)", r"\$(?P<h>(?:[A-Za-z_]\w*)?)\$(?s:.*?)\$(?P=h)\$", r"'(?:[^']|'')*'", r"(?mi:^)[ \t]*(?P<head>(?i:create[ \t]+(?:or[ \t]+replace[ \t]+)?(?:function|procedure))[ \t]+(?P<name>[\w.]+))", r"(?P<open>\()|(?P<close>\))|(?P<stop>;)", ends="stop"),
}
_RUST_EDGE = re.compile(r"/\*|\*/")
_OPENS = re.compile(r'[ \t]*(?:\#[^\n]*)?(?:\n[ \t]*(?:\#[^\n]*)?)*(?P<q>(?i:[ru]{0,2})(?:"""(?:[^\\]|\\(?s:.))*?"""|\'\'\'(?:[^\\]|\\(?s:.))*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'))')


def _lines(text: str) -> str:
    return text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")


def line_count(text: str) -> int:
    """Lines of the text; a line break at its end begins no further line."""
    return text.count("\n") + (not text.endswith("\n")) if text else 0


class Declaration:
    """A function as the grammar found it: its name, lines, the first line of its annotations, and its documentation."""

    __slots__ = ("name", "top", "line", "end", "doc", "depth", "indent", "heading")

    def __init__(self, name: str, top: int, line: int, doc: str | None, depth: int, indent: int):
        self.name, self.top, self.line, self.end, self.doc, self.depth, self.indent = name, top, line, None, doc, depth, indent
        self.heading = True  # its body has not begun


def _unnested(text: str, at: int) -> int:
    """Behind the comment that begins at ``at`` and may hold others; the end of the text if it never ends."""
    depth = 0
    for m in _RUST_EDGE.finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def read(language: str, text: str) -> tuple[list[Declaration], dict[int, str]]:
    """The declarations of the text (with \\n line ends), and the comment that ends directly above each line."""
    scan, ends = GRAMMARS[language]
    found: list[Declaration] = []
    open_: list[Declaration] = []  # declarations whose body has not ended
    above: dict[int, str] = {}
    run: list[str] = []  # line comments that follow each other
    run_end = note = note_end = -1  # lines: end of the run, first of the annotations, where the last of them ends
    note_depth = note_stop = -1  # brackets open where an annotation began; where its name ends
    depth, line, seen, at = 0, 1, 0, 0
    while m := scan.search(text, at):
        kind = m.lastgroup
        at = max(m.end(), at + 1)
        if kind in _SKIPPED:
            continue
        start = m.start(kind)
        line += text.count("\n", seen, start)
        seen = start
        if kind == "nested":
            at = _unnested(text, start)
        if kind in ("block", "line", "nested"):
            if text[text.rfind("\n", 0, start) + 1 : start].strip():
                continue  # behind code
            body = text[start:at]
            last = line + body.count("\n")
            if kind == "line" and run and run_end == line - 1:
                run.append(body)
                above.pop(last, None)
            else:
                run = [body]
            run_end = last
            above[last + 1] = "\n".join(run)
            if kind != "line":
                run = []
        elif kind == "note":
            if note < 0 or note_end < line - 1 or above.get(line) is not None:
                note = line
            note_end, note_stop = line, m.end()
            if m.group(kind).endswith("["):
                note_depth = depth
                depth += 1
        elif kind == "head":
            name = next(m.group(g) for g in _NAMES if g in m.re.groupindex and m.group(g))
            top = note if note > 0 and note_end in (line - 1, line) and note_depth < 0 else line
            column = start - text.rfind("\n", 0, start) - 1
            if not (open_ and open_[-1].heading and ends == "braces"):
                made = Declaration(name, top, line, above.get(top), depth, column)
                found.append(made)
                if ends == "word" and _ENDLESS.match(text, at):
                    made.end, made.heading = line, False
                else:
                    open_.append(made)
                    if ends == "word":
                        made.heading = False
                        depth += 1
            note = -1
        elif kind in ("open", "word"):
            if kind == "open" and m.group("open") == "{" and open_ and open_[-1].heading and open_[-1].depth == depth:
                open_[-1].heading = False
            if start == note_stop:
                note_depth = depth
            depth += 1
        elif kind == "late":
            depth += 1
        elif kind in ("close", "end"):
            depth = max(0, depth - 1)
            if note_depth == depth:
                note_depth, note_end = -1, line
            if (kind != "close" or m.group("close") == "}") and open_ and not open_[-1].heading and open_[-1].depth >= depth and ends in ("braces", "word"):
                if ends == "braces" and _MORE_BODY.match(text, at):  # that was a type in the signature
                    open_[-1].heading = True
                else:
                    open_.pop().end = line
        elif kind == "stop" and open_ and open_[-1].heading and open_[-1].depth == depth:
            if ends == "indent":
                open_[-1].heading = False
                q = _OPENS.match(text, m.end())
                if q:
                    raw = q.group("q").lstrip("rRuU")
                    open_[-1].doc = raw[3:-3] if raw[:3] in ('"""', "\'\'\'") else raw[1:-1]
            else:  # without a body
                open_.pop().end = line
    if ends == "indent":
        _indented_ends(text, found)
    return found, above


_SKIPPED = frozenset([None, "string", "h"])
_NAMES = ("name", "name2", "name3")
_MORE_BODY = re.compile(r"(?:\[\])*[ \t]*\{")
_ENDLESS = re.compile(r"[ \t]*(?:\([^()\n]*\))?[ \t]*=(?![=~>])|[^\n]*\bend[ \t]*(?=\n|\Z)")
_PYTHON_WATER = re.compile(r'(?i:[rbuft]{0,3})(?:"""(?:[^\\]|\\(?s:.))*?"""|\'\'\'(?:[^\\]|\\(?s:.))*?\'\'\'|' + _STRING + r")|\#[^\n]*")


def _blank(m: re.Match) -> str:
    """A comment as blanks; a string as one mark, and another (no line of its own) where it ends on a later line."""
    text = m.group()
    if text[0] == "#":
        return " " * len(text)
    inner = re.sub(r"[^\n]", " ", text[1:])
    return "x" + (inner[:-1] + "\0" if "\n" in inner else inner)


def _indented_ends(text: str, found: list[Declaration]) -> None:
    """The last line of each Python declaration: before the next line of code that is not indented further."""
    if not found:
        return
    bare = _PYTHON_WATER.sub(_blank, text)
    lines, depth = bare.split("\n"), 0
    starts = {d.line: d for d in found}
    stack: list[Declaration] = []
    last = 0
    for n, line in enumerate(lines, 1):
        body = line.strip()
        if body and depth == 0 and body[0] != "\0":
            width = len(line) - len(line.lstrip())
            while stack and stack[-1].indent >= width and stack[-1].line < n:
                stack.pop().end = last
            if n in starts:
                stack.append(starts[n])
        if body:
            last = n
            depth = max(0, depth + sum(map(line.count, "([{")) - sum(map(line.count, ")]}")))
    for d in stack:
        d.end = last


def docs_by_line(language: str, text: str) -> dict[int, str]:
    """For each line on which a declaration may start, the documentation in the file: the grammar's, else the comment above."""
    found, above = read(language, text)
    docs = above
    for d in found:
        if d.doc is not None:
            docs[d.line] = docs[d.top] = d.doc
    return docs


_MARK = re.compile(r"^\s*(?:/\*+!?|\*/|\*(?!/)|//+!?|#+!?|--+|\"\"\"|'''|<!--|=begin|=end)?\s?|\s*(?:\*+/|\"\"\"|''')\s*$")
_REGION = re.compile(r"^\s*(?:/\*+|//+|\*+|#+)?\s*#\s?(?:end)?(?:region|pragma|if|endif)\b[\s\w]*(?:\*/)?$")  # folding marks
_REPEATED = re.compile(r"^(\w+)(?:\s+\1)+$")  # a word and nothing but itself again
_RULER = re.compile(r"^[-=~*_#/+]{3,}$")
_TAG = re.compile(r"^[@\\:](?:param|arg|argument|type|tparam|return|returns|throws|raises|exception|rtype)\b:?\s*(.*)$", re.I)
_TYPE = r"(?:int|integer|i64|i32|u32|u64|usize|str|string|bool|boolean|float|double|number|void|none|null|any|object|long|self|list|dict|map|array|optional)"
_NOTHING = re.compile(
    r"^(?:"
    r"[-=~*_#/+.?!\s]*"  # rulers
    r"|(?:\w+\s*:\s*)?(?:todo|fixme|xxx|hack|tbd|wip)\b.*"
    r"|n/?a|none|undocumented|lorem ipsum.*|description(?: goes here)?|documentation|doc(?:string|umentation)?s? (?:goes here|here|missing|pending)|(?:no|missing|add|needs?|write|insert) (?:a |the |some )?(?:description|documentation|docs?|docstring|comment)s?(?: here| yet| available)?"
    r"|placeholder(?: comment)?|not (?:yet )?documented(?: yet)?|(?:function|method|constructor|getter|setter|helper|stub|comment|summary|docs?)"
    r"|see (?:base|super|parent) ?class|see (?:above|below)|see @\w+|(?:inherited|inherits) .*|\{@inheritdoc\}|@inheritdoc|@override"
    r"|@(?:since|author|version|see|deprecated|generated|internal|ignore|suppress\w*|todo|api|package|module|date|copyright|license)\b.*"
    r"|<summary>\s*</summary>|</?\w+>"
    r"|(?:pylint|noqa|eslint|tslint|nolint|clang-format|mypy|flake8|rubocop|prettier|istanbul|checkstyle|nosonar|jshint|jscs|golangci|swiftlint|phpcs|yapf|isort|rustfmt|@ts)\s*[!:-].*"
    r"|(?:type|pragma|fmt|coverage)\s*[:!-]\s*(?:ignore|no|off|on|skip|once|warning|disable|enable)\b.*|go:\S+.*|(?:noqa|nosonar|nolint|eslint-\S+.*|clang-format.*)"
    r"|copyright\b.*|\(c\) .*|all rights reserved.*|licen[sc]ed under.*|spdx-.*|part of \S+|this file is part of.*"
    r"|auto-?generated\b.*|this stub was created.*|to change it, edit the template.*|created (?:on )?[\d/-]+.*|(?:author|created by)\s*:.*|(?:date|since|version|modified)\s*:\s*v?\d[\w./:-]*(?: by .*)?|generated by.*"
    r"|\(?see \S+ #?\d+\)?|#\d+|[A-Z]+-\d+"
    r"|(?:args|arguments|parameters|params|returns?|raises|throws|yields|examples?|notes?|attributes|see also)\s*:?"
    rf"|:?(?:r?type|returns?)\b[^\w]*{_TYPE}?|{_TYPE}|\(?(?:{_TYPE}[, ]*)*\)?\s*->\s*{_TYPE}"
    r")[.:!;,\s]*$",
    re.I,
)
_CODE = re.compile(r"^[\w.\[\]]+\s*[-+*/|&]?:?=\s*\S.*$|^(?:return|if|for|while|else|elif|end|break|continue|throw|raise|import|let|var|const|def|fn|func)\b[^.]*[\w)\]>;:{}=+\-*/%<]$|^[\w.]+\([^)]*\);?$|^[{}();]+$")
_UNSPACED = r"฀-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"  # scripts without spaces: each character is a piece
_PIECES = re.compile(rf"[A-Z]+(?![a-z])|[A-Z]?[a-zß-öø-ÿ]+|(?=\w)[{_UNSPACED}]|[^\W\d_A-Za-zÀ-ÿ{_UNSPACED}]+|\d+")
# Words that tell nothing about what a function does.
EMPTY = frozenset("a an the this that these those it its is are be of for to in on with by and or from as at into function method functions methods procedure routine helper class module returns return given which will does do just simply used uses".split())


def _stem(word: str) -> str:
    w = word.lower()
    for end in ("ings", "ing", "ies", "es", "ed", "s", "e", "y"):
        if w.endswith(end) and len(w) - len(end) >= 2:
            w = w[: -len(end)]
            break
    if len(w) > 3 and w[-1] in "ey":
        w = w[:-1]
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def clean_lines(doc: str) -> list[str]:
    """The lines of a documentation without comment marks; a word between two rulers is a heading and left out."""
    lines = _lines(doc).split("\n")
    texts = [_MARK.sub("", _MARK.sub("", line)).strip() for line in lines]
    ruled = [bool(_RULER.match(text) or _RULER.match(line.strip())) for text, line in zip(texts, lines)]
    out = []
    for i, text in enumerate(texts):
        heading = 0 < i < len(lines) - 1 and ruled[i - 1] and ruled[i + 1] and " " not in text
        if text and not heading and not _REGION.match(lines[i]) and not _REPEATED.match(text):
            out.append(text)
    return out


def _sentences(line: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z@(])", line) if s.strip()]


def said(name: str | None, signature: str | None, doc: str | None, class_name: str | None = None) -> bool:
    """Whether ``doc`` tells anything that name, parameters and types do not."""
    if not doc or not doc.strip():
        return False
    known = {_stem(w) for x in (name, signature, class_name) if x for w in _PIECES.findall(x)}
    lines = clean_lines(doc)
    in_args = False
    for line in lines:
        if re.match(r"^(?:args|arguments|parameters|params|attributes)\s*:?$", line, re.I):
            in_args = True
            continue
        tag = _TAG.match(line)
        if tag:
            rest = tag.group(1)
            if not re.match(r"^[@\\:](?:return|returns|rtype|throws|raises|exception)", line, re.I):
                rest = re.sub(r"^(?:\{[^}]*\}\s*)?\[?[\w.]+\]?\s*[:-]?\s*", "", rest)  # the parameter's own name
            pieces = [rest]
        elif in_args and re.match(r"^\*{0,2}\w+\s*(?:\([^)]*\))?\s*:", line):
            pieces = [line.partition(":")[2]]
        else:
            pieces = _sentences(line)
        for piece in pieces:
            text = piece.strip()
            if not text or _NOTHING.match(text) or _CODE.match(text):
                continue
            text = re.sub(r"\b(?:TODO|FIXME|XXX)\b.*$", "", text)
            words = [w for x in re.findall(r"[\w']+", text) for w in _PIECES.findall(x)]
            rest = [w for w in words if w.lower() not in EMPTY and _stem(w) not in known and not w.isdigit() and not (re.fullmatch(_TYPE, w, re.I))]
            if rest:
                return True
    return False


FACTS = "relative_path string, mtime double, order_hash long, n_lines int, docs map<int,string>"
CODE = "code map<int,struct<last:int,text:string>>"


def _facts(with_code: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n_lines, docs, code = [], [], []
            for path, text in zip(batch["relative_path"], batch["content"]):
                language = language_of(path)
                text = _lines(text) if text is not None else None
                n_lines.append(line_count(text) if text is not None else None)
                docs.append(docs_by_line(language, text) if language and text else {})
                if with_code:
                    code.append(code_by_line(language, text) if language and text else {})
            out = batch[["relative_path", "mtime", "order_hash"]].assign(n_lines=pd.array(n_lines, "Int32"), docs=docs)
            yield out.assign(code=code) if with_code else out

    return run


def code_by_line(language: str, text: str) -> dict[int, dict]:
    """For each first line of a declaration its last line and its code."""
    lines, out = text.split("\n"), {}
    for d in read(language, text)[0]:
        if d.end:
            for first in {d.top, d.line}:
                out[first] = {"last": d.end, "text": "\n".join(lines[first - 1 : d.end])}
    return out


@F.pandas_udf(T.BooleanType())
def _said(name: pd.Series, signature: pd.Series, doc: pd.Series, class_name: pd.Series) -> pd.Series:
    return pd.Series([said(a, b, c, d) for a, b, c, d in zip(name, signature, doc, class_name)])


def functions(nodes: DataFrame) -> DataFrame:
    """Living functions and methods with their lines."""
    fields = ["node_type", "name", "class_name", "signature", "docstring", "file_path", "line_start", "line_end", "removed_at"]
    now = current_rows(nodes.where("id is not null"), "id", [F.col("node_seq")], fields)
    return now.where("node_type in ('function', 'method') and removed_at is null and line_start >= 1 and line_end >= line_start and file_path is not null")


def _documented(nodes: DataFrame, files: DataFrame, with_code: bool) -> DataFrame:
    rows = files.where("relative_path is not null").select("relative_path", "mtime", F.xxhash64("content").alias("order_hash"), "content")
    facts = rows.mapInPandas(_facts(with_code), f"{FACTS}, {CODE}" if with_code else FACTS)
    facts = current_rows(facts, "relative_path", [F.col("mtime"), F.col("order_hash")], ["n_lines", "docs", *(["code"] if with_code else [])])
    joined = skew_join(functions(nodes), facts.withColumnRenamed("relative_path", "file_path"), "file_path")
    inside = joined.where("line_end <= n_lines").withColumn("documentation", F.coalesce("docstring", F.col("docs")[F.col("line_start")]))
    return inside.where(F.col("documentation").isNotNull() & _said("name", "signature", "documentation", "class_name"))


def documented(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Functions whose documentation says something: id, name, file_path, lines, signature, documentation."""
    return _documented(nodes, files, False).select("id", "name", "node_type", "file_path", "line_start", "line_end", "signature", "documentation")


def pairs(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Code and documentation of each documented function.

    The code is cut where the file is read, by the grammar's spans. Of functions whose given lines are others, the
    lines are cut from the current content of their files, which alone are read again and moved.
    """
    found = _documented(nodes, files, True).withColumn("span", F.col("code")[F.col("line_start")])
    found = cut(found.select("id", "name", "file_path", "line_start", "line_end", "documentation", F.when(F.col("span.last") == F.col("line_end"), F.col("span.text")).alias("code")))
    rest = found.where("code is null").drop("code")
    paths = rest.select(F.col("file_path").alias("relative_path")).distinct()
    own = files.where("relative_path is not null").join(paths, "relative_path", "left_semi")
    current = current_rows(own, "relative_path", [F.col("mtime"), F.xxhash64("content")], ["content"])
    lines = F.split(F.regexp_replace(F.regexp_replace("content", "^\ufeff", ""), r"\r\n?", "\n"), "\n")
    code = F.array_join(F.slice(lines, F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n")
    rest = rest.join(current.withColumnRenamed("relative_path", "file_path"), "file_path").select("id", "name", "file_path", "line_start", "line_end", "documentation", code.alias("code"))
    return found.where("code is not null").unionByName(rest)
