"""Comments of a source file, told from its strings."""

from __future__ import annotations

import re

_BLOCK = r"/\*[\s\S]*?(?:\*/|\Z)"
_QUOTED = r'"(?:[^"\\\n]|\\[\s\S])*"|' + r"'(?:[^'\\\n]|\\[\s\S])*'"
_LONG = r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''"
_BACKTICK = r"`(?:[^`\\]|\\[\s\S])*`"
_REGEX = r"[(\[{=:,;!&|?~^<>+*%-][ \t]*/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/"
_C_LIKE = rf"(?P<c>//[^\n]*|{_BLOCK})|{_QUOTED}|{_BACKTICK}"
# What begins a comment and what hides one, by the extension of the file.
SCANS = {
    ("py",): rf"(?P<c>#[^\n]*)|{_LONG}|{_QUOTED}",
    ("sql",): rf"(?P<c>--[^\n]*|{_BLOCK})|{_QUOTED}",
    ("js", "mjs", "ts", "jsx", "tsx"): rf"{_C_LIKE}|{_REGEX}",
    ("java", "c", "cc", "cpp", "h", "hpp", "cs", "go", "rs", "swift", "php", "kt"): _C_LIKE,
}
_BY_EXTENSION = {e: re.compile(scan) for exts, scan in SCANS.items() for e in exts}
_MARKS = re.compile(r"^(?://|/\*|#+|--)|\*/$")


def plain_lines(text: str) -> str:
    """The text without byte order mark, each line ended by a line feed."""
    return text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")


def extension_of(path: str) -> str:
    return path.rpartition(".")[2].lower() if "." in path else ""


def comments(path: str, text: str) -> list[tuple[int, str]]:
    """Line and text of every line of a comment that is not blank; other extensions: what stands behind the first ``#``."""
    text = plain_lines(text)
    scan = _BY_EXTENSION.get(extension_of(path))
    out = []
    if scan is None:
        for n, line in enumerate(text.split("\n"), 1):
            said = line.partition("#")[2].strip()
            if said and not (n == 1 and line.startswith("#!")):
                out.append((n, said))
        return out
    line = seen = 0
    for m in scan.finditer(text):
        if m.lastgroup != "c":
            continue
        line += text.count("\n", seen, m.start())
        seen = m.start()
        for k, part in enumerate(_MARKS.sub("", m.group()).split("\n")):
            if part.strip():
                out.append((line + k + 1, part.strip()))
    return out


def masked(path: str, text: str, strings: bool = True) -> str:
    """The text of equal length and lines with its comments (and strings) blank."""
    text = plain_lines(text)
    scan = _BY_EXTENSION.get(extension_of(path))
    if scan is None:
        scan = _HASH if strings else _HASH_ONLY
    blank = lambda m: _NOT_BREAK.sub(" ", m.group()) if strings or m.lastgroup == "c" else m.group()
    return scan.sub(blank, text)


_NOT_BREAK = re.compile(r"[^\n]")
_HASH = re.compile(rf"(?P<c>#[^\n]*)|{_QUOTED}")
_HASH_ONLY = re.compile(rf"(?P<c>#(?!\{{)[^\n]*)|{_QUOTED}")
