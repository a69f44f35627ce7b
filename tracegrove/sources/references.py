"""Imports and calls as they stand in a source file, read from its text without comments (and, for calls, without strings).

An import's candidates say what it may stand for, in order of preference, as keys of ``operators.resolve.path_index``.
"""

from __future__ import annotations

import re

from ..functions.comments import extension_of, masked

IMPORTS = "seq int, raw string, names array<string>, aliases map<string,string>, is_star boolean, candidates array<string>"
# Suffixes of script files, source roots of Java and Kotlin, suffixes of headers.
SCRIPT_SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".d.ts", ".mts", ".cts"]
SOURCE_ROOTS = ["src/main/java", "src/test/java", "src/main/kotlin", "src/test/kotlin", "app/src/main/java", "app/src/test/java", "app/src/main/kotlin", "app/src/test/kotlin"]
HEADER_SUFFIXES = [".h", ".hpp", ".hh", ".hxx"]
CALLS = "seq int, line int, callee string, receiver string"

_PY = re.compile(r"^[ \t]*(?:import[ \t]+(?P<mods>[^\n;]+)|from[ \t]+(?P<module>\.*[ \t]*[\w.]*)[ \t]+import[ \t]+(?P<names>\([^)]*\)|[^\n;]+))", re.M)
_SCRIPT = re.compile(r"^[ \t]*(?:import|export)\b(?P<clause>[^\"'`;=()]*?)[\"'](?P<raw>[^\"'\n]+)[\"']|\b(?:require|import)[ \t]*\([ \t]*[\"'](?P<call>[^\"'\n]+)[\"'][ \t]*\)", re.M)
_JAVA = re.compile(r"^[ \t]*import[ \t]+(?:static[ \t]+)?(?P<raw>[\w.]+(?:\.\*)?)(?:[ \t]+as[ \t]+(?P<alias>\w+))?[ \t]*;?[ \t]*$", re.M)
_GO = re.compile(r"^import[ \t]*(?:\((?P<group>[^)]*)\)|(?P<one>[^\n(]+))", re.M)
_GO_SPEC = re.compile(r"(?:(?P<alias>\w+|\.)[ \t]+)?\"(?P<raw>[^\"\n]+)\"")
_RUST = re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:use[ \t]+(?P<tree>[^;]+);|mod[ \t]+(?P<mod>\w+)[ \t]*;)", re.M)
_C = re.compile(r"^[ \t]*#[ \t]*include[ \t]*(?:\"(?P<quoted>[^\"\n]+)\"|(?P<angle><[^>\n]+>))", re.M)
_CSHARP = re.compile(r"^[ \t]*(?:global[ \t]+)?using[ \t]+(?:static[ \t]+)?(?:(?P<alias>\w+)[ \t]*=[ \t]*)?(?P<raw>[A-Za-z_][\w.]*)[ \t]*;", re.M)
_RUBY = re.compile(r"^[ \t]*require_relative[ \t(]*[\"'](?P<raw>[^\"'\n]+)[\"']", re.M)

Import = tuple[str, list[str], dict[str, str], bool]


def _named(text: str) -> tuple[list[str], dict[str, str], bool]:
    """Names, aliases and whether all is meant, of a list like ``a, b as c``."""
    names, aliases = [], {}
    for part in text.strip("() \t\n{}").split(","):
        words = part.split()
        if words[:1] == ["type"] and len(words) > 1:
            words = words[1:]
        if words and re.fullmatch(r"[\w$.:]+", words[0]):
            names.append(words[0])
            if len(words) == 3 and words[1] == "as":
                aliases[words[0]] = words[2]
    return names, aliases, "*" in text


def _python(m: re.Match) -> list[Import]:
    if m["mods"] is not None:
        names, aliases, _ = _named(m["mods"])
        return [(n, [], {n: aliases[n]} if n in aliases else {}, False) for n in names]
    names, aliases, star = _named(m["names"])
    return [(m["module"].replace(" ", ""), names, aliases, star)]


def _script(m: re.Match) -> list[Import]:
    if m["call"] is not None:
        return [(m["call"], [], {}, False)]
    clause = re.sub(r"\bfrom\b\s*$", "", m["clause"])
    space = re.search(r"\*\s*as\s+([\w$]+)", clause)
    names, aliases, _ = _named(clause.partition("{")[2].partition("}")[0])
    return [(m["raw"], names, aliases | ({m["raw"]: space[1]} if space else {}), "*" in clause and not space)]


def _go(m: re.Match) -> list[Import]:
    specs = _GO_SPEC.finditer(m["group"] if m["group"] is not None else m["one"])
    return [(s["raw"], [], {s["raw"]: s["alias"]} if s["alias"] and s["alias"] not in (".", "_") else {}, s["alias"] == ".") for s in specs]


def _rust(m: re.Match) -> list[Import]:
    if m["mod"]:
        return [(m["mod"], [], {}, False)]
    path, brace, inside = "".join(m["tree"].split(" as ")[0].split()).partition("{")
    alias = re.search(r"\bas\s+(\w+)\s*$", m["tree"])
    star = path.endswith("*") or inside.startswith("*")
    path = path.rstrip("*").rstrip(":")
    if not brace:
        return [(path, [], {path: alias[1]} if alias else {}, star)]
    names, aliases, _ = _named(re.sub(r"\w+::|\{|\}", "", m["tree"].partition("{")[2]))
    return [(path, [n for n in names if n != "self"], aliases, star)]


_LANGUAGES = {
    ("py",): (_PY, _python), ("js", "mjs", "ts", "jsx", "tsx"): (_SCRIPT, _script), ("go",): (_GO, _go), ("rs",): (_RUST, _rust),
    ("java", "kt"): (_JAVA, lambda m: [(m["raw"], [], {m["raw"]: m["alias"]} if m["alias"] else {}, m["raw"].endswith(".*"))]),
    ("c", "h", "cc", "cpp", "hpp"): (_C, lambda m: [(m["quoted"] or m["angle"], [], {}, False)]),
    ("cs",): (_CSHARP, lambda m: [(m["raw"], [], {m["raw"]: m["alias"]} if m["alias"] else {}, False)]),
    ("rb",): (_RUBY, lambda m: [(m["raw"], [], {}, False)]),
}
_READERS = {e: reader for exts, reader in _LANGUAGES.items() for e in exts}


def _plain(*parts: str) -> str:
    """The joined path without empty parts, ``.`` and ``..``."""
    done: list[str] = []
    for p in "/".join(parts).split("/"):
        if p == "..":
            done[-1:] = []
        elif p not in ("", "."):
            done.append(p)
    return "/".join(done)


def _script_at(root: str, here: str, raw: str) -> list[str]:
    if not raw.startswith((".", "/")):
        return []
    base = _plain(root if raw.startswith("/") else here, raw)
    if "." in base.rpartition("/")[2].lstrip(".") and not raw.endswith("/"):
        return [f"file:{base}"]
    return [f"file:{base}{s}" for s in SCRIPT_SUFFIXES] + [f"file:{base}/index{s}" for s in SCRIPT_SUFFIXES]


def _python_at(root: str, here: str, raw: str) -> list[str]:
    name = raw.lstrip(".")
    ups = len(raw) - len(name)
    tops = [_plain(here, *[".."] * (ups - 1))] if ups else [root, here]
    return [f"file:{_plain(t, name.replace('.', '/'))}{s}" for t in tops for s in (".py", "/__init__.py")]


def _java_at(root: str, here: str, raw: str) -> list[str]:
    roots = [f"{root}/{r}" for r in SOURCE_ROOTS] + [root]
    if raw.endswith(".*"):
        return [f"folder:java|{r}/{raw[:-2].replace('.', '/')}" for r in roots]
    name = raw.replace(".", "/")
    return [f"file:{r}/{name}{s}" for r in roots for s in (".java", ".kt", ".kts")] + [f"end:{root}|{name}{s}" for s in (".java", ".kt", ".kts")]


def _go_at(root: str, here: str, raw: str) -> list[str]:
    return [f"folder:go|{_plain(here, raw)}"] if raw.startswith(("./", "../")) else [f"module:{root}|{raw}"]


def _rust_at(root: str, here: str, raw: str) -> list[str]:
    first, _, rest = raw.partition("::")
    base = {"crate": f"{root}/src", "self": here, "super": here.rpartition("/")[0]}.get(first, f"{root}/src" if rest else here)
    parts = (rest if first in ("crate", "self", "super") else raw).split("::")
    ways = [parts, parts[:-1]] if len(parts) > 1 else [parts]
    return [f"file:{_plain(base, *w)}{s}" for w in ways for s in (".rs", "/mod.rs")]


def _c_at(root: str, here: str, raw: str) -> list[str]:
    name = raw.strip("<>")
    folders = [f"{root}/include", f"{root}/src", root, here] if raw.startswith("<") else [here, f"{root}/src", f"{root}/include", root]
    suffixes = [""] if "." in name.rpartition("/")[2] else ["", *HEADER_SUFFIXES]
    return [f"file:{_plain(f, name)}{s}" for s in suffixes for f in folders]


def _csharp_at(root: str, here: str, raw: str) -> list[str]:
    return [f"folder:cs|{_plain(root, s, raw.replace('.', '/'))}" for s in ("", "src", "Source")] + [f"end:{root}|{raw.rpartition('.')[2]}.cs"]


_PLACES = {
    ("py",): _python_at, ("js", "mjs", "ts", "jsx", "tsx"): _script_at, ("go",): _go_at, ("rs",): _rust_at, ("java", "kt"): _java_at, ("c", "h", "cc", "cpp", "hpp"): _c_at, ("cs",): _csharp_at,
    ("rb",): lambda root, here, raw: [f"file:{_plain(here, raw.removesuffix('.rb'))}.rb"],
}
_CANDIDATES = {e: place for exts, place in _PLACES.items() for e in exts}


def imports(path: str, text: str) -> list[tuple]:
    """seq, raw, names, aliases, whether everything is imported, and candidates, in the order of the text."""
    ext = extension_of(path)
    if ext not in _READERS:
        return []
    pattern, read = _READERS[ext]
    root, here = path.partition("/")[0] if "/" in path else "", path.rpartition("/")[0]
    found = [i for m in pattern.finditer(masked(path, text, strings=False)) for i in read(m)]
    return [(n, *i, _CANDIDATES[ext](root, here, i[0])) for n, i in enumerate(found)]


_CALL = re.compile(r"(?P<before>\b(?:def|func|function|fn|class|new|interface|struct|enum|record)[ \t]+)?(?P<path>(?:[A-Za-z_$][\w$]*(?:\?\.|\.|::|->))*)(?P<name>[A-Za-z_$][\w$]*[?!]?)[ \t]*\(")
# Words that stand before a parenthesis and are no calls.
_NO_CALLS = frozenset("if for while switch return catch elif else except and or not in is with assert lambda yield await match case func fn def function sizeof typeof instanceof when unless until using lock fixed synchronized range throw raise del print_if do try defer go select".split())
_CALLING = frozenset("py js mjs ts jsx tsx java kt go rs c h cc cpp hpp cs rb php swift".split())


def calls(path: str, text: str) -> list[tuple]:
    """seq, line, callee and receiver (the name before the last dot) of every call ``f(``, ``a.f(``, ``A::f(``."""
    if extension_of(path) not in _CALLING:
        return []
    text = masked(path, text)
    out, line, seen = [], 1, 0
    for m in _CALL.finditer(text):
        if m["name"] in _NO_CALLS and not m["path"] or m["before"] and not m["before"].startswith("new"):
            continue
        line += text.count("\n", seen, m.start("name"))
        seen = m.start("name")
        owner = re.findall(r"[\w$]+", m["path"])
        out.append((len(out), line, m["name"], owner[-1] if owner else None))
    return out
