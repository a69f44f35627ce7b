"""Symbols and lineage from source text: Python by its own parser, other languages by declaration patterns, SQL by table names.

Runs per file in Arrow batches. A file that cannot be read or parsed gives no rows and no failure.
"""

from __future__ import annotations

import ast
import re
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

SYMBOLS = "kind string, name string, class_name string, line_start int, line_end int, docstring string, bases array<string>, decorators array<string>, modifiers array<string>, is_main_guard boolean"


def python_symbols(text: str) -> list[tuple]:
    """Classes, functions and methods (not those inside functions): kind, name, class, lines, docstring, bases, decorators, modifiers, main guard."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text.removeprefix("\ufeff"))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
    guarded = {c.func.id for n in tree.body if isinstance(n, ast.If) and "__name__" in ast.dump(n.test) for c in ast.walk(n) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name)}
    out = []

    def visit(body, owner):
        for n in body:
            if isinstance(n, ast.ClassDef):
                out.append(("class", n.name, None, n.lineno, n.end_lineno, ast.get_docstring(n), [ast.unparse(b) for b in n.bases], ["@" + ast.unparse(x) for x in n.decorator_list], [], False))
                if owner is None:
                    visit(n.body, n.name)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "method" if owner else "function"
                out.append((kind, n.name, owner, n.lineno, n.end_lineno, ast.get_docstring(n), [], ["@" + ast.unparse(x) for x in n.decorator_list], ["async"] if isinstance(n, ast.AsyncFunctionDef) else [], owner is None and n.name in guarded))

    visit(tree.body, None)
    return out


def python_rows(path: str, text: str) -> list[tuple]:
    return python_symbols(text)


# Declarations at the start of a line: the pattern's groups are the names of classes and of functions.
DECLARATIONS = {
    ("js", "mjs", "ts"): r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?(?:class[ \t]+(\w+)|(?:async[ \t]+)?function\*?[ \t]+(\w+))",
    ("java",): r"^[ \t]*(?:(?:public|private|protected|static|final|abstract)[ \t]+)*(?:(?:class|interface|enum|record)[ \t]+(\w+)|[\w<>\[\]]+[ \t]+(\w+)\([^;]*\{)",
    ("cs",): r"^[ \t]*(?:(?:public|private|protected|internal|static|sealed|abstract|partial)[ \t]+)+(?:(?:class|interface|struct|enum|record)[ \t]+(\w+)|[\w<>\[\]]+[ \t]+(\w+)\([^;]*$)",
    ("go",): r"^(?:type[ \t]+(\w+)[ \t]+(?:struct|interface)|func[ \t]+(?:\([^)]*\)[ \t]*)?(\w+))",
    ("rs",): r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:struct|enum|trait)[ \t]+(\w+)|(?:async[ \t]+)?(?:unsafe[ \t]+)?fn[ \t]+(\w+))",
    ("c", "h"): r"^(?:typedef[ \t]+)?(?:struct[ \t]+(\w+)[ \t]*\{|(?:static[ \t]+|inline[ \t]+)*[A-Za-z_]\w*[ \t*]+(\w+)\([^;]*$)",
    ("rb",): r"^[ \t]*(?:(?:class|module)[ \t]+(\w+)|def[ \t]+(?:self\.)?(\w+[?!=]?))",
}


def declarations(path: Column, content: Column) -> Column:
    """Line, kind and name of the declarations of other languages, as an array; null for other files. It stays in the JVM."""
    ext = T.extension(path)

    def found(pattern: str) -> Column:
        def one(x: Column) -> Column:
            holder, function = F.regexp_extract(x["text"], pattern, 1), F.regexp_extract(x["text"], pattern, 2)
            return F.struct(x["n"].alias("line"), F.when(holder != "", "class").otherwise("function").alias("kind"), F.when(holder != "", holder).otherwise(function).alias("name"))

        hits = F.filter(T.numbered(T.lines(content)), lambda x: x["text"].rlike(pattern))
        return F.filter(F.transform(hits, one), lambda x: ~x["name"].isin("", "if", "for", "while", "switch", "catch", "else"))

    out = F.lit(None)
    for exts, pattern in DECLARATIONS.items():
        out = F.when(ext.isin(*exts), found(pattern)).otherwise(out)
    return out


STATEMENTS = "ordinal int, kind string, writes array<string>, reads array<string>, columns array<string>"
_SQL_TOKEN = re.compile(r"--[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|(?P<keep>'(?:[^']|'')*'|\"[^\"\n]*\"|`[^`\n]*`)|(?P<end>;)")
_NAME = r"((?:[A-Za-z_]\w*|\"[^\"\n]+\"|`[^`\n]+`)(?:\.(?:[A-Za-z_]\w*|\"[^\"\n]+\"|`[^`\n]+`))*)"
_WRITES = re.compile(rf"(?i)\b(?:insert\s+(?:or\s+\w+\s+)?into|merge\s+into|create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:materialized\s+)?(?:table|view)(?:\s+if\s+not\s+exists)?|^\s*update|delete\s+from)\s+{_NAME}")
_NO_ALIAS = r"(?!(?:where|join|on|group|order|set|left|right|inner|outer|full|cross|natural|having|limit|union|intersect|except|select|values|using|when|returning|for|window|fetch|offset)\b)"
_READS = re.compile(rf"(?i)\b(?:from|join|using)\s+(?!\s*select\b){_NAME}(?P<more>(?:\s+(?:as\s+)?{_NO_ALIAS}\w+)?(?:\s*,\s*{_NAME}(?:\s+(?:as\s+)?{_NO_ALIAS}\w+)?)*)")
_WITH = re.compile(r"(?i)(?:\bwith\s+(?:recursive\s+)?|\)\s*,\s*)([A-Za-z_]\w*)\s*(?:\([^()]*\)\s*)?as\s*(?:(?:not\s+)?materialized\s*)?\(")
_COLUMN = re.compile(r"(?i)\bas\s+\w+|(?<![\w.:@$])([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)(?!\s*\(|[\w.])")
_SOURCE = re.compile(rf"(?i)\b(?:from|join|into|update|table|view)\s+{_NAME}(?:\s+(?:as\s+)?{_NO_ALIAS}\w+)?")
_EXPRESSIONS = re.compile(r"(?is)\b(?:select|where|set|on|having)\b.*")
# Words of statements that are no columns.
_SQL_WORDS = frozenset("select from where group by having order limit offset union intersect except all distinct insert into values update set delete create table view as and or not in is null like ilike between exists case when then else end join inner left right full outer cross on using asc desc over partition rows range unbounded preceding following current row true false with recursive default returning conflict do nothing nulls first last interval date timestamp".split())


def _sql_parts(text: str) -> list[str]:
    """Statements without comments, their string literals emptied; a semicolon within a string ends none."""
    parts, at = [""], 0
    for m in _SQL_TOKEN.finditer(text):
        parts[-1] += text[at : m.start()]
        at = m.end()
        if m["end"]:
            parts.append("")
        else:
            parts[-1] += "''" if (m["keep"] or "").startswith("'") else m["keep"] or " "
    parts[-1] += text[at:]
    return [p for p in parts if p.strip()]


def sql_rows(path: str, text: str) -> list[tuple]:
    """Ordinal, kind, tables written and read (common table expressions are none), and columns that expressions name, as often as they do."""
    out = []
    for n, part in enumerate(_sql_parts(text.removeprefix("\ufeff"))):
        bare = lambda x: x.replace('"', "").replace("`", "")
        own = {m.lower() for m in _WITH.findall(part)} if re.search(r"(?i)\bwith\b", part) else set()
        writes = list(dict.fromkeys(bare(m) for m in _WRITES.findall(part)))
        reads = []
        for m in _READS.finditer(part):
            reads += [m[1], *re.findall(rf",\s*{_NAME}", m["more"] or "")]
        reads = [r for r in dict.fromkeys(map(bare, reads)) if r.lower() not in own]
        kind = re.match(r"\s*\(*\s*(\w*)", part)[1].upper()
        said = _EXPRESSIONS.search(part)
        columns = [c for c in _COLUMN.findall(_SOURCE.sub(" ", said.group())) if c and c.lower() not in _SQL_WORDS] if said else []
        out.append((n, kind, writes, [*reads, *(w for w in writes if w not in reads)], columns))
    return out
