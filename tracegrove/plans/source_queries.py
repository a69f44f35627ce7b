"""Extraction and link resolution over the files as they stand, hashes, spans, folders, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import resolve
from ..operators.relational import positions
from ..session import cut
from ..sources import extract, references, scan
from ..sources.tables import table
from .base import all_edges, edges, file_facts, file_rows, files, functions, nodes, sql
from .graph_queries import path_of

PROJECT_RULES = ["static/", "vendor*/", "*.g.cs", "!vendor*/keep/"]  # a project's own ignore rules


def content_hashes(spark, d):
    """Whether stored hashes hold, per repository; case does not matter, null hashes are counted apart."""
    rows = file_facts(spark, d, sha=F.sha2("content", 256), stored=F.lower("content_hash")).where("sha is not null")
    return rows.groupBy(F.split("relative_path", "/")[0].alias("repository")).agg(F.count("*").alias("n"), F.count("stored").alias("hashed"), F.coalesce(F.sum((F.col("sha") == F.col("stored")).cast("long")), F.lit(0)).alias("right"))


def short_hashes(spark, d):
    return nodes(spark, d, "node_type", "name").where("node_type = 'table'").select("id", F.substring(F.md5("name"), 1, 10).alias("md5"), F.substring(F.sha1("name"), 1, 12).alias("sha1"))


def duplicate_contents(spark, d):
    """Contents that several files share; one row per content."""
    rows = file_facts(spark, d, hash=F.when(F.col("content") != "", F.sha2("content", 256))).where("hash is not null")
    return rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("relative_path").alias("first")).where("n > 1")


def ignore_filter(spark, d):
    """Files that the default rules, a project's own and its exceptions leave, per extension."""
    rows = files(spark, d, "mtime").where(~scan.ignored(F.col("relative_path"), [*scan.IGNORED, *PROJECT_RULES]))
    return rows.groupBy(T.extension(F.col("relative_path")).alias("ext")).agg(F.count("*").alias("n"))


def read_span_first_lines(spark, d):
    """Length and hash of lines 2 to 6 of every file."""
    span = scan.span(F.col("content"), 6, 2)
    return file_facts(spark, d, chars=F.length(span), md5=F.md5(span)).where("chars is not null")


def read_span_context(spark, d):
    """Lines 5 to 3 of every file with two lines around them, at most 120 bytes: first line, whether cut, and if not, bytes and hash."""
    got = scan.span_bytes(F.col("content"), 5, 3, 2, 120)
    rows = file_facts(spark, d, s=F.when(F.col("content").isNotNull(), F.struct(got["base_line"].alias("base_line"), got["truncated"].alias("truncated"), F.when(~got["truncated"], F.octet_length(got["content"])).alias("n_bytes"), F.when(~got["truncated"], F.md5(got["content"])).alias("md5"))))
    return rows.where("s is not null").select("relative_path", "s.*")


def read_file_numbered(spark, d):
    """Every file with its lines numbered, and raw up to a number of bytes: lengths and hashes."""
    text, raw = scan.numbered_file(F.col("content")), scan.raw_file(F.col("content"), 400)
    rows = file_facts(spark, d, s=F.when(F.col("content").isNotNull(), F.struct(F.length(text).alias("chars"), F.md5(text).alias("md5"), F.octet_length(raw["content"]).alias("raw_bytes"), raw["truncated"].alias("truncated"))))
    return rows.where("s is not null").select("relative_path", "s.*")


def list_directory(spark, d):
    """Entries of every folder."""
    return scan.list_directory(files(spark, d, "mtime")).groupBy("folder").agg(F.sum(F.col("is_file").cast("long")).alias("files"), F.sum((~F.col("is_file")).cast("long")).alias("folders"))


def python_extract(spark, d):
    """Symbols read from Python files."""
    found = file_rows(spark, d, extract.python_rows, extract.SYMBOLS, "py").withColumnRenamed("relative_path", "path")
    return found.select("path", "kind", "name", "class_name", "line_start", "line_end", F.col("docstring").isNotNull().alias("documented"))


def declarations_extract(spark, d):
    """Classes and functions of the other languages with the line they start on."""
    rows = file_facts(spark, d, found=extract.declarations(F.col("relative_path"), F.col("content")))
    rows = rows.select(F.col("relative_path").alias("path"), T.extension(F.col("relative_path")).alias("ext"), F.explode("found").alias("f"))
    return rows.select("path", "ext", "f.line", "f.kind", "f.name")


def symbols_per_language(spark, d):
    found = declarations_extract(spark, d).select("ext", "kind")
    python = python_extract(spark, d).select(F.lit("py").alias("ext"), F.when(F.col("kind") == "class", "class").otherwise("function").alias("kind"))
    return found.unionByName(python).groupBy("ext", "kind").agg(F.count("*").alias("n"))


def sql_lineage(spark, d):
    """Statements with what they write and read."""
    rows = _sql_statements(spark, d)
    return rows.select("path", "ordinal", "kind", F.array_join(F.array_sort("writes"), ",").alias("writes"), F.array_join(F.array_sort("reads"), ",").alias("reads"))


def _sql_statements(spark, d):
    rows = file_rows(spark, d, extract.sql_rows, extract.STATEMENTS, "sql")
    return rows.withColumnRenamed("relative_path", "path")


def sql_column_references(spark, d):
    """Columns that the expressions of statements name, and how often."""
    rows = _sql_statements(spark, d).select("path", "ordinal", F.explode("columns").alias("column"))
    return rows.groupBy("path", "ordinal", "column").agg(F.count("*").alias("n"))


def _imports(spark, d):
    return file_rows(spark, d, references.imports, references.IMPORTS).withColumnRenamed("relative_path", "path")


def _modules(spark, d):
    """The module that each root's ``go.mod`` declares."""
    name = F.regexp_extract("content", r"(?m)^module[ \t]+(\S+)", 1)
    rows = file_facts(spark, d, module=F.when(F.col("relative_path").rlike(r"^[^/]+/go\.mod$"), name))
    return rows.where("module <> ''").select(F.split("relative_path", "/")[0].alias("root"), "module")


def import_statements(spark, d):
    """Imports per language, and how many different things they name."""
    return _imports(spark, d).groupBy(T.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"), F.countDistinct("raw").alias("names"))


def _resolved(spark, d):
    paths = table(spark, d, "files").where("relative_path is not null").select(F.col("relative_path").alias("path")).distinct()
    return resolve.resolve_imports(_imports(spark, d), paths, _modules(spark, d))


def import_resolution(spark, d):
    """Every import with the file it stands for, null where the project has none."""
    return _resolved(spark, d).select("path", "seq", "raw", "target")


def import_edges_by_kind(spark, d):
    """Resolved imports as edges: to symbols, to files whose symbol is missing, of everything, of modules; and how many have an alias."""
    found = resolve.import_edges(_resolved(spark, d), nodes(spark, d, "name", "file_path", "node_seq"))
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.count("alias").alias("aliased"))


def _import_links(spark, d):
    """What the files of the graph import: file, seq, symbol or at, alias."""
    e = all_edges(spark, d, "metadata").where("edge_type = 'imports' and src like 'file::%' and dst is not null")
    is_file = F.col("dst").startswith("file::")
    bare = lambda c: F.substring(c, 7, 1_000_000)
    return e.select(bare("src").alias("file"), F.col("edge_seq").alias("seq"), F.when(~is_file, F.col("dst")).alias("symbol"), F.when(is_file, bare("dst")).alias("at"), F.col("metadata")["module_alias"].alias("alias"))


def _calls(spark, d):
    known = functions(spark, d, "name", "file_path", "class_name", "line_start", "line_end")
    found = file_rows(spark, d, references.calls, references.CALLS).withColumnRenamed("relative_path", "path")
    return resolve.calling_functions(found, known), known


def call_statements(spark, d):
    """Calls per function."""
    calls, _ = _calls(spark, d)
    return calls.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("calls"), F.countDistinct("callee").alias("callees"))


def call_resolution_cascade(spark, d):
    """Calls with the function they mean, by the first of five tiers that has one."""
    calls, known = _calls(spark, d)
    return resolve.resolve_calls(calls, known, _import_links(spark, d))


def cross_file_inheritance(spark, d):
    """Bases of classes and what they resolve to (null: nothing that is known)."""
    classes = nodes(spark, d, "node_type", "name", "file_path", "bases", "node_seq").where("node_type = 'class'")
    at = nodes(spark, d, "file_path", "relative_path").select("id", path_of().alias("file"))
    links = edges(spark, d, "imports").join(at.select(F.col("id").alias("src"), F.col("file").alias("src_file")), "src").join(at.select(F.col("id").alias("dst"), F.col("file").alias("dst_file")), "dst").select("src_file", "dst_file")
    had = edges(spark, d, "inherits").join(classes.select(F.col("id").alias("dst"), "name"), "dst").select("src", "name")
    return resolve.resolve_bases(classes, links, had)


def debounce_sessions(spark, d):
    """Bursts of events per user: a gap of a minute or more ends one."""
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    # Neighbours meet by place, so that no task holds a user whole.
    placed = cut(positions(rows, "user_id", ["ts", "event_id"]).select("user_id", "pos", "us"))
    before = placed.select("user_id", (F.col("pos") + 1).alias("pos"), F.col("us").alias("before"))
    starts = placed.join(before, ["user_id", "pos"], "left").where(F.col("before").isNull() | (F.col("us") - F.col("before") >= 60_000_000)).select("user_id", "pos", F.col("us").alias("first_us"))
    starts = cut(positions(starts, "user_id", ["pos"], "session"))
    ends = placed.groupBy("user_id").agg(F.max("pos").alias("final"))
    nexts = starts.select("user_id", (F.col("session") - 1).alias("session"), (F.col("pos") - 1).alias("stop"))
    spans = starts.join(nexts, ["user_id", "session"], "left").join(ends, "user_id").withColumn("stop", F.coalesce("stop", "final"))
    last = placed.select("user_id", F.col("pos").alias("stop"), F.col("us").alias("last_us"))
    return spans.join(last, ["user_id", "stop"]).select("user_id", F.col("session").cast("long").alias("session"), (F.col("stop") - F.col("pos") + 1).cast("long").alias("events"), "first_us", "last_us")


def dangling_counts(spark, d):
    """Edges lost per type when ends that do not live are dropped."""
    kept = edges(spark, d).groupBy("edge_type").agg(F.count("*").alias("kept"))
    every = all_edges(spark, d).groupBy("edge_type").agg(F.count("*").alias("n"))
    return every.join(kept, "edge_type", "left").select("edge_type", "n", F.coalesce("kept", F.lit(0)).alias("kept"))


def markdown_reports(spark, d):
    """A line of text per repository: files, symbols and documented symbols."""
    known = nodes(spark, d, "node_type", "docstring", "file_path").where("file_path is not null")
    rows = known.groupBy(F.split("file_path", "/")[0].alias("repository")).agg(F.sum((F.col("node_type") == "file").cast("long")).alias("f"), F.sum(F.col("node_type").isin("class", "function", "method").cast("long")).alias("s"), F.count("docstring").alias("k"))
    return rows.select("repository", F.concat(F.lit("- **"), "repository", F.lit("**: "), F.col("f").cast("string"), F.lit(" files, "), F.col("s").cast("string"), F.lit(" symbols, "), F.col("k").cast("string"), F.lit(" documented")).alias("line"))


QUERIES = {
    f.__name__: f
    for f in (
        content_hashes, short_hashes, duplicate_contents, ignore_filter, read_span_first_lines, read_span_context, read_file_numbered, list_directory, python_extract, declarations_extract, symbols_per_language,
        sql_lineage, sql_column_references, import_statements, import_resolution, import_edges_by_kind, call_statements, call_resolution_cascade, cross_file_inheritance, debounce_sessions, dangling_counts, markdown_reports,
    )
}

_EXT = r"lower(regexp_extract(relative_path, '\.([A-Za-z0-9]+)$', 1))"
_LINES = r"regexp_split_to_array(regexp_replace(regexp_replace(content, '\r\n|\r', chr(10), 'g'), '\n$', ''), '\n')"
_SQLS = r"""st as (select path, o - 1 as ordinal, text from (select path, unnest(ps) as text, generate_subscripts(ps, 1) as o from (select relative_path as path, list_filter(string_split(regexp_replace(regexp_replace(content, '--[^\r\n]*', '', 'g'), '/\*[\s\S]*?\*/', '', 'g'), ';'), lambda x: not regexp_full_match(x, '\s*')) as ps from cf where lower(regexp_extract(relative_path, '\.([A-Za-z0-9]+)$', 1)) = 'sql' and content is not null))),
sx as (select path, ordinal, upper(regexp_extract(text, '^\s*(\w+)', 1)) as kind, list_distinct(regexp_extract_all(text, '(?i)\b(?:insert\s+into|create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view)(?:\s+if\s+not\s+exists)?|update|delete\s+from)\s+([A-Za-z_][\w.]*)', 1)) as w, regexp_extract_all(text, '(?i)\b(?:from|join)\s+([A-Za-z_][\w.]*)', 1) as r from st)"""

_DECLS = "dc0 as (select relative_path as path, " + _EXT + " as ext, unnest(ls) as t, generate_subscripts(ls, 1) as line from (select relative_path, " + _LINES + " as ls from cf where content is not null)), dc1 as (select path, ext, cast(line as integer) as line, case " + " ".join("when ext in (" + ", ".join(f"'{e}'" for e in exts) + f") then regexp_extract(t, '{p}', ['holder', 'fn'])" for exts, p in extract.DECLARATIONS.items()) + " end as g from dc0), dc as (select path, ext, line, case when g.holder <> '' then 'class' else 'function' end as kind, case when g.holder <> '' then g.holder else g.fn end as name from dc1 where g is not null and (g.holder <> '' or g.fn not in ('', 'if', 'for', 'while', 'switch', 'catch', 'else')))"
_Q = r"\"(?:[^\"\\\n]|\\[\s\S])*\"|''(?:[^''\\\n]|\\[\s\S])*''"
_CALL = r"(?:(?:def|func|function|fn|class|new|interface|struct|enum|record)[ \t]+)?(?:[A-Za-z_$][\w$]*(?:\?\.|\.|::|->))*[A-Za-z_$][\w$]*[?!]?[ \t]*\(|[\w$]+|[\s\S]"
_SCANS = {
    "py": rf'"""[\s\S]*?"""|{"'" * 6}[\s\S]*?{"'" * 6}|#[^\n]*|{_Q}|{_CALL}', "rb": rf"#[^\n]*|{_Q}|{_CALL}",
    "c": rf"//[^\n]*|/\*[\s\S]*?\*/|{_Q}|`(?:[^`\\]|\\[\s\S])*`|{_CALL}",
}
_NOT_CALLED = "'" + "', '".join(sorted(references._NO_CALLS)) + "'"
_CALLS = rf"""ct as (select path, unnest(ts) as tok, generate_subscripts(ts, 1) as k from (select relative_path as path, case when ext = 'py' then regexp_extract_all(t, '{_SCANS["py"]}') when ext = 'rb' then regexp_extract_all(t, '{_SCANS["rb"]}') else regexp_extract_all(t, '{_SCANS["c"]}') end as ts
  from (select relative_path, {_EXT} as ext, regexp_replace(regexp_replace(content, '\r\n|\r', chr(10), 'g'), '^\x{{FEFF}}', '') as t from cf where content is not null and {_EXT} in ('py', 'rb', 'js', 'mjs', 'ts', 'java', 'go', 'rs', 'c', 'h', 'cs')))),
cu as (select *, cast(1 + coalesce(sum(length(tok) - length(replace(tok, chr(10), ''))) over (partition by path order by k rows between unbounded preceding and 1 preceding), 0) as integer) as line from ct),
cv as (select path, k, line, regexp_extract(tok, '([A-Za-z_$][\w$]*[?!]?)[ \t]*\($', 1) as callee, nullif(regexp_extract(tok, '([\w$]+)(?:\?\.|\.|::|->)[A-Za-z_$][\w$]*[?!]?[ \t]*\($', 1), '') as receiver, tok from cu
  where regexp_matches(tok, '^[A-Za-z_$][^"''#]*\($') and not regexp_matches(tok, '^(?:def|func|function|fn|class|interface|struct|enum|record)[ \t]')),
cw as (select * from cv where not (receiver is null and callee in ({_NOT_CALLED}))),
fs as (select id, name, class_name, file_path, line_start, line_end from cn where node_type in ('function', 'method') and line_start >= 1 and line_end >= line_start),
cx as (select * from (select cw.*, fs.id as source, fs.name as own, fs.class_name, fs.line_start, row_number() over (partition by path, k order by line_end - line_start, fs.id) rn from cw join fs on fs.file_path = cw.path and cw.line between line_start and line_end) where rn = 1 and not (line = line_start and callee = own))"""
_TIERS = """li as (select substr(src, 7) as file, edge_seq as seq, case when dst not like 'file::%' then dst end as symbol, case when dst like 'file::%' then substr(dst, 7) end as at_, al from
  (select edge_seq, min(src) src, min(dst) dst, min(edge_type) et, any_value(metadata['module_alias']) as al from edges where edge_seq is not null group by 1) where et = 'imports' and src like 'file::%' and dst is not null),
aq as (select distinct source, callee, receiver, path as file, class_name from cx), kn as (select id, name as callee, file_path as at_, class_name as owner from cn where node_type in ('function', 'method')),
inf as (select at_, callee, count(*) n, min(id) target from kn where at_ is not null group by 1, 2), inc as (select at_, owner, callee, count(*) n, min(id) target from kn where owner is not null group by 1, 2, 3), ofc as (select owner, callee, count(*) n, min(id) target from kn where owner is not null group by 1, 2),
t as (select source, aq.callee, receiver, 1 as tier, seq, kn.id as target from aq join li on li.file = aq.file join kn on kn.id = li.symbol and kn.callee = aq.callee
 union all select source, aq.callee, receiver, 1, seq, case when inf.n = 1 or al = receiver then inf.target when inc.n = 1 then inc.target end from aq join li on li.file = aq.file join inf on inf.at_ = li.at_ and inf.callee = aq.callee left join inc on inc.at_ = li.at_ and inc.owner = receiver and inc.callee = aq.callee
 union all select source, aq.callee, receiver, 2, 0, u.target from aq join (select callee, min(id) target from kn group by 1 having count(*) = 1) u on u.callee = aq.callee
 union all select source, aq.callee, receiver, 3, 0, target from aq join inf on inf.at_ = aq.file and inf.callee = aq.callee where n = 1
 union all select source, aq.callee, receiver, 4, 0, target from aq join ofc on ofc.owner = aq.class_name and ofc.callee = aq.callee where n = 1
 union all select source, aq.callee, receiver, 5, 0, target from aq join ofc on ofc.owner = aq.receiver and ofc.callee = aq.callee where n = 1)"""
_FIRST_IMPORT = {
    "js mjs ts": r"(?m)^[ \t]*(?:import|export)[ \t][^\"''`;=()]*[\"'']([^\"''\n]+)[\"'']", "py": r"(?m)^[ \t]*(?:import|from)[ \t]+([\w.]+)", "java": r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+(?:\.\*)?)[ \t]*;", "go": r"(?m)^import[ \t]+\"([^\"\n]+)\"",
    "rs": r"(?m)^[ \t]*(?:pub[ \t]+)?use[ \t]+([\w:]+)", "c h": r"(?m)^[ \t]*#[ \t]*include[ \t]*\"([^\"\n]+)\"", "cs": r"(?m)^[ \t]*using[ \t]+([\w.]+)[ \t]*;", "rb": r"(?m)^[ \t]*require_relative[ \t(]*[\"'']([^\"''\n]+)",
}


def _ext_in(names: str) -> str:
    return "ext in (" + ", ".join(f"'{e}'" for e in names.split()) + ")"


_IMPORTS = "im0 as (select relative_path as path, " + _EXT + r""" as ext, case """ + " ".join(f"when {_ext_in(e).replace('ext in', _EXT + ' in')} then regexp_extract_all(regexp_replace(regexp_replace(content, '\\r\\n|\\r', chr(10), 'g'), '^\\x{{FEFF}}', ''), '{p}', 1)" for e, p in _FIRST_IMPORT.items()) + """ end as raws from cf where content is not null),
im as (select path, ext, split_part(path, '/', 1) as root, regexp_extract(path, '^(.*)/[^/]*$', 1) as here, cast(generate_subscripts(raws, 1) - 1 as integer) as seq, unnest(raws) as raw from im0)"""
# Candidates of the import forms without dots that lead upwards.
_CANDIDATES = (
    "ca as (select path, seq, generate_subscripts(cs, 1) as prio, unnest(cs) as cand from (select *, case "
    + "when ext in ('js', 'mjs', 'ts') and not starts_with(raw, '.') then [] "
    + r"when ext in ('js', 'mjs', 'ts') and regexp_matches(raw, '[^./][^/]*\.[^./]+$') then [here || '/' || regexp_replace(raw, '^\./', '')] "
    + r"when ext in ('js', 'mjs', 'ts') then list_concat(list_transform(" + str(references.SCRIPT_SUFFIXES) + r", lambda x: here || '/' || regexp_replace(raw, '^\./', '') || x), list_transform(" + str(references.SCRIPT_SUFFIXES) + r", lambda x: here || '/' || regexp_replace(raw, '^\./', '') || '/index' || x)) "
    + "when ext = 'py' then [root || '/' || replace(raw, '.', '/') || '.py', root || '/' || replace(raw, '.', '/') || '/__init__.py', here || '/' || replace(raw, '.', '/') || '.py', here || '/' || replace(raw, '.', '/') || '/__init__.py'] "
    + "when ext in ('c', 'h') then [here || '/' || raw, root || '/src/' || raw, root || '/include/' || raw, root || '/' || raw] when ext = 'rb' then [here || '/' || raw || '.rb'] "
    + "when ext = 'rs' then list_concat([root || '/src/' || replace(regexp_replace(raw, '^crate::', ''), '::', '/') || '.rs', root || '/src/' || replace(regexp_replace(raw, '^crate::', ''), '::', '/') || '/mod.rs'], case when contains(regexp_replace(raw, '^crate::', ''), '::') then [root || '/src/' || regexp_extract(replace(regexp_replace(raw, '^crate::', ''), '::', '/'), '^(.*)/', 1) || '.rs'] else [] end) "
    + "else [] end as cs from im)), fo as (select distinct relative_path p, " + _EXT + " as ext from files where relative_path is not null), "
    + "cd as (select path, seq, prio, cand as target from ca join fo on p = cand "
    + "union all select path, seq, k, min(p) from (select im.*, unnest(range(9)) k from im where ext = 'java' and raw like '%.*') j join fo on fo.ext = 'java' and starts_with(p, root || '/' || list_value(" + ", ".join(f"'{r}/'" for r in references.SOURCE_ROOTS) + ", '')[k + 1] || replace(regexp_replace(raw, '\\.\\*$', ''), '.', '/') || '/') group by 1, 2, 3 "
    + "union all select path, seq, k, min(p) from (select im.*, unnest(range(3)) k from im where ext = 'cs') j join fo on fo.ext = 'cs' and starts_with(p, root || '/' || list_value('', 'src/', 'Source/')[k + 1] || replace(raw, '.', '/') || '/') group by 1, 2, 3 "
    + "union all select path, seq, 9, min(p) from im join fo on fo.ext = 'cs' and im.ext = 'cs' and starts_with(p, root || '/') and p like '%/' || regexp_extract(raw, '([^.]*)$', 1) || '.cs' group by 1, 2), rs as (select path, seq, arg_min(target, prio) target from cd group by 1, 2)"
)

ORACLES = {
    "import_statements": sql(f", {_IMPORTS} select ext, count(*) n, count(distinct raw) names from im group by 1"),
    "import_resolution": sql(f", {_IMPORTS}, {_CANDIDATES} select im.path, im.seq, im.raw, rs.target from im left join rs using (path, seq)"),
    "call_statements": sql(f", {_CALLS} select source as id, count(*) calls, count(distinct callee) callees from cx group by 1"),
    "call_resolution_cascade": sql(f", {_CALLS}, {_TIERS} select source, callee, receiver, target, tier from (select *, row_number() over (partition by source, callee, receiver order by tier, seq, target) rn from t where target is not null) where rn = 1"),
    "ignore_filter": r"select lower(regexp_extract(p, '\.([A-Za-z0-9]+)$', 1)) ext, count(*) n from (select distinct relative_path p from files where relative_path is not null) where not (regexp_matches(p, '(^|/)(\.git|\.venv|venv|__pycache__|node_modules|\.idea|\.vscode|\.cache|\.lancedb|dist|build|static)/') or regexp_matches(p, '(^|/)[^/]*(\.pyc|\.min\.js|\.map|\.g\.cs)(/|$)') or (regexp_matches(p, '(^|/)vendor[^/]*/') and not regexp_matches(p, '^vendor[^/]*/keep/'))) group by 1",
    "read_span_context": sql(rf"select relative_path, cast(greatest(1, least(5, n, 3) - 2) as integer) base_line, strlen(t) > 120 truncated, case when strlen(t) <= 120 then cast(strlen(t) as integer) end n_bytes, case when strlen(t) <= 120 then md5(t) end md5 from (select relative_path, n, array_to_string(list_slice(ls, greatest(1, least(3, n) - 2), least(n, 7)), chr(10)) t from (select relative_path, {_LINES} ls, len({_LINES}) n from cf where content is not null))"),
    "read_file_numbered": sql(rf"select relative_path, cast(length(t) as integer) chars, md5(t) md5, cast(least(400, strlen(content)) as integer) raw_bytes, strlen(content) > 400 truncated from (select relative_path, content, array_to_string(list_transform({_LINES}, lambda x, i: case when i < 1000 then lpad(cast(i as varchar), 4, ' ') else cast(i as varchar) end || ' | ' || x), chr(10)) t from cf where content is not null)"),
    "declarations_extract": sql(f", {_DECLS} select path, ext, line, kind, name from dc"),

    "content_hashes": sql("select split_part(relative_path, '/', 1) repository, count(*) n, count(content_hash) hashed, coalesce(cast(sum((sha256(content) = lower(content_hash))::int) as bigint), 0) as \"right\" from cf where content is not null group by 1"),
    "short_hashes": sql("select id, substr(md5(name), 1, 10) md5, substr(sha1(name), 1, 12) sha1 from cn where node_type = 'table'"),
    "duplicate_contents": sql("select sha256(content) as hash, count(*) n, min(relative_path) as first from cf where content is not null and content <> '' group by 1 having count(*) > 1"),
    "read_span_first_lines": sql(rf"select relative_path, cast(length(s) as integer) chars, md5(s) md5 from (select relative_path, array_to_string(list_transform(list_slice({_LINES}, 2, 6), lambda x, i: lpad(cast(i + 1 as varchar), 4, ' ') || ' | ' || x), chr(10)) as s from cf where content is not null)"),
    "sql_lineage": sql(f", {_SQLS} select path, cast(ordinal as integer) ordinal, kind, array_to_string(list_sort(w), ',') writes, array_to_string(list_sort(list_distinct(list_concat(r, w))), ',') reads from sx"),
    "cross_file_inheritance": sql(
        r", cl as (select * from cn where node_type = 'class'), bs0 as (select distinct id, file_path, list_extract(regexp_split_to_array(raw, '\.|::'), -1) as name from (select id, file_path, unnest(bases) as raw from cl) where raw is not null), "
        "bs as (select * from bs0 where (id, name) not in (select (src, cl.name) from le join cl on cl.id = dst where edge_type = 'inherits')), kn as (select id as base, name, file_path as at_, node_seq from cl), "
        "ft as (select id, coalesce(relative_path, file_path) as file from cn), lk as (select distinct a.file as a, b.file as b from le join ft a on a.id = src join ft b on b.id = dst where edge_type = 'imports' and a.file <> b.file), "
        "c2 as (select bs.id, bs.name, base, false as cross_file, node_seq from bs join kn on kn.name = bs.name where bs.id <> base and at_ = bs.file_path union all select bs.id, bs.name, base, true, node_seq from bs join kn on kn.name = bs.name where (bs.file_path, at_) in (select (a, b) from lk)) "
        "select bs.id, bs.name, base, cross_file from bs left join (select * from (select *, row_number() over (partition by id, name order by cross_file, node_seq) rn2 from c2) where rn2 = 1) x on x.id = bs.id and x.name = bs.name"
    ),
    "debounce_sessions": "with g as (select *, epoch_us(ts) us, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) gap from events), s as (select *, sum(case when gap is null or gap >= 60000000 then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) session from g) select user_id, cast(session as bigint) session, count(*) events, min(us) first_us, max(us) last_us from s group by 1, 2",
    "dangling_counts": sql("select edge_type, count(*) n, cast(sum(case when edge_seq in (select edge_seq from le) then 1 else 0 end) as bigint) kept from ae group by 1"),
    "markdown_reports": sql("select split_part(file_path, '/', 1) repository, '- **' || split_part(file_path, '/', 1) || '**: ' || sum((node_type = 'file')::int) || ' files, ' || sum((node_type in ('class', 'function', 'method'))::int) || ' symbols, ' || count(docstring) || ' documented' as line from cn where file_path is not null group by 1"),
    "list_directory": sql("select folder, cast(sum(f) as bigint) files, cast(sum(1 - f) as bigint) folders from (select distinct array_to_string(list_slice(p, 1, i - 1), '/') as folder, p[i] as name, (i = len(p))::int as f from (select p, unnest(range(1, len(p) + 1)) as i from (select string_split(relative_path, '/') p from cf where relative_path <> ''))) where not starts_with(name, '.') group by 1"),
}
