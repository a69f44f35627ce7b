"""Markdown sections, links between documentation and symbols, staleness, coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.relational import first_by
from .base import edges, file_facts, files, functions, nodes, sql
from .graph_queries import path_of

STALE_SECONDS = 14 * 86400
SECTION_CHARS = 8000
CHUNK, OVERVIEW, SPAN, BLOCK = 4000, 150, 4000, 64  # characters of a chunk, lines of an overview, of a symbol, of a block
# What names a symbol in text.
EXPLICIT = r"\b(?:function|class|method)::[^\s`]+"
DOTTED = r"\b[A-Z][A-Za-z0-9_]+\.[a-zA-Z_][a-zA-Z0-9_]*\b"
TICKED = r"`([A-Za-z_][A-Za-z0-9_]*)`"


def _sections(spark, d, fact):
    """path and, of each Markdown section, what ``fact`` makes of it; read where the file is."""
    is_md = (T.extension(F.col("relative_path")) == "md") & F.col("content").isNotNull()
    rows = file_facts(spark, d, found=F.when(is_md, F.transform(T.sections(F.col("content"), SECTION_CHARS), fact)))
    return rows.select(F.col("relative_path").alias("path"), F.explode("found").alias("s")).select("path", "s.*")


def doc_sections(spark, d):
    def fact(s):
        return F.struct(s["section"].alias("section"), s["title"].alias("title"), s["level"].alias("level"), T.anchor(s["title"]).alias("anchor"), s["line_start"].alias("line_start"), F.length(s["content"]).alias("n_chars"), F.substring(F.md5(s["content"]), 1, 12).alias("content_hash"))

    return _sections(spark, d, fact)


def doc_links_tiered(spark, d):
    """Symbols that documentation sections name, as edges both ways.

    Explicit ids 1.0, ``Class.method`` 0.9 (of several the latest node), a name in back ticks or among the refs that
    only one symbol bears 0.7; case matters for ids only; a token counts by the first of these that knows it.
    """
    text = F.coalesce("content", F.lit(""))
    named = [F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in ((EXPLICIT, 0), (DOTTED, 0), (TICKED, 1))]
    tokens = F.array_distinct(F.concat(F.coalesce("refs", F.array().cast("array<string>")), *named))
    docs = nodes(spark, d, "node_type", "content", "refs").where("node_type = 'doc_section'").select(F.col("id").alias("src"), F.explode(tokens).alias("token"))
    known = nodes(spark, d, "node_type", "name", "class_name", "node_seq").where("node_type in ('class', 'function', 'method')")
    is_id = F.col("token").rlike("^(?:function|class|method)::")
    by_id = docs.where(is_id).join(known.select(F.col("id").alias("dst")), F.col("token") == F.col("dst")).select("src", "dst", F.lit(1.0).alias("confidence"), F.lit("explicit").alias("reason"))
    dotted = known.where("node_type = 'method' and class_name is not null").groupBy(F.lower(F.trim(F.concat_ws(".", "class_name", "name"))).alias("key")).agg(F.max_by("id", "node_seq").alias("dotted"))
    single = known.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min("id").alias("single"), F.count("*").alias("n"))
    words = docs.where(~is_id).select("src", F.lower(F.trim("token")).alias("key")).distinct().join(dotted, "key", "left").join(single.where("n = 1").select("key", "single"), "key", "left")
    by_word = words.where("dotted is not null or single is not null").select("src", F.coalesce("dotted", "single").alias("dst"), F.when(F.col("dotted").isNotNull(), 0.9).otherwise(0.7).alias("confidence"), F.when(F.col("dotted").isNotNull(), "dotted").otherwise("unique").alias("reason"))
    links = first_by(by_id.unionByName(by_word), ["src", "dst"], [F.desc("confidence")])
    there = links.withColumn("edge_type", F.lit("documents"))
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence", "reason", F.lit("documented_by").alias("edge_type"))
    return there.unionByName(back).select("src", "dst", "edge_type", "confidence", "reason")


def stale_docs_thetajoin(spark, d):
    """Documentation older than what it documents by more than two weeks; unknown times count as 0."""
    at = nodes(spark, d, "file_path", "relative_path").select("id", path_of().alias("path"))
    mtime = files(spark, d, "mtime").select(F.col("relative_path").alias("path"), F.coalesce("mtime", F.lit(0.0)).alias("mtime"))
    when = at.join(mtime, "path", "left").select("id", "path", F.coalesce("mtime", F.lit(0.0)).alias("mtime"))
    pairs = edges(spark, d, "documents").join(when.select(F.col("id").alias("src"), F.col("mtime").alias("doc_time")), "src").join(when.select(F.col("id").alias("dst"), F.col("mtime").alias("code_time")), "dst")
    return pairs.where(F.col("code_time") > F.col("doc_time") + STALE_SECONDS).select("src", "dst").distinct()


def doc_coverage(spark, d):
    """Share of documented classes, functions and methods per repository."""
    known = nodes(spark, d, "node_type", "docstring", "file_path").where("node_type in ('class', 'function', 'method')")
    has = (F.trim(F.coalesce("docstring", F.lit(""))) != "").cast("double")
    return known.groupBy(F.split("file_path", "/")[0].alias("repository"), "node_type").agg(F.count("*").alias("n"), F.round(F.avg(has), 6).alias("coverage"))


def doc_missing_top(spark, d):
    known = functions(spark, d, "name", "docstring", "file_path").where(F.trim(F.coalesce("docstring", F.lit(""))) == "")
    return known.orderBy("file_path", "name", "id").limit(20).select("file_path", "name", "id")


def docs_map(spark, d):
    """Per Markdown file its sections in order."""
    known = nodes(spark, d, "node_type", "title", "level", "line_start", "file_path").where("node_type = 'doc_section'")
    rows = F.array_sort(F.collect_list(F.struct(F.coalesce("line_start", F.lit(0)).alias("line"), "id", "title")))
    return known.groupBy("file_path").agg(F.count("*").alias("sections"), F.array_join(F.transform(rows, lambda r: r["title"]), " | ").alias("titles"))


def chunks(spark, d):
    """Chunks to index: id, name, file_path, node_type and content, of symbols, documentation sections and files.

    A symbol's chunk is a heading, its docstring and its code; a file's the heading, its outline and its first
    OVERVIEW lines; each is cut at CHUNK characters with a mark. Methods count as functions.
    """
    known = nodes(spark, d, "node_type", "name", "docstring", "signature", "file_path", "line_start", "line_end", "content", "title")
    kind = F.when(F.col("node_type") == "method", "function").otherwise(F.col("node_type"))
    cut_text = lambda c: F.when(F.length(c) > CHUNK, F.concat(F.substring(c, 1, CHUNK), F.lit("\n[cut]"))).otherwise(c)
    symbols = known.where("node_type in ('class', 'function', 'method')")
    # A chunk is text, so text is moved here, in blocks of lines that meet the spans reaching into them.
    spans = symbols.where("line_start >= 1 and line_end >= line_start").select("id", F.col("file_path").alias("path"), "line_start", F.least("line_end", F.col("line_start") + SPAN - 1).alias("line_end"))
    lines = file_facts(spark, d, lines=F.when(F.col("content").isNotNull(), F.transform(T.numbered(T.lines(F.col("content"))), lambda x: F.struct(x["n"].alias("line"), F.substring(x["text"], 1, CHUNK).alias("text")))))
    blocks = lines.select(F.col("relative_path").alias("path"), F.explode("lines").alias("l")).select("path", F.floor(F.col("l.line") / BLOCK).alias("block"), "l")
    blocks = blocks.groupBy("path", "block").agg(F.array_sort(F.collect_list("l")).alias("lines"))
    wanted = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("line_start") / BLOCK), F.floor(F.col("line_end") / BLOCK))))
    inside = F.filter("lines", lambda x: (x["line"] >= F.col("line_start")) & (x["line"] <= F.col("line_end")))
    code = wanted.join(blocks, ["path", "block"]).select("id", inside.alias("ls")).groupBy("id").agg(F.flatten(F.array_sort(F.collect_list("ls"))).alias("ls"))
    code = code.where("size(ls) > 0").select("id", F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("code"))
    own = symbols.join(code, "id", "left").select("id", "name", "file_path", kind.alias("node_type"), F.concat_ws("\n", F.concat_ws(" ", kind, "name", "file_path"), "signature", "docstring", "code").alias("content"))
    texts = known.where("node_type = 'doc_section'").select("id", "name", "file_path", "node_type", F.concat_ws("\n", "title", "content").alias("content"))
    head = file_facts(spark, d, head=F.array_join(F.slice(T.lines(F.col("content")), 1, OVERVIEW), "\n")).select(F.col("relative_path").alias("file_path"), F.substring("head", 1, CHUNK).alias("head"))
    overview = known.where("node_type = 'file'").select("id", "name", "file_path", "node_type").join(file_outline(spark, d), "file_path", "left").join(head, "file_path", "left")
    overview = overview.select("id", "name", "file_path", "node_type", F.concat_ws("\n", F.concat_ws(" ", F.lit("file"), "file_path"), "outline", "head").alias("content"))
    every = own.unionByName(texts).unionByName(overview)
    return every.withColumn("content", cut_text(F.col("content")))


def chunks_for_index(spark, d):
    """Chunks and characters per kind."""
    return chunks(spark, d).groupBy(F.col("node_type").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


def file_outline(spark, d):
    """Per file the first fifty symbols by line, and how many more there are."""
    known = nodes(spark, d, "node_type", "name", "line_start", "file_path").where("node_type in ('class', 'function', 'method') and file_path is not null")
    w = Window.partitionBy("file_path").orderBy(F.col("line_start").asc_nulls_last(), "id")
    first = known.withColumn("n", F.row_number().over(w)).groupBy("file_path").agg(F.count("*").alias("symbols"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= 50, F.struct("n", "name")))), lambda r: r["name"]), ", ").alias("outline"))
    return first.select("file_path", "symbols", "outline", F.greatest(F.col("symbols") - 50, F.lit(0)).alias("more"))


QUERIES = {f.__name__: f for f in (doc_sections, doc_links_tiered, stale_docs_thetajoin, doc_coverage, doc_missing_top, docs_map, chunks_for_index, file_outline)}

_LINES = r"regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(content, '^\x{FEFF}', ''), '\r\n|\r', chr(10), 'g'), '\n$', ''), '\n')"
_SECTIONS = rf"""ml as (select path, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as pos from (select relative_path as path, {_LINES} as ls from cf where lower(regexp_extract(relative_path, '\.([A-Za-z0-9]+)$', 1)) = 'md' and content is not null)),
mh as (select *, case when regexp_matches(line, '^#{{1,6}}[ \t]+[^ \t]') then 1 else 0 end as h from ml),
mp as (select *, sum(h) over (partition by path order by pos) as section, max(h) over (partition by path) as anyh from mh),
mr as (select path, section, string_agg(line, chr(10) order by pos) as whole, arg_min(line, pos) as top, min(pos) as first from mp where section > 0 or anyh = 0 group by 1, 2),
mx as (select path, cast(section as bigint) as section, case when section = 0 then 'Document' else regexp_replace(regexp_replace(top, '^#+[ \t]+', ''), '[ \t]+$', '') end as title,
  case when section = 0 then 1 else length(regexp_extract(top, '^(#+)', 1)) end as level, cast(first + 1 as integer) as line_start, case when length(whole) > {SECTION_CHARS} then substr(whole, 1, {SECTION_CHARS}) || chr(10) || '[cut]' else whole end as content from mr)"""
_TOKENS = rf"""ds as (select id as src, unnest(list_distinct(list_concat(coalesce(refs, []), regexp_extract_all(coalesce(content, ''), '{EXPLICIT}'), regexp_extract_all(coalesce(content, ''), '{DOTTED}'), regexp_extract_all(coalesce(content, ''), '{TICKED}', 1)))) as token from cn where node_type = 'doc_section'),
kn as (select * from cn where node_type in ('class', 'function', 'method')),
dt as (select lower(trim(concat_ws('.', class_name, name))) as key, arg_max(id, node_seq) as id from kn where node_type = 'method' and class_name is not null group by 1),
sg as (select lower(trim(name)) as key, min(id) as id from kn group by 1 having count(*) = 1),
ln as (select src, token as dst, 1.0::double as confidence, 'explicit' as reason from ds where token in (select id from kn)
  union all select distinct src, coalesce(dt.id, sg.id), case when dt.id is not null then 0.9::double else 0.7::double end, case when dt.id is not null then 'dotted' else 'unique' end
    from ds left join dt on dt.key = lower(trim(token)) left join sg on sg.key = lower(trim(token)) where not regexp_matches(token, '^(function|class|method)::') and coalesce(dt.id, sg.id) is not null),
l1 as (select * from (select *, row_number() over (partition by src, dst order by confidence desc) rn from ln) where rn = 1)"""

ORACLES = {
    "doc_sections": sql(f", {_SECTIONS} select path, section, title, cast(level as integer) as level, replace(trim(lower(title)), ' ', '-') as anchor, line_start, cast(length(content) as integer) as n_chars, substr(md5(content), 1, 12) as content_hash from mx"),
    "doc_links_tiered": sql(f", {_TOKENS} select src, dst, 'documents' as edge_type, confidence, reason from l1 union all select dst, src, 'documented_by', confidence, reason from l1"),
    "stale_docs_thetajoin": sql(f", wh as (select cn.id, coalesce(cf.mtime, 0) as m from cn left join cf on cf.relative_path = coalesce(cn.relative_path, cn.file_path)) select distinct src, dst from le join wh a on a.id = src join wh b on b.id = dst where edge_type = 'documents' and b.m > a.m + {STALE_SECONDS}"),
    "doc_coverage": sql("select split_part(file_path, '/', 1) repository, node_type, count(*) n, round(avg(case when trim(coalesce(docstring, '')) <> '' then 1.0 else 0.0 end), 6) coverage from cn where node_type in ('class', 'function', 'method') group by 1, 2"),
    "doc_missing_top": sql("select file_path, name, id from cn where node_type in ('function', 'method') and trim(coalesce(docstring, '')) = '' order by file_path, name, id limit 20"),
    "docs_map": sql("select file_path, count(*) sections, string_agg(title, ' | ' order by coalesce(line_start, 0), id, title) titles from cn where node_type = 'doc_section' group by 1"),
    "chunks_for_index": sql(
        r", fl as (select relative_path as path, regexp_split_to_array(regexp_replace(regexp_replace(content, '\r\n|\r', chr(10), 'g'), '\n$', ''), '\n') as ls from cf where content is not null), "
        "ol as (select file_path, string_agg(name, ', ' order by rn2) filter (where rn2 <= 50) outline from (select *, row_number() over (partition by file_path order by line_start nulls last, id) rn2 from cn where node_type in ('class', 'function', 'method') and file_path is not null) group by 1), "
        "ch as (select case when node_type = 'method' then 'function' else node_type end as kind, concat_ws(chr(10), concat_ws(' ', case when node_type = 'method' then 'function' else node_type end, name, cn.file_path), signature, docstring, case when line_start >= 1 and line_end >= line_start and line_start <= len(ls) then array_to_string(list_slice(ls, line_start, line_end), chr(10)) end) as t from cn left join fl on fl.path = cn.file_path where node_type in ('class', 'function', 'method') "
        "union all select node_type, concat_ws(chr(10), title, content) from cn where node_type = 'doc_section' "
        "union all select node_type, concat_ws(chr(10), concat_ws(' ', 'file', cn.file_path), outline, substr(array_to_string(list_slice(ls, 1, 150), chr(10)), 1, 4000)) from cn left join ol on ol.file_path = cn.file_path left join fl on fl.path = cn.file_path where node_type = 'file') "
        "select kind, count(*) n, cast(sum(length(case when length(t) > 4000 then substr(t, 1, 4000) || chr(10) || '[cut]' else t end)) as bigint) chars from ch group by 1"
    ),
    "file_outline": sql("select file_path, count(*) symbols, string_agg(name, ', ' order by rn2) filter (where rn2 <= 50) outline, greatest(count(*) - 50, 0) as more from (select *, row_number() over (partition by file_path order by line_start nulls last, id) rn2 from cn where node_type in ('class', 'function', 'method') and file_path is not null) group by 1"),
}
