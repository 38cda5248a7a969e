"""Corpus queries: files are `pages` (url as path) and `documents`; derived texts carry imports and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions import text as T
from quarry.operators import chunking, context, corpus
from quarry.sources import store
from quarry.sources.store import read

IGNORE = ["# generated", "*.html", "/src/blog*/", "**/en/1?", "!keep.me", "de/"]
KIND = "element_at(array('.ts','.png','.py','.min.js','','.tsx','.md','.d.ts','.go','.lock'), cast(page_id % 10 as int) + 1)"
FOLDER = "element_at(array('src/','node_modules/','','docs/','lib/'), cast(page_id % 5 as int) + 1)"
SQL_KIND = "(['.ts','.png','.py','.min.js','','.tsx','.md','.d.ts','.go','.lock'])[(page_id % 10)::int + 1]"
SQL_FOLDER = "(['src/','node_modules/','','docs/','lib/'])[(page_id % 5)::int + 1]"


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files: a folder and an ending are put around the url's own path."""
    p = read(spark, d, "pages").select("page_id", "url", F.length("html").cast("long").alias("size"))
    own = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "[?#].*$", "")
    host = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)
    return p.select("page_id", F.concat(F.expr(FOLDER), host, F.lit("/"), own, F.expr(KIND)).alias("path"), "size", host.alias("repo"))


def path_language(spark, d):
    return _files(spark, d).select("page_id", P.language(F.col("path")).alias("language"))


def path_filter(spark, d):
    p = F.col("path")
    return _files(spark, d).select(
        "page_id", P.is_binary(p).alias("is_binary"), P.in_excluded_dir(p).alias("in_excluded_dir"), P.is_excluded(p).alias("is_excluded"),
        P.in_priority_folder(p).alias("in_priority"), P.is_code(p).alias("is_code"), P.is_included(p).alias("included"),
    )


def gitignore_match(spark, d):
    return _files(spark, d).select("page_id", P.is_ignored(F.col("path"), P.ignore_rules("\n".join(IGNORE))).alias("ignored"))


def corpus_stats(spark, d):
    return corpus.corpus_stats(_files(spark, d), ["repo"])


def corpus_prioritised(spark, d):
    """Files kept per repository when more than 60 estimated lines are too many."""
    kept = corpus.prioritised(_files(spark, d).filter("path is not null"), "repo", most_lines=60)
    return kept.groupBy("repo").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def filter_report(spark, d):
    """What filtering did to each repository, when more than 60 estimated lines are too many."""
    found = corpus.filter_report(_files(spark, d).filter("path is not null"), "repo", most_lines=60)
    return found.withColumn("warnings", F.array_join("warnings", "|"))


def size_warnings(spark, d):
    """Whether a host's pages, taken as a repository's kilobytes, exceed the size that is warned of."""
    sizes = _files(spark, d).filter("path is not null").groupBy("repo").agg(F.sum("size").alias("kb"))
    return sizes.withColumn("w", P.size_warning(F.col("kb"))).select("repo", "w.*")


def redact_nested(spark, d):
    """Events as nested JSON, without what sensitive keys hold at any depth."""
    e = read(spark, d, "events").filter("event_type is not null")
    note = F.concat(F.lit("Bearer abc.def "), "event_type")
    inner = F.struct(F.lit("x").alias("api_key"), note.alias("note"), F.col("event_id").alias("n"))
    outer = F.struct(F.struct(F.lit(1).alias("a")).alias("userToken"), inner.alias("inner"), F.array(F.lit("token: abc")).alias("list"))
    return e.select("event_id", T.redact_json(F.to_json(F.struct(F.col("event_type").alias("kind"), outer.alias("outer")))).alias("shown"))


def language_bytes(spark, d):
    rows = read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return rows.orderBy(F.desc("chars"), "source", "lang")


def repo_stats(spark, d):
    return corpus.repo_stats(read(spark, d, "documents"), ["source"], "lang")


def repo_stats_language(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("chunks"))


def repo_stats_type(spark, d):
    return read(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("chunks"))


def token_estimate(spark, d):
    return read(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


def content_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("sha"))


def snapshot_diff(spark, d):
    """Texts of the second turn against those of the first, by conversation."""
    c = read(spark, d, "conversations")
    of = lambda t: c.filter(F.col("turn") == t).select(F.col("conv_id").alias("path"), T.content_hash(F.col("text")).alias("sha"))
    return corpus.snapshot_diff(of(0), of(2))


def redact(spark, d):
    """Digest of each text after redaction."""
    shown = T.redact(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.sha2(shown, 256).alias("sha"), (shown != F.col("text")).alias("changed"))


def deps_extract(spark, d):
    """Dependencies of a module put together from each part: two imports, one of them twice, and a require."""
    p = read(spark, d, "part")
    code = F.concat(
        F.lit("import { a } from '"), F.col("p_name"), F.lit("'\nconst b = require(\""), F.col("p_brand"), F.lit("\")\nimport c from '"),
        F.col("p_type"), F.lit("'\nimport d from '"), F.col("p_name"), F.lit("'"),
    )
    deps = corpus.dependencies(code, F.lit("typescript"))
    return p.select("p_partkey", F.array_join(deps, "|").alias("deps"), F.size(deps).cast("long").alias("n"))


def citations_parse(spark, d):
    """Citations of an answer put together from each part: with a range, with a line, bare, and a link."""
    p = read(spark, d, "part")
    text = F.concat(
        F.lit("see [src/"), F.translate("p_name", " ", "_"), F.lit(".ts:"), F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 5).cast("string"),
        F.lit("], é [lib/b.py:"), F.col("p_size").cast("string"), F.lit("] and [a/c.go] not [x/y.md](u)"),
    )
    found = context.citations(p.select("p_partkey", text.alias("t")), "t")
    return found.select("p_partkey", "n", "path", "line", "end_line", "original", "start_index", "end_index")


def context_pack_prefix(spark, d):
    rows = read(spark, d, "documents").select("source", "doc_id", F.length("text").cast("long").alias("len"))
    return context.prefix_pack(rows, 20_000, "len", [F.col("doc_id")], ["source"]).select("source", "doc_id", "used")


def context_pack_grouped(spark, d):
    rows = read(spark, d, "documents").select("source", "lang", "doc_id", "text")
    packed = context.grouped_pack(rows, 3_000, "lang", "doc_id", "text", "doc_id", ["source"])
    return packed.select("source", "n_chunks", "n_files", "n_chars", F.sha2("context", 256).alias("context_sha"))


def minimal_context(spark, d):
    rows = read(spark, d, "part").select("p_brand", "p_name", "p_partkey")
    return context.minimal(rows, "p_brand", "p_name", "p_partkey")


def chunk_format(spark, d):
    p = read(spark, d, "part")
    text = context.format_chunk(
        F.col("p_brand"), F.col("p_size"), F.col("p_size") + 9, F.col("p_type"), F.col("p_name"), F.lit("text"), F.concat(F.lit("price "), F.col("p_type")),
    )
    return p.select("p_partkey", text.alias("formatted"))


def fixed_chunks(spark, d):
    """Number and length of the pieces of each document taken as a text file."""
    files = read(spark, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    chunks = chunking.chunk_files(files, "path", "text")
    return chunks.groupBy("path").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"), F.max("end_line").alias("last_line"))


def repo_list_merge(spark, d):
    """Customers, then suppliers, as one list with each key once, newest balance first."""
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return store.merged_first([b, a], "id", F.col("name")).orderBy(F.desc("balance"), "id")


def replace_rows(spark, d):
    """Rows by source after the second half of the sources was indexed anew with shorter texts."""
    docs = read(spark, d, "documents").select("doc_id", "source", F.length("text").cast("long").alias("len"))
    new = docs.filter("source >= 'src2'").withColumn("len", F.least(F.col("len"), F.lit(100).cast("long")))
    return store.replaced(docs, new, "source").groupBy("source").agg(F.count("*").alias("n"), F.sum("len").alias("chars"))


def upsert_rows(spark, d):
    """Customers after those that ordered in 2001 got their last order's price as balance."""
    old = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    new = read(spark, d, "orders").filter("o_orderdate >= '2001-01-01'").select(
        F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("balance"), F.struct("o_orderdate", "o_orderkey").alias("seq")
    )
    return store.upserted(old, new, ["id"])


def cascade_counts(spark, d):
    """Rows left of customers, orders and lines after the customers of nation 3 are gone."""
    tables = {
        "customer": read(spark, d, "customer").select("c_custkey", "c_nationkey"), "orders": read(spark, d, "orders").select("o_orderkey", "o_custkey"),
        "lineitem": read(spark, d, "lineitem").select("l_orderkey", "l_linenumber"),
    }
    links = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]
    left = store.cascade_delete(tables, links, "customer", tables["customer"].filter("c_nationkey = 3"), "c_custkey")
    counts = [left[t].agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in tables]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def activate_one(spark, d):
    """Suppliers of a nation, one of them active."""
    s = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.lit(True).alias("active"))
    return store.updated(s, F.col("s_nationkey") == 5, {"active": F.col("s_suppkey") == 40})


def unindexed_search(spark, d):
    """Customers without orders since July 2001 whose name or segment contains a word."""
    c = read(spark, d, "customer")
    free = c.join(read(spark, d, "orders").filter("o_orderdate >= '2001-07-01'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    has = lambda x: F.coalesce(F.contains(F.lower(x), F.lit("ma")), F.lit(False))
    return free.filter(has("c_name") | has("c_mktsegment")).select("c_custkey", "c_name", "c_mktsegment")


QUERIES = [
    path_language, path_filter, gitignore_match, corpus_stats, corpus_prioritised, language_bytes, repo_stats, repo_stats_language,
    repo_stats_type, token_estimate, content_hash, snapshot_diff, redact, deps_extract, citations_parse, context_pack_prefix,
    filter_report, size_warnings, redact_nested, context_pack_grouped, minimal_context, chunk_format, fixed_chunks, repo_list_merge, replace_rows, upsert_rows, cascade_counts,
    activate_one, unindexed_search,
]


def _list(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


_F = rf"""f as (select page_id, {SQL_FOLDER} || regexp_extract(url, '^[a-z]+://([^/]*)', 1) || '/'
|| regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', '') || {SQL_KIND} path, length(html) size,
regexp_extract(url, '^[a-z]+://([^/]*)', 1) repo from pages),
l as (select *, lower(regexp_extract(path, '([^.]*)$', 1)) ext, string_split(path, '/') parts from f)"""
_LANG = "case " + " ".join(f"when ext = '{e}' then '{v}'" for e, v in P.LANGUAGES.items()) + " else 'text' end"
_BIN, _EXC = f"ext in {_list(P.BINARY)}", "regexp_matches(path, '" + "|".join(P.EXCLUDED_PATTERNS) + "')"
_DIR = f"len(list_filter(parts, lambda x: x in {_list(P.EXCLUDED_DIRS)})) > 0"
_PRI = f"len(list_filter(parts, lambda x: lower(x) in {_list(P.PRIORITY_FOLDERS)})) > 0"
_INC = f"(not {_BIN} and not {_DIR} and not {_EXC} and {_LANG} <> 'text')"
_REDACTED = "text"
for _p in T.REDACTED:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_p}', '[REDACTED]', 'gi')"

_PACKED = f"""{_F}, inc as (select page_id, repo, path, size, ceil(size / 40.0)::bigint as lines, {_PRI} pri, parts[-1] in {_list(P.IMPORTANT_FILES)} imp from l where path is not null and {_INC}),
g1 as (select repo, ceil(sum(size) / 40.0) > 60 large from inc group by 1), c1 as (select inc.*, large from inc join g1 using (repo) where not large or pri or imp),
g2 as (select repo, ceil(sum(size) / 40.0) > 60 still from c1 group by 1), c2 as (select c1.*, still from c1 join g2 using (repo)),
o as (select *, row_number() over (partition by repo order by not imp, path, size, page_id) i from c2 where large and still),
r(repo, i, used, fits) as (select distinct repo, 0::bigint, 0::bigint, false from o union all
select o.repo, o.i, used + case when used + o.lines <= 60 then o.lines else 0 end, used + o.lines <= 60 from r join o on o.repo = r.repo and o.i = r.i + 1),
kept as (select repo, size from c2 where not (large and still) union all select o.repo, o.size from o join r using (repo, i) where fits)"""

SQL = {
    "corpus_prioritised": f"with recursive {_PACKED} select repo, count(*) files, sum(size)::bigint bytes from kept group by 1",
    "filter_report": f"""with recursive {_PACKED}, a as (select repo, count(*) files, sum(size)::bigint bytes, count(*) filter ({_INC}) indexable,
ceil(coalesce(sum(size) filter ({_INC}), 0) / 40.0)::bigint as lines, ceil(coalesce(sum(size) filter ({_INC} and ({_PRI} or parts[-1] in {_list(P.IMPORTANT_FILES)})), 0) / 40.0)::bigint chosen
from l where path is not null group by 1), k as (select repo, count(*) kept, sum(size)::bigint kept_bytes from kept group by 1),
b as (select a.*, coalesce(kept, 0) kept, coalesce(kept_bytes, 0)::bigint kept_bytes from a left join k using (repo))
select repo, files, bytes, kept, kept_bytes, files - kept excluded, files - indexable filtered, lines > 60 is_prioritised, indexable = 0 is_empty,
concat_ws('|', case when indexable = 0 then 'No indexable code files found in repository' end, case when lines > 60 then 'Repository is large (~' || floor(lines / 1000.0 + 0.5)::bigint
|| 'k lines). Only priority folders will be indexed: src, lib, app, pages, components, etc.' end, case when lines > 60 and chosen > 60 then 'Indexed ' || kept || ' of ' || indexable || ' files due to size limit.' end) warnings from b""",
    "size_warnings": f"with {_F} select repo, sum(size) > 50000 exceeds, sum(size)::bigint kilobytes, 50000::bigint threshold from l where path is not null group by 1",
    "redact_nested": """select event_id, '{"kind":"' || event_type || '","outer":{"userToken":"[REDACTED]","inner":{"api_key":"[REDACTED]","note":"[REDACTED] ' || event_type
|| '","n":' || event_id || '},"list":["token: abc"]}}' shown from events where event_type is not null""",
    "path_language": f"with {_F} select page_id, {_LANG} \"language\" from l",
    "path_filter": f"with {_F} select page_id, {_BIN} is_binary, {_DIR} in_excluded_dir, {_EXC} is_excluded, {_PRI} in_priority, {_LANG} <> 'text' is_code, {_INC} included from l",
    "gitignore_match": rf"""with {_F} select page_id, regexp_matches(path, '(^|/)[^/]*\.html(/|$)') or regexp_matches(path, '^src/blog[^/]*/')
or regexp_matches(path, '(^|/)(.*/)?en/1[^/](/|$)') or regexp_matches(path, '(^|/)de/') ignored from l""",
    "corpus_stats": f"""with {_F}, g as (select repo, count(*) files, count(*) filter ({_INC}) code_files, coalesce(sum(size) filter ({_INC}), 0)::bigint code_bytes from l group by repo)
select *, ceil(code_bytes / 40.0)::bigint lines, ceil(code_bytes / 40.0) > 50000 is_large, code_files = 0 is_empty from g""",
    "language_bytes": "select source, lang, count(*) n, sum(length(text))::bigint chars from documents group by all",
    "repo_stats": "select source, count(*) chunks, count(distinct lang) files from documents group by 1",
    "repo_stats_language": "select lang, count(*) chunks from documents group by 1",
    "repo_stats_type": "select p_type, count(*) chunks from part group by 1",
    "token_estimate": "select doc_id, ceil(length(text) / 4.0)::bigint tokens from documents",
    "content_hash": "select doc_id, sha256(text) sha from documents",
    "snapshot_diff": """with o as (select conv_id path, sha256(text) sha from conversations where turn = 0), n as (select conv_id path, sha256(text) sha from conversations where turn = 2),
j as (select coalesce(o.path, n.path) path, case when o.path is null then 'added' when n.path is null then 'deleted' when o.sha <> n.sha then 'modified' end change
from o full join n on o.path = n.path) select * from j where change is not null""",
    "redact": f"select doc_id, sha256({_REDACTED}) sha, {_REDACTED} <> text changed from documents",
    "deps_extract": "select p_partkey, p_name || '|' || p_type || '|' || p_brand deps, 3::bigint n from part",
    "citations_parse": """with b as (select p_partkey, replace(p_name, ' ', '_') nm, p_size s from part),
c as (select p_partkey, 0 n, 'src/' || nm || '.ts' path, s line, s + 5 end_line, '[src/' || nm || '.ts:' || s || '-' || (s + 5) || ']' original, 4 start_index from b),
e as (select p_partkey, 1 n, 'lib/b.py' path, b.s line, null::int end_line, '[lib/b.py:' || b.s || ']' original, 4 + length(c.original) + 4 start_index from b join c using (p_partkey)),
g as (select p_partkey, 2 n, 'a/c.go' path, null::int line, null::int end_line, '[a/c.go]' original, e.start_index + length(e.original) + 5 start_index from e),
u as (select * from c union all select * from e union all select * from g)
select p_partkey, n::int n, path, line::int line, end_line::int end_line, original, start_index::int start_index, (start_index + length(original))::int end_index from u""",
    "context_pack_prefix": """with s as (select source, doc_id, sum(length(text)) over (partition by source order by doc_id)::bigint used from documents)
select * from s where used <= 20000""",
    "context_pack_grouped": """with f as (select *, min(doc_id) over (partition by source, lang) first from documents),
s as (select *, sum(length(text)) over (partition by source order by first, lang, doc_id) used from f)
select source, count(*) n_chunks, count(distinct lang) n_files, sum(length(text))::bigint n_chars, sha256(string_agg(text, chr(10) order by first, lang, doc_id)) context_sha
from s where used <= 11800 group by source""",
    "minimal_context": """with r as (select p_brand, p_name, p_partkey, row_number() over (partition by p_brand order by p_partkey, p_name) r from part where p_name is not null)
select p_brand, string_agg(p_name, ', ' order by r) symbols from r where r <= 5 group by 1""",
    "chunk_format": """select p_partkey, '### [' || p_brand || ':' || p_size || '-' || (p_size + 9) || ']' || chr(10) || '**' || p_type || '**: `' || p_name || '`' || chr(10) || chr(10)
|| '```text' || chr(10) || 'price ' || p_type || chr(10) || '```' || chr(10) formatted from part""",
    "repo_list_merge": """with u as (select s_suppkey id, s_name as name, s_acctbal balance, 0 p from supplier union all select c_custkey, c_name, c_acctbal, 1 from customer)
select id, name, balance from u qualify row_number() over (partition by id order by p, name) = 1""",
    "replace_rows": "select source, count(*) n, sum(case when source >= 'src2' then least(length(text), 100) else length(text) end)::bigint chars from documents group by 1",
    "upsert_rows": """with n as (select o_custkey id, o_totalprice balance from orders where o_orderdate >= '2001-01-01'
qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)
select c_custkey id, coalesce(n.balance, c_acctbal) balance from customer left join n on n.id = c_custkey union all select id, balance from n where id not in (select c_custkey from customer)""",
    "cascade_counts": """select 'customer' as name, count(*) n from customer where c_nationkey <> 3 union all
select 'orders', count(*) from orders where o_custkey not in (select c_custkey from customer where c_nationkey = 3) union all
select 'lineitem', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3))""",
    "activate_one": "select s_suppkey, s_nationkey, case when s_nationkey = 5 then s_suppkey = 40 else true end active from supplier",
    "unindexed_search": """select c_custkey, c_name, c_mktsegment from customer where c_custkey not in (select o_custkey from orders where o_orderdate >= '2001-07-01')
and (contains(lower(c_name), 'ma') or contains(lower(c_mktsegment), 'ma'))""",
}
