"""Queries of the stored lexical index, of the strategies, and of whole contexts. Chunks are `documents` with a path and a kind
by their id, and the names of `part` as symbols."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import context, lexical, strategies, usage
from quarry.operators import retrieval as R
from quarry.operators.indexing import Refused
from quarry.sources.store import read
from quarry.streaming.windows import shared_folder

from . import retrieval as plans

PATHS = ["src/components/a.tsx", "lib/hooks/useB.ts", "app/api/c/route.ts", "types/d.d.ts", "docs/e.md"]
KINDS = ["function", "class", "interface", "type", "module", "method", "config"]
QUESTION = "blue widgt"


#: Indexes that a session has written: (application, tables, name) -> folder.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def written(spark: SparkSession, d: str, name: str, build: Callable[[str], object]) -> str:
    """The folder of an index over the tables of a folder. The first query of a session that needs it has it built."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _WRITTEN:
        path = shared_folder(spark, name)
        build(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def has_written(spark: SparkSession, d: str, name: str) -> bool:
    return (spark.sparkContext.applicationId, d, name) in _WRITTEN


def _index(spark: SparkSession, d: str) -> str:
    return written(spark, d, "lexical", lambda path: lexical.write(plans._docs(spark, d), plans._fields(), path))


def index_size(spark, d):
    """Writes the index: chunks and words that it holds."""
    version = lexical.current(spark, _index(spark, d))
    rows = version.live().groupBy("segment").agg(F.count("*").alias("chunks"), *[F.sum(f"n_{w}").cast("long").alias(f"words_{w}") for w in version.weights])
    return rows.select("chunks", *[f"words_{w}" for w in version.weights])


def index_text_rank(spark, d):
    """`text_rank` from the stored index."""
    return lexical.search(spark, _index(spark, d), plans.QUERY, 20)


def index_text_match(spark, d):
    return lexical.search(spark, _index(spark, d), plans.QUERY)


def index_bm25(spark, d):
    return lexical.bm25(spark, _index(spark, d), plans.QUERY, "C")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    one_of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col("id"), F.lit(len(values))) + 1).cast("int"))
    symbols = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("symbol"))
    rows = plans._docs(spark, d).select("id", one_of(PATHS).alias("path"), F.col("id").alias("start_line"), one_of(KINDS).alias("kind"))
    return rows.join(symbols, "id", "left")


def _run(spark, d, strategy: str, **how) -> DataFrame:
    return strategies.run(strategy, _chunks(spark, d), *plans._legs(spark, d), **how)


def strategy_metadata(spark, d):
    return _run(spark, d, "metadata", subject="COMPONENTS")


def strategy_symbol(spark, d):
    return _run(spark, d, "symbol", question=QUESTION)


def strategy_symbol_fallback(spark, d):
    """No symbol is like the question, so both legs answer."""
    return _run(spark, d, "symbol", question="qqqq")


def strategy_hybrid_v2(spark, d):
    return _run(spark, d, "hybrid_v2")


def strategy_hybrid(spark, d):
    return _run(spark, d, "hybrid", subject="TYPES")


def strategy_expanded(spark, d):
    return _run(spark, d, "expanded", patterns=["%hooks%", "%api/%"])


def strategy_vector(spark, d):
    return _run(spark, d, "vector")


def _context(spark, d, **how) -> DataFrame:
    text = context.format_chunk(F.col("p_type"), F.col("p_size"), F.col("p_size") + 9, F.lit("part"), F.col("p_name"), F.lit("text"), F.col("p_brand"), F.col("p_brand"))
    packed = context.whole(read(spark, d, "part"), ["p_brand"], 400, "p_type", "p_size", "p_partkey", text, **how)
    return packed.select(
        "p_brand", F.sha2("context", 256).alias("context_sha"), "n_included", "n_total", "tokens", "truncated", F.array_join("files", "|").alias("files")
    )


def context_grouped(spark, d):
    """Whole contexts by file, of at most 400 tokens, in French."""
    return _context(spark, d)


def context_sequential(spark, d):
    """Whole contexts in order of the chunks, in English."""
    return _context(spark, d, grouped=False, language="en")


def rerank_provider(spark, d):
    """The fused list reranked by a provider that runs in tasks."""
    docs = plans._docs(spark, d).select("id", "text").join(F.broadcast(plans._fused(spark, d)), "id")
    return R.rerank_with(docs, "the and onen reth thon", F.col("text")).select("id", "score", "original_score")


def rerank_failed(spark, d):
    """The first of the fused list, since the provider fails."""
    docs = plans._docs(spark, d).select("id", "text").join(F.broadcast(plans._fused(spark, d)), "id")
    return R.rerank_with(docs, "the and", F.col("text"), _broken).select("id", "score", "original_score")


def _broken(query: str, documents: list[str]) -> list[float]:
    raise Refused("no provider")


def citation_links(spark, d):
    """Line ranges and their link marks, owner and name of a repository, short commits, and the time that indexing takes."""
    p = read(spark, d, "part")
    start, end = F.nullif(F.col("p_size"), F.lit(1)), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size") + F.col("p_partkey") % 2)
    sha, latest = F.sha2("p_name", 256), F.sha2(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.col("p_brand")), 256)
    full = F.concat("p_type", F.lit("/"), "p_name")
    return p.select(
        "p_partkey", T.line_label(start, end).alias("shown"), T.line_hash(start, end).alias("mark"), T.owner_of(full).alias("owner"),
        T.repository_of(full).alias("repo"), T.short_sha(sha).alias("short"), T.has_newer(sha, latest).alias("newer"),
        T.indexing_time(F.col("p_partkey") * F.col("p_partkey") * 37).alias("takes"),
    )


def completed_jobs(spark, d):
    """Users with events before the last day of the month who have no large one on it: what was in progress and no longer is."""
    e = read(spark, d, "events")
    day = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return usage.completed(e.filter(F.col("ts") < day), e.filter((F.col("ts") >= day) & (F.col("value") > 50)), "user_id")


QUERIES = [
    rerank_provider, rerank_failed, citation_links, completed_jobs,
    index_size, index_text_rank, index_text_match, index_bm25, strategy_metadata, strategy_symbol, strategy_symbol_fallback, strategy_hybrid_v2, strategy_hybrid,
    strategy_expanded, strategy_vector, context_grouped, context_sequential,
]

_CH = f"""ch as (select doc_id id, ({PATHS})[(doc_id % 5)::int + 1] path, doc_id start_line, ({KINDS})[(doc_id % 7)::int + 1] kind, p_name symbol
from documents left join part on p_partkey = doc_id)"""
_RRF_30 = "select id, combined_score score, row_number() over (order by combined_score desc, id) + 1000000 ord from rrf qualify ord <= 1000030"


def _meta(where: str, limit: int, score: float) -> str:
    return f"select id, {score}::double score, row_number() over (order by path, start_line, id) ord from ch where {where} qualify ord <= {limit}"


def _weighted(k: int) -> str:
    return f"""a as (select id, similarity v from vec order by v desc, id limit {2 * k}), b as (select id, score t from txt order by t desc, id limit {2 * k}),
f as (select coalesce(a.id, b.id) id, round(0.7::double * coalesce(v, 0) + 0.3::double * coalesce(t, 0), 9) score from a full join b on a.id = b.id),
wt as (select id, score, row_number() over (order by score desc, id) + 1000000 ord from f qualify ord <= {1000000 + k})"""


def _ranked(name: str, rows: str) -> str:
    return f"""u as ({rows}), m as (select id, max(score)::double score, min(ord) first_ord from u group by id)
select '{name}' strategy, row_number() over (order by score desc, first_ord)::int rank, id, score from m"""


def _context_sql(grouped: bool) -> str:
    if grouped:
        frame = "'## Code source pertinent' || chr(10) || chr(10) || 'J''ai trouve ' || n_total || ' section(s) de code pertinente(s) dans le repository:' || chr(10)"
        note = "'_Note: ' || n_included || '/' || n_total || ' sections affichees (limite de tokens atteinte)_'"
        end = "'Utilise ces informations pour repondre avec precision.' || chr(10) || 'Cite toujours les fichiers avec le format `[chemin:lignes]`.'"
    else:
        frame = "'## Relevant Source Code' || chr(10) || chr(10) || 'Found ' || n_total || ' relevant code section(s) in the repository:' || chr(10)"
        note = "'_Note: Showing ' || n_included || '/' || n_total || ' sections (token limit reached)_'"
        end = "'Use this information to answer accurately.' || chr(10) || 'Always cite files using the format `[path:lines]`.'"
    head = "case when row_number() over (partition by p_brand, p_type order by p_size, p_partkey) = 1 then '## 📄 ' || p_type || chr(10) || chr(10) else '' end" if grouped else "''"
    order = "first, p_size, p_partkey" if grouped else "p_partkey"
    glue = "case when i > 1 and (head <> '' or " + ("false" if grouped else "true") + ") then chr(10) else '' end"
    return f"""with t as (select p_brand, p_type, p_size, p_partkey, '### [' || p_type || ':' || p_size || '-' || (p_size + 9) || ']' || chr(10) || '**part**: `' || p_name || '`' || chr(10)
|| chr(10) || '> ' || p_brand || chr(10) || chr(10) || '```text' || chr(10) || p_brand || chr(10) || '```' || chr(10) body from part),
h as (select *, min(p_partkey) over (partition by p_brand, p_type) first, count(*) over (partition by p_brand) n_total,
row_number() over (partition by p_brand order by p_partkey) o from t),
k as (select *, {head} head, row_number() over (partition by p_brand order by {order}) i from h),
s as (select *, {frame} frame, sum(length(head) + length(body)) over (partition by p_brand order by i rows unbounded preceding) used from k),
c as (select p_brand, any_value(frame) frame, any_value(n_total) n_total, count(*) filter (used <= 1600 - length(frame) - 200) n_included,
coalesce(string_agg({glue} || head || body, '' order by i) filter (used <= 1600 - length(frame) - 200), '') shown from s group by p_brand),
d as (select p_brand, n_total, n_included, n_included < n_total truncated, frame || chr(10) || shown || chr(10) || '---' || chr(10) || case when n_included < n_total
then {note} || chr(10) || chr(10) else '' end || {end} context from c),
p as (select p_brand, p_type, min(o) o from s join c using (p_brand) where o <= c.n_included group by all),
q as (select p_brand, string_agg(p_type, '|' order by o) files from p group by 1)
select p_brand, sha256(context) context_sha, n_included, n_total, ceil(length(context) / 4.0)::bigint tokens, truncated, coalesce(files, '') files from d left join q using (p_brand)"""


_COMPONENTS = "(contains(path, 'components') or contains(path, '.tsx')) and kind in ('function', 'class')"
_TYPES = "(contains(path, 'types') or contains(path, '.d.ts')) and kind in ('interface', 'type')"
SQL = {
    "rerank_provider": plans.SQL["rerank_results"],
    "rerank_failed": f"with {plans._RRF} select id, combined_score score, combined_score original_score from rrf order by combined_score desc, id limit 10",
    "completed_jobs": """select distinct user_id from events where ts < '2024-01-30' and user_id not in
(select user_id from events where ts >= '2024-01-30' and value > 50 and user_id is not null) and user_id is not null""",
    "citation_links": """with r as (select *, case when p_size <> 1 then p_size end s, case when p_partkey % 3 > 0 then p_size + p_partkey % 2 end e,
ceil(p_partkey * p_partkey * 37 / 1000.0)::bigint as secs from part), t as (select *, ceil(secs / 60.0)::bigint as mins from r), u as (select *, ceil(mins / 60.0)::bigint as hours from t)
select p_partkey, case when s is null then '' when e <> s then ':' || s || '-' || e else ':' || s end shown,
case when s is null then '' when e <> s then '#L' || s || '-L' || e else '#L' || s end mark, p_type as owner, p_name repo, substr(sha256(p_name), 1, 7) short,
p_partkey % 2 <> 0 newer, case when secs < 60 then '~' || secs || ' secondes' when mins < 60 then '~' || mins || ' minute' || case when mins > 1 then 's' else '' end
else '~' || hours || ' heure' || case when hours > 1 then 's' else '' end end takes from u""",
    "index_size": f"""select count(*) chunks, sum(len({plans._W.format('source')}))::bigint words_A, sum(len({plans._W.format('lang')}))::bigint words_B,
sum(len({plans._W.format('text')}))::bigint words_C from documents""",
    "index_text_rank": plans.SQL["text_rank"],
    "index_text_match": plans.SQL["text_and_match"],
    "index_bm25": plans.SQL["text_bm25"],
    "strategy_metadata": f"with {_CH}, {_ranked('metadata', _meta(_COMPONENTS, 100, 1.0))}",
    "strategy_symbol": f"""with {_CH}, y as (select id, {plans._sim('symbol', QUESTION)} score from ch where symbol is not null),
z as (select id, score, row_number() over (order by score desc, id) + 1000000 ord from y where score >= 0.3 qualify ord <= 1000020), {_ranked('symbol', 'select * from z')}""",
    "strategy_symbol_fallback": f"with {plans._RRF}, {_ranked('hybrid_v2', _RRF_30)}",
    "strategy_hybrid_v2": f"with {plans._RRF}, {_ranked('hybrid_v2', _RRF_30)}",
    "strategy_hybrid": f"with {plans._VEC}, {plans._TXT}, {_CH}, {_weighted(15)}, {_ranked('hybrid', 'select * from wt union all ' + _meta(_TYPES, 50, 1.0))}",
    "strategy_expanded": f"""with {plans._RRF}, {_CH}, r30 as ({_RRF_30}), e as ({_meta("contains(path, 'hooks') or contains(path, 'api/')", 50, 0.9)}),
{_ranked('expanded', 'select * from e union all select * from r30')}""",
    "strategy_vector": f"with {plans._VEC}, {plans._TXT}, {_weighted(30)}, {_ranked('vector', 'select * from wt')}",
    "context_grouped": _context_sql(True),
    "context_sequential": _context_sql(False),
}
