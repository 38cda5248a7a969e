"""Search and cutting as SQL table functions: what the DataFrame operators find, for callers that write SQL.

`register` makes temporary functions over a view `chunks` (id, path, kind, symbol, content, embedding). The searches are SQL
table functions, which the optimizer puts into the query that calls them; the cutting of files and texts are Python
table functions, for lateral joins.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from quarry.operators import chunking
from quarry.operators.context import CITATION

_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> cast(x AS double) * cast(y AS double)), 0D, (s, x) -> s + x)"
_COSINE = f"try_divide({_DOT.format('embedding', 'query')}, sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format('query', 'query')}))"
_NEAR = f"SELECT id, similarity FROM (SELECT id, round(CASE WHEN size(embedding) = size(query) THEN {_COSINE} END, 9) AS similarity FROM chunks) WHERE similarity IS NOT NULL AND NOT isnan(similarity)"
_WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+', 0)"
_HIT = "size(filter({}, t -> array_contains(ws, t)))"
# weights of the fields: symbol 1, file and kind 0.4, content 0.2
_SAID = f"""SELECT id, round((1D * {_HIT.format('a')} + 0.4D * {_HIT.format('b')} + 0.2D * {_HIT.format('c')}) / (1D + ln(1D + size(a) + size(b) + size(c))), 9) AS score
FROM (SELECT id, {_WORDS.format('symbol')} AS a, concat({_WORDS.format("regexp_replace(path, '^.*/', '')")}, {_WORDS.format('kind')}) AS b, {_WORDS.format('content')} AS c,
array_distinct({_WORDS.format('question')}) AS ws FROM chunks) WHERE size(ws) > 0 AND size(array_except(ws, concat(a, b, c))) = 0"""
_GRAMS = r"array_distinct(flatten(transform(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+', 0), w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))"


def _like(name: str) -> str:
    a, b = _GRAMS.format(name), _GRAMS.format("pattern")
    return f"round(coalesce(try_divide(cast(size(array_intersect({a}, {b})) AS double), size(array_union({a}, {b}))), 0D), 9)"


def _place(rows: str, columns: str, order: str, k: str) -> str:
    """The first k rows in an order; the limit by row number goes into every task."""
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM ({rows})) WHERE place <= {k}"


_LEG = lambda rows, score, k: _place(rows, f"id, {score}, place", f"{score} DESC, id", k)
FUNCTIONS = {
    "match_chunks(query ARRAY<DOUBLE>, k INT, above DOUBLE) RETURNS TABLE(id BIGINT, similarity DOUBLE)": _place(
        f"SELECT * FROM ({_NEAR}) WHERE similarity > above", "id, similarity", "similarity DESC, id", "k"
    ),
    "hybrid_chunks(query ARRAY<DOUBLE>, question STRING, k INT, vector_weight DOUBLE, text_weight DOUBLE) RETURNS TABLE(id BIGINT, vector_score DOUBLE, text_score DOUBLE, combined_score DOUBLE)": _place(
        f"""SELECT *, round(vector_weight * vector_score + text_weight * text_score, 9) AS combined_score FROM (SELECT coalesce(v.id, t.id) AS id, coalesce(similarity, 0D) AS vector_score,
coalesce(score, 0D) AS text_score FROM ({_LEG(_NEAR, 'similarity', '2 * k')}) v FULL OUTER JOIN ({_LEG(_SAID, 'score', '2 * k')}) t ON v.id = t.id)""",
        "id, vector_score, text_score, combined_score", "combined_score DESC, id", "k",
    ),
    "fused_chunks(query ARRAY<DOUBLE>, question STRING, rrf INT, k INT, vector_limit INT, text_limit INT) RETURNS TABLE(id BIGINT, vector_score DOUBLE, text_score DOUBLE, combined_score DOUBLE)": _place(
        f"""SELECT coalesce(v.id, t.id) AS id, coalesce(similarity, 0D) AS vector_score, coalesce(score, 0D) AS text_score,
round(coalesce(1D / (rrf + v.place), 0D) + coalesce(1D / (rrf + t.place), 0D), 9) AS combined_score
FROM ({_LEG(_NEAR, 'similarity', 'vector_limit')}) v FULL OUTER JOIN ({_LEG(_SAID, 'score', 'text_limit')}) t ON v.id = t.id""",
        "id, vector_score, text_score, combined_score", "combined_score DESC, id", "k",
    ),
    "like_symbols(pattern STRING, only STRING, k INT) RETURNS TABLE(id BIGINT, symbol STRING, similarity DOUBLE)": _place(
        f"SELECT * FROM (SELECT id, symbol, {_like('symbol')} AS similarity FROM chunks WHERE symbol IS NOT NULL AND (only IS NULL OR kind = only)) WHERE similarity >= 0.3D",
        "id, symbol, similarity", "similarity DESC, id", "k",
    ),
    "like_files(pattern STRING, k INT) RETURNS TABLE(path STRING, chunk_count BIGINT, similarity DOUBLE)": _place(
        f"SELECT * FROM (SELECT path, chunk_count, {_like('path')} AS similarity FROM (SELECT path, count(*) AS chunk_count FROM chunks GROUP BY path)) WHERE similarity >= 0.3D",
        "path, chunk_count, similarity", "similarity DESC, path", "k",
    ),
}


@udtf(returnType="start_line int, end_line int, language string, chunk_type string, symbol string, content string, dependencies array<string>")
class CutFile:
    """The chunks of one file (path, content)."""

    def eval(self, path: str, content: str):
        if path is not None:
            for row in chunking.chunk(content, path):
                yield row[1:]


@udtf(returnType="place int, path string, start_line int, end_line int")
class Citations:
    """The citations [path:line] or [path:line-line] of a text, in order."""

    def eval(self, text: str):
        for i, m in enumerate(re.finditer(CITATION, text or "")):
            path, start, end = (*m.groups(), None, None)[:3]
            yield i, path, int(start) if start else None, int(end) if end else None


def register(spark: SparkSession, chunks: DataFrame) -> None:
    """Make the functions, over these chunks."""
    chunks.createOrReplaceTempView("chunks")
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("cut_file", CutFile)
    spark.udtf.register("citations", Citations)


def vector(values) -> str:
    """A vector as a SQL literal."""
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"
