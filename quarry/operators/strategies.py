"""What each strategy of a question (`quarry.functions.routing.strategy`) searches, and how its parts are put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import routing
from quarry.operators import retrieval as R

METADATA_LIMIT, VECTOR_LIMIT, SYMBOL_LIMIT = 100, 30, 20
#: Ordinals of the second list of a union begin here; the first list is shorter.
SECOND = 1_000_000


def by_subject(chunks: DataFrame, subject: str, limit: int = METADATA_LIMIT) -> DataFrame:
    """Chunks (id, path, start_line, kind, symbol) that fit the subject's preset, in order of path and line, score 1; none
    for a subject without a preset."""
    preset = routing.PRESETS.get(subject)
    if preset is None:
        return _numbered(chunks.filter(F.lit(False)), 1.0)
    patterns, kinds, symbol = preset
    return _numbered(_first(R.by_metadata(chunks, "path", "kind", "symbol", patterns, kinds, symbol), limit), 1.0)


def by_patterns(chunks: DataFrame, patterns: list[str], limit: int) -> DataFrame:
    """Chunks whose path contains any pattern of an expansion, in order of path and line, score 0.9."""
    found = chunks.filter(R.like_any(F.col("path"), list(patterns))) if patterns else chunks.filter(F.lit(False))
    return _numbered(_first(found, limit), 0.9)


def _first(chunks: DataFrame, limit: int) -> DataFrame:
    return R.top(chunks.select("id", "path", "start_line"), limit, F.col("path"), F.col("start_line"), F.col("id"))


def _numbered(few: DataFrame, score: float) -> DataFrame:
    """(id, score, ord) of at most `limit` rows."""
    return few.select("id", F.lit(score).alias("score"), F.row_number().over(Window.orderBy("path", "start_line", "id")).alias("ord"))


def _scored(few: DataFrame, score: str) -> DataFrame:
    return few.select("id", F.col(score).alias("score"), (F.row_number().over(Window.orderBy(F.desc(score), "id")) + SECOND).alias("ord"))


def run(
    strategy: str, chunks: DataFrame, vec: DataFrame, txt: DataFrame, question: str = "", subject: str = "GENERIC", patterns: list[str] = (),
    metadata_limit: int = METADATA_LIMIT, vector_limit: int = VECTOR_LIMIT,
) -> DataFrame:
    """(strategy, rank, id, score) of one question. `vec` (id, similarity) and `txt` (id, score) are its two legs; for an
    expanded question `txt` is the search for its words (`routing.search_words`).

    metadata: the subject's preset. symbol: symbols like the question, or if there are none hybrid_v2, under that name.
    hybrid_v2: both legs by their ranks. hybrid: half of the preset's rows and half of those of the weighted legs.
    expanded: half as many rows of the patterns, and hybrid_v2. vector: the weighted legs. A chunk that two parts find
    counts once, with its better score; ties stay in the order in which the parts found them.
    """
    if strategy == "symbol":
        found = R.fuzzy_symbols(chunks, question, "symbol", k=SYMBOL_LIMIT).select("id", F.col("similarity").alias("score"))
        # both lists are short: whether there is a symbol is told by a window over them, not by a search of its own
        both = _scored(found, "score").withColumn("own", F.lit(True)).unionByName(_scored(R.hybrid_rrf(vec, txt, vector_limit), "combined_score").withColumn("own", F.lit(False)))
        any_symbol = both.withColumn("symbols", F.max("own").over(Window.partitionBy()))
        rows = any_symbol.filter(F.col("own") == F.col("symbols")).withColumn("strategy", F.when(F.col("symbols"), "symbol").otherwise("hybrid_v2"))
    elif strategy == "metadata":
        rows = by_subject(chunks, subject, metadata_limit)
    elif strategy == "hybrid_v2":
        rows = _scored(R.hybrid_rrf(vec, txt, vector_limit), "combined_score")
    elif strategy == "hybrid":
        half = by_subject(chunks, subject, metadata_limit // 2)
        rows = half.unionByName(_scored(R.hybrid_weighted(vec, txt, vector_limit // 2), "combined_score"))
    elif strategy == "expanded":
        half = by_patterns(chunks, patterns, metadata_limit // 2)
        rows = half.unionByName(_scored(R.hybrid_rrf(vec, txt, vector_limit), "combined_score"))
    elif strategy == "vector":
        rows = _scored(R.hybrid_weighted(vec, txt, vector_limit), "combined_score")
    else:
        raise ValueError(f"no strategy {strategy}")
    if "strategy" not in rows.columns:
        rows = rows.withColumn("strategy", F.lit(strategy))
    best = R.dedupe_best(rows, "ord")
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "first_ord"))
    return best.select("strategy", rank.alias("rank"), "id", "score")


def weights_of(form: Column) -> Column:
    """(vector, text): the weights of the two legs for a question's form."""
    pair = lambda w: F.struct(F.lit(w[0]).alias("vector"), F.lit(w[1]).alias("text"))
    out = pair(routing.FORM_WEIGHTS["natural_language"])
    for name, weights in routing.FORM_WEIGHTS.items():
        out = F.when(form == name, pair(weights)).otherwise(out)
    return out


def _leg(rows: DataFrame, score: str, most: int) -> DataFrame:
    """The best rows of each question, with their place."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(score), "id"))
    return rows.select("qid", "id", score).withColumn("place", place).filter(F.col("place") <= most)


def weighted_many(questions: DataFrame, vec: DataFrame, txt: DataFrame, k: Column | int = 15) -> DataFrame:
    """(qid, id, score, place): per question the k best by the weighted sum of both legs' scores, of 2k rows each, 0 for a leg
    that lacks the row. `questions`: qid, weights (vector, text) and, if k is a Column of it, what that needs; `vec`: qid,
    id, similarity; `txt`: qid, id, score."""
    k = F.lit(k) if isinstance(k, int) else k
    asked = questions.select("qid", "weights", k.alias("k"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "id"))
    leg = lambda rows, score, name: (
        rows.select("qid", "id", F.col(score).alias("s")).withColumn("place", place).join(asked.select("qid", "k"), "qid")
        .filter(F.col("place") <= 2 * F.col("k")).select("qid", "id", F.col("s").alias(name))
    )
    both = leg(vec, "similarity", "v").join(leg(txt, "score", "t"), ["qid", "id"], "full_outer").join(asked, "qid")
    score = F.col("weights.vector") * F.coalesce("v", F.lit(0.0)) + F.col("weights.text") * F.coalesce("t", F.lit(0.0))
    scored = both.select("qid", "id", "k", F.round(score, R.DIGITS).alias("s")).withColumn("place", place)
    return scored.filter(F.col("place") <= F.col("k")).select("qid", "id", F.col("s").alias("score"), "place")


def rrf_many(vec: DataFrame, txt: DataFrame, k: int = VECTOR_LIMIT, per_leg: int = 50) -> DataFrame:
    """(qid, id, score, place): per question the k best by reciprocal rank fusion of both legs."""
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(R.RRF_K)) + F.col(c)), F.lit(0.0))
    a = _leg(vec, "similarity", per_leg).select("qid", "id", F.col("place").alias("rv"))
    b = _leg(txt, "score", per_leg).select("qid", "id", F.col("place").alias("rt"))
    fused = a.join(b, ["qid", "id"], "full_outer").select("qid", "id", F.round(part("rv") + part("rt"), R.DIGITS).alias("score"))
    return _leg(fused, "score", k)


def by_subjects(chunks: DataFrame, limit: int = METADATA_LIMIT) -> DataFrame:
    """(subject, id, place): the first chunks of every subject's preset, in order of path and line; one scan for all."""
    def fits(name: str) -> Column:
        patterns, kinds, symbol = routing.PRESETS[name]
        test = F.lit(True)
        if patterns:
            test = test & R.like_any(F.col("path"), patterns)
        if kinds:
            test = test & F.col("kind").isin(kinds)
        if symbol:
            test = test & F.col("symbol").startswith(symbol.replace("%", ""))
        return F.when(F.coalesce(test, F.lit(False)), F.lit(name))

    subjects = F.array_compact(F.array(*[fits(name) for name in routing.PRESETS]))
    rows = chunks.select("id", "path", "start_line", F.explode(subjects).alias("subject"))
    place = F.row_number().over(Window.partitionBy("subject").orderBy("path", "start_line", "id"))
    return rows.withColumn("place", place).filter(F.col("place") <= limit).select("subject", "id", "place")


def run_many(
    questions: DataFrame, chunks: DataFrame, vec: DataFrame, txt: DataFrame, symbols: DataFrame, metadata_limit: int = METADATA_LIMIT, vector_limit: int = VECTOR_LIMIT
) -> DataFrame:
    """(qid, strategy, rank, id, score): every question by its own strategy, as `run` does one.

    `questions`: qid, strategy (of all but `expanded`), subject, weights; `vec` (qid, id, similarity), `txt` (qid, id, score) and `symbols`
    (qid, id, similarity, only the best ones of a question) are what the batch searches found."""
    asked = questions.select("qid", "strategy", "subject", "weights")
    found = symbols.select("qid").distinct().withColumn("known", F.lit(True))
    unknown = (F.col("strategy") == "symbol") & F.col("known").isNull()
    asked = asked.join(found, "qid", "left").withColumn("strategy", F.when(unknown, "hybrid_v2").otherwise(F.col("strategy"))).drop("known")
    of = lambda *names: asked.filter(F.col("strategy").isin(*names))
    only = lambda rows, *names: rows.join(of(*names).select("qid"), "qid", "left_semi")
    second = (F.col("place") + SECOND).alias("ord")
    limit = F.when(F.col("strategy") == "metadata", metadata_limit).otherwise(metadata_limit // 2)
    meta = of("metadata", "hybrid").join(F.broadcast(by_subjects(chunks, metadata_limit)), "subject").filter(F.col("place") <= limit)
    k = F.when(F.col("strategy") == "vector", vector_limit).otherwise(vector_limit // 2)
    parts = [
        meta.select("qid", "id", F.lit(1.0).alias("score"), F.col("place").alias("ord")),
        weighted_many(of("hybrid", "vector"), only(vec, "hybrid", "vector"), only(txt, "hybrid", "vector"), k).select("qid", "id", "score", second),
        rrf_many(only(vec, "hybrid_v2"), only(txt, "hybrid_v2"), vector_limit).select("qid", "id", "score", second),
        _leg(only(symbols, "symbol"), "similarity", SYMBOL_LIMIT).select("qid", "id", F.col("similarity").alias("score"), second),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    best = rows.groupBy("qid", "id").agg(F.max("score").alias("score"), F.min("ord").alias("first_ord"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "first_ord"))
    return best.withColumn("rank", rank).join(asked.select("qid", "strategy"), "qid").select("qid", "strategy", "rank", "id", "score")
