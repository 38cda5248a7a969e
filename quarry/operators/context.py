"""Contexts for answers: packing by budget, formats, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: how a citation is written.
CITATION = r"\[([a-zA-Z0-9_\-./()]+/[a-zA-Z0-9_\-./()]+\.[a-zA-Z0-9]+)(?::(\d+)(?:-(\d+))?)?\](?!\()"
RESERVE = 200


def format_chunk(path: Column, start: Column, end: Column, kind: Column, symbol: Column, language: Column, content: Column, context: Column | None = None, score: Column | None = None) -> Column:
    """A chunk as Markdown: place, symbol, description, relevance, code."""
    none = F.lit(None).cast("string")
    place = F.concat(F.lit("### ["), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("]"))
    named = F.when(F.length(symbol) > 0, F.concat(F.lit("**"), kind, F.lit("**: `"), symbol, F.lit("`")))
    told = none if context is None else F.when(F.length(context) > 0, F.concat(F.lit("\n> "), context))
    sure = none if score is None else F.concat(F.lit("_Relevance: "), F.round(score * 100, 0).cast("int").cast("string"), F.lit("%_"))
    return F.concat_ws("\n", place, named, told, sure, F.lit(""), F.concat(F.lit("```"), language), content, F.lit("```"), F.lit(""))


def prefix_pack(chunks: DataFrame, budget: int, length: str, order: list[Column], by: list[str] = ()) -> DataFrame:
    """Chunks in order up to the first that overflows the budget (of each group), with `used` so far."""
    w = Window.partitionBy(*by).orderBy(*order)
    used = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # lengths are no less than 0, so once over the budget every later sum is over it too
    return chunks.withColumn("used", used).filter(F.col("used") <= budget)


def grouped_pack(chunks: DataFrame, budget_tokens: int, path: str, start: str, text: str, order: str, by: list[str] = ()) -> DataFrame:
    """One row per group: files in order of first appearance, chunks by line, packed up to the first overflow of
    4 characters a token less the reserve; `context`, `n_chunks`, `n_files`."""
    keys = list(by)
    first = F.min(order).over(Window.partitionBy(*keys, path))
    sized = chunks.withColumn("_first", first).withColumn("_len", F.length(text))
    ordering = [F.col("_first"), F.col(path), F.col(start), F.col(order)]
    packed = prefix_pack(sized, budget_tokens * 4 - RESERVE, "_len", ordering, keys)
    rows = packed.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_first", path, start, F.col(text).alias("text")))).alias("c"),
        F.count("*").alias("n_chunks"), F.countDistinct(path).alias("n_files"), F.sum("_len").alias("n_chars"),
    )
    return rows.withColumn("context", F.array_join(F.transform("c", lambda x: x["text"]), "\n")).drop("c")


# What stands around the chunks of a context, by language; {n} and {of} are how many it has, and of how many.
FRAMES = {
    "fr": {
        "head": ("## Code source pertinent", "J'ai trouve {of} section(s) de code pertinente(s) dans le repository:"),
        "note": "_Note: {n}/{of} sections affichees (limite de tokens atteinte)_",
        "end": ("Utilise ces informations pour repondre avec precision.", "Cite toujours les fichiers avec le format `[chemin:lignes]`."),
        "none": "Aucun code pertinent trouve dans le repository.",
    },
    "en": {
        "head": ("## Relevant Source Code", "Found {of} relevant code section(s) in the repository:"),
        "note": "_Note: Showing {n}/{of} sections (token limit reached)_",
        "end": ("Use this information to answer accurately.", "Always cite files using the format `[path:lines]`."),
        "none": "No relevant code found in the repository.",
    },
}
# Fixed value: tokens of the context that says that nothing was found.
TOKENS_OF_NONE = 10


def _filled(pattern: str, **values: Column) -> Column:
    out = F.lit(pattern)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def whole(chunks: DataFrame, by: list[str], budget_tokens: int, path: str, start: str, order: str, formatted: Column, grouped: bool = True, language: str = "fr") -> DataFrame:
    """One row per group (a question): its whole `context` with head and end, `n_included`, `n_total`, `tokens`, `truncated`,
    and `files`, the distinct paths of as many chunks as were included, in their own order.

    Chunks (unique `order` in a group) are taken in that order or, if grouped, file by file in order of their first chunk
    and by line inside, each file under its path, up to the first that overflows 4 characters a token less the head and
    the reserve. Only texts that fit are gathered, so a group's row is no larger than its budget. Without groups (`by` empty) an empty
    table gives the message for no chunks.
    """
    frame, keys = FRAMES[language], list(by)
    line = F.concat(F.lit("## 📄 "), F.col(path), F.lit("\n\n"))
    rows = chunks.select(*keys, F.col(path).alias("_path"), F.col(start).alias("_start"), F.col(order).alias("_ord"), formatted.alias("_body"), line.alias("_line"))
    group, file = Window.partitionBy(*keys), Window.partitionBy(*keys, "_path")
    first = F.min("_ord").over(file)
    opens = F.row_number().over(file.orderBy("_start", "_ord")) == 1
    rows = rows.withColumns({"_of": F.count("*").over(group), "_o": F.row_number().over(group.orderBy("_ord"))})
    rows = rows.withColumns({"_first": first, "_open": opens & F.lit(grouped)})
    walk = group.orderBy("_first", "_start", "_ord") if grouped else group.orderBy("_ord")
    head = F.concat(F.lit(frame["head"][0] + "\n\n"), _filled(frame["head"][1], of=F.col("_of")), F.lit("\n"))
    piece = F.when(F.col("_open"), F.concat("_line", "_body")).otherwise(F.col("_body"))
    rows = rows.withColumns({"_piece": piece, "_i": F.row_number().over(walk)}).withColumn("_head", head)
    used = F.sum(F.length("_piece")).over(walk.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = used <= budget_tokens * 4 - F.length("_head") - RESERVE
    parted = F.when((F.col("_i") > 1) & (F.col("_open") if grouped else F.lit(True)), F.lit("\n")).otherwise(F.lit(""))
    rows = rows.withColumn("_fits", fits).withColumn("_piece", F.concat(parted, "_piece"))
    ordered = lambda when, *what: F.array_sort(F.collect_list(F.when(when, F.struct(*what))))
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("n_total"), F.count_if("_fits").alias("n_included"), F.first("_head").alias("_head"), ordered(F.col("_fits"), "_i", "_piece").alias("_pieces"),
        # each chunk that fits has a character at least
        ordered(F.col("_o") <= budget_tokens * 4, "_o", "_path").alias("_paths"),
    )
    found = found.withColumn("truncated", F.col("n_included") < F.col("n_total"))
    shown = F.array_join(F.transform("_pieces", lambda x: x["_piece"]), "")
    note = F.when(F.col("truncated"), F.concat(_filled(frame["note"], n=F.col("n_included"), of=F.col("n_total")), F.lit("\n\n"))).otherwise(F.lit(""))
    text = F.concat("_head", F.lit("\n"), shown, F.lit("\n---\n"), note, F.lit("\n".join(frame["end"])))
    none = F.col("n_total") == 0
    files = F.array_distinct(F.transform(F.filter("_paths", lambda x: x["_o"] <= F.col("n_included")), lambda x: x["_path"]))
    out = found.withColumn("context", F.when(none, F.lit(frame["none"])).otherwise(text))
    tokens = F.when(none, F.lit(TOKENS_OF_NONE)).otherwise(F.ceil(F.length("context") / F.lit(4.0))).cast("long")
    return out.select(*keys, "context", "n_included", "n_total", tokens.alias("tokens"), "truncated", files.alias("files"))


def minimal(chunks: DataFrame, path: str, symbol: str, start: str, most: int = 5) -> DataFrame:
    """(path, symbols): the first symbols of each file, null ones left out."""
    rows = chunks.filter(F.col(symbol).isNotNull())
    rank = F.row_number().over(Window.partitionBy(path).orderBy(start, symbol))
    few = rows.select(path, symbol, start).withColumn("_r", rank).filter(F.col("_r") <= most)
    return few.groupBy(path).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", symbol))), lambda x: x[symbol]), ", ").alias("symbols"))


def file_context(chunks: DataFrame, path: str, wanted: str, start: str, text: str) -> DataFrame:
    rows = chunks.filter(F.col(path) == wanted)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(start, text))), lambda x: x[text]), "\n\n")
    return rows.groupBy(path).agg(joined.alias("context"))


def citation(path: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("["), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("]"))


def with_prompt(base: Column, context: Column) -> Column:
    return F.concat_ws("\n\n", base, context)


def citations(df: DataFrame, text: str) -> DataFrame:
    """A row for each citation in a text: n, path, line, end_line, original, start_index, end_index. Links don't count."""
    t = F.col(text)
    whole = F.regexp_extract_all(t, F.lit(CITATION), 0)
    path, line, last = (F.regexp_extract_all(t, F.lit(CITATION), i) for i in (1, 2, 3))
    gaps = F.transform(F.split(t, CITATION, -1), lambda g: F.length(g))
    rows = df.filter(t.rlike(CITATION)).select("*", F.posexplode(F.arrays_zip(whole.alias("w"), path.alias("p"), line.alias("l"), last.alias("e"))).alias("_i", "_c"), gaps.alias("_g"), whole.alias("_w"))
    before = F.aggregate(F.slice("_g", 1, F.col("_i") + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(
        F.transform(F.slice("_w", 1, F.col("_i")), lambda x: F.length(x)), F.lit(0), lambda a, x: a + x
    )
    return rows.select(
        *df.columns, F.col("_i").alias("n"), F.col("_c.p").alias("path"), F.nullif(F.col("_c.l"), F.lit("")).cast("int").alias("line"),
        F.nullif(F.col("_c.e"), F.lit("")).cast("int").alias("end_line"), F.col("_c.w").alias("original"), before.alias("start_index"),
        (before + F.length("_c.w")).alias("end_index"),
    )


def segments(df: DataFrame, text: str) -> DataFrame:
    """A row for each piece of a text, in order: text between citations, and citations (is_citation)."""
    t = F.col(text)
    plain = F.transform(F.split(t, CITATION, -1), lambda g: F.struct(F.lit(False).alias("is_citation"), g.alias("piece")))
    cited = F.transform(F.regexp_extract_all(t, F.lit(CITATION), 0), lambda c: F.struct(F.lit(True).alias("is_citation"), c.alias("piece")))
    pairs = F.flatten(F.transform(F.arrays_zip(plain.alias("a"), cited.alias("b")), lambda x: F.array(x["a"], x["b"])))
    pieces = F.filter(pairs, lambda x: x.isNotNull() & (F.length(x["piece"]) > 0))
    return df.select("*", F.posexplode(pieces).alias("n", "_p")).select(*df.columns, "n", "_p.is_citation", "_p.piece")


def enriched(context: Column, content: Column) -> Column:
    """A chunk's text for its vector: its description before it, if there is one."""
    return F.when(F.length(F.trim(context)) > 0, F.concat_ws("\n\n", context, content)).otherwise(content)
