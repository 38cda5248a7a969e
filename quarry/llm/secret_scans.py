"""Secret scans: rules, and character Markov models compared by log-likelihood ratio. DataFrame functions only.

Two first-order character models, of random strings and of ordinary identifiers, are counted from labelled
samples. A token of `LEAST` or more characters of the key alphabet whose log-likelihood ratio is at least
`RATIO` is reported as `random`, unless it lies within what a rule has found. Rules (`assign`, `access`, `hex`) are
matched leftmost and without overlap, each kind for itself, over whole texts.

Scale: a scan is one narrow projection, without shuffle; each text is handled by itself, however long, and
the model is a constant of 128 x 128 numbers. Training reads a bounded sample of texts (`SAMPLE_DOCS`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh

# Fixed values of the rules.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
LEAST, RATIO = 20, 25.0
SAMPLE_DOCS, SAMPLE_STRINGS = 2000, 4000
CODES = 128


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled strings (string, random): hashes in five alphabets, and words of about SAMPLE_DOCS texts, alone and
    joined as identifiers are. The texts are those of the lowest hash of id and text, so null ids and ids that repeat
    pass no bound; what rows that repeat wholly say counts once."""
    n = docs.count()
    some = docs
    if n > SAMPLE_DOCS:
        some = docs.filter(F.shiftrightunsigned(F.xxhash64(id_col, text_col), 1) < 2.0**63 * SAMPLE_DOCS / n)
    word = F.explode(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(r"[A-Za-z]{2,}"), 0))
    words = some.select(word.alias("w")).distinct()
    other = F.reverse("w")  # a second word's stand-in: what joins matters, not which words
    names = words.select(
        F.explode(F.array("w", F.lower("w"), F.concat_ws("_", F.lower("w"), F.lower("w")), F.concat("w", F.initcap("w")), F.concat_ws("-", F.lower("w"), F.lower("w")), F.concat_ws("/", F.lower("w"), F.lower(other)), F.upper("w"))).alias("string"),
        F.lit(False).alias("random"),
    )
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.base64(F.unhex(digest))
    random = docs.sparkSession.range(SAMPLE_STRINGS).select(
        F.explode(F.array(digest, base64, F.regexp_replace(base64, "[+/=]", ""), F.upper(F.regexp_replace(base64, "[+/=]", "")), F.lower(F.regexp_replace(base64, "[+/=]", "")))).alias("string"),
        F.lit(True).alias("random"),
    )
    return names.unionByName(random)


def _codes(string: Column) -> Column:
    return F.transform(F.split(string, ""), lambda c: F.least(F.ascii(c), F.lit(CODES - 1)))


def train(strings: DataFrame) -> list[float]:
    """Log-likelihood ratios (random over identifier) of each character after each other, add-a-half smoothed;
    code 0 before the first character. `strings`: string, random; null and empty strings are left out."""
    rows = strings.filter("string is not null and string <> '' and random is not null")
    codes = rows.select("random", F.concat(F.array(F.lit(0)), _codes(F.col("string"))).alias("c"))
    pairs = codes.select(
        "random", F.explode(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("a"), F.slice("c", 2, F.size("c")).alias("b"))).alias("p")
    )
    counted = pairs.groupBy("random", F.col("p.a").alias("a"), F.col("p.b").alias("b")).count().collect()
    sums = {True: [0.5] * CODES**2, False: [0.5] * CODES**2}
    for r in counted:
        sums[r["random"]][r["a"] * CODES + r["b"]] += r["count"]
    out = []
    for a in range(CODES):
        row = slice(a * CODES, (a + 1) * CODES)
        yes, no = sums[True][row], sums[False][row]
        out += [math.log(x / sum(yes)) - math.log(y / sum(no)) for x, y in zip(yes, no, strict=True)]
    return out


def ratio(string: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string under a model of `train`."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")
    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))
    return F.aggregate(
        _codes(string), start,
        lambda a, c: F.struct(c.alias("before"), (a["sum"] + F.get(table, a["before"] * CODES + c)).alias("sum")),
        lambda a: a["sum"],
    )


def _placed(text: Column, pattern: str, matches: Column, kind: int) -> Column:
    """(start, kind, end) of each match: texts between matches and the matches themselves, measured in turn.

    Taken in pieces of as many matches as there are pieces, so that n matches cost n ** 1.5 steps: a fold that appends
    to an array copies it each time."""
    gaps = F.split(text, pattern, -1)
    n = F.size(matches)
    piece = F.ceil(F.sqrt(n)).cast("int")
    lengths = F.transform(F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, n).alias("g")), lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["m"]).alias("m")))
    # an argument of a function is computed once, what stands in a lambda once for each element
    pieces = F.transform(F.array(lengths), lambda x: F.transform(F.sequence(F.lit(0), piece - 1), lambda k: F.slice(x, k * piece + 1, piece)))[0]
    empty_at = F.expr("cast(array() as array<struct<part: array<struct<g: int, m: int>>, at: int>>)")
    begun = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), empty_at.alias("out")),
        lambda a, p: F.struct(
            F.aggregate(p, a["at"], lambda at, x: at + x["g"] + x["m"]).alias("at"),
            F.concat(a["out"], F.array(F.struct(p.alias("part"), a["at"].alias("at")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    empty = F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")
    placed = F.transform(
        begun,
        lambda p: F.aggregate(
            p["part"],
            F.struct(p["at"].alias("at"), empty.alias("out")),
            lambda a, x: F.struct(
                (a["at"] + x["g"] + x["m"]).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("start"), F.lit(kind).alias("kind"), (a["at"] + x["g"] + x["m"]).alias("end")))).alias("out"),
            ),
            lambda a: a["out"],
        ),
    )
    return F.when(n > 0, F.flatten(placed)).otherwise(empty)


def _number(start: Column, end: Column) -> Column:
    return F.shiftleft(start.cast("long"), 32) + end


def scan(docs: DataFrame, model: list[float], text_col: str = "text") -> DataFrame:
    """`docs` with `base` and `spans` (under names that don't clash): arrays of (start, kind, end), sorted, kind being
    a place in KINDS; code points, end exclusive. base has what the rules find, spans also what the models add.

    A null text is empty; empty texts have no spans; rows that repeat are each scanned; other columns stay.
    """
    text, c_base, c_spans, *names = fresh(docs, "text_", "base", "spans", "assign", "value", "access", "hex", "token", "good", "placed", "added")
    assign, value, access, hexes, tokens, good, placed, added = names
    t = F.col(text)
    found = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumns(
        {
            assign: F.regexp_extract_all(t, F.lit(ASSIGN), 0),
            access: F.when(t.contains("AKIA"), F.regexp_extract_all(t, F.lit(ACCESS), 0)).otherwise(F.array().cast("array<string>")),
            hexes: F.regexp_extract_all(t, F.lit(HEX), 0),
            tokens: F.regexp_extract_all(t, F.lit(TOKEN), 0),
        }
    )
    found = found.withColumn(value, F.when(F.size(assign) > 0, F.regexp_extract_all(t, F.lit(ASSIGN), 2)))
    # a failing match keeps its place, so that others are counted from the right one
    pairs = F.arrays_zip(_placed(t, ASSIGN, F.col(assign), 0).alias("s"), F.col(assign).alias("m"), F.col(value).alias("v"))
    found = found.withColumn(good, F.when(F.size(assign) > 0, F.filter(pairs, lambda x: F.length(x["v"]) >= ASSIGN_LEAST)))
    none = F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")
    ruled = F.coalesce(F.transform(good, lambda x: x["s"]), none)
    base = F.array_sort(F.concat(ruled, _placed(t, ACCESS, F.col(access), 1), _placed(t, HEX, F.col(hexes), 2)))
    found = found.withColumn(c_base, base).withColumn(placed, _placed(t, TOKEN, F.col(tokens), 3))
    likely = F.filter(placed, lambda s, i: ratio(F.get(F.col(tokens), i), model) >= RATIO)
    # what lies within a rule's span: a token that is one, or one that an assignment's own text has. As numbers, for
    # which array_except hashes
    inside = F.transform(
        good,
        lambda x: F.transform(
            _placed(x["m"], TOKEN, F.regexp_extract_all(x["m"], F.lit(TOKEN), 0), 3),
            lambda s: _number(x["s"]["start"] + s["start"], x["s"]["start"] + s["end"]),
        ),
    )
    no_number = F.array().cast("array<bigint>")
    known = F.concat(F.transform(c_base, lambda s: _number(s["start"], s["end"])), F.coalesce(F.flatten(inside), no_number))
    new = F.array_except(F.transform(likely, lambda s: _number(s["start"], s["end"])), known)
    back = F.transform(new, lambda n: F.struct(F.shiftright(n, 32).cast("int").alias("start"), F.lit(3).alias("kind"), n.bitwiseAND(0xFFFFFFFF).cast("int").alias("end")))
    found = found.withColumn(added, F.when(F.size(placed) > 0, back).otherwise(none))
    found = found.withColumn(c_spans, F.array_sort(F.concat(c_base, added)))
    return found.drop(text, *names)


def written(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def mask(text: Column, spans: Column, put: str = "[SECRET]") -> Column:
    """Text with each run of overlapping spans replaced."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"), F.expr("cast(array() as array<string>)").alias("out"))
    pieces = F.aggregate(
        spans, start,
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.greatest(a["end"], s["end"]).alias("end"),
            F.when(
                (s["start"] >= a["at"]),
                F.concat(a["out"], F.array(F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(put))),
            ).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) > 0, pieces).otherwise(text)
