"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 in `DIMENSIONS` dimensions, drawn by its code point. A trigram's vector
binds (multiplies) those of its letters, the first permuted (rolled) twice, the second once. A text bundles (adds) the
vectors of its trigrams, a language those of all its texts; a text gets the language whose prototype has the highest
cosine with it.

Scale: learning adds vectors within tasks; one vector per language leaves a task and they are summed in Spark. The
prototypes (4 KB a language) come to the driver and go to every task. Prediction is one pass without shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, hold_batches, slices, with_text

DIMENSIONS, SEED = 1024, 20240229
#: Languages whose sums a task holds before it lets them go.
HELD = 512
#: Trigrams that are bound at once.
BOUND = 1024


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(cp).isalpha() for cp in range(0x110000)), bool, 0x110000)


@lru_cache(20_000)
def _letter(point: int) -> np.ndarray:
    """Vector of a letter; that of point 0 stands for what lies between words."""
    return np.random.default_rng((SEED, point)).integers(0, 2, DIMENSIONS, np.int8) * np.int8(2) - np.int8(1)


def trigrams(text: str | None) -> np.ndarray:
    """Every trigram of a text's letters, as a number; what lies between words is one sign. None without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    s = np.where(_is_letter()[points], points, 0)
    if not s.any():
        return np.empty(0, np.int64)
    s = np.concatenate(([0], s, [0]))
    s = s[(s != 0) | np.concatenate(([True], s[:-1] != 0))]
    return s[:-2] << 42 | s[1:-1] << 21 | s[2:]


def bundle(grams: np.ndarray) -> np.ndarray:
    """Sum of the trigrams' vectors."""
    grams, counts = np.unique(grams, return_counts=True)
    letters, code = np.unique(np.concatenate((grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF)), return_inverse=True)
    vectors = np.stack([_letter(int(p)) for p in letters]) if len(letters) else np.empty((0, DIMENSIONS), np.int8)
    twice, once = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    a, b, c = code.reshape(3, -1)
    out = np.zeros(DIMENSIONS)
    for i in range(0, len(grams), BOUND):
        on = slice(i, i + BOUND)
        bound = twice[a[on]] * once[b[on]] * vectors[c[on]]
        out += counts[on].astype(np.float32) @ bound.astype(np.float32)
    return out


@dataclass
class Model:
    languages: list[str]
    prototypes: np.ndarray


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Prototypes of all languages of `labelled`. Null languages and texts without a letter teach nothing."""

    def add(batches):
        sums: dict[str, np.ndarray] = {}

        def told():
            names = list(sums)
            values = pa.array(np.concatenate([sums[x] for x in names]))
            offsets = pa.array(np.arange(0, DIMENSIONS * len(names) + 1, DIMENSIONS, dtype=np.int32))
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.ListArray.from_arrays(offsets, values)], ["lang", "v"])

        for part in slices(batches):
            of: dict[str, list] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                of.setdefault(lang, []).append(trigrams(text))
            for lang, grams in of.items():
                sums[lang] = sums.get(lang, 0) + bundle(np.concatenate(grams))
            if len(sums) >= HELD:
                yield told()
        if sums:
            yield told()

    hold_batches(labelled)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null")
    parts = rows.mapInArrow(add, "lang string, v array<double>").select("lang", F.posexplode("v").alias("at", "x"))
    sums = parts.groupBy("lang", "at").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v"))
    got = sums.select("lang", F.transform("v", lambda x: x["x"].cast("float")).alias("v")).toArrow().sort_by("lang")
    languages = got["lang"].to_pylist()
    out = np.asarray(got["v"].combine_chunks().flatten(), np.float32).reshape(-1, DIMENSIONS)
    taught = np.flatnonzero(out.any(axis=1))
    out = out[taught] / np.linalg.norm(out[taught], axis=1, keepdims=True)
    return Model([languages[i] for i in taught], out)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns of `docs` (all by default) with `lang_pred` and `score` (under names that don't clash).

    score is the cosine, 0 at least. A text that is null or has no letter, or any if no language was learned, is
    `und` with score 0. Ties go to the language first in order.
    """
    kept = docs.columns if keep is None else keep
    languages, prototypes = model.languages, model.prototypes
    c_lang, c_score = fresh(docs, "lang_pred", "score")
    rows, at, _ = with_text(docs, kept, text_col)
    schema = docs.select(*kept).schema.add(c_lang, "string").add(c_score, "double")

    def judge(batches):
        for part in slices(batches):
            said, scores = [], []
            for t in part.column(at).cast(pa.string()).to_pylist():
                grams = trigrams(t)
                if not len(grams) or not languages:
                    said.append("und")
                    scores.append(0.0)
                    continue
                v = bundle(grams)
                cosine = prototypes @ v / max(np.sqrt(v @ v), 1e-9)
                best = int(np.argmax(cosine))
                said.append(languages[best])
                scores.append(float(min(1.0, max(0.0, cosine[best]))))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(said, pa.string()), pa.array(scores, pa.float64())], [*kept, c_lang, c_score])

    return rows.mapInArrow(judge, schema)
