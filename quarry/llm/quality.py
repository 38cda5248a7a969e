"""Quality classifier: n-gram indicators scaled by class log-count ratios, and a linear hinge-loss model.

Indicators are hashed n-grams of a text's words (1, 2) and of the words' shapes (1 to 3; letters, capitals and
digits in a row are one sign each, other signs stay, and a word that repeats the one before it has a shape of its
own). Every indicator that a text has is scaled by r, the log-ratio of the smoothed rates at which texts of either
class have it; a text's vector has length 1. A hinge-loss model is fitted on these by dual coordinate descent.

Scale: the counts behind r cover the labelled texts that are given (`LABELLED` bounds how many the queries give; one
partially aggregated pass; at most `BUCKETS` rows per class leave a task). The fit takes at most `FIT_PER_CLASS` texts of
each class, those with the lowest hash of their id and text, on the driver. Scoring is one pass without shuffle; the model sent to tasks is two arrays of `BUCKETS` numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import coded_words, fresh, hashes_of, hold_batches, ngrams, slices, with_text

BUCKETS = 1 << 18
FIT_PER_CLASS = 2000
#: Bound of the sample of labelled rows that a model is learned from.
LABELLED = 50_000
#: Texts of the training rows that must have an indicator before it counts.
LEAST_TEXTS = 5
REPEATED = np.uint64(0x5EED)


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every indicator that a text has, each once, sorted."""
    starts, vocabulary, codes = coded_words(texts, lower=False)
    shapes = pc.replace_substring_regex(vocabulary, r"\p{Ll}+", "a")
    shapes = pc.replace_substring_regex(shapes, r"\p{Lu}+", "A")
    shapes = pc.replace_substring_regex(shapes, r"\p{N}+", "0")
    word, shape = hashes_of(pc.utf8_lower(vocabulary))[codes], hashes_of(shapes)[codes]
    if len(codes) > 1:
        again = np.concatenate(([False], codes[1:] == codes[:-1]))
        again[starts[:-1][starts[:-1] < len(codes)]] = False
        shape = np.where(again, REPEATED, shape)
    keys = []
    for kind, (values, n) in enumerate(((word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3))):
        at, h = ngrams(starts, values, n)
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at)).astype(np.uint64)
        bucket = (h * np.uint64(2 * kind + 1) + np.uint64(kind)) >> np.uint64(64 - 18)
        keys.append(owner * np.uint64(BUCKETS) + bucket)
    key = np.unique(np.concatenate(keys)).astype(np.int64)
    return key // BUCKETS, key % BUCKETS


def _counted(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many texts of class 0 and 1 have each indicator (2 x BUCKETS), and how many texts there are of each."""

    def count(batches):
        sums, texts = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for part in slices(batches):
            label = np.asarray(part.column(1), np.int64)
            owner, bucket = indicators(part.column(0))
            np.add.at(sums, (label[owner], bucket), 1)
            texts += np.bincount(label, minlength=2)
        for c in (0, 1):
            at = np.flatnonzero(sums[c])
            at = np.concatenate((at, [BUCKETS]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), c)), pa.array(at), pa.array(np.concatenate((sums[c][at[:-1]], texts[c : c + 1])))], ["c", "b", "n"]
            )

    rows = labelled.select("text", "label").mapInArrow(count, "c long, b long, n long")
    got = rows.groupBy("c", "b").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((2, BUCKETS + 1), np.int64)
    sums[np.asarray(got["c"]), np.asarray(got["b"])] = np.asarray(got["n"])
    return sums[:, :-1], sums[:, -1]


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, rounds: int = 30, seed: int = 7):
    """Hinge-loss weights by dual coordinate descent; the last weight is the bias. `rows`: places of each example's
    values; `cost`: upper bound of each dual variable."""
    rng, w, alpha = np.random.default_rng(seed), np.zeros(size + 1), np.zeros(len(y))
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(y)):
            at, x = rows[i], values[i]
            slope = y[i] * (w[at] @ x + w[size]) - 1
            new = min(max(alpha[i] - slope / (x @ x + 1), 0.0), cost[i])
            if (step := new - alpha[i]) != 0:
                worst = max(worst, abs(slope))
                w[at] += step * y[i] * x
                w[size] += step * y[i]
                alpha[i] = new
        if worst < 1e-2:
            break
    return w


def train(labelled: DataFrame, fit_per_class: int = FIT_PER_CLASS, cost: float = 4.0) -> Model:
    """`labelled`: id, text, label (0 or 1). Null labels are left out; without both classes the score is the share
    of class 1 (0.5 without any row)."""
    hold_batches(labelled)
    rows = labelled.filter("label in (0, 1)").select("id", "text", F.col("label").cast("long").alias("label"))
    counts, texts = _counted(rows)
    if not texts.all():
        share = np.clip((texts[1] + 0.5) / (texts.sum() + 1), 0.05, 0.95)
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)) if texts.any() else 0.0))
    rate = (counts + 1) / (texts[:, None] + 2)
    ratio = np.where(counts.sum(0) >= LEAST_TEXTS, np.log(rate[1] / rate[0]), 0)
    parts = []
    for c in (0, 1):
        # by the text too, so that ids that repeat or are null don't pass the bound; not the hash that chose the rows
        of = rows.filter(F.col("label") == c).withColumn("h", F.shiftrightunsigned(F.xxhash64("id", "text", F.lit(1)), 1))
        if texts[c] > fit_per_class:
            of = of.filter(F.col("h") < min(2.0**63, 2.0**64 * fit_per_class / texts[c])).orderBy("h").limit(fit_per_class)
        parts.append(of)

    def features(batches):
        for part in slices(batches):
            owner, bucket = indicators(part.column(0))
            cuts = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
            some = pa.ListArray.from_arrays(pa.array(cuts), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), some], ["label", "h", "at"])

    sample = parts[0].unionByName(parts[1]).select("text", "label", "h").mapInArrow(features, "label long, h long, at array<int>").toArrow()
    label = np.asarray(sample["label"])
    at, x, y = [], [], np.where(label == 1, 1.0, -1.0)
    lists = sample["at"].combine_chunks()
    flat, cuts = np.asarray(lists.flatten()), np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))))
    for i in range(len(y)):
        some = flat[cuts[i] : cuts[i + 1]]
        some = some[ratio[some] != 0]
        v = ratio[some]
        at.append(some)
        x.append(v / max(np.sqrt(v @ v), 1e-9))
    balance = np.where(label == 1, len(label) / max(1, 2 * (label == 1).sum()), len(label) / max(1, 2 * (label == 0).sum()))
    order = np.lexsort((np.asarray(sample["h"]), label))  # the order of rows must not depend on tasks; like rows are alike
    w = descend([at[i] for i in order], [x[i] for i in order], y[order], cost * balance[order], BUCKETS)
    return Model(ratio.astype(np.float32), w[:-1].astype(np.float32), float(w[-1]))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns of `docs` (all by default) with `score` in 0 to 1 (under a name that doesn't clash).

    0.5 and more means class 1. Null and empty texts have the score of a text without indicators; rows that repeat
    get the same score.
    """
    kept = docs.columns if keep is None else keep
    ratio, weight, bias = model.ratio, model.weight * model.ratio, model.bias
    (name,) = fresh(docs, "score")
    rows, at, _ = with_text(docs, kept, text_col)
    schema = docs.select(*kept).schema.add(name, "double")

    def judge(batches):
        for part in slices(batches):
            owner, bucket = indicators(part.column(at).cast(pa.string()))
            n = part.num_rows
            norm = np.sqrt(np.bincount(owner, np.square(ratio[bucket], dtype=np.float64), n))
            margin = np.bincount(owner, weight[bucket], n) / np.maximum(norm, 1e-9) + bias
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(1 / (1 + np.exp(-4 * np.clip(margin, -50, 50))))], [*kept, name])

    return rows.mapInArrow(judge, schema)
