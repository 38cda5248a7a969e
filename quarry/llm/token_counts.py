"""Token counts by section: texts are encoded once, and tokens are attributed by their character spans.

A whole text is encoded with a byte-level vocabulary; the byte lengths of its tokens give their byte spans, and the
text's own bytes turn those into spans of code points. Sections are spans too; both are sorted, so an interval join
is a binary search per section boundary. A token that crosses a boundary goes to one section by `rule`:

first   the section that holds its first character
most    the section that holds most of its characters, the earlier one on a tie (the default)

Scale: one pass without shuffle. A task holds the vocabulary, read once per Python worker; the file `vocabulary` of the
driver's machine is sent to the others.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ._common import fresh, hold_batches, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A sentence's or line's end, with the white space after it. A run of signs is read once, from where it begins.
SENTENCE = r"(?<![.!?])[.!?]++\s+|\n\s*"
#: How the vocabulary's texts are cut into words before merging (a fixed value that belongs to it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space (as that pattern has it) beyond which it may fail.
LONG_BLANK = re.compile(r"[^\S\x1c-\x1f]{10000,}")


@lru_cache(2)
def _encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, rank in ranks.items():
        lengths[rank] = len(piece)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def _encoded(encoder, text: str) -> list[int]:
    """Tokens of a text. The encoder's pattern fails on very long white space, all of which but the last character
    before a word is one piece; such pieces are encoded by themselves."""
    out, at = [], 0
    for run in LONG_BLANK.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += encoder.encode_ordinary(text[at : run.start()]) + encoder._encode_single_piece(text[run.start() : end])
        at = end
    return out + encoder.encode_ordinary(text[at:]) if at else encoder.encode_ordinary(text)


def token_spans(text: str, vocabulary: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """First and last character (last exclusive) that each token of the text touches."""
    encoder, lengths = _encoder(vocabulary)
    ids = np.asarray(_encoded(encoder, text), np.int64)
    if not len(ids):
        return ids, ids
    raw = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths[ids])
    return character[ends - lengths[ids]], character[ends - 1] + 1


def section_ends(text: str, boundary: str = SENTENCE) -> np.ndarray:
    """Ends of the parts that a text has up to each match of `boundary`, with it; together they are the text."""
    ends = [m.end() for m in re.finditer(boundary, text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return np.array(ends, np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, s_start: np.ndarray, s_end: np.ndarray, rule: str) -> tuple[np.ndarray, int, int]:
    """(tokens per section, tokens in none, tokens that touch more than one). Sections are sorted and don't overlap."""
    n = len(s_start)
    if not len(starts) or not n:
        return np.zeros(n, np.int64), len(starts), 0
    low = np.searchsorted(s_end, starts, "right")  # the first section that ends after the token begins
    high = np.searchsorted(s_start, ends, "left") - 1  # the last section that begins before the token ends
    if rule == "first":
        at = np.where((low < n) & (s_start[np.minimum(low, n - 1)] <= starts), low, -1)
    else:
        at, most = np.full(len(starts), -1), np.zeros(len(starts), np.int64)
        for k in range(int((high - low).max(initial=0)) + 1):
            on = low + k
            there = on <= high
            i = np.minimum(on, n - 1)
            shared = np.where(there, np.minimum(ends, s_end[i]) - np.maximum(starts, s_start[i]), 0)
            at, most = np.where(shared > most, on, at), np.maximum(most, shared)
    return np.bincount(at[at >= 0], minlength=n), int((at < 0).sum()), int((high > low).sum())


def count_tokens(
    docs: DataFrame,
    text_col: str = "text",
    sections_col: str | None = None,
    rule: str = "most",
    vocabulary: str = VOCABULARY,
    boundary: str = SENTENCE,
    keep: list[str] | None = None,
) -> DataFrame:
    """The `keep` columns of `docs` (all by default) with n_tokens, section_tokens (array), outside, crossing, under
    names that don't clash.

    `sections_col`: array of (start, end) in code points, end exclusive, sorted and without overlap; without it a
    text's parts up to each match of `boundary` are its sections. `outside` counts tokens of no section, `crossing` those that touch several. Null
    and empty texts have 0 tokens; null sections are none.
    """
    if rule not in ("first", "most"):
        raise ValueError(rule)
    kept = docs.columns if keep is None else keep
    names = fresh(docs, "n_tokens", "section_tokens", "outside", "crossing")
    text, sections = fresh(docs, "text_", "sections_")
    schema = docs.select(*kept).schema
    for name in names:
        schema = schema.add(name, ArrayType(LongType()) if name == names[1] else LongType())

    docs.sparkSession.sparkContext.addFile(vocabulary)
    sent = os.path.basename(vocabulary)

    def count(batches):
        file = SparkFiles.get(sent)
        for part in slices(batches):
            total, per, outside, crossing = [], [], [], []
            spans = part.column(part.num_columns - 1).to_pylist()
            for t, given in zip(part.column(part.num_columns - 2).to_pylist(), spans, strict=True):
                t = t or ""
                starts, ends = token_spans(t, file)
                if sections_col is None:
                    s_end = section_ends(t, boundary)
                    s_start = np.concatenate(([0], s_end[:-1])) if len(s_end) else s_end
                else:
                    given = given or []
                    s_start = np.array([g["start"] for g in given], np.int64)
                    s_end = np.array([g["end"] for g in given], np.int64)
                tokens, no, many = attribute(starts, ends, s_start, s_end, rule)
                total.append(len(starts))
                per.append(tokens)
                outside.append(no)
                crossing.append(many)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-2], pa.array(total, pa.int64()), pa.array(per, pa.list_(pa.int64())), pa.array(outside, pa.int64()), pa.array(crossing, pa.int64())],
                [*kept, *names],
            )

    hold_batches(docs)
    given = F.lit(None).cast("array<struct<start: int, end: int>>") if sections_col is None else F.col(sections_col)
    return docs.select(*kept, F.col(text_col).cast("string").alias(text), given.alias(sections)).mapInArrow(count, schema)
