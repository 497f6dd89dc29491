"""Quality rules: base counts and a hashed n-gram logistic regression.

Base counts are over the whole text; lines and windows of words are equal when
64-bit hashes of their contents are. The classifier sees hashed words and pairs
of words, and hashed n-grams of 1 to 3 characters (code points), as log(1 +
count), each kind scaled to unit length. A long text is counted in slices, which
its n-grams run across. It is fitted by gradient steps on a bounded sample of ``labels.quality``
(about PER_CLASS rows of each label, within a bound of bytes), and its
margin is turned into a probability on a fifth of that sample held back. Rows
are scored in Arrow batches. A text is kept when no base rule fails and the
probability of quality 1 is at least KEEP.

A null or empty text has no words: all counts 0, base_failed. Without labels of
both kinds the classifier keeps everything the base rules keep (probability
1). Rows without a doc_id are left out; repeated rows are scored each. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake.llm.features import blocks_of, char_counts, code_points, platt, sigmoid, word_counts
from finlake.llm.kernels import SPACE, U64, fold, mix, slices, span_hashes, text_bytes, word_hashes
from finlake.llm.sampling import labelled_texts
from finlake.llm.scratch import arrow_map, documents, in_sample

WORD_BUCKETS, CHAR_BUCKETS, ORDERS, PER_CLASS = 8192, 8192, (1, 2, 3), 1200
#: Fixed thresholds of the rules.
MIN_WORDS, MOST_REPEATED, KEEP, WINDOW = 10, 20, 0.3, 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _more_than_once(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is found twice or more in its row, is not the first of its row)."""
    if not len(hashes):
        return np.zeros(0, bool), np.zeros(0, bool)
    _, first, back, count = np.unique(mix(hashes + row.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(hashes), bool)
    later[first] = False
    return count[back] > 1, later


def base_counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    rows = len(bounds) - 1

    def per_row(flags: np.ndarray) -> np.ndarray:
        if rows == 1:
            return np.array([np.count_nonzero(flags)])
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[bounds[1:]] - sums[bounds[:-1]]

    hashes, row = word_hashes(data, bounds)
    n_words = np.bincount(row, minlength=rows)
    repeated = np.zeros(len(hashes) + WINDOW, bool)
    full = len(hashes) - WINDOW + 1
    if full > 0:
        at = np.flatnonzero(row[:full] == row[WINDOW - 1 :])
        twice, _ = _more_than_once(fold([hashes[at + k] for k in range(WINDOW)], 1), row[at])
        for k in range(WINDOW):
            repeated[at[twice] + k] = True
    # Lines: cut at \n and at the ends of rows.
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.unique(np.concatenate((bounds[:-1], breaks + 1)))
    begin = begin[begin < len(data)]
    stop = np.concatenate((begin[1:], [len(data)])) if len(begin) else begin
    stop = stop - ((stop > begin) & (data[np.maximum(stop - 1, 0)] == 0x0A)) if len(begin) else stop
    inside = ~SPACE[data]
    worded = np.logical_or.reduceat(inside, begin) if len(begin) else np.zeros(0, bool)
    begin, stop = begin[worded], stop[worded]
    line_row = np.searchsorted(bounds, begin, "right") - 1
    _, later = _more_than_once(span_hashes(data, begin, stop), line_row)
    return {
        "n_words": n_words,
        "word_chars": per_row(inside & ((data & 0xC0) != 0x80)),
        "n_symbols": per_row(SYMBOLS[data]),
        "n_dup_lines": np.bincount(line_row[later], minlength=rows),
        "n_repeat_words": np.bincount(row[repeated[: len(row)]], minlength=rows),
    }


def _char_counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Counts of character n-grams, slice by slice; each slice is given the first characters of the next, so that n-grams across the cut are counted once."""
    more = max(ORDERS) - 1
    total, (points, at) = 0, (np.zeros(0, np.uint32), np.zeros_like(bounds))
    for part in slices(data, bounds):
        following, next_at = code_points(*part)
        total = total + char_counts(np.concatenate((points, following[:more])), at + np.minimum(next_at, more), ORDERS, CHAR_BUCKETS, starts=len(points))
        points, at = following, next_at
    return total + char_counts(points, at, ORDERS, CHAR_BUCKETS)


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    chars = _char_counts(data, bounds)
    parts = [np.log1p(word_counts(data, bounds, WORD_BUCKETS)), np.log1p(chars)]
    parts = [p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9) for p in parts]
    return np.concatenate(parts, axis=1).astype(np.float32)


def fit(texts: list[str], y: np.ndarray, seed: int = 6, steps: int = 300, rate: float = 0.02, decay: float = 1e-4) -> dict | None:
    """Weights, offset and calibration; None if there is only one label."""
    y = np.asarray(y, float)
    if len(set(y.tolist())) < 2:
        return None
    x = np.concatenate([features(*text_bytes(b)) for b in blocks_of(texts)])
    held = np.arange(len(y)) % 5 == 0 if min((y == 1).sum(), (y == 0).sum()) >= 25 else np.zeros(len(y), bool)
    xs, ys = x[~held], y[~held]
    balance = np.where(ys == 1, 0.5 / max((ys == 1).sum(), 1), 0.5 / max((ys == 0).sum(), 1)).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        miss = ((sigmoid(xs @ w + b) - ys) * balance).astype(np.float32)
        g, gb = xs.T @ miss + decay * w, float(miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    on = held if held.any() else ~held
    a, c = platt(x[on] @ w + b, y[on])
    return {"w": w, "b": b, "slope": a, "offset": c}


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 6) -> dict | None:
    sample = labelled_texts(docs, labels.where(in_sample(F.col("doc_id"))), "quality", per_class, seed)
    return fit(sample["text"].tolist(), sample["label"].to_numpy(), seed)


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, the base counts, base_failed, p_quality and kept for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def columns(block: pa.RecordBatch) -> dict:
        m = shared.value
        data, bounds = text_bytes(block.column("text"))
        out = base_counts(data, bounds)
        failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
        p = np.ones(block.num_rows) if m is None else sigmoid(m["slope"] * (features(data, bounds) @ m["w"] + m["b"]) + m["offset"]).astype(float)
        return out | {"doc_id": block.column("doc_id"), "base_failed": failed, "p_quality": p, "kept": ~failed & (p >= KEEP)}

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_quality double, kept boolean"
    return arrow_map(rows, columns, schema, rows=128)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op6_quality": op6_quality}
ORACLE: dict[str, str] = {}
