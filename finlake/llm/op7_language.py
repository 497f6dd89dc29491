"""Language identification by nearest centroids.

Letters are folded to lower case, other ASCII to blanks. Byte n-grams of 1 to 3
are hashed to BUCKETS counts, weighted log(1 + tf) * idf and scaled to unit
length. Each language has up to CENTROIDS unit centroids from spherical k-means
over a bounded sample (about PER_LANGUAGE rows of each language, within a
bound of bytes; all other steps read whole texts of all rows). A text takes
the language of the centroid with the largest cosine, which is the score. Where
the cosine falls below the language's rejection limit, the text is too far from
all that was learned: ``rejected``. The limit is MARGIN times a low quantile of
the cosines of one in HELD rows of the language's sample, held back from the
centroids that they are compared with, so a few odd rows do not set it. Texts
under SHORT bytes meet few n-grams of any centroid, so theirs falls with the
root of their bytes: one word of a learned language is no reason to reject.

A text that is null or has no letter: ``und``, score 0, rejected. Without any
row to learn from, every text is ``und``. Rows without a doc_id are left out;
repeated rows, and rows of one doc_id with other texts, are predicted and kept
each. lang, source and doc_id never reach the
model's features. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from finlake.llm.features import LETTERS, blocks_of, char_counts
from finlake.llm.kernels import text_bytes
from finlake.llm.sampling import texts_by
from finlake.llm.scratch import arrow_map, by_block, documents, in_sample

BUCKETS, ORDERS, CENTROIDS, PER_LANGUAGE = 4096, (1, 2, 3), 4, 400
#: A rejection limit is MARGIN times the LOW quantile of the cosines of held-back rows.
LOW, MARGIN, HELD, SHORT = 0.05, 0.5, 5, 64
#: A language with fewer rows holds none back; its limit comes from the rows of its centroids.
LEAST_ROWS = 25
UNKNOWN = "und"


def vectors(column: pa.Array, idf: np.ndarray | None = None) -> np.ndarray:
    """Unit TF-IDF vectors; a text without letters gives zeros."""
    data, bounds = text_bytes(column)
    x = np.log1p(char_counts(LETTERS[data], bounds, ORDERS, BUCKETS, blanks=False)).astype(np.float32)
    if idf is None:
        return x
    x *= idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _cluster(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means, from spread-out seeds."""
    centres = [x[rng.integers(len(x))]]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.argmin(np.max(x @ np.array(centres).T, axis=1)))])
    c = np.array(centres)
    for _ in range(12):
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _limit(x: np.ndarray, seed: int) -> float:
    held = np.arange(len(x)) % HELD == 0 if len(x) >= LEAST_ROWS else np.zeros(len(x), bool)
    c = _cluster(x[~held], CENTROIDS, np.random.default_rng(seed))
    return MARGIN * float(np.quantile((x[held if held.any() else ~held] @ c.T).max(axis=1), LOW))


def fit(texts: list[str], langs: list[str], seed: int = 7) -> dict:
    """The model: idf, centroids, the language of each and the limits of rejection."""
    if not texts:
        return {"langs": []}
    raw = np.concatenate([vectors(b) for b in blocks_of(texts)])
    idf = (np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))) + 1).astype(np.float32)
    x = raw * idf
    size = np.linalg.norm(x, axis=1)
    x = x / np.maximum(size, 1e-9)[:, None]
    rng, lang = np.random.default_rng(seed), np.array(langs)
    centroids, of, limits = [], [], []
    for name in sorted(set(langs)):
        own = x[(lang == name) & (size > 0)]
        if len(own):
            c = _cluster(own, CENTROIDS, rng)
            centroids.append(c)
            of += [name] * len(c)
            limits += [_limit(own, seed)] * len(c)
    return {"idf": idf, "langs": of, "limits": np.array(limits), "centroids": np.concatenate(centroids).astype(np.float32) if centroids else None}


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 7) -> dict:
    sample = texts_by(docs, "lang", per_language, seed)
    return fit(sample["text"].tolist(), sample["label"].astype(str).tolist(), seed)


def _rows(docs: DataFrame, *columns) -> DataFrame:
    """The given columns, text, and whether it has a letter."""
    return docs.where("doc_id is not null").select(*columns, "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))


def _decided(block: pa.RecordBatch, m: dict) -> dict:
    """lang_pred, score and rejected of each row of ``block``."""
    if not m["langs"]:
        return {"lang_pred": [UNKNOWN] * block.num_rows, "score": np.zeros(block.num_rows), "rejected": np.ones(block.num_rows, bool)}
    has = block.column("letters").to_numpy(zero_copy_only=False).astype(bool)
    near = vectors(block.column("text"), m["idf"]) @ m["centroids"].T
    best = near.argmax(axis=1)
    score = np.where(has, np.clip(near.max(axis=1), 0, 1), 0.0).astype(float)
    size = np.diff(text_bytes(block.column("text"))[1])
    rejected = ~has | (score < m["limits"][best] * np.sqrt(np.minimum(size / SHORT, 1)))
    return {"lang_pred": [m["langs"][b] if h else UNKNOWN for b, h in zip(best, has)], "score": score, "rejected": rejected}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def columns(block: pa.RecordBatch) -> dict:
        return {"doc_id": block.column("doc_id"), **_decided(block, shared.value)}

    return arrow_map(_rows(docs, F.col("doc_id").cast("long").alias("doc_id")), columns, "doc_id long, lang_pred string, score double, rejected boolean", rows=256)


def recognised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language the model, trained on them, does not reject; each by its own text, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def kept(batches):
        for block in by_block(batches, rows=256):
            keep = pa.array(~_decided(block, shared.value)["rejected"])
            yield pa.RecordBatch.from_arrays([block.column(c).filter(keep) for c in ("text", "doc")], names=["text", "doc"])

    # The other columns of docs travel in a struct, so that none of them can clash.
    rows = _rows(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"))
    out = rows.mapInArrow(kept, StructType([rows.schema["text"], rows.schema["doc"]]))
    return out.select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict(docs, train(docs.where(in_sample(F.col("doc_id")))))
    return found.select("doc_id", (~in_sample(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op7_language": op7_language}
ORACLE: dict[str, str] = {}
