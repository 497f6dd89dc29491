"""Vector code compression: one byte for each part of a vector, by integer codebooks.

Components become whole numbers, vectors PARTS equal parts. A codebook of each
part position starts as the parts of the first ENTRIES vectors by vec_id. In each
of ROUNDS rounds the codebooks are broadcast; a task finds the nearest entry of
every part by |x|^2 - 2 x c + |c|^2 in 64-bit integers, the first one on ties, and
gives one row of sums and count per entry it met; a grouped shuffle adds them up,
and entries become floor(sum / count); unused ones stay. All is exact, so neither
partitions nor lost executors change a code. What comes to the driver is PARTS x
ENTRIES rows, whatever the table has.

Results: rows whose vector is null or holds a null or non-finite component are
left out; all others are coded, those without a vec_id too (they come last where
the first codebook is chosen). Rows that repeat a vec_id are vectors of their own,
taken by vec_id, then components. With fewer than ENTRIES vectors the codebooks
have fewer entries. Shorter vectors, and lengths that PARTS does not divide, count
as if zeros followed. Scaled components beyond LIMIT count as LIMIT. Null labels
share a sum. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from finlake.llm.scratch import Scratch
from finlake.llm.vectors import SCALE, matrix, whole_numbers

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Largest component, in steps: squared distances of parts of up to 64 components fit 62 bits.
LIMIT = 1 << 27
#: Rows whose distances are worked out together.
ROWS = 4096
#: Labels whose sums are broadcast; with more of them, rows and sums are merged.
MOST_BROADCAST = 100_000


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first nearest entry, squared distance) of each row of ``x``."""
    far = (book * book).sum(1) - 2 * (x @ book.T)
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at] + (x * x).sum(1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _parts(batch: pa.RecordBatch) -> np.ndarray:
    """Part position x row x component."""
    x = matrix(batch.column("x"))
    return x.reshape(len(x), PARTS, -1).swapaxes(0, 1)


def _sums(books):
    """Sums and counts of a task's parts by nearest entry, a row for each entry that has any."""

    def run(batches):
        total, count = np.zeros_like(books.value), np.zeros(books.value.shape[:2], np.int64)
        for batch in _slices(batches):
            for part, (x, book) in enumerate(zip(_parts(batch), books.value)):
                at = nearest(x, book)[0]
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                total[part, at[order][first]] += np.add.reduceat(x[order], first, axis=0)
                count[part] += np.bincount(at, minlength=len(book))
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({"part": part.astype(np.int32), "entry": entry.astype(np.int32), "n": count[part, entry], "sums": pa.array(list(total[part, entry]), pa.list_(pa.int64()))})

    return run


def _codes(books):
    def run(batches):
        for batch in _slices(batches):
            found = [nearest(x, book) for x, book in zip(_parts(batch), books.value)]
            code = ["".join(f"{i:02x}" for i in row) for row in np.stack([at for at, _ in found], 1).tolist()]
            made = [pa.array(code, pa.string()), pa.array(sum(d for _, d in found), pa.int64())]
            rest = [name for name in batch.schema.names if name != "x"]
            yield pa.RecordBatch.from_arrays([batch.column(name) for name in rest] + made, names=[*rest, "code", "error"])

    return run


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over ``vectors`` (x)."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    sums = vectors.select("x").mapInArrow(_sums(sent), "part int, entry int, n long, sums array<long>")
    width = books.shape[2]
    totals = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).cast("array<long>").alias("sums"))
    out = books.copy()
    for row in totals.collect():
        out[row["part"], row["entry"]] = [s // row["n"] for s in row["sums"]]
    sent.unpersist()
    return out


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``id``, ``label``, ``code``, ``error`` of each vector, and the codebooks: part x entry x component."""
    scratch = Scratch(vectors.sparkSession, "codes")
    kept = scratch.save(whole_numbers(vectors, (id, label), vector, LIMIT, multiple=PARTS), "vectors")
    first = kept.orderBy(F.col(id).asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
    books = np.array([r[0] for r in first], np.int64).reshape(len(first), PARTS, -1 if first and first[0][0] else 0).swapaxes(0, 1)
    schema = StructType([*kept.drop("x").schema, StructField("code", StringType()), StructField("error", LongType())])
    if not first:
        return vectors.sparkSession.createDataFrame([], schema), books
    for _ in range(ROUNDS):
        books = refined(kept, books)
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    codes = scratch.save(kept.mapInArrow(_codes(sent), schema), "codes")
    scratch.drop("vectors")
    return codes, books


def digest(books: np.ndarray) -> str:
    """SHA-256 of the components as decimals by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    totals = codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    totals = F.broadcast(totals) if codes.select("label").distinct().count() <= MOST_BROADCAST else totals
    return codes.join(totals, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


QUERIES = {"op13_vector_codes": op13_vector_codes}


def _sql() -> str:
    """The rounds as tables: a (entries nearest to parts) and c (codebooks), by round."""
    near = """a{r} AS (
  SELECT vec_id, p, arg_min(e, d * 1000 + e) AS e, min(d) AS d FROM (
    SELECT x.vec_id, x.p, c.e, list_sum(list_transform(list_zip(x.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts x JOIN c{r} c USING (p)) GROUP BY ALL
)"""
    move = """m{r} AS (
  SELECT p, e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS v FROM a{r} JOIN parts USING (vec_id, p), unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL
), c{n} AS (
  SELECT c.p, c.e, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (SELECT p, e, list(v ORDER BY i) AS c FROM m{r} GROUP BY ALL) m USING (p, e)
)"""
    rounds = ", ".join(f"{near.format(r=r)}, {move.format(r=r, n=r + 1)}" for r in range(ROUNDS))
    return f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), parts AS (
  SELECT vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM k, unnest(range({PARTS})) AS u(p)
), c0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < {ENTRIES}
), {rounds}, {near.format(r=ROUNDS)}, coded AS (
  SELECT vec_id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY ALL
), s AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN k USING (vec_id), s
"""


ORACLE = {"op13_vector_codes": _sql()}
