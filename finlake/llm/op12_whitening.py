"""Embedding whitening from an exact scatter matrix in residue numbers.

Components become whole numbers x. For each of several primes below 2^21 a task
multiplies residues of blocks of rows (with a column of ones) as doubles, whose
sums stay below 2^53 and so are exact; the products, modulo the prime, are added up
by a grouped shuffle. Chinese remaindering gives the sums of x x', of x and the
count as whole numbers of any size: the number of primes follows from the count
and the largest component. n * sum(x x') - S S' is the centred scatter without any
rounding; divided by n^2, each entry rounded once, it goes through one ``eigh`` in
doubles. What comes to the driver is primes x dimensions rows, whatever the table
has.

Results: rows whose vector is null or holds a null or non-finite entry are left out;
all others are in the fit, repeated rows and those without a vec_id too. Shorter
vectors count as if zeros followed. Scaled components beyond LIMIT count as LIMIT.
There are COMPONENTS components, or as many as dimensions. A component without
variance (at most the rounding of the largest one's) has whitened and explained 0
and no part in identity_error. ``deviation`` is null where it does not fit 64
bits, as with very many rows. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from finlake.llm.scratch import Scratch
from finlake.llm.vectors import matrix, whole_numbers

COMPONENTS, OFFSET, LIMIT = 8, 100_000, 1 << 40
#: Primes are below 2^PRIME_BITS; ROWS products of two residues stay below 2^53.
PRIME_BITS, ROWS = 21, 1024


def primes(product: int) -> list[int]:
    """The largest primes below 2^PRIME_BITS, as many as it takes to exceed ``product``."""
    found, at, have = [], (1 << PRIME_BITS) - 1, 1
    while have <= product:
        if all(at % k for k in range(3, int(at**0.5) + 1, 2)):
            found.append(at)
            have *= at
        at -= 2
    return found


def remaindered(residues: dict[int, np.ndarray]) -> np.ndarray:
    """The whole numbers, as Python's, that have these residues by prime and the smallest absolute value."""
    product = 1
    for p in residues:
        product *= p
    total = 0
    for p, r in residues.items():
        rest = product // p
        total = total + r.astype(object) * (rest * pow(rest, -1, p))
    total = total % product
    return np.where(total > product // 2, total - product, total)


def _scatter(moduli: list[int]):
    """Residues of a task's sum of outer products of (x, 1): a row for each prime and row of the matrix."""

    def run(batches):
        held = None
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                x = matrix(batch.column("x").slice(start, ROWS))
                x = np.concatenate((x, np.ones((len(x), 1), np.int64)), axis=1)
                held = np.zeros((len(moduli), x.shape[1], x.shape[1]), np.int64) if held is None else held
                for k, p in enumerate(moduli):
                    r = (x % p).astype(float)
                    held[k] = (held[k] + (r.T @ r).astype(np.int64)) % p
        if held is not None:
            k, row = np.divmod(np.arange(held.shape[0] * held.shape[1]), held.shape[1])
            yield pa.RecordBatch.from_pydict({"k": k.astype(np.int32), "row": row.astype(np.int32), "residues": pa.array(list(held[k, row]), pa.list_(pa.int64()))})

    return run


def exact_sums(vectors: DataFrame, size: int, largest: int, n: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums of x, sums of x x') of ``vectors`` (x, of ``size`` components up to ``largest``), as Python integers."""
    moduli = primes(2 * n * max(1, largest) ** 2)
    parts = vectors.select("x").mapInArrow(_scatter(moduli), "k int, row int, residues array<long>")
    total = parts.groupBy("k", "row").agg(F.array(*[F.sum(F.get("residues", F.lit(i))) for i in range(size + 1)]).alias("residues"))
    found = np.zeros((len(moduli), size + 1, size + 1), np.int64)
    for r in total.collect():
        found[r["k"], r["row"]] = [v % moduli[r["k"]] for v in r["residues"]]
    whole = remaindered(dict(zip(moduli, found)))
    return int(whole[size, size]), whole[size, :size], whole[:size, :size]


@dataclass(frozen=True)
class Whitening:
    """``sums`` as Python integers; ``axes``: dimensions x components, scaled to unit variance; ``explained``: their shares of all variance."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n; the whole part is taken off first, so nothing is lost."""
        whole = (self.sums // self.n).astype(np.int64)
        return (x - whole) - (self.sums % self.n / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - sums)^2; None where 64 bits do not hold them."""
        near = np.square(self.centred(x) * self.n).sum(1)
        # What fits has small terms, which arithmetic modulo 2^64 gives exactly.
        term = np.int64(self.n) * x - np.array([(int(s) + 2**63) % 2**64 - 2**63 for s in self.sums], np.int64)
        out = np.square(term).sum(1).tolist()
        for i in np.flatnonzero(near > 2.0**63 * (1 - 1e-9)).tolist():
            exact = sum((self.n * int(v) - int(s)) ** 2 for v, s in zip(x[i], self.sums)) if near[i] < 2.0**63 * (1 + 1e-9) else 2**63
            out[i] = exact if exact < 2**63 else None
        return out


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``vectors`` (x); None without rows."""
    n, size, largest = vectors.agg(F.count("*"), F.max(F.size("x")), F.max(F.aggregate("x", F.lit(0).cast("long"), lambda a, c: F.greatest(a, F.abs(c))))).first()
    if not n:
        return None
    n, sums, products = exact_sums(vectors, size, largest, n)
    scatter = n * products - np.outer(sums, sums)
    covariance = np.array([[v / n**2 for v in row] for row in scatter.tolist()], float).reshape(size, size)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    spread = sum(scatter[i, i] for i in range(size)) / n**2 if size else 0.0
    live = values > max(values.max(initial=0.0), 0.0) * size * np.finfo(float).eps
    scale = np.where(live, 1 / np.sqrt(np.where(live, values, 1.0)), 0.0)
    return Whitening(n, sums, axes * scale, np.where(live, values / (spread or 1.0), 0.0))


def _project(model):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x, w = matrix(part.column("x")), model.value
                rest = [name for name in part.schema.names if name != "x"]
                made = [pa.array(w.deviations(x), pa.int64()), pa.array(list(w.centred(x) @ w.axes), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column(name) for name in rest] + made, names=[*rest, "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """``id``, ``deviation`` and ``whitened`` (array by component) of each vector, and the model."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "whitening")
    kept = scratch.save(whole_numbers(vectors, (id,), vector, LIMIT, OFFSET), "vectors")
    schema = StructType([*kept.drop("x").schema, StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])
    model = fitted(kept, components)
    if model is None:
        return spark.createDataFrame([], schema), None
    out = scratch.save(kept.mapInArrow(_project(spark.sparkContext.broadcast(model)), schema), "whitened")
    scratch.drop("vectors")
    return out, model


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """The largest difference of the covariance of ``whitened`` (centred, by n) from the identity, over the components that vary."""
    live = [i for i, share in enumerate(model.explained) if share > 0]
    w = [F.get("whitened", F.lit(i)) for i in live]
    if not live:
        return 0.0
    means = whitened.agg(*[F.avg(c) for c in w]).first()
    pairs = [(i, j) for i in range(len(live)) for j in range(i + 1)]
    found = whitened.agg(*[F.avg((w[i] - F.lit(means[i])) * (w[j] - F.lit(means[j]))) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    n, error = (model.n, identity_error(rows, model)) if model else (0, 0.0)
    shares = F.array(*[F.lit(float(x)) for x in (model.explained if model else ())]).cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


QUERIES = {"op12_whitening": op12_whitening}
ORACLE: dict[str, str] = {}
