"""Exact dedup by composable polynomial fingerprints.

A text, lower-cased in A-Z only, is cut into chunks of its UTF-8 bytes. Each
chunk is hashed by itself (the value of its bytes as digits to a base, modulo
four primes), and the hashes combine to that of the text: each is shifted by
base ** (bytes after the chunk), then all are added. Texts of more than
PARALLEL chunks are dealt out chunk by chunk, so that a huge text is hashed by
many tasks; what the others need is found in the same pass.

Texts with equal fingerprint and length are then compared chunk by chunk, as
bytes: for each chunk of a group the smallest and the largest content are
found, which Spark does before it shuffles, so a group with a third of all rows
is no task's. Where these differ the fingerprints collided: the members of such a
group are compared with the group's representative, and what differs from it goes
into another round with a representative of its own.

A row is told apart by its doc_id and a 64-bit hash of its text, so rows of one
doc_id with different texts are in the groups of their texts. Repeated rows
(same doc_id and text) are returned each and count each in group_size; the
deduplicated table keeps one of them. Null texts count as empty, empty texts are
copies of each other. Rows without a doc_id are left out. Other columns of the
input, whatever their names, are neither read nor returned. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake.llm.kernels import LOWER, text_bytes
from finlake.llm.scratch import Scratch, documents

#: Primes below 2**31; a 64-bit sum of byte * power stays exact for a chunk.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525017, 1566083941, 1812433253)
CHUNK_BYTES = 1 << 16
#: Chunks of a text that one task hashes.
PARALLEL = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_powers: list[np.ndarray] = []


def _digits(n: int) -> list[np.ndarray]:
    """For each prime, base ** (n - 1), ..., base, 1."""
    if not _powers:
        for p, b in zip(PRIMES, BASES):
            at = np.empty(CHUNK_BYTES, np.uint64)
            x = 1
            for i in range(CHUNK_BYTES):
                at[CHUNK_BYTES - 1 - i] = x
                x = x * b % p
            _powers.append(at)
    return [p[CHUNK_BYTES - n :] for p in _powers]


def chunk_hash(data: np.ndarray) -> list[int]:
    """The polynomial value of at most CHUNK_BYTES bytes, for each prime. Digits are byte + 1, so that zero bytes count."""
    digits = data.astype(np.uint64) + np.uint64(1)
    return [int(np.dot(digits, w)) % p for w, p in zip(_digits(len(digits)), PRIMES)]


def shift(value: int, length: int, k: int) -> int:
    """The share of a chunk with hash ``value`` that ``length`` bytes follow."""
    return value * pow(BASES[k], length, PRIMES[k]) % PRIMES[k]


def normalised(text) -> F.Column:
    """A-Z in lower case; ``lower`` is the same, and faster, where all is ASCII."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _chunks(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per chunk: the kept columns, number, chunk, and bytes of the text after it."""
    data = F.col("data")
    last = F.greatest(F.ceil(F.octet_length(data) / CHUNK_BYTES) - 1, F.lit(0)).cast("int")
    return (
        rows.select(*keep, "data", F.explode(F.sequence(F.lit(0), last)).alias("number"))
        .select(
            *keep, "number",
            F.substring(data, F.col("number") * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES)).alias("chunk"),
            F.greatest(F.octet_length(data) - (F.col("number") + 1) * CHUNK_BYTES, F.lit(0)).cast("long").alias("after"),
        )
    )


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and version, which tells rows of one doc_id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))


RESIDUES = [f"r{k}" for k in range(4)]


def _hashed(column: pa.Array) -> list[list[int]]:
    """The chunk hashes of each chunk, lower-cased."""
    data, bounds = text_bytes(column)
    return [chunk_hash(LOWER[data[s:e]]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _whole(batches):
    """Texts of at most PARALLEL chunks: the composed hash, and the digest."""
    for batch in batches:
        data, bounds = text_bytes(batch.column("text"))
        found, digests = [], []
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            value, digest = [0] * 4, hashlib.sha256()
            for at in range(s, max(e, s + 1), CHUNK_BYTES):
                chunk = LOWER[data[at : min(at + CHUNK_BYTES, e)]]
                digest.update(chunk)
                value = [(shift(v, len(chunk), k) + h) % PRIMES[k] for k, (v, h) in enumerate(zip(value, chunk_hash(chunk)))]
            found.append(value)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(np.diff(bounds)), *[pa.array([v[k] for v in found], pa.int64()) for k in range(4)], pa.array(digests, pa.string())], names=["doc_id", "version", "n_bytes", *RESIDUES, "digest"])


def _shares(batches):
    """Single chunks: their share of the hash of their text."""
    for batch in batches:
        after = batch.column("after").to_pylist()
        hashes = _hashed(batch.column("chunk"))
        size = pc.binary_length(batch.column("chunk")).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), batch.column("row"), size, *[pa.array([shift(h[k], n, k) for h, n in zip(hashes, after)], pa.int64()) for k in range(4)]], names=["doc_id", "version", "row", "n_bytes", *RESIDUES])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, version, n_bytes, digest (SHA-256) and f1, f2 (four residues in two longs), for every row."""
    rows, most = _rows(docs), PARALLEL * CHUNK_BYTES
    kinds = ", ".join(f"{r} long" for r in RESIDUES)
    whole = rows.where(F.octet_length("text") <= most).mapInArrow(_whole, f"doc_id long, version long, n_bytes long, {kinds}, digest string")
    long = rows.where(F.octet_length("text") > most).withColumn("row", F.monotonically_increasing_id()).withColumn("data", F.col("text").cast("binary"))
    chunks = _chunks(long, "doc_id", "version", "row").repartition("row", "number")
    sums = chunks.mapInArrow(_shares, f"doc_id long, version long, row long, n_bytes long, {kinds}").groupBy("row", "doc_id", "version").agg(F.sum("n_bytes").alias("n_bytes"), *[(F.sum(r) % PRIMES[k]).alias(r) for k, r in enumerate(RESIDUES)])
    digests = rows.where(F.octet_length("text") > most).select("doc_id", "version", F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("digest")).dropDuplicates(["doc_id", "version"])
    pair = lambda a, b: F.shiftleft(F.col(a), 31).bitwiseOR(F.col(b))
    every = whole.unionByName(sums.drop("row").join(digests, ["doc_id", "version"]))
    return every.select("doc_id", "version", "n_bytes", "digest", pair("r0", "r1").alias("f1"), pair("r2", "r3").alias("f2"))


ROW, PRINT, KEEP = ["doc_id", "version"], ["n_bytes", "f1", "f2"], ["keep_id", "keep_version"]


def exact_groups(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, version, digest, keep_id and keep_version (the row with the largest id of the same text) and group_size, for every row."""
    rows = scratch.save(fingerprints(docs), "prints")
    pending = scratch.save(rows.groupBy(*ROW, *PRINT).agg(F.count("*").alias("copies")), "pending")
    data, done = _rows(docs), None
    for turn in range(1 << 30):
        largest = F.max(F.struct("doc_id", "version"))
        groups = pending.groupBy(*PRINT).agg(largest.alias("keep"), F.count("*").alias("members"), F.sum("copies").alias("group_size"))
        groups = scratch.save(groups.select(*PRINT, F.col("keep.doc_id").alias("keep_id"), F.col("keep.version").alias("keep_version"), "members", "group_size"), f"groups{turn}")
        # Sides of the join are scans, so that AQE can split a hot group.
        members = scratch.save(pending.join(groups.where("members > 1").select(*PRINT, *KEEP), PRINT).select(*ROW, *KEEP), f"members{turn}")
        # Merged at every size, so that a larger input does the same as a small one; lower-cased after the join, what is left of the texts only.
        chunks = _chunks(_normal(data.join(members.hint("merge"), ROW), *KEEP), *KEEP)
        mixed = chunks.groupBy(*KEEP, "number").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low <> high").select(*KEEP).distinct()
        mixed = scratch.save(mixed, f"mixed{turn}")
        if mixed.isEmpty():
            found = pending.join(groups, PRINT).select(*ROW, *KEEP)
        else:
            checked = scratch.save(_like_representative(data, members.join(mixed, KEEP, "left_semi")), f"checked{turn}")
            good = pending.join(groups.join(mixed, KEEP, "left_anti"), PRINT).select(*ROW, *KEEP)
            found = good.union(checked.where("same").select(*ROW, *KEEP))
        done = found if done is None else done.union(found)
        if mixed.isEmpty():
            break
        pending = scratch.save(pending.join(checked.where("not same").select(*ROW), ROW), f"pending{turn}")
    if turn == 0:
        return rows.join(groups, PRINT).select(*ROW, "digest", *KEEP, "group_size")
    done = rows.join(scratch.save(done, "done"), ROW).select(*ROW, "digest", *KEEP)
    return done.join(done.groupBy(*KEEP).agg(F.count("*").alias("group_size")), KEEP).select(*ROW, "digest", *KEEP, "group_size")


def _normal(rows: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the normalised text as ``data``."""
    return rows.select(*keep, normalised(F.col("text")).cast("binary").alias("data"))


def _like_representative(data: DataFrame, members: DataFrame) -> DataFrame:
    """The members of groups whose fingerprints collided, with ``same``: every chunk is the representative's."""
    heads = members.select(*KEEP).distinct()
    mine = _chunks(_normal(data.join(members, ROW), *ROW, *KEEP).dropDuplicates(ROW), *ROW, *KEEP)
    theirs = _chunks(_normal(data.select(F.col("doc_id").alias("keep_id"), F.col("version").alias("keep_version"), "text").join(heads, KEEP), *KEEP).dropDuplicates(KEEP), *KEEP)
    met = mine.join(theirs.select(*KEEP, "number", F.col("chunk").alias("other")), [*KEEP, "number"], "left")
    return met.groupBy(*ROW, *KEEP).agg(F.min(F.coalesce(F.col("chunk") == F.col("other"), F.lit(False))).alias("same"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, of equal texts one row with the largest doc_id."""
    scratch = Scratch(docs.sparkSession, "exact")
    groups = exact_groups(docs, scratch).groupBy(*ROW).agg(F.count("*").alias("copies"), F.first(F.struct(*ROW) == F.struct(F.col("keep_id"), F.col("keep_version"))).alias("stays"))
    groups = scratch.save(groups.where("not stays or copies > 1"), "away")
    # The columns of docs travel in a struct, so that none of them can clash.
    packed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    kept = packed.join(groups.hint("merge"), ROW, "left_anti")
    several = groups.where("stays")
    if not several.isEmpty():  # one of the repeated rows
        kept = kept.unionByName(packed.join(several.select(*ROW), ROW).dropDuplicates(ROW))
    return kept.select("doc.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(documents(spark, sf_dir), Scratch(spark, "op10"))
    return groups.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLE = {
    "op10_exact_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
}
