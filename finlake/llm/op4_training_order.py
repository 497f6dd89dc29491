"""Training-order materialisation: token sequences in a keyed random order, in fixed-stride binary shards.

Documents are dealt into blocks by a hash of id and text, about BLOCK_ROWS in
each and MOST_BLOCKS at most, and sorted by id and text within a block. A row that
repeats more often than a block has rows is counted and dealt out in lots of that
many copies, so that no block gets them all. Documents are encoded, each closed by
one END id, and the stream of a block is cut into sequences of SEQUENCE ids; only
the last of a block can be shorter. The sequences are numbered 0 to N - 1 (by block, then in order), and a keyed Feistel
network permutes the numbers: it permutes a domain of a power of four, and
values outside N walk on along their cycle until they fall inside, so every slot
0 to N - 1 is taken once and nothing is sorted or held to shuffle the corpus.
Blocks, numbers and slots follow from the rows and the key alone: input splits,
partitions and executors change no byte of a shard.

Shard k holds the slots from k * SHARD on. Shards are written in WAVES ranges of
slots, one after the other: the encoded rows are stored by wave, and a wave's
rows and shuffle files go when its shards are written, so rows, shuffle and
shards are never all on disk. Within a wave a task gets a range of whole shards,
sorted by slot, and writes records of STRIDE bytes (length and crc32 as 4 bytes
each, then ids as 2 bytes each, little-endian, zeros after the length), each
shard under another name first and renamed when complete, so a task can be run
again. A reader resumes at any slot by seeking to slot % SHARD * STRIDE in the
shard's file, whose path is in the index.

Null texts count as empty (one END id). Rows without a doc_id are left out;
repeated rows are encoded each. Extra columns are ignored. An empty table makes
no shard and no rows. Ids above 65535 are an error of the tokenizer chosen.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake.llm.kernels import U64, mix
from finlake.llm.op9_packing import END_ID, public_tokenizer
from finlake.llm.scratch import Scratch, by_block, documents
from finlake.llm.tokens import encoder

SEQUENCE, SHARD, KEY = 2048, 4096, 0x5EED2024
HEADER = "<II"
STRIDE = struct.calcsize(HEADER) + 2 * SEQUENCE
ROUNDS = 6
#: Rows of a block, about, and most blocks; slot ranges written in turn, and most tasks of one.
BLOCK_ROWS, MOST_BLOCKS, WAVES, MOST_TASKS = 4096, 100_000, 4, 20_000

PIECES = "array<struct<doc_id:long,start:long,length:long>>"


def feistel(numbers: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0 to n - 1, told apart by ``key``."""
    half = 1
    while 1 << (2 * half) < n:
        half += 1
    mask, shift = U64((1 << half) - 1), U64(half)
    keys = mix(np.arange(1, rounds + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) ^ U64(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return (left << shift) | right

    out = once(numbers.astype(U64))
    while (outside := out >= U64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _dealt(rows: DataFrame, blocks: int, most: int) -> DataFrame:
    """``rows`` in their blocks, sorted by id and text; no block gets more than ``most`` copies of a row at a time."""
    # Ids of more than ``most`` rows: ``most`` is a MOST_BLOCKS-th of all rows or more, so there are about MOST_BLOCKS of them at most.
    often = [(r["doc_id"],) for r in rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > most).collect()]
    block = lambda *by: F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int")
    if not often:
        return rows.repartitionById(blocks, block("doc_id", "text")).sortWithinPartitions("doc_id", "text")
    ids = F.broadcast(rows.sparkSession.createDataFrame(often, "doc_id long"))
    # Copies are counted, before anything is shuffled, and the counts dealt out in lots.
    lots = rows.join(ids, "doc_id").groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    lots = lots.select("doc_id", "text", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {most}"))).alias("lot"))
    lots = lots.select("doc_id", "text", F.least(F.lit(most), F.col("n") - F.col("lot") * most).cast("int").alias("times"), block("doc_id", "text", "lot").alias("block"))
    others = rows.join(ids, "doc_id", "left_anti").select("doc_id", "text", F.lit(1).alias("times"), block("doc_id", "text").alias("block"))
    dealt = others.unionByName(lots).repartitionById(blocks, "block").sortWithinPartitions("doc_id", "text", "times")
    return dealt.select("doc_id", "text", F.explode(F.sequence(F.lit(1), "times"))).select("doc_id", "text")


def sequences(docs: DataFrame, tokenizer: str) -> DataFrame:
    """part (a block), n (place in it), n_tokens, ids_crc32, payload (compressed ids), pieces."""
    schema = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("n_tokens", pa.int32()), ("ids_crc32", pa.int64()), ("payload", pa.binary()), ("pieces", pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])))])

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        rest, rest_pieces = np.zeros(0, np.uint16), []

        def out(ids: np.ndarray, doc: np.ndarray, start: np.ndarray, begin: np.ndarray, last: bool):
            nonlocal made, rest, rest_pieces
            ends = np.append(begin[1:], len(ids))
            whole = len(ids) // SEQUENCE
            count = whole + (1 if last and len(ids) % SEQUENCE else 0)
            rows = []
            for k in range(count):
                s, e = k * SEQUENCE, min((k + 1) * SEQUENCE, len(ids))
                body = ids[s:e].astype("<u2").tobytes()
                i, j = np.searchsorted(ends, s, "right"), np.searchsorted(begin, e, "left")
                pieces = [{"doc_id": int(doc[x]), "start": int(start[x] + max(s - begin[x], 0)), "length": int(min(e, ends[x]) - max(s, begin[x]))} for x in range(i, j)]
                rows.append((part, made + k, e - s, zlib.crc32(body), pa.compress(body, codec="zstd", asbytes=True), pieces))
            made += count
            s = count * SEQUENCE
            rest = ids[s:]
            i = np.searchsorted(ends, s, "right")
            rest_pieces = [(int(doc[x]), int(start[x] + max(s - begin[x], 0)), int(max(begin[x] - s, 0))) for x in range(i, len(begin))] if s < len(ids) else []
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], schema.field(c).type) for c in range(6)], schema=schema)

        for block in by_block(batches):
            ids, bounds = encoder(tokenizer).encode(block.column("text"))
            if len(ids) and ids.max() > 0xFFFF:
                raise ValueError("the tokenizer has ids of more than 2 bytes")
            size = np.diff(bounds) + 1
            stream = np.full(size.sum(), END_ID, np.uint16)
            stream[np.arange(len(ids)) + np.repeat(np.arange(len(size)), size - 1)] = ids
            begin = np.cumsum(size) - size + len(rest)
            held = np.array(rest_pieces, np.int64).reshape(-1, 3)
            yield out(
                np.concatenate((rest, stream)), np.concatenate((held[:, 0], block.column("doc_id").to_numpy())),
                np.concatenate((held[:, 1], np.zeros(len(size), np.int64))), np.concatenate((held[:, 2], begin)), last=False,
            )
        if len(rest):
            held = np.array(rest_pieces, np.int64).reshape(-1, 3)
            yield out(rest, held[:, 0], held[:, 1], held[:, 2], last=True)

    count = docs.count()
    blocks = max(1, min(count // BLOCK_ROWS, MOST_BLOCKS))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = _dealt(rows, blocks, max(BLOCK_ROWS, count // MOST_BLOCKS))
    return rows.mapInArrow(run, f"part int, n long, n_tokens int, ids_crc32 long, payload binary, pieces {PIECES}")


def placed(made: DataFrame, key: int = KEY) -> tuple[DataFrame, int]:
    """The rows with ``sequence`` (0 to N - 1), ``slot`` and ``wave``, and N. Only a count per block, MOST_BLOCKS at most, reaches the driver."""
    counts = {r["part"]: r["n"] for r in made.groupBy("part").agg(F.count("*").alias("n")).collect()}
    first, total = {}, 0
    for part in sorted(counts):
        first[part], total = total, total + counts[part]
    shards = max(1, -(-total // SHARD))

    def run(batches):
        for batch in batches:
            part, n = batch.column("part").to_numpy(), batch.column("n").to_numpy()
            begin = np.array([first[p] for p in part.tolist()], np.int64)
            slot = feistel(begin + n, total, key) if len(n) else n
            wave = slot // SHARD * WAVES // shards
            yield pa.RecordBatch.from_arrays([pa.array(begin + n), pa.array(slot), *[batch.column(c) for c in ("n_tokens", "ids_crc32", "payload", "pieces")], pa.array(wave.astype(np.int32))], names=["sequence", "slot", "n_tokens", "ids_crc32", "payload", "pieces", "wave"])

    return made.mapInArrow(run, f"sequence long, slot long, n_tokens int, ids_crc32 long, payload binary, pieces {PIECES}, wave int"), total


def shard_path(root: str, shard: int) -> str:
    return f"{root}/shard-{shard:08d}.bin"


def write_shards(rows: DataFrame, first: int, shards: int, root: str) -> DataFrame:
    """Writes the ``shards`` shards from number ``first`` on under ``root`` (a folder all executors share), all of whose slots ``rows`` must hold, and returns where each sequence stands."""
    names = ["sequence", "slot", "shard", "path", "byte_offset", "n_tokens", "ids_crc32", "pieces"]

    def run(batches):
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        stream, at, temporary, shard = None, 0, "", -1

        def close():
            if stream is not None:
                stream.close()
                made = shard_path(folder, shard)
                # A task that runs again finds the shards that it had finished; they have the same bytes.
                if store.get_file_info(made).type == fs.FileType.NotFound:
                    store.move(temporary, made)
                else:
                    store.delete_file(temporary)

        for batch in batches:
            slots = batch.column("slot").to_pylist()
            for slot, size, crc, payload in zip(slots, batch.column("n_tokens").to_pylist(), batch.column("ids_crc32").to_pylist(), batch.column("payload").to_pylist()):
                if slot // SHARD != shard:
                    close()
                    shard, at = slot // SHARD, 0
                    temporary = f"{shard_path(folder, shard)}.{TaskContext.get().taskAttemptId()}"
                    stream = store.open_output_stream(temporary)
                if slot != shard * SHARD + at:
                    raise ValueError(f"slot {shard * SHARD + at} is missing")
                body = pa.decompress(payload, decompressed_size=2 * size, codec="zstd", asbytes=True)
                stream.write(struct.pack(HEADER, size, crc) + body + bytes(2 * (SEQUENCE - size)))
                at += 1
            slot = np.array(slots, np.int64)
            paths = pa.array([shard_path(root, k) for k in (slot // SHARD).tolist()])
            yield pa.RecordBatch.from_arrays([batch.column("sequence"), batch.column("slot"), pa.array(slot // SHARD), paths, pa.array(slot % SHARD * STRIDE), batch.column("n_tokens"), batch.column("ids_crc32"), batch.column("pieces")], names=names)
        close()

    each = -(-shards // MOST_TASKS)
    ranged = rows.repartitionById(-(-shards // each), F.expr(f"int((slot div {SHARD} - {first}) div {each})")).sortWithinPartitions("slot")
    return ranged.mapInArrow(run, f"sequence long, slot long, shard long, path string, byte_offset long, n_tokens int, ids_crc32 long, pieces {PIECES}")


def materialise(docs: DataFrame, tokenizer: str, scratch: Scratch, root: str, key: int = KEY) -> DataFrame:
    """Writes the shards of ``docs`` and returns their index, one row per sequence."""
    made = scratch.save(sequences(docs, tokenizer), "sequences")
    rows, total = placed(made, key)
    scratch.save(rows, "waves", by="wave")
    scratch.drop("sequences")
    shards, found = max(1, -(-total // SHARD)), None
    for wave in range(WAVES):
        first, end = (-(-shards * w // WAVES) for w in (wave, wave + 1))  # the shards k with k * WAVES // shards = wave
        if end > first:
            schema = rows.drop("wave").schema
            part = scratch.load(schema, f"waves/wave={wave}") if total else docs.sparkSession.createDataFrame([], schema)
            index = scratch.save(write_shards(part, first, end - first, root), f"index{wave}")
            found = index if found is None else found.unionByName(index)
            scratch.drop(f"waves/wave={wave}")
    _tidy(docs.sparkSession, root)
    return found


def _tidy(spark: SparkSession, root: str) -> None:
    """Deletes what failed attempts left beside the shards."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/shard-*.bin.*")
    store = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.globStatus(pattern) or []:
        store.delete(status.getPath(), False)


def read_from(root: str, slot: int, total: int) -> Iterator[np.ndarray]:
    """The sequences from ``slot`` on, read in order; checks each against its crc32. A cut, damaged or missing shard raises OSError."""
    store, folder = fs.FileSystem.from_uri(root)
    while slot < total:
        with store.open_input_file(shard_path(folder, slot // SHARD)) as f:
            f.seek(slot % SHARD * STRIDE)
            for _ in range(min(SHARD - slot % SHARD, total - slot)):
                if len(record := f.read(STRIDE)) < STRIDE:
                    raise OSError(f"the shard of slot {slot} ends before it")
                size, crc = struct.unpack_from(HEADER, record)
                body = record[8 : 8 + 2 * size]
                if zlib.crc32(body) != crc:
                    raise OSError(f"slot {slot} is damaged")
                yield np.frombuffer(body, "<u2")
                slot += 1


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards stay in a folder of their own under the shared one; the index names their paths."""
    scratch = Scratch(spark, "op4")
    return materialise(documents(spark, sf_dir), public_tokenizer("word_bpe_49k.json"), scratch, f"{scratch.path}-shards")


QUERIES = {"op4_training_order": op4_training_order}
ORACLE: dict[str, str] = {}
