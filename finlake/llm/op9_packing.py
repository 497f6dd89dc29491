"""Vector bin packing of training examples into sequences.

An example demands tokens, one segment and loss-bearing tokens; a sequence has
room for so many of each. The next example for an open sequence is the fitting
one with the largest dot product of its demand and the room left, each measured
in capacities and weighted by mean demand. Where cutting is allowed, an example
with more tokens than a sequence first fills sequences of its own, and when
nothing fits whole, the best example is cut to fill what is left. What an
input partition has left at its end goes into sequences whose lengths are powers
of two, so nothing is padded there either.

Every task packs the rows it reads and keeps one open lot of examples; no row
moves between tasks and a lost task is simply run again. Nothing grows with the
size of a source or of a group.

Null texts count as empty: one closing id. Rows without a doc_id are left out;
repeated rows are packed each. Extra columns are ignored. An empty table gives
no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake.llm.scratch import by_block, documents
from finlake.llm.tokens import encoder

SEQUENCE_TOKENS, MAX_SEGMENTS = 2048, 256
END_ID = 1
#: Examples that one lot holds when it is packed.
LOT = 512


class Packer:
    """Packs examples (key, tokens, loss): the last ``loss`` tokens bear loss. Pieces come out as (key, start, length, sequence, offset)."""

    def __init__(self, tokens: int = SEQUENCE_TOKENS, segments: int = MAX_SEGMENTS, loss: int | None = None, cut: bool = True, first_sequence: int = 0):
        self.capacity = np.array([tokens, segments, tokens if loss is None else loss], float)
        self.cut, self.sequence = cut, first_sequence
        self.lot: list[list] = []  # key, start, end, first token with loss

    @staticmethod
    def _loss(x: list, length: int) -> int:
        """Loss-bearing tokens among the next ``length`` of an example."""
        return max(0, x[1] + length - max(x[1], x[3]))

    def add(self, key, tokens: int, loss: int) -> Iterator[tuple]:
        whole = int(self.capacity[0])
        x = [key, 0, tokens, tokens - loss]
        if not self.cut and (tokens > whole or loss > self.capacity[2]):
            raise ValueError(f"an example of {tokens} tokens, {loss} with loss, has no sequence to go to")
        while self.cut and x[2] - x[1] >= whole and self._loss(x, whole) <= self.capacity[2]:
            yield self._piece(x, whole, 0)
            self.sequence += 1
        if x[2] > x[1]:
            self.lot.append(x)

    def _piece(self, x: list, length: int, offset: int) -> tuple:
        out = (x[0], x[1], length, self.sequence, offset)
        x[1] += length
        return out

    def pack(self, last: bool) -> Iterator[tuple]:
        """Packs the lot; unless ``last``, what no longer fills a sequence waits for more."""
        lot = self.lot
        size = np.array([x[2] - x[1] for x in lot], np.int64)
        loss = np.array([self._loss(x, x[2] - x[1]) for x in lot], np.int64)
        open_ = np.ones(len(lot), bool)
        demand = np.stack([size, np.ones(len(lot)), loss], axis=1) / self.capacity if lot else np.zeros((0, 3))
        weight = demand.mean(axis=0) if lot else np.ones(3)
        left = int(size.sum())
        while left and (last or left >= 2 * self.capacity[0]):
            if last and self.cut and left < self.capacity[0]:
                break
            room, offset = np.ones(3), 0
            while True:
                fits = open_ & (demand <= room + 1e-9).all(axis=1)
                if fits.any():
                    i = int(np.argmax(np.where(fits, demand @ (room * weight), -1.0)))
                    take = int(size[i])
                elif self.cut and room[0] * self.capacity[0] >= 1 and room[1] * self.capacity[1] >= 1 and open_.any():
                    i = int(np.argmax(np.where(open_, demand @ (room * weight), -1.0)))
                    take = self._part(lot[i], room)
                    if take <= 0:
                        break
                else:
                    break
                used = np.array([take, 1, self._loss(lot[i], take)]) / self.capacity
                yield self._piece(lot[i], take, offset)
                offset, left, room = offset + take, left - take, np.round((room - used) * self.capacity) / self.capacity
                size[i] -= take
                loss[i] = self._loss(lot[i], int(size[i]))
                demand[i] = np.array([size[i], 1, loss[i]]) / self.capacity
                open_[i] = size[i] > 0
            self.sequence += 1
        self.lot = [x for x in lot if x[2] > x[1]]
        if last and self.lot:
            yield from self._powers()

    def _part(self, x: list, room: np.ndarray) -> int:
        tokens, most_loss = int(round(room[0] * self.capacity[0])), int(round(room[2] * self.capacity[2]))
        before = max(0, x[3] - x[1])
        return min(tokens, before + most_loss, x[2] - x[1])

    def _powers(self) -> Iterator[tuple]:
        """The rest, less than a sequence, in sequences of 1024, 512, ... tokens; shorter where another limit comes first."""
        while self.lot:
            goal = 1 << sum(x[2] - x[1] for x in self.lot).bit_length() - 1
            offset = segments = losses = 0
            while offset < goal and segments < self.capacity[1]:
                x = self.lot[0]
                take = min(x[2] - x[1], goal - offset, max(0, x[3] - x[1]) + int(self.capacity[2]) - losses)
                if take <= 0:
                    break
                losses += self._loss(x, take)
                yield self._piece(x, take, offset)
                offset, segments = offset + take, segments + 1
                if x[2] == x[1]:
                    self.lot.pop(0)
            self.sequence += 1


def first_sequence() -> int:
    """Where the sequence numbers of this task begin."""
    return TaskContext.get().partitionId() << 33


def pack_examples(examples: DataFrame, tokens: int = SEQUENCE_TOKENS, segments: int = MAX_SEGMENTS, loss: int | None = None, cut: bool = False) -> DataFrame:
    """Packs rows (id, n_tokens, n_loss) of instruction data; returns id, start, length, sequence_id, offset."""

    def run(batches):
        packer = Packer(tokens, segments, loss, cut, first_sequence())

        def out(pieces):
            cols = list(zip(*pieces)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "start", "length", "sequence_id", "offset"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "n_tokens", "n_loss"))):
                pieces = list(packer.add(*row))
                if len(packer.lot) >= LOT:
                    pieces += packer.pack(last=False)
                if pieces:
                    yield out(pieces)
        yield out(list(packer.pack(last=True)))

    rows = examples.where("id is not null and n_tokens > 0").select(
        F.col("id").cast("long").alias("id"), F.col("n_tokens").cast("long").alias("n_tokens"), F.least(F.coalesce("n_loss", F.lit(0)), "n_tokens").cast("long").alias("n_loss")
    )
    return rows.mapInArrow(run, "id long, start long, length long, sequence_id long, offset long")


class Waiting:
    """Ids of documents whose tokens are not all packed: only what is left of each."""

    def __init__(self):
        self.held: dict[int, tuple[object, np.ndarray, int, int]] = {}  # doc_id, ids from the start on, that start, all tokens

    def add(self, key: int, doc, ids: np.ndarray) -> None:
        self.held[key] = (doc, ids, 0, len(ids))

    def row(self, key: int, start: int, length: int, sequence: int, offset: int) -> tuple:
        doc, ids, base, size = self.held[key]
        return doc, start, length, zlib.crc32(ids[start - base : start - base + length]), size, sequence, offset

    def keep(self, lot: list[list]) -> None:
        """Lets go of all ids that ``lot`` does not wait for."""
        kept = {}
        for key, start, *_ in lot:
            doc, ids, base, size = self.held[key]
            kept[key] = (doc, ids[start - base :].copy(), start, size) if start > base else self.held[key]
        self.held = kept

    @property
    def nbytes(self) -> int:
        return sum(ids.nbytes for _, ids, _, _ in self.held.values())


def pack_documents(docs: DataFrame, tokenizer: str, tokens: int = SEQUENCE_TOKENS, segments: int = MAX_SEGMENTS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Every token bears loss."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        packer, held, key = Packer(tokens, segments, cut=True, first_sequence=first_sequence()), Waiting(), 0

        def out(pieces):
            cols = list(zip(*[held.row(*piece) for piece in pieces])) or [[]] * len(names)
            held.keep(packer.lot)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for block in by_block(batches):
            ids, bounds = encoder(tokenizer).encode(block.column("text"))
            for row, doc in enumerate(block.column("doc_id").to_pylist()):
                own = np.append(ids[bounds[row] : bounds[row + 1]], np.uint32(END_ID)).astype("<u4")
                held.add(key, doc, own)
                pieces = list(packer.add(key, len(own), len(own)))
                key += 1
                if len(packer.lot) >= LOT:
                    pieces += packer.pack(last=False)
                if pieces:
                    yield out(pieces)
        if held.held:
            yield out(list(packer.pack(last=True)))

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizer("word_bpe_49k.json"))


QUERIES = {"op9_packing": op9_packing}
ORACLE: dict[str, str] = {}
