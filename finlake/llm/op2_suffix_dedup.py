"""Repeated passages by ranks of positions at growing lengths.

Removed is every byte that a THRESHOLD-byte string covers which also starts in
a document with a smaller doc_id; strings are judged on the input. Ranks of
positions are made at growing lengths, and what is unique at one length never
reaches the next:

1. Length 20. A window of 50 bytes is ranked by the smallest hash of its
   20-byte strings; equal windows have equal ranks, and neighbouring windows
   mostly share theirs, so a position in 16 or so is sorted, not each. Spark
   deals the ranks out by value; each task sorts its share and sends back which
   are not unique to one document.
2. Length 40. Windows whose rank is crowded (more than CROWDED runs have it, as
   those around a phrase that many documents share) are reranked by their 40-byte
   strings, which deals them out anew; with more than PACKED runs by the whole
   window, of which a block of documents sends one.
3. Length 50, past the threshold. Runs of windows that still are not unique are
   dealt out by rank with their bytes, each different run of a block of documents
   once; each task sorts the windows themselves and finds the smallest document
   of each. Windows, and runs, of one hash are compared byte by byte.

Hashes of doubled length come from pairs of hashes at an offset (1, 2, 4, ...,
32). Documents are handled in blocks of about BLOCK_BYTES of text, dealt to tasks in
turn; within a block a rank, or a run, is sent once however many documents have it, so
a passage in a third of all documents makes one entry per block. No pair of documents is
made. In the end the runs of a block are joined as intervals and the bytes between them
hashed where they lie.
CROWDED and PACKED choose the length of a rank and change no result.

A null text counts as empty. Of rows that repeat a doc_id only the one with the
smallest text counts, found by an aggregation before anything is grouped, so that
an id with a third of all rows makes no large group; rows without a doc_id are left
out. Texts shorter than
the threshold lose nothing. Extra columns are ignored. An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from finlake.llm.kernels import BYTE_CODE, U64, _lanes, mix, same_spans, span_hashes, text_bytes
from finlake.llm.scratch import Scratch, documents

THRESHOLD, FIRST, SECOND = 50, 20, 40
BLOCK_BYTES, LEAST_BLOCKS, PIECE_BYTES, BATCH_BYTES, CROWDED, PACKED = 8 << 20, 48, 1 << 18, 2 << 20, 2000, 1 << 18

#: Set in a 16-bit count of runs of one block: all are of one document.
ONE_DOCUMENT = 1 << 15


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * U64(0x9FB21C651E98DF25)
    x += b
    x ^= x >> U64(29)
    return x


def ranks(data: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each length the hash of the string at each position, from pairs of hashes at doubling offsets."""
    level, size, ladder = BYTE_CODE[data], 1, {}
    needed = {1 << k for n in lengths for k in range(n.bit_length()) if n >> k & 1}
    while size <= max(needed) and len(level):
        if size in needed:
            ladder[size] = level
        level = _pair(level[:-size], level[size:]) if len(level) > size else level[:0]
        size *= 2
    out = {}
    for n in lengths:
        count, whole, at = len(data) - n + 1, None, 0
        for part in sorted(needed, reverse=True):
            if n & part and count > 0:
                h = ladder[part][at : at + count]
                whole, at = (h if whole is None else _pair(whole, h)), at + part
        out[n] = mix(whole) if whole is not None else np.zeros(0, U64)
    return out


def smallest(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by doubling."""
    if len(h) < width:
        return h[:0]
    size, m = 1, h
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    n = len(h) - width + 1
    return np.minimum(m[:n], m[width - size : width - size + n])


def _pieces(data: np.ndarray, bounds: np.ndarray):
    """(bytes, owner row and offset of each part) of a few texts at a time; long texts come in parts that overlap by THRESHOLD - 1."""
    lot, size = [], 0
    for row, (begin, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        for at in range(begin, max(end - THRESHOLD + 1, begin), PIECE_BYTES):
            part = (row, at - begin, at, min(end, at + PIECE_BYTES + THRESHOLD - 1))
            lot.append(part)
            size += part[3] - part[2]
            if size >= PIECE_BYTES:
                yield lot
                lot, size = [], 0
    if lot:
        yield lot


def runs(data: np.ndarray, bounds: np.ndarray, deep: bool = True):
    """Yields (bytes, run start in them, windows, rank, deeper ranks of all windows by level, text row, start in the text) per piece."""
    for lot in _pieces(data, bounds):
        x = np.concatenate([data[s:e] for _, _, s, e in lot])
        ends = np.cumsum([e - s for _, _, s, e in lot])
        n = len(x) - THRESHOLD + 1
        if n <= 0:
            continue
        part = np.repeat(np.arange(len(lot)), [e - s for _, _, s, e in lot])[:n]
        inside = np.arange(n) + THRESHOLD <= ends[part]
        made = ranks(x, (FIRST, SECOND, THRESHOLD) if deep else (FIRST,))
        rank, *deeper = (smallest(h, THRESHOLD - length + 1) for length, h in made.items())
        new = inside.copy()
        new[1:] &= (rank[1:] != rank[:-1]) | (part[1:] != part[:-1])
        start = np.flatnonzero(new)
        label = np.cumsum(new) - 1
        windows = np.bincount(label[inside], minlength=len(start))
        row, base, at = (np.array(c) for c in list(zip(*lot))[:3])
        first = ends - np.array([e - s for _, _, s, e in lot])
        # Smallest hashes lie close together; mixed, they spread over all buckets.
        yield x, start, windows, mix(rank[start]), deeper, row[part[start]], start - first[part[start]] + base[part[start]]


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids ascending, bytes, bounds); of equal ids the smallest text."""
    table = table.select(["doc_id", "text"])
    ids = table.column("doc_id").to_numpy()
    if len(np.unique(ids)) < len(ids):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids = table.column("doc_id").to_numpy()
        table = table.take(pa.array(np.concatenate(([0], np.flatnonzero(ids[1:] != ids[:-1]) + 1))))
    else:
        table = table.take(pa.array(np.argsort(ids)))
    data, bounds = text_bytes(table.column("text"))
    return table.column("doc_id").to_numpy(), data, bounds


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)


def _cells(bucket: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each bucket that sorted ``bucket`` has."""
    value, begin = np.unique(bucket, return_index=True)
    return list(zip(value.tolist(), begin.tolist(), np.append(begin[1:], len(bucket)).tolist()))


def _joined(table: pa.Table, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The arrays in a binary column one after another, and the length of each."""
    data, bounds = text_bytes(table.column(name).cast(pa.large_binary()))
    return data.view(kind), np.diff(bounds) // np.dtype(kind).itemsize


def _equal_windows(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the THRESHOLD bytes from each ``a`` on are those from ``b`` on."""
    lanes, out = _lanes(x), np.ones(len(a), bool)
    for k in (*range(0, THRESHOLD - 8, 8), THRESHOLD - 8):
        out &= lanes[a + k] == lanes[b + k]
    return out


def _numbered(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each different window of THRESHOLD bytes, by the bytes themselves."""
    windows = x[at[:, None] + np.arange(THRESHOLD)]
    return np.unique(windows.view(f"V{THRESHOLD}").ravel(), return_inverse=True)[1].astype(U64)


def removed(left: pa.Table, right: pa.Table, texts: bool) -> pa.Table:
    """The result rows of a block from its documents and its runs of repeated windows. Runs are joined as intervals, so no array has an entry for each byte."""
    ids, data, bounds = _texts(left)
    doc, at, windows = (_joined(right, n, np.int64)[0] for n in ("docs", "starts", "windows"))
    row = np.searchsorted(ids, doc)
    order = np.lexsort((at, row))
    row = row[order]
    begin = bounds[row] + at[order]
    end = np.maximum.accumulate(begin + windows[order] + THRESHOLD - 1)
    new = np.flatnonzero(np.concatenate(([True], (begin[1:] > end[:-1]) | (row[1:] != row[:-1])))[: len(row)])
    row, begin, end = row[new], begin[new], end[np.append(new[1:], len(end))[: len(new)] - 1]
    spans = np.bincount(row, minlength=len(ids))
    gone = np.concatenate(([0], np.cumsum(end - begin)))
    last = np.cumsum(spans)
    kept, digest = [], []
    for s, e, i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), (last - spans).tolist(), last.tolist()):
        edges = zip([s, *end[i:j].tolist()], [*begin[i:j].tolist(), e])
        rest = [data[a:b] for a, b in edges if a < b]
        h = hashlib.sha256()
        for r in rest:
            h.update(r)
        digest.append(h.hexdigest())
        if texts:
            kept.append(b"".join(rest))
    return pa.table({
        "doc_id": pa.array(ids), "n_bytes": pa.array(np.diff(bounds)), "n_removed": pa.array(gone[last] - gone[last - spans]), "n_spans": pa.array(spans),
        "kept_sha256": pa.array(digest, pa.string()), **({"kept": pa.array(kept, pa.binary())} if texts else {}),
    })


def _one_text_per_id(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The smallest text of each doc_id. Tasks reduce what they read before the shuffle; where no id repeats, nothing is moved but counts of ids."""
    if rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows
    return scratch.save(rows.groupBy("doc_id").agg(F.min("text").alias("text")), "single")


def repeated(docs: DataFrame, scratch: Scratch, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, the kept bytes as ``kept``, for every document."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _one_text_per_id(rows, scratch)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, size // BLOCK_BYTES)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    tasks = min(blocks, max(LEAST_BLOCKS, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def dealt(frame: DataFrame, by: str) -> GroupedData:
        """Blocks, or buckets, go to tasks in turn: by a hash some tasks would get, sort and hold several times as many as others."""
        return frame.repartitionById(tasks, by).groupBy(by)

    def first_ranks(key, table):
        ids, data, bounds = _texts(table)
        found = [(rank, row) for _, _, _, rank, _, row, _ in runs(data, bounds, deep=False)]
        rank, row = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, U64), np.zeros(0, np.int64))
        order = np.lexsort((row, rank))
        rank, row = rank[order], row[order]
        begin = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1]))) if len(rank) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(rank)) if len(rank) else begin
        several = np.minimum(end - begin, ONE_DOCUMENT - 1).astype(np.uint16)
        several[row[end - 1] == row[begin]] |= ONE_DOCUMENT
        rank = rank[begin]
        cells = _cells(_bucket(rank, blocks), blocks)
        return pa.table({
            "bucket": pa.array([b for b, _, _ in cells], pa.int32()),
            "block": pa.array([key[0].as_py()] * len(cells), pa.int32()),
            "ranks": pa.array([rank[s:e].tobytes() for _, s, e in cells], pa.binary()),
            "several": pa.array([several[s:e].tobytes() for _, s, e in cells], pa.binary()),
        })

    def not_unique(table):
        rank, sizes = _joined(table, "ranks", U64)
        several, _ = _joined(table, "several", np.uint16)
        order = np.argsort(rank, kind="stable")
        begin = np.flatnonzero(np.concatenate(([True], rank[order][1:] != rank[order][:-1])))
        count = np.diff(np.append(begin, len(rank)))
        shared = (count > 1) | (several[order][begin] < ONE_DOCUMENT)
        total = np.add.reduceat((several[order] & (ONE_DOCUMENT - 1)).astype(np.int64), begin)
        keep, crowded = np.zeros(len(rank), bool), np.zeros(len(rank), np.uint8)
        keep[order], crowded[order] = np.repeat(shared, count), np.repeat((total > CROWDED).astype(np.uint8) + (total > PACKED), count)
        ends = np.cumsum(sizes)
        cells = [(b, slice(e - n, e)) for b, n, e in zip(table.column("block").to_pylist(), sizes.tolist(), ends.tolist()) if keep[e - n : e].any()]
        return pa.table({
            "block": pa.array([b for b, _ in cells], pa.int32()),
            "ranks": pa.array([rank[s][keep[s]].tobytes() for _, s in cells], pa.binary()),
            "crowded": pa.array([crowded[s][keep[s]].tobytes() for _, s in cells], pa.binary()),
        })

    def shared_runs(key, left, right):
        known, _ = _joined(right, "ranks", U64)
        crowded, _ = _joined(right, "crowded", np.uint8)
        order = np.argsort(known)
        known, crowded = known[order], crowded[order]
        ids, data, bounds = _texts(left)
        parts: list[tuple] = []
        for x, start, windows, rank, deeper, row, at in runs(data, bounds):
            if not len(known):
                break
            place = np.minimum(np.searchsorted(known, rank), len(known) - 1)
            hit = np.flatnonzero(known[place] == rank)
            start, windows, rank, row, at, full = start[hit], windows[hit], rank[hit], row[hit], at[hit], crowded[place[hit]]
            mark = ~U64(3)  # the last bits tell the level of a rank
            if full.any():  # rerank window by window, and join neighbours of the same rank
                own = np.flatnonzero(full)
                reps = windows[own]
                step = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                place_, owner = np.repeat(start[own], reps) + step, np.repeat(own, reps)
                longer = np.where(full[owner] > 1, mix(deeper[1][place_]) & mark | U64(2), mix(deeper[0][place_]) & mark | U64(1))
                new = np.concatenate(([True], (longer[1:] != longer[:-1]) | (owner[1:] != owner[:-1])))
                head = np.flatnonzero(new)
                extra = (place_[head], np.diff(np.append(head, len(place_))), longer[head], row[owner[head]], (at[owner] + step)[head])
                keep = full == 0
                start, windows, rank, row, at = (np.concatenate((a[keep], b)) for a, b in zip((start, windows, rank & mark, row, at), extra))
            else:
                rank = rank & mark
            # Long runs of periodic text come in parts.
            most = 256
            cut = -(-windows // most)
            own = np.repeat(np.arange(len(start)), cut)
            step = (np.arange(len(own)) - np.repeat(np.cumsum(cut) - cut, cut)) * most
            start, at, rank, row, windows = start[own] + step, at[own] + step, rank[own], row[own], np.minimum(windows[own] - step, most)
            stop = start + windows + THRESHOLD - 1
            size = stop - start
            body = x[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            parts.append((rank, span_hashes(x, start, stop), ids[row], at, windows, size, body))
        names = ["bucket", "block", "ranks", "docs", "starts", "windows", "bodies"]
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
        if not parts:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds)})
        rank, whole, doc, at, windows, size = (np.concatenate([p[k] for p in parts]) for k in range(6))
        body = np.concatenate([p[6] for p in parts])
        parts.clear()
        base = np.cumsum(size) - size
        order = np.lexsort((doc, whole, rank))
        rank, whole, doc, at, windows, size, base = (a[order] for a in (rank, whole, doc, at, windows, size, base))
        new = (rank[1:] != rank[:-1]) | (whole[1:] != whole[:-1]) | (size[1:] != size[:-1])
        new[~new] = ~same_spans(body, base[1:][~new], base[:-1][~new], size[1:][~new])
        begin = np.flatnonzero(np.concatenate(([True], new)))
        lowest = np.repeat(doc[begin], np.diff(np.append(begin, len(doc))))
        later = doc > lowest  # the same run is in a smaller document of this block
        first = ~later
        cells = _cells(_bucket(rank[first], blocks), blocks)
        rank, doc_, at_, win_, size_, base_ = (a[first] for a in (rank, doc, at, windows, size, base))

        def sent(s: int, e: int) -> bytes:
            n = size_[s:e]
            return body[np.repeat(base_[s:e] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()

        def batch(lot: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*lot), kinds)], names)

        # In small batches, as each is held whole by the JVM and by Python.
        lot, held, batches = [(-1, key[0].as_py(), b"", doc[later].tobytes(), at[later].tobytes(), windows[later].tobytes(), b"")], 0, []
        for b, s, e in cells:
            lot.append((b, key[0].as_py(), rank[s:e].tobytes(), doc_[s:e].tobytes(), at_[s:e].tobytes(), win_[s:e].tobytes(), sent(s, e)))
            held += int(size_[s:e].sum())
            if held >= BATCH_BYTES:
                batches.append(batch(lot))
                lot, held = [], 0
        return pa.Table.from_batches([*batches, batch(lot)] if lot else batches)

    def same_windows(table):
        rank, sizes = _joined(table, "ranks", U64)
        doc, at, windows = (_joined(table, n, np.int64)[0] for n in ("docs", "starts", "windows"))
        block = np.repeat(table.column("block").to_numpy(), sizes)
        bodies, _ = _joined(table, "bodies", np.uint8)
        size = windows + THRESHOLD - 1
        base = np.cumsum(size) - size
        names = ["block", "docs", "starts", "windows"]
        # Whole ranks at a time, so that the arrays stay small.
        order = np.argsort(rank, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], rank[order][1:] != rank[order][:-1], [True])))
        held = np.concatenate(([0], np.cumsum(size[order])))[edges]
        found, s = [], 0
        while s < len(edges) - 1:
            e = max(s + 1, int(np.searchsorted(held, held[s] + PIECE_BYTES, "right")) - 1)
            own = order[edges[s] : edges[e]]
            s = e
            n, w = size[own], windows[own]
            x = bodies[np.repeat(base[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            owner = np.repeat(np.arange(len(own)), w)
            step = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            place = np.repeat(np.cumsum(n) - n, w) + step
            h = ranks(x, (THRESHOLD,))[THRESHOLD][place]
            by = np.argsort(h, kind="stable")
            alike = np.flatnonzero(h[by][1:] == h[by][:-1])
            if not _equal_windows(x, place[by][alike], place[by][alike + 1]).all():  # different windows of one hash
                h = _numbered(x, place)
                by = np.argsort(h, kind="stable")
            hs, ds = h[by], doc[own][owner[by]]
            begin = np.flatnonzero(np.concatenate(([True], hs[1:] != hs[:-1])))
            gone = np.zeros(len(h), bool)
            gone[by] = ds > np.repeat(np.minimum.reduceat(ds, begin), np.diff(np.append(begin, len(hs))))
            head = gone & np.concatenate(([True], ~gone[:-1] | (owner[1:] != owner[:-1])))
            starts = np.flatnonzero(head)
            if len(starts):
                length = np.bincount((np.cumsum(head) - 1)[gone], minlength=len(starts))
                found.append((block[own][owner[starts]], doc[own][owner[starts]], at[own][owner[starts]] + step[starts], length))
        if not found:
            return pa.table({n: pa.array([], pa.int32() if n == "block" else pa.binary()) for n in names})
        b, d, a, w = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(b, kind="stable")
        b, d, a, w = b[order], d[order], a[order], w[order]
        cells = _cells(b, 0)
        return pa.table({
            "block": pa.array([c for c, _, _ in cells], pa.int32()),
            **{n: pa.array([v[s:e].astype(np.int64).tobytes() for _, s, e in cells], pa.binary()) for n, v in (("docs", d), ("starts", a), ("windows", w))},
        })

    def cut(key, left, right):
        return removed(left, right, texts)

    sent = dealt(rows, "block").applyInArrow(first_ranks, "bucket int, block int, ranks binary, several binary")
    shared = scratch.save(dealt(sent, "bucket").applyInArrow(not_unique, "block int, ranks binary, crowded binary"), "shared")
    found = dealt(rows, "block").cogroup(dealt(shared, "block")).applyInArrow(shared_runs, "bucket int, block int, ranks binary, docs binary, starts binary, windows binary, bodies binary")
    found = scratch.save(found, "runs")
    scratch.drop("shared")
    gone = dealt(found.where("bucket >= 0"), "bucket").applyInArrow(same_windows, "block int, docs binary, starts binary, windows binary")
    gone = scratch.save(gone.union(found.where("bucket < 0").select("block", "docs", "starts", "windows")), "gone")
    scratch.drop("runs")
    return dealt(rows, "block").cogroup(dealt(gone, "block")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(documents(spark, sf_dir), Scratch(spark, "op2"), texts=False)


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLE: dict[str, str] = {}
