"""op2, op5, op10 on edge cases and against brute force."""

import hashlib
import itertools
import math
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from plain_doubling import bytes_removed
from pyspark.sql import functions as F
from support import SF, same_rows

from finlake.llm import op2_suffix_dedup as op2
from finlake.llm import op5_minhash as op5
from finlake.llm import op10_exact_dedup as op10
from finlake.llm.components import connected_components
from finlake.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect() if r["doc_id"] is not None}


# --- op2


def removed(docs: dict[int, str]) -> dict[int, tuple]:
    first, out = {}, {}
    for i in sorted(docs):
        b = docs[i].encode()
        gone, mine = np.zeros(len(b) + 50, int), set()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            mine.add(w)
            if w in first:
                gone[k] += 1
                gone[k + 50] -= 1
        for w in mine:
            first.setdefault(w, i)
        g = np.cumsum(gone)[: len(b)] > 0
        spans = int((g & ~np.concatenate(([False], g[:-1]))).sum()) if len(b) else 0
        out[i] = (len(b), int(g.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~g])).hexdigest())
    return out


def op2_rows(docs, spark):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op2.repeated(docs, Scratch(spark, "t")).drop("kept").collect()}


def test_op2_edges(spark, edge, empty):
    assert op2_rows(edge, spark) == removed(texts(edge))
    assert op2_rows(empty, spark) == {}


@pytest.mark.parametrize("crowded, packed, piece", [(2000, 1 << 18, 1 << 19), (1, 1 << 18, 700), (1, 1, 700), (1, 4, 700)])
def test_op2_brute_force(spark, crowded, packed, piece, monkeypatch):
    """Also where every shared rank is reranked, to either level, and texts come in many parts."""
    monkeypatch.setattr(op2, "CROWDED", crowded)
    monkeypatch.setattr(op2, "PACKED", packed)
    monkeypatch.setattr(op2, "PIECE_BYTES", piece)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 90")
    assert op2_rows(docs, spark) == removed(texts(docs))


def test_op2_brute_force_on_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert op2_rows(docs, spark) == removed(texts(docs))


def test_op2_agrees_with_plain_doubling(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    found = {r["doc_id"]: r["n_removed"] for r in op2.repeated(docs, Scratch(spark, "t")).collect()}
    assert {i: n for i, n in found.items() if n} == bytes_removed(docs)


def test_op2_periodic_and_overlapping(spark):
    docs = {1: "ab" * 400, 2: "ba" * 100 + "tail", 3: "z" * 49, 4: "z" * 50, 5: "z" * 51, 6: "q" + "ab" * 30 + "q", 7: "é" * 40}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert op2_rows(df, spark) == removed(docs)


def test_op2_compares_bytes_where_hashes_agree(spark, monkeypatch):
    """With hashes of few values all runs and windows collide; the result is that of the bytes."""
    real = op2.ranks

    def few(data, lengths):
        return {n: r % op2.U64(3) for n, r in real(data, lengths).items()}

    def none(data, start, end):
        return (end - start).astype(op2.U64) * op2.U64(0)

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    expected = removed(texts(docs))
    monkeypatch.setattr(op2, "ranks", few)
    monkeypatch.setattr(op2, "span_hashes", none)
    assert op2_rows(docs, spark) == expected and any(n for _, n, _, _ in expected.values())


def test_op2_repeated_ids_are_reduced_first(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{base} {i}") for i in range(20)] + [(7, f"{base} other {i % 40}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    single = op2._one_text_per_id(df, Scratch(spark, "t"))
    assert single.count() == 20
    smallest = {i: min(t for j, t in rows if j == i) for i in range(20)}
    assert op2_rows(df, spark) == removed(smallest)
    plain = spark.createDataFrame(rows[:20], df.schema)
    assert op2._one_text_per_id(plain, Scratch(spark, "t")) is plain


def test_op2_last_step_needs_no_array_of_bytes():
    """A block's result from its runs, also where they touch, overlap or end with a text, in little more memory than its texts."""
    rng = np.random.default_rng(5)
    sizes = [0, 49, 50, 51, *rng.integers(100, 40_000, 250).tolist(), 0]
    docs = {i * 3: "".join(map(chr, rng.integers(97, 123, n))) for i, n in enumerate(sizes)}
    found = [(2 * 3, 0, 1), (3 * 3, 0, 1), (3 * 3, 1, 1), (4 * 3, 0, 1), (4 * 3, 50, 1)]  # whole texts; two runs that touch
    for i, text in docs.items():
        for at in rng.integers(0, max(len(text) - 49, 1), 4 * (len(text) > 99)).tolist():
            found.append((i, at, int(rng.integers(1, min(256, len(text) - 49 - at) + 1))))
    rng.shuffle(found)
    left = pa.table({"doc_id": pa.array(list(docs)), "text": pa.array(list(docs.values()))})
    cells = [{n: np.array([r[k] for r in part], np.int64).tobytes() for k, n in enumerate(("docs", "starts", "windows"))} for part in (found[:300], found[300:])]
    tracemalloc.start()
    out = op2.removed(left, pa.Table.from_pylist(cells), texts=False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * sum(sizes)
    kept = op2.removed(left, pa.Table.from_pylist(cells), texts=True).column("kept").to_pylist()
    for row, own in zip(out.to_pylist(), kept):
        gone = np.zeros(row["n_bytes"], bool)
        for _, at, n in [f for f in found if f[0] == row["doc_id"]]:
            gone[at : at + n + 49] = True
        rest = bytes(np.frombuffer(docs[row["doc_id"]].encode(), np.uint8)[~gone])
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(gone) else 0
        assert (row["n_removed"], row["n_spans"], row["kept_sha256"], own) == (gone.sum(), spans, hashlib.sha256(rest).hexdigest(), rest)
    assert op2.removed(left.slice(0, 2), pa.Table.from_pylist([], pa.schema([(n, pa.binary()) for n in ("docs", "starts", "windows")])), True).column("n_spans").to_pylist() == [0, 0]


def test_op2_runs_are_sent_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(op2, "BATCH_BYTES", 1)  # a batch for each bucket
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    expected = removed(texts(docs))
    assert op2_rows(docs, spark) == expected and any(n for _, n, _, _ in expected.values())


def test_op2_blocks_are_dealt_evenly(spark, monkeypatch):
    """Each task of the result has one block; where tasks are fewer, at most one more than another."""
    df = spark.range(4800).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    for blocks, limit in ((48, 48), (48, 5)):
        monkeypatch.setattr(op2, "LEAST_BLOCKS", limit)
        monkeypatch.setattr(op2, "BLOCK_BYTES", df.selectExpr("sum(length(text))").first()[0] // blocks)
        rows = op2.repeated(df, Scratch(spark, "t")).select(F.spark_partition_id().alias("task"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"))
        dealt = [r["n"] for r in rows.groupBy("task").agg(F.countDistinct("block").alias("n")).collect()]
        assert len(dealt) == limit and sum(dealt) == 48 and max(dealt) - min(dealt) <= 1


def test_op2_ranks_compose():
    data = np.frombuffer(b"the same twenty bytes or more, the same twenty bytes or more", np.uint8)
    r = op2.ranks(data, (20, 40, 50))
    assert r[20][0] == r[20][31] and len(r[50]) == len(data) - 49 and len(op2.ranks(data[:10], (20,))[20]) == 0


# --- op5


def components(docs: dict[int, str], percent: int = 85) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in docs.items():
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    part = {i: i for i in docs}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in itertools.combinations(sorted(docs), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            part[y] = x
    return {i: (len(sets[i]), root(i)) for i in docs}


def op5_rows(docs, spark):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op5.near_groups(docs, Scratch(spark, "t")).collect()}


def test_op5_edges(spark, edge, empty):
    assert op5_rows(edge, spark) == components(texts(edge))
    assert op5_rows(empty, spark) == {}


def test_op5_agrees_with_sql(spark, duck):
    same_rows(op5.op5_minhash(spark, SF).toPandas(), duck.execute(op5.ORACLE["op5_minhash"]).df())


def crowd(copies: int, n: int, seed: int) -> dict[int, str]:
    """Copies of one text with 0 to 4 words changed: some link to the text, some to each other only, some to nothing."""
    rng = np.random.default_rng(seed)
    base = [f"b{k}" for k in range(n)]
    docs = {}
    for i in range(copies):
        w = list(base)
        for k in rng.choice(n, rng.integers(0, 5), replace=False):
            w[k] = f"x{i}-{k}" if rng.random() < 0.6 else f"y{k}-{rng.integers(3)}"
        docs[i] = " ".join(w)
    return docs


@pytest.mark.parametrize("n", [40, 150])
def test_op5_crowded_buckets(spark, n):
    docs = crowd(160, n, n)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert op5_rows(df, spark) == components(docs)


def sections(n: int, seed: int) -> dict[int, str]:
    """Texts of six of twelve shared sections in one order and a few words of their own: long lists, few links, many sizes."""
    draw = np.random.default_rng(seed)
    shared = [" ".join(f"s{k}w{i}" for i in range(12 + 3 * k)) for k in range(12)]
    out = {}
    for i in range(n):
        own = " ".join(f"o{i}x{j}" for j in range(draw.integers(0, 9)))
        out[i] = " ".join([shared[k] for k in sorted(draw.choice(12, 6, replace=False))] + [own])
    return out


@pytest.mark.parametrize("block", [3, 1000])
def test_op5_long_lists_without_links(spark, block, monkeypatch):
    """The last turn by classes of size and blocks, against brute force: without stars it does all of the work."""
    monkeypatch.setattr(op5, "BLOCK", block)
    monkeypatch.setattr(op5, "STARS", 0 if block == 3 else 1)
    docs = sections(150, block)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    expected = components(docs)
    assert 20 < len({c for _, c in expected.values()}) < len(docs)
    assert op5_rows(df, spark) == expected


def test_op5_near_dedup_keeps_columns_and_uses_80(spark, edge):
    kept = op5.near_dedup(edge)
    assert kept.columns == edge.columns
    expected = {i for i, (_, c) in components(texts(edge), 80).items() if i == c}
    assert {r["doc_id"] for r in kept.collect()} == expected


def test_op5_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(1, 2**63, 1000).astype(np.uint64)
    b = np.concatenate((a[:900], rng.integers(1, 2**63, 100).astype(np.uint64)))
    few = a[:2]
    s = op5.sketches(np.concatenate((a, b, few)), np.array([0, 1000, 2000, 2002, 2002]), 400)
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.08
    assert (s[2] != op5.EMPTY).all() and (s[3] == op5.EMPTY).all()  # two elements fill every coordinate, none fill none


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(10, 40)] + [(50, 52), (52, 51), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(edges, Scratch(spark, "t"), "c").collect()}
    assert got == {k: 10 for k in range(10, 41)} | {50: 50, 51: 50, 52: 50}
    assert connected_components(edges.limit(0), Scratch(spark, "t"), "c").isEmpty()


@pytest.mark.parametrize("n", [100, 400])
def test_op5_members_that_only_share_a_passage_do_not_meet(spark, n):
    """Sets of 50 to 53 elements that share 45: too few to link, though the passage stands early enough for a smaller partner."""
    rows = [(1, i, 50 + i % 4, place, i) for i in range(n) for place in [6 + i % 4] if place <= 8]
    members = spark.createDataFrame(rows, "item long, doc_id long, n int, place int, component long")
    met = lambda away, others: away.select(*op5.CELL, F.col("doc_id").alias("a")).join(others.select(*op5.CELL, F.col("doc_id").alias("b")), op5.CELL).where("a <> b").count()
    assert met(*op5._cells(members, members, Scratch(spark, "t"), 85)) <= n * math.log2(n)
    early = members.withColumn("place", F.lit(1))  # these may link, and all meet
    assert met(*op5._cells(early, early, Scratch(spark, "t"), 85)) == len(rows) * (len(rows) - 1)


@pytest.mark.parametrize("threshold", [80, 85, 100])
def test_op5_classes_lose_no_pair(spark, threshold):
    """Every pair of sizes and places that the exact conditions allow meets in a cell."""
    sizes = [1, 2, 3, 5, 8, 9, 10, 17, 18, 20, 21, 40, 47, 50, 99, 100, 117, 118, 1000, 1176]
    rows = [(1, 10 * k + p, n, place, 10 * k + p) for k, n in enumerate(sizes) for p, place in enumerate(sorted({1, 2, max(1, n // 10), max(1, n - math.ceil(n * threshold / 100) + 1)}))]
    members = spark.createDataFrame(rows, "item long, doc_id long, n int, place int, component long")
    away, others = op5._cells(members, members, Scratch(spark, "t"), threshold)
    pair = away.select(*op5.CELL, F.col("doc_id").alias("a")).join(others.select(*op5.CELL, F.col("doc_id").alias("b")), op5.CELL)
    found = {(r["a"], r["b"]) for r in pair.collect()}
    for _, a, n, p, _ in rows:
        for _, b, m, q, _ in rows:
            overlap = -(-threshold * (n + m) // (100 + threshold))
            if 100 * n >= threshold * m and 100 * m >= threshold * n and p <= n - overlap + 1 and q <= m - overlap + 1:
                assert (a, b) in found, (n, p, m, q)


# --- op10


def groups(docs: dict[int, str]) -> dict[int, tuple]:
    by: dict[str, list[int]] = {}
    for i, t in docs.items():
        by.setdefault(t.translate(LOWER), []).append(i)
    return {i: (max(ids), len(ids)) for ids in by.values() for i in ids}


def op10_rows(docs, spark):
    return {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in op10.exact_groups(docs, Scratch(spark, "t")).collect()}


def group_rows(rows: list[tuple]) -> list[tuple]:
    """(doc_id, keep_id, group_size, digest) of each row, repeated ones too."""
    norm = [(i, (t or "").translate(LOWER)) for i, t in rows if i is not None]
    of = {}
    for i, t in norm:
        of.setdefault(t, []).append(i)
    return sorted((i, max(of[t]), len(of[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)


REPEATED = [(5, "A"), (5, "B"), (3, "a"), (2, "b"), (5, "A"), (9, "long " * 400_000), (8, "LONG " * 400_000), (7, "LONG " * 399_999 + "lung "), (1, None), (1, ""), (4, ""), (None, "a")]


@pytest.mark.parametrize("parallel", [64, 2])
def test_op10_rows_of_one_id(spark, parallel, monkeypatch):
    monkeypatch.setattr(op10, "PARALLEL", parallel)
    df = spark.createDataFrame(REPEATED, "doc_id long, text string").repartition(3)
    found = op10.exact_groups(df, Scratch(spark, "t")).select("doc_id", "keep_id", "group_size", "digest").collect()
    assert sorted(map(tuple, found)) == group_rows(REPEATED)
    kept = op10.exact_dedup(df.selectExpr("doc_id", "text", "1 as version", "2 as keep_id", "3 as copies", "4 as doc"))
    assert sorted((r["doc_id"], (r["text"] or "").lower()[:9]) for r in kept.collect()) == [(4, ""), (5, "a"), (5, "b"), (7, "long long"), (9, "long long")]


def test_op10_edges(spark, edge, empty):
    found = op10.exact_groups(edge, Scratch(spark, "t")).select("doc_id", "keep_id", "group_size", "digest").collect()
    assert sorted(map(tuple, found)) == group_rows([(r["doc_id"], r["text"]) for r in edge.collect()])
    assert op10_rows(empty, spark) == {}


def test_op10_agrees_with_sql(spark, duck):
    same_rows(op10.op10_exact_dedup(spark, SF).toPandas(), duck.execute(op10.ORACLE["op10_exact_dedup"]).df())


def test_op10_chunks_compose(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 3000).astype(np.uint8)
    whole = op10.chunk_hash(data)
    for cut in (1, 1000, 2999):
        left, right = op10.chunk_hash(data[:cut]), op10.chunk_hash(data[cut:])
        assert [(op10.shift(left[k], len(data) - cut, k) + right[k]) % op10.PRIMES[k] for k in range(4)] == whole
    digits = data.astype(object) + 1
    assert whole[0] == sum(int(d) * pow(op10.BASES[0], len(data) - 1 - i, op10.PRIMES[0]) for i, d in enumerate(digits)) % op10.PRIMES[0]


def test_op10_equal_fingerprints_are_compared(spark, edge, monkeypatch):
    """All texts get one fingerprint per length: only the comparison can tell them apart."""
    rows = {i: f"text {i % 4}" for i in range(12)} | {20: "other length"}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    real = op10.fingerprints
    monkeypatch.setattr(op10, "fingerprints", lambda docs: real(docs).selectExpr("doc_id", "version", "n_bytes", "digest", "0L as f1", "0L as f2"))
    assert op10_rows(df, spark) == groups(rows)


def test_op10_dedup_keeps_columns(spark, edge):
    kept = op10.exact_dedup(edge)
    assert kept.columns == edge.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, _ in groups(texts(edge)).values()}


def test_repeated_ids_do_not_crash(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "other text of six words"), (2, "a b c d e f")], "doc_id long, text string")
    assert len(op10_rows(df, spark)) == 2 and len(op5_rows(df, spark)) == 2 and len(op2_rows(df, spark)) == 2


def test_op5_repeated_ids(spark):
    """A doc_id counts with its smallest set, in one row."""
    rows = [(1, "a b c d e f g"), (1, "other text of six words"), (2, "a b c d e f g"), (3, "other text of six words"), (3, "other text of six words"), (4, "A b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(map(tuple, op5.near_groups(df, Scratch(spark, "t")).collect()))
    assert found == [(1, 1, 1), (2, 3, 2), (3, 1, 1), (4, 3, 2)]  # the text of one shingle is the smaller


def test_op5_equal_digests_are_compared(spark, monkeypatch):
    """With one digest for all sets of a size, nothing is merged that differs, and every link is found."""
    monkeypatch.setattr(op5, "_digest", lambda values, bounds: {"n_shingles": np.diff(bounds), "k1": np.zeros(len(bounds) - 1, np.int64), "k2": np.zeros(len(bounds) - 1, np.int64)})
    docs = {1: "a b c d e f g", 2: "h i j k l m n", 3: "a b c d e f g", 4: "o p q r s t u", 5: "H i j k l m n", 6: ""}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert op5_rows(df, spark) == components(docs)


THUE_MORSE = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
OTHER = THUE_MORSE.translate(str.maketrans("ab", "ba"))


def test_op5_long_words_are_told_apart(spark):
    """Words whose polynomial hashes modulo a power of two agree whatever the base."""
    docs = {1: THUE_MORSE, 2: OTHER, 3: f"one two {THUE_MORSE} three four", 4: f"one two {OTHER} three four", 5: THUE_MORSE}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert op5_rows(df, spark) == components(docs)
