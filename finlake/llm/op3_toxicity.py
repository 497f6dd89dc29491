"""Toxicity: a convolutional text classifier in NumPy.

Words are runs of letters, lower-cased in A-Z. A word's embedding is the sum of
two rows of one hashed table: that of the word and that of its first PREFIX
bytes, which words of one stem share. Filters of several widths run over the
embeddings, each is pooled by its maximum over the whole text, and a logistic
layer reads the pooled values. One column of the table starts as the smoothed
log-odds of the row among toxic and other texts of the sample, the rest at
random; all weights are then trained by gradient steps through the maxima.

It learns from every labelled text, whole, in Spark's tasks. The words of the texts
are set aside as rows of the table, dealt out by a hash of the id. In a round
each task takes gradient steps over its rows from the model of the last round; a
weight moves by the mean of its moves, over the rows of the tasks that moved it.
Moves are summed as integers, so runs agree; the driver holds one model. A fifth
of the rows is held back: the margin is scaled to a probability there so that the
score CUT stands at the margin that separates best, and each language that has
enough rows gets a threshold of its own the same way, both from counts of rows by
margin in steps of 1 / STEPS. The language chooses a
threshold for ``flagged`` only; the score comes from the text alone. Of several labels
of one id the smallest is taken; repeated rows are learned each.

A null or empty text pools nothing: its score is that of no words at all.
Without labels of both kinds every score is 0. Rows without a doc_id are left
out; repeated rows are scored each. Extra columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake.llm.features import LETTERS, platt, sigmoid
from finlake.llm.kernels import U64, mix, slices, span_hashes, text_bytes, words
from finlake.llm.scratch import Scratch, arrow_map, documents, in_sample

BUCKETS, DIMENSIONS, WIDTHS, FILTERS, PREFIX = 1 << 17, 6, (1, 2, 3), 6, 6
CUT, ENOUGH, ROUNDS, RATE = 0.7, 40, 8, 0.01
#: Labelled rows of a shard, about; steps of a margin that are told apart; parts of a weight's move.
SHARD_ROWS, STEPS, PARTS = 8192, 1024, 1 << 24
#: Words of a long text that are pooled together.
SLICE_WORDS = 1 << 17


def word_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table rows of words, of prefixes, bounds of the texts)."""
    data, bounds = text_bytes(column)
    found = []
    for part, at in slices(LETTERS[data], bounds):
        start, end, row = words(part, at)
        found.append((span_hashes(part, start, end), mix(span_hashes(part, start, np.minimum(end, start + PREFIX)) + U64(1)), row))
    whole, prefix, row = (np.concatenate(c) for c in zip(*found))
    n = np.bincount(row, minlength=len(column))
    return (whole % U64(BUCKETS)).astype(np.int64), (prefix % U64(BUCKETS)).astype(np.int64), np.concatenate(([0], np.cumsum(n)))


def _pooled(table: np.ndarray, filters: list[np.ndarray], bias: np.ndarray, a: np.ndarray, b: np.ndarray, bounds: np.ndarray, places: bool = False, open_end: int = 0):
    """Texts x filters maxima of relu(conv); with ``places`` also where each stands (-1: nowhere above 0). No window begins at the last ``open_end`` words."""
    rows, gap = len(bounds) - 1, max(WIDTHS) - 1
    size = np.diff(bounds)
    shift = np.repeat(np.arange(rows) * gap, size)  # zero rows between texts
    x = np.zeros((len(a) + rows * gap + gap, table.shape[1]), np.float32)
    at = np.arange(len(a)) + shift
    x[at] = table[a] + table[b]
    real = np.zeros(len(x), bool)
    real[at[: len(at) - open_end]] = True
    out, where = [], []
    begin = bounds[:-1] + np.arange(rows) * gap
    for w in filters:  # width x dimensions x filters
        n = len(x) - gap
        y = x[:n] @ w[0]
        for k in range(1, len(w)):
            y += x[k : k + n] @ w[k]
        y[~real[:n]] = -1e9  # a window begins at a word; what it lacks at the end of a text is zeros
        out.append((y, begin))
    pooled = np.concatenate([np.maximum.reduceat(np.vstack((y, np.full((1, y.shape[1]), -1e9, np.float32))), begin, axis=0) for y, begin in out], axis=1) if rows else np.zeros((0, len(bias)), np.float32)
    pooled = np.where(size[:, None] > 0, pooled + bias, 0.0)
    value = np.maximum(pooled, 0).astype(np.float32)
    if not places:
        return value
    for y, begin in out:
        stop = np.append(begin[1:], len(y))
        where.append(np.stack([begin[i] + y[begin[i] : stop[i]].argmax(axis=0) if size[i] else np.full(y.shape[1], -1) for i in range(rows)]))
    return value, np.concatenate(where, axis=1), x, at


def _seen(a: np.ndarray, b: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many toxic and other texts hold each table row."""
    row = np.repeat(np.arange(len(y)), np.diff(bounds))
    hit, miss = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for ids in (a, b):
        seen = np.unique(ids * len(y) + row)
        doc, bucket = seen % len(y), seen // len(y)
        hit += np.bincount(bucket[y[doc] == 1], minlength=BUCKETS)
        miss += np.bincount(bucket[y[doc] != 1], minlength=BUCKETS)
    return hit, miss


def _start(hit: np.ndarray, miss: np.ndarray, positive: int, negative: int, rng: np.random.Generator) -> dict:
    """The weights that training begins with."""
    positive, negative = max(positive, 1), max(negative, 1)
    odds = np.where(hit + miss > 0, np.log((hit + 1) / positive * negative / (miss + 1 * negative / positive)), 0.0)  # smoothed
    table = rng.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32)
    table[:, 0] = np.clip(odds, -1, 6) / 4
    filters = [rng.normal(0, 0.1, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in filters:
        w[:, 0, :] = np.abs(w[:, 0, :]) + 0.6 / len(w)
    n = len(WIDTHS) * FILTERS
    return {"table": table, "filters": filters, "bias": np.full(n, -0.2, np.float32), "out": np.full(n, 0.3, np.float32), "offset": np.float32(-2.0)}


def _maxima(m: dict, a: np.ndarray, b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts x filters: the maxima, and the words at which their windows begin (-1: none); about SLICE_WORDS words at once."""
    values, places, gap, i = [], [], max(WIDTHS) - 1, 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE_WORDS, "right")) - 1)
        low, high = bounds[i], bounds[j]
        value, place = None, None
        for at in range(low, max(high - gap, low + 1), SLICE_WORDS) if high - low > SLICE_WORDS else (low,):  # a long text, by slices that overlap by the reach of a window
            stop = high if high - low <= SLICE_WORDS else min(high, at + SLICE_WORDS + gap)
            own = bounds[i : j + 1] - low if high - low <= SLICE_WORDS else np.array([0, stop - at])
            v, p, _, _ = _pooled(m["table"], m["filters"], m["bias"], a[at:stop], b[at:stop], own, places=True, open_end=gap if stop < high else 0)
            p = np.where(p < 0, -1, p - np.arange(len(own) - 1)[:, None] * gap + at)
            value, place = (v, p) if value is None else (np.maximum(v, value), np.where(v > value, p, place))
        values.append(value)
        places.append(place)
        i = j
    return np.concatenate(values), np.concatenate(places)


def _step(m: dict, a: np.ndarray, b: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray, step: float) -> None:
    """One gradient step over some texts, in place. Only the windows of the maxima have a gradient."""
    value, place = _maxima(m, a, b, bounds)
    miss = ((sigmoid(value @ m["out"] + m["offset"]) - y) * weight / len(y)).astype(np.float32)
    g_value = miss[:, None] * m["out"][None, :] * (value > 0)
    moves, ids, changes = [], [], []
    for j, w in enumerate(m["filters"]):
        cols = slice(j * FILTERS, (j + 1) * FILTERS)
        g, p, move = g_value[:, cols], place[:, cols], []
        for k in range(len(w)):
            inside = (p >= 0) & (p + k < bounds[1:, None]) & (g != 0)
            i, f = np.nonzero(inside)
            word = p[i, f] + k
            x = np.zeros((*p.shape, DIMENSIONS), np.float32)
            x[i, f] = m["table"][a[word]] + m["table"][b[word]]
            move.append(np.einsum("ifd,if->df", x, g))
            change = g[i, f][:, None] * w[k].T[f]
            ids += [a[word], b[word]]
            changes += [change, change]
        moves.append(np.stack(move))
    m["out"] -= step * 10 * (value.T @ miss + 1e-3 * m["out"])
    m["offset"] -= np.float32(step * 10 * miss.sum())
    m["bias"] -= step * 5 * g_value.sum(axis=0)
    for w, move in zip(m["filters"], moves):
        w -= step * 5 * (move + 1e-3 * w)
    np.add.at(m["table"], np.concatenate(ids), -step * 20 * np.concatenate(changes))


def _picked(a: np.ndarray, b: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and bounds of some of the texts."""
    parts = [np.arange(bounds[i], bounds[i + 1]) for i in rows]
    at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return a[at], b[at], np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))


def _learn(m: dict, a: np.ndarray, b: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray, step: float, rng: np.random.Generator) -> None:
    """Gradient steps over all texts once, about 64 in each."""
    for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
        _step(m, *_picked(a, b, bounds, batch), y[batch], weight[batch], step)


def _weights(y: np.ndarray, positive: int, negative: int) -> np.ndarray:
    return np.where(y == 1, 0.5 / max(positive, 1), 0.5 / max(negative, 1)) * (positive + negative)


def _finished(m: dict) -> dict:
    return {"table": m["table"].astype(np.float16), "filters": m["filters"], "bias": m["bias"], "out": m["out"], "offset": float(m["offset"]), "slope": 1.0, "shift": 0.0, "cuts": {}}


def _calibrated(model: dict, z: np.ndarray, y: np.ndarray, n: np.ndarray, by_language: dict) -> dict:
    """``n``: rows of each margin and label; ``by_language``: the same by name, of those with enough rows."""
    slope, shift = platt(z, y, n=n)
    model |= {"slope": max(slope, 1e-3)}
    model |= {"shift": float(np.log(CUT / (1 - CUT)) - model["slope"] * _best_cut(z, y, n))}
    for name, (own, target, rows) in sorted(by_language.items()):
        model["cuts"][name] = float(_best_cut(sigmoid(model["slope"] * own + model["shift"]), target, rows))
    return model


def fit(texts: list[str], y: np.ndarray, langs: list[str], seed: int = 3, rounds: int = ROUNDS, rate: float = RATE) -> dict | None:
    """The trained and calibrated model of texts in memory, as one shard; None if there is only one label."""
    y = np.asarray(y, np.int64)
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.2 if min((y == 1).sum(), (y == 0).sum()) >= 20 else np.zeros(len(y), bool)
    column = pa.array(texts, pa.large_string())
    words_of, ys = word_rows(column.take(pa.array(np.flatnonzero(~held)))), y[~held]
    positive, negative = int((ys == 1).sum()), int((ys != 1).sum())
    m = _start(*_seen(*words_of, ys), positive, negative, rng)
    for turn in range(rounds):
        _learn(m, *words_of, ys, _weights(ys, positive, negative), rate / (1 + 0.5 * turn), rng)
    model = _finished(m)
    on = held if held.any() else ~held
    z, target, lang = margins(column.filter(pa.array(on)), model), y[on], np.array([str(x) for x in langs], dtype=object)[on]
    one = lambda mine: (z[mine], target[mine], np.ones(mine.sum()))
    enough = {name: one(lang == name) for name in set(lang) if min((target[lang == name] == 1).sum(), (target[lang == name] != 1).sum()) >= ENOUGH}
    return _calibrated(model, z, target, np.ones(len(z)), enough)


def _best_cut(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the best F1; ``n``: how often each of z and y stands."""
    order = np.argsort(-z)
    z, hit, n = z[order], np.where(y[order] == 1, n[order], 0), n[order]
    hits = np.cumsum(hit)
    f1 = 2 * hits / (np.cumsum(n) + hits[-1])
    after = np.append(z[1:], z.min() - 1e-3)
    gap = np.where((f1 >= f1.max() - 1e-12) & (z > after), z - after, -1)
    i = int(gap.argmax())
    return float((z[i] + after[i]) / 2)


def margins(column: pa.Array, model: dict) -> np.ndarray:
    return np.concatenate([_margin(column.slice(i, 64), model) for i in range(0, len(column), 64)]) if len(column) else np.zeros(0)


def _margin(column: pa.Array, model: dict) -> np.ndarray:
    a, b, bounds = word_rows(column)
    table, gap, value = model["table"].astype(np.float32, copy=False), max(WIDTHS) - 1, 0.0
    pool = lambda a, b, bounds, **more: _pooled(table, model["filters"], model["bias"], a, b, bounds, **more)
    if len(column) > 1 or len(a) <= SLICE_WORDS:
        value = pool(a, b, bounds)
    else:  # a long text, by slices that overlap by the reach of a window
        for at in range(0, len(a) - gap, SLICE_WORDS):
            part = slice(at, at + SLICE_WORDS + gap)
            value = np.maximum(value, pool(a[part], b[part], np.array([0, len(a[part])]), open_end=gap if part.stop < len(a) else 0))
    return (value @ model["out"] + model["offset"]).astype(float)


def _unpacked(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of the words, of the prefixes, bounds, labels of a block of the words that were set aside."""
    whole, prefix = block.column("words"), block.column("prefixes")
    return whole.flatten().to_numpy().astype(np.int64), prefix.flatten().to_numpy().astype(np.int64), np.concatenate(([0], np.cumsum(pc.list_value_length(whole).to_numpy(zero_copy_only=False), dtype=np.int64))), block.column("label").to_numpy()


def _set_aside(scratch: Scratch, docs: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """label, lang, held, words and prefixes of all labelled texts, in an order by the hash of the id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("toxic") == 1).cast("long").alias("label"))
    known = scratch.save(known, "labels")
    shards = max(1, -(-known.count() // SHARD_ROWS))
    # Only what may be learned is shuffled, once, and dealt the same way at any size.
    deal = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(lang, F.lit("None")).alias("lang"))
    rows = rows.repartition(deal, "doc_id").join(known.repartition(deal, "doc_id").hint("merge"), "doc_id")

    def columns(block: pa.RecordBatch) -> dict:
        a, b, bounds = word_rows(block.column("text"))
        lists = lambda ids: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
        return {c: block.column(c) for c in ("doc_id", "lang", "label")} | {"words": lists(a), "prefixes": lists(b)}

    found = arrow_map(rows, columns, "doc_id long, lang string, label long, words array<int>, prefixes array<int>", rows=4096)
    place = F.xxhash64(F.lit(seed), F.col("doc_id"))
    found = found.withColumns({"place": place, "held": F.pmod(place, F.lit(5)) == 0})
    return scratch.save(found.sortWithinPartitions("place", "doc_id", F.xxhash64("words")).drop("doc_id", "place"), "words").coalesce(shards)


def _flat(m: dict) -> np.ndarray:
    """All weights, in rows of DIMENSIONS numbers: the table, then the others."""
    rest = np.concatenate([*[w.ravel() for w in m["filters"]], m["bias"], m["out"], [m["offset"]]]).astype(np.float32)
    return np.concatenate((m["table"], np.pad(rest, (0, -len(rest) % DIMENSIONS)).reshape(-1, DIMENSIONS)))


def _shaped(flat: np.ndarray) -> dict:
    rest, at, filters, n = flat[BUCKETS:].ravel(), 0, [], len(WIDTHS) * FILTERS
    for w in WIDTHS:
        size = w * DIMENSIONS * FILTERS
        filters.append(rest[at : at + size].reshape(w, DIMENSIONS, FILTERS).copy())
        at += size
    return {"table": flat[:BUCKETS].copy(), "filters": filters, "bias": rest[at : at + n].copy(), "out": rest[at + n : at + 2 * n].copy(), "offset": np.float32(rest[at + 2 * n])}


def _numbers(df: DataFrame, scratch: Scratch, name: str) -> dict[str, np.ndarray]:
    """Columns of a table of at most a row for each row of the model."""
    found = scratch.save(df, name).toArrow()
    scratch.drop(name)
    return {c: found.column(c).to_numpy() for c in found.column_names}


def _round(rows: DataFrame, scratch: Scratch, m: dict, turn: int, totals: tuple[int, int], seed: int) -> dict:
    """The model after each task has learned from all its rows once, and their mean."""
    before = _flat(m)
    shared, names = rows.sparkSession.sparkContext.broadcast(before), [f"d{k}" for k in range(DIMENSIONS)]

    def run(blocks):
        mine, rng, n = _shaped(shared.value), np.random.default_rng((seed, turn)), 0
        for block in blocks:
            if block.num_rows:
                a, b, bounds, y = _unpacked(block)
                _learn(mine, a, b, bounds, y, _weights(y, *totals), RATE / (1 + 0.5 * turn), rng)
                n += block.num_rows
        if n:
            moved = np.rint((_flat(mine) - shared.value).astype(float) * PARTS).astype(np.int64)
            at = np.flatnonzero(moved.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), n))] + [pa.array(moved[at, k] * n) for k in range(DIMENSIONS)], names=["at", "n", *names])

    moves = rows.where("not held").select("words", "prefixes", "label").mapInArrow(run, ", ".join(f"{c} long" for c in ("at", "n", *names)))
    got = _numbers(moves.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", *names)]), scratch, f"round{turn}")
    shared.destroy()
    before[got["at"]] += (np.stack([got[c] for c in names], axis=1) / got["n"][:, None] / PARTS).astype(np.float32)
    return _shaped(before)


def train(docs: DataFrame, labels: DataFrame, seed: int = 3) -> dict | None:
    """``labels``: the rows to learn from, all of them. None if there is only one label."""
    scratch = Scratch(docs.sparkSession, "op3_toxicity")
    rows = _set_aside(scratch, docs, labels, seed)
    count = lambda df: {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}
    every, learned = count(rows), count(rows.where("not held"))
    if len(every) < 2:
        scratch.drop()
        return None
    if min(every.values()) < 20 or len(learned) < 2:  # too few to hold some back
        rows, learned = rows.withColumn("held", F.lit(False)), every
    totals = learned[1], learned[0]

    def seen(blocks):
        hit, miss = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for block in blocks:
            if block.num_rows:
                more = _seen(*_unpacked(block))
                hit, miss = hit + more[0], miss + more[1]
        at = np.flatnonzero(hit + miss)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(hit[at].astype(np.int64)), pa.array(miss[at].astype(np.int64))], names=["at", "hit", "miss"])

    held_in = rows.where("not held").select("words", "prefixes", "label").mapInArrow(seen, "at long, hit long, miss long")
    got = _numbers(held_in.groupBy("at").agg(F.sum("hit").alias("hit"), F.sum("miss").alias("miss")), scratch, "seen")
    hit, miss = (np.bincount(got["at"], got[c], BUCKETS) for c in ("hit", "miss"))
    m = _start(hit, miss, *totals, np.random.default_rng(seed))
    for turn in range(ROUNDS):
        m = _round(rows, scratch, m, turn, totals, seed)
    model = _finished(m)
    on = rows.where("held") if learned is not every else rows
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def margin(blocks):
        ready = shared.value | {"table": shared.value["table"].astype(np.float32)}
        for block in blocks:
            if block.num_rows:
                a, b, bounds, _ = _unpacked(block)
                z = np.concatenate([_maxima(ready, *_picked(a, b, bounds, np.arange(i, min(i + 64, block.num_rows))))[0] for i in range(0, block.num_rows, 64)]) @ ready["out"] + ready["offset"]
                yield pa.RecordBatch.from_arrays([block.column("lang"), pa.array(np.rint(z.astype(float) * STEPS).astype(np.int64)), block.column("label")], names=["lang", "z", "label"])

    found = scratch.save(on.select("lang", "words", "prefixes", "label").mapInArrow(margin, "lang string, z long, label long").groupBy("lang", "z", "label").agg(F.count("*").alias("n")), "margins")
    of = lambda g: (np.array([r["z"] for r in g]) / STEPS, np.array([r["label"] for r in g]), np.array([float(r["n"]) for r in g]))
    whole = found.groupBy("z", "label").agg(F.sum("n").alias("n")).orderBy("z", "label").collect()
    n_of = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    enough = found.groupBy("lang").agg(n_of(1).alias("hit"), n_of(0).alias("miss")).where((F.col("hit") >= ENOUGH) & (F.col("miss") >= ENOUGH)).select("lang")
    own: dict[str, list] = {}
    for r in found.join(enough, "lang").orderBy("lang", "z", "label").collect():  # a row for each step of a language's margins
        own.setdefault(r["lang"], []).append(r)
    shared.destroy()
    scratch.drop()
    return _calibrated(model, *of(whole), {name: of(g) for name, g in own.items()})


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score, predicted (score >= CUT) and flagged (score >= the language's threshold) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ready: dict = {}

    def columns(block: pa.RecordBatch) -> dict:
        m = shared.value
        if m is None:
            value = np.zeros(block.num_rows)
        else:
            if "table" not in ready:
                ready["table"] = m["table"].astype(np.float32)
            value = sigmoid(m["slope"] * _margin(block.column("text"), m | ready) + m["shift"])
        cuts = np.array([(m or {"cuts": {}})["cuts"].get(x, CUT) for x in block.column("lang").to_pylist()])
        return {"doc_id": block.column("doc_id"), "score": value, "predicted": (value >= CUT).astype(np.int32), "flagged": (value >= cuts)}

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang"))
    return arrow_map(rows, columns, "doc_id long, score double, predicted int, flagged boolean", rows=4096)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score(docs, train(docs.where(in_sample(F.col("doc_id"))), labels.where(in_sample(F.col("doc_id")))))
    return found.select("doc_id", (~in_sample(F.col("doc_id"))).alias("held_out"), "score", "predicted", "flagged")


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE: dict[str, str] = {}
