"""op1, op4, op8, op9: round trips, invariants and edge cases."""

import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from support import SF, same_rows

from finlake.llm import kernels
from finlake.llm import op1_chat as op1
from finlake.llm import op4_training_order as op4
from finlake.llm import op8_mixing as op8
from finlake.llm import op9_packing as op9
from finlake.llm.scratch import Scratch
from finlake.llm.tokens import WordEncoder

PATH = op9.public_tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(PATH)


def ids_of(encoder, text) -> np.ndarray:
    return np.array(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


# --- op1

TURNS = "conv_id long, turn long, role string, text string, window int, formatted string, cost int, block long"


def chat(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", 2, 3) for r in rows], TURNS)


def test_op1_agrees_with_sql(spark, duck):
    same_rows(op1.op1_chat(spark, SF).toPandas(), duck.execute(op1.ORACLE["op1_chat"]).df())


def test_op1_round_trip_of_control_strings(spark):
    nasty = ["\\", "\\\\", "\\s", "\\l", "\\h###", "####", "<", "</turn>\n", "### user: x</turn>\n### assistant: y", "a: b", "", None, "\n", "é👍", "\\### Assistant: </turn> ok"]
    rows = [(1, i, role, t) for i, t in enumerate(nasty) for role in ["assistant" if i % 2 else "us:er</turn>"]] + [(2, None, None, None), (2, None, "assistant", "x"), (None, 1, "user", "no id"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    got = op1.read_back(op1.format_chats(chat(spark, rows))).orderBy("conv_id", "window").collect()
    back = {c: [(t["role"], t["text"]) for r in got if r["conv_id"] == c for t in r["turns"]] for c in (1, 2, 3)}
    assert back[1] == [(r or "", t or "") for c, _, r, t in rows if c == 1]
    assert back[2] == [("", ""), ("assistant", "x")] and back[3] == [("assistant", "same")] * 2
    targets = [x for r in got if r["conv_id"] == 1 for x in r["targets"]]
    assert targets == [t or "" for _, i, r, t in rows[: len(nasty)] if r == "assistant"]
    assert op1.format_chats(chat(spark, rows).limit(0)).isEmpty()


def test_op1_windows(spark):
    rows = [(1, 0, "system", "be kind " * 20)] + [(1, i, "assistant" if i % 2 == 0 else "user", f"t{i} " + "word " * 150) for i in range(1, 900)]
    windows = op1.format_chats(chat(spark, rows)).orderBy("window").collect()
    assert len(windows) > 100
    for n, w in enumerate(windows):
        marks = w["formatted"].split(op1.TAIL)[:-1]
        assert marks[0].startswith("### system: ") and w["repeated"] >= (n > 0)
        assert len(w["formatted"]) / 4 <= op1.BUDGET * 1.1
        if n:
            history = marks[1 : w["repeated"]]
            assert history == windows[n - 1]["formatted"].split(op1.TAIL)[:-1][-len(history) :] and 1 <= len(history) <= 2
    targets = [x for r in sorted(op1.read_back(op1.format_chats(chat(spark, rows))).collect(), key=lambda r: r["window"]) for x in r["targets"]]
    assert targets == [t for _, _, r, t in rows if r == "assistant"]


def test_op1_no_window_is_over_budget(spark):
    say = lambda tokens: "w" * (4 * (tokens - op1.TURN_TOKENS))
    costs = {
        1: [100] + [1000, 900] * 5,  # windows of the plain stride would hold 2380 and more
        2: [5000] + [300] * 20,  # a system turn above the budget
        3: [1500] + [300, 40, 20] * 8,  # one that leaves little room
        4: [100, 200, 3000, 200, 200],  # a turn above the budget
        5: [200, 1900, 30, 10],  # a turn that does not fit beside the system turn
        6: [700] + [30] * 30 + [1000] * 3,
    }
    rows = [(c, i, "assistant" if i % 2 else "user" if i else "system", say(n)) for c, all_costs in costs.items() for i, n in enumerate(all_costs)]
    rows += [(7, i, "r" * 3000, "x") for i in range(9)]  # heads cost too
    found = op1.format_chats(chat(spark, rows)).orderBy("conv_id", "window").collect()
    back = op1.read_back(op1.format_chats(chat(spark, rows))).orderBy("conv_id", "window").collect()
    assert [(t["role"], t["text"]) for r in back for t in r["turns"]] == [(role, text) for _, _, role, text in rows]
    assert [x for r in back for x in r["targets"]] == [text for _, _, role, text in rows if role == "assistant"]
    for w, b in zip(found, back):
        assert b["turns"] and w["over"] == (w["tokens"] > op1.BUDGET) and len(w["formatted"]) / 4 <= w["tokens"]
        assert not w["over"] or (w["repeated"] == 0 and len(b["turns"]) == 1)
        system = costs.get(w["conv_id"], [op1.BUDGET])[0]
        own = w["tokens"] if not w["repeated"] else sum(len(t["text"]) // 4 + op1.TURN_TOKENS for t in b["turns"])
        assert (w["formatted"].startswith("### system: ")) == (w["window"] == 0 or system + own <= op1.BUDGET) or w["conv_id"] == 7
    assert [(w["conv_id"], w["tokens"]) for w in found if w["over"]] == [(2, 5000), (4, 3000)]
    assert [(w["window"], w["tokens"], w["repeated"]) for w in found if w["conv_id"] == 5] == [(0, 200, 0), (200, 1900, 0), (2100, 240, 1)]


def test_op1_uses_no_python(spark):
    plan = op1.op1_chat(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# --- tokens


def test_tokens_equal_those_of_whole_texts(encoder):
    texts = ["", "It's Dogs' 'TIS 'll don't", "a.b,c!d?1e22", "Ünïcödé é a≠b ẖ H̱", "x<|endoftext|>y <|ENDOFTEXT|>", "tab\tnew\nline\x0b\x0c", "1234 12a 3é 4́", "“quotes”… – dash", "漢字 kana かな", " nbsp　wide", "'s's 's", "KK İ ß ẞ"]
    rng = np.random.default_rng(3)
    letters = list("aB'sT.1 <|>é") + ["́", " ", "’"]
    texts += ["".join(rng.choice(letters, 30)) for _ in range(500)]
    ids, bounds = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_tokens_of_words_with_one_polynomial_hash(encoder):
    tm = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    texts = [tm, tm.translate(str.maketrans("ab", "ba")), f"{tm} {tm.translate(str.maketrans('ab', 'ba'))}"]
    ids, bounds = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_tokens_with_one_hash_are_told_apart(encoder, monkeypatch):
    monkeypatch.setattr(kernels, "span_hashes", lambda data, start, end: (end - start).astype(np.uint64))
    texts = ["some words and more text", "text more and words some", "abc def ghi abc"]
    ids, bounds = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_long_texts_are_encoded_in_slices(encoder, monkeypatch):
    rng = np.random.default_rng(4)
    text = " ".join(rng.choice(["wörd", "Don't", "x,y", "12a", "<", "\n", "plain"], 3000))
    monkeypatch.setattr(kernels.slices, "__defaults__", (500,))
    ids, bounds = encoder.encode(pa.array([text, "", text]))
    whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == whole * 2 and bounds.tolist() == [0, len(whole), len(whole), 2 * len(whole)]


# --- op9


def check_pieces(pieces: pd.DataFrame, docs: dict[int, list], encoder) -> None:
    for doc, rows in pieces.sort_values(["doc_id", "start", "sequence_id", "offset"]).groupby("doc_id"):
        ids = ids_of(encoder, docs[doc][0])
        assert (rows.doc_tokens == len(ids)).all()
        cover = np.zeros(len(ids), int)
        for r in rows.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
            cover[r.start : r.start + r.length] += 1
        assert (cover == len(docs[doc])).all()
    assert set(pieces.doc_id) == set(docs)
    for _, rows in pieces.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert (rows.offset == rows.length.cumsum() - rows.length).all() and rows.length.sum() <= op9.SEQUENCE_TOKENS and len(rows) <= op9.MAX_SEGMENTS


def by_id(df) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in df.select("doc_id", "text").collect():
        if r["doc_id"] is not None:
            out.setdefault(r["doc_id"], []).append(r["text"])
    return out


def test_op9_edges(spark, edge, empty, encoder):
    check_pieces(op9.pack_documents(edge, PATH).toPandas(), by_id(edge), encoder)
    assert op9.pack_documents(empty, PATH).isEmpty()


def test_op9_documents(spark, encoder):
    pieces = op9.op9_packing(spark, SF).toPandas()
    check_pieces(pieces, by_id(spark.read.parquet(f"{SF}/documents.parquet")), encoder)
    size = pieces.groupby("sequence_id").length.sum()
    assert all(n == 2048 or n & (n - 1) == 0 for n in size)  # nothing is padded


@pytest.mark.parametrize("cut, segments, loss", [(False, 8, 900), (True, 5, 700), (True, 200, None)])
def test_op9_limits(cut, segments, loss):
    rng = np.random.default_rng(segments)
    examples = [(i, int(n), int(min(n, rng.integers(0, 700)))) for i, n in enumerate(rng.integers(1, 2048 if not cut else 5000, 700))]
    packer, pieces = op9.Packer(2048, segments, loss, cut), []
    for x in examples:
        pieces += packer.add(*x)
        if len(packer.lot) >= 128:
            pieces += packer.pack(last=False)
    pieces += packer.pack(last=True)
    use: dict[int, list] = {}
    cover = {i: np.zeros(n, int) for i, n, _ in examples}
    for i, start, length, sequence, offset in pieces:
        n, with_loss = examples[i][1:]
        u = use.setdefault(sequence, [0, 0, 0])
        assert offset == u[0] and (cut or length == n)
        cover[i][start : start + length] += 1
        u[0] += length
        u[1] += 1
        u[2] += max(0, start + length - max(start, n - with_loss))
    assert all((c == 1).all() for c in cover.values())
    assert all(a <= 2048 and b <= segments and c <= (loss or 2048) for a, b, c in use.values())
    if not cut:
        least = max(sum(n for _, n, _ in examples) / 2048, len(examples) / segments, sum(x for *_, x in examples) / loss)
        assert len(use) <= 1.12 * least + 2


def test_op9_examples(spark):
    df = spark.createDataFrame([(1, 500, 100, "e"), (2, 1500, None, "e"), (3, 0, 0, "e"), (None, 5, 1, "e"), (4, 2048, 2048, "e")], "id long, n_tokens long, n_loss long, offset string").coalesce(1)
    got = op9.pack_examples(df).toPandas()
    assert sorted(got.id) == [1, 2, 4] and got.groupby("sequence_id").length.sum().max() <= 2048
    with pytest.raises(ValueError):
        list(op9.Packer(10, cut=False).add(1, 11, 0))


# --- op4


def test_op4_permutation():
    for n in (1, 2, 5, 64, 1000, 4097):
        slots = op4.feistel(np.arange(n), n, 7)
        assert sorted(slots.tolist()) == list(range(n))
    a, b = op4.feistel(np.arange(5000), 5000, 1), op4.feistel(np.arange(5000), 5000, 2)
    assert (a != b).mean() > 0.99 and abs(np.corrcoef(a, np.arange(5000))[0, 1]) < 0.1


def test_op8_targets_of_many_sources_are_not_one_task(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'two words' as text", "concat('s', id) as source")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "4k"}
    before = {k: spark.conf.get(k) for k in conf}
    scratch = Scratch(spark, "t")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        op8.mix(docs, scratch)
        held = spark.read.parquet(f"{scratch.path}/targets").groupBy(F.input_file_name()).count().toPandas()["count"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert held.sum() == 3000 and len(held) > 1


@pytest.mark.parametrize("source", ["edge", "documents"])
def test_op4_round_trip(spark, source, edge, encoder, tmp_path, monkeypatch):
    monkeypatch.setattr(op4, "SHARD", 16)  # several shards
    docs = edge if source == "edge" else spark.read.parquet(f"{SF}/documents.parquet")
    root = f"file://{tmp_path}/shards"
    index = op4.materialise(docs, PATH, Scratch(spark, "t"), root).orderBy("slot").toPandas()
    assert index.slot.tolist() == list(range(len(index))) and sorted(index.sequence) == list(range(len(index)))
    assert (index.byte_offset == index.slot % 16 * op4.STRIDE).all()
    texts = by_id(docs)
    encoded = {i: ids_of(encoder, t[0]) for i, t in texts.items()}
    cover = {i: np.zeros(len(ids), int) for i, ids in encoded.items()}
    stored = list(op4.read_from(root, 0, len(index)))
    for ids, r in zip(stored, index.itertuples(), strict=True):
        whole = np.concatenate([encoded[p["doc_id"]][p["start"] : p["start"] + p["length"]] for p in r.pieces])
        assert ids.tolist() == whole.tolist() and len(ids) == r.n_tokens
        for p in r.pieces:
            cover[p["doc_id"]][p["start"] : p["start"] + p["length"]] += 1
    assert all((c == len(texts[i])).all() for i, c in cover.items())
    later = list(op4.read_from(root, len(index) // 2, len(index)))  # a reader that resumes
    assert [x.tolist() for x in later] == [x.tolist() for x in stored[len(index) // 2 :]]


def test_op4_shards_do_not_depend_on_partitions(spark, edge, tmp_path, monkeypatch):
    for name, value in (("SHARD", 8), ("BLOCK_ROWS", 5), ("MOST_TASKS", 2)):  # several blocks, several shards to a task
        monkeypatch.setattr(op4, name, value)
    made = []
    for n in (1, 5):
        index = op4.materialise(edge.repartition(n), PATH, Scratch(spark, "t"), f"file://{tmp_path}/{n}")
        made.append((sorted((r["slot"], r["ids_crc32"], r["byte_offset"]) for r in index.collect()), {p.name: p.read_bytes() for p in (tmp_path / str(n)).glob("*.bin")}))
    assert made[0] == made[1] and len(made[0][1]) > 5
    assert {r["path"] for r in index.collect()} == {f"file://{tmp_path}/5/{name}" for name in made[0][1]}


def test_op4_copies_of_a_row_are_dealt_out(spark, tmp_path, monkeypatch):
    for name, value in (("SHARD", 8), ("BLOCK_ROWS", 10)):
        monkeypatch.setattr(op4, name, value)
    rows = [(7, "the same row")] * 200 + [(7, "another of this id"), (7, None)] + [(i, f"text {i}") for i in range(100, 200)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = op4._dealt(docs.where("doc_id is not null"), 30, 10)
    assert Counter(map(tuple, dealt.collect())) == Counter(r for r in rows if r[0] is not None)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 80  # 200 and more in one block otherwise
    made = []
    for n in (1, 6):
        index = op4.materialise(docs.repartition(n), PATH, Scratch(spark, "t"), f"file://{tmp_path}/{n}")
        made.append({p.name: p.read_bytes() for p in (tmp_path / str(n)).glob("*.bin")})
    pieces = Counter(p["doc_id"] for r in index.collect() for p in r["pieces"] if p["start"] == 0)
    assert made[0] == made[1] and pieces == Counter(r[0] for r in rows if r[0] is not None)


def test_op4_empty_table(spark, empty, tmp_path):
    assert op4.materialise(empty, PATH, Scratch(spark, "t"), f"file://{tmp_path}/s").isEmpty()


def test_op4_sees_damage(spark, edge, tmp_path):
    root = f"file://{tmp_path}/shards"
    n = op4.materialise(edge, PATH, Scratch(spark, "t"), root).count()
    path = tmp_path / "shards" / "shard-00000000.bin"
    data = bytearray(path.read_bytes())
    data[20] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(OSError):
        list(op4.read_from(root, 0, n))


# --- op8


def shares(sizes: dict) -> dict:
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    out, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        full = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


@pytest.mark.parametrize("source", ["edge", "documents"])
def test_op8_targets_are_met(spark, source, edge):
    docs = edge.dropDuplicates(["doc_id"]).where("doc_id is not null") if source == "edge" else spark.read.parquet(f"{SF}/documents.parquet")
    got = op8.mix(docs, Scratch(spark, "t")).toPandas()
    raw = docs.select("doc_id", "source", F.coalesce(F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")), F.lit(0)).alias("n")).toPandas()
    raw["n"] = raw.n.clip(lower=0)
    raw["source"] = raw.source.astype(object).where(raw.source.notna(), None)
    sizes = {s: int(raw[raw.source.isna() if s is None else raw.source == s].n.sum()) for s in set(raw.source)}
    expected = shares(sizes)
    assert got.set_index("doc_id")["size"].to_dict() == raw.set_index("doc_id").n.to_dict()
    for s in sizes:
        mine = got[got.source.isna() if s is None else got.source == s]
        assert (mine.source_size == sizes[s]).all() and np.allclose(mine.target, expected[s])
        longest = mine["size"].max()
        assert abs(mine.taken.sum() - expected[s]) <= (0.005 * expected[s] + 1 if source == "documents" else longest)
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    again = op8.mix(docs.repartition(3), Scratch(spark, "t")).toPandas()
    assert got.set_index("doc_id").taken.to_dict() == again.set_index("doc_id").taken.to_dict()


def test_op8_fit_is_the_nearest_of_tiny_sources():
    rng = np.random.default_rng(9)
    for _ in range(300):
        lengths = sorted(set(rng.integers(1, 400, rng.integers(1, 5)).tolist()))
        counts = rng.integers(1, 3, len(lengths)).tolist()
        target = float(rng.random() * 2 * sum(a * b for a, b in zip(lengths, counts)))
        taken = op8.fit(lengths, [2 * c for c in counts], target, above=True)
        reach = {0}
        for a, b in zip(lengths, counts):
            reach = {x + a * k for x in reach for k in range(2 * b + 1)}
        assert all(0 <= t <= 2 * c for t, c in zip(taken, counts))
        assert abs(target - sum(a * b for a, b in zip(lengths, taken))) <= min(abs(target - x) for x in reach) + 1e-6


def test_op8_a_long_text_takes_little_memory():
    tracemalloc.start()
    lengths, counts = [*range(1, 4001), 2_000_000], [5] * 4000 + [1]
    target = 1.3 * sum(a * b for a, b in zip(lengths, counts))
    taken = op8.fit(lengths, [2 * c for c in counts], target, above=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(target - sum(a * b for a, b in zip(lengths, taken))) <= 1 and peak < 60_000_000


def test_op8_fit_is_exact_where_it_can_be():
    rng = np.random.default_rng(8)
    for _ in range(60):
        lengths = sorted(set(rng.integers(0, 60, 8).tolist()))
        counts = rng.integers(1, 6, len(lengths)).tolist()
        total = sum(a * b for a, b in zip(lengths, counts))
        budget = int(rng.integers(0, total + 1))
        taken = op8.fit(lengths, counts, budget)
        got = sum(a * b for a, b in zip(lengths, taken))
        assert all(0 <= t <= c for t, c in zip(taken, counts)) and got <= budget
        reach = {0}
        for a, b in zip(lengths, counts):
            reach = {x + a * k for x in reach for k in range(b + 1)}
        assert budget - got <= budget - max(x for x in reach if x <= budget), (lengths, counts, budget)


def test_op8_empty_and_wordless(spark, empty):
    assert op8.mix(empty, Scratch(spark, "t")).isEmpty()
    none = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [(r["size"], r["taken"], r["target"]) for r in op8.mix(none, Scratch(spark, "t")).collect()] == [(0, 0, 0.0)] * 2
    assert op8.mixed(none).isEmpty()


def test_op8_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a b c", "s")] * 3 + [(2, "d e", "s"), (2, "f g", "s"), (3, "h i j k", "s"), (4, "l", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as time", "2 as times", "3 as rows", "4 as row", "5 as doc", "6 as __times").repartition(3)
    taken = sum(r["taken"] for r in op8.mix(docs, Scratch(spark, "t")).collect())
    got = op8.mixed(docs)
    assert got.columns == docs.columns
    found = Counter((r["doc_id"], r["text"], r["source"]) for r in got.collect())
    assert sum(len(t.split()) * n for (_, t, _), n in found.items()) == taken and taken > 0
    have = Counter(rows)
    assert all(n <= 2 * have[r] for r, n in found.items())


def test_op8_mixed_repeats_rows(spark, edge):
    docs = edge.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = op8.mixed(docs)
    taken = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in op8.mix(docs, Scratch(spark, "t")).collect()}
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == {i: n for i, n in taken.items() if n}
