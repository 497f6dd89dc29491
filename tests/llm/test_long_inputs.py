"""Long texts and broken shards: what samples, slices, packing and readers do with them."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from test_sequences import PATH

import corpus_pipeline
from finlake.llm import op4_training_order as op4
from finlake.llm import op6_quality as op6
from finlake.llm import op7_language as op7
from finlake.llm import op9_packing as op9
from finlake.llm import registry, sampling
from finlake.llm.features import char_counts, code_points
from finlake.llm.kernels import text_bytes
from finlake.llm.scratch import Scratch

WORDS = {"en": "the house and a river with some very old trees near it".split(), "fi": "talo ja joki jossa on hyvin vanhoja puita äiti tyttö yö".split()}


def text(lang: str, n: int, seed: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS[lang], n))


@pytest.fixture(scope="module")
def two_languages(spark):
    """60 short English texts, 60 Finnish ones above 20 kB."""
    rows = [(i, text("en", 40, i), "en") for i in range(60)] + [(100 + i, text("fi", 4000, i), "fi") for i in range(60)]
    assert min(len(t.encode()) for i, t, _ in rows if i >= 100) > 20_000
    return spark.createDataFrame([(*r, "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_a_language_of_long_texts_only_is_learned_and_kept(spark, two_languages):
    assert {r["lang_pred"] for r in op7.predict(two_languages, op7.train(two_languages)).where("doc_id >= 100").collect()} == {"fi"}
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, two_languages, "").select("doc_id").collect()}
    assert len(kept) >= 110 and len([i for i in kept if i >= 100]) >= 55


def test_samples_stay_within_their_bytes(two_languages, monkeypatch):
    monkeypatch.setattr(sampling, "TEXT_BYTES", 200)
    found = sampling.texts_by(two_languages, "lang", 1000, 3)  # 200 000 bytes a label
    size = found.text.str.encode("utf-8").str.len().groupby(found.label).agg(["sum", "count"])
    assert size.loc["en", "count"] == 60 and 1 <= size.loc["fi", "count"] < 10 and size["sum"].max() <= 200_000
    monkeypatch.setattr(sampling, "TEXT_BYTES", 1)
    assert set(sampling.texts_by(two_languages, "lang", 1000, 3).label) == {"en", "fi"}  # one row at least


def test_labelled_samples_take_long_texts(spark, two_languages):
    labels = two_languages.selectExpr("doc_id", "int(lang = 'fi') as quality").union(spark.createDataFrame([(5, 1), (5, 0), (None, 1), (7777, 1)], "doc_id long, quality int"))
    found = sampling.labelled_texts(two_languages, labels, "quality", 50, 3, columns=("lang",))
    assert found.doc_id.is_unique and set(found.label) == {0, 1} and (found.label == (found.lang == "fi")).all() and (found.label == 1).sum() > 25


def test_repeated_ids_give_the_same_sample(spark):
    rows = [(i % 50, f"text {i} " * (i % 7 + 1), f"l{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = (sampling.texts_by(df.repartition(n), "lang", 100, 5) for n in (1, 7))
    pd.testing.assert_frame_equal(a, b)
    assert a.doc_id.is_unique


def test_character_ngrams_run_across_slices():
    long = "ä漢x yz " * 400_000  # above 3 MB
    data, bounds = text_bytes(pd.array([long], dtype="string").__arrow_array__())
    sliced = op6._char_counts(data, bounds)
    plain = char_counts(*code_points(data, bounds), op6.ORDERS, op6.CHAR_BUCKETS)
    assert sliced.sum() == plain.sum() == 3 * len(long) - 3 and np.array_equal(sliced, plain)


def test_packing_holds_only_what_waits():
    packer, held, most = op9.Packer(), op9.Waiting(), 0
    ids = np.arange(200_001, dtype="<u4")
    for key in range(511):
        held.add(key, key, ids)
        pieces = list(packer.add(key, len(ids), len(ids)))
        assert all(held.row(*p)[3] == op9.zlib.crc32(ids[p[1] : p[1] + p[2]]) for p in pieces[-1:])
        held.keep(packer.lot)
        most = max(most, held.nbytes)
    assert most < 50e6
    last = [held.row(*p) for p in packer.pack(last=True)]
    assert sum(r[2] for r in last) == 511 * (200_001 % 2048) and all(r[3] == op9.zlib.crc32(ids[r[1] : r[1] + r[2]]) for r in last)


def test_readers_end_at_cut_and_missing_shards(spark, edge, tmp_path, monkeypatch):
    monkeypatch.setattr(op4, "SHARD", 4)
    root = f"file://{tmp_path}/shards"
    n = op4.materialise(edge, PATH, Scratch(spark, "t"), root).count()
    second = tmp_path / "shards" / "shard-00000001.bin"
    whole = second.read_bytes()
    for size in (0, op4.STRIDE + 5, len(whole) - 1):
        second.write_bytes(whole[:size])
        with pytest.raises(OSError):
            list(op4.read_from(root, 0, n))
    second.unlink()
    with pytest.raises(OSError):
        list(op4.read_from(root, 0, n))


def test_shards_written_again_are_the_same(spark, edge, tmp_path, monkeypatch):
    """As by a task that is lost after it renamed its shard, and one that failed before."""
    monkeypatch.setattr(op4, "SHARD", 4)
    root = f"file://{tmp_path}/shards"
    op4.materialise(edge, PATH, Scratch(spark, "t"), root).count()
    before = {p.name: p.read_bytes() for p in (tmp_path / "shards").glob("*.bin")}
    (tmp_path / "shards" / "shard-00000000.bin.77").write_bytes(b"left behind")
    op4.materialise(edge, PATH, Scratch(spark, "t"), root).count()
    assert {p.name: p.read_bytes() for p in (tmp_path / "shards").iterdir() if not p.name.startswith(".")} == before


def test_copies_of_a_very_long_text(spark, tmp_path):
    """Whole queries on a text of 6 MB, its copy and a near copy with another end."""
    vocabulary = np.array([f"w{i:x}" for i in range(50_000)])
    long = " ".join(vocabulary[np.random.default_rng(1).integers(0, 50_000, 1_050_000)])
    near, end = long[:-200], " changed end of it"
    rows = [(1, long), (2, long), (3, near + end), (4, "a short text of some six words")]
    assert long.isascii() and len(long) > 6_000_000
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {name: {r["doc_id"]: r for r in registry.QUERIES[name](spark, str(tmp_path)).collect()} for name in ("op2_suffix_dedup", "op5_minhash", "op10_exact_dedup")}
    removed = {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in found["op2_suffix_dedup"].items()}
    digest = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}
    assert removed == {
        1: (len(long), 0, 0, digest[1]), 2: (len(long), len(long), 1, hashlib.sha256(b"").hexdigest()),
        3: (len(near + end), len(near), 1, hashlib.sha256(end.encode()).hexdigest()), 4: (len(rows[3][1]), 0, 0, digest[4]),
    }
    words = {i: t.split() for i, t in rows}
    assert {i: r["n_shingles"] for i, r in found["op5_minhash"].items()} == {i: len(set(zip(*(w[k:] for k in range(5))))) for i, w in words.items()}
    assert {i: r["component_id"] for i, r in found["op5_minhash"].items()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {i: (r["keep_id"], r["group_size"], r["text_sha256"]) for i, r in found["op10_exact_dedup"].items()} == {1: (2, 2, digest[1]), 2: (2, 2, digest[2]), 3: (3, 1, digest[3]), 4: (4, 1, digest[4])}
