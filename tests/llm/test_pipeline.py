"""Each stage against brute force on what the stage before kept, and run() as a whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import SF
from test_dedup import components, groups
from test_sequences import PATH, by_id, check_pieces

import corpus_pipeline as pipeline
from finlake.llm import registry
from finlake.llm.op8_mixing import mix
from finlake.llm.scratch import Scratch
from finlake.llm.tokens import WordEncoder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Documents with planted copies, near copies and texts without letters; the result of every stage."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120").toPandas()
    rng = np.random.default_rng(4)
    extra = []
    for i in range(20, 40):
        text = docs.text[i]
        words = text.split(" ")
        if len(words) > 30:
            words[rng.integers(len(words))] = "planted"
        extra += [(1000 + i, text.upper() if text.isascii() else text), (2000 + i, " ".join(words))]
    extra += [(3000, None), (3001, ""), (3002, "12 34 !!"), (3003, " \n")]
    rows = [(int(r.doc_id), r.text, r.lang, r.source, int(r.n_chars)) for r in docs.itertuples()] + [(i, t, "en", "src1", len(t or "")) for i, t in extra] + [(None, "no id", None, None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, out[-1], str(folder)).write.parquet(f"{folder}/stage{k}")
        out.append(spark.read.parquet(f"{folder}/stage{k}"))
    return str(folder), out


def ids(df) -> list:
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def texts(df) -> dict:
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "exact dedup", "MinHash near-dedup", "mixing", "packing"]
    assert all(df.columns == COLUMNS for df in stages[1][:-1])


def test_language_drops_what_has_no_letters(stages):
    before, after = stages[1][0], stages[1][1]
    assert set(ids(before.where("doc_id is not null"))) - set(ids(after)) == {3000, 3001, 3002, 3003}


def test_exact_copies(stages):
    before, after = stages[1][1], stages[1][2]
    expected = {k for k, _ in groups(texts(before)).values()}
    assert set(ids(after)) == expected and len(expected) < before.count()


def test_near_copies(stages):
    before, after = stages[1][2], stages[1][3]
    expected = {i for i, (_, c) in components(texts(before), 80).items() if i == c}
    assert set(ids(after)) == expected and len(expected) < before.count()


def test_mixing(spark, stages):
    before, after = stages[1][3], stages[1][4]
    times = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mix(before, Scratch(spark, "t")).collect()}
    assert ids(after) == sorted(i for i, n in times.items() for _ in range(n))


def test_packing(stages):
    check_pieces(stages[1][5].toPandas(), by_id(stages[1][4]), WordEncoder(PATH))


def test_run_gives_the_last_stage(spark, stages):
    """Where documents are cut depends on how tasks read them; the pieces are exactly those of what mixing left, all the same."""
    ran = pipeline.run(spark, stages[0])
    check_pieces(ran.toPandas(), by_id(stages[1][4]), WordEncoder(PATH))
    total = lambda df: {r["doc_id"]: r["n"] for r in df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert total(ran) == total(stages[1][5])


@pytest.mark.parametrize("kind", ["edge", "empty"])
def test_run_on_edges(spark, edge, empty, kind, tmp_path):
    """Nulls, copies, repeated rows, a very long text and clashing columns; and a table without rows."""
    docs = edge if kind == "edge" else empty
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = pipeline.run(spark, str(tmp_path)).toPandas()
    if kind == "empty":
        assert not len(pieces)
    else:
        known = {i: len(t[0] or "") for i, t in by_id(edge).items()}
        assert set(pieces.doc_id) <= set(known) and 9 in set(pieces.doc_id) and not {1, 2, 3, 12} & set(pieces.doc_id)
        whole = pieces.groupby("doc_id").length.sum()
        size = pieces.drop_duplicates("doc_id").set_index("doc_id").doc_tokens
        assert (whole % size == 0).all()


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
