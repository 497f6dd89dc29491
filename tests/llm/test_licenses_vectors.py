import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from support import SF, same_rows

from finlake.llm import op11_licenses, op12_whitening, op13_vector_codes
from finlake.llm.op11_licenses import ANCHORS, BASE, MENTION, POSTINGS, TEMPLATES, VOCABULARY, licenses
from finlake.llm.op12_whitening import identity_error, primes, remaindered, whiten
from finlake.llm.op13_vector_codes import compress, digest


@pytest.mark.parametrize("module", [op11_licenses, op13_vector_codes])
def test_agrees_with_sql(module, spark, duck):
    (name, query), = module.QUERIES.items()
    same_rows(query(spark, SF).toPandas(), duck.execute(module.ORACLE[name]).df())


# --- licences -------------------------------------------------------------------------------------------------------


def plain_licenses(texts):
    """The method on lists of words, file by file."""
    lower = str.maketrans(op11_licenses.UPPER, op11_licenses.LOWER)
    files = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower)) for t in texts]
    counts = Counter(w for f in files for w in set(f) & set(VOCABULARY))
    order = sorted(VOCABULARY, key=lambda w: (counts[w], w))
    out = []
    for words in files:
        places, labels, base, score = set(), set(), set(), 0.0
        for number, (label, phrase, _) in enumerate(TEMPLATES):
            template = phrase.split()
            anchors = [w for w in order if w in template and w in words][:ANCHORS]
            votes = {}
            for at, w in enumerate(words):
                for q, v in enumerate(template):
                    if v == w and w in anchors:
                        votes.setdefault(at - q, set()).add(w)
            for start, who in votes.items():
                here = [0 <= start + q < len(words) and words[start + q] == w for q, w in enumerate(template)]
                if start >= 0 and 2 * len(who) >= len(anchors) and all(h for h, p in zip(here, [p for p in POSTINGS if p[0] == number]) if p[3]):
                    labels.add(label)
                    share = sum(here) / len(here)
                    score = max(score, share * MENTION if number < len(BASE) else share)
                    if number < len(BASE):
                        places.add((number, start))
                        base.add(label)
        at = [s for _, s in places]
        out.append((len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
    return out


LICENCE_TEXTS = [
    None, "", " \n", "mit license", "MIT\n\n---License. mit license mit license", "The Apache  License, Version 2.0", "general public license general public license",
    "GNU General Public License", "unmit license", "mit licenses", "mit-licensé mit éé license", "Licensed under CC BY-NC 4.0.", "licensed under cc by sa 3 0", "worK mit licİense",
    "Permission is hereby granted, free of charge, to any man obtaining a copy of this software", "Redistribution and use in source and binary forms", "mit " * 500 + "license", "0 license",
    "This work is licensed under the GNU General Public License, version 3. Released under the MIT License.", "apache mit license license apache license",
]


@pytest.mark.parametrize("piece", [1 << 16, 7, 13])
def test_licenses_equal_the_plain_method_in_pieces_of_any_size(spark, monkeypatch, piece):
    monkeypatch.setattr(op11_licenses, "PIECE", piece)
    docs = spark.createDataFrame(list(enumerate(LICENCE_TEXTS)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: tuple(r)[1:] for r in licenses(docs).collect()}
    assert [found[i] for i in range(len(LICENCE_TEXTS))] == plain_licenses(LICENCE_TEXTS)


def test_licenses_of_edges(edge, empty, spark):
    found = licenses(edge).toPandas()
    assert len(found) == edge.count() and found["doc_id"].isna().sum() == 1 and (found["doc_id"] == 8).sum() == 2
    words = {r["doc_id"]: r["text"] for r in edge.collect()}
    for _, r in found.dropna(subset="doc_id").iterrows():
        assert r["n_words"] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (words[r["doc_id"]] or "").lower()))
    assert licenses(empty).count() == 0
    clash = edge.withColumnsRenamed({"key": "row", "rep": "hits", "data": "template", "score": "label"})
    assert licenses(clash).count() == edge.count()


def test_licenses_find_all_in_a_long_text(spark):
    """Of 30 million characters, with repeated and rare marks; every place is found."""
    text = ("lorem ipsum dolor " * 50_000 + "MIT License. ") * 30 + "x" * 200_000 + " apache license"
    row = licenses(spark.createDataFrame([(1, text), (2, "mit")], "doc_id long, text string")).where("doc_id = 1").first()
    assert (row["n_words"], row["n_base"], row["base_labels"]) == (30 * 150_002 + 3, 31, "apache,mit")
    assert (row["first_word"], row["last_word"]) == (150_000, 30 * 150_002 + 1)


def test_licenses_are_native(spark):
    rows = licenses(spark.createDataFrame([(1, "mit license")], "doc_id long, text string").cache())
    plan = rows._jdf.queryExecution().toString() + op11_licenses.noted(rows.withColumn("text", rows["labels"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- vectors --------------------------------------------------------------------------------------------------------

BAD = [(900, None), (901, [1.0, None, 2.0, 3.0]), (902, [1.0, float("nan"), 0.0, 0.0]), (903, [float("inf"), 0.0, 0.0, 0.0])]
VECTORS = "vec_id long, embedding array<double>, label int"


def kept_rows(n, d, seed=3, spread=0.3):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, spread, (n, d)).round(5)
    base[n // 2 : n // 2 + n // 3] = base[0]  # a third of all are equal
    return [(i, v.tolist(), None if i % 5 == 0 else i % 3) for i, v in enumerate(base)]


def plain_codes(rows, entries):
    x = {i: [math.floor(1024 * c) for c in v] for i, v, _ in rows}
    width = len(next(iter(x.values()))) // 4
    part = {i: [v[p * width : (p + 1) * width] for p in range(4)] for i, v in x.items()}
    books = [[part[i][p] for i in sorted(x)[:entries]] for p in range(4)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(book))
    for _ in range(4):
        new = []
        for p, book in enumerate(books):
            mine = {}
            for i in x:
                mine.setdefault(near(part[i][p], book)[1], []).append(part[i][p])
            new.append([[sum(c) // len(c) for c in zip(*mine[e])] if e in mine else c for e, c in enumerate(book)])
        books = new
    last = {i: [near(part[i][p], books[p]) for p in range(4)] for i in x}
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {i: ("".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n)) for i, n in last.items()}, sha


@pytest.mark.parametrize("partitions", [1, 5])
def test_codes_equal_plain_python(spark, partitions):
    rows = kept_rows(330, 8)
    df = spark.createDataFrame(rows + [(i, v, 1) for i, v in BAD], VECTORS).repartition(partitions)
    codes, books = compress(df)
    expected, sha = plain_codes(rows, 256)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in codes.collect()} == expected and digest(books) == sha


def test_codes_of_edges(spark):
    assert compress(spark.createDataFrame([], VECTORS))[0].count() == 0
    assert compress(spark.createDataFrame([(i, v, 1) for i, v in BAD], VECTORS))[0].count() == 0
    # Few vectors, repeated rows, no id, short and empty vectors, huge components.
    rows = [(2, [0.5] * 4, 1), (2, [0.5] * 4, 1), (None, [0.25] * 4, None), (3, [0.5], 2), (4, [], 2), (5, [1e300, -1e300, 0.0, 0.0, 0.0], 3)]
    codes, books = compress(spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS code", "'a' AS error", "2 AS x"))
    found = codes.collect()
    assert len(found) == 6 and books.shape == (4, 6, 2) and all(r["error"] == 0 for r in found)
    assert compress(spark.createDataFrame([(1, [], 1)], VECTORS))[0].first()["code"] == "00000000"


def test_residues_give_back_whole_numbers():
    rng = np.random.default_rng(5)
    values = np.array([int(v) * 10**k for v, k in zip(rng.integers(-(10**9), 10**9, 60), range(60))], object)
    moduli = primes(2 * 10**70)
    assert all(p < 1 << 21 for p in moduli) and len(set(moduli)) == len(moduli)
    assert remaindered({p: (values % p).astype(np.int64) for p in moduli}).tolist() == values.tolist()


@pytest.mark.parametrize("partitions", [1, 7])
def test_whitening_equals_exact_arithmetic(spark, partitions):
    rows = kept_rows(2500, 12)
    df = spark.createDataFrame(rows + [(i, v, 1) for i, v in BAD], VECTORS).repartition(partitions)
    found, model = whiten(df)
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v, _ in rows], object)
    n, sums = len(x), x.sum(axis=0)
    assert model.n == n and model.sums.tolist() == sums.tolist()
    term = n * x - sums
    assert {r["vec_id"]: r["deviation"] for r in found.collect()} == {i: int((t * t).sum()) for i, t in enumerate(term)}
    cov = np.array([[float(v) / n**3 for v in row] for row in (term.T @ term).tolist()])
    values, axes = np.linalg.eigh(cov)
    got = np.array([r["whitened"] for r in found.orderBy("vec_id").collect()])
    want = (term.astype(float) / n) @ axes[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    assert np.allclose(model.explained, values[::-1][:8] / np.trace(cov), rtol=1e-9) and identity_error(found, model) < 1e-9


def test_whitening_of_edges(spark):
    assert whiten(spark.createDataFrame([], VECTORS))[0].count() == 0
    # One row, equal rows, short and empty vectors: no variance, or little of it.
    one, model = whiten(spark.createDataFrame([(1, [0.5, 0.25], 1)] * 3, VECTORS))
    assert [r["whitened"] for r in one.collect()] == [[0.0, 0.0]] * 3 and identity_error(one, model) == 0.0
    assert whiten(spark.createDataFrame([(1, [], 1)], VECTORS))[0].first()["whitened"] == []
    mixed, model = whiten(spark.createDataFrame([(1, [0.5], 1), (None, [], 1), (3, [0.1, 0.2, 0.3], 1), (3, [0.1, 0.2, 0.3], 1)], VECTORS).selectExpr("*", "1 AS x", "2 AS deviation"))
    assert mixed.count() == 4 and identity_error(mixed, model) < 1e-9
    # Deviations that 64 bits do not hold are null, others stay exact.
    huge, _ = whiten(spark.createDataFrame([(1, [1e9], 1), (2, [-1e9], 1), (3, [0.0], 1)], VECTORS))
    exact = [(3 * v - sum((x1, x2, x3))) ** 2 for x1, x2, x3 in [(min(1024 * 10**9, 1 << 40) + 100_000, -min(1024 * 10**9, 1 << 40) + 100_000, 100_000)] for v in (x1, x2, x3)]
    assert [r["deviation"] for r in huge.orderBy("vec_id").collect()] == [v if v < 2**63 else None for v in exact]


def test_whitening_query_has_all_rows(spark):
    df = op12_whitening.QUERIES["op12_whitening"](spark, SF).toPandas()
    assert len(df) == 8 * df["n"].iloc[0] and df["identity_error"].max() <= 1e-4 and df.groupby("vec_id")["deviation"].nunique().max() == 1
    assert op12_whitening.QUERIES["op12_whitening"](spark, SF).columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
