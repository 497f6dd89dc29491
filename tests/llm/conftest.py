import pytest

EXTRA = "bucket string, block long, data string, size long, n int, kept boolean, row long, taken long, score double, key string, rep long, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + i * 104729) % 99991}" for i in range(n))


def edge_rows() -> list[tuple]:
    """(doc_id, text): nulls, empty and white texts, copies, near copies, a repeated row, other scripts, a very long text."""
    base = words(1, 200).split()
    near = [*base]
    near[100] = "changed"
    long_text = words(2, 60_000)
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "Tiny text"), (5, "tiny TEXT"), (6, " ".join(base)), (7, " ".join(near)), (8, " ".join(base)), (8, " ".join(base)),
        (9, long_text), (10, long_text + " end"), (11, "Ünïcödé Ångström ß İ 漢字 👍"), (12, "!!! ### $$$ 123"), (13, "a\nb\na\nb\n"), (14, "<|endoftext|> in\x00side"), (None, "no id"), (15, "x " * 3000),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, "b", 1, "d", 2, 3, True, 4, 5, 0.5, "k", 6, None if i == 6 else "en", None if i in (1, 9) else f"s{(i or 0) % 3}", 7) for i, t in edge_rows()]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def empty(edge, spark):
    return spark.createDataFrame([], edge.schema)


@pytest.fixture(autouse=True)
def few_blocks(monkeypatch):
    """Small tables need few blocks."""
    from finlake.llm import op2_suffix_dedup

    monkeypatch.setattr(op2_suffix_dedup, "LEAST_BLOCKS", 4)
