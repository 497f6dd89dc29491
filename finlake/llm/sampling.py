"""Bounded samples of labelled rows, for models that are fitted on the driver.

A label has about ``per_class`` rows, drawn by a seeded hash of the id from all its
rows with a text, whatever their length, and TEXT_BYTES bytes of text for each of
these rows: where texts are long, it has fewer rows. Drawn rows are taken in the
order of their hashes; one that no longer fits into the label's bytes is passed
over, but a label whose drawn rows are all too long keeps its shortest. So no label
and no kind of text is left out for its length. Of several texts or labels of one
id the smallest is taken (by bytes and hash; by value), so runs agree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: Bytes of text that a row of the sample has on average at most, and all of a sample together.
TEXT_BYTES, SAMPLE_BYTES = 20_000, 400_000_000
#: Rows that a sample has about, of all labels together; with many labels each gets an equal part, LEAST_ROWS at least.
SAMPLE_ROWS, LEAST_ROWS = 20_000, 20
#: Labels or rows that are broadcast; with more of them, both sides are merged.
MOST_BROADCAST = 100_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def _draw(rows: DataFrame, per_class: int, seed: int) -> tuple[DataFrame, int, int]:
    """About ``per_class`` rows of each ``label``; the rows and bytes that a label has at most. One count per label comes to the driver, where the model has room for each label."""
    counts = [(r["label"], r["n"]) for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()]
    per = min(per_class, max(LEAST_ROWS, SAMPLE_ROWS // max(1, len(counts))))
    shares = rows.sparkSession.createDataFrame([(k, per / n) for k, n in counts], StructType([StructField("label", rows.schema["label"].dataType), StructField("__share", DoubleType())]))
    drawn = rows.join(_small(shares, len(counts)), "label").where(_place(seed) < F.col("__share")).select(*rows.columns)
    return drawn, per, min(per * TEXT_BYTES, SAMPLE_BYTES // max(1, len(counts)))


def _place(seed: int):
    """A number from 0 to 1 by the id."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1_000_003)) / 1_000_003.0


def _fitting(drawn: pd.DataFrame, most: int) -> pd.DataFrame:
    """Rows of each label within ``most`` bytes, in order of ``place``; one at least."""
    kept = []
    for _, own in drawn.sort_values(["place", "doc_id"]).groupby("label", sort=True):
        held = 0
        for i, size in zip(own.index, own["bytes"]):
            if held + size <= most:
                held += size
                kept.append(i)
        if not held:
            kept.append(own["bytes"].idxmin())
    return drawn.loc[sorted(set(kept))]


def _texts(drawn: DataFrame, docs: DataFrame, most: int, seed: int, columns: tuple[str, ...] = ()) -> pd.DataFrame:
    """doc_id, text, label and ``columns`` of the rows (doc_id, label, bytes, hash) that fit. Sizes come to the driver first, then the texts that were taken."""
    found = drawn.select("doc_id", "label", "bytes", "hash", _place(seed).alias("place")).distinct().toPandas()
    found = found.sort_values(["doc_id", "bytes", "hash", "label"]).drop_duplicates("doc_id")
    taken = _fitting(found, most)
    schema = StructType([StructField(c, LongType()) for c in ("doc_id", "__hash")])
    wanted = docs.sparkSession.createDataFrame(list(zip(taken["doc_id"].tolist(), taken["hash"].tolist())), schema)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("__hash"), *columns)
    out = texts.join(_small(wanted, len(taken)), ["doc_id", "__hash"]).drop("__hash").toPandas()
    out = out.sort_values(["doc_id", *columns], ignore_index=True).drop_duplicates("doc_id", ignore_index=True)
    return out.merge(taken[["doc_id", "label"]], on="doc_id")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int, columns: tuple[str, ...] = ()) -> pd.DataFrame:
    """doc_id, text, label: texts of a bounded sample of the labelled rows. ``labels`` has doc_id and ``label``."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("label"))
    drawn, per, most = _draw(rows, per_class, seed)
    sizes = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("hash"))
    # The drawn rows are about ``per`` of each label, which the driver has room for.
    return _texts(sizes.join(_small(drawn, SAMPLE_ROWS if per > LEAST_ROWS else MOST_BROADCAST + 1), "doc_id"), docs, most, seed, columns)


def texts_by(docs: DataFrame, label: str, per_class: int, seed: int) -> pd.DataFrame:
    """The same where the label is a column of ``docs``."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col(label).isNotNull())
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("hash"))
    drawn, _, most = _draw(rows, per_class, seed)
    return _texts(drawn, docs, most, seed)
