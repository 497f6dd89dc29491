"""Prefix doubling of every position, as it is written in textbooks: the measure of op2_suffix_dedup, for small tables.

Run as a script on a directory of tables it prints what it moves.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD, FIRST = 50, 8


def _reranked(pairs: DataFrame, *key: str) -> DataFrame:
    """doc_id, pos, rank: positions that share their key get its smallest position number as rank; unique ones go."""
    classes = pairs.groupBy(*key).agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return pairs.join(classes, list(key)).select("doc_id", "pos", F.xxhash64("first.doc_id", "first.pos").alias("rank"))


def repeated_positions(docs: DataFrame) -> DataFrame:
    """doc_id, pos of the THRESHOLD-byte strings that also start in a document with a smaller doc_id."""
    data = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data")).where(F.octet_length("data") >= THRESHOLD)
    start = data.select("doc_id", "data", F.explode(F.sequence(F.lit(0), F.octet_length("data") - FIRST)).alias("pos"))
    ranks = _reranked(start.select("doc_id", "pos", F.hex(F.substring("data", F.col("pos") + 1, F.lit(FIRST))).alias("bytes")), "bytes")
    for step in (8, 16, THRESHOLD - 32):  # 8 to 16, 16 to 32, 32 to 50
        ranks = ranks.persist()
        then = ranks.select("doc_id", (F.col("pos") - step).alias("pos"), F.col("rank").alias("after"))
        ranks = _reranked(ranks.join(then, ["doc_id", "pos"]), "rank", "after")
    least = ranks.groupBy("rank").agg(F.min("doc_id").alias("least"))
    return ranks.join(least, "rank").where("doc_id > least").select("doc_id", "pos")


def bytes_removed(docs: DataFrame) -> dict[int, int]:
    found: dict[int, list[int]] = {}
    for r in repeated_positions(docs).collect():
        found.setdefault(r["doc_id"], []).append(r["pos"])
    return {i: len({b for p in at for b in range(p, p + THRESHOLD)}) for i, at in found.items()}


if __name__ == "__main__":
    import json
    import sys
    import tempfile
    from pathlib import Path

    from pyspark.sql import SparkSession

    logs = tempfile.mkdtemp()
    conf = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{logs}", "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"}
    spark = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    docs = spark.read.parquet(f"{sys.argv[1]}/documents.parquet")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    rows = repeated_positions(docs).count()
    spark.stop()
    moved = seconds = 0
    for line in next(Path(logs).iterdir()).read_text().splitlines():
        event = json.loads(line)
        if event["Event"] == "SparkListenerTaskEnd" and event.get("Task Metrics"):
            moved += event["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"]
            seconds += event["Task Metrics"]["Executor CPU Time"] / 1e9
    print(f"text {size} bytes, shuffled {moved} bytes ({moved / size:.1f} x), {seconds:.0f} CPU seconds ({seconds / size * 1e9:.0f} a GB), {rows} positions")
