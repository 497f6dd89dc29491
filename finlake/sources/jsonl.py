"""JSON-lines sources with declared schemas."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake import schemas
from finlake.operators.dedup import aligned
from finlake.operators.keyed import exists


@dataclass(frozen=True)
class Source:
    """``path`` has ``{day}``; ``glob`` picks files at any depth below it."""

    name: str
    schema: str
    path: str
    glob: str | None = None


def sources(root: str) -> dict[str, Source]:
    return {
        "transactions": Source("transactions", schemas.TRANSACTIONS, f"{root}/day={{day}}", "transactions.jsonl"),
        "cancellations": Source("cancellations", schemas.CANCELLATIONS, f"{root}/cancellations/day={{day}}/cancellations.jsonl"),
        "exchange_rates": Source("exchange_rates", schemas.RATES, f"{root}/exchange_rates/day={{day}}/rates.jsonl"),
    }


#: Columns that a scan adds: the day whose folder a line is in, and the line itself where it is no record.
DAY, BAD = "source_day", "bad_line"


def scan_days(spark: SparkSession, source: Source, days: Iterable[str]) -> DataFrame:
    """The lines of these days with DAY and BAD; days without files have none, and no files at all make an empty frame of the same schema.

    A line is bad if nothing of it could be read. One with a field of another type is
    a record in which that field is null.
    """
    paths = [path for day in days if exists(spark, path := source.path.format(day=day))]
    if not paths:
        return spark.createDataFrame([], f"{source.schema}, {DAY} string, {BAD} string")
    reader = spark.read.schema(f"{source.schema}, {BAD} string").option("columnNameOfCorruptRecord", BAD)
    if source.glob:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", source.glob)
    lines = reader.json(paths)
    nothing = F.coalesce(*[F.col(c).cast("string") for c in lines.columns if c != BAD]).isNull()
    day = F.regexp_extract(F.col("_metadata.file_path"), r"day=(\d{4}-\d{2}-\d{2})", 1)
    return lines.withColumns({DAY: day, BAD: F.when(nothing, F.col(BAD))})


def read_days(spark: SparkSession, source: Source, days: Iterable[str]) -> DataFrame:
    """The records of these days."""
    return scan_days(spark, source, days).where(F.col(BAD).isNull()).drop(DAY, BAD)


def read_day(spark: SparkSession, source: Source, day: str) -> DataFrame:
    return read_days(spark, source, [day])


def read_snapshot(spark: SparkSession, path: str, schema: str, ingested_at) -> DataFrame:
    """A reference table (users, test users, promo codes) as a whole."""
    return spark.read.schema(schema).json(path).withColumn("ingested_at", ingested_at)


def load_snapshots(spark: SparkSession, root: str, names: dict[str, str], ingested_at, required: frozenset[str]) -> tuple[dict[str, DataFrame], list[str]]:
    """Frames by name, and what could not be read; a missing required one raises."""
    found, missing = {}, []
    for name, schema in names.items():
        if exists(spark, path := f"{root}/{name}.jsonl"):
            found[name] = read_snapshot(spark, path, schema, ingested_at)
        elif name in required:
            raise FileNotFoundError(path)
        else:
            missing.append(name)
    return found, missing


def residual(table: DataFrame, partition: str, values: DataFrame, like: DataFrame) -> DataFrame:
    """What the table holds in the partitions that ``values`` names, in the columns of ``like``."""
    wanted = values.select(partition).distinct()
    return aligned(table.join(wanted, partition, "left_semi"), like)


def committed(progress: dict) -> tuple[int, int]:
    """(batch, rows) of a streaming query's progress record; (-1, 0) before the first."""
    return int(progress.get("batchId", -1)), int(progress.get("numInputRows", 0))
