"""Keyed tables over partitioned Parquet: upsert, overwrite, snapshot, and what changed between versions."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Collection, Mapping, Sequence
from contextlib import closing
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from finlake.operators.dedup import POSITION, latest
from finlake.operators.joins import counted

#: What a manifest says: its version, the rows of each folder that it wrote, and the newest batch of each stream that is in the table.
MANIFEST = "version long, written map<string,long>, batches map<string,long>"
#: Names of manifests; files that are still being written have others.
MANIFEST_FILES = "[0-9]*[0-9]"
#: Size of a range of sorted rows, which one task sorts; in memory they take about ten times as much as in files.
FILE_BYTES = 16 << 20


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a pattern, names anything; runs no job."""
    store, at = _path(spark, path)
    return bool(store.globStatus(at))


def put_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file whole or not at all; False where there is one."""
    store, at = _path(spark, path)
    _, aside = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    with closing(store.create(aside)) as file:
        file.write(bytearray(text.encode()))
    done = not store.exists(at) and store.rename(aside, at)
    if not done:
        store.delete(aside, False)
    return done


def get_text(spark: SparkSession, path: str) -> str:
    store, at = _path(spark, path)
    with closing(store.open(at)) as file:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")


def delete(spark: SparkSession, path: str) -> None:
    store, at = _path(spark, path)
    store.delete(at, True)


def merged(old: DataFrame, new: DataFrame, key: Sequence[str], order: str | None) -> DataFrame:
    """The rows of both, one per key: the higher ``order`` wins, and the new row where they are equal or without an order."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(old.columns).withColumn("__new", F.lit(1)))
    return latest(both, key, [*([F.col(order).desc_nulls_last()] if order else []), F.col("__new").desc()]).drop("__new")


@dataclass(frozen=True)
class KeyedTable:
    """``key`` identifies a row, in the whole table or (``global_key`` false) in its partition; ``order`` tells which version is newer.

    A write makes new folders and then a new manifest, the list of folders that
    are the table, whose renaming is the commit. So a write that fails leaves the
    table as it was, and a reader sees one version or the next. Folders that the
    last ``keep`` manifests do not name are deleted after a commit. One writer at a
    time; a second one fails at its commit.

    Folders are one per partition, or with ``buckets`` one per hash of the key, which
    has the partitions below it. A write neither reads nor rewrites folders that it
    does not touch: an upsert those of its partitions, or the buckets of its keys. So
    a global key that moves to another partition is found in its bucket; without
    buckets a global key needs the key columns of the whole table.

    With ``sort`` the files of a write hold ranges of (folder, sort columns) that do
    not overlap: as many as there are FILE_BYTES in the rows, by Catalyst's estimate,
    and at most one for each shuffle partition.

    Without, the rows of a folder are brought together, so that the number of files follows
    from their size and not from the number of tasks.

    With a ``name`` each commit points the table of this name in the session's
    catalogue to the new folders, so any session finds it with ``spark.table``.
    """

    path: str
    schema: str
    key: tuple[str, ...]
    order: str
    partition: str | None = None
    global_key: bool = True
    sort: tuple[str, ...] = ()
    buckets: int = 0
    keep: int = 2
    file_bytes: int = FILE_BYTES
    name: str | None = None

    def __post_init__(self):
        if self.buckets and not self.global_key:
            raise ValueError("buckets are for keys of the whole table; others have their partition")

    @property
    def columns(self) -> list[str]:
        return StructType.fromDDL(self.schema).names

    @property
    def _folder(self) -> tuple[str, Column] | None:
        """Name and value of the column that rows are put into folders by."""
        if self.buckets:
            return "key_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        return (self.partition, F.col(self.partition)) if self.partition else None

    def _files(self, df: DataFrame) -> int:
        """Ranges that ``df`` is written in; what it holds is estimated, not counted."""
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return max(1, min(-(-size // self.file_bytes), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    @property
    def manifests(self) -> str:
        return f"{self.path}/_manifests"

    def _manifest(self, number: int) -> str:
        return f"{self.manifests}/{number:012d}"

    def versions(self, spark: SparkSession) -> list[int]:
        """The versions that can still be read."""
        store, at = _path(spark, f"{self.manifests}/{MANIFEST_FILES}")
        return sorted(int(x.getPath().getName()) for x in store.globStatus(at) or [])

    def version(self, spark: SparkSession) -> int | None:
        """The number of the newest commit; None before the first."""
        return max(self.versions(spark), default=None)

    def _state(self, spark: SparkSession, number: int | None = None) -> dict:
        number = self.version(spark) if number is None else number
        return {"folders": {}, "batches": {}} if number is None or number < 0 else json.loads(get_text(spark, self._manifest(number)))

    def folders(self, spark: SparkSession, number: int | None = None) -> dict[str, str]:
        """Folder's name (empty without partition and buckets) -> path below ``path``, of the newest commit or ``number``."""
        return self._state(spark, number)["folders"]

    def batch(self, spark: SparkSession, query: str) -> int:
        """The newest batch of a stream that the table has; -1 without one."""
        return self._state(spark)["batches"].get(query, -1)

    def commits(self, spark: SparkSession) -> DataFrame:
        """version, folder, rows of what each version that is still there has written."""
        found = spark.read.schema(MANIFEST).option("pathGlobFilter", MANIFEST_FILES).json(self.manifests)
        return found.select("version", F.explode("written").alias("folder", "rows"))

    def create(self, spark: SparkSession) -> None:
        """An empty table, unless there is one."""
        if self.version(spark) is None:
            self._commit(spark, 0, {}, {}, {})

    def read(self, spark: SparkSession, only: Collection[str] | None = None, number: int | None = None) -> DataFrame:
        """The table (its newest version or ``number``), or those of its folders that ``only`` names."""
        return self._open(spark, [folder for name, folder in self.folders(spark, number).items() if only is None or name in only])

    def _open(self, spark: SparkSession, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], self.schema)
        schema = f"{self.schema}, table_version string" + (", key_bucket int" if self.buckets else "")
        return spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/{x}" for x in folders]).select(*self.columns)

    def _replace(self, df: DataFrame, spark: SparkSession, replaced: Collection[str] | None, values: Collection | None = None, batch: tuple[str, int] | None = None) -> None:
        """``df`` instead of the folders ``replaced`` (None: of all) and of those it has rows for.

        ``values``: all values of the folder column in ``df``, where they are known;
        rows are then counted by folder, from what the written files say of themselves,
        else together while they are written.
        """
        number = self.version(spark)
        before = self._state(spark, number)
        number = 0 if number is None else number + 1
        folder = f"table_version={number}-{uuid.uuid4().hex[:12]}"
        df, by = df.select(*self.columns), []
        if self._folder:
            by = [self._folder[0], *([self.partition] if self.buckets and self.partition else [])]
            df = df.withColumn(*self._folder)
        values = list(range(self.buckets)) if self.buckets else list(values or ()) if self._folder else []
        if self.sort:
            order = [*by, *self.sort]
            df = df.repartitionByRange(self._files(df), *order).sortWithinPartitions(*order)
        elif by:  # a file for each folder and advisory size, not for each folder and task
            df = df.hint("rebalance", *map(F.col, by))
        counts = Observation()
        writer = (df if values else df.observe(counts, F.count("*").alias("rows"))).write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{folder}")
        made = {"": folder}
        if by:
            store, at = _path(spark, f"{self.path}/{folder}")
            names = [x.getPath().getName() for x in store.listStatus(at) if x.isDirectory()]
            made = {name: f"{folder}/{name}" for name in names}
        if values:
            got = self._counted(spark, f"{self.path}/{folder}", by) if made else {}
            named = {self.folder(spark, v): got.get(None if v is None else str(v), 0) for v in values}
            written = {name: named[name] for name in made if name in named}
        else:
            written = {"": counts.get.get("rows", 0)}
        kept = {} if replaced is None else {name: f for name, f in before["folders"].items() if name not in replaced}
        self._commit(spark, number, kept | made, written, before["batches"] | (dict([batch]) if batch else {}))

    @staticmethod
    def _counted(spark: SparkSession, path: str, by: Sequence[str]) -> dict[str | None, int]:
        """Rows by folder; no column of the files is read, only their footers."""
        rows = spark.read.schema(", ".join(f"`{c}` string" for c in by)).parquet(path)
        return {r[0]: r["n"] for r in rows.groupBy(by[0]).agg(F.count("*").alias("n")).collect()}

    def _commit(self, spark: SparkSession, number: int, folders: Mapping[str, str], written: Mapping[str, int], batches: Mapping[str, int]) -> None:
        if not put_text(spark, self._manifest(number), json.dumps({"version": number, "folders": folders, "written": written, "batches": batches})):
            raise RuntimeError(f"another writer committed {self.path}")
        if self.name:
            self.publish(spark)
        store, at = _path(spark, f"{self.path}/table_version=*")
        old = [v for v in self.versions(spark) if v <= number - self.keep]
        named = {folder for v in range(max(0, number - self.keep + 1), number + 1) if v not in old for folder in self.folders(spark, v).values()}
        for status in store.globStatus(at):
            folder = status.getPath().getName()
            parts = [f"{folder}/{x.getPath().getName()}" for x in store.listStatus(status.getPath()) if x.isDirectory()] if self._folder else []
            gone = [p for p in parts if p not in named]
            for path in [folder] if folder not in named and len(gone) == len(parts) else gone:
                store.delete(_path(spark, f"{self.path}/{path}")[1], True)
        for v in old:
            store.delete(_path(spark, self._manifest(v))[1], False)

    def publish(self, spark: SparkSession) -> None:
        """Makes what the catalogue has by this name the newest version.

        By partitions it is an external table, whose partitions are moved where they
        are not where it has them. Else it is a view over the folder, or the folders of
        all buckets: other sessions may hold on to a table's location, not to a view's.
        """
        folders = {name: f"{self.path}/{folder}" for name, folder in self.folders(spark).items()}
        empty = f"{self.path}/_empty"
        store, at = _path(spark, empty)
        store.mkdirs(at)
        if self.buckets or not self.partition:
            fields = [f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in StructType.fromDDL(self.schema)]
            parts = [f"SELECT {', '.join(fields)} FROM parquet.`{folder}`" for folder in folders.values()]
            nothing = f"SELECT {', '.join(f'CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`' for f in StructType.fromDDL(self.schema))} WHERE false"
            spark.sql(f"CREATE OR REPLACE VIEW {self.name} AS {' UNION ALL '.join(parts) or nothing}")
            return
        if not spark.catalog.tableExists(self.name):
            spark.sql(f"CREATE TABLE {self.name} ({self.schema}) USING parquet PARTITIONED BY ({self.partition}) LOCATION '{empty}'")
        value = lambda name: "'" + unquote(name.partition("=")[2]).replace("'", "\\'") + "'"
        state = spark.sql(f"SHOW TBLPROPERTIES {self.name} ('finlake.folders')").first()["value"]
        before = json.loads(bytes.fromhex(state)) if re.fullmatch("[0-9a-f]+", state) else {}
        gone = [name for name, folder in before.items() if folders.get(name) != folder]
        new = {name: folder for name, folder in folders.items() if before.get(name) != folder}
        if gone:
            spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS " + ", ".join(f"PARTITION ({self.partition} = {value(n)})" for n in gone))
        if new:
            spark.sql(f"ALTER TABLE {self.name} ADD IF NOT EXISTS " + " ".join(f"PARTITION ({self.partition} = {value(n)}) LOCATION '{f}'" for n, f in new.items()))
        spark.sql(f"ALTER TABLE {self.name} SET TBLPROPERTIES ('finlake.folders' = '{json.dumps(folders).encode().hex()}')")
        spark.catalog.refreshTable(self.name)

    def folder(self, spark: SparkSession, value) -> str:
        """The name of the folder of a partition, or bucket."""
        name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        return name(self._folder[0], None if value is None else str(value))

    def _values(self, df: DataFrame) -> list:
        """Values of the folder column in ``df``; one per folder reaches the driver."""
        return [r[0] for r in df.select(self._folder[1].cast("string").alias("v")).distinct().collect()]

    def snapshot(self, df: DataFrame) -> None:
        """Replaces the whole table."""
        self._replace(df, df.sparkSession, None)

    def overwrite_partitions(self, df: DataFrame, values: Collection | None = None) -> None:
        """Replaces the partitions that ``df`` has rows for (``values``, where they are known); all where the table has no partitions."""
        if self.buckets:
            raise ValueError("a table with buckets has no folder for each partition")
        self._replace(df, df.sparkSession, () if self.partition else None, values)

    def upsert(self, batch: DataFrame, source: tuple[str, int] | None = None, replace: bool = False, gone: Column | None = None) -> bool:
        """Merges a batch, whose repeated keys collapse first (as in ``latest``); an empty batch writes nothing.

        ``source``: the stream and number of the batch. The commit says that the
        table has it, so a batch that comes again after a crash changes nothing.
        ``replace``: the batch's rows win whatever their order. ``gone``: merged rows
        to leave out. True if the table was written.
        """
        spark = batch.sparkSession
        if source and self.batch(spark, source[0]) >= source[1]:
            return False
        key = self.key if self.global_key or not self.partition else (*self.key, self.partition)
        position = [POSITION] if POSITION in batch.columns and POSITION not in self.columns else []  # tells ties apart, and is not kept
        batch = latest(batch.select(*self.columns, *position), key, [F.col(self.order).desc_nulls_last()]).select(*self.columns)
        aside = f"{self.path}/_batch-{uuid.uuid4().hex}"  # so that the batch is computed once
        try:
            batch.write.parquet(aside)
            batch = spark.read.schema(batch.schema).parquet(aside)
            if batch.isEmpty():
                return False
            replaced, values = None, None
            if self._folder:
                values = self._values(batch)
                if self.partition and self.global_key and not self.buckets:
                    values = sorted({*values, *self._values(self.read(spark).join(counted(batch.select(*self.key)), list(self.key), "left_semi"))}, key=str)
                replaced = {self.folder(spark, v) for v in values}
            old = self.folders(spark)
            if old if replaced is None else replaced & set(old):
                rows = merged(self.read(spark, replaced), batch, key, None if replace else self.order)
            else:  # nothing to merge with: the batch has one row per key already
                rows = batch.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(self.schema)])
            self._replace(rows if gone is None else rows.where(~F.coalesce(gone, F.lit(False))), spark, replaced, values, source)
            return True
        finally:
            delete(spark, aside)

    def changes(self, spark: SparkSession, after: int, until: int) -> DataFrame:
        """Keys whose rows differ between two versions (-1: before the first): ``change`` (insert, update, delete), ``before`` and ``row`` as structs.

        Only folders that are not the same in both versions are read.
        """
        if after >= 0 and after not in self.versions(spark):
            raise LookupError(f"version {after} of {self.path} is gone")
        old, new = self.folders(spark, after), self.folders(spark, until)
        key = self.key if self.global_key or not self.partition else (*self.key, self.partition)
        side = lambda mine, other, name: self._open(spark, [f for k, f in mine.items() if other.get(k) != f]).select(*key, F.struct(*self.columns).alias(name))
        both = side(old, new, "before").join(side(new, old, "row"), list(key), "full_outer")
        kind = F.when(F.col("before").isNull(), "insert").when(F.col("row").isNull(), "delete").otherwise("update")
        return both.where(~F.col("before").eqNullSafe(F.col("row"))).select(kind.alias("change"), "before", "row")
