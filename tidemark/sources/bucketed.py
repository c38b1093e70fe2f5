"""A store of one row per key that is added to and changed in place (CD-03, ST-01, IO-08, IO-11), and snapshots that switch at once (IO-09)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS, BUCKETS = 64, 8
PART = "store_part"


class BucketedStore:
    """A Parquet table dealt to `parts` folders by a hash of its key, each bucketed and sorted by the key.

    A change reads and rewrites only the folders of its keys. What is joined with the store by key is dealt like its buckets, so the
    store isn't shuffled. Keys aren't null: rows without one are refused. `name` is the table's name in the session, `path` its folder, which all executors share.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "url", parts: int = PARTS, buckets: int = BUCKETS, name: str | None = None) -> None:
        self.spark, self.key, self.parts, self.buckets = spark, key, parts, buckets
        self.name = name or f"store_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({schema}, {PART} INT) USING parquet PARTITIONED BY ({PART}) CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")

    @staticmethod
    def like(df: DataFrame, path: str, **how) -> BucketedStore:
        """An empty store with the columns of `df`."""
        return BucketedStore(df.sparkSession, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), **how)

    def part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def read(self) -> DataFrame:
        return self.spark.table(self.name).drop(PART)

    def _dealt(self, batch: DataFrame) -> DataFrame:
        columns = [c for c in self.spark.table(self.name).columns if c != PART]
        return batch.filter(F.col(self.key).isNotNull()).select(*columns, self.part().alias(PART))

    def _touched(self, dealt: DataFrame) -> DataFrame:
        """The folders that hold the keys of a batch; their numbers, of which there are `parts` at most, are collected."""
        parts = [r[0] for r in dealt.select(PART).distinct().collect()]
        return self.spark.table(self.name).filter(F.col(PART).isin(parts))

    def rest_of(self, dealt: DataFrame) -> DataFrame:
        """Rows of the touched folders whose keys a batch doesn't have."""
        return self._touched(dealt).join(dealt.select(self.key), self.key, "left_anti").select(*dealt.columns)

    def new_of(self, dealt: DataFrame) -> DataFrame:
        return dealt.join(self._touched(dealt).select(self.key), self.key, "left_anti").select(*dealt.columns)

    def _write(self, rows: DataFrame, overwrite: bool) -> None:
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            rows.write.mode("overwrite" if overwrite else "append").insertInto(self.name, overwrite=overwrite)
        finally:
            self.spark.conf.set(mode, before)
        self.spark.catalog.refreshTable(self.name)

    def upsert(self, batch: DataFrame) -> None:
        """Rows of `batch`, one per key, replace those of their keys; other folders stay as they are. Doing it again changes nothing."""
        dealt = self._dealt(batch)
        self._write(self.rest_of(dealt).unionByName(dealt.repartition(self.buckets, self.key)), overwrite=True)

    def insert_new(self, batch: DataFrame) -> None:
        """Rows of `batch`, one per key, whose keys aren't stored are added in files of their own; no stored file is rewritten. Doing it again adds nothing."""
        dealt = self._dealt(batch)
        self._write(self.new_of(dealt).repartition(self.buckets, self.key), overwrite=False)

    def drop(self) -> None:
        """Forgets the table's name; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


CURRENT = "CURRENT"


def _files(spark: SparkSession, path: str):
    """Hadoop's file calls for the store that `path` is in."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    return at, at.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf)


def write_snapshot(df: DataFrame, path: str, keep: int = 2) -> str:
    """IO-09: writes `df` to a folder of its own under `path`, then lets the pointer name it, by one rename. A reader sees the old rows or the new ones, whole.

    The last `keep` whole snapshots stay for readers that have begun; older ones go. A write that fails before the rename changes nothing for readers.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    at, files, context = _files(spark, path)
    whole = lambda s: s.isDirectory() and files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    known = sorted((s.getModificationTime(), s.getPath().getName()) for s in files.listStatus(at) if whole(s)) if files.exists(at) else []
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}/.{version}")
    out = files.create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{path}/{CURRENT}"), options)
    for _, old in known[: len(known) - keep + 1]:
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)
    return version


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """IO-09: the snapshot that the pointer names now; later switches don't change it."""
    return spark.read.parquet(f"{path}/{spark.read.text(f'{path}/{CURRENT}').first()[0]}")
