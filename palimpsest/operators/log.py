"""A log that only grows, as one plain Parquet folder by bucket and batch."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.shared import cut

#: Buckets of a log: what a batch touches is read by these.
BUCKETS = 64


class Log:
    """Rows by the hashed bucket of their keys and the batch that brought them.

    Whatever the number of batches, reading is one scan with partition filters. A batch that is run again replaces its own
    folders and no others, so a replay changes nothing; rows that come again in a later batch stay, as those who read a
    log (folding is a function of the set of observations) don't count them.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def append(self, rows: DataFrame, batch: int) -> None:
        """Add a batch's rows, each once."""
        placed = rows.dropDuplicates().withColumns({"__bucket": self.bucket(), "__batch": F.lit(batch).cast("long")})
        self._put(placed)

    def _put(self, placed: DataFrame) -> None:
        out = placed.hint("rebalance", "__bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.option("compression", "zstd").partitionBy("__bucket", "__batch").parquet(self.path)

    def _folder(self, path: str):  # noqa: ANN202
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _scan(self, schema: T.StructType) -> DataFrame:
        fs, place = self._folder(self.path)
        whole = T.StructType([*schema.fields, T.StructField("__bucket", T.IntegerType()), T.StructField("__batch", T.LongType())])
        return self.spark.read.schema(whole).parquet(self.path) if fs.exists(place) else self.spark.createDataFrame([], whole)

    def read(self, schema: T.StructType, buckets: Iterable[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        rows = self._scan(schema)
        return (rows if buckets is None else rows.where(F.col("__bucket").isin(list(buckets)))).select(*schema.names)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows with these keys fall into: at most as many as there are."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def compact(self, schema: T.StructType, before: int, buckets: Iterable[int] | None = None) -> int:
        """Bring each bucket's batches below ``before`` together in the first of them, each row once; how many folders went.

        The whole is written before what it replaces goes, and a crash between leaves rows twice, which changes nothing.
        Not to be run beside a writer of these batches.
        """
        rows = self._scan(schema).where(F.col("__batch") < before)
        rows = rows if buckets is None else rows.where(F.col("__bucket").isin(list(buckets)))
        held = [(r[0], r[1]) for r in rows.select("__bucket", "__batch").distinct().collect()]  # a row for each folder
        first = {b: min(n for c, n in held if c == b) for b, _ in held}
        gone = [(b, n) for b, n in held if n != first[b]]
        if not gone:
            return 0
        many = self.spark.createDataFrame([(b, first[b]) for b in {b for b, _ in gone}], "__bucket int, __first long")
        together = rows.join(F.broadcast(many), "__bucket").drop("__batch").withColumnRenamed("__first", "__batch").dropDuplicates()
        self._put(cut(together.select(*schema.names, "__bucket", "__batch")))
        for b, n in gone:
            fs, place = self._folder(f"{self.path}/__bucket={b}/__batch={n}")
            fs.delete(place, True)
        return len(gone)
