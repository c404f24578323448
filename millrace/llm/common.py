"""Scratch tables in the shared folder, deleted as soon as a result stands without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import cut_lineage, scratch_path

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: what separates words: space and the control characters 9 to 13
GAPS = "[\\x20\\x09-\\x0D]+"


class Scratch:
    """Tables written below `spark.checkpoint.dir`; leaving the block deletes them.

    A written table cuts lineage (lost executors cost one stage, not the job)
    and is compressed and read by column, which a checkpoint is not.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def path(self, name: str) -> str:
        self.paths.append(scratch_path(self.spark, name))
        return self.paths[-1]

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        """A table that outlives the block, as a reliable checkpoint."""
        return cut_lineage(df)

    def drop(self, *names: str) -> None:
        """Delete the tables whose names start like one of these."""
        for p in [p for p in self.paths if p.rsplit("/", 1)[1].rsplit("-", 1)[0] in names]:
            self._delete(p)
            self.paths.remove(p)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __exit__(self, *_) -> None:
        for p in self.paths:
            self._delete(p)


def words(text: Column) -> Column:
    """Words of a whole text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")


def lowered(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, *LOWER)
