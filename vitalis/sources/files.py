"""Readers and writers: text messages, validated XML, unit tables, model files, and versioned tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def messages(spark: SparkSession, path: str) -> DataFrame:
    """Each file of a directory as one message: payload and the file it came from."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"), F.input_file_name().alias("source"))


def message_stream(spark: SparkSession, path: str, files_at_once: int = 50) -> DataFrame:
    """The same as a stream; files_at_once bounds a micro-batch, which is what holds back a flood."""
    s = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_at_once).load(path)
    return s.select(F.col("value").alias("payload"), F.input_file_name().alias("source"))


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str, xsd: str | None = None) -> DataFrame:
    """Rows of XML files; where they break the schema document, _corrupt_record holds them."""
    r = spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").schema(schema + ", _corrupt_record string")
    return (r.option("rowValidationXSDPath", xsd) if xsd else r).load(path)


def unit_table(spark: SparkSession, path: str) -> DataFrame:
    """(code, unit) from a CSV file with a header."""
    return spark.read.csv(path, header=True, schema="code string, unit string").where("code is not null")


def model_file(path: str) -> dict:
    """Parameters of a generator's network; a small configuration file."""
    with open(path) as f:
        return json.load(f)


class VersionedTable:
    """A table as versions in a folder: a new one is written whole, then becomes current by one small file.

    Readers never see half a version, and a failed write leaves the current one as it is. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def current(self) -> str | None:
        fs, path = self._fs()
        at = path(f"{self.path}/_current")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        version = self.current()
        return self.spark.read.parquet(f"{self.path}/{version}") if version else None

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> str:
        version = f"v-{uuid.uuid4().hex}"
        w = df.write
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.path}/{version}")
        fs, path = self._fs()
        stream = fs.create(path(f"{self.path}/_current"), True)
        try:
            stream.writeUTF(version)
        finally:
            stream.close()
        return version

    def append(self, df: DataFrame) -> str:
        """A new version with the rows of both; columns are matched by name."""
        old = self.read()
        return self.write(df if old is None else old.unionByName(df, allowMissingColumns=True))

    def delete(self, keys: DataFrame, on: list[str]) -> str:
        old = self.read()
        if old is None:
            raise ValueError("there is no version to delete from")
        return self.write(old.join(keys.select(*on).distinct(), on, "left_anti"))

    def truncate(self) -> str:
        """A new version without rows, as a staging table after its batch was loaded."""
        old = self.read()
        if old is None:
            raise ValueError("there is no version to empty")
        return self.write(old.limit(0))


def analysed(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Materialises a result as a table of the catalogue, with statistics for the planner; path is where it is stored."""
    if path:  # the catalogue's own folder may hold a table of this name from another session
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    (df.write.option("path", path) if path else df.write).mode("overwrite").saveAsTable(name)
    df.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
    return df.sparkSession.table(name)
