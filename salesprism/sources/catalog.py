"""Tables of metadata as appended Parquet: the last version of a key counts, alerts are kept once."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = {
    "datasets": ("dataset_id", "dataset_id string, name string, path string, recipient string"), "mappings": ("fingerprint", "fingerprint string, roles string"),
    "snapshots": ("fingerprint", "fingerprint string, rows long, median_value double, products long, first_date date, last_date date"), "stories": ("dataset_id", "dataset_id string, findings string"),
    "goals": ("id", "id string, dataset_id string, metric string, target double, start date, end date"), "alerts": ("key", "key string, dataset_id string, kind string, level string, subject string, period string, acknowledged boolean"),
}


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _all(self, table: str) -> DataFrame:
        schema = f"{TABLES[table][1]}, version long, deleted boolean"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def read(self, table: str) -> DataFrame:
        """The last version of each key that isn't deleted."""
        key = TABLES[table][0]
        last = self._all(table).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("version").desc())))
        return last.where("_r = 1 and not deleted").drop("_r", "version", "deleted")

    def get(self, table: str, key: str) -> dict | None:
        row = self.read(table).where(F.col(TABLES[table][0]) == key).first()
        return row.asDict() if row else None

    def put(self, table: str, rows: DataFrame, deleted: bool = False) -> None:
        rows.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in TABLES[table][1].split(", ")]).withColumn("version", F.lit(time.time_ns())).withColumn("deleted", F.lit(deleted)).write.mode("append").parquet(f"{self.root}/{table}")

    def put_new(self, table: str, rows: DataFrame) -> None:
        """Only rows whose key isn't there yet, each key once. Of writers at the same time all may write a key; they are versions of one row."""
        key = TABLES[table][0]
        new = rows.dropDuplicates([key]).join(self.read(table).select(key), key, "left_anti")
        if not new.isEmpty():
            self.put(table, new)

    def delete(self, table: str, key: str) -> None:
        self.put(table, self.read(table).where(F.col(TABLES[table][0]) == key), deleted=True)
