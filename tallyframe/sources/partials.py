"""Tables stored by delivery: one folder for each part (a year, a day), replaced as a whole.

``PartTable`` writes a part's rows to ``<path>/<part>=<value>`` and overwrites that folder when the
part is delivered again, so a late or corrected delivery is idempotent.  A filter on the part
column prunes the other folders before a file is opened.

``StoredCounts`` keeps partial counts that way.  A delivery reads only what is
delivered and writes one row per key; totals, top-k and cross-tables are
aggregates of the stored counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.counts import as_list, by_measure


class PartTable:
    """A Parquet table under ``path`` (a folder that all executors share), partitioned by ``part``."""

    def __init__(self, spark: SparkSession, path: str, part: str, part_type: str = "int") -> None:
        self.spark, self.path, self.part, self.part_type = spark, path.rstrip("/"), part, part_type
        self.schema: T.StructType | None = None

    def deliver(self, df: DataFrame, value: object) -> None:
        """Replace one part by ``df``; rows of another part are an error, none empty the part."""
        if self.part in df.columns:
            other = df.filter(~F.col(self.part).eqNullSafe(F.lit(value))).limit(1).count()
            if other:
                raise ValueError(f"the delivery of {self.part}={value} holds rows of another part")
            df = df.drop(self.part)
        self._keep(df.schema)
        df.write.mode("overwrite").parquet(f"{self.path}/{self.part}={value}")

    def deliver_all(self, df: DataFrame) -> None:
        """Replace every part that ``df`` has rows of, in one job; other parts stay."""
        self._keep(T.StructType([f for f in df.schema.fields if f.name != self.part]))
        df.write.partitionBy(self.part).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def _keep(self, schema: T.StructType) -> None:
        if self.schema is not None and [(f.name, f.dataType) for f in self.schema] != [(f.name, f.dataType) for f in schema]:
            raise ValueError(f"the delivery has {schema.simpleString()}, the table {self.schema.simpleString()}")
        self.schema = schema

    def read(self) -> DataFrame:
        if self.schema is None:
            return self.spark.read.parquet(self.path)
        schema = T.StructType([*self.schema.fields, T.StructField(self.part, T._parse_datatype_string(self.part_type))])
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path)

    def one(self, value: object) -> DataFrame:
        """One part's rows; only its folder is read."""
        return self.read().filter(F.col(self.part) == F.lit(value))


class StoredCounts:
    """Rows per key and part, kept up by deliveries."""

    def __init__(
        self, spark: SparkSession, path: str, part: str, keys: str | Sequence[str], part_type: str = "int"
    ) -> None:
        self.table, self.keys = PartTable(spark, path, part, part_type), as_list(keys)

    def _counts(self, df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by, *self.keys).agg(F.count(F.lit(1)).alias("n"))

    def deliver(self, df: DataFrame, value: object) -> None:
        """The rows of one part, all of them; they replace what was delivered for it before."""
        self.table.deliver(self._counts(df), value)

    def deliver_all(self, df: DataFrame) -> None:
        """Rows of many parts (with the part column), each whole."""
        self.table.deliver_all(self._counts(df, self.table.part))

    def totals(self, keys: str | Sequence[str], name: str = "n", parts: Sequence[object] | None = None) -> DataFrame:
        """Rows by some of the stored keys, over all parts or the given ones."""
        by, stored = as_list(keys), self.table.read()
        if parts is not None:
            stored = stored.filter(F.col(self.table.part).isin(*parts))
        return stored.groupBy(*by).agg(F.sum("n").alias(name)).orderBy(*by_measure(name, by))
