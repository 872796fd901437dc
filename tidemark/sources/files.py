"""COPY in and out of CSV and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, StringType, StructField, StructType
from pyspark.sql import functions as F


def copy_to_csv(frame: DataFrame, path: str, header: bool = True, delimiter: str = ",") -> None:
    frame.write.mode("overwrite").option("header", header).option("sep", "\t" if delimiter == "TAB" else delimiter).option("escape", '"').option("nullValue", "NULL").csv(path)


def copy_from_csv(spark: SparkSession, path: str, schema: StructType, header: bool = True, delimiter: str = ",") -> DataFrame:
    """Read with a declared schema; NULL and empty fields are null, booleans may be spelt t, 1 or yes."""
    text = StructType([StructField(f.name, StringType() if isinstance(f.dataType, BooleanType) else f.dataType) for f in schema.fields])
    reader = spark.read.schema(text).option("header", header).option("sep", "\t" if delimiter == "TAB" else delimiter)
    found = reader.option("escape", '"').option("multiLine", True).option("nullValue", "NULL").option("mode", "FAILFAST").csv(path)
    yes = lambda c: F.when(F.col(c).isNotNull(), F.lower(c).isin("t", "true", "1", "yes"))
    return found.withColumns({f.name: yes(f.name) for f in schema.fields if isinstance(f.dataType, BooleanType)})


def copy_to_jsonl(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def copy_from_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One object a line, keys in any case; there is no cap on rows."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def sample_rows(frame: DataFrame, count: int) -> DataFrame:
    """Some rows, as many as asked for."""
    return frame.limit(count)
