"""JSON lines: lenient and strict scans, canonical and sharded sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_lenient(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Fields of each line's object, and `bad`: null, malformed or no object, without the field, wrong type.

    Blank lines aren't rows. A bad line keeps its row with null fields, so that it can be counted.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    v = lines.withColumn("v", F.try_parse_json("value"))
    kind = F.schema_of_variant("v")
    first = next(iter(fields))
    got = {name: F.try_variant_get("v", f'$["{name}"]', t) for name, t in fields.items()}
    present = F.try_variant_get("v", f'$["{first}"]', "variant")
    bad = (
        F.when(F.col("v").isNull(), "malformed")
        .when(~kind.startswith("OBJECT"), "no_object")
        .when(present.isNull(), "no_field")
        .when(F.schema_of_variant(present) != fields[first].upper(), "wrong_type")
    )
    out = v.select(*[c.alias(n) for n, c in got.items()], bad.alias("bad"))
    return out.select(*[F.when(F.col("bad").isNull(), F.col(n)).alias(n) for n in fields], "bad")


def read_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Every line must fit the schema; NaN and infinities aren't numbers."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("allowNonNumericNumbers", "false").json(path)


def strict_objects(lines: DataFrame, column: str = "value") -> DataFrame:
    """Variants of JSON texts; malformed texts and repeated keys raise."""
    return lines.select(F.parse_json(column).alias("v"))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, value): lines with their place in the file, counted within each file.

    A file's lines are numbered in the order that Spark reads them in one task, so
    files are read whole; split large files beforehand.
    """
    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n", -1)).alias("row", "value"))


def canonical(row: dict[str, Column]) -> Column:
    """One JSON object with sorted keys, nulls written."""
    return F.to_json(F.struct(*[row[k].alias(k) for k in sorted(row)]), {"ignoreNullFields": "false"})


def write_lines(df: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines in a new folder; Spark's commit protocol makes the output appear whole or not at all."""
    df.write.mode("errorifexists").option("compression", compression).json(path)


def notebook_code(c: Column) -> Column:
    """The code cells of a notebook's JSON, joined by empty lines; null if it is malformed."""
    cells = F.from_json(c, "cells array<struct<cell_type string, source array<string>>>")["cells"]
    code = F.filter(cells, lambda x: x["cell_type"] == "code")
    return F.array_join(F.transform(code, lambda x: F.array_join(x["source"], "")), "\n\n")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
