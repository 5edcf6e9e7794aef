"""Files as tables: JSON and CSV with a schema, drafts of many files, manifests of size and SHA-256, and sinks that refuse to overwrite.

Edge cases: a CSV file whose header is not the schema's column names, in order, is an error, as is a row that does not
fit; missing JSON fields are null; empty folders of a readable kind give no rows; paths that leave a manifest's folder
are reported by ``audit``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV files whose header equals the schema's names; other headers and bad rows fail when read."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST", multiLine=True, escape='"')


def read_json(spark: SparkSession, path: str, schema: StructType, field: str | None = None) -> DataFrame:
    """Rows of JSON files that hold an array of objects, or one object with that array in ``field``; with file and idx."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    rows = F.from_json("value", f"array<{schema.simpleString()}>", {"mode": "FAILFAST"})
    if field is not None:
        inner = F.from_json("value", f"struct<`{field}`:array<{schema.simpleString()}>>", {"mode": "FAILFAST"})
        rows = F.when(F.ltrim("value").startswith("["), rows).otherwise(inner[field])
    return text.select("file", F.posexplode(rows).alias("idx", "row")).select("file", "idx", "row.*")


def last_written(rows: DataFrame, keys: list[str], kind: Column) -> DataFrame:
    """Of rows with one key that of the latest file: by kind, then path, then place in the file."""
    w = Window.partitionBy(*keys).orderBy(kind.desc(), F.desc("file"), F.desc("idx"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def write_csv(rows: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """One CSV file with a header and rows in order; an existing folder is an error."""
    rows.select(*columns).orderBy(*order).coalesce(1).write.csv(path, header=True, mode="errorifexists", escape='"')


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines; an existing folder is an error."""
    rows.write.json(path, mode="errorifexists")


def nested(sections: DataFrame, nodes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Sections with an array ``nodes`` of structs in order, empty where a section has none."""
    rest = [c for c in nodes.columns if c not in keys]
    lists = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in rest if c != order)))).alias("nodes"))
    kind = lists.schema["nodes"].dataType
    return sections.join(lists, keys, "left").withColumn("nodes", F.coalesce("nodes", F.array().cast(kind)))


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size, sha256 of each file below a folder; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def audit(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """path, issue: files that are missing, unrecorded or changed, or recorded outside the folder; nothing for those that agree."""
    r = recorded.select("path", F.col("sha256").alias("was"))
    f = found.select("path", F.col("sha256").alias("is"))
    issue = F.when(F.col("path").rlike(r"(^|/)\.\.(/|$)"), "escapes").when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "unrecorded").when(F.col("was") != F.col("is"), "changed")
    return r.join(f, "path", "full_outer").select("path", issue.alias("issue")).where("issue is not null")
