"""Dataset manifests and dependency reports: JSON with declared schemas, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "id string, filename string, resolution string, scene_tags array<string>, source string, sha256 string, added_at string, added_reason string, expected_success boolean"
METADATA = "packages array<struct<id:string,name:string,version:string,license:string,repository:string,source:string>>, workspace_members array<string>"
SPLITS = ("functional", "quality", "perf", "robustness")


def read_manifests(spark: SparkSession, root: str, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """split, id, filename, expected_success of every manifest below ``root`` that exists; ids count from 1 in the file's order."""
    jvm = spark._jvm
    out = None
    for split in splits:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{split}/manifest.json")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            continue
        text = spark.read.option("wholetext", True).text(path.toString())
        rows = text.select(F.posexplode(F.from_json("value", f"array<struct<{MANIFEST.replace(' array<string>', ':array<string>').replace(' string', ':string').replace(' boolean', ':boolean')}>>")).alias("n", "m"))
        own = rows.select(
            F.lit(split).alias("split"),
            F.coalesce("m.id", F.format_string(f"{split}-%03d", F.col("n") + 1)).alias("id"),
            F.col("m.filename").alias("filename"),
            F.coalesce("m.expected_success", F.lit(split != "robustness")).alias("expected_success"),
        )
        out = own if out is None else out.unionByName(own)
    return out if out is not None else spark.createDataFrame([], "split string, id string, filename string, expected_success boolean")


def foreign_packages(metadata: DataFrame, column: str = "value") -> DataFrame:
    """name, version, license, repository, source of packages that are not members, in order of name and version."""
    got = metadata.select(F.from_json(column, METADATA).alias("m"))
    packages = got.select(F.inline("m.packages"))
    members = got.select(F.explode("m.workspace_members").alias("id"))
    return packages.join(members, "id", "left_anti").drop("id").orderBy("name", "version")


def licence_counts(packages: DataFrame, column: str = "license") -> DataFrame:
    return packages.groupBy(F.coalesce(column, F.lit("UNKNOWN")).alias(column)).agg(F.count("*").alias("packages")).orderBy(F.desc("packages"), column)


def read_platforms(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of every .json file of a folder, with their path; a folder that is missing has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{schema}, path string")
    found = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return found.withColumn("path", F.input_file_name())
