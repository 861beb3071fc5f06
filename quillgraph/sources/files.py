"""File sources and sinks: JSON, JSON lines, CSV, documents and code trees, Markdown and graph exports."""

from __future__ import annotations

import subprocess
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SKIP_FOLDERS = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects or arrays of objects, a file each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str, since: str | None = None, at: str = "ts") -> DataFrame:
    """Records of an append log; malformed lines are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows if since is None else rows.filter(F.try_to_timestamp(F.col(at)) >= F.lit(since).cast("timestamp"))


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S9."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def text_tree(spark: SparkSession, path: str, patterns: Sequence[str], skip: Sequence[str] = SKIP_FOLDERS) -> DataFrame:
    """Path, text of every file of a tree with one of the extensions, outside skipped folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(patterns) + "}").load(path)
    inside = F.split(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "/")
    return files.filter(~F.arrays_overlap(inside, F.array(*map(F.lit, skip)))).select("path", F.decode("content", "UTF-8").alias("text"))


def changed_files(spark: SparkSession, repository: str, staged: bool = False, base: str | None = None) -> DataFrame:
    """Names of files that a repository's diff touches."""
    args = ["git", "-C", repository, "diff", "--name-only", *(["--cached"] if staged else []), *([base] if base else [])]
    names = subprocess.run(args, capture_output=True, text=True, check=True, timeout=60).stdout.splitlines()
    return spark.createDataFrame([(n,) for n in names], "path string")


def head(repository: str) -> str:
    """A repository's current commit."""
    return subprocess.run(["git", "-C", repository, "rev-parse", "HEAD"], capture_output=True, text=True, check=True, timeout=60).stdout.strip()


def sheet_rates(lines: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Section, item, rate of lines like `name 13.0%`; a line without a rate heads the lines after it."""
    rate = F.regexp_extract(text, r"^(.+?)([\d.]+)%", 2)
    head_ = F.when(rate == "", F.nullif(F.trim(text), F.lit("")))
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("section", F.last(head_, ignorenulls=True).over(w)).filter(rate != "")
    return rows.select(by, "section", F.trim(F.regexp_extract(text, r"^(.+?)([\d.]+)%", 1)).alias("item"), rate.try_cast("double").alias("rate"))


def append_manifest(rows: DataFrame, path: str) -> None:
    """K13."""
    rows.write.mode("append").json(path)


def write_tables(df: DataFrame, path: str, by: str) -> None:
    """K1: one folder a label or relation, so that readers prune."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def markdown_notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Id, text: a note with a heading, the content and links to neighbours in order."""
    links = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("- "), "rel_type", F.lit(" [["), "dst", F.lit("]]")))).alias("links"))
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("title", "name", "id")), F.nullif("content", F.lit("")), F.array_join("links", "\n"))
    return nodes.join(links, "id", "left").select("id", body.alias("text"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Kind, json: a line for each node and edge."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "label", "name")).alias("json"))
    return n.unionByName(edges.select(F.lit("link").alias("kind"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("rel_type").alias("type"))).alias("json")))
