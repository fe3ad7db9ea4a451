"""Readers for manifests, listings, labels, curves and summaries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.expressions import base_name, name_category, parent_name, stem

MANIFEST_SCHEMA = "role string, category string, path string"
PER_IMAGE_SCHEMA = "role string, category string, path string, n_boxes int, max_conf double"
# File name suffixes that count as photographs.
IMAGE_SUFFIXES = ["bmp", "jpeg", "jpg", "png", "webp"]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, found out by asking a reader, so that it works over any connection."""
    try:
        spark.read.format("binaryFile").load(path).schema
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.csv(
        path, schema=schema, header=True, nullValue="", emptyValue="", enforceSchema=False
    )


def read_manifest(
    spark: SparkSession, path: str, role: str | None = None, limit: int | None = None
) -> DataFrame:
    """(role, category, path) of a manifest folder partitioned by role, or of one manifest file.

    A missing path or role reads as no rows. The role filter prunes partitions. A limit takes the
    first rows by path.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    rows = spark.read.csv(path, schema=MANIFEST_SCHEMA, header=True)
    if role is not None:
        # The folder's partition column repeats the role; only a filter on it prunes.
        pruned = rows.filter(F.col("part") == role) if "part" in rows.columns else rows
        rows = pruned.filter(F.col("role") == role)
    rows = rows.select("role", "category", "path")
    return rows if limit is None else rows.orderBy("path").limit(limit)


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(?<=.)\.([^.]*)$", 1)).isin(IMAGE_SUFFIXES)


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the photographs in a folder, contents unread; a missing folder is empty."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "path string, length bigint")
    return spark.read.format("binaryFile").load(folder).select("path", "length").filter(is_image(F.col("path")))


def with_directory_category(files: DataFrame, excluded: list[str]) -> DataFrame:
    """Add `category` from the directory that holds the file; excluded categories are dropped."""
    rows = files.withColumn("category", parent_name("path"))
    return rows.filter(~F.col("category").isin(excluded))


def with_curated_category(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """Add `category`: the override for the file name, else what the name itself carries.

    overrides: (name, override). The rows are not hinted: the table's size decides the join.
    """
    rows = files.withColumn("_name", base_name("path"))
    return rows.join(overrides.withColumnRenamed("name", "_name"), "_name", "left").withColumn(
        "category", F.coalesce("override", name_category("_name"))
    ).drop("_name", "override")


# ------------------------------------------------------------------ JSON
def json_or_null(text: Column, schema: str) -> Column:
    """Parsed struct, or null where the text is missing or malformed."""
    bad = "_corrupt_record"
    parsed = F.from_json(
        text, f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    )
    return F.when(parsed[bad].isNull(), parsed)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per readable JSON file under `path`; malformed and missing files give no row."""
    try:
        rows = spark.read.json(
            path, schema=f"{schema}, _corrupt_record string", multiLine=True, mode="PERMISSIVE",
            columnNameOfCorruptRecord="_corrupt_record",
        ).withColumn("file", F.input_file_name())
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, file string")
    return rows.filter("_corrupt_record is null").drop("_corrupt_record")


def json_number(text: Column, path: str, default: float | None = None) -> Column:
    """A number inside a JSON text, `default` when it is not there."""
    value = F.get_json_object(text, path).try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(default))


# ------------------------------------------------------------------ labels and curves
def parse_labels(lines: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, line_no, x0, y0, x1, y1) pixel boxes from 'class cx cy w h' lines.

    lines: (image_id, line_no, line); images: (image_id, width, height). Lines without exactly
    five tokens are skipped; an image without usable lines stays as one row with null box.
    """
    tokens = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    rows = lines.withColumn("_t", tokens).filter(F.size("_t") == 5)
    num = lambda i: F.element_at("_t", i).try_cast("double")
    rows = rows.select(
        "image_id", "line_no", num(2).alias("cx"), num(3).alias("cy"), num(4).alias("bw"), num(5).alias("bh")
    ).filter("cx is not null and cy is not null and bw is not null and bh is not null")
    c = F.col
    return images.join(rows, "image_id", "left").select(
        "image_id", "line_no",
        ((c("cx") - c("bw") / 2) * c("width")).alias("x0"), ((c("cy") - c("bh") / 2) * c("height")).alias("y0"),
        ((c("cx") + c("bw") / 2) * c("width")).alias("x1"), ((c("cy") + c("bh") / 2) * c("height")).alias("y1"),
    )


def read_labels(spark: SparkSession, folder: str, images: DataFrame) -> DataFrame:
    """parse_labels over a folder of <stem>.txt files; images: (image_id = stem, width, height)."""
    if not exists(spark, folder):
        lines = spark.createDataFrame([], "image_id string, line_no bigint, line string")
    else:
        text = spark.read.text(folder, wholetext=True)
        lines = text.select(
            stem(base_name(F.input_file_name())).alias("image_id"), F.posexplode(F.split("value", r"\r?\n"))
        ).select("image_id", F.col("pos").cast("bigint").alias("line_no"), F.col("col").alias("line"))
    return parse_labels(lines, images)


def read_training_curve(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """(arm, epoch, metric) from CSV files whose header names are padded with blanks."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = raw.toDF(*[c.strip() for c in raw.columns])
    arm = F.col("arm") if "arm" in rows.columns else F.lit("")
    return rows.select(
        arm.alias("arm"), F.col("epoch").cast("double").cast("int").alias("epoch"),
        F.col(f"`{metric}`").cast("double").alias("metric"),
    )


def read_per_image(spark: SparkSession, path: str) -> DataFrame:
    """Per-image rollup; a blank confidence is null and stays null."""
    return _csv(spark, path, PER_IMAGE_SCHEMA)


def read_latency_rounds(spark: SparkSession, path: str) -> DataFrame:
    """(arm, label, round, ms) from the interleaved latency JSON."""
    arm = "struct<label: string, latency_ms: double, round_ms: array<double>>"
    doc = spark.read.json(path, schema=f"arms map<string, {arm}>", multiLine=True)
    return doc.select(F.explode("arms").alias("arm", "v")).select(
        "arm", F.col("v.label").alias("label"), F.posexplode("v.round_ms").alias("round", "ms")
    )
