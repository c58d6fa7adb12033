"""Reading and writing result tables, and listing images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One row per encode run.
RUNS = (
    "image STRING, width INT, height INT, pixels BIGINT, format STRING, qp INT, encode_qp INT, encoder STRING, setting STRING, variant STRING, "
    "size_bytes BIGINT, bpp DOUBLE, encode_s DOUBLE, psnr_rgb DOUBLE, ssim_rgb DOUBLE, psnr_y DOUBLE, ms_ssim DOUBLE, ms_ssim_db DOUBLE, vifp DOUBLE, "
    "psnr_hvs_m DOUBLE, vmaf DOUBLE, xpsnr DOUBLE, butteraugli DOUBLE, haarpsi DOUBLE, dists DOUBLE, lpips DOUBLE, output_path STRING"
)
#: Columns that tell runs apart.
RUN_KEY = ["image", "format", "encoder", "qp", "encode_qp", "setting", "variant"]

#: Lossless runs are written with an infinite quality, which plain options would read as null.
CSV_OPTIONS = {"header": "true", "positiveInf": "inf", "negativeInf": "-inf", "nanValue": "nan", "emptyValue": "", "nullValue": ""}


def read_results(spark: SparkSession, path: str, schema: str = RUNS) -> DataFrame:
    """A result table with a fixed schema; an empty field is null.  A run without its own quantiser has the nominal one."""
    rows = spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)
    return rows.withColumn("encode_qp", F.coalesce("encode_qp", "qp")) if {"encode_qp", "qp"} <= set(rows.columns) else rows


def write_results(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet is the table of record; see ``export_csv`` for text."""
    rows.write.mode(mode).parquet(path)


def export_csv(rows: DataFrame, path: str, digits: dict[str, int] | None = None) -> None:
    """CSV with the stated decimals; arrays joined by a bar."""
    out = rows
    for name, kind in rows.dtypes:
        if kind.startswith("array"):
            out = out.withColumn(name, F.array_join(name, "|"))
        elif digits and name in digits:
            out = out.withColumn(name, F.round(name, digits[name]))
    out.write.mode("overwrite").options(header="true", emptyValue="").csv(path)


def list_images(spark: SparkSession, root: str, patterns: Sequence[str] = ("*",)) -> DataFrame:
    """(path, length) of image files below a folder, in order of the patterns and then paths, each once.

    Contents are not read.
    """
    found = None
    for k, pattern in enumerate(patterns):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
        files = files.select("path", "length", F.lit(k).alias("pattern"))
        found = files if found is None else found.unionByName(files)
    images = found.where(F.lower("path").rlike(r"\.(png|jpe?g)$"))
    first = F.row_number().over(Window.partitionBy("path").orderBy("pattern"))
    return images.withColumn("_n", first).where("_n = 1").orderBy("pattern", "path").select("path", "length")


def counters_from_text(lines: DataFrame, names: Sequence[str], text: str = "value") -> DataFrame:
    """Counters printed as ``name=123`` or ``name: 123`` in log lines, a column each, null if not there."""
    found = [F.nullif(F.regexp_extract(text, rf"(?:^|\W){n}\s*[=:]\s*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double").alias(n) for n in names]
    return lines.select(*[c for c in lines.columns if c != text], *found)


def with_digest(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds the SHA-256 of each file's bytes."""
    return files.withColumn("sha256", F.sha2(content, 256))
