"""Uploaded images as an evidence ledger: hash, format, size, verdict.  Bytes are not kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions.text import let


def read_images(spark: SparkSession, path: str, names: str | None = None, most_bytes: int | None = None, since: str | None = None) -> DataFrame:
    """Files of a folder and those below it: ``path, modificationTime, length, content``.

    File names by a glob pattern, a greatest length and an earliest time of change leave files out before their content is
    read: the source itself prunes by them.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", names) if names else reader).load(path)
    if most_bytes is not None:
        files = files.filter(F.col("length") <= most_bytes)
    return files if since is None else files.filter(F.col("modificationTime") >= F.lit(since).cast("timestamp"))


def _hex(content: Column, offset: int, size: int) -> Column:
    return F.hex(F.substring(content, offset + 1, size))


def _ascii(text: str) -> str:
    return text.encode("ascii").hex().upper()


def image_format(content: Column) -> Column:
    """The format by leading bytes; null for anything else."""
    head = _hex(content, 0, 8)
    return (
        F.when(head == "89504E470D0A1A0A", "png").when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("424D"), "bmp").when(head.startswith("49492A00"), "tiff-le")
        .when(head.startswith("4D4D002A"), "tiff-be")
        .when(head.startswith(_ascii("RIFF")) & (_hex(content, 8, 4) == _ascii("WEBP")), "webp")
    )


def _big(content: Column, offset: int, size: int) -> Column:
    return F.conv(_hex(content, offset, size), 16, 10).cast("bigint")


def _little(content: Column, offset: int, size: int) -> Column:
    return sum((_big(content, offset + i, 1) * (256 ** i) for i in range(size)), F.lit(0).cast("bigint"))


def _signed(value: Column) -> Column:
    return F.abs(F.when(value >= 2 ** 31, value - 2 ** 32).otherwise(value))


def dimensions(content: Column, kind: Column) -> Column:
    """Width and height where the header has them at a fixed place (PNG, BMP, WebP)."""
    size = F.length(content)
    chunk = _hex(content, 12, 4)
    pair = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    packed = lambda w: F.struct(w.alias("bits"))
    bits = _little(content, 21, 4)
    return (
        F.when((kind == "png") & (size >= 24) & (chunk == _ascii("IHDR")), pair(_big(content, 16, 4), _big(content, 20, 4)))
        .when((kind == "bmp") & (size >= 26), pair(_signed(_little(content, 18, 4)), _signed(_little(content, 22, 4))))
        .when((kind == "webp") & (size >= 30) & (chunk == _ascii("VP8X")),
              pair(_little(content, 24, 3) + 1, _little(content, 27, 3) + 1))
        .when((kind == "webp") & (size >= 30) & (chunk == _ascii("VP8 ")),
              pair(_little(content, 26, 2) % 16384, _little(content, 28, 2) % 16384))
        .when((kind == "webp") & (size >= 30) & (chunk == _ascii("VP8L")) & (_hex(content, 20, 1) == "2F"),
              let(packed(bits), lambda b: pair(
                  b["bits"] % 16384 + 1, F.floor(b["bits"] / 16384).cast("bigint") % 16384 + 1)))
    )


def image_ledger(images: DataFrame) -> DataFrame:
    """One row per image file; ``images(path, content)`` and, if known, ``ocr_text``."""
    text = F.col("ocr_text") if "ocr_text" in images.columns else F.lit(None).cast("string")
    rows = images.select(
        "path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("bigint").alias("byte_length"),
        image_format(F.col("content")).alias("format"), "content", text.alias("extracted_text"),
    ).withColumn("_d", dimensions(F.col("content"), F.col("format")))
    pixels = F.col("_d.width") * F.col("_d.height")
    ident = F.concat(F.lit("image:"), F.substring("sha256", 1, 24))
    return rows.select(
        ident.alias("image_id"), "path", "sha256", "byte_length", "format",
        F.col("_d.width").alias("width"), F.col("_d.height").alias("height"), "extracted_text",
        F.when(F.col("byte_length") == 0, "empty").when(F.col("format").isNull(), "unsupported")
        .when((F.col("_d.width") < 1) | (F.col("_d.height") < 1) | (pixels > K.MAX_IMAGE_PIXELS), "too_large")
        .otherwise("accepted").alias("verdict"),
        F.array(ident, F.concat(ident, F.lit(":ocr"))).alias("evidence_ids"),
    )


def duplicate_images(ledger: DataFrame) -> DataFrame:
    """How often the same bytes were uploaded, and where first (no list of copies is built)."""
    return ledger.groupBy("sha256").agg(
        F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path")).filter(F.col("copies") > 1)
