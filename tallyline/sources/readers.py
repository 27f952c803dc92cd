"""Sources: manifests, word lists, subtitles, archives, files by content hash, and text columns of unknown tables."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import looks_spoken

SAMPLE = "id string, video string, reference string, speaker string, session string, label_source string, domain string, sha256 string, split string, articulation string, label_verified boolean, mouth_roi boolean, articulation_verified boolean, start double, end double"
MANIFEST = f"schema_version int, split string, training_overlap_checked boolean, description string, samples array<struct<{SAMPLE.replace(' string', ': string').replace(' boolean', ': boolean').replace(' double', ': double')}>>"


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, samples) of JSON manifests; a document that doesn't parse, or isn't version 1, is an error and never a missing row."""
    raw = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if not raw.where("schema_version is null or schema_version <> 1").isEmpty():
        raise ValueError("a manifest isn't of version 1")
    own = raw.select("split", F.posexplode("samples").alias("ord", "s")).select(F.col("split").alias("manifest_split"), "ord", "s.*")
    return raw.drop("samples"), own.withColumn("start", F.coalesce("start", F.lit(0.0)))


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of every file below a folder, each read once."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length", F.sha2("content", 256).alias("sha256"))


def folder_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("length").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Words of a text file; blank lines and those that begin with # go."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> '' and word not like '#%'")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Single characters among the first fields of a unit file."""
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+")[0].alias("character")).where(F.length("character") == 1).distinct()


def headed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, which may begin with a byte order mark."""
    df = spark.read.option("header", True).csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def seconds(stamp) -> F.Column:  # noqa: ANN001
    """hh:mm:ss,mmm as seconds."""
    part = lambda i: F.regexp_extract(stamp, r"(\d+):(\d+):(\d+)[,.](\d+)", i).cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000


def cues(spark: SparkSession, path: str) -> DataFrame:
    """(file, cue, start, end, text) of subtitle files."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r", "").alias("v"))
    block = raw.select("file", F.posexplode(F.split("v", r"\n[ \t]*\n+")).alias("cue", "b")).withColumn("times", F.regexp_extract("b", r"(\d+:\d+:\d+[,.]\d+ *--> *\d+:\d+:\d+[,.]\d+)", 1)).where("times <> ''")
    ends = F.split("times", " *--> *")
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("b", r"(?s)-->[^\n]*\n(.*)", 1), "<[^>]*>", ""), r"\s+", " "))
    return block.select("file", "cue", seconds(ends[0]).alias("start"), seconds(ends[1]).alias("end"), text.alias("text"))


def zip_members(spark: SparkSession, path: str, names: list[str], most: int) -> DataFrame:
    """(path, name, size, crc32, content) of the named members of ZIP files; members over ``most`` bytes or with a wrong checksum are errors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for at, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if info.filename not in names:
                            continue
                        if info.file_size > most:
                            raise ValueError(f"{info.filename} has over {most} bytes")
                        body = z.read(info)
                        if zlib.crc32(body) != info.CRC:
                            raise ValueError(f"{info.filename} is damaged")
                        rows.append((at, info.filename, len(body), info.CRC, body))
            yield pd.DataFrame(rows, columns=["path", "name", "size", "crc32", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, name string, size long, crc32 long, content binary")


def text_columns(df: DataFrame, sample: int = 300, least_values: int = 5, least_share: float = 0.6) -> DataFrame:
    """(column, share, values, filled): string columns of an unknown table that look like spoken text, best first.

    Each column is judged by ``sample`` of its own values that aren't null, those with the smallest MD5, so the order of rows doesn't matter and a column that is
    null in most rows is judged like any other. filled counts its values. Columns named for formatted text come before others, these before raw
    recognitions; then the larger share, then the fuller column. A table without string columns has no rows."""
    strings = [c for c, t in df.dtypes if t == "string"] or [F.lit(None).cast("string")]
    names = [c if isinstance(c, str) else "" for c in strings]
    pairs = F.array(*(F.struct(F.lit(n).alias("column"), (F.col(f"`{c}`") if isinstance(c, str) else c).alias("value")) for n, c in zip(names, strings, strict=True)))
    long = df.select(F.explode(pairs).alias("x")).select("x.*").where("value is not null")
    ranked = long.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy(F.md5("value"), "value"))).where(F.col("place") <= sample)
    judged = ranked.groupBy("column").agg(F.avg(looks_spoken(F.col("value")).cast("double")).alias("share"), F.count("*").alias("values")).where((F.col("values") >= least_values) & (F.col("share") > least_share))
    rank = F.when(F.col("column").rlike("(?i)format|final|edit|clean"), 0).when(F.col("column").rlike("(?i)asr|raw|transcri"), 2).otherwise(1)
    return judged.join(long.groupBy("column").agg(F.count("*").alias("filled")), "column").orderBy(rank, F.desc("share"), F.desc("filled"), "column")


def asset_plan(assets: DataFrame, mode: str) -> DataFrame:
    """The assets of a mode: those whose groups hold it, and the common ones."""
    return assets.where(F.array_contains("groups", mode) | F.array_contains("groups", "common"))
