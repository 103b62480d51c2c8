"""Readers: texts, JSON documents and lines, EPUB containers, sound files and folders, each with an explicit schema."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum import schemas
from vellum.functions.arrow import arrow_udf
from vellum.functions.text import clean_read, is_http, re, rstrip, stem, strip
from vellum.session import ship


@arrow_udf("string")
def utf8(data: pd.Series) -> pd.Series:
    """UTF-8, with replacement marks where the bytes are none."""
    return data.map(lambda b: bytes(b).decode("utf-8", "replace") if b is not None else None)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, each as one chapter: (path, title, text), the text without blanks at its end and with one line end."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return files.select("path", stem("path").alias("title"), F.concat(rstrip(utf8("content")), F.lit("\n")).alias("text"))


def clean_texts(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned chapters as they are read back."""
    return texts(spark, path).withColumn("text", clean_read("text"))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a file; malformed files give nulls, not an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank and malformed lines and lines that are no objects are passed over."""
    raw = spark.read.text(path).where(strip("value").startswith("{"))
    parsed = raw.select(F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("j"))
    return parsed.where("j IS NOT NULL AND j._corrupt IS NULL").select("j.*").drop("_corrupt")


def epub_items(spark: SparkSession, path: str) -> DataFrame:
    """The items of EPUB files: (path, spine_pos, id, href, media_type, properties, content). One file is opened by one task."""
    from vellum.kernels import epub

    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [{"path": name, **item} for item in epub.items(data)]
                if rows:
                    schema = pa.schema([("path", pa.string()), ("spine_pos", pa.int32()), ("id", pa.string()), ("href", pa.string()), ("media_type", pa.string()), ("properties", pa.string()), ("content", pa.binary())])
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, f"path string, {schemas.EPUB_ITEMS}")


def epub_books(spark: SparkSession, path: str) -> DataFrame:
    """The metadata of EPUB files: (path, title, authors, language, dates, year, contents)."""
    from vellum.kernels import epub

    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for name, data in zip(f["path"], f["content"]):
                _, package, _ = epub.opened(bytes(data))
                entries = [{"pos": i, "title": t, "href": h} for i, (t, h) in enumerate(epub.contents(bytes(data)))]
                rows.append({"path": name, **epub.metadata(package), "contents": entries})
            yield pd.DataFrame(rows)

    return files.mapInPandas(run, f"path string, {schemas.BOOK_META}, contents array<struct<pos:int,title:string,href:string>>")


VOICE_FILE = "name string, ref_audio string, ref_text string, language string, gender string"


def voices(spark: SparkSession, path: str) -> DataFrame:
    """Voice files, one JSON object each: (path, name, ref_audio, ref_text, language, gender, problem).

    A relative sound file stands beside its voice file. ``problem`` tells why a voice cannot be used: no sound file, or none of the text spoken in it."""
    from vellum.functions.fields import gender, language, voice_name

    raw = spark.read.schema(VOICE_FILE).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("path", F.input_file_name())
    audio = F.when(F.col("ref_audio").rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*://)"), F.col("ref_audio")).otherwise(F.concat(re("path", "[^/]*$", ""), "ref_audio"))
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    problem = F.when(blank("ref_audio"), "no_audio").when(blank("ref_text"), "no_text")
    return raw.select("path", voice_name("name", "path").alias("name"), F.when(~blank("ref_audio"), audio).alias("ref_audio"), strip("ref_text").alias("ref_text"), language("language").alias("language"), gender("gender").alias("gender"), problem.alias("problem"))


def probe(data: bytes) -> tuple[bool, int]:
    """(whether it is a mono sound file with any frame, its milliseconds)."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            n, rate = w.getnframes(), w.getframerate()
            return w.getnchannels() == 1 and n > 0, round(n * 1000 / rate) if rate > 0 else 0
    except Exception:
        return False, 0


@arrow_udf("valid boolean, duration_ms bigint", once=True)
def probed(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([probe(bytes(b)) if b is not None else (False, 0) for b in content], columns=["valid", "duration_ms"])


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Sound files of chunks: (chapter_id, chunk_idx, valid, duration_ms), from ``<chapter>/<number>.wav``."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    parts = F.split("path", "/")
    out = files.select(F.get(parts, F.size(parts) - 2).alias("chapter_id"), F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("int").alias("chunk_idx"), probed("content").alias("p"))
    return out.select("chapter_id", "chunk_idx", "p.valid", "p.duration_ms")


def listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Files of a folder tree by pattern, without their contents: (path, name, size, modified), sorted by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", re("path", "^.*/", "").alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy("name")


def remote(sources: DataFrame, column: str) -> DataFrame:
    """Sources that must be fetched, with the key they are kept under; the fetch itself is left to an outer stage."""
    from vellum.functions.text import cache_key

    return sources.where(is_http(column)).withColumn("cache_key", cache_key(column))
