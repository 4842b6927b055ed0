"""Reading exports: format, encoding and delimiter detection, tolerant parsing, flat columns."""

from __future__ import annotations

import csv
import os
import uuid
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tesserae.sources import xlsx

# File endings that can be read, the largest upload, and delimiters.
ENDINGS = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet", ".xlsx": "xlsx", ".xls": "xlsx"}
MOST_BYTES = 200 * 1024 * 1024
DELIMITERS = ",\t;|"


def ending(path: str) -> str:
    kind = ENDINGS.get(os.path.splitext(path)[1].lower())
    if kind is None:
        raise ValueError(f"no reader for {path}")
    return kind


def data_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the data files of a folder by name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    found = [(f.getPath().toString(), f.getLen()) for f in there if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    return sorted(found)


def checked_upload(spark: SparkSession, path: str, most: int = MOST_BYTES) -> str:
    """The format of an upload; refuses unknown endings and what is larger than ``most``."""
    kind = ending(path)
    size = sum(n for _, n in data_files(spark, path))
    if size > most:
        raise ValueError(f"{path} has {size} bytes, over the limit of {most}")
    return kind


def head(spark: SparkSession, path: str, size: int = 65_536) -> bytes:
    """The first bytes of a file, or of a folder's first file, read through Hadoop so that any store will do.

    A file with the ending of a codec is unpacked, as Spark's readers do.
    """
    files = data_files(spark, path)
    if not files:
        return b""
    p = spark._jvm.org.apache.hadoop.fs.Path(files[0][0])
    conf = spark._jsc.hadoopConfiguration()
    stream, codec = p.getFileSystem(conf).open(p), spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
    stream = codec.createInputStream(stream) if codec is not None else stream
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


# Letters beyond ASCII that texts in Western and in Central European languages use.
WESTERN = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
CENTRAL = "áâăäąćčçďđéęěëíîĺľłńňóôőöŕřśšşťţůúűüýźžż"
#: Encodings that Spark's own reader knows; others are read as bytes and decoded per cell.
READABLE = ("UTF-8", "UTF-16", "UTF-16LE", "UTF-16BE", "ISO-8859-1")


def _without_mark(data: bytes) -> str | None:
    """UTF-16 without a byte order mark: nearly all bytes of one half are zero."""
    if len(data) < 4:
        return None
    even, odd = data[0::2].count(0) / len(data[0::2]), data[1::2].count(0) / len(data[1::2])
    return "UTF-16LE" if odd > 0.4 > 5 * even else "UTF-16BE" if even > 0.4 > 5 * odd else None


def _fit(text: str, usual: str) -> float:
    """How well high letters fit: usual ones for, and signs or odd letters next to letters against, in pairs of neighbours."""
    total = 0.0
    for before, c, after in zip(" " + text, text, text[1:] + " ", strict=False):
        if ord(c) > 127:
            inside = before.isalpha() + after.isalpha()
            upper = c.isupper() and before.islower()
            rare = c in "õÕ" and after not in "eE"  # õ stands before e in Western texts; elsewhere the byte is ő, as a rule
            total += 1 + inside if c.lower() in usual and not upper and not rare else -1 - inside if c.isalpha() or inside else 0.2 if c.isprintable() else -2
    return total


def _japanese(data: bytes) -> float:
    """How well bytes read as Shift-JIS: kana and common ideographs for, half-width pairs and failures against."""
    for cut in range(2):
        try:
            text = data[: len(data) - cut].decode("shift_jis")
        except UnicodeDecodeError:
            continue
        kana = sum("\u3040" <= c <= "\u30ff" for c in text)
        wide = sum("\u4e00" <= c <= "\u9fff" for c in text)
        half = sum("\uff61" <= c <= "\uff9f" for c in text)
        return 2.0 * kana + 0.5 * wide - 2.0 * half if kana + wide else -1.0
    return float("-inf")


def encoding_of(data: bytes) -> str:
    """By byte order mark, zero bytes, and UTF-8 if it decodes (a cut last letter aside); else what fits best.

    Shift-JIS, Central European (ISO-8859-2) and Western (Windows-1252, or ISO-8859-1 where no byte tells the two
    apart) are told by how the high letters sit among their neighbours.
    """
    if data.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "UTF-16"
    if found := _without_mark(data):
        return found
    for cut in range(4):
        try:
            data[: len(data) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            continue
    western, central = _fit(data.decode("cp1252", "replace"), WESTERN), _fit(data.decode("iso-8859-2"), CENTRAL)
    if _japanese(data) > max(western, central, 0):
        return "Shift_JIS"
    if central > western:
        return "ISO-8859-2"
    return "windows-1252" if any(0x80 <= b < 0xA0 for b in data) else "ISO-8859-1"


def _decoded(encoding: str) -> Callable[[Column], Column]:
    """Cells that were read byte by byte, in ``encoding``."""

    @F.pandas_udf(StringType())
    def decode(cells: pd.Series) -> pd.Series:
        return cells.map(lambda t: t.encode("latin-1").decode(encoding, "replace"), na_action="ignore")

    return decode


def delimiter_of(text: str) -> str:
    """The delimiter in the header; where it has several, or none, what the first rows look like."""
    counts = Counter(c for c in text.split("\n", 1)[0] if c in DELIMITERS)
    if len(counts) == 1:
        return next(iter(counts))
    try:
        return csv.Sniffer().sniff(text[:8192], "".join(counts) or DELIMITERS).delimiter
    except csv.Error:
        return counts.most_common(1)[0][0] if counts else ","


def read_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A CSV file with a header; rows with too many cells are skipped, short rows get nulls.

    One more column than the header has catches the surplus cells of long rows. Cells with nothing in them are null and
    quoted empty ones are empty: what stands for null while Spark parses is drawn anew, so no cell can hold it. Quotes
    escape themselves; Spark's own default there is the letter NUL, which it then drops from quoted cells.
    """
    data = head(spark, path)
    encoding = encoding_of(data)
    text = data.decode(encoding, "replace").lstrip("﻿")
    sep = sep or ("\t" if path.lower().endswith(".tsv") else delimiter_of(text))
    names = next(csv.reader(text.splitlines() or [""], delimiter=sep), [])
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names) + 1)])
    direct = encoding in READABLE
    raw = spark.read.csv(
        path, schema=schema, sep=sep, encoding=encoding if direct else "ISO-8859-1", header=True, multiLine=True, quote='"', escape='"', charToEscapeQuoteEscaping='"',
        nullValue=uuid.uuid4().hex, mode="PERMISSIVE", enforceSchema=True,
    )
    kept = raw.where(F.coalesce(F.col(f"c{len(names)}"), F.lit("")) == "")
    cell = (lambda c: c) if direct else _decoded(encoding)
    return kept.select(*[cell(F.col(f"c{i}")).alias(n.strip()) for i, n in enumerate(names) if n.strip()])


def flattened(df: DataFrame) -> DataFrame:
    """Structs as dotted columns, at any depth."""

    def leaves(schema: StructType, path: tuple[str, ...] = ()):
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, here)
            else:
                yield here

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in leaves(df.schema)])


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return flattened(spark.read.json(path, mode="DROPMALFORMED"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects; an object's first list of objects, else the object; else JSON lines."""
    whole = spark.read.json(path, multiLine=True, columnNameOfCorruptRecord="_corrupt")
    if "_corrupt" in whole.columns or not whole.columns:
        return read_jsonl(spark, path)
    lists = [f.name for f in whole.schema.fields if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType)]
    if lists and len(whole.limit(2).collect()) == 1:
        return flattened(whole.select(F.inline(f"`{lists[0]}`")))
    return flattened(whole)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    kind = ending(path)
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "json":
        return read_json(spark, path)
    if kind == "jsonl":
        return read_jsonl(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    return xlsx.read(spark, path)


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-1 of a file, by which an upload is known again."""
    return spark.read.format("binaryFile").load(path).select(F.sha1("content")).first()[0]


def demo(spark: SparkSession, rows: int = 300, seed: int = 42) -> DataFrame:
    """A small made-up dataset, the same for the same seed, made by hashes of the row number."""
    number = lambda name, most: F.pmod(F.xxhash64("id", F.lit(f"{name}{seed}")), F.lit(most))
    pick = lambda name, of: F.element_at(F.array(*map(F.lit, of)), number(name, len(of)).cast("int") + 1)
    texts = ("The bridge opens next week #city", "Otra vez llueve en la costa", "Le marché ouvre demain @ana", "Der Zug kommt heute später", "Prices rise again, says @ben #economy")
    return spark.range(rows).select(
        F.format_string("demo_%06d", "id").alias("post_id"),
        F.date_format(F.timestamp_seconds(1_767_225_600 + number("t", 8_640_000)), "yyyy-MM-dd'T'HH:mm:ss").alias("posted_at"),
        pick("a", ("ana", "ben", "chloe", "dmitri", "eve")).alias("author_username"), pick("p", ("forum", "video", "micro")).alias("platform"),
        pick("l", ("en", "es", "fr", "de")).alias("language"), pick("x", texts).alias("text"),
        number("k", 60).alias("like_count"), number("s", 20).alias("share_count"), number("v", 900).alias("view_count"),
    )
