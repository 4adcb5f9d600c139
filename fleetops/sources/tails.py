"""The ends of files, and what has come to them since they were last read: bytes before that aren't read.

Files are listed by Spark, with their lengths and without their contents; each stretch of bytes is one row, dealt to the
tasks, which open the file, go to its place and read no more than it. Nothing about the files is held by the driver.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READ = "path string, length long, start long, end long, text string"


def open_file(path: str) -> BinaryIO:
    """A file of any store that Arrow knows, to be read at any place."""
    from pyarrow import fs

    at = urlsplit(path, allow_fragments=False)
    if at.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(path.removeprefix("file:"))
    store, name = fs.FileSystem.from_uri(quote(path.replace("s3a:", "s3:", 1), safe=":/@"))
    return store.open_input_file(name)


def lengths(spark: SparkSession, path: str, names: str = "*.log") -> DataFrame:
    """path and length of the files; none is opened, and Spark passes over those that are empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names)
    return files.load(path).select("path", "length")


def read_tails(spark: SparkSession, path: str, most: int = 1 << 20, names: str = "*.log", opened: Callable[[str], BinaryIO] = open_file) -> DataFrame:
    """path, length, start, end, text: the last `most` bytes of each file, all of a shorter one. The first line may lack its
    beginning; bytes that are no UTF-8 become U+FFFD. A file that has gone since it was listed has a null text, and one
    that grows meanwhile is read up to the length listed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, length, start in batch.itertuples(index=False):
                try:
                    with opened(name) as file:
                        file.seek(start)
                        text = file.read(length - start).decode("utf-8", "replace")
                except FileNotFoundError:
                    text = None
                yield pd.DataFrame([(name, length, start, length, text)], columns=["path", "length", "start", "end", "text"])

    files = lengths(spark, path, names).withColumn("start", F.greatest(F.lit(0), F.col("length") - most))
    return files.repartition("path").mapInPandas(run, READ)


def read_growth(spark: SparkSession, path: str, known: DataFrame | None = None, piece: int = 4 << 20, names: str = "*.log", opened: Callable[[str], BinaryIO] = open_file) -> DataFrame:
    """path, length, start, end, text: what files hold beyond their known ends, in pieces of about `piece` bytes, each
    from start to end and none between two characters' bytes.

    known: path, end (see `ends`), of files of this path; a file that isn't in it is read from its first byte, and so is
    one that has become shorter. One that is empty now, or gone, gives an empty piece once. The first bytes of a character
    whose rest isn't there yet are left for the next time. A byte that is no UTF-8 becomes ?, so a text has as many bytes
    as its piece. A file that goes after it was listed has no piece. One large file is read by as many tasks as it has
    pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, length, first, a in batch.itertuples(index=False):
                b = min(a + piece, length)
                try:
                    with opened(name) as file:
                        file.seek(a)
                        held = file.read(min(b + 3, length) - a)
                except FileNotFoundError:
                    continue
                skip = 0 if a == first else _inner(held)
                upto = b - a + (0 if b == length else _inner(held[b - a :]))
                decoder = codecs.getincrementaldecoder("utf-8")("surrogateescape")
                text = decoder.decode(held[skip:upto], final=b < length)
                start, end = a + skip, a + upto - len(decoder.getstate()[0])
                text = "".join("?" if "\udc80" <= c <= "\udcff" else c for c in text) if not text.isascii() else text
                if end > start:
                    yield pd.DataFrame([(name, length, start, end, text)], columns=["path", "length", "start", "end", "text"])

    files, before = lengths(spark, path, names), None
    if known is not None:
        before = known.select("path", F.col("end").alias("_end"))
        files = files.join(before, "path", "left").withColumn("first", F.when(F.col("length") >= F.col("_end"), F.col("_end")).otherwise(0))
    else:
        files = files.withColumn("first", F.lit(0).cast("long"))
    stretches = F.sequence("first", F.col("length") - 1, F.lit(piece).cast("long"))
    pieces = files.filter("first < length").select("path", "length", "first", F.explode(stretches).alias("a"))
    read = pieces.repartition("path", "a").mapInPandas(run, READ)
    if before is None:
        return read
    zero = F.lit(0).cast("long")
    blank = before.filter("_end > 0").join(files.select("path"), "path", "left_anti").select("path", *[zero.alias(c) for c in ("length", "start", "end")], F.lit("").alias("text"))
    return read.unionByName(blank)


def _inner(data: bytes) -> int:
    """How many of the first three bytes go on with a character that began before them."""
    return next((i for i, x in enumerate(data[:3]) if x & 0xC0 != 0x80), min(3, len(data)))


def ends(growth: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """path and end after a growth was read: what the next one is to be given. `growth` should be written before, or its
    files are read again, when they may have grown."""
    new = growth.groupBy("path").agg(F.max("end").alias("end"))
    return new if known is None else new.unionByName(known.select("path", "end").join(new.select("path"), "path", "left_anti"))
