"""Readers: texts, pages, media files, transcripts, comments."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions.text import youtube_id

#: Largest size in megabytes and extensions by kind of media.
MEDIA = {
    "audio": (45, ("mp3", "wav", "m4a", "ogg", "flac", "webm", "aac")),
    "image": (8, ("png", "jpg", "jpeg", "webp", "gif", "bmp")),
    "video": (200, ("mp4", "mov", "webm", "mkv", "avi", "m4v")),
}


def texts(spark: SparkSession, path: str) -> DataFrame:
    """One document per text file: path and text."""
    return spark.read.format("text").option("wholetext", True).load(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, size, modified, content and sha256 of any files."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select("path", F.col("length").alias("byte_size"), F.col("modificationTime").alias("modified_at"), "content", F.sha2("content", 256).alias("sha256"))


def media(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Files of a kind within its size and extensions; the filter reaches the scan, so others are not opened."""
    most, endings = MEDIA[kind]
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    df = spark.read.format("binaryFile").load(path).where((F.col("length") <= most * 1024 * 1024) & ext.isin(*endings))
    return df.select("path", F.col("length").alias("byte_size"), "content")


def extract_with(df: DataFrame, content: str, extractor: Callable[[bytes], str], out: str = "text") -> DataFrame:
    """A column of extracted text by a function from bytes to text (a PDF library, a speech or image model); a failure gives null text
    and the error's name in ``<out>_error``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for b in f[content]:
                try:
                    found.append((extractor(bytes(b)).strip(), None))
                except Exception as e:  # the extractor is the caller's: its errors are data
                    found.append((None, type(e).__name__))
            f[out], f[f"{out}_error"] = [x for x, _ in found], [e for _, e in found]
            yield f

    from pyspark.sql.types import StructField, StructType

    schema = StructType([*df.schema.fields, StructField(out, StringType()), StructField(f"{out}_error", StringType())])
    return df.mapInPandas(run, schema)


class _Article(HTMLParser):
    """Text of paragraphs and headings outside of menus and scripts."""

    KEEP = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td figcaption".split())
    DROP = frozenset("script style nav header footer aside form noscript".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.drop = 0
        self.open = False

    def handle_starttag(self, tag, attrs):
        self.drop += tag in self.DROP
        if tag in self.KEEP:
            self.open = True
            self.out.append("")

    def handle_endtag(self, tag):
        self.drop = max(0, self.drop - (tag in self.DROP))
        if tag in self.KEEP:
            self.open = False

    def handle_data(self, data):
        if self.open and not self.drop:
            self.out[-1] += data


def article_text(page: str | None) -> str | None:
    """A page's article; None if it has none."""
    p = _Article()
    p.feed(page or "")
    p.close()
    return "\n".join(t for x in p.out if (t := re.sub(r"\s+", " ", html.unescape(x)).strip())) or None


@F.pandas_udf(StringType())
def article_text_udf(s: pd.Series) -> pd.Series:
    return s.map(article_text)


def articles(pages: DataFrame) -> DataFrame:
    """url, text, and the host, of pages already fetched (url, html)."""
    return pages.select("url", F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)).alias("domain"), article_text_udf("html").alias("text"))


def transcripts(segments: DataFrame) -> DataFrame:
    """Videos' transcripts from segments (url, start, text), in order."""
    part = F.array_sort(F.collect_list(F.struct("start", "text")))
    return segments.groupBy(youtube_id(F.col("url")).alias("video_id")).agg(F.array_join(F.transform(part, lambda s: s["text"]), " ").alias("text"))


def comment_sentiment(comments: DataFrame, compound: str = "compound", order: str | None = None) -> DataFrame:
    """Mean score and label of each video's comments, given a scored column. With ``order`` (a column) the scores are added in that order,
    so that the last digit of a mean, and with it a label at the limit, does not hang on how the rows are dealt."""
    if order is None:
        mean = F.avg(compound)
    else:
        scores = F.transform(F.array_sort(F.collect_list(F.when(F.col(compound).isNotNull(), F.struct(F.col(order).alias("k"), F.col(compound).cast("double").alias("v"))))), lambda s: s["v"])
        mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda t, x: t + x) / F.size(scores))
    label = F.when(F.col("mean") >= 0.05, "positive").when(F.col("mean") <= -0.05, "negative").otherwise("neutral")
    return comments.groupBy("video_id").agg(F.count("*").alias("n"), mean.alias("mean")).withColumn("label", label)
