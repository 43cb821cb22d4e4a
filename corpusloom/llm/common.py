"""Shared plumbing of the text operators: Arrow-batched maps that read only the columns they need."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.batches import BATCH_BYTES, bounded, hand_back
from corpusloom.plans.relations import spread

#: Words are runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A table of texts, in pieces for all cores."""
    return spread(read(spark, sf_dir, table))


def map_rows(
    df: DataFrame,
    columns: list[Column],
    make: Callable[[], Callable[..., list]],
    schema: str,
    keep: int,
    args: tuple[int, ...] | None = None,
) -> DataFrame:
    """Map ``df.select(columns)`` batch by batch; the first ``keep`` columns pass through unchanged.

    ``make()`` runs once per task and returns a function from the batch's remaining columns, or those at ``args``,
    (Python lists) to one list per added column. Only the chosen columns are read, so other
    columns of any name never matter.
    """
    src = bounded(df).select(*columns)
    fields = [*src.schema.fields[:keep], *T._parse_datatype_string(schema).fields]
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    arrow = _arrow_schema(out)
    given = range(keep, len(columns)) if args is None else args

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for b in batches:
            fn = fn or make()
            for part in parts(b):
                added = fn(*(part.column(i).to_pylist() for i in given))
                cols = [part.column(i).cast(arrow.field(i).type) for i in range(keep)]
                cols += [pa.array(v, arrow.field(keep + i).type) for i, v in enumerate(added)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)
        fn = part = added = cols = b = None
        hand_back()

    return src.mapInArrow(run, out)


def fold_rows(
    df: DataFrame,
    columns: list[Column],
    make: Callable[[], tuple[Callable[..., Iterator[tuple]], Callable[[], Iterator[tuple]]]],
    schema: str,
) -> DataFrame:
    """Per-task fold: ``make()`` gives (take, finish); both yield tuples of output rows.

    ``take`` sees the batch's columns and may yield rows early (to bound memory); ``finish``
    yields what is left at the end of the task.
    """
    src = bounded(df).select(*columns)
    out = T._parse_datatype_string(schema)
    arrow = _arrow_schema(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, finish = make()

        def rows() -> Iterator[tuple]:
            for b in batches:
                for part in parts(b):
                    yield from take(*(part.column(i).to_pylist() for i in range(part.num_columns)))
            yield from finish()

        held: list[tuple] = []
        for r in rows():
            held.append(r)
            if len(held) >= 20_000:
                yield batch(held)
                held = []
        if held:
            yield batch(held)
        take = finish = held = None
        hand_back()

    return src.mapInArrow(run, out)


def parts(batch: pa.RecordBatch, rows: int = 1000, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows, and of ``size`` bytes of text where a single row is not larger."""
    held = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            held += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(held)])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, min(at + rows, int(np.searchsorted(upto, upto[at] + size, "right")) - 1))
        yield batch.slice(at, end - at)
        at = end


def row_key(id_col: str, text_col: str, digest: Column | None = None) -> list[Column]:
    """Columns _id and _digest, without nulls, that are equal for two rows only if both id and text are equal or both null.

    The text counts by its SHA-256 (``digest``, if it is known already); null differs from every text and id.
    """
    return [
        F.coalesce(F.concat(F.lit("+"), F.col(id_col).cast("string")), F.lit("-")).alias("_id"),
        F.coalesce(F.unhex(F.sha2(F.col(text_col), 256)) if digest is None else digest, F.unhex(F.lit(""))).alias("_digest"),
    ]


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def bucket(col: Column, mod: int) -> Column:
    """crc32(value as text) mod ``mod``; null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % mod


def spans_text(spans: list[tuple[int, int, int, str]]) -> str:
    """kind:start:end, by start and then kind order, comma-joined. spans: (start, order, end, kind)."""
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


#: Classes of the character table.
LOWER, UPPER, OTHER_LETTER, DIGIT, SPACE, PUNCT, SYMBOL, REST = range(8)
N_CLASSES = 8


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of each code point, by its Unicode category; built once per worker."""
    import unicodedata

    kind = {"Ll": LOWER, "Lu": UPPER, "Lt": UPPER, "Nd": DIGIT, "Zs": SPACE, "Zl": SPACE, "Zp": SPACE}
    first = {"L": OTHER_LETTER, "M": OTHER_LETTER, "N": DIGIT, "P": PUNCT, "S": SYMBOL}
    table = np.full(0x110000, REST, np.uint8)
    for cp in range(0x110000):
        if 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4 or 0x20000 <= cp < 0x33480:
            continue
        c = unicodedata.category(chr(cp))
        if c != "Cn":
            table[cp] = kind.get(c, first.get(c[0], REST))
    table[0x3400:0xA000] = table[0xAC00:0xD7A4] = table[0x20000:0x33480] = OTHER_LETTER
    table[9:14] = SPACE
    for c in "#*$%&|<>":
        table[ord(c)] = SYMBOL
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
