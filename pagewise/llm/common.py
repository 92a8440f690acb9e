"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the ASCII blanks that separate words in the query contracts
BLANKS = " \t\n\x0b\f\r"
WORD_RE = "[^\\x20\\x09-\\x0D]+"
BLANK_RE = "[\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


ARROW_BYTES = 4 << 20
_ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: int = ARROW_BYTES) -> None:
    """Let no Arrow batch that goes to Python hold more than about ``most`` bytes
    (by default 10,000 whole texts make one): what a worker needs at once then does
    not grow with the texts. It stays set in the session."""
    spark.conf.set(_ARROW_LIMIT, str(most))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def is_held_out(doc_id: Column, modulus: int, value: int) -> Column:
    """True where the remainder is ``value``; a null id is never held out."""
    return F.coalesce(remainder(doc_id, modulus) == value, F.lit(False))


def lower_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text after lower-casing A-Z; ``bytes.split`` cuts at
    exactly the blanks of ``BLANKS``."""
    return text.lower().split() if text else []


def text_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column, one value at a time."""
    for v in column.cast(pa.binary()):
        yield v.as_py()


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """``mapInArrow`` function that applies ``fn`` to each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b)
            if out is not None:
                yield out
    return run
