"""Helpers shared by the operators: words, Arrow batches, group numbering."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns every ASCII byte outside [0-9a-z] into a space; bytes above 0x7F stay.
_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32
               for c in range(256))


def space_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return text.lower().split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; null has none."""
    return text.translate(_ALNUM).split() if text else []


def counter_index() -> defaultdict:
    """A dict that numbers unseen keys 0, 1, 2, ... on lookup."""
    index: defaultdict = defaultdict()
    index.default_factory = index.__len__
    return index


def number(index: defaultdict, items: list) -> np.ndarray:
    return np.fromiter(map(index.__getitem__, items), dtype=np.int64, count=len(items))


def binary_column(batch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def text_slices(batches: Iterable, name: str = "text", max_bytes: int = 2 << 20) -> Iterator:
    """Cut batches so that each holds about ``max_bytes`` of text and at least one row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(name))
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def remainder(doc_id, mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def text_bytes(df: DataFrame, name: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(name))).first()[0] or 0


def even_numbers(spark: SparkSession, n: int) -> list[int]:
    """n integers that Spark's hash partitioner sends to n different partitions.

    Groups numbered by them get one partition each, so no task is left with
    several groups while others stay empty.
    """
    found: dict[int, int] = {}
    lo = 0
    while len(found) < n:
        hi = lo + 16 * n
        rows = (spark.range(lo, hi, numPartitions=1)
                .select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"))
                .groupBy("p").agg(F.min("id").alias("id")).collect())
        for r in rows:
            found.setdefault(r["p"], r["id"])
        lo = hi
    return [found[p] for p in range(n)]


def mix64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit mix of two uint64 arrays (multiply and xor-shift rounds)."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x
