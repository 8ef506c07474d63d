"""Fill-in-middle: texts cut at two unit boundaries and put into another order.

A unit is a run of ASCII letters or any other single code point. The boundaries
of a text (0, the end of every unit) are kept as a set in the manner of Roaring
bitmaps: the high bits of an offset name a container, the low 16 bits lie in it
as a sorted array, a bitmap or runs, whichever is smallest. Cumulative
cardinalities tell which container holds the k-th boundary, and a select inside
it gives the code point. Both cuts of a text are two such selects.

The cuts depend on the id alone, so a run repeated after a lost executor gives
the same rows. Only the texts go to Python, in Arrow batches, and three numbers
come back; the pieces are put together by column expressions. No shuffle.

Defined results: a null text is empty; a null id is hashed as the empty text;
empty texts and those holding a marker stay plain; repeated rows get the same
cuts; an empty table gives no rows; other columns are carried along, apart from
those named like a result, which it replaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPAN = 1 << 16          # offsets of one container
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")

_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(bool)      # bits of a byte, lowest first
_ONES = _BITS.sum(axis=1)


class ArrayContainer:
    """Offsets one by one."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    @staticmethod
    def cost(count: int, runs: int) -> int:
        return 2 * count

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """One bit for each offset, and the number of bits before every byte."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, dtype=bool)
        bits[low] = True
        self.bytes = np.packbits(bits, bitorder="little")
        self.upto = np.cumsum(_ONES[self.bytes])

    @staticmethod
    def cost(count: int, runs: int) -> int:
        return SPAN // 8

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.upto, k, side="right"))
        before = int(self.upto[at - 1]) if at else 0
        return 8 * at + int(np.flatnonzero(_BITS[self.bytes[at]])[k - before])


class RunContainer:
    """Runs of consecutive offsets, and the number of offsets up to the end of each."""

    def __init__(self, low: np.ndarray):
        first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.start = low[first].astype(np.uint16)
        self.upto = np.append(first[1:], len(low))

    @staticmethod
    def cost(count: int, runs: int) -> int:
        return 4 * runs

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.upto, k, side="right"))
        return int(self.start[at]) + k - (int(self.upto[at - 1]) if at else 0)


KINDS = (ArrayContainer, BitmapContainer, RunContainer)


class BoundarySet:
    """A set of offsets with select, from a sorted array of distinct ones."""

    def __init__(self, offsets: np.ndarray):
        edges = np.searchsorted(offsets, np.arange(0, int(offsets[-1]) + SPAN + 1 if len(offsets) else 1, SPAN))
        self.keys, self.containers, sizes = [], [], []
        for key, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if a < b:
                low = offsets[a:b] - key * SPAN
                runs = int((np.diff(low) != 1).sum()) + 1
                kind = min(KINDS, key=lambda k: k.cost(b - a, runs))  # noqa: B023
                self.keys.append(key)
                self.containers.append(kind(low))
                sizes.append(b - a)
        self.upto = np.cumsum(sizes, dtype=np.int64)

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.upto, k, side="right"))
        return self.keys[at] * SPAN + self.containers[at].select(k - (int(self.upto[at - 1]) if at else 0))


def boundaries(text: np.ndarray) -> BoundarySet:
    """The boundaries of a text given as UTF-8 bytes, in code points."""
    lead = text[(text & 0xC0) != 0x80]
    letter = ((lead | 0x20) - np.uint8(97)) < 26
    inner = np.zeros(len(lead) + 1, dtype=bool)
    inner[1:-1] = letter[1:] & letter[:-1]
    return BoundarySet(np.flatnonzero(~inner))


def _cut(text: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    out = np.zeros((3, len(text)), dtype=np.int64)
    rows = zip(text.cast(pa.large_binary()).to_pylist(), a.to_pylist(), b.to_pylist(), strict=True)
    for i, (t, x, y) in enumerate(rows):
        found = boundaries(np.frombuffer(t or b"", dtype=np.uint8))
        n = len(found)
        x, y = sorted((x % n, y % n))
        out[:, i] = n - 1, found.select(x), found.select(y)
    return pa.StructArray.from_arrays([pa.array(c) for c in out], ["n", "first", "second"])


def cuts(text: Column, a: Column, b: Column) -> Column:
    """struct(n, first, second): units of a text and the code points before its boundaries a and b modulo n + 1."""
    return F.arrow_udf(_cut, "n long, first long, second long")(text, a, b)


def transform(docs: DataFrame, seed: str = "1", rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output.

    ``rate`` percent of the texts are cut, ``spm_rate`` percent of these have the suffix first.
    """
    kept = [c for c in docs.columns if c not in (*RESULTS, "text")]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    text, cut = F.col("text"), F.col("_cut")
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = (F.when((text == "") | marked | (h[2] % 100 >= rate), "plain")
            .when(h[3] % 100 < spm_rate, "spm").otherwise("psm"))
    first, second = cut["first"].cast("int"), cut["second"].cast("int")
    prefix, middle = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first)
    suffix = F.substring(text, second + 1, F.char_length(text))
    output = (F.when(F.col("form") == "plain", text)
              .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)))
    moved = F.col("form") != "plain"
    return (docs.select(*kept, F.coalesce("text", F.lit("")).alias("text"))
            .select(*kept, "text", cuts(text, h[0], h[1]).alias("_cut"), form.alias("form"))
            .select(*kept, "text", cut["n"].alias("n"), "form",
                    F.when(moved, cut["first"]).alias("prefix_chars"),
                    F.when(moved, cut["second"] - cut["first"]).alias("middle_chars"), output.alias("output")))


def restore(output: Column, form: Column) -> Column:
    """The text from output and form alone.

    No piece holds a marker, and a marker neither starts with its own end nor ends with
    its own start, so the first place of each is the one that was put there.
    """
    def piece(start: Column, end: Column | None = None) -> Column:
        return F.substring(output, start, F.char_length(output) if end is None else end - start)

    p, s, m = (F.instr(output, x) for x in (PREFIX, SUFFIX, MIDDLE))
    return (F.when(form == "plain", output)
            .when(form == "psm", F.concat(piece(p + 3, s), piece(m + 3), piece(s + 3, m)))
            .otherwise(F.concat(piece(p + 3, m), piece(m + 3), piece(s + 3, p))))
