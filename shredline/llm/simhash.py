"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint is cut into 16 segments of 4 bits and mapped to the vector of its
segments' bit counts. The Manhattan distance of two such vectors is a lower
bound of the fingerprints' Hamming distance. Fingerprints within ``RADIUS`` = 2
bits therefore have vectors within distance 2 on the integer grid, and two such
grid points always share a grid cell at distance 1 or less from both. Every
distinct fingerprint is put into its own cell and the (at most 32) cells beside
it; fingerprints that share a cell are candidates and are verified by XOR.

A cell is compared by lags (each member with the next, the one after, ...). Up
to ``DENSE`` members it is done so; the members of larger cells are linked
exactly by bit flips instead: two fingerprints within 2 bits share one of the
65 words within 1 bit of each, and all holders of such a word link to the
smallest. No pair list is ever built, and no link is lost.

Exact copies share a fingerprint and meet as one row. Links are contracted in
each task to a forest before the components are joined up in Spark.

Defined results: a null, empty or wordless text has fingerprint zero; texts of
one or two words have one shingle, the whole; repeated rows are returned as
often as they stand; null ids never become a component's id unless it holds no
other; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shredline.llm.common import binary_column, space_words, text_slices
from shredline.session import ensure_checkpoint_dir

RADIUS = 2
SEGMENTS, WIDTH = 16, 4     # segments and bits of each
DENSE = 1024                # members from which a cell is linked by bit flips


def shingle_hashes(words: list[bytes], k: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of every k-word shingle, repeats included; shorter sequences are one shingle."""
    if not words:
        return []
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [h(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[k - 1:].tolist())]


def fingerprints(texts: list[bytes | None], k: int = 3) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if it is set in over half of the text's shingle hashes."""
    out = np.zeros(len(texts), dtype=np.uint64)
    rows, hashes, sizes = [], [], []

    def settle():
        if rows:
            bits = np.unpackbits(np.concatenate(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            n = np.array(sizes)
            counts = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int64)
            out[rows] = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
            rows.clear(), hashes.clear(), sizes.clear()

    for i, text in enumerate(texts):
        got = shingle_hashes(space_words(text), k)
        if got:
            rows.append(i)
            hashes.append(np.array(got, dtype=np.uint64))
            sizes.append(len(got))
            if sum(sizes) > 1 << 17:
                settle()
    settle()
    return out


def fingerprint_table(docs: DataFrame, k: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``carry`` and fp (signed 64-bit) of every row."""
    names = ["doc_id", *carry]
    docs = docs.select(*names, "text")
    kinds = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in names)

    def run(batches):
        for part in text_slices(batches):
            fp = fingerprints(binary_column(part, "text"), k).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fp)], names=[*names, "fp"])

    return docs.mapInArrow(run, f"{kinds}, fp long")


def popcount_cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of each fingerprint (its own and those beside it) and whose they are."""
    x = fp.view(np.uint64)
    segments = np.stack([np.bitwise_count((x >> np.uint64(WIDTH * s)) & np.uint64((1 << WIDTH) - 1))
                         for s in range(SEGMENTS)], axis=1).astype(np.int64)
    unit = np.int64(1) << (3 * np.arange(SEGMENTS, dtype=np.int64))      # a count of 0 to 4 takes 3 bits
    own = segments @ unit
    who = np.arange(len(fp))
    cells, of = [own], [who]
    for s in range(SEGMENTS):
        up, down = segments[:, s] < WIDTH, segments[:, s] > 0
        cells += [own[up] + unit[s], own[down] - unit[s]]
        of += [who[up], who[down]]
    return np.concatenate(cells), np.concatenate(of)


class Forest:
    """Union-find over the places of an array; the smaller place is the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def flat(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if (q == p).all():
                return p
            p = self.parent = q

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[i] with b[i]."""
        while True:
            roots = self.flat()
            x, y = roots[a], roots[b]
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            x, y = x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def link_cells(cells: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span the same groups as all verified pairs inside the cells; cells are sorted."""
    distinct, node = np.unique(fps, return_inverse=True)
    heads = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    sizes = np.diff(np.append(heads, len(cells)))
    rest = np.repeat(heads + sizes, sizes) - np.arange(len(cells))      # members from here to the cell's end
    forest, x, lag = Forest(len(distinct)), fps.view(np.uint64), 1
    active = np.flatnonzero(rest > 1)
    while len(active):
        near = active[np.bitwise_count(x[active] ^ x[active + lag]) <= RADIUS]
        if len(near):
            forest.join(node[near], node[near + lag])
        lag += 1
        active = active[rest[active] > lag]
    root = forest.flat()
    linked = np.flatnonzero(root != np.arange(len(distinct)))
    return distinct[linked], distinct[root[linked]]


def _cells(batches):
    for part in batches:
        fp = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo in range(0, len(fp), 1 << 14):
            cells, of = popcount_cells(fp[lo:lo + (1 << 14)])
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(fp[lo:lo + (1 << 14)][of])],
                                             names=["cell", "fp"])


def _links(batches):
    """Sorted (cell, fp) rows to links; members of dense cells come out as (fp, null)."""
    def out(a, b, dense):
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([a, dense])),
            pa.array(np.concatenate([b, dense]), mask=np.arange(len(a) + len(dense)) >= len(a))], names=["a", "b"])

    none = np.empty(0, np.int64)
    keep_cell, keep_fp, flooded = none, none, None     # the last cell may go on in the next batch
    for part in batches:
        cells = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        fps = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        if flooded is not None:
            own = cells == flooded
            if own.any():
                yield out(none, none, fps[own])
                cells, fps = cells[~own], fps[~own]
            if len(cells):
                flooded = None
        if not len(cells):
            continue
        cells, fps = np.concatenate([keep_cell, cells]), np.concatenate([keep_fp, fps])
        heads = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        sizes = np.diff(np.append(heads, len(cells)))
        last = heads[-1]
        dense = np.repeat(sizes > DENSE, sizes)
        closed = np.arange(len(cells)) < last
        if sizes[-1] > DENSE:
            flooded, closed[last:] = cells[-1], True
            keep_cell, keep_fp = none, none
        else:
            keep_cell, keep_fp = cells[last:], fps[last:]
        a, b = link_cells(cells[closed & ~dense], fps[closed & ~dense])
        yield out(a, b, fps[closed & dense])
    if len(keep_cell):
        yield out(*link_cells(keep_cell, keep_fp), none)


def near_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) with a > b over distinct fingerprints (column fp), spanning all pairs within RADIUS bits."""
    n = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = (nodes.mapInArrow(_cells, "cell long, fp long").repartition(n, "cell").sortWithinPartitions("cell")
             .mapInArrow(_links, "a long, b long").distinct().checkpoint())
    flips = F.array(F.col("a"), *[F.col("a").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long"))
                                  for i in range(64)])
    dense = found.where(F.col("b").isNull()).select("a")
    stars = (dense.select("a", F.explode(flips).alias("word")).groupBy("word")     # at most 65 holders of a word
             .agg(F.collect_set("a").alias("held")).where(F.size("held") > 1)
             .select(F.explode("held").alias("a"), F.array_min("held").alias("b")).where("a <> b").distinct())
    return found.where(F.col("b").isNotNull()).unionByName(stars)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node that isn't itself the smallest of its component.

    Alternates the large-star and small-star steps until nothing changes; each
    round is written to the checkpoint folder.
    """
    ensure_checkpoint_dir(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = (large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                                                F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
                                               .alias("e")).select("e.*").where("u <> v").distinct().checkpoint())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def classes_of(prints: DataFrame) -> DataFrame:
    """fp, root (the component's smallest linked fingerprint) and component_id of every distinct fingerprint."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(near_links(prints.select("fp").distinct()))
    rooted = (nodes.join(roots, nodes["fp"] == roots["node"], "left")
              .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(lows, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links of 2 or fewer bits) of every row."""
    ensure_checkpoint_dir(docs.sparkSession)
    prints = fingerprint_table(docs, k).checkpoint()
    return prints.join(classes_of(prints), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, k: int = 3) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id.

    Of rows of one component that repeat this id the text with the smallest hash
    stays, and of rows that repeat this text too the one with the smallest hash. An
    id on texts of several components stays once for each of them that it leads.
    Of a component whose rows all have a null id one row stays, chosen likewise;
    null ids in other components go.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    key = F.xxhash64("text").alias("key")
    prints = fingerprint_table(docs.select("doc_id", key, "text"), k, ("key",)).checkpoint()
    leads = (prints.join(classes_of(prints), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
             .groupBy("root", "doc_id", "key").agg(F.count("*").alias("n")))
    kept = (leads.groupBy("root", "doc_id").agg(F.min("key").alias("key"), F.min_by("n", "key").alias("n"))
            .select("root", F.col("doc_id").alias("lead"), F.col("key").alias("lead_key"), "n").checkpoint())
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", key)
    on = F.col("doc_id").eqNullSafe(F.col("lead")) & (F.col("key") == F.col("lead_key"))
    if kept.where("n > 1").isEmpty():
        return rows.join(kept, on, "left_semi").select("row.*")
    whole = F.xxhash64(F.to_json("row"))                # whole rows are shuffled again, so only if leading rows do repeat
    return rows.join(kept, on).groupBy("root").agg(F.min_by("row", whole).alias("row")).select("row.*")
