"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``POINTS`` points. Each shard owns ``nodes`` virtual nodes on it; a
row is hashed by its text to a point and belongs to the next node clockwise, so
equal texts go together. A shard takes rows until its bound is reached; the rows
that overflow continue clockwise to the next node whose shard has room. Bounds
are floor(n / shards) or one more, so counts are at most one apart (law
``rows``), and a shard added moves about its own share of rows and few others.

Rows meet the ring in a fixed order: by point, then salt, text hash and id. The
driver sees one count for each point (``POINTS`` numbers, whatever the input)
and walks the ring over these counts; each point's rows are then numbered by
windows over (point, salt). Salts come from the id, so that a text that a third
of all rows share is numbered by ``SALTS`` tasks.

Defined results: a null text has size 1 and the crc32 of the empty text; null
ids and repeated rows are placed like any other; an empty table gives no rows;
columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

POINTS = 4096       # points on the ring
SALTS = 64


def ring(shards: int, nodes: int = 32) -> list[int]:
    """The shard that owns each point: that of the next virtual node clockwise."""
    owner: dict[int, int] = {}
    for s in range(shards):
        got = i = 0
        while got < nodes:
            place = xxhash.xxh64_intdigest(f"{s}:{i}") % POINTS
            i += 1
            if place not in owner:
                owner[place], got = s, got + 1
    out, now = [0] * POINTS, owner[min(owner)]
    for p in range(POINTS - 1, -1, -1):
        now = owner.get(p, now)
        out[p] = now
    return out


def walk(counts: list[int], shards: int, nodes: int = 32) -> list[tuple[int, int, int, int, int]]:
    """Place the rows of every point: (point, first row, end row, shard, first slot).

    A point's rows stay with their own shard as far as its bound goes; the rest go on
    clockwise, from node to node.
    """
    if shards * nodes > POINTS:
        raise ValueError("more virtual nodes than points")
    total, owner = sum(counts), ring(shards, nodes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    #: The shards that a row meets from each point on, each once.
    route: list[list[int]] = [[] for _ in range(POINTS)]
    seen: list[int] = []
    for p in range(2 * POINTS - 1, -1, -1):
        s = owner[p % POINTS]
        seen = [s] + [x for x in seen if x != s]
        if p < POINTS:
            route[p] = seen
    first = [0] * POINTS
    out = []
    for turn in range(shards):
        for p in range(POINTS):
            s = route[p][turn]
            n = min(counts[p] - first[p], room[s] - used[s])
            if n > 0:
                out.append((p, first[p], first[p] + n, s, used[s]))
                used[s] += n
                first[p] += n
    return out


def assign_shards(docs: DataFrame, shards: int = 8, nodes: int = 32) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    rows = rows.withColumn("point", F.pmod(F.shiftrightunsigned("h", 40), F.lit(POINTS)).cast("int"))
    salted = rows.groupBy("point", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("point").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = np.zeros(POINTS, dtype=np.int64)
    for r in salted.groupBy("point").agg(F.sum("n").alias("n")).collect():
        counts[r["point"]] = r["n"]
    plan = spark.createDataFrame(walk(counts.tolist(), shards, nodes),
                                 "point int, lo long, hi long, shard int, base long")
    order = Window.partitionBy("point", "salt").orderBy("h", "doc_id", "size", "text_crc32")
    placed = (rows.withColumn("n", F.row_number().over(order))
              .join(offsets, ["point", "salt"])                     # at most POINTS * SALTS rows
              .withColumn("at", F.col("before") + F.col("n") - 1))
    return (placed.join(F.broadcast(plan), (placed["point"] == plan["point"]) & (placed["at"] >= plan["lo"])
                        & (placed["at"] < plan["hi"]))             # at most POINTS * shards rows
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("base") + F.col("at") - F.col("lo")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
