"""Conversation prefix trie: shared prefixes as nodes, subtree sums by centroid decomposition.

**Sequences.** A turn is (role, text), named by 120 bits of SHA-256. A prefix of
d turns is named by its length and two 64-bit sums (XOR) of hashes of its (turn,
place) pairs, so a node's parent is known without a join and running values over
a conversation are enough: they are spread over range partitions
(:mod:`shredline.operators.running`), so that one conversation may hold any share
of all rows. Texts are read once and never shuffled.

**Nodes.** One aggregate with partial sums gives every node its members' number
and smallest id. The smallest member and the depth name a node, too. The rows at
or below a node (members times turns left) are additive over subtrees and known
before any rollup; they are the weights of the decomposition.

**Rollup.** The centroid of a component is its deepest node that holds more than
half of the weight: what is above it and each of its children's subtrees hold at
most half. The totals of the centroid's part (itself and below) are added to
every node on the path from the centroid to the component's top; these nodes also
lose the part's weight, and the components left are split again. A node and any
node below it are parted exactly once, by a centroid on the path between them, so
every sum is whole. Components of more than ``limit`` nodes are split by joins
(all at once, each round halves their weights); the others are sorted together
and streamed through tasks that split many of them at once with the same steps.

Defined results: null roles and texts are empty; a null turn comes first, rows of
the same turn follow by the digest of (role, text); repeated rows are turns of
their own; rows without a conv_id belong to no conversation; an empty table gives
no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shredline.operators.running import running, spread
from shredline.session import ensure_checkpoint_dir

LIMIT = 50_000          # nodes of a component that a task splits by itself
RUN_BITS = 12           # ids that differ in so many low bits are packed into one string

KEY = ["depth", "z1", "z2"]
VALUES = ["leaves", "saved"]
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "z1", "z2"]


def _stored(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read again."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/trie-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _marks(turn: Column, place: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a turn at a place."""
    return F.xxhash64(turn["a"], turn["b"], place), F.xxhash64(place, turn["b"], turn["a"], F.lit(1))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, and t: the turn's digest (a, b) and its words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    part = [F.conv(F.substring(digest, i, 15), 16, 10).cast("long") for i in (1, 16)]
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.struct(part[0].alias("a"), part[1].alias("b"), words.cast("long").alias("words")).alias("t"))


def rebuilt_prefixes(conversations: DataFrame, stride: int = 20, most: int = 4) -> DataFrame:
    """One row for each rebuilt conversation and prefix (also the empty one).

    Conversation c begins with the first h = crc32(c) % ``most`` turns of conversation c - c % ``stride``,
    then come its own turns after its first h. Columns: conv_id, depth, length (of the whole
    conversation), z1, z2, p1, p2 (the same of the prefix one turn shorter), words (of the last turn).
    """
    order = [F.col("turn").asc_nulls_first(), F.col("t.a").asc(), F.col("t.b").asc()]
    rows = running(spread(turn_rows(conversations), ["conv_id"], order), ["conv_id"], order, {"place": ("count", F.lit(1))})
    rows = _stored(rows.drop("turn"))
    heads = (rows.where((F.col("place") < most) & (F.col("conv_id") % stride == 0))
             .groupBy(F.col("conv_id").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("place", "t"))).alias("head")))       # fewer than `most` turns
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    convs = (rows.groupBy("conv_id").agg(F.count("*").alias("own"))
             .withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % stride})
             .join(heads, "base", "left")
             .withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), 1, F.col("h").cast("int")))
             .withColumns({"kept": F.size("head").cast("long"), "length": F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))}))
    convs = _stored(convs.select("conv_id", "h", "head", "kept", "length"))

    def total(upto: Column, i: int) -> Column:
        """Mark i of the first ``upto`` turns of the head."""
        return F.aggregate(F.slice(F.col("head"), 1, upto.cast("int")), F.lit(0).cast("long"),
                           lambda z, x: z.bitwiseXOR(_marks(x["t"], x["place"])[i]))

    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), "length", *[zero.alias(c) for c in ("z1", "z2", "p1", "p2", "words")])
    at = F.col("x.place")
    first = convs.select("*", F.explode("head").alias("x")).select(
        "conv_id", at.alias("depth"), "length", total(at, 0).alias("z1"), total(at, 1).alias("z2"),
        total(at - 1, 0).alias("p1"), total(at - 1, 1).alias("p2"), F.col("x.t.words").alias("words"))
    own = (rows.join(convs.select("conv_id", "h", "kept", "length", *[
               total(F.col("kept"), i).alias(f"s{i}") for i in (0, 1)]), "conv_id")
           .where(F.col("place") > F.col("h")).withColumn("depth", F.col("place") - F.col("h") + F.col("kept")))
    m1, m2 = _marks(F.col("t"), F.col("depth"))
    order = [F.col("depth").asc()]
    own = running(own.select("_part", "conv_id", "depth", "length", F.col("t.words").alias("words"), "s0", "s1",
                             m1.alias("m1"), m2.alias("m2")), ["conv_id"], order,
                  {"x1": ("bit_xor", F.col("m1")), "x2": ("bit_xor", F.col("m2"))})
    z1, z2 = F.col("s0").bitwiseXOR(F.col("x1")), F.col("s1").bitwiseXOR(F.col("x2"))
    own = own.select("conv_id", "depth", "length", z1.alias("z1"), z2.alias("z2"),
                     z1.bitwiseXOR(F.col("m1")).alias("p1"), z2.bitwiseXOR(F.col("m2")).alias("p2"), "words")
    return _stored(roots.unionByName(first).unionByName(own))


def trie_nodes(prefixes: DataFrame) -> DataFrame:
    """One row for each node: NODE, words (of the last text), weight (rows at or below)."""
    nodes = _stored(prefixes.groupBy(*KEY, "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("words").alias("words"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight")))
    below = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("z1"), F.col("p2").alias("z2"))
    children = below.groupBy(*KEY).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("z1").alias("p1"), F.col("z2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(children, KEY, "left").join(parents, ["depth", "p1", "p2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                    "z1", "z2", "words", "weight"))


def members_digest(prefixes: DataFrame) -> DataFrame:
    """KEY and ends_sha256 of the nodes where conversations end.

    Ids are packed into strings of at most 2^RUN_BITS ids first; a task then reads a node's strings in
    order and feeds them to the hash, so only the digest's state is held.
    """
    packed = (prefixes.where("depth = length").groupBy(*KEY, F.shiftright("conv_id", RUN_BITS).alias("run"))
              .agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")))
    ordered = packed.repartition(*KEY).sortWithinPartitions(*KEY, "run")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for *own, ids in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*KEY, "ids")), strict=True):
                if own != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _batch(out)
            out = []
        if key is not None:
            yield _batch([(*key, state.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {c: pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i, c in enumerate([*KEY, "ends_sha256"])})

    return ordered.mapInArrow(digest, "depth long, z1 long, z2 long, ends_sha256 string")


def split_components(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of ``values`` (one row for each value) by centroid decomposition.

    parent: index of the parent, -1 for a component's top; weight: sum of positive weights over
    the node's part of its component. All components are split at once, round by round.
    """
    n = len(parent)
    weight, sums, home = weight.copy(), np.zeros_like(values), np.arange(n)
    todo = np.argsort(depth, kind="stable")
    for level in _levels(depth, todo):
        inner = level[parent[level] >= 0]
        home[inner] = home[parent[inner]]                  # a component is named by its top
    centroid, under = np.full(n, -1), np.zeros(n, dtype=bool)
    while len(todo):
        heavy = todo[2 * weight[todo] > weight[home[todo]]]
        centroid[home[heavy]] = heavy                      # the heavy nodes are a path, written from the top down
        top = home[todo]
        mine = centroid[top]
        under[todo] = todo == mine
        new_home = home.copy()
        for level in _levels(depth, todo):
            inner = level[(home[level] != level) & ~under[level]]
            low = inner[under[parent[inner]]]
            under[low] = True
            up = parent[low]
            new_home[low] = np.where(up == centroid[home[low]], low, new_home[up])
        part = todo[under[todo]]
        totals = _group_sums(values[:, part], home[part], n)
        at = np.unique(mine)
        tops, lost = home[at], weight[at]
        sums[:, at] += totals[:, tops]
        moving = at != tops
        cur, tops, lost = parent[at[moving]], tops[moving], lost[moving]
        while len(cur):                                    # from the centroid to the top, all components in step
            sums[:, cur] += totals[:, tops]
            weight[cur] -= lost
            on = cur != tops
            cur, tops, lost = parent[cur[on]], tops[on], lost[on]
        under[todo] = False
        home = new_home
        todo = todo[todo != mine]
    return sums


def _group_sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(values), n), dtype=values.dtype)
    for row, v in zip(out, values, strict=True):
        np.add.at(row, group, v)
    return out


def _levels(depth: np.ndarray, nodes: np.ndarray) -> list[np.ndarray]:
    """Nodes (sorted by depth) cut where the depth changes."""
    return np.split(nodes, np.flatnonzero(np.diff(depth[nodes])) + 1) if len(nodes) else []


def _finish(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Split whole components, which follow one another in the rows; about ``limit`` rows at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= limit:
            rows = pa.Table.from_batches(held).combine_chunks()
            tops = [rows.column(c).to_numpy() for c in ("top_depth", "top_conv")]
            edges = np.flatnonzero((np.diff(tops[0]) != 0) | (np.diff(tops[1]) != 0))
            cut = int(edges[-1]) + 1 if len(edges) else 0
            if cut:
                yield from _solve(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
    if held:
        yield from _solve(pa.Table.from_batches(held))


def _solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    col = {c: rows.column(c).to_numpy() for c in ("conv_id", "depth", "top_conv", "top_depth", "weight", *VALUES)}
    up = rows.column("parent_conv_id").fill_null(0).to_numpy()
    ids, code = np.unique(np.concatenate([col["conv_id"], up]), return_inverse=True)
    n = len(up)
    depth = col["depth"]
    name, wanted = depth * len(ids) + code[:n], (depth - 1) * len(ids) + code[n:]
    order = np.argsort(name)
    is_top = (col["conv_id"] == col["top_conv"]) & (depth == col["top_depth"])
    place = np.minimum(np.searchsorted(name[order], wanted), n - 1)
    parent = np.where(is_top, -1, order[place])
    sums = split_components(parent, depth, col["weight"], np.stack([col[v] for v in VALUES]))
    out = rows.select([*NODE])
    for v, own in zip(VALUES, sums, strict=True):
        out = out.append_column(f"sum_{v}", pa.array(own + rows.column(f"more_{v}").to_numpy()))
    yield from out.combine_chunks().to_batches()


def subtree_sums(nodes: DataFrame, prefixes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """NODE with sum_<value> for each of VALUES: the value summed over the node's subtree.

    nodes: NODE, weight and VALUES. prefixes: as ``rebuilt_prefixes``, for the ancestors of a node.
    """
    top = ["top_conv", "top_depth"]
    more = [f"more_{v}" for v in VALUES]
    root = nodes.where("depth = 0").select("conv_id").first()
    state = nodes.select(*NODE, "weight", *VALUES, F.lit(root["conv_id"] if root else None).cast("long").alias("top_conv"),
                         F.lit(0).cast("long").alias("top_depth"), *[F.lit(0).cast("long").alias(m) for m in more])
    state, paths, done = _stored(state), None, []
    columns = state.columns
    while True:
        parts = state.groupBy(*top).agg(F.count("*").alias("nodes"), F.max("weight").alias("total"))
        large = parts.where(F.col("nodes") > limit)
        if large.isEmpty():
            break
        if paths is None:                                  # the owner of a conversation's node at each depth
            owner = nodes.select(*KEY, F.col("conv_id").alias("owner"), F.col("parent_conv_id").alias("owner_up"))
            paths = _stored(prefixes.select(*KEY, F.col("conv_id").alias("member")).join(owner, KEY)
                            .select("member", F.col("depth").alias("at"), "owner", "owner_up"))
        here = state.join(large, top)
        centroids = here.where(2 * F.col("weight") > F.col("total")).groupBy(*top).agg(
            F.max_by(F.struct(F.col("conv_id").alias("c_conv"), F.col("weight").alias("lost")), "depth").alias("c"),
            F.max("depth").alias("c_depth")).select(*top, "c.*", "c_depth")
        below = paths.select(F.col("member").alias("conv_id"), (F.col("at") - 1).alias("c_depth"), "owner", "owner_up")
        here = (state.join(centroids, top).join(below, ["conv_id", "c_depth"], "left")
                .withColumn("is_c", (F.col("conv_id") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth")))
                .withColumn("under", (F.col("depth") > F.col("c_depth")) & F.coalesce(F.col("owner_up") == F.col("c_conv"), F.lit(False))))
        here = _stored(here.select(*columns, "c_conv", "c_depth", "lost", "owner", "is_c", "under"))
        totals = here.groupBy(*top, "c_conv", "c_depth").agg(
            *[F.sum(F.when(F.col("is_c") | F.col("under"), F.col(v)).otherwise(0)).alias(f"t_{v}") for v in VALUES],
            F.max("lost").alias("part"))
        steps = (totals.join(paths, (F.col("c_conv") == F.col("member")) & (F.col("at") <= F.col("c_depth"))
                             & (F.col("at") >= F.col("top_depth")))
                 .select(F.col("owner").alias("conv_id"), F.col("at").alias("depth"), "part", *[f"t_{v}" for v in VALUES]))
        moved = here.join(steps, ["conv_id", "depth"], "left").withColumns(
            {m: F.col(m) + F.coalesce(f"t_{v}", F.lit(0)) for m, v in zip(more, VALUES, strict=True)}
            | {"weight": F.when(F.col("is_c"), F.col("weight")).otherwise(F.col("weight") - F.coalesce("part", F.lit(0))),
               "top_conv": F.when(F.col("under"), F.col("owner")).otherwise(F.col("top_conv")),
               "top_depth": F.when(F.col("under"), F.col("c_depth") + 1).otherwise(F.col("top_depth"))})
        rest = state.join(large.select(*top), top, "left_anti").select(*columns)
        moved = _stored(moved.select(*columns, "is_c").unionByName(rest.withColumn("is_c", F.lit(False))))
        done.append(moved.where("is_c").select(*NODE, *[F.col(m).alias(f"sum_{v}") for m, v in zip(more, VALUES, strict=True)]))
        state = moved.where(~F.col("is_c")).select(*columns)
    ready = state.repartition(*top).sortWithinPartitions("top_depth", "top_conv")
    schema = ", ".join([f"{c} long" for c in NODE] + [f"sum_{v} long" for v in VALUES])
    out = ready.mapInArrow(lambda batches: _finish(batches, limit), schema)
    for d in done:
        out = out.unionByName(d)
    return out


def prefix_trie(conversations: DataFrame, stride: int = 20, most: int = 4, limit: int = LIMIT) -> DataFrame:
    """One row for each node of the rebuilt conversations' trie.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens
    (both over the subtree), ends_sha256.
    """
    prefixes = rebuilt_prefixes(conversations, stride, most)
    nodes = trie_nodes(prefixes).withColumns({
        "leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    rolled = subtree_sums(_stored(nodes.drop("words")), prefixes, limit)
    return rolled.join(members_digest(prefixes), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("sum_leaves").alias("n_leaves"),
        F.col("sum_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
