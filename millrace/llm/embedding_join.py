"""Embedding near-dedup: links of one label with cosine of at least a bound, and their components.

Subspace pigeonhole. Unit vectors of cosine c are at squared distance 2 - 2c, which a rotation keeps. It splits over
blocks of dimensions, so of two linked vectors at least one block is within its share of the distance, in proportion to
its dimensions. Each block is range-joined: one side lies in the cell of a grid over the block's first dimensions, the
other looks into all cells its ball touches. More dimensions in the grid mean more cells to look into and fewer vectors in
each; how many are used follows from the number of vectors of the largest label, by a cost model.

The range join only says which vectors meet any other in a cell (a semi join that holds the block distances against the
budget). Those are compared exactly, in double precision, cell by cell, a cell of many vectors being dealt out over pairs of
blocks of about CELL of them. A cell gives back a row for each vector, how many others it links to, and the edges of a
spanning forest, never its pairs; so rows follow the number of vectors, however many links a group of near copies has. A
link that meets in several blocks counts in the first that is within its budget.

Equal vectors of a label are one node with a count, so a vector that a third of all rows hold is one row.

Defined results: a null label, a null vector, and one that is empty, zero or holds null, NaN or infinite values link
with nothing, and so does a row without a vec_id; vectors of different lengths never link; ties and repeats link as any
pair; repeated rows of a vec_id are one vector, of several the greatest label and name; an empty table gives an empty
table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_IDS, components, only_ids, written
from ._words import U, mix

BLOCK, SLACK = 8, 1e-9
#: Vectors of a cell compared in one go, and pairs held at once.
CELL, PAIRS = 2048, 1 << 15
#: Cost of a comparison in the range join, in rows written; it moves cost only.
COMPARE = 0.01


def rotation(d: int) -> np.ndarray:
    """A fixed random rotation of d dimensions."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(d)).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def grid(population: int, draws: int = 4000) -> int:
    """Dimensions of the grid of least cost for so many vectors: cells a ball touches, and vectors met in them. Places in
    cells are taken as even, and half of all vectors as in one of the two cells of a dimension that are looked into."""
    u = np.random.Generator(np.random.PCG64(1)).uniform(size=(draws, BLOCK)) ** 2
    price = {}
    for g in range(2, BLOCK + 1):
        touched = (u[:, :g] @ np.array(list(product((0, 1), repeat=g))).T <= 1).sum(1).mean()
        price[g] = touched + COMPARE * population * 0.5**g * touched / 2**g
    return min(price, key=price.get)


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by their largest component first, so that no square is lost."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _vectors(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of each length in a list column."""
    flat, cut = np.asarray(column.values), np.asarray(column.offsets)
    lengths = np.diff(cut)
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        yield at, flat[cut[at][:, None] + np.arange(d)]


def _rows(least: float, probe: bool, dims: int):
    """Rows of the range join: the cell of each block of each vector, or all cells its ball touches (probe)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, groups = np.asarray(batch["node"]), np.asarray(batch["group"])
            for at, x in _vectors(batch["embedding"]):
                d = x.shape[1]
                x = _unit(x) @ rotation(d)
                for b in range(0, d, BLOCK):
                    part = x[:, b : b + BLOCK]
                    radius = np.sqrt((2 - 2 * least) * part.shape[1] / d) + SLACK
                    wide = 2 * radius * (1 + 1e-9)
                    g = min(dims, part.shape[1])
                    own = np.floor(part[:, :g] / wide).astype(np.int64)
                    rest = part[:, :g] - own * wide
                    row, cell = np.arange(len(at)), own
                    if probe:  # in each dimension the ball reaches one neighbour at most
                        up = rest > wide / 2
                        reach = np.where(up, wide - rest, rest)
                        masks = np.array(list(product((0, 1), repeat=g)))
                        row, mask = np.nonzero(reach**2 @ masks.T <= radius**2 * (1 + 1e-6))
                        cell = own[row] + masks[mask] * np.where(up[row], 1, -1)
                    key = mix(groups[at][row].view(U) ^ U(b + 1))
                    for k in range(g):
                        key = mix(key ^ cell[:, k].view(U))
                    padded = np.zeros((len(at), BLOCK), np.float32)
                    padded[:, : part.shape[1]] = part
                    cols = [pa.array(key.view(np.int64)), pa.array(ids[at][row]), *[pa.array(padded[row, k]) for k in range(BLOCK)], pa.array(np.full(len(row), radius**2)), pa.array(np.full(len(row), b // BLOCK, np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "node", *[f"x{k}" for k in range(BLOCK)], "budget", "block"])

    return of


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place it is connected to by the edges (a, b)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


def _pairs(gid: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(places of members, places of lookers, whether all combine) of the cells of rows sorted by cell and side: cells of
    many pairs one by one, the others as pairs, many cells at a time."""
    edge = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]])) if len(gid) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(side == 0)])
    end = np.append(edge[1:], len(gid))
    na = total[end] - total[edge]
    nb = end - edge - na
    many = na * nb > PAIRS
    for k in np.flatnonzero(many).tolist():
        yield np.arange(edge[k], edge[k] + na[k]), np.arange(edge[k] + na[k], end[k]), True
    few = np.flatnonzero(~many & (na > 0) & (nb > 0))
    size = (na * nb)[few]
    for part in np.split(few, np.flatnonzero(np.diff(np.cumsum(size) // PAIRS)) + 1) if len(few) else []:
        n = (na * nb)[part]
        p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(edge[part], n) + p // np.repeat(nb[part], n), np.repeat((edge + na)[part], n) + p % np.repeat(nb[part], n), False


def _linked(least: float):
    """Of rows (gid, side, block, node, n, label, embedding) sorted by gid: (node, null, how many vectors it links to) and
    (node, a smaller node it is connected to, 0)."""

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        labels = t["label"].combine_chunks().dictionary_encode()
        label = np.asarray((labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels).indices)
        gids, sides, blocks, nodes, ns = (np.asarray(t[c]) for c in ("gid", "side", "block", "node", "n"))
        column = t["embedding"].combine_chunks()
        for at, x in _vectors(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column):
            order = at[np.lexsort((sides[at], gids[at]))]
            x = x[np.searchsorted(at, order)]
            gid, side, block, node, n, of = gids[order], sides[order], blocks[order], nodes[order], ns[order], label[order]
            d = x.shape[1]
            unit = _unit(x)
            x = x / np.abs(x).max(1, keepdims=True)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            turned = unit @ rotation(d)
            starts = np.arange(0, d, BLOCK)
            budget = (np.sqrt((2 - 2 * least) * np.diff(np.append(starts, d)) / d)) ** 2 + 1e-11
            others, ends = np.zeros(len(order), np.int64), []
            for i, j, whole in _pairs(gid, side):
                if whole:
                    a, b = np.nonzero(unit[i] @ unit[j].T >= least - 1e-9)
                    i, j = i[a], j[b]
                fine = (node[i] < node[j]) & (of[i] == of[j]) & (block[i] == block[j])
                i, j = i[fine], j[fine]
                for k in range(0, len(i), PAIRS):
                    a, b = i[k : k + PAIRS], j[k : k + PAIRS]
                    near = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= least
                    a, b = a[near], b[near]
                    within = np.add.reduceat((turned[a] - turned[b]) ** 2, starts, axis=1) <= budget
                    first = within.argmax(1) == block[a]
                    a, b = a[first], b[first]
                    np.add.at(others, a, n[b])
                    np.add.at(others, b, n[a])
                    ends.append((a, b))
            if not ends:
                continue
            names, place = np.unique(node, return_inverse=True)
            a, b = place[np.concatenate([a for a, _ in ends])], place[np.concatenate([b for _, b in ends])]
            low = forest(len(names), a, b)
            up = np.flatnonzero(low != np.arange(len(names)))
            got = np.flatnonzero(others)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([node[got], names[up]])),
                    pa.array(np.concatenate([node[got], names[low[up]]]), mask=np.arange(len(got) + len(up)) < len(got)),
                    pa.array(np.concatenate([others[got], np.zeros(len(up), np.int64)])),
                ],
                names=["a", "b", "k"],
            )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            gid = np.asarray(held["gid"])
            if len(gid):
                last = int(np.searchsorted(gid, gid[-1]))
                yield from compare(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield from compare(held)

    return of


def _dealt(met: DataFrame) -> DataFrame:
    """met (key, side, ..) with gid: the cell, or one of the pairs of blocks of a cell of many vectors."""
    count = lambda s: F.ceil(F.count_if(F.col("side") == s) / CELL)
    many = met.groupBy("key").agg(count(0).alias("pa"), count(1).alias("pb")).where("pa > 1 or pb > 1")
    many = written(many, "many")  # a row for CELL vectors at least
    met = met.join(F.broadcast(many) if many.count() <= BROADCAST_IDS // 4 else many.hint("merge"), "key", "left").withColumns({"pa": F.coalesce("pa", F.lit(1)), "pb": F.coalesce("pb", F.lit(1))})
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("pa")).otherwise(F.col("pb")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("side") == 0, F.col("pb")).otherwise(F.col("pa")) - 1))
    met = met.withColumn("mine", mine).withColumn("other", other)
    part = F.when(F.col("side") == 0, F.struct("mine", "other")).otherwise(F.struct(F.col("other").alias("mine"), F.col("mine").alias("other")))
    return met.withColumn("gid", F.when((F.col("pa") == 1) & (F.col("pb") == 1), F.col("key")).otherwise(F.xxhash64("key", part))).select("gid", "side", "block", "node")


def link(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    name = F.unhex(F.sha2(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), 256))
    rows = written(rows.withColumn("sound", sound).withColumn("name", F.when(F.col("sound"), name)), "vectors")
    twice = written(rows.where("vec_id is not null").groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "twice")
    if not twice.isEmpty():
        once = only_ids(rows, twice, "vec_id").groupBy("vec_id").agg(F.max_by(F.struct("label", "embedding", "sound", "name"), F.struct("sound", "label", "name")).alias("x"))
        rows = written(only_ids(rows, twice, "vec_id", "left_anti").unionByName(once.select("vec_id", "x.*")), "once")
    copies = rows.where("sound").groupBy("label", "name").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")).where("n > 1")
    copies = written(copies.withColumnsRenamed({"label": "l", "name": "m"}), "copies")
    slim = rows.where("sound").select("vec_id", "label", "name")
    if copies.count() <= BROADCAST_IDS // 16:
        told = slim.join(F.broadcast(copies), (F.col("label") == F.col("l")) & (F.col("name") == F.col("m")), "left")
    else:  # a vector that very many rows hold is dealt out
        dealt = copies.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(31))))
        salted = slim.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(32)).cast("int"))
        told = salted.join(dealt.hint("merge"), (F.col("label") == F.col("l")) & (F.col("name") == F.col("m")) & (F.col("salt") == F.col("part")), "left")
    of = written(told.select("vec_id", F.coalesce("node", "vec_id").alias("node"), F.coalesce("n", F.lit(1)).alias("n")), "members")
    repeats = written(of.where("vec_id <> node").select("vec_id"), "repeats")
    nodes = rows.where("sound").join(F.broadcast(repeats) if repeats.count() <= BROADCAST_IDS else repeats.hint("merge"), "vec_id", "left_anti")
    nodes = written(nodes.select(F.col("vec_id").alias("node"), "label", "embedding", F.xxhash64("label", F.size("embedding")).alias("group")), "nodes")

    largest = nodes.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    dims = grid(largest)
    shape = "key long, node long, " + ", ".join(f"x{k} float" for k in range(BLOCK)) + ", budget double, block int"
    small = nodes.select("node", "group", "embedding")
    cells = small.mapInArrow(_rows(least, False, dims), shape)
    balls = small.mapInArrow(_rows(least, True, dims), shape)
    a, b = cells.alias("a"), balls.alias("b")
    apart = sum((F.col(f"a.x{k}") - F.col(f"b.x{k}")) * (F.col(f"a.x{k}") - F.col(f"b.x{k}")) for k in range(BLOCK))
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (apart <= F.col("b.budget") * 1.0001 + 1e-6)
    lookers = written(b.join(a, meet, "left_semi"), "lookers")
    b = lookers.alias("b")
    members = a.join(b, meet, "left_semi")
    met = written(members.select("key", F.lit(0).alias("side"), "block", "node").union(lookers.select("key", F.lit(1), "block", "node")), "met")

    ids = written(met.select("node").distinct(), "near")
    known = nodes.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge"), "node", "left_semi").select("node", "label", "embedding")
    known = known.join(of.where("vec_id = node").select("node", "n"), "node")
    full = _dealt(met).join(known, "node").select("gid", "side", "block", "node", "n", "label", "embedding")
    found = written(full.repartition("gid").sortWithinPartitions("gid").mapInArrow(_linked(least), "a long, b long, k long"), "links")

    counts = found.where("b is null").groupBy("a").agg(F.sum("k").alias("others")).withColumnRenamed("a", "node")
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "node")
    linked = written(counts.join(roots, "node"), "linked")
    some = F.broadcast(linked) if linked.count() <= BROADCAST_IDS // 4 else linked.hint("merge")
    out = of.join(some, "node", "left").select("vec_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = out.union(rows.where("not sound").select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
