"""Operator 7: embedding near-duplicates by collision-counting projections.

Equal vectors of one label are one node, so hot copies cost nothing. The
nodes of a label are placed on PROJECTIONS random lines. Two unit vectors of
cosine t are at distance r = sqrt(2 - 2t); on a Gaussian line their places
differ by N(0, r). A window of half width WIDTH * r around the query
therefore catches a pair at the threshold with a known probability on each
line, independently, and the number of lines on which it is caught is
binomial. The least count that such a pair reaches with probability
1 - MISS is the count that a pair must reach to be verified; nearer pairs
reach it more often. Verification is the cosine in double precision.

Only vectors that share a cell are compared. Some lines together, cut into
steps of SIDE * r from a random origin, make a grid; the more rows the largest
label has, the more lines a grid has, so that a cell has about CELL_ROWS rows
of vectors that point anywhere. There are as many grids as make the
probability that a pair at the threshold shares no cell at most PARTED, at
every size. With n vectors of a label the work grows as n to a power of about
1.12 (in rows: a row to a vector and grid), not as their pairs. A pair that shares cells of
several grids counts in the first of them.

Cells are compared in one task each, large ones in tiles of two blocks: on
every line both are sorted, and each query's window is a range of the sorted
places. What leaves a task is one row to a node (its number of links and the
least node that it is connected with there), never the pairs. Components come
from the spanning edges.

Defined results: null labels, null vectors, zero vectors, and vectors with
null or non-finite components link with nothing and keep themselves; vectors
of other lengths link only with their like; a cosine of exactly the threshold
links; rows of equal id are one vector each, but share its name; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.graph import components
from leafmill.llm.jaccard_join import tiles
from leafmill.llm.storage import Scratch, bounded_batches, key_runs, packed
from leafmill.llm.words import mix, place

#: Lines on which collisions are counted, and the windows' half width in distances at the threshold.
PROJECTIONS, WIDTH = 24, 2.0
#: Probability with which a pair at the threshold falls short of the count, and with which it shares no cell.
MISS, PARTED = 1e-9, 1e-6
#: Side of a grid's cell in distances at the threshold, and rows that a cell of a label spread evenly should have.
SIDE, CELL_ROWS = 10.0, 256
#: Rows of a block; a tile has two, and a worker holds one tile.
BLOCK = 1024
#: Elements of the comparison of a cell that are held at once.
HELD = 1 << 21


def required_count(lines: int = PROJECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold falls short of with probability at most miss."""
    p, total, c = math.erf(width / math.sqrt(2)), 0.0, 0
    while True:
        total += math.comb(lines, c) * p**c * (1 - p) ** (lines - c)
        if total > miss:
            return c
        c += 1


@lru_cache(maxsize=8)
def lines(dim: int, count: int = PROJECTIONS) -> np.ndarray:
    """Gaussian directions; the same on every machine."""
    return np.random.default_rng(90_210 + dim).standard_normal((dim, count))


def same_cell(ratio: float) -> float:
    """Probability that two places whose difference is N(0, 1) fall into one cell of a grid with that side and a random origin."""
    return math.erf(ratio / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-(ratio**2) / 2))


def grids_for(largest: int, radius: float, parted: float = PARTED) -> tuple[int, int]:
    """(lines to a grid, grids): cells of about CELL_ROWS of `largest` rows whose vectors point anywhere, and as many
    grids as make it that improbable that a pair at the threshold shares no cell of any."""
    near, far = same_cell(SIDE), same_cell(SIDE * radius / math.sqrt(2))
    width = max(1, math.ceil(math.log(max(1.0, largest / CELL_ROWS)) / -math.log(far)))
    return width, max(1, math.ceil(math.log(parted) / math.log1p(-(near**width))))


@lru_cache(maxsize=8)
def _grid(dim: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and origins (in sides) of all grids' lines."""
    rng = np.random.default_rng(70_707 + dim)
    return rng.standard_normal((dim, count)), rng.random(count)


def cells_of(unit: np.ndarray, width: int, grids: int, side: float) -> np.ndarray:
    """(rows, grids): the hash of each row's cell in each grid."""
    directions, origins = _grid(unit.shape[1], width * grids)
    spot = np.floor(unit @ directions / side + origins).astype(np.int64).view(np.uint64).reshape(len(unit), grids, width)
    total = np.zeros(spot.shape[:2], dtype=np.uint64)
    for k in range(width):
        total = mix(total + spot[:, :, k] * place(k))
    return total.view(np.int64)


def collisions(query: np.ndarray, base: np.ndarray, half: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of rows) that meet in the query's window on at least `least` lines.

    On each line the base is sorted, and a query's window is a range of its places; a pair meets there if the place
    of the base's row is in the range. Ranges of all lines are found at once, the lines being laid end to end."""
    m, n = base.shape
    gap = 4 * (np.abs(base).max(initial=0) + np.abs(query).max(initial=0) + half + 1)
    ends = gap * np.arange(n)
    order = np.argsort(base, axis=0, kind="stable")
    kind = np.uint16 if m < 1 << 15 else np.uint32
    rank = np.empty((n, m), dtype=kind)
    np.put_along_axis(rank, order.T, np.broadcast_to(np.arange(m, dtype=kind), (n, m)), axis=1)
    laid = (np.take_along_axis(base, order, axis=0) + ends).T.ravel()
    starts = m * np.arange(n)
    left, right = [], []
    rows = max(1, HELD // max(1, n * m))
    for a in range(0, len(query), rows):
        q = query[a : a + rows] + ends
        low, high = (np.searchsorted(laid, q + h, side) - starts for h, side in ((-half, "left"), (half, "right")))
        low, size = low.T.astype(kind)[:, :, None], (high - low).T.astype(kind)[:, :, None]
        met = ((rank[:, None, :] - low) < size).sum(axis=0, dtype=np.uint16)  # unsigned: places below the range are large
        i, j = np.nonzero(met >= least)
        left.append(i + a)
        right.append(j)
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def _links(unit: np.ndarray, x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, half: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    p = unit @ lines(unit.shape[1])
    i, j = collisions(p[left], p[right], half, least)
    i, j = left[i], right[j]
    keep = i < j if left is right else i != j
    i, j = i[keep], j[keep]
    sure = [np.zeros(0, dtype=bool)]
    for a in range(0, len(i), 1 << 13):
        u, v = x[i[a : a + (1 << 13)]], x[j[a : a + (1 << 13)]]
        dot, un, vn = (np.einsum("ij,ij->i", s, t) for s, t in ((u, v), (u, u), (v, v)))
        sure.append(dot / (np.sqrt(un) * np.sqrt(vn)) >= threshold)
    ok = np.concatenate(sure)
    return i[ok], j[ok]


def _units(column: pa.Array, dim: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a binary column in double precision, as they are and of length one."""
    x = packed(column, kind).reshape(len(column), dim).astype(np.float64)
    return x, x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _place(rows: DataFrame, width: int, grids: int, side: float, kind: str) -> DataFrame:
    """The rows and their cells, 8 bytes to a grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy(zero_copy_only=False)
            cells = np.empty((batch.num_rows, grids), dtype=np.int64)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                cells[own] = cells_of(_units(batch.column(2).take(pa.array(own)), int(dim), kind)[1], width, grids, side)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

    return rows.mapInArrow(run, "node binary, label string, v binary, dim int, n long, rep long, cells array<long>")


def _nodes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, kind: str) -> DataFrame:
    """(vec_id, label, node, v): node and v are null for vectors that link with nothing; v are the numbers as kind."""
    id_kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            labels, nodes, out = batch.column(1).to_pylist(), [], []
            for label, vector in zip(labels, batch.column(2).to_pylist(), strict=True):
                x = None
                if label is not None and vector and None not in vector:
                    x = np.array(vector, dtype=np.float64) + 0.0
                    big = np.abs(x).max()
                    if not np.isfinite(big) or big == 0 or not np.isfinite(x).all():
                        x = None
                    elif not 1e-100 < big < 1e100:
                        x = x / big  # the square would leave the range of doubles; the cosine stays
                raw = None if x is None else x.astype(kind).tobytes()
                nodes.append(None if raw is None else hashlib.blake2b(label.encode() + b"\0" + raw, digest_size=16).digest())
                out.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(out, pa.binary())], names=["vec_id", "label", "node", "v"])

    cols = vectors.select(id_col, F.col(label_col).cast("string"), F.col(vec_col).cast("array<double>"))
    return cols.mapInArrow(run, f"vec_id {id_kind}, label string, node binary, v binary")


def embedding_links(
    vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    spark = bounded_batches(vectors.sparkSession)
    scratch, parts = Scratch(spark, "vectors"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    radius = math.sqrt(2 - 2 * threshold) + 1e-9
    half, least = WIDTH * radius, required_count()
    kind = "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"  # floats are moved as floats
    named = scratch.table(_nodes(vectors, id_col, vec_col, label_col, kind), "named")
    # node is a digest of label and vector: any row's v stands for all
    unique = named.where("node is not null").groupBy("node", "label").agg(F.min("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").cast("long").alias("rep"))
    unique = scratch.table(unique.select("node", "label", "v", (F.octet_length("v") / int(kind[2])).cast("int").alias("dim"), "n", "rep"), "unique")
    largest = unique.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    width, grids = grids_for(largest, radius)
    nodes = scratch.table(_place(unique, width, grids, SIDE * radius, kind), "nodes")
    cell = ["label", "dim", "grid", "cell"]
    keys = nodes.select("node", "label", "dim", F.posexplode("cells").alias("grid", "cell"))
    # counts that are joined back are written first: then both sides of the join are shuffled, and a hot cell can be split
    met = scratch.table(keys.groupBy(*cell).agg(F.count("*").alias("size")).where("size > 1"), "met")
    members = scratch.table(keys.join(met, cell), "members")
    tile = [*cell, "i", "j"]
    ready = tiles(members, F.col("size") / block).join(nodes.select("node", "n", "v", "cells"), "node").select(*tile, "b", "node", "n", "v", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        for (_, dim, grid, _, bi, bj), (blocks, names, copies, vectors_, cells) in key_runs(batches, 6):
            size = len(names)
            if size < 2:
                continue
            x, unit = _units(vectors_, dim, kind)
            b, spots = blocks.to_numpy(), np.arange(size)
            left, right = (spots, spots) if bi == bj else (spots[b == bi], spots[b == bj])
            i, j = _links(unit, x, left, right, threshold, half, least)
            if len(i) and grid:  # a pair belongs to the first grid in which it shares a cell
                own = np.asarray(cells.flatten()).reshape(size, -1)[:, :grid]
                first = (own[i] != own[j]).all(axis=1)
                i, j = i[first], j[first]
            if not len(i):
                continue
            n, ids = copies.to_numpy(), names.to_pylist()
            links, root = np.zeros(size, dtype=np.int64), np.arange(size)
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            order = np.argsort(i, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
                trees = np.unique(root[np.append(j[part], i[part[0]])])
                if len(trees) > 1:
                    root[np.isin(root, trees)] = trees[0]
            low: dict[int, bytes] = {}
            for k in np.flatnonzero(links).tolist():
                low[root[k]] = min(ids[k], low.get(root[k], ids[k]))
            for k in np.flatnonzero(links).tolist():
                for kept, value in zip(out, (ids[k], low[root[k]], int(links[k])), strict=True):
                    kept.append(value)
            if len(out[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["node", "root", "links"])
                out = ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["node", "root", "links"])

    kinds = [pa.binary(), pa.binary(), pa.int64()]
    found = ready.repartition(parts, *tile).sortWithinPartitions(*tile).mapInArrow(run, "node binary, root binary, links long")
    found = scratch.table(found, "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    merged = components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")), scratch)
    # what is joined back is written first: then both sides are shuffled, and a hot component or vector can be split
    classes = scratch.table(merged.join(nodes.select("node", "rep"), "node"), "classes")
    least_id = scratch.table(classes.groupBy("component").agg(F.min("rep").alias("low")), "least")
    home = classes.join(least_id, "component").select("node", "low")
    facts = nodes.select("node", "rep", "n").join(links, "node", "left").join(home, "node", "left").select(
        "node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("low", "rep").alias("component_id")
    )
    facts = scratch.table(facts, "facts")
    scratch.keep(named, facts)
    return named.select("vec_id", "node").join(facts, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col("vec_id")).cast("long").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
