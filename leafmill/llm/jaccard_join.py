"""Operator 8: all pairs of documents whose word shingle sets have Jaccard similarity of at least a threshold.

1. One pass over the texts gives each document a digest of its word sequence
   and a MinHash signature (128 values of 16 bits, four to a band). Documents
   of equal words are one node from here on.
2. Nodes that share a band meet (32 bands of 4: a pair at 0.8 is missed with
   probability 5e-8). In each meeting the signatures are compared
   incrementally: after 16, 32, 64 and 128 values, pairs whose posterior
   probability of reaching the threshold (uniform prior) is under TOLERANCE
   are dropped. Survivors leave as a spanning forest, never as all pairs.
   Bands that more than BLOCK nodes share are joined into groups which are
   compared once, in tiles of two blocks, rather than once to a band.
3. Inside each connected component of survivors the pairs are compared in the
   same way, in tiles again, and those that survive are verified exactly on
   their shingle sets; each node gets its number of links, and the verified
   links leave as a spanning forest.
4. Components of verified links are the classes.

No group is gathered beyond two blocks, which are bounded in nodes and in
bytes, and nothing of the documents reaches the driver. A text larger than a
block is a block of its own.

Defined results: texts of fewer than five words have one shingle of all their
words; a similarity of exactly the threshold links; very long texts are taken
whole; null texts and texts without words link with nothing and are a class
each; repeated rows count as documents of equal text; rows without an id are
compared like others, and a class of which no row has an id has none; an empty
table gives an empty result; columns other than the id and the text are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import groupby
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.graph import components
from leafmill.llm.storage import Scratch, bounded_batches
from leafmill.llm.words import hashed, shingles, words
from leafmill.session import spread

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
#: Nodes of a block of signatures; a tile has two blocks, and a worker holds one tile.
BLOCK = 2048
#: Nodes and bytes of a block of shingle sets.
SET_BLOCK, SET_BYTES = 512, 4 << 20
#: Members that are gathered at once while sets are intersected.
GATHERED = 1 << 20
TOLERANCE = 1e-6
STEPS = (16, 32, 64, 128)
#: Ids up to which the members of components are sent to all executors (16 MB); beyond it a shuffled join is used.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20_240_501)
_FLIP = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)


def minhash(shingle_hashes: np.ndarray) -> np.ndarray:
    """HASHES minima, cut to their upper 16 bits."""
    x = (shingle_hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 1024):
        y = (x[at : at + 1024, None] ^ _FLIP) * _TIMES
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(low, y.min(axis=0), out=low)
    return (low >> np.uint32(16)).astype(np.uint16)


def least_matches(threshold: Fraction, tolerance: float, steps: tuple[int, ...] = STEPS) -> list[int]:
    """For each number n of compared values the fewest matches m with P(J >= t | m of n) >= tolerance.

    With a uniform prior that posterior is P(Binomial(n + 1, t) <= m)."""
    out, t = [], float(threshold)
    for n in steps:
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


class Forest:
    """Union-find over positions, the least position being the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


def _survivors(sig: np.ndarray, i: int, todo: np.ndarray, least: list[int]) -> np.ndarray:
    """The rows of todo whose signatures keep up with that of row i after each step."""
    start, matches = 0, np.zeros(len(todo), dtype=np.int32)
    for n, m in zip(STEPS, least, strict=True):
        if not len(todo):
            break
        matches += (sig[todo, start:n] == sig[i, start:n]).sum(axis=1, dtype=np.int32)
        start, keep = n, matches >= m
        todo, matches = todo[keep], matches[keep]
    return todo


def surviving_forest(sig: np.ndarray, left: np.ndarray, right: np.ndarray, least: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (of left x right positions) that survive the incremental comparison.

    A row that is already connected with all others need not be compared with
    them: rows are taken one at a time against those not yet in their tree."""
    forest, edges = Forest(len(sig)), []
    root = np.arange(len(sig))
    for i in left:
        todo = _survivors(sig, i, right[(root[right] != root[i]) & (right != i)], least)
        for j in todo:
            if forest.join(int(i), int(j)):
                edges.append((int(i), int(j)))
        if len(todo):
            joined = np.unique(np.append(root[todo], root[i]))
            root[np.isin(root, joined)] = joined[0]
    return edges


class SharedMembers:
    """Sets of hashes, cut to what intersections need: members that occur once are left out, and members of one
    occurrence pattern are a column with a weight. The columns of a set are a range of one flat array."""

    def __init__(self, sets: list[np.ndarray]):
        g = len(sets)
        row = np.repeat(np.arange(g, dtype=np.int32), [len(s) for s in sets])
        _, col, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
        keep = count[col] > 1
        row, col = row[keep], col[keep]
        tag = np.random.default_rng(7).integers(0, 1 << 63, g, dtype=np.uint64)
        pattern = np.zeros(len(count), dtype=np.uint64)
        np.add.at(pattern, col, tag[row])
        used = np.flatnonzero(count > 1)
        _, first, weight = np.unique(pattern[used], return_index=True, return_counts=True)
        new = np.full(len(count), -1, dtype=np.int32)
        new[used[first]] = np.arange(len(first), dtype=np.int32)
        col = new[col]
        self.weight, self.flat = weight.astype(np.int32), col[col >= 0]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(row[col >= 0], minlength=g))])
        self._here = np.zeros(len(first), dtype=np.int32)

    def of(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i] : self.ends[i + 1]]

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set i with others; what is gathered at once is bounded."""
        out = np.zeros(len(others), dtype=np.int64)
        own = self.of(i)
        self._here[own] = self.weight[own]
        size = self.ends[others + 1] - self.ends[others]
        for part in np.split(np.arange(len(others)), np.flatnonzero(np.diff(np.cumsum(size) // GATHERED)) + 1):
            n = size[part]
            at = np.arange(n.sum()) + np.repeat(self.ends[others[part]] - np.cumsum(n) + n, n)
            out[part] = np.bincount(np.repeat(np.arange(len(part)), n), weights=self._here[self.flat[at]], minlength=len(part))
        self._here[own] = 0
        return out


def verified_links(
    sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, copies: np.ndarray, least: list[int], threshold: Fraction
) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each row: the copies of other rows that it is linked with, and the least row that it is connected with.

    Pairs are of left x right rows. They are compared incrementally on their signatures; those that survive are
    verified on their sets. One row's pairs are held at a time."""
    up, down = threshold.numerator + threshold.denominator, threshold.numerator
    members, length = SharedMembers(sets), np.array([len(s) for s in sets], dtype=np.int64)
    links, root = np.zeros(len(sets), dtype=np.int64), np.arange(len(sets))
    for i in left:
        todo = right[right > i] if left is right else right
        todo = _survivors(sig, i, todo, least)
        if not len(todo):
            continue
        linked = todo[up * members.common(i, todo) >= down * (length[i] + length[todo])]
        if not len(linked):
            continue
        links[i] += copies[linked].sum()
        links[linked] += copies[i]
        trees = np.unique(np.append(root[linked], root[i]))
        if len(trees) > 1:
            root[np.isin(root, trees)] = trees[0]
    return links, root


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal leading columns, over batch bounds."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for key, run in groupby(rows(), key=lambda r: r[:keys]):
        yield key, [r[keys:] for r in run]


def _sign(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sigs = [], []
            for text in batch.column(1).to_pylist():
                if tokens := words(text):
                    digests.append(hashlib.blake2b(" ".join(tokens).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    sigs.append(minhash(shingles(hashed(tokens), width)).view(np.int64))
                else:
                    digests.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "key", "node", "sig"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    return spread(docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))).mapInArrow(run, f"doc_id {kind}, key long, node binary, sig array<long>")


def tiles(df: DataFrame, blocks: Column, tag: str = "node") -> DataFrame:
    """Adds tile columns i <= j and the row's own block b, of as many blocks as the row's group needs."""
    df = df.withColumn("nb", F.greatest(F.ceil(blocks), F.lit(1)).cast("int")).withColumn("b", F.pmod(F.xxhash64(tag), F.col("nb")).cast("int"))
    return df.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        *[c for c in df.columns if c not in ("nb", "b")], "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j")
    )


def _candidate_forest(nodes: DataFrame, least: list[int], scratch: Scratch, block: int) -> DataFrame:
    """Edges (u, v) that connect all pairs of nodes which share a band and survive."""
    bands = nodes.select("node", F.posexplode("sig").alias("band", "value"))
    # counts that are joined back are written first: then both sides of the join are shuffled, and a hot key can be split
    met = scratch.table(bands.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1"), "met")
    small = bands.join(met.where(F.col("n") <= block).hint("merge"), ["band", "value"])  # the same plan at every size
    found = small.select(F.col("band").cast("long").alias("g"), F.col("value").alias("h"), "node", F.lit(0).alias("b"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    large = met.where(F.col("n") > block)
    if not large.isEmpty():  # one group for bands that share nodes
        hot = scratch.table(bands.join(large, ["band", "value"]).select("node", F.xxhash64("band", "value").alias("key")), "hot")
        firsts = hot.groupBy("node").agg(F.min("key").alias("v"))
        links = hot.join(firsts, "node").select(F.col("key").alias("u"), "v").distinct()
        merged = components(links, scratch).withColumnRenamed("node", "v")
        homes = firsts.join(merged, "v", "left").select("node", F.coalesce("component", "v").alias("h"))
        homes = scratch.table(homes, "homes")
        sizes = scratch.table(homes.groupBy("h").agg(F.count("*").alias("n")), "group-sizes")
        found = found.unionByName(tiles(homes.join(sizes, "h"), F.col("n") / block).select(F.lit(-1).cast("long").alias("g"), "h", "node", "b", "i", "j"))
    ready = found.join(nodes.select("node", "sig"), "node").select("g", "h", "i", "j", "b", "node", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for (_, _, i, j), rows in _runs(batches, 4):
            if len(rows) < 2:
                continue
            rows.sort(key=lambda r: r[1])
            b = np.array([r[0] for r in rows])
            sig = np.array([r[2] for r in rows], dtype=np.int64).view(np.uint16)
            spots = np.arange(len(rows))
            left, right = (spots, spots) if i == j else (spots[b == i], spots[b == j])
            forest = Forest(len(rows))
            for x, y in surviving_forest(sig, left, right, least):
                forest.join(x, y)
            for x in range(len(rows)):  # each on the least of its tree: no node has many smaller neighbours
                if (y := forest.find(x)) != x:
                    us.append(rows[x][1])
                    vs.append(rows[y][1])
            if len(us) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])
                us, vs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])

    return ready.repartition("g", "h", "i", "j").sortWithinPartitions("g", "h", "i", "j").mapInArrow(run, "u binary, v binary")


def _shingle_sets(docs: DataFrame, homes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, shingles binary) of the nodes of homes: the text of one row of each is read again, found by id and hash."""
    keys = homes.select("key", "rep").distinct()
    small = keys.count() <= BROADCAST_IDS
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("own"))
    own = own.join(F.broadcast(keys) if small else keys, F.col("own").eqNullSafe(F.col("key")) & F.col("id").eqNullSafe(F.col("rep")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sets = [], []
            for text in batch.column(0).to_pylist():
                if tokens := words(text):
                    digests.append(hashlib.blake2b(" ".join(tokens).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    sets.append(np.unique(shingles(hashed(tokens), width)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return own.select("text").mapInArrow(run, "node binary, shingles binary").dropDuplicates(["node"])


def _verify(homes: DataFrame, least: list[int], threshold: Fraction, block: int, block_bytes: int) -> DataFrame:
    """(node, root, links, tiled): the node's links with documents of other nodes in one tile, and the
    least node that it is connected with there. homes has the nodes' sets, and the rows and bytes of their component."""
    blocks = F.greatest(F.col("size") / block, F.col("bytes") / block_bytes)
    laid = tiles(homes, blocks).select("home", "i", "j", (F.ceil(blocks) > 1).alias("tiled"), "b", "node", "n", "sig", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j, tiled), rows in _runs(batches, 4):
            rows.sort(key=lambda r: r[1])
            names, b = [r[1] for r in rows], np.array([r[0] for r in rows])
            copies, sig = np.array([r[2] for r in rows], dtype=np.int64), np.array([r[3] for r in rows], dtype=np.int64).view(np.uint16)
            sets = [np.frombuffer(r[4], dtype=np.uint64) for r in rows]
            spots = np.arange(len(rows))
            left, right = (spots, spots) if i == j else (spots[b == i], spots[b == j])
            links, root = verified_links(sig, sets, left, right, copies, least, threshold)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array([names[x] for x in root], pa.binary()), pa.array(links, pa.int64()), pa.array([tiled] * len(rows), pa.bool_())],
                names=["node", "root", "links", "tiled"],
            )

    return (
        laid.repartition("home", "i", "j").sortWithinPartitions("home", "i", "j", "tiled")
        .mapInArrow(run, "node binary, root binary, links long, tiled boolean")
    )


def jaccard_classes(
    docs: DataFrame, threshold: Fraction = Fraction(4, 5), width: int = 5, tolerance: float = TOLERANCE, block: int = BLOCK,
    block_bytes: int = SET_BYTES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every document.

    class_id: the least id reachable over links; n_links: other documents linked directly, copies
    included; n_copies: documents of the same words, itself included."""
    scratch = Scratch(bounded_batches(docs.sparkSession), "jaccard")
    least = least_matches(threshold, tolerance)
    signed = scratch.table(_sign(docs, id_col, text_col, width), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("sig").alias("sig"), first.alias("first"), F.count("*").alias("n"))
    nodes = scratch.table(nodes.select("node", "sig", F.col("first.doc_id").alias("rep"), F.col("first.key").alias("key"), "n"), "nodes")
    edges = scratch.table(_candidate_forest(nodes, least, scratch, block), "candidates")
    comps = components(edges, scratch).withColumnRenamed("component", "home")
    homes = scratch.table(comps.join(nodes.select("node", "rep", "key", "n", "sig"), "node"), "homes")
    homes = scratch.table(homes.join(_shingle_sets(docs, homes, id_col, text_col, width), "node"), "sets")
    sizes = scratch.table(homes.groupBy("home").agg(F.count("*").alias("size"), F.sum(F.octet_length("shingles")).alias("bytes")), "sizes")
    checked = scratch.table(_verify(homes.join(sizes, "home"), least, threshold, min(block, SET_BLOCK), block_bytes), "checked")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    tiled = checked.where("tiled and node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    if not tiled.isEmpty():
        merged = components(tiled, scratch)
        links = links.join(merged, "node", "left").select("node", "links", F.coalesce("component", "root").alias("root"))
    linked = scratch.table(links.join(homes.select("node", "rep"), "node"), "linked")
    classes = scratch.table(linked.groupBy("root").agg(F.min("rep").alias("class_rep")), "classes")
    final = linked.join(classes, "root").select("node", "links", "class_rep")
    facts = nodes.select("node", "rep", "n").join(final, "node", "left").select(
        "node", F.col("n").alias("n_copies"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("class_rep", "rep").alias("class_rep")
    )
    facts = scratch.table(facts, "facts")
    scratch.keep(signed, facts)
    return signed.select("doc_id", "node").join(facts, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_rep")).alias("class_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )


def one_of_each(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row of docs of each class, all columns as they were; rows without words all stay.

    Rows are numbered and written first, so repeated or missing ids do not matter."""
    spark, cols = docs.sparkSession, docs.columns
    plain = spread(docs).toDF(*(f"_c{n}" for n in range(len(cols)))).withColumn("_row", F.monotonically_increasing_id())
    rows = Scratch(spark, "unique").table(plain, "rows")
    classes = jaccard_classes(rows, id_col="_row", text_col=f"_c{cols.index(text_col)}")
    gone = Scratch(spark, "unique").table(classes.where("doc_id <> class_id").select(F.col("doc_id").alias("_row")), "gone")
    few = gone.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(gone) if few else gone, "_row", "left_anti").drop("_row").toDF(*cols)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and numbers of links of all documents."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
