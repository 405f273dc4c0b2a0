"""Operator 9: benchmark decontamination with spaced seeds.

Fixed masks look at some of the words under them and ignore the others, so a
window with substituted words still shares a seed. They are chosen together:
whichever words of an overlap that counts (see below) are substituted, some
mask looks at equal words only somewhere inside it. MASKS hit every stretch of
MIN_WORDS words or more, SHORT_MASKS every shorter item; the tests go through
all placements, so no overlap that counts is missed. The seeds of all items
and of all windows of all documents are joined under every mask. On each
diagonal with a hit the document and the item are laid over each other and
the overlap is verified word by word: a document is contaminated by an item
if some stretch of the diagonal of at least MIN_WORDS words (or the whole
item, if it is shorter) starts and ends with equal words and has at least
IDENTITY of its words equal.

The words of the benchmark are counted first. An index of at most
BROADCAST_SEEDS seeds is sent to the executors, and documents are read once
without a shuffle. Seeds of a larger benchmark stay a table: a bitmap of fixed
size lets only those seeds of documents out that may be in it, these are
joined with the table, and the texts and items of the pairs that meet are
joined for verification. Equal texts are judged once there.

Items of fewer than SHORTEST words are left out, as they would match ordinary
text.

Defined results: null and wordless documents are clean; null items are left
out; an empty benchmark leaves all documents clean; very long texts are
searched whole, and hits of repeated words are held in lots of bounded size;
of equally long overlaps the one with the most equal words is told; repeated
rows are judged each; equal items are reported under each of their ids; an
empty table gives an empty result; columns other than the id and the text are
not read, and those that are kept may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from leafmill.llm.storage import Scratch, bounded_batches
from leafmill.llm.words import hashed, mix, place, words
from leafmill.session import spread

# The places a mask looks at, in items of MIN_WORDS words or more and in shorter ones.
MASKS = ("1101111", "1100010111", "11011000011", "1111101")
SHORT_MASKS = ("1111", "11011", "10111", "11101", "1110111")
MIN_WORDS = 13
IDENTITY = 0.8
SHORTEST = 5
#: All masks; the second value is whether they are those of short items.
ALL_MASKS = [(m, False) for m in MASKS] + [(m, True) for m in SHORT_MASKS]
#: Seeds up to which the index is broadcast, about 32 MB.
BROADCAST_SEEDS = 2_000_000
#: Bits of a seed that the bitmap of a larger benchmark looks at: 16 MB.
SIEVE_BITS = 27
#: Hits that are held at once, and words of texts that are looked up together.
LOT, TOGETHER = 1 << 20, 1 << 16
_BITS = 20


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """Seed of the window at each position; none if the text is shorter than the mask."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            total += h[k : k + n] * place(k)
    return mix(total)


@dataclass
class Index:
    """Seeds of items, sorted, with the item and position of each; items are word hashes."""

    items: list[np.ndarray]
    ids: list[int]
    masks: list[str]
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def build(rows: list[tuple[int, str]]) -> Index:
        return Index.of([(key, hashed(words(text))) for key, text in rows])

    @staticmethod
    def of(rows: list[tuple[int, np.ndarray]]) -> Index:
        rows = [(key, h) for key, h in rows if len(h) >= SHORTEST]
        items, masks, tables = [h for _, h in rows], [], []
        for mask, short in ALL_MASKS:
            found = [(k, seeds(h, mask)) for k, h in enumerate(items) if (len(h) < MIN_WORDS) == short]
            if not found:
                continue
            s = np.concatenate([x for _, x in found])
            item = np.concatenate([np.full(len(x), k, dtype=np.int32) for k, x in found])
            at = np.concatenate([np.arange(len(x), dtype=np.int32) for _, x in found])
            order = np.argsort(s, kind="stable")
            s = s[order]
            there = np.zeros(1 << _BITS, dtype=bool)
            there[s >> np.uint64(64 - _BITS)] = True
            masks.append(mask)
            tables.append((s, item[order], at[order], there))
        return Index(items, [key for key, _ in rows], masks, tables)

    def diagonals(self, h: np.ndarray) -> dict[int, np.ndarray]:
        """By item the diagonals (document position less item position) with a hit; hits are held in bounded lots."""
        kept = np.zeros(0, dtype=np.int64)
        for mask, (s, item, at, there) in zip(self.masks, self.tables, strict=True):
            own = seeds(h, mask)
            where = np.flatnonzero(there[own >> np.uint64(64 - _BITS)])
            lo, hi = np.searchsorted(s, own[where], "left"), np.searchsorted(s, own[where], "right")
            met = np.flatnonzero(lo < hi)
            if not len(met):
                continue
            where, lo, n = where[met], lo[met], (hi - lo)[met]
            for part in np.split(np.arange(len(met)), np.flatnonzero(np.diff(np.cumsum(n) // LOT)) + 1):
                k = n[part]
                entry = np.arange(k.sum()) + np.repeat(lo[part] - np.cumsum(k) + k, k)
                key = item[entry].astype(np.int64) << 32 | (np.repeat(where[part], k) - at[entry] + (1 << 31))
                kept = np.union1d(kept, key)
        if not len(kept):
            return {}
        which, shift = kept >> 32, (kept & 0xFFFFFFFF) - (1 << 31)
        bounds = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(kept)]
        return {int(which[a]): shift[a:b] for a, b in zip(bounds, bounds[1:], strict=False)}

    def touched(self, texts: list[np.ndarray]) -> np.ndarray:
        """Which texts have a window with the seed of some item; the texts are laid end to end, and windows over an end do not count."""
        flat = np.concatenate([np.zeros(0, np.uint64), *texts])
        owner = np.repeat(np.arange(len(texts)), [len(h) for h in texts])
        out = np.zeros(len(texts), dtype=bool)
        for mask, (s, _, _, there) in zip(self.masks, self.tables, strict=True):
            own = seeds(flat, mask)
            where = np.flatnonzero(there[own >> np.uint64(64 - _BITS)])
            where = where[owner[where] == owner[where + len(mask) - 1]]
            found = np.searchsorted(s, own[where])
            out[owner[where[s[np.minimum(found, len(s) - 1)] == own[where]]]] = True
        return out

    def overlaps_of(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """overlaps of each text; texts are looked up together, and only those with a hit are laid over items."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        first, held, size = 0, [], 0
        for k, text in enumerate(texts):
            held.append(hashed(words(text)))
            size += len(held[-1])
            if size >= TOGETHER or k == len(texts) - 1:
                for hit in np.flatnonzero(self.touched(held)).tolist():
                    out[first + hit] = self.overlaps(held[hit])
                first, held, size = k + 1, [], 0
        return out

    def overlaps(self, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item id, start, words, equal words) of the longest verified overlap with each item, in document words;
        of equally long ones that with the most equal words."""
        found = []
        for k, shifts in self.diagonals(h).items():
            if best := best_overlap(h, self.items[k], shifts):
                found.append((self.ids[k], *best))
        return sorted(found)


def best_overlap(h: np.ndarray, w: np.ndarray, shifts: np.ndarray) -> tuple[int, int, int] | None:
    """(start, words, equal words) of the longest overlap of a document with an item on any of the diagonals."""
    least, laid = min(MIN_WORDS, len(w)), []
    for shift in shifts.tolist():
        a, b = max(0, shift), min(len(h), shift + len(w))
        equal = int(np.count_nonzero(h[a:b] == w[a - shift : b - shift]))
        if equal >= IDENTITY * least - 1e-9:
            laid.append((-min(b - a, int(equal / IDENTITY + 1e-9)), -equal, a, b, shift))
    best = None
    for most, equal, a, b, shift in sorted(laid):
        if best and (-most, -equal) <= (best[1], best[2]):
            continue  # neither longer nor with more equal words
        found = longest(h[a:b] == w[a - shift : b - shift], least)
        if found and (best is None or found[1:] > best[1:]):
            best = (found[0] + a, found[1], found[2])
    return best


def longest(same: np.ndarray, least: int, where: list[int] | None = None) -> tuple[int, int, int] | None:
    """(start, length, equal) of the longest stretch with ends equal, length at least `least`, a share of equal
    words of at least IDENTITY, that contains one of the places of where if they are given; of equally long ones the
    first with the most equal words."""
    equal = np.flatnonzero(same)
    if len(equal) < 2:
        return None
    total = np.concatenate([[0], np.cumsum(same)])
    best = None
    for a in equal:
        ends = equal[equal - a + 1 >= max(least, best[1] if best else 0)]
        if not len(ends):
            continue
        share = (total[ends + 1] - total[a]) >= IDENTITY * (ends - a + 1) - 1e-9
        for e in ends[share][::-1]:
            if where is None or any(a <= p <= e for p in where):
                found = (int(a), int(e - a + 1), int(total[e + 1] - total[a]))
                best = found if best is None or found[1:] > best[1:] else best
                break
    return best


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, n, words binary) of the items that count; item is a number of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [hashed(words(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(map(len, made), pa.int64()), pa.array([h.tobytes() for h in made], pa.binary())], names=["item", "item_id", "n", "words"]
            )

    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.where("text is not null").mapInArrow(run, "item long, item_id long, n long, words binary").where(F.col("n") >= SHORTEST)


def _seed_rows(masks: list[tuple[str, bool]], h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(mask, distinct seeds) of a text for all masks that are given."""
    for mask, _ in masks:
        yield [m for m, _ in ALL_MASKS].index(mask), np.unique(seeds(h, mask))


def _item_seeds(items: DataFrame) -> DataFrame:
    """(mask, seed, item): the distinct seeds of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.frombuffer(raw, np.uint64)
                for mask, own in _seed_rows([m for m in ALL_MASKS if m[1] == (len(h) < MIN_WORDS)], h):
                    yield pa.RecordBatch.from_pydict({"mask": np.full(len(own), mask, np.int32), "seed": own.view(np.int64), "item": np.full(len(own), item, np.int64)})

    return items.select("item", "words").mapInArrow(run, "mask int, seed long, item long")


def _bitmap(item_seeds: DataFrame) -> np.ndarray:
    """Bits of the upper SIEVE_BITS bits of all seeds: 2**(SIEVE_BITS - 3) bytes, whatever the benchmark's size."""
    place = F.shiftrightunsigned("seed", 64 - SIEVE_BITS)
    parts = item_seeds.groupBy(F.shiftright(place, 15).cast("int").alias("k")).agg(F.bitmap_construct_agg(place.bitwiseAND(32767)).alias("bits"))
    out = np.zeros(1 << max(12, SIEVE_BITS - 3), dtype=np.uint8)
    for row in parts.collect():  # at most 2**(SIEVE_BITS - 15) rows of 4 kB
        out[row.k << 12 : (row.k + 1) << 12] = np.frombuffer(row.bits, np.uint8)
    return out


def _hits(texts: DataFrame, sieve: np.ndarray) -> DataFrame:
    """(a, b, mask, seed): the distinct seeds of each text that pass the sieve."""
    shared = texts.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for a, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for mask, own in _seed_rows(ALL_MASKS, hashed(words(text))):
                    spot = (own >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)
                    own = own[(bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1]
                    if len(own):
                        yield pa.RecordBatch.from_pydict({"a": np.full(len(own), a, np.int64), "b": np.full(len(own), b, np.int64), "mask": np.full(len(own), mask, np.int32), "seed": own.view(np.int64)})

    return texts.select("a", "b", "text").mapInArrow(run, "a long, b long, mask int, seed long")


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with the text as `text` and two hashes that name it."""
    text = F.col(text_col).cast("string")
    return docs.withColumns({"text": text, "a": F.xxhash64(text), "b": F.xxhash64(text, F.lit(1))})


def _joined_overlaps(texts: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, item_id, start, words, equal) of all verified overlaps, by joins on seeds: for a benchmark of any size."""
    item_seeds = scratch.table(_item_seeds(items), "seeds")
    met = _hits(spread(texts), _bitmap(item_seeds)).join(item_seeds, ["mask", "seed"])
    pairs = scratch.table(met.select("a", "b", "item").distinct(), "pairs")
    named = scratch.table(pairs.join(items, "item").select("a", "b", "item_id", "words"), "named")
    one = texts.join(pairs.select("a", "b").distinct(), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.min("text").alias("text"))
    laid = named.join(scratch.table(one, "texts"), ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, None
        for batch in batches:
            rows = []
            for a, b, item, raw, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != last:  # rows of one text mostly follow each other
                    last, h = (a, b), hashed(words(text))
                rows += [(a, b, *x) for x in Index.of([(item, np.frombuffer(raw, np.uint64))]).overlaps(h)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.int32()] * 3, strict=True)], names=["a", "b", "item_id", "start", "words", "equal"])

    return laid.select("a", "b", "item_id", "words", "text").mapInArrow(run, "a long, b long, item_id long, start int, words int, equal int")


def _broadcast_index(items: DataFrame, scratch: Scratch) -> Broadcast | None:
    """The index of all items on every executor, if it has at most BROADCAST_SEEDS seeds; these are counted first."""
    most = max(len(MASKS), len(SHORT_MASKS))
    seeds_ = (items.agg(F.sum("n")).first()[0] or 0) * most
    if seeds_ > BROADCAST_SEEDS:
        return None
    rows = [(r.item_id, np.frombuffer(r.words, np.uint64)) for r in items.orderBy("item_id", "item").collect()]
    scratch.drop(items)
    return items.sparkSession.sparkContext.broadcast(Index.of(rows))


def contamination(
    docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(id_col or keep, contaminated, item_ids, overlap_words, equal_words) of every row.

    item_ids: items it overlaps, ascending; the two numbers are those of its longest overlap."""
    spark, keep = bounded_batches(docs.sparkSession), list(keep or [id_col])
    scratch = Scratch(spark, "overlaps")
    items = scratch.table(_items(benchmark, item_col, item_text), "items")
    rows = docs.select(*(F.col(c).alias(f"_k{n}") for n, c in enumerate(keep)), F.col(text_col).cast("string").alias("text"))
    shared = _broadcast_index(items, scratch)
    if shared is not None:
        kind = ArrayType(StructType().add("item_id", "long").add("words", "integer").add("equal", "integer"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            each = pa.list_(pa.struct([("item_id", pa.int64()), ("words", pa.int32()), ("equal", pa.int32())]))
            for batch in batches:
                found = [[{"item_id": i, "words": n, "equal": e} for i, _, n, e in each_] for each_ in own.overlaps_of(batch.column(len(keep)).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, each)], names=[*batch.schema.names[:-1], "found"])

        schema = StructType([*(StructField(f"_k{n}", docs.schema[c].dataType) for n, c in enumerate(keep))]).add("found", kind)
        found = spread(rows).mapInArrow(run, schema)
    else:
        keyed = _keyed(rows, "text")
        each = F.struct("item_id", "words", "equal")
        overlaps = scratch.table(_joined_overlaps(keyed.select("a", "b", "text"), items, scratch).groupBy("a", "b").agg(F.collect_list(each).alias("found")), "overlaps")
        scratch.keep(overlaps)
        found = keyed.drop("text").join(overlaps, ["a", "b"], "left").withColumn("found", F.coalesce("found", F.array().cast(overlaps.schema["found"].dataType)))
    top = F.array_max(F.transform("found", lambda x: F.struct(x["words"].alias("words"), x["equal"].alias("equal"))))
    return found.select(
        *(F.col(f"_k{n}").alias(c) for n, c in enumerate(keep)), (F.size("found") > 0).alias("contaminated"), F.array_sort(F.array_distinct(F.col("found.item_id"))).alias("item_ids"),
        F.coalesce(top["words"], F.lit(0)).alias("overlap_words"), F.coalesce(top["equal"], F.lit(0)).alias("equal_words"),
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that overlap no benchmark item, all columns as they were; only texts go to Python."""
    spark = bounded_batches(docs.sparkSession)
    scratch = Scratch(spark, "overlaps")
    items = scratch.table(_items(benchmark, "item_id", "text"), "items")
    shared = _broadcast_index(items, scratch)
    if shared is not None:

        @F.arrow_udf("boolean")
        def overlapping(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = shared.value
            for part in texts:
                yield pa.array(list(map(bool, own.overlaps_of(part.to_pylist()))), pa.bool_())

        return docs.where(~overlapping(F.col(text_col).cast("string")))
    texts = _keyed(docs.select(F.col(text_col).alias("text")), "text")
    gone = scratch.table(_joined_overlaps(texts, items, scratch).select(F.col("a").alias("_a"), F.col("b").alias("_b")).distinct(), "gone")
    scratch.keep(gone)
    text = F.col(text_col).cast("string")
    return docs.join(gone, (F.xxhash64(text) == F.col("_a")) & (F.xxhash64(text, F.lit(1)) == F.col("_b")), "left_anti")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all documents with all benchmark items."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
