"""Operator 4: byte-level BPE encoding and decoding.

Each match of the pre-tokenisation pattern is merged on its own. A segment
tree over its byte positions holds in each leaf ``rank << POS_BITS | position``
of the pair that starts there, so the root is the leftmost pair of minimum
rank. A merge updates three leaves: the merged token's pair, the pair of its
live left neighbour, and the leaf of the swallowed neighbour. Live neighbours
are a doubly linked list over positions.

Short pre-tokens, nearly all, are merged many at a time: one matrix holds
one tree in each row, and each step performs one merge of every row. Long ones
(over BATCH_BYTES bytes) get a tree of their own. Both give the same ids.

Defined results: a null text is encoded as an empty one (no ids). Texts and
pre-tokens of any length are encoded whole; of pairs of equal rank the leftmost
is merged first. Repeated rows are encoded each. An empty table gives an empty
result. Columns other
than the id and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.splitting import pretokens
from leafmill.llm.storage import bounded_batches, claim
from leafmill.session import spread

POS_BITS = 24
POS_MASK = (1 << POS_BITS) - 1
NONE = np.int64(1 << 62)
BATCH_BYTES = 64
#: Entries of each of the two generations of a worker's cache; it bounds memory, not results.
CACHE_ENTRIES = 250_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 token and rank lines."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Vocabulary:
    """Ranks, and the rank of every pair of tokens whose concatenation is a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pairs = pairs
        self._build_table()

    def _build_table(self) -> None:
        """Open addressing in arrays, for lookups of many pairs at once."""
        keys = np.fromiter(self.pairs.keys(), dtype=np.int64, count=len(self.pairs))
        vals = np.fromiter(self.pairs.values(), dtype=np.int64, count=len(self.pairs))
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.full((1 << bits) + 64, -1, dtype=np.int64)
        self.slot_val = np.full((1 << bits) + 64, NONE, dtype=np.int64)
        todo, depth = np.arange(len(keys)), 0
        home = self._home(keys)
        while len(todo):
            at = home[todo] + depth
            free = self.slot_key[at] == -1
            cand, first = np.unique(at[free], return_index=True)
            won = todo[free][first]
            self.slot_key[cand], self.slot_val[cand] = keys[won], vals[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            depth += 1
        self.probes = depth

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the pair is no token; negative ids are no tokens."""
        keys = np.where((left < 0) | (right < 0), np.int64(-2), left << 20 | right)
        at = self._home(keys)
        out = np.full(len(keys), NONE, dtype=np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            slot = self.slot_key[at[open_]]
            hit = slot == keys[open_]
            out[open_[hit]] = self.slot_val[at[open_[hit]]]
            open_ = open_[~hit & (slot != -1)]
            if not len(open_):
                break
            at[open_] += 1
        return out


def merge_long(piece: bytes, vocab: Vocabulary) -> list[int]:
    """Ids of one pre-token with a segment tree of its own: O(n log n)."""
    n = len(piece)
    bits = max(POS_BITS, n.bit_length())  # numbers of any size: a pre-token may have any length
    mask = (1 << bits) - 1
    none, pairs = int(NONE), vocab.pairs
    ids = [int(vocab.byte_ids[b]) for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    size = 1 << max(1, (n - 1).bit_length())
    tree = [none] * (2 * size)
    for i in range(n - 1):
        rank = pairs.get(ids[i] << 20 | ids[i + 1])
        if rank is not None:
            tree[size + i] = rank << bits | i
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def update(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    while tree[1] != none:
        i = tree[1] & mask
        ids[i] = tree[1] >> bits
        j = after[i]
        after[i] = k = after[j]
        update(j, none)
        if k < n:
            before[k] = i
            rank = pairs.get(ids[i] << 20 | ids[k])
            update(i, none if rank is None else rank << bits | i)
        else:
            update(i, none)
        if (h := before[i]) >= 0:
            rank = pairs.get(ids[h] << 20 | ids[i])
            update(h, none if rank is None else rank << bits | h)
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


def merge_batch(pieces: list[bytes], vocab: Vocabulary) -> list[list[int]]:
    """Ids of many pre-tokens of at most BATCH_BYTES bytes; one tree to a row, one merge of each row to a step."""
    rows, width = len(pieces), max(map(len, pieces))
    length = np.fromiter(map(len, pieces), dtype=np.int64, count=rows)
    size = 1 << max(1, (width - 1).bit_length())
    ids = np.full((rows, size + 1), -1, dtype=np.int64)
    inside = np.arange(size + 1) < length[:, None]
    ids[inside] = vocab.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    spot = np.arange(size + 1)
    after = np.repeat(np.minimum(spot + 1, size)[None, :], rows, axis=0)
    before = np.repeat((spot - 1)[None, :], rows, axis=0)
    tree = np.full((rows, 2 * size), NONE, dtype=np.int64)
    rank = vocab.pair_ranks(ids[:, :size].ravel(), ids[:, 1 : size + 1].ravel()).reshape(rows, size)
    tree[:, size:] = np.where(rank == NONE, NONE, rank << POS_BITS | spot[:size])
    k = size
    while k > 1:
        k >>= 1
        np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2], out=tree[:, k : 2 * k])

    def update(row: np.ndarray, at: np.ndarray, value: np.ndarray | np.int64) -> None:
        k = at + size
        tree[row, k] = value
        while k[0] > 1:  # all leaves lie at one depth
            k = k >> 1
            tree[row, k] = np.minimum(tree[row, 2 * k], tree[row, 2 * k + 1])

    row = np.flatnonzero(tree[:, 1] != NONE)
    while len(row):
        root = tree[row, 1]
        i = root & POS_MASK
        new = root >> POS_BITS
        j = after[row, i]
        nxt = after[row, j]
        h = before[row, i]
        ids[row, i] = new
        ids[row, j] = -1
        after[row, i] = nxt
        before[row, nxt] = i
        update(row, j, NONE)
        right = vocab.pair_ranks(new, ids[row, nxt])
        update(row, i, np.where(right == NONE, NONE, right << POS_BITS | i))
        if len(has := np.flatnonzero(h >= 0)):
            left = vocab.pair_ranks(ids[row[has], h[has]], new[has])
            update(row[has], h[has], np.where(left == NONE, NONE, left << POS_BITS | h[has]))
        row = row[tree[row, 1] != NONE]
    ids[:, size] = -1
    live = ids >= 0
    flat = ids[live].tolist()
    ends = np.cumsum(live.sum(axis=1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Encoder:
    """Encodes texts; results for pre-tokens are kept in two generations of bounded size."""

    def __init__(self, vocab: Vocabulary, pattern: str, cache_entries: int = CACHE_ENTRIES):
        self.vocab, self.pattern, self.limit = vocab, pattern, cache_entries
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def _learn(self, missing: list[str]) -> None:
        pieces, ranks = [], self.vocab.ranks
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for word in missing:
            if (kept := self.old.get(word)) is not None:
                self.young[word] = kept
                continue
            piece = word.encode("utf-8", "surrogatepass")
            whole = ranks.get(piece)
            if whole is not None:
                self.young[word] = (whole,)
            elif len(piece) > BATCH_BYTES:
                self.young[word] = tuple(merge_long(piece, self.vocab))
            else:
                by_size.setdefault((len(piece) - 1).bit_length(), []).append((word, piece))
        for pieces in by_size.values():
            for at in range(0, len(pieces), 8192):
                part = pieces[at : at + 8192]
                for (word, _), ids in zip(part, merge_batch([p for _, p in part], self.vocab), strict=True):
                    self.young[word] = tuple(ids)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        claim(self, self.forget)
        out = []
        split = [pretokens(x, self.pattern) for x in texts]
        missing = list(set(chain.from_iterable(split)).difference(self.young))
        self._learn(missing)
        get = self.young.__getitem__
        for words in split:
            out.append(list(chain.from_iterable(map(get, words))))
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        return out

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _encoder(data: bytes, pattern: str) -> Encoder:
    """One to a worker process: its cache serves all its tasks."""
    return Encoder(Vocabulary(read_ranks(data)), pattern)


def blocks(texts: list[str], limit: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about limit characters: bounds the working memory of one step."""
    run, size = [], 0
    for x in texts:
        run.append(x)
        size += len(x)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode_documents(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>, decoded binary) of every row."""
    spark = bounded_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(vocabulary)  # the vocabulary file: bounded, about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value, pattern)
        for batch in batches:
            keys, at = batch.column(0), 0
            for texts in blocks([x or "" for x in batch.column(1).to_pylist()]):
                ids = enc.encode_batch(texts)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode(x) for x in ids], pa.binary())],
                    names=[id_col, "ids", "decoded"],
                )
                at += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(id_col, F.col(text_col).cast("string"))).mapInArrow(run, f"{id_col} {kind}, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): as encode_documents, but only digests leave the worker."""
    spark = bounded_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value, pattern)
        words = {i: str(i) for i in enc.vocab.tokens}
        for batch in batches:
            counts, digests, back = [], [], []
            for texts in blocks([x or "" for x in batch.column(1).to_pylist()]):
                for ids in enc.encode_batch(texts):
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(",".join(map(words.__getitem__, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(id_col, F.col(text_col).cast("string"))).mapInArrow(
        run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def decode_documents(rows: DataFrame, vocabulary: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded binary): the bytes of the ids, null ids as none; an id outside the vocabulary is an error."""
    shared = bounded_batches(rows.sparkSession).sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in read_ranks(shared.value).items()}
        for batch in batches:
            back = [b"".join(map(tokens.__getitem__, x or ())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], names=[id_col, "decoded"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, decoded binary")


def vocabulary_file(path: str | None = None) -> bytes:
    """The bytes of the vocabulary file, read on the driver; the default is the public multilingual one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def published_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of all documents."""
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_file(), published_pattern())
