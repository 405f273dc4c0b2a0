"""Operator 3: token ids as flat binary files.

A data set is a folder of parts in ascending id order. A part is three files:
``NNNNN.bin`` holds the ids of its documents one after another as little-endian
unsigned integers (16 bits if the vocabulary allows, else 32), ``NNNNN.idx``
the int64 offsets of its documents in that file (one more than documents),
``NNNNN.doc`` the int64 document ids. A part's base, the number of ids before
it, is the prefix sum of the parts' counts; ``manifest.json`` lists parts and
bases. Readers map the files into memory.

Writers write under another name and rename: a lost or repeated task leaves
the same files. Each match of the pre-tokenisation pattern is encoded by the
tokenizers library once and kept in a cache of bounded size, which gives the
ids of the whole text, as the library merges within matches only. A text with
the string of an added token is encoded by the library whole.

Parts are ranges of (id, hash of the text, row): rows of one id, rows without
an id and equal rows are dealt over parts like any others.

Defined results: a null text is encoded as an empty one (the end id alone).
Rows of equal id are ordered by the hash of their text, equal rows in any
order. Rows without an id come first and come back without one. Very long
texts are encoded whole. An empty table gives an empty data set. Columns other
than the id and the text are not read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.bpe import blocks, published_pattern, vocabulary_file
from leafmill.llm.splitting import pretokens
from leafmill.llm.storage import Scratch, arrow_fs, bounded_batches, claim, local_path

CACHE_ENTRIES = 600_000
#: Documents that one reading task takes.
READ_DOCS = 50_000



def _marks() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


MARKS = _marks()


class IdBytes:
    """The ids of texts as packed bytes, by the tokenizers library.

    A pre-token is handed to the library's merge model as it would be inside the whole text. A text that holds
    the string of an added token is handed to the library whole, as that string is cut out before the pattern is applied."""

    def __init__(self, tokenizer_json: bytes, pattern: str, dtype: str, cache_entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json.decode())
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern, self.dtype, self.limit = pattern, dtype, cache_entries
        self.pack, self.sizes = struct.pack, "<%dH" if dtype == "<u2" else "<%dI"
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        claim(self, self.forget)
        pack, size = self.pack, self.sizes
        whole = {k: self.tokenizer.encode(x, add_special_tokens=False).ids for k, x in enumerate(texts) if any(t in x for t in self.added)}
        split = [[] if k in whole else pretokens(x, self.pattern) for k, x in enumerate(texts)]
        missing = list(set(chain.from_iterable(split)).difference(self.young))
        fresh = [x for x in missing if x not in self.old]
        self.young.update((x, self.old[x]) for x in missing if x in self.old)
        merge = self.tokenizer.model.tokenize
        for word in fresh:
            ids = [x.id for x in merge(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(MARKS))]
            self.young[word] = pack(size % len(ids), *ids)
        get = self.young.__getitem__
        out = [pack(size % len(whole[k]), *whole[k]) if k in whole else b"".join(map(get, words)) for k, words in enumerate(split)]
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        return out


@lru_cache(maxsize=2)
def _packer(tokenizer_json: bytes, pattern: str, dtype: str) -> IdBytes:
    return IdBytes(tokenizer_json, pattern, dtype)


class _Sink:
    """One file, written under another name and renamed when whole."""

    def __init__(self, uri: str):
        self.uri, self.tmp = uri, f"{uri}.{uuid.uuid4().hex}.tmp"
        if (path := local_path(uri)) is not None:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            self.file = open(local_path(self.tmp), "wb")
        else:
            self.fs, self.path = arrow_fs(self.tmp)
            self.file = self.fs.open_output_stream(self.path)

    def close(self) -> None:
        self.file.close()
        if (path := local_path(self.uri)) is not None:
            os.replace(local_path(self.tmp), path)
        else:
            self.fs.move(self.path, arrow_fs(self.uri)[1])


def _mapped(uri: str, dtype: str) -> np.ndarray:
    """The file as an array: mapped from a mounted folder, read from another store."""
    if (path := local_path(uri)) is not None:
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    fs, at = arrow_fs(uri)
    with fs.open_input_file(at) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def write_token_files(
    docs: DataFrame, root: str, tokenizer_json: bytes, pattern: str, end_id: int, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> dict:
    """Write the data set under root and return its manifest."""
    spark = bounded_batches(docs.sparkSession)
    size = len(json.loads(tokenizer_json)["model"]["vocab"])
    dtype = "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(tokenizer_json)  # the tokenizer's file: bounded, a few MB
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], dtype=dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, name = _packer(shared.value, pattern, dtype), f"{root}/{part:05d}"
        n_docs = n_null = n_ids = 0
        files = {}
        for batch in batches:
            keys = batch.column(0).cast(pa.int64())
            texts = [x or "" for x in batch.column(1).to_pylist()]
            if not texts:
                continue
            if not files:
                files = {kind: _Sink(f"{name}.{kind}") for kind in ("bin", "idx", "doc")}
                files["idx"].file.write(np.zeros(1, "<i8").tobytes())
            n_null += keys.null_count
            n_docs += len(texts)
            files["doc"].file.write(np.asarray(keys.fill_null(0), dtype="<i8").tobytes())
            for run_ in blocks(texts):
                packed = packer.encode(run_)
                sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // np.dtype(dtype).itemsize + 1
                files["bin"].file.write(end.join(packed) + end)
                files["idx"].file.write((n_ids + np.cumsum(sizes)).astype("<i8").tobytes())
                n_ids += int(sizes.sum())
        for f in files.values():
            f.close()
        if files:
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [n_docs], "nulls": [n_null], "ids": [n_ids]})

    # ranges are of narrow keys, since some of them reach the driver; with the row's number even equal rows can be parted
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(parts, "id", "h", "row").sortWithinPartitions("id", "h", "row").select("id", "text")
    counts = sorted(rows.mapInArrow(run, "part long, docs long, nulls long, ids long").collect())  # a row to a part
    base, listed = 0, []
    for part, n_docs, n_null, n_ids in counts:
        listed.append({"name": f"{part:05d}", "docs": n_docs, "nulls": n_null, "ids": n_ids, "base": base})
        base += n_ids
    manifest = {"dtype": dtype, "end_id": end_id, "ids": base, "parts": listed}
    sink = _Sink(f"{root}/manifest.json")
    sink.file.write(json.dumps(manifest).encode())
    sink.close()
    return manifest


def read_token_files(spark: SparkSession, root: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files under root."""
    manifest = json.loads(bytes(_mapped(f"{root}/manifest.json", "u1")))
    dtype = manifest["dtype"]
    spans = [
        (p["name"], p["nulls"], p["base"], first, min(first + READ_DOCS, p["docs"]))
        for p in manifest["parts"] for first in range(0, p["docs"], READ_DOCS)
    ]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not spans:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, nulls, base, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, offsets, keys = (_mapped(f"{root}/{name}.{kind}", t) for kind, t in (("bin", dtype), ("idx", "<i8"), ("doc", "<i8")))
                for a in range(first, last, 4096):
                    b = min(a + 4096, last)
                    at = np.asarray(offsets[a : b + 1])
                    crc, rows = [], []
                    for x, y in zip(at[:-1], at[1:], strict=True):
                        own = np.asarray(ids[x:y])
                        crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                        if with_ids:
                            rows.append(own.astype(np.int32))
                    cols = [
                        pa.array(np.asarray(keys[a:b]), pa.int64(), mask=np.arange(a, b) < nulls),
                        pa.array(base + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.array(rows, pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    listed = spark.createDataFrame(spans, "name string, nulls long, base long, first long, last long")
    return listed.repartition(min(len(spans), 2000)).mapInArrow(run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as token files and read back."""
    import public_tokenizers

    root = Scratch(spark, "tokens").root
    tokenizer = vocabulary_file(public_tokenizers.path("byte_bpe_50k.json"))
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), root, tokenizer, published_pattern(), end_id=2)
    return read_token_files(spark, root)
