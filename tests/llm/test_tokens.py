"""Operators 2, 3 and 4: sharding, token files, byte-level BPE."""

import hashlib
import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm import bpe, sharding, token_files
from leafmill.llm.splitting import pretokens
from leafmill.llm.storage import shared_dir
from tests.llm.conftest import make

PATTERN = public_tokenizers.PATTERN


def odd_texts():
    rng = random.Random(8)
    fixed = ["", "  a  b\n\n c'd 'll\x1c\x1d x\x85\xa0y ²³ ½x", "<|endoftext|>", "日本語 テスト 123", "a" * 3000, "ab" * 2000 + " " + "1" * 3000, " " * 300 + "x", "x é́ 😀"]
    return fixed + ["".join(rng.choice("ab1 .'s\n\x1f é²日　") for _ in range(60)) for _ in range(200)]


@pytest.fixture(scope="module")
def plain():
    ranks = bpe.read_ranks(bpe.vocabulary_file())
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pretokens_are_the_matches_of_the_pattern():
    full = regex.compile(PATTERN)
    for x in odd_texts():
        assert pretokens(x, PATTERN) == full.findall(x)


def test_pretokens_follow_any_other_pattern():
    assert pretokens("ab cd", ".") == list("ab cd")
    assert pretokens("ab (cd)", r"(\w)\w") == ["ab", "cd"]


def test_encoding_equals_the_library_and_decodes_back(plain):
    enc = bpe.Encoder(bpe.Vocabulary(bpe.read_ranks(bpe.vocabulary_file())), PATTERN, cache_entries=50)
    for x in odd_texts():
        ids = enc.encode(x)
        assert ids == plain.encode_ordinary(x)
        assert enc.decode(ids) == x.encode()


def test_both_forms_of_the_merge_agree():
    vocab = bpe.Vocabulary(bpe.read_ranks(bpe.vocabulary_file()))
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"abehilnorst \xc3\xa9\xff") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    assert bpe.merge_batch(pieces, vocab) == [bpe.merge_long(p, vocab) for p in pieces]


def test_a_position_may_need_more_bits(monkeypatch, plain):
    vocab = bpe.Vocabulary(bpe.read_ranks(bpe.vocabulary_file()))
    monkeypatch.setattr(bpe, "POS_BITS", 3)
    for piece in (b"a" * 100, b"the" * 50, b"\xff" * 9):
        assert bpe.merge_long(piece, vocab) == plain._encode_single_piece(piece)


def test_a_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0})


def test_documents_of_every_kind(docs, corpus, plain, empty):
    found = bpe.encode_digests(docs, bpe.vocabulary_file(), PATTERN)
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found.collect())
    want = []
    for i, t in corpus:
        ids = plain.encode_ordinary(t or "")
        want.append((i or -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    full = bpe.encode_documents(docs, bpe.vocabulary_file(), PATTERN)
    back = bpe.decode_documents(full, bpe.vocabulary_file())
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((t or "").encode() for _, t in corpus)
    assert bpe.encode_digests(empty, bpe.vocabulary_file(), PATTERN).count() == 0
    assert bpe.encode_documents(empty, bpe.vocabulary_file(), PATTERN).count() == 0


def test_token_files_come_back(spark, docs, corpus, library, empty):
    tokenizer = bpe.vocabulary_file(public_tokenizers.path("byte_bpe_50k.json"))
    root = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    manifest = token_files.write_token_files(docs, root, tokenizer, PATTERN, end_id=2, parts=4)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32, r.ids) for r in token_files.read_token_files(spark, root, with_ids=True).collect()), key=lambda r: r[0])
    order = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for (i, t), row in zip(order, got, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert row == (start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    assert manifest["ids"] == start and manifest["dtype"] == "<u2" and len(manifest["parts"]) > 1
    root = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    token_files.write_token_files(empty, root, tokenizer, PATTERN, end_id=2, parts=4)
    assert token_files.read_token_files(spark, root).count() == 0


def test_added_tokens_in_a_text_are_those_of_the_library(spark, library):
    tokenizer = bpe.vocabulary_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b <|endoftex", *odd_texts()]
    root = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    token_files.write_token_files(make(spark, list(enumerate(texts))), root, tokenizer, PATTERN, end_id=2, parts=3)
    got = {r.doc_id: r.ids for r in token_files.read_token_files(spark, root, with_ids=True).collect()}
    assert got == {k: [*library.encode(t, add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}
    assert 50256 in got[0]


def test_rows_of_one_id_are_dealt_over_parts(spark):
    tokenizer = bpe.vocabulary_file(public_tokenizers.path("byte_bpe_50k.json"))
    for rows in ([(None, f"text {k}") for k in range(400)], [(7, "one text")] * 400):
        root = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
        manifest = token_files.write_token_files(make(spark, rows).repartition(4), root, tokenizer, PATTERN, end_id=2, parts=4)
        assert len(manifest["parts"]) == 4 and max(p["docs"] for p in manifest["parts"]) < 200
        got = sorted(token_files.read_token_files(spark, root).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == [i for i, _ in rows]
        assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))


def brute_capacity(sizes, shards):
    best = [0] + [10**18] * len(sizes)
    for _ in range(shards):
        now = list(best)
        for j in range(1, len(sizes) + 1):
            for i in range(j):
                now[j] = min(now[j], max(best[i], sum(sizes[i:j])))
        best = now
    return best[-1]


def test_smallest_capacity_and_cuts_are_optimal():
    rng = random.Random(5)
    for _ in range(150):
        sizes, shards = [rng.choice([0, 1, 2, 5, 9, 40]) for _ in range(rng.randint(1, 14))], rng.randint(1, 6)
        want = brute_capacity(sizes, shards)
        assert sharding.smallest_capacity(np.array(sizes), shards) == want
        cuts = [*sharding.contiguous_cuts(np.array(sizes), shards), len(sizes)]
        assert cuts[0] == 0 and all(a <= b for a, b in zip(cuts, cuts[1:], strict=False))
        assert max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)) == want


def test_shards(docs, corpus, empty):
    got = sharding.shard_documents(docs, 7).toPandas()
    assert sorted(got["size"]) == sorted(len((t or "").encode()) + 16 for _, t in corpus)
    assert (got["law"] == "bytes").all() and got["grown_shard"].isna().all()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert got.groupby("text_crc32")["shard"].nunique().max() == 1
    assert set(got["text_crc32"]) == {zlib.crc32((t or "").encode()) for _, t in corpus}
    units = got.groupby("text_crc32")["size"].sum()
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() <= max(units.max(), loads.sum() / 7 + units[units < units.max()].max())
    assert sharding.shard_documents(empty, 7).count() == 0


@pytest.mark.parametrize("rows", [[(3, "one text")] * 300, [(None, "one text")] * 300, [(None, None)] * 300])
def test_equal_rows_are_dealt_over_cells(spark, rows, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    got = sharding.shard_documents(make(spark, rows).repartition(3), 4).toPandas()
    assert got["shard"].nunique() == 1 and sorted(got["slot"]) == list(range(300))


def test_the_shard_expression_equals_the_assignment(spark):
    rng = np.random.default_rng(3)
    for n, shards in ((1, 4), (3, 4), (4, 4), (200, 7), (200, 40)):
        units = np.sort(rng.choice(1 << 18, n, replace=False))
        shard = sharding.assign_units(rng.choice([1, 5, 40, 4000], n), shards)
        df = spark.createDataFrame([(int(u), int(s)) for u, s in zip(units, shard, strict=True)], "unit int, want int")
        assert df.where(sharding.shard_of(units, shard, shards, F.col("unit")) != F.col("want")).count() == 0
