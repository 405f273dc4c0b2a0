"""Stream machines: any cut of the input gives the batch result, in plain Python and in Structured Streaming."""

import random
import time

import pytest
from pyspark.sql import functions as F

from leafmill.streaming import machines as M
from leafmill.streaming import processors

TEXTS = [
    "<PAGE>one\ntwo<PAGE>three <BLOCK>figure[1, 2, 3, 4]<FORK> x <BLOCK>text[1, 2, 3, 4]<FORK>body<PAGE>",
    "  \n<PAGE><PAGE>a<PA", "lead text<PAGE>x_1 = y^2\n```\nx_1 = 2\n```\nz_2 = 4", "", "a\r\nb\rc\n\nd", "<|det|>title [1, 2, 3, 4]<|/det|>T<PAGE><|det|>text [5, 6, 7, 8]<|/det|>b",
    "\n".join(f"# {k}. again" for k in range(1, 30)), "\n".join(f"line number {k} of the same template" for k in range(80)),
]


def whole(machine, pieces):
    out = [e for p in pieces for e in machine.feed(p)] + machine.finish()
    merged = []
    for kind, data in out:
        if kind == "text" and merged and merged[-1][0] == "text":
            merged[-1] = ("text", merged[-1][1] + data)
        else:
            merged.append((kind, data))
    return merged


@pytest.mark.parametrize("make", [M.PageFramer, M.BlockHeaders, M.Lines, M.RepetitionGuard, M.Grounding, M.MathLines, M.Coalescer])
def test_every_cut_gives_the_batch_result(make):
    rng = random.Random(5)
    for text in TEXTS:
        want = whole(make(), [text])
        assert whole(make(), list(text)) == want
        cuts = [[text[:k], text[k:]] for k in range(len(text) + 1)] if len(text) < 200 else []
        for _ in range(10):
            at = sorted(rng.randrange(len(text) + 1) for _ in range(4))
            cuts.append([text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)])
        for pieces in cuts:
            machine, out = make(), []
            for p in pieces:  # the state travels as a dict, as in a stream
                machine = make(machine.s)
                out += machine.feed(p)
            out += machine.finish()
            assert whole(_Replay(out), []) == want


class _Replay:
    def __init__(self, events):
        self.events = events

    def feed(self, _):
        return []

    def finish(self):
        return self.events


def test_framing_counts_pages():
    assert whole(M.PageFramer(expected=3), ["a<PAGE>b"]) == [("page", "1"), ("text", "a"), ("page", "2"), ("text", "b"), ("page", "3")]
    assert [e for e in whole(M.PageFramer(expected=1), ["<PAGE>a<PAGE>b"]) if e[0] == "page"] == [("page", "1")]
    with pytest.raises(ValueError):
        M.BlockHeaders().feed("<BLOCK>" + "x" * 2000)


def test_rate_limiter_equals_a_plain_window():
    rng, limiter, kept = random.Random(1), M.RateLimiter(span=100, limit=3), []
    t = 0
    for _ in range(400):
        t += rng.randint(0, 40)
        kept = [x for x in kept if x > t - 100]
        wait = limiter.hit(t)
        if len(kept) < 3:
            assert wait is None
            kept.append(t)
        else:
            assert wait == 100 - (t - kept[len(kept) - 3]) and wait > 0


def test_runaway_guard():
    guard = M.RunawayGuard({"prompt": 500, "chars": 0, "looked": 0, "stop": ""})
    assert [e for _ in range(5) for e in guard.feed("x" * 700)] == [("stop", "runaway")]


def rows_of(texts, size=5):
    return [(k, n, t[a : a + size]) for k, t in enumerate(texts) for n, a in enumerate(range(0, len(t), size))]


@pytest.mark.parametrize("make", [M.PageFramer, M.Lines, M.Grounding])
def test_keys_follow_each_other_through_a_task(spark, make):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # keys cross batches
    try:
        rows = [(None if k == 3 else k, n, t) for k, n, t in rows_of(TEXTS)]
        rows.sort(key=lambda r: -r[1])
        found = processors.run_batch(spark.createDataFrame(rows, "key int, seq int, text string"), make)
        grouped = [(None if k == 3 else k, [x for j, _, x in rows_of(TEXTS) if j == k]) for k in range(len(TEXTS))] + [(99, None)]
        pieces = processors.run_pieces(spark.createDataFrame(grouped, "key int, pieces array<string>"), make)
        want = set()
        for k, (key, texts) in enumerate(grouped[:-1]):
            machine = make()
            events = [e for x in texts for e in machine.feed(x)] + machine.finish()
            want |= {(None if key is None else str(k), n, *e) for n, e in enumerate(events)}
        assert {tuple(r) for r in found.collect()} == want and {tuple(r) for r in pieces.collect()} == want
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()  # no frame to a key
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_held_back_is_the_longest_beginning():
    for mark in (M.PAGE, "<|det|>", "aab"):
        for text in ("", "x", *(f"{x}{mark[:n]}{y}" for n in range(len(mark) + 1) for x in ("", "a", "<", "aa<|") for y in ("", "a", "<", "b"))):
            want = max((n for n in range(1, len(mark)) if n <= len(text) and text.endswith(mark[:n])), default=0)
            assert M.held_back(text, mark) == want


def test_batch_and_stream_agree(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    texts = [t for t in TEXTS[:3] if t]
    rows = rows_of(texts)
    batch = processors.run_batch(spark.createDataFrame(rows, "key int, seq int, text string"), M.PageFramer)
    want = {k: M.joined([(r.event, r.data) for r in batch.where(F.col("key") == str(k)).orderBy("seq").collect()]) for k in range(len(texts))}
    source = tmp_path / "in"
    source.mkdir()
    ends = [(k, 10_000, "\u0004") for k in range(len(texts))]
    parts = [rows[::1][: len(rows) // 2], rows[len(rows) // 2 :], ends]
    schema = "key int, seq int, text string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / f"w{n}"))
        next((tmp_path / f"w{n}").glob("part-*")).rename(source / f"{n}.json")
        time.sleep(0.05)
    out = processors.run_stream(stream, M.PageFramer)
    q = out.writeStream.format("memory").queryName("framed").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("framed").collect()
    for k in want:
        events = sorted((r.seq, r.event, r.data) for r in got if r.key == str(k))
        assert M.joined([(e, d) for _, e, d in events]) == want[k]


def test_windows_and_upserts(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:0{m}:00", m) for m in range(6)] + [("b", "2024-01-01 00:01:30", 9)]
    spark.createDataFrame(rows, "k string, t string, v int").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t timestamp_ntz, v int").json(str(tmp_path / "in"))
    q = processors.windowed_counts(stream, "t", "k", "2 minutes", "1 minute").writeStream.format("memory").queryName("wins").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.k, r.n) for r in spark.table("wins").collect()) == [("a", 2), ("a", 2), ("a", 2), ("b", 1)]
    q = processors.upsert_batches(stream, str(tmp_path / "out"), str(tmp_path / "c2"), ["k"], "v").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out" / "v=0")).collect()) == [("a", 5), ("b", 9)]
    last = processors.last_activity(spark.read.json(str(tmp_path / "in")), "k", "t")
    assert {r.k: r.n for r in last.collect()} == {"a": 6, "b": 1}
