"""Operators 5 and 6, the queries' shape and the pipeline."""

import hashlib
import random
import re

import pytest

import corpus_pipeline
from leafmill.llm import catalog, pii, url_filter
from tests.llm.conftest import make


def captures(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, fetched_at long, host string, pattern string")


def test_urls_are_judged_as_of_their_fetch_time(spark):
    entries = [("bad.example.com", "block", 10), ("bad.example.com", "off", 20), ("bad.example.com", "block", 30), ("example.org", "block", 5), ("ok.example.org", "allow", 8), ("a.example.net/x", "block", 1), (None, "block", 1), ("z.com", None, 1), ("z.com", "block", None), ("t.com", "allow", 3), ("t.com", "block", 3)]
    rows = [("http://bad.example.com/a", t) for t in (9, 10, 19, 20, 29, 30)] + [("https://www.OK.example.org:80/", 7), ("https://ok.example.org/", 8), ("http://u@deep.ok.example.org", 9), ("http://a.example.net/x/y?q", 1), ("http://a.example.net/y", 1), (None, 5), ("no url", 5), ("http://z.com", 5), ("http://example.org", None), ("http://t.com./", 3), ("http://t.com./", 3)]
    df = captures(spark, [(k, u, t, "h", "p") for k, (u, t) in enumerate(rows)])
    got = sorted((r.page_id, r.verdict, r.listed_at) for r in url_filter.filter_captures(df, spark.createDataFrame(entries, "pattern string, action string, listed_at long"), ["page_id"]).collect())
    want = ["none", "block", "block", "none", "none", "block", "block", "allow", "allow", "block", "none", "none", "none", "none", "none", "block", "block"]
    assert [v for _, v, _ in got] == want and got[1][2] == 10 and got[5][2] == 30
    none = spark.createDataFrame([], "pattern string, action string, listed_at long")
    assert url_filter.filter_captures(df, none, ["page_id"]).where("blocked").count() == 0
    assert url_filter.filter_captures(df.where("false"), none, ["page_id"]).count() == 0


def test_patterns_of_paths_and_parents(spark):
    entries = [("HTTP://user@WWW.Bad.com.:80/a/b/?q", "block", 0), ("good.net/x", "allow", 0), ("good.net", "block", 0), ("exact.org/p/q/r.html", "block", 0), ("  ", "block", 0), ("/path", "block", 0)]
    urls = ["http://bad.com/a/b", "http://bad.com/a/b/c?d", "http://bad.com/a", "http://bad.com/a/bc", "http://sub.bad.com/a/b/", "http://good.net/x/1", "http://a.good.net/x", "http://good.net/y", "http://exact.org/p/q/r.html#f", "http://exact.org/p/q", "http://other.org//a"]
    df = captures(spark, [(k, u, 1, "h", "p") for k, u in enumerate(urls)])
    got = sorted((r.page_id, r.verdict, r.pattern) for r in url_filter.filter_captures(df, spark.createDataFrame(entries, "pattern string, action string, listed_at long"), ["page_id"]).collect())
    assert [v for _, v, _ in got] == ["block", "block", "none", "none", "block", "allow", "allow", "block", "block", "none", "none"]
    assert got[0][2] == "bad.com/a/b" and got[8][2] == "exact.org/p/q/r.html"


def test_a_long_list_is_joined_without_a_broadcast(spark, monkeypatch):
    df = captures(spark, [(k, f"http://h{k % 7}.com/{k}", k % 40, "h", "p") for k in range(300)])
    entries = spark.createDataFrame([(f"h{k % 9}.com", ["block", "off", "allow"][k % 3], k * 5 % 37) for k in range(40)], "pattern string, action string, listed_at long")
    want = sorted(map(str, url_filter.filter_captures(df, entries, ["page_id"]).collect()))
    monkeypatch.setattr(url_filter, "BROADCAST_ENTRIES", 1)
    assert sorted(map(str, url_filter.filter_captures(df, entries, ["page_id"]).collect())) == want


# The plain patterns of the base spans.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), n, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(4)
    texts = [None, "", "a@b.c+d@e.f", "a@b.com_x@y.z", "é😀 x@y.de 1.2.3.4.5.6.7.8 256.1.1.1", "4111-1111-1111-1111 and 4111111111111111-", "+1 (017) 555-7713", "1" * 20_000, "1 " * 5000, "a." * 9000 + "@b.c", "x@" + "a." * 5000 + "a", "a@b.c " * 600]
    texts += ["".join(rng.choice("a1.@- +(4é") for _ in range(rng.randint(5, 60))) for _ in range(400)]
    texts += ["".join(rng.choice("0123456789 -") for _ in range(rng.randint(10, 50))) for _ in range(400)]
    got = {r.doc_id: r for r in pii.pii_spans(make(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        spans = plain_spans(t)
        text = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        assert got[k].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
        assert [got[k][f"n_{kind}"] for kind in PLAIN] == [sum(s[3] == kind for s in spans) for kind in PLAIN]


def test_disclosing_terms(spark):
    near = [(k, f"Wilbert{k % 9} met agent Kowalczyk at noon {k} near joe@x.org on the quay {k}") for k in range(60)]
    far = [(100 + k, f"the noon near quay met agent on {k}") for k in range(600)]
    lone = [(900, "Mirabel wrote once to ann@y.org"), (901, "Mirabel wrote once to ann@y.org"), (902, "Kowalczyk alone")]
    df = make(spark, near + far + lone)
    got = {r.doc_id: r for r in pii.pii_spans(df).collect()}
    assert all(got[k].spans.split(",")[0] == f"term:{t.index('Kowalczyk')}:{t.index('Kowalczyk') + 9}" and got[k].n_terms == 1 for k, t in near)
    assert all(got[k].n_terms == 0 for k, _ in far + lone)  # common terms, one surrounding only, no entity near
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[0] == "Wilbert0 met agent  at noon 0 near <email> on the quay 0" and clean[902] == "Kowalczyk alone" and clean[900] == "Mirabel wrote once to <email>"


def test_disclosing_terms_far_from_the_entity_and_at_the_end(spark):
    filler = "of the and so on with more " * 40  # some 1,000 characters
    apart = [(k, f"Kowalczyk was seen {filler} write {k} to joe@x.org now {filler} by kowalczyk") for k in range(12)]
    last = [(100 + k, f"write {k} to ann@y.org now Mirabel") for k in range(12)]
    copies = [(200 + k, f"Oberwald {filler} to eve@z.org {filler}") for k in range(5)]
    once = [(300, f"Lindqvist {filler} a1 ivo@v.org {filler} b2 ivo@v.org {filler} c3 ivo@v.org")]
    plain = [(1000 + k, f"{filler} was seen write now by {k}") for k in range(300)]
    df = make(spark, apart + last + copies + once + plain)
    got = {r.doc_id: r for r in pii.pii_spans(df).collect()}
    for k, t in apart + last:
        spans = [x.split(":") for x in got[k].spans.split(",")]
        terms = [t[int(a) : int(b)].lower() for kind, a, b in spans if kind == "term"]
        assert terms == (["kowalczyk"] * 2 if k < 100 else ["mirabel"]), k
    assert all(got[k].n_terms == 0 for k, _ in copies + once + plain)  # one passage or one document is no evidence
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "owalczyk" not in clean[0] and clean[100] == "write 0 to <email> now " and "Oberwald" in clean[200] and "Lindqvist" in clean[300]


def test_sanitised_rows_keep_their_columns(spark, docs, corpus, empty):
    out = pii.sanitise(docs, length_col="n_chars")
    assert out.columns == docs.columns and out.count() == len(corpus)
    assert sorted(r.text or "" for r in out.collect()) == sorted(t or "" for _, t in corpus)
    assert pii.sanitise(empty).count() == 0 and pii.pii_spans(empty).count() == 0
    overlap = make(spark, [(1, "call +1.2.3.4.5.6.7.8.9 or 1.2.3.4@x.org now")])
    row = pii.sanitise(overlap, length_col="n_chars").first()
    assert "1.2" not in row.text and row.n_chars == len(row.text)


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_cover_their_table(spark, small, name):
    source = {"op5_url_filter": "pages", "op7_embedding_dedup": "embeddings"}.get(name, "documents")
    key = {"pages": "page_id", "embeddings": "vec_id"}.get(source, "doc_id")
    ids = sorted(r[0] for r in spark.read.parquet(f"{small}/{source}.parquet").select(key).collect())
    assert sorted(r[0] for r in catalog.QUERIES[name](spark, small).select(key).collect()) == ids


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small).cache()
        if name != "encoding":
            assert out.columns == docs.columns
        sizes.append(out.count())
        docs = out
    assert sizes[0] >= sizes[1] > sizes[2] >= sizes[3] == sizes[4] == sizes[5] > 0
    assert docs.select("doc_id").distinct().count() == sizes[-1]
    assert corpus_pipeline.run(spark, small).count() == sizes[-1]


def test_pipeline_stages_on_nothing_and_on_odd_rows(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = [(1, None), (1, None), (2, ""), (3, "!!!"), (None, "a text without an id"), (None, "a text without an id"), (4, "word " * 30_000)]
    odd = spark.createDataFrame([(k, t, None, None, 0, "x") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    kept = odd
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path)).cache()
        if name != "encoding":
            assert kept.columns == odd.columns
        assert kept.count() == (7 if name == "quality" else 6)
    assert sorted(r.n_tokens for r in kept.collect())[:3] == [0, 0, 0]
