"""Goldens and plain twins of operators whose semantics SQL cannot state, nulls and odd rows included."""

import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.functions import markdown, markup, unicode
from leafmill.functions import text as T
from leafmill.functions.arrays import running_total
from leafmill.operators import align, control, evaluate, fidelity, folds, gates, jobs, ladder, masking, pages, repetition, textlayer, units


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k long, v {kind}")
    return [r.x for r in df.select("k", expr(F.col("v")).alias("x")).orderBy("k").collect()]


def test_text_functions(spark):
    assert column(spark, [" \t a b\n ", "", None], T.strip_ws) == ["a b", "", None]
    assert column(spark, ["ab é", "a", ""], T.char_bigrams) == [["ab", "b ", " é"], [], []]
    assert column(spark, ["x" * 100, "x" * 10], lambda c: T.probes(c, 32, 24)) == [["x" * 32] * 3, []]
    assert column(spark, ["<|<|a|>b|>c<PAGE>"], T.sanitize) == ["c⟨PAGE⟩"]
    assert column(spark, ["<think>a</think> x", "```\nx\n```"], T.strip_think) == ["x", "x"]
    assert column(spark, [[3, 1, 2] * 200, []], running_total, "array<int>") == [[sum(([3, 1, 2] * 200)[: k + 1]) for k in range(600)], []]


def test_skip_reasons(spark):
    texts = ["", "  \n", "[1] A, Title\n[2] B, Title", "[1] A. Proc. 2020, vol. 3", "[1] hello there friend", "한국어 문장", "arXiv:2401.00001v2", "x = 1;\ny = 2;", "a, b, c, d, e, f, g, h", "1 + 2 = 3 ...", "This is an ordinary line of text."]
    want = ["non-linguistic", "non-linguistic", "references", "references", "", "already-korean", "identifier", "code", "identifier-list", "non-linguistic", ""]
    assert column(spark, texts, gates.skip_reason) == want


def test_output_reasons(spark):
    src = "A sentence of some length with 2024 in it."
    outs = ["Source: x", "I am unable to help", "짧은 문장 하나가 여기 있다 그리고 2024 더", src, "가" * 30, "번역된 문장이 여기 하나 있다", "번역된 문장이 여기 하나 있다 정말로 그렇다 2,024" * 5, "번역 A sentence of some length with 2024 in it 문서입니다 그리고", "2024", "죄송합니다 2024"]
    df = spark.createDataFrame([(k, src, o) for k, o in enumerate(outs)], "k int, s string, o string")
    got = [r.x for r in df.select("k", gates.output_reason(F.col("s"), F.col("o")).alias("x")).orderBy("k").collect()]
    assert got == ["scaffold", "refusal", "", "hangul-ratio", "repetition", "number-mismatch", "length-ratio", "", "hangul-ratio", "refusal"]
    pairs = [("Abstract", "요약입니다."), ("Abstract", "요약"), ("Abstract", "가" * 10 + " 나다라마" * 10), ("We study translation here", "번역할 수 없는 문장"), ("We study it here now", "번역할 수 없는 문장"), ("I'm sorry", "죄송합니다"), ("One two three four five six seven eight nine ten.", "다음 문서는 번역하지 않습니다: one two three four five six seven eight 이상 그리고 끝"), ("One two three four five six seven eight nine ten.", "하나에서 넷까지(one two three four), 다섯에서 여덟까지의 수(five six seven eight) 그리고 아홉(nine ten) 등")]
    assert [r.x for r in spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, s string, o string").select("k", gates.output_reason(F.col("s"), F.col("o")).alias("x")).orderBy("k").collect()] == ["label-sentence", "", "length-ratio", "", "refusal", "", "echo", ""]


def test_reference_lists_and_code(spark):
    refs = ["[12] Gersho, A. Vector quantization, 1992", "[12] Gersho, A. Vector quantization", "[1] shows that it holds", "[1] see pp. 3", "plain\n[1] a\n[2] b"]
    assert column(spark, refs, gates.is_reference_list) == [True, True, False, True, True]
    texts = [
        "$ ls -l\ntotal 12\n-rw-r--r-- 1 a b", "import os", "import duties rise.", "x == y && f(x)", "[Step: 3/9]", '{"a": 1}', "data[sos+4] = 2", "make: No such file",
        "$ Since there are no other ways to do this we build it here\nx = 1", "x = 1\n한국어", "a, b, c, d, e, f, g, h.i", "A title of some kind", "see main.rs for f(x)",
    ]
    assert column(spark, texts, gates.code_reason) == ["code", "code", "", "code", "code", "code", "code", "code", "", "", "identifier-list", "", "code"]


def test_repetition(spark):
    assert column(spark, ["ab" * 60, "abc", "-" * 200, "no" * 5], gates.longest_repetition) == [120, 0, 0, 0]
    assert column(spark, [" ".join(f"# {k}." for k in range(1, 25)), "# 1. # 3."], lambda c: repetition.counter_runs(c, 20)) == [24, 0]
    rng = random.Random(1)
    for _ in range(20):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        recent = words[-10:]
        want = sorted({recent[i + 2] for i in range(len(recent) - 2) if recent[i : i + 2] == recent[-2:]}) if len(recent) >= 3 else []
        assert column(spark, [words], lambda c: repetition.banned_followers(c, 3, 10), "array<string>") == [want]
    assert markup.tandem("x " + "over and over " * 300) == len("over and over " * 300)
    assert markup.tandem("word " * 10) == 0 and markup.tandem("| " * 4000) == 0


def test_fidelity(spark):
    rows = [(1, "abcd" * 100, "abcd" * 100), (2, "abcd" * 100, "abcd" * 200), (3, "short", "short"), (4, "abcdefgh" * 40, None), (5, None, "x")]
    df = spark.createDataFrame(rows, "k long, t string, c string")
    got = {r.k: r.score for r in fidelity.page_fidelity(df, ["k"], "t", "c").collect()}
    assert got == {1: 1.0, 2: 0.65, 3: None, 4: 0.0, 5: None}
    a, b = spark.createDataFrame([(1, "abab"), (2, "")], "k long, text string"), spark.createDataFrame([(1, "abxab"), (2, "zz")], "k long, text string")
    assert {r.k: (r.shared, r.total) for r in fidelity.containment(a, b, ["k"]).collect()} == {1: (2, 3), 2: (0, 0)}
    p = spark.createDataFrame([(1, k, s, lost) for k, (s, lost) in enumerate([(0.1, False), (0.2, True), (0.9, False), (None, False), (0.3, False)])], "doc_id long, page long, score double, lost boolean")
    assert [r.decision for r in fidelity.decisions(p, 0.1).orderBy("page").collect()] == ["retry", "retry", "kept", "unmeasurable", "skipped"]


def brute_alignment(table, models, n):
    best = (0.0, [])
    def go(i, j, total, picked):
        nonlocal best
        if total > best[0] + 1e-12:
            best = (total, list(picked))
        for a in range(i, models + 1):
            for b in range(j, n + 1):
                if table.get((a, b), 0) >= align.LEAST_SCORE:
                    go(a + 1, b + 1, total + table[a, b], [*picked, (a, b)])
    go(1, 1, 0.0, [])
    return best[0]


def test_monotone_alignment_is_optimal(spark):
    rng = random.Random(2)
    for _ in range(40):
        models, n = rng.randint(1, 4), rng.randint(1, 4)
        table = {(a, b): round(rng.random(), 2) for a in range(1, models + 1) for b in range(1, n + 1)}
        frame = pd.DataFrame([(a, b, s) for (a, b), s in table.items()], columns=["model", "page", "score"])
        found = align.monotone(frame, models, n)
        used = [p for p in found if p is not None]
        assert used == sorted(set(used))
        assert abs(sum(table[k + 1, p] for k, p in enumerate(found) if p is not None) - brute_alignment(table, models, n)) < 1e-9


def test_slots(spark):
    rows = [(1, m, p) for m, p in enumerate([None, 2, None, None, 5, None, 9, None], 1)] + [(2, 1, None)]
    got = align.fill_slots(spark.createDataFrame(rows, "doc_id long, model long, page long"), "doc_id").orderBy("doc_id", "model").collect()
    assert [r.slot for r in got] == [1, 2, 3, 4, 5, 5, 9, 9, 1]
    assert align.merge_lines(["ab cd", "ef"], ["x", "abcd e", "zz", "ef"]) == [1, 3] and align.merge_lines(["q"], ["x"]) is None


def test_masking_is_loss_free(spark):
    rng = random.Random(3)
    parts = ["`code`", "$x_1$", "$5", "[1, 2]", "Fig. 3", "https://a.b/c", "<b>", "![a](b)", "⟦c1⟧", " word ", "\n", "$$y$$", "a@b.co", "```\nx\n```"]
    for _ in range(200):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        masked, kept = masking.mask(text)
        assert masking.unmask(masked, kept) == (text, [], [])
        assert len({name for name, _, _ in kept}) == len(kept)
    masked, kept = masking.mask("see `a` and [1]")
    assert masked == "see ⟦c1⟧ and ⟦c2⟧" and [k for _, k, _ in kept] == ["code", "cite"]
    assert masking.unmask("only ⟦ c2 ⟧ ⟦c2⟧ ⟦z9⟧", kept) == ("only [1]  ", ["c1"], ["c2", "z9"])
    assert masking.sanitize("# Title\n- item $x", "Title item x") == ("Title\nitem x", 3)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "`a`")], "doc_id long, text string")
    assert [r.masked for r in masking.mask_rows(df, "doc_id").orderBy("doc_id").collect()] == ["", "", "⟦c1⟧"]


def test_ladder_reasons(spark):
    calls = []

    def provider(step, texts):
        out = []
        for t in texts:
            good = "가나다 " * max(1, len(t.replace(" ", "")) // 3)
            fault = {"first": "FIRST" in t or "REPAIR" in t or "SPLIT" in t or "NEVER" in t, "repair": "REPAIR" in t or "SPLIT" in t or "NEVER" in t, "split": "NEVER" in t}[step]
            out.append("Source: " + t if fault else good)
        return out

    texts = ["Plain words stand here today.", "FIRST words stand here today.", "REPAIR words that stand here alone", "SPLIT words stand here. And more of them here too.", "NEVER words stand here. NEVER any more of them here.", "", "Plain words stand here today."]
    rows = spark.createDataFrame([(f"u{k}", t) for k, t in enumerate(texts)], "unit_id string, src string")
    got = {r.unit_id: r for r in ladder.translate(rows, provider).collect()}
    assert [got[f"u{k}"].how for k in range(7)] == ["first", "repair", "kept", "split", "kept", "skipped", "first"]
    assert got["u4"].out == texts[4] and got["u4"].reason == "scaffold" and calls == []


def test_ladder_judges_each_output_once(spark):
    judged = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def verdict(src, out):
        judged.add(1)
        return "bad" if out != "good" else ""

    rows = spark.createDataFrame([(f"u{k}", t) for k, t in enumerate(["Ordinary words stand here", "FIRST words stand here. And more here", "Ordinary words stand here"])], "unit_id string, src string")
    provider = lambda step, texts: ["bad" if "FIRST" in t and step != "split" else "good" for t in texts]
    got = sorted((r.unit_id, r.out, r.how, r.reason) for r in ladder.translate(rows, provider, judge=verdict).collect())
    assert got == [("u0", "good", "first", ""), ("u1", "goodgood", "split", ""), ("u2", "good", "first", "")]
    assert judged.value == 2 + 1 + 2  # two sources, one of them again, then its two parts


def test_repetitions_of_every_unit_and_offset(spark):
    unit = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ가나다🙂"
    texts = ["0123456"[:at] + unit[-size:] * times + "!" for size in range(1, 41) for at in range(7) for times in (7, 8)]
    found = column(spark, texts, gates.longest_repetition)
    assert found == [size * 8 if times == 8 and any(c.isalnum() for c in unit[-size:]) else 0 for size in range(1, 41) for at in range(7) for times in (7, 8)]
    assert column(spark, [None, ""], gates.repetition_spans) == [None, []]


def test_tables_and_markup():
    html = "<table><tr><th rowspan=2>a</th><th>b</th></tr><tr><td>c<br>d</td></tr></table>"
    assert markup.table_matrix(html) == [["a", "b"], ["a", "c d"]]
    assert markup.table_matrix("<table><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>") is None
    assert markup.table_cells("no table") is None
    large = "<table>" + "".join("<tr>" + "".join(f"<td>{r}.{c}</td>" for c in range(90)) + "</tr>" for r in range(60)) + "</table>"
    assert len(markup.table_cells(large)) == 5400 and markup.table_matrix(large)[59][89] == "59.89"
    assert markup.table_cells("<table><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>") is None
    assert markup.table_cells("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>") is not None
    assert markup.table_cells("<table><tr><td rowspan=2>a</td><td rowspan=2>b</td></tr><tr></tr></table>") is not None
    assert markup.table_cells("<table><tr><td>a</td><td rowspan=2>b</td></tr><tr><td colspan=2>c</td></tr></table>") is None
    assert markup.balance_table_tags("<table><tr><td>x</tr></td></table></table>") == "<table><tr><td>x</td></tr></table>"
    assert markup.restore_table_tags("&lt;td colspan=&quot;2&quot;&gt;&lt;script&gt;") == '<td colspan="2">&lt;script&gt;'
    assert markup.plain_math(r"\frac{1}{x^{2}} \leq \sqrt{a_{i}} \foo") == "1/x² ≤ √a(i) foo"
    forms = {
        r"\(E=mc^{2}\)": "E=mc²", r"\frac{a+b}{\sqrt{d_k}}": "(a+b)/√d(k)", r"\binom n 2": "C(n, 2)", r"\mathbb{R}^{d} \hat{y}": "ℝ^(d) y\u0302", r"\sqrt[3]{x} \{a\}": "³√x {a}",
        r"x<sub>1</sub> \cdot \left( \text{if } n-1 \right)": "x(1) · ( if n-1 )", r"3\,GB \| x \|": "3 GB ‖ x ‖", r"\frac{1": r"frac1", "a\n\n  b  c": "a\nb c", "x^": "x^", "": "",
    }
    assert {x: markup.plain_math(x) for x in forms} == forms
    assert markup.recover_math("so x_1 = y^2 + 3\n```\nx_1 = 2\n```\na = b and `x_1 = 2`") == "so \\(x_1 = y^2 + 3\\)\n```\nx_1 = 2\n```\na = b and `x_1 = 2`"
    assert [(r["kind"], r["text"]) for r in markup.split_inline_math("costs $5, but \\[ x^2 \\] and \\(y\\)\\( \\)")] == [("text", "costs $5, but "), ("math", "x^2"), ("text", " and "), ("math", "y")]
    assert markup.split_inline_math("") == [{"kind": "text", "text": "", "display": False}]
    assert markup.dollar_delimiters("a \\(b\n\n c\\) \\\\[2pt] $x$ $5 to $6") == "a \\(b\n\n c\\) \\\\[2pt] $x$ \\$5 to \\$6"
    assert markup.strip_markdown("# A **b** `*c*`\n> q", "plain") == "A b `*c*`\nq" and markup.strip_markdown("# A", "# x") == "# A"
    assert markup.equation_found("as \\(a + b\\) shows", "a+b") and markup.equation_found("value: 2 = 1, 1", "2=1") and not markup.equation_found("c + a + b", "a+b")
    found = lambda page, want="E=mc^2": markup.equation_found(page, want)
    assert all(map(found, ["$E = m c^{2}$", "\\[E=\\mathrm{m}c^2\\]", "so E = mc^2, where", "E=mc^2\n= 3", "<b>E=mc^2</b>", "E − x $E=mc^{ 2 }$", "E=mc^2. Next"]))
    assert not any(map(found, ["$E=mc^2+1$", "E=mc^2.5", "E = mc^2 + 1", "E=mc^2x", "E=mc^2 x + 1", "E=mc^2 7", "2E=mc^2", "- E=mc^2", "E=mc^{*2}", "$E=mc^2", "E=mc^2 \\alpha"][:9]))
    assert markup.math_text("\\left( a \\times \\sqrt{x_{i}+1} \\right)") == "(a*sqrt(x_i+1))" and markup.math_text("a)") is None and markup.math_text("\\alpha") is None
    assert found("a \\cdot b = &lt; 3".replace("&lt; ", ""), "a*b=3") and found("x ≤ 2", "x≤2")
    with pytest.raises(ValueError):
        markup.equation_found("x", "\\int x")


def test_folds(spark):
    spans = spark.createDataFrame([(1, k, 0.0, y) for k, y in enumerate([0.0, 1.0, 1.2, 2.4, 3.0])], "page long, span long, x double, y double")
    assert [r.line for r in folds.visual_lines(spans, "page", 1.0).orderBy("span").collect()] == [0, 0, 0, 1, 1]  # by the anchor, not by the neighbour
    blocks = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 12, 0, 20, 10), (1, 3, 40, 0, 50, 10), (1, 4, 0, 30, 10, 40)], "page long, idx long, x0 long, y0 long, x1 long, y1 long")
    assert markup.recover_math_line("z" * 5000 + " so x_1 = y^2 + 3").endswith("\\(x_1 = y^2 + 3\\)")
    wide = spark.range(6000).selectExpr("1L page", "id idx", "id * 20 x0", "0L y0", "id * 20 + 15 x1", "10L y1")
    assert folds.merge_fragments(wide, "page").collect()[0].n == 6000
    assert [(r.x0, r.x1, r.n) for r in folds.merge_fragments(blocks, "page").orderBy("group").collect()] == [(0, 20, 2), (40, 50, 1), (0, 10, 1)]
    own = spark.createDataFrame([(k, 1) for k in range(6)], "node long, cost long")
    edges = spark.createDataFrame([(0, 1), (0, 1), (1, 2), (3, 4), (4, 3)], "node long, child long")
    assert {r.node: r.cost for r in folds.dag_cost(edges, own, 100).collect()} == {0: 5, 1: 2, 2: 1, 3: 100, 4: 100, 5: 1}


def test_geometry(spark):
    df = spark.createDataFrame([(0, 0, 10, 10, 5, 5, 20, 20), (0, 0, 10, 10, 30, 30, 40, 40), (0, 0, 10, 10, 2, 2, 4, 4)], "a long, b long, c long, d long, e long, f long, g long, h long")
    one, two = G.box(*(F.col(x) for x in "abcd")), G.box(*(F.col(x) for x in "efgh"))
    rows = df.select(G.overlap(one, two).alias("o"), G.iou(one, two).alias("i"), G.minus(one, two).alias("m")).collect()
    assert [r.o for r in rows] == [25, 0, 4] and rows[0].i == 25 / 300
    for r, want in zip(rows, (75, 100, 96), strict=True):
        assert sum((s.x1 - s.x0) * (s.y1 - s.y0) for s in r.m) == want


def test_jobs(spark):
    j = spark.createDataFrame([(1, "queued", 5), (2, "queued", None), (3, "done", 1), (4, "queued", 2), (5, None, 9)], "job_id long, status string, submit_seq long")
    assert {r.job_id: r.position for r in jobs.queue_position(j).collect()} == {1: 2, 2: 3, 3: None, 4: 1, 5: None}
    e = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (1, 3, "-", True), (1, 4, "c", False), (2, 1, "x", False)], "k long, seq long, text string, r boolean")
    assert {r.k: r.log for r in jobs.replay_log(e, "k", ["seq"], F.col("r"), "text").collect()} == {1: "c", 2: "x"}
    w = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 3.0), ("a", 9.0, 1.0), ("b", 4.0, 1.0)], "g string, v double, w double")
    assert {r.g: r.median for r in jobs.weighted_median(w, ["g"], "v", "w").collect()} == {"a": 2.0, "b": 4.0}
    page = jobs.keyset_page(j, "job_id", "job_id", (4, 4), 2).orderBy("rank").collect()
    assert [(r.job_id, r.has_more) for r in page] == [(3, True), (2, True)]


def test_pages_and_units(spark):
    df = spark.createDataFrame([(1, "<PAGE>a<PAGE>b"), (2, "x<PAGE>a"), (3, "none"), (4, "")], "doc_id long, text string")
    assert [r.p for r in df.select("doc_id", pages.split_marked(F.col("text")).alias("p")).orderBy("doc_id").collect()] == [["a", "b"], ["x", "a"], ["none"], [""]]
    u = spark.createDataFrame([(1, 1, "u1", "a"), (1, 2, "u2", "b\n---\n")], "doc_id long, page long, unit_id string, src string")
    t = spark.createDataFrame([("u2", "\n B\n---\nC  ")], "unit_id string, out string")
    assert units.assemble(u, t).first().text == "a\n B\n⸻\nC"
    assert column(spark, ["One two. Three four five. Six", "none"], units.split_two) == [["One two. ", "Three four five. Six"], ["none"]]
    marks = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (1, 3, 9)], "d long, o long, p long")
    assert evaluate.pair_order(marks, "d", "o", "p").first().concordant == 2


@pytest.mark.parametrize("fn", [pages.explode_pages, lambda d: folds.merge_fragments(d.selectExpr("doc_id as page", "1L idx", "1L x0", "1L y0", "1L x1", "1L y1"), "page"), lambda d: masking.mask_rows(d, "doc_id")])
def test_empty_tables(spark, fn):
    assert fn(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_that_begin_at_one_point(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 100, 100)], "page long, box long, x0 long, y0 long, x1 long, y1 long")
    lines = [(1, 0, 0, 10, 40, "a"), (1, 13, 0, 20, 10, "b"), (1, 13, 0, 60, 40, "c")]
    for given in (lines, lines[::-1]):
        rows = spark.createDataFrame(given, "page long, x0 long, y0 long, x1 long, y1 long, text string").coalesce(1)
        assert [r.text for r in textlayer.lines_in_boxes(boxes, rows).collect()] == ["a bc"]


def test_text_layer(spark):
    lines = spark.createDataFrame([(1, 1, 0, 0, 10, 10, "aa", 9.0), (1, 2, 12, 0, 20, 10, "b", 12.0), (1, 3, 0, 11, 10, 20, "cc", 12.0)], "block long, line long, x0 long, y0 long, x1 long, y1 long, text string, size double")
    b = textlayer.text_blocks(lines.withColumn("page", F.lit(1)).withColumn("horizontal", F.lit(True))).first()
    assert (b.text, b.size, b.x1, b.tabular) == ("aa\nb\ncc", 12.0, 20, False)
    boxes = spark.createDataFrame([(1, 1, 0, 0, 30, 12), (1, 2, 50, 50, 60, 60)], "page long, box long, x0 long, y0 long, x1 long, y1 long")
    rows = lines.withColumn("page", F.lit(1).cast("long"))
    assert {r.box: r.text for r in textlayer.lines_in_boxes(boxes, rows).collect()} == {1: "aab", 2: ""}
    assert [r.text for r in textlayer.plain_pages(rows.withColumn("block", F.col("line")), [1, 5]).orderBy("page").collect()] == ["aa\nb\ncc", None]
    im = spark.createDataFrame([(1, 0, 0, 50, 50), (1, 0, 0, 50, 50), (1, 0, 0, 100, 100)], "page long, x0 long, y0 long, x1 long, y1 long").withColumn("width", F.lit(100)).withColumn("height", F.lit(100))
    assert [(r.x1, r.over) for r in textlayer.figures(im).collect()] == [(0.5, False)]
    spans = spark.createDataFrame([(1, 1, 1, "Bold ", True), (1, 1, 2, "two", True), (1, 1, 3, " rest", False), (1, 2, 1, "all", True), (1, 3, 1, "x", False)], "page long, block long, span long, text string, bold boolean")
    assert {r.block: r.prefix for r in textlayer.leading_bold(spans).collect()} == {1: "Bold two", 2: None, 3: None}
    c = spark.createDataFrame([(1, 0, 10.0, 0.0, 90.0), (1, 1, 40.0, 0.0, 90.0), (1, 2, 80.0, 0.0, 90.0), (2, 0, 50.0, 0.0, 90.0), (2, 1, 40.0, 0.0, 90.0)], "page long, k long, c double, lo double, hi double")
    assert [(r.page, r.at) for r in textlayer.boundaries(c).orderBy("page", "k").collect()] == [(1, 25.0), (1, 60.0), (2, 45.0)]
    cells = spark.createDataFrame([(1, 1, 0, 0, 100, 20)], "page long, cell long, x0 long, y0 long, x1 long, y1 long")
    ink = spark.createDataFrame([(1, 9.0, True, 70, 2, 99, 18)], "page long, size double, bold boolean, x0 long, y0 long, x1 long, y1 long")
    assert textlayer.cell_styles(cells, ink).first()[2:] == (9.0, "right", True)
    chain = spark.createDataFrame([(1, k, 8 * k, 0, 8 * k + 10, 5) for k in range(6)] + [(1, 9, 500, 0, 510, 5)], "page long, idx long, x0 long, y0 long, x1 long, y1 long")
    assert {r.idx: r.cluster for r in textlayer.clusters(chain).collect()} == {**dict.fromkeys(range(6), 0), 9: 9}
    links = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "page long, link long, anchor string")
    hits = spark.createDataFrame([(1, 70, "a"), (1, 80, "a")], "page long, hit long, anchor string")
    assert {r.link: r.hit for r in textlayer.relocated_links(links, hits).collect()} == {1: 70, 2: 80, 3: None}


def test_control(spark):
    f = spark.createDataFrame([("/w/.staging-a/x", 10), ("/w/.staging-b/x", 95), ("/w/keep", 1)], "path string, mtime long")
    assert [r.path for r in control.expired_staging(f, 100, 50).collect()] == ["/w/.staging-a/x"]
    k = spark.createDataFrame([("1.1.1.1", "9.9.9.9, 8.8.8.8", True), ("1.1.1.1", "9.9.9.9", False), ("1.1.1.1", None, True)], "d string, c string, t boolean")
    assert [r.x for r in k.select(control.client_key(F.col("d"), F.col("c"), 2, F.col("t")).alias("x")).collect()] == ["9.9.9.9", "1.1.1.1", "1.1.1.1"]
    assert control.variant({"a": 1, "b": 2, "key": "s"}, {"a": 1}, ("key",)).startswith("b=2;key=") and len(control.variant({"key": "s"}, {}, ("key",))) == 20
    e = spark.createDataFrame([(404, "", 1, 2), (400, "Content Policy", 1, 2), (200, "", 2, 2), (None, "", 0, 2)], "s int, b string, u int, l int")
    assert [r.x for r in e.select(control.failure_text(*(F.col(c) for c in "sbul")).alias("x")).collect()] == ["model not found", "content policy", "output limit", "transport"]
    pages_ = spark.createDataFrame([(j, p, "boom" if j == 2 else f"t{p}") for j in (1, 2) for p in (1, 2, 3)], "job long, page long, payload string")

    def run(chunk):
        if any(t == "boom" for _, t in chunk):
            raise RuntimeError("bad page")
        return [t.upper() for _, t in chunk]

    got = control.Engine("test", run, control.Capabilities(chunk=2)).recognise(pages_).orderBy("job", "page").collect()
    assert [r.raw for r in got] == ["T1", "T2", "T3", "", "", ""] and all("bad page" in r.warning for r in got[3:])
    with pytest.raises(KeyError):
        control.engine("none")
    with pytest.raises(ValueError):
        control.register(control.engine("demo"))
    sets = list(control.until_settled(spark.createDataFrame([(k,) for k in range(6)], "k long"), lambda df: df.where("k < 3"), ["k"]))
    assert [s.count() for s in sets] == [6, 3, 3]


def test_exact_forms():
    forms = lambda fn, *texts: fn(pa.array(texts, pa.string())).to_pylist()
    assert forms(unicode.comparison_forms, "<b>ﬁne</b> Ⅳ \\alpha Straße_1", None, "", "\\Gamma\\frac{\\theta}2 <a, b> <td colspan=2>x</td> \\varphi \\ell \\") == ["fineivαstrasse1", None, "", "γθ2abxφℓ"]
    assert forms(unicode.truth_forms, "![x](y) a &amp; B <i>c</i>", None, "\\text{Fo o}\\mathrm {b} <x y> É") == ["abc", None, "foobé"]
    assert len(unicode.LETTERS) == 37


def test_markdown_blocks_cover_every_line():
    rng = random.Random(9)
    parts = ["# h", "", "text", "- item", "> q", "```", "~~~", "| a | b |", "|---|---|", "<div>", "---", "  ", "1. x", "<table><tr><td>x"]
    for _ in range(300):
        text = "\n".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        blocks, lines = markdown.page_blocks(text), text.split("\n")
        seen = [k for b in blocks for k in range(b["start"], b["stop"])]
        assert seen == sorted(set(seen)) and all(not lines[k].strip() for k in set(range(len(lines))) - set(seen))
        out = markdown.to_html(text)
        assert "<div>" not in out and out.count("<table") == out.count("</table")
    assert markdown.to_html("# A *b* <i>\n\nx `a<b` **c**") == "<h1>A <em>b</em> &lt;i&gt;</h1>\n<p>x <code>a&lt;b</code> <strong>c</strong></p>"
    assert [b["kind"] for b in markdown.page_blocks("a\nb\n# c\n- d\n  e\n\n```\n\n```\nf")] == ["paragraph", "heading", "list", "fence", "paragraph"]


def test_flow_components(spark):
    rows = [(1, 1, 0, 0, 100, 10), (1, 2, 0, 20, 90, 30), (1, 3, 200, 0, 300, 10), (1, 4, 0, 200, 100, 210), (1, 5, 210, 20, 290, 30)]
    got = folds.flow_components(spark.createDataFrame(rows, "page long, idx long, x0 long, y0 long, x1 long, y1 long"), "page")
    assert {r.idx: r.component for r in got.collect()} == {1: 0, 2: 0, 3: 1, 4: 2, 5: 1}
