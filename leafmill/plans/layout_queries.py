"""Queries over layout blocks. The tables hold none: they are derived from lineitem in both engines, integers only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.operators import evaluate, layout
from leafmill.plans.registry import query, table

BLOCK = """select l_orderkey as page, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as idx,
  case l_returnflag when 'A' then 'title' when 'N' then 'text' else 'image' end as type, (l_partkey * 7) % 800 as x0, (l_suppkey * 13 + l_linenumber * 90) % 800 as y0, (l_partkey * 7) % 800 + 20 + cast(l_quantity as bigint) * 3 as x1,
  (l_suppkey * 13 + l_linenumber * 90) % 800 + 10 + cast(l_quantity as bigint) as y1, case when l_linenumber % 5 = 0 then '' else concat('part ', l_partkey % 97, ' of ', l_suppkey % 13) end as content from lineitem"""
B = f"b as ({BLOCK})"
CHANGED = "t as (select page, idx + case when page % 97 = 1 then 1 else 0 end as idx, case when page % 97 = 2 then 'note' else type end as type, x0, y0, x1 + case when page % 97 = 3 then 1 else 0 end as x1, y1, case when (page + idx) % 3 = 0 then content || ' translated' else content || '  ' end as content from b)"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "lineitem").createOrReplaceTempView("_leafmill_lineitem")
    return spark.sql(BLOCK.replace("from lineitem", "from _leafmill_lineitem")).withColumn("idx", F.col("idx").cast("long"))


def _changed(blocks: DataFrame) -> DataFrame:
    return blocks.selectExpr(
        "page", "idx + case when page % 97 = 1 then 1 else 0 end as idx", "case when page % 97 = 2 then 'note' else type end as type", "x0", "y0", "x1 + case when page % 97 = 3 then 1 else 0 end as x1", "y1",
        "case when (page + idx) % 3 = 0 then concat(content, ' translated') else concat(content, '  ') end as content",
    )


@query("layout_alignment", "J01", f"with {B}, {CHANGED} select page, idx, b.type, trim(b.content) <> trim(t.content) as translated from b join t using (page, idx) where b.type = t.type and b.x0 = t.x0 and b.y0 = t.y0 and b.x1 = t.x1 and b.y1 = t.y1 and (trim(b.content) <> '' or trim(t.content) <> '')")
def layout_alignment(spark, d):
    b = _blocks(spark, d)
    return layout.align(b, _changed(b))


@query("layout_pair_violations", "F21 F22 V04", f"""with {B}, {CHANGED} select page, idx, case when t.type is null then 'missing' when b.type is null then 'extra' when b.type <> t.type then 'type' else 'bbox' end as what
from b full join t using (page, idx) where t.type is null or b.type is null or b.type <> t.type or (b.x0, b.y0, b.x1, b.y1) <> (t.x0, t.y0, t.x1, t.y1)""")
def layout_pair_violations(spark, d):
    b = _blocks(spark, d)
    return layout.violations(b, _changed(b))


@query("layout_applied", "K04 M21", f"with {B} select page, idx, type, x0, y0, x1, y1, case when (page + idx) % 3 = 0 then 'out ' || idx else content end as content, case when (page + idx) % 6 = 0 then 'kept' end as preserved from b")
def layout_applied(spark, d):
    b = _blocks(spark, d)
    texts = b.where("(page + idx) % 3 = 0").select("page", "idx", F.concat(F.lit("out "), "idx").alias("out"), F.when((F.col("page") + F.col("idx")) % 6 == 0, "kept").alias("preserved"))
    return layout.apply(b, texts)


@query("grounded_markup_round_trip", "P05 P04 U02", f"with {B} select page, idx, type, x0, y0, x1, y1, case when type = 'image' then '' else content end as content from b")
def grounded_markup_round_trip(spark, d):
    cols = ["type", "x0", "y0", "x1", "y1", "content"]
    raw = _blocks(spark, d).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("idx", *cols))).alias("x")).select("page", layout.to_markup(F.col("x")).alias("raw"))
    back = raw.select("page", F.posexplode(layout.from_markup(F.col("raw"))).alias("p", "b"))
    return back.select("page", (F.col("p") + 1).cast("long").alias("idx"), *(F.col(f"b.{c}").alias(c) for c in cols))


@query("block_headers_normalized", "P06", f"""with {B} select page, idx, '<|ref|>' || type || '<|/ref|><|det|>[[' || x0 || ', ' || y0 || ', ' || x1 || ', ' || y1 || ']]<|/det|>' || content as raw from b""")
def block_headers_normalized(spark, d):
    kind = F.when(F.col("type") == "image", F.when(F.col("idx") % 2 == 0, "figure").otherwise("chart")).otherwise(F.col("type"))
    raw = F.concat(F.lit("<BLOCK>"), kind, F.lit("["), F.concat_ws(", ", "x0", "y0", "x1", "y1"), F.lit("]<FORK>"), "content")
    return _blocks(spark, d).select("page", "idx", layout.normalize_headers(raw).alias("raw"))


@query("block_rect_clamp", "P07 P08 X08", f"""with {B}, c as (select page, idx, least(greatest(least(x0 - 100, x1 + 150), 0), 999) as x0, least(greatest(y0 - 50, 0), 999) as y0, least(greatest(greatest(x0 - 100, x1 + 150), 0), 999) as x1, least(greatest(y1 + 100 - case when idx % 4 = 0 then 2000 else 0 end, 0), 999) as y1 from b)
select page, idx, case when x1 > x0 and greatest(y0, y1) > least(y0, y1) then x0 end as x0, case when x1 > x0 and greatest(y0, y1) > least(y0, y1) then (x1 * 1700) // 999 end as px1,
  least(greatest(round((x0 / 999 * 400 - 8 + 100) / 1700 * 999), 0), 999)::bigint as page_x from c""")
def block_rect_clamp(spark, d):
    b = _blocks(spark, d)
    moved = G.box(F.col("x0") - 100, F.col("y0") - 50, F.col("x1") + 150, F.col("y1") + 100 - F.when(F.col("idx") % 4 == 0, 2000).otherwise(0))
    c = b.select("page", "idx", G.clamped(moved).alias("c"), F.least(F.greatest(F.col("x0") - 100, F.lit(0)), F.lit(999)).alias("raw"))
    crop = G.to_page(F.col("raw"), F.lit(400), 8, F.lit(100), F.lit(1700))
    return c.select("page", "idx", F.col("c.x0").alias("x0"), G.to_pixels(F.col("c.x1"), F.lit(1700)).alias("px1"), crop.alias("page_x"))


OVERLAP = "greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0)"


@query("rect_overlap_pairs", "F11 L12", f"with {B} select a.page, a.idx as i, c.idx as j, {OVERLAP} as overlap from b a join b c on a.page = c.page and a.idx < c.idx where {OVERLAP} > 0.5 * least((a.x1 - a.x0) * (a.y1 - a.y0), (c.x1 - c.x0) * (c.y1 - c.y0))")
def rect_overlap_pairs(spark, d):
    return layout.overlapping_pairs(_blocks(spark, d))


@query("lines_outside_figures", "J09 F10", f"""with {B} select a.page, count(*)::bigint as n, sum(a.idx)::bigint as ids from b a where type <> 'image' and not exists (select 1 from b c where c.page = a.page and c.type = 'image' and {OVERLAP} > 0.5 * (a.x1 - a.x0) * (a.y1 - a.y0)) group by 1""")
def lines_outside_figures(spark, d):
    b = _blocks(spark, d)
    return layout.outside(b.where("type <> 'image'"), b.where("type = 'image'")).groupBy("page").agg(F.count("*").alias("n"), F.sum("idx").alias("ids"))


SPANS = "s as (select page, idx as span, case when idx % 3 = 0 then content else '' end as text, x0 + (page % 7) * 20 as x0, y0 + 3 as y0, x0 + (page % 7) * 20 + 30 as x1, y0 + 11 as y1 from b)"


@query("span_owner", "J10 F20 J12", f"""with {B}, {SPANS},
p as (select s.page, span, c.idx, case when text <> '' and contains(c.content, text) then 1 else 0 end as m, case when a.x0 + a.x1 between 2 * (c.x0 - 1) and 2 * (c.x1 + 1) and a.y0 + a.y1 between 2 * (c.y0 - 1) and 2 * (c.y1 + 1) then 1 else 0 end as i,
  {OVERLAP} as o, (a.x0 + a.x1 - c.x0 - c.x1) ** 2 + (a.y0 + a.y1 - c.y0 - c.y1) ** 2 as d, (c.x1 - c.x0) * (c.y1 - c.y0) as area from s, lateral (select s.x0, s.y0, s.x1, s.y1) a, b c where s.page = c.page),
q as (select * from p where i = 1 or o >= 0.35 * 240), r as (select *, row_number() over (partition by page, span order by m desc, i desc, o desc, d, area, idx) as k from q)
select page, span, case when sum(m) <= 1 then max(case when k = 1 then idx end) end as owner, count(*)::bigint as candidates, sum(m) > 1 as ambiguous from r group by 1, 2""")
def span_owner(spark, d):
    b = _blocks(spark, d)
    s = b.selectExpr("page", "idx as span", "case when idx % 3 = 0 then content else '' end as text", "x0 + (page % 7) * 20 as x0", "y0 + 3 as y0", "x0 + (page % 7) * 20 + 30 as x1", "y0 + 11 as y1")
    return layout.owners(s, b)


@query("inline_rule_owner", "M07", f"""with {B}, r as (select page, idx as rule, x0 + 2 as x0, y0 + 2 as y0, x0 + 20 as x1, y0 + 3 as y1 from b)
select r.page, rule, min(b.idx) as owner from r join b on r.page = b.page and b.content <> '' and r.x0 >= b.x0 - 2 and r.y0 >= b.y0 - 2 and r.x1 <= b.x1 + 2 and r.y1 <= b.y1 + 2 group by 1, 2 having count(*) = 1""")
def inline_rule_owner(spark, d):
    b = _blocks(spark, d)
    return layout.inline_rules(b.selectExpr("page", "idx as rule", "x0 + 2 as x0", "y0 + 2 as y0", "x0 + 20 as x1", "y0 + 3 as y1"), b)


@query("row_partner_band_join", "J17 F14", f"with {B} select a.page, a.idx as i, c.idx as j from b a join b c on a.page = c.page and a.x1 < 500 and c.x0 >= 400 and a.y0 <= c.y1 and c.y0 <= a.y1 and (least(a.y1, c.y1) - greatest(a.y0, c.y0)) * 2 > least(a.y1 - a.y0, c.y1 - c.y0)")
def row_partner_band_join(spark, d):
    b = _blocks(spark, d)
    return layout.row_partners(b.where("x1 < 500"), b.where("x0 >= 400"))


GUTTER = f"""{B}, pg as (select (page // 4) as page, row_number() over (partition by page // 4 order by page, idx) as idx, type, x0, y0, x1, y1, content from b),
e as (select page, x0 as x from pg union select page, x1 from pg), n as (select page, x, lead(x) over (partition by page order by x) as nx from e),
c as (select n.page, n.x, n.nx, n.x + n.nx as x2, sum(y1 - y0) as total, sum(y1 - y0) filter (x1 <= n.x) as l, sum(y1 - y0) filter (x0 > n.x) as r, count(*) filter (x1 <= n.x) as nl, count(*) filter (x0 > n.x) as nr,
  max(x1) filter (x1 <= n.x) as lx, min(x0) filter (x0 > n.x) as rx, min(x0) as lo, max(x1) as hi from n join pg using (page) where n.nx is not null group by n.page, n.x, n.nx),
k as (select *, row_number() over (partition by page order by total - l - r, lx - rx, abs(x2 - lo - hi), x2) as rk from c where l >= 0.2 * total and r >= 0.2 * total and total - l - r <= 0.25 * total and nl >= 2 and nr >= 2 and rx - lx >= 3),
gut as (select page, x2 from k where rk = 1)"""


def _pages4(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("_leafmill_lineitem")
    b = _blocks(spark, d)
    b.createOrReplaceTempView("_leafmill_blocks")
    return spark.sql("select cast(floor(page / 4) as bigint) as page, cast(row_number() over (partition by floor(page / 4) order by page, idx) as bigint) as idx, type, x0, y0, x1, y1, content from _leafmill_blocks")


@query("gutter_prefix_sums", "W08", f"with {GUTTER} select page, x2 from gut")
def gutter_prefix_sums(spark, d):
    return layout.gutters(_pages4(spark, d))


@query("column_reading_order", "W08", f"""with {GUTTER}, j as (select pg.*, x2, x2 is not null and 2 * x0 < x2 and 2 * x1 > x2 as span from pg left join gut using (page)),
s as (select *, case when x2 is null or span then 0 when x0 + x1 < x2 then 1 else 2 end as side, sum(span::int) over (partition by page order by y0, x0, idx rows unbounded preceding) as band from j)
select page, idx, row_number() over (partition by page order by band, side, y0, x0, idx) as position from s""")
def column_reading_order(spark, d):
    p = _pages4(spark, d)
    return layout.column_order(p, layout.gutters(p)).select("page", "idx", "position")


@query("font_size_estimate", "P20 P21 M06", f"""with {B}, t as (select page, idx, x0, y0, x1, y1, trim(regexp_replace(content || case when idx % 3 = 0 then ' 제목 é' else '' end, '\\s+', ' ', 'g')) as t from b),
n as (select *, length(t) as n, length(t) - length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g')) as a, length(t) - length(regexp_replace(t, '[\\x{{AC00}}-\\x{{D7A3}}]', '', 'g')) as w from t),
f as (select *, a * 0.5 + w + (n - a - w) * 0.65 as weight, (x1 - x0) / 999 * 100 as bw, (y1 - y0) / 999 * 100 * 1.4 as bh from n)
select page, idx, case when weight >= 1 then round(least(greatest(least(sqrt(bw * bh / (1.2 * weight)), bh / 1.25), 0.8), 3.6), 4) end as fs from f""")
def font_size_estimate(spark, d):
    t = F.concat("content", F.when(F.col("idx") % 3 == 0, " 제목 é").otherwise(""))
    b = G.box(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    return _blocks(spark, d).select("page", "idx", F.round(G.font_size(b, t, 1.4), 4).alias("fs"))


@query("outline_levels", "W10", f"""with {B}, t as (select page // 100 as doc, page, idx, content, (page % 40) / 10.0 as fs from b where type = 'title'),
r as (select *, row_number() over (partition by doc order by page, idx) as k from t) select doc, page, idx, case when k = 1 then 1 when fs >= 2.2 then 2 else 3 end::int as level, substr(content, 1, 500) as text from r""")
def outline_levels(spark, d):
    return layout.outline(_blocks(spark, d).withColumn("doc", F.floor(F.col("page") / 100)).withColumn("fs", F.col("page") % 40 / 10))


@query("block_alignment", "A06", f"""with {B}, l as (select page, idx, x0, x1, unnest(range(1, 5)) as line from b), m as (select *, x0 + case when page % 3 = 0 then line * 2 when page % 3 = 1 then 0 else 3 end as lx0, x1 - case when page % 3 = 0 then line * 2 when page % 3 = 1 then case when line = 4 then 15 else 1 end else line * 4 end as lx1 from l),
v as (select page, idx, (abs((lx0 - x0) - (x1 - lx1)) * 20 <= x1 - x0)::int as c, (lx1 - lx0) / (x1 - x0) as r, line = 4 as last_ from m),
g as (select page, idx, avg(c) as share, median(r) as mid, count(*) as n, avg(case when not last_ then (r >= 0.82)::int end) as full_ from v group by 1, 2)
select page, idx, case when share >= 0.75 and mid < 0.72 then 'center' when n >= 3 and full_ >= 0.5 then 'justify' end as align from g""")
def block_alignment(spark, d):
    l = _blocks(spark, d).select("page", "idx", "x0", "x1", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("line"))  # noqa: E741
    k = F.col("page") % 3
    m = l.withColumn("lx0", F.col("x0") + F.when(k == 0, F.col("line") * 2).when(k == 1, 0).otherwise(3))
    m = m.withColumn("lx1", F.col("x1") - F.when(k == 0, F.col("line") * 2).when(k == 1, F.when(F.col("line") == 4, 15).otherwise(1)).otherwise(F.col("line") * 4))
    return layout.alignment(m)


@query("iou_best_match", "J14", f"""with {B}, t as (select page, idx as t, x0 + 5 as x0, y0 + 5 as y0, x1 + 5 as x1, y1 + 5 as y1 from b where type = 'image'), f as (select * from b where type = 'image' and idx % 2 = 0)
select page, t, round(coalesce(max(case when u > 0 then o / u else 0 end), 0), 6) as iou from (select a.page, a.t, {OVERLAP} as o, (a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) - {OVERLAP} as u from t a left join f c on a.page = c.page) group by 1, 2""")
def iou_best_match(spark, d):
    b = _blocks(spark, d).where("type = 'image'")
    truth = b.select("page", F.col("idx").alias("t"), G.box(F.col("x0") + 5, F.col("y0") + 5, F.col("x1") + 5, F.col("y1") + 5).alias("box"))
    return evaluate.best_iou(b.where("idx % 2 = 0").select("page", G.box(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))).alias("box")), truth)


@query("landmark_pair_order", "A15", """with w as (select doc_id, text, unnest(['the', 'of', 'and', 'der', 'die', 'de', 'la', 'que']) as mark, unnest(range(1, 9)) as ord from documents), p as (select doc_id, ord, strpos(text, mark) as pos from w where strpos(text, mark) > 0)
select a.doc_id, count(*)::bigint as pairs, count(*) filter (a.pos < b.pos)::bigint as concordant, round(count(*) filter (a.pos < b.pos) / count(*), 6) as accuracy from p a join p b on a.doc_id = b.doc_id and a.ord < b.ord group by 1""")
def landmark_pair_order(spark, d):
    marks = ["the", "of", "and", "der", "die", "de", "la", "que"]
    each = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("ord"), F.instr("text", m).alias("pos")) for k, m in enumerate(marks)))).alias("m")
    p = table(spark, d, "documents").select("doc_id", each).select("doc_id", "m.ord", "m.pos").where("pos > 0")
    return evaluate.pair_order(p, "doc_id", "ord", "pos")


@query("translation_invariants", "F22 M03", r"""with p as (select doc_id, text as s, case doc_id % 4 when 0 then text || chr(10) when 1 then text || '![x](y)' when 2 then text || '⟦k1⟧' else text end as t from documents)
select doc_id, unnest(['pages', 'images', 'cells', 'tables', 'math', 'placeholders']) as check,
  unnest([len(regexp_extract_all(s, '\n')) = len(regexp_extract_all(t, '\n')), len(regexp_extract_all(s, '!\[')) = len(regexp_extract_all(t, '!\[')), true, true, true, not contains(t, '⟦')]) as ok from p""")
def translation_invariants(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 4
    out = docs.select("doc_id", F.concat("text", F.when(k == 0, "\n").when(k == 1, "![x](y)").when(k == 2, "⟦k1⟧").otherwise("")).alias("text"))
    return evaluate.invariants(docs, out)


@query("dropped_translation_pages", "M02", r"""with s as (select doc_id as page, case when length(text) > 0 then (length(text) - length(regexp_replace(text, '[a-z]', '', 'g'))) / length(text) else 0 end as was from documents)
select page, round(was, 6) as was, round(was * case when page % 3 = 0 then 0.4 else 0.9 end, 6) as now from s where was >= 0.6 and page % 3 = 0""")
def dropped_translation_pages(spark, d):
    share = F.when(F.length("text") > 0, F.regexp_count("text", F.lit("[a-z]")) / F.length("text")).otherwise(0.0)
    before = table(spark, d, "documents").select(F.col("doc_id").alias("page"), share.alias("was"))
    after = before.select("page", (F.col("was") * F.when(F.col("page") % 3 == 0, 0.4).otherwise(0.9)).alias("now"))
    return evaluate.dropped_pages(before, after, 0.6, 0.5).select("page", F.round("was", 6).alias("was"), F.round("now", 6).alias("now"))
