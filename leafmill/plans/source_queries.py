"""Queries over readers, sinks, text layers, viewers and machines: files are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import markup, portable, preview
from leafmill.operators import control, jobs, layout, pages, textlayer
from leafmill.plans.job_queries import JOBS, _jobs
from leafmill.plans.layout_queries import OVERLAP, B, _blocks
from leafmill.plans.page_queries import LINES
from leafmill.plans.registry import query, table
from leafmill.session import global_rank, working_path
from leafmill.sources import readers, sinks
from leafmill.streaming import machines, processors

BOX = ("x0", "y0", "x1", "y1")


def _written(df: DataFrame, name: str, *parts: str) -> str:
    """The path of a table of texts, a directory to each value of parts."""
    path = working_path(df.sparkSession, name)
    writer = df.write.partitionBy(*parts) if parts else df.write
    writer.text(path)
    return path


@query("uploads_probed", "S01", r"""with g as (select doc_id // 100 as part, case doc_id // 100 % 3 when 0 then '%PDF-1.4 ' when 1 then 'GIF89a ' else '%PDF ' end || string_agg(text, chr(10) order by doc_id) as t from documents group by 1)
select part::int as part, (octet_length(encode(t)) + 1)::bigint as length, case when part % 3 = 0 then 'pdf' end as kind, case when part % 3 = 0 then '' else 'unknown-kind' end as reason from g""")
def uploads_probed(spark, d):
    k = F.col("part") % 3
    g = table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 100).alias("part")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("x"))  # a hundred at most
    head = F.when(k == 0, "%PDF-1.4 ").when(k == 1, "GIF89a ").otherwise("%PDF ")
    path = _written(g.select("part", F.concat(head, F.array_join("x.text", "\n")).alias("value")), "uploads", "part")
    found = readers.documents(spark, f"{path}/part=*/*.txt")
    return found.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("int").alias("part"), "length", "kind", "reason")


@query("raw_pages_read", "S14", r"""with r as (select doc_id // 100 as part, row_number() over (partition by doc_id // 100 order by doc_id) as page, text from documents)
select part::int as part, page::int as page, md5(text) as digest, length(text)::bigint as chars from r""")
def raw_pages_read(spark, d):
    """Files {"pages": [...]} of a hundred documents each, written and read back page by page."""
    g = table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 100).alias("part")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("x"))
    path = _written(g.select("part", F.to_json(F.struct(F.col("x.text").alias("pages"))).alias("value")), "raw-pages", "part")
    r = readers.raw_pages(spark, f"{path}/part=*/*.txt")
    return r.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("int").alias("part"), "page", F.md5(F.col("raw").cast("binary")).alias("digest"), F.length("raw").cast("long").alias("chars"))


@query("generated_pages_shape", "S14", "select j.range as job, p.range as page, 'Page ' || p.range as title, 'Body of job ' || j.range as body, 200::bigint as title_width, 250::bigint as body_width from range(40) j, range(1, 26) p")
def generated_pages_shape(spark, d):
    number = lambda k: F.regexp_extract("raw", r"title \[(\d+), 10, (\d+), 40\][^\n]*\n<\|det\|>text \[(\d+), 60, (\d+), 300\]", k).cast("long")
    return readers.generated_pages(spark, 40, 25).select(
        "job", "page", F.regexp_extract("raw", r"<\|/det\|>(Page \d+)", 1).alias("title"), F.regexp_extract("raw", r"(Body of job \d+)$", 1).alias("body"), (number(2) - number(1)).alias("title_width"), (number(4) - number(3)).alias("body_width"),
    )


UNIT_TYPE = "case when type = 'image' then type when idx % 5 = 1 then 'ref_text' when idx % 5 = 2 then 'unreadable' else type end"


@query("layout_units_read", "S11 S13", f"with {B}, u as (select page, idx, {UNIT_TYPE} as kind, content from b) select 'lay:' || page || ':' || (idx - 1) as unit_id, kind, page::int as page, content as src, case kind when 'ref_text' then 'references' when 'unreadable' then 'unreadable' else '' end as skip_reason from u where kind <> 'image' and trim(content) <> ''")
def layout_units_read(spark, d):
    """Layout files of pages, written as one array to a file, read with the fixed schema and flattened to units."""
    b = _blocks(spark, d).withColumn("type", F.expr(UNIT_TYPE))
    block = F.struct("type", F.array(*(F.col(c).cast("int") for c in BOX)).alias("bbox"), "content", F.when(F.col("type") == "image", "a.png").alias("image"))
    p = b.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", block.alias("b")))), lambda s: s["b"]).alias("blocks"))
    page = F.struct(F.col("page").cast("int").alias("page"), F.lit(999).alias("width"), F.lit(999).alias("height"), "blocks")
    files = p.select(F.floor(F.col("page") / 2000).alias("part"), page.alias("p")).groupBy("part").agg(F.to_json(F.collect_list("p")).alias("value"))
    path = _written(files, "layout", "part")
    return readers.layout_units(readers.blocks(readers.layout(spark, f"{path}/part=*/*.txt")))


@query("jobs_loaded", "S07", f"""with {JOBS}, m as (select 'j_' || lpad(lower(to_hex(job_id)), 12, '0') as id, status, job_id % 2 = 0 as submitted, event_id as submit_order from s),
r as (select id, row_number() over (order by submit_order, id) as position from m where status = 'queued' and submitted)
select id, case status when 'running' then 'error' else status end as status, coalesce(position is not null, false) as resubmit, position from m left join r using (id)""")
def jobs_loaded(spark, d):
    """Job records written a line each and loaded as after a restart; those to submit again are numbered in their order."""
    j = _jobs(spark, d)
    meta = F.to_json(F.struct(F.concat(F.lit("j_"), F.lpad(F.lower(F.hex("job_id")), 12, "0")).alias("id"), "status", (F.col("job_id") % 2 == 0).alias("submitted"), F.col("event_id").alias("submit_order")))
    path = _written(j.select(meta.alias("value")).unionByName(spark.createDataFrame([('{"id": "j_bad", "status": "done"}',), ("no record",)], "value string")), "jobs")
    found = readers.jobs(spark, path, "*.txt", "lines").select("id", "status", "resubmit", "submit_order")
    again = global_rank(found.where("resubmit"), [F.col("submit_order"), F.col("id")], "position")
    return again.unionByName(found.where("not resubmit").withColumn("position", F.lit(None).cast("long"))).drop("submit_order")


@query("glossary_saved_loaded", "S12 K05", """select lower(source || ' ' || lang) as src, lang as ko, case when count(*) % 2 = 0 then 'A' else 'D' end as policy, min(doc_id)::varchar as first_unit from documents group by source, lang""")
def glossary_saved_loaded(spark, d):
    g = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").cast("string").alias("first_unit"))
    path = working_path(spark, "glossary")
    sinks.json_records(g.select(F.upper(F.concat_ws(" ", "source", "lang")).alias("src"), F.col("lang").alias("ko"), F.when(F.col("n") % 2 == 0, "A").otherwise("D").alias("policy"), "first_unit"), path)
    return readers.glossary(spark, path, lower=True, records="lines").select("src", "ko", "policy", "first_unit")


@query("records_replaced", "K02", "select doc_id, n_chars, lang from documents where doc_id % 2 = 0 union all select doc_id, n_chars + 1, lang from documents where doc_id % 2 = 1")
def records_replaced(spark, d):
    """A set of records written twice under one name: readers see the whole of the second."""
    docs, path = table(spark, d, "documents").select("doc_id", "n_chars", "lang"), working_path(spark, "records")
    sinks.json_records(docs, path)
    sinks.json_records(docs.withColumn("n_chars", F.col("n_chars") + F.col("doc_id") % 2), path)
    return spark.read.schema("doc_id long, n_chars long, lang string").json(path)


@query("reason_maps", "K12", """with c as (select user_id, event_type, count(*) as n from events group by 1, 2) select user_id, string_agg(event_type || '=' || n, ',' order by event_type) as reasons from c group by 1""")
def reason_maps(spark, d):
    m = sinks.reason_map(table(spark, d, "events"), "user_id", "event_type")
    return m.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("reasons")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("reasons"))


MEMBERS = "case doc_id % 7 when 0 then 'result.md' when 1 then 'meta.json' when 2 then 'figures/a.png' when 3 then 'figures/b.jpg' when 4 then 'out.pdf' when 5 then 'secret.env' else 'units.json' end"


@query("archive_contents", "K06 M29", f"""with f as (select doc_id || '/' || {MEMBERS} as path, doc_id % 7 as k from documents), m as (select path, case k when 0 then 'text' when 1 then 'meta' when 2 then 'images' when 3 then 'images' when 4 then 'pdf' end as scope from f)
select 'all' as archive, path, scope from m where scope is not null union all select 'text', path, scope from m where scope in ('text', 'meta') union all select 'images', path, scope from m where scope in ('images', 'meta')""")
def archive_contents(spark, d):
    f = table(spark, d, "documents").select(F.expr(f"concat(doc_id, '/', {MEMBERS})").alias("path"))
    out = None
    for scope in ("all", "text", "images"):
        part = sinks.archive_members(f, scope).select(F.lit(scope).alias("archive"), "path", "scope")
        out = part if out is None else out.unionByName(part)
    return out


def _span_lines(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of ten pages as lines of blocks: sizes and directions by their numbers."""
    return _blocks(spark, d).select(
        F.floor(F.col("page") / 10).alias("page"), (F.col("idx") % 3).alias("block"), (F.col("page") % 10 * 100 + F.col("idx")).alias("line"), *BOX,
        F.col("content").alias("text"), (F.col("x0") % 3 + 9).alias("size"), (F.col("y0") % 4 != 0).alias("horizontal"),
    )


SPAN_LINES = "l as (select page // 10 as page, idx % 3 as block, page % 10 * 100 + idx as line, x0, y0, x1, y1, content as text, x0 % 3 + 9 as size, y0 % 4 <> 0 as horizontal from b)"


@query("text_layer_blocks", "S03", f"""with {B}, {SPAN_LINES}, z as (select page, block, size, sum(length(text)) as c from l group by 1, 2, 3), s as (select page, block, arg_max(size, (c, size)) as size from z group by 1, 2),
w as (select *, coalesce(lag(y0) over v < y1 and lag(y1) over v > y0 and lag(x1) over v <= x0, false) as beside from l window v as (partition by page, block order by line))
select page, block, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, string_agg(text, chr(10) order by line) as text, any_value(s.size) as size, round(avg(y1 - y0), 6) as line_height, count(*) filter (horizontal) * 2 > count(*) as horizontal, count(*) filter (beside) >= 2 as tabular
from w join s using (page, block) group by 1, 2""")
def text_layer_blocks(spark, d):
    return textlayer.text_blocks(_span_lines(spark, d)).withColumn("line_height", F.round("line_height", 6))


@query("plain_page_texts", "S04", f"""with {B}, {SPAN_LINES}, k as (select page, block, string_agg(text, chr(10) order by line) as text from l group by 1, 2), p as (select page, string_agg(text, chr(10) order by block) as text from k group by 1)
select w.page, p.text from (select unnest([0, 3, 17, 40, -5])::bigint as page) w left join p using (page)""")
def plain_page_texts(spark, d):
    return textlayer.plain_pages(textlayer.text_blocks(_span_lines(spark, d)), [0, 3, 17, 40, -5])


@query("lines_in_boxes", "S05", f"""with {B}, q as (select page, idx as box, x0 - 60 as x0, y0 - 5 as y0, x1 + 200 as x1, y1 + 60 as y1 from b where idx % 2 = 1),
j as (select q.page, box, b.x0, b.y0, b.x1, b.y1, content as text from q join b using (page) where b.x0 + b.x1 between 2 * q.x0 and 2 * q.x1 and b.y0 + b.y1 between 2 * q.y0 and 2 * q.y1),
n as (select *, case when greatest(least(y1, lag(y1) over v) - greatest(y0, lag(y0) over v), 0) > 0.3 * least(y1 - y0, lag(y1) over v - lag(y0) over v) then 0 else 1 end as fresh from j window v as (partition by page, box order by y0, x0)),
r as (select *, sum(fresh) over (partition by page, box order by y0, x0 rows unbounded preceding) as row from n), g as (select *, case when x0 - lag(x1) over (partition by page, box, row order by x0) > 0.25 * (y1 - y0) then ' ' else '' end || text as piece from r),
t as (select page, box, row, string_agg(piece, '' order by x0, piece) as text from g group by 1, 2, 3), o as (select page, box, string_agg(text, chr(10) order by row) as text from t group by 1, 2)
select q.page, q.box, coalesce(o.text, '') as text from q left join o using (page, box)""")
def lines_in_boxes(spark, d):
    b = _blocks(spark, d)
    boxes = b.where("idx % 2 = 1").select("page", F.col("idx").alias("box"), (F.col("x0") - 60).alias("x0"), (F.col("y0") - 5).alias("y0"), (F.col("x1") + 200).alias("x1"), (F.col("y1") + 60).alias("y1"))
    return textlayer.lines_in_boxes(boxes, b.select("page", *BOX, F.col("content").alias("text")))


@query("figure_rectangles", "L10", f"""with {B}, u as (select distinct page // 20 as page, round(x0 / 950.0, 7) as x0, round(y0 / 990.0, 7) as y0, round(x1 / 950.0, 7) as x1, round(y1 / 990.0, 7) as y1 from b where type = 'image')
select *, count(*) over (partition by page) > 20 as over from u where (x1 - x0) * (y1 - y0) < 0.95""")
def figure_rectangles(spark, d):
    i = _blocks(spark, d).where("type = 'image'").select(F.floor(F.col("page") / 20).alias("page"), *BOX, F.lit(950.0).alias("width"), F.lit(990.0).alias("height"))
    return textlayer.figures(i, most=20)


@query("scan_clusters", "W17", f"""with recursive {B}, e as (select a.page, a.idx, c.idx as j from b a join b c on a.page = c.page and a.idx <> c.idx and {OVERLAP} > 0),
w(page, idx, low) as (select page, idx, idx from b union select w.page, e.j, w.low from w join e on e.page = w.page and e.idx = w.idx) select page, idx, min(low) as cluster from w group by 1, 2""")
def scan_clusters(spark, d):
    return textlayer.clusters(_blocks(spark, d))


@query("links_relocated", "M10", f"""with {B}, f as (select page // 5 as page, page % 5 * 100 + idx as link, content as anchor from b where content <> ''), a as (select *, row_number() over (partition by page, anchor order by link) as n from f),
h as (select page, 1000 - link as hit, anchor from f where link % 4 <> 0), c as (select *, row_number() over (partition by page, anchor order by hit) as n from h) select a.page, a.link, c.hit from a left join c using (page, anchor, n)""")
def links_relocated(spark, d):
    f = _blocks(spark, d).where("content <> ''").select(F.floor(F.col("page") / 5).alias("page"), (F.col("page") % 5 * 100 + F.col("idx")).alias("link"), F.col("content").alias("anchor"))
    return textlayer.relocated_links(f, f.where("link % 4 <> 0").select("page", (1000 - F.col("link")).alias("hit"), "anchor"))


@query("bold_prefixes", "M15", f"""with {B}, {SPAN_LINES}, s as (select page, block, line as span, text || ' ' as text, x0 % 4 <> 0 as bold from l), r as (select *, sum((not bold)::int) over (partition by page, block order by span rows unbounded preceding) as plain from s),
p as (select page, block, trim(string_agg(text, '' order by span)) as p from r where plain = 0 group by 1, 2), w as (select page, block, bool_and(bold) as whole from s group by 1, 2)
select page, block, case when not whole and len(string_split_regex(p, '\\s+')) <= 6 and length(p) between 1 and 80 then p end as prefix from w left join p using (page, block)""")
def bold_prefixes(spark, d):
    s = _span_lines(spark, d).select("page", "block", F.col("line").alias("span"), F.concat("text", F.lit(" ")).alias("text"), (F.col("x0") % 4 != 0).alias("bold"))
    return textlayer.leading_bold(s)


@query("source_span_records", "M15", f"""with {B}, s as (select page, idx, case idx % 4 when 0 then '' when 1 then content else 'ab' || idx end as text, x0, y0, x1, y1 from b where idx % 5 <> 0)
select page, row_number() over (partition by page order by idx) as span, text, x0::double as x0, y1::double as y1, case when idx % 3 = 0 then x0 + 1 else x0 end::double as x, case when idx % 3 = 0 then y1 - 2 else y1 end::double as y, case when idx % 2 = 0 then 0 else 1 end::double as dx,
  case when idx % 2 = 0 then 1 else 0 end::double as dy, (x0 % 3 + 9)::double as size from s where trim(text) <> ''""")
def source_span_records(spark, d):
    """Nested text dictionaries of derived blocks, a line and a span each, flattened to records."""
    k = F.col("idx")
    span = F.struct(
        F.when(k % 5 != 0, F.array(*(F.col(c).cast("double") for c in BOX))).alias("bbox"), F.when(~(k % 4).isin(0, 1), F.array(F.lit("ab"), k.cast("string"))).alias("chars"), F.when(k % 4 == 1, F.col("content")).alias("text"),
        (F.col("x0") % 3 + 9).cast("double").alias("size"), F.lit(0).alias("flags"), F.when(k % 3 == 0, F.array((F.col("x0") + 1).cast("double"), (F.col("y1") - 2).cast("double"))).alias("origin"),
    )
    line = F.struct(F.when(k % 2 == 0, F.array(F.lit(0.0), F.lit(1.0))).alias("dir"), F.array(span).alias("spans"))
    nested = _blocks(spark, d).groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.struct(F.array(line).alias("lines")).alias("b")))), lambda s: s["b"]).alias("blocks"))
    return textlayer.span_records(nested).select("page", "span", "text", "x0", "y1", "x", "y", "dx", "dy", "size")


@query("cell_styles", "M17", f"""with {B}, c as (select page, idx as cell, x0 - 30 as x0, y0 - 30 as y0, x1 + 60 as x1, y1 + 30 as y1 from b where idx % 2 = 0), s as (select page, x0, y0, x1, y1, y0 % 5 + 8 as size, x0 % 3 = 0 as bold from b),
j as (select c.page, cell, c.x0 as a0, c.x1 as a1, s.* exclude (page) from c join s using (page) where s.x0 + s.x1 between 2 * c.x0 and 2 * c.x1 and s.y0 + s.y1 between 2 * c.y0 and 2 * c.y1),
g as (select page, cell, median(size) as size, count(*) filter (bold) * 2 > count(*) as bold, ((min(x0) + max(x1)) - (any_value(a0) + any_value(a1))) / (2 * (any_value(a1) - any_value(a0))) as off from j group by 1, 2)
select page, cell, size, case when abs(off) <= 0.08 then 'center' when off >= 0.12 then 'right' else 'left' end as align, bold from g""")
def cell_styles(spark, d):
    b = _blocks(spark, d)
    cells = b.where("idx % 2 = 0").select("page", F.col("idx").alias("cell"), (F.col("x0") - 30).alias("x0"), (F.col("y0") - 30).alias("y0"), (F.col("x1") + 60).alias("x1"), (F.col("y1") + 30).alias("y1"))
    return textlayer.cell_styles(cells, b.select("page", *BOX, (F.col("y0") % 5 + 8).alias("size"), (F.col("x0") % 3 == 0).alias("bold")))


@query("table_rules", "M17", f"""with {B}, t as (select * from b where type = 'image'), s as (select page, x0 - 100 as x0, x1 - 40 as x1, y0 + (idx % 5) * 9 - 8 as y, idx % 3 as width from b)
select s.page, t.idx as tbl, s.x0, s.x1, s.y, s.width from s join t using (page) where not (s.x1 < t.x0 - 2 or s.x0 > t.x1 + 2 or s.y < t.y0 - 3 or s.y > t.y1 + 3)""")
def table_rules(spark, d):
    b = _blocks(spark, d)
    segments = b.select("page", (F.col("x0") - 100).alias("x0"), (F.col("x1") - 40).alias("x1"), (F.col("y0") + F.col("idx") % 5 * 9 - 8).alias("y"), (F.col("idx") % 3).alias("width"))
    return textlayer.table_rules(segments, b.where("type = 'image'").withColumnRenamed("idx", "tbl"))


@query("grid_boundaries", "A20", f"""with {B}, m as (select page // 4 as page, idx % 3 as k, median((x0 + x1) / 2) as c, min(x0) as lo, max(x1) as hi from b group by 1, 2),
n as (select *, lead(c) over (partition by page order by k) as n, count(*) over (partition by page) as total, min(lo) over (partition by page) as l, max(hi) over (partition by page) as h from m), f as (select *, bool_or(coalesce(n <= c, false)) over (partition by page) as bad from n)
select page, k, round(case when bad then l + (h - l) * (k + 1) / total else (c + n) / 2 end, 6) as edge from f where n is not null""")
def grid_boundaries(spark, d):
    c = _blocks(spark, d).select(F.floor(F.col("page") / 4).alias("page"), (F.col("idx") % 3).alias("k"), ((F.col("x0") + F.col("x1")) / 2).alias("c"), F.col("x0").alias("lo"), F.col("x1").alias("hi"))
    return textlayer.boundaries(c).select("page", "k", F.round("at", 6).alias("edge"))


PASSES = 6
SETTLED = "z0 as (select page, idx from b where content <> '')" + "".join(
    f", z{k + 1} as (select a.page, a.idx from z{k} a where a.idx % 4 = 0 or exists (select 1 from z{k} c where c.page = a.page and c.idx = a.idx + 1))" for k in range(PASSES)
)


@query("cleared_blocks_settled", "M08", f"with {B}, {SETTLED} select page, idx from z{PASSES}")
def cleared_blocks_settled(spark, d):
    """Blocks that stay cleared: each pass drops those whose follower is no longer in the set, until nothing changes."""
    b = _blocks(spark, d).where("content <> ''").select("page", "idx")

    def step(now: DataFrame) -> DataFrame:
        following = now.select("page", (F.col("idx") - 1).alias("idx"), F.lit(True).alias("_next"))
        return now.join(following, ["page", "idx"], "left").where("idx % 4 = 0 or _next").select("page", "idx")

    *_, last = control.until_settled(b, step, ["page", "idx"], PASSES)
    return last


@query("client_keys", "V03", """with e as (select event_id, user_id, '10.0.0.' || user_id % 250 as direct, case event_id % 4 when 0 then null when 1 then '' when 2 then ' 1.2.3.' || event_id % 200 || ' ' else '9.9.9.9, 1.2.3.' || event_id % 200 || ' ,10.1.1.1' end as chain, user_id % 3 <> 0 as trusted from events),
p as (select *, list_filter([trim(x) for x in string_split(coalesce(chain, ''), ',')], lambda x: x <> '') as parts from e) select event_id, case when trusted and len(parts) >= 2 then parts[len(parts) - 1] else direct end as caller from p""")
def client_keys(spark, d):
    n = F.col("event_id") % 200
    k = F.col("event_id") % 4
    chain = F.when(k == 0, None).when(k == 1, "").when(k == 2, F.concat(F.lit(" 1.2.3."), n, F.lit(" "))).otherwise(F.concat(F.lit("9.9.9.9, 1.2.3."), n, F.lit(" ,10.1.1.1")))
    direct = F.concat(F.lit("10.0.0."), F.col("user_id") % 250)
    return table(spark, d, "events").select("event_id", control.client_key(direct, chain, 2, F.col("user_id") % 3 != 0).alias("caller"))


@query("failure_texts", "M27", """with e as (select event_id, case event_id % 9 when 0 then 404 when 1 then 429 when 2 then 401 when 3 then 403 when 4 then 400 when 5 then 503 when 6 then null when 7 then 418 else 400 end as status, case event_id % 9 when 4 then 'Blocked by Content Policy' else event_type end as body, user_id % 7 as used from events)
select event_id, case when status = 404 then 'model not found' when status = 429 then 'rate limited' when status in (401, 403) then 'not authorised' when contains(lower(body), 'content policy') then 'content policy' when used >= 6 then 'output limit' when status >= 500 then 'server error' when status is null then 'transport' else 'failed' end as message from e""")
def failure_texts(spark, d):
    k = F.col("event_id") % 9
    status = F.element_at(F.array(*(F.lit(x) for x in (404, 429, 401, 403, 400, 503, None, 418, 400))), (k + 1).cast("int"))
    body = F.when(k == 4, "Blocked by Content Policy").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", control.failure_text(status, body, F.col("user_id") % 7, F.lit(6)).alias("message"))


@query("request_variants", "M26", """select event_id, concat_ws(';', case when event_type <> 'view' then 'kind=' || event_type end, case when user_id % 3 <> 0 then 'steps=' || user_id % 3 end, case when user_id % 5 <> 0 then 'token=' || substr(sha256('key ' || user_id), 1, 16) end) as variant from events""")
def request_variants(spark, d):
    config = {"token": F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("key "), "user_id")).otherwise(""), "kind": F.col("event_type"), "steps": F.col("user_id") % 3}
    defaults = {"kind": F.lit("view"), "steps": F.lit(0).cast("long"), "token": F.lit("")}
    return table(spark, d, "events").select("event_id", control.variant_of(config, defaults, ("token",)).alias("variant"))


@query("viewer_page_slice", "V01", f"""with {LINES}, n as (select doc_id, count(*)::bigint as total from lines group by 1) select doc_id, page, line, total, (doc_id + page) % 3 = 0 as aligned from lines join n using (doc_id) where page >= 1 + doc_id % 7 and page < 1 + doc_id % 7 + 4""")
def viewer_page_slice(spark, d):
    """A window of pages of each document with its total, and whether an alignment is there for a page."""
    p = pages.explode_pages(table(spark, d, "documents"))
    aligned = p.where("(doc_id + page) % 3 = 0").select("doc_id", "page", F.lit(True).alias("aligned"))
    s = jobs.page_slice(p, "doc_id", "page", F.lit(1) + F.col("doc_id") % 7, 4)
    return s.join(aligned, ["doc_id", "page"], "left").select("doc_id", "page", "line", "total", F.coalesce("aligned", F.lit(False)).alias("aligned"))


@query("hydration_frames", "W15 M31", f"""with {LINES}, n as (select doc_id, count(*)::bigint as total from lines group by 1), f as (select doc_id, greatest(1, least(total, 1 + doc_id % 11) - 3) as a, least(total, least(total, 1 + doc_id % 11) + 3) as z from n),
m as (select doc_id, page, page - row_number() over (partition by doc_id order by page) as island from lines join f using (doc_id) where page between a and z and (doc_id + page) % 5 <> 0), k as (select *, (row_number() over (partition by doc_id, island order by page) - 1) // 2 as k from m)
select doc_id, min(page) as first, max(page) as last from k group by doc_id, island, k""")
def hydration_frames(spark, d):
    """Batches of pages that are missing in the frame around each document's current page."""
    p = pages.explode_pages(table(spark, d, "documents"))
    frame = p.groupBy("doc_id").agg(F.count("*").alias("total")).select("doc_id", jobs.page_frame(F.col("total"), F.lit(1) + F.col("doc_id") % 11, 3).alias("f"))
    inside = p.join(frame, "doc_id").where(F.col("page").between(F.col("f.start"), F.col("f.end")))
    return jobs.missing_batches(inside, "doc_id", "page", (F.col("doc_id") + F.col("page")) % 5 == 0, 2)


def _pieces(spark: SparkSession, d: str, size: int, mark: str) -> DataFrame:
    text = F.replace("text", F.lit("\n"), F.lit(mark))
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.posexplode(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).alias("seq", "text"))


@query("coalesced_writes", "T02", """with t as (select doc_id, replace(text, chr(10), '<PAGE>') as t from documents where text <> '') select doc_id::varchar as key, ceil(length(t) / 259)::bigint as writes, length(t)::bigint as chars, least(length(t), 259)::bigint as largest from t""")
def coalesced_writes(spark, d):
    """Pieces of seven characters joined to writes of 256 or more: 37 pieces each."""
    out = processors.run_batch(_pieces(spark, d, 7, "<PAGE>"), machines.Coalescer)
    return out.groupBy("key").agg(F.count("*").alias("writes"), F.sum(F.length("data")).alias("chars"), F.max(F.length("data")).cast("long").alias("largest"))


@query("preview_renders", "T09", """with l as (select doc_id, string_split(text, chr(10)) as l from documents where text <> ''), n as (select doc_id, unnest(case when l[-1] = '' then l[:-2] else l end) as page from l)
select doc_id::varchar as key, count(*)::bigint as pages, sum(length(page))::bigint as chars from n group by 1""")
def preview_renders(spark, d):
    """Pages that a preview renders, each once, when it has become complete."""
    out = processors.run_batch(_pieces(spark, d, 11, "<PAGE>"), machines.PreviewPlan).where("event = 'page'")
    return out.groupBy("key").agg(F.count("*").alias("pages"), F.sum(F.length("data")).alias("chars"))


# Forms of one equation by the document's number, and whether it stands there.
EQUATIONS = (
    ("$E_7=m_9+4$ ", True), ("so E_{7} = m_9 + 4, and", True), ("\\[E_7 = \\mathrm{m}_9 \\times 4\\]", False), ("E_7=m_9+4.5", False), ("2E_7 = m_9 + 4", False), ("<b>E_7 = m_9 + 4</b>", True), ("E_7=m_9+4 - 3", False), ("\\(E_{7} = \\left m_{9}+4 \\right\\)", True), ("no equation", False),
)


@query("equations_found", "M05 P32", "select doc_id, doc_id % 9 in (" + ", ".join(str(k) for k, (_, there) in enumerate(EQUATIONS) if there) + ") as found from documents")
def equations_found(spark, d):
    """Whether E_7 = m_9 + 4 stands in a document behind one of its forms: marked, bare, or as a part of another."""
    head = F.element_at(F.array(*(F.lit(x) for x, _ in EQUATIONS)), (F.col("doc_id") % len(EQUATIONS) + 1).cast("int"))
    there = markup.as_udf(lambda page: markup.equation_found(page, "E_7 = m_9 + 4"), "boolean")
    return table(spark, d, "documents").select("doc_id", there(F.concat(head, F.lit("\n"), "text")).alias("found"))


@query("portable_texts", "P34", r"""select doc_id, regexp_replace(replace(replace(replace('x² − y × z' || chr(10) || text, '²', '2'), '−', '-'), '×', 'x'), '[^\x00-\x7F]', '', 'g') as plain from documents""")
def portable_texts(spark, d):
    """Documents for a font of ASCII characters; characters without a plainer spelling are left out here, as accents differ by engine."""
    ascii_ = "".join(map(chr, range(128)))
    t = F.concat(F.lit("x² − y × z\n"), F.regexp_replace("text", r"[^\x00-\x7F²−×]", ""))
    return table(spark, d, "documents").select("doc_id", portable.portable_text(t, ascii_).alias("plain"))


@query("titles_balanced", "P34", """with w as (select doc_id, 'Title ' || doc_id as a, 'of part ' || doc_id % 90 as b from documents)
select doc_id, case when length(a || ' ' || b) * 5 * 0.76 <= 60 + doc_id % 30 + 0.25 then a || ' ' || b else null end as one_line from w""")
def titles_balanced(spark, d):
    """Titles that fit a line at some allowed size, all characters being half as wide as high; null where they are broken."""
    title = F.concat(F.lit("Title "), "doc_id", F.lit(" of part "), F.col("doc_id") % 90)
    lines = portable.title_lines(title, F.lit(60) + F.col("doc_id") % 30, 10.0, {chr(c): 0.5 for c in range(32, 127)})
    return table(spark, d, "documents").select("doc_id", lines.alias("t")).select("doc_id", F.when(~F.contains("t", F.lit("\n")), F.col("t")).alias("one_line"))


@query("grounded_pages_read", "S13", f"with {B} select page, idx, type from b where idx <= 3")
def grounded_pages_read(spark, d):
    """Grounded markup of pages, written as raw pages and parsed back into blocks."""
    raw = _blocks(spark, d).where("idx <= 3").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("idx", "type", *BOX, "content"))).alias("x")).select("page", layout.to_markup(F.col("x")).alias("raw"))
    files = raw.select(F.floor(F.col("page") / 4000).alias("part"), "page", "raw").groupBy("part").agg(F.array_sort(F.collect_list(F.struct("page", "raw"))).alias("x"))
    path = _written(files.select("part", F.to_json(F.struct(F.transform("x", lambda s: F.concat(s["page"], F.lit("\n"), s["raw"])).alias("pages"))).alias("value")), "grounded", "part")
    back = readers.raw_pages(spark, f"{path}/part=*/*.txt").select(F.split("raw", "\n", 2).alias("s"))
    blocks = back.select(F.get("s", F.lit(0)).cast("long").alias("page"), F.posexplode(layout.from_markup(F.get("s", F.lit(1)))).alias("p", "b"))
    return blocks.select("page", (F.col("p") + 1).cast("long").alias("idx"), "b.type")


@query("reading_views", "P29", f"""with {B}, k as (select page // 4 as doc, page, idx, case when idx % 7 = 5 then 'page_number' else type end as kind, content from b),
x as (select doc, page, idx, case kind when 'page_number' then '' when 'image' then '> 🖼 그림 감지됨' || case when trim(content) <> '' then chr(10) || chr(10) || trim(content) else '' end when 'title' then case when trim(content) <> '' then '## ' || trim(content) else '' end else trim(content) end as part from k),
p as (select doc, page, string_agg(part, chr(10) || chr(10) order by idx) filter (part <> '') as body from x group by 1, 2)
select doc, coalesce(string_agg(body, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by page) filter (body is not null), '') as view from p group by 1""")
def reading_views(spark, d):
    """The reading view of four derived pages each, in both forms of marks."""
    kind = F.when(F.col("idx") % 7 == 5, "page-number").otherwise(F.col("type"))
    box = F.concat_ws(", ", *(F.greatest(F.col(c), F.lit(0)) for c in BOX))
    figure = F.concat(F.lit("<|ref|>Image<|/ref|><|det|>[["), box, F.lit("]]<|/det|>"))
    mark = F.when(kind == "image", figure).otherwise(F.concat(F.lit("<|det|>"), kind, F.lit(" ["), box, F.lit("]<|/det|>")))
    b = _blocks(spark, d).select(F.floor(F.col("page") / 4).alias("doc"), "page", "idx", F.concat(F.when(F.col("idx") == 1, "<PAGE>").otherwise(""), mark, "content", F.lit("<|x|>\n")).alias("raw"))
    g = b.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "idx", "raw"))).alias("x"))
    return g.select("doc", markup.as_udf(preview.reading_view, "string")(F.array_join("x.raw", "")).alias("view"))


@query("page_mentions", "V06", """with n as (select doc_id, doc_id % 90 + 1 as a, doc_id % 7 as b from documents)
select doc_id, concat_ws(',', a, b + 2, a + 1, a + 2) as pages, concat_ws(',', a || '페이지', (b + 2) || '–' || (b + 4) || '페이지', (a + 1)::varchar, (a + 2)::varchar) as marks from n""")
def page_mentions(spark, d):
    a, b = F.col("doc_id") % 90 + 1, F.col("doc_id") % 7
    text = F.concat(a, F.lit("페이지 실패, "), b + 2, F.lit("–"), b + 4, F.lit("페이지, 3/"), a, F.lit("페이지, 0페이지; 페이지: "), a + 1, F.lit(", "), a + 2, F.lit("\n"), F.regexp_replace("text", "페이지", ""))
    found = markup.as_udf(preview.page_mentions, "array<struct<page: bigint, value: string>>")(text)
    return table(spark, d, "documents").select("doc_id", found.alias("m")).select("doc_id", F.array_join(F.col("m.page"), ",").alias("pages"), F.array_join(F.col("m.value"), ",").alias("marks"))


@query("viewer_searches", "P31", """with e as (select event_id, event_id % 4 as k, user_id, event_type from events)
select event_id, k in (0, 3) as open, case k when 0 then user_id % 40 + 1 when 3 then 12 else 1 end::bigint as page, case when k = 0 and user_id % 2 = 0 then 'ko' else 'orig' end as lang,
  case k when 0 then '?q=' || event_type || '&viewer=1&page=' || (user_id % 40 + 1) || '&lang=' || case when user_id % 2 = 0 then 'ko' else 'orig' end when 1 then '?a=1&b=' || user_id when 2 then '' else '?viewer=1&page=12&lang=orig' end as search from e""")
def viewer_searches(spark, d):
    k = F.col("event_id") % 4
    given = (
        F.when(k == 0, F.concat(F.lit("?viewer=1&q="), "event_type", F.lit("&page="), F.col("user_id") % 40 + 1, F.lit("&lang="), F.when(F.col("user_id") % 2 == 0, "ko").otherwise("en")))
        .when(k == 1, F.concat(F.lit("a=1&page=x&b="), "user_id")).when(k == 2, "?page=0&lang=de").otherwise("?viewer=1&page=12.9")
    )
    s = table(spark, d, "events").select("event_id", given.alias("g")).withColumn("s", preview.viewer_state(F.col("g")))
    return s.select("event_id", "s.open", "s.page", "s.lang", preview.viewer_search(F.col("g"), F.col("s")).alias("search"))


@query("error_lines", "P33", "select doc_id, 'Error' || doc_id % 5 || ': ' || left(text, 200) as line from documents")
def error_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", preview.error_line(F.concat(F.lit("Error"), F.col("doc_id") % 5), F.col("text")).alias("line"))


@query("stream_upserts", "K13 T15", "select event_type as kind, user_id, max(event_id) as event_id from events group by 1, 2")
def stream_upserts(spark, d):
    """The newest row of each key, kept up to date by a stream over files, a micro-batch each."""
    root = working_path(spark, "stream")
    events = table(spark, d, "events").select(F.col("event_type").alias("kind"), "user_id", "event_id")
    for part in range(4):  # arrivals
        events.where(F.col("event_id") % 4 == part).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(f"{root}/in")
    processors.upsert_batches(stream, f"{root}/out", f"{root}/state", ["kind", "user_id"], "event_id").trigger(availableNow=True).start().awaitTermination()
    versions = spark.read.parquet(f"{root}/out").agg(F.max("v")).first()[0]
    return spark.read.parquet(f"{root}/out/v={versions}")
