"""Layout blocks: grounded markup, pairs of layouts, spatial joins, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry as G

#: Labels whose blocks hold no running text.
FIGURES = ("image", "figure", "chart")


def to_markup(blocks: Column) -> Column:
    """Inline-det markup of an ordered array of (type, x0, y0, x1, y1, content)."""
    one = lambda b: F.concat(F.lit("<|det|>"), b["type"], F.lit(" ["), F.concat_ws(", ", *(b[c].cast("string") for c in ("x0", "y0", "x1", "y1"))), F.lit("]<|/det|>"), b["content"])
    return F.array_join(F.transform(blocks, one), "\n")


def from_markup(raw: Column) -> Column:
    """array<struct<type, x0, y0, x1, y1, content>> of inline-det markup; figures lose their content."""
    head = r"<\|det\|>([a-z_]+) \[(\d{1,6}), (\d{1,6}), (\d{1,6}), (\d{1,6})\]<\|/det\|>"
    parts = [F.regexp_extract_all(raw, F.lit(head), F.lit(k)) for k in range(1, 6)]
    bodies = F.slice(F.split(raw, head, -1), F.lit(2), F.size(parts[0]))
    zipped = F.arrays_zip(*(p.alias(n) for p, n in zip((*parts, bodies), ("type", "a", "b", "c", "d", "body"), strict=True)))
    number = lambda v: v.cast("long")
    return F.transform(zipped, lambda z: F.struct(
        z["type"].alias("type"), number(z["a"]).alias("x0"), number(z["b"]).alias("y0"), number(z["c"]).alias("x1"), number(z["d"]).alias("y1"),
        F.when(z["type"].isin(*FIGURES), "").otherwise(F.regexp_replace(z["body"], r"\n$", "")).alias("content"),
    ))


def normalize_headers(text: Column) -> Column:
    """Second-generation block headers in the older grammar; figures and charts are images."""
    out = F.regexp_replace(text, r"<BLOCK>(?:figure|image|chart)\[([0-9, ]*)\]<FORK>", "<|ref|>image<|/ref|><|det|>[[$1]]<|/det|>")
    return F.regexp_replace(out, r"<BLOCK>([a-z_]+)\[([0-9, ]*)\]<FORK>", "<|ref|>$1<|/ref|><|det|>[[$2]]<|/det|>")


def align(source: DataFrame, target: DataFrame) -> DataFrame:
    """(page, idx, type, translated): blocks of both layouts by position; both-blank ones and invalid boxes go."""
    s, t = source.alias("s"), target.alias("t")
    joined = s.join(t, ["page", "idx"]).where("s.type = t.type and s.x0 = t.x0 and s.y0 = t.y0 and s.x1 = t.x1 and s.y1 = t.y1")
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    keep = ((flat(F.col("s.content")) != "") | (flat(F.col("t.content")) != "")) & F.expr("s.x1 > s.x0 and s.y1 > s.y0")
    return joined.where(keep).select("page", "idx", F.col("s.type").alias("type"), (flat(F.col("s.content")) != flat(F.col("t.content"))).alias("translated"))


def violations(source: DataFrame, target: DataFrame) -> DataFrame:
    """(page, idx, what) of blocks that break the pairing of two layouts."""
    s = source.select("page", "idx", F.struct("type", "x0", "y0", "x1", "y1").alias("s"))
    t = target.select("page", "idx", F.struct("type", "x0", "y0", "x1", "y1").alias("t"))
    j = s.join(t, ["page", "idx"], "full")
    what = F.when(F.col("t").isNull(), "missing").when(F.col("s").isNull(), "extra").when(F.col("s.type") != F.col("t.type"), "type").when(~F.col("s").eqNullSafe(F.col("t")), "bbox")
    return j.select("page", "idx", what.alias("what")).where("what is not null")


def apply(source: DataFrame, texts: DataFrame) -> DataFrame:
    """Blocks with their content replaced where texts (page, idx, out, preserved) have one; nothing else changes."""
    j = source.join(texts, ["page", "idx"], "left")
    return j.withColumn("content", F.coalesce("out", "content")).drop("out")


def overlapping_pairs(blocks: DataFrame, share: float = 0.5) -> DataFrame:
    """(page, i, j, overlap) of blocks of a page whose overlap exceeds the share of the smaller one."""
    b = blocks.select("page", "idx", G.box(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))).alias("b"))
    p = b.select("page", F.col("idx").alias("i"), F.col("b").alias("bi")).join(b.select("page", F.col("idx").alias("j"), F.col("b").alias("bj")), "page").where("i < j")
    both = G.overlap(F.col("bi"), F.col("bj"))
    return p.where(both > share * F.least(G.area(F.col("bi")), G.area(F.col("bj")))).select("page", "i", "j", both.alias("overlap"))


def outside(lines: DataFrame, excluded: DataFrame, share: float = 0.5) -> DataFrame:
    """Lines that no excluded box of their page covers by more than the share of their area."""
    box = lambda: G.box(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    rects = excluded.groupBy("page").agg(F.collect_list(box()).alias("_rects"))  # boxes of one page
    line = lines.join(rects, "page", "left").withColumn("_b", box())
    hit = F.exists("_rects", lambda r: G.overlap(F.col("_b"), r) > share * G.area(F.col("_b")))
    return line.where(~F.coalesce(hit, F.lit(False))).drop("_rects", "_b")


def owners(spans: DataFrame, blocks: DataFrame, slack: int = 1, share: float = 0.35) -> DataFrame:
    """(page, span, owner, candidates): the block of each span by content, inclusion, overlap, distance, area, index.

    A span whose content matches several candidates is ambiguous and has no owner."""
    box = lambda: G.box(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    s = spans.select("page", "span", F.col("text").alias("st"), box().alias("sb"))
    b = blocks.select("page", "idx", F.col("content").alias("bt"), box().alias("bb"))
    sb, bb = F.col("sb"), F.col("bb")
    both, inside = G.overlap(sb, bb), G.center_inside(sb, bb, slack)
    pairs = s.join(b, "page").where(inside | (both >= share * F.greatest(G.area(sb), F.lit(1))))
    dx, dy = sb["x0"] + sb["x1"] - bb["x0"] - bb["x1"], sb["y0"] + sb["y1"] - bb["y0"] - bb["y1"]
    match = (F.col("st") != "") & F.contains("bt", "st")
    rank = F.struct(match.cast("int").alias("m"), inside.cast("int").alias("i"), both.alias("o"), (-(dx * dx + dy * dy)).alias("d"), (-G.area(bb)).alias("a"), (-F.col("idx")).alias("k"))
    best = pairs.groupBy("page", "span").agg(F.max_by("idx", rank).alias("owner"), F.count("*").alias("candidates"), F.count_if(match).alias("matches"))
    return best.select("page", "span", F.when(F.col("matches") <= 1, F.col("owner")).alias("owner"), "candidates", (F.col("matches") > 1).alias("ambiguous"))


def inline_rules(rules: DataFrame, blocks: DataFrame, slack: int = 2) -> DataFrame:
    """(page, rule, owner) of rules that exactly one non-empty block contains."""
    r = rules.select("page", "rule", *(F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")))
    j = r.join(blocks.where("content <> ''"), "page").where(f"rx0 >= x0 - {slack} and ry0 >= y0 - {slack} and rx1 <= x1 + {slack} and ry1 <= y1 + {slack}")
    return j.groupBy("page", "rule").agg(F.count("*").alias("n"), F.min("idx").alias("owner")).where("n = 1").drop("n")


def row_partners(left: DataFrame, right: DataFrame) -> DataFrame:
    """(page, i, j) of blocks whose vertical overlap is over half of the lower one."""
    l = left.select("page", F.col("idx").alias("i"), F.col("y0").alias("ly0"), F.col("y1").alias("ly1"))  # noqa: E741
    r = right.select("page", F.col("idx").alias("j"), F.col("y0").alias("ry0"), F.col("y1").alias("ry1"))
    both = F.least("ly1", "ry1") - F.greatest("ly0", "ry0")
    return l.join(r, "page").where("ly0 <= ry1 and ry0 <= ly1").where(both * 2 > F.least(F.col("ly1") - F.col("ly0"), F.col("ry1") - F.col("ry0"))).select("page", "i", "j")


def gutters(blocks: DataFrame, side: float = 0.2, cross: float = 0.25, gap: int = 3) -> DataFrame:
    """(page, x2): twice the x of the gutter of each page that has one.

    At each block edge the heights left and right of it are prefix sums; between neighbouring edges the
    crossing height is least, then the empty strip widest, then the middle nearest."""
    ends = blocks.select("page", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(0).alias("k")), F.struct(F.col("x1").alias("x"), F.lit(1).alias("k")))).alias("e"), (F.col("y1") - F.col("y0")).alias("h"))
    at = ends.groupBy("page", F.col("e.x").alias("x")).agg(
        F.sum(F.when(F.col("e.k") == 1, F.col("h")).otherwise(0)).alias("ending"), F.sum(F.when(F.col("e.k") == 0, F.col("h")).otherwise(0)).alias("starting"),
        F.count_if(F.col("e.k") == 1).alias("n_end"), F.count_if(F.col("e.k") == 0).alias("n_start"), F.max(F.when(F.col("e.k") == 1, F.col("e.x"))).alias("end_x"), F.min(F.when(F.col("e.k") == 0, F.col("e.x"))).alias("start_x"),
    )
    w = Window.partitionBy("page")
    up = w.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = w.orderBy("x").rowsBetween(1, Window.unboundedFollowing)
    run = at.select(
        "page", "x", F.lead("x").over(w.orderBy("x")).alias("nx"), F.sum("ending").over(up).alias("l"), F.coalesce(F.sum("starting").over(down), F.lit(0)).alias("r"), F.sum("ending").over(w).alias("total"),
        F.sum("n_end").over(up).alias("nl"), F.coalesce(F.sum("n_start").over(down), F.lit(0)).alias("nr"), F.max("end_x").over(up).alias("lx"), F.min("start_x").over(down).alias("rx"), F.min("x").over(w).alias("lo"), F.max("x").over(w).alias("hi"),
    )
    mid = (F.col("x") + F.col("nx")).alias("x2")
    ok = (F.col("l") >= side * F.col("total")) & (F.col("r") >= side * F.col("total")) & (F.col("total") - F.col("l") - F.col("r") <= cross * F.col("total")) & (F.col("nl") >= 2) & (F.col("nr") >= 2) & (F.col("rx") - F.col("lx") >= gap)
    rank = F.struct((F.col("total") - F.col("l") - F.col("r")).alias("c"), (F.col("lx") - F.col("rx")).alias("g"), F.abs(F.col("x2") - F.col("lo") - F.col("hi")).alias("m"), F.col("x2").alias("x"))
    return run.where("nx is not null").withColumn("x2", mid).where(ok).groupBy("page").agg(F.min(rank).alias("b")).select("page", F.col("b.x").alias("x2"))


def column_order(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Adds position: bands between blocks that span the gutter, in each band left column, then right."""
    b = blocks.join(found, "page", "left")
    span = F.col("x2").isNotNull() & (2 * F.col("x0") < F.col("x2")) & (2 * F.col("x1") > F.col("x2"))
    side = F.when(F.col("x2").isNull() | span, 0).when(F.col("x0") + F.col("x1") < F.col("x2"), 1).otherwise(2)
    down = Window.partitionBy("page").orderBy("y0", "x0", "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = b.withColumn("span", span).withColumn("side", side).withColumn("band", F.sum(F.col("span").cast("int")).over(down))
    w = Window.partitionBy("page").orderBy("band", "side", "y0", "x0", "idx")
    return b.withColumn("position", F.row_number().over(w).cast("long")).drop("x2", "span")


def outline(blocks: DataFrame) -> DataFrame:
    """(page, idx, level, text) of titles: the first is level 1, large ones 2, others 3; texts of up to 500 characters."""
    titles = blocks.where("type = 'title'")
    first = F.row_number().over(Window.partitionBy("doc").orderBy("page", "idx")) == 1
    return titles.withColumn("level", F.when(first, 1).when(F.col("fs") >= 2.2, 2).otherwise(3)).select("doc", "page", "idx", "level", F.substring("content", 1, 500).alias("text"))


def alignment(lines: DataFrame) -> DataFrame:
    """(page, idx, align) of blocks from the lines in them: centred, justified or neither."""
    centred = F.abs((F.col("lx0") - F.col("x0")) - (F.col("x1") - F.col("lx1"))) * 20 <= F.col("x1") - F.col("x0")
    ratio = (F.col("lx1") - F.col("lx0")) / (F.col("x1") - F.col("x0"))
    last = F.row_number().over(Window.partitionBy("page", "idx").orderBy(F.desc("line"))) == 1
    g = lines.withColumn("_c", centred.cast("int")).withColumn("_r", ratio).withColumn("_last", last).groupBy("page", "idx").agg(
        F.avg("_c").alias("share"), F.median("_r").alias("mid"), F.count("*").alias("n"), F.avg(F.when(~F.col("_last"), (F.col("_r") >= 0.82).cast("int"))).alias("full")
    )
    align = F.when((F.col("share") >= 0.75) & (F.col("mid") < 0.72), "center").when((F.col("n") >= 3) & (F.col("full") >= 0.5), "justify")
    return g.select("page", "idx", align.alias("align"))


def block_html(aspect: float = 1.414) -> Column:
    """A block's element at its place on the page, in hundredths: figures as images, other blocks with their text escaped;
    null for unreadable ones. A box that is six times as high as wide with twelve characters or more runs upwards.

    Columns: type, x0, y0, x1, y1, content, image, fs (null if the page tells none)."""
    at = {c: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(999)) for c in ("x0", "y0", "x1", "y1")}
    percent = lambda v: F.format_string("%.2f", v / 999 * 100)
    wide, high = at["x1"] - at["x0"], at["y1"] - at["y0"]
    size = lambda v: percent(F.greatest(v, F.lit(4)))
    style = F.concat(F.lit("left:"), percent(at["x0"]), F.lit("%;top:"), percent(at["y0"]), F.lit("%;width:"), size(wide), F.lit("%;height:"), size(high), F.lit("%;"))
    kind = F.when(F.col("type").rlike(r"^[A-Za-z_][\w-]{0,40}$"), F.col("type")).otherwise("text")
    up = F.col("fs").isNull() & (wide > 0) & (high * aspect >= 6 * wide) & (F.length("content") >= 12)
    font = F.when(F.col("fs").isNotNull(), F.concat(F.lit("font-size:"), F.format_string("%.2f", F.greatest(F.lit(0.6), F.least(F.lit(6.0), F.col("fs")))), F.lit("cqw;line-height:1.22;"))).otherwise("")
    text = F.col("content")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    image = F.concat(F.lit('<img class="layout-block layout-image" src="images/'), "image", F.lit('" style="'), style, F.lit('" alt="">'))
    element = F.concat(F.lit('<div class="layout-block layout-'), kind, F.when(up, " layout-vertical-up").otherwise(""), F.lit('" style="'), style, font, F.lit('" title="'), kind, F.lit('">'), text, F.lit("</div>"))
    return F.when(F.col("type") == "unreadable", None).when(F.col("image").rlike(r"^[\w.-]+$"), image).otherwise(element)
