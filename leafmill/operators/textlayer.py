"""Text layers of pages: spans to lines and blocks, figures, hidden text, tables from ink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry as G

BOX = ("x0", "y0", "x1", "y1")


def box(prefix: str = "") -> Column:
    return G.box(*(F.col(f"{prefix}{c}") for c in BOX))


def text_blocks(lines: DataFrame) -> DataFrame:
    """(page, block, x0, y0, x1, y1, text, size, line_height, horizontal, tabular) of rows (page, block, line, box, text, size, horizontal).

    size: that of most characters, the larger of equals; tabular: two pairs of lines or more stand side by side."""
    by_size = lines.groupBy("page", "block", "size").agg(F.sum(F.length("text")).alias("c"))
    size = by_size.groupBy("page", "block").agg(F.max(F.struct("c", "size")).alias("s")).select("page", "block", F.col("s.size").alias("size"))
    w = Window.partitionBy("page", "block").orderBy("line")
    beside = (F.lag("y0").over(w) < F.col("y1")) & (F.lag("y1").over(w) > F.col("y0")) & (F.lag("x1").over(w) <= F.col("x0"))
    g = lines.withColumn("_b", F.coalesce(beside, F.lit(False))).groupBy("page", "block").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("t"),
        F.avg(F.col("y1") - F.col("y0")).alias("line_height"), (F.count_if("horizontal") * 2 > F.count("*")).alias("horizontal"), (F.count_if("_b") >= 2).alias("tabular"),
    )
    return g.join(size, ["page", "block"]).select("page", "block", *BOX, F.array_join(F.col("t.text"), "\n").alias("text"), "size", "line_height", "horizontal", "tabular")


def plain_pages(blocks: DataFrame, wanted: list[int]) -> DataFrame:
    """(page, text) of the wanted pages, blocks in order; a page without text has none."""
    spark = blocks.sparkSession
    asked = spark.createDataFrame([(int(p),) for p in wanted], "page long")
    g = blocks.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("t")).select("page", F.array_join(F.col("t.text"), "\n").alias("text"))
    return asked.join(g, "page", "left")


def lines_in_boxes(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """(page, box, text): lines whose centre lies in a box, in rows of over 0.3 common height, a blank where the gap is over a quarter of it.

    Lines go by y0 and x0, those of a row by x0 and y0; of lines that begin at one point the narrower, lower, alphabetically first."""
    q = boxes.select("page", "box", box().alias("qb"))
    j = q.join(lines.select("page", box().alias("lb"), "text"), "page").where(G.center_inside(F.col("lb"), F.col("qb")))
    ties = ("lb.x1", "lb.y1", "text")
    w = Window.partitionBy("page", "box").orderBy("lb.y0", "lb.x0", *ties)
    before = F.lag("lb").over(w)
    high = F.least(G.height(F.col("lb")), G.height(before))
    j = j.withColumn("_new", F.coalesce(G.overlap_y(F.col("lb"), before) <= 0.3 * high, F.lit(True)).cast("int"))
    j = j.withColumn("row", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    along = Window.partitionBy("page", "box", "row").orderBy("lb.x0", "lb.y0", *ties)
    gap = F.col("lb.x0") - F.lag("lb.x1").over(along)
    piece = F.concat(F.when(gap > 0.25 * G.height(F.col("lb")), " ").otherwise(""), "text")
    rows = j.withColumn("_p", piece).groupBy("page", "box", "row").agg(F.array_sort(F.collect_list(F.struct(F.col("lb.x0").alias("x"), F.col("_p").alias("p")))).alias("t"))
    g = rows.groupBy("page", "box").agg(F.array_sort(F.collect_list(F.struct("row", F.array_join(F.col("t.p"), "").alias("p")))).alias("r"))
    return boxes.select("page", "box").join(g.select("page", "box", F.array_join(F.col("r.p"), "\n").alias("text")), ["page", "box"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def figures(images: DataFrame, width: str = "width", height: str = "height", most: int = 256) -> DataFrame:
    """(page, x0, y0, x1, y1, over): image boxes in 0..1, distinct at 7 digits, without those of 95 % of the page; over tells of more than `most`."""
    unit = [F.round(F.col(c) / F.col(width if c[0] == "x" else height), 7).alias(c) for c in BOX]
    d = images.select("page", *unit).where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) < 0.95).dropDuplicates(["page", *BOX])
    return d.withColumn("over", F.count("*").over(Window.partitionBy("page")) > most)


def trusted_figures(blocks: DataFrame, drawn: DataFrame, share: float = 0.1) -> DataFrame:
    """Figure blocks of which drawings cover a tenth or more."""
    d = drawn.select("page", box().alias("db"))
    b = blocks.select("page", "idx", box().alias("bb"))
    j = b.join(d, "page", "left").groupBy("page", "idx", "bb").agg(F.sum(F.coalesce(G.overlap(F.col("bb"), F.col("db")), F.lit(0))).alias("o"))
    return j.where((F.col("o") > 0) & (F.col("o") >= share * G.area(F.col("bb")))).select("page", "idx")


def trusted_equations(blocks: DataFrame, page_area: int = 999 * 999) -> DataFrame:
    """Equation blocks, unless those of the page take over half of it."""
    total = F.sum(G.area(box())).over(Window.partitionBy("page"))
    return blocks.withColumn("_t", total).where(F.col("_t") * 2 <= page_area).drop("_t")


def hidden_spans(spans: DataFrame, images: DataFrame) -> DataFrame:
    """(page, span) of spans that a later opaque image covers and over which no later text is drawn again."""
    s = spans.select("page", "span", "seq", "text", box().alias("sb"))
    i = images.where("opaque").select("page", F.col("seq").alias("iseq"), box().alias("ib"))
    covered = s.join(i, "page").where((F.col("iseq") > F.col("seq")) & (G.overlap(F.col("sb"), F.col("ib")) * 10 >= G.area(F.col("sb")) * 9))
    last = covered.groupBy("page", "span", "sb").agg(F.max("iseq").alias("iseq"))
    again = s.select("page", F.col("seq").alias("tseq"), F.col("sb").alias("tb"))
    redrawn = last.join(again, "page").where((F.col("tseq") > F.col("iseq")) & (G.overlap(F.col("sb"), F.col("tb")) > 0)).select("page", "span").distinct()
    return last.select("page", "span").join(redrawn, ["page", "span"], "left_anti")


def ink_runs(rows: DataFrame, least: int = 1) -> DataFrame:
    """(page, start, stop) of runs of inked rows; rows: (page, y, ink)."""
    inked = rows.where("ink > 0").withColumn("_i", F.col("y") - F.row_number().over(Window.partitionBy("page").orderBy("y")))
    return inked.groupBy("page", "_i").agg(F.min("y").alias("start"), F.max("y").alias("stop")).where(F.col("stop") - F.col("start") + 1 >= least).drop("_i")


def chosen_gaps(gaps: DataFrame, need: int, margin: float = 1.5) -> DataFrame:
    """(page, at) of the `need` widest gaps, forced ones first; none for a page where the next gap is not clearly narrower."""
    w = Window.partitionBy("page").orderBy(F.desc("forced"), F.desc("width"), "at")
    r = gaps.withColumn("_r", F.row_number().over(w))
    page = Window.partitionBy("page")
    last = F.max(F.when(F.col("_r") == need, F.col("width"))).over(page)
    following = F.coalesce(F.max(F.when(F.col("_r") == need + 1, F.col("width"))).over(page), F.lit(0))
    return r.withColumn("_l", last).withColumn("_f", following).where((F.col("_r") <= need) & (F.col("_l") >= F.col("_f") * margin)).select("page", "at")


def boundaries(centers: DataFrame) -> DataFrame:
    """(page, k, at): boundaries half way between the median centres of neighbouring columns; even ones where those do not rise."""
    m = centers.groupBy("page", "k").agg(F.median("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    page = Window.partitionBy("page")
    nxt = F.lead("c").over(page.orderBy("k"))
    x = m.withColumn("_n", nxt).withColumn("_bad", F.max(F.coalesce(nxt <= F.col("c"), F.lit(False)).cast("int")).over(page)).withColumn("_count", F.count("*").over(page)).withColumn("_lo", F.min("lo").over(page)).withColumn("_hi", F.max("hi").over(page))
    even = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("k") + 1) / F.col("_count")
    return x.where("_n is not null").select("page", "k", F.when(F.col("_bad") == 1, even).otherwise((F.col("c") + F.col("_n")) / 2).alias("at"))


def leading_bold(spans: DataFrame) -> DataFrame:
    """(page, block, prefix): the bold run that begins a block, of one to six words and at most 80 characters; null if there is none."""
    w = Window.partitionBy("page", "block").orderBy("span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = spans.withColumn("_plain", F.sum((~F.col("bold")).cast("int")).over(w)).where("_plain = 0")
    g = run.groupBy("page", "block").agg(F.array_sort(F.collect_list(F.struct("span", "text"))).alias("t")).select("page", "block", F.trim(F.array_join(F.col("t.text"), "")).alias("p"))
    fits = (F.size(F.split("p", r"\s+")) <= 6) & (F.length("p").between(1, 80))
    whole = spans.groupBy("page", "block").agg(F.bool_and("bold").alias("all"))
    return whole.join(g, ["page", "block"], "left").select("page", "block", F.when(~F.col("all") & fits, F.col("p")).alias("prefix"))


def cell_styles(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """(page, cell, size, align, bold) from spans whose centre lies in a cell: median size, alignment by the ink's centre, bold by majority."""
    j = cells.select("page", "cell", box().alias("cb")).join(spans.select("page", "size", "bold", box().alias("sb")), "page").where(G.center_inside(F.col("sb"), F.col("cb")))
    g = j.groupBy("page", "cell", "cb").agg(F.median("size").alias("size"), (F.count_if("bold") * 2 > F.count("*")).alias("bold"), F.min("sb.x0").alias("x0"), F.max("sb.x1").alias("x1"))
    off = ((F.col("x0") + F.col("x1")) - (F.col("cb.x0") + F.col("cb.x1"))) / (2 * G.width(F.col("cb")))
    return g.select("page", "cell", "size", F.when(F.abs(off) <= 0.08, "center").when(off >= 0.12, "right").otherwise("left").alias("align"), "bold")


def text_bands(spans: DataFrame) -> DataFrame:
    """(page, block, x0, y0, x1, y1): union of the base line bands of a block's spans, 0.8 above and 0.25 of the size below."""
    up, down = F.col("base") - 0.8 * F.col("size"), F.col("base") + 0.25 * F.col("size")
    return spans.groupBy("page", "block").agg(F.min("x0").alias("x0"), F.round(F.min(up), 4).alias("y0"), F.max("x1").alias("x1"), F.round(F.max(down), 4).alias("y1"))


def relocated_links(before: DataFrame, after: DataFrame) -> DataFrame:
    """(page, link, hit): the n-th link of an anchor text goes to its n-th occurrence after a change."""
    w = Window.partitionBy("page", "anchor")
    a = before.withColumn("_n", F.row_number().over(w.orderBy("link")))
    b = after.withColumn("_n", F.row_number().over(w.orderBy("hit")))
    return a.join(b, ["page", "anchor", "_n"], "left").select("page", "link", "hit")


def obstacles(drawings: DataFrame, blocks: DataFrame, slack: int = 3) -> DataFrame:
    """(page, drawing, kind): edge if a drawing follows a block's edge, backing if it holds a block, else obstacle."""
    d, b = drawings.select("page", "drawing", box().alias("db")), blocks.select("page", box().alias("bb"))
    j = d.join(b, "page", "left")
    db, bb = F.col("db"), F.col("bb")
    thin = F.least(G.width(db), G.height(db)) <= slack
    edge = thin & ((F.abs(db["y0"] - bb["y1"]) <= slack) | (F.abs(db["y1"] - bb["y0"]) <= slack)) & (G.overlap_x(db, bb) > 0)
    holds = (db["x0"] <= bb["x0"]) & (db["y0"] <= bb["y0"]) & (db["x1"] >= bb["x1"]) & (db["y1"] >= bb["y1"])
    g = j.groupBy("page", "drawing").agg(F.bool_or(F.coalesce(edge, F.lit(False))).alias("e"), F.bool_or(F.coalesce(holds, F.lit(False))).alias("h"))
    return g.select("page", "drawing", F.when(F.col("e"), "edge").when(F.col("h"), "backing").otherwise("obstacle").alias("kind"))


def washed(histogram: DataFrame) -> DataFrame:
    """(image, washed): 85 % of the pixels at 245 or more, and the darkest hundredth between 48 and 128; histogram: (image, level, n)."""
    w = Window.partitionBy("image")
    run = histogram.withColumn("_c", F.sum("n").over(w.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_t", F.sum("n").over(w))
    g = run.groupBy("image").agg((F.sum(F.when(F.col("level") >= 245, F.col("n")).otherwise(0)) >= 0.85 * F.max("_t")).alias("light"), F.min(F.when(F.col("_c") * 100 >= F.col("_t"), F.col("level"))).alias("black"))
    return g.select("image", (F.col("light") & (F.col("black") > 48) & (F.col("black") <= 128)).alias("washed"))


def clusters(boxes: DataFrame, most: int = 32) -> DataFrame:
    """(page, idx, cluster): overlapping boxes of a page together, by the least index, until nothing moves."""
    from leafmill.session import cut

    b = boxes.select("page", "idx", box().alias("b"))
    pairs = cut(b.join(b.select("page", F.col("idx").alias("j"), F.col("b").alias("bj")), "page").where((F.col("idx") != F.col("j")) & (G.overlap(F.col("b"), F.col("bj")) > 0)).select("page", "idx", "j"))
    now = cut(b.select("page", "idx", F.col("idx").alias("cluster")))
    for _ in range(most):
        seen = pairs.join(now.select("page", F.col("idx").alias("j"), F.col("cluster").alias("c")), ["page", "j"]).groupBy("page", "idx").agg(F.min("c").alias("c"))
        nxt = cut(now.join(seen, ["page", "idx"], "left").select("page", "idx", F.least("cluster", F.coalesce("c", "cluster")).alias("cluster"), (F.coalesce("c", "cluster") < F.col("cluster")).alias("moved")))
        moved = not nxt.where("moved").isEmpty()
        now = nxt.drop("moved")
        if not moved:
            return now
    raise RuntimeError("clusters did not settle")


def span_records(pages: DataFrame) -> DataFrame:
    """(page, span, x0, y0, x1, y1, text, size, flags, x, y, dx, dy): spans of nested pages (page, blocks) that are not blank, in order.

    A span's text is that of its characters where it lists them; the base point of a span without one is its lower
    left corner, the direction of a line without one is to the right."""
    b = pages.select("page", F.posexplode("blocks").alias("i", "b"))
    lines_ = b.select("page", "i", F.posexplode("b.lines").alias("j", "l"))
    spans = lines_.select("page", "i", "j", F.col("l.dir").alias("dir"), F.posexplode("l.spans").alias("k", "s"))
    text = F.when(F.col("s.chars").isNotNull(), F.array_join("s.chars", "")).otherwise(F.coalesce("s.text", F.lit("")))
    at = lambda c, k, other: F.coalesce(F.get(c, F.lit(k)), other)
    corner = [F.get("s.bbox", F.lit(k)).alias(n) for k, n in enumerate(BOX)]
    kept = spans.where((F.size("s.bbox") == 4) & (F.trim(F.regexp_replace(text, r"\s", " ")) != ""))
    named = kept.select(
        "page", F.struct("i", "j", "k").alias("_at"), *corner, text.alias("text"), F.coalesce("s.size", F.lit(0.0)).alias("size"), F.coalesce("s.flags", F.lit(0)).alias("flags"),
        at("s.origin", 0, F.get("s.bbox", F.lit(0))).alias("x"), at("s.origin", 1, F.get("s.bbox", F.lit(3))).alias("y"), at("dir", 0, F.lit(1.0)).alias("dx"), at("dir", 1, F.lit(0.0)).alias("dy"),
    )
    return named.withColumn("span", F.row_number().over(Window.partitionBy("page").orderBy("_at")).cast("long")).drop("_at")


def table_rules(segments: DataFrame, tables: DataFrame) -> DataFrame:
    """(page, tbl, x0, x1, y, width): horizontal segments that touch a table's frame, 2 wider and 3 higher than it is."""
    t = tables.select("page", "tbl", *(F.col(c).alias(f"_{c}") for c in BOX))
    near = (F.col("x1") >= F.col("_x0") - 2) & (F.col("x0") <= F.col("_x1") + 2) & F.col("y").between(F.col("_y0") - 3, F.col("_y1") + 3)
    return segments.join(t, "page").where(near).select("page", "tbl", "x0", "x1", "y", "width")
