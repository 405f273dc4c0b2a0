"""Readers of the document artefacts, each with a fixed schema: nothing is inferred, malformed records are dropped
or come back as null columns, and every reader takes a path of any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "type string, bbox array<int>, content string, crop_index int, image string, fs double, bold boolean, font_style string, align string, vertical string, preserved string"
LAYOUT = f"page int, width int, height int, fonts_v int, blocks array<struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in BLOCK.split(', '))}>>"
JOB = (
    "id string, filename string, mode string, workflow string, dpi int, status string, created_at string, error string, warnings array<string>, notices array<string>, engine string, model_id string,"
    " submitted boolean, submit_order bigint, page_separator string, started_at string, finished_at string, progress struct<phase: string, current_page: int, total_pages: int, chunk: int, total_chunks: int>"
)
FIGURE = "struct<x1: int, y1: int, x2: int, y2: int, image_width: int, image_height: int, refined: boolean>"
GLOSSARY = "src string, ko string, policy string, first_unit string, first_unit_lay string"


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, page from 1, raw) of files {"pages": [text, ...]}."""
    df = spark.read.schema("pages array<string>").option("multiLine", True).json(path)
    return df.select(F.col("_metadata.file_path").alias("file"), F.posexplode("pages").alias("k", "raw")).select("file", (F.col("k") + 1).alias("page"), "raw")


def layout(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, width, height, fonts_v, blocks) of layout files; a page without a number is dropped."""
    df = spark.read.schema(LAYOUT).option("multiLine", True).json(path)
    return df.where("page is not null").select(F.col("_metadata.file_path").alias("file"), "*")


def blocks(pages: DataFrame) -> DataFrame:
    """Flat form of layout pages: (file, page, idx, type, x0, y0, x1, y1, content, ...)."""
    b = pages.select("file", "page", F.posexplode("blocks").alias("idx", "b"))
    box = [F.get("b.bbox", F.lit(k)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]
    return b.select("file", "page", "idx", "b.type", *box, "b.content", "b.crop_index", "b.image", "b.fs", "b.bold", "b.align", "b.preserved")


def layout_units(flat: DataFrame) -> DataFrame:
    """(unit_id, kind, page, src, skip_reason) of blocks that carry text; references and unreadable ones are skipped with a reason."""
    kept = flat.where("image is null and trim(coalesce(content, '')) <> ''")
    reason = F.when(F.col("type") == "ref_text", "references").when(F.col("type") == "unreadable", "unreadable").otherwise("")
    return kept.select(F.concat_ws(":", F.lit("lay"), "page", "idx").alias("unit_id"), F.col("type").alias("kind"), "page", F.col("content").alias("src"), reason.alias("skip_reason"))


def jobs(spark: SparkSession, root: str, files: str = "j_*/meta.json", records: str = "files") -> DataFrame:
    """Job records under root: a running one is an error after a restart, a queued one is submitted again in order.

    records: a record to a file (files) or to a line (lines)."""
    df = spark.read.schema(JOB).option("multiLine", records == "files").json(f"{root}/{files}").where("id rlike '^j_[0-9a-f]{12}$'")
    return df.withColumn("status", F.when(F.col("status") == "running", "error").otherwise(F.col("status"))).withColumn("resubmit", (F.col("status") == "queued") & F.coalesce("submitted", F.lit(False)))


def figure_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, x1, y1, x2, y2, image_width, image_height, refined) of files {name: box}."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"map<string, {FIGURE}>").alias("m"))
    return df.select("file", F.explode("m").alias("name", "b")).select("file", "name", "b.*")


def units_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, text) of a file {key: text}."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("key", "text"))


def glossary(spark: SparkSession, path: str, lower: bool = False, records: str = "files") -> DataFrame:
    """Glossary entries; lower folds the sources of a seed. records: an array to a file (files) or an entry to a line (lines)."""
    df = spark.read.schema(GLOSSARY).option("multiLine", records == "files").json(path).where("src is not null")
    return df.withColumn("src", F.lower("src")) if lower else df


def sse(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, event, data, text) of captured event streams: records end with a blank line."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n\r?\n")).alias("seq", "record"))
    event = F.regexp_extract("record", r"(?m)^event: ?(.*)$", 1)
    data = F.array_join(F.regexp_extract_all("record", F.lit(r"(?m)^data: ?(.*)$"), F.lit(1)), "\n")
    parsed = whole.select("file", F.col("seq").cast("long").alias("seq"), event.alias("event"), data.alias("data")).where("event <> '' or data <> ''")
    return parsed.withColumn("text", F.get_json_object("data", "$.text"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, kind, reason) of uploaded files: what is too large or of an unknown kind has a reason. Spark lists no files of length zero."""
    df = spark.read.format("binaryFile").load(path).select("path", "length", F.substring("content", 1, 8).alias("head"))
    kind = F.when(F.col("head").startswith(F.lit(b"%PDF-")), "pdf").when(F.hex("head").startswith("89504E47"), "png").when(F.hex("head").startswith("FFD8FF"), "jpeg")
    reason = F.when(F.col("length") > 200 * 1024 * 1024, "too-large").when(kind.isNull(), "unknown-kind").otherwise("")
    return df.select("path", "length", kind.alias("kind"), reason.alias("reason"))


def generated_pages(spark: SparkSession, jobs_: int, pages: int) -> DataFrame:
    """(job, page, raw): deterministic grounded pages, for tests and demonstrations."""
    n = spark.range(jobs_ * pages).select(F.floor(F.col("id") / pages).alias("job"), (F.col("id") % pages + 1).alias("page"))
    x = F.pmod(F.xxhash64("job", "page"), F.lit(700)).cast("int")
    return n.withColumn("raw", F.concat(F.lit("<|det|>title ["), x, F.lit(", 10, "), x + 200, F.lit(", 40]<|/det|>Page "), "page", F.lit("\n<|det|>text ["), x, F.lit(", 60, "), x + 250, F.lit(", 300]<|/det|>Body of job "), "job"))
