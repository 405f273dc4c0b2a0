"""Operator 6: personal data, with information-theoretic sanitisation. DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers, found by
fixed patterns. Each distinct value is a protected entity. Words that share
documents with an entity can give it away: over all documents, with N
documents, df(t) holding term t, df(e) entity e, and df(e, t) both, at any
distance,

    disclosure(t, e) = PMI(t; e) / IC(e) = log(N df(e,t) / (df(t) df(e))) / log(N / df(e)),

the share of the entity's information that the term carries. A pair is judged
only if it has been seen in at least SUPPORT different surroundings, as
copies of one passage are no evidence: the term within WINDOW characters of
so many mentions that read differently, or both in so many documents whose
mentions do. Terms over GENERALISE are replaced by a general mark wherever
they stand in a document that holds the entity, terms over REMOVE are
removed. Base spans always stay.

The patterns are written so that Java's matcher neither recurses by the
length of a match nor scans a run of characters again from each of its
places; they match the same texts as the plain ones. Positions of matches
come from the lengths of the pieces between them. Terms are looked for in the
documents that hold an entity of enough surroundings, which are moved once to
meet it; only the document frequencies of terms need all documents again.

Defined results: a null text is an empty one and has no spans (its digest is
that of the empty string); repeated rows are reported each, and count as
documents each but as one surrounding; an empty table gives an empty result;
columns other than the id and the text are not read by pii_spans, and are
passed through by sanitise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.storage import Scratch
from leafmill.session import spread

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
WINDOW = 60
SUPPORT = 3
GENERALISE = 0.8
REMOVE = 0.95

_LOCAL = "A-Za-z0-9._%+-"
_LABEL = "A-Za-z0-9-"
#: The plain patterns are [..]+@[..]+(\.[..]+)+ and so on; see the docstring.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++\.[{_LABEL}](?:[{_LABEL}.](?<!\.(?![{_LABEL}])))*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])(?=[0-9](?:[ -]?[0-9]){11})[0-9](?:[0-9 -](?<![ -](?![0-9])))++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that a text without a match mostly fails.
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WORD = r"(?<![\p{L}\p{N}_])\p{L}{3,}+(?![\p{L}\p{N}_])"
_STEP = 256


def _running(steps: Column) -> Column:
    """Running totals of an array of ints; linear but for its square over _STEP squared."""
    def plain(values: Column, start: Column) -> Column:
        grown = F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(grown, F.lit(2), F.size(values))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _STEP).cast("int")), lambda c: F.slice(steps, c * _STEP + 1, F.lit(_STEP)))
    parts = F.transform(chunks, lambda c: F.struct(c.alias("c"), F.aggregate(c, F.lit(0), lambda a, x: a + x).alias("s")))
    flat = F.transform(parts, lambda p, k: plain(p["c"], F.aggregate(F.slice(parts["s"], F.lit(1), k), F.lit(0), lambda a, x: a + x)))
    return F.when(F.size(steps) <= _STEP, plain(steps, F.lit(0))).otherwise(F.flatten(flat))


def located(text: Column, pattern: str, found: Column, kind: int) -> Column:
    """array<struct<start, kind, end, value>> of the matches `found` of the pattern, in code points."""
    pieces = F.split(text, pattern, -1)
    steps = F.transform(found, lambda m, k: F.length(F.get(pieces, k)) + F.when(k > 0, F.length(F.get(found, k - 1))).otherwise(0))
    starts = _running(steps)
    return F.when(
        F.size(found) > 0,
        F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(m)).alias("end"), m.alias("value"))),
    ).otherwise(F.expr("cast(array() as array<struct<start: int, kind: int, end: int, value: string>>)"))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backwards = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(backwards, lambda d, k: F.when(k % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.length(_digits(v)).between(12, 19) & _luhn(_digits(v))
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


def _valid_only(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def with_spans(df: DataFrame, text: Column, name: str = "_spans") -> DataFrame:
    """df with the valid base spans of the text, ordered by start, then kind."""
    cols = [f"{name}_{k}" for k in KINDS]
    for kind, col in zip(KINDS, cols, strict=True):
        all_ = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        none = F.expr("cast(array() as array<string>)")
        df = df.withColumn(col, F.when(F.contains(text, F.lit(HINT[kind])), all_).otherwise(none) if HINT[kind] else all_)
    parts = [_valid_only(located(text, PATTERNS[k], F.col(c), n), k) for n, (k, c) in enumerate(zip(KINDS, cols, strict=True))]
    some = F.lit(False)
    for c in cols:
        some = some | (F.size(c) > 0)
    empty = F.expr("cast(array() as array<struct<start: int, kind: int, end: int, value: string>>)")
    return df.withColumn(name, F.when(some, F.array_sort(F.concat(*parts))).otherwise(empty)).drop(*cols)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in (*KINDS, TERM)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _windows(marked: DataFrame) -> DataFrame:
    """(uid, _spans, entity, low, around, last) of each base span; marked: uid, text, _spans.

    around: the text within WINDOW characters, from low on; last: whether it reaches the end of the text."""
    each = marked.select("uid", "_spans", "text", F.explode("_spans").alias("s"))
    low = F.greatest(F.col("s.start") - WINDOW, F.lit(0))
    return each.select(
        "uid", "_spans", F.xxhash64(F.col("s.kind"), F.lower("s.value")).alias("entity"), low.alias("low"),
        F.expr(f"substring(text, greatest(s.start - {WINDOW}, 0) + 1, s.end - greatest(s.start - {WINDOW}, 0) + {WINDOW})").alias("around"),
        (F.col("s.end") + WINDOW >= F.length("text")).alias("last"),
    )


def _free(start: Column, end: Column) -> Column:
    """Whether no base span is touched."""
    return ~F.exists("_spans", lambda s: (s["start"] < end) & (start < s["end"]))


def _surroundings(windows: DataFrame) -> DataFrame:
    """(entity, around, term) of the words in each window, without repetition.

    Words that touch a base span or are cut by the window are left out."""
    each = windows.withColumn("words", F.regexp_extract_all("around", F.lit(WORD), F.lit(0)))
    each = each.withColumn("words", located(F.col("around"), WORD, F.col("words"), len(KINDS)))
    each = each.withColumn("w", F.explode("words"))
    inside = ((F.col("w.start") > 0) | (F.col("low") == 0)) & ((F.col("w.end") < F.length("around")) | F.col("last"))
    free = _free(F.col("low") + F.col("w.start"), F.col("low") + F.col("w.end"))
    return each.where(inside & free).select("entity", F.xxhash64("around").alias("around"), F.lower("w.value").alias("term")).distinct()


def _terms(text: Column, spans: Column) -> Column:
    """The distinct lower-case words of a text that touch no base span."""
    word = r"^[\p{L}\p{N}_]"

    def mark(s: Column) -> Column:  # a word next to a span stays one only if it was
        edges = [F.when(F.rlike(c, F.lit(word)), "_").otherwise(" ") for c in (F.substring(s["value"], 1, 1), F.right(s["value"], F.lit(1)))]
        return F.concat(edges[0], F.lit(" "), edges[1])

    return F.array_distinct(F.regexp_extract_all(F.lower(replaced(text, spans, mark)), F.lit(WORD), F.lit(0)))


def _words(marked: DataFrame) -> DataFrame:
    """(uid, term, start, end) of every word of the texts, by running totals of the lengths of the pieces between them."""
    pieces = F.transform(F.split("text", WORD, -1), lambda x: F.length(x))
    each = marked.select("uid", F.posexplode(F.arrays_zip(pieces.alias("gap"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("word"))))
    each = each.where(F.col("col.word").isNotNull()).select("uid", "pos", "col.gap", "col.word")
    end = F.sum(F.col("gap") + F.length("word")).over(Window.partitionBy("uid").orderBy("pos")).cast("int")
    return each.select("uid", F.lower("word").alias("term"), (end - F.length("word")).alias("start"), end.alias("end"))


def _held(marked: DataFrame, scratch: Scratch, total: int) -> tuple[DataFrame, DataFrame]:
    """(held, near): a row (uid, entities, terms) of every document that holds an entity with at least SUPPORT
    surroundings, entities with their df_e and one surrounding; and (entity, term, around) of the words near those."""
    windows = scratch.table(_windows(marked), "windows")
    entities = windows.groupBy("entity").agg(F.countDistinct("uid").alias("df_e"), F.countDistinct(F.xxhash64("around")).alias("surroundings"))
    entities = scratch.table(entities.where((F.col("surroundings") >= SUPPORT) & (F.col("df_e") < total)).select("entity", "df_e"), "entities")
    mentions = windows.groupBy("uid", "entity").agg(F.min(F.xxhash64("around")).alias("around")).join(entities, "entity")
    mentions = mentions.groupBy("uid").agg(F.collect_list(F.struct("entity", "df_e", "around")).alias("entities"))
    held = marked.join(scratch.table(mentions, "mentions"), "uid").select("uid", "entities", _terms(F.col("text"), F.col("_spans")).alias("terms"))
    return scratch.table(held, "held"), _surroundings(windows.join(entities, "entity", "left_semi"))


def _pairs(held: DataFrame) -> DataFrame:
    """(uid, entity, df_e, around, term) of each entity and term of a document."""
    each = held.select("uid", "terms", F.explode("entities").alias("e"))
    return each.select("uid", "e.*", F.explode("terms").alias("term"))


def disclosures(docs: DataFrame, held: DataFrame, near: DataFrame, scratch: Scratch, text_col: str, total: int) -> DataFrame:
    """(entity, term, disclosure) of the pairs over GENERALISE; counts run over all documents.

    disclosure >= GENERALISE means df(t) <= df(e, t) (N / df(e)) ** (1 - GENERALISE). A term that stands in more
    documents with entities than that allows is dropped early: no pair is lost. The frequencies of all terms are
    summed up in each task before they move."""
    total = float(total)
    pairs = _pairs(held).groupBy("entity", "term").agg(
        F.first("df_e").alias("df_e"), F.count("*").alias("both"), F.countDistinct("around").alias("documents")
    )
    close = near.groupBy("entity", "term").agg(F.count("*").alias("near"))
    at_least = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("seen"))
    most = F.col("both") * F.pow(F.lit(total) / F.col("df_e"), F.lit(1 - GENERALISE)) * 1.001
    pairs = pairs.join(close, ["entity", "term"], "left").where(F.greatest("documents", "near") >= SUPPORT).join(at_least, "term")
    pairs = scratch.table(pairs.where(F.col("seen") <= most).select("entity", "term", "both", "df_e"), "pairs")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(r"\p{L}{3,}+"), F.lit(0)))
    frequency = docs.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count("*").alias("df_t"))
    share = F.log(total * F.col("both") / (F.greatest("df_t", "both") * F.col("df_e"))) / F.log(total / F.col("df_e"))
    return pairs.join(frequency, "term").select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= GENERALISE)


def _mark(docs: DataFrame, columns: list[Column], scratch: Scratch, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(marked, hits): rows with a number, the given columns, the texts of rows with spans, their base spans;
    and (uid, terms) with the disclosing terms of a row, ordered."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = spread(docs).select(*columns, F.col(text_col).cast("string").alias("_text"))
    rows = with_spans(rows, text).withColumn("text", F.when(F.size("_spans") > 0, F.col("_text"))).drop("_text")
    marked = scratch.table(rows.withColumn("uid", F.monotonically_increasing_id()), "marked")
    some = marked.where(F.size("_spans") > 0).select("uid", "text", "_spans")
    total = docs.count()
    held, near = _held(some, scratch, total)
    told = scratch.table(disclosures(docs, held, near, scratch, text_col, total), "disclosures")
    found = scratch.table(_pairs(held).join(told, ["entity", "term"]).groupBy("uid", "term").agg(F.max("disclosure").alias("disclosure")), "found")
    scratch.keep(marked, found)
    each = _words(some.join(found.select("uid").distinct(), "uid", "left_semi")).join(found, ["uid", "term"])
    hits = each.join(some.select("uid", "_spans"), "uid").where(_free(F.col("start"), F.col("end")))
    span = F.struct("start", F.lit(len(KINDS)).alias("kind"), "end", F.when(F.col("disclosure") >= REMOVE, "").otherwise("[term]").alias("value"))
    return marked, hits.groupBy("uid").agg(F.array_sort(F.collect_list(span)).alias("terms"))  # words of one row


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms) of every row."""
    scratch = Scratch(docs.sparkSession, "pii")
    marked, hits = _mark(docs, [F.col(id_col).alias("_id")], scratch, text_col)
    terms = F.coalesce("terms", F.expr("cast(array() as array<struct<start: int, kind: int, end: int, value: string>>)"))
    everything = F.array_sort(F.concat("_spans", terms))
    counts = [_count(F.col("_spans"), n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return marked.join(hits, "uid", "left").select(
        F.col("_id").alias(id_col), *counts, F.sha2(listed(F.col("_spans")), 256).alias("base_sha256"), listed(everything).alias("spans"), F.size(terms).cast("long").alias("n_terms")
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with spans replaced: base spans by <kind>, terms by their value; what overlaps an earlier span is
    joined to it."""
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    return replaced(text, spans, lambda s: F.when(s["kind"] < len(KINDS), F.get(names, s["kind"])).otherwise(s["value"]))


def replaced(text: Column, spans: Column, marked: Callable[[Column], Column]) -> Column:
    """The text with a mark for each span; what overlaps an earlier span is joined to it."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        grown = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), marked(s))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, grown).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with the text sanitised; all columns stay, length_col is the new length of the text."""
    scratch = Scratch(docs.sparkSession, "sanitise")
    cols = docs.columns
    kept = [F.col(c).alias(f"_c{n}") for n, c in enumerate(cols)]
    marked, hits = _mark(docs, kept, scratch, text_col)
    terms = F.coalesce("terms", F.expr("cast(array() as array<struct<start: int, kind: int, end: int, value: string>>)"))
    clean = marked.where(F.size("_spans") == 0).select(*(F.col(f"_c{n}").alias(c) for n, c in enumerate(cols)))
    changed = marked.where(F.size("_spans") > 0).join(hits, "uid", "left").withColumn("_all", F.array_sort(F.concat("_spans", terms)))
    changed = changed.withColumn("_new", redacted(F.col("text"), F.col("_all")))
    now = {text_col: F.col("_new")} | ({length_col: F.length("_new").cast("long")} if length_col in cols else {})
    return clean.unionByName(changed.select(*(now.get(c, F.col(f"_c{n}")).alias(c) for n, c in enumerate(cols))))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    return pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
