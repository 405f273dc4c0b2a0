"""Queries over pages: framing, normalisation, fidelity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import fidelity, pages
from leafmill.plans.registry import query, table
from leafmill.session import spread

LINES = """lines as (
  select doc_id, unnest(l) as line, generate_subscripts(l, 1)::bigint as page
  from (select doc_id, string_split(text, chr(10)) as l from documents))"""
SPLIT = "string_split(n, '')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))


@query("document_page_split", "S08 X07", r"""
with p as (select doc_id, string_split(text, chr(10)) as l, text from documents)
select doc_id, case when text = '' then 0 else len(l) end::bigint as total,
  case when len(l) >= 2 then regexp_replace(regexp_replace(l[2], '^\s+', ''), '\s+$', '') else '' end as page_text
from p""")  # fmt: skip
def document_page_split(spark, d):
    return pages.page_context(_docs(spark, d), F.lit(2), "\n").select("doc_id", "total", "page_text")


@query("marked_page_split", "S09 P06 L05", r"""
with r as (select doc_id, case when doc_id % 3 = 0 then 'x' when doc_id % 3 = 1 then '  ' else '' end || '<PAGE>' || replace(text, chr(10), '<PAGE>') as raw from documents),
p as (select doc_id, string_split(raw, '<PAGE>') as a from r),
q as (select doc_id, case when trim(a[1]) = '' then a[2:] else a end as pages from p)
select doc_id, len(pages)::bigint as n_pages, regexp_replace(pages[1], '\s+$', '') as first_page, array_to_string(pages[1:2], '|') as leading from q""")
def marked_page_split(spark, d):
    head = F.when(F.col("doc_id") % 3 == 0, "x").when(F.col("doc_id") % 3 == 1, "  ").otherwise("")
    raw = F.concat(head, F.lit(T.PAGE_MARK), F.replace("text", F.lit("\n"), F.lit(T.PAGE_MARK)))
    df = _docs(spark, d).select("doc_id", pages.split_marked(raw).alias("pages"))
    return df.select("doc_id", F.size("pages").cast("long").alias("n_pages"), F.regexp_replace(F.get("pages", F.lit(0)), r"\s+$", "").alias("first_page"), F.array_join(F.slice("pages", 1, 2), "|").alias("leading"))


@query("separator_framing_check", "K01 S08", r"""
select doc_id, text, len(string_split(text, chr(10)))::bigint as pages, true as framed from documents""")
def separator_framing_check(spark, d):
    return pages.join_pages(pages.explode_pages(_docs(spark, d)), "\n")


@query("separator_neutralized", "P10", f"""
with {LINES},
x as (select doc_id, page, line as raw, case when page % 4 = 2 then '---' when page % 4 in (1, 3) then '' else line end as line from lines),
w as (select *, trim(line) = '---' and coalesce(trim(lag(line) over v) = '', true) and coalesce(trim(lead(line) over v) = '', true) as hit
  from x window v as (partition by doc_id order by page))
select doc_id, count(*)::bigint as n, count(*) filter (hit)::bigint as neutralized, count(*) filter (trim(line) = '---' and not hit)::bigint as kept from w group by doc_id""")
def separator_neutralized(spark, d):
    p = pages.explode_pages(_docs(spark, d))
    k = F.col("page") % 4
    p = p.withColumn("line", F.when(k == 2, "---").when(k.isin(1, 3), "").otherwise(F.col("line")))
    out = pages.neutralize_separator(p, "---")
    return out.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("neutralized").alias("neutralized"), F.count_if((F.trim("line") == "---") & ~F.col("neutralized")).alias("kept"))


@query("line_budget", "M01", f"""
with {LINES},
w as (select *, 500 - (sum(length(line)) over (partition by doc_id order by page) - length(line)) as left_ from lines)
select doc_id, page, substr(line, 1, left_::int) as kept, length(line) > left_ as cut from w where left_ > 0""")
def line_budget(spark, d):
    return pages.budgeted(pages.explode_pages(_docs(spark, d)), 500).select("doc_id", "page", "kept", "cut")


@query("page_chunks", "W16", f"""
with {LINES}
select doc_id, (page - 1) // 8 as chunk, count(*)::bigint as pages, min(page) as first_page, max(page) as last_page from lines group by 1, 2""")
def page_chunks(spark, d):
    c = pages.chunked(pages.explode_pages(_docs(spark, d)), 8)
    return c.groupBy("doc_id", "chunk").agg(F.count("*").alias("pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


@query("failed_chunk_placeholders", "M24", f"""
with {LINES},
n as (select doc_id, max(page) as n from lines group by 1),
slots as (select doc_id, unnest(range(1, n + 1)) as page from n)
select s.doc_id, s.page, l.line is null as filled, coalesce(l.line, '[failed]') as line
from slots s left join (select * from lines where (doc_id + page) % 5 <> 0) l using (doc_id, page)""")
def failed_chunk_placeholders(spark, d):
    p = pages.explode_pages(_docs(spark, d))
    return pages.placeholders(p.groupBy("doc_id").agg(F.max("page").alias("n")), p.where("(doc_id + page) % 5 <> 0"), "[failed]").select("doc_id", "page", "filled", "line")


@query("overflow_pages_folded", "M22 J18", f"""
with {LINES}
select doc_id, least(page, 6) as slot, string_agg(case when page > 6 then 'x' || (page - 6) || '_' else '' end || 'p' || page || '.jpg', ',' order by page) as names
from lines group by 1, 2""")
def overflow_pages_folded(spark, d):
    f = pages.fold_overflow(pages.explode_pages(_docs(spark, d)), 6)
    name = F.concat("prefix", F.lit("p"), "page", F.lit(".jpg"))
    g = f.groupBy("doc_id", "slot").agg(F.array_sort(F.collect_list(F.struct("page", name.alias("name")))).alias("x"))
    return g.select("doc_id", "slot", F.array_join(F.col("x.name"), ",").alias("names"))


@query("page_texts_normalized", "P02 P28 X01 X07", r"""
select doc_id, lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) as plain,
  lower(regexp_replace(regexp_replace(regexp_replace('<|ref|>title<|/ref|> ![x](y.png) <b>' || text || '</b>', '<\|[^|]*\|>', ' ', 'g'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '</?[A-Za-z][^>\n]*>', '', 'g').regexp_replace('[^\p{L}\p{N}]+', '', 'g')) as aligned,
  regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+', ''), '\s+$', '') as collapsed
from documents""")
def page_texts_normalized(spark, d):
    marked = F.concat(F.lit("<|ref|>title<|/ref|> ![x](y.png) <b>"), "text", F.lit("</b>"))
    return _docs(spark, d).select("doc_id", T.normalize_latin(F.col("text")).alias("plain"), T.align_norm(marked).alias("aligned"), T.collapse(F.col("text")).alias("collapsed"))


@query("special_tokens_sanitized", "P09", r"""
with r as (select doc_id, '<|<|a|>b|>' || text || '<PAGE>' || case when doc_id % 2 = 0 then '<|det|>' else '' end as t from documents)
select doc_id, replace(regexp_replace(regexp_replace(t, '<\|[^|]*\|>', '', 'g'), '<\|[^|]*\|>', '', 'g'), '<PAGE>', '⟨PAGE⟩') as clean from r""")
def special_tokens_sanitized(spark, d):
    raw = F.concat(F.lit("<|<|a|>b|>"), "text", F.lit("<PAGE>"), F.when(F.col("doc_id") % 2 == 0, "<|det|>").otherwise(""))
    return _docs(spark, d).select("doc_id", T.sanitize(raw).alias("clean"))


CANDIDATE = """cand as (
  select doc_id, string_agg(case when page % 5 = 0 then line || chr(10) || line else line end, chr(10) order by page) filter (page % 3 <> 0) as cand from lines group by doc_id)"""
SCORES = f"""with {LINES}, {CANDIDATE},
b as (select d.doc_id, lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) as t, lower(regexp_replace(coalesce(cand, ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g')) as c
  from documents d join cand using (doc_id)),
s as (select doc_id, t, c, string_split(t, '') as ta, string_split(c, '') as ca from b),
g as (select doc_id, unnest([ta[i] || ta[i + 1] for i in range(1, len(ta))]) as gram, 1 as t, 0 as c from s
  union all select doc_id, unnest([ca[i] || ca[i + 1] for i in range(1, len(ca))]), 0, 1 from s),
m as (select doc_id, gram, sum(t) as t, sum(c) as c from g group by 1, 2),
k as (select doc_id, sum(least(t, c)) as shared, sum(t) as total from m group by 1),
f as (select b.doc_id, length(b.t)::bigint as truth_chars, length(b.c)::bigint as cand_chars,
  case when length(b.t) >= 200 then round(coalesce(case when total > 0 then shared / total else 1.0 end, 1.0)
    * case when length(b.c) > 0 then least(1.0, 1.3 * length(b.t) / length(b.c)) else 1.0 end, 6) end as score
  from b left join k using (doc_id))"""


def damaged(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a candidate that lacks every third line and repeats every fifth."""
    docs = _docs(spark, d)
    kept = F.filter(F.transform(T.lines(F.col("text")), lambda x, k: F.when((k + 1) % 3 == 0, None).when((k + 1) % 5 == 0, F.concat(x, F.lit("\n"), x)).otherwise(x)), lambda x: x.isNotNull())
    return docs.select("doc_id", "text", F.array_join(kept, "\n").alias("cand"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return fidelity.page_fidelity(damaged(spark, d), ["doc_id"], "text", "cand")


@query("page_fidelity_score", "A01 A02 A03 X03", SCORES + " select * from f")
def page_fidelity_score(spark, d):
    return scored(spark, d)


@query("fidelity_decision_table", "C05", SCORES + """,
p as (select doc_id // 20 as job, doc_id as page, score, cand_chars * 10 < truth_chars as lost from f),
r as (select *, coalesce(score < 0.7, false) as candidate, greatest(2, floor(count(*) over (partition by job) * 0.2))::bigint as budget from p),
z as (select *, row_number() over (partition by job, candidate order by lost desc, score, page) as rk from r)
select job, page, score, lost, budget, case when score is null then 'unmeasurable' when not candidate then 'kept' when rk <= budget then 'retry' else 'skipped' end as decision,
  case when score is null or not candidate then null when page % 7 = 0 then 'failed' when page % 3 = 0 then 'accepted' when not lost and page % 2 = 0 then 'limit' else 'rejected' end as outcome from z""")
def fidelity_decision_table(spark, d):
    p = scored(spark, d).select(F.floor(F.col("doc_id") / 20).alias("job"), F.col("doc_id").alias("page"), "score", (F.col("cand_chars") * 10 < F.col("truth_chars")).alias("lost"))
    out = fidelity.decisions(p, 0.2, key="job")
    k = F.col("page")
    after = F.when(k % 7 == 0, None).when(k % 3 == 0, F.col("score") + 0.2).when(k % 2 == 0, F.col("score")).otherwise(F.col("score") - 0.3)
    tried = F.col("decision").isin("retry", "skipped")
    return out.withColumn("outcome", F.when(tried, fidelity.retry_outcome(F.col("score"), after, F.col("lost"))))


@query("untrusted_text_share", "F08", r"""
with b as (select doc_id, lang, regexp_replace(case when doc_id % 9 = 0 then repeat(chr(57344), 200) || text when doc_id % 9 = 1 then repeat('#', 4 * length(text)) || text else text end, '\s+', '', 'g') as t from documents),
r as (select lang, case when length(t) = 0 then 'empty'
  when (length(t) - length(regexp_replace(t, '[\x{E000}-\x{F8FF}\x{FFFD}\x00-\x08\x0E-\x1F]', '', 'g'))) * 5 >= length(t) then 'broken-glyphs'
  when (length(t) - length(regexp_replace(t, '[\p{L}\p{N}]', '', 'g'))) * 10 < length(t) * 3 then 'mostly-symbols' else '' end as reason from b)
select lang, reason, count(*)::bigint as n from r group by 1, 2""")
def untrusted_text_share(spark, d):
    k = F.col("doc_id") % 9
    raw = F.when(k == 0, F.concat(F.repeat(F.lit(chr(0xE000)), 200), "text")).when(k == 1, F.concat(F.repeat(F.lit("#"), 4 * F.length("text")), "text")).otherwise(F.col("text"))
    return _docs(spark, d).select("lang", fidelity.untrusted_reason(raw).alias("reason")).groupBy("lang", "reason").agg(F.count("*").alias("n"))


@query("answer_postprocess", "P23 P25", r"""
with a as (select doc_id, case doc_id % 4 when 0 then '<think>plan' || chr(10) || 'more</think> <think>x</think>  ' || text when 1 then '```md' || chr(10) || text || chr(10) || '```'
  when 2 then 'GET http://h/p?token=' || doc_id || '&x=1 (again) ' || text else text end as t from documents),
b as (select doc_id, regexp_replace(regexp_replace(regexp_replace(t, '^(?s:\s*<think>.*?</think>)+', ''), '^\s+', ''), '\s+$', '') as t from a)
select doc_id, regexp_replace(case when regexp_matches(t, '^```[^\n]*\n(?s:.*)\n```$') then regexp_extract(t, '^```[^\n]*\n(?s:(.*))\n```$', 1) else t end, '\?[^\s''"()<>]*', '?…', 'g') as answer from b""")
def answer_postprocess(spark, d):
    k = F.col("doc_id") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit("<think>plan\nmore</think> <think>x</think>  "), "text")).when(k == 1, F.concat(F.lit("```md\n"), "text", F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("GET http://h/p?token="), "doc_id", F.lit("&x=1 (again) "), "text")).otherwise(F.col("text"))
    )
    return _docs(spark, d).select("doc_id", T.redact_query(T.strip_think(raw)).alias("answer"))
