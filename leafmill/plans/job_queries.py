"""Queries over jobs, event logs, rate windows and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators import evaluate, jobs, pages
from leafmill.plans.page_queries import LINES
from leafmill.plans.registry import query, table

US = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
STATUS = "case event_type when 'signup' then 'queued' when 'view' then 'running' when 'error' then 'error' when 'click' then 'queued' else 'done' end"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("us", F.expr(US))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    state = jobs.latest_state(_events(spark, d), "user_id", ["us", "event_id"], "event_type", "us", "event_id", "value")
    return state.withColumn("status", F.expr(STATUS)).withColumnRenamed("user_id", "job_id")


JOBS = f"""e as (select *, epoch_us(ts) as us from events),
j as (select user_id as job_id, arg_max(event_type, (us, event_id)) as event_type, max(us) as us, arg_max(event_id, (us, event_id)) as event_id, arg_max(value, (us, event_id)) as value from e group by 1),
s as (select *, {STATUS} as status from j)"""


@query("job_states", "", f"with {JOBS} select job_id, status, us, case status when 'running' then 'error' else status end as after_restart from s")
def job_states(spark, d):
    j = _jobs(spark, d)
    return j.select("job_id", "status", "us", F.when(F.col("status") == "running", "error").otherwise(F.col("status")).alias("after_restart"))


@query("queue_position", "W01", f"""with {JOBS}, q as (select job_id, status, case when event_id % 3 = 0 then null else event_id end as submit_seq from s)
select job_id, status, submit_seq, case when status = 'queued' then row_number() over (partition by status order by submit_seq nulls last, job_id) end as position from q""")
def queue_position(spark, d):
    j = _jobs(spark, d).select("job_id", "status", F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("submit_seq"))
    return jobs.queue_position(j)


@query("job_page_keyset", "L01", f"""with {JOBS}, c as (select us, job_id from s order by us desc, job_id desc limit 1 offset 4),
p as (select s.job_id, s.us, row_number() over (order by s.us desc, s.job_id desc) as rank, count(*) over () as n from s, c where s.us < c.us or (s.us = c.us and s.job_id < c.job_id))
select job_id, us, rank, n > 5 as has_more from p where rank <= 5""")
def job_page_keyset(spark, d):
    j = _jobs(spark, d).select("job_id", "us")
    cursor = j.orderBy(F.desc("us"), F.desc("job_id")).offset(4).limit(1).first()  # the caller's cursor: one row
    return jobs.keyset_page(j, "us", "job_id", (cursor.us, cursor.job_id) if cursor else None, 5)


@query("job_ttl_expired", "A18", """with e as (select *, epoch_us(ts) as us from events), l as (select user_id, max(us) as last_us, bool_or(event_type = 'purchase' and value > 200) as protected from e group by 1)
select user_id, last_us from l where last_us < (select max(us) from e) - 86400000000 and not protected""")
def job_ttl_expired(spark, d):
    e = _events(spark, d)
    now = e.agg(F.max("us")).first()[0]
    return jobs.expired(e, "user_id", F.col("us"), F.lit(now), 86_400_000_000, (F.col("event_type") == "purchase") & (F.col("value") > 200))


@query("rate_window_counts", "W13", """with e as (select *, epoch_us(ts) // 1000 as ms from events)
select event_id, user_id, count(*) over (partition by user_id order by ms range between 21599999 preceding and current row) as in_window,
  count(*) over (partition by user_id order by ms range between 21599999 preceding and current row) > 3 as over from e""")
def rate_window_counts(spark, d):
    ms = F.floor(F.col("us") / 1000)
    return jobs.window_counts(_events(spark, d), "user_id", ms, 21_600_000, 3).select("event_id", "user_id", "in_window", "over")


@query("channel_last_activity", "T13", "select user_id, max(epoch_us(ts)) as last_us, count(*)::bigint as n from events group by 1")
def channel_last_activity(spark, d):
    return _events(spark, d).groupBy("user_id").agg(F.max("us").alias("last_us"), F.count("*").alias("n"))


REPLAY = """e as (select *, epoch_us(ts) as us, event_type || ':' || event_id || ';' as text from events),
r as (select *, max(case when event_type = 'error' then us::hugeint * 100000 + event_id end) over (partition by user_id) as reset from e),
k as (select * from r where event_type <> 'error' and (reset is null or us::hugeint * 100000 + event_id > reset)),
l as (select user_id, string_agg(text, '' order by us, event_id) as log, count(*)::bigint as n from k group by 1)"""


def _log(spark, d):
    e = _events(spark, d).withColumn("text", F.concat("event_type", F.lit(":"), "event_id", F.lit(";")))
    return jobs.replay_log(e, "user_id", ["us", "event_id"], F.col("event_type") == "error", "text")


@query("replay_log_reconstructed", "T03 T04", f"with {REPLAY} select * from l")
def replay_log_reconstructed(spark, d):
    return _log(spark, d)


@query("replay_log_tail", "T04", f"with {REPLAY} select user_id, right(log, 40) as tail, length(log) > 40 as truncated from l")
def replay_log_tail(spark, d):
    tail, cut = jobs.tail_capped(F.col("log"), 40)
    return _log(spark, d).select("user_id", tail.alias("tail"), cut.alias("truncated"))


@query("log_head_truncated", "L07", """with e as (select user_id, event_id, event_type || ';' as text, epoch_us(ts) as us from events),
w as (select *, 100 - (sum(length(text)) over (partition by user_id order by us, event_id rows unbounded preceding) - length(text)) as left_ from e)
select user_id, event_id, substr(text, 1, left_::int) as text from w where left_ > 0""")
def log_head_truncated(spark, d):
    e = _events(spark, d).select("user_id", "event_id", F.concat("event_type", F.lit(";")).alias("text"), "us")
    return jobs.head_capped(e, "user_id", ["us", "event_id"], "text", 100).select("user_id", "event_id", "text")


@query("lru_prune", "L04", """with l as (select user_id, max(epoch_us(ts)) as us from events group by 1), r as (select *, row_number() over (order by us desc, user_id desc) as k from l where user_id <> 7)
select user_id, us from r where k <= 24 union all select user_id, us from l where user_id = 7""")
def lru_prune(spark, d):
    last = _events(spark, d).groupBy("user_id").agg(F.max("us").alias("us"))
    kept = last.where("user_id <> 7").orderBy(F.desc("us"), F.desc("user_id")).limit(24)
    return kept.unionByName(last.where("user_id = 7"))


@query("notes_dedupe_last_n", "L03", """with n as (select user_id, event_type as kind, floor(value)::bigint % 10 as page, event_id, epoch_us(ts) as us from events),
o as (select *, row_number() over (partition by user_id, kind, page order by us desc, event_id desc) as r from n), p as (select *, row_number() over (partition by user_id order by us desc, event_id desc) as k from o where r = 1)
select user_id, kind, page, event_id from p where k <= 5""")
def notes_dedupe_last_n(spark, d):
    n = _events(spark, d).select("user_id", F.col("event_type").alias("kind"), (F.floor("value").cast("long") % 10).alias("page"), "event_id", "us")
    return jobs.keep_last(n, ["user_id", "kind", "page"], ["us", "event_id"], 5, "user_id").select("user_id", "kind", "page", "event_id")


@query("notes_markdown", "K10", """with n as (select user_id, event_type as kind, event_id, epoch_us(ts) as us from events where event_type in ('click', 'view'))
select user_id, kind, string_agg('- ' || event_id, chr(10) order by us, event_id) as body, count(*)::bigint as n from n group by 1, 2""")
def notes_markdown(spark, d):
    n = _events(spark, d).where(F.col("event_type").isin("click", "view"))
    g = n.groupBy("user_id", F.col("event_type").alias("kind")).agg(F.array_sort(F.collect_list(F.struct("us", "event_id"))).alias("x"))
    return g.select("user_id", "kind", F.array_join(F.transform("x", lambda s: F.concat(F.lit("- "), s["event_id"])), "\n").alias("body"), F.size("x").cast("long").alias("n"))


@query("stale_running_jobs", "M25", f"""with {JOBS}, live as (select distinct user_id as job_id from events where event_id % 5 = 0 and event_type = 'view')
select job_id, case when status = 'running' and job_id not in (select job_id from live) then 'error' else status end as status from s""")
def stale_running_jobs(spark, d):
    live = table(spark, d, "events").where("event_id % 5 = 0 and event_type = 'view'").select(F.col("user_id").alias("job_id")).distinct().withColumn("live", F.lit(True))
    j = _jobs(spark, d).select("job_id", "status").join(live, "job_id", "left")
    return j.select("job_id", F.when((F.col("status") == "running") & F.col("live").isNull(), "error").otherwise(F.col("status")).alias("status"))


@query("weighted_median_price", "A05 X09", """with v as (select l_returnflag, l_extendedprice, sum(l_quantity) as w from lineitem group by 1, 2),
c as (select *, sum(w) over (partition by l_returnflag order by l_extendedprice rows unbounded preceding) as c, sum(w) over (partition by l_returnflag) as t from v)
select l_returnflag, min(l_extendedprice) as median from c where c * 2 >= t group by 1""")
def weighted_median_price(spark, d):
    return jobs.weighted_median(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")


@query("judge_scores", "A13", """with s as (select source, (quality * 3 + toxic + doc_id % 2 + 1)::bigint as score, doc_id % 11 = 0 as failed from labels join documents using (doc_id))
select source, round(avg(case when not failed and score between 1 and 5 then score end), 2) as mean, count(*) filter (failed)::bigint as failures, count(*) filter (not failed and score > 4)::bigint as top from s group by 1""")
def judge_scores(spark, d):
    s = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("source", (F.col("quality") * 3 + F.col("toxic") + F.col("doc_id") % 2 + 1).alias("score"), (F.col("doc_id") % 11 == 0).alias("failed"))
    ok = ~F.col("failed")
    return s.groupBy("source").agg(F.round(F.avg(F.when(ok & F.col("score").between(1, 5), F.col("score"))), 2).alias("mean"), F.count_if("failed").alias("failures"), F.count_if(ok & (F.col("score") > 4)).alias("top"))


@query("judge_sample", "L02", """with l as (select source, doc_id, row_number() over (partition by source order by length(text) desc, doc_id) as r, md5('7:' || doc_id) as h from documents),
k as (select *, row_number() over (partition by source, r <= 4 order by h, doc_id) as s from l)
select source, doc_id, case when r <= 4 then 'longest' else 'drawn' end as part from k where r <= 4 or s <= 6""")
def judge_sample(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.length("text").alias("n"), F.md5(F.concat(F.lit("7:"), "doc_id").cast("binary")).alias("h"))
    return evaluate.judge_sample(docs, "source", "doc_id", "n", "h", 4, 6)


@query("reason_report", "A16", """with p as (select event_type as reason, (user_id % 50)::bigint as page from events), g as (select reason, page, count(*) as n from p group by 1, 2), r as (select *, row_number() over (partition by reason order by page) as k from g)
select reason, sum(n)::bigint as n, count(*)::bigint as pages, string_agg(page::varchar, ',' order by page) filter (k <= 5) as first_pages from r group by 1""")
def reason_report(spark, d):
    return jobs.reason_report(table(spark, d, "events").select(F.col("event_type").alias("reason"), (F.col("user_id") % 50).alias("page")), "reason", "page")


@query("warning_summary", "A17 L06", """with c as (select event_type || ':' || user_id % 7 as message, count(*)::bigint as n from events where event_type in ('error', 'view') group by 1)
select message, n, (select greatest(count(*) - 3, 0) from c)::bigint as more from c order by n desc, message limit 3""")
def warning_summary(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("error", "view")).select(F.concat("event_type", F.lit(":"), F.col("user_id") % 7).alias("message"))
    return jobs.top_messages(e, "message")


@query("artifact_revision", "C08", """select doc_id // 20 as job, substr(sha256(string_agg(doc_id || ':' || n_chars || ':' || lang, chr(10) order by doc_id)), 1, 20) as revision from documents group by 1""")
def artifact_revision(spark, d):
    files = table(spark, d, "documents").withColumn("job", F.floor(F.col("doc_id") / 20))
    return jobs.revision(files, "job", F.concat_ws(":", "doc_id", "n_chars", "lang"), "doc_id")


@query("bench_timings", "A22", """with e as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) as run from events)
select user_id, median(value) filter (run between 2 and 4) as seconds, count(*) filter (run between 2 and 4)::bigint as runs from e group by 1""")
def bench_timings(spark, d):
    e = table(spark, d, "events").withColumn("run", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    timed = F.col("run").between(2, 4)
    return e.groupBy("user_id").agg(F.median(F.when(timed, F.col("value"))).alias("seconds"), F.count_if(timed).alias("runs"))


@query("reader_position", "W14", f"""with {LINES}, b as (select doc_id, page, length(line) + 1 as h, sum(length(line) + 1) over (partition by doc_id order by page) - (length(line) + 1) as top from lines),
a as (select distinct doc_id, unnest([0, 100, 750, doc_id * 3 % 2000])::bigint as offset_ from documents)
select doc_id, offset_ as asked, arg_max(page, top) as band, round(least(1.0, (offset_ - max(top)) / arg_max(h, top)), 6) as fraction from a join b using (doc_id) where top <= offset_ group by 1, 2""")
def reader_position(spark, d):
    h = pages.explode_pages(table(spark, d, "documents")).withColumn("h", (F.length("line") + 1).cast("long"))
    asked = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(100).cast("long"), F.lit(750).cast("long"), F.col("doc_id") * 3 % 2000)).alias("asked")).distinct()
    return jobs.position_lookup(h, asked, "doc_id", "page", "h", "asked")


@query("hydration_batches", "W15", f"""with {LINES}, m as (select doc_id, page, page - row_number() over (partition by doc_id order by page) as island from lines where (doc_id + page) % 7 <> 0),
k as (select *, (row_number() over (partition by doc_id, island order by page) - 1) // 4 as k from m) select doc_id, min(page) as first, max(page) as last from k group by doc_id, island, k""")
def hydration_batches(spark, d):
    return jobs.missing_batches(pages.explode_pages(table(spark, d, "documents")), "doc_id", "page", (F.col("doc_id") + F.col("page")) % 7 == 0, 4)


@query("distinct_page_numbers", "L11 J20", f"with {LINES} select page, count(distinct doc_id)::bigint as docs from (select doc_id, page from lines union all select doc_id, page from lines where page % 2 = 0) group by 1")
def distinct_page_numbers(spark, d):
    p = pages.explode_pages(table(spark, d, "documents")).select("doc_id", "page")
    both = p.unionByName(p.where("page % 2 = 0")).dropDuplicates(["doc_id", "page"])
    return both.groupBy("page").agg(F.count("*").alias("docs"))


@query("drawable_characters", "M18", """select ascii(c)::bigint as code, c as ch from (select distinct unnest(string_split(text, '')) as c from documents) where c <> ''""")
def drawable_characters(spark, d):
    from leafmill.functions.text import chars

    each = table(spark, d, "documents").select(F.explode(F.array_distinct(chars(F.col("text")))).alias("ch")).distinct()
    return each.select(F.expr("ascii(ch)").cast("long").alias("code"), "ch")


@query("message_reasons", "", """select conv_id, turn, case when contains(lower(text), 'timeout') then 'timeout' when regexp_matches(text, '\\d{3}') then 'status' when text = '' then 'empty' when length(text) > 400 then 'too-long' else 'other' end as reason,
  len(regexp_extract_all(text, '\\d+'))::bigint as numbers from conversations""")
def message_reasons(spark, d):
    t = F.col("text")
    reason = F.when(F.contains(F.lower(t), F.lit("timeout")), "timeout").when(t.rlike(r"\d{3}"), "status").when(t == "", "empty").when(F.length(t) > 400, "too-long").otherwise("other")
    return table(spark, d, "conversations").select("conv_id", "turn", reason.alias("reason"), F.regexp_count(t, F.lit(r"\d+")).cast("long").alias("numbers"))


@query("cer_conversations", "A04 X05", r"""with f as (select conv_id, turn, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') as text from conversations), p as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as prev from f)
select conv_id, turn, levenshtein(text, prev)::bigint as distance, case when length(prev) > 0 then round(levenshtein(text, prev) / length(prev), 6) end as cer from p where prev is not null""")
def cer_conversations(spark, d):
    """Each message against the one before, characters beyond ASCII taken alike (the twin counts bytes)."""
    flat = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("text"))
    p = flat.withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("prev is not null")
    return p.select("conv_id", "turn", F.levenshtein("text", "prev").cast("long").alias("distance"), evaluate.cer(F.col("text"), F.col("prev")).alias("cer"))


@query("json_props", "P24 X11", """select event_id, json_extract_string(props, '$.k')::bigint as k, case when user_id % 5 = 0 then null else event_type end as kind from events""")
def json_props(spark, d):
    raw = F.when(F.col("user_id") % 5 == 0, "noise").otherwise(F.concat(F.lit("```json\n{\"kind\": \""), "event_type", F.lit("\"}\n```")))
    kind = F.get_json_object(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), "$.kind")
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), kind.alias("kind"))


@query("url_parts", "F17 X13", r"""select page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') as query,
  starts_with(url, 'https://') and regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) in ('therst.example.net', 'ththou.example.com', 'thered.example.org') as allowed from pages""")
def url_parts(spark, d):
    host = F.parse_url(F.col("url"), F.lit("HOST"))
    ok = (F.parse_url(F.col("url"), F.lit("PROTOCOL")) == "https") & host.isin("therst.example.net", "ththou.example.com", "thered.example.org")
    return table(spark, d, "pages").select("page_id", host.alias("host"), F.coalesce(F.parse_url(F.col("url"), F.lit("PATH")), F.lit("")).alias("path"), F.parse_url(F.col("url"), F.lit("QUERY")).alias("query"), ok.alias("allowed"))


@query("html_fragments", "V05 X12", r"""select page_id, len(regexp_extract_all(html, '<p[^>]*>[^<]*'))::bigint as paragraphs, regexp_extract(html, '<title>([^<]*)</title>', 1) as title,
  length(regexp_replace(html, '<[^>]*>', '', 'g'))::bigint as text_chars from pages""")
def html_fragments(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.regexp_count("html", F.lit("<p[^>]*>[^<]*")).cast("long").alias("paragraphs"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("text_chars"),
    )
