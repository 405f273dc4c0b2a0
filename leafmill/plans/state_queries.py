"""Queries over states, reports, errors and the placed HTML of layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import control, evaluate, jobs, layout, pages, units
from leafmill.plans.layout_queries import B, _blocks
from leafmill.plans.page_queries import LINES
from leafmill.plans.registry import query, table


@query("cache_reconstruction", "J19", f"""with {LINES}, u as (select 'md:' || doc_id || ':' || page as unit_id, sha256(line || chr(31) || 'model') as key, trim(line) = '' as skip, page from lines), c as (select distinct key from u where substr(key, 1, 1) in ('0', '2', '4', '6', '8')),
s as (select case when skip then 'skipped' when key in (select key from c) then 'found' when page % 3 = 0 then 'kept' else 'unverified' end as state from u) select state, count(*)::bigint as n from s group by 1""")
def cache_reconstruction(spark, d):
    """How each unit's translation is found again: skipped, in the cache, kept by the report, or unverified."""
    u = pages.explode_pages(table(spark, d, "documents")).select(F.concat_ws(":", F.lit("md"), "doc_id", "page").alias("unit_id"), units.cache_key(F.col("line"), F.lit("model")).alias("key"), (F.trim("line") == "").alias("skip"), "page")
    found = units.reconstructed(u, u.where(F.substring("key", 1, 1).isin("0", "2", "4", "6", "8")), u.where("page % 3 = 0"))
    return found.groupBy("state").agg(F.count("*").alias("n"))


@query("job_claims", "C09", """with a as (select event_id, user_id, epoch_us(ts) as us, case event_type when 'click' then 'claim' when 'error' then 'cancel' else 'other' end as what, user_id % 4 <> 0 as waiting from events where event_type in ('click', 'error')),
r as (select *, row_number() over (partition by user_id order by us, event_id) as k from a) select event_id, user_id as job, what, waiting and k = 1 as won, case when waiting and k = 1 then case what when 'claim' then 'running' else 'canceled' end end as state from r""")
def job_claims(spark, d):
    """Attempts to claim or to cancel jobs: of a waiting job one attempt succeeds."""
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    a = table(spark, d, "events").where(F.col("event_type").isin("click", "error")).select("event_id", F.col("user_id").alias("job"), us.alias("us"), F.when(F.col("event_type") == "click", "claim").otherwise("cancel").alias("what"), (F.col("user_id") % 4 != 0).alias("waiting"))
    won = jobs.first_attempts(a, "job", ["us", "event_id"])
    return won.select("event_id", "job", "what", "won", F.when(F.col("won"), F.when(F.col("what") == "claim", "running").otherwise("canceled")).alias("state"))


@query("kept_summaries", "A21", """with c as (select user_id, event_type as reason, count(*)::bigint - 12 as n from events group by 1, 2), k as (select user_id, coalesce(string_agg(reason || ' ' || n, ' · ' order by n desc, reason) filter (n > 0 and reason < 'l'), '') as kept_why, coalesce(sum(n) filter (n > 0 and reason < 'l'), 0)::bigint as kept,
  greatest(user_id % 3, coalesce(sum(n) filter (n > 0 and reason >= 'l'), 0))::bigint as skipped from c group by 1)
select user_id, kept_why, kept, skipped, case when kept > 0 and skipped > 0 then '원문 유지 ' || kept || ' · 건너뜀 ' || skipped when kept > 0 then '원문 유지 ' || kept when skipped > 0 then '건너뜀 ' || skipped else '전부 번역됨' end as line from k""")
def kept_summaries(spark, d):
    """Reasons as sorted pairs with totals, from maps of counts that may be under one."""
    c = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("reason")).agg((F.count("*") - 12).alias("n"))
    part = lambda late: F.map_from_entries(F.filter(F.collect_list(F.struct("reason", "n")), lambda s: (s["reason"] >= "l") == late))
    m = c.groupBy("user_id").agg(part(False).alias("k"), part(True).alias("s")).select("user_id", evaluate.reason_pairs(F.col("k")).alias("kp"), evaluate.reason_pairs(F.col("s")).alias("sp"))
    t = m.select("user_id", F.array_join(F.transform("kp", lambda p: F.concat(p["reason"], F.lit(" "), p["n"])), " · ").alias("kept_why"), evaluate.reason_total(F.col("kp"), F.lit(None).cast("long")).alias("kept"), evaluate.reason_total(F.col("sp"), F.col("user_id") % 3).alias("skipped"))
    return t.withColumn("line", evaluate.kept_summary(F.col("kept"), F.col("skipped")))


# Bodies of errors, and what they say: temperature, reasoning, input list, policy.
BODIES = (
    ('{"error": {"param": "temperature", "code": "unsupported_value", "message": "no"}}', "1000"), ('{"error": {"message": "This model does not support the parameter \'temperature\' as reasoning is active"}}', "1100"),
    ('{"message": "temperature must be 1"}', "0000"), ("plain: Unsupported parameter: temperature", "1000"), ('{"error": {"detail": "Input must be a list"}}', "0010"), ('{"error": {"code": "content_filter", "message": "x"}}', "0001"),
    ('{"type": "ContentPolicyViolationError", "message": "y"}', "0001"), ("", "0000"), ('{"error": "busy"}', "0000"),
)


@query("error_classes", "F16", "select event_id, case event_id % 9 " + " ".join(f"when {k} then '{want}'" for k, (_, want) in enumerate(BODIES)) + " end as found, case event_id % 4 when 0 then 503 when 1 then event_id::int end as status from events")
def error_classes(spark, d):
    body = F.element_at(F.array(*(F.lit(b) for b, _ in BODIES)), (F.col("event_id") % len(BODIES) + 1).cast("int"))
    status = F.when(F.col("event_id") % 4 == 0, " 503 ").when(F.col("event_id") % 4 == 1, F.col("event_id").cast("string")).when(F.col("event_id") % 4 == 2, "5x").otherwise("")
    e = table(spark, d, "events").select("event_id", control.error_classes(body).alias("c"), control.status_code(status).alias("status"))
    return e.select("event_id", F.concat(*(F.col(f"c.{n}").cast("int").cast("string") for n in ("temperature", "reasoning", "input_list", "policy"))).alias("found"), "status")


@query("record_dates", "X14", """select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' as iso, case when event_id % 5 = 0 then 0 else epoch_us(ts) // 1000000 * 1000000000 end::bigint as created, date_diff('day', date '2024-01-01', ts::date)::bigint as day from events""")
def record_dates(spark, d):
    """Times as job records write them, read back into the order of creation; every fifth record has no date."""
    at = F.col("ts").cast("timestamp")
    e = table(spark, d, "events").select("event_id", jobs.iso(at).alias("iso"), F.date_diff(at.cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("day"))
    return e.select("event_id", "iso", jobs.created_order(F.when(F.col("event_id") % 5 == 0, "not a date").otherwise(F.col("iso"))).alias("created"), "day")


@query("layout_html", "K08", f"""with {B}, c as (select *, least(greatest(x0, 0), 999) as a0, least(greatest(y0, 0), 999) as b0, least(greatest(x1, 0), 999) as a1, least(greatest(y1, 0), 999) as b1, case when idx % 7 = 3 then 'unreadable' when idx % 5 = 4 then 'b<d' else type end as kind, content || ' <&>' as t, case when idx % 2 = 0 then x0 / 100.0 end as fs from b),
s as (select *, 'left:' || printf('%.2f', a0 / 999.0 * 100) || '%;top:' || printf('%.2f', b0 / 999.0 * 100) || '%;width:' || printf('%.2f', greatest(a1 - a0, 4) / 999.0 * 100) || '%;height:' || printf('%.2f', greatest(b1 - b0, 4) / 999.0 * 100) || '%;' as style from c where kind <> 'unreadable')
select page, idx, case when type = 'image' then '<img class="layout-block layout-image" src="images/a.png" style="' || style || '" alt="">' else '<div class="layout-block layout-' || case kind when 'b<d' then 'text' else kind end
  || case when fs is null and (b1 - b0) * 1.414 >= 6 * (a1 - a0) and a1 > a0 and length(t) >= 12 then ' layout-vertical-up' else '' end || '" style="' || style || case when fs is not null then 'font-size:' || printf('%.2f', greatest(0.6, least(6.0, fs))) || 'cqw;line-height:1.22;' else '' end
  || '" title="' || case kind when 'b<d' then 'text' else kind end || '">' || replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</div>' end as html from s""")
def layout_html(spark, d):
    kind = F.when(F.col("idx") % 7 == 3, "unreadable").when(F.col("idx") % 5 == 4, "b<d").otherwise(F.col("type"))
    b = _blocks(spark, d).withColumns({"image": F.when(F.col("type") == "image", "a.png"), "content": F.concat("content", F.lit(" <&>")), "fs": F.when(F.col("idx") % 2 == 0, F.col("x0") / 100), "type": kind})
    return b.select("page", "idx", layout.block_html().alias("html")).where("html is not null")
