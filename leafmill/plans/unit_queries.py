"""Queries over units: gates, repetition, glossary, coverage, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import gates, glossary, overlap, pages, repetition, units
from leafmill.plans.page_queries import LINES
from leafmill.plans.registry import query, table
from leafmill.session import spread


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return pages.explode_pages(_docs(spark, d))


# Every seventh line is replaced by a specimen of a rare class, in both engines.
SPECIMENS = ("", "[1] A. Author, Title. [2] B", "[3] C. Author, Proc. 2019, vol. 3, doi:10.1/x", "한국어 문장 입니다", "2401.12345v2", "+ - = 12 %", "arXiv:2401.12345")
SPECIMEN_SQL = "case (doc_id + page) % 49 " + " ".join(f"when {7 * k} then '{x}'" for k, x in enumerate(SPECIMENS)) + " else line end"


def specimen() -> F.Column:
    k = (F.col("doc_id") + F.col("page")) % 49
    out = F.when(k == 0, SPECIMENS[0])
    for n, x in enumerate(SPECIMENS[1:], 1):
        out = out.when(k == 7 * n, x)
    return out.otherwise(F.col("line"))


def quoted(x: str) -> str:
    """A text as an SQL literal."""
    return "'" + x.replace("'", "''") + "'"


def has(c: str, pattern: str) -> str:
    """SQL: whether the pattern is found; classes by code point are spelt as DuckDB reads them."""
    return f"regexp_matches({c}, {quoted(pattern)})"


def count_of(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {quoted(pattern)}))"


@query("skip_reason_counts", "F01 F02 A10", f"""
with {LINES}, u as (select doc_id, {SPECIMEN_SQL} as t from lines), b as (select t, regexp_replace(regexp_replace(t, '^\\s+', ''), '\\s+$', '') as s from u),
r as (select case when s = '' then 'non-linguistic'
  when {has('t', gates.REFERENCE_LINE)} and {has('t', gates.BIBLIOGRAPHY)} then 'references'
  when {count_of('t', gates.HANGUL)} * 2 > {count_of('t', r'[^ \t\n\v\f\r]')} then 'already-korean'
  when {has('s', gates.ARXIV)} then 'identifier'
  when not regexp_matches(t, '[A-Za-z]{{2}}') or {count_of('t', '[A-Za-z]')} * 10 < {count_of('t', r'[^ \t\n\v\f\r]')} * 3 then 'non-linguistic' else '' end as reason from b)
select reason, count(*)::bigint as n from r group by 1""")
def skip_reason_counts(spark, d):
    u = _lines(spark, d).select(gates.skip_reason(specimen(), with_code=False).alias("reason"))
    return u.groupBy("reason").agg(F.count("*").alias("n"))


# Every line, and behind each document a listing, a transcript, a list of names or a sentence behind a prompt.
TAILS = ("def f(x):\n  return x;\n", "$ ls -l\n-rw-r--r-- 1 a b\nfoo.c: No such file", "a, b_c, d.e, f, g, h, i1, j", "$ Since there are no other ways to do this we build it here.", '"key": {\n}\n"b": 1', "x == y && f(x)", "let z = 3\nThe rest of this is what they had.")
TAIL_SQL = "case doc_id % 8 " + " ".join(f"when {k} then {quoted(x)}" for k, x in enumerate(TAILS)) + " else text end"
SIGNS_SQL = " + ".join(f"{has('x', p)}::int" for p in gates.CODE_SIGNS)
CODE_SQL = f"({has('x', gates.CODE_SURE)} or (not {has('x', gates.SENTENCE_END)} and ({has('x', gates.DECLARATION)} or {has('x', gates.ASSIGNMENT)} or {SIGNS_SQL} >= 2)))"


@query("code_like_units", "F03 F15", rf"""
with t as (select doc_id, {TAIL_SQL} as t from documents), ls as (select doc_id, t, list_filter([regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '') for x in string_split(t, chr(10))], lambda x: x <> '') as l,
  list_filter([trim(x) for x in string_split(replace(t, chr(10), ' '), ',')], lambda x: x <> '') as p from t),
e as (select doc_id, unnest(l) as x from ls), f as (select *, regexp_replace(x, {quoted(gates.PROMPT_MARK)}, '') as body from e), w as (select *, regexp_extract_all(lower(body), {quoted(gates.PROSE_WORD)}) as words from f),
j as (select doc_id, {CODE_SQL} as code, not {has('x', gates.LISTING)} and len(words) >= 6 and len(list_filter(words, lambda v: v in ({', '.join(map(quoted, gates.PROSE_WORDS))}))) >= 2 and not {has('body', gates.DECLARATION)} and not regexp_matches(body, ';\s*$')
  and {count_of('body', r'[^\p{L}\p{N}_\s]')} * 100 < length(body) * 18 as prose from w),
g as (select doc_id, count(*) filter (code) * 2 > count(*) and count(*) filter (prose) = 0 as code from j group by 1)
select doc_id, case when {has('t', gates.HANGUL)} then '' when len(p) >= 8 and len(list_filter(p, lambda v: regexp_matches(v, {quoted(gates.IDENTIFIER)}))) * 10 >= len(p) * 9 then 'identifier-list' when coalesce(code, false) then 'code' else '' end as reason,
  regexp_matches(t, '[.!?]\s+\S') or len(regexp_extract_all(t, '</tr>')) > 1 as splittable from ls left join g using (doc_id)""")
def code_like_units(spark, d):
    k = F.col("doc_id") % 8
    t = F.when(k == 0, TAILS[0])
    for n, x in enumerate(TAILS[1:], 1):
        t = t.when(k == n, x)
    return _docs(spark, d).withColumn("t", t.otherwise(F.col("text"))).select("doc_id", gates.code_reason(F.col("t")).alias("reason"), gates.splittable(F.col("t")).alias("splittable"))


OUTPUTS = ("text", "'Source: ' || text", "'I am unable to do that'", "'한국어 번역 문장 입니다 그리고 더' || chr(10) || text", "'가나다 라마 바사 ' || length(text) || ' 아자차'", "'번역할 수 없습니다'", "upper(text)", "'번역 ' || left(text, (length(text) / 2)::int) || ' 이다'", "'요약입니다.'", "repeat(text || ' 그리고 다른 문장 ', 4)")


@query("output_gate_reasons", "F04 F05 A11", rf"""
with u as (select conv_id, turn, case turn % 3 when 0 then left(text, 9) when 1 then text || ' about translation 2024' else text end as text from conversations),
o as (select conv_id, turn, text as src, case (conv_id + turn) % {len(OUTPUTS)} {' '.join(f'when {k} then {x}' for k, x in enumerate(OUTPUTS))} end as o from u),
b as (select *, regexp_extract_all(lower(src), '[a-z]{{2,}}') as sw, list_distinct(regexp_extract_all(lower(o), '[a-z]{{2,}}')) as ow, {count_of('o', gates.HANGUL)} as own, {count_of('o', r'[^ \t\n\v\f\r]')} as dense, regexp_extract_all(src, '\d{{4,}}') as nums,
  ' ' || array_to_string([case when regexp_matches(x, {quoted(gates.HANGUL)}) then '|' else lower(x) end for x in regexp_extract_all(o, {quoted('[A-Za-z]{2,}|' + gates.HANGUL + '+')})], ' ') || ' ' as body from o),
m as (select *, greatest(8, (len(sw) * 4 + 4) // 5) as need, case when dense > 0 then own / dense else 1 end as share, case when len(sw) > 0 then len(list_filter(sw, lambda x: list_contains(ow, x))) / len(sw) end as kept from b)
select conv_id, turn, case when {has('o', gates.SCAFFOLD)} and not {has('src', gates.SCAFFOLD)} then 'scaffold'
  when {has('o', gates.REFUSAL)} and not {has('src', gates.REFUSAL)} and (not regexp_matches(src, '(?i)translat') or regexp_matches(regexp_replace(o, {quoted(gates.KO_NEGATION)}, ' ', 'g'), {quoted(gates.REFUSAL)})) then 'refusal'
  when len(sw) <= 2 and not regexp_matches(src, '[.!?:;]\s*$') and {has('o', gates.POLITE_END)} then 'label-sentence'
  when len(sw) < 2 then case when length(o) > greatest(40, 6 * length(src)) then 'length-ratio' else '' end
  when length(src) <= 80 and len(nums) > 0 and len(list_filter(nums, lambda x: contains(regexp_replace(o, '[,\s]', '', 'g'), x))) = 0 then 'number-mismatch'
  when share < 0.15 and (share < 0.05 or kept >= 0.9) then 'hangul-ratio'
  when len(sw) >= 8 and len(list_filter(range(1, (len(sw) - need + 2)::bigint), lambda k: contains(body, ' ' || array_to_string(sw[k:k + need - 1], ' ') || ' '))) > 0 then 'echo'
  when length(o) < case when length(src) <= 80 then 0.12 else 0.25 end * length(src) or length(o) > 3 * length(src) then 'length-ratio' else '' end as reason from m""")
def output_gate_reasons(spark, d):
    """Gates over messages, shortened or lengthened by turn, and derived outputs; repetition has a query of its own."""
    table(spark, d, "conversations").createOrReplaceTempView("_leafmill_conversations")
    outputs = " ".join(f"when {k} then {x}" for k, x in enumerate(OUTPUTS))
    # SQL's cast takes halves to even numbers; its capitals are letter by letter, a ligature has none.
    capitals = "array_join(transform(split(text, ''), c -> if(length(upper(c)) > 1, c, upper(c))), '')"
    for sql, own in {"chr(10)": "char(10)", "(length(text) / 2)::int": "cast(bround(length(text) / 2) as int)", "upper(text)": capitals}.items():
        outputs = outputs.replace(sql, own)
    u = spark.sql("select conv_id, turn, case turn % 3 when 0 then left(text, 9) when 1 then text || ' about translation 2024' else text end as text from _leafmill_conversations")
    o = u.withColumn("o", F.expr(f"case (conv_id + turn) % {len(OUTPUTS)} {outputs} end"))
    return o.select("conv_id", "turn", gates.output_reason(F.col("text"), F.col("o"), with_repetition=False).alias("reason"))


@query("degenerate_repetition", "F06 W06")
def degenerate_repetition(spark, d):
    """(doc_id, longest, degenerate) over all lines; back-references have no SQL twin."""
    x = _lines(spark, d).select("doc_id", "page", gates.longest_repetition(F.col("line")).alias("r"), gates.is_degenerate(F.col("line"), F.lit("")).alias("g"))
    return x.groupBy("doc_id").agg(F.max("r").cast("long").alias("longest"), F.bool_or("g").alias("degenerate"))


@query("benchmark_contamination_echo", "F07", r"""
with i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from benchmark),
j as (select item_id, w, greatest(8, ceil(0.8 * len(w)))::int as n from i),
g as (select item_id, unnest([' ' || array_to_string(w[k:k + n - 1], ' ') || ' ' for k in range(1, len(w) - n + 2)]) as run from j where len(w) >= n),
t as (select doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' as body from documents)
select distinct doc_id, item_id from t join g on contains(body, run)""")
def benchmark_contamination_echo(spark, d):
    return overlap.echoed_items(_docs(spark, d).select("doc_id", "text"), table(spark, d, "benchmark"))


@query("repeated_line_runs", "W04", f"""
with {LINES},
s as (select doc_id, page, case when len(regexp_extract_all(line, '\\d+')) <= 2 and length(line) >= 24 and length(line) - length(regexp_replace(line, '\\p{{L}}', '', 'g')) >= 8 then regexp_replace(line, '\\d+', '<n>', 'g') end as template from lines where trim(line) <> ''),
w as (select *, row_number() over (partition by doc_id order by page) - row_number() over (partition by doc_id, template order by page) as island from s)
select doc_id, template, min(page) as first_page, count(*)::bigint as run from w where template is not null group by doc_id, template, island having count(*) >= 2""")
def repeated_line_runs(spark, d):
    return repetition.template_runs(_lines(spark, d), 2)


@query("counter_loops", "W05", r"""
with t as (select doc_id, text || ' ' || array_to_string(['# ' || case when doc_id % 3 = 0 and k = 11 then 3 else k + doc_id % 4 end || '. x' for k in range(1, 15 + doc_id % 20)], ' ') as t from documents),
n as (select doc_id, unnest(l)::bigint as n, generate_subscripts(l, 1) as i from (select doc_id, regexp_extract_all(t, '#\s*(\d{1,9})\.', 1) as l from t)),
g as (select doc_id, i, n, sum(case when n = p + 1 then 0 else 1 end) over (partition by doc_id order by i) as g from (select *, lag(n) over (partition by doc_id order by i) as p from n)),
c as (select doc_id, g, count(*) as run from g group by 1, 2), b as (select doc_id, max(run) as run from c group by 1)
select doc_id, case when run >= 20 then run else 0 end::bigint as run from b""")
def counter_loops(spark, d):
    k = F.col("doc_id") % 4
    t = F.transform(F.sequence(F.lit(1).cast("long"), 14 + F.col("doc_id") % 20), lambda i: F.concat(F.lit("# "), F.when((F.col("doc_id") % 3 == 0) & (i == 11), F.lit(3).cast("long")).otherwise(i + k), F.lit(". x")))
    return _docs(spark, d).select("doc_id", repetition.counter_runs(F.concat("text", F.lit(" "), F.array_join(t, " ")), 20).alias("run"))


@query("ngram_ban_words", "G04 X10", r"""
with w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as a from documents), r as (select doc_id, a[greatest(len(a) - 199, 1):] as a from w),
x as (select doc_id, a, a[len(a):] as prefix from r)
select doc_id, array_to_string(list_sort(list_distinct([a[i + 1] for i in range(1, len(a)) if a[i] = prefix[1]])), ' ') as banned from x""")
def ngram_ban_words(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(repetition.banned_followers(T.words_of(F.col("text")), 2, 200), " ").alias("banned"))


@query("glossary_candidates", "A07", r"""
with t as (select unnest(list_concat(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){0,2})', 1), regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_-])(\p{Ll}{2,}(?:-\p{Ll}{2,})+)', 1))) as term from documents)
select term, count(*)::bigint as freq from t where lower(term) not in ('the','and','for','with','this','that','from','are','was','were','not','but','all','can','has','have','its','our','their','these','those','table','figure')
group by 1 having count(*) >= 3 order by freq desc, term limit 80""")
def glossary_candidates(spark, d):
    return glossary.candidates(_docs(spark, d))


@query("acronym_terms", "F12 L09", r"""
with t as (select unnest(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^[A-Z]{2,8}s?$'))) as term from documents), a as (select term, count(*) as freq from t group by 1 having count(*) >= 2 and (contains(term, ' ') or regexp_matches(term, '[A-Z].*[A-Z]'))),
e as (select term, 'D' as policy, 0 as prio from (values ('the'), ('and'), ('der'), ('of the'), ('in'), ('GNU')) v(term) union all select term, 'A', 1 from a),
r as (select *, row_number() over (partition by lower(term) order by prio, term) as k from e)
select term, policy, prio from r where k = 1""")
def acronym_terms(spark, d):
    seed = spark.sql("select term, 'D' as policy from values ('the'), ('and'), ('der'), ('of the'), ('in'), ('GNU') as v(term)")
    return glossary.merged([seed, glossary.acronyms(_docs(spark, d)).select("term", F.lit("A").alias("policy"))])


TERMS = "('the', 'A'), ('and', 'A'), ('of the', 'D'), ('der', 'A'), ('in', 'B'), ('les', 'A'), ('on the', 'D'), ('para', 'C'), ('nowhere at all', 'A')"
MATCHES = f"""with {LINES}, g as (select * from (values {TERMS}) v(term, policy)),
u as (select 'md:' || doc_id || ':' || page as unit_id, doc_id * 100000 + page as ord, line as src, ' ' || array_to_string(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' as body from lines),
m as (select u.*, term, policy from u join g on contains(body, ' ' || term || ' '))"""


def _matches(spark, d):
    seed = spark.sql(f"select * from values {TERMS} as v(term, policy)")
    u = _lines(spark, d).select(F.concat_ws(":", F.lit("md"), "doc_id", "page").alias("unit_id"), (F.col("doc_id") * 100000 + F.col("page")).alias("ord"), F.col("line").alias("src"))
    return glossary.matches(u, seed)


@query("glossary_unit_terms", "J05", MATCHES + """
select unit_id, count(distinct term)::bigint as n_terms, coalesce(array_to_string(list_sort(list(distinct term) filter (policy = 'A'))[1:12], '|'), '') as keep from m group by 1""")
def glossary_unit_terms(spark, d):
    return glossary.unit_terms(_matches(spark, d))


@query("term_first_unit", "A08", MATCHES + " select term, arg_min(unit_id, ord) as first_unit from m group by 1")
def term_first_unit(spark, d):
    return glossary.first_units(_matches(spark, d), "ord")


@query("glossary_violations", "A12", MATCHES + """
select term, policy, count(*)::bigint as violations from m where policy <> 'A' and not contains(upper(src), upper(term) || ' TH') group by 1, 2""")
def glossary_violations(spark, d):
    m = _matches(spark, d).where("policy <> 'A' and not contains(upper(src), concat(upper(term), ' TH'))")
    return m.groupBy("term", "policy").agg(F.count("*").alias("violations"))


@query("shouty_lines_dropped", "P22", r"""
with l as (select doc_id, string_split(text, chr(10)) as l from documents)
select doc_id, array_to_string(list_filter(l, lambda x: not (len(regexp_extract_all(x, '[A-Za-z]+')) >= 2 and len(regexp_extract_all(x, '[A-Z]')) * 10 > len(regexp_extract_all(x, '[A-Za-z]')) * 7)), chr(10)) as kept,
  regexp_replace(lower(regexp_extract(l[1], '[A-Za-z]+')), '(?:ing|ed|es|s)$', '') as stem from l""")
def shouty_lines_dropped(spark, d):
    first = F.regexp_extract(F.get(T.lines(F.col("text")), F.lit(0)), "[A-Za-z]+", 0)
    return _docs(spark, d).select("doc_id", gates.shouty_dropped(F.col("text")).alias("kept"), gates.stem(first).alias("stem"))


@query("reference_scope", "W03", f"""
with {LINES}, h as (select *, (doc_id + page) % 6 = 0 as heading, (doc_id + page) % 18 = 0 as opens from lines),
s as (select doc_id, page, coalesce(last_value(case when heading then opens end ignore nulls) over (partition by doc_id order by page rows unbounded preceding), false) as in_scope from h)
select doc_id, count(*)::bigint as n, count(*) filter (in_scope)::bigint as scoped from s group by 1""")
def reference_scope(spark, d):
    k = F.col("doc_id") + F.col("page")
    s = units.scoped(_lines(spark, d), k % 6 == 0, k % 18 == 0)
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("in_scope").alias("scoped"))


@query("unit_coverage", "J03 L08", f"""
with {LINES}, b as (select distinct unnest(string_split(text, chr(10))) as line from benchmark union select distinct line from lines where doc_id % 10 = 0),
m as (select doc_id as unit_id, b.line as hit from lines l left join b using (line) where trim(l.line) <> '')
select unit_id, count(*)::bigint as n_lines, count(hit)::bigint as n_covered, count(*) = count(hit) as covered from m group by 1""")
def unit_coverage(spark, d):
    lines = _lines(spark, d)
    known = table(spark, d, "benchmark").select(F.explode(T.lines(F.col("text"))).alias("line")).unionByName(lines.where("doc_id % 10 = 0").select("line"))
    return units.coverage(lines.withColumnRenamed("doc_id", "unit_id"), known)


@query("line_map_unique", "J02", f"""
with {LINES}, p as (select line as src, '>' || line || case when doc_id % 7 = 0 and page = 1 then '!' else '' end as o from lines where trim(line) <> '')
select src, min(o) as out from p group by src having count(distinct o) = 1""")
def line_map_unique(spark, d):
    mark = F.when((F.col("doc_id") % 7 == 0) & (F.col("page") == 1), "!").otherwise("")
    p = _lines(spark, d).where(F.trim("line") != "").select(F.col("line").alias("src"), F.concat(F.lit(">"), "line", mark).alias("out"))
    return units.line_map(p)


@query("reference_rule_mismatch", "J04", f"""
with {LINES}, l as (select doc_id as unit_id, trim(line) as line from lines where trim(line) <> ''), a as (select * from l where unit_id % 2 = 0), b as (select * from l where unit_id % 2 = 1),
m as (select distinct 'left' as side, unit_id from a where line not in (select line from b) union select distinct 'right', unit_id from b where line not in (select line from a))
select side, count(*)::bigint as n, min(unit_id) as sample from m group by 1""")
def reference_rule_mismatch(spark, d):
    l = _lines(spark, d).where(F.trim("line") != "").select(F.col("doc_id").alias("unit_id"), F.trim("line").alias("line"))  # noqa: E741
    m = units.mismatch(l.where("unit_id % 2 = 0"), l.where("unit_id % 2 = 1"))
    return m.groupBy("side").agg(F.count("*").alias("n"), F.min("unit_id").alias("sample"))


@query("assembled_documents", "K03 J16 X07", f"""
with {LINES}, u as (select doc_id, page, line as src, case when (doc_id + page) % 3 = 0 then case when page % 9 = 0 then ' --- ' else chr(10) || '>' || line || '  ' end end as o from lines),
s as (select *, regexp_replace(regexp_replace(array_to_string([case when trim(x) = '---' then '⸻' else x end for x in string_split(o, chr(10))], chr(10)), '^\\s*\\n', ''), '\\s+$', '') as t from u)
select doc_id, string_agg(coalesce(t, src), chr(10) order by page) as text, count(o)::bigint as replaced from s group by 1""")
def assembled_documents(spark, d):
    u = _lines(spark, d).withColumn("unit_id", F.concat_ws(":", F.lit("md"), "doc_id", "page")).withColumnRenamed("line", "src")
    out = F.when(F.col("page") % 9 == 0, " --- ").otherwise(F.concat(F.lit("\n>"), "src", F.lit("  ")))
    return units.assemble(u, u.where("(doc_id + page) % 3 = 0").select("unit_id", out.alias("out")))


@query("assemble_identity", "K03", "select doc_id, text, 0::bigint as replaced from documents")
def assemble_identity(spark, d):
    u = _lines(spark, d).withColumn("unit_id", F.concat_ws(":", F.lit("md"), "doc_id", "page")).withColumnRenamed("line", "src")
    return units.assemble(u, u.where("false").select("unit_id", F.col("src").alias("out")))


@query("cache_hits_misses", "J06 X06", f"""
with {LINES}, u as (select 'md:' || doc_id || ':' || page as unit_id, sha256(line || chr(31) || 'model') as key from lines), c as (select distinct key from u where substr(key, 1, 1) in ('0', '2', '4', '6', '8')),
m as (select key, min(unit_id) as owner, count(*) as sharers from u where key not in (select key from c) group by 1)
select 'hit' as kind, count(*)::bigint as units, count(distinct key)::bigint as keys from u where key in (select key from c)
union all select 'miss', sum(sharers)::bigint, count(*)::bigint from m""")
def cache_hits_misses(spark, d):
    u = _lines(spark, d).select(F.concat_ws(":", F.lit("md"), "doc_id", "page").alias("unit_id"), units.cache_key(F.col("line"), F.lit("model")).alias("key"))
    cache = u.where(F.substring("key", 1, 1).isin("0", "2", "4", "6", "8")).select("key").distinct()
    hits, misses = units.cache_plan(u, cache)
    h = hits.agg(F.lit("hit").alias("kind"), F.count("*").alias("units"), F.count_distinct("key").alias("keys"))
    return h.unionByName(misses.agg(F.lit("miss").alias("kind"), F.sum("sharers").alias("units"), F.count("*").alias("keys")))


@query("degenerate_output_groups", "A09", r"""
with r as (select lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) as o, source || ':' || lang as sig from documents)
select o as out, count(distinct sig)::bigint as n_sources, count(*)::bigint as n_units from r group by 1 having count(distinct sig) >= 3""")
def degenerate_output_groups(spark, d):
    r = _docs(spark, d).select(T.normalize_latin(F.col("text")).alias("out"), F.concat_ws(":", "source", "lang").alias("sig"))
    return units.degenerate_outputs(r, "out", "sig")


@query("context_tail", "W02", "select conv_id, turn, coalesce(right(lag(text) over (partition by conv_id order by turn), 200), '') as context from conversations")
def context_tail(spark, d):
    return units.context_tail(table(spark, d, "conversations"), 200, "conv_id", "turn", "text").select("conv_id", "turn", "context")


@query("unit_split_two", "C02", r"""
with p as (select doc_id, text as t, regexp_extract_all(text, '[.!?]\s+') as ms, string_split_regex(text, '[.!?]\s+') as ps from documents),
e as (select doc_id, t, unnest([length(array_to_string(ps[1:k], '')) + length(array_to_string(ms[1:k], '')) for k in range(1, len(ms) + 1)]) as e from p),
b as (select doc_id, arg_min(e, struct_pack(d := abs(e * 2 - length(t)), e := e)) as e from e where e < length(t) group by 1)
select doc_id, case when e is null then 1 else 2 end::bigint as parts, substr(text, 1, coalesce(e, length(text))::int) as head from documents left join b using (doc_id)""")
def unit_split_two(spark, d):
    s = _docs(spark, d).select("doc_id", units.split_two(F.col("text")).alias("p"))
    return s.select("doc_id", F.size("p").cast("long").alias("parts"), F.get("p", F.lit(0)).alias("head"))
