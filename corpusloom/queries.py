"""Queries over the driver's tables, one per operator, and the same results as DuckDB SQL where SQL can express them.

The raw documents have no headings, page marks or CJK text, so some queries run on texts that are derived by one SQL
expression which both engines understand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import jaccard, shingles, text
from .operators import chunk, classify, clean, dedup, entities, history, lint, pages, planner, quality, render, similarity, typo
from .plans import llm_stage
from .sources import readers

#: Headings, blank lines, CJK letters, contents and reference lines put into a text.
DERIVED = (
    "translate(concat('# ', source, chr(10), replace(replace(coalesce(text, ''), '. ', chr(10)), ', ', concat(chr(10), chr(10))), chr(10), '## Contents', chr(10), '1.1 One', chr(10), '1.2 Two', chr(10),"
    " 'Preface', chr(10), 'References [1]', chr(10), chr(10), chr(10), chr(10), chr(10), chr(10), chr(10), chr(10), 'end', chr(10)), 'qwxzk', '知识管理学')"
)
CARDS = (
    "select doc_id as pos, doc_id % 9 as compilation_id, split(coalesce(text, ''), chr(10))[0] as title, translate(coalesce(text, ''), 'qwxzkj', '知识管理学例') as content,"
    " case cast(doc_id % 7 as int) when 0 then 'Knowledge' when 1 then 'Person' when 2 then 'Term' when 3 then 'Quote' when 4 then 'Action' when 5 then 'CounterIntuit' else 'Review' end as card_type,"
    " concat(case when doc_id % 3 = 0 then '管理学' else source end, case when doc_id % 4 = 0 then '_第12页' when doc_id % 4 = 1 then '_p.7' else '_p3' end) as reference,"
    " case when doc_id % 5 = 0 then text else '' end as original_text, case when doc_id % 2 = 0 then source else '' end as source, cast(doc_id as string) as unique_id from documents"
)
Q: dict = {}
O: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, d) -> DataFrame:
    return read(spark, d, "documents")


def derived(spark, d) -> DataFrame:
    return docs(spark, d).select("doc_id", F.expr(DERIVED).alias("text"))


def cards(spark, d) -> DataFrame:
    return spark.sql(CARDS.replace("from documents", "from {documents}"), documents=docs(spark, d))


def r4(c) -> F.Column:
    return F.round(c, 4)


# DuckDB: lines of a text t of (doc_id, t), their trimmed form, and cards
LN = """
s as (select doc_id, t, string_split(t, chr(10)) as x from t),
l as (select doc_id, t, list_slice(x, 1, len(x) - case when x[len(x)] = '' then 1 else 0 end) as ls from s),
ln as (select doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as i from l),
m as (select *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as m from ln)"""
RAW = "with t as (select doc_id, coalesce(text, '') as t from documents)," + LN
DER = f"with t as (select doc_id, {DERIVED} as t from documents)," + LN
DUCK_CARDS = CARDS.replace("split(coalesce(text, ''), chr(10))[0]", "string_split(coalesce(text, ''), chr(10))[1]").replace("as string)", "as varchar)")
PRINT = r"[^\t\n\r\x20-\x7E\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}]"
CJK = r"[^\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}]"
A_CHARS = f"chars as (select doc_id, length(t) as n, length(regexp_replace(t, '{PRINT}', '', 'g')) as p, length(regexp_replace(t, '{CJK}', '', 'g')) as c from t)"
TOC = quality.TOC_LINE.replace("(?U)", "").replace(r"\z", "$")
A_STRUCT = f"""
pg as (select *, sum((m = '')::int) over (partition by doc_id order by i) as g from m),
pa as (select doc_id, g, sum(strlen(m)) + count(*) - 1 as b from pg where m <> '' group by all),
pb as (select doc_id, count(*) as paras, sum(b) as total, count(*) filter (b < 20) as short, count(*) filter (b > 500) as long from pa group by doc_id),
tc as (select doc_id, i, strlen(m) < 80 and regexp_matches(m, '{TOC}') as toc from m where m <> ''),
ti as (select *, sum((not toc)::int) over (partition by doc_id order by i) as g from tc),
tn as (select doc_id, sum(greatest(n - 1, 0)) as toc from (select doc_id, g, count(*) filter (toc) as n from ti group by all) group by doc_id),
hd as (select doc_id, count(*) filter (regexp_matches(line, '^#\\s+')) as h1, count(*) filter (regexp_matches(line, '^##\\s+')) as h2 from ln group by doc_id),
structure as (select t.doc_id, coalesce(paras, 0) as paras, coalesce(total, 0) as total, coalesce(short, 0) as short, coalesce(long, 0) as long, coalesce(toc, 0) as toc, coalesce(h1, 0) as h1, coalesce(h2, 0) as h2,
  case when h1 > 0 and h2 > 0 then 90.0 when h2 > 0 then 70.0 else 40.0 end - least(coalesce(short, 0) * 0.5, 20.0) as score
  from t left join pb using (doc_id) left join tn using (doc_id) left join hd using (doc_id))"""
CODE = r"""[^{}\[\]()=:;+\-*/|&#<>.,_%!?''"`~]"""
A_NOISE = rf"""
k as (select doc_id, i, line, m, (starts_with(m, '|') and suffix(m, '|')) or starts_with(m, '```') or starts_with(line, '    ') or starts_with(line, chr(9))
        or length(regexp_replace(m, '{CODE}', '', 'g')) / strlen(m) > 0.3 as c from m where strlen(m) >= 10),
kc as (select doc_id, m, c, count(*) as n from k group by all),
kr as (select doc_id, sum(case when not c then n - 1 else 0 end) as prose, sum(case when c then (n - 1) // 4 else 0 end) as code from kc where n >= 3 group by doc_id),
wm as (select doc_id, arg_min(m, i) as w from m where regexp_matches(line, '{quality.WATERMARK.replace("(?iuU)", "(?i)")}') group by doc_id),
noise as (select t.doc_id, coalesce(prose, 0) as prose, coalesce(code, 0) as code, coalesce(w, '') as w, w is not null as wm,
  greatest(100 - least((coalesce(prose, 0) + coalesce(code, 0)) * 0.5, 25.0) - case when w is not null then 20.0 else 0.0 end, 0.0) as score from t left join kr using (doc_id) left join wm using (doc_id))"""
A_COH = r"""
nx as (select *, lead(m) over (partition by doc_id order by i) as y from m),
cc as (select doc_id, count(*) filter (m <> '' and y is not null and not regexp_matches(m, '[。，；：！？.!?;:,]$') and regexp_matches(y, '^[a-z\x{4E00}-\x{9FFF}]')) as br,
  count(*) filter (y is not null and (regexp_matches(m, 'https?://$') or (suffix(m, '/') and not contains(m, ' '))) and y <> '' and not starts_with(y, '#') and not starts_with(y, '第')) as ur,
  count(*) filter (m <> '') as fl, count(*) filter (m <> '' and strlen(m) < 30) as sh, coalesce(sum(strlen(line)) filter (m <> ''), 0) as byt from nx group by doc_id),
coherence as (select t.doc_id, coalesce(br, 0) as br, coalesce(ur, 0) as ur, coalesce(byt, 0) / greatest(coalesce(fl, 0), 1) as av, coalesce(sh, 0) / greatest(coalesce(fl, 0), 1) as shr,
  case when cc.doc_id is null then 0.0 else greatest(100 - least(br * 0.02, 8.0) - least(ur * 2.0, 15.0), 0.0) end as score from t left join cc using (doc_id))"""
A_COMP = r"""
gp as (select doc_id, i - coalesce(lag(i) over (partition by doc_id order by i), 0) - 1 as gap, regexp_matches(m, '参考文献|References?|Bibliography|\[\d+\]') as ref from m where m <> ''),
ga as (select doc_id, count(*) filter (gap > 5) as gaps, count(*) filter (ref) as refs from gp group by doc_id),
cp as (select t.doc_id, strlen(t) as b, case when contains(t, chr(12)) then length(t) - length(replace(t, chr(12), '')) + 1 else strlen(t) // 450 + 1 end as pages, coalesce(gaps, 0) as gaps, coalesce(refs, 0) as refs from t left join ga using (doc_id)),
completeness as (select *, case when b / pages > 300 then 100.0 when b / pages > 100 then 70.0 else 40.0 end - least(gaps / greatest(pages, 1) * 30, 20.0) as score from cp)"""
ALL = f"{A_CHARS},{A_STRUCT},{A_NOISE},{A_COH},{A_COMP},"
SCORED = """
sc as (select doc_id, case when n > 0 then 100.0 * p / n else 0.0 end as char_score, s.score as struct_score, z.score as noise_score, h.score as coherence_score, greatest(e.score, 0.0) as completeness_score,
  case when n > 0 then 1 - p / n else 1.0 end as garbled, z.w, z.wm, z.prose, h.br, h.ur, s.toc, e.gaps / greatest(e.pages, 1) as blank
  from chars join structure s using (doc_id) join noise z using (doc_id) join coherence h using (doc_id) join completeness e using (doc_id)),
ov as (select *, (char_score + struct_score + noise_score + coherence_score + completeness_score) / 5 as overall from sc),
rep as (select *, case when overall >= 90 then 'A' when overall >= 75 then 'B' when overall >= 60 then 'C' when overall >= 40 then 'D' else 'F' end as grade,
  overall >= 60 and char_score >= 50 and noise_score >= 40 and coherence_score >= 40 as acceptable from ov)"""
AXES = {"char_score": "chars", "struct_score": "structure", "noise_score": "noise", "coherence_score": "coherence", "completeness_score": "completeness"}


@query
def quality_report(spark, d):
    r = quality.report(docs(spark, d))
    return r.select("doc_id", *[r4(F.col(f"{a}.score")).alias(n) for n, a in AXES.items()], r4(F.col("overall")).alias("overall"), "grade", "acceptable")


O["quality_report"] = f"{RAW}, {ALL}{SCORED} select doc_id, {', '.join(f'round({n}, 4) as {n}' for n in AXES)}, round(overall, 4) as overall, grade, acceptable from rep"


@query
def quality_report_derived(spark, d):
    r = quality.report(derived(spark, d))
    return r.select("doc_id", *[r4(F.col(f"{a}.score")).alias(n) for n, a in AXES.items()], r4(F.col("overall")).alias("overall"), "grade", "acceptable")


O["quality_report_derived"] = O["quality_report"].replace(RAW, DER)


@query
def char_health(spark, d):
    r = quality.with_axes(docs(spark, d))
    return r.select("doc_id", "chars.total_chars", r4(F.col("chars.printable_ratio")).alias("printable_ratio"), r4(F.col("chars.cjk_ratio")).alias("cjk_ratio"), r4(F.col("chars.score")).alias("score"))


O["char_health"] = f"{RAW}, {A_CHARS} select doc_id, n as total_chars, round(p / n, 4) as printable_ratio, round(c / n, 4) as cjk_ratio, round(100.0 * p / n, 4) as score from chars"


@query
def structure(spark, d):
    r = quality.with_axes(derived(spark, d))
    s = lambda n: F.col(f"structure.{n}")
    return r.select("doc_id", s("heading_counts")[0].cast("long").alias("h1"), s("heading_counts")[1].cast("long").alias("h2"), s("paragraph_count").alias("paragraphs"), s("short_paragraphs").alias("short"), s("long_paragraphs").alias("long"), r4(s("avg_paragraph_length")).alias("mean_bytes"), s("toc_line_count").alias("toc_lines"), r4(s("score")).alias("score"))


O["structure"] = f"{DER}, {A_STRUCT} select doc_id, h1, h2, paras as paragraphs, short, long, round(case when paras > 0 then total / paras else 0 end, 4) as mean_bytes, toc::bigint as toc_lines, round(score, 4) as score from structure"


@query
def noise(spark, d):
    r = quality.with_axes(docs(spark, d))
    return r.select("doc_id", "noise.repeated_lines", "noise.watermark_detected", "noise.watermark_text", r4(F.col("noise.score")).alias("score"))


O["noise"] = f"{RAW}, {A_NOISE} select doc_id, prose::bigint as repeated_lines, wm as watermark_detected, w as watermark_text, round(score, 4) as score from noise"


@query
def noise_top_phrases(spark, d):
    return quality.top_phrases(docs(spark, d))


O["noise_top_phrases"] = f"{RAW}, {A_NOISE} select doc_id, rank, m as line, n as count from (select *, row_number() over (partition by doc_id order by n desc, m) as rank from kc where n >= 3 and not c) where rank <= 5"


@query
def coherence(spark, d):
    r = quality.with_axes(derived(spark, d))
    return r.select("doc_id", "coherence.forced_break_count", "coherence.broken_urls", r4(F.col("coherence.avg_line_length")).alias("avg_line_length"), r4(F.col("coherence.short_line_ratio")).alias("short_line_ratio"), r4(F.col("coherence.score")).alias("score"))


O["coherence"] = f"{DER}, {A_COH} select doc_id, br as forced_break_count, ur as broken_urls, round(av, 4) as avg_line_length, round(shr, 4) as short_line_ratio, round(score, 4) as score from coherence"


@query
def completeness(spark, d):
    r = quality.with_axes(derived(spark, d))
    return r.select("doc_id", "completeness.total_bytes", r4(F.col("completeness.blank_ratio")).alias("blank_ratio"), r4(F.col("completeness.content_density")).alias("content_density"), "completeness.reference_count", r4(F.col("completeness.score")).alias("score"))


O["completeness"] = f"{DER}, {A_COMP} select doc_id, b as total_bytes, round(gaps / greatest(pages, 1), 4) as blank_ratio, round(b / pages, 4) as content_density, refs as reference_count, round(greatest(score, 0.0), 4) as score from completeness"


@query
def critical_issues(spark, d):
    r = quality.report(derived(spark, d))
    return r.select("doc_id", F.size("issues").alias("n_issues"), F.array_join("issues", " | ").alias("issues"))


O["critical_issues"] = f"""{DER}, {ALL}{SCORED}, iss as (select doc_id, list_filter([
  case when garbled > 0.05 then '乱码比例过高: ' || printf('%.1f', garbled * 100) || '%' end, case when wm then '检测到水印污染: ''' || w || ''' 重复出现' end,
  case when prose > 50 then '大量重复内容: ' || prose::bigint || ' 行重复' end, case when br > 500 then '强制换行较多: ' || br || ' 处' end, case when ur > 10 then 'URL 断裂: ' || ur || ' 处 URL 被换行切断' end,
  case when toc > 5 then '目录混入正文: 检测到 ' || toc::bigint || ' 行目录格式内容' end, case when blank > 0.1 then '空白区域过多: ' || printf('%.1f', blank * 100) || '%' end], lambda x: x is not null) as v from rep)
  select doc_id, len(v)::int as n_issues, array_to_string(v, ' | ') as issues from iss"""


@query
def grade_histogram(spark, d):
    return quality.report(docs(spark, d)).groupBy("grade", "acceptable").agg(F.count("*").alias("n"))


O["grade_histogram"] = f"{RAW}, {ALL}{SCORED} select grade, acceptable, count(*) as n from rep group by all"


# cleaning ------------------------------------------------------------------------------------------------------------
def _step(name: str, source, f, sql: str | None) -> None:
    Q[name] = lambda spark, d: source(spark, d).select("doc_id", f(text("text")).alias("text"))
    if sql:
        O[name] = sql


_step("clean_page_breaks", derived, clean.page_breaks, f"{DER} select doc_id, regexp_replace(replace(t, chr(12), chr(10) || chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') as text from t")
_step("collapse_blank", derived, clean.collapse_blank, O["clean_page_breaks"])
_step(
    "drop_watermarks", docs, clean.drop_watermarks,
    rf"""{RAW} select t.doc_id, coalesce(string_agg(line, chr(10) order by i), '') as text from t left join (select * from m where not (m <> '' and ((regexp_matches(m, '{clean.DOMAIN}') and strlen(m) < 80)
      or regexp_matches(m, '{clean.PROMO.replace("(?iuU)", "(?i)")}') or regexp_matches(m, '{clean.LOUD}')))) k using (doc_id) group by t.doc_id""",
)
NORMAL = r"regexp_replace(m, '[\s.\-–—]+\d+\s*$', '')"
_step(
    "drop_repeated_lines", docs, clean.drop_repeated,
    rf"""{RAW}, nm as (select *, {NORMAL} as n from m), oft as (select doc_id, n from nm where strlen(m) >= 5 group by all having count(*) >= 5)
      select t.doc_id, coalesce(string_agg(line, chr(10) order by i), '') as text from t left join (select nm.* from nm left join oft using (doc_id, n) where m = '' or oft.n is null) k using (doc_id) group by t.doc_id""",
)
_step(
    "merge_soft_breaks", derived, clean.merge_breaks,
    rf"""{DER}, pv as (select *, lag(m) over (partition by doc_id order by i) as p, sum((i > 1 and starts_with(m, '```'))::int) over (partition by doc_id order by i) as f from m),
      j as (select *, p is not null and p <> '' and regexp_matches(m, '^[a-z0-9\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{3000}}-\x{{303F}}]') and not regexp_matches(p, '^#{{1,6}}\s+') and not regexp_matches(p, '[。．.！!?？…、,；;：:\-–—~]$') and f % 2 = 0
        and not regexp_matches(p, '^\|.*\|$') and not regexp_matches(m, '^\|.*\|$') and not regexp_matches(p, '^\+[\-+]+\+$') and not regexp_matches(m, '^\+[\-+]+\+$') and (strlen(p) < 120 or strlen(m) < 120) as z from pv)
      select doc_id, string_agg(case when i = 1 then line when z then ' ' || line else chr(10) || line end, '' order by i) as text from j group by doc_id""",
)


@query
def remove_toc(spark, d):
    return clean.drop_toc(derived(spark, d))


@query
def clean_text(spark, d):
    return clean.clean_text(derived(spark, d))


@query
def strip_headers_footers(spark, d):
    # six pages a document: a header, the text's parts, a footer with the page's number
    parts = docs(spark, d).select("doc_id", F.col("source"), F.posexplode(F.array(*[F.expr(f"substring(coalesce(text, ''), {k} * (length(coalesce(text, '')) div 6) + 1, case when {k} = 5 then length(coalesce(text, '')) else length(coalesce(text, '')) div 6 end)") for k in range(6)])).alias("p", "t"))
    page = F.concat(F.lit("## 第 "), F.col("p") + 1, F.lit(" 页\n报告 "), "source", F.lit("\n"), "t", F.lit("\n— "), F.col("p") + 1, F.lit(" —\n"))
    marked = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", page.alias("t")))), lambda x: x["t"]), "").alias("text"))
    return pages.strip_headers_footers(marked)


# classification and planning -------------------------------------------------------------------------------------------
FEATURES = f"""{DER}, lo as (select doc_id, t, lower(t) as w from t),
lc as (select doc_id, count(*) as line_count, count(*) filter (starts_with(line, '# ')) as h1, count(*) filter (starts_with(line, '## ')) as h2, count(*) filter (contains(line, '|')) as bars from ln group by doc_id),
f as (select doc_id, length(t) as char_count, line_count, h1, h2, {", ".join("(" + " or ".join(f"contains(w, '{x}')" for x in v) + f") as {k}" for k, v in classify.WORDS.items())},
  contains(t, '```') as has_code, contains(t, '| ') and bars > 3 as has_table, (length(w) - length(replace(w, '步骤', ''))) // 2 + (length(w) - length(replace(w, 'step', ''))) // 4 + (length(w) - length(replace(w, '1. ', ''))) // 3 + (length(w) - length(replace(w, '2. ', ''))) // 3 as step_count
  from lo join lc using (doc_id))"""


@query
def doc_features(spark, d):
    r = classify.features(derived(spark, d))
    return r.select("doc_id", "f.char_count", "f.line_count", F.col("f.h1_count").alias("h1"), F.col("f.h2_count").alias("h2"), *[f"f.{n}" for n in classify.WORDS], "f.has_code", "f.has_table", "f.step_count")


O["doc_features"] = f"{FEATURES} select doc_id, char_count, line_count, h1, h2, {', '.join(classify.WORDS)}, has_code, has_table, step_count::bigint as step_count from f"


@query
def doc_type(spark, d):
    return classify.classify(derived(spark, d)).select("doc_id", "doc_type", "confidence", "best_score", "second_score")


def _sum(*rules: tuple[str, int]) -> str:
    return " + ".join(f"case when {c} then {p} else 0 end" for c, p in rules)


O["doc_type"] = f"""{FEATURES}, sco as (select doc_id, [
 {{'s': {_sum(("char_count > 5000", 20), ("char_count > 20000", 10), ("h1 >= 3", 25), ("h2 >= 3", 15), ("has_toc", 40), ("has_preface", 20), ("has_appendix", 15), ("has_references", 5))}, 'i': 0, 't': 'Book'}},
 {{'s': {_sum(("has_abstract", 45), ("has_keywords", 30), ("has_references", 30), ("has_figure", 10), ("char_count > 2000", 5), ("has_conclusion", 5))}, 'i': 1, 't': 'Paper'}},
 {{'s': case when char_count = 0 then 0 else {_sum(("char_count < 3000", 20), ("h1 >= 1", 10), ("h1 <= 2", 10), ("h2 <= 3", 5), ("not has_references", 5), ("not has_toc", 3), ("not has_appendix", 3), ("not has_abstract", 5))} end, 'i': 2, 't': 'Article'}},
 {{'s': {_sum(("has_table", 35), ("has_abstract", 20), ("has_conclusion", 20), ("char_count > 1000", 10), ("h1 >= 2", 10), ("has_references", 5))}, 'i': 3, 't': 'Report'}},
 {{'s': {_sum(("has_code", 40), ("step_count >= 2", 25), ("h2 >= 2", 15), ("has_table", 5), ("not has_abstract", 5), ("not has_references", 5))}, 'i': 4, 't': 'Manual'}}] as v from f),
r as (select doc_id, list_reverse_sort(v) as v from sco), b as (select doc_id, v[1].s as a, v[2].s as z, v[1].t as t from r), u as (select *, a < 20 or (z > 0 and a - z < 5) as unk from b)
select doc_id, case when unk then 'Unknown' else t end as doc_type, (case when unk then 30 else least((a - z) * 2 + a, 95) end)::int as confidence, a::int as best_score, z::int as second_score from u"""


@query
def doc_type_configs(spark, d):
    types = classify.classify(derived(spark, d)).groupBy("doc_type").agg(F.count("*").alias("n"))
    return types.join(F.broadcast(classify.configs(spark)), "doc_type").select("doc_type", "n", "chunk_size", "max_cards_per_chunk")


O["doc_type_configs"] = f"select doc_type, n, chunk_size, max_cards_per_chunk from (select doc_type, count(*) as n from ({O['doc_type']}) group by 1) join (values {', '.join(f'{(c[0], c[2], c[3])}' for c in classify.CONFIGS)}) as v(doc_type, chunk_size, max_cards_per_chunk) using (doc_type)"


@query
def chunk_limit(spark, d):
    o = read(spark, d, "orders")
    return o.select("o_orderkey", planner.chunk_limit(F.col("o_orderkey") * 37, F.col("o_custkey") * 11).alias("chunk_limit"))


O["chunk_limit"] = "select o_orderkey, greatest(least(least(floor(greatest(o_orderkey * 37 - 2800, 0) / 1.3::double), floor(greatest(o_custkey * 11 / 700.0::double, 1.0) * 4000.0)), 500000), 10000)::bigint as chunk_limit from orders"


@query
def type_targets(spark, d):
    n = docs(spark, d).select("doc_id", F.col("n_chars").alias("chars"), (F.floor(F.col("n_chars") / 5000) + 1).alias("chunks"))
    return planner.type_targets(n, "chars", "chunks")


O["type_targets"] = f"""with n as (select doc_id, n_chars as chars, n_chars // 5000 + 1 as chunks from documents), p as (select *, ceil(least(greatest(ceil(chars / 5556.0::double), 8), 300) / greatest(chunks, 1)) as per from n)
select doc_id, chars, chunks, card_type, (case when chars = 0 then 0 else greatest(round(per * share), 1) end)::bigint as target from p, (values {', '.join(f"('{k}', {v}::double)" for k, v in planner.SHARES.items())}) as s(card_type, share)"""


@query
def route(spark, d):
    return docs(spark, d).select("doc_id", planner.route(F.col("n_chars"), F.lit(10_000)).alias("route"))


O["route"] = "select doc_id, case when n_chars <= 10000 then 'single' else 'map_reduce' end as route from documents"


@query
def semantic_chunks(spark, d):
    return chunk.semantic_chunks(derived(spark, d), 10_000)


# card lint -------------------------------------------------------------------------------------------------------------
def _linted(spark, d):
    return lint.lint(cards(spark, d))


@query
def lint_cards(spark, d):
    return _linted(spark, d).select("pos", F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"), r4(F.col("quality_score")).alias("quality_score"), "is_valid", "status", "is_gated")


@query
def lint_stats(spark, d):
    return lint.lint_stats(_linted(spark, d))


@query
def quality_by_type(spark, d):
    return lint.quality_report(_linted(spark, d))


@query
def info_density(spark, d):
    return cards(spark, d).select("pos", r4(lint.info_density(F.col("content"))).alias("density"))


def _marks() -> str:
    terms = [f"(length(content) - length(replace(content, '{m.replace(chr(39), chr(39) * 2)}', ''))) / {len(m)} * {w}::double" for m, w in lint.MARKERS]
    return " + ".join([*terms, "(length(content) - length(regexp_replace(content, '[0-9]', '', 'g'))) * 0.5::double"])


O["info_density"] = f"with c as ({DUCK_CARDS}) select pos, round(case when content = '' then 0.0 else ({_marks()}) * 100 / greatest(length(content), 1) end, 4) as density from c"


@query
def ref_format(spark, d):
    return cards(spark, d).select("pos", "reference", lint.ref_ok(F.col("reference")).alias("ok"))


O["ref_format"] = f"""with c as ({DUCK_CARDS}), p as (select pos, reference, strpos(reference, '_p') as a from c), q as (select *, substr(reference, 1, a - 1) as s, substr(reference, a + 2, 1) as n from p)
select pos, reference, a > 0 and regexp_matches(n, '[0-9]') and s <> '' and not regexp_matches(s, '《|》|本书|;|\\[|\\]') and not regexp_matches(s, '^[A-Za-z\\s.\\-&;]{{2,}}$') and not regexp_matches(s, '^(（|\\[[法美英德日中意奥俄]\\])') as ok from q"""


@query
def ref_repair(spark, d):
    return cards(spark, d).select("pos", lint.repair_ref(F.col("reference"), F.col("content"), ["聪明的阅读者", "人生模式"]).alias("reference"))


O["ref_repair"] = f"with c as ({DUCK_CARDS}) select pos, regexp_replace(regexp_replace(reference, '^(.+)_第(\\d+)(?:-\\d+)?页$', '\\1_p\\2'), '_p\\.(\\d+)$', '_p\\1') as reference from c"


@query
def title_match(spark, d):
    c = cards(spark, d)
    return c.select("pos", lint.title_matches(F.reverse("title"), F.col("content")).alias("matches"))


PUNCT = lint.TITLE_PUNCTUATION.replace("'", "''")
O["title_match"] = f"""with c as ({DUCK_CARDS}), b as (select pos, content, trim(reverse(title)) as t, list_reduce(list_concat([reverse(title)], string_split('{PUNCT}', '')), lambda a, x: replace(a, x, '')) as n from c)
select pos, contains(content, t) or len(list_filter(range(1, length(n)), lambda i: contains(content, substr(n, i, 2)))) > 0 as matches from b"""


@query
def lcs_similarity(spark, d):
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", r4(similarity.lcs_ratio(F.col("text"), F.reverse("text"))).alias("lcs"))


@query
def fnv1a_hash(spark, d):
    return read(spark, d, "part").select("p_partkey", similarity.fnv1a(F.col("p_name")).alias("fnv"))


# similarity and merge --------------------------------------------------------------------------------------------------
def _talk(spark, d) -> DataFrame:
    return read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.col("role").alias("title"), F.col("text").alias("content"), F.concat("role", F.lit("_p1")).alias("reference"), F.lit("Knowledge").alias("card_type"))


@query
def shingle_counts(spark, d):
    c = _talk(spark, d)
    return c.select("pos", F.size(shingles(F.col("content"), 3)).cast("long").alias("n"), r4(jaccard(shingles(F.col("content"), 3), shingles(F.col("title"), 3))).alias("j"))


TALK = "c as (select conv_id * 1000 + turn as pos, role as title, text as content from conversations)"
SH = "case when length({0}) < {1} then [{0}] else list_distinct(list_transform(range(1, length({0}) - {1} + 2), lambda i: substr({0}, i, {1}))) end"
O["shingle_counts"] = f"with {TALK}, s as (select pos, {SH.format('content', 3)} as a, {SH.format('title', 3)} as b from c) select pos, len(a) as n, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 4) as j from s"


@query
def similarity_edges(spark, d):
    return dedup.similarity_edges(_talk(spark, d), 3, 0.65).select("a", "b", r4(F.col("sim")).alias("sim"))


JAC = "len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1})))"
O["similarity_edges"] = f"""with {TALK}, r as (select min(pos) as pos, coalesce(title, '') as title, coalesce(content, '') as content from c group by 2, 3), s as (select pos, {SH.format('title', 3)} as ts, {SH.format('content', 3)} as cs from r),
p as (select a.pos as a, b.pos as b, 0.3::double * {JAC.format('a.ts', 'b.ts')} + 0.7::double * {JAC.format('a.cs', 'b.cs')} as sim from s a join s b on a.pos < b.pos and len(a.cs) >= len(b.cs) * 0.5 and len(b.cs) >= len(a.cs) * 0.5)
select a, b, round(sim, 4) as sim from p where sim >= 0.65"""


@query
def components(spark, d):
    c = _talk(spark, d)
    return dedup.members(c, dedup.similarity_edges(c, 3, 0.65, spanning=True))


@query
def dedup_cards(spark, d):
    return dedup.dedup_cards(_talk(spark, d))


# entities --------------------------------------------------------------------------------------------------------------
def _names(spark, d) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_brand").alias("entity_type"), F.col("p_type").alias("context"))


@query
def entity_exact_dedup(spark, d):
    return entities.exact_dedup(_names(spark, d)).select("pos", "name", "entity_type")


O["entity_exact_dedup"] = "select min(p_partkey) as pos, arg_min(p_name, p_partkey) as name, p_brand as entity_type from part group by lower(p_name), p_brand"


@query
def entity_unify(spark, d):
    return entities.unify(_names(spark, d))


@query
def entity_name_map(spark, d):
    return entities.name_map(_names(spark, d))


@query
def parse_entities(spark, d):
    raw = read(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("type")), F.struct(F.lit(" ").alias("name"), F.lit("x").alias("type"))).alias("entities"))).alias("raw"))
    return entities.parse_entities(raw, "raw")


O["parse_entities"] = "select p_partkey as pos, p_name as name, p_brand as entity_type, '' as context from part"


# history ---------------------------------------------------------------------------------------------------------------
def _books(spark, d) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("author"))


def _runs(spark, d) -> DataFrame:
    o = read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("book_id"), F.lit(1).alias("version"), (F.col("o_orderkey") % 90).alias("total_cards"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("compiled_at"), (F.col("o_orderkey") % 2).cast("int").alias("reviewed"))


RUNS = "r as (select o_orderkey as id, o_custkey as book_id, 1 as version, o_orderkey % 90 as total_cards, strftime(o_orderdate, '%Y-%m-%d') as compiled_at, (o_orderkey % 2)::int as reviewed from orders)"


@query
def history_recent(spark, d):
    return history.recent(_runs(spark, d), _books(spark, d), 20)


O["history_recent"] = f"with {RUNS}, l as (select * from r order by compiled_at desc, id desc limit 20) select id, book_id, c_name as title, c_mktsegment as author, version, total_cards, compiled_at from l join customer on c_custkey = book_id"


@query
def history_card_stats(spark, d):
    return history.card_stats(cards(spark, d))


O["history_card_stats"] = f"select card_type, count(*) as n from ({DUCK_CARDS}) group by 1"


@query
def history_stats(spark, d):
    return history.stats(_runs(spark, d), _books(spark, d))


O["history_stats"] = f"with {RUNS} select (select count(*) from customer) as n_books, count(*) as n_compilations, sum(total_cards)::bigint as n_cards, count(*) filter (reviewed = 1) as n_reviewed, max(compiled_at) as last_compiled_at from r"


@query
def version_assign(spark, d):
    runs = _runs(spark, d)
    return history.next_versions(runs.where("id % 2 = 0").select("id", "book_id"), runs.where("id % 2 = 1")).select("id", "book_id", "version")


O["version_assign"] = f"with {RUNS}, k as (select book_id, max(version) as v from r where id % 2 = 1 group by 1) select id, r.book_id, (coalesce(v, 0) + row_number() over (partition by r.book_id order by id))::int as version from r left join k on k.book_id = r.book_id where id % 2 = 0"


@query
def mark_reviewed(spark, d):
    runs = _runs(spark, d)
    return history.mark_reviewed(runs, runs.where("id % 3 = 0").select("id")).select("id", "reviewed")


O["mark_reviewed"] = f"with {RUNS} select id, (case when id % 3 = 0 then 1 else reviewed end)::int as reviewed from r"


@query
def book_upsert(spark, d):
    c = read(spark, d, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("source_file"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment")).alias("title"), F.lit("").alias("author"), F.lit("p").alias("publisher"), F.lit("").alias("isbn"), F.col("c_custkey").alias("page_count"), F.lit(1).alias("file_size"), F.lit("a").alias("content_hash"), F.lit(2).cast("long").alias("compile_count"))
    new = c.where("c_custkey % 4 <> 0 or c_custkey % 3 = 0").select(F.col("c_name").alias("source_file"), F.lit("new").alias("title"), F.lit("who").alias("author"), F.lit("q").alias("publisher"), F.lit("").alias("isbn"), (F.col("c_custkey") + 1).alias("page_count"), F.lit(2).alias("file_size"), F.lit("b").alias("content_hash"))
    return history.upsert_books(old, new)


O["book_upsert"] = """with o as (select c_name as source_file, case when c_custkey % 2 = 0 then '' else c_mktsegment end as title, c_custkey as k from customer where c_custkey % 3 <> 0), n as (select c_name as source_file, c_custkey + 1 as k from customer where c_custkey % 4 <> 0 or c_custkey % 3 = 0)
select coalesce(o.source_file, n.source_file) as source_file, case when coalesce(o.title, '') <> '' then o.title when n.k is not null then 'new' else '' end as title, case when n.k is not null then 'who' else '' end as author,
 case when o.k is not null then 'p' else 'q' end as publisher, '' as isbn, coalesce(n.k, o.k) as page_count, (case when n.k is not null then 2 else 1 end)::int as file_size, case when n.k is not null then 'b' else 'a' end as content_hash,
 (case when o.k is not null then 2 else 0 end + case when n.k is not null then 1 else 0 end)::bigint as compile_count from o full join n on o.source_file = n.source_file"""


@query
def usage_rollup(spark, d):
    e = read(spark, d, "events")
    return history.usage(e.select(F.col("event_type").alias("model"), F.col("event_id").alias("prompt_tokens"), (F.col("user_id") % 100).alias("completion_tokens"), (F.col("event_id") % 977).alias("latency_ms")))


O["usage_rollup"] = "select event_type as model, count(*) as calls, sum(event_id)::bigint as prompt_tokens, sum(user_id % 100)::bigint as completion_tokens, floor(sum(event_id % 977) / count(*))::bigint as mean_latency_ms from events group by 1"


@query
def diagnostics_union(spark, d):
    e = read(spark, d, "events")
    return history.diagnostics(e.where("event_id % 3 = 0").select("event_id", F.lit("m").alias("message")), e.where("event_id % 3 = 1").select("event_id", F.col("user_id").alias("expected_count")), e.where("event_id % 3 = 2").select("event_id", F.lit(2).alias("retry_count")))


O["diagnostics_union"] = "select event_id, case event_id % 3 when 0 then 'fail' when 1 then 'degradation' else 'retry' end as diag_type, case when event_id % 3 = 0 then 'm' end as message, case when event_id % 3 = 1 then user_id end as expected_count, case when event_id % 3 = 2 then 2 end as retry_count from events"


@query
def card_counts(spark, d):
    return history.card_counts(_linted(spark, d))


@query
def unique_ids(spark, d):
    return history.unique_ids(docs(spark, d).select(F.col("doc_id").alias("pos")), "20240101120000")


O["unique_ids"] = "select doc_id as pos, strftime(timestamp '2024-01-01 12:00:00' + to_seconds(row_number() over (order by doc_id) - 1), '%Y%m%d%H%M%S') as unique_id from documents"


# rendering, typography, answers, sources ---------------------------------------------------------------------------------
@query
def card_markdown(spark, d):
    return cards(spark, d).select("pos", render.card_markdown(cards(spark, d)).alias("markdown"))


@query
def mermaid(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return render.mermaid(n.select(F.col("n_name").alias("source"), F.col("r_name").alias("target"), F.lit("in").alias("relation_type")))


O["mermaid"] = """with e as (select n_name as source, r_name as target from nation join region on n_regionkey = r_regionkey), n as (select name, row_number() over (order by name) - 1 as id from (select source as name from e union select target from e))
select '    N' || id || '["' || name || '"]' as line from n union all select '    N' || a.id || ' -->|in| N' || b.id from e join n a on a.name = source join n b on b.name = target"""


@query
def file_names(spark, d):
    return read(spark, d, "pages").select("page_id", render.file_name(F.col("url")).alias("name"))


O["file_names"] = "select page_id, trim(translate(url, '/\\:*?\"<>|：？＜＞｜', '______________')) as name from pages"


@query
def guess_title(spark, d):
    return derived(spark, d).select("doc_id", render.guess_title(F.col("text"), F.lit("")).alias("title"))


O["guess_title"] = "select doc_id, translate(source, 'qwxzk', '知识管理学') as title from documents"


@query
def typo_fix(spark, d):
    return typo.fix_column(derived(spark, d), "text").select("doc_id", "text", "n_fixes")


@query
def json_degrade(spark, d):
    c = docs(spark, d)
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('x\n```json\n{"a": '), "doc_id", F.lit("}\n```\ny"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("标题 "), "source", F.lit("---")))
    return c.select("doc_id", llm_stage.degrade(raw).alias("json"))


O["json_degrade"] = """select doc_id, case doc_id % 3 when 0 then '{"a": ' || doc_id || '}' when 1 then '{"cards":[{"raw_card":"标题 ' || source || '"}]}' end as json from documents"""


@query
def html_to_markdown(spark, d):
    return readers.html_to_markdown(read(spark, d, "pages"))


@query
def scan_triage(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), (F.col("p_size") % 9).cast("long").alias("pages"), (F.col("p_partkey") % 4).alias("fonts"), (F.col("p_partkey") % 3).alias("images"), (F.col("p_partkey") * 7 % 200).alias("objects"))
    return readers.scan_report(readers.triage(p))


O["scan_triage"] = """with f as (select p_size % 9 as pages, p_partkey % 4 as fonts, p_partkey % 3 as images, p_partkey * 7 % 200 as objects from part),
s as (select case when fonts > 0 then 'HasText' when images = 0 and objects > 20 * pages then 'HandDrawn' else 'NeedOcr' end as status from f) select status, count(*) as n, round(100 * count(*) / sum(count(*)) over (), 4) as percent from s group by 1"""
