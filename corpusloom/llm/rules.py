"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every rule rejects a document whose integer score is above a cutoff. Cutoffs are not guessed: for each
stratum (language), rule and cutoff of a fixed grid, the labelled good documents are the holdout, and the
exact binomial tail P(Bin(n, ALPHA) <= false rejections) is the p-value of "this cutoff rejects more than
ALPHA of the good documents". A cutoff is valid if its p-value is at most DELTA over the number of all
tests (Bonferroni). The lowest valid cutoff is used; a stratum with too few labels has none, and the rule
rests there. So with probability 1 - DELTA no rule rejects more than ALPHA of the good documents in any
stratum.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_or_plain, written

#: Highest share of good documents that one rule may reject in a stratum, and the error of the whole selection.
ALPHA, DELTA = 0.01, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SPACE = r"[\x20\x09-\x0D]"
#: Score (in thousandths) and its grid of cutoffs, by rule.
RULES: dict[str, tuple[str, tuple[int, ...]]] = {
    "symbols": ("1000 * n_symbols div greatest(word_chars, 1)", (5, 10, 20, 40, 60, 80, 120, 160, 240)),
    "capitals": ("1000 * n_capitals div greatest(word_chars, 1)", (30, 60, 100, 150, 200, 300, 500)),
    "exclaims": ("1000 * n_exclaims div greatest(n_words, 1)", (20, 50, 100, 200, 400)),
    "lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", (50, 100, 200, 300, 500)),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", (50, 100, 200, 300, 400)),
    "long_words": ("1000 * word_chars div greatest(n_words, 1)", (6500, 7500, 9000, 12000)),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclaims")


def _gone(text: str, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def with_counts(rows: DataFrame) -> DataFrame:
    """Replace column _text by COUNTS. Window repeats are found by one sort of window hashes per text."""
    s = rows.withColumn("_text", F.coalesce(F.col("_text").cast("string"), F.lit("")))
    s = s.withColumn("_w", F.filter(F.split("_text", SPACE + "+"), lambda x: x != ""))
    s = s.withColumn("_l", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    s = s.withColumn("_h", F.expr("case when size(_w) < 3 then array() else transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) end"))
    s = s.withColumn("_o", F.expr("case when size(array_distinct(_h)) < size(_h) then sort_array(transform(_h, (h, i) -> struct(h, i))) end"))
    # (hash, place) in order: a window is repeated if a neighbour in this order has its hash
    s = s.withColumn("_p", F.expr("sort_array(transform(filter(_o, (x, k) -> (k > 0 and _o[k - 1].h = x.h) or (k + 1 < size(_o) and _o[k + 1].h = x.h)), x -> x.i))"))
    covered = F.expr("aggregate(_p, struct(-3 as at, 0L as n), (a, x) -> struct(x as at, a.n + least(3, x - a.at) as n), a -> a.n)")
    return s.select(
        *[c for c in rows.columns if c != "_text"],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _gone("_text", r"#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        _gone("_text", "A-Z").cast("long").alias("n_capitals"),
        _gone("_text", "!").cast("long").alias("n_exclaims"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact, summed in logarithms; 1 where k >= n p (there it is at least 1/2)."""
    start = n * log(1 - p)
    odds = log(p / (1 - p))

    def step(a: Column, j: Column) -> Column:
        term = a["t"] + F.log((n - j + 1) / j) + odds
        high, low = F.greatest(a["s"], term), F.least(a["s"], term)
        return F.struct(term.alias("t"), (high + F.log1p(F.exp(low - high))).alias("s"))

    first = F.struct(start.alias("t"), start.alias("s"))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, 1.0).otherwise(F.aggregate(steps, first, step, lambda a: F.exp(a["s"])))


def cutoffs(counts: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, cut map<rule, cutoff>) from all labelled good rows (quality 1) of ``counts(doc_id, stratum, ...)``."""
    good = counts.join(labels.where("quality = 1").select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id") == F.col("_id"), "left_semi")
    grid = [(name, score, cut) for name, (score, cuts) in RULES.items() for cut in cuts]
    over = [F.count_if(F.expr(score) > cut).alias(f"{name}:{cut}") for name, score, cut in grid]
    tally = good.groupBy("stratum").agg(F.count("*").alias("n"), *over)
    tests = written(
        tally.select("stratum", "n", F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(cut).alias("cutoff"), F.col(f"{name}:{cut}").alias("k")) for name, _, cut in grid])).alias("t")).select("stratum", "n", "t.*"),
        "tests",
    )
    total = tests.select(F.greatest(F.count("*"), F.lit(1)).alias("m"))
    valid = tests.crossJoin(F.broadcast(total)).where(binomial_tail(F.col("n"), F.col("k"), alpha) <= delta / F.col("m"))
    best = valid.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    return written(best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut")), "cutoffs")


def _verdict(counts: DataFrame, cuts: DataFrame) -> DataFrame:
    hits = [F.when(F.expr(score) > F.col("cut")[name], F.lit(name)) for name, (score, _) in RULES.items()]
    joined = counts.join(small_or_plain(cuts), "stratum", "left")
    fired = joined.withColumn("fired", F.array_compact(F.array(*hits))).withColumn("base_failed", base_failed())
    return fired.withColumn("kept", ~F.col("base_failed") & (F.size("fired") == 0))


def _counts(docs: DataFrame) -> DataFrame:
    return with_counts(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), F.col("text").alias("_text")))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, fired for each row.

    ``docs(doc_id, text, lang)``, ``labels(doc_id, quality)``; other columns are ignored. A null or empty text has
    no words and fails the base rule. A null language is a stratum of its own. Without labels, or with too few in
    a stratum, only the base rule rejects there. Rows with a null or repeated doc_id are judged like others.
    """
    counts = written(_counts(docs), "counts")
    out = _verdict(counts, cutoffs(counts, labels, alpha, delta))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", "fired")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns. Texts are counted twice and never shuffled."""
    cuts = cutoffs(written(_counts(docs), "counts"), labels, alpha, delta)
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), F.col("text").alias("_text"))
    # a filter must not move below the counts: each would be computed again wherever the verdict mentions it. It
    # does not move below a column like _stay
    counted = with_counts(rows).withColumn("_stay", F.monotonically_increasing_id())
    return _verdict(counted, cuts).where("kept and _stay >= 0").select("_row.*")


def oracle_sql(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """The same result as DuckDB SQL, for documents with distinct ids."""
    grid = ", ".join(f"('{name}', {cut})" for name, (_, cuts) in RULES.items() for cut in cuts)
    score = "case g.rule " + " ".join(f"when '{name}' then {s.replace(' div ', ' // ')}" for name, (s, _) in RULES.items()) + " end"
    return f"""
with t as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t),
win as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
rep as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from win) where n > 1),
cov as (select doc_id, count(distinct i + d) as n from rep, range(0, 3) as r(d) group by doc_id),
c as (select w.doc_id, w.stratum, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines,
             (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::bigint as n_capitals,
             (length(text) - length(replace(text, '!', '')))::bigint as n_exclaims
      from w left join cov using (doc_id)),
g as (select * from (values {grid}) as v(rule, cutoff)),
s as (select c.doc_id, c.stratum, g.rule, g.cutoff, {score} > g.cutoff as over from c, g),
tests as (select stratum, rule, cutoff, count(*) as n, count(*) filter (where over) as k from s
          where doc_id in (select doc_id from labels where quality = 1) group by all),
terms as (select stratum, rule, cutoff, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha}) + (n - j) * ln(1 - {alpha}))) as p
          from (select *, unnest(range(0, k + 1)) as j from tests where k < n * {alpha}) group by all),
best as (select stratum, rule, min(cutoff) as cutoff from terms where p <= {delta} / (select count(*) from tests) group by all),
fired as (select distinct s.doc_id from s join best using (stratum, rule, cutoff) where s.over),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and doc_id not in (select doc_id from fired) as kept
from b"""
