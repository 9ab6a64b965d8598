"""URL filters: fixed host-and-path rules, and association rules mined from labelled URLs.

A URL's tokens are its scheme, registered suffixes and labels of its host, the words of its path, its file ending, and
its query keys. Spark's FP-growth mines frequent token combinations together with the label; rules
"combination -> block" are kept if support, count, confidence and lift are high enough, if the confidence is surely
at least the wanted one (a Chernoff bound, Bonferroni over all mined combinations) and no more general rule is as
confident. Matching uses an inverted index: each mined rule is filed under its rarest token, each fixed rule
under its host, so a URL meets only rules that share that token with it. Support bounds the number of rules; the index is
broadcast after its size is checked.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (verdict, rule); a rule is a host, a slash and the start of the path after it.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 0.5, 1.5
#: A rule has at least so many bad URLs; the risk that chance alone makes any rule below the wanted confidence.
MIN_COUNT, RISK = 5, 0.05
#: More rules than this are not broadcast: mine with a higher support.
MOST_RULES = 100_000
BLOCK = "=block"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    """(host, path); both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = re.search(r"[/?#]|\Z", rest).start()
    tail = rest[end:]
    path = tail[: re.search(r"[?#]|\Z", tail).start()]
    return rest[:end].encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass"), path


def suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))]


def tokens(url: str | None) -> list[str]:
    """The distinct tokens of a URL; numbers are no tokens."""
    host, path = parts(url)
    if not host:
        return []
    scheme, _, rest = url.partition("://")
    out = ["scheme:" + scheme.lower()]
    out += ["host:" + s for s in suffixes(host)]
    out += ["label:" + x for x in re.split(r"[.\-_]", host) if x]
    words = [x for x in re.split(r"[/.\-_]", path.lower()) if x and not x.isdecimal()]
    out += ["path:" + x for x in words]
    query = re.search(r"\?([^#]*)", rest)
    out += ["key:" + x.partition("=")[0] for x in (query[1].split("&") if query else []) if x]
    out += ["fragment"] * ("#" in rest)
    return list(dict.fromkeys(out))


def _tokens_column(df: DataFrame, url: str, *keep: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([tokens(x) for x in b.column(0).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], got], names=[*b.schema.names[1:], "items"])

    rest = df.select(*keep)
    return df.select(F.col(url).cast("string"), *keep).mapInArrow(run, rest.schema.add("items", T.ArrayType(T.StringType())))


def surely(bad: int, n: int, least: float, risk: float) -> bool:
    """Whether ``bad`` of ``n`` has at most probability ``risk`` (Chernoff) if the true share is ``least`` or lower."""
    p = bad / n
    if p <= least or least <= 0:
        return least <= 0
    rest = (1 - p) * math.log((1 - p) / (1 - least)) if p < 1 else 0.0
    return n * (p * math.log(p / least) + rest) >= -math.log(risk)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_count: int = MIN_COUNT, risk: float = RISK) -> list[dict]:
    """Rules {tokens, confidence, support, index} from all rows of ``labelled(url, bad boolean)``.

    Rows without a label or without tokens are left out; without any bad row there are no rules.
    """
    baskets = _tokens_column(labelled.where("bad is not null").select("url", "bad"), "url", "bad").where("size(items) > 0")
    baskets = baskets.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")).alias("items"))
    # what never occurs often enough with the label cannot be in a rule: dropped from the baskets before the mining
    n = baskets.count()
    if not n:
        return []
    often = baskets.where(F.array_contains("items", BLOCK)).select(F.explode("items").alias("t")).groupBy("t").count().where(F.col("count") >= max(min_support * n, min_count))
    kept = {r.t: r["count"] for r in often.collect()}  # at most (tokens a URL) / min_support
    if BLOCK not in kept:
        return []
    baskets = baskets.select(F.array_intersect("items", F.array(*[F.lit(t) for t in sorted(kept)])).alias("items")).where("size(items) > 0")
    m = baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min(1.0, (min_count - 0.5) / m)), minConfidence=min_confidence, numPartitions=max(8, baskets.sparkSession.sparkContext.defaultParallelism)).fit(baskets)
    found = model.associationRules.where(F.array_contains("consequent", BLOCK) & (F.col("lift") >= min_lift)).select("antecedent", "confidence", "support")
    if found.count() > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules; raise min_support")
    tests = max(1, model.freqItemsets.where(F.array_contains("items", BLOCK)).count())
    sure = [r for r in found.collect() if surely(k := round(r.support * m), round(k / r.confidence), min_confidence, risk / tests)]
    rules = sorted(((frozenset(r.antecedent), r.confidence, r.support) for r in sure), key=lambda r: (len(r[0]), -r[1], sorted(r[0])))
    out: list[dict] = []
    general: dict[str, list[tuple[frozenset, float]]] = {}
    for items, confidence, support in rules:
        if any(confidence <= c and other <= items for t in items for other, c in general.get(t, ())):
            continue  # a more general rule is as confident
        index = min(items, key=lambda t: (kept.get(t, 0), t))
        general.setdefault(index, []).append((items, confidence))
        out.append({"tokens": sorted(items), "confidence": confidence, "support": support, "index": index})
    return out


class Filter:
    """Both kinds of rules in their inverted indexes."""

    def __init__(self, rules: list[dict], fixed: tuple = RULES):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in fixed:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))
        self.by_token: dict[str, list[tuple[float, frozenset, str]]] = {}
        for r in rules:
            self.by_token.setdefault(r["index"], []).append((r["confidence"], frozenset(r["tokens"]), " & ".join(r["tokens"])))

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None, float | None]:
        """host, path, fixed rule, verdict, mined rule, its confidence."""
        host, path = parts(url)
        fits = [(len(rule), rule, verdict) for s in suffixes(host) for start, rule, verdict in self.by_host.get(s, ()) if host and path.startswith(start)]
        if fits:
            _, rule, verdict = max(fits)
            return host, path, rule, verdict, None, None
        have = set(tokens(url))
        hits = [(c, text) for t in have for c, need, text in self.by_token.get(t, ()) if need <= have]
        if hits:
            confidence, text = max(hits)
            return host, path, None, "block", text, confidence
        return host, path, None, "allow", None, None


def judge(pages: DataFrame, rules: list[dict], fixed: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined, confidence for each row of ``pages(page_id, url)``.

    The longest fixed rule that fits decides, else the most confident mined rule blocks, else the URL is allowed. A null URL or one
    without ``://`` has an empty host and path and is allowed. Other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(Filter(rules, fixed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.float64()]
        for b in batches:
            got = [shared.value.judge(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(zip(*got) if got else [[]] * 6, kinds))], names=["page_id", "host", "path", "rule", "verdict", "mined", "confidence"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, mined string, confidence double")


def document_number(url: Column) -> Column:
    """The number of the document that a page's path names, else null."""
    return F.regexp_extract(url, r"://[^/?#]*/(?:[^?#]*/)?(\d+)", 1).try_cast("long")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of pages whose document is labelled; bad is poor or toxic."""
    bad = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return pages.select("url", document_number(F.col("url")).alias("_n")).join(bad, F.col("_n") == F.col("_id")).select("url", "bad")
