"""Entity resolution: normal names, pair test, leader clustering within a type, merge."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text, utrim

SAME = 0.85
BRACKETS = ("（）", "()", "【】", "[]")


def strip_brackets(s: str) -> str:
    """Without what stands in brackets, nested ones too; an unmatched closing one goes, an unmatched opening one takes the rest."""
    for open_, close in BRACKETS:
        depth, out = 0, []
        for part in re.split(f"([{re.escape(open_ + close)}])", s):
            if part == open_:
                depth += 1
            elif part == close:
                depth = max(0, depth - 1)
            elif not depth:
                out.append(part)
        s = "".join(out)
    return s


def normal_name(name: str) -> str:
    return " ".join(re.sub("[·・.]", "", strip_brackets(name.lower())).split())


def english_name(name: str) -> str | None:
    for pattern in ("（([^）]*)）", r"\(([^)]*)\)"):
        m = re.search(pattern, name)
        if m and re.search("[A-Za-z]", m[1]):
            return m[1].strip().lower()
    return None


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def same_entity(a: tuple, b: tuple) -> bool:
    """a, b: (normal name, its bytes, English name)."""
    (x, nx, ex), (y, ny, ey) = a, b
    if x == y or nx >= 4 and ny >= 4 and (x in y or y in x):
        return True
    if ex and ey:
        if ex in ey or ey in ex:
            return True
        p, q = (ex.split() or [ex])[-1], (ey.split() or [ey])[-1]
        if p == q and len(p.encode()) >= 3:
            return True
    longest = max(len(x), len(y))
    if not x or not y or 1 - abs(len(x) - len(y)) / longest < SAME:  # the lengths alone rule it out
        return False
    return 1 - levenshtein(x, y) / longest >= SAME


def name_score(c: Column) -> Column:
    return F.length(c) + F.when(c.rlike("[·・.]"), 5).otherwise(0) + F.when(~c.rlike(r"[(（]"), 2).otherwise(0) + F.when(c.rlike(r"^\p{Lu}"), 1).otherwise(0)


def exact_dedup(entities: DataFrame) -> DataFrame:
    """The first row (by pos) of each lower-cased name and type."""
    first = entities.groupBy(F.lower(text("name")).alias("_n"), text("entity_type").alias("_t")).agg(F.min_by(F.struct(*entities.columns), "pos").alias("r"))
    return first.select("r.*")


def leaders(entities: DataFrame) -> DataFrame:
    """(entity_type, name, leader): each distinct name of a type with the name that leads its group.

    Greedy in order of first appearance: a name joins the first leader that it equals by ``same_entity``; it is compared with leaders
    only. The rule is sequential within a type, so a type's distinct names (copies are dropped before) run in one task.
    """
    names = entities.groupBy(text("entity_type").alias("entity_type"), text("name").alias("name")).agg(F.min("pos").alias("pos"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "name"])
        heads: list[tuple[tuple, str]] = []
        out = []
        for name in pdf["name"]:
            n = normal_name(name)
            me = (n, len(n.encode()), english_name(name))
            # leaders stand in order, so the first that fits is the one that would have absorbed the name
            lead = next((h for k, h in heads if same_entity(k, me)), None)
            if lead is None:
                heads.append((me, name))
                lead = name
            out.append(lead)
        return pd.DataFrame({"entity_type": pdf["entity_type"], "name": pdf["name"], "leader": out})

    return names.groupBy("entity_type").applyInPandas(run, "entity_type string, name string, leader string")


def unify(entities: DataFrame) -> DataFrame:
    """One row per group: entity_type, name (the best of the group, the last of equals), context (distinct, in order), merged."""
    led = leaders(entities)
    d = entities.select("pos", text("name").alias("name"), text("entity_type").alias("entity_type"), text("context").alias("context")).join(led, ["entity_type", "name"])
    g = d.groupBy("entity_type", "leader").agg(
        F.max_by("name", F.struct(name_score(F.col("name")), "pos")).alias("name"), F.count("*").alias("merged"),
        F.array_sort(F.collect_set(F.when(F.col("context") != "", F.struct("pos", "context")))).alias("c"),
    )
    return g.select("entity_type", "name", F.array_join(F.array_distinct(F.transform("c", lambda x: x["context"])), "；").alias("context"), "merged")


def name_map(entities: DataFrame) -> DataFrame:
    """(entity_type, raw_name, canonical)."""
    led = leaders(entities)
    d = entities.select("pos", text("name").alias("name"), text("entity_type").alias("entity_type")).join(led, ["entity_type", "name"])
    best = d.groupBy("entity_type", "leader").agg(F.max_by("name", F.struct(name_score(F.col("name")), "pos")).alias("canonical"))
    return led.join(best, ["entity_type", "leader"]).select("entity_type", F.col("name").alias("raw_name"), "canonical")


def parse_entities(raw: DataFrame, column: str) -> DataFrame:
    """(… , name, entity_type, context) from JSON: an object with ``entities`` or an array; ``type`` wins over ``entity_type``; no empty names."""
    item = "array<struct<name:string,type:string,entity_type:string,context:string>>"
    both = F.coalesce(F.from_json(F.get_json_object(column, "$.entities"), item), F.from_json(F.col(column), item))
    rest = [c for c in raw.columns if c != column]
    d = raw.select(*rest, F.explode(both).alias("e")).where(F.coalesce(utrim(F.col("e.name")), F.lit("")) != "")
    return d.select(*rest, "e.name", F.coalesce("e.type", "e.entity_type", F.lit("未知")).alias("entity_type"), F.coalesce("e.context", F.lit("")).alias("context"))


def mentions(entities: DataFrame, cards: DataFrame) -> DataFrame:
    """(name, entity_type, n): cards whose words hold a one-word entity name, by an equi-join on words."""
    words = cards.select("pos", F.explode(F.array_distinct(F.split(F.lower(text("content")), r"[^\p{L}\p{N}]+"))).alias("w"))
    names = entities.select("name", "entity_type", F.lower("name").alias("w")).distinct()
    return words.join(names, "w").groupBy("name", "entity_type").agg(F.count("*").alias("n"))


def ranked(entities: DataFrame) -> DataFrame:
    """Entities with their place by name within a type."""
    return entities.withColumn("rank", F.row_number().over(Window.partitionBy("entity_type").orderBy("name")))

