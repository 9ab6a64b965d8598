"""Chinese typography: lint and repair as one Arrow function.

Every step computes for all characters at once where it must not touch the text (code fences, URLs, tables) and rewrites by
regular expressions outside of that. Positions in issues belong to the text as the step found it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# fixed values
CJK = "一-鿿㐀-䶿　-〿＀-￯⺀-⻿\U00020000-\U0002a6df"
CJK_MARKS = "。，、；：！？“”‘’（）【】《》〈〉「」『』—…·～"
TO_CJK = str.maketrans(",.;:!?()[]<>", "，。；：！？（）【】《》")
BOUNDARY = re.compile(f"(?=([{CJK}])[A-Za-z])|(?=([A-Za-z])[{CJK}])")
DIGIT_BOUNDARY = re.compile(f"(?=([{CJK}])[0-9])|(?=([0-9])[{CJK}])")
LATIN_MARK = re.compile(f"(?<=[{CJK}])[,.;:!?()\\[\\]<>]|[,.;:!?()\\[\\]<>](?=[{CJK}])")
BRACKET = re.compile(f"\\((?=[{CJK}])|(?<=[{CJK}])\\)")
AFTER = re.compile(f"(?<=[{CJK}])[\"']")
BEFORE = re.compile(f"(?<![{CJK}])[\"'](?=[{CJK}])")


class Guard:
    """Places that stay: in code fences, just behind a URL scheme or a link's opening, in lines with a bar."""

    def __init__(self, text: str):
        self.text = text
        self.fences = [m.end() - 1 for m in re.finditer("```", text)]

    def code_or_url(self, at: int) -> bool:
        if self.fences and sum(f <= at for f in self.fences) % 2:
            return True
        near = self.text[max(0, at - 10) : at + 1]
        return "http://" in near or "https://" in near or "ftp://" in near or (at >= 2 and near.endswith("]("))

    def table(self, at: int) -> bool:
        start = self.text.rfind("\n", 0, at) + 1
        end = self.text.find("\n", at)
        return "|" in self.text[start : end if end >= 0 else len(self.text)]


def _rewrite(text: str, pattern: re.Pattern, code: str, new, issues: list, tables: bool) -> str:
    guard = Guard(text)

    def one(m: re.Match) -> str:
        if guard.code_or_url(m.start()) or tables and guard.table(m.start()):
            return m[0]
        to = new(m)
        issues.append((code, m.start(), m[0], to))
        return to

    return pattern.sub(one, text)


def _space(text: str, pattern: re.Pattern, code: str, issues: list) -> str:
    guard, out, last = Guard(text), [], 0
    for m in pattern.finditer(text):
        at = m.start()
        if text[at] in CJK_MARKS or text[at + 1] in CJK_MARKS or guard.code_or_url(at):
            continue
        issues.append((code, at, text[max(0, at - 5) : at + 7], " "))
        out += [text[last : at + 1], " "]
        last = at + 1
    return "".join([*out, text[last:]])


def typo_fix(text: str, digits: bool = False) -> tuple[str, list[tuple[str, int, str, str]]]:
    """The repaired text and the issues (code, position, found, expected) in the order of the steps."""
    issues: list[tuple[str, int, str, str]] = []
    parts = [x.removesuffix("\r") for x in text.split("\n")]
    for i, line in enumerate(parts):
        if line.startswith(" "):
            issues.append(("LeadingSpace", i, " ", ""))
        if line.endswith(" "):
            issues.append(("TrailingSpace", i, " ", ""))
    text = "\n".join(x if x.lstrip().startswith("|") else re.sub(" {3,}", "  ", x) for x in parts)
    text = re.sub(r"([。，、；：！？.,;:!])\1+", r"\1", text)
    text = _space(text, BOUNDARY, "MissingSpace", issues)
    if digits:
        text = _space(text, DIGIT_BOUNDARY, "MissingDigitSpace", issues)
    text = _rewrite(text, LATIN_MARK, "LatinPunctuation", lambda m: m[0].translate(TO_CJK), issues, True)
    text = _rewrite(text, BRACKET, "MixedBrackets", lambda m: m[0].translate(TO_CJK), issues, True)
    # a quote behind CJK opens, one before CJK only closes; both kinds are found in one text
    quotes = re.compile(f"{AFTER.pattern}|{BEFORE.pattern}")
    cjk = re.compile(f"[{CJK}]")

    def quote(m: re.Match) -> str:
        opens = m.start() > 0 and cjk.match(m.string[m.start() - 1]) is not None
        return ("“" if opens else "”") if m[0] == '"' else ("‘" if opens else "’")

    return _rewrite(text, quotes, "MixedQuotes", quote, issues, True), issues


def fix_column(df: DataFrame, column: str, digits: bool = False) -> DataFrame:
    """``df`` with ``column`` repaired, and typo_issues and n_fixes (issues) beside it; null stays null."""
    at = df.columns.index(column)
    kind = pa.list_(pa.struct([("code", pa.string()), ("pos", pa.int32()), ("found", pa.string()), ("expected", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(None, []) if t is None else typo_fix(t, digits) for t in b.column(at).to_pylist()]
            found = pa.array([[dict(zip(("code", "pos", "found", "expected"), x)) for x in i] for _, i in got], kind)
            cols = [pa.array([t for t, _ in got], pa.string()) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*cols, found, pa.array([len(i) for _, i in got], pa.int32())], names=[*b.schema.names, "typo_issues", "n_fixes"])

    issue = T.StructType([T.StructField("code", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("found", T.StringType()), T.StructField("expected", T.StringType())])
    own = [T.StructField("typo_issues", T.ArrayType(issue)), T.StructField("n_fixes", T.IntegerType())]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *own]))
