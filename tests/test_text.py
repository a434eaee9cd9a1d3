import random
import sys
from hashlib import sha256

from pyspark.sql import functions as F

from docgrove.functions import text

BLANKS = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
NEAR_BLANKS = ["​", "᠎", "﻿", "\x1b", "\x00x", "⁠"]


def _strings(count, alphabet, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randrange(12))) for _ in range(count)]


def _applied(spark, values, column):
    df = spark.createDataFrame(list(enumerate(values)), "n int, c string")
    return [row[0] for row in df.orderBy("n").select(column).collect()]


def test_strip_and_body_follow_python(spark):
    values = _strings(3000, BLANKS + NEAR_BLANKS + ["a", "é", "標"], 1)
    assert _applied(spark, values, text.strip(F.col("c"))) == [v.strip() for v in values]
    values.append(None)
    assert _applied(spark, values, text.has_body(F.col("c"))) == [bool((v or "").strip()) for v in values]


def test_hash_of_whole_body(spark):
    values = ["", None, "é" * 5000, "a　b"]
    assert _applied(spark, values, text.content_hash(F.col("c"))) == [
        sha256((v or "").encode()).hexdigest() for v in values
    ]


def test_prepare_text(spark):
    rows = [("body", "T"), ("body", ""), ("body", None), (None, "T"), ("𝒳é" * 3000, "T")]
    df = spark.createDataFrame(rows, "content string, title string")
    whole = text.prepare_text(F.col("content"), F.col("title"))
    got = df.select(whole).collect()
    for (content, title), (full,) in zip(rows, got):
        head = f"标题: {title}\n\n" if title else ""
        assert full == head + (content or "")


def test_fill_template_leaves_other_braces(spark):
    column = text.fill_template("{x} {outline}|{text}{}", outline=F.lit("A{text}"), text=F.lit("B"))
    assert spark.range(1).select(column).first()[0] == "{x} A{text}|B{}"
    template, outline, body = "{x} {outline}|{text}{}", "A{text}", "B{outline}"
    assert text.request_filler(template, outline=outline)(body) == "{x} A{text}|B{outline}{}"
    length = text.request_length(template, outline=F.lit(outline), text=F.lit(body))
    assert spark.range(1).select(length).first()[0] == len("{x} A{text}|B{outline}{}")


def _clean(raw):
    """The cleaning rules, one after the other."""
    a = (raw or "").strip()
    for fence in ("```json", "```"):
        a = a.removeprefix(fence)
    a = a.removesuffix("```").strip()
    while a[:1] == '"':
        a = a[1:]
    while a[-1:] == '"':
        a = a[:-1]
    while a[:1] == "'":
        a = a[1:]
    while a[-1:] == "'":
        a = a[:-1]
    if a.startswith("分类结果："):
        a = "".join(a.split("分类结果：")).strip()
    lines = a.split("\n")
    return lines[0].strip() if len(lines) > 1 else a


def test_clean_response(spark):
    values = _strings(4000, ["```json", "```", '"', "'", "\n", " ", "　", "\r", "分类结果：", "A -> B", "x"], 2)
    values += [None, "", '" A "', "分类结果：分类结果： A\nB", "```json\n\"A -> B\"\n```", "A\r\nB", "```JSON A```"]
    cleaned = _applied(spark, values, text.clean_response(F.col("c")))
    assert cleaned == [_clean(v) for v in values]
