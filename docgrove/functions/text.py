"""Text rules as native columns. Whitespace means all the characters Unicode text stripping removes,
not only the blank that `trim` knows."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
_VISIBLE = r"(?U)[^\s\x1c-\x1f]"

# Fixed values, equal to the reference's: label before the title in a request, label that may
# precede an answer.
TITLE_LABEL = "标题: "
ANSWER_LABEL = "分类结果："


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` for a `use` that refers to its argument several times: the value is computed once, and
    the plan does not repeat its expression."""
    return F.transform(F.array(value), use)[0]


def has_body(content: Column) -> Column:
    """True if there is anything but whitespace; false for null."""
    return F.coalesce(content.rlike(_VISIBLE), F.lit(False))


def content_hash(content: Column) -> Column:
    """SHA-256 of the whole body; null counts as empty."""
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def prepare_text(content: Column, title: Column) -> Column:
    """The whole body under its title line, if it has a title."""
    body = F.coalesce(content, F.lit(""))
    headed = F.concat(F.lit(TITLE_LABEL), title, F.lit("\n\n"), body)
    return F.when(F.coalesce(title, F.lit("")) != "", headed).otherwise(body)


def template_pieces(template: str, names: Iterable[str]) -> list[tuple[str, bool]]:
    """The template cut at each `{name}`: pieces, and whether a piece is a name. What is put in is never cut again."""
    cut = re.split("(" + "|".join(re.escape(f"{{{name}}}") for name in names) + ")", template)
    return [(p[1:-1], True) if i % 2 else (p, False) for i, p in enumerate(cut) if p]


def fill_template(template: str, **values: Column) -> Column:
    """The template with a column in place of each `{name}`; anything else in braces stays as it is."""
    return F.concat(*[values[p] if named else F.lit(p) for p, named in template_pieces(template, values)])


def request_filler(template: str, **fixed: str) -> Callable[[str], str]:
    """A function that puts a document into the template's `{text}`; `fixed` has what stands for other names."""
    pieces = template_pieces(template, ["text", *fixed])
    return lambda text: "".join(p if not named else text if p == "text" else fixed[p] for p, named in pieces)


def request_length(template: str, **values: Column) -> Column:
    """Characters of the filled template, without making it."""
    parts = [F.length(values[p]) if named else F.lit(len(p)) for p, named in template_pieces(template, values)]
    return reduce(operator.add, [p.cast("bigint") for p in parts], F.lit(0).cast("bigint"))


def clean_response(raw: Column) -> Column:
    """The label path in a raw model answer: without code fences, quotes, answer label, further lines."""
    answer = strip(F.coalesce(raw, F.lit("")))
    answer = F.regexp_replace(answer, r"\A```json", "")
    answer = F.regexp_replace(answer, r"\A```", "")
    answer = F.regexp_replace(answer, r"```\z", "")
    answer = strip(answer)
    answer = F.regexp_replace(answer, r'\A"+|"+\z', "")
    answer = F.regexp_replace(answer, r"\A'+|'+\z", "")

    def unlabelled(a: Column) -> Column:
        return F.when(a.startswith(ANSWER_LABEL), strip(F.replace(a, F.lit(ANSWER_LABEL), F.lit("")))).otherwise(a)

    def first_line(a: Column) -> Column:
        return F.when(a.contains("\n"), strip(F.substring_index(a, "\n", 1))).otherwise(a)

    return once(once(answer, unlabelled), first_line)


def annotated_body(tag_line: Column, content: Column) -> Column:
    """A body under its tag line; null without a tag line."""
    line = F.coalesce(tag_line, F.lit(""))
    return F.when(line != "", F.concat(line, F.lit("\n"), F.coalesce(content, F.lit(""))))
