"""Label paths such as `Science -> Physics` as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgrove.functions.text import once, strip

# Fixed values, equal to the reference's.
SEPARATOR = " -> "
OTHERS = "Others"
FOLDER_LEVELS = 3

# How an answer was matched.
EXACT, CONTAINED, LAST_LEVEL, FALLBACK = 0, 1, 2, 3


def path_parts(path: Column) -> Column:
    """Labels of a path from the root down; `Others` for an empty path."""
    return F.when(path == "", F.array(F.lit(OTHERS))).otherwise(F.transform(F.split(path, SEPARATOR), strip))


def folder_parts(parts: Column) -> Column:
    """The levels that become folders."""
    return F.slice(parts, 1, FOLDER_LEVELS)


def tag_map(parts: Column) -> Column:
    """`{"tag1": [label], "tag2": [label], ...}` as a map."""
    names = F.transform(parts, lambda _, i: F.concat(F.lit("tag"), (i + 1).cast("string")))
    return F.map_from_arrays(names, F.transform(parts, lambda p: F.array(p)))


def tag_json(parts: Column) -> Column:
    return F.to_json(tag_map(parts))


def path_from_tags(json: Column) -> Column:
    """Label path from `{"tag1": [label], ...}` as JSON text."""

    def path(tags: Column) -> Column:
        names = F.sequence(F.lit(1), F.size(tags))
        parts = F.transform(names, lambda n: F.element_at(tags, F.concat(F.lit("tag"), n.cast("string")))[0])
        return F.array_join(parts, SEPARATOR)

    return once(F.from_json(json, "map<string,array<string>>"), path)


def tag_message(parts: Column) -> Column:
    """Line that shows all levels: a newline, then ` | Tag1: ... | Tag2: ...`."""
    tags = F.transform(parts, lambda p, i: F.concat(F.lit("Tag"), (i + 1).cast("string"), F.lit(": "), p))
    return F.concat(F.lit("\n | "), F.array_join(tags, " | "))
