"""Answers matched against a label tree by lookups in an index, not path by path.

An answer takes the first path, in pre-order, that equals it; else the first that lies inside it or around it; else the first
with the same last level; else `Others`, which an empty answer takes as well.

The index has rows `(kind, key, n, ord_path, path)`:

- EXACT: the path by itself, LAST: by what stands behind each of its separators, and by itself;
- INSIDE: by its rarest gram (GRAM characters), to be met by answers that have this gram; paths shorter than that by themselves;
- AROUND: by each of its grams, with `n`, the number of paths that have it: an answer asks for its rarest gram only;
- FIRST: each shorter run of characters with the first path that has it, all that a shorter answer asks for.

Only different answers are looked up. Candidates of INSIDE and AROUND are checked by the texts themselves, so the choice
of grams decides how many are looked at, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrove.functions.labels import CONTAINED, EXACT, FALLBACK, LAST_LEVEL, OTHERS, SEPARATOR

GRAM = 5
_EXACT, _LAST, _INSIDE, _AROUND, _FIRST = "exact", "last", "inside", "around", "first"


def _runs(text: Column, length: int) -> Column:
    """The different runs of `length` characters of a text."""
    starts = F.sequence(F.lit(1), F.char_length(text) - length + 1)
    runs = F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(length))))
    return F.when(F.char_length(text) >= length, runs).otherwise(F.array().cast("array<string>"))


def _short_runs(text: Column) -> Column:
    return F.concat(*[_runs(text, n) for n in range(1, GRAM)])


def _behind_separators(path: Column) -> Column:
    """The path, and what stands behind each separator in it; separators may overlap."""
    size = len(SEPARATOR)
    starts = F.filter(F.sequence(F.lit(1), F.char_length(path)), lambda i: F.substr(path, i, F.lit(size)) == SEPARATOR)
    return F.concat(F.array(path), F.transform(starts, lambda i: F.substr(path, i + size, F.char_length(path))))


def label_index(taxonomy: DataFrame) -> DataFrame:
    """The index of a label tree; stage it where several tables are matched."""
    paths = taxonomy.filter("path <> ''").groupBy("path").agg(F.min("ord_path").alias("ord_path"))

    def rows(frame: DataFrame, kind: str, key: Column, n: Column | None = None) -> DataFrame:
        number = F.lit(None).cast("long") if n is None else n
        return frame.select(F.lit(kind).alias("kind"), key.alias("key"), number.alias("n"), "ord_path", "path")

    path = F.col("path")
    grams = paths.select("ord_path", "path", F.explode(_runs(path, GRAM)).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counted = grams.join(counts, "gram")
    rarest = counted.groupBy("path").agg(F.min("ord_path").alias("ord_path"), F.min(F.struct("n", "gram")).alias("least"))
    first = paths.select("ord_path", "path", F.explode(_short_runs(path)).alias("run"))
    first = first.groupBy("run").agg(F.min(F.struct("ord_path", "path")).alias("first")).select("run", "first.*")
    parts = [
        rows(paths, _EXACT, path),
        rows(paths.select("ord_path", "path", F.explode(_behind_separators(path)).alias("last")), _LAST, F.col("last")),
        rows(rarest, _INSIDE, F.col("least.gram")),
        rows(paths.filter(F.char_length(path) < GRAM), _INSIDE, path),
        rows(counted, _AROUND, F.col("gram"), F.col("n")),
        rows(first, _FIRST, F.col("run")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def match_answers(answers: DataFrame, index: DataFrame) -> DataFrame:
    """`(answer, path, tier)` for each different value of `answer` but null."""
    given = answers.select("answer").distinct().filter("answer is not null")
    answer = F.col("answer")
    long = F.char_length(answer) >= GRAM
    last = F.element_at(F.split(answer, SEPARATOR), -1)

    def ask(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    asked = F.concat(
        ask(_EXACT, F.array(answer)),
        ask(_LAST, F.array(last)),
        ask(_INSIDE, F.concat(_runs(answer, GRAM), _short_runs(answer))),
        ask(_FIRST, F.when(long, F.array().cast("array<string>")).otherwise(F.array(answer))),
    )
    looked = given.filter("answer <> ''").select("answer", F.explode(asked).alias("asked")).select("answer", "asked.*")
    tier = F.when(F.col("kind") == _EXACT, EXACT).when(F.col("kind") == _LAST, LAST_LEVEL).otherwise(CONTAINED)
    found = looked.join(index.drop("n"), ["kind", "key"]).filter((F.col("kind") != _INSIDE) | answer.contains(F.col("path")))
    found = found.select("answer", F.struct(tier.alias("tier"), "ord_path", "path").alias("match"))

    # Paths around a longer answer: all of its grams must be there, and its rarest leads to the candidates.
    around = index.filter(F.col("kind") == _AROUND)
    known = around.select("key", "n").distinct()
    grams = given.filter(long).select("answer", F.explode(_runs(answer, GRAM)).alias("key"))
    least = grams.join(known, "key", "left").groupBy("answer").agg(
        F.min(F.struct("n", "key")).alias("least"), F.count_if(F.col("n").isNull()).alias("absent")
    )
    wanted = least.filter("absent = 0").select("answer", F.col("least.key").alias("key"))
    wider = wanted.join(around.drop("n", "kind"), "key").filter(F.col("path").contains(answer))
    wider = wider.select("answer", F.struct(F.lit(CONTAINED).alias("tier"), "ord_path", "path").alias("match"))

    best = found.unionByName(wider).groupBy("answer").agg(F.min("match").alias("match"))
    is_others = answer == OTHERS
    return given.join(best, "answer", "left").select(
        "answer",
        F.when(is_others, F.lit(OTHERS)).otherwise(F.coalesce("match.path", F.lit(OTHERS))).alias("path"),
        F.when(is_others, F.lit(EXACT)).otherwise(F.coalesce("match.tier", F.lit(FALLBACK))).alias("tier"),
    )
