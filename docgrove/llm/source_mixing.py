"""Mixing sources to target weights by budgets on a tree, with DataFrame operations only.

Leaves are the distinct values of the level columns (domain, language, source). A node can give at most `max_epochs` times its
tokens. From the root down, a node's budget is split among its children by weight; a child that cannot use its share
gives the rest to its siblings by weight, again and again until all fits. A node's budget never exceeds what its whole
subtree can give, so a shortage leaves a family only when every sibling is exhausted, and then goes to the siblings of
the parent. All amounts are whole tokens.

A leaf's budget is spent on seeded epochs: whole epochs take every document, the last one the documents first in its
own random order (by a hash of seed, epoch, id and text) while their tokens fit. Where an order ends is found by totals
per hash prefix, three digits at a time: no window is larger than 4096 rows or one such prefix's documents, and no
document is moved. In the end a row compares its hash with its leaf's cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrove.llm.tables import free_name, keep

SEED, MAX_EPOCHS = 17, 4
#: Hex digits of the hash per step of the search for a cut.
DIGITS, STEPS = 3, 2


def token_count(text: Column) -> Column:
    """Runs of other than white space; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _order(epoch: Column, seed: int, doc_id: Column, text: Column) -> Column:
    """A document's place in the order of an epoch, as hex digits. Only equal rows have equal places."""
    own = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), own, F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def split_budget(nodes: DataFrame, parent: list[str], node: str) -> DataFrame:
    """nodes: parent columns, node, weight, capacity, given (what the parent has) -> the same with `budget`."""
    exact = "decimal(38,0)"
    by_need = Window.partitionBy(*parent).orderBy(F.expr("case when weight > 0 then capacity / weight else 0 end"), node)
    upto = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nodes = nodes.withColumn("capacity", F.expr("case when weight > 0 then capacity else 0 end"))
    nodes = nodes.withColumn("before", F.coalesce(F.sum("capacity").over(upto), F.lit(0))).withColumn("rest", F.sum("weight").over(onward))
    nodes = nodes.withColumn("full", F.expr(f"cast(capacity as {exact}) * rest <= cast(given - before as {exact}) * weight"))
    family = Window.partitionBy(*parent)
    nodes = nodes.withColumn("left", F.col("given") - F.sum(F.expr("case when full then capacity else 0 end")).over(family))
    nodes = nodes.withColumn("open", F.sum(F.expr("case when full then 0 else weight end")).over(family))
    sums = F.sum(F.expr("case when full then 0 else weight end")).over(Window.partitionBy(*parent).orderBy(node))
    nodes = nodes.withColumn("sums", sums)
    share = f"cast(cast(left as {exact}) * {{}} div open as long)"
    part = f"{share.format('sums')} - {share.format('(sums - weight)')}"
    budget = F.expr(f"case when full then capacity when open > 0 then {part} else 0 end").cast("long")
    return nodes.withColumn("budget", budget).drop("before", "rest", "full", "left", "open", "sums")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, Column], budget: int | None, max_epochs: int) -> DataFrame:
    """leaves: levels and tokens -> with `budget`. budget: tokens wanted in all, by default as many as there are."""
    own = [f"w{i}" for i in range(len(levels))]
    tree = leaves.withColumns({w: F.greatest(weights.get(c, F.lit(1)).cast("long"), F.lit(0)) for w, c in zip(own, levels)})
    # What no weighted path leads to can give nothing.
    reached = F.lit(True)
    for w in own:
        reached = reached & (F.col(w) > 0)
    tree = tree.withColumn("capacity", F.when(reached, F.col("tokens") * max_epochs).otherwise(0))
    wanted = F.sum("tokens") if budget is None else F.lit(budget).cast("long")
    above = tree.agg(F.least(wanted, F.sum("capacity")).alias("given")).withColumn("root", F.lit(0))
    parent = ["root"]
    tree = tree.withColumn("root", F.lit(0))
    for i, level in enumerate(levels):
        nodes = tree.groupBy("root", *levels[: i + 1]).agg(F.max(own[i]).alias("weight"), F.sum("capacity").alias("capacity"))
        split = split_budget(nodes.join(above, parent), parent, level)
        parent = ["root", *levels[: i + 1]]
        above = split.select(*parent, F.col("budget").alias("given"))
    return leaves.join(above.drop("root").withColumnRenamed("given", "budget"), levels)


def leaf_cuts(rows: DataFrame, plan: DataFrame, levels: list[str]) -> DataFrame:
    """plan: levels, epochs (whole ones), rest (tokens of the last) -> with `cut`: the last hash that is taken, "" if none.
    rows: levels, place (hash for the last epoch), tokens."""
    at = plan.select(*levels, "rest", F.lit("").alias("prefix"), F.lit("").alias("cut"))
    for step in range(STEPS + 1):
        size = DIGITS * (step + 1) if step < STEPS else 32
        below = rows.join(at, levels).filter(F.expr(f"substring(place, 1, {DIGITS * step}) = prefix"))
        part = F.expr(f"substring(place, 1, {size})").alias("part")
        totals = below.groupBy(*levels, "rest", "cut", part).agg(F.sum("tokens").alias("tokens"))
        upto = F.sum("tokens").over(Window.partitionBy(*levels).orderBy("part"))
        totals = totals.withColumn("upto", upto)
        fits = F.col("upto") <= F.col("rest")
        found = totals.groupBy(*levels, "rest", "cut").agg(
            F.max(F.when(fits, F.col("part"))).alias("whole"),
            F.min(F.when(~fits, F.col("part"))).alias("prefix"),
            F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("spent"),
        )
        # All hashes that begin with `whole` are taken: it is followed by the greatest digit.
        cut = F.coalesce(F.rpad("whole", 32, "f"), F.col("cut"))
        at = keep(found.select(*levels, (F.col("rest") - F.col("spent")).alias("rest"), F.col("prefix"), cut.alias("cut")), "cuts")
        # Where all of a step fits there is nothing to look at below; a null prefix matches no row, so keep those cuts.
        done = at.filter("prefix is null").select(*levels, "cut")
        ends = done if step == 0 else ends.unionByName(done)
        at = at.filter("prefix is not null")
    return plan.join(ends.unionByName(at.select(*levels, "cut")), levels, "left").withColumn("cut", F.coalesce("cut", F.lit("")))


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, Column], budget: int | None = None, seed: int = SEED,
        max_epochs: int = MAX_EPOCHS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, each as often as epochs take it, with a column `epoch` (underscores are added to its name where
    `docs` has one so called).

    levels: name and column of each level from the top; null values are a node "". weights: for a level, whole-number
    weights as a column over the levels' names; 1 where none is given; nodes with weight 0 or null get nothing. Tokens are words.
    Rows without words cost nothing; they are taken with the epochs of their leaf in which they come before the cut.
    Rows that are equal in id and text are taken or left together. An empty table gives an empty one.
    """
    names = [f"level_{i}" for i in range(len(levels))]
    named = {n: F.coalesce(c.cast("string"), F.lit("")) for n, c in zip(names, levels.values())}
    given = dict(zip(levels, names))
    own_id, own_text = F.col(f"`{id_column}`"), F.col(f"`{text}`")
    slim = docs.select(*[c.alias(n) for n, c in named.items()], own_id.alias("id"), own_text.alias("text"))

    counted = slim.select(*names, token_count(F.col("text")).alias("tokens"))
    leaves = keep(counted.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "leaves")
    readable = leaves.select(*[F.col(n).alias(level) for level, n in given.items()], "tokens")
    budgets = leaf_budgets(readable, list(levels), {k: F.coalesce(w, F.lit(0)) for k, w in weights.items()}, budget, max_epochs)
    plan = budgets.select(
        *[F.col(level).alias(n) for level, n in given.items()],
        F.expr("case when tokens > 0 then budget div tokens else 0 end").alias("epochs"),
        F.expr("case when tokens > 0 then budget % tokens else 0 end").alias("rest"),
    )
    plan = keep(plan, "plan")
    placed = slim.join(plan, names).select(*names, "rest", _order(F.col("epochs"), seed, F.col("id"), F.col("text")).alias("place"),
                                           token_count(F.col("text")).alias("tokens")).drop("rest")
    cuts = keep(leaf_cuts(keep(placed, "places"), plan, names), "leaf_cuts")

    epoch = free_name(docs, "epoch")
    inner = [free_name(docs, f"{n}_") for n in names]
    epochs, cut = free_name(docs, "epochs_"), free_name(docs, "cut_")
    cuts = cuts.select(*[F.col(n).alias(i) for n, i in zip(names, inner)], F.col("epochs").alias(epochs), F.col("cut").alias(cut))
    joined = docs.withColumns(dict(zip(inner, named.values()))).join(cuts, inner)
    in_last = _order(F.col(epochs), seed, own_id, own_text) <= F.col(cut)
    times = F.col(epochs) + in_last.cast("long")
    joined = joined.withColumn(epoch, F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1))))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(epoch).cast("int").alias(epoch))


def document_levels() -> dict[str, Column]:
    """The levels of the table `documents`: its sources are numbered, and every fourth belongs to one domain."""
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    domain = F.when(number != "", F.concat(F.lit("domain"), (F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint)") % 4).cast("string")))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def _choice(column: str, values: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, weight in values.items():
        out = F.when(F.col(column) == name, F.lit(weight)).otherwise(out)
    return out


#: Target weights of the query and the pipeline; sources of one language share evenly.
DOMAIN_WEIGHTS = {"domain0": 40, "domain1": 30, "domain2": 20, "domain3": 10}
LANG_WEIGHTS = {"en": 50, "de": 20, "fr": 20, "es": 10}
OTHER_WEIGHT = 5


def document_weights() -> dict[str, Column]:
    return {"domain": _choice("domain", DOMAIN_WEIGHTS, OTHER_WEIGHT), "lang": _choice("lang", LANG_WEIGHTS, OTHER_WEIGHT)}
