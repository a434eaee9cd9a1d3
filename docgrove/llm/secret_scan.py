"""Secrets in texts: fixed patterns, and long tokens that pass a battery of randomness tests, with DataFrame operations only.

Patterns give the base spans. Besides, every run of token characters that is long enough and lies in no base span is tested:

1. Its encoding is inferred from the characters it has (hexadecimal, base 32, letters, letters and digits, base 64); this
   says which symbols there are and their order. Plain numbers are in no encoding, and not tested.
2. Three tests, each of whether the symbols may have been drawn evenly: chi-squared of their counts, the number of runs in
   the lower and upper half of the alphabet, and the correlation of each symbol with the next. Fisher's rule makes one p of
   the three; a low p speaks against chance.
3. Short ordinary words pass such tests easily, long ones hardly ever. How easily is measured: from every text a window
   of ordinary letters of each length class is taken, at a hashed place, and tested as well. In each class the least p that
   a token must have is the lowest grid value at which expected false discoveries (the share of ordinary windows that pass, times
   the tokens of that class) are at most `rate` of the tokens that pass. A class without such a value has no discoveries.

Rows are decided one by one; only counts by (class, grid value) are gathered. Null text is empty and has no spans. Texts are
read whole, however long; work is linear in them. Repeated rows each have a row, an id may be null, other columns are not read.
An empty table gives an empty result. Of spans with equal starts the order is that of KINDS.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrove.llm.tables import keep, narrow

# The base patterns. `assign` counts from eight characters in its second group on; the two others have
# their least length in the pattern, which finds the same spans as dropping shorter runs.
_WORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({_WORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_VALUE = 8
KINDS = ("assign", "access", "hex", "random")

#: A token to test, and what is cut away to get at ordinary letters.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ORDINARY = rf"{TOKEN}|[^A-Za-z0-9]+"
#: Least lengths of the length classes, grid of p, and the rate of false discoveries.
LENGTHS = (16, 24, 32, 48, 96)
GRID = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5)
RATE = 0.05
#: Elements of a block of a running sum.
BLOCK = 256

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (characters, what there must be as well, alphabet): the first that fits is the encoding.
ENCODINGS = (
    (r"^[0-9]+$", None, None),
    (r"^([0-9a-f]+|[0-9A-F]+)$", "[0-9]", _DIGITS + "abcdef"),
    (r"^[A-Z2-7]+$", "[0-9]", _UPPER + "234567"),
    (r"^[a-z]+$", None, _LOWER),
    (r"^[A-Z]+$", None, _UPPER),
    (r"^[A-Za-z]+$", None, _UPPER + _LOWER),
    (r"^[0-9a-z]+$", None, _DIGITS + _LOWER),
    (r"^[0-9A-Z]+$", None, _DIGITS + _UPPER),
    (r"^[0-9A-Za-z]+$", None, _DIGITS + _UPPER + _LOWER),
    (r"^[0-9A-Za-z+/]+$", None, _UPPER + _LOWER + _DIGITS + "+/"),
    (r"^[0-9A-Za-z_-]+$", None, _UPPER + _LOWER + _DIGITS + "-_"),
    (r"", None, _UPPER + _LOWER + _DIGITS + "+/-_="),
)


def _once(value: Column, use) -> Column:
    """`use(value)`, with the value computed once however often `use` refers to it."""
    return F.transform(F.array(value), use)[0]


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _total(values: Column) -> Column:
    return F.aggregate(values, _long(0), lambda s, x: s + x)


def running_sums(values: Column) -> Column:
    """Sums of an array of long up to and with each element; block totals keep the work well below quadratic."""

    def sums(x):
        blocks = F.sequence(F.lit(0), ((F.size(x) - 1) / BLOCK).cast("int"))
        totals = F.transform(blocks, lambda b: _total(F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))
        before = _once(totals, lambda t: F.transform(t, lambda _, b: _total(F.slice(t, F.lit(1), b))))
        return _once(before, lambda base: F.transform(
            x, lambda _, i: base[(i / BLOCK).cast("int")] + _total(F.slice(x, (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))
        ))

    return _once(values, lambda x: F.when(F.size(x) == 0, x).otherwise(sums(x)))


def occurrences(text: Column, pattern: str, measured: int = 0) -> tuple[Column, Column]:
    """What `pattern` matches in `text`, leftmost and without overlap, as structs of start and end (code points, end
    exclusive), value and n, the length of group `measured`; and the pieces between, with their starts."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = found if not measured else F.regexp_extract_all(text, F.lit(pattern), F.lit(measured))
    none = F.lit(None).cast("string")
    pieces = F.arrays_zip(gaps.alias("gap"), found.alias("value"), sizes.alias("sized"))
    whole = F.array(F.struct(text.alias("gap"), none.alias("value"), none.alias("sized")))
    pieces = F.when(text.rlike(pattern), pieces).otherwise(whole)  # most texts have no match

    def width(c):
        return F.coalesce(F.char_length(c), F.lit(0)).cast("long")

    def placed(p):
        ends = running_sums(F.transform(p, lambda x: width(x["gap"]) + width(x["value"])))
        return F.zip_with(p, ends, lambda x, end: F.struct(
            (end - width(x["value"])).alias("start"), end.alias("end"), x["value"].alias("value"), F.char_length(x["sized"]).alias("n"),
            x["gap"].alias("gap"), (end - width(x["value"]) - width(x["gap"])).alias("gap_start"),
        ))

    whole = _once(pieces, placed)
    return F.filter(whole, lambda x: x["value"].isNotNull()), whole


def _alphabet(value: Column) -> Column:
    """The symbols of the encoding inferred for a token, in order; null for a plain number."""
    found = None
    for characters, also, symbols in ENCODINGS:
        fits = value.rlike(characters) & (value.rlike(also) if also else F.lit(True))
        found = F.when(fits, F.lit(symbols)) if found is None else found.when(fits, F.lit(symbols))
    return found


def _above(z: Column) -> Column:
    """The normal distribution's share above z: the complementary error function by its usual rational form."""

    def share(z):
        x = F.abs(z) / math.sqrt(2)
        poly = _once(1 / (1 + 0.3275911 * x), lambda t: t * (
            0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))))
        return _once(0.5 * poly * F.exp(-x * x), lambda tail: F.when(z >= 0, tail).otherwise(1 - tail))

    return _once(z, share)


def _battery(value: Column, symbols: Column) -> Column:
    """One p of the three tests, for a token all of whose characters are among `symbols`."""
    n, k = F.char_length(value).cast("double"), F.char_length(symbols).cast("double")
    zero = F.lit(0.0)
    start = F.struct(F.lit(-1.0).alias("last"), zero.alias("runs"), zero.alias("high"), zero.alias("x"), zero.alias("xx"), zero.alias("xy"))

    def step(s, x):
        first, high = s["last"] < 0, x * 2 >= k
        return F.struct(
            x.alias("last"), (s["runs"] + (first | ((s["last"] * 2 >= k) != high)).cast("double")).alias("runs"),
            (s["high"] + high.cast("double")).alias("high"), (s["x"] + x).alias("x"), (s["xx"] + x * x).alias("xx"),
            (s["xy"] + F.when(first, 0.0).otherwise(s["last"] * x)).alias("xy"),
        )

    def tests(codes):
        def combine(s):
            squares = F.aggregate(F.filter(F.split(symbols, ""), lambda c: c != ""), zero, lambda t, c: t + F.pow(n - F.char_length(F.replace(value, c, F.lit(""))), F.lit(2)))
            df = k - 1
            cube = F.cbrt(F.greatest(k / n * squares - n, zero) / df)
            chi = (cube - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
            both = 2 * s["high"] * (n - s["high"])
            spread = both * (both - n) / (n * n * (n - 1))
            runs = F.when(spread <= 0, 9.0).otherwise((s["runs"] - both / n - 1) / F.sqrt(F.greatest(spread, F.lit(1e-9))))
            varied = n * s["xx"] - s["x"] * s["x"]
            serial = (n * (s["xy"] + s["last"] * codes[0]) - s["x"] * s["x"]) / F.greatest(varied, F.lit(1e-9))
            serial = F.when(varied <= 0, 9.0).otherwise((serial + 1 / (n - 1)) / (n / ((n - 1) * F.sqrt(n - 2))))
            each = [_above(chi), 2 * _above(F.abs(runs)), 2 * _above(F.abs(serial))]
            half = -reduce(lambda a, b: a + b, [F.log(F.greatest(p, F.lit(1e-12))) for p in each])
            return _once(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

        return _once(F.aggregate(codes, start, step), combine)

    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: (F.instr(symbols, c) - 1).cast("double"))
    return _once(codes, tests)


def randomness(token: Column) -> Column:
    """p of a token under even random symbols of its encoding; null for plain numbers and tokens that are too short."""

    def judged(v):
        def of(symbols):
            folded = F.when(F.char_length(symbols) == 16, F.lower(v)).otherwise(v)
            return F.when(symbols.isNotNull() & (F.char_length(v) >= LENGTHS[0]), _once(folded, lambda w: _battery(w, symbols)))

        return _once(_alphabet(v), of)

    return _once(F.regexp_replace(token, "=+$", ""), judged)


def _steps(value: Column, edges) -> Column:
    """How many of the edges are at most `value`; null for null."""
    return _once(value, lambda x: reduce(lambda a, b: a + b, [(x >= e).cast("int") for e in edges]))


def _judged(tokens: Column, token, *kept) -> Column:
    """Of an array of structs those that can be tested: the kept fields, length class and number of grid values reached."""

    def of(x):
        return F.struct(*[x[f].alias(f) for f in kept], (_steps(F.char_length(token(x)), LENGTHS) - 1).alias("class"), _steps(randomness(token(x)), GRID).alias("level"))

    return F.filter(F.transform(tokens, of), lambda x: x["level"].isNotNull())


def _ordinary(text: Column) -> Column:
    """A window of ordinary letters of each length class, as far as the text has so many."""
    place = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    letters = F.regexp_replace(text, ORDINARY, "")

    def windows(x):
        found = [F.when(F.char_length(x) >= n, F.struct(F.substr(x, (place % (F.char_length(x) - n + 1) + 1).cast("int"), F.lit(n)).alias("value"))) for n in LENGTHS]
        return F.filter(F.array(*found), lambda w: w.isNotNull())

    return _once(letters, windows)


def _found(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, base, tokens, windows): base spans as (start, kind's number, end), tested tokens and ordinary windows."""
    plain = narrow(docs, id_column, text).select(F.col(id_column), F.coalesce(F.col(text), F.lit("")).alias("text"))
    body = F.col("text")

    def spans(number, pattern):
        return F.transform(occurrences(body, pattern)[0], lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end")))

    def outside(pieces):
        """Tokens in the pieces between assignments, but for those that hold a base span of another kind."""
        def of(piece):
            inner = F.filter(occurrences(piece["gap"], TOKEN)[0], lambda x: ~x["value"].rlike(HEX) & ~x["value"].rlike(ACCESS))
            return F.transform(inner, lambda x: F.struct(
                (piece["gap_start"] + x["start"]).alias("start"), (piece["gap_start"] + x["end"]).alias("end"), x["value"].alias("value")))

        return F.flatten(F.transform(F.filter(pieces, lambda p: p["gap"].rlike(TOKEN)), of))

    pieces = plain.select(id_column, "text", occurrences(body, ASSIGN, 2)[1].alias("pieces"))
    assigned = F.filter(F.col("pieces"), lambda x: x["n"] >= ASSIGN_VALUE)
    assigned = F.transform(assigned, lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("kind"), x["end"].alias("end")))
    return pieces.select(
        id_column,
        F.array_sort(F.concat(assigned, spans(1, ACCESS), spans(2, HEX))).alias("base"),
        _judged(outside(F.col("pieces")), lambda x: x["value"], "start", "end").alias("tokens"),
        _judged(_ordinary(body), lambda x: x["value"]).alias("windows"),
    )


def discovery_levels(found: DataFrame, rate: float = RATE) -> DataFrame:
    """(class, level): the grid value tokens of a length class must reach; classes without one are absent. At most
    len(LENGTHS) rows, from counts of at most len(LENGTHS) * (len(GRID) + 1)."""

    def cells(column: str, token: int) -> Column:
        return F.transform(column, lambda x: F.struct(x["class"].alias("class"), x["level"].alias("level"), F.lit(token).alias("token")))

    rows = found.select(F.explode(F.concat(cells("tokens", 1), cells("windows", 0))).alias("x")).groupBy("x.class", "x.level")
    counts = rows.agg(F.sum("x.token").alias("tokens"), F.sum(1 - F.col("x.token")).alias("windows"))
    whole = Window.partitionBy("class")
    upward = whole.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = counts.select(
        "class", "level", F.sum("tokens").over(whole).alias("all_tokens"), F.sum("windows").over(whole).alias("all_windows"),
        F.sum("tokens").over(upward).alias("tokens"), F.sum("windows").over(upward).alias("windows"),
    )
    false_share = (F.col("windows") + 1) / (F.col("all_windows") + 1) * F.col("all_tokens")
    return shares.filter((F.col("tokens") > 0) & (false_share <= rate * F.col("tokens"))).groupBy("class").agg(F.min("level").alias("level"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end by start) and n_random."""
    found = keep(_found(docs, id_column, text), "secrets")
    levels = {r["class"]: r["level"] for r in discovery_levels(found, rate).collect()}
    added = F.filter(F.col("tokens"), lambda x: reduce(
        lambda a, b: a | b, [(x["class"] == c) & (x["level"] >= least) for c, least in sorted(levels.items())], F.lit(False)))
    added = F.transform(added, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))

    def number(kind):
        return F.size(F.filter(F.col("base"), lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        id_column, number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", added))).alias("spans"), F.size(added).cast("long").alias("n_random"),
    )
