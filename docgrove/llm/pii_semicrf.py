"""Personal data by fixed rules and, beyond them, by a semi-Markov conditional random field.

The rules find e-mail addresses, IP addresses, card and phone numbers in a standard form. The field finds the same kinds in other
forms. It works on the places where such data can be: runs of chunks around digits, at signs and their written-out forms.
Chunks end at white space, at punctuation that is in no entity, and where a script without spaces begins or ends. In each
place it scores segments as a whole (shape, number of digits, check sum, separators, what stands left and right) for every
kind, and dynamic programming over segment ends chooses boundaries and kinds of all entities together.

A segment is any run of up to NEAR chunks, and any longer one that can be an entity still: chunks without letters with no more
digits than a card has, or one address of chunks linked by at and dot marks. A chunk begins few segments of either sort, so
the work grows with the number of chunks, and a place may be as long as its text.

The weights are learnt by stochastic gradient on the exact log-likelihood (forward and backward sums over the same
segments) in one task, from a bounded sample of documents: the rules' spans are the entities. Each place is learnt in
a second form, too, in which the entities are rewritten as people do to evade rules (no plus sign, other separators,
at and dot in brackets); what the rules left alone stays without entity in both.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrove.llm.labels import least_hashes
from docgrove.llm.tables import narrow
from docgrove.llm.words import release, text_column

KINDS = ("email", "ip", "card", "phone")
NEAR, AROUND = 5, 2
#: Documents with digits or at signs that the field learns from at most: those with the least hash of their text.
LEARN_MAX, EPOCHS, RATE, DECAY = 3000, 4, 0.3, 1e-6
BITS = 14
#: Evidence an entity needs before it is added to what the rules found.
MARGIN = 2.0
#: Texts of a batch that are masked at once.
MASK_ROWS = 64

# The rules' patterns and bounds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, IP_MOST = (13, 19), (9, 15), 255
#: The parts of EMAIL, and IP from the start of a run of digits only: where it fails there, it fails within the run as well.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP_AT_RUN = re.compile(r"(?<![0-9])" + IP.pattern)
#: Longest address there is: a local part of 64 characters, the at sign and a domain of 255.
ADDRESS_MOST = 320

_TRIGGER = re.compile(r"[0-9@]|[\[({]\s?(?:at|AT|At|dot|DOT|Dot)\s?[\])}]")
_MARK = re.compile(r"[\[({]\s?(?:at|dot)\s?[\])}]|@", re.I)
_AT = re.compile(r"[\[({]\s?at\s?[\])}]|@", re.I)
#: Scripts that are written without spaces.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"
_CHUNK = re.compile(
    r"(?:[\[({]\s?(?i:at|dot)\s?[\])}]"  # a mark
    r"|(?<![0-9])[0-9]{1,3}(?:,[0-9]{3})+(?![0-9])"  # thousands
    r"|(?<=[0-9]):(?=[0-9])"
    rf"|[^\s\",;:|<>=&{_UNSPACED}])+|[{_UNSPACED}]+"
)
_EDGE = ".,;:!?\"'`|<>*#&$%=~"
_PAIRS = {"]": "[", "}": "{"}
_RUNS = re.compile(r"[0-9]+|[^\W\d_]+|\s+")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What EMAIL finds, in time linear in the text: from each at sign back over its local part, which no other at sign
    shares, and on over its domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        end = _DOMAIN.match(text, at + 1)
        if end:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, end.end()
                done = end.end()
        at = text.find("@", max(done, at + 1))


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) by kind and start. A match that fails its test is dropped, not tried again."""
    spans = [(0, a, b) for a, b in _emails(text)]
    for m in _IP_AT_RUN.finditer(text) if text.count(".") > 2 else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= IP_MOST for p in m[0].split(".")):
            spans.append((1, *m.span()))
    for m in CARD.finditer(text):
        number = digits(m[0])
        if CARD_DIGITS[0] <= len(number) <= CARD_DIGITS[1] and luhn(number):
            spans.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if PHONE_DIGITS[0] <= len(digits(m[0])) <= PHONE_DIGITS[1]:
                spans.append((3, *m.span()))
    return spans


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A chunk without punctuation at its edges, nor brackets of which it holds one side only."""
    while a < b and (text[a] in _EDGE or text[a] in "[{" and text.find("]" if text[a] == "[" else "}", a, b) < 0):
        a += 1
    while b > a and (text[b - 1] in _EDGE or text[b - 1] in _PAIRS and text.find(_PAIRS[text[b - 1]], a, b) < 0):
        b -= 1
    return a, b


def places(text: str) -> list[list[tuple[int, int]]]:
    """Runs of chunks around triggers: each chunk as start and end without punctuation at its edges."""
    found: list[list[tuple[int, int]]] = []
    done = 0
    for m in _TRIGGER.finditer(text):
        if m.start() < done:
            continue
        left = m.start()
        words = 0
        while left > done and words <= AROUND:  # back over the trigger's own word and AROUND more, dots by themselves not counted
            while left > done and text[left - 1].isspace():
                left -= 1
            end = left
            while left > done and not text[left - 1].isspace():
                left -= 1
            words += text[left:end] != "."
        chunks: list[tuple[int, int]] = []
        last = -1
        for chunk in _CHUNK.finditer(text, left):
            a, b = chunk.span()
            if b > m.start() and (a < m.end() or _TRIGGER.search(text, a, b) or text[a:b] == "."):
                if last < 0:
                    while len(chunks) > AROUND and sum(text[c:d] != "." for c, d in chunks[1:]) >= AROUND:
                        del chunks[0]
                last = len(chunks)
            if a >= m.end() and len(chunks) > last + AROUND:
                break
            chunks.append((a, b))
            done = b
        trimmed = [(a, b) for a, b in (_trimmed(text, *c) for c in chunks) if a < b]
        if trimmed:
            found.append(trimmed)
        done = max(done, m.end())
    return found


def _place(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << BITS) - 1)


def features(text: str, a: int, b: int, chunks: int) -> array:
    """The places of a segment's features, none that depends on its kind."""
    own = text[a:b]
    number = digits(own)
    n = len(number)
    shape = _RUNS.sub(lambda m: "9" if m[0][0].isdigit() else " " if m[0].isspace() else "a", own)[:32]
    lengths = "-".join(str(min(len(r), 9)) for r in re.findall(r"[0-9]+", own)[:6])
    size = next(name for most, name in ((0, "0"), (3, "1"), (8, "4"), (12, "9"), (15, "13"), (19, "16"), (1 << 60, "20")) if n <= most)
    names = [
        "bias", "shape " + shape, "lengths " + lengths, "digits " + size, f"chunks {chunks}", f"shape {shape} digits {size}",
        f"left {text[a - 1] if a and not text[a - 1].isalnum() else 'a' if a else '^'}", f"right {text[b] if b < len(text) and not text[b].isalnum() else 'a' if b < len(text) else '$'}",
        f"letters {min(sum(c.isalpha() for c in own), 3)} at {min(own.count('@'), 2)} dots {min(own.count('.'), 4)}",
        f"at {bool(re.search('@|[(\\[{] ?at ?[)\\]}]', own, re.I))} dot {bool(re.search('[(\\[{] ?dot ?[)\\]}]', own, re.I))}",
    ]
    if CARD_DIGITS[0] <= n <= CARD_DIGITS[1]:
        names.append(f"luhn {luhn(number)} {bool(re.fullmatch('[0-9 .-]+', own))}")
    parts = re.split(r"[. ]+", own)
    if len(parts) == 4 and all(p.isdecimal() for p in parts):
        names.append(f"quad {all(int(p[:9]) <= IP_MOST for p in parts)}")
    return array("H", [_place(x) for x in names])


def segments(text: str, chunks: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """First chunk and end of all segments that can be an entity, by those."""
    n = len(chunks)
    triggers = [m.span() for m in _TRIGGER.finditer(text, chunks[0][0], chunks[-1][1])]
    starts = [a for a, _ in triggers]
    own = [text[a:b] for a, b in chunks]
    count = [len(digits(x)) for x in own]
    numeric = [not any(c.isalpha() for c in x) and "@" not in x for x in own]
    number = [k for k in range(n) if count[k]]
    barrier = [n] * (n + 1)  # the first chunk from here on that is in no number
    for k in range(n - 1, -1, -1):
        barrier[k] = barrier[k + 1] if numeric[k] else k
    ats = [len(_AT.findall(x)) for x in own]
    size = [len(_MARK.sub(".", x)) for x in own]
    marks = [(_MARK.match(x), any(m.end() == len(x) for m in _MARK.finditer(x))) for x in own]
    linked = [
        bool(marks[k][1] or marks[k + 1][0]) or text[chunks[k][1] : chunks[k + 1][0]].split() == ["."] and text[chunks[k][1]].isspace()
        for k in range(n - 1)
    ] + [False]
    for i in range(n):
        ends = set(range(i + 1, min(i + NEAR, n) + 1))
        if count[i] or i + 1 < n and count[i + 1]:
            total = 0
            for k in number[(at := bisect_left(number, i)) : at + CARD_DIGITS[1]] if barrier[i] > i + NEAR else ():
                total += count[k]
                if k >= barrier[i] or total > CARD_DIGITS[1]:
                    break
                ends.add(k + 1)
        j, signs, length = i + 1, ats[i], size[i]
        while j < n and linked[j - 1] and signs + ats[j] <= 1 and length + size[j] <= ADDRESS_MOST:
            signs, length = signs + ats[j], length + size[j]
            j += 1
            if signs == 1:
                ends.add(j)
        at = bisect_left(starts, chunks[i][0])
        for j in sorted(ends) if at < len(triggers) else ():
            if triggers[at][1] <= chunks[j - 1][1]:
                yield i, j


class Lattice:
    """All segments of a place that can be an entity, with their features."""

    def __init__(self, text: str, chunks: list[tuple[int, int]]):
        self.chunks = chunks
        self.segments: list[tuple[int, int, array]] = [
            (i, j, features(text, chunks[i][0], chunks[j - 1][1], j - i)) for i, j in segments(text, chunks)
        ]

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Segments by kinds."""
        return np.array([weights[:, f].sum(axis=1) for *_, f in self.segments]).reshape(-1, len(KINDS))

    def best(self, scores: np.ndarray) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the entities of the best labelling; a chunk outside has score 0."""
        n = len(self.chunks)
        value = [0.0] + [-np.inf] * n
        came: list[tuple | None] = [None] * (n + 1)
        by_end: dict[int, list[int]] = {}
        for s, (_, j, _) in enumerate(self.segments):
            by_end.setdefault(j, []).append(s)
        kinds, tops = scores.argmax(axis=1), scores.max(axis=1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for s in by_end.get(j, ()):
                i = self.segments[s][0]
                if value[i] + tops[s] > value[j]:
                    value[j], came[j] = value[i] + tops[s], (i, int(kinds[s]))
        out, j = [], n
        while j:
            if came[j] is None:
                j -= 1
            else:
                i, kind = came[j]
                out.append((kind, self.chunks[i][0], self.chunks[j - 1][1]))
                j = i
        return out[::-1]

    def expected(self, scores: np.ndarray) -> np.ndarray:
        """The chance of each segment and kind, by forward and backward sums."""
        n = len(self.chunks)
        total = np.logaddexp.reduce(scores, axis=1)
        forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        forward[0] = backward[n] = 0.0
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        begins: list[list[int]] = [[] for _ in range(n + 1)]
        for s, (i, j, _) in enumerate(self.segments):
            ends[j].append(s)
            begins[i].append(s)
        for j in range(1, n + 1):
            terms = [forward[j - 1]] + [forward[self.segments[s][0]] + total[s] for s in ends[j]]
            forward[j] = np.logaddexp.reduce(terms)
        for i in range(n - 1, -1, -1):
            terms = [backward[i + 1]] + [backward[self.segments[s][1]] + total[s] for s in begins[i]]
            backward[i] = np.logaddexp.reduce(terms)
        around = np.array([forward[i] + backward[j] for i, j, _ in self.segments]) - forward[n]
        return np.exp(scores + around[:, None])


def _rewritten(kind: int, own: str, turn: int) -> str:
    """An entity as people write it to evade rules."""
    if kind == 0:
        return own.replace("@", (" (at) ", " [at] ")[turn % 2]).replace(".", (" (dot) ", " [dot] ")[turn % 2]) if own.count(".") == 1 or turn % 4 > 1 else own.replace("@", (" (at) ", "(at)", "[at]")[turn % 3])
    if kind == 1:
        return own.replace(".", " . ") if turn % 2 else own.replace(".", "[.]")
    if kind == 2:
        number = digits(own)
        return (" . ", ".", "/")[turn % 3].join(number[i : i + 4] for i in range(0, len(number), 4)) if turn % 3 else ".".join(number[i : i + 4] for i in range(0, len(number), 4))
    return ("00" if turn % 2 else "") + own.lstrip("+").replace("-", (".", " ", "/")[turn % 3])


def _apart(text: str, chunks: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> Iterator[tuple[list, list]]:
    """The chunks between those that spans touch which are no segment, and the spans in each run of them."""
    ends: dict[int, set[int]] = {}
    for i, j in segments(text, chunks):
        ends.setdefault(chunks[i][0], set()).add(chunks[j - 1][1])
    good = [s for s in spans if s[2] in ends.get(s[1], ())]
    bad = sorted(set(spans).difference(good), key=lambda s: s[1])
    at = 0
    for s in [*bad, None]:
        end = at
        while end < len(chunks) and (s is None or chunks[end][1] <= s[1]):
            end += 1
        if end > at:
            inside = good[bisect_left(good, chunks[at][0], key=lambda s: s[1]) : bisect_right(good, chunks[end - 1][0], key=lambda s: s[1])]
            yield chunks[at:end], inside
        at = end
        while s is not None and at < len(chunks) and chunks[at][0] < s[2]:
            at += 1


def _lessons(text: str) -> Iterator[tuple[Lattice, dict[tuple[int, int], int]]]:
    """Places of a text with the segments that are entities, as they stand and rewritten. Chunks that a rule's span touches
    which is no segment are left out, not the place around them."""
    spans = sorted(rule_spans(text), key=lambda s: s[1])
    most = max((b - a for _, a, b in spans), default=0)
    for turn, whole in enumerate(places(text)):
        low = bisect_left(spans, whole[0][0] - most, key=lambda s: s[1])
        inside = [s for s in spans[low : bisect_left(spans, whole[-1][1], key=lambda s: s[1])] if s[2] > whole[0][0]]
        chosen: list[tuple[int, int, int]] = []
        for s in sorted(inside, key=lambda s: s[1] - s[2]):
            at = bisect_left(chosen, s[1], key=lambda c: c[1])
            if (at == 0 or chosen[at - 1][2] <= s[1]) and (at == len(chosen) or s[2] <= chosen[at][1]):
                chosen.insert(at, s)
        for chunks, marks in _apart(text, whole, chosen):
            yield from _lesson(text, chunks, marks, turn)


def _lesson(text: str, chunks: list[tuple[int, int]], chosen: list[tuple[int, int, int]], turn: int) -> Iterator[tuple[Lattice, dict[tuple[int, int], int]]]:
    start, end = chunks[0][0], chunks[-1][1]
    for rewrite in (False, True) if chosen else (False,):
        own, marks, moved = text, chosen, chunks
        if rewrite:
            pieces, at, marks, base = [text[max(0, start - 8) : start]], start, [], min(8, start)
            for kind, a, b in chosen:
                new = _rewritten(kind, text[a:b], turn + a)
                before = text[at:a]
                pieces += [before, new]
                marks.append((kind, base + len(before), base + len(before) + len(new)))
                base += len(before) + len(new)
                at = b
            own = "".join(pieces) + text[at : end + 8]
            found = places(own)
            moved = found[0] if len(found) == 1 else []
        if not moved:
            continue
        lattice = Lattice(own, moved)
        named = {(moved[i][0], moved[j - 1][1]): s for s, (i, j, _) in enumerate(lattice.segments)}
        if all((a, b) in named for _, a, b in marks) and lattice.segments:
            yield lattice, {(named[a, b], kind): 1 for kind, a, b in marks}


def train(texts: list[str], epochs: int = EPOCHS) -> np.ndarray:
    """Weights by kind and feature."""
    weights = np.zeros((len(KINDS), 1 << BITS))
    weights[:, _place("bias")] = -4.0
    lessons = [lesson for text in texts for lesson in _lessons(text)]
    for turn in range(epochs):
        rate = RATE / (1 + turn)
        for at in np.random.default_rng(turn).permutation(len(lessons)).tolist():
            lattice, truth = lessons[at]
            step = -lattice.expected(lattice.scores(weights))
            for s, kind in truth:
                step[s, kind] += 1
            for s in np.flatnonzero(np.abs(step).max(axis=1) > 1e-3).tolist():
                weights[:, lattice.segments[s][2]] += rate * step[s][:, None]
        weights *= 1 - DECAY * max(len(lessons), 1)
    return weights.astype(np.float32)


def field_spans(text: str, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """What the field finds, whether the rules do or not, where an entity's evidence exceeds MARGIN."""
    out = []
    for chunks in places(text):
        lattice = Lattice(text, chunks)
        if lattice.segments:
            scores = lattice.scores(weights) - MARGIN
            if scores.max() > 0:
                out += lattice.best(scores)
    return out


def all_spans(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The rules' spans, and those together with the field's that overlap none of them; by kind and start."""
    if not _TRIGGER.search(text):
        return [], []
    base = rule_spans(text)
    by_start = sorted(base, key=lambda b: b[1])
    starts, reach = [b[1] for b in by_start], list(accumulate((b[2] for b in by_start), max))

    def free(span: tuple[int, int, int]) -> bool:
        before = bisect_left(starts, span[2])  # rule spans that begin before its end
        return not before or reach[before - 1] <= span[1]

    return base, sorted(base + [s for s in field_spans(text, weights) if free(s)])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def fit(docs: DataFrame, id_column: str = "doc_id", text: str = "text", limit: int = LEARN_MAX) -> np.ndarray:
    """Weights learnt from at most `limit` documents that hold digits or at signs; all 0 where there are none."""

    def run(table: pa.Table) -> pa.Table:
        weights = train(sorted(table["text"].to_pylist())).tobytes()
        release()
        return pa.table({"weights": pa.array([weights], pa.binary())})

    own = narrow(docs, id_column, text).select(F.col(text).alias("text"))
    some = least_hashes(own.filter(F.col("text").rlike("[0-9@]")), F.col("text"), limit)
    chosen = some.distinct().orderBy(F.xxhash64("text")).limit(limit)
    rows = chosen.groupBy(F.lit(0).alias("all")).applyInArrow(run, "weights binary").collect()
    return np.frombuffer(rows[0][0], np.float32).reshape(len(KINDS), -1) if rows else np.zeros((len(KINDS), 1 << BITS), np.float32)


def find(docs: DataFrame, id_column: str = "doc_id", text: str = "text", limit: int = LEARN_MAX) -> DataFrame:
    """One row per row of `docs`: id, n_email, n_ip, n_card, n_phone (spans of the rules), base_sha256 of those, spans
    (all, as kind:start:end) and n_added (those of the field).

    Texts are read whole; the rules take time linear in a text, unbroken runs of digits or letters too. An empty table gives an
    empty result. Starts and ends are code points, ends exclusive. Null and empty texts have no spans. Rows without an id and repeated rows
    each have a row; other columns of `docs` are not read.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, id_column, text, limit))
    counts = [f"n_{kind}" for kind in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for words in text_column(batch.column(1)):
                base, every = all_spans(words.as_py(), weights.value)
                own = [0] * len(KINDS)
                for kind, *_ in base:
                    own[kind] += 1
                rows.append((*own, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
            kinds = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), pa.int64()]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_column, *counts, "base_sha256", "spans", "n_added"])

    schema = f"`{id_column}` long, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string, n_added long"
    return narrow(docs, id_column, text).mapInArrow(run, schema)


def mask_column(weights: np.ndarray):
    """An Arrow UDF from text to the text with every span replaced by its kind in brackets. Null stays null."""

    def masked(text: str) -> str:
        spans = sorted(all_spans(text, weights)[1], key=lambda s: (s[1], -s[2]))
        out, at = [], 0
        for kind, a, b in spans:
            if a < at:  # it begins inside the one before: only what is left of it
                at = max(at, b)
                continue
            out += [text[at:a], f"[{KINDS[kind]}]"]
            at = b
        return "".join(out) + text[at:]

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.string())]
        for i in range(0, len(texts), MASK_ROWS):  # few texts at a time are Python strings as well
            parts.append(pa.array([None if t is None else masked(t) for t in texts.slice(i, MASK_ROWS).to_pylist()], pa.string()))
        made = pa.concat_arrays(parts)
        del parts, texts
        release()
        return made

    return mask
