"""Main text of web pages by union-free regular expressions (wrappers) inferred for each host.

A page is a stream of tokens: block tags, and text slots marked by where they stand (in the article, in a part that
is never main text, elsewhere). Inside one page, runs of equal groups become one repeated group. The streams of a host
are then aligned one after another: what both have stays, what only one has becomes optional, repeated groups with equal
bodies are one. The outcome is one regular expression over tokens for the host, with numbered text slots.

Distinct streams are found by an aggregate, so a host with very many equal pages is folded once; the streams of a host
are folded as a tree, some in each task and then their wrappers with each other, since a wrapper aligns with a wrapper as
with a page. Extraction matches a page with its host's wrapper and takes the text of every slot of the article, or of
all slots outside excluded parts where the page fills none of the article's, since a host may have pages of both kinds. Of the
latter, the slots decide: a text that stands in a slot on most pages of the host that fill it is the template's, and goes.
Names of classes and ids only hint at excluded parts, and only if all of their words do: where a page has no other text, texts
under such names are taken if the host's pages show that they are no template. Within an article they stand for adverts, menus and
reader comments, not for headings. An article within an article is a comment or a teaser, and taken if there is nothing else. A page that its wrapper does not match (none that was
there when it was inferred) is aligned with it once more.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrove.llm.tables import keep

#: Wrappers of a host that are folded into one at a time.
FOLD = 32
#: Longest group of tokens, and longest run, looked at for repetition in one page.
GROUP_MAX = 16
#: So many different pages of a host must fill a slot before a text they all have in it is the template's.
LEAST_PAGES = 3
#: Share of the pages that fill a slot from which on a text they have in it is the template's.
TEMPLATE_SHARE = 0.8

_RAW = {n: re.compile(rf"</{n}\b[^>]*>", re.I) for n in "script style noscript template textarea iframe svg select".split()}
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag may be left out.
_LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option".split())
_EXCLUDED = frozenset("nav header footer aside form menu button dialog head title".split())
#: Words that name parts beside the article, those that are no such part within an article, reader comments, and words
#: that say nothing by themselves. A class or id counts if all of its words are among these.
_BESIDE = frozenset(
    "nav navbar navigation menu footer sidebar ad ads advert adverts advertisement cookie cookies consent notice promo promoted "
    "sponsor sponsored share sharing social related breadcrumb breadcrumbs popup modal overlay newsletter subscribe login signup search "
    "widget pagination pager toolbar disclaimer copyright".split()
)
_HEADS = frozenset("header masthead banner".split())
_COMMENTS = frozenset("comment comments respond reply replies".split())
_PLAIN = frozenset(
    "list box block wrapper wrap container area section bar site page main global top bottom left right inner outer links link posts articles "
    "stories items item slot unit buttons panel group".split()
)
_MAIN = frozenset(["article", "main"])
_EXCLUDED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
_ODD_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z]+")

def _named(words: list[str]) -> str:
    """What a class or id of these words says: c comments, s a part beside the article, w one unless it stands in an article."""
    if not words or not all(w in _BESIDE or w in _HEADS or w in _COMMENTS or w in _PLAIN for w in words):
        return ""
    return "c" if not _COMMENTS.isdisjoint(words) else "w" if not _HEADS.isdisjoint(words) else "s" if not _BESIDE.isdisjoint(words) else ""


def _attributes(source: str) -> tuple[str, str]:
    """First word of the class, and whether this is no main text: x its role says so, else what its classes or id hint at."""
    first, excluded = "", ""
    for name, a, b, c in _NAMED.findall(source):
        value = a or b or c
        words = [w.lower() for w in _WORD.findall(value)]
        if name.lower() == "role":
            if any(w in _EXCLUDED_ROLES for w in words):
                excluded = "x"
        else:
            for part in value.split():
                excluded = excluded or _named([w.lower() for w in _WORD.findall(part)])
            if name.lower() == "class" and words:
                first = words[0]
    return first, excluded


@lru_cache(1 << 12)
def _tag(closing: str, name: str, attributes: str) -> tuple[bool, str, bool, str, str]:
    """Whether it closes, name, whether it has no content, how it is excluded, its token."""
    name = name.lower()
    first, excluded = _attributes(attributes) if attributes.strip("/ ") else ("", "")
    empty = name in _VOID or attributes.endswith("/")
    return bool(closing), name, empty, excluded, ("/" + name if closing else f"{name}.{first}" if first else name)


class _Open:
    """The elements that are open, and so the kind of a text: x excluded, w excluded by names, c reader comments, a article, n an
    article within one, o other."""

    def __init__(self):
        self.stack: list[tuple[str, str]] = []

    def kind(self) -> str:
        return self.stack[-1][1] if self.stack else "o"

    def push(self, name: str, excluded: str) -> None:
        kind = self.kind()
        if name in _MAIN and (excluded == "c" or any(k == "c" for _, k in self.stack)):
            kind = "c"
        elif name in _MAIN:
            while self.stack and self.stack[-1][1] in "xw":  # an article stands in no menu: that was left open
                self.stack.pop()
            kind = "n" if name == "article" and any(n == "article" for n, _ in self.stack) else "a"
        elif name == "body":  # all of the page: its names exclude nothing
            self.stack.clear()
            kind = "o"
        elif excluded == "x" or name in _EXCLUDED and not (name == "header" and kind in "an"):
            kind = "x"
        elif kind not in "xc" and excluded and not (excluded == "w" and kind in "an"):
            kind = "c" if excluded == "c" else "w"
        self.stack.append((name, kind))

    def pop(self, name: str) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == name:
                del self.stack[at:]
                return


def tokens(source: str) -> tuple[list[str], list[str]]:
    """The token stream of a page, and the text of each token ("" for tags). A text slot is "#" and its kind."""
    stream: list[str] = []
    texts: list[str] = []
    pieces: list[str] = []
    open_ = _Open()

    def end_text() -> None:
        if pieces:
            text = "".join(pieces)
            pieces.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                stream.append("#" + open_.kind())
                texts.append(text)

    at, size = 0, len(source)
    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            pieces.append(source[at:])
            break
        if lt > at:
            pieces.append(source[at:lt])
        tag = _TAG.match(source, lt) or _ODD_TAG.match(source, lt)
        if not tag:
            skip = _SKIP.match(source, lt)
            at = skip.end() if skip else lt + 1
            if not skip:
                pieces.append("<")
            continue
        at = tag.end()
        closing, name, empty, excluded, token = _tag(*tag.groups())
        if not closing and name in _RAW:
            if not empty:
                end = _RAW[name].search(source, at)
                at = end.end() if end else size
            continue
        if name in _INLINE:
            if name == "br":
                pieces.append(" ")
            continue
        end_text()
        if closing:
            if name not in _LOOSE:
                open_.pop(name)
                stream.append(token)
                texts.append("")
            elif open_.stack and open_.stack[-1][0] == name:
                open_.stack.pop()
            continue
        if name in _LOOSE and open_.stack and open_.stack[-1][0] in _LOOSE and (open_.stack[-1][0] == name or name == "p"):
            open_.stack.pop()
        if not empty and (name not in _LOOSE or excluded):
            open_.push(name, excluded)
        stream.append(token)
        texts.append("")
    end_text()
    return stream, texts


# A wrapper is a list of nodes [key, optional]; key is a token, or a list of tokens that may repeat.


def collapse(stream: list[str]) -> list[list]:
    """The wrapper of one page: the longest runs of equal groups, shortest groups first, as repeated groups."""
    nodes: list[list] = []
    at, size = 0, len(stream)
    while at < size:
        for width in range(1, min(GROUP_MAX, size - at) + 1):
            loose = width == 2 and stream[at].partition(".")[0] in _LOOSE
            if not loose and (at + width == size or stream[at + width] != stream[at]):
                continue
            group = stream[at : at + width]
            end = at + width
            while stream[end : end + width] == group:
                end += width
            # Paragraphs and items repeat by nature, even if this page has one only.
            if end > at + width or (loose and group[1][0] == "#"):
                nodes.append([group, False])
                at = end
                break
        else:
            nodes.append([stream[at], False])
            at += 1
    merged: list[list] = []
    for node in nodes:
        if not (merged and merged[-1] == node and isinstance(node[0], list)):
            merged.append(node)
    return merged


def _key(node: list) -> str:
    return "\x1f".join(node[0]) + "\x1e" if isinstance(node[0], list) else node[0]


def align(one: list[list], other: list[list]) -> list[list]:
    """The wrapper of all that either describes: nodes of both stay, those of one become optional."""
    out: list[list] = []
    for what, a, b, c, d in SequenceMatcher(None, [_key(n) for n in one], [_key(n) for n in other], False).get_opcodes():
        if what == "equal":
            out += [[x[0], x[1] or y[1]] for x, y in zip(one[a:b], other[c:d])]
        else:
            out += [[n[0], True] for n in one[a:b]] + [[n[0], True] for n in other[c:d]]
    return out


class Wrapper:
    """A wrapper as a regular expression in which every token is one character."""

    def __init__(self, nodes: list[list]):
        self.nodes = nodes
        names = dict.fromkeys(t for key, _ in nodes for t in (key if isinstance(key, list) else [key]))
        self.letters = {name: chr(0xF0000 + i) for i, name in enumerate(names)}
        kinds: list[str] = []

        def letter(token: str) -> str:
            if token[0] == "#":
                kinds.append(token)
                return f"({self.letters[token]})"
            return self.letters[token]

        parts = []
        for key, optional in nodes:
            if isinstance(key, list):
                parts.append("(?:" + "".join(map(letter, key)) + ")" + ("*+" if optional else "++"))
            else:
                parts.append(letter(key) + ("?" if optional else ""))
        self.pattern = regex.compile("".join(parts))
        self.slots = {main: [i + 1 for i, kind in enumerate(kinds) if kind == main] for main in ("#a", "#n", "#o", "#w")}

    def filled(self, stream: list[str]) -> dict[str, list[tuple[int, int]]] | None:
        """By kind, the texts' places and their slots; None if the page does not match."""
        found = self.pattern.fullmatch("".join([self.letters.get(t, "￿") for t in stream]))
        if found is None:
            return None
        return {main: sorted((a, slot) for slot in slots for a, _ in found.spans(slot)) for main, slots in self.slots.items()}

    def places(self, stream: list[str]) -> list[int] | None:
        """Which tokens are main text by their kinds alone; None if the page does not match."""
        filled = self.filled(stream)
        return None if filled is None else [at for at, _ in filled["#a"] or filled["#n"] or filled["#o"]]


@lru_cache(256)
def _loaded(source: str) -> Wrapper:
    return Wrapper(json.loads(source))


def _code(slot: int, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{slot} {text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def slot_texts(source: str, wrapper: str) -> list[dict]:
    """Each slot outside articles that a page fills (code null), and the code of each different text in it."""
    stream, texts = tokens(source)
    filled = _loaded(wrapper).filled(stream)
    if filled is None or filled["#a"] or filled["#n"]:
        return []
    found = {(slot, code) for kind in ("#o", "#w") for at, slot in filled[kind] for code in (None, _code(slot, texts[at]))}
    return [{"slot": slot, "code": code} for slot, code in sorted(found, key=lambda x: (x[0], x[1] is not None, x[1] or 0))]


@lru_cache(256)
def _known(evidence: str) -> tuple[frozenset[int], frozenset[int]]:
    held = json.loads(evidence)
    return frozenset(held["template"]), frozenset(held["slots"])


def main_text(source: str, wrapper: str | None, evidence: str | None = None) -> str:
    """Blocks of main text, by the host's wrapper and template texts; failing that, by the wrapper of the page's own stream."""
    stream, texts = tokens(source)
    filled = _loaded(wrapper).filled(stream) if wrapper else None
    if filled is not None:
        template, slots = _known(evidence) if evidence else (frozenset(), frozenset())
        at = [i for i, _ in filled["#a"] or filled["#n"]] or [i for i, slot in filled["#o"] if _code(slot, texts[i]) not in template]
        if not at:
            at = [i for i, slot in filled["#w"] if slot in slots and _code(slot, texts[i]) not in template]
    else:
        at = Wrapper(collapse(stream)).places(stream)
        if at is None:  # possessive groups took too much: every token by itself
            at = Wrapper([[t, False] for t in stream]).places(stream)
    return "\n\n".join(texts[i] for i in at)


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame, url: str = "url", source: str = "html", fold_at_once: int = FOLD) -> DataFrame:
    """(host, wrapper): the wrapper of each host over all its pages, as JSON. Null pages count for nothing.

    The different streams of a host are folded as a tree: about `fold_at_once` in a task, the outcomes again, until one is
    left. So no task has more of a host than that, however many streams there are."""

    @F.arrow_udf("string")
    def skeleton(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else json.dumps(collapse(tokens(x)[0])) for x in column.to_pylist()], pa.string())

    def fold(table: pa.Table) -> pa.Table:
        wrapper: list[list] | None = None
        for own in sorted(table["wrapper"].to_pylist()):
            nodes = json.loads(own)
            wrapper = nodes if wrapper is None else align(wrapper, nodes)
        return pa.table({"host": table["host"].slice(0, 1), "wrapper": pa.array([json.dumps(wrapper)])})

    own = pages.select(host(F.col(f"`{url}`")).alias("host"), skeleton(F.col(f"`{source}`")).alias("wrapper")).filter("wrapper is not null")
    distinct = own.groupBy("host", "wrapper").agg(F.count(F.lit(1)).alias("pages")).select("host", "wrapper")
    left = keep(distinct, "streams")
    while True:
        sizes = keep(left.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "stream_counts")
        if sizes.filter("n > 1").isEmpty():
            return left
        part = F.pmod(F.xxhash64("wrapper"), F.expr(f"n div {fold_at_once} + 1")).alias("part")
        dealt = left.join(sizes, "host").select("host", "wrapper", part)
        left = keep(dealt.groupBy("host", "part").applyInArrow(fold, "host string, wrapper string"), "wrappers")


def template_texts(pages: DataFrame, wrappers: DataFrame, url: str = "url", source: str = "html", least: int = LEAST_PAGES,
                   share: float = TEMPLATE_SHARE) -> DataFrame:
    """(host, evidence): of each host, as JSON, the slots that at least `least` different pages without article text fill, and
    the codes of the texts that at least `share` of the pages which fill a slot have in it. Pages with the same texts count once."""

    @F.arrow_udf("array<struct<slot:int,code:bigint>>")
    def filled(column: pa.Array, wrapper: pa.Array) -> pa.Array:
        kinds = pa.list_(pa.struct([("slot", pa.int32()), ("code", pa.int64())]))
        return pa.array([slot_texts(x, w) for x, w in zip(column.to_pylist(), wrapper.to_pylist())], kinds)

    own = pages.select(host(F.col(f"`{url}`")).alias("host"), F.col(f"`{source}`").alias("source")).filter("source is not null")
    found = own.join(wrappers, "host").select("host", filled("source", "wrapper").alias("filled")).filter("size(filled) > 0")
    each = found.distinct().select("host", F.explode("filled").alias("own")).groupBy("host", "own.slot", "own.code").agg(F.count(F.lit(1)).alias("n"))
    each = keep(each.filter(F.col("n") >= least), "slot_texts")
    slots = each.filter("code is null").select("host", "slot", "n")
    filling = slots.withColumnRenamed("n", "pages")
    same = each.filter("code is not null").join(filling, ["host", "slot"]).filter(F.col("n") >= share * F.col("pages")).select("host", "slot", "code")
    both = slots.select("host", "slot", F.lit(None).cast("long").alias("code")).unionByName(same)
    lists = both.groupBy("host").agg(F.collect_set("code").alias("template"), F.collect_set("slot").alias("slots"))
    return lists.select("host", F.to_json(F.struct("template", "slots")).alias("evidence"))


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per row of `pages`: id, url, text, n_chars.

    Null and empty pages, and pages without main text, have an empty text. Pages are read whole, however long. An empty table gives
    an empty result. Rows without a URL share the host "". Repeated
    rows each have a row; other columns of `pages` are not read.
    """
    wrappers = keep(infer_wrappers(pages, url, source), "wrappers")
    wrappers = keep(wrappers.join(template_texts(pages, wrappers, url, source), "host", "left"), "templates")

    @F.arrow_udf("string")
    def text(column: pa.Array, wrapper: pa.Array, evidence: pa.Array) -> pa.Array:
        rows = zip(column.to_pylist(), wrapper.to_pylist(), evidence.to_pylist())
        return pa.array([main_text(x or "", w, e) for x, w, e in rows], pa.string())

    own = pages.select(F.col(f"`{id_column}`").cast("long").alias(id_column), F.col(f"`{url}`").alias("url"), F.col(f"`{source}`").alias("source"))
    joined = own.withColumn("host", host(F.col("url"))).join(wrappers, "host", "left")
    found = joined.select(id_column, "url", text("source", "wrapper", "evidence").alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
