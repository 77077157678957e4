"""Main text of web pages by equivalence-class template deduction across pages of a host.

A page is a sequence of tokens: tags in the place they have in the page (the path of open
elements), and runs of text in that place. Tokens of a host with equal occurrence vectors, the counts page
by page, form an equivalence class. Vectors are compared by a hash that is combined page by page, so no
host is ever gathered. Only tokens on at least half of a host's pages come in, so a host's classes are no
longer than twice its mean page. Near copies of a page count once (``near_mark``).

A class of several tokens has an order: that of its tokens' first places, summed over the host's pages. On a
page its tokens are template where they stand in that order; a class that occurs n times must repeat as a
whole n times. A text of it is template if the class holds a tag and is on nine tenths of the pages (the frame of the
host), or if the tag of its own place belongs to the class, so that the text comes and goes with its block.
Classes nest in each other's slots by these places; what the template leaves are the slots.

The remaining slots are the main text but for those in menus, headers, footers, sidebars, forms, adverts and
reader comments. Names, roles and forms are evidence only: an element that holds most of the slots is no aside. Where at
least half of what remains lies in an article or main element, only that is kept. In an article, a template text stays
where its block's place also holds other text, for it is one of several paragraphs.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickframe.operators.series import settle

SALTS = 16      # parts the pages of a host are dealt to when its template is joined
SUPPORT = 3     # pages a host needs for a template
LONG = 50       # words from which pages that differ in numbers and short dated blocks only are near copies

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|textarea|select|iframe|object|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r"(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>", re.S | re.I)
_DIGITS = re.compile(r"\d+")
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

# Elements of HTML by what they do here, and the names by which pages mark what is not main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
ASIDE = frozenset("aside button dialog footer form head header label menu nav".split())
MAIN = frozenset("article main".split())
NOTES = frozenset("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
                  "cookies disqus footer masthead menu modal nav navbar navigation newsletter notice pagination popup promo related "
                  "replies respond share sharing sidebar social sponsor sponsored subscribe subscription topbar widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
_CLOSES_P = BLOCK - {"body", "html", "head", "caption", "tbody", "tfoot", "thead", "tr", "li", "dd", "dt"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
_KEEPS = {"head": set(), "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "p": {"article", "section", "div", "main", "td", "li", "body", "blockquote"}}


def _named_aside(attributes: str) -> bool:
    for name, *values in _NAMED.findall(attributes):
        own = "".join(values).lower()
        if name.lower() == "role":
            if own in ROLES:
                return True
        elif not NOTES.isdisjoint(re.split(r"[^a-z]+", own)):
            return True
    return False


class Open(NamedTuple):
    """An open element: its aside is certain by its tag, or claimed by ``marks``, elements it is or lies in."""
    tag: str
    aside: bool
    marks: tuple[int, ...]
    main: bool
    article: bool
    place: str
    block: int     # the token of the innermost block tag


class Block(NamedTuple):
    place: str
    text: str
    top: Open


class Page:
    """Blocks of a page in order, and its tokens: tags and texts with their place."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.sequence: list[tuple[int, int]] = []     # token, number of its block or -1 for a tag
        self.stack: list[Open] = []
        self.text: list[str] = []
        self.has_main = False
        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self.text.append(source[at:m.start()])
            at = m.end()
            if m[3]:
                self._tag(m[3].lower(), bool(m[2]), m[4])
            elif m[1] and m[1].lower() != "svg":
                self.text.append(" ")
        self.text.append(source[at:])
        self._block()

    def _top(self) -> Open:
        return self.stack[-1] if self.stack else Open("", False, (), False, False, "", 0)

    def _block(self) -> None:
        text = " ".join(html.unescape("".join(self.text)).split())
        self.text.clear()
        if text:
            top = self._top()
            self.sequence.append((text_token(top.place, text), len(self.blocks)))
            self.blocks.append(Block(top.place, text, top))

    def _tag(self, tag: str, closing: bool, attributes: str) -> None:
        if closing:
            if tag in BLOCK:
                self._block()
            for depth in range(len(self.stack) - 1, -1, -1):
                if self.stack[depth].tag == tag:
                    del self.stack[depth:]
                    return
                if tag not in BLOCK and self.stack[depth].tag in BLOCK:
                    return
            return
        if tag in BLOCK:
            self._block()
            if tag in _CLOSES_P:
                self._end({"p"}, "p")
            if tag in _SAME:
                self._end(_SAME[tag], tag)
        elif tag in ("br", "td", "th"):
            self.text.append(" ")
        if tag == "body":
            self._end({"head"}, "head")
        top = self._top()
        main = top.main or tag in MAIN
        named = "".join(sorted("".join(v) for n, *v in _NAMED.findall(attributes))) if "=" in attributes else ""
        place = f"{top.place}/{tag}.{named}" if named else f"{top.place}/{tag}"
        block = top.block
        if tag in BLOCK:
            block = xxhash.xxh3_64_intdigest(place)
            self.sequence.append((block, -1))
        if tag not in VOID and not attributes.endswith("/"):
            self.has_main |= tag in MAIN
            aside = top.aside or (tag in ASIDE and tag != "form" and not (tag == "header" and main))
            claimed = tag == "form" or (tag not in ("html", "body") and _named_aside(attributes))
            self.stack.append(Open(tag, aside, (*top.marks, len(self.sequence)) if claimed else top.marks, main,
                                   top.article or tag == "article", place, block))

    def _end(self, tags: set[str], kind: str) -> None:
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth].tag in tags:
                del self.stack[depth:]
                return
            if self.stack[depth].tag in _KEEPS[kind]:
                return

    def tokens(self) -> dict[int, tuple[int, int]]:
        """How often each token of the page occurs, and where first: tags, and texts with their place."""
        first: dict[int, int] = {}
        for at, (token, _) in enumerate(self.sequence):
            first.setdefault(token, at)
        counts = Counter(token for token, _ in self.sequence)
        return {token: (n, first[token]) for token, n in counts.items()}

    def near_mark(self) -> int:
        """A hash of the block texts, equal for near copies.

        Pages of ``LONG`` words or more are near copies if they differ in numbers only, or in blocks of up to six words with a
        number in them, such as dates and counters. Shorter ones must have equal texts.
        """
        texts = [b.text for b in self.blocks]
        if sum(t.count(" ") + 1 for t in texts) >= LONG:
            folded = [_DIGITS.sub("0", t) for t in texts if t.count(" ") > 5 or not _DIGITS.search(t)]
            texts = folded or texts
        return xxhash.xxh3_64_intdigest("\n".join(texts))

    def template_blocks(self, classes: list[tuple[int, list[int]]], of: int) -> set[int]:
        """Numbers of the blocks that are template text; ``classes`` are (pages, tokens in order) of ``of`` pages."""
        rank = {t: (k, r) for k, (_, tokens) in enumerate(classes) for r, t in enumerate(tokens)}
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for token, block in self.sequence:
            if token in rank:
                k, r = rank[token]
                found[k].append((r, block))
        out: set[int] = set()
        for k, own in found.items():
            pages, tokens = classes[k]
            times, over = divmod(len(own), len(tokens))
            if over:
                continue                                  # no whole class on this page
            if times == 1:
                own = _ascending(own)
            elif [r for r, _ in own] != [*range(len(tokens))] * times:
                continue
            if len(own) < 2:
                continue
            frame = 10 * pages >= 9 * of and any(b < 0 for _, b in own)
            held = {tokens[r] for r, b in own if b < 0}
            out.update(b for _, b in own if b >= 0 and (frame or self.blocks[b].top.block in held))
        return out

    def main_text(self, classes: list[tuple[int, list[int]]] = (), of: int = 0) -> list[str]:
        template = self.template_blocks(classes, of)
        other = {b.top.block for k, b in enumerate(self.blocks) if k not in template}
        slots = [b for k, b in enumerate(self.blocks) if k not in template or (b.top.article and b.top.block in other)]
        # an element that holds most of the articles' slots, or of all slots where there is no article, is no aside
        base = [b for b in slots if not b.top.aside and (b.top.main or not self.has_main)]
        share: Counter = Counter()
        for b in base:
            for mark in b.top.marks:
                share[mark] += len(b.text)
        whole = sum(len(b.text) for b in base)
        wide = {mark for mark, n in share.items() if 2 * n > whole}
        slots = [b for b in slots if not b.top.aside and wide.issuperset(b.top.marks)]
        inside = [b for b in slots if b.top.main]
        if 2 * sum(len(b.text) for b in inside) >= sum(len(b.text) for b in slots):
            slots = inside
        return [b.text for b in slots]


def _ascending(own: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of a page's tokens of a class that stands in the class's order."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for at, (r, _) in enumerate(own):
        k = bisect_left(tails, r)
        before.append(ends[k - 1] if k else -1)
        tails[k:k + 1] = [r]
        ends[k:k + 1] = [at]
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(own[at])
        at = before[at]
    return out[::-1]


def text_token(place: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{place}\n{text}")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _occurrences(batches) -> Iterator[pa.RecordBatch]:
    """A row per page: its near-copy mark, and its tokens with their counts and first places."""
    for batch in batches:
        near, tokens, counts, firsts = [], [], [], []
        for source in batch.column("html").to_pylist():
            page = Page(source or "")
            own = page.tokens()
            near.append(_signed(page.near_mark()))
            tokens.append([_signed(t) for t in own])
            counts.append([n for n, _ in own.values()])
            firsts.append([at for _, at in own.values()])
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), batch.column("mark"), pa.array(near, pa.int64()), pa.array(tokens, longs),
             pa.array(counts, longs), pa.array(firsts, longs)], names=["host", "mark", "near", "token", "n", "at"])


def host_of(url: Column) -> Column:
    """The lower-case host of a URL without user and port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def equivalence_classes(pages: DataFrame) -> DataFrame:
    """``pages`` (host, mark, html) → (host, vector, pages, most, tokens, of): classes of equal vectors.

    Only tokens on at least half of a host's ``of`` pages come in, and hosts of ``SUPPORT`` pages or more.
    ``most`` is how often the class occurs on a page at most; ``tokens`` stand in the class's order. Different pages
    need different marks; near copies of a page count once, so copies alone make no template.
    """
    parsed = pages.select("host", "mark", "html").mapInArrow(
        _occurrences, "host string, mark long, near long, token array<long>, n array<long>, at array<long>")
    distinct = settle(parsed.groupBy("host", "near").agg(F.min(F.struct("mark", "token", "n", "at")).alias("x"))
                      .select("host", "x.*"))
    sizes = distinct.groupBy("host").agg(F.count("*").alias("of")).where(F.col("of") >= SUPPORT)
    each = distinct.select("host", "mark", F.explode(F.arrays_zip("token", "n", "at")).alias("x")).select("host", "mark", "x.*")
    found = (each.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("mark", "n")).alias("vector"), F.count("*").alias("pages"), F.max("n").alias("most"), F.sum("at").alias("at"))
        .join(sizes, "host").where(F.col("pages") >= SUPPORT).where(2 * F.col("pages") >= F.col("of")))
    ordered = F.array_sort(F.collect_list(F.struct("at", "token")))
    return found.groupBy("host", "vector", "pages", "most", "of").agg(ordered.alias("x")).select(
        "host", "vector", "pages", "most", F.col("x.token").alias("tokens"), "of")


def _extracted(others: list[str]):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, template, of in zip(*(batch.column(k).to_pylist() for k in ("html", "_template", "_of"))):
                classes = [(c["pages"], [x % (1 << 64) for x in c["tokens"]]) for c in template or ()]
                texts.append("\n\n".join(Page(source).main_text(classes, of or 0)) if source else "")
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in others), pa.array(texts, pa.string())],
                                             names=[*others, "text"])
    return run


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html, more) → its columns without html, and ``text``: the page's main text.

    Character references are decoded, white space inside a block is one space, blocks are joined
    by an empty line; nothing is cut. Null or empty html, and pages without main text, give an empty
    text. Pages without a host, or of hosts with fewer than ``SUPPORT`` different pages, have no
    template. Repeated rows stay. A column ``text`` is replaced. No rows give no rows.
    """
    pages = pages.drop("text")
    names = [c for c in pages.columns if c != "html"]
    known = pages.withColumns({"_host": host_of(F.col("url")), "_mark": F.xxhash64("html")})
    classes = equivalence_classes(known.where("_host <> '' and html is not null").select(
        F.col("_host").alias("host"), F.col("_mark").alias("mark"), "html"))
    templates = settle(classes.where(F.size("tokens") > 1).groupBy("host", F.col("of").alias("_of")).agg(
        F.collect_list(F.struct("pages", "tokens")).alias("_template")))
    spread = templates.withColumn("_salt", F.explode(F.lit(list(range(SALTS))))).withColumnRenamed("host", "_host")
    salted = known.withColumn("_salt", F.pmod(F.col("_mark"), F.lit(SALTS)).cast("int"))
    joined = salted.join(spread, ["_host", "_salt"], "left").select(*pages.columns, "_template", "_of")
    schema = StructType([f for f in pages.schema if f.name != "html"]).add("text", "string")
    return joined.mapInArrow(_extracted(names), schema)
