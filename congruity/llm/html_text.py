"""Main text of web pages: page structure, and a suffix array over each host.

A page's text is cut into runs of tokens. Runs inside ``article`` or ``main`` are
protected where they are at least half of what is not chrome: a copied article is main
text too, so repeats do not count against it. Runs in menus, footers, forms, adverts, comments and the like are chrome.
The streams of all runs that are not protected make the host's suffix array: suffixes,
cut at the shortest length that counts, are dealt to tasks by ranges of their order and
sorted there. Neighbours that agree so far on two distinct pages are repeats. A suffix's
place is part of its order, so that one line of a large host is split between tasks; the
first and last suffixes of the tasks are compared with each other. On pages without a
protected run, what repeats cover is boilerplate and goes; the unique runs stay. Pages
are parsed once.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_of, in_slices, passing, staged

#: Tokens of the shortest repeat that counts; a shorter run counts if it repeats whole.
LEAST_TOKENS = 8

#: HTML elements by what they mean for the text.
SILENT = frozenset("script style noscript template svg math iframe object canvas title textarea select option button audio video".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
IN_HEAD = frozenset("html head meta link title script style base noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset("address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CHROME = frozenset("nav footer aside form dialog menu".split())
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments disqus reply replies share sharing social related"
    " newsletter subscribe signup login popup modal overlay widget pagination pager search complementary contentinfo".split()
)
PAGE_HEADER_NAMES = frozenset("header masthead".split())
#: Words that say nothing of their own in a name: ad-slot is an advert, related-posts a list of links.
PLAIN_NAMES = frozenset("area bar block body bottom box button buttons container content desktop form group icons inner item items left link links list mobile panel post posts right section slot thread top unit user users wrap wrapper zone".split())
OF_READERS = frozenset("comment comments reply replies".split())
#: Elements whose id is the place of a link rather than what they are; headings have no role.
OF_TEXT, HEADINGS = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre span td".split()), frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN, MAIN_NAMES = frozenset(("article", "main")), frozenset("article main".split())

#: Quotes count in a value only; nothing is matched twice.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*"|=\s*+'[^']*'|["'=])*+)>|<[!?][^>]*>|<[/!?a-zA-Z][^>]*\Z""", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PROTECTED, OPEN, IN_CHROME, WRAPPER = 0, 1, 2, 3
#: The suffix array, in its order: key is null where the text stays whatever repeats it.
ENTRIES = ("host", "suffix", "page", "key", "run", "start", "n")
ARRAY = "host string, suffix string, page bigint, key bigint, run int, start int, n int, differs boolean, edge boolean"


def names(attributes: str, ids: bool = True) -> set[str]:
    found: set[str] = set()
    if attributes:
        for which, a, b, c in NAMED.findall(attributes):
            if ids or which.lower() != "id":
                found.update((a or b or c).lower().split())
    return found


def parts(named: set[str]) -> list[set[str]]:
    """The words of each name, without numbers."""
    return [{w for w in re.split(r"[^a-z0-9]+", n) if w and not w.isdigit()} for n in named]


def is_chrome(words: set[str]) -> bool:
    """Whether a name says chrome as a whole: cookie-notice does, with-sidebar does not."""
    return bool(words & CHROME_NAMES) and words <= CHROME_NAMES | PAGE_HEADER_NAMES | MAIN_NAMES | PLAIN_NAMES


class Regions:
    """The open elements that decide what text is, each with what holds within it:
    chrome or not, how many wrappers, a main element or not. Elements are told apart
    by the depth of their tag, so a page of any nesting takes linear time."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int, bool, int, bool]] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.depth: Counter[str] = Counter()

    def within(self) -> tuple[bool, int, bool]:
        return self.open[-1][2:] if self.open else (False, 0, False)

    def push(self, tag: str, kind: int) -> None:
        chrome, wrappers, inside = self.within()
        chrome = chrome or kind == IN_CHROME or kind == WRAPPER and inside
        self.at[tag].append(len(self.open))
        self.open.append((tag, self.depth[tag], chrome, wrappers + (kind == WRAPPER and not inside), inside or kind == PROTECTED))

    def close(self, tag: str) -> None:
        if self.at[tag] and self.open[self.at[tag][-1]][1] >= self.depth[tag]:
            first = self.at[tag][-1]
            for other, *_ in self.open[first:]:
                self.at[other].pop()
            del self.open[first:]
        self.depth[tag] -= self.depth[tag] > 0

    def kind(self) -> int:
        """What text is here; beyond WRAPPER, in a main element that so many wrappers hold."""
        chrome, wrappers, inside = self.within()
        if chrome or wrappers and not inside:
            return IN_CHROME
        return WRAPPER + wrappers if wrappers else PROTECTED if inside else OPEN


def settled(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Main elements in named chrome or forms are main text where nothing else is: those
    that the fewest wrappers hold."""
    held = {k for k, t in found if t and (k == PROTECTED or k > WRAPPER)}
    least = min(held, default=PROTECTED)
    return [(PROTECTED if k == least else IN_CHROME if k > WRAPPER else k, t) for k, t in found]


def runs(page: str) -> list[tuple[int, str]]:
    """(kind, text) of each stretch of the page that stands in one region, in order."""
    out: list[tuple[int, list[str]]] = []
    regions, kind, pos = Regions(), OPEN, 0
    unclosed: set[str] = set()  # silent elements of which no end is left

    def add(text: str) -> None:
        if text:
            if not out or out[-1][0] != kind:
                out.append((kind, []))
            out[-1][1].append(text)

    while True:
        found = TAG.search(page, pos)
        add(html.unescape(page[pos : found.start() if found else len(page)]))
        if not found:
            return settled([(k, " ".join("".join(x).split())) for k, x in out])
        pos = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag not in IN_HEAD and regions.open and regions.open[-1][0] == "head":
            regions.close("head")  # the first element of the body ends an open head
        if tag in SILENT and not found[1]:
            end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, pos)
            if end:
                pos = end.end()
            elif tag in RAW:
                pos = len(page)
            else:
                unclosed.add(tag)  # markup that only began: what follows is text like other
        elif tag not in VOID:
            if tag in BREAKS:
                add(" ")
            if found[1]:
                regions.close(tag)
            else:
                regions.depth[tag] += 1
                if (one := region_of(tag, found[3], regions.within()[2])) is not None:
                    regions.push(tag, one)
        elif tag in BREAKS:
            add(" ")
        before, kind = kind, regions.kind()
        if kind != before:
            add(" ")


def region_of(tag: str, attributes: str, inside: bool) -> int | None:
    """What an element makes of the text in it, if anything; ``inside`` a main element."""
    if tag in MAIN:
        # A reader's comment may be an article too.
        return IN_CHROME if tag == "article" and any(w & OF_READERS and is_chrome(w) for w in parts(names(attributes))) else PROTECTED
    if tag in CHROME - {"form"} or tag == "head" or tag == "header" and not inside:
        return IN_CHROME
    words = parts(names(attributes, tag not in OF_TEXT)) if tag not in ("body", "html") and tag not in HEADINGS else []
    if tag == "form" or any(map(is_chrome, words)) or not inside and any(w & PAGE_HEADER_NAMES for w in words):
        return WRAPPER
    if any(w & MAIN_NAMES and not w & CHROME_NAMES for w in words):
        return PROTECTED
    return None


def main_text(found: list[tuple[int, str]]) -> str | None:
    """The protected text, or None if the page has none, or less of it than of text that
    nothing names: then articles may be teasers, and structure does not decide."""
    kept = [t for k, t in found if k == PROTECTED and t]
    left = sum(len(t) for k, t in found if k == OPEN)
    return " ".join(kept) if kept and sum(map(len, kept)) >= left else None


def suffixes(tokens: list[str], least: int) -> Iterator[tuple[int, int, str]]:
    """(start, tokens, suffix cut at ``least`` tokens); of a short run only the whole."""
    for k in range(max(1, len(tokens) - least + 1)):
        if part := tokens[k : k + least]:
            yield k, len(part), "\x01".join(part) + "\x02" * (len(tokens) < least)


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted suffixes of a task, each with: whether it agrees with the one before and
    stands on another page; whether it is the first or last of the task."""
    held, before = None, None
    for batch in chain((b for b in batches if b.num_rows), (None,)):
        if held is not None:
            heads = list(zip(*(held.column(k).to_pylist() for k in range(3)), strict=True))
            differs = [a is not None and a[:2] == b[:2] and a[2] != b[2] for a, b in zip((before, *heads), heads)]
            edge = [before is None, *(False for _ in heads[1:])]
            edge[-1] |= batch is None
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array(differs), pa.array(edge)], [*ENTRIES, "differs", "edge"])
            before = heads[-1]
        held = batch


def suffix_array(entries: DataFrame) -> DataFrame:
    """ARRAY: the suffixes in their order, compared with their neighbours in a task."""
    dealt = entries.repartitionByRange(*ENTRIES).sortWithinPartitions(*ENTRIES)
    return staged(dealt.mapInArrow(neighbours, ARRAY), compression="zstd")


def repeats_of(array: DataFrame) -> DataFrame:
    """host, suffix: what two distinct pages of a host have. Where neighbours lie in two
    tasks, both are edges."""
    edges = array.filter("edge").groupBy("host", "suffix").agg(F.min("page").alias("a"), F.max("page").alias("b")).filter("a != b")
    return array.filter("differs").select("host", "suffix").unionByName(edges.select("host", "suffix")).distinct()


def html_text(pages: DataFrame, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points), from_structure.

    White space becomes one blank, blocks are joined by one. Null and empty pages
    give an empty text; a null url is a host of its own. Repeated rows are the
    same page, as are pages that say the same under several addresses, so they are no
    repeats of each other; each gives its row. Pages without an article that holds most
    of their text keep the runs that no other page of the host has. Extra
    columns are ignored; an empty table gives an empty result.
    """
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    base = pages.select("page_id", "url", "html").withColumn("host", host)
    id_kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [runs(h.as_py() or "") for h in batch.column(2)]
            text = [main_text(x) for x in found]
            left = [[t for k, t in x if k == OPEN and t] if own is not None else [t for k, t in x if k in (OPEN, PROTECTED) and t] for x, own in zip(found, text, strict=True)]
            chrome = [[t for k, t in x if k not in (OPEN, PROTECTED) and t] for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(text, pa.string()), pa.array(left, pa.list_(pa.string())), pa.array(chrome, pa.list_(pa.string()))],
                ["page_id", "url", "host", "text", "left", "chrome"],
            )

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        for batch in in_slices(batches, 100):
            rows = [
                (h, s, p, key if r < len(left) else None, r, k, n)
                for h, p, key, left, chrome in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for r, t in enumerate((*left, *chrome))
                for k, n, s in suffixes(t.split(), least_tokens)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(ENTRIES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = []
            for left, covered in zip(batch.column(2), batch.column(3), strict=True):
                tokens = [t.split() for t in left.as_py()]
                gone = {(c["run"], k) for c in covered.as_py() or [] for k in range(c["start"], c["start"] + c["n"])}
                text.append(" ".join(w for r, ws in enumerate(tokens) for k, w in enumerate(ws) if (r, k) not in gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    parsed = base.mapInArrow(read, f"page_id {id_kind}, url string, host string, text string, left array<string>, chrome array<string>")
    # A page is known by what it says, so that its copies under other addresses do not make it a repeat.
    parsed = staged(parsed.withColumn("page", F.xxhash64("text", F.concat_ws("\n", "left"))))
    undecided = parsed.filter("text IS NULL AND size(left) > 0").withColumn("hash", F.xxhash64("host"))
    out = parsed.filter("text IS NOT NULL OR size(left) = 0").select("page_id", "url", F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("from_structure"))
    if not undecided.isEmpty():
        undecided = staged(undecided.drop("text").withColumn("key", F.monotonically_increasing_id()))
        bits = staged(filter_of(undecided.select("hash")))
        others = passing(parsed.filter("text IS NOT NULL OR size(left) = 0").withColumn("hash", F.xxhash64("host")), bits)
        of_host = [x.select("host", "page", key.alias("key"), "left", "chrome") for x, key in ((undecided, F.col("key")), (others, F.lit(None).cast("long")))]
        array = suffix_array(of_host[0].unionByName(of_host[1]).mapInArrow(entries, ARRAY[: ARRAY.index(", differs")]))
        places = array.filter("key IS NOT NULL").select("key", "host", "suffix", "run", "start", "n")
        covered = places.join(repeats_of(array), ["host", "suffix"], "left_semi").groupBy("key").agg(F.collect_list(F.struct("run", "start", "n")).alias("covered"))
        decided = undecided.join(covered, "key", "left").select("page_id", "url", "left", "covered").mapInArrow(cut, f"page_id {id_kind}, url string, text string")
        out = out.unionByName(decided.withColumn("from_structure", F.lit(False)))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "from_structure")
