"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags; scripts, styles, comments and the like are left out.

First pass, each block by itself: link density, length, and the density of stop words (of
the language that has most of them in the page) say good, near good, short or bad.  Where no language of
`STOP_WORDS` (English, German, French, Spanish) has `STOP_LEAST` of the page's words, length and link density decide alone.
Second pass: the ambiguous ones inherit.  A short block takes the label of its nearest decided
neighbours: good between good ones, bad between bad ones, and where they differ good only if a near-good
block lies closer on the bad side; after that near-good blocks join a good neighbour
on either side.  Headings that come shortly before good text are good.

A link lasts from <a> to </a>, or the next <a>, whatever blocks are between.  A tag without its > ends before the next <; a
quote without its second counts as a character.  Time is in proportion to the page.

Defined cases: null or empty html gives a row with no blocks and an empty text; html without tags is one block;
unclosed scripts and comments end with the page.  The title is the first outside of scripts and comments.  Each row gives
one row, repeated ones and those without page_id too; an empty table none.  Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import slices
from .shared import output_schema

MAX_LINKS = 0.2
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH, STOP_LEAST = 0.10, 0.20, 0.03
HEADING_REACH = 200

STOP_WORDS = {
    "en": "the a an and or but of to in on at by for with from as is are was were be been has have had it its this that these those he she they we you i not no which who what when where there their his her our your will would can could should all any some more than then so if about into out up over also only other such",
    "de": "der die das den dem des ein eine einer eines einem einen und oder aber von zu im in an auf bei für mit aus als ist sind war waren sein hat haben es dies diese dieser dieses er sie wir ihr ich nicht kein keine welche wer was wenn wo dort nach über unter auch nur noch so wie um am zum zur durch werden wird wurde sich dass",
    "fr": "le la les un une des du de et ou mais à au aux en dans sur par pour avec est sont était ce cette ces il elle ils elles nous vous je ne pas que qui quoi dont où leur leurs son sa ses notre votre se plus comme si tout tous aussi être avoir a ont on y",
    "es": "el la los las un una unos unas de del y o pero a al en con por para desde como es son era eran ser ha han su sus lo se no que quien cual cuando donde este esta estos estas ese esa él ella ellos nosotros yo más muy también si todo todos hay le les me mi ya",
}

_BLOCK = "address article aside blockquote body button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
_ATTRIBUTES = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+'|["'])*+(?:>|\Z|(?=<))"""
_DROP = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|head|textarea)\b{_ATTRIBUTES}.*?(?:</\1\s*+>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S | re.I)
_TITLE = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea)\b{_ATTRIBUTES}.*?(?:</\1\s*+>|\Z)|<title\b{_ATTRIBUTES}(?P<title>.*?)(?:</title|\Z)", re.S | re.I)
_TAG = re.compile(rf"<(/?)([a-zA-Z][a-zA-Z0-9]*+){_ATTRIBUTES}")
_WORD = re.compile(r"[^\W\d_]+")
_BLOCKS = frozenset(_BLOCK)
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])


class Block:
    __slots__ = ("text", "linked", "heading", "label")

    def __init__(self, text: str, linked: int, heading: bool):
        self.text, self.linked, self.heading, self.label = text, linked, heading, ""


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in order."""
    page = _DROP.sub(" ", page)
    out: list[Block] = []
    held: list[str] = []
    linked = depth = at = 0
    heading = False

    def close():
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append(Block(text, min(linked, len(text)), heading))
        held.clear()
        linked = 0

    for m in _TAG.finditer(page):
        if m.start() > at:
            piece = entities.unescape(page[at : m.start()])
            held.append(piece)
            if depth:
                linked += len(" ".join(piece.split()))
        at = m.end()
        name = m[2].lower()
        if name == "a":
            depth = 0 if m[1] else 1
        elif name in _BLOCKS:
            close()
            heading = not m[1] and name in _HEADINGS
        elif name == "br":
            held.append(" ")
    if at < len(page):
        piece = entities.unescape(page[at:])
        held.append(piece)
        if depth:
            linked += len(" ".join(piece.split()))
    close()
    return out


def _nearest(labels: list[str], kinds: tuple[str, ...], step: int) -> list[str]:
    """For each place the label of the nearest one before it (step 1) or behind it (-1) of these kinds; "bad" if there is none."""
    out, last = ["bad"] * len(labels), "bad"
    for i in range(len(labels))[::step]:
        out[i] = last
        if labels[i] in kinds:
            last = labels[i]
    return out


def settle(first: list[str]) -> list[str]:
    """The second pass: "good" or "bad" for labels "good", "near", "short" and "bad"."""
    decided, also = ("good", "bad"), ("good", "bad", "near")
    before, behind, near_before, near_behind = (_nearest(first, kinds, step) for kinds in (decided, also) for step in (1, -1))
    second = list(first)
    for i, label in enumerate(first):
        if label == "short":
            x, y = before[i], behind[i]
            second[i] = x if x == y else "good" if "near" == (near_before if x == "bad" else near_behind)[i] else "bad"
    before, behind = _nearest(second, decided, 1), _nearest(second, decided, -1)
    return ["good" if x == "near" and "good" in (before[i], behind[i]) else "bad" if x == "near" else x for i, x in enumerate(second)]


def classify(found: list[Block], stop_words: dict[str, frozenset]) -> None:
    """Labels every block "good" or "bad" in two passes."""
    words = [[w.lower() for w in _WORD.findall(b.text)] for b in found]
    every = [w for ws in words for w in ws]
    share, stop = max(((sum(w in s for w in every), s) for s in stop_words.values()), key=lambda x: x[0], default=(0, frozenset()))
    known = share >= STOP_LEAST * len(every)
    for b, ws in zip(found, words):
        size, links = len(b.text), b.linked / len(b.text)
        density = sum(w in stop for w in ws) / max(1, len(ws)) if known else STOP_HIGH
        if links > MAX_LINKS or "\xa9" in b.text:
            b.label = "bad"
        elif size < SHORT:
            b.label = "bad" if b.linked else "short"
        elif density >= STOP_HIGH:
            b.label = "good" if size > LONG else "near"
        else:
            b.label = "near" if density >= STOP_LOW else "bad"
    second = settle([b.label for b in found])
    for i, b in enumerate(found):
        if b.heading and second[i] == "bad" and not b.linked:
            reach, j = 0, i + 1
            while j < len(found) and reach <= HEADING_REACH:
                if second[j] == "good":
                    second[i] = "good"
                    break
                reach += len(found[j].text)
                j += 1
    if "good" not in second:  # a page of moderate blocks alone has them as its text
        second = ["good" if x == "near" else y for x, y in zip([b.label for b in found], second)]
    for b, label in zip(found, second):
        b.label = label


def extract(page: str | None, stop_words: dict[str, frozenset]) -> tuple[str, str, int, int]:
    """(title, text, blocks, kept blocks)."""
    if not page:
        return "", "", 0, 0
    found = blocks(page)
    classify(found, stop_words)
    kept = [b.text for b in found if b.label == "good"]
    title = next((m["title"] for m in _TITLE.finditer(page) if m["title"] is not None), "")
    return " ".join(entities.unescape(title).split()), "\n".join(kept), len(found), len(kept)


def _extractor(stop_words: dict[str, str]):
    sets = {k: frozenset(v.split()) for k, v in stop_words.items()}

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                got = [extract(h, sets) for h in part.column(1).to_pylist()]
                title, text, n, kept = zip(*got)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(title, pa.string()), pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(kept, pa.int32())], names=["page_id", "title", "text", "n_blocks", "n_kept"])

    return run


def extract_pages(pages: DataFrame, stop_words: dict[str, str] = STOP_WORDS) -> DataFrame:
    """page_id, title, text, n_blocks, n_kept of every page."""
    src = pages.select("page_id", F.col("html").cast("string").alias("html"))
    return src.mapInArrow(_extractor(stop_words), output_schema(src, ["page_id"], "title string, text string, n_blocks int, n_kept int"))
