"""Documents cut into the pages of their PDFs, one document a row: no shuffle, and a task has one document at a time."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import alignment as al
from foliospark.functions.similarity import indel_ratio

from .pages import HEADER_STOP

_FIGURES = re.compile(r"\[(FOOTNOTE|FIGURE|TABLE).*?END\1\]")
_SHOWN = re.compile(r"\[(FIGURE|TABLE)(.*?)\](.*?)\[END\1\]")
_BREAK = re.compile(r"(?<!\n)\n([^\n\d*#\[])")
MIN_WORDS, CHUNK, REACH = 22, 1000, 5

SPLIT = "paper_id string, page_no int, text string, score double, paragraph int, place int, first_words string, last_words string"


def chunked(text: str, chars: int = CHUNK) -> list[str]:
    """Lines in groups of equally many, about `chars` characters each."""
    lines = text.split("\n")
    sizes = [len(x) for x in lines if len(x) > 1]
    if not sizes:
        return []
    step = 1 + int(chars / (sum(sizes) / len(sizes)))
    return ["\n".join(lines[i : i + step]) for i in range(0, len(lines), step)]


def frequent_words(pages: list[list[str]], words: int = 10, share: float = 0.4) -> list[str]:
    """Words that many pages have among their first ones, in the order in which they come."""
    counts: dict[str, int] = {}
    for p in pages:
        for w in " ".join(p).lower().split(" ")[:words]:
            counts[w] = counts.get(w, 0) + 1
    return [w for w, n in counts.items() if w and w not in HEADER_STOP and not w.startswith("\\") and n >= share * len(pages)]


def without_headers(pages: list[list[str]], words: int = 10) -> list[list[str]]:
    gone = frequent_words(pages, words)
    out = []
    for page in pages:
        seen, lines = 0, []
        for x in page:
            if seen < words:
                seen += len(x.split(" "))
                for w in gone:
                    x = re.sub(re.escape(w), "", re.sub(r"-\s*\d{1,3}\s*-", "", x) if w == "-" else x, flags=re.I)
            lines.append(x)
        out.append(lines)
    return out


def without_captions(pages: list[list[str]], figures: list[dict]) -> list[list[str]]:
    """Page lines without the captions that are found in them, the last first, so that places before them hold."""
    spots = []
    for f in figures:
        said, page = f.get("caption") or f.get("text"), f.get("page")
        if said and page is not None and 0 <= page < len(pages):
            start, size, score = al.locate_within("\n".join(pages[page]), al.unicode_to_latex(said))
            if score > 0.8 and size > 0:
                spots.append((start, size, page))
    out = [list(p) for p in pages]
    for start, size, page in sorted(spots, reverse=True):
        whole = "\n".join(out[page])
        out[page] = [x for x in (whole[:start] + whole[start + size :]).split("\n") if x]
    return out


def borders(paragraphs: list[str], pages: list[list[str]]) -> tuple[list[tuple[int, int, float]], list[str], list[str]]:
    """Of each page where it begins (paragraph, place, score), and the words looked for at the borders of pages."""
    lines = [x for p in pages for x in p]
    target = [k for k, p in enumerate(pages) for _ in p]
    steps: list[int] = []
    if paragraphs and len(set(target)) > 1:
        labels = al.LinearClassifier(lines, target).predict(paragraphs)
        steps = [int(x) for x in al.label_steps(labels, len(pages))]
    finder, found, firsts, lasts = al.Borders(paragraphs), [(0, 0, 1.0)], [], []
    for k in range(1, len(pages)):
        ahead, behind = " ".join(pages[k]).split(" ")[:MIN_WORDS], " ".join(pages[k - 1]).split(" ")[-MIN_WORDS:]
        first, last = " ".join(ahead).strip(), " ".join(behind).strip()
        firsts.append(first)
        lasts.append(last)
        if len(first) < 3 and len(last) < 3 or not paragraphs:
            found.append(found[-1])
        else:
            found.append(finder.between(steps[k - 1] if k <= len(steps) else len(paragraphs) - 1, first, last, math.ceil(REACH)))
    return found, firsts, lasts


def split_pages(text: str, pages: list[list[str]], figures: list[dict] | None = None, bodies: dict[str, str] | None = None, least: float = 0.9) -> list[tuple[str, float, int, int, str, str]]:
    """(text, score, paragraph, place, first words, last words) of every page; pages whose borders aren't sure are empty."""
    whole = [al.unicode_to_latex(x) if not x.isascii() else x for x in chunked(text)]
    at = [i for i, x in enumerate(whole) if len(x) > 1]
    paragraphs = [_FIGURES.sub("", whole[i]) for i in at]
    lines = [[al.unicode_to_latex(x).replace("\n", " ") for x in p if len(x) >= 3] for p in pages]
    found, firsts, lasts = [(0, 0, 1.0)], [], []
    if len(pages) > 1:
        lines = without_captions(without_headers(lines), figures or [])
        found, firsts, lasts = borders(paragraphs, lines)
    found = found + [(len(paragraphs), -1, 1.0)]
    out = []
    for k in range(len(pages)):
        (p, a, s), (q, b, t) = found[k], found[k + 1]
        said, score = "", (s + t) / 2
        if score >= least and p < len(at):
            inner = whole[at[p] : at[q] + 1 if q < len(at) else None]
            if len(inner) == 1 and q < len(at):
                inner = [inner[0][a:b]]
            elif inner:
                inner[0] = inner[0][a:]
                inner[-1] = inner[-1][:b] if q < len(at) else inner[-1]
            said = _BREAK.sub(r" \1", "\n".join(inner)).strip()
        out.append([said, score, p, a, firsts[k - 1] if k and k <= len(firsts) else None, lasts[k] if k < len(lasts) else None])
    bodies = bodies or {}
    tex = [x for n, x in bodies.items() if not n.startswith("FOOTNOTE")]
    for f in figures or []:
        said, page = f.get("caption") or f.get("text"), f.get("page")
        if said and tex and page is not None and 0 <= page < len(out) and out[page][0]:
            ratios = [indel_ratio(x.partition("\\end{table}")[2] if f.get("figType") == "Table" else x, said) for x in tex]
            k = int(np.argmax(ratios))
            if ratios[k] >= 0.8:
                out[page][0] += "\n\n" + _BREAK.sub(r" \1", tex[k].strip()).strip()
    for row in out:
        row[0] = re.sub(r"\[FOOTNOTE(.*?)\]\[ENDFOOTNOTE\]", lambda m: bodies.get("FOOTNOTE" + m[1], ""), row[0])
        row[0] = _SHOWN.sub("", row[0])
    return [tuple(r) for r in out]


def split_documents(papers: DataFrame, least: float = 0.9) -> DataFrame:
    """Pages of papers (paper_id, markdown, pages array<array<string>>, figures array<struct<page,caption,text,figType>>, bodies
    map<string,string>); a paper without markdown or pages has none, figures and bodies may be null."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.schema([("paper_id", pa.string()), ("page_no", pa.int32()), ("text", pa.string()), ("score", pa.float64()), ("paragraph", pa.int32()), ("place", pa.int32()), ("first_words", pa.string()), ("last_words", pa.string())])
        for b in batches:
            for r in range(b.num_rows):  # a document at a time
                paper, markdown, pages, figures, bodies = (b.column(k)[r].as_py() for k in range(5))
                if markdown is None or not pages:
                    continue
                lines = [[x for x in p if x is not None] if p is not None else [] for p in pages]
                rows = [(paper, k + 1, *row) for k, row in enumerate(split_pages(markdown, lines, figures, dict(bodies or ()), least))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    src = papers.select(F.col("paper_id").cast("string").alias("paper_id"), "markdown", "pages", "figures", "bodies")
    return src.mapInArrow(run, SPLIT)
