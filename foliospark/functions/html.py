"""Scientific HTML (LaTeX classes) to Markdown: a tree of elements, then text; anything the rules don't know passes its children on."""

from __future__ import annotations

import re
import sys
from html.parser import HTMLParser

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ESCAPES, STYLES, SYNONYMS

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE_TEX = re.compile(r"^(?:\\\(|\\\[|\$\$?)|(?:\\\)|\\\]|\$\$?)$")
_NUMBER = re.compile(r"^\d+$")
_FIGURE = re.compile(r"\[(FOOTNOTE|FIGURE|TABLE)(.*?)\](.*?)\[END\1\]", re.S)


class Node:
    __slots__ = ("name", "attrs", "classes", "children", "parent")

    def __init__(self, name: str, attrs: dict, parent: Node | None):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.classes, self.children = frozenset((attrs.get("class") or "").split()), []

    def has(self, *classes: str) -> bool:
        return any("ltx_" + c in self.classes for c in classes)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def find(self, test):
        for c in self.children:
            if not isinstance(c, str):
                if test(c):
                    yield c
                else:
                    yield from c.find(test)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        n = Node(tag, dict(attrs), self.at)
        self.at.children.append(n)
        if tag not in _VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.name != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


class Unresolved(ValueError):
    """A citation or reference that leads nowhere."""


def _blank(s: str) -> str:
    if s.strip():
        s = re.sub(r"\n+\Z", "\n", re.sub(r"\A\n+", "\n", s))
    else:
        s = s.strip("\n")
    return re.sub(r"[ \t]+", " ", s)


def _hoist(mark: str, s: str) -> str:
    core = s.strip()
    if not core:
        return s
    at = s.index(core)
    return s[:at] + mark + core + mark + s[at + len(core) :]


def _tex(s: str, inline: bool) -> str:
    s = _INLINE_TEX.sub("", s.strip()).strip()
    s = re.sub(r"(?<!\\)%.*\n", "\n", s).replace("\n", " ")
    for a, b in (*SYNONYMS, *STYLES):
        s = s.replace(a, b)
    return "" if not s else f"\\({s}\\)" if inline else f"\\[{s}\\]"


def _span(n: Node, what: str) -> int:
    v = n.attrs.get(what) or "1"
    return int(v) if v.isdigit() else 1


class Writer:
    def __init__(self):
        self.unnamed = 0
        self.level = 0
        self.in_table = 0
        self.in_code = 0
        self.titled = False

    def all(self, n: Node) -> str:
        return "".join(self.one(c) for c in n.children)

    def name(self, n: Node) -> str:
        if n.attrs.get("id"):
            return n.attrs["id"]
        self.unnamed += 1
        return f"{self.unnamed}"

    def one(self, n) -> str:
        if isinstance(n, str):
            s = n if self.in_code else _blank(n)
            return "".join(ESCAPES.get(c, c) for c in s) if self.in_table else s
        has, t = n.has, n.name
        if t in ("script", "style", "head", "nav") and not n.classes or has("rule", "ERROR", "author_before", "role_pubyear", "role_pagerange", "page_footer", "page_navbar"):
            return ""
        if t == "p" or has("p") or t in ("div", "span") and has("para") or t == "section" and has("paragraph"):
            return self.all(n).strip() + "\n\n"
        if has("tag"):
            return "" if has("tag_note", "tag_subsection") else self.all(n).upper() if has("tag_section") else self.all(n)
        if has("note_outer"):
            mark = next(n.find(lambda x: x.has("note_mark")), None)
            key = mark.text().strip() if mark else self.name(n)
            body = "".join(self.one(c) for c in n.children if isinstance(c, str) or not c.has("note_mark")).strip()
            return f"[FOOTNOTE:{key}]Footnote {key}: {body}[ENDFOOTNOTE]"
        if has("note_mark"):
            return ""
        if t in ("sup", "sub"):
            s = self.all(n)
            to = "⁰¹²³⁴⁵⁶⁷⁸⁹" if t == "sup" else "₀₁₂₃₄₅₆₇₈₉"
            return s.translate(str.maketrans("0123456789", to)) if _NUMBER.match(s) else s
        if t == "math" or has("Math", "DisplayMath"):
            tex = n.attrs.get("alttext") or next((x.attrs["aria-label"] for x in n.find(lambda x: "aria-label" in x.attrs)), "")
            return _tex(tex, inline=not has("DisplayMath") and n.attrs.get("display", "inline") == "inline")
        if has("missing_citation", "missing_label"):
            s = n.text().strip()
            number = s if _NUMBER.match(s) else (re.search(r"\.bib(\d+)$", n.attrs.get("href", "")) or [None, None])[1]
            if not number:
                raise Unresolved(s)
            return number
        if has("bibblock", "role_author", "contact", "role_email", "role_affiliation"):
            return self.all(n) + "\n"
        if has("authors", "personname", "dates", "role_thanks"):
            return self.all(n).strip() + "\n\n"
        if t == "h1" and has("title_document"):
            first, self.titled = not self.titled, True
            return f"# {self.all(n).strip()}\n\n" if first else ""
        if t == "section" or has("abstract", "acknowledgements"):
            body = self.all(n)
            return body if body.strip() else ""
        if re.fullmatch("h[1-6]", t) and has("title"):
            s = " ".join(self.all(n).split())
            if has("title_theorem", "title_proof"):
                return f"**{s}**: "
            return f"\n{'#' * int(t[1])} {s}\n\n" if s else ""
        if has("TOC"):
            return f"\n###### Contents\n\n{self.all(n)}"
        if has("itemize", "enumerate", "toclist", "biblist") or t in ("ul", "ol") and n.classes:
            self.level += 1
            items = [c for c in n.children if not isinstance(c, str)]
            out = []
            for i, c in enumerate(items, 1):
                tag = next(c.find(lambda x: x.has("tag")), None)
                label = tag.text().strip() if tag else f"{i}." if t == "ol" else "*"
                label = f"* {label}" if has("biblist") and tag else "*" if label in "•–∗·" else label
                body = "".join(self.one(x) for x in c.children if isinstance(x, str) or not x.has("tag")).strip()
                out.append("  " * (self.level - 1) + f"{label} {body}")
            self.level -= 1
            return "\n" + "\n".join(out) + "\n\n"
        if t == "cite":
            s = self.all(n)
            return s if re.search(r"[\[\]A-Za-z]", s) else f"[{s.strip()}]"
        if t == "a":
            s, href = self.all(n), n.attrs.get("href") or ""
            if has("ref") and "#bib" in href and not _NUMBER.match(s.strip()):
                m = re.search(r"\.bib(\d+)$", href)
                if not m:
                    raise Unresolved(s)
                return m[1]
            return s if not href or href.startswith("#") or "#bib" in href else f"[{s}]({href})"
        if has("equationgroup", "eqn_table"):
            return f"\n{re.sub(r'\\\] *\\\[', ' ', self.all(n)).strip()}\n\n"
        if has("eqn_row", "eqn_cell"):
            s = self.all(n).strip()
            return s + " " if s else ""
        if t == "table" or has("tabular"):
            return self.table(n)
        if has("text", "emph") or t in ("em", "i", "b", "strong"):
            s = self.all(n)
            if self.in_code:
                return s
            return _hoist("**", s) if has("font_bold") else _hoist("_", s) if has("emph", "font_italic") else s
        if t == "figure" and has("table", "figure", "float"):
            kind = "TABLE" if has("table") else "FIGURE"
            return f"[{kind}:{self.name(n)}]{self.all(n).strip()}[END{kind}]\n\n"
        if has("listing"):
            self.in_code += 1
            s = self.all(n).strip("\n")
            self.in_code -= 1
            return f"\n```\n{s}\n```\n\n"
        if has("listingline"):
            return self.all(n) + "\n"
        if t == "dt":
            return self.all(n).strip() + ": "
        if t == "dd":
            return self.all(n).strip() + "\n"
        if t == "figcaption" or has("caption"):
            return self.all(n).strip() + "\n"
        if t == "br" or has("break"):
            return "\n\n" if has("break") else "\n"
        return self.all(n)

    def table(self, n: Node) -> str:
        """A LaTeX tabular: spans as multicolumn and multirow, borders of columns and rows from the classes of cells."""
        self.in_table += 1
        rows = [[c for c in r.find(lambda x: x.name in ("td", "th") or x.has("td", "th"))] for r in n.find(lambda x: x.name == "tr" or x.has("tr"))]
        width = max((sum(_span(c, "colspan") for c in r) for r in rows), default=0)
        specs: list[dict[str, int]] = [{} for _ in range(width)]
        lines, below = [], {}
        for r in rows:
            cells, col, top = [], 0, 0
            for c in r:
                while below.get(col, 0) > 0:
                    below[col] -= 1
                    cells.append("")
                    col += 1
                wide, high = _span(c, "colspan"), _span(c, "rowspan")
                spec = self.align(c)
                body = " ".join(self.all(c).split())
                top += any(x.startswith("ltx_border_t") for x in c.classes)
                if high > 1:
                    body = f"\\multirow{{{high}}}{{*}}{{{body}}}"
                    below |= {k: high - 1 for k in range(col, col + wide)}
                if wide > 1:
                    body = f"\\multicolumn{{{wide}}}{{{spec}}}{{{body}}}"
                elif col < width:
                    specs[col][spec] = specs[col].get(spec, 0) + 1
                cells.append(body)
                col += wide
            lines.append(("\\hline " if top and top == len(r) else "") + " & ".join(cells))
        self.in_table -= 1
        spec = "".join(max(s, key=s.get) if s else "c" for s in specs)
        return "\\begin{tabular}{" + spec + "}\n" + " \\\\\n".join(lines) + "\n\\end{tabular}\n\n"

    @staticmethod
    def align(c: Node) -> str:
        inner = next((k for w, k in (("align_left", "l"), ("align_right", "r"), ("align_justify", "p{1cm}"), ("align_center", "c")) if c.has(w)), "c")
        bars = lambda side: "|" * max((len(x) - len("ltx_border_") for x in c.classes if re.fullmatch(f"ltx_border_{side}+", x)), default=0)
        return bars("l") + inner + bars("r")


def parse(page: str) -> Node:
    b = _Builder()
    b.feed(page)
    b.close()
    return b.root


def markdown(page: str | None) -> tuple[bool, str | None, str | None, dict[str, str]]:
    """(ok, error, Markdown, bodies of figures, tables and footnotes by marker)."""
    if page is None:
        return False, "no page", None, {}
    if sys.getrecursionlimit() < 6000:  # elements nest as deep as pages have them
        sys.setrecursionlimit(6000)
    try:
        article = next(parse(page.replace("\xa0", " ")).find(lambda x: x.name == "article"), None)
        if article is None:
            return False, "no article", None, {}
        s = Writer().all(article)
    except Unresolved as e:
        return False, f"unresolved reference: {e}", None, {}
    except RecursionError:
        return False, "nested too deeply", None, {}
    s = re.sub(r"(?m) $", "", s)
    s = re.sub(r"(?m)\n[\t ]*$", "\n", s)
    s = re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<!\n) {2,}", " ", s)).lstrip()
    figures = {m[0] + m[1]: m[2].strip() for m in _FIGURE.findall(s)}
    return True, None, _FIGURE.sub(r"[\1\2][END\1]", s), figures


@F.pandas_udf(
    T.StructType(
        [
            T.StructField("ok", T.BooleanType()),
            T.StructField("error", T.StringType()),
            T.StructField("markdown", T.StringType()),
            T.StructField("figures", T.MapType(T.StringType(), T.StringType())),
        ]
    )
)
def to_markdown(column):
    import pandas as pd

    return pd.DataFrame([markdown(x) for x in column], columns=["ok", "error", "markdown", "figures"])


def converted(pages, html: str = "html"):
    """(documents, faulty): pages with markdown and figures, and those without, with the error that says why."""
    out = pages.withColumn("_x", to_markdown(html))
    others = [c for c in pages.columns if c != html]
    return out.where("_x.ok").select(*others, "_x.markdown", "_x.figures"), out.where("not _x.ok").select(*others, "_x.error")
