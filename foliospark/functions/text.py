"""Clean-up of page text and LaTeX as Column expressions; all but those of many literal replacements stay within generated code."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f(value) with the value evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def mapped(f):
    """A function of one text as a function of Columns, for rules that would each take a pass over the text; nulls stay.  Of a
    batch only some rows at a time are strings of Python."""

    @F.arrow_udf(T.StringType())
    def run(x):
        import pyarrow as pa

        parts = [pa.array([None if (s := v.as_py()) is None else f(s) for v in x.slice(i, 64)], pa.string()) for i in range(0, len(x), 64)]
        out = pa.concat_arrays(parts or [pa.array([], pa.string())])
        del parts
        pa.default_memory_pool().release_unused()  # workers live on
        return out

    return run


def replace_all(c: Column | str, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, _col(c))


def substitute(c: Column | str, *rules: tuple[str, str]) -> Column:
    """Regular-expression replacements, one after the other; only a line feed ends a line."""
    return reduce(lambda x, r: F.regexp_replace(x, "(?d)" + r[0], r[1]), rules, _col(c))


def strip(c: Column | str) -> Column:
    return substitute(c, (r"^\s+", ""), (r"\s+\z", ""))


def remove_pretty_linebreaks(c: Column | str) -> Column:
    """Single line breaks within a paragraph become blanks; those before digits, *, # and [ stay."""
    return strip(substitute(c, (r"(?<!\n)\n([^\n\d*#\[])", " $1")))


LIGATURES = dict(zip("ﬀﬁﬂﬃﬄﬅﬆꜳ", "ff fi fl ffi ffl ft st aa".split()))


def replace_ligatures(c: Column | str) -> Column:
    return replace_all(c, list(LIGATURES.items()))


def dehyphenate(c: Column | str) -> Column:
    """Joins words that a hyphen at a line's end divides; lines lose the white space at their ends.  A line that ends with a
    hyphen gets the next line's first word, up to a blank, whether or not it lost its own to the line before."""

    def joined(lines: Column) -> Column:
        def line_of(line: Column, i: Column) -> Column:
            after = F.get(lines, i + 1)
            left = F.when((i > 0) & F.get(lines, i - 1).endswith("-"), F.substr(line, F.length(F.split_part(line, F.lit(" "), F.lit(1))) + 1)).otherwise(line)
            return F.when(line.endswith("-") & after.isNotNull(), F.concat(F.left(left, F.greatest(F.length(left) - 1, F.lit(0))), F.split_part(after, F.lit(" "), F.lit(1)))).otherwise(left)

        return F.transform(lines, line_of)

    return F.array_join(let(F.split(substitute(c, (r"[\s&&[^\n]]+(?=\n|\z)", "")), "\n", -1), joined), "\n")


# the order matters: blanks go before the commands that hold them, and braces before the markers
SPECIAL = [("\\ ", ""), (" ", ""), ("\n", ""), *[(x, "") for x in r"* _ ^ \[ \] \( \) \right \left".split()], (r"\sum", "X")]
SPECIAL += [(x, "") for x in "{ } # [REF] [ENDREF]".split()] + [(r"\varphi", r"\phi")] + [(x, "") for x in r"\quad \qquad \hskip \vskip \frac \rm \, -".split()]


def strip_special_chars(c: Column | str) -> Column:
    """The form in which texts are compared when page boundaries are looked for."""
    return F.lower(replace_all(c, SPECIAL))


def remove_numbers(c: Column | str) -> Column:
    return strip(substitute(c, (r"[\d_]|\*\*", "")))


def clean_html_whitespace(c: Column | str) -> Column:
    """Line breaks at the ends become one if there is text, else none; runs of blanks become one blank."""
    x = _col(c)
    blank = F.trim(F.regexp_replace(x, r"\s", "")) == ""
    edges = F.when(blank, substitute(x, (r"^\n+", ""), (r"\n+\z", ""))).otherwise(substitute(x, (r"^\n+", "\n"), (r"\n+\z", "\n")))
    return F.regexp_replace(edges, r"[ \t]+", " ")


def drop_trailing_blank(parts: Column | str) -> Column:
    """An array without the blank elements at its end."""
    last = lambda p: F.array_max(F.transform(p, lambda x, i: F.when(F.trim(x) != "", i + 1).otherwise(0)))
    return let(_col(parts), lambda p: F.slice(p, F.lit(1), F.coalesce(last(p), F.lit(0))))


def surrounding_blanks(c: Column | str) -> Column:
    """struct(lead, body, trail)."""
    x = _col(c)
    lead = F.regexp_extract(x, r"^(\s*)", 1)
    body = strip(x)
    return F.struct(lead.alias("lead"), body.alias("body"), F.when(body == "", "").otherwise(F.regexp_extract(x, r"(\s*)\z", 1)).alias("trail"))


ESCAPES = {"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\^{}", "\\": r"\textbackslash{}", "<": r"\textless{}", ">": r"\textgreater{}"}


def latex_escape(c: Column | str) -> Column:
    """All special characters at once: what an escape brings in isn't escaped again."""
    table = F.create_map(*[F.lit(x) for p in ESCAPES.items() for x in p])
    return F.array_join(F.transform(F.split(_col(c), ""), lambda ch: F.coalesce(F.element_at(table, ch), ch)), "")


def ocr_cleanup(c: Column | str) -> Column:
    return strip(substitute(c, (r"\n+\s+?([^\s])", "\n\n$1")))


def format_document(c: Column | str) -> Column:
    """White space of a whole document."""
    x = F.translate(_col(c), "\u00a0", " ")
    return substitute(x, (r"(?m) $", ""), (r"(?m)\n[\t ]*$", "\n"), (r"(?<!\n) {2,}", " "), (r"\n{3,}", "\n\n"), (r"^\s+", ""))


def superscript(c: Column | str) -> Column:
    return F.translate(_col(c), "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")


def subscript(c: Column | str) -> Column:
    return F.translate(_col(c), "0123456789", "₀₁₂₃₄₅₆₇₈₉")


_MARKED, _UNMARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ’‘“”–—\u00a0", "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY''\"\"-- "
_SPELLED = [("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("…", "...")]
_PLAIN = dict(zip(_MARKED, _UNMARKED)) | dict(_SPELLED)


def to_ascii(c: Column | str) -> Column:
    """Latin letters without their marks and typographic signs in ASCII; other non-ASCII characters go."""
    return F.regexp_replace(replace_all(F.translate(_col(c), _MARKED, _UNMARKED), _SPELLED), r"[^\x00-\x7F]", "")


def next_punctuation(c: Column | str, start: Column | int = 0) -> Column:
    """0-based place of the first of . ? ! and line break from `start` on, or null."""
    at = F.regexp_instr(F.substr(_col(c), F.lit(start) + 1 if isinstance(start, int) else start + 1), F.lit(r"[.?!\n]"))
    return F.when(at > 0, at - 1 + start)


def last_punctuation(c: Column | str, before: Column | int) -> Column:
    """0-based place of the last of . ? ! and line break before `before`, or null; the first character is not looked at."""
    x = _col(c)
    head = F.substr(x, F.lit(2), F.greatest(F.least(F.lit(before) if isinstance(before, int) else before, F.length(x)) - 1, F.lit(0)))
    at = F.regexp_instr(F.reverse(head), F.lit(r"[.?!\n]"))
    return F.when(at > 0, F.length(head) - at + 1)


ENVIRONMENTS = ("bmatrix", "pmatrix", "matrix", "tabular", "table")


def _count(c: Column, literal: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / len(literal)


def close_environments(c: Column | str) -> Column:
    """Appends the ends of the LaTeX environments that are left open."""
    x = _col(c)
    missing = lambda x, env: (_count(x, f"\\begin{{{env}}}") - _count(x, f"\\end{{{env}}}")).cast("int")
    # what one environment needs changes no count of another
    return let(x, lambda x: F.concat(x, *(F.repeat(F.lit(f"\\end{{{env}}}"), F.greatest(F.lit(0), missing(x, env))) for env in ENVIRONMENTS)))


def drop_trailing_title(c: Column | str) -> Column:
    return substitute(c, (r"\n#+ [^\n]*\z", ""))


# --- LaTeX ---------------------------------------------------------------------------------

_WORDS = """rbrack=] lbrack=[ lbrace=\\} rbrace=\\{ lnot=\\neg land=\\wedge vee=\\lor doublecup=\\Cup doublecap=\\Cap llless=\\lll gggtr=\\ggg
doteqdot=\\Doteq ne=\\neq le=\\leq ge=\\geq leftarrow=\\gets rightarrow=\\to restriction=\\upharpoonright owns=\\ni textlnot=\\neg
textellipsis=\\ldots textbullet=\\bullet plusmn=\\pm"""
_OTHERS = r"texttimes=\times textmu=\mu textendash=- textemdash=--- >=\: medspace=\: thinspace=\, negthinspace=\! thickspace=\;"
SYNONYMS = [("\\" + a + " ", b + " ") for a, b in (w.split("=", 1) for w in _WORDS.split())]
SYNONYMS += [("\\" + a, b) for a, b in (w.split("=", 1) for w in _OTHERS.split())]
STYLES = [("\\" + s + "style", "") for s in ("display", "script", "scriptscript", "text")]


_GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi o pi rho varsigma sigma tau upsilon varphi chi psi omega".split()
_SIGNS = """× times÷ div± pm∓ mp· cdot∘ circ∙ cdot≤ leq≥ geq≠ neq≈ approx≡ equiv∼ sim≃ simeq≅ cong∝ propto∞ infty∂ partial∇ nabla∫ int∑ sum∏ prod√ surd∈ in∉ notin∋ ni⊂ subset⊆ subseteq⊃ supset⊇ supseteq
∪ cup∩ cap∅ emptyset∀ forall∃ exists¬ neg∧ wedge∨ lor⊕ oplus⊗ otimes⊥ perp∥ parallel∠ angle→ to← gets↔ leftrightarrow⇒ Rightarrow⇐ Leftarrow⇔ Leftrightarrow↦ mapsto↑ uparrow↓ downarrow⟨ langle⟩ rangle
⌊ lfloor⌋ rfloor⌈ lceil⌉ rceil… ldots⋯ cdots⋮ vdots⋱ ddots† dagger‡ ddagger• bullet★ star⋆ star° degreeℏ hbarℓ ellℜ Reℑ Imℵ aleph′ prime″ prime≪ ll≫ gg⊢ vdash⊨ models⊤ top≜ triangleq□ square◇ diamond△ triangle"""
UNICODE_TEX = [(chr(0x3B1 + i), f"\\{n} " if len(n) > 1 else n) for i, n in enumerate(_GREEK)]
UNICODE_TEX += [(chr(0x391 + i), f"\\{n.capitalize()} ") for i, n in enumerate(_GREEK) if n in ("gamma", "delta", "theta", "lambda", "xi", "pi", "sigma", "upsilon", "psi", "omega")]
UNICODE_TEX += [("ϵ", "\\epsilon "), ("ϕ", "\\phi "), ("ϑ", "\\vartheta "), ("Φ", "\\Phi "), ("µ", "\\mu ")]
UNICODE_TEX += [(m[0], f"\\{m[1]} ") for m in re.findall(r"([^\sa-zA-Z]) ?([a-zA-Z]+)", _SIGNS)]
UNICODE_TEX += list(zip("’‘“”–—−\u00a0\u2009\u202f", ["'", "'", '"', '"', "-", "-", "-", " ", " ", " "]))


_BLANK = " \t\n\v\f\r"
_BLANKS = re.compile(f"[{_BLANK}]{{2,}}")
_COMMANDS = dict(UNICODE_TEX)


def _found_replaced(s: str, table: dict[str, str]) -> str:
    """Characters as the table says; those that the text doesn't have cost nothing."""
    for c in set(s).intersection(table):
        s = s.replace(c, table[c])
    return s


# no synonym makes another or shares a begin with one, so one pass does as much as one after the other
_COMMAND, _SYNONYM = re.compile(r"\\(?:" + "|".join(re.escape(a[1:]) for a, _ in SYNONYMS) + ")"), dict(SYNONYMS)


def _without_synonyms(s: str) -> str:
    return _COMMAND.sub(lambda m: _SYNONYM[m[0]], s)


def _unicode_as_latex(s: str) -> str:
    s = _found_replaced(s.strip(_BLANK), _COMMANDS)
    s = _BLANKS.sub(" ", s.replace("{", " ").replace("}", " ")).strip(_BLANK)
    s = _without_synonyms(s)
    return s if s.isascii() else _found_replaced(s, _PLAIN).encode("ascii", "ignore").decode()


def unicode_to_latex(c: Column | str) -> Column:
    """Characters beyond ASCII as LaTeX commands; braces become blanks, blanks in a row one; letters lose their marks and
    what has no command goes."""
    return mapped(_unicode_as_latex)(_col(c))


def latex_synonyms(c: Column | str) -> Column:
    return let(_col(c), lambda x: F.when(F.contains(x, F.lit("\\")), replace_all(x, SYNONYMS)).otherwise(x))


def remove_styles(c: Column | str) -> Column:
    return replace_all(c, STYLES)


def tex_one_line(c: Column | str) -> Column:
    """Without comments and line breaks."""
    return F.replace(substitute(c, (r"(?<!\\)%.*\n", "\n")), F.lit("\n"), F.lit(" "))


_OPENING, _CLOSING, _COMMENT = re.compile(r"\A(?:\\\(|\\\[|\$\$|\$)"), re.compile(r"(?:\\\)|\\\]|\$\$|\$)\Z"), re.compile(r"(?<!\\)%[^\n]*\n")


def _inline_tex(s: str) -> str:
    s = _CLOSING.sub("", _OPENING.sub("", s.strip(_BLANK))).strip(_BLANK)
    if not s:
        return ""
    s = _without_synonyms(_COMMENT.sub("\n", s).replace("\n", " "))
    for style, _ in STYLES:
        s = s.replace(style, "")
    return f"\\({s}\\)"


def normalise_tex(c: Column | str, inline: bool = True) -> Column:
    """One pair of delimiters off, comments, synonyms and styles normalised, delimiters of one kind on."""
    x = mapped(_inline_tex)(_col(c))
    return x if inline else displayed(x)


def displayed(inline: Column) -> Column:
    """Normalised inline TeX in display delimiters."""
    return F.when(inline == "", "").otherwise(F.concat(F.lit("\\["), F.substr(inline, F.lit(3), F.length(inline) - 4), F.lit("\\]")))


FIGURE = r"(?s)\[(FOOTNOTE|FIGURE|TABLE)([^\]]*+)\](.*?)\[END\1\]"


def extract_figures(c: Column | str) -> Column:
    """Map of marker (kind and id) to body; of repeated markers the last counts."""
    x = _col(c)
    parts = F.arrays_zip(*[F.regexp_extract_all(x, F.lit(FIGURE), F.lit(i)).alias(n) for i, n in ((1, "k"), (2, "i"), (3, "b"))])
    entries = F.transform(parts, lambda p: F.struct(F.concat(p["k"], p["i"]).alias("key"), strip(p["b"]).alias("value")))
    # the last value of each key, keys in order
    sort = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"), e["value"].alias("value"))))
    last = let(sort, lambda a: F.filter(a, lambda e, i: F.coalesce(F.get(a, i + 1)["key"] != e["key"], F.lit(True))))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def without_figure_bodies(c: Column | str) -> Column:
    return substitute(c, (FIGURE, "[$1$2][END$1]"))


def without_figures(c: Column | str) -> Column:
    return substitute(c, (r"\[(FOOTNOTE|FIGURE|TABLE).*?END\1\]", ""))


def without_placeholders(c: Column | str) -> Column:
    """Figures and tables go, from marker to end marker."""
    return substitute(c, (r"\[(FIGURE|TABLE)[^\]\n]*+\].*?\[END\1\]", ""))


def footnotes_in_place(c: Column | str, bodies: Column) -> Column:
    """Empty footnote markers become their bodies from a map, or nothing."""
    x = _col(c)
    names = F.array_distinct(F.regexp_extract_all(x, F.lit(r"\[FOOTNOTE(.*?)\]\[ENDFOOTNOTE\]"), F.lit(1)))
    put = lambda acc, n: F.replace(acc, F.concat(F.lit("[FOOTNOTE"), n, F.lit("][ENDFOOTNOTE]")), F.coalesce(F.try_element_at(bodies, F.concat(F.lit("FOOTNOTE"), n)), F.lit("")))
    return F.aggregate(names, x, put)


def without_line_breaks(parts: Column | str) -> Column:
    return F.transform(_col(parts), lambda x: F.replace(x, F.lit("\n"), F.lit(" ")))


def reversed_texts(parts: Column | str) -> Column:
    """The array from back to front, each text too."""
    return F.reverse(F.transform(_col(parts), F.reverse))


# --- generated pages -------------------------------------------------------------------------


def markdown_compatible(c: Column | str) -> Column:
    """Equation tags, bold maths, links and code fences in the form Markdown has them."""
    tag = r"\(([\d.]+[a-zA-Z]?)\)"
    x = substitute(
        c,
        (rf"(?m)^{tag} \\\[(.+?)\\\]$", r"\\[$2 \\tag{$1}\\]"),
        (rf"(?m)^\\\[(.+?)\\\] {tag}$", r"\\[$1 \\tag{$2}\\]"),
        (rf"(?m)^\\\[(.+?)\\\] {tag} (\\\[.+?\\\])$", r"\\[$1 \\tag{$2}\\] $3"),
    )
    x = replace_all(x, [("\\. ", ". "), ("\\bm{", "\\mathbf{"), ("{\\\\bm ", "\\mathbf{")])
    return substitute(
        x,
        (r"\\mbox\{ ?\\boldmath\$(.*?)\$\}", r"\\mathbf{$1}"),
        (r"((?:https?|ftp)://[\w-]+(?:\.[\w-]+)+[\w.,@?^=%&:/~+#-]*[\w@?^=%&/~+#-])", "[$1]($1)"),
        (r"(?s)```\s*(.+?)\s*```", "```\n$1\n```"),
    )


def heading_rules(c: Column | str) -> Column:
    """Overlong headings become text; headings of numbers alone and a heading that ends the page go."""
    x = strip(substitute(c, (r"(?:\n|^)#+ \d*\W? ?(.{100,})", "\n$1")))
    x = F.replace(x, F.lit("\n* [leftmargin=*]\n"), F.lit("\n"))
    return drop_trailing_title(substitute(x, (r"(?m)^#+ (?:\.?[\dixv])*\s*(?:$|\n\s*)", "")))


def reference_rules(c: Column | str) -> Column:
    """Bibliography lines of initials, empty brackets, lone characters, PMC maths and footnotes."""
    return substitute(
        c,
        (r"(?m)^\* \[\d+\](\s?[A-W]\.+\s?){10,}.*$", ""),
        (r"(?m)^(\* \[\d+\])\[\](.*)$", "$1$2"),
        (r"(^\w\n\n|\n\n\w\z)", ""),
        (r"([\s.,()])_([a-zA-Z0-9])__([a-zA-Z0-9]){1,3}_([\s.,:()])", r"$1\\($2_{$3}\\)$4"),
        (r"([\s.,\d])_([a-zA-Z0-9])_([\s.,\d;])", r"$1\\($2\\)$3"),
        (r"(\nFootnote .*?:) (?:footnotetext|thanks):\W*(.*(?:\n\n|\z))", "$1 $2"),
        (r"\[FOOTNOTE:.+?\](.*?)\[ENDFOOTNOTE\]", ""),
    )


def joiner(c: Column | str, words: Column | None = None) -> Column:
    """White space with which a page can be joined to the next.  `words`: an array of words; null stands for "unknown", which adds a blank."""
    x = _col(c)
    x = F.when(x.endswith(".") | x.endswith("}"), F.concat(x, F.lit("\n\n"))).otherwise(x)
    last = F.substring_index(x, "\n", -1)
    ends = F.lit(True) if words is None else F.array_contains(words, F.substring_index(x, " ", -1))
    return (
        F.when(x.rlike(r"^[A-Z0-9,;:]\n?\z"), F.concat(x, F.lit(" ")))
        .when(x.startswith("#") | x.startswith("**") | x.startswith("\\begin"), F.concat(F.lit("\n\n"), x))
        .when(last.startswith("#") | last.startswith("Figure") | last.startswith("Table"), F.concat(x, F.lit("\n\n")))
        .when(ends, F.concat(x, F.lit(" "))).otherwise(x)
    )


def is_garbage_table(line: Column) -> Column:
    return (_count(line, "\\begin{tabular}") > 15) | (_count(line, "\\multicolumn") > 60) | (_count(line, "&") > 400)


def disclaimer(repeats: Column, repetition: Column) -> Column:
    """What a page that was cut says of it, with the cut rest if there is any."""
    said = F.when(repeats > 0, "WARNING: Truncated because of repetitions").otherwise("ERROR: No output for this page")
    whole = lambda rest: F.when(repeats.isNull() | (rest == ""), "").otherwise(F.concat(F.lit("\n\n+++ =="), said, F.lit("==\n"), rest, F.lit("\n+++\n\n")))
    return let(strip(close_environments(repetition)), whole)


def table_rules(c: Column | str) -> Column:
    """Line breaks about tables, empty tables, leftovers; lines that can't be tables are emptied."""
    lines = F.transform(F.split(_col(c), "\n", -1), lambda x: F.when(is_garbage_table(x), "").otherwise(x))
    x = replace_all(F.array_join(lines, "\n"), [("\\begin{table} \\begin{tabular}", "\\begin{table}\n\\begin{tabular}"), ("\\end{tabular} \\end{table}", "\\end{tabular}\n\\end{table}"), ("\\end{table} Tab", "\\end{table}\nTab")])
    x = substitute(x, (r"(?m)(^.+)\\begin\{tab", "$1\n\\\\begin{tab"))
    x = replace_all(x, [("\\begin{tabular}{l l}  & \\\\ \\end{tabular}", ""), ("\\begin{tabular}{}\n\n\\end{tabular}", ""), ("\\begin{array}[]{", "\\begin{array}{")])
    return substitute(
        x,
        (r"\\begin\{tabular\}\{([clr ]){2,}\}\s*[& ]*\s*(\\\\)? \\end\{tabular\}", ""),
        (r"(\*\*S\. A\. B\.\*\*\n+){2,}", ""),
        (r"(?m)^#+( [\[\d\w])?$", ""),
        (r"(?m)^\.\s*$", ""),
        (r"\n{3,}", "\n\n"),
    )
