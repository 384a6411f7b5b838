"""Clean-up rules over whole texts.  Texts without LaTeX get some by literal replacement first, the same in both forms of a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.operators import pages

from .registry import literal, query, regexes, replaced, stripped, table

HEADED = [("\n", "\n# "), (". ", ".\n## 1.2\n"), ("? ", "?\n* [leftmargin=*]\n")]
CITED = [(", ", " _a__b_, "), (". ", ".\nFootnote 1: thanks: "), ("? ", "?\n* [12][] "), ("\n\n", "\n\n[FOOTNOTE:3]"), (" de ", " _x_ "), (" the ", "[ENDFOOTNOTE] ")]
TABLED = [(". ", ".\\end{table} Tab"), (", ", "\\begin{table} \\begin{tabular}{l l} & & \\end{tabular} \\end{table}"), (" ", " & "), ("\n\n", "\n#\n.\n\n")]
LINKED = [(". ", ".\n(1.2a) \\[x_1\\]\n"), (", ", "\n\\[y\\] (3)\n"), (" the ", " http://a.org/b "), (" de ", " \\bm{z}\\. "), ("? ", " \\mbox{ \\boldmath$v$} ")]
OPENED = [(" de ", "\\begin{tabular}"), (" the ", "\\begin{pmatrix}"), (". ", "\\end{pmatrix}"), (" la ", "\\begin{table}\\end{table}")]
MATHS = [(". ", "% note\n"), (" the ", " \\ne \\displaystyle "), (" de ", " \\le \\textmu"), ("? ", "\\%")]
MARKED = [(". ", "[ENDTABLE] "), (", ", " [TABLE:t1]"), ("\n", "\n[FIGURE:f]")]

_HEADINGS = regexes(replaced(stripped(regexes(replaced("text", HEADED), (r"(?:\n|^)#+ \d*\W? ?(.{100,})", "\n\\1"))), [("\n* [leftmargin=*]\n", "\n")]), (r"(?m)^#+ (?:\.?[\dixv])*\s*(?:$|\n\s*)", ""), (r"\n#+ [^\n]*\z", "")).replace("'\n* [leftmargin=*]\n'", "chr(10) || '* [leftmargin=*]' || chr(10)")


@query(f"SELECT doc_id, {_HEADINGS} AS page FROM documents")
def heading_rules(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.heading_rules(text.replace_all("text", HEADED)).alias("page"))


@query(f"SELECT doc_id, {regexes(replaced('text', HEADED), (chr(92) + 'n#+ [^' + chr(92) + 'n]*' + chr(92) + 'z', ''))} AS page FROM documents")
def trailing_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.drop_trailing_title(text.replace_all("text", HEADED)).alias("page"))


_REFERENCES = regexes(
    replaced("text", CITED),
    (r"(?m)^\* \[\d+\](\s?[A-W]\.+\s?){10,}.*$", ""), (r"(?m)^(\* \[\d+\])\[\](.*)$", r"\1\2"), (r"(^\w\n\n|\n\n\w\z)", ""),
    (r"([\s.,()])_([a-zA-Z0-9])__([a-zA-Z0-9]){1,3}_([\s.,:()])", r"\1\\(\2_{\3}\\)\4"), (r"([\s.,\d])_([a-zA-Z0-9])_([\s.,\d;])", r"\1\\(\2\\)\3"),
    (r"(\nFootnote .*?:) (?:footnotetext|thanks):\W*(.*(?:\n\n|\z))", r"\1 \2"), (r"\[FOOTNOTE:.+?\](.*?)\[ENDFOOTNOTE\]", ""),
)


@query(f"SELECT doc_id, {_REFERENCES} AS page FROM documents")
def reference_rules(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.reference_rules(text.replace_all("text", CITED)).alias("page"))


@query(r"""WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '# ' || text WHEN turn % 3 = 1 THEN text || chr(10) || 'Figure 1' WHEN turn % 5 = 0 THEN left(upper(text), 1) ELSE text END AS t FROM conversations),
b AS (SELECT conv_id, turn, CASE WHEN ends_with(t, '.') OR ends_with(t, '}') THEN t || chr(10) || chr(10) ELSE t END AS t FROM a), c AS (SELECT *, string_split(t, chr(10))[-1] AS l FROM b)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '^[A-Z0-9,;:]\n?\z') THEN t || ' ' WHEN starts_with(t, '#') OR starts_with(t, '**') OR starts_with(t, '\begin') THEN chr(10) || chr(10) || t
WHEN starts_with(l, '#') OR starts_with(l, 'Figure') OR starts_with(l, 'Table') THEN t || chr(10) || chr(10) ELSE t || ' ' END AS joined FROM c""")
def page_joiner(spark, sf_dir):
    t = F.col("text")
    made = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("# "), t)).when(F.col("turn") % 3 == 1, F.concat(t, F.lit("\nFigure 1"))).when(F.col("turn") % 5 == 0, F.left(F.upper(t), F.lit(1))).otherwise(t)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.joiner(made).alias("joined"))


_COUNT = "(length(l) - length(replace(l, {0}, ''))) / {1}"
_GARBAGE = " OR ".join(f"{_COUNT.format(literal(s), len(s))} > {k}" for s, k in (("\\begin{tabular}", 15), ("\\multicolumn", 60), ("&", 400)))
_LINES = f"array_to_string(list_transform(string_split({replaced('text', TABLED)}, chr(10)), lambda l: CASE WHEN {_GARBAGE} THEN '' ELSE l END), chr(10))"
_TABLES = replaced(_LINES, [("\\begin{table} \\begin{tabular}", "\\begin{table}\n\\begin{tabular}"), ("\\end{tabular} \\end{table}", "\\end{tabular}\n\\end{table}"), ("\\end{table} Tab", "\\end{table}\nTab")])
_TABLES = replaced(regexes(_TABLES, (r"(?m)(^.+)\\begin\{tab", "\\1\n\\\\begin{tab")), [("\\begin{tabular}{l l}  & \\\\ \\end{tabular}", ""), ("\\begin{tabular}{}\n\n\\end{tabular}", ""), ("\\begin{array}[]{", "\\begin{array}{")])
_TABLES = regexes(_TABLES, (r"\\begin\{tabular\}\{([clr ]){2,}\}\s*[& ]*\s*(\\\\)? \\end\{tabular\}", ""), (r"(\*\*S\. A\. B\.\*\*\n+){2,}", ""), (r"(?m)^#+( [\[\d\w])?$", ""), (r"(?m)^\.\s*$", ""), (r"\n{3,}", "\n\n"))


@query(f"SELECT doc_id, {_TABLES} AS page FROM documents")
def table_rules(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.table_rules(text.replace_all("text", TABLED)).alias("page"))


_MARKDOWN = regexes(
    replaced("text", LINKED),
    (r"(?m)^\(([\d.]+[a-zA-Z]?)\) \\\[(.+?)\\\]$", r"\\[\2 \\tag{\1}\\]"), (r"(?m)^\\\[(.+?)\\\] \(([\d.]+[a-zA-Z]?)\)$", r"\\[\1 \\tag{\2}\\]"),
    (r"(?m)^\\\[(.+?)\\\] \(([\d.]+[a-zA-Z]?)\) (\\\[.+?\\\])$", r"\\[\1 \\tag{\2}\\] \3"),
)
_MARKDOWN = regexes(
    replaced(_MARKDOWN, [("\\. ", ". "), ("\\bm{", "\\mathbf{"), ("{\\\\bm ", "\\mathbf{")]),
    (r"\\mbox\{ ?\\boldmath\$(.*?)\$\}", r"\\mathbf{\1}"), (r"((?:https?|ftp)://[\w-]+(?:\.[\w-]+)+[\w.,@?^=%&:/~+#-]*[\w@?^=%&/~+#-])", r"[\1](\1)"),
    (r"(?s)```\s*(.+?)\s*```", "```\n\\1\n```"),
)


@query(f"SELECT doc_id, {_MARKDOWN} AS page FROM documents")
def markdown_compatible(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.markdown_compatible(text.replace_all("text", LINKED)).alias("page"))


def _closed(x: str) -> str:
    for env in text.ENVIRONMENTS:
        a, b = (f"(length({x}) - length(replace({x}, '\\{w}{{{env}}}', ''))) / {len(w) + len(env) + 3}" for w in ("begin", "end"))
        yield f"SELECT * REPLACE ({x} || repeat('\\end{{{env}}}', CAST(greatest(0, {a} - {b}) AS BIGINT)) AS {x})"


def _close_sql(source: str, x: str) -> str:
    for step in _closed(x):
        source = f"({step} FROM {source})"
    return source


@query(f"SELECT doc_id, page FROM {_close_sql('(SELECT doc_id, ' + replaced('text', OPENED) + ' AS page FROM documents)', 'page')}")
def close_environments(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.close_environments(text.replace_all("text", OPENED)).alias("page"))


@query(rf"""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 0 WHEN turn % 4 = 2 THEN 7 END AS r, CASE WHEN turn % 8 = 1 THEN '  ' ELSE {replaced('text', OPENED)} END AS page FROM conversations), d AS (SELECT conv_id, turn, r, {stripped('page')} AS p FROM {_close_sql('c', 'page')})
SELECT conv_id, turn, CASE WHEN r IS NULL OR p = '' THEN '' ELSE chr(10) || chr(10) || '+++ ==' || CASE WHEN r > 0 THEN 'WARNING: Truncated because of repetitions' ELSE 'ERROR: No output for this page' END || '==' || chr(10) || p || chr(10) || '+++' || chr(10) || chr(10) END AS disclaimer FROM d""")
def page_disclaimer(spark, sf_dir):
    repeats = F.when(F.col("turn") % 4 == 1, 0).when(F.col("turn") % 4 == 2, 7)
    rest = F.when(F.col("turn") % 8 == 1, F.lit("  ")).otherwise(text.replace_all("text", OPENED))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.disclaimer(repeats, rest).alias("disclaimer"))


@query(r"""SELECT page_id, regexp_replace(CASE WHEN regexp_replace(html, '\s', '', 'g') = '' THEN regexp_replace(regexp_replace(html, '^\n+', ''), '\n+\z', '') ELSE regexp_replace(regexp_replace(html, '^\n+', chr(10)), '\n+\z', chr(10)) END, '[ \t]+', ' ', 'g') AS cleaned FROM pages""")
def html_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_html_whitespace("html").alias("cleaned"))


@query(r"""WITH l AS (SELECT doc_id, string_split(replace(text, '. ', chr(10)) || chr(10) || ' ' || chr(10), chr(10)) AS a FROM documents)
SELECT doc_id, array_to_string(a[1:coalesce(list_max(list_transform(a, lambda x, i: CASE WHEN trim(x) <> '' THEN i END)), 0)], '|') AS parts FROM l""")
def trailing_blank_parts(spark, sf_dir):
    parts = F.split(F.concat(F.replace("text", F.lit(". "), F.lit("\n")), F.lit("\n \n")), "\n", -1)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.drop_trailing_blank(parts), "|").alias("parts"))


@query(r"""SELECT doc_id, array_to_string(list_transform(string_split(text, '. '), lambda x: replace(x, chr(10), ' ')), '|') AS parts FROM documents""")
def parts_in_one_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.without_line_breaks(F.split("text", r"\. ", -1)), "|").alias("parts"))


@query(r"""SELECT doc_id, array_to_string(list_transform(list_reverse(string_split(text, chr(10))), lambda x: reverse(x)), chr(10)) AS reversed FROM documents""")
def reversed_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.reversed_texts(F.split("text", "\n", -1)), "\n").alias("reversed"))


@query(rf"""WITH x AS (SELECT conv_id, turn, repeat(' ', turn % 3) || CASE WHEN turn % 5 = 0 THEN '' ELSE text END || repeat(chr(10), turn % 2) AS x FROM conversations)
SELECT conv_id, turn, regexp_extract(x, '^(\s*)', 1) AS lead, {stripped('x')} AS body, CASE WHEN {stripped('x')} = '' THEN '' ELSE regexp_extract(x, '(\s*)\z', 1) END AS trail FROM x""")
def surrounding_blanks(spark, sf_dir):
    t = F.concat(F.repeat(F.lit(" "), (F.col("turn") % 3).cast("int")), F.when(F.col("turn") % 5 == 0, "").otherwise(F.col("text")), F.repeat(F.lit("\n"), (F.col("turn") % 2).cast("int")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.surrounding_blanks(t).alias("x")).select("conv_id", "turn", "x.*")


_DOCUMENT = regexes("replace(html, chr(160), ' ')", (r"(?m) $", ""), (r"(?m)\n[\t ]*$", "\n"), (r"(^|[^\n]) {2,}", r"\1 "), (r"\n{3,}", "\n\n"), (r"^\s+", ""))


@query(f"SELECT page_id, {_DOCUMENT} AS document FROM pages")
def document_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.format_document("html").alias("document"))


@query(r"""WITH l AS (SELECT doc_id, list_transform(string_split(replace(replace(text, ' the ', '- ' || chr(10)), ', ', '-' || chr(10)), chr(10)), lambda x: regexp_replace(x, '\s+$', '')) AS a FROM documents)
SELECT doc_id, array_to_string(list_transform(list_transform(a, lambda x, i: {'x': x, 'l': CASE WHEN i > 1 AND ends_with(a[i - 1], '-') THEN substr(x, length(split_part(x, ' ', 1)) + 1) ELSE x END, 'n': a[i + 1], 'm': i < len(a)}),
lambda s: CASE WHEN ends_with(s.x, '-') AND s.m THEN left(s.l, greatest(length(s.l) - 1, 0)) || split_part(s.n, ' ', 1) ELSE s.l END), chr(10)) AS joined FROM l""")
def dehyphenation(spark, sf_dir):
    t = text.replace_all("text", [(" the ", "- \n"), (", ", "-\n")])
    return table(spark, sf_dir, "documents").select("doc_id", text.dehyphenate(t).alias("joined"))


@query(r"""WITH p AS (SELECT doc_id, doc_id % 97 AS k, text FROM documents), s AS (SELECT *, substr(text, k + 1) AS t, substr(text, 2, greatest(least(k, length(text)) - 1, 0)) AS h FROM p)
SELECT doc_id, CASE WHEN regexp_matches(t, '[.?!\n]') THEN length(regexp_extract(t, '^[^.?!\n]*')) + k END AS next_stop, CASE WHEN regexp_matches(h, '[.?!\n]') THEN length(h) - length(regexp_extract(h, '[^.?!\n]*\z')) END AS last_stop FROM s""")
def punctuation_places(spark, sf_dir):
    k = (F.col("doc_id") % 97).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", text.next_punctuation("text", k).cast("bigint").alias("next_stop"), text.last_punctuation("text", k).cast("bigint").alias("last_stop"))


_ONE_LINE = f"replace({regexes(replaced('text', MATHS), (r'(^|[^\\])%[^' + chr(92) + 'n]*' + chr(92) + 'n', chr(92) + '1' + chr(10)), (r'(^|[^\\])%[^' + chr(92) + 'n]*' + chr(92) + 'n', chr(92) + '1' + chr(10)))}, chr(10), ' ')"


@query(f"SELECT doc_id, {_ONE_LINE} AS tex FROM documents")
def tex_comments(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.tex_one_line(text.replace_all("text", MATHS)).alias("tex"))


_RAW = "'$$ ' || left(text, 400) || CASE WHEN doc_id % 2 = 0 THEN '$' ELSE '\\]' END"
_BARE = regexes(stripped(replaced("(" + _RAW.replace("left(text, 400)", "text") + ")", MATHS)), (r"^(?:\\\(|\\\[|\$\$|\$)", ""), (r"(?:\\\)|\\\]|\$\$|\$)\z", ""))
_BARE = stripped(_BARE)
_NORMAL = replaced(replaced(f"replace({regexes('b', (r'(^|[^\\])%[^' + chr(92) + 'n]*' + chr(92) + 'n', chr(92) + '1' + chr(10)), (r'(^|[^\\])%[^' + chr(92) + 'n]*' + chr(92) + 'n', chr(92) + '1' + chr(10)))}, chr(10), ' ')", text.SYNONYMS), text.STYLES)


@query(rf"WITH m AS (SELECT doc_id, {_BARE} AS b FROM documents) SELECT doc_id, CASE WHEN b = '' THEN '' ELSE '\(' || {_NORMAL} || '\)' END AS inline, CASE WHEN b = '' THEN '' ELSE '\[' || {_NORMAL} || '\]' END AS display FROM m")
def tex_normal_form(spark, sf_dir):
    t = text.replace_all(F.concat(F.lit("$$ "), F.col("text"), F.when(F.col("doc_id") % 2 == 0, "$").otherwise("\\]")), MATHS)
    d = table(spark, sf_dir, "documents").select("doc_id", text.normalise_tex(t).alias("inline"))
    return d.select("doc_id", "inline", text.displayed(F.col("inline")).alias("display"))


_KINDS = {k: rf"(?s)\[{k}(.*?)\](.*?)\[END{k}\]" for k in ("FIGURE", "TABLE")}


@query(rf"""WITH m AS (SELECT doc_id, replace(replace(text, '. ', '[ENDTABLE] '), ', ', ' [TABLE:t' || (doc_id % 3) || ']') AS t FROM documents),
e AS (SELECT doc_id, t, unnest(range(1, len(regexp_extract_all(t, '{_KINDS['TABLE']}')) + 1)) AS i FROM m),
f AS (SELECT doc_id, i, 'TABLE' || regexp_extract_all(t, '{_KINDS['TABLE']}', 1)[i] AS marker, {stripped(f"regexp_extract_all(t, '{_KINDS['TABLE']}', 2)[i]")} AS body FROM e)
SELECT doc_id, marker, body FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, marker ORDER BY i DESC) = 1""")
def figure_bodies(spark, sf_dir):
    t = F.replace(F.replace("text", F.lit(". "), F.lit("[ENDTABLE] ")), F.lit(", "), F.concat(F.lit(" [TABLE:t"), (F.col("doc_id") % 3).cast("string"), F.lit("]")))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.extract_figures(t)).alias("marker", "body"))


@query(rf"""WITH m AS (SELECT doc_id, {replaced('text', MARKED)} AS t FROM documents)
SELECT doc_id, {regexes('t', (_KINDS['TABLE'], r'[TABLE\1][ENDTABLE]'))} AS emptied, {regexes('t', (r'\[TABLE.*?ENDTABLE\]', ''))} AS searched, {regexes('t', (r'\[TABLE(.*?)\](.*?)\[ENDTABLE\]', ''))} AS shown FROM m""")
def figure_placeholders(spark, sf_dir):
    t = text.replace_all("text", MARKED)
    return table(spark, sf_dir, "documents").select("doc_id", text.without_figure_bodies(t).alias("emptied"), text.without_figures(t).alias("searched"), text.without_placeholders(t).alias("shown"))


@query(r"""WITH m AS (SELECT doc_id, doc_id % 4 AS k, replace(text, ', ', '[FOOTNOTE:' || (doc_id % 7) || '][ENDFOOTNOTE], ') AS t FROM documents)
SELECT doc_id, replace(t, '[FOOTNOTE:' || (doc_id % 7) || '][ENDFOOTNOTE]', CASE WHEN doc_id % 7 < 3 THEN 'note ' || (doc_id % 7) ELSE '' END) AS page FROM m""")
def footnote_bodies(spark, sf_dir):
    t = F.replace("text", F.lit(", "), F.concat(F.lit("[FOOTNOTE:"), (F.col("doc_id") % 7).cast("string"), F.lit("][ENDFOOTNOTE], ")))
    bodies = F.create_map(*[F.lit(x) for i in range(3) for x in (f"FOOTNOTE:{i}", f"note {i}")])
    return table(spark, sf_dir, "documents").select("doc_id", text.footnotes_in_place(t, bodies).alias("page"))


@query(r"""WITH c AS (SELECT conv_id, turn, string_split(text, '. ') AS lines FROM conversations), w AS (SELECT conv_id, unnest(list_filter(string_split(lower(array_to_string(lines, ' ')), ' ')[1:10], lambda x: x <> '')) AS word FROM c),
n AS (SELECT conv_id, word, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT conv_id, count(*) AS pages FROM c GROUP BY conv_id),
f AS (SELECT conv_id, list_sort(list(word)) AS words FROM n JOIN s USING (conv_id) WHERE n >= 0.4 * pages AND NOT starts_with(word, chr(92)) AND word NOT IN (""" + ", ".join(map(literal, pages.HEADER_STOP)) + r""") GROUP BY conv_id),
b AS (SELECT c.*, words, list_transform(lines, lambda x, i: list_sum(list_transform(lines[1:i - 1], lambda y: len(string_split(y, ' '))))) AS before FROM c LEFT JOIN f USING (conv_id))
SELECT conv_id, turn, array_to_string(CASE WHEN words IS NULL THEN lines ELSE list_transform(list_zip(lines, before), lambda p: CASE WHEN coalesce(p[2], 0) < 10 THEN list_reduce(words, lambda acc, w: regexp_replace(CASE WHEN w = '-' THEN regexp_replace(acc, '-\s*\d{1,3}\s*-', '', 'g') ELSE acc END, '(?i)' || regexp_escape(w), '', 'g'), p[1]) ELSE p[1] END) END, '|') AS lines FROM b""")
def header_words_removed(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", r"\. ", -1).alias("lines"))
    return pages.without_header_words(c, "conv_id", "lines").select("conv_id", "turn", F.array_join("lines", "|").alias("lines"))


_MARKS, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ’‘“”–—\u00a0", "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY''\"\"-- "


@query(f"SELECT doc_id, {regexes(replaced(f'translate(text, {literal(_MARKS)}, {literal(_PLAIN)})', [('ß', 'ss'), ('æ', 'ae'), ('œ', 'oe'), ('…', '...')]), (r'[^\x00-\x7F]', ''))} AS plain FROM documents")
def ascii_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.to_ascii("text").alias("plain"))


_GREEKED = "translate(replace(replace(replace(text, ' the ', '≤'), ', ', ' {∞}'), '. ', ' \\ne '), 'aeo', 'αεω')"
_TEXED = stripped(regexes(f"translate({replaced(stripped(_GREEKED), text.UNICODE_TEX)}, '{{}}', '  ')", (r"\s{2,}", " ")))


@query(f"SELECT doc_id, {regexes(replaced(f'translate({replaced(_TEXED, text.SYNONYMS)}, {literal(_MARKS)}, {literal(_PLAIN)})', [('ß', 'ss'), ('æ', 'ae'), ('œ', 'oe'), ('…', '...')]), (r'[^\x00-\x7F]', ''))} AS tex FROM documents")
def unicode_as_latex(spark, sf_dir):
    t = F.translate(text.replace_all("text", [(" the ", "≤"), (", ", " {∞}"), (". ", " \\ne ")]), "aeo", "αεω")
    return table(spark, sf_dir, "documents").select("doc_id", text.unicode_to_latex(t).alias("tex"))
