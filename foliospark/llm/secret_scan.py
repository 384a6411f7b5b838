"""Secrets in source and configuration text, by assignment-aware lexing.

1. Texts are lexed for assignments: ``name = expr``, ``name := expr``, ``name: expr``, ``name: type = expr``, ``"name": expr``,
   ``NAME literal`` after export, set or ENV, ``<name>literal</name>``, ``--name literal``, ``name => expr``, ``bearer literal``, ``scheme://user:literal@``.
   An expression is a chain of quoted literals, names and template holes joined by ``+`` or ``.``; else one bare word.
   Triple-quoted literals, YAML block scalars and private keys in PEM go over several lines, as do literals with a
   backslash before the line break; blanks and line breaks at the ends of the first three don't count.
   The lexer goes from one name, quote, dash or angle bracket to the next and never back, so its time is in proportion to the text.
2. Constants propagate: a name in an expression stands for the literal it was last given in
   the text before, or else for the first it is given after, also within ``${name}`` and ``{name}``.
   Names that stand for each other in a circle stand for nothing; a literal isn't put in where that would make
   one of more than `LONGEST` characters.
3. A pair of name and literal scores: how sensitive the target name is, and the literal's own looks (length,
   entropy, kinds of characters, well-known shapes of keys).  Placeholders, dates, numbers, paths, addresses
   of pages and plain words score low; so does what doesn't look random under names of much else than secrets
   (`WEAK`).  Several lines look like the longest of them.  A literal that flowed from another name counts for the most sensitive of them.
   A literal without a name, whatever its shape, is no pair and isn't reported.

Defined cases: rows without doc_id are scanned and reported with a null; null and empty texts have no secrets;
repeated rows are reported each; an empty table has none.  Literals longer than 4096 characters are judged by length, entropy and
shape as any other.  The literal itself is never returned: only a mask, its length and its SHA-256.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import slices
from .shared import output_schema

THRESHOLD = 0.5
WEAK = 0.65  # weight of names that much else than secrets has: only literals that look random count in full

NAMES = {
    "password": 0.95, "passwd": 0.95, "passphrase": 0.95, "pwd": 0.9, "secret": 0.95, "privatekey": 1.0, "apikey": 1.0, "accesskey": 0.95,
    "secretkey": 1.0, "authtoken": 1.0, "accesstoken": 1.0, "token": 0.9, "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "authorization": 0.8,
    "clientsecret": 1.0, "encryptionkey": 1.0, "signingkey": 1.0, "connectionstring": 0.7, "auth": 0.6, "pass": 0.7, "key": WEAK, "salt": WEAK, "cookie": WEAK, "session": WEAK, "cert": WEAK, "pin": WEAK,
}
_HARMLESS = re.compile(r"(?:public|pub|foreign|primary|sort|partition|cache|row|column|group|field|label|hash|file|path|url|name|id|length|size|type|count|max|min|limit|expir\w*|ttl|hint|policy)$")
_SHAPES = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}\Z|gh[pousr]_[0-9A-Za-z]{36,}\Z|xox[abprs]-[0-9A-Za-z-]{10,}\Z|sk[-_](?:live|test)?[-_]?[0-9A-Za-z]{20,}\Z|AIza[0-9A-Za-z_-]{35}\Z|eyJ[\w-]+\.[\w-]+\.[\w-]*\Z|glpat-[\w-]{20,}\Z|-----BEGIN [A-Z ]*PRIVATE KEY-----")
_EMPTY = re.compile(r"(?i)(?:x{3,}|\*{3,}|\.{3,}|_{3,}|change.?me|example|sample|dummy|placeholder|your[-_ ].*|<.*>|\$\{?\w+\}?|%\w+%|\{\{.*\}\}|none|null|nil|true|false|undefined|todo|test|foo|bar|redacted|env|string|str|int)\Z")
_PLAIN = re.compile(r"(?:[a-z]{1,12}|[A-Z][a-z]{1,14}|\d{1,8}|\d{4}-\d\d-\d\d.*|(?:https?|ftp|file)://[^@\s]*|(?:[\w.-]*/)+[\w.-]*|[\w.+-]+@[\w-]+\.[\w.]+)\Z")

PAIRS = frozenset("pass word,pass phrase,private key,api key,access key,secret key,auth token,access token,client secret,encryption key,signing key,connection string".split(","))  # names of two words
LONGEST = 4096

_PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY[A-Z ]{0,40}-----"
_QUOTED = (
    r'(?>"""(?:[^\\]|\\[\s\S])*?"""|' + r"\'\'\'(?:[^\\]|\\[\s\S])*?\'\'\'|"
    + rf'"\s*+{_PEM}[^"]*+"|' + rf"\'\s*+{_PEM}[^\']*+\'|"
    + r'"(?:[^"\\\n]|\\[\s\S])*+"|\'(?:[^\'\\\n]|\\[\s\S])*+\'|`[^`]*+`)'
)
_NAME = r"(?>[A-Za-z_$][\w$]*+(?:(?:\.|->|::|-)[A-Za-z_$][\w$]*+|\[(?:\"[^\"\n]*+\"|'[^'\n]*+')\])*+)"
_ATOM = rf"(?>[rbufRBUF]{{0,2}}+(?:{_QUOTED})|{_NAME}(?![\w(/@:~%=-]))"
# where an assignment may begin: a name, a quoted name, a dash before an option, a tag
_START = re.compile(rf"""(?P<name>{_NAME})|(?P<key>"(?>[^"\n=:]+)"|'(?>[^'\n=:]+)')|--|<(?=[A-Za-z_])|["']""")
_TAIL = re.compile(
    rf"""(?:[ \t]{{0,8}}:[ \t]{{0,4}}(?>[A-Za-z_][\w\[\]<>.]*+)(?=[ \t]*+(?::=|=>|=(?!=))))?[ \t]*+(?P<op>:=|=>|=(?!=)|:(?![:/]))[ \t]*+(?P<scheme>(?:[Bb]earer|[Bb]asic)[ \t]++)?"""
    rf"""(?P<expr>{_ATOM}(?:\s*+(?:\+|\.\.|<>|\|\|)\s*+{_ATOM})*+|{_PEM}(?>(?:(?!-----)[^"'`])*)-----END [A-Z ]+-----|[|>][-+\d]{{0,2}}(?=[ \t]*+(?:\#[^\n]*+)?\r?\n)|[^\s"'`,;&<>#){{}}\[\]]++)"""
)
_WORD = rf"(?:{_QUOTED}|[^\s\"'`,;&<>-][^\s\"'`,;&<>]*+)"
_COMMAND = re.compile(rf"[ \t]++(?P<name>[A-Za-z_][\w-]*+)[ \t]++(?P<expr>{_WORD})")
_OPTION = re.compile(rf"--[ \t]?(?P<name>[A-Za-z_][\w-]*+)[ \t]++(?P<expr>{_WORD})")
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.-]*+)>(?P<expr>[^<>\n]++)</(?P=name)>")
_BEARER = re.compile(r"[ \t]++(?P<expr>[\w.~+/-]{16,}+=*+)")
_LOGIN = re.compile(r"://[^\s:/@]++:(?P<expr>[^\s:/@]++)@")
_PARTS = re.compile(rf"[rbufRBUF]{{0,2}}+({_QUOTED})|({_NAME})")
_BLOCK = re.compile(r"[|>][-+\d]{0,2}\Z")
_HOLE = re.compile(r"\$?\{(\w++)\}|\$(\w++)")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[^A-Za-z0-9]+")
_IDENTIFIER = re.compile(r"[A-Za-z_.]+\Z")  # unquoted, it is a name and no literal
_IN_URL = re.compile(r"://[^\s:/@]++:([^\s:/@]++)@")
_SOLID = re.compile(r"\S|\Z")
_BLANKS = re.compile(r"[^\S\n]*+")
_ESCAPE = re.compile(r"\\(.)", re.S)
# RE2, over whole Arrow columns: the name of every pair that can score holds one of these, or stands for it before the @ of an address
_HINT = r"(?i)pass|pwd|secret|key|token|credential|bearer|auth|connection|salt|cookie|session|cert|pin|://[^\s:/@]+:[^\s:/@]+@"


def sensitivity(name: str) -> float:
    """How likely a name is that of a secret."""
    parts = [p.lower() for p in _CAMEL.split(name) if p]
    if not parts:
        return 0.0
    best = 0.0
    for i in range(len(parts)):
        for width in (1, 2):
            if i + width > len(parts) or width == 2 and f"{parts[i]} {parts[i + 1]}" not in PAIRS:
                continue
            score = NAMES.get("".join(parts[i : i + width]), 0.0)
            if score and i + width < len(parts) and _HARMLESS.match("_".join(parts[i + width :])):
                score *= 0.3
            if score and i and _HARMLESS.match(parts[i - 1]) and parts[i] == "key":
                score *= 0.3
            best = max(best, score)
    return best


def plausibility(literal: str) -> float:
    """How much a literal looks like a secret."""
    if literal.startswith("-----BEGIN "):  # certificates and public keys are no secrets
        return 1.0 if re.search(_PEM, literal) else 0.0
    if "\n" in literal:
        literal = max((line.strip() for line in literal.split("\n")), key=len)
    n = len(literal)
    if n < 4 or _EMPTY.match(literal):
        return 0.0
    if _SHAPES.match(literal):
        return 1.0
    counts = Counter(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    if _PLAIN.match(literal):
        return 0.35 if n >= 8 and entropy > 2.5 else 0.2
    if " " in literal:
        return 0.3 if kinds >= 3 else 0.15
    return min(1.0, 0.25 + 0.1 * min(kinds, 3) + 0.15 * min(entropy, 4) / 4 + 0.3 * min(n, 20) / 20)


def _random(literal: str) -> bool:
    """Whether letters and digits mix as in a random literal and not as in an identifier."""
    longest = max(literal.split("\n"), key=len)
    if len(longest) >= 16 and (longest.isdigit() or all(any(f(c) for c in longest) for f in (str.islower, str.isupper, str.isdigit))):
        return True
    return sum(a.isdigit() and b.isalpha() or a.isalpha() and b.isdigit() for a, b in zip(longest, longest[1:])) >= 4


def score(weight: float, literal: str) -> float:
    """The score of a literal under a name of that weight."""
    looks = plausibility(literal)
    return weight * looks * (0.5 if weight == WEAK and looks < 1.0 and not _random(literal) else 1.0)


def _literal(quoted: str) -> str:
    triple = len(quoted) >= 6 and quoted[:3] in ('"""', "'''")
    inner = _ESCAPE.sub(lambda m: {"n": "\n", "t": "\t", "\n": ""}.get(m[1], m[1]), quoted[3:-3] if triple else quoted[1:-1])
    return inner.strip() if triple or "-----BEGIN " in inner else inner


def _block(text: str, start: int, header: int) -> str:
    """The YAML block scalar whose name begins at start and whose | or > is at header; empty if the line holds more than the pair."""
    column = start - (text.rfind("\n", 0, start) + 1)
    if text[start - column : start].strip(" -"):
        return ""
    lines, at = [], text.find("\n", header) + 1
    while 0 < at < len(text):
        stop = text.find("\n", at)
        line = text[at : stop if stop >= 0 else len(text)]
        if line.strip() and len(line) - len(line.lstrip(" ")) <= column:
            break
        lines.append(line.strip())
        at = stop + 1
    return ("\n" if text[header] == "|" else " ").join(lines).strip()


def _assignments(text: str):
    """(kind, offset of the pair, of the expression, end, name, expression, operator, scheme) of every assignment, in order."""
    at = 0
    while m := _START.search(text, at):
        at, begin = m.end(), m.start()
        if m["name"] or m["key"]:
            name = m["name"] or m["key"][1:-1]
            got, kind = _TAIL.match(text, m.end()), "="
            if not got and m["name"] in ("export", "set", "setenv", "ENV"):
                got, kind = _COMMAND.match(text, m.end()), "word"
            elif not got and m["name"] in ("bearer", "Bearer"):
                got, kind = _BEARER.match(text, m.end()), "word"
            elif not got and m["name"]:
                got, kind, name = _LOGIN.match(text, m.end()), "login", "password"
            if got:
                groups = got.groupdict()
                yield kind, begin, got.start("expr"), got.end(), groups.get("name") or name, got["expr"], groups.get("op"), groups.get("scheme")
                at = got.end()
            elif m["key"]:
                at = begin + 1
        elif m[0] in ("--", "<"):
            if got := (_OPTION if m[0] == "--" else _ELEMENT).match(text, begin):
                yield "word", begin, got.start("expr"), got.end(), got["name"], got["expr"], None, None
                at = got.end()


def _flow(found: list[tuple[str, float, list, str | None]]) -> list[tuple[str, float] | None]:
    """(literal, weight) of every assignment (name, weight, pieces, bare word if no piece is a literal) or None.  Pieces
    are literals or tuples of a name and what it leaves if it stands for nothing."""
    bound: list[list] = []
    value: list[tuple[str, float] | None] = []
    waiting: dict[str, list[int]] = defaultdict(list)
    names = {f[0] for f in found}
    ended = False  # then bare words are literals, even if they are names

    def evaluate(i: int) -> tuple[str, float] | None:
        _, weight, pieces, bare = found[i]
        out, size, any_ = [], 0, bare is None
        for p, got in zip(pieces, bound[i]):
            if not isinstance(p, tuple):
                out.append(p)
            elif got and size + len(got[0]) <= LONGEST:
                out.append(got[0])
                weight, any_ = max(weight, got[1]), True
            else:
                out.append(p[1])
            size += len(out[-1])
        said = "".join(out) if any_ else bare if ended or not any(p[0] in names for p in pieces) else ""
        return (said, weight) if said else None

    def bind(i: int, name: str, got: tuple[str, float]) -> bool:
        """Whether i has a literal now and had none."""
        for k, p in enumerate(found[i][2]):
            if isinstance(p, tuple) and p[0] == name and not bound[i][k]:
                bound[i][k] = got
        had, value[i] = value[i], evaluate(i)
        return value[i] is not None and had is None

    known: dict[str, tuple[str, float]] = {}
    for i, (name, _, pieces, _) in enumerate(found):
        bound.append([known.get(p[0]) if isinstance(p, tuple) else None for p in pieces])
        value.append(evaluate(i))
        if value[i]:
            known[name] = value[i]
        for n in {p[0] for k, p in enumerate(pieces) if isinstance(p, tuple) and not bound[i][k]}:
            waiting[n].append(i)
    late = {i for w in waiting.values() for i in w}
    later: dict[str, tuple[str, float]] = {}
    new: list[int] = []
    for i in range(len(found) - 1, -1, -1):
        if i in late:
            for n in {p[0] for k, p in enumerate(found[i][2]) if isinstance(p, tuple) and not bound[i][k]}:
                if n in later and bind(i, n, later[n]):
                    new.append(i)
        if value[i]:
            later[found[i][0]] = value[i]

    def spread() -> None:
        while new:  # names given a literal only now may let others have one
            k = new.pop()
            for i in waiting.pop(found[k][0], []):
                if i != k and bind(i, found[k][0], value[k]):
                    new.append(i)

    spread()
    ended = True
    for i, f in enumerate(found):
        if f[3] and not value[i] and (got := evaluate(i)):
            value[i] = got
            new.append(i)
            spread()
    return value


def pairs(text: str) -> list[tuple[int, str, str, float]]:
    """(offset of the literal, name, literal after propagation, sensitivity of the names it flowed through)."""
    found, places = [], []
    seen, first = 0, _SOLID.search(text).start()  # how far line breaks are known, and the present line's first character that isn't blank
    for kind, begin, at, end, name, expr, op, scheme in _assignments(text):
        pieces: list = []
        bare = None
        if kind != "=":
            pieces = [_literal(expr) if expr[0] in "\"'`" and len(expr) > 1 else expr.strip()]
        elif op == ":" and _BLOCK.match(expr):
            pieces = [_block(text, begin, at)]
        else:
            sure = False
            for p in _PARTS.finditer(expr) if expr[0] in "\"'`" or _PARTS.match(expr) else ():
                if p[1] is None:
                    pieces.append((p[2], ""))
                    continue
                sure, piece, done = True, _literal(p[1]), 0
                for h in _HOLE.finditer(piece):
                    pieces += [piece[done : h.start()], (h[1] or h[2], h[0])]
                    done = h.end()
                pieces.append(piece[done:])
            if not sure:
                # an unquoted word is a literal where the line holds nothing but the pair, as configuration does
                if (stop := text.rfind("\n", seen, begin)) >= 0:
                    first = _SOLID.search(text, stop).start()
                seen = begin
                after = text[(q := _BLANKS.match(text, end).end()) : q + 1] if begin - first < 12 else "x"
                alone = text[first:begin].strip() in ("", "-", "export", "set", "local", "readonly") if after in ("", "\n", "#", ";") else False
                bare = expr if scheme or expr.startswith("-----BEGIN ") or alone and not _IDENTIFIER.match(expr) else ""
        found.append((name, sensitivity(name), pieces, bare))
        places.append((at, kind == "login"))
    out = []
    for (at, login), (name, *_), got in zip(places, found, _flow(found)):
        if got:
            out.append((at, name, *got))
            out += [(at, "password", c[1], NAMES["password"]) for c in _IN_URL.finditer(got[0])] if not login else []
    return out


def _mask(literal: str) -> str:
    return literal[:2] + "*" * 6 if len(literal) > 8 else "*" * 6


def _scanner(threshold: float):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(1)
                hit = pc.fill_null(pc.match_substring_regex(texts, _HINT), False)
                rows = np.flatnonzero(np.asarray(hit))
                found = []
                for i in rows.tolist():
                    for at, name, literal, weight in pairs(texts[i].as_py()):
                        if weight:
                            likely = score(weight, literal)
                            if likely >= threshold:
                                found.append((i, at, name, likely, _mask(literal), len(literal), hashlib.sha256(literal.encode("utf-8", "replace")).hexdigest()))
                cols = list(zip(*found)) or [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.int64(), pa.string()]
                cols = [pa.array(c, k) for c, k in zip(cols, kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(cols[0]), *cols[1:]], names=["doc_id", "start_char", "name", "score", "mask", "length", "sha256"])

    return run


def secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start_char, name, score, mask, length, sha256) of every pair that reaches the threshold."""
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_scanner(threshold), output_schema(src, ["doc_id"], "start_char bigint, name string, score double, mask string, length bigint, sha256 string"))
