"""Secret scans by assignment-aware lexing (operator 9).

Source and configuration syntax in a text is lexed: comments, strings (plain, triple-quoted, in
backquotes, over several lines where the syntax allows it), braces, definitions, and heads of
assignments (``name =``, ``"name":``, ``name: type =``, ``name :=``, ``name +=``).  Assignments are taken
in order and by scope: a name stands for what it was given last, in its own block or one around it, so
constants are propagated through names and concatenation, and a name that was given something else
since no longer stands for its old literal.  Each literal is scored by the name that it reaches and
by how random it looks.  Comments and strings are lexed inside too, with names of their own.  Three
plain patterns (assign, access, hex) are always reported.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

KINDS = ("assign", "access", "hex", "named", "flow")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_HEX_MAP = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))
_STEMS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_NAME = rb"[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z0-9_$]+)*"
_STRING = rb'"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\.)*"|(?<![A-Za-z0-9])\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`'
_BARE = rb"[A-Za-z0-9+/_.=$@!%^*~-]+"
#: What can stand between a name and its = as a type.
_TYPE = rb"(?:[\x20\t]*:[\x20\t]*[A-Za-z_][A-Za-z0-9_.,|\[\]\x20\t]*?(?=[\x20\t]*=(?![=>])))?"
_TOKEN = re.compile(
    rb"""(?P<comment>/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)|(?<![:/A-Za-z0-9])//[^\n]*|(?<![^\s;{(])\#[^\n]*)
    |["'](?P<quoted>%s)["'][\x20\t]*(?:=>|[:=])(?!=)
    |(?P<string>%s)
    |(?P<indent>(?m:^)[\x20\t]*)(?:export[\x20]+|public[\x20]+|async[\x20]+)*(?:def|class|function|func|fn)[\x20]
    |(?<![A-Za-z0-9_.$-])-{0,2}(?P<name>%s)%s[\x20\t]*(?P<more>\+=|:=|=>|[:=])(?!=)
    |(?P<brace>[{}])"""
    % (_NAME, _STRING, _NAME, _TYPE),
    re.S | re.X,
)
_PART = re.compile(rb"(?P<string>%s)|(?P<bare>%s)" % (_STRING, _BARE), re.S)
_GAP = re.compile(rb"[\x20\t]*(?:\([\x20\t\r\n]*)*")
#: What joins the parts of an expression: +, or nothing between strings, also over line ends.
_JOIN = re.compile(rb"[\x20\t]*\\?\s*\+[\x20\t]*\\?\s*|[\x20\t]*\\?\s*(?=[\"'])")
_IS_NAME = re.compile(rb"%s\Z" % _NAME)
#: Strings and comments in strings and comments are lexed so deep.
_DEPTH = 3

#: Weight of a word in a target name.  With a random literal each is enough to report it.
_WEIGHT = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 0.9, "authkey": 0.9, "auth": 0.65, "bearer": 0.8, "pin": 0.6, "key": 0.6, "salt": 0.6, "signature": 0.6}
#: A sensitive name before a sign of assignment: without one no literal can be reported.
_AIM = re.compile(rb"(?i)(?<![A-Za-z0-9_$.-])(?=[A-Za-z0-9_$.-]*?(?:pass|pwd|secret|token|key|cred|auth|bearer|salt|signature|pin))[A-Za-z0-9_$.-]++[\"']?%s[\x20\t]*(?:\+=|:=|=>|[:=])(?!=)" % _TYPE)
_WORDS_OF = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_DULL = re.compile(rb"(?i)(?:x+|\*+|\.+|none|null|nil|true|false|todo|changeme|example|placeholder|undefined|your[_-].*|<.*>|\$\{?.*)\Z")
#: A pass phrase: three words or more, and no sentence.
_PHRASE = re.compile(rb"[A-Za-z0-9]+(?:[\x20_-][A-Za-z0-9]+){2,}\Z")
#: Least score of a reported literal.
REPORT_FROM = 0.55


def name_weight(name: str) -> float:
    """0 to 1: how sensitive what is stored under this name is."""
    words = [w.lower() for w in _WORDS_OF.findall(name)]
    pairs = [a + b for a, b in zip(words, words[1:])]
    return max((_WEIGHT.get(w, 0.0) for w in words + pairs), default=0.0)


def literal_weight(value: bytes, quoted: bool) -> float:
    """0 to 1: how likely the literal is a credential rather than prose or a placeholder."""
    n = len(value)
    if n < 6 or _DULL.match(value):
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    if b" " in value or b"\n" in value:  # a phrase is enough under the names that weigh most only
        return 0.55 if quoted and _PHRASE.match(value) else 0.0
    digits = any(48 <= c <= 57 for c in value)
    if not quoted and not (digits and n >= 8):
        return 0.0
    return min(1.0, 0.45 + 0.1 * bits + 0.15 * digits)


Literal = tuple[int, int, bool]  # start, end, quoted


class _Lexer:
    """Literals that reach sensitive names in one text; ``found`` has the kind of each place."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.found: dict[tuple[int, int], str] = {}

    def run(self, start: int, end: int, depth: int) -> None:
        """Lexes a stretch of the text with names of its own."""
        raw = self.raw
        if not _AIM.search(raw, start, end):
            return
        scopes: list[tuple[int | None, dict[bytes, dict[Literal, None]]]] = [(None, {})]  # indent of a definition, or None for a brace
        at = line = seen = start
        first = True  # no head on this line so far
        while m := _TOKEN.search(raw, at, end):
            at = max(m.end(), at + 1)
            kind = m.lastgroup
            if kind in ("comment", "string"):
                if depth < _DEPTH:
                    self.run(m.start() + 1, m.end() if kind == "comment" else m.end() - 1, depth + 1)
            elif kind == "indent":
                self.leave(scopes, len(m["indent"]))
                scopes.append((len(m["indent"]), {}))
            elif kind == "brace":
                if m["brace"] == b"{":
                    scopes.append((None, {}))
                elif len(scopes) > 1:
                    scopes.pop()
            else:
                newline = raw.rfind(b"\n", seen, m.start())
                if newline >= 0:
                    line, first = newline + 1, True
                seen = m.start()
                if first and not (lead := raw[line : m.start()]).strip():
                    self.leave(scopes, len(lead))
                first = False
                name = m["quoted"] or m["name"]
                parts, at = self.expression(at, end, scopes, depth)
                self.assign(name, parts, scopes, m["more"] == b"+=")

    @staticmethod
    def leave(scopes: list, indent: int) -> None:
        """Ends the definitions that a line with this indent isn't in."""
        while len(scopes) > 1 and scopes[-1][0] is not None and scopes[-1][0] >= indent:
            scopes.pop()

    def expression(self, at: int, end: int, scopes: list, depth: int) -> tuple[list[tuple[Literal, bool]], int]:
        """The literals that an expression stands for, and which of them are written in it; and where it ends."""
        raw, parts = self.raw, []
        pos = _GAP.match(raw, at, end).end()
        while m := _PART.match(raw, pos, end):
            if m["string"] is not None:
                quotes = 3 if m.group()[:3] in (b'"""', b"'''") and m.end() - m.start() >= 6 else 1
                parts.append(((m.start() + quotes, m.end() - quotes, True), True))
                if depth < _DEPTH:
                    self.run(m.start() + quotes, m.end() - quotes, depth + 1)
            elif raw[m.end() : m.end() + 1] not in (b"(", b"["):  # not a call or a place in something
                parts += self.bare(m.start(), m.end(), scopes)
            at, joined = m.end(), _JOIN.match(raw, m.end(), end)
            if not joined:
                break
            pos = joined.end()
        return parts, at

    def bare(self, start: int, end: int, scopes: list) -> list[tuple[Literal, bool]]:
        value = self.raw[start:end]
        for piece in (value, *value.split(b"+")):
            if _IS_NAME.match(piece) and self.known(piece, scopes) is not None:
                return [(x, False) for y in ((value,) if piece == value else value.split(b"+")) for x in self.known(y, scopes) or ()]
        return [((start, end, False), True)]

    @staticmethod
    def known(name: bytes, scopes: list) -> dict[Literal, None] | None:
        return next((names[name] for _, names in reversed(scopes) if name in names), None)

    def assign(self, name: bytes, parts: list[tuple[Literal, bool]], scopes: list, more: bool) -> None:
        new = dict.fromkeys(x for x, _ in parts)
        names = scopes[-1][1]
        if more and name in names:
            names[name].update(new)
        else:
            names[name] = dict.fromkeys([*((self.known(name, scopes) or ()) if more else ()), *new])
            new = names[name]
        weight = name_weight(name.decode("ascii"))
        if weight > 0:
            here = {x for x, written in parts if written}
            for x in new:
                s, e, quoted = x
                if weight * literal_weight(self.raw[s:e], quoted) >= REPORT_FROM:
                    if x in here:
                        self.found[s, e] = "named"
                    else:
                        self.found.setdefault((s, e), "flow")


def _flows(raw: bytes) -> list[tuple[str, int, int]]:
    """The literals that reach a sensitive name, with their places."""
    lexer = _Lexer(raw)
    lexer.run(0, len(raw), 0)
    return [(kind, s, e) for (s, e), kind in lexer.found.items()]


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text in code points, by start, then kind, then end."""
    if not text:
        return []
    # One byte for each code point; what isn't ASCII becomes '?', which no pattern takes.
    raw = text.encode("ascii", "replace")
    low, spans = raw.lower(), []
    separated = b"=" in raw or b":" in raw
    if separated and any(s in low for s in _STEMS):
        spans += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(raw) if m.end(1) - m.start(1) >= 6]
    if b"AKIA" in raw:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    if b"x" * 24 in raw.translate(_HEX_MAP):
        spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(raw)]
    if separated and _AIM.search(raw):
        spans += _flows(raw)
    return sorted(spans, key=lambda x: (x[1], _ORDER[x[0]], x[2]))


def redact(text: str | None, spans: list[tuple[str, int, int]], mask: str = "[SECRET]") -> str | None:
    """The text with each maximal run of covered characters replaced by ``mask``."""
    if not text or not spans:
        return text
    out, at, i = [], 0, 0
    ordered = sorted((s, e) for _, s, e in spans)
    while i < len(ordered):
        s, e = ordered[i]
        i += 1
        while i < len(ordered) and ordered[i][0] <= e:
            e = max(e, ordered[i][1])
            i += 1
        out += [text[at:s], mask]
        at = e
    return "".join(out) + text[at:]


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Spans of secrets of each text, and the text without them.

    Returns ``keep`` (by default ``id_col``), ``spans`` (array of kind, start, end; code points, end
    exclusive; ordered by start, then kind) and ``redacted`` (each run of covered characters replaced
    by a mark), one row per input row.  Narrow, no shuffle.

    Null and empty texts have no spans and come back as they are.  Texts are scanned whole.  Spans
    of different kinds may overlap; ties are ordered by kind, then end.  Repeated rows give repeated
    results, a null id stays null, an empty table gives none, other columns are not read.
    """
    added = T.StructType([T.StructField("spans", _SPAN), T.StructField("redacted", T.StringType())])

    def make():
        def each(text):
            spans = scan(text)
            return ([{"kind": k, "start": s, "end": e} for k, s, e in spans], redact(text, spans))

        return each

    return map_texts(df, keep or [id_col], text_col, added, make)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind and the spans as strings, from what ``scan_secrets`` returns."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return scanned.select(
        id_col,
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
