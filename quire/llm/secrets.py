"""Secret scans by assignment-aware lexing.

Source and configuration text is read as pairs of a name and a literal: assignments of programs,
keys of JSON, YAML, INI, properties and shell files, keyword arguments, elements and attributes of
markup, command line flags, headers and the userinfo of addresses. A value may be quoted, bare, a
call that wraps a literal or has one as its default, or a concatenation; names in it stand for the
constants assigned to them earlier in the same text, also within strings ("${NAME}"), and a literal
that reaches a sensitive name that way is marked where it is written. A literal counts by the words
of its target's name (``NAME_WORDS``) times how much it looks like a secret (characters, kinds of
characters, length; placeholders count nothing); from ``THRESHOLD`` on it is a span of kind ``literal``.
Beside these come three fixed patterns: kinds ``assign``, ``access`` and ``hex``.

Each text is scanned alone, in Arrow batches, without a shuffle. All patterns are possessive or
bounded by the next delimiter, so the time is linear in the text, very long ones included. Defined
cases: null and empty texts have no spans; every row of the input gives one row, repeated rows and
null identifiers included; spans of one kind that several rules find at the same place count once
(the highest score stays); of ties in start the kinds come in the order of ``KINDS``, then by end; an
empty table gives an empty one; other columns are ignored by ``scanned`` and kept by ``redacted``. A
propagated value of more than ``LONGEST`` code points, or of more than 64 literals, is taken as
unknown: no credential is that long, and values that double at each line would grow without bound.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import sliced

KINDS = ("assign", "access", "hex", "literal")
BASE = KINDS[:3]
THRESHOLD = 0.5
LONGEST = 1 << 16

#: Fixed patterns. Shorter runs than asked for are dropped, and a longer match can't begin inside one, so
#: access and hex ask for the length at once.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
HEX = re.compile("[0-9a-f]{16,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: How sensitive a target is by a word, or two words in a row, of its name.
NAME_WORDS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pwd": 0.9, "pass": 0.8, "secret": 1.0, "secrets": 0.9,
    "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "authorization": 0.9, "bearer": 0.8,
    "signature": 0.6, "salt": 0.6, "pin": 0.6, "api key": 1.0, "access key": 0.9, "secret key": 1.0, "private key": 1.0,
    "encryption key": 0.9, "signing key": 0.9, "master key": 0.9, "account key": 0.9, "auth key": 0.9, "session key": 0.8,
    "connection string": 0.7,
}
#: A name that ends in one of these tells of a secret rather than holding it.
ABOUT = frozenset("url uri path file filename name id length len count type field label hint policy regex pattern ttl expiry expires timeout format prefix suffix size min max limit enabled required header endpoint version".split())
PLACEHOLDER = re.compile(r"(?i)(change.?me|example|placeholder|your.|dummy|redacted|insert|todo|none$|null$|undefined|true$|false$|x{4,}|\*{3,}|\.{3}|\$\{|\{\{|%\(|<[a-z_ -]+>|%[sd])")

#: A text without any of these has no name that counts.
HINTS = tuple(sorted({w.split()[-1] for w in NAME_WORDS} | {"pass"}))

WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
HEAD = re.compile(
    r"""(?<![\w$.-])(?:--?)?(?P<q>["'`]?)(?P<name>[A-Za-z_$@](?:[\w$@]|-(?=\w))*+(?:(?:\.|->|::)[A-Za-z_$](?:[\w$]|-(?=\w))*+)*+(?:\[[ ]?["']?[\w.-]++["']?[ ]?\])*+)(?P=q)
    (?:[ \t]*+:[ \t]*+[A-Za-z_][\w.]*+(?:\[[\w.,| ]*+\])?(?=[ \t]*+=))?[ \t]*+(?:=>|:=|\?=|\+=|=(?![=~>])|:(?![:/=]))[ \t]*+""",
    re.X | re.A,
)
FLAG = re.compile(r"""(?<![\w-])--?(?P<name>[A-Za-z](?:\w|-(?=\w))*+)[ \t]++(?!-)""", re.A)
STRING = re.compile(r"""(?P<prefix>[fFrRbBuUL$@]{0,2})(?:"(?P<d>(?:[^"\\\n]|\\.)*+)"|'(?P<s>(?:[^'\\\n]|\\.)*+)'|`(?P<b>(?:[^`\\]|\\.)*+)`)""", re.A | re.S)
TRIPLE = re.compile("\"{3}|'{3}")
CALL = re.compile(r"(?:new[ ]+)?(?P<callee>[A-Za-z_][\w.]*+)\(\s*+", re.A)
REFERENCE = re.compile(r"\$?\{?(?P<name>[A-Za-z_$](?:\w|-(?=\w))*+(?:\.[A-Za-z_]\w*+)*+)\}?(?![\w(\[-])", re.A)
BARE = re.compile(r"(?:(?:Bearer|Basic|Token|Digest)[ \t]++)?(?P<v>[^\s\"'`,;=:<>{}()\[\]]++=*+)", re.A)
PLUS = re.compile(r"\s*+(?:\+|\.\.|[.&](?=[ \t\"']))\s*+|[ \t]*+\\?\n?[ \t]*+(?=[\"'])")
INNER = re.compile(r"\$?\{(?P<name>[A-Za-z_]\w*+)\}", re.A)
#: Calls whose first argument is a name to look up; a literal may follow it as the default.
LOOKUPS = re.compile(r"(?i)(^|\.)(getenv|env|get|config|environ|getproperty|fetch|lookup)$")
WRAPPERS = re.compile(r"(?i)(decode|encode|str|string|bytes|secret|secretstr|quote|trim|strip|of|from)$")
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.:-]*+)(?:[ \t\n][^<>]*+)?>(?P<v>[^<>]*+)</(?P=name)[ \t]*+>", re.A)
TAG = re.compile(r"<[A-Za-z][^<>]*+>", re.A)
ATTRIBUTE = re.compile(r"""(?<![\w-])(?P<name>key|name|value)[ ]?=[ ]?(?:"(?P<d>[^"<>]*+)"|'(?P<s>[^'<>]*+)')""", re.A | re.I)
USERINFO = re.compile(r"""://[^\s/:@"'<>]*+:(?P<v>[^\s/@"'<>]++)@""", re.A)

Piece = tuple[int, int, str]  # where a literal stands, and what it says


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three fixed patterns."""
    low = text.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def sensitivity(name: str) -> float:
    """0 to 1: the highest weight of a word or two words of the name, a third of it if the name is about a secret."""
    words = [w.lower() for w in WORD.findall(name)]
    if not words:
        return 0.0
    best = max(NAME_WORDS.get(w, 0.0) for w in [*words, *map(" ".join, zip(words, words[1:]))])
    return best / 3 if words[-1] in ABOUT or words[0] in ("public", "no", "is", "has") else best


def likeness(value: str, quoted: bool) -> float:
    """0 to 1: how much a literal looks like a secret."""
    n = len(value)
    if n < 6 or len(set(value)) < 3 or PLACEHOLDER.search(value):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = bool(re.search("[a-z]", value)) + bool(re.search("[A-Z]", value)) + bool(re.search("[0-9]", value)) + bool(re.search(r"[^A-Za-z0-9\s]", value))
    score = 0.55 * min(1.0, entropy / 3.2) + 0.25 * min(1.0, (kinds - 1) / 2) + 0.2 * min(1.0, n / 12)
    if re.search(r"\s", value):
        score *= 0.5  # prose
    elif value.isalpha():
        score *= 0.95 if quoted else 0.5  # a word
    return score


class Lexer:
    """Pairs of one text, in order, with constants known so far."""

    def __init__(self, text: str) -> None:
        self.text, self.known, self.no_triple = text, {}, set()
        self.scores: dict[tuple[str, bool], float] = {}
        self.found: dict[tuple[int, int], tuple[float, str]] = {}

    def string(self, at: int) -> tuple[list[Piece], int] | None:
        """The literals of a string at a place, constants in it resolved, and where it ends."""
        text = self.text
        if m := TRIPLE.match(text, at):
            end = -1 if m[0] in self.no_triple else text.find(m[0], m.end())
            if end >= 0:
                return [(m.end(), end, text[m.end() : end])], end + 3
            self.no_triple.add(m[0])
            return None
        m = STRING.match(text, at)
        if m is None:
            return None
        group = m.lastgroup
        start, raw = m.start(group), m[group]
        pieces, last = [], 0
        if self.known and "{" in raw:
            for x in INNER.finditer(raw):
                if inner := self.known.get(x["name"]):
                    if x.start() > last:
                        pieces.append((start + last, start + x.start(), raw[last : x.start()]))
                    pieces += inner
                    last = x.end()
        if last < len(raw) or not pieces:
            pieces.append((start + last, start + len(raw), raw[last:]))
        return pieces, m.end()

    def term(self, at: int, depth: int = 0) -> tuple[list[Piece], int, bool] | None:
        """Literals, end and whether they are quoted, of a string, a call, a known name or a bare word."""
        text = self.text
        if got := self.string(at):
            return (*got, True)
        if (m := CALL.match(text, at)) and depth < 4:
            inner = self.term(m.end(), depth + 1)
            if LOOKUPS.search(m["callee"]):
                comma = re.compile(r"\s*+,\s*+").match(text, inner[1]) if inner else None
                return self.term(comma.end(), depth + 1) if comma else None
            return inner if inner and (inner[2] or WRAPPERS.search(m["callee"])) and WRAPPERS.search(m["callee"]) else None
        if (m := REFERENCE.match(text, at)) and m["name"] in self.known:
            pieces = self.known[m["name"]]
            return (pieces, m.end(), True) if pieces else None
        if m := BARE.match(text, at):
            return [(m.start("v"), m.end("v"), m["v"])], m.end(), False
        return None

    def value(self, at: int) -> tuple[list[Piece], bool] | None:
        """The literals that an expression puts together, None if that isn't known or too long."""
        if self.text.startswith("(", at):
            at += 1
        pieces, quoted, size = [], False, 0
        while got := self.term(at):
            pieces = pieces + got[0] if pieces else got[0]
            size += sum(len(p[2]) for p in got[0])
            quoted = quoted or got[2]
            if size > LONGEST or len(pieces) > 64:
                return None
            plus = PLUS.match(self.text, got[1]) if got[2] else None
            if not plus or plus.end() == got[1]:
                break
            at = plus.end()
        return (pieces, quoted) if pieces else None

    def pair(self, name: str, pieces: list[Piece], quoted: bool) -> None:
        weight = sensitivity(name)
        if not weight:
            return
        said = pieces[0][2] if len(pieces) == 1 else "".join(p[2] for p in pieces)
        if (said, quoted) not in self.scores:
            self.scores[said, quoted] = likeness(said, quoted)
        score = round(weight * self.scores[said, quoted], 6)
        if score >= THRESHOLD:
            for start, end, _ in pieces:
                if end > start:
                    self.found[start, end] = max(self.found.get((start, end), (0.0, "")), (score, name))

    def run(self) -> dict[tuple[int, int], tuple[float, str]]:
        """(start, end) of each literal that counts: score and the target's name."""
        text = self.text
        for m in HEAD.finditer(text):
            name = m["name"]
            got = self.value(m.end())
            short = re.split(r"\.|->|::", name)[-1]
            if got:
                pieces, quoted = got
                if m[0].rstrip().endswith("+=") and self.known.get(name):
                    pieces = self.known[name] + pieces
                self.pair(name, pieces, quoted)
                keep = pieces if quoted and sum(len(p[2]) for p in pieces) <= LONGEST and len(pieces) <= 64 else None
                if keep is None and not quoted and "\n" not in m[0]:
                    keep = pieces  # a bare value of a configuration file may be named later
            else:
                keep = None
            self.known[name] = self.known[short] = keep
        if "-" in text:
            for m in FLAG.finditer(text):
                if sensitivity(m["name"]) and (got := self.value(m.end())):
                    self.pair(m["name"], *got)
        if "<" in text:
            for m in ELEMENT.finditer(text):
                self.pair(m["name"], [(m.start("v"), m.end("v"), m["v"])], True)
            for tag in TAG.finditer(text):
                by = {x["name"].lower(): x for x in ATTRIBUTE.finditer(text, tag.start(), tag.end())}
                name, value = by.get("key") or by.get("name"), by.get("value")
                if name and value:
                    self.pair(name[name.lastgroup], [(*value.span(value.lastgroup), value[value.lastgroup])], True)
        if "://" in text:
            for m in USERINFO.finditer(text):
                self.pair("password", [(m.start("v"), m.end("v"), m["v"])], True)
        return self.found


def spans_of(text: str | None) -> list[dict]:
    """All spans of a text, by start, then kind, then end: kind, start, end (code points), name, score."""
    if not text:
        return []
    found = {(start, KINDS.index(kind), end): (None, 1.0) for start, end, kind in base_spans(text)}
    low = text.lower()
    if ("://" in text) or (("=" in text or ":" in text or "<" in text or "--" in text) and any(h in low for h in HINTS)):
        for (start, end), (score, name) in Lexer(text).run().items():
            found[start, 3, end] = (name, score)
    return [{"kind": KINDS[kind], "start": start, "end": end, "name": name, "score": score} for (start, kind, end), (name, score) in sorted(found.items())]


SPAN = "array<struct<kind string, start long, end long, name string, score double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end, name, score) for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            spans = pa.array([spans_of(t.as_py()) for t in batch.column(1)], _SPAN_TYPE)
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {SPAN}")


def secret_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal, top_score for each row of docs."""
    rows = scanned(docs).withColumnRenamed("spans", "found")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("found")).alias("spans"),
        count("literal").alias("n_literal"), F.array_max(F.transform("found", lambda s: s["score"])).alias("top_score"),
    )


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every run of characters that spans cover replaced in ``text``; nulls stay, other columns too."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else _clean(t, mark))

    return docs.withColumn("text", clean("text"))


def _clean(text: str, mark: str) -> str:
    out, at = [], 0
    for s in spans_of(text):
        if s["start"] > at or not out and s["start"] == at:
            out += [text[at : s["start"]], mark]
        at = max(at, s["end"])
    return "".join(out) + text[at:] if out else text
