"""Secret scans: fixed patterns, and an assignment-aware lexer for source and configuration text.

The lexer reads name-operator-value statements (`name = "x"`, `name: x`, `"name" => 'x'`,
`name := x`, `<name>x</name>`), keeps the constants a text assigns, follows references and
concatenations of them, and scores each literal by how sensitive the names are that it reaches.

Spans are `kind:start:end` in code points, end exclusive, ordered by start, then kind in the
order assign, access, hex, lex, then end.  A lex span that lies inside a span of the fixed
patterns is not repeated.  A literal is read to its closing quote or last character, and a
concatenation to its last piece.  Null text counts as empty: no spans, and the digest of nothing.
Repeated rows are scanned each for itself; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

# The patterns of the base scan.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

KINDS = ("assign", "access", "hex", "lex")

FIELDS = T.StructType(
    [
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("n_lex", T.LongType()),
    ]
)

#: How much each part of a target name says that its value is secret.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 0.9, "signingkey": 0.9,
    "encryptionkey": 0.9, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.5, "key": 0.4, "salt": 0.4,
}
#: Values that stand for a secret without being one.
PLACEHOLDERS = re.compile(
    r"(?i)^(?:x+|\*+|\.+|-+|_+|null|none|nil|true|false|undefined|change_?me|example.*|your[_-].*|placeholder|redacted|dummy|todo|password|secret|token|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s)$"
)

#: Characters kept of each end of a literal, more than any placeholder's fixed part.
ENDS = 32
_OP = re.compile(r":=|=>|[:=]")
#: The last name of a stretch of text, read backwards; and a type between a name and its operator, as in `name: str = x`.
_NAME_BACK = re.compile(r"""["'\]]{0,2}([\w$.-]++)""", re.ASCII)
_NAME_START = re.compile(r"[A-Za-z_$]", re.ASCII)
_TYPE = re.compile(r"[ \t]*[A-Za-z_][\w\[\]<>., |]*+[ \t]*", re.ASCII)
_VALUE = re.compile(
    r"""[ \t]*(?:[bruf]{1,2}(?=["']))?(?:"((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)'|`([^`\n]*+)`|(?=([A-Za-z0-9_$@%+/.=~^!*#&?-])))""",
    re.ASCII,
)
_BARE = re.compile(r"[A-Za-z0-9_$@%+/.=~^!*#&?-]++")
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.|\.(?=[ \t]*[\"'$])|\\?\n[ \t]*(?=[\"']))")
_TAG = re.compile(r"<([A-Za-z_][\w.-]*+)>([^<>\s]++)</\1>", re.ASCII)
_IDENT = re.compile(r"\$?\{?([A-Za-z_][\w.-]*)\}?$", re.ASCII)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_HEX_MAP = bytes(104 if 48 <= c <= 57 or 97 <= c <= 102 else 32 for c in range(256))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within a kind."""
    found = []
    if ":" in text or "=" in text:  # an assign match holds one of them
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    # A long hex run shows as a run of one byte after translation, which a plain search finds.
    if b"h" * MIN_HEX in text.encode("utf-8", "replace").translate(_HEX_MAP):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def name_weight(name: str) -> float:
    """The largest weight of a part of the name or of two adjacent parts, as in api_key or accessKey."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    pairs = [a + b for a, b in zip(parts, parts[1:])]
    return max((NAME_WEIGHTS.get(p, 0.0) for p in parts + pairs), default=0.0)


def last_name(text: str, low: int, high: int) -> str | None:
    """The name that stands, with a type or without, right before `high` and not before `low`."""
    colon = text.rfind(":", low, high)
    for end in (colon, high) if colon >= 0 and _TYPE.fullmatch(text, colon + 1, high) else (high,):
        if run := _NAME_BACK.match(text[low:end].rstrip(" \t")[::-1]):
            name = run[1][::-1]
            if start := _NAME_START.search(name):
                return name[start.start() :]
    return None


class Value:
    """What is known of a literal or of joined ones: the characters, whether all are quoted, and both ends."""

    def __init__(self, counts: Counter, quoted: bool, head: str, tail: str):
        self.counts, self.quoted, self.head, self.tail = counts, quoted, head[:ENDS], tail[-ENDS:]
        self.length = sum(counts.values())

    def __add__(self, other: Value) -> Value:
        # An end that is shorter than ENDS is the whole value.
        return Value(self.counts + other.counts, self.quoted and other.quoted, self.head + other.head if self.length < ENDS else self.head,
                     self.tail + other.tail if other.length < ENDS else other.tail)

    def probe(self) -> str:
        """The text, or one in its place to which PLACEHOLDERS answers alike: both ends, and each character between them."""
        return self.head if self.length <= ENDS else self.head + "".join(self.counts) + self.tail


def value_weight(value: Value) -> float:
    """How much a literal looks like a secret: its length, its letters' entropy, and its classes."""
    counts, n = value.counts, value.length
    if n < 6 or " " in counts or PLACEHOLDERS.match(value.probe()):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    letters = "".join(counts)
    classes = sum(bool(re.search(p, letters)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    score = min(1.0, entropy / 3.0) * min(1.0, 0.5 + n / 24)
    if classes == 1:
        score *= 0.75
    if not value.quoted and not any(c.isdigit() for c in counts):
        score *= 0.4  # a bare word after a colon is mostly prose
    return score


class Lexer:
    """Name-literal pairs of one text, with constants propagated through references and concatenations."""

    def __init__(self, text: str):
        self.text = text
        #: name -> the pieces that its value is made of: literals, (start, end, quoted), and lists of pieces for constants.
        self.constants: dict[str, list] = {}
        self.pairs: list[tuple[str, list]] = []
        self.has_quoted: dict[int, bool] = {}  # by the id of a list of pieces
        self.made: list[list] = []  # keeps those lists, and so their ids
        self.bare = (0, 0)  # the run of characters of bare literals that was met last
        self.known: dict[int, Value] = {}  # by the id of a list of pieces
        self.suffix: dict[int, tuple[int, Counter]] = {}  # by the end of a literal: a start, and the characters from there

    def run(self) -> Lexer:
        text, after = self.text, 0
        before = last = 0  # ends of the two operators before; a name lies behind the first, its type behind the second
        for op in _OP.finditer(text):
            a, b = op.span()
            low, before, last = before, last, b
            if a < after or text[max(0, a - 1) : a] in ("=", "!", "<", ">", ":") or text[b : b + 1] == "=" or text[b : b + 2] == "//":
                continue
            if not (name := last_name(text, max(low, text.rfind("\n", low, a) + 1), a)):
                continue
            pieces, end, quoted = self.value(b)
            if pieces:
                self.constants[name] = pieces
                self.pairs.append((name, pieces))
                if quoted:
                    after = end  # operators inside a quoted literal are no statements
        for m in _TAG.finditer(text):
            self.pairs.append((m[1], [(m.start(2), m.end(2), True)]))
        return self

    def value(self, at: int) -> tuple[list, int, bool]:
        """The pieces of the expression that begins at `at`, where it ends, and whether a literal in them is quoted."""
        pieces: list = []
        any_quoted = False
        while m := _VALUE.match(self.text, at):
            group = next(i for i in (1, 2, 3, 4) if m[i] is not None)
            if group < 4:
                at = m.end()
                pieces.append((m.start(group), m.end(group), True))
                any_quoted = True
            else:
                start, at = m.start(4), self.bare_end(m.start(4))
                ref = _IDENT.match(self.text, start, at)
                if ref and ref[1] in self.constants:
                    pieces.append(self.constants[ref[1]])
                    any_quoted |= self.has_quoted[id(pieces[-1])]
                elif self.text[at : at + 1] in ("(", "["):
                    return [], at, False  # a call or an index: no literal
                else:
                    pieces.append((start, at, False))
            if not (more := _JOIN.match(self.text, at)):
                break
            at = more.end()
        self.has_quoted[id(pieces)] = any_quoted
        self.made.append(pieces)
        return pieces, at, any_quoted

    def bare_end(self, at: int) -> int:
        """Where the bare literal ends that begins at `at`; a run is read once, however many operators it holds."""
        if not self.bare[0] <= at < self.bare[1]:
            self.bare = (at, _BARE.match(self.text, at).end())
        return self.bare[1]

    def literal(self, start: int, end: int, quoted: bool) -> Value:
        """A literal's value; of literals with one end only what lies before the last one is counted."""
        at, counts = self.suffix.get(end, (end, Counter()))
        if at < start:
            at, counts = end, Counter()
        counts = Counter(self.text[start:at]) + counts
        self.suffix[end] = start, counts
        return Value(counts, quoted, self.text[start : min(end, start + ENDS)], self.text[max(start, end - ENDS) : end])

    def whole(self, pieces: list) -> Value:
        """The value of joined pieces; that of each constant is put together once."""
        todo = [pieces]
        while todo:
            now = todo[-1]
            missing = [p for p in now if isinstance(p, list) and id(p) not in self.known]
            if missing:
                todo += missing
                continue
            todo.pop()
            if id(now) not in self.known:
                total = Value(Counter(), True, "", "")
                for p in now:
                    total += self.known[id(p)] if isinstance(p, list) else self.literal(*p)
                self.known[id(now)] = total
        return self.known[id(pieces)]

    def secrets(self, threshold: float = 0.5) -> list[tuple[int, int]]:
        """Spans of literals whose best score over the names they reach is at least the threshold."""
        found, seen = set(), set()
        for name, pieces in reversed(self.pairs):
            weight = name_weight(name)
            if weight < threshold or weight * value_weight(self.whole(pieces)) < threshold:
                continue
            todo = [pieces]
            while todo:
                for p in todo.pop():
                    if not isinstance(p, list):
                        if p[1] > p[0]:
                            found.add(p[:2])
                    elif id(p) not in seen:
                        seen.add(id(p))
                        todo.append(p)
        return sorted(found)


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and the base and lexer spans together, each (start, kind, end) in order."""
    base = base_spans(text)
    if "=" not in text and ":" not in text and "</" not in text:
        return base, base
    added = [(a, 3, b) for a, b in Lexer(text).run().secrets() if not any(s <= a and b <= e for s, _, e in base)]
    return base, sorted(base + added)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _row(text: str) -> tuple:
    base, spans = all_spans(text)
    count = Counter(k for _, k, _ in spans)
    return count[0], count[1], count[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), count[3]


def redact(text: str, mark: str = "[REDACTED]") -> str:
    """The text with each found span, overlapping ones together, replaced by the mark."""
    out, at = [], 0
    for a, _, b in all_spans(text)[1]:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def _scanner() -> Callable:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def score(column: pa.Array) -> list[pa.Array]:
        rows = [_row(t or "") for t in column.to_pylist()]
        return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

    return score


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256, spans and n_lex, in one pass without a shuffle."""
    return append_columns(docs, text_col, FIELDS, lambda: _scanner())


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """docs with every found secret replaced by the mark; null texts stay null."""

    def scrubber():
        return lambda column: [pa.array([None if t is None else redact(t, mark) for t in column.to_pylist()], pa.string())]

    clean = append_columns(docs, text_col, T.StructType([T.StructField(text_col, T.StringType())]), scrubber)
    return clean.select([F.col(f"`{c}`") for c in docs.columns])
