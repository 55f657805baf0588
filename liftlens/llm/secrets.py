"""Secret scans by assignment-aware lexing.

Besides fixed base patterns, a text is lexed for assignments as source code
and configuration files write them: a name, ``=``, ``:=``, ``=>`` or ``:``, and
literals or names joined by ``+``. Constants are propagated: a name stands for
what was last assigned to it above. Each literal that reaches a target is
scored by the target's name and by the value's own look; a literal that scores
high enough is a span of kind ``literal``. One pass over the rows, no shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_type, slices, tidy

# Fixed patterns of the base scan: kind, pattern, shortest match (of group 2 for assign).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "literal")
MIN_ASSIGNED = 12

# Words in names, with the weight they give; a name's parts are split at case changes and punctuation.
SENSITIVE = {
    "password": 4, "passwd": 4, "passphrase": 4, "pwd": 4, "secret": 4, "token": 3, "apikey": 4, "credential": 3,
    "credentials": 3, "privatekey": 4, "accesskey": 4, "auth": 2, "bearer": 3, "private": 2, "key": 2, "access": 1,
    "api": 1, "signing": 2, "encryption": 2, "cookie": 1, "session": 1, "jwt": 3, "salt": 1, "pin": 1, "client": 1,
}
HARMLESS = {"path", "file", "url", "uri", "name", "type", "id", "length", "len", "size", "count", "public", "hash", "label", "field", "header"}
PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|changeme|example|placeholder|none|null|true|false|todo|test|your[_-].*|<.*>|\$\{.*\}|%.*%)$", re.IGNORECASE)
MIN_LITERAL = 8
MIN_SCORE = 6
SCORED_CHARS = 4096  # of a joined value; all its literals are spans

# A name is read once: quoted names are tried after a quote, bare ones only where a run of name characters begins,
# and no part gives characters back, so long runs of letters, dots or spaces cost one pass.
NAME = re.compile(
    r"""(?:(?P<quote>["'])(?P<quoted>[A-Za-z_][A-Za-z0-9_.\-]*+)(?P=quote)|(?<![A-Za-z0-9_.\-])[0-9.\-]*+(?P<bare>[A-Za-z_][A-Za-z0-9_.\-]*+))"""
    r"""\x20*+(?::=|=>|=(?![=>])|:(?![:/]))\x20*+""",
    re.ASCII,
)
ATOM = re.compile(
    r'''"(?P<double>(?:[^"\\\n]|\\.)*)"|'(?P<single>(?:[^'\\\n]|\\.)*)'|(?P<word>[A-Za-z0-9_][A-Za-z0-9+/_.=\-]*)''', re.ASCII
)
PLUS = re.compile(r"\x20*\+\x20*")
CASE = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+", re.ASCII)

Span = tuple[int, int]
Parts = list  # the spans of a value's literals, and the Parts of constants joined to it


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, leftmost and without overlap per kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def name_score(name: str) -> int:
    """How much a name says that its value is secret."""
    parts = [p.lower() for p in CASE.findall(name)]
    joined = ["".join(p) for p in zip(parts, parts[1:])]
    if not parts or parts[-1] in HARMLESS:
        return 0
    return max((SENSITIVE.get(p, 0) for p in joined), default=0) + sum(SENSITIVE.get(p, 0) for p in set(parts))


def value_score(value: str) -> int:
    """How much a literal looks like a secret: mixed characters, entropy, no placeholder."""
    if len(value) < MIN_LITERAL or PLACEHOLDER.match(value) or " " in value:
        return -10
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum((any(c.isdigit() for c in value), any(c.islower() for c in value), any(c.isupper() for c in value)))
    return (2 if entropy >= 3.0 else 0) + (1 if kinds >= 2 else 0) + (1 if n >= 16 else 0)


def assignments(text: str) -> Iterator[tuple[str, str, Parts]]:
    """(name, value, its parts) for each assignment, constants propagated. The
    value is cut at SCORED_CHARS; the parts are whole, and shared between names."""
    known: dict[str, tuple[str, Parts]] = {}
    at = 0
    while (m := NAME.search(text, at)) is not None:
        at = m.end()
        value, parts, place = "", [], at
        while (atom := ATOM.match(text, place)) is not None:
            kind = atom.lastgroup
            literal = atom.group(kind)
            if kind == "word" and literal in known:
                more, part = known[literal]
            else:
                more, part = literal, (atom.start(kind), atom.end(kind))
            if len(value) < SCORED_CHARS:
                value = (value + more)[:SCORED_CHARS]
            parts.append(part)
            at = place = atom.end()
            plus = PLUS.match(text, place)
            if plus is None:
                break
            place = plus.end()
        if parts:
            name = m["quoted"] or m["bare"]
            known[name] = (value, parts)
            yield name, value, parts


def literal_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of literals that reach a sensitive name and look like a secret."""
    if "=" not in text and ":" not in text:
        return []
    found = set()
    reported: dict[int, Parts] = {}  # by identity, each walked through once
    for name, value, parts in assignments(text):
        score = name_score(name)
        if score and score + value_score(value) >= MIN_SCORE:
            todo = [parts]
            while todo:
                own = todo.pop()
                if id(own) not in reported:
                    reported[id(own)] = own
                    todo += [p for p in own if isinstance(p, list)]
                    found.update(("literal", *p) for p in own if isinstance(p, tuple) and p[1] > p[0])
    return sorted(found)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_text(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text, as (kind, start, end) in code points."""
    base = base_spans(text or "")
    return in_order(base), in_order(base + literal_spans(text or ""))


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """The text with every span, joined where they overlap, replaced by ``mark``."""
    out, at, end = [], 0, 0
    for _, lo, hi in sorted(spans, key=lambda s: s[1:]):
        if lo >= end:
            out += [text[at:lo], mark]
        end = max(end, hi)
        at = end
    return "".join(out) + text[at:]


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per input row: the id, base and spans (arrays of kind, start,
    end by start, then kind), the columns named in ``carry`` and, if
    ``with_text``, the text with all spans replaced (null for null).

    Null and empty texts have no spans. Repeated rows and null ids are rows
    like any other; texts are scanned whole, however long.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema(
        [(id_col, arrow_type(docs, id_col)), ("base", pa.list_(span)), ("spans", pa.list_(span))]
        + [(c, arrow_type(docs, c)) for c in carry]
        + ([("text", pa.string())] if with_text else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                found = [scan_text(t) for t in texts]
                columns = [[[dict(zip(("kind", "start", "end"), s)) for s in f[k]] for f in found] for k in (0, 1)]
                arrays = [part.column(0), *(pa.array(c, pa.list_(span)) for c in columns), *part.columns[2:]]
                if with_text:
                    arrays.append(pa.array([t if t is None else redact(t, f[1]) for t, f in zip(texts, found)], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    one = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("base", T.ArrayType(one)), T.StructField("spans", T.ArrayType(one))]
        + [docs.schema[c] for c in carry]
        + ([T.StructField("text", T.StringType())] if with_text else [])
    )
    return docs.select(id_col, text_col, *carry).mapInArrow(tidy(run), out)
