"""Secret scan through a trigram inverted index.

From each rule's parsed pattern a Boolean query over trigrams is derived: a sequence must hold the trigrams of its
literal runs (AND), a branch those of any alternative (OR), and a part that may match anything asks for nothing. For each
block of documents the postings of the trigrams in those queries are gathered in one vectorised pass over the bytes,
case folded; queries are answered by intersecting and uniting postings, and only candidates are run through the regular
expression. A rule without a mandatory trigram (hex runs) scans every document.

Base rules match leftmost without overlap, and a match that fails its length is dropped after it has taken its text.
Spans are in code points, end exclusive. The pem span of ``report`` is the BEGIN line, as in the SQL; ``redact`` masks the
whole key. Defined results: null is an empty text; repeated rows each get a row; texts are scanned whole, whatever their
length (about ``BLOCK_BYTES`` of them at a time, a longer one by itself); where spans overlap the first rule that began masks
them; other columns are ignored by ``report`` and kept, values and all, by ``redact``; an empty table gives no rows.

Patterns are parsed by the standard library's own parser, which has no public name; what ``trigram_query`` doesn't know asks for nothing, so such a rule scans more, never less.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import blocks, column, joined_bytes, utf8


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = True


#: In the order in which kinds are listed.
RULES = (
    Rule("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("hub", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}", base=False),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", base=False),
)
#: A run of hex digits shorter than this rule's least length can't count, and runs don't overlap: scanned with it built in.
_SCAN = {"hex": r"[0-9a-f]{24,}"}

#: What follows a BEGIN line without an END line: headers and lines of base64 (line ends may be spelled out, or be spaces).
_BODY = re.compile(r"(?:(?:\s|\\[nr])*(?:Proc-Type|DEK-Info):[^\n\\]*)*(?:(?:\s|\\[nr])*[A-Za-z0-9+/]{16,}={0,2}(?![^\s\\\"',<]))*")
#: A last line of base64 that is short.
_LAST = re.compile(r"[^\S\n]*(?:\n|\\n)[^\S\n]*(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{4}|[A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{2}==)(?=[^\S\n]*(?:\n|\\[nr]|$))")

ALL = None  # the query that every document satisfies


def _exact(tree) -> set[bytes] | None:
    """All strings that a parsed piece can match, folded; None if they are many or not ASCII literals."""
    out = {b""}
    for kind, arg in tree:
        if kind is op.LITERAL and arg < 128:
            more = {bytes([arg]).lower()}
        elif kind is op.IN and all(k is op.LITERAL and v < 128 for k, v in arg):
            more = {bytes([v]).lower() for _, v in arg}
        elif kind is op.SUBPATTERN:
            more = _exact(arg[-1])
        elif kind is op.BRANCH:
            parts = [_exact(x) for x in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] <= 8:
            one = _exact(arg[2])
            more = None if one is None else {b"".join(x) for n in range(arg[0], arg[1] + 1) for x in _products(one, n)}
        else:
            more = None
        if more is None or len(out) * len(more) > 64:
            return None
        out = {a + b for a in out for b in more}
    return out


def _products(parts: set[bytes], n: int) -> list[tuple[bytes, ...]]:
    found: list[tuple[bytes, ...]] = [()]
    for _ in range(n):
        found = [(*x, y) for x in found for y in parts][:65]
    return found


def _all_of(parts: list):
    parts = [p for p in parts if p is not ALL]
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(parts: list):
    return ALL if ALL in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[bytes]):
    return _any_of([_all_of([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(pattern: str):
    """``bytes`` (a trigram), ``("and" | "or", parts)``, or ALL."""

    def walk(tree):
        parts, run = [], []
        for node in [*tree, None]:
            if node is not None and _exact([*run, node]) is not None:
                run.append(node)
                continue
            if run:
                parts.append(_of_strings(_exact(run)))
                run = []
            if node is None:
                break
            kind, arg = node
            if _exact([node]) is not None:
                run = [node]
            elif kind is op.SUBPATTERN:
                parts.append(walk(arg[-1]))
            elif kind is op.BRANCH:
                parts.append(_any_of([walk(x) for x in arg[1]]))
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] > 0:
                parts.append(walk(arg[2]))
        return _all_of(parts)

    return walk(parser.parse(pattern))


def trigrams_of(query) -> set[bytes]:
    return set() if query is ALL else {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


class TrigramIndex:
    """Postings, over the documents of a block, of the trigrams that the rules ask for."""

    def __init__(self, wanted: list[bytes]):
        self.wanted = wanted
        codes = [t[0] << 16 | t[1] << 8 | t[2] for t in wanted]
        self.slot = np.zeros(1 << 24, np.uint8 if len(wanted) < 255 else np.int32)
        self.slot[codes] = np.arange(1, len(wanted) + 1)
        self.fold = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
        self.postings: dict[bytes, np.ndarray] = {}
        self.n = 0

    def build(self, raw: np.ndarray, ends: np.ndarray) -> None:
        """``raw``: the documents' bytes; document k has those from ends[k] to ends[k + 1]."""
        self.n = len(ends) - 1
        low = self.fold[raw].astype(np.int32)
        found = self.slot[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]] if len(low) > 2 else self.slot[:0]
        at = np.flatnonzero(found)
        doc = np.searchsorted(ends, at, side="right") - 1
        whole = at + 3 <= ends[doc + 1]
        slot, doc = found[at][whole].astype(np.int64), doc[whole]
        both = np.unique(slot * self.n + doc)
        cuts = np.searchsorted(both, np.arange(1, len(self.wanted) + 2) * self.n)
        self.postings = {t: both[cuts[k] : cuts[k + 1]] - (k + 1) * self.n for k, t in enumerate(self.wanted)}

    def candidates(self, query) -> np.ndarray:
        if query is ALL:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[query]
        sets = [self.candidates(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(sets))
        out = sets[0]
        for s in sorted(sets[1:], key=len):
            out = np.intersect1d(out, s, assume_unique=True)
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(k, r, re.compile(_SCAN.get(r.kind, r.pattern)), trigram_query(r.pattern)) for k, r in enumerate(rules)]
        self.index = TrigramIndex(sorted(set().union(*(trigrams_of(q) for *_, q in self.rules))))

    def find(self, part: pa.RecordBatch) -> list[list[tuple[int, int, int]]]:
        """For each document the spans (start, number of the rule, end), sorted."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(part.num_rows)]
        self.index.build(*joined_bytes(part))
        texts = utf8(part)
        decoded: dict[int, str] = {}
        for k, rule, regex, query in self.rules:
            for d in self.index.candidates(query).tolist():
                if not texts[d]:
                    continue
                if d not in decoded:
                    decoded[d] = texts[d].decode()
                for m in regex.finditer(decoded[d]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[d].append((m.start(), k, m.end()))
            if query is ALL:
                decoded = {d: decoded[d] for d in range(len(out)) if out[d] and d in decoded}
        for spans in out:
            spans.sort()
        return out


def _joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...], base: bool) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans if rules[k].base or not base)


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs(doc_id, text)`` -> the contract's row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for part in blocks(batch):
                found = scanner.find(part)
                counts = [pa.array([sum(rules[k].kind == kind for _, k, _ in s) for s in found], pa.int64()) for kind in ("assign", "access", "hex")]
                digest = [hashlib.sha256(_joined(s, rules, True).encode()).hexdigest() for s in found]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), *counts, pa.array(digest), pa.array([_joined(s, rules, False) for s in found])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def whole_keys(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """The spans, with those of BEGIN lines drawn out to the END line of the same label, or over what looks like a key's body."""
    out = []
    for a, k, b in spans:
        if rules[k].kind == "pem":
            end = text.find(text[a:b].replace("BEGIN", "END", 1), b)
            begin = text.find("-----BEGIN ", b)
            if end >= 0 and not 0 <= begin < end:
                b = end + (b - a) - 2
            else:
                body = _BODY.match(text, b).end()
                last = _LAST.match(text, body) if body > b else None
                b = last.end() if last else body
        out.append((a, k, b))
    return out


def masked(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    out, done = [], 0
    for a, k, b in spans:
        if b > done:
            out += [text[done : max(a, done)], f"<{rules[k].kind}>" if a >= done else ""]
            done = b
    return "".join(out) + text[done:]


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All documents and columns, with each secret of ``text`` replaced by its kind in angle brackets, and ``n_chars``,
    where there is one, counted anew."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for part in blocks(batch):
                texts = column(part, "text").to_pylist()
                texts = [masked(t, whole_keys(t, s, rules), rules) if s else t for t, s in zip(texts, scanner.find(part))]
                at = part.schema.get_field_index("text")
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
