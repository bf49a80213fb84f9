"""Secret scans: base patterns plus assignment-aware lexing of source and configuration text.

Base spans follow three patterns (``BASE``). The lexer then reads name-literal pairs
(``name = "literal"``, ``name: literal``, ``"name": "literal"``, ``export NAME=literal``),
follows constants (``X = "literal"`` … ``password = X``) and scores each literal by the
sensitivity of the names it reaches and by its own randomness. Literals that score at
least ``threshold`` add spans of kind ``named``, unless a base span covers them already.

Cases: null and empty texts have no spans; a text is always scanned whole; equal rows
give equal results; other columns pass through unread. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblode.llm.storage import map_texts

# Kinds in their order, pattern, group that is measured (0: whole match), least length.
BASE = (
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
KINDS = ("assign", "access", "hex", "named")
# Words of a name and how strongly they speak for a secret value.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3,
    "credentials": 3, "auth": 2, "authorization": 2, "bearer": 2, "private": 1, "access": 1, "api": 1, "key": 1,
    "client": 1, "session": 1, "signature": 1, "encryption": 1, "signing": 1,
}
THRESHOLD = 5.0
LEAST_LITERAL = 12

# A run of hexadecimal digits is maximal, so requiring the length at once finds the same runs; so for access keys.
_HEX = re.compile(r"[0-9a-f]{16,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_ASSIGN = re.compile(BASE[0][1])
_PAIR = re.compile(r"""["']?([A-Za-z_$][\w$.-]*+)["')\]]*+[ \t]*+(?:=>|:=|=(?!=)|:(?!:|//))[ \t]*+""", re.ASCII)
_TERM = re.compile(
    r"""(?P<open>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)|(?P<bare>[^\s"'`,;#(){}\[\]<>+&|]++)""", re.ASCII
)
_PLUS = re.compile(r"[ \t]*\+[ \t]*")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$.]*\Z", re.ASCII)
_NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in order."""
    found = []
    for match in _ASSIGN.finditer(text):
        if match.end(2) - match.start(2) >= 12:
            found.append((match.start(), 0, match.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def name_score(name: str) -> int:
    """Sensitivity of an assigned name, at most 3."""
    score = 0
    for word in _NAME_WORD.findall(name):
        score += SENSITIVE.get(word.lower(), 0)
    return min(3, score)


def literal_score(literal: str) -> float:
    """Randomness of a literal, 0 to 4: entropy of its characters and mix of kinds; 0 if short or prose."""
    if len(literal) < LEAST_LITERAL or any(c.isspace() for c in literal):
        return 0.0
    counts = Counter(literal)
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    kinds = sum((any(c.isdigit() for c in literal), any(c.islower() for c in literal), any(c.isupper() for c in literal)))
    return min(2.0, max(0.0, entropy - 2.0)) + (kinds - 1 if any(c.isdigit() for c in literal) else 0)


def pairs(text: str) -> list[tuple[str, list[tuple[int, int]], list[str]]]:
    """(name, literal spans, referenced names) of each assignment, left to right.

    The right side is a term or a sum of terms; a term is a quoted literal or a bare
    word. A bare word that looks like an identifier also counts as a reference.
    """
    found = []
    for match in _PAIR.finditer(text):
        spans, names, at = [], [], match.end()
        while term := _TERM.match(text, at):
            if term["open"]:
                spans.append((term.start() + 1, term.end() - 1))
            else:
                spans.append(term.span())
                if _IDENTIFIER.match(term["bare"]):
                    names.append(term["bare"])
            more = _PLUS.match(text, term.end())
            if not more:
                break
            at = more.end()
        if spans:
            found.append((match[1], spans, names))
    return found


def named_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Literals whose own or propagated name makes them secret."""
    if "=" not in text and ":" not in text:
        return []
    known = pairs(text)
    scores: dict[str, int] = {}
    for name, _, _ in known:
        if (score := name_score(name)) > scores.get(name, 0):
            scores[name] = score
    if not scores:
        return []
    # A name's sensitivity passes to the constants it is built from, along any chain of references.
    references: dict[str, set[str]] = {}
    defined = {name for name, _, _ in known}
    for name, _, used in known:
        references.setdefault(name, set()).update(x for x in used if x in defined and x != name)
    waiting = sorted(scores)
    while waiting:
        name = waiting.pop()
        for other in references.get(name, ()):
            if scores.get(other, 0) < scores[name]:
                scores[other] = scores[name]
                waiting.append(other)
    found = set()
    for name, spans, _ in known:
        if scores.get(name, 0):
            for start, end in spans:
                literal = text[start:end]
                if literal not in defined and scores[name] + literal_score(literal) >= threshold:
                    found.add((start, end))
    return sorted(found)


def all_spans(text: str, threshold: float = THRESHOLD) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base with the lexer's spans; both as (start, kind number, end) in order."""
    base = base_spans(text)
    ends: list[tuple[int, int]] = []  # disjoint covered stretches
    for start, _, end in base:
        if ends and start <= ends[-1][1]:
            ends[-1] = (ends[-1][0], max(end, ends[-1][1]))
        else:
            ends.append((start, end))
    added, i = [], 0
    for start, end in named_spans(text, threshold):
        while i < len(ends) and ends[i][1] <= start:
            i += 1
        if not (i < len(ends) and ends[i][0] <= start and end <= ends[i][1]):
            added.append((start, 3, end))
    return base, sorted(base + added)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "<secret>") -> str:
    """The text with each stretch that spans cover replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at or not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Each row of ``df`` as struct ``row`` with ``base`` and ``spans`` (arrays of kind, start, end) and ``redacted`` text."""
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"

    def make():
        def shown(spans):
            return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

        def one(text: str | None):
            text = text or ""
            base, every = all_spans(text, threshold)
            return shown(base), shown(every), redact(text, every) if every else text

        return lambda texts: list(zip(*map(one, texts))) or [[], [], []]

    return map_texts(df, text_col, f"base {kind}, spans {kind}, redacted string", make)


def redact_rows(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` with every secret replaced by a mark; null texts stay null."""
    found = scan(df, text_col, threshold)
    clean = F.when(F.col("row")[text_col].isNotNull(), F.col("redacted"))
    return found.select(*[clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def joined(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        F.col("row.doc_id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"), F.sha2("redacted", 256).alias("redacted_sha256"),
    )

