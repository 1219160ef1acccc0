"""Secret scans: keyword automaton first, anchored patterns only at its hits, then checksums.

One pass of an Aho-Corasick automaton finds every keyword of a text.  Patterns are tried only where a
keyword stands, from that place on.  Tokens that embed a checksum are kept only when it is right, which
makes them findings even without a telling word in front.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import annotate

# Keywords, patterns and least lengths of the kinds of secrets.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "checked")
UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}

OUTPUTS = "spans array<struct<kind:string,start:int,stop:int>>"


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    words = ahocorasick.Automaton()
    for kind, keywords in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("checked", CHECKED_PREFIXES)):
        for word in keywords:
            words.add_word(word, (kind, len(word)))
    words.make_automaton()
    return words


def checksum(body: str) -> str:
    """Six base-62 digits of the body's CRC-32, as issuers of such tokens append them."""
    rest, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        digits = BASE62[digit] + digits
    return digits


def secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) in code points, by start, then kind as listed."""
    lowered = text.lower()
    if len(lowered) != len(text):  # a character whose lower case is longer would shift the places
        lowered = text.translate(UPPER_TO_LOWER)
    hits: dict[str, list[int]] = {"assign": [], "access": [], "checked": []}
    for last, (kind, length) in automaton().iter(lowered):
        hits[kind].append(last + 1 - length)
    found = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("checked", CHECKED)):
        free = 0
        for at in sorted(hits[kind]):
            match = pattern.match(text, at) if at >= free else None
            if match:
                free = match.end()  # also when it fails the checks below: matches do not overlap
                if accepted(kind, match):
                    found.append((kind, match.start(), match.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def accepted(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= ASSIGN_LEAST
    if kind == "access":
        return len(match[0]) >= ACCESS_LEAST
    return checksum(match[1]) == match[2]


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``spans`` of secrets, in code points, end exclusive.

    Spans of one kind never overlap, spans of different kinds may.  A null or empty text has no spans;
    repeated rows are scanned one by one.  A column of ``docs`` named ``spans`` is replaced.
    """

    def compute(texts):
        names = ("kind", "start", "stop")
        return [[[dict(zip(names, s)) for s in secrets((t or b"").decode("utf-8", "replace"))] for t in texts]]

    return annotate(docs, text, OUTPUTS, compute)


def span_list(spans) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document: findings of each base kind, the digest of the base spans, all spans."""
    found = find_secrets(docs.select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(span_list(F.filter("spans", lambda s: s["kind"] != "checked")), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


def redact_secrets(docs: DataFrame, mark: str = "[secret]", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with every secret replaced by ``mark``; touching spans become one mark.

    Null texts stay null and texts without findings stay as they are.  Other columns are not changed.
    """

    def compute(texts):
        return [[None if t is None else redacted(t.decode("utf-8", "replace"), mark) for t in texts]]

    columns = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    made = annotate(held, "text", "redacted string", compute)
    return made.select(*[F.col("redacted").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in columns])


def redacted(text: str, mark: str) -> str:
    parts, free = [], 0
    for _, start, stop in secrets(text):
        if start > free or not parts:
            parts += [text[free:start], mark]
        free = max(free, stop)
    return "".join([*parts, text[free:]])
