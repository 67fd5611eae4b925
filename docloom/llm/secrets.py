"""Secret scans: keyword automaton, anchored patterns near its hits, checksums.

An Aho-Corasick automaton finds the literal starts of all kinds in one walk over
a text.  Only at those places an anchored pattern is tried, which restates the
leftmost non-overlapping search: a kind's search goes on behind its last match,
whether or not that match is long enough.  Runs of hexadecimal digits have no
literal start; a byte class image of the text is searched for a run of the least
length instead.  Vendor tokens carry a checksum, which must hold.

Offsets are code points, ends exclusive.  Kinds: assign, access, hex (base),
github, npm (checksummed vendor tokens), pem (private key headers).

Defined results: null and empty texts have no spans; extra columns stay, except
those named as the results, which are replaced; repeated rows are scanned each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The searched formats.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "pem")
ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
VENDOR = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Literal starts, in lower case, and the kinds that begin there.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
    "-----begin ": "pem",
}
HEX_LEAST = 32
HEX_IMAGE = bytes(104 if chr(b) in "0123456789abcdef" else 46 for b in range(256))
HEX_RUN = b"h" * HEX_LEAST


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def checksum(body: str) -> str:
    """The CRC-32 of a token's body as six base-62 digits."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def hex_runs(raw: bytes, ascii_only: bool) -> list[tuple[int, int]]:
    """Maximal runs of hexadecimal digits of the least length or more."""
    image, out, at = raw.translate(HEX_IMAGE), [], 0
    while (start := image.find(HEX_RUN, at)) >= 0:
        end = start + HEX_LEAST
        while image[end : end + 1] == b"h":
            end += 1
        shift = 0 if ascii_only else start - len(raw[:start].decode())
        out.append((start - shift, end - shift))
        at = end
    return out


def spans(text: str, words) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind."""
    raw = text.encode()
    out, after = [("hex", a, b) for a, b in hex_runs(raw, len(raw) == len(text))], dict.fromkeys(KINDS, 0)
    for last, (length, kind) in words.iter(raw.lower().decode()):
        start = last - length + 1
        if start < after[kind]:
            continue
        if kind == "assign":
            match = ASSIGN.match(text, start)
            good = match and len(match[2]) >= 8
        elif kind == "access":
            match = ACCESS.match(text, start)
            good = match and len(match[0]) >= 16
        elif kind == "pem":
            match = good = PEM.match(text, start)
        else:
            match = VENDOR.match(text, start)
            good = match and checksum(match[1]) == match[2]
        if match:
            after[kind] = match.end()
        if good:
            out.append((kind, start, match.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``secrets``: an array of (kind, start, end)."""

    @F.pandas_udf("array<struct<kind string, start int, end int>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = automaton()
        for batch in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in spans(t, words)] if t else [] for t in batch], dtype=object)

    return docs.withColumn("secrets", found(F.col(text)))


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace each secret by ``[secret]``; overlapping spans are replaced as one."""

    @F.pandas_udf("string")
    def redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = automaton()

        def clean(value):
            if not value or not (hits := spans(value, words)):
                return value
            out, end = [], 0
            for _, a, b in hits:
                if a >= end:
                    out += [value[end:a], "[secret]"]
                end = max(end, b)
            return "".join([*out, value[end:]])

        for batch in batches:
            yield pd.Series([clean(t) for t in batch], dtype=object)

    return docs.withColumn(text, redacted(F.col(text)))


def secret_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts and span lists of each document."""
    scanned = scan_secrets(docs.select("doc_id", text), text)
    listed = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda x: x.kind.isin(*BASE_KINDS))
    return scanned.select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"),
        *[count(k) for k in KINDS if k not in BASE_KINDS],
    )
