"""Secret scan: keyword automaton, anchored expressions near its hits only, embedded checksums.

1. One Aho-Corasick automaton finds every keyword in the lower-cased text.  Runs of hexadecimal digits
   have no keyword; any run of 16 covers four neighbouring positions that are multiples of four, so
   those positions are looked at instead, and four in a row are a hit.
2. The expression of a kind is matched only at its hits, anchored there.  Hits are taken from left to
   right and a match, kept or dropped, hides the hits inside it, which is what a leftmost
   non-overlapping search does.
3. A match must pass its kind's rule: a length, or a checksum that is part of the token.

Offsets are code points: the scan runs on a copy with one byte per code point (non-ASCII is ``?``,
which no expression accepts).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from zlib import crc32

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framelake.llm.common import arrow_rows

BASE_KINDS = ("assign", "access", "hex")
# Tokens that end in six base-62 digits of the CRC-32 of their random part, and keys with a double
# SHA-256 checksum.
CHECKED_KINDS = ("service_token", "package_token", "wallet_key")
KINDS = (*BASE_KINDS, *CHECKED_KINDS)

ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
SERVICE_WORDS = (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_")
WALLET_WORDS = (b"wif", b"wallet", b"private")

ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
SERVICE = re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
PACKAGE = re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
WALLET = re.compile(rb"(?<![A-Za-z0-9])[5KL][1-9A-HJ-NP-Za-km-z]{50,51}(?![A-Za-z0-9])")
WALLET_REACH = 40  # how far behind its keyword a key may begin

BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
HEX_DIGIT = np.zeros(256, bool)
HEX_DIGIT[list(b"0123456789abcdef")] = True
HEX_RUN, STRIDE = 16, 4


def base62_crc32_holds(body: bytes) -> bool:
    """The last six characters are the CRC-32 of the rest, in base 62."""
    value, digits = crc32(body[:-6]), b""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit:digit + 1] + digits
    return digits == body[-6:]


def base58_check_holds(key: bytes) -> bool:
    """A base-58 private key: version byte, 32 or 33 bytes, first four bytes of the double SHA-256."""
    value = 0
    for c in key:
        value = value * 58 + BASE58.index(c)
    if value.bit_length() > 8 * 38:
        return False
    raw = value.to_bytes(38 if len(key) == 52 else 37, "big") if value.bit_length() <= 8 * (38 if len(key) == 52 else 37) else b""
    if not raw or raw[0] != 0x80:
        return False
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _at_hits(data: bytes, hits: list[int], expression: re.Pattern, keep: Callable[[re.Match], bool]) -> list[tuple[int, int]]:
    """Matches anchored at the hits (ascending), leftmost and non-overlapping; ``keep`` decides afterwards."""
    found, end = [], 0
    for at in hits:
        if at >= end and (m := expression.match(data, at)):
            end = m.end()
            if keep(m):
                found.append(m.span())
    return found


def _hex_runs(data: bytes) -> list[tuple[int, int]]:
    """Maximal runs of at least 16 hexadecimal digits."""
    is_hex = HEX_DIGIT[np.frombuffer(data, np.uint8)]
    grid = is_hex[::STRIDE]
    if len(grid) < HEX_RUN // STRIDE:
        return []
    hits = np.flatnonzero(grid[:-3] & grid[1:-2] & grid[2:-1] & grid[3:]) * STRIDE
    found, end, n = [], 0, len(data)
    for at in hits.tolist():
        if at < end:
            continue
        begin = at
        while begin and is_hex[begin - 1]:
            begin -= 1
        stop = HEX_AFTER.match(data, at).end() if at < n else n
        end = stop
        if stop - begin >= HEX_RUN:
            found.append((begin, stop))
    return found


HEX_AFTER = re.compile(rb"[0-9a-f]*")


def scanner() -> Callable[[str | None], list[tuple[str, int, int]]]:
    """A function from a text to its spans ``(kind, start, end)``, by start, then kind as listed."""
    automaton = ahocorasick.Automaton()
    groups = [("assign", ASSIGN_WORDS), ("access", (b"akia",)), ("service_token", SERVICE_WORDS), ("package_token", (b"npm_",)),
              ("wallet_key", WALLET_WORDS)]
    for kind, words in groups:
        for word in words:
            automaton.add_word(word.decode(), (kind, len(word)))
    automaton.make_automaton()
    order = {k: n for n, k in enumerate(KINDS)}

    def scan(text: str | None) -> list[tuple[str, int, int]]:
        if not text:
            return []
        data = text.encode("ascii", "replace")
        hits: dict[str, list[int]] = {}
        for last, (kind, length) in automaton.iter(data.lower().decode("ascii")):
            hits.setdefault(kind, []).append(last - length + 1)
        spans = [("hex", *s) for s in _hex_runs(data)]
        if hits:
            for kind, expression, keep in (
                ("assign", ASSIGN, lambda m: len(m[1]) >= 12),
                ("access", ACCESS, lambda m: len(m[0]) >= 18),
                ("service_token", SERVICE, lambda m: base62_crc32_holds(m[1])),
                ("package_token", PACKAGE, lambda m: base62_crc32_holds(m[1])),
            ):
                if kind in hits:
                    spans += [(kind, *s) for s in _at_hits(data, sorted(hits[kind]), expression, keep)]
            found: dict[int, int] = {}
            for at in hits.get("wallet_key", ()):
                for m in WALLET.finditer(data, at, at + WALLET_REACH + 60):
                    if m.start() <= at + WALLET_REACH and base58_check_holds(m[0]):
                        found[m.start()] = m.end()
            spans += [("wallet_key", *s) for s in found.items()]
        return sorted(spans, key=lambda s: (s[1], order[s[0]]))

    return scan


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def secret_spans(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (array of kind, start, end) of every whole text.

    One row per row, repeated rows included.  A null or empty text has an empty array.  Other columns
    are not read, so their names cannot clash.  Spans of different kinds may overlap.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))])

    def row():
        scan = scanner()
        return lambda doc_id, text: (doc_id, [{"kind": k, "start": a, "end": b} for k, a, b in scan(text)])

    return arrow_rows(docs, row, ["doc_id", "text"], schema)
