"""Secret scans: an Aho-Corasick automaton finds keywords, regular expressions anchored at its hits find the secrets,
and tokens that carry a checksum or a signed header are validated by it."""

from __future__ import annotations

import base64
import binascii
import hashlib
import itertools
import json
import re
import zlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, small_batches, text_bytes

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
BASE = KINDS[:3]
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: What is matched where a keyword of the kind begins.
PATTERNS = {
    "assign": re.compile("(" + "|".join(map(_any_case, ASSIGN_WORDS)) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
}
HEX = re.compile(r"[0-9a-f]{16,}")
#: A run that fails as a token's head from one start fails from all others in it: what follows the run is the same.
HEAD = re.compile(r"[A-Za-z0-9_-]*")


def base62(number: int, width: int) -> str:
    out = ""
    while number:
        number, digit = divmod(number, 62)
        out = BASE62[digit] + out
    return out.rjust(width, "0")


def checksum_holds(token: str) -> bool:
    """The last six characters of a prefixed token are the CRC-32 of the 30 before them, in base 62."""
    body = token.partition("_")[2]
    return base62(zlib.crc32(body[:30].encode()), 6) == body[30:]


def jwt_header_holds(token: str) -> bool:
    head = token.partition(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, TypeError):
        return False


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 12
    if kind == "access":
        return len(m[0]) >= 18
    return jwt_header_holds(m[0]) if kind == "jwt" else checksum_holds(m[0])


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Keywords in each mixture of cases that counts, so that a text needn't be lower-cased."""
    a = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        for letters in itertools.product(*[{c, c.upper()} for c in word]):
            a.add_word("".join(letters), ("assign", len(word)))
    for kind, words in {"access": ["AKIA"], "github": [f"gh{c}_" for c in "pousr"], "npm": ["npm_"], "jwt": ["eyJ"]}.items():
        for word in words:
            a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind. Within a kind, matches are leftmost and don't overlap;
    one that fails its length or checksum is dropped after it has taken up its place."""
    found, past = [], dict.fromkeys(PATTERNS, 0)
    for last, (kind, length) in automaton().iter(text):
        start = last - length + 1
        if start < past[kind]:
            continue
        if m := PATTERNS[kind].match(text, start):
            past[kind] = m.end()
            if _valid(kind, m):
                found.append((kind, start, m.end()))
        elif kind == "jwt":
            past[kind] = HEAD.match(text, start).end()
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, value>>; a row for each row of docs, with an empty array where
    nothing is found. A null text counts as empty. Whole texts are scanned, each by one task; nothing is shuffled."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(docs[doc_id].alias("doc_id"), text_bytes(docs[text]).alias("t"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t in batch["t"]:
            text = t.as_py().decode("utf-8", "replace")
            out.append([{"kind": k, "start": a, "end": b, "value": text[a:b]} for k, a, b in scan(text)])
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, kind)], ["doc_id", "spans"])

    return map_arrow(rows, run, f"doc_id {id_type}, spans array<struct<kind: string, start: bigint, end: bigint, value: string>>")


def spans_sha256(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
