"""Secrets in whole texts: patterns, and structural confirmation of what base64, hex and signed tokens hold (operator 4)."""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridjobs.llm.tables import slices, table

#: The base patterns (fixed values); letters of the first group stand in either case.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
#: Words of which an assignment has one, for a quick look.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Order of kinds that start at the same place.
KINDS = ("assign", "access", "hex", "jwt", "key", "encoded")
#: Candidates of the structural checks; encoded ones from the shortest secret of the base patterns on (12 bytes).
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:(?!-----).)+)-----END \1-----", re.S)
#: A header in front of a key: with the rest of its line, or with one word where lines were joined.
HEADERS = [re.compile(r"(?:\s|\\[nr])*([A-Za-z][A-Za-z0-9-]*):[ \t]*((?:(?!\\[nr])" + one + r")*)") for one in (r"[^\n\r]", r"\S")]
CIPHER = re.compile(r"[A-Za-z0-9-]+,[0-9A-Fa-f]{16,}\s*")
#: A token begins at the first mark of its run of base64 signs, so that a run is read once, however many marks it has.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+)")
B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
HEX_ANY = re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{24,}+")


def unbase64(s: str) -> bytes:
    """Bytes of base64 in either alphabet, padded or not; nothing if it isn't base64."""
    s = re.sub(r"\\[nr]|[\s\\]", "", s).rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return b""
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def der(data: bytes, depth: int = 0) -> list[int] | None:
    """Tags of a DER value's direct parts if its nested lengths fill it exactly, or None."""
    tags, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n, at = int.from_bytes(data[at : at + k]), at + k
            if n < 0x80:
                return None
        if at + n > len(data):
            return None
        if tag & 0x20 and depth < 8 and der(data[at : at + n], depth + 1) is None:
            return None
        tags.append(tag)
        at += n
    return tags


def is_key(data: bytes) -> bool:
    """A private key: a DER sequence with a version number in front, or the length-prefixed form that begins with its name."""
    if data.startswith(b"openssh-key-v1\0"):
        at = 15
        for _ in range(3):  # cipher, derivation, its options
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4])
        return at + 4 <= len(data)
    if len(data) < 24 or data[0] != 0x30 or der(data) != [0x30]:
        return False
    head = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0)
    inner = der(data[head:])
    return bool(inner) and len(inner) > 1 and inner[0] == 0x02 and data[head + 1] == 1 and data[head + 2] < 3


def opened(body: str) -> tuple[dict[str, str], bytes]:
    """Header lines and bytes of what stands between the marks of a PEM key; nothing if it isn't base64."""
    for header in HEADERS:
        heads, at = {}, 0
        while m := header.match(body, at):
            heads[m[1].lower()] = m[2]
            at = m.end()
        if data := unbase64(body[at:]):
            return heads, data
    return {}, b""


def is_pem_key(title: str, body: str) -> bool:
    """A private key between its marks: plain, or encrypted as DER, or encrypted whole as its headers say."""
    heads, data = opened(body)
    if is_key(data) or "ENCRYPTED" in title and der(data) == [0x30]:
        return True
    return "ENCRYPTED" in heads.get("proc-type", "") and bool(CIPHER.fullmatch(heads.get("dek-info", ""))) and len(data) >= 16 and len(data) % 8 == 0


def is_signed_token(s: str) -> bool:
    """Three dotted parts of which the first two are JSON objects and the header names an algorithm. Objects nested deeper than
    the parser follows (some thousand levels) are none."""
    head, body, _ = s.split(".", 2)
    try:
        head, body = json.loads(unbase64(head)), json.loads(unbase64(body))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out


class Taken:
    """Places of a text that findings cover, apart from each other and in order."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []

    def free(self, start: int, end: int) -> bool:
        at = bisect_left(self.spans, (end,))
        return not at or self.spans[at - 1][1] <= start

    def add(self, start: int, end: int) -> bool:
        """Cover a place; False if part of it is covered already."""
        free = self.free(start, end)
        if free:
            insort(self.spans, (start, end))
        return free


def as_text(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def unhex(s: str) -> bytes:
    return bytes.fromhex(s[: len(s) & ~1])


def kind_of(data: bytes) -> str | None:
    """What decoded bytes are: a key, or text that holds a secret itself, however often that is encoded in turn."""
    if is_key(data):
        return "key"
    inner = as_text(data)
    return "encoded" if inner and (base_spans(inner) or confirmed_spans(inner)) else None


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """What decodes to a key, a signed token, or text that holds a secret itself.

    Decoded text is searched like any other. It is at most three quarters as long as what it came from, and what is text as
    hex isn't tried as base64 too, so all levels together take a few times the text's own time.
    """
    out, taken = [], Taken()
    if "PRIVATE KEY-----" in text:
        out += [(m.start(), m.end(), "key") for m in PEM.finditer(text) if is_pem_key(m[1], m[2])]
    if "eyJ" in text:
        out += [(m.start(1), m.end(1), "jwt") for m in JWT.finditer(text) if is_signed_token(m[1])]
    out = [s for s in out if taken.add(s[0], s[1])]
    for pattern, decode in ((HEX_ANY, unhex), (B64, unbase64)):
        for m in pattern.finditer(text):
            if not taken.free(m.start(), m.end()) or pattern is B64 and HEX_ANY.fullmatch(m[0]) and as_text(unhex(m[0])) is not None:
                continue
            if kind := kind_of(decode(m[0])):
                taken.add(m.start(), m.end())
                out.append((m.start(), m.end(), kind))
    return out


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets of a text, by start, then kind as listed."""
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each secret (overlapping ones together) replaced by its first kind in brackets."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPANS = "array<struct<start:int,end:int,kind:string>>"


def _spans(columns: list[str], masked: bool):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("_text").to_pylist()
            found = [find(t or "") for t in texts]
            cols = [batch.column(c) for c in columns] + [pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in f] for f in found], kind)]
            if masked:
                cols.append(pa.array([t if t is None or not f else mask(t, f) for t, f in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*columns, "secrets", *["masked"] * masked])

    return run


def secret_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), masked: bool = False) -> DataFrame:
    """``keep`` columns, ``secrets`` (start, end, kind in code points, end exclusive) of every whole text and, with ``masked``,
    the text with its secrets masked.

    Null and empty texts hold none (a null stays null when masked). Every row gives one row, repeated rows too; spans of
    different kinds may overlap and all stay. Columns that are not kept are not read. A very long text is
    one task's, whole; an empty table gives an empty one. One pass over the text, no shuffle.
    """
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    d = docs.select(*keep, F.col(text).alias("_text"))
    return d.mapInArrow(_spans(list(keep), masked), f"{kinds}, secrets {SPANS}" + ", masked string" * masked)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    told = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.array_join(F.transform(base, told), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", told), ",").alias("spans"),
    )

