"""Byte-level BPE encoding and decoding of whole texts (operator 7).

Ordinary text is cut into pre-tokens, and each distinct pre-token is encoded once per worker. Unsplit stretches beyond
``HALF`` bytes are encoded by tree concatenation: both halves are encoded on their own, then a growing window around the
join is encoded anew until it agrees with what stands to its left and to its right. Texts beyond ``SEGMENT`` characters
are cut into segments that separate tasks encode; the same join puts segments together where the cut fell inside a stretch,
be it letters, digits, signs or white space.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice, pairwise

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridjobs.functions.session import cut
from gridjobs.llm.tables import slices, table

#: White space as the tokenizer's pattern has it (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-token pattern of byte-level BPE (fixed value).
CONTRACTION = regex.compile(r"'(?:[stmd]|re|ve|ll)")
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Bytes of an unsplit stretch that are merged directly; longer ones are halved.
HALF = 256
#: Characters of a segment of a long text, and how far to look for a place where the pattern surely cuts.
SEGMENT = 65_536
#: Places that are looked at for a sure cut before one inside a pre-token is taken.
NEAR = 4_096
LETTER, NUMBER, WHITE = regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(rf"[{SPACE}]")
#: Distinct pre-tokens that a worker remembers, and pre-tokens handled at a time within a text.
REMEMBERED, AT_A_TIME = 150_000, 65_536
#: A merge is kept as rank << 20 | id; NONE stands above all.
NONE, IDS = 1 << 60, (1 << 20) - 1


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def _from_ranks(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Ids and merges of a file of ranked tokens; a token's last merge is that of the two parts that lower ranks leave of it."""
    with open(path, "rb") as f:
        ids = {base64.b64decode(t): int(n) for t, n in (line.split() for line in f if line.strip())}
    merges = []
    for token in sorted(ids, key=ids.__getitem__):
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            found = [ids.get(x + y, NONE) for x, y in pairwise(parts)]
            k = found.index(min(found))
            if found[k] > ids[token]:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) == 2:
            merges.append((parts[0], parts[1]))
    return ids, merges


class Codec:
    """Encoder and decoder of one vocabulary file (merges in JSON, or ranked tokens); ids travel as little-endian unsigned 32-bit
    integers."""

    def __init__(self, path: str):
        special: list[dict] = []
        if path.endswith(".tiktoken"):
            self.ids, pairs = _from_ranks(path)
        else:
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            letters, special = _byte_letters(), spec["added_tokens"]
            raw = lambda s: bytes(letters[c] for c in s)
            self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
            pairs = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        self.rank = {(self.ids[x], self.ids[y]): n << 20 | self.ids[x + y] for n, (x, y) in enumerate(pairs)}
        #: Pieces are handed whole to the compiled merger where token ids stand in merge order, as it expects.
        in_order = all(x >> 20 < y >> 20 and x & IDS < y & IDS for x, y in pairwise(self.rank.values()))
        self.short = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=self.ids, special_tokens={}).encode_ordinary if in_order else None
        self.base = [self.ids[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in special}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.pattern = regex.compile(PRETOKEN)
        self.ascii_pattern = re.compile(PRETOKEN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+"))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.seen: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Merges of a piece, lowest rank first, leftmost first."""
        ids = [self.base[b] for b in piece]
        if len(ids) > 96:
            return self._merge_long(ids)
        get = self.rank.get
        while len(ids) > 1:
            found = [get(p, NONE) for p in zip(ids, ids[1:])]  # noqa: B905
            best = min(found)
            if best == NONE:
                break
            k, new = found.index(best), best & IDS
            pair = (ids[k], ids[k + 1])
            ids[k : k + 2] = [new]
            k += 1
            while k + 1 < len(ids):
                if (ids[k], ids[k + 1]) == pair:
                    ids[k : k + 2] = [new]
                k += 1
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs and a linked list."""
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        get = self.rank.get
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := get((ids[k], ids[k + 1]), NONE)) != NONE]
        heapify(heap)
        while heap:
            r, k, a, b = heappop(heap)
            nxt = after[k]
            if ids[k] != a or nxt < 0 or ids[nxt] != b:
                continue
            ids[k], ids[nxt] = r & IDS, -1
            after[k] = after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
            for p, q in ((before[k], k), (k, after[k])):
                if p >= 0 and q >= 0 and (x := get((ids[p], ids[q]), NONE)) != NONE:
                    heappush(heap, (x, p, ids[p], ids[q]))
        return [i for i in ids if i >= 0]

    def agree(self, a: int, b: int) -> bool:
        """Whether two tokens stand side by side when their bytes are encoded as one piece."""
        return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of one unsplit piece from those of its halves: a piece is encoded rightly when each pair of neighbours agrees."""
        self.join_onto(left, right)
        return left

    def join_onto(self, left, right) -> None:
        """The same, with the result in ``left`` (a list or an array): only the window around the join is written anew."""
        w = 1
        while left and right:
            lo, hi = max(0, len(left) - w), min(len(right), w)
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, [*left[lo:], *right[:hi]])))
            if (lo == 0 or self.agree(left[lo - 1], window[0])) and (hi == len(right) or self.agree(window[-1], right[hi])):
                del left[lo:]
                left.extend(window)
                left.extend(right[hi:])
                return
            w *= 2
        left.extend(right)

    def piece(self, data: bytes) -> list[int]:
        """Encoding of one unsplit piece of any length."""
        if len(data) <= HALF:
            return self.merge(data)
        mid = len(data) // 2
        return self.join(self.piece(data[:mid]), self.piece(data[mid:]))

    def _packed(self, pre: str) -> bytes:
        small = len(pre) <= HALF // 4
        ids = self.short(pre) if small and self.short else self.piece(pre.encode())
        out = struct.pack(f"<{len(ids)}I", *ids)
        if small:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[pre] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, packed."""
        out: list[bytes] = []
        seen, packed = self.seen, self._packed
        for part in self.split_special.split(text) if self.split_special and "<" in text else (text,):
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
                continue
            pattern = self.ascii_pattern if part.isascii() else self.pattern
            if len(part) <= 8 * AT_A_TIME:
                out.append(b"".join([seen.get(p) or packed(p) for p in pattern.findall(part)]))
                continue
            found = pattern.finditer(part)
            while some := [m.group() for m in islice(found, AT_A_TIME)]:
                out.append(b"".join([seen.get(p) or packed(p) for p in some]))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """Text of packed ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        import numpy as np

        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=4)
def special_tokens(path: str) -> tuple[str, ...]:
    return tuple(codec(path).special)


def _kind(c: str) -> str:
    return "L" if LETTER.match(c) else "N" if NUMBER.match(c) else "S" if WHITE.match(c) else "P"


def cut_at(text: str, at: int, special: tuple[str, ...] = ()) -> bool | None:
    """Whether a cut before ``text[at]`` falls inside a pre-token (True), between two that the pattern cuts too (False), or where
    it would change what stands beside it (None).

    The pattern begins anew at each cut, so one between characters of different kinds is sure, but for an apostrophe that may
    begin a contraction, and for white space, the last of which belongs to what follows; so is one beside a special token. Inside a run of one kind both sides stay
    as they are when joined, unless the right one would begin with a contraction or with its last white space."""
    for s in special:
        if s in text[max(0, at - len(s) + 1) : at + len(s) - 1]:
            return None
        if text.endswith(s, 0, at) or text.startswith(s, at):
            return False
    a, b = _kind(text[at - 1]), _kind(text[at])
    if a == b == "S":
        return True if at + 1 < len(text) and _kind(text[at + 1]) == "S" else None
    if a == "S" or text[at - 1] == "'" and a != b:
        return None
    if a == b:
        # letters behind an apostrophe may be a contraction's, or what a contraction left over
        near = "'" in text[max(0, at - 3) : at + 1] if a == "L" else a == "P" and CONTRACTION.match(text, at)
        return None if near else True
    return False


def cuts(text: str, size: int, special: tuple[str, ...] = ()) -> list[tuple[int, int, bool]]:
    """(start, end, hard) of the segments of a text; hard: the cut at the end falls inside a pre-token.

    A sure place in the second half of a segment is taken if one is near its end, and else the last place that can be joined.
    Should there be neither (an apostrophe follows each letter, say), the segment is longer."""
    out, start = [], 0
    while len(text) - start > size:
        end, hard = 0, False
        for at in range(start + size, start + size - min(size // 2, NEAR), -1):
            how = cut_at(text, at, special)
            if how is not None and (not how or not end):
                end, hard = at, how
            if how is False:
                break
        at = start + size
        while not end:
            at += 1
            if at >= len(text):
                end = at
            elif (how := cut_at(text, at, special)) is not None:
                end, hard = at, how
        out.append((start, end, hard))
        start = end
    return [*out, (start, len(text), False)] if start < len(text) or not out else out


def _encoded(path: str, columns: list[str], what: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches):
            packed = [c.encode(t or "") for t in batch.column("text").to_pylist()]
            yield _result(batch.select(columns), c, packed, what)
        c.seen.clear()

    return run


#: What is told of an encoded text, and its columns.
TOLD = {"ids": "ids binary", "count": "n_tokens long", "digest": "n_tokens long, ids_sha256 string, decoded_sha256 string"}


def _result(kept: pa.RecordBatch, c: Codec, packed: list[bytes], what: str) -> pa.RecordBatch:
    cols, names = list(kept.columns), list(kept.schema.names)
    if what == "ids":
        cols.append(pa.array(packed, pa.binary()))
        names.append("ids")
    else:
        cols.append(pa.array([len(p) // 4 for p in packed], pa.int64()))
        names.append("n_tokens")
    if what == "digest":
        cols += [pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()), pa.array([hashlib.sha256(c.decode(p).encode()).hexdigest() for p in packed], pa.string())]
        names += ["ids_sha256", "decoded_sha256"]
    return pa.RecordBatch.from_arrays(cols, names=names)


def _segments(path: str, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = cuts(text, size, special_tokens(path))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([h for _, _, h in parts], pa.bool_()), pa.array([text[a:b] for a, b, _ in parts], pa.string())],
                    names=["row", "part", "hard", "text"],
                )

    return run


def _encoded_segments(path: str) -> Callable:
    """Segments' ids, and how many of them belong to their first and to their last pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches, 16):
            ids, head, tail = [], [], []
            for text in batch.column("text").to_pylist():
                parts = c.split_special.split(text) if c.split_special and "<" in text else [text]
                first = c.pattern.match(parts[0])
                last = None
                for last in c.pattern.finditer(parts[-1]):
                    pass
                ids.append(c.encode(text))
                head.append(len(c.encode(first.group())) // 4 if first else 0)
                tail.append(len(c.encode(last.group())) // 4 if last else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("row", "part", "hard")), pa.array(ids, pa.binary()), pa.array(head, pa.int64()), pa.array(tail, pa.int64())], names=["row", "part", "hard", "ids", "head", "tail"])
        c.seen.clear()

    return run


def _joined(path: str, what: str) -> Callable:
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        c = codec(path)
        done: list[bytes] = []
        stretch: array | None = None  # ids of the pre-token that the last cut fell inside
        for r in group.sort_by("part").to_pylist():
            ids = r["ids"]
            n, head, tail = len(ids) // 4, r["head"], r["tail"]
            if stretch is not None:
                c.join_onto(stretch, array("I", ids[: 4 * head]))
                if head == n and r["hard"]:
                    continue
                done.append(stretch.tobytes())
                ids, n, stretch = ids[4 * head :], n - head, None
            if r["hard"]:
                stretch = array("I", ids[4 * (n - tail) :])
                ids = ids[: 4 * (n - tail)]
            done.append(ids)
        kept = pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64())], names=["row"])
        return pa.Table.from_batches([_result(kept, c, [b"".join(done)], what)])

    return run


def encode_texts(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), keep_ids: bool = False, segment: int = SEGMENT, count_only: bool = False) -> DataFrame:
    """``keep`` columns and the encoding of every whole text: n_tokens, ids_sha256, decoded_sha256, or with ``keep_ids`` the packed
    ids, or with ``count_only`` n_tokens alone.

    Null texts count as empty: no ids, the hash of nothing. Repeated rows give repeated results; other columns, whatever
    their names, are not read. An empty table gives an empty one. Texts of more than ``segment`` characters are numbered and
    written to the shared folder, so that a lost task meets the same numbers again, and encoded in segments by separate
    tasks; the ids of one text meet in one task, since its hash runs over all of them in order.
    """
    path, what = path or default_path(), "ids" if keep_ids else "count" if count_only else "digest"
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text"))
    long = F.length("text") > segment
    kinds = ", ".join(f"`{c}` {t}" for c, t in d.drop("text").dtypes)
    short = d.where(~long).mapInArrow(_encoded(path, list(keep), what), f"{kinds}, {TOLD[what]}")
    rows = cut(d.where(long).withColumn("row", F.monotonically_increasing_id()))
    parts = rows.select("row", "text").mapInArrow(_segments(path, segment), "row long, part int, hard boolean, text string")
    parts = parts.repartition(F.col("row"), F.col("part")).mapInArrow(_encoded_segments(path), "row long, part int, hard boolean, ids binary, head long, tail long")
    whole = parts.groupBy("row").applyInArrow(_joined(path, what), f"row long, {TOLD[what]}")
    return short.unionByName(rows.drop("text").join(whole, "row").drop("row"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))
