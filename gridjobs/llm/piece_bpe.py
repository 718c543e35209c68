"""Byte-level BPE by a sentencepiece model that is written from a file of ranked tokens (operator 11)."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain, islice, pairwise

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridjobs.llm.bpe import SPACE
from gridjobs.llm.tables import slices, table

#: Distinct pre-tokens that a worker remembers, the longest of them, and pre-tokens of a long text handled at a time.
REMEMBERED, LONGEST, AT_A_TIME = 150_000, 64, 65_536
#: Characters of texts that are handled together.
TOGETHER = 1_000_000
#: Kinds of pieces, the BPE kind of model, and numbers of fields in the model's format (fixed values).
NORMAL, UNKNOWN, UNUSED, BPE = 1, 2, 5, 2
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND = 1, 2, 3
MODEL_TYPE, VOCAB_SIZE, UNK, BOS, EOS, PAD = 3, 4, 40, 41, 42, 43
NAME, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def letters() -> str:
    """The letter that stands for each byte in a piece: one that no model takes for white space or a mark of its own."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(plain)))
    return "".join(out[b] for b in range(256))


LETTERS = letters()
BYTES = {ord(c): b for b, c in enumerate(LETTERS)}


def _number(n: int) -> bytes:
    """A whole number in groups of seven bits, the lowest first; negative ones as 64 bits."""
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a message: whole numbers, single floats, or bytes (texts and inner messages)."""
    if isinstance(value, float):
        return _number(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    return _number(number << 3 | 2) + _number(len(value)) + value


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(n) for t, n in (line.split() for line in f if line.strip())}


def serialized_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of ranked tokens.

    Piece n is the token of rank n with each byte as its letter, scored -n, so the pair that is merged next is the leftmost one of
    lowest rank. Numbers that no token has are unused pieces, and the unknown piece, which nothing meets as every byte is
    a piece, comes last. Texts are taken as they are: no prefix, no folding of characters or spaces.
    """
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a token: {missing[:5]}")
    tokens = {n: t for t, n in ranks.items()}
    size = max(tokens) + 1
    out = []
    for n in range(size):
        text = "".join(map(LETTERS.__getitem__, tokens[n])) if n in tokens else f"▁{n}"
        out.append(_field(PIECES, _field(PIECE, text.encode()) + _field(SCORE, float(-n)) + _field(KIND, NORMAL if n in tokens else UNUSED)))
    out.append(_field(PIECES, _field(PIECE, "▁unknown".encode()) + _field(SCORE, float(-size)) + _field(KIND, UNKNOWN)))
    none = b"".join(_field(f, -1) for f in (BOS, EOS, PAD))
    trainer = _field(MODEL_TYPE, BPE) + _field(VOCAB_SIZE, size + 1) + _field(UNK, size) + none
    normalizer = _field(NAME, b"identity") + b"".join(_field(f, 0) for f in (DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES))
    return b"".join([*out, _field(TRAINER, trainer), _field(NORMALIZER, normalizer)])


def ascii_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts of ASCII alone, which the plainer engine finds faster; None where it holds other classes than these."""
    for old, new in ((r"[^\s\p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]"), (r"\p{L}", "[A-Za-z]"), (r"\p{N}", "[0-9]"), (r"\s", r"[\t-\r ]"), (r"\S", r"[^\t-\r ]")):
        pattern = pattern.replace(old, new)
    return None if r"\p" in pattern else re.compile(pattern)


class Codec:
    """Encoder and decoder of one file of ranked tokens; ids travel as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialized_model(self.ranks))
        # white space as the pattern's own engine has it
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        self.ascii = ascii_pattern(pattern) or self.pattern
        self.decimal = [b"%d" % n for n in range(max(self.ranks.values()) + 1)]
        known = set(self.ranks.values())
        self.bytes_of = [self.model.id_to_piece(n).translate(BYTES).encode("latin-1") if n in known else b"" for n in range(len(self.decimal))]
        self.seen: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        """Ids of distinct pre-tokens: whole tokens by their rank, the others by the model."""
        raw = [p.encode() for p in pieces]
        ranks = [self.ranks.get(b) for b in raw]
        parts = [k for k, r in enumerate(ranks) if r is None]
        # no UTF-8 holds the byte 255, so its letter can stand between pre-tokens
        lettered = b"\xff".join([raw[k] for k in parts]).decode("latin-1").translate(LETTERS).split(LETTERS[255])
        found = self.model.encode(lettered, out_type=int, num_threads=1) if parts else []
        flat = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        ends = [4 * n for n in accumulate(map(len, found), initial=0)]
        self.seen.update((p, struct.pack("<I", r)) for p, r in zip(pieces, ranks, strict=True) if r is not None)
        self.seen.update((pieces[k], flat[x:y]) for k, (x, y) in zip(parts, pairwise(ends), strict=True))

    def packed(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of some texts, which come as their pre-tokens."""
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        seen = self.seen
        new = [p for p in set(chain.from_iterable(texts)) if p not in seen]
        if new:
            self._learn(new)
        out = [b"".join([seen[p] for p in t]) for t in texts]
        for p in new:
            if len(p) > LONGEST:
                del seen[p]
        return out

    def encode(self, texts: list[str]) -> Iterator[list[bytes]]:
        """Each text's ids, in pieces for a text of many characters; texts are taken together while they are short."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            pattern = self.ascii if text.isascii() else self.pattern
            if size and size + len(text) > TOGETHER:
                yield from ([ids] for ids in self.packed(group))
                group, size = [], 0
            if len(text) <= TOGETHER:
                group.append(pattern.findall(text))
                size += len(text)
                continue
            yield from ([ids] for ids in self.packed(group))
            group, size = [], 0
            found = (m.group() for m in pattern.finditer(text))
            yield (self.packed([some])[0] for some in iter(lambda: list(islice(found, AT_A_TIME)), []))  # noqa: B023
        yield from ([ids] for ids in self.packed(group))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the letters of the ids' pieces."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, packed: Iterable[bytes]) -> tuple[int, str, str]:
        """Number of tokens, hash of the decimal ids, hash of the decoded bytes."""
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        for some in packed:
            ids = np.frombuffer(some, "<u4").tolist()
            ids_hash.update((b" " if n and ids else b"") + b" ".join(map(self.decimal.__getitem__, ids)))
            text_hash.update(self.decode(ids))
            n += len(ids)
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _encoded(path: str, pattern: str, columns: list[str], keep_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in slices(batches):
            found = c.encode([t or "" for t in batch.column("_text").to_pylist()])
            if keep_ids:
                cols = [pa.array([b"".join(p) for p in found], pa.binary())]
            else:
                n, ids, text = zip(*(c.digest(p) for p in found), strict=True) if batch.num_rows else ((), (), ())
                cols = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())]
            names = ["ids"] if keep_ids else ["n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in columns), *cols], names=[*columns, *names])
        c.seen.clear()

    return run


def encode_pieces(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), keep_ids: bool = False) -> DataFrame:
    """``keep`` columns and the encoding of every whole text: n_tokens, ids_sha256 and decoded_sha256, or with ``keep_ids`` the ids
    packed as little-endian unsigned 32-bit integers, which ``decoded`` turns back.

    Each match of the pattern is encoded by itself; no special tokens. Null texts count as empty: no ids, the hash of nothing.
    Repeated rows give repeated results; other columns, whatever their names, are not read; an empty table gives an empty one. A
    very long text is encoded by its task some thousand pre-tokens at a time (with ``keep_ids`` its ids are held as well); a
    pre-token of any length goes to the model whole, which takes some 100 bytes for each of its own. Rows only pass through, so
    nothing is shuffled.
    """
    path, pattern = path or default_path(), pattern or default_pattern()
    d = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in d.drop("_text").dtypes)
    more = "ids binary" if keep_ids else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return d.mapInArrow(_encoded(path, pattern, list(keep), keep_ids), ", ".join(x for x in (kinds, more) if x))


def decoded(coded: DataFrame, path: str | None = None, pattern: str | None = None, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and text, the decoding of packed ids; bytes that are no UTF-8 become U+FFFD, null ids null."""
    path, pattern = path or default_path(), pattern or default_pattern()
    d = coded.select(*keep, F.col(ids).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in slices(batches):
            texts = [None if p is None else c.decode(np.frombuffer(p, "<u4").tolist()).decode("utf-8", "replace") for p in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return d.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in d.drop("_ids").dtypes), "text string"]))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"))
