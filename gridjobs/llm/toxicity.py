"""Toxicity of whole texts after noisy-channel deobfuscation (operator 6).

Words that look disguised (digits and signs between letters, spaced or dotted letters, long repetitions) become a lattice of
the characters that may be meant; a Viterbi search under a character language model picks the likeliest word, and the
restored words are scored. The character model is counted over all documents; the word weights and the logistic scorer are
fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridjobs.functions.session import cut
from gridjobs.llm.tables import slices, table

#: What a sign may stand for (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
#: Signs that may stand between the letters of one word.
BETWEEN = set(".-_*~' /\\,")
#: Labelled rows of which the weights are learned, at most; rows come in the order of a hash of their id.
TRAIN_ROWS = 16_000
#: Documents with label 1 that a word or stem must be in, and the log ratio from which it counts; from STRONG on, one is enough.
SUPPORT, LEAST, STRONG = 6, 1.2, 4.0
#: Word beginnings that are learned beside whole words.
STEMS = range(4, 9)
#: Score from which a document is predicted toxic.
PREDICT = 0.3
#: Distinct words that a worker remembers.
REMEMBERED = 200_000
LETTERS = re.compile(r"[^\W\d_]+")
EDGES = re.compile(r"^[^\w@$]+|[^\w$@]+$|[$@!*]{2,}$")
SEPARATORS = re.compile(r"[-._~'/\\,]+")
#: What is an address of mail or of the web as a whole, and the signs that such have.
ADDRESS = re.compile(r"(?:mailto:)?[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,24}|(?:https?|s?ftps?|wss?|file|git|ssh)://[^\s]+")
MARKS = re.compile(r"[@:/]+")
TRIPLE = re.compile(r"(.)\1\1")
DOUBLE = re.compile(r"(.)\1")
#: Characters of the language model: 0 stands for the edge of a word, then letters a-z, then accented letters.
CODES = {c: n + 1 for n, c in enumerate("abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100))))}
SIZE = 64


def _code_table() -> bytes:
    return bytes(CODES.get(chr(b), 0) for b in range(256))


def trigrams(texts: list[str]) -> np.ndarray:
    """Counts of three character codes in a row over lower-case texts; all that isn't a letter of the model is an edge."""
    out = np.zeros(SIZE**3, np.int64)
    known, held, size = _code_table(), [], 0
    for text in [*texts, None]:
        if text is not None:
            held.append(text.lower().encode("latin-1", "replace"))
            size += len(held[-1])
        if held and (text is None or size > 500_000):
            code = np.frombuffer((b"  " + b"  ".join(held) + b"  ").translate(known), np.uint8).astype(np.int32)
            out += np.bincount((code[:-2] * SIZE + code[1:-1]) * SIZE + code[2:], minlength=SIZE**3)
            held, size = [], 0
    return out


def smoothed(counts: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(third code | first two), counts and the learned words mixed in equal parts, each backed off to shorter contexts."""

    def model(c: np.ndarray) -> np.ndarray:
        c = c.reshape(SIZE, SIZE, SIZE).astype(float)
        one = (c.sum((0, 1)) + 0.1) / (c.sum() + 0.1 * SIZE)
        two = (c.sum(0) + 5 * one) / (c.sum((0, 2)) + 5)[:, None]
        return (c + 5 * two[None]) / (c.sum(2) + 5)[:, :, None]

    p = model(counts)
    if words:
        p = (p + model(trigrams([" " + w + " " for w in words]))) / 2
    return np.log(p).astype(np.float32)


#: A gap in spelled text: nothing, or the edge of a word.
GAP = ([0], [0, 1])


def _readings(word: str) -> Iterator[tuple[list[int], list[int]]]:
    """What each run of one sign may stand for, and how often; signs that only stand between letters are passed over."""
    for c, same in groupby(word):
        n = sum(1 for _ in same)
        if c in BETWEEN and c != "*":
            continue
        readings = [CODES[x] for x in (c if c in CODES else LEET.get(c, ""))]
        if readings:
            yield readings, [1, 2] if n > 2 else [n]


def _spelled(letters: str) -> Iterator[tuple[list[int], list[int]]]:
    """The same for spelled text, whose words may end at any letter."""
    for k, step in enumerate(_readings(letters)):
        if k:
            yield GAP
        yield step


def decode(word: str, logp: np.ndarray, spelled: bool = False) -> str:
    """The likeliest letters behind a disguised word: each sign's readings, repetitions as one or two, separators dropped.

    With ``spelled`` the gap after each letter is nothing or a space, whichever the model finds likelier."""
    states = {(0, 0): (0.0, ())}
    for readings, copies in (_spelled if spelled else _readings)(word):
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in states.items():
            for x in readings:
                for n in copies:
                    s = score + (float(logp[a, b, x]) if n else 0.0) + (float(logp[b, x, x]) if n == 2 else 0.0)
                    to = (x, x) if n == 2 else (b, x) if n else (a, b)
                    if to not in new or s > new[to][0]:
                        new[to] = (s, (path, x, n))
        states = new
    path = max(((s + float(logp[a, b, 0]), p) for (a, b), (s, p) in states.items()), key=lambda x: x[0])[1]
    letters = {n: c for c, n in CODES.items()} | {0: " "}
    out = []
    while path:
        path, x, n = path
        out.append(letters[x] * n)
    return "".join(reversed(out))


def disguised(word: str) -> bool:
    """Whether a lower-case word, stripped at its edges, has signs between letters or a letter three times in a row."""
    if word.isalpha():
        return bool(TRIPLE.search(word))
    if sum(c.isalpha() for c in word) < 2:
        return False
    if re.fullmatch(r"[0-9a-f]{16,}", word) or ADDRESS.fullmatch(word):
        return False
    core = word[:-1] if word[-1] in "!" else word
    return any(c in LEET or c in BETWEEN for c in core) and not re.fullmatch(r"[^\W\d_]{2,}(['-][^\W\d_]{2,})+", word)


def pieces(word: str) -> list[str]:
    """The parts between a word's separators; single signs that follow each other are one part, as they spell words."""
    out = []
    for single, parts in groupby(filter(None, SEPARATORS.split(word)), lambda p: len(p) == 1):
        out += ["".join(parts)] if single else parts
    return out


def spaced(words: list[str]) -> list[str]:
    """Words spelled with a space between letters: three or more single characters in a row, not all the same."""
    ones = [k for k, w in enumerate(words) if not w[1:]]
    out, k = [], 0
    while k < len(ones):
        n = 1
        while k + n < len(ones) and ones[k + n] == ones[k] + n:
            n += 1
        if n >= 3:
            run = "".join(words[ones[k] : ones[k] + n])
            if len(set(run)) > 1 and any(c.isalpha() for c in run):
                out.append(run)
        k += n
    return out


@dataclass
class Model:
    """Weights of words and stems, the character model, and the logistic scorer."""

    weights: dict[str, float] = field(default_factory=dict)
    logp: np.ndarray | None = None
    scorer: np.ndarray = field(default_factory=lambda: np.array([-3.0, *[0.0] * 7]))
    clean_rate: float = 1e-3
    seen: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "lengths"} | {"seen": {}}

    def plain(self, word: str) -> float:
        """Weight of a word of letters: its own or the largest of its beginnings."""
        get = self.weights.get
        best = get(word, 0.0)
        for k in STEMS:
            if k >= len(word):
                break
            if (x := get(word[:k] + "-", 0.0)) > best:
                best = x
        return best

    def weight(self, token: str) -> float:
        word = EDGES.sub("", token)
        best = max((self.plain(w) for w in ([word] if word.isalpha() else LETTERS.findall(word))), default=0.0)
        if best < STRONG and self.logp is not None and word:
            if disguised(word):
                best = max(best, self.plain(decode(word, self.logp)), self.phrase(word), self.marked(word))
            elif DOUBLE.search(word):
                best = max(best, self.strong(DOUBLE.sub(r"\1", word)))
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen[token] = best
        return best

    def marked(self, word: str) -> float:
        """Weight of a token with signs of addresses that is none: of its parts, each decoded, or of all of them together."""
        if not MARKS.search(word):
            return 0.0
        parts = [p for p in [EDGES.sub("", p) for p in MARKS.split(word)] if disguised(p)]
        return max(self.strong(decode(p, self.logp)) for p in [MARKS.sub("", word), *parts])

    def strong(self, word: str) -> float:
        return x if (x := self.plain(word)) >= STRONG else 0.0

    @cached_property
    def lengths(self) -> list[int]:
        """Lengths of the learned words of strong weight that are looked for inside spelled text."""
        return sorted({len(w) for w, x in self.weights.items() if x >= STRONG and len(w) >= 4 and not w.endswith("-")})

    def phrase(self, word: str) -> float:
        """Weight of a token's strongest part, each decoded by itself, where separators leave several or spell them out."""
        if not SEPARATORS.search(word):
            return 0.0
        parts = pieces(word)
        runs = (self.run(p) for p in parts if len(p) >= 3) if self.spelled(word) else ()
        return max([0.0, *(self.strong(decode(p, self.logp)) for p in parts if disguised(p)), *runs])

    @staticmethod
    def spelled(word: str) -> bool:
        """Whether separators stand between most signs of a word."""
        ones = [len(p) == 1 for p in SEPARATORS.split(word) if p]
        return 2 * sum(ones) > len(ones) and sum(ones) >= 3

    def run(self, letters: str) -> float:
        """Weight of spelled letters, however many: of the strongest word that they are decoded to, or that stands in all of them."""
        word = decode(letters, self.logp)
        inner = (self.weights.get(word[a : a + n], 0.0) for a in range(len(word)) for n in self.lengths if a + n <= len(word))
        words = (self.strong(w) for w in decode(letters, self.logp, True).split())
        return max(self.strong(word), max(words, default=0.0), max((x for x in inner if x >= STRONG), default=0.0))

    def counts(self, text: str) -> tuple[int, int, int, float]:
        """Words, those of strong and of weak weight, and the weights' sum; a word counts as often as it is said."""
        tokens = text.lower().split()
        seen, weight = self.seen, self.weight
        hits = [(x, n) for t, n in Counter(tokens).items() if (x := seen[t] if t in seen else weight(t))]
        if self.logp is not None:
            hits += [(x, 1) for s in spaced(tokens) if (x := self.run(s))]
        strong = sum(n for x, n in hits if x >= STRONG)
        return len(tokens), strong, sum(n for _, n in hits) - strong, math.fsum(x * n for x, n in hits)

    def features(self, n: int, strong: int, weak: int, mass: float) -> list[float]:
        over = (weak - n * self.clean_rate) / math.sqrt(n * self.clean_rate + 1)
        return [1.0, float(strong > 0), math.log1p(strong), math.log1p(weak), weak / (n + 20) * 10, over, math.log1p(mass), math.log1p(n) / 5]

    def score(self, text: str) -> float:
        z = float(np.dot(self.scorer, self.features(*self.counts(text))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_scorer(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
    return w


def word_counts(texts: list[str], labels: list[int]) -> dict[str, list[int]]:
    """word or stem -> times in toxic texts, times in others, toxic texts with it."""
    out: dict[str, list[int]] = {}
    for text, y in zip(texts, labels, strict=True):
        of: Counter = Counter()
        for w, n in Counter(m[0] for m in LETTERS.finditer(text.lower())).items():
            of[w] += n
            for k in STEMS:
                if k >= len(w):
                    break
                of[w[:k] + "-"] += n
        for w, n in of.items():
            c = out.setdefault(w, [0, 0, 0])
            c[1 - y] += n
            c[2] += y
    return out


def _trigram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE**3, np.int64)
    for batch in slices(batches):
        total += trigrams([t for t in batch.column("text").to_pylist() if t])
    at = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["code", "n"])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        c = word_counts([t or "" for t in batch.column("text").to_pylist()], batch.column("y").to_pylist())
        cols = [pa.array(list(c), pa.string()), *(pa.array([v[k] for v in c.values()], pa.int64()) for k in range(3))]
        yield pa.RecordBatch.from_arrays(cols, names=["word", "toxic", "other", "support"])


def _count_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            c = [model.counts(t or "") for t in batch.column("text").to_pylist()]
            cols = [batch.column("y"), *(pa.array([x[k] for x in c], pa.float64()) for k in range(4))]
            yield pa.RecordBatch.from_arrays(cols, names=["y", "n", "strong", "weak", "mass"])
        model.seen.clear()

    return run


def chosen_weights(counts: list[tuple[str, int, int, int]], toxic: int, other: int) -> dict[str, float]:
    """Weights of words in enough toxic texts; a stem counts only where no single word makes up most of it."""
    found = {w: (math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (other + 1)), s) for w, a, b, s in counts}
    largest: dict[str, int] = {}
    for w, (_, s) in found.items():
        for k in STEMS:
            if not w.endswith("-") and k < len(w):
                largest[w[:k] + "-"] = max(s, largest.get(w[:k] + "-", 0))
    return {w: x for w, (x, s) in found.items() if x >= LEAST and (not w.endswith("-") or largest.get(w, 0) <= 0.6 * s)}


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from all documents (characters) and at most ``train_rows`` labelled ones, in the order of a hash of doc_id.

    ``labels`` has doc_id and toxic; rows with a null in either are left out, and of repeated labels the largest counts. Of rows
    that repeat an id one is learned from (the one of smallest text), so that the sample keeps its bound.
    Only tables of bounded size reach the driver: character counts (at most 64 x 64 x 64), words in at least ``SUPPORT`` toxic
    rows of the sample, and four numbers for each row of the sample. Without both labels no document is predicted toxic.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", F.col("text").alias("text"))
    y = labels.dropna(subset=["doc_id", "toxic"]).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = d.join(F.broadcast(y), "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = cut(texts.select("text", "y").repartition(max(8, spark.sparkContext.defaultParallelism)))
    model = Model()
    counts = np.zeros(SIZE**3, np.int64)
    for r in d.select("text").mapInArrow(_trigram_rows, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[r["code"]] = r["n"]
    rows = sample.mapInArrow(_word_rows, "word string, toxic long, other long, support long")
    words = cut(rows.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("toxic", "other", "support"))))
    total = words.where("not endswith(word, '-')").agg(F.sum("toxic"), F.sum("other")).first()
    if total[0] is None or not total[0] or not total[1]:
        return model
    ratio = F.log((F.col("toxic") + 0.5) / (total[0] + 1)) - F.log((F.col("other") + 0.5) / (total[1] + 1))
    picked = words.where(F.col("support") >= SUPPORT).where((ratio >= LEAST) | ~F.endswith("word", F.lit("-")) & (ratio >= 0)).collect()
    model.weights = chosen_weights([tuple(r) for r in picked], *total)
    model.logp = smoothed(counts, [w for w, x in model.weights.items() if x >= STRONG and not w.endswith("-")])
    c = sample.mapInArrow(_count_rows(spark.sparkContext.broadcast(model)), "y int, n double, strong double, weak double, mass double").toPandas()
    clean = c[c["y"] == 0]
    model.clean_rate = float((clean["weak"].sum() + 1) / (clean["n"].sum() + 1000))
    x = np.array([model.features(*v) for v in c[["n", "strong", "weak", "mass"]].itertuples(index=False)])
    model.scorer = fit_scorer(x, c["y"].to_numpy(float))
    return model


def _scores(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            s = [model.score(t or "") for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(s, pa.float64())], names=[*columns, "score"])
        model.seen.clear()

    return run


def toxicity(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1, higher: likelier toxic) of every whole text.

    Null and empty texts are scored like a text without words. Repeated rows give repeated results, an empty table an empty
    one; columns that are not kept are not read. One pass over the text, no shuffle.
    """
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(_scores(shared, list(keep)), f"{kinds}, score double")


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def fit_on_tables(spark: SparkSession, sf_dir: str) -> Model:
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return fit(table(spark, sf_dir, "documents"), labels)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), fit_on_tables(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
