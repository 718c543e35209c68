"""Benchmark decontamination: a BM25 index of test items that every training passage queries (operator 2)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridjobs.functions.session import cut
from gridjobs.llm.tables import slices, table

WORD = re.compile(r"\w+")
#: BM25's usual constants.
K1, B = 1.2, 0.75
#: Words of a shingle, and the share of an item's shingles that a passage must hold.
WIDTH, OVERLAP = 5, 0.8
#: Share of an item's words, in order and close together, with which a passage holds it though edits broke its shingles.
ORDERED = 0.8
#: Share of the answer's words that go with a fully overlapped question.
ANSWER = 0.8
#: Items in a block of the index, and blocks in a stretch.
BLOCK, SPAN = 8, 64
#: Items are indexed with others of their length (to the next power of two; the shortest together), and passages follow that.
LEAST = 16
#: Single precision of summed impacts.
SLACK = 1e-5
#: Passages times stretches, and terms of passages, that are held at a time.
CELLS, ROWS = 4_000_000, 50_000
#: Items whose shingles a worker remembers.
REMEMBERED = 4_096
#: Characters of items in one index (some 250 MB of arrays); more items make more indexes, and each is run over all passages.
INDEX_CHARS = 32_000_000
#: Words handled at a time within a batch.
AT_A_TIME = 100_000


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Question and answer words: the last line is the answer, or the last sentence, or else the last quarter of the words."""
    text = text.strip()
    for pattern in (r"^(.*\w.*)\n+(.*\w.*)$", r"^(.*\w.*[.?!:])\s+(.*\w.*)$"):
        if m := re.match(pattern, text, re.S):
            return words(m[1]), words(m[2])
    w = words(text)
    cut = max(1, len(w) - len(w) // 4)
    return w[:cut], w[cut:]


def shingles(w: list) -> set[tuple]:
    return {tuple(w[k : k + WIDTH]) for k in range(max(1, len(w) - WIDTH + 1))} if w else set()


def in_order(item: list, passage: list, share: float = ORDERED) -> bool:
    """Whether a stretch of the passage, at most a fifth longer than the item, has the share of its words in their order.

    Below five words that is the whole item word for word."""
    n, need = len(item), math.ceil(share * len(item) - 1e-9)
    places: dict = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    at = [k for k, w in enumerate(passage) if w in places]
    full, most = (1 << n) - 1, n + n // 5
    for i in range(len(at) - need + 1):
        if at[i + need - 1] - at[i] >= most:
            continue
        left = full  # longest common subsequence, a bit for each word of the item
        for k in passage[at[i] : at[i] + most]:
            if m := left & places.get(k, 0):
                left = (left + m | left - m) & full
        if n - left.bit_count() >= need:
            return True
    return False


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, position) of all positions of ranges."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _joint(a_key: np.ndarray, b_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the keys of ``a_key`` in the sorted ``b_key``: (position in a, position in b) of those found."""
    at = np.minimum(np.searchsorted(b_key, a_key), max(0, len(b_key) - 1))
    hit = np.nonzero(b_key[at] == a_key)[0] if len(b_key) else np.empty(0, np.int64)
    return hit, at[hit]


def _most_missing(row: np.ndarray, mass: np.ndarray, cost: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """For each row, the most mass that terms within the budget of their costs can have; the last of them counts in part."""
    of = np.argsort(-mass / cost, kind="stable")
    of = of[np.argsort(row[of], kind="stable")]
    row, mass, cost = row[of], mass[of], cost[of].astype(float)
    total = np.cumsum(cost)
    first = np.searchsorted(row, np.arange(len(budget)))
    before = total - cost - np.append(0.0, total)[first][row]
    return np.bincount(row, mass * np.clip((budget[row] - before) / cost, 0, 1), len(budget))


class Postings:
    """Inverted index of items of like length, with impacts relative to the least that a passage must have of each item.

    Postings of a term stand in order of items; ``BLOCK`` items are a block and ``SPAN`` blocks a stretch, and for each term and
    block, and each term and stretch, the largest impact is kept. A posting is a pivot if its term is one of those (the ones of most
    impact) without which the rest of the item can't reach 1. Arrays only: some 30 bytes a posting.
    """

    def __init__(self, first: int, lengths: np.ndarray, term: np.ndarray, item: np.ndarray, impact: np.ndarray):
        self.first, self.n = first, len(lengths)
        self.reach = math.ceil(1.25 * int(lengths.max()))
        falling = np.lexsort((-impact, item))
        sums = np.cumsum(impact[falling].astype(float))
        begin = np.searchsorted(item[falling], item[falling])
        rest = np.bincount(item, impact, self.n)[item[falling]] - (sums - impact[falling] - np.append(0.0, sums)[begin])
        pivot = np.zeros(len(item), bool)
        pivot[falling] = rest >= 1 - SLACK
        order = np.lexsort((item, term))
        term, self.item, self.impact, pivot = term[order], item[order].astype(np.int32), impact[order].astype(np.float32), pivot[order]
        self.n_blocks = -(-self.n // BLOCK)
        self.n_stretches = -(-self.n_blocks // SPAN)
        #: term and block (or stretch) as one number, where its postings (or blocks) begin, its largest impact, and whether a pivot is there
        self.block_key, self.block_at, self.block_max = self._grouped(term * self.n_blocks + self.item // BLOCK, self.impact)
        self.block_pivot = np.logical_or.reduceat(pivot, self.block_at[:-1]) if len(pivot) else pivot
        term, block = self.block_key // self.n_blocks, self.block_key % self.n_blocks
        self.stretch_key, self.stretch_at, self.stretch_max = self._grouped(term * self.n_stretches + block // SPAN, self.block_max)
        self.stretch_at = self.stretch_at.astype(np.int64)
        self.pivot_key = self.stretch_key[np.logical_or.reduceat(self.block_pivot, self.stretch_at[:-1])] if len(pivot) else self.stretch_key

    @staticmethod
    def _grouped(key: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.nonzero(np.append(True, key[1:] != key[:-1]))[0] if len(key) else np.empty(0, np.int64)
        return key[at], np.append(at, len(key)).astype(np.int32), np.maximum.reduceat(impact, at) if len(at) else impact

    def retrieve(self, half: np.ndarray, term: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all passages that have what they must of an item.

        ``half``, ``term``: distinct terms of each half passage, in order; a passage is a half and the one after it where
        ``pairs`` says so. Only stretches in which the passage meets a pivot are opened, if the sum of its terms' maxima there can reach
        1; in these only blocks for which both hold as well are read. What is skipped at either level is never touched.
        """
        if not len(term) or not len(self.block_key):
            return (np.empty(0, np.int64),) * 2 + (np.empty(0),)
        lo, hi = np.searchsorted(self.pivot_key, term * self.n_stretches), np.searchsorted(self.pivot_key, (term + 1) * self.n_stretches)
        of, at = _ranges(lo, hi)
        met, stretch = half[of], self.pivot_key[at] % self.n_stretches
        back = (met > 0) & pairs[np.maximum(met - 1, 0)]
        open_ = _distinct(np.append(met * self.n_stretches + stretch, (met[back] - 1) * self.n_stretches + stretch[back]))
        passage, stretch = open_ // self.n_stretches, open_ % self.n_stretches
        first, last = np.searchsorted(half, passage), np.searchsorted(half, passage + 1 + pairs[passage])
        ends = np.append(0, np.cumsum(last - first))
        found, a = [], 0
        while a < len(passage):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + ROWS, "right")) - 1)
            found.append(self._within(passage[a:b], stretch[a:b], first[a:b], last[a:b], term))
            a = b
        return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64 if k < 2 else float) for k in range(3))

    def _within(self, passage: np.ndarray, stretch: np.ndarray, first: np.ndarray, last: np.ndarray, term: np.ndarray):
        """The same for some passages, each in one stretch."""
        of, at = _ranges(first, last)
        size = int(term.max()) + 1
        own = _distinct(of * size + term[at])
        row, words = own // size, own % size
        hit, at = _joint(words * self.n_stretches + stretch[row], self.stretch_key)
        row = row[hit]
        can = np.bincount(row, self.stretch_max[at], len(passage)) >= 1 - SLACK
        row, at = row[can[row]], at[can[row]]
        which, block = _ranges(self.stretch_at[at], self.stretch_at[at + 1])
        inside = row[which] * SPAN + self.block_key[block] % self.n_blocks - stretch[row[which]] * SPAN
        open_ = np.bincount(inside, self.block_max[block], len(passage) * SPAN) >= 1 - SLACK
        open_ &= np.bincount(inside, self.block_pivot[block], len(passage) * SPAN) > 0
        keep = open_[inside]
        row, block = row[which[keep]], block[keep]
        which, post = _ranges(self.block_at[block].astype(np.int64), self.block_at[block + 1].astype(np.int64))
        key = row[which] * self.n + self.item[post]
        order = np.argsort(key, kind="stable")
        key, impact = key[order], self.impact[post[order]].astype(float)
        start = np.nonzero(np.append(True, key[1:] != key[:-1]))[0] if len(key) else np.empty(0, np.int64)
        score = np.add.reduceat(impact, start) if len(start) else impact
        key = key[start]
        hits = score >= 1 - SLACK
        return passage[key[hits] // self.n], key[hits] % self.n, score[hits]


class Index:
    """Items by length, each class with its own postings and passages.

    Counts of terms, the number of items and their mean length are those of ``everywhere`` (number, mean, {word: items}) where that
    is given, so that a share of the items is weighed as all of them are, and else of these items.
    """

    def __init__(self, items: list[tuple], everywhere: tuple[int, float, dict[str, int]] | None = None):
        parsed = [(i, *split_item(t or ""), *more) for i, t, *more in items]
        parsed = sorted((x for x in parsed if x[1] or x[2]), key=lambda x: (len(x[1]) + len(x[2]), x[0] is None, x[0]))
        self.ids, self.more = [x[0] for x in parsed], [x[3:] for x in parsed]
        self.asked = np.array([len(x[1]) for x in parsed], np.int32)
        self.terms: dict[str, int] = {}
        known = self.terms.setdefault
        self.flat = np.fromiter((known(w, len(self.terms)) for x in parsed for w in chain(x[1], x[2])), np.int64)
        lengths = np.array([len(x[1]) + len(x[2]) for x in parsed], np.int64)
        del parsed
        self.at = np.append(0, np.cumsum(lengths))
        self.sets: dict[int, tuple] = {}
        n, size = len(lengths), max(1, len(self.terms))
        key, count = np.unique(np.repeat(np.arange(n), lengths) * size + self.flat, return_counts=True)
        item, term = key // size, key % size
        many, mean, df = n, max(1.0, lengths.mean() if n else 1.0), np.bincount(term, minlength=len(self.terms))
        if everywhere:
            many, mean, counts = everywhere
            df = np.fromiter(map(counts.__getitem__, self.terms), np.int64, len(self.terms))
        idf = np.log(1 + (many - df + 0.5) / (df + 0.5))
        impact = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * lengths[item] / mean))
        impact /= np.bincount(item, impact, n)[item]
        #: the share of its own score that a passage must have at least to hold an item
        self.least = self._least(key, item, impact, count, lengths)
        impact = impact / self.least[item]
        self.classes = []
        size = np.ceil(np.log2(np.maximum(lengths, LEAST))).astype(int) if n else np.empty(0, int)
        for k in np.unique(size).tolist():
            lo, hi = int(np.searchsorted(size, k)), int(np.searchsorted(size, k, "right"))
            own = slice(int(np.searchsorted(item, lo)), int(np.searchsorted(item, hi)))
            self.classes.append(Postings(lo, lengths[lo:hi], term[own], item[own] - lo, impact[own]))

    def _least(self, key: np.ndarray, item: np.ndarray, mass: np.ndarray, count: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A bound from below of the score of any passage that ``verify`` accepts, for each item.

        What such a passage may lack is bounded for each of the ways to be accepted. Words in order: their places. Shingles: a
        place lies in up to five, so the places' shingles add up to at most five times what may be lacking. Answers: their words.
        """
        n, size, asked = len(lengths), max(1, len(self.terms)), self.asked.astype(np.int64)
        place = np.arange(len(self.flat)) - np.repeat(self.at[:-1], lengths)
        row = np.repeat(np.arange(n), lengths)
        own = np.searchsorted(key, row * size + self.flat)  # each place's (item, term)
        in_question = place < asked[row]

        def part(inside: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Most mass that may lack where the first ``length`` words are held, in order or by shingles; number of shingles."""
            places = np.bincount(own[inside], minlength=len(key))
            windows = np.maximum(length - WIDTH + 1, (length > 0).astype(np.int64))
            covered = np.minimum(np.minimum(place + 1, WIDTH), np.minimum(length[row] - place, windows[row]))
            cost = np.bincount(own[inside], covered[inside], len(key)).astype(np.int64)
            starts = inside & (place < windows[row])
            hashed = np.zeros(len(self.flat), np.uint64)
            for k in range(WIDTH):
                at = np.minimum(np.arange(len(self.flat)) + k, len(self.flat) - 1)
                hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + np.where(inside[at] & (row[at] == row), self.flat[at] + 1, 0).astype(np.uint64)
            first = np.unique(hashed[starts] * np.uint64(0x9E3779B97F4A7C15) + row[starts].astype(np.uint64), return_index=True)[1]
            shingles_ = np.bincount(row[starts][first], minlength=n)
            may = np.floor(shingles_ - OVERLAP * shingles_ + 1e-9)
            # where a shingle is repeated, one that is lacking may stand for many places
            for i in np.nonzero(shingles_ < windows)[0].tolist():
                w = self.words(i)[: int(length[i])]
                per = Counter(t for s in shingles(w) for t in set(s))
                lo, hi = np.searchsorted(key, [i * size, (i + 1) * size])
                cost[lo:hi] = [per.get(int(k) % size, 0) for k in key[lo:hi]]
            used = places > 0
            some = lambda c, budget: _most_missing(item[used], mass[used], np.maximum(1, c[used]), budget)
            need = np.ceil(ORDERED * length - 1e-9)
            return np.maximum(some(places, length - need), some(cost, WIDTH * may)), shingles_

        whole, _ = part(np.ones(len(self.flat), bool), lengths)
        question, number = part(in_question, asked)
        answer = np.bincount(own[~in_question], minlength=len(key)) > 0
        words_ = np.bincount(item[answer], minlength=n)
        rest = _most_missing(item[answer], mass[answer], np.ones(answer.sum()), np.floor(words_ - ANSWER * words_ + 1e-9))
        missing = np.maximum(whole, np.where(number > 1, question + rest, 0.0))
        smallest = np.full(n, np.inf)
        np.minimum.at(smallest, item, mass)
        return np.maximum(1 - missing, smallest) * (1 - SLACK)

    def __getstate__(self):
        return self.__dict__ | {"sets": {}}

    def words(self, item: int) -> list[int]:
        return self.flat[self.at[item] : self.at[item + 1]].tolist()

    def _sets(self, item: int) -> tuple:
        """Words, question's shingles, answer's words and all shingles of an item; a few thousand items are remembered."""
        if item not in self.sets:
            if len(self.sets) >= REMEMBERED:
                self.sets.clear()
            w, n = self.words(item), int(self.asked[item])
            self.sets[item] = (w, shingles(w[:n]), set(w[n:]), shingles(w))
        return self.sets[item]

    def verify(self, item: int, passage: list[int]) -> tuple[float, float, bool]:
        """Shares of the question's shingles and of the answer's words that the passage holds, and whether they are enough."""
        w, question, answer, whole = self._sets(item)
        has, got = shingles(passage), set(passage)
        q = len(question & has) / len(question) if question else 1.0
        a = len(answer & got) / len(answer) if answer else 1.0
        enough = len(whole & has) / len(whole) >= OVERLAP or (q >= OVERLAP and a >= ANSWER and len(question) > 1) or in_order(w, passage)
        return q, a, enough or (a >= ANSWER and len(question) > 1 and in_order(w[: self.asked[item]], passage))

    def search(self, texts: list[str]) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(text, item) -> score, question overlap, answer overlap of the best verified passage."""
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        at = 0
        while at < len(texts):
            lengths, ids, total, first = [], [], 0, at
            while at < len(texts) and (not lengths or total < AT_A_TIME):
                w = words(texts[at])
                ids.append(np.fromiter(map(self.terms.get, w, repeat(-1)), np.int64, len(w)))
                lengths.append(len(w))
                total += len(w)
                at += 1
            self._search(first, np.array(lengths, np.int64), np.concatenate(ids), best)
        return best

    def _search(self, first: int, lengths: np.ndarray, ids: np.ndarray, best: dict) -> None:
        begin = np.cumsum(lengths) - lengths
        place = np.arange(len(ids)) - np.repeat(begin, lengths)
        known = np.nonzero(ids >= 0)[0]
        for c in self.classes:
            halves = -(-lengths // c.reach)
            start = np.cumsum(halves) - halves
            doc = np.repeat(np.arange(len(lengths)), halves)
            pairs = np.append(doc[1:] == doc[:-1], False) if len(doc) else np.empty(0, bool)
            key = _distinct((np.repeat(start, lengths)[known] + place[known] // c.reach) * len(self.terms) + ids[known])
            half, term = key // max(1, len(self.terms)), key % max(1, len(self.terms))
            step = max(2, CELLS // c.n_stretches)
            for a in range(0, len(doc), step):
                b = min(len(doc), a + step)
                own = slice(int(np.searchsorted(half, a)), int(np.searchsorted(half, b + 1)))
                many = pairs[a : b + 1].copy()
                many[-1] &= b + 1 < len(doc) or len(many) <= b - a
                for p, item, score in zip(*(x.tolist() for x in c.retrieve(half[own] - a, term[own], many)), strict=True):
                    p += a
                    if p >= b:
                        continue
                    d = int(doc[p])
                    lo = int(begin[d]) + (p - int(start[d])) * c.reach
                    q, share, enough = self.verify(c.first + item, ids[lo : min(lo + 2 * c.reach, int(begin[d] + lengths[d]))].tolist())
                    if enough:
                        k = (first + d, c.first + item)
                        best[k] = max(best.get(k, (0.0, 0.0, 0.0)), (score * float(self.least[c.first + item]), q, share))


def _matches(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in slices(batches):
            found = index.search([t or "" for t in batch.column("_text").to_pylist()])
            rows = pa.array([d for d, _ in found], pa.int64())
            cols = [batch.column(c).take(rows) for c in columns]
            cols += [pa.array([index.ids[i] for _, i in found], pa.int64()), pa.array([index.more[i][1] for _, i in found], pa.string())]
            cols += [pa.array([x[k] for x in found.values()], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(cols, names=[*columns, "item_id", "_same", "bm25", "question_overlap", "answer_overlap"])

    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, items, length) for each word of each item, with the item's length once, beside a null word."""
    for batch in slices(batches):
        word, length = [], []
        for text in batch.column("_item").to_pylist():
            q, a = split_item(text)
            if q or a:
                own = [None, *dict.fromkeys(chain(q, a))]
                word += own
                length += [len(q) + len(a), *([0] * (len(own) - 1))]
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(length, pa.int64())], names=["word", "length"])


def _indexes(items: DataFrame, index_chars: int) -> Iterator[Index]:
    """Indexes of bounded size over all different items, each item with how many rows have it and a key of its text.

    Their summed size is asked first, and only so many are collected at a time. Where they make more than one index, words are counted over
    all of them first, and each index is given the counts of its own words."""
    i = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("_item")).where("_item is not null")
    i = i.groupBy("_item").agg(F.min("item_id").alias("item_id"), F.count("*").alias("copies"))
    total = i.agg(F.coalesce(F.sum(F.length("_item")), F.lit(0))).first()[0]
    n = max(1, -(-total // index_chars))
    rows = i.select("item_id", "_item", "copies", F.sha2("_item", 256).alias("key"))
    if n == 1:
        yield Index([tuple(r) for r in rows.collect()])
        return
    dealt = F.pmod(F.xxhash64("_item"), F.lit(n))
    counted = cut(i.select("_item").mapInArrow(_item_words, "word string, length long").groupBy("word").agg(F.count("*").alias("items"), F.sum("length").alias("length")))
    every = counted.where("word is null").first()
    for k in range(n):
        own = rows.where(dealt == k)
        if every is None:
            return
        its = own.select("_item").mapInArrow(_item_words, "word string, length long").where("word is not null").select("word").distinct()
        df = dict(tuple(r) for r in counted.select("word", "items").join(its, "word").collect())
        yield Index([tuple(r) for r in own.collect()], (every["items"], every["length"] / every["items"], df))


def _counted(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in slices(batches):
            n: Counter = Counter()
            for d, i in index.search([t or "" for t in batch.column("text").to_pylist()]):
                n[d] += index.more[i][0]
            more = pa.array([n[k] + old for k, old in enumerate(batch.column("n_items").to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), more], names=[*columns, "n_items"])

    return run


def with_item_counts(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id", "text"), index_chars: int = INDEX_CHARS) -> DataFrame:
    """Every row of ``docs`` with its ``keep`` columns (``text`` among them) and n_items, how many benchmark items it holds. The
    matches are those of ``contaminated``; rows only pass through, so a filter on n_items needs no join. Where items make more than
    one index, each is run over what the one before has written, so that a worker holds one index at a time."""
    out = docs.select(*keep, F.lit(0).cast("long").alias("n_items"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in out.dtypes)
    for n, index in enumerate(_indexes(items, index_chars)):
        out = (cut(out) if n else out).mapInArrow(_counted(docs.sparkSession.sparkContext.broadcast(index), list(keep)), kinds)
    return out


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), index_chars: int = INDEX_CHARS) -> DataFrame:
    """One row per document row and benchmark item that it holds: ``keep`` columns, item_id, bm25 (share of the item's own
    score), question_overlap, answer_overlap.

    For items of each class of length, a document is cut into passages of twice the longest of them (and a quarter more, for
    insertions), each overlapping the next by half, so that an item lies whole in one of them. A passage is verified against each item
    of which it has the least score that any passage can have that is accepted, so the index loses none. Items are collected for an index only up to ``index_chars``
    characters (their size is summed first, equal texts once); beyond that they are dealt out over several indexes by hash of
    their text, with counts of words over all of them, and each index is run over all passages, one after the other. Nothing
    else leaves the executors and no document is shuffled.

    Null and empty texts and items match nothing; items without words are left out; a null item_id is kept as null.
    Repeated documents give repeated rows, repeated items give a row each. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    d = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in d.drop("_text").dtypes)
    found: list[tuple[DataFrame, bool]] = []
    held = None
    for index in _indexes(items, index_chars):
        if held is not None:  # write what an index found before the next one is held
            found[-1] = (cut(found[-1][0]), found[-1][1])
            held.destroy()
        held = spark.sparkContext.broadcast(index)
        part = d.mapInArrow(_matches(held, list(keep)), f"{kinds}, item_id long, _same string, bm25 double, question_overlap double, answer_overlap double")
        found.append((part, any(m[0] > 1 for m in index.more)))
    out = None
    if any(repeated for _, repeated in found):
        again = items.where("text is not null").select(F.sha2("text", 256).alias("_same"), F.col("item_id").cast("long").alias("item_id"))
    for part, repeated in found:
        part = part.drop("item_id").join(again, "_same").select(*part.columns) if repeated else part
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"{kinds}, item_id long, _same string, bm25 double, question_overlap double, answer_overlap double")
    return out.drop("_same")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
