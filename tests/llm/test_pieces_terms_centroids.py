"""Operators 11 to 13 against the library, plain loops and whole rounds without bounds."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridjobs.llm import centroids, divergence, piece_bpe

ODD = [None, "", " \t\n", "a", "é" * 30_000, "word " * 30_000, "\x00 \x1c ﻿ 𝔘𝔫𝔦", "same", "same"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, term string, row int, _text int"


def frame(spark, texts):
    return spark.createDataFrame([(n, t, "en" if n % 3 else None, None if n % 4 == 0 else "s", None, 1, "x", 2, 3) for n, t in enumerate(texts)], DOCS)


# 11


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = piece_bpe.read_ranks(piece_bpe.default_path())
    return tiktoken.Encoding("own", pat_str=piece_bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def test_pieces_equal_the_library_and_decode_back(spark, library):
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choice("aAbé'st  \n\t1.%世　ﬁ\x1c\x85ıſ<|endoftext|>") for _ in range(rng.randrange(80))) for _ in range(300)]
    texts += ["x" * 70_000, "ab1 " * 500_000, "naïve café " * 100_000]
    d = frame(spark, texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in piece_bpe.encode_pieces(d).collect()}
    assert len(got) == len(texts)
    for n, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[n] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = piece_bpe.decoded(piece_bpe.encode_pieces(d, keep_ids=True)).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {n: t or "" for n, t in enumerate(texts)}
    assert piece_bpe.encode_pieces(d.limit(0)).count() == 0


def test_every_token_is_a_piece_that_decodes_to_itself(library):
    c = piece_bpe.codec(piece_bpe.default_path(), piece_bpe.default_pattern())
    assert c.model.get_piece_size() == len(c.ranks) + 1
    assert all(c.bytes_of[n] == t and c.model.get_score(n) == -n for t, n in c.ranks.items())
    kinds = [chr(k) for k in (*range(0x20, 0x600), *range(0x1680, 0x16F0), *range(0x2000, 0x2070), *range(0x3000, 0x3040), *range(0xFE00, 0xFF20), *range(0x1D400, 0x1D420))]
    texts = [f"a{c}b {c}1{c}{c} .{c}  {c}" for c in kinds]
    for t, ids in zip(texts, c.encode(texts), strict=True):
        assert np.frombuffer(b"".join(ids), "<u4").tolist() == library.encode_ordinary(t)


def test_batches_and_what_is_remembered_change_nothing(library, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc é1.") * rng.randrange(1, 90) for _ in range(rng.randrange(20))) for _ in range(60)]
    monkeypatch.setattr(piece_bpe, "REMEMBERED", 5)
    monkeypatch.setattr(piece_bpe, "TOGETHER", 300)
    monkeypatch.setattr(piece_bpe, "AT_A_TIME", 7)
    c = piece_bpe.Codec(piece_bpe.default_path(), piece_bpe.default_pattern())
    got = [np.frombuffer(b"".join(ids), "<u4").tolist() for ids in c.encode(texts)]
    assert got == [library.encode_ordinary(t) for t in texts]


def test_models_need_all_bytes_and_stand_gaps_in_ranks():
    with pytest.raises(ValueError):
        piece_bpe.serialized_model({b"a": 0})
    import sentencepiece

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 299, b"abc": 310}
    m = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe.serialized_model(ranks))
    assert m.encode("abcab", out_type=int) == [310, 300]


# 12


def plain_divergence(rows, least, top):
    """The definition in loops over every term and group."""
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = sorted(w for w, n in df.items() if n >= least)
        counts = defaultdict(Counter)
        for _, s, ws in own:
            counts[s].update(w for w in ws if df[w] >= least)
        share = lambda n: {w: 1 + 10**9 * (n[w] + 5) // (sum(n.values()) + 5 * len(kept)) for w in kept}
        p, q = {s: share(n) for s, n in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = {r: sum(abs(p[s][w] - p[r][w]) for w in kept) for r in counts if r != s}
            terms = {w: p[s][w] - q[w] for w in kept if counts[s][w] and p[s][w] > q[w]}
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                best = sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(best)}
    return out


def made_up(seed, n):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "aBcÉ世" for b in "xyzÄ"] + ["É", "i̇x"]
    rows = []
    for _ in range(n):
        source = rng.choice([None, "", "s1", "s2", "ß", "z", "only"])
        some = rng.sample(words, rng.randrange(1, 9)) if source != "only" else ["rare"]
        rows.append((rng.choice([None, "en", "en", "de"]), source, rng.choice([None, ""]) if rng.random() < 0.1 else "9".join(rng.choices(some, k=rng.randrange(1, 30)))))
    return rows


@pytest.mark.parametrize("least", [1, 4, 1000])
def test_divergence_equals_the_definition(spark, least):
    rows = made_up(least, 150) + [("en", "s1", "Q" * 50_000 + " q" * 50_000), ("xx", "alone", "a a b")]
    d = spark.createDataFrame([(t, lang, s, n, n, 1) for n, (lang, s, t) in enumerate(rows)], "text string, lang string, source string, doc_id long, term long, n int")
    got = divergence.divergence(d, least, 3).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == plain_divergence(rows, least, 3)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_counts_passed_on_early_sum_to_the_same(spark, monkeypatch):
    rows = made_up(7, 80)
    d = spark.createDataFrame(rows, "lang string, source string, text string")
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"lang": a or "", "source": b or "", "text": c or ""} for a, b, c in rows])
    total = Counter()
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "AT_A_TIME", 10)
    for b in divergence._terms(iter([batch])):
        for r in b.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["n"]
    monkeypatch.undo()
    assert dict(total) == {(r["lang"], r["source"], r["term"]): r["n"] for r in divergence.term_counts(d).collect()}


def test_shared_paths_are_set_against_ancestors_once():
    rng = random.Random(3)
    sources = "abcde"
    none = {s: rng.randrange(5) for s in sources}
    rows = Counter(tuple((s, none[s] + rng.randrange(1, 3), none[s]) for s in sources if rng.random() < 0.8) for _ in range(2_000))
    tree = divergence.Tree()
    for row in sorted(rows):
        if row:
            tree.insert(*(np.array(c, np.int64) for c in zip(*((sources.index(s), p, p0) for s, p, p0 in row), strict=True)), rows[row])
    tree.leave(0)
    want = Counter()
    for row, n in rows.items():
        for k, (s, p, p0) in enumerate(row):
            for r, q, q0 in row[:k]:
                want[s, r] += n * (abs(p - q) - abs(p - q0) - abs(p0 - q) + abs(p0 - q0))
    assert {(sources[a], sources[b]): v for a, b, v in zip(*tree.told(), strict=True)} == {k: v for k, v in want.items() if v}
    nodes = {row[:k] for row in rows for k in range(1, len(row) + 1)}
    assert tree.combinations == sum(len(n) - 1 for n in nodes) < sum(len(r) * (len(r) - 1) // 2 for r in rows)


# 13


def plain_clusters(rows, k, rounds):
    """Every vector against every centroid in every round."""
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    c = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    dist = lambda v, y: sum((a - b) ** 2 for a, b in zip(v, y, strict=True))
    for r in range(rounds + 1):
        at = [min((dist(v, y), n) for n, y in enumerate(c)) for _, v in kept]
        if r < rounds:
            for n in range(len(c)):
                own = [v for (_, v), a in zip(kept, at, strict=True) if a[1] == n]
                c[n] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else c[n]
    total = sum(d for d, _ in at)
    return sorted((-1 if i is None else i, n, d, sum(x for x, m in at if m == n), total, hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, at, strict=True))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, cluster int, ids string").repartition(3)


@pytest.mark.parametrize("seed,n,rounds", [(0, 400, 3), (1, 9, 3), (2, 300, 5), (3, 60, 0)])
def test_clusters_equal_rounds_without_bounds(spark, monkeypatch, seed, n, rounds):
    monkeypatch.setattr(centroids, "TILE", 64)
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.4, (5, 64))
    rows = [(k, [float(x) for x in (np.round(middle[k % 5] + rng.normal(0, 0.2, 64), 1 if k % 3 else 5))]) for k in range(n)]
    rows += [(k, rows[0][1]) for k in range(n, n + 20)] + [(3, rows[3][1])] * 5
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, [None] + [0.0] * 63), (None, rows[1][1])]
    got = centroids.cluster_vectors(vectors(spark, rows), rounds=rounds).fillna({"vec_id": -1}).collect()
    assert sorted(map(tuple, got)) == plain_clusters(rows, 16, rounds)


def test_vectors_with_gaps_left_are_not_scanned(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in np.eye(64)[k % 16] * 2 + rng.normal(0, 0.05, 64)]) for k in range(1_600)]
    trace = []
    got = centroids.cluster_vectors(vectors(spark, rows), rounds=8, trace=trace).collect()
    assert sorted(map(tuple, got)) == plain_clusters(rows, 16, 8)
    assert trace[0] == 1_600 and trace[-1] < 160
    with pytest.raises(Exception, match="134217728"):
        centroids.cluster_vectors(vectors(spark, [(1, [1e9] * 64)])).collect()


def test_few_or_no_vectors(spark):
    none = vectors(spark, [(1, None), (2, [1.0])])
    assert centroids.cluster_vectors(none).count() == 0 and centroids.cluster_vectors(none.limit(0)).count() == 0
    same = centroids.cluster_vectors(vectors(spark, [(7, [0.5] * 64)] * 40)).collect()
    assert {tuple(r)[:5] for r in same} == {(7, 0, 0, 0, 0)} and len(same) == 40


def test_bounds_hold_at_all_magnitudes():
    rng = np.random.default_rng(8)
    for size in (3, 1_000, 1 << 21, (1 << 27) - 1):
        x = rng.integers(-size, size, (500, 8))
        c = x[:6].copy()
        t, drift = centroids.Tile(x), np.zeros(6)
        for _ in range(6):
            t.assign(c, drift)
            full = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, y, strict=True)) for y in c] for v in x], object)
            assert t.cluster.tolist() == [min(range(6), key=lambda k: (r[k], k)) for r in full]
            assert sum(map(len, t.heaps)) == 500
            new = np.array([x[t.cluster == k].sum(0) // max(1, (t.cluster == k).sum()) for k in range(6)])
            moves = np.sqrt(((new - c) ** 2).sum(1).astype(float))
            drift = drift + moves + np.array([np.delete(moves, k).max() for k in range(6)])
            c = new
