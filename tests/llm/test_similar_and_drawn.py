"""Importance resampling, vector codes and the n-gram Jaccard join against plain Python, and their rules for odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from test_llm import ODD, odd, table  # noqa: F401

# Importance resampling.


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    return words, [zlib.crc32(" ".join(words[k : k + n]).encode()) % 10_000 for n in (1, 2) for k in range(len(words) - n + 1)]


def drawn(docs, bench, least=20, share=25):
    s, t = (Counter(b for _, text in rows for b in grams(text)[1]) for rows in (docs, bench))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
    out = []
    for i, text in docs:
        words, own = grams(text)
        weight = math.floor(sum(gain[b] for b in own) / len(own)) if own else 0
        h = None if i is None else int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, None, len(words)])
    able = sorted((r for r in out if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resampling(spark, odd):  # noqa: F811
    from leadweave.llm.resampling import resample

    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "Éclair", "x9", "漢字", "gamma", "delta", "o", "I", "zeta-eta"]
    text = lambda n, part: " ".join(rng.choice(vocabulary[:part]) for _ in range(n))
    docs = [(k, text(rng.randint(0, 60), 4 + k % 7)) for k in range(300)] + [(1000 + k, "same text for all of them " * 6) for k in range(150)] + list(enumerate(ODD, 2000)) + [(None, text(30, 5)), (3000, "Long " * 40_000)]
    bench = [(k, text(40, 4)) for k in range(9)] + [(None, None), (9, "")]
    target = spark.createDataFrame(bench, "item_id bigint, text string")
    got = resample(table(spark, docs).repartition(5), target)
    assert sorted(map(tuple, got.collect()), key=str) == drawn(docs, bench)
    assert sum(r[4] is not None for r in drawn(docs, bench)) > 80
    none = resample(odd.where("false"), target)
    assert none.columns == ["doc_id", "n_features", "weight", "score", "rank"] and none.isEmpty()
    clash = odd.withColumnRenamed("doc_id", "Rank")
    assert resample(clash, target.where("false"), "Rank").columns == ["Rank", "n_features", "weight", "score", "rank_"]


def test_repeated_rows_are_documents_of_their_own(spark):
    from leadweave.llm.resampling import features, resample

    docs = table(spark, [(1, "a b c"), (1, "a b c"), (1, "a b"), (None, "a b c"), (None, "a b c")])
    rows = features(docs.repartition(2), "doc_id", "text").collect()
    ab = zlib.crc32(b"a b") % 10_000
    assert len(rows) == 14 and sum(r.f2 == ab for r in rows) == 5 and sum(r.f2 is None for r in rows) == 5
    bench = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    got = Counter((r.doc_id, r.n_features, r["rank"]) for r in resample(docs, bench, least_words=1, share=50).collect())
    assert got[None, 5, None] == 2 and sum(n for (i, _, _), n in got.items() if i == 1) == 3 and sum(n for (_, _, r), n in got.items() if r == 1) == 1


# Vector codes.


def coded(rows, entries, rounds=4, parts=4):
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) and abs(x) < 32768 for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(order[0][2])]
    order = [r for r in order if len(r[2]) == len(order[0][2])]
    w = len(order[0][2]) // parts
    cut = lambda v, p: tuple(v[p * w : p * w + w])
    books = [[cut(r[2], p) for r in order[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for r in kept:
                own[near(cut(r[2], p), book)[1]].append(cut(r[2], p))
            books[p] = [tuple(sum(c) // len(c) for c in zip(*xs, strict=True)) if xs else e for e, xs in zip(book, own, strict=True)]
    out = []
    for i, label, v in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, [k for _, k in found], sum(d for d, _ in found)))
    return sorted(out, key=str), books


def test_vector_codes(spark):
    from leadweave.llm import vectors

    rng = np.random.default_rng(5)
    vector = lambda: [float(np.float32(x)) for x in rng.normal(size=8).round(1)]
    rows = [(k, vector(), int(k % 3)) for k in range(60)] + [(100 + k, [0.5] * 8, None) for k in range(70)] + [(k, vector(), 1) for k in (3, 3, 7)] + [(200, [0.25] * 4 + [0.75] * 4, 2)] * 2
    rows += [(300, None, 1), (301, [], 1), (302, [float("nan")] + [0.0] * 7, 1), (303, [float("inf")] * 8, 1), (304, [None] + [1.0] * 7, 2), (305, [1.0] * 7, 2), (306, [1.0] * 12, 2), (307, [40_000.0] * 8, 1), (308, [32_000.0, -32_000.0] * 4, 9), (None, vector(), None), (None, [-0.0001] * 8, 4)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, code string, part int").repartition(4)
    expected, books = coded(rows, 9)
    found, entries = vectors.compress(df, entries=9)
    assert entries.tolist() == [[list(c) for c in b] for b in books]
    assert sorted(((r.id, r.label, r.codes, r.error) for r in found.collect()), key=str) == expected
    got = vectors.digests(df).collect()
    expected, books = coded(rows, 256)
    by_label = Counter()
    for _, label, _, error in expected:
        by_label[label] += error
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, "".join(f"{k:02x}" for k in codes), error, by_label[label], sha) for i, label, codes, error in expected), key=str)


def test_vectors_that_no_row_keeps(spark):
    from leadweave.llm import vectors

    for rows in ([], [(1, None, 2)]):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
        assert vectors.digests(df).isEmpty() and vectors.digests(df).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_nearest_entry_is_exact_for_large_numbers():
    from leadweave.llm.vectors import nearest

    rng = np.random.default_rng(6)
    for size in (1 << 10, 1 << 25):
        x, book = rng.integers(-size, size, (50, 16)), rng.integers(-size, size, (9, 16))
        d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in book] for r in x]
        code, error = nearest(x, np.vstack([book, book]))
        assert code.tolist() == [r.index(min(r)) for r in d] and error.tolist() == [min(r) for r in d]


# The Jaccard join.


def components(rows):
    sets = [frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").encode().lower().decode().split()) else frozenset() for _, t in rows]
    groups = brute.Groups()
    for a in range(len(rows)):
        groups.find(a)
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                groups.link(a, b)
    low = {}
    for a, (i, _) in enumerate(rows):
        r = groups.find(a)
        low[r] = i if low.get(r) is None else low[r] if i is None else min(low[r], i)
    return sorted(((i, len(sets[a]), low[groups.find(a)]) for a, (i, _) in enumerate(rows)), key=str)


def near_copies(seed, groups, copies, sizes=(4, 9, 14, 30, 60, 140, 400)):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(12)]
    out = []
    for g in range(groups):
        base = [word() for _ in range(sizes[g % len(sizes)])]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(own) // 25)):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join([*own, *passage] if rng.random() < 0.2 else own))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("rare", "size", "hot"), [(16, 16, 50), (1, 4, 10**9), (2, 8, 4)])
def test_jaccard_groups(spark, monkeypatch, rare, size, hot):
    from leadweave.llm import jaccard

    entries = jaccard.entries
    monkeypatch.setattr(jaccard, "entries", lambda *a: entries(*a, rare, size))
    monkeypatch.setattr(jaccard, "HOT", hot)
    texts = near_copies(rare, 14, 24)
    rows = list(enumerate(texts)) + [(1000 + k, t) for k, t in enumerate(ODD)] + [(2000 + k, "One and the Same text, copied often") for k in range(40)] + [(3000, "a a a a a a a"), (3001, "a a a a a a a a a"), (5, texts[5]), (None, texts[6].upper()), (None, "alone here")]
    got = sorted((tuple(r) for r in jaccard.similar_documents(table(spark, rows).repartition(5)).collect()), key=str)
    assert got == components(rows)


def test_jaccard_of_crowded_entries(spark):
    """Many variants of one text, of which some are similar to each other only, and some to none."""
    from leadweave.llm import jaccard

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(90)]
    texts = []
    for k in range(160):
        own = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 5))):
            own[rng.randrange(90)] = word()
        texts.append(" ".join(own))
        if k % 4 == 0:
            own[rng.randrange(90)] = word()
            texts.append(" ".join(own))
    rows = list(enumerate(texts))
    expected = components(rows)
    assert sorted((tuple(r) for r in jaccard.similar_documents(table(spark, rows)).collect()), key=str) == expected and len({c for _, _, c in expected}) > 10


def test_similar_sets_share_an_entry():
    from leadweave.llm.jaccard import entries

    rng = random.Random(4)
    for trial in range(400):
        n = rng.randint(4, 120)
        df = {t: rng.choice((2, 5, 17, 900)) for t in range(3 * n + 60)}
        a = set(rng.sample(range(n + 20), n))
        b = set(a)
        for _ in range(rng.randint(0, 1 + n // 8)):
            if rng.random() < 0.5 and len(b) > 4:
                b.discard(rng.choice(sorted(b)))
            else:
                b.add(rng.randrange(n + 20, 3 * n + 60))
        a, b = sorted((a, b), key=len)
        if 100 * len(a & b) < 80 * len(a | b):
            continue
        order = lambda s, df=df: sorted(s, key=lambda t: (df[t], t))
        level, fewer, most = len(a).bit_length() - 1, len(a) - -(-160 * len(a) // 180), len(b) - -(-80 * len(b) // 100)
        x, y = ({k for _, k in entries(order(s), [df[t] for t in order(s)], level, need, 16, 16)} for s, need in ((a, fewer + 1), (b, most + 1)))
        assert x & y, trial


def test_hot_tokens_are_found_by_counters(monkeypatch):
    from leadweave.llm import jaccard

    monkeypatch.setattr(jaccard, "COUNTERS", 50)
    rng = np.random.default_rng(1)
    found = jaccard.Frequent()
    for _ in range(400):
        found.add(np.unique(np.r_[np.arange(3, dtype=np.uint64), rng.integers(100, 1 << 40, 20, dtype=np.uint64)]))
        found.fold()
    assert len(found.token) <= 50 and {0, 1, 2} <= set(found.token.tolist())
    assert all(400 - 400 * 23 / 50 <= found.count[found.token == t][0] <= 400 for t in range(3))


def test_jaccard_odd_tables(spark, odd):  # noqa: F811
    from leadweave.llm.jaccard import similar_documents

    none = similar_documents(odd.where("false"))
    assert none.columns == ["doc_id", "n_shingles", "component_id"] and none.isEmpty()
    assert similar_documents(odd.withColumnRenamed("doc_id", "N_Shingles"), "N_Shingles").columns == ["N_Shingles", "n_shingles_", "component_id"]
    long = [(1, "w%d " * 30_000 % tuple(range(30_000))), (2, "w%d " * 30_500 % tuple(range(30_500))), (3, "x " * 90_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents(table(spark, long)).collect()}
    assert got == {1: (29_996, 1), 2: (30_496, 1), 3: (1, 3)}
    text = spark.createDataFrame([("b", "one two"), ("a", "ONE  two"), ("c", None)], "doc_id string, text string")
    assert sorted(map(tuple, similar_documents(text).collect())) == [("a", 1, "a"), ("b", 1, "a"), ("c", 0, "c")]
