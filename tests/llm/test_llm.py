"""Operators of the document tables against brute force, and their rules for odd rows."""

from __future__ import annotations

import hashlib
import random
import sys
from pathlib import Path

import brute
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, th string, fp string, runs string, _k string"
ODD = [None, "", " \n\t ", "one", "One two", "a b c d e f g", "a b c d e f g", "¡é 漢字 😀!", "x " * 3000, "mail me at jo@ex.com or +1 (614) 555-8001 now"]


def table(spark, rows):
    """Documents with columns whose names the operators use inside, some of them null."""
    return spark.createDataFrame([(i, t, None if k % 3 else "en", f"s{k % 2}", None, "x", None, "y", "z") for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    return table(spark, [*enumerate(ODD), (None, "one two three"), (3, "one")]).repartition(3).cache()


def variants(seed, n, words=40, changes=2):
    rng = random.Random(seed)
    make = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [[make() for _ in range(words)] for _ in range(4)]
    out = []
    for k in range(n):
        own = list(base[k % 4])
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(words)] = make()
        out.append(" ".join(own))
    return out


def test_simhash_components(spark):
    from leadweave.llm.simhash import near_duplicates

    rows = list(enumerate(variants(1, 60) + [None, "", "word", "word"]))
    got = sorted(tuple(r) for r in near_duplicates(table(spark, rows), shard=8).collect())
    assert got == sorted(brute.near_duplicates(rows))


def test_vantage_point_search_is_exact():
    from leadweave.llm.simhash import Tree, shard_forest

    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[rng.integers(0, 300, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64))
    points = np.unique(np.r_[base, near])
    a, b = shard_forest(points, points, 3)
    groups, expected = brute.Groups(), brute.Groups()
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        groups.link(x, y)
    for p in points:
        for q in points[np.bitwise_count(points ^ p) <= 3]:
            expected.link(int(p), int(q))
    assert [groups.find(int(p)) for p in points] == [expected.find(int(p)) for p in points]
    upper = Tree(points[:200], leaves=8)
    home = {int(q): leaf for leaf, own in upper.reach(points, 0) for q in points[own]}
    asked = {(int(q), leaf) for leaf, own in upper.reach(points, 3) for q in points[own]}
    assert len(home) == len(points)
    assert all((int(p), home[int(q)]) in asked for p in points for q in points[np.bitwise_count(points ^ p) <= 3])


def test_keep_first(spark, odd):
    from leadweave.llm.simhash import keep_first

    kept = keep_first(odd)
    assert kept.columns == odd.columns and kept.groupBy("doc_id").count().where("count > 1").isEmpty()
    assert {r.doc_id for r in kept.collect()} == {None, 0, 3, 4, 5, 7, 8, 9}


def test_keep_first_finds_near_copies(spark):
    from leadweave.llm import simhash

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [[word() for _ in range(n)] for n in (4, 9, 30, 80, 300, 3000)]
    rows = []
    for k in range(240):
        own = list(base[k % 6])
        for _ in range(rng.randint(0, 1 + len(own) // 25)):
            own[rng.randrange(len(own))] = word()
        rows.append((k, " ".join(own).title() if k % 5 == 0 else " ".join(own)))
    kept = {r.doc_id for r in simhash.keep_first(table(spark, rows)).collect()}
    assert kept == brute.first_copies(rows) and len(kept) < len({i for i, _, c in brute.near_duplicates(rows) if i == c})
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5).astype(np.uint64)) for _, t in rows]
    keys = [set(simhash.bands(simhash.minhash(u)).tolist()) for u in sets]
    pairs = [(a, b) for a in range(240) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    assert len(pairs) > 500 and sum(not keys[a].isdisjoint(keys[b]) for a, b in pairs) >= 0.99 * len(pairs)


def test_components_of_a_path_and_a_star(spark):
    from leadweave.llm.components import components

    edges = [(k, k + 1) for k in range(50)] + [(1000, 1000 + k) for k in range(1, 40)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len(got) == 91 and len({got[k] for k in range(51)}) == 1 and len({got[k] for k in range(1000, 1040)}) == 1 and len(set(got.values())) == 2


def test_line_dedup(spark, odd):
    from leadweave.llm.lines import dedup

    lines = variants(2, 60, words=24, changes=1) + variants(3, 30, words=12, changes=1) + ["Short line.", "short LINE", "short lime", "la ja", "***", "", "long " * 300 + "end", "long " * 299 + "end", "Contact us todax", "contact us today"]
    random.Random(5).shuffle(lines)
    rows = [(k, "\n".join(lines[k * 4 : k * 4 + 4])) for k in range(len(lines) // 4 + 1)] + [(900, None), (901, ""), (902, "Short line.")]
    got = sorted((r.doc_id, r.text, r._n_removed) for r in dedup(table(spark, rows)).collect())
    assert got == sorted(brute.line_dedup(rows))
    clash = dedup(odd.withColumn("_n_removed", F.lit("own")))
    assert clash.columns == [*odd.columns, "_n_removed", "_n_removed_"] and clash.where("_n_removed = 'own'").count() == 12
    assert dedup(odd.where("false")).count() == 0
    by_text = {(r.doc_id, r.text) for r in dedup(odd).collect()}
    assert {(0, None), (1, ""), (2, " \n\t "), (5, "a b c d e f g"), (6, "")} <= by_text


def test_line_dedup_finds_similar_lines_of_any_length(spark):
    """Recall against all pairs, by edit similarity alone, on the documents' own lines."""
    from leadweave.llm.common import cut
    from leadweave.llm.lines import groups, occurrences

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = cut(occurrences(docs))
    _, root = groups(docs, found, "doc_id", "text")
    norms = sorted({" ".join(brute.PLAIN.findall(x.lower())) for r in docs.collect() for x in (r.text or "").split("\n")} - {""})
    norms = [x for x in norms if len(x) <= 150]
    pairs = brute.similar(norms)
    h = {r.n: r.h for r in spark.createDataFrame([(x,) for x in norms], "n string").select("n", F.xxhash64("n").alias("h")).collect()}
    of = {r.h: r.r for r in root.select(F.col("node.h1").alias("h"), F.col("root.h1").alias("r")).collect()}
    hit = sum(of.get(h[norms[a]], a) == of.get(h[norms[b]], -1 - b) for a, b in pairs)
    assert len(pairs) > 20 and hit / len(pairs) >= 0.9


def test_line_fingerprint_is_the_majority_of_the_sample(spark):
    from leadweave.llm.lines import BLOCKS, SAMPLE, occurrences

    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(n)) for n in (5, 9, 12, 1000, 40_000)]
    got = occurrences(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    mask = (1 << 64) - 1
    for t, r in zip(texts, got, strict=True):
        w = [xxhash.xxh64_intdigest(x.encode(), 42) for x in t.split()]
        width = 3 if len(w) >= 10 else 2
        runs = {brute.signed((w[k] ^ (w[k + 1] << 1 & mask) ^ ((w[k + 2] << 2 & mask) if width == 3 else 0)) & mask) for k in range(len(w) - width + 1)}
        sample = sorted(runs)[:SAMPLE]
        assert r.fp == brute.signed(brute.simhash([x & mask for x in sample]))
        assert [r[f"k{k}"] for k in range(BLOCKS)] == [sample[k] if k < len(sample) else None for k in range(BLOCKS)]


def test_line_dedup_of_crowded_buckets(spark, monkeypatch):
    """Lines that share a passage and little else meet theirs by pairs of blocks, and frequent blocks are dealt out apart."""
    from leadweave.llm import lines as module

    monkeypatch.setattr(module, "HOT", 1)
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    passage, lines = [word() for _ in range(8)], []
    for _ in range(30):
        own = [*passage, *(word() for _ in range(16))]
        lines += [" ".join(own), " ".join([*own[:-1], word()])]
    rng.shuffle(lines)
    rows = list(enumerate(lines))
    got = sorted((r.doc_id, r.text, r._n_removed) for r in module.dedup(table(spark, rows)).collect())
    assert got == sorted(brute.line_dedup(rows)) and sum(r[2] for r in got) == 30


def test_substring_dedup(spark, odd):
    from leadweave.llm.repeats import remove_repeats

    rng = random.Random(7)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(40))
    shared = [[word() for _ in range(n)] for n in (12, 13, 14, 60)]
    rows = []
    for k in range(120):
        own = [word() for _ in range(rng.randint(0, 60))]
        for s in rng.sample(shared, rng.randint(0, 2)):
            at = rng.randint(0, len(own))
            own[at:at] = s
        rows.append((k, " ".join(own)))
    rows += [(200, "w " * 40), (201, "w " * 30), (202, None), (203, ""), (204, rows[5][1]), (204, rows[5][1])]
    got = sorted(tuple(r) for r in remove_repeats(table(spark, rows), digest=True).collect())
    assert got == sorted(brute.remove_repeats(rows))
    assert remove_repeats(odd).count() == 12 and remove_repeats(odd.where("false")).count() == 0


def test_decontamination(spark, odd):
    from leadweave.llm.decontamination import clean, contaminated

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 3, 5, 9, 24, 30])] + [(90, None), (91, "")]
    docs = []
    for k in range(60):
        own = [word() for _ in range(rng.randint(0, 80))]
        item = rng.choice(items[:6])[1].split()
        if k % 3 == 0:
            if len(item) > 20 and k % 2:
                item[rng.randrange(len(item))] = "changed"
            own[3:3] = item
        docs.append((k, " ".join(own).title()))
    docs += [(100, None), (101, "")]
    shingles = lambda t, n: {tuple(w[k : k + n]) for w in [brute.PLAIN.findall((t or "").lower())] for k in range(len(w) - n + 1)}
    expected = set()
    for i, t in docs:
        for j, item in items:
            n = min(5, len(brute.PLAIN.findall((item or "").lower())))
            q = shingles(item, n) if n else set()
            if q and len(q & shingles(t, n)) >= 0.8 * len(q) - 1e-9:
                expected.add((i, j, len(q & shingles(t, n)) / len(q)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = contaminated(table(spark, docs), bench)
    assert {(r.doc_id, r.item_id, r.containment) for r in got.collect()} == expected and got.count() == len(expected)
    assert {r.doc_id for r in clean(table(spark, docs), bench).collect()} == {i for i, _ in docs} - {i for i, _, _ in expected}
    assert contaminated(odd, bench.where("false")).isEmpty() and clean(odd, bench.where("item_id > 80")).count() == 12


def test_quality(spark, odd):
    from leadweave.llm import quality

    text = "a b c d e f g h i\na b c d e f g h i\n\n#x ünï &\nlast last"
    row = quality.count(text.encode())
    # Nine words twice: all windows of eight are within the two copies.
    assert row[:5] == (23, 32, 2, 1, 18) and row[8] == 1
    assert quality.count(b"")[:5] == (0, 0, 0, 0, 0)
    rng = random.Random(9)
    clean = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 90))) for _ in range(200)]
    junk = [" ".join(w + "***" for w in t.split()) for t in clean[:20]]
    docs = table(spark, list(enumerate(clean + junk)))
    kept = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert all(kept[k] for k in range(200)) and not any(kept[k] for k in range(200, 220))
    assert {r.doc_id for r in quality.filter_documents(docs).collect()} == set(range(200))
    assert quality.judge(odd).count() == 12 and quality.judge(odd.where("false")).count() == 0


def test_quality_query_is_brute_force(spark):
    from leadweave.llm.queries import QUERIES

    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in QUERIES["op6_quality_rules"](spark, DATA).collect()]
    expected = brute.quality([(r.doc_id, r.text, r.lang, r.source) for r in docs])
    assert sorted(got) == sorted(expected) and len({r[6:] for r in got}) == 3


def test_quality_cutoffs_come_from_merged_sketches(spark):
    from leadweave.llm import quality

    rows = [("en", "big", r.name, b, 10) for r in quality.RULES for b in range(10, 20)] + [("en", "small", r.name, 90, 1) for r in quality.RULES] + [("en", "zeros", r.name, quality.ZERO, 9) for r in quality.RULES]
    limits = {r.source: r.limits for r in quality.cutoffs(spark.createDataFrame(rows, "lang string, source string, rule string, bucket int, n bigint")).collect()}
    high, low = 1.02**17, 1.02**12
    big = high + quality.FENCE * (high - low)
    assert limits["big"]["repeats"] == pytest.approx(big, rel=0.02)
    wide = limits["zeros"]["repeats"]  # no row counts: what its language has
    assert limits["small"]["repeats"] == pytest.approx((1.02**90 + quality.PRIOR * wide) / (1 + quality.PRIOR)) and limits["small"]["repeats"] != limits["big"]["repeats"]
    assert quality.SLACK < limits["zeros"]["symbols"] < limits["big"]["symbols"]


def test_repeated_words_are_held_against_the_words():
    from leadweave.llm import quality

    text = "a b c d e f g h x a b c d e f g h".split()
    words = [w.encode() for w in text]
    assert quality.repeated_words(words) == 16
    same = quality.rolling
    try:
        quality.rolling = lambda own, width: np.zeros(len(own) - width + 1, np.uint64)  # all windows share a hash
        assert quality.repeated_words(words) == 16 and quality.repeated_words([str(k).encode() for k in range(30)]) == 0
    finally:
        quality.rolling = same


def test_bpe_is_exact():
    import base64

    import public_tokenizers
    import tiktoken

    from leadweave.llm.bpe import coder

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = coder(path, public_tokenizers.PATTERN)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(10)
    for alphabet in ("aeiou thrsn", "abcXYZ  \n.,'0123456789", "éèüñ漢字😀 \t\x1c\x85\xa0ab", "".join(map(chr, range(1, 3000)))):
        for _ in range(400):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            ids = own.encode(t)
            assert ids == other.encode_ordinary(t) and own.decode(ids) == t.encode()
    long = "".join(rng.choice("aeith") for _ in range(30_000))
    assert own.encode(long) == other.encode_ordinary(long)


def test_bpe_rows(spark, odd):
    import public_tokenizers

    from leadweave.llm.bpe import digests, encode, encode_rows

    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = {r.doc_id: r for r in digests(odd, *args).collect()}
    assert rows[0].n_tokens == 0 and rows[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[7].decoded_sha256 == hashlib.sha256(ODD[7].encode()).hexdigest()
    assert encode(odd, *args).count() == 12
    out = encode_rows(odd, *args)
    assert out.columns == [*odd.columns, "ids", "n_tokens"] and out.drop("ids", "n_tokens").exceptAll(odd).isEmpty()


def test_token_files(spark, odd, tmp_path):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from leadweave.llm.token_files import round_trip

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [*ODD, "<|endoftext|> İstanbul ΣΑΣ don't", "naïve, CAFÉ! x² ½", None]
    rows = [(k * 7 % 13, t) for k, t in enumerate(texts)]
    got = round_trip(table(spark, rows).repartition(3), path, folder=str(tmp_path)).orderBy("doc_id").collect()
    start = 0
    for (i, t), r in zip(sorted(rows), got, strict=True):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert sum(p.stat().st_size for p in tmp_path.glob("*.bin")) == 2 * start
    last = round_trip(odd, path).collect()
    assert len(last) == 12 and sum(r.doc_id is None for r in last) == 1 and round_trip(odd.where("false"), path).count() == 0


def test_pii_base_spans(spark, odd):
    import re

    from leadweave.llm import pii

    texts = [
        "a@b.co c_d@e.f x@y", "jo@a.b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "4539 1488 0343 6467 and 4539-1488-0343-6468", "+1 (614) 555-8001, +12 +44 20 7946 0958 +1234567890123456",
        "é😀 mail: ann@x.org", "9" * 5000 + " a" * 3, "Call (614) 555-8001 or Dr. Anna Smith", "jo (at) ex (dot) com", "token = \"9e7c0011\"", "token = \"cb1a9fee807a05366fcb8b6c95c7c565ede51a72\"", "pay 4539148803436467 4539148803436467", "a@b.co 1.2.3.4 " * 400, *[t or "" for t in ODD],
    ]
    patterns = {k: re.compile(v) for k, v in pii.BASE.items()}

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def valid(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    found = pii.find(table(spark, list(enumerate(texts)))).withColumns({"b": pii.joined("base"), "s": pii.joined("spans")})
    for r in found.collect():
        spans = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(patterns.items()) for m in p.finditer(texts[r.doc_id]) if valid(kind, m.group()))
        assert r.b == ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        assert set(filter(None, r.b.split(","))) <= set(r.s.split(","))
    added = {r.doc_id: set(r.s.split(",")) - set(r.b.split(",")) for r in found.collect()}
    assert added[10] == {"secret:9:49"} and added[11] == {"card_run:4:20", "card_run:21:37"} and not added[9] and not added[12] and not added[5]
    assert pii.find(odd).count() == 12 and pii.find(odd.where("false")).count() == 0
    names = [n for line in pii.find(odd)._jdf.queryExecution().executedPlan().toString().split("\n") for n in ("Python", "Arrow", "Pandas") if n in line]
    assert not names


def test_pii_keys_of_any_length_and_places_behind_many_spans(spark):
    from leadweave.llm import pii

    rng = random.Random(2)
    key = lambda n: "".join(rng.choice("abcdef") + rng.choice("0123456789") for _ in range(n // 2))  # no run of digits is a card
    keys = [key(n) for n in (40, 248, 264, 480, 5000)]
    long = ".".join(["1.2.3.4"] * 40) + ".Ab3Cd5Ef7Gh9Jk1Lm3Np5Qr7@ex.com"
    texts = [f'token = "{k}"' for k in keys] + [long + " token: Ab3Cd5Ef7Gh9Jk1Lm3Np5Qr7St", "1.2.3.4 " * 60 + 'token = "' + keys[0] + '"']
    found = {r.doc_id: set(r.s.split(",")) - set(r.b.split(",")) for r in pii.find(table(spark, list(enumerate(texts)))).withColumns({"b": pii.joined("base"), "s": pii.joined("spans")}).collect()}
    assert [found[i] for i in range(5)] == [{f"secret:9:{9 + len(k)}"} for k in keys]
    assert found[5] == {f"secret:{len(long) + 8}:{len(texts[5])}"} and found[6] == {"secret:489:529"}


def test_pii_em_finds_who_is_reliable():
    from leadweave.llm import pii

    rng = random.Random(11)
    counts = {}
    for _ in range(4000):
        true = rng.random() < 0.6
        votes = tuple((1 if true else -1) if rng.random() < p else (-1 if true else 1) for p in (0.95, 0.9, 0.85, 0.8, 0.55))
        counts["number", votes] = counts.get(("number", votes), 0) + 1
    prior, reliability, posterior = pii.em(counts)
    hit = [(reliability["number", j, True, 1] + reliability["number", j, False, -1]) / 2 for j in pii.LABELERS]
    assert abs(prior["number"] - 0.6) < 0.05 and hit[0] > hit[3] > hit[4] and posterior["number", (1, 1, 1, 1, 1)] > 0.95
    model = pii.train([("number", *v, 2, True, n) for (_, v), n in sorted(counts.items())])
    assert model.weights["format:1"] > 0 > model.weights["format:-1"]


def test_language(spark, odd):
    from leadweave.llm import langid

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    found = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id")))
    assert found.where("lang = lang_pred").count() / found.count() > 0.98
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == "und" and all(0 <= r.score <= 1 for r in rows.values())
    assert langid.train(odd.where("false")) is None and langid.identify(odd, None).where("lang_pred <> 'und'").isEmpty()


def test_string_kernel_is_the_share_of_common_grams():
    from leadweave.llm import langid

    model = langid.fit([("the cat sat on the mat", "a"), ("der hund lag auf dem bett", "b"), ("the dog", "a")])
    sets = lambda t: set(np.concatenate(langid.grams(langid.codes(t, model.place))).tolist())
    text, marks = "that dog there", ["the cat sat on the mat", "the dog", "der hund lag auf dem bett"]
    expected = [len(sets(text) & sets(m)) / (len(sets(text)) * len(sets(m))) ** 0.5 for m in marks]
    assert model.kernel([text])[0].tolist() == pytest.approx(expected, rel=1e-5)


def test_classifier(spark, odd):
    from leadweave.llm import gam

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = gam.classify(docs, labels).join(labels, "doc_id").where(gam.held_out(F.col("doc_id")))
    assert found.where((F.col("score") >= 0.3).cast("int") == F.col("quality")).count() / found.count() > 0.95
    assert all(0 <= r.score <= 1 for r in gam.classify(odd, labels).collect())
    none = gam.classify(odd, labels.where("false")).collect()
    assert len(none) == 12 and all(r.score == 0.5 for r in none)


def test_gam_learns_an_interaction():
    from leadweave.llm import gam

    rng = np.random.default_rng(12)
    x = rng.random((3000, len(gam.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = gam.fit(x, y)
    assert (2, 5) in {(a, b) for a, b, _ in model.pairs} and ((model.score(x) > 0.5) == y).mean() > 0.9


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "encode"]
    out = corpus_pipeline.run(spark, DATA).collect()
    ids = [r.doc_id for r in out]
    assert 0 < len(ids) == len(set(ids)) < docs.count() and set(out[0].asDict()) == {*docs.columns, "ids", "n_tokens"}
    step, now = docs, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, step, DATA)
        assert now.columns == docs.columns and now.count() <= step.count()
        step = now
    assert brute.first_copies([(r.doc_id, r.text) for r in out]) == set(ids)


def test_decontamination_of_repeated_and_nameless_items(spark):
    from leadweave.llm.decontamination import clean, contaminated

    rng = random.Random(13)
    text = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]
    long, other, nameless = text(9), text(9), text(9)
    bench = spark.createDataFrame([(1, " ".join(long))] * 3 + [(1, " ".join(other)), (None, " ".join(nameless))], "item_id bigint, text string")
    # Each document has four of an item's five shingles, the first or the last one broken.
    docs = [(k, " ".join([*item[:-1], "end"] if k % 2 else ["start", *item[1:]])) for k, item in enumerate([long, long, other, other, nameless, nameless])]
    got = contaminated(table(spark, docs), bench).collect()
    key = lambda x: (x[0], x[1] or 0)
    assert sorted(((r.doc_id, r.item_id, r.n_found, r.q) for r in got), key=key) == [(k, 1 if k < 4 else None, 4, 5) for k in range(6)]
    assert clean(table(spark, docs), bench).isEmpty()


def test_token_files_query_matches_special_tokens(spark, tmp_path):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from leadweave.llm.queries import QUERIES

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["hello <|endoftext|> world", "a<|endoftext|>b, <|startoftext|>é", "<|ENDOFTEXT|> <|endoftext|><|endoftext|>", None]
    table(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op9_token_files"](spark, str(tmp_path)).orderBy("doc_id").collect()
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]
    assert 49407 in ids[0] and [(r.n_tokens, r.ids_crc32) for r in got] == [(len(x), zlib.crc32(x.tobytes())) for x in ids]


def test_sql_of_the_corpus_queries(spark):
    import duckdb

    from leadweave.llm.queries import ORACLE_SQL, QUERIES

    duck = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        own = duck.sql(sql)
        got = QUERIES[name](spark, DATA).select(*own.columns).collect()
        assert sorted(map(tuple, got)) == sorted(own.fetchall()) and got


def test_clashing_columns(spark, odd):
    import public_tokenizers

    from leadweave.llm import bpe, decontamination

    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    own = odd.withColumns({"ids": F.lit("x"), "N_TOKENS": F.lit(1)})
    assert bpe.encode_rows(own, *args).columns == [*own.columns, "ids_", "n_tokens_"]
    named = odd.withColumnRenamed("doc_id", "item_id")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id bigint, text string")
    found = decontamination.contaminated(named, bench, ["item_id"])
    assert found.columns == ["item_id", "item_id_", "n_found", "q", "containment"] and {r.item_id for r in found.collect()} == {5, 6}


def test_tables_of_other_scopes_stay(spark):
    from leadweave.llm.common import cut, drop, scope

    outer = cut(spark.range(3).toDF("a"))
    with scope(spark):
        inner = cut(spark.range(4).toDF("a"))
        assert inner.count() == 4
    assert outer.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        inner.agg(F.sum("a")).collect()
    drop(outer)
    drop(outer)


def test_pipeline_is_the_chain_of_plain_versions(spark, tmp_path):
    import base64

    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 7)))
    item = " ".join(word() for _ in range(12))
    shared = " ".join(word() for _ in range(14))
    rows = []
    for k in range(60):
        lines = [" ".join(word() for _ in range(12)) for _ in range(4)]
        if k % 6 == 0:
            lines[1] = shared if k % 12 else shared + " end"
        if k % 10 == 3:
            lines[2] += " " + item
        rows.append([k, "\n".join(lines), "en" if k % 2 else "de", f"s{k % 3}"])
    rows[7][1] = " ".join(w + "###" for w in rows[7][1].split())
    fresh = rows[8][1].split("\n")
    near = "\n".join(" ".join([*fresh[j].split()[:6], *fresh[j - 1].split()[6:]]) for j in range(4))
    rows += [[60, rows[5][1].replace("\n", "\n\n"), "en", "s0"], [65, near, "de", "s2"], [61, None, "en", None], [62, "", None, "s0"], [63, "too few words", "en", "s0"], [64, "x " * 3000, "en", "s1"]]
    docs = spark.createDataFrame([(i, t, a, b, len(t) if t else None, "own") for i, t, a, b in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, _k string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r[0] for r in brute.quality(rows) if r[7]}
    step = [(i, t) for i, t, _, _ in rows if i in kept]
    step = [(i, t) for i, t, _ in brute.line_dedup(step)]
    near = brute.first_copies(step)
    step = [(i, t) for i, t in step if i in near]
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [brute.PLAIN.findall(t.lower())] for k in range(len(w) - 4)}
    step = [(i, t) for i, t in step if len(shingles(t) & shingles(item)) < 0.8 * len(shingles(item)) - 1e-9]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*docs.columns, "ids", "n_tokens"]
    assert sorted((r.doc_id, r.text, r.n_chars, r.ids) for r in got.collect()) == sorted((i, t, len(t), library.encode_ordinary(t)) for i, t in step)
    assert 7 not in kept and {3, 13}.isdisjoint(i for i, _ in step) and len(step) > 30
    empty = tmp_path / "empty"
    docs.where("false").write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
