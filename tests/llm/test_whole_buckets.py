"""Buckets in which those that belong together are never among the first: all pairs between groups are compared."""

from __future__ import annotations

import random

import brute
import pytest
from pyspark.sql import functions as F


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def words(rng, n):
    return ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(n)]


@pytest.mark.parametrize("chunk", [5, 1_000])
def test_lines_of_crowded_blocks(spark, monkeypatch, chunk):
    from leadweave.llm import common, lines

    monkeypatch.setattr(common, "CHUNK", chunk, raising=False)
    monkeypatch.setattr(lines, "HEADS", 1)
    rng = random.Random(5)
    pool = [words(rng, 6) for _ in range(12)]
    rows = [(k, " ".join(w for p in sorted(rng.sample(range(12), 6)) for w in pool[p])) for k in range(130)]
    found = {r.doc_id: r for r in lines.occurrences(table(spark, rows)).collect()}
    keys = {k: {r[f"k{j}"] for j in range(lines.BLOCKS)} for k, r in found.items()}
    root = list(range(130))
    signed = lambda x: x & (2**64 - 1)
    pairs = [(a, b) for a in range(130) for b in range(a) if keys[a] & keys[b] and (signed(found[a].fp) ^ signed(found[b].fp)).bit_count() <= lines.RADIUS]
    sim = table(spark, rows).withColumnsRenamed({"doc_id": "a", "text": "s"}).crossJoin(table(spark, rows).withColumnsRenamed({"doc_id": "b", "text": "t"})).where("a > b")
    close = {(r.a, r.b) for r in sim.where(F.levenshtein("s", "t") <= F.floor((1 - F.lit(0.8)) * F.greatest(F.length("s"), F.length("t")) + 1e-9)).select("a", "b").collect()}
    for a, b in close & set(pairs):
        ra, rb = root[a], root[b]
        root = [min(ra, rb) if x in (ra, rb) else x for x in root]
    gone = {k for k in range(130) if root[k] != k}
    assert {r.doc_id for r in lines.dedup(table(spark, rows)).where("_n_removed > 0").collect()} == gone and len(gone) > 10 and len(gone) < 120


@pytest.mark.parametrize("chunk", [5, 1_000])
def test_near_copies_of_crowded_bands(spark, monkeypatch, chunk):
    from leadweave.llm import common, simhash

    monkeypatch.setattr(common, "CHUNK", chunk, raising=False)
    monkeypatch.setattr(simhash, "HEADS", (1,))
    rng = random.Random(6)
    base, rows = words(rng, 300), []
    for _ in range(60):
        own = list(base)
        for _ in range(5):
            own[rng.randrange(300)] = words(rng, 1)[0]
        other = list(own)
        for _ in range(3):
            other[rng.randrange(300)] = words(rng, 1)[0]
        rows += [own, other]
    rng.shuffle(rows)
    rows = [(k, " ".join(x)) for k, x in enumerate(rows)]
    kept = {r.doc_id for r in simhash.keep_first(table(spark, rows)).collect()}
    assert kept == brute.first_copies(rows) and len(kept) < 90


def test_long_lines_are_accepted_by_pieces_as_by_all_characters(spark):
    from leadweave.llm import lines

    rng = random.Random(9)
    rows = []
    for k, changes in enumerate((30, 60, 90, 120, 150)):
        line = words(rng, 500)
        other = list(line)
        for at in rng.sample(range(500), changes):
            other[at] = words(rng, 1)[0]
        del other[:: 50 if k % 2 else 500]
        rows += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(other))]
    pairs = spark.createDataFrame([(rows[2 * k][1], rows[2 * k + 1][1], 2 * k + 1) for k in range(5)], "s string, t string, doc_id long")
    close = {r.doc_id for r in pairs.where(F.levenshtein("s", "t") <= F.floor(F.lit(1 - 0.8) * F.greatest(F.length("s"), F.length("t")) + 1e-9)).collect()}
    docs = table(spark, rows)
    from leadweave.llm.common import cut

    found = cut(lines.occurrences(docs))
    h = {r.doc_id: r.h1 for r in found.collect()}
    nodes = found.groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in ("doc_id", "th", "line_no")])
    given = spark.createDataFrame([(h[2 * k], h[2 * k + 1]) for k in range(5)], "x long, y long")
    got = {r.b.h1 for r in lines._similar(given, cut(nodes), docs, "doc_id", "text", 0.8).collect()}
    assert got == {h[k] for k in close} and 0 < len(got) < 5


def test_pairs_that_fail_by_words_are_not_written_by_the_last_round(spark, monkeypatch):
    from leadweave.llm import lines

    for name, value in (("RADIUS", 64), ("HEADS", 1), ("ROWS", 300), ("PAIRS", 20)):
        monkeypatch.setattr(lines, name, value, raising=False)
    given, similar = [], lines._similar
    monkeypatch.setattr(lines, "_similar", lambda pairs, *a: given.append(pairs.collect()) or similar(pairs, *a))
    rng = random.Random(12)
    pool = [words(rng, 6) for _ in range(16)]
    texts = [[w for p in sorted(rng.sample(range(16), 6)) for w in pool[p]] for _ in range(60)]
    docs = table(spark, [(k, " ".join(x)) for k, x in enumerate(texts)])
    own = {r.h1: texts[r.doc_id] for r in lines.occurrences(docs).collect()}
    lines.dedup(docs).collect()

    def cost(s, t):
        row = list(range(len(t) + 1))
        for i, x in enumerate(s, 1):
            last, row = row, [i]
            for j, y in enumerate(t, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    # Words that differ have equal marks at times.
    assert len(given) == 3 and all(cost(own[r.x], own[r.y]) <= 18 + 3 for r in given[2])
