"""Plain Python versions of the operators, over all pairs, for small tables."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\W_]+")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Groups:
    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def simhash(hashes: list[int]) -> int:
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def shingles(text: str | None, width: int = 3) -> list[str]:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] if len(words) >= width else ([" ".join(words)] if words else [])


def fingerprint(text: str | None, width: int = 3) -> int:
    return simhash([xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles(text, width)])


def near_duplicates(rows: list[tuple[int, str | None]], radius: int = 3) -> list[tuple[int, str, int]]:
    fps = [fingerprint(t) for _, t in rows]
    at = np.array(fps, np.uint64)
    groups = Groups()
    for k in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(at ^ at[k]) <= radius):
            groups.link(k, int(j))
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        r = groups.find(k)
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    return [(i, f"{fps[k]:016x}", least[groups.find(k)]) for k, (i, _) in enumerate(rows)]


def first_copies(rows: list[tuple[int, str | None]], radius: int = 3, width: int = 5, similarity: float = 0.8) -> set:
    """The ids that come first in their group of near copies, by fingerprints and by sets of shingles."""
    fps, sets = [fingerprint(t, width) for _, t in rows], [set(shingles(t, width)) for _, t in rows]
    groups, least = Groups(), {}
    for k in range(len(rows)):
        for j in range(k):
            both = len(sets[k] & sets[j])
            alike = both and both >= similarity * (len(sets[k]) + len(sets[j]) - both) - 1e-9
            if alike or (fps[k] ^ fps[j]).bit_count() <= radius:
                groups.link(k, j)
    for k, (i, _) in enumerate(rows):
        least[groups.find(k)] = min(least.get(groups.find(k), i), i)
    return set(least.values())


def similar(texts: list[str], similarity: float = 0.8) -> list[tuple[int, int]]:
    """All pairs of places whose texts have the edit similarity, by another engine's edit distance."""
    import duckdb
    import pandas as pd

    t = pd.DataFrame({"k": range(len(texts)), "t": texts, "n": [len(x) for x in texts]})
    near = f"a.k < b.k and least(a.n, b.n) >= {similarity} * greatest(a.n, b.n) - 1e-9"
    found = duckdb.sql(f"select a.k, b.k from t a join t b on {near} where levenshtein(a.t, b.t) <= (1 - {similarity}) * greatest(a.n, b.n) + 1e-9").fetchall()
    return sorted(found) if len(t) else []


def line_dedup(rows: list[tuple[int, str | None]], similarity: float = 0.8) -> list[tuple[int, str | None, int]]:
    """Texts without their surplus lines; rows must have distinct ids or equal texts."""
    groups, first = Groups(), {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42)))):
        for n, line in enumerate(t.split("\n")):
            words = tuple(PLAIN.findall(line.lower()))
            if words and words not in first:
                first[words] = (len(first), i, t, n)
    for a, b in similar([" ".join(w) for w in first], similarity):
        groups.link(a, b)
    kept = {groups.find(first[w][0]) for w in first}
    by_number = {v[0]: v[1:] for v in first.values()}
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0))
            continue
        stay = []
        for n, line in enumerate(t.split("\n")):
            words = tuple(PLAIN.findall(line.lower()))
            root = groups.find(first[words][0]) if words else None
            stay.append(not words or (root in kept and by_number[root] == (i, t, n)))
        out.append((i, "\n".join(x for x, s in zip(t.split("\n"), stay, strict=True) if s), stay.count(False)))
    return out


def quality(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of rows (doc_id, text, lang, source)."""
    import math

    measured = []
    for i, text, lang, source in rows:
        t = text or ""
        words = WORD.findall(t)
        joined = "".join(words)
        windows: dict = {}
        for k in range(len(words) - 7):
            windows.setdefault(tuple(words[k : k + 8]), []).append(k)
        twice = {k + j for places in windows.values() if len(places) > 1 for k in places for j in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        dup = sum(x in lines[:k] for k, x in enumerate(lines))
        n, size = len(words), len(joined)
        share = lambda p: len(re.findall(p, joined)) / size if size else 0.0  # noqa: B023, E731
        ratios = {
            "symbols": share(r"[#*$%&|<>]"), "upper": share("[A-Z]"), "punctuation": share(r"[!-/:-@\[-`{-~]"), "word_length": size / n if n else 0.0, "dup_lines": dup / len(lines) if lines else 0.0,
            "repeats": len(twice) / n if n else 0.0, "stutter": sum(a == b for a, b in zip(words, words[1:])) / n if n else 0.0,
        }
        failed = n < 20 or 100 * len(twice) > 30 * n
        measured.append((i, lang, source, n, size, round(share(r"[#*$%&|<>]") * size), dup, len(twice), failed, ratios))

    def fence(values: list[float], rule: str) -> tuple[int, float | None]:
        zeros = rule not in ("dup_lines", "repeats", "stutter")
        found = sorted(1.02 ** math.ceil(math.log(v) / math.log(1.02)) if v > 0 else 0.0 for v in values if v > 0 or zeros)
        if not found:
            return 0, None
        low, high = (found[math.ceil(q * len(found)) - 1] for q in (0.25, 0.75))
        return len(found), high + 6 * (high - low) + (0.01 if zeros else 0)

    def leaning(n: int, own: float | None, wide: float | None) -> float | None:
        return wide if own is None else own if wide is None else (n * own + 50 * wide) / (n + 50)

    def limit(rule: str, lang: str | None, source: str | None) -> float | None:
        of = lambda test: fence([m[9][rule] for m in measured if not m[8] and test(m)], rule)
        wide = leaning(*of(lambda m: m[1] == lang), of(lambda m: True)[1])
        return leaning(*of(lambda m: (m[1], m[2]) == (lang, source)), wide)

    limits: dict = {}
    out = []
    for i, lang, source, n, size, symbols, dup, twice, failed, ratios in measured:
        for rule in ratios:
            if (rule, lang, source) not in limits:
                limits[rule, lang, source] = limit(rule, lang, source)
        above = [r for r, v in ratios.items() if limits[r, lang, source] is not None and v > limits[r, lang, source]]
        out.append((i, n, size, symbols, dup, twice, failed, not failed and not above))
    return out


def remove_repeats(rows: list[tuple[int, str | None]], window: int = 13) -> list[tuple[int, int, int, str]]:
    low: dict = {}
    for i, t in rows:
        words = WORD.findall(t or "")
        for k in range(len(words) - window + 1):
            own = tuple(words[k : k + window])
            if i is not None:
                low[own] = min(low.get(own, i), i)
    out = []
    for i, t in rows:
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if i is not None and low[tuple(words[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
