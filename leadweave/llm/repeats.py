"""Substring dedup by fixed-block anchors: words covered by a window that starts in a document before are removed.

A window of 2b-1 words holds exactly one whole block that starts at a multiple of b, wherever it stands. So
each document gives its non-overlapping blocks of b words as reference blocks and every rolling window of b
words as a probe. Blocks that a probe of another document meets are anchors; the texts around anchors are then
compared by windows of full width, which extends every anchor to its maximal exact repeat.

Hashes travel as packed postings, many words to a row, dealt out by ranges of the hash to buckets. Before that each
task reduces what its own documents share to the posting of the first document, so that a passage
of very many documents brings a bucket one posting for each reader's block of documents, not one for each document.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, mix, raw_texts, rolling, slices, small_or_shuffled

WINDOW = 13
#: op10's rows by brute force over all windows, for DuckDB.
ORACLE_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k : k + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM w WHERE len(w) >= 13)),
low AS (SELECT s, min(doc_id) AS low FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM win JOIN low USING (s) WHERE low.low < win.doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM w),
kept AS (
  SELECT doc_id, count(gone.k) AS n_removed, string_agg(CASE WHEN gone.k IS NULL THEN word END, ' ' ORDER BY words.k) AS text
  FROM words LEFT JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(kept.n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
#: Words that a reader packs at once, and postings that a bucket should hold, about.
PACK, BUCKET = 1_500_000, 2_500_000
_LAST = np.iinfo(np.int64).max
POSTINGS = "bucket int, payload binary"


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _pack_marks(doc: np.ndarray, th: np.ndarray, pos: np.ndarray, groups: int) -> pa.RecordBatch:
    """Rows (bucket, payload) of marked positions, one for each group of documents; the bucket of group g is -1-g."""
    with np.errstate(over="ignore"):
        group = (mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + th.view(np.uint64)) >> np.uint64(1)).astype(np.int64) % groups
    order = np.lexsort((pos, th, doc, group))
    group, doc, th, pos = group[order], doc[order], th[order], pos[order].astype(np.int64)
    starts = np.flatnonzero(np.r_[np.full(min(1, len(doc)), True), (group[1:] != group[:-1]) | (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (pos[1:] != pos[:-1] + 1)])
    stops = np.r_[starts, len(doc)][1:] - 1
    runs = np.stack([doc[starts], th[starts], pos[starts], pos[stops]], axis=1) if len(starts) else np.empty((0, 4), np.int64)
    of = group[starts]
    first = np.flatnonzero(np.r_[np.full(min(1, len(of)), True), of[1:] != of[:-1]])
    cuts = np.r_[first, len(of)]
    rows = [np.ascontiguousarray(runs[x:y].T).tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array((-1 - of[first]).astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "payload"])


def _merge(payloads: list[bytes]) -> pa.RecordBatch:
    """(doc_id, th, runs) of a group's documents: the union of their runs, which may touch or overlap."""
    parts = [np.frombuffer(p, np.int64).reshape(4, -1) for p in payloads]
    doc, th, a, b = (np.concatenate([p[k] for p in parts]) for k in range(4))
    order = np.lexsort((a, th, doc))
    doc, th, a, b = doc[order], th[order], a[order], b[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])])
    runs = []
    for x, y in zip(first.tolist(), [*first[1:].tolist(), len(doc)], strict=True):
        reach = np.maximum.accumulate(b[x:y])
        new = np.flatnonzero(np.r_[True, a[x + 1 : y] > reach[:-1] + 1])
        runs.append(np.stack([a[x:y][new], reach[np.r_[new[1:] - 1, y - x - 1]]], axis=1).astype(np.uint32).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(th[first]), pa.array(runs, pa.binary())], names=["doc_id", "th", "runs"])


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, so that the shuffle's compression finds the empty high bytes."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(raw: memoryview, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel()


class Packer:
    """Collects (hash, document, position, block?) and packs them to postings by bucket.

    exact: full 64-bit hashes travel and what is marked here is final; else 32 bits of them do, and marks may be too many.
    """

    def __init__(self, buckets: int, exact: bool) -> None:
        self.buckets, self.exact = buckets, exact
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, doc: int, th: int, h: np.ndarray, pos: np.ndarray, block: np.ndarray) -> None:
        self.parts.append((doc, th, h, pos, block))
        self.size += len(h)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        count = [len(p[2]) for p in self.parts]
        doc, th = (np.repeat(np.array([p[k] for p in self.parts], np.int64), count) for k in (0, 1))
        h, pos, block = (np.concatenate([p[k] for p in self.parts]) for k in (2, 3, 4))
        self.clear()
        order = np.argsort(h, kind="stable")
        hs, ds = h[order], doc[order]
        first = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(hs)]))
        low, high = np.minimum.reduceat(ds, first), np.maximum.reduceat(ds, first)
        shared = (high > low)[group]
        if self.exact:
            marked = ds > low[group]
        else:
            any_block = np.logical_or.reduceat(block[order], first)
            marked = shared  # whether or not one is a block: only the first document's posting goes on to meet others'
            block[order] = any_block[group]
        if marked.any():
            own = order[marked]
            yield _pack_marks(doc[own], th[own], pos[own], self.buckets)
        order = order[ds == low[group]]
        # Buckets are ranges of the hash's upper 32 bits; only those that have postings are looked at, however many there are.
        of = ((h[order] >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.r_[np.full(min(1, len(of)), True), of[1:] != of[:-1]])
        rows: list[tuple[int, bytes]] = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
            own = np.sort(order[a:b])
            rows.append((int(of[a]), self._payload(doc[own], th[own], pos[own], h[own], block[own])))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "payload"])

    def _payload(self, doc: np.ndarray, th: np.ndarray, pos: np.ndarray, h: np.ndarray, block: np.ndarray) -> bytes:
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])])
        step = np.diff(pos, prepend=0)
        step[first] = pos[first]
        hashes = h.tobytes() if self.exact else h.astype(np.uint32).tobytes()
        return b"".join([struct.pack("<II", len(first), len(h)), doc[first].tobytes(), th[first].tobytes(), _planes(np.diff(np.r_[first, len(h)])), _planes(step), np.packbits(block).tobytes(), hashes])


def _unpack(raw: bytes, exact: bool) -> tuple[np.ndarray, ...]:
    view = memoryview(raw)
    n_docs, n = struct.unpack_from("<II", raw)
    at = 8
    doc = np.frombuffer(view[at:], np.int64, n_docs)
    th = np.frombuffer(view[at + 8 * n_docs :], np.int64, n_docs)
    at += 16 * n_docs
    count = _unplanes(view[at:], n_docs).astype(np.int64)
    at += 4 * n_docs
    step = _unplanes(view[at:], n).astype(np.int64)
    at += 4 * n
    block = np.unpackbits(np.frombuffer(view[at:], np.uint8, ceil(n / 8)), count=n).astype(bool)
    at += ceil(n / 8)
    h = np.frombuffer(view[at:], np.uint64 if exact else np.uint32, n)
    total = np.cumsum(step)
    start = np.cumsum(count) - count
    pos = total - np.repeat(total[start] - step[start], count)
    return np.repeat(np.arange(n_docs), count), doc, th, pos.astype(np.uint32), block, h


def _resolve(payloads: list[bytes], exact: bool, groups: int) -> pa.RecordBatch:
    """Mark what a bucket's postings have in common with a document before, and (not exact) the blocks it was found by."""
    index, docs, ths, poss, blocks, hs = [], [], [], [], [], []
    at = 0
    for raw in payloads:
        i, doc, th, pos, block, h = _unpack(raw, exact)
        index.append(i + at)
        at += len(doc)
        for to, x in ((docs, doc), (ths, th), (poss, pos), (blocks, block), (hs, h)):
            to.append(x)
    i, doc, th, pos, block, h = (np.concatenate(x) for x in (index, docs, ths, poss, blocks, hs))
    order = np.argsort(h, kind="stable")
    hs_ = h[order]
    first = np.flatnonzero(np.r_[True, hs_[1:] != hs_[:-1]])
    size = np.diff(np.r_[first, len(hs_)])
    twice = np.repeat(size > 1, size)
    order, size = order[twice], size[size > 1]
    if not len(order):
        return _pack_marks(np.empty(0, np.int64), np.empty(0, np.int64), pos[:0], groups)
    first = np.cumsum(size) - size
    ds = doc[i[order]]
    is_block = block[order]
    low = np.repeat(np.minimum.reduceat(np.where(is_block, ds, _LAST), first), size)
    high = np.repeat(np.maximum.reduceat(ds, first), size)
    own = order[(low < ds) | (~np.bool_(exact) & is_block & (high > ds))]
    return _pack_marks(doc[i[own]], th[i[own]], pos[own], groups)


def _shared(postings: DataFrame, buckets: int, exact: bool) -> DataFrame:
    """(doc_id, th, runs): the marked positions of each document, from packed postings.

    Marks travel packed by groups of documents, as many as there are buckets, so that their rows don't multiply with both.
    """

    def by_bucket(batches: Iterable[pa.RecordBatch], done: Callable[[list[bytes]], pa.RecordBatch], skip: bool) -> Iterator[pa.RecordBatch]:
        now, waiting = None, []
        for batch in batches:
            inside = np.array(batch.column(0).to_pylist())
            if skip and (inside < 0).any():
                yield batch.filter(pa.array(inside < 0))
            for bucket, payload in zip(inside.tolist(), batch.column(1).to_pylist(), strict=True):
                if not (skip and bucket < 0):
                    if bucket != now and waiting:
                        yield done(waiting)
                        waiting = []
                    now = bucket
                    waiting.append(payload)
        if waiting:
            yield done(waiting)

    dealt = postings.repartition(buckets, F.pmod("bucket", F.lit(buckets))).sortWithinPartitions("bucket")
    marks = dealt.mapInArrow(lambda batches: by_bucket(batches, lambda x: _resolve(x, exact, buckets), True), POSTINGS)
    grouped = marks.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return cut(grouped.mapInArrow(lambda batches: by_bucket(batches, _merge, False), "doc_id bigint, th bigint, runs binary"))


def _spread(runs: bytes, before: int, behind: int, n: int) -> np.ndarray:
    """A mask over n places: each run, ``before`` places to its left and ``behind`` to its right."""
    edge = np.zeros(n + 1, np.int64)
    pairs = np.frombuffer(runs, np.uint32).reshape(-1, 2).astype(np.int64)
    np.add.at(edge, np.clip(pairs[:, 0] - before, 0, n), 1)
    np.add.at(edge, np.clip(pairs[:, 1] + behind + 1, 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _postings(docs: DataFrame, window: int, buckets: int, anchors: bool) -> DataFrame:
    """Packed postings of docs (doc_id, th, text): blocks and probes, or (with runs) the windows around anchors."""
    block = (window + 1) // 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets, exact=not anchors)
        for batch in (b for whole in batches for b in slices(whole)):
            runs = [None] * batch.num_rows if anchors else batch.column(3).to_pylist()
            for doc, th, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch), runs, strict=True):
                words = text.split()
                if len(words) < window:
                    continue
                h = rolling(word_hashes(words), block if anchors else window)
                pos = np.arange(len(h), dtype=np.int64)
                if anchors:
                    packer.add(doc, th, h, pos, pos % block == 0)
                else:
                    near = _spread(own, window - block, 0, len(h))
                    packer.add(doc, th, h[near], pos[near], np.ones(int(near.sum()), bool))
                if packer.size >= PACK:
                    yield from packer.flush()
        yield from packer.flush()

    return docs.mapInArrow(run, POSTINGS)


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, th, runs) of docs (doc_id, th, text): starts of windows that also start in a document of smaller id."""
    if window % 2 == 0:
        raise ValueError("the window must be odd, so that it holds one whole block of half its width")
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(size / 6 / BUCKET))
    anchors = _shared(_postings(rows, window, buckets, anchors=True), buckets, exact=False)
    around = rows.join(small_or_shuffled(anchors, BROADCAST_ROWS, F.octet_length("runs")), ["doc_id", "th"]).select("doc_id", "th", "text", "runs")
    return _shared(_postings(around, window, buckets, anchors=False), buckets, exact=True)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _with_runs(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    rows = _keyed(docs, id_col, text_col)
    found = repeated_windows(rows, window)
    return rows.join(small_or_shuffled(found, BROADCAST_ROWS, F.octet_length("runs")), ["doc_id", "th"], "left").select("doc_id", "text", "runs")


def kept_words(text: bytes, runs: bytes | None, window: int) -> tuple[int, list[bytes]]:
    """The number of words, and the words that no marked window covers."""
    words = text.split()
    if not runs:
        return len(words), words
    gone = _spread(runs, 0, window - 1, len(words))
    return len(words), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (digest: kept_sha256), the words that stay joined by one space, of each row.

    Windows are judged on the input. Null texts have no words; rows with null ids neither remove nor lose
    words; rows of one id don't remove words of each other, and equal rows lose the same words; other columns are ignored.
    Texts travel once at most: marked positions, a few numbers a document, are broadcast if their checked size
    allows it.
    """
    last = "kept_sha256" if digest else "kept_text"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in slices(whole)):
            n, gone, out = [], [], []
            for text, runs in zip(raw_texts(batch), batch.column(2).to_pylist(), strict=True):
                total, kept = kept_words(text, runs, window)
                n.append(total)
                gone.append(total - len(kept))
                joined = b" ".join(kept)
                out.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", last])

    return _with_runs(docs, window, id_col, text_col).mapInArrow(run, f"doc_id bigint, n_words bigint, n_removed bigint, {last} string")
