"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius by vantage-point trees.

A tree over a bounded sample of distinct fingerprints deals the fingerprint space out to shards by Hamming
distance from vantage points. Every distinct fingerprint is stored in one shard and asked of each shard that
the triangle bound cannot rule out, so that the pairs found are exact. A shard builds its own tree, searches it
in blocks and returns a spanning forest of its links, never all pairs of a group.

Near copies of a shingle similarity of 0.8 differ in about ten bits, where triangle bounds rule nothing out. keep_first()
therefore adds links between texts whose shingle sets have that Jaccard similarity. Candidates share a band of a MinHash
sketch (at 0.8 all but 2 of 10,000 pairs do) and are verified on the whole sets. Members of a band's bucket meet some of
its members, drawn by hash, not each other; buckets that still hold more than one group draw anew, and more of them. What
is of different groups after that meets each other, so that all that share a band are of one group or have been compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bucket_pairs, cut, drop, fresh, map_batches, mix, raw_texts, small_or_shuffled
from .components import components, merged

RADIUS = 3
#: Distinct fingerprints that a shard holds, about; members of a leaf within a shard; sample for the upper tree.
SHARD, LEAF, SAMPLE = 16_384, 64, 4_096
#: keep_first(): Jaccard similarity of near copies and words of a shingle.
SIMILARITY, WIDTH = 0.8, 5
#: Bands of a MinHash sketch and hashes of a band; places of a sketch in which a pair to be verified may differ, which is
#: four standard deviations beyond what a similarity of 0.8 leads to.
BANDS, ROWS, APART = 16, 4, 26
#: Members of a bucket that all its members meet, by rounds, before those of different groups meet each other.
HEADS = (2, 8)
_FACTORS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(text: bytes, width: int = 3, seed: int = 42) -> np.ndarray:
    """The big-endian XXH64 of the shingles of a text, in order, repeats included.

    A-Z become a-z; a text of fewer than ``width`` words is one shingle, one of none has no shingle.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, ">u8")
    whole = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(whole, seed)], ">u8")
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(whole[a:b], seed) for a, b in zip(start, end[width - 1 :].tolist(), strict=True)], dtype=">u8", count=len(start))


def majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of the big-endian hashes; 0 if there are none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 50_000):
        ones += np.unpackbits(h[at : at + 50_000].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: bit i is set if it is set in over half the XXH64 of its shingles."""
    return majority(shingle_hashes(text, width, seed))


def minhash(u: np.ndarray) -> np.ndarray:
    """The MinHash sketch of a set of hashes, not empty."""
    n = BANDS * ROWS
    low = np.full(n, np.iinfo(np.uint64).max)
    for at in range(0, len(u), 2_048):
        np.minimum(low, (np.multiply.outer(_FACTORS[:n], u[at : at + 2_048]) + _FACTORS[n:, None]).min(axis=1), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """A key for each band of a sketch."""
    key = np.arange(BANDS, dtype=np.uint64)
    for own in low.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + own)
    return key.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp bigint) of each row; a null text counts as empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t, width, seed) for t in raw_texts(batch)), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, f"doc_id {kind}, fp bigint")


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), pa.array(np.concatenate(rows)))


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int) -> DataFrame:
    """(doc_id, fp, sid, n, keys, marks) of each row: its SimHash, a 128-bit digest of its set of shingles, the set's size, the
    keys of its bands and a byte of each place of its sketch; no keys and marks if there is no shingle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, sids, sizes, keys, marks, none = [], [], [], [], [], np.empty(0, np.int64)
        for text in raw_texts(batch):
            h = shingle_hashes(text, width, seed)
            u = np.unique(h.astype(np.uint64))
            fps.append(majority(h))
            sids.append(xxhash.xxh3_128_digest(u.tobytes()))
            sizes.append(len(u))
            low = minhash(u) if len(u) else None
            keys.append(none if low is None else bands(low))
            marks.append(none if low is None else mix(low).astype(np.uint8).view(np.int64))
        columns = [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sids, pa.binary()), pa.array(sizes, pa.int64()), _lists(keys), _lists(marks)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "sid", "n", "keys", "marks"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, f"doc_id {kind}, fp bigint, sid binary, n bigint, keys array<bigint>, marks array<bigint>")


def shingle_sets(docs: DataFrame, text_col: str, width: int, seed: int) -> DataFrame:
    """(sid, u): the distinct shingle hashes of each row's text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t, width, seed).astype(np.uint64)).view(np.int64) for t in raw_texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], names=["sid", "u"])

    return map_batches(docs.select("sid", F.col(text_col).cast("string").alias("text")), run, "sid binary, u array<bigint>")


class Tree:
    """A vantage-point tree as arrays: node i has a vantage, a bound and children; a negative child is leaf -1-k."""

    def __init__(self, points: np.ndarray, leaves: int | None = None, leaf: int = LEAF) -> None:
        """Split until there are ``leaves`` parts (a power of two), or until a part has at most ``leaf`` members."""
        self.vantage: list[int] = []
        self.bound: list[int] = []
        self.child: list[list[int]] = []
        self.members: list[np.ndarray] = []
        todo = [(np.arange(len(points)), -1, 0, 0)]
        while todo:
            own, parent, side, depth = todo.pop()
            split = None
            if (2**depth < leaves) if leaves else len(own) > leaf:
                split = self._split(points, own)
            if split is None:
                self.members.append(own)
                node = -len(self.members)
            else:
                v, bound, near = split
                node = len(self.vantage)
                self.vantage.append(int(v))
                self.bound.append(bound)
                self.child.append([0, 0])
                todo += [(own[near], node, 0, depth + 1), (own[~near], node, 1, depth + 1)]
            if parent >= 0:
                self.child[parent][side] = node
            else:
                self.root = node

    @staticmethod
    def _split(points: np.ndarray, own: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
        """The most even split by distance from one of a few members; None if all members are equal."""
        best = None
        for k in range(4):
            if not len(own):
                break
            v = points[own[(k * 7919 + len(own) // 2) % len(own)]]
            d = np.bitwise_count(points[own] ^ v).astype(np.int64)
            bound = int(np.median(d))
            bound = bound if d.max() > bound else bound - 1
            near = d <= bound
            if near.any() and not near.all() and (best is None or abs(2 * near.sum() - len(own)) < best[0]):
                best = (abs(2 * int(near.sum()) - len(own)), (v, bound, near))
        return best and best[1]

    def reach(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each leaf, the queries whose ball of ``radius`` it may hold members of."""
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            node, q = todo.pop()
            if node < 0:
                yield -1 - node, q
                continue
            d = np.bitwise_count(queries[q] ^ np.uint64(self.vantage[node])).astype(np.int64)
            for side, keep in ((0, d - radius <= self.bound[node]), (1, d + radius > self.bound[node])):
                if keep.any():
                    todo.append((self.child[node][side], q[keep]))


class Forest:
    """Union-find over 0..n-1 that takes blocks of edges; roots are kept flat, so that known links cost one look-up."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.root[u], self.root[v]
            new = a != b
            if not new.any():
                return
            u, v = u[new], v[new]
            np.minimum.at(self.root, np.maximum(a[new], b[new]), np.minimum(a[new], b[new]))
            while not np.array_equal(flat := self.root[self.root], self.root):
                self.root = flat


def shard_forest(stored: np.ndarray, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between ``asked`` and ``stored`` fingerprints (distinct, unsigned)."""
    every = np.unique(np.concatenate([stored, asked]))
    forest, s_at, q_at = Forest(len(every)), np.searchsorted(every, stored), np.searchsorted(every, asked)
    tree = Tree(stored)
    for leaf, q in tree.reach(asked, radius):
        own = tree.members[leaf]
        for at in range(0, len(q), 65_536):
            part = q[at : at + 65_536]
            near = np.bitwise_count(asked[part][:, None] ^ stored[own][None, :]) <= radius
            i, j = np.nonzero(near)
            u, v = q_at[part[i]], s_at[own[j]]
            forest.add(u[u != v], v[u != v])
    moved = np.flatnonzero(forest.root != np.arange(len(every)))
    return every[moved], every[forest.root[moved]]


def links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): edges between distinct fingerprints of ``nodes`` (column fp) that span all links within ``radius``."""
    n = nodes.count()
    leaves = 1
    while leaves * shard < n:
        leaves *= 2
    sample = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    upper = Tree(np.array([r.fp for r in sample], np.int64).view(np.uint64), leaves=leaves)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            q = fp.view(np.uint64)
            home = {leaf: own for leaf, own in upper.reach(q, 0)}
            for leaf, own in upper.reach(q, radius):
                at_home = np.isin(own, home.get(leaf, []))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), leaf)), pa.array(fp[own]), pa.array(at_home)], names=["shard", "fp", "stored"])

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows.fp.to_numpy().view(np.uint64)
        a, b = shard_forest(fp[rows.stored.to_numpy()], fp, radius) if rows.stored.any() else (fp[:0], fp[:0])
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = nodes.select("fp").mapInArrow(deal, "shard bigint, fp bigint, stored boolean")
    return dealt.groupBy("shard").applyInPandas(search, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links) of each row of docs.

    Equal fingerprints are one node, so exact copies cost nothing beyond a combined min. Null and empty texts
    have fingerprint zero and link like any other; null ids get a row and never are a component_id unless
    nothing else is there; repeated rows stay repeated; other columns are ignored.
    """
    fps = cut(fingerprints(docs, id_col, text_col, width, seed))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    root = components(links(nodes, radius, shard))
    rooted = nodes.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _apart(a: str, b: str) -> Column:
    """The bytes in which two arrays of marks differ."""
    out = F.lit(0)
    for k in range(BANDS * ROWS // 8):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        for step in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        out = out + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return out


def similar_groups(docs: DataFrame, sketched: DataFrame, edges: DataFrame, id_col: str, text_col: str, width: int, seed: int, similarity: float) -> DataFrame:
    """(node, root): groups by ``edges`` (a, b) and by links between sets of shingles whose Jaccard similarity is at least ``similarity``.

    Nodes are digests of sets, so that equal sets cost nothing. Heads are mins by hash, which combine before the shuffle,
    so that few pairs join most of a bucket however large it is; bucket_pairs() gives the rest. Texts are fetched again for nodes that
    share a bucket only.
    """
    root = None
    nodes = cut(sketched.where("n > 0").groupBy("sid").agg(F.min("n").alias("n"), F.min("keys").alias("keys"), F.min("marks").alias("marks"), F.min("doc_id").alias("at")))
    keyed = nodes.select("sid", "n", "marks", F.explode("keys").alias("key"))
    shared = cut(keyed.groupBy("key").count().where("count > 1").select("key"))
    member = cut(keyed.join(small_or_shuffled(shared, BROADCAST_ROWS), "key"))
    wanted = cut(member.select("sid").distinct())
    first = cut(nodes.select("sid", F.col("at").alias(id_col)).join(small_or_shuffled(wanted, BROADCAST_ROWS), "sid"))
    texts = docs.select(id_col, text_col).join(small_or_shuffled(first, BROADCAST_ROWS, F.lit(64)), id_col)
    sets = cut(shingle_sets(texts, text_col, width, seed))
    if not sets.groupBy("sid").count().where("count > 1").isEmpty():  # repeated rows of one id and text
        sets = cut(sets.dropDuplicates(["sid"]))

    def with_root() -> DataFrame:
        if root is None:
            return cut(member.withColumn("root", F.col("sid")))
        up = small_or_shuffled(root.withColumnRenamed("node", "sid"), BROADCAST_ROWS)
        return cut(member.join(up, "sid", "left").withColumn("root", F.coalesce("root", "sid")))

    def near(o: str) -> Column:
        """Whether sizes and sketches leave room for the similarity of a row and the one whose columns begin with ``o``."""
        room = F.least("n", f"{o}n") >= F.lit(similarity) * F.greatest("n", f"{o}n") - 1e-9
        return room & (_apart("marks", f"{o}marks") <= APART)

    def verified(met: DataFrame) -> DataFrame:
        """(a, b): the roots of pairs (sid, osid) whose sets have the similarity."""
        pairs = cut(met.groupBy(F.least("sid", "osid").alias("a"), F.greatest("sid", "osid").alias("b")).agg(F.min(F.least("root", "oroot")).alias("ra"), F.min(F.greatest("root", "oroot")).alias("rb")))
        both = pairs.join(sets.withColumnRenamed("sid", "a"), "a").join(sets.select(F.col("sid").alias("b"), F.col("u").alias("v")), "b")
        common = F.size(F.array_intersect("u", "v"))
        found = cut(both.where(common * (1 + similarity) >= F.lit(similarity) * (F.size("u") + F.size("v")) - 1e-9).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        drop(pairs)
        return found

    for turn, count in enumerate(HEADS):
        rooted = with_root()
        several = cut(rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key"))
        rest = cut(rooted.join(small_or_shuffled(several, BROADCAST_ROWS), "key"))
        own = F.col("key") if turn else F.lit(0)  # the first heads are those of many buckets, for few pairs
        heads = [F.min(F.struct(F.xxhash64("sid", own, F.lit(turn), F.lit(k)).alias("h"), "sid", "n", "root", "marks")) for k in range(count)]
        led = cut(rest.groupBy("key").agg(F.array_distinct(F.array(*heads)).alias("heads")))
        met = rest.join(small_or_shuffled(led, BROADCAST_ROWS, F.lit(count * 160)), "key").select("sid", "n", "root", "marks", F.inline("heads").alias("h", "osid", "on", "oroot", "omarks"))
        found = verified(met.where("root <> oroot").where(near("o")))
        drop(rooted, several, rest, led)
        if root is None:
            root = cut(components(edges.union(found)))
        elif found.isEmpty():
            break
        else:
            root = merged(root, found)
    found = verified(bucket_pairs(with_root(), "sid", near("o")))
    return root if found.isEmpty() else merged(root, found)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = 42, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that come first (by id, a null id before others) of each group of near copies, with all columns.

    Rows are linked if their fingerprints differ in at most ``radius`` bits or their sets of shingles have a Jaccard
    similarity of ``similarity``; groups are what is reachable by links. Null and empty texts have no shingles and
    link to each other, and to texts whose fingerprint is within the radius of zero. Repeated rows of one id and text keep one;
    an empty table gives an empty one. The ids that go are broadcast if few, so that texts aren't shuffled.
    """
    (k,) = fresh(docs, "_k")
    keyed = docs.select("*", F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th")).alias(k))
    found = cut(sketches(keyed, k, text_col, width, seed))
    # Nodes are sets of shingles; those of one fingerprint hang on the least of them.
    by_fp = cut(found.groupBy("fp").agg(F.min("sid").alias("low")))
    own = found.select("fp", "sid").distinct().join(by_fp, "fp").where("sid <> low").select(F.col("sid").alias("a"), F.col("low").alias("b"))
    end = lambda c: by_fp.select(F.col("fp").alias(c), F.col("low").alias(f"low_{c}"))
    near = links(by_fp, radius).join(end("a"), "a").join(end("b"), "b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b"))
    root = similar_groups(keyed, found, own.union(near), k, text_col, width, seed, similarity)
    rooted = found.select("doc_id", "sid").join(small_or_shuffled(root.withColumnRenamed("node", "sid"), BROADCAST_ROWS), "sid", "left")
    grouped = cut(rooted.select("doc_id", F.coalesce("root", "sid").alias("root")))
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").select("root", "first")
    gone = cut(grouped.join(small_or_shuffled(cut(least), BROADCAST_ROWS), "root").where(~F.col("doc_id").eqNullSafe(F.col("first"))).select(F.col("doc_id").alias(k)).distinct())
    kept = keyed.join(small_or_shuffled(gone, BROADCAST_ROWS), k, "left_anti")
    if not found.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([k])
    return kept.select(*docs.columns)
