"""N-gram Jaccard join: groups of documents whose sets of word shingles are similar, found by token-combination prefixes.

Equal sets are one node, by a cryptographic digest of their shingles. Tokens are hashes of shingles, in one order for all: by the number of
nodes that have them, rare ones first. A node of n shingles that is similar to another lacks at most m = n - ceil(p n / 100) of them there, so
that of any m + 1 of its tokens one is in the other. Tokens of few nodes are indexed alone. Frequent ones are dealt out to classes and
indexed in pairs of one class: x tokens of a class then stand for x - 1 of the m + 1, so that the prefix is extended by a token a class.
There is a class for every CLASS shingles of a node (of the power of two below its size), which keeps pairs in proportion to the prefix. The smaller
node of a pair needs a shorter prefix, as it lacks fewer: m = n - ceil(2 p n / (100 + p)).

If the prefix of either ends first in the order, its tokens that the other has are in the prefix of the other too, and fewer
than a class asks for would be more than m missing ones; so each similar pair shares an entry, and none is lost. Tokens of one node only come
first in the order and need no shuffle beyond counting: most documents end there.

Pairs of an entry aren't all compared. Every node meets the entry's head, which has the fewest tokens of its own, by the words of both. Nodes
that this doesn't group meet only if the entry's head leaves them room: what two nodes share is at most what both share
with the head, and what either has that isn't the head's or its own. These are verified by their words too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import BROADCAST_ROWS, cut, fresh, map_batches, mix, raw_texts, slices, small_batches, small_or_shuffled
from .components import components

WIDTH, PERCENT = 5, 80
#: Nodes that may have a token that is indexed alone; shingles of a node for each class of frequent tokens.
RARE, CLASS = 16, 16
#: Tokens of a bucket of the count, about, and the least number of buckets.
BUCKET, LEAST_BUCKETS = 2_000_000, 64
#: A token of one row in so many is hot: it is last in the order and isn't counted by one task. Counters that a task keeps to find them.
HOT, COUNTERS = 50, 65_536
_HOT_DF = np.iinfo(np.int32).max


def shingles(text: bytes, width: int = WIDTH) -> list[bytes]:
    """The distinct shingles of a text with a-z for A-Z; of fewer words the whole sequence, without words none."""
    words = text.lower().split()
    if not words:
        return []
    whole = b" ".join(words)
    if len(words) <= width:
        return [whole]
    end = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    start = [0, *(e + 1 for e in end[: len(words) - width])]
    return list({whole[a:b] for a, b in zip(start, end[width - 1 :], strict=True)})


def tokens(own: list[bytes]) -> np.ndarray:
    """64-bit hashes of shingles."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))


def short(h: np.ndarray) -> np.ndarray:
    """The tokens that are counted and ordered: the upper 48 bits. Those that this makes equal cost comparisons, not links."""
    return np.unique(h >> np.uint64(16))


def digest(own: list[bytes], h: np.ndarray) -> bytes:
    """A digest of a set of shingles, which are put in the order of their hashes."""
    return hashlib.blake2b(b"\n".join([own[i] for i in np.argsort(h, kind="stable").tolist()]), digest_size=16).digest()


class Frequent:
    """Counters of the most frequent tokens of a task: what is missing from a count is at most the tokens seen / COUNTERS."""

    def __init__(self) -> None:
        self.token, self.count, self.todo, self.waiting = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def add(self, token: np.ndarray) -> None:
        self.todo.append(token)
        self.waiting += len(token)
        if self.waiting > 1_000_000:
            self.fold()

    def fold(self) -> None:
        token, at = np.unique(np.concatenate([self.token, *self.todo]), return_inverse=True)
        weight = np.concatenate([self.count, np.ones(self.waiting, np.int64)])
        count = np.bincount(at, weights=weight, minlength=len(token)).astype(np.int64)
        if len(token) > COUNTERS:
            count -= np.partition(count, len(count) - COUNTERS - 1)[len(count) - COUNTERS - 1]
        self.token, self.count, self.todo, self.waiting = token[count > 0], count[count > 0], [], 0


def digested(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(at, sid, n, m, token, seen): a row for each document with the digest and size of its set and its number of short tokens, and rows of
    (token, seen) for the tokens that many rows of a task have. ``at`` is (id, hash of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = Frequent(), 0
        for batch in (b for whole in batches for b in slices(whole)):
            sids, n, m = [], [], []
            for text in raw_texts(batch):
                own = shingles(text, width)
                h = tokens(own)
                few = short(h)
                found.add(few)
                sids.append(digest(own, h))
                n.append(len(own))
                m.append(len(few))
            rows += batch.num_rows
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sids, pa.binary()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), none, none], names=names)
        found.fold()
        often = found.count * 4 * HOT >= rows
        k = int(often.sum())
        if k:
            empty = [pa.nulls(k, kind) for kind in (at_type, pa.binary(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(found.token[often].astype(np.int64)), pa.array(found.count[often])], names=names)

    names = ["at", "sid", "n", "m", "token", "seen"]
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("th")).alias("at"), text.alias("text"))
    at_type = to_arrow_type(keyed.schema["at"].dataType)
    return keyed.mapInArrow(run, f"at {keyed.schema['at'].dataType.simpleString()}, sid binary, n bigint, m bigint, token bigint, seen bigint")


def postings(texts: DataFrame, buckets: int, hot: np.ndarray, width: int) -> DataFrame:
    """(bucket, nodes, counts, tokens) from (k, text): of a slice of nodes the tokens of each bucket, 6 bytes each, node after node. Hot tokens go by
    node to buckets below zero."""

    def pack(token: np.ndarray) -> bytes:
        return np.ascontiguousarray(token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        node = batch.column("k").to_numpy()
        each = [short(tokens(shingles(t, width))) for t in raw_texts(batch)]
        token, of = np.concatenate([np.empty(0, np.uint64), *each]), np.repeat(np.arange(len(each)), [len(t) for t in each])
        is_hot = np.isin(token, hot)
        bucket = np.where(is_hot, -1 - (mix(node.astype(np.uint64))[of] % np.uint64(buckets)).astype(np.int64), (token >> np.uint64(48 - (buckets.bit_length() - 1))).astype(np.int64))
        order = np.lexsort((of, bucket))
        token, of, bucket = token[order], of[order], bucket[order]
        first = np.flatnonzero(np.r_[np.full(min(1, len(bucket)), True), bucket[1:] != bucket[:-1]])
        out: list[list] = [[], [], [], []]
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True) if len(first) else ():
            own, count = np.unique(of[a:b], return_counts=True)
            for column, x in zip(out, (int(bucket[a]), node[own].astype("<i8").tobytes(), count.astype("<u4").tobytes(), pack(token[a:b])), strict=True):
                column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["bucket", "nodes", "counts", "tokens"])

    return map_batches(texts.select("k", "text"), run, "bucket int, nodes binary, counts binary, tokens binary")


def shared_tokens(rows: pd.DataFrame) -> pd.DataFrame:
    """(k, token, df) of a bucket's tokens that two nodes have; hot ones come last in the order, by an uncounted df."""
    hot = bool(len(rows)) and rows.bucket.iat[0] < 0
    node, count = np.frombuffer(b"".join(rows.nodes), "<i8"), np.frombuffer(b"".join(rows.counts), "<u4")
    raw = np.frombuffer(b"".join(rows.tokens), np.uint8).reshape(-1, 6)
    token = np.zeros((len(raw), 8), np.uint8)
    token[:, :6] = raw
    token, k = token.view("<i8").ravel(), np.repeat(node, count)
    order = np.lexsort((k, token))
    token, k = token[order], k[order]
    if len(token):  # rows of one id and text that are repeated bring a node's tokens again
        new = np.r_[True, (token[1:] != token[:-1]) | (k[1:] != k[:-1])]
        token, k = token[new], k[new]
    _, at, df = np.unique(token, return_inverse=True, return_counts=True)
    df = df[at] if len(token) else np.empty(0, np.int64)
    keep = np.full(len(token), True) if hot else df > 1
    return pd.DataFrame({"k": k[keep], "token": token[keep], "df": np.full(int(keep.sum()), _HOT_DF) if hot else df[keep].astype(np.int32)})


def entries(tokens: list[int], df: list[int], level: int, need: int, rare: int = RARE, size: int = CLASS) -> list[tuple[int, int]]:
    """(errors so far, key) of the entries of a prefix that stands for ``need`` tokens; tokens are in order."""
    classes = max(1, (1 << level) // size)
    seen: dict[int, list[int]] = {}
    out, errors = [], 0
    for t, f in zip(tokens, df, strict=True):
        if errors >= need:
            break
        if f <= rare:
            out.append((errors, hash((level, t))))
            errors += 1
        else:
            own = seen.setdefault(t % classes, [])
            out += [(errors, hash((level, t, x))) for x in own]
            errors += bool(own)
            own.append(t)
    return out


def prefixes(nodes: DataFrame, percent: int) -> DataFrame:
    """(key, k, n, u, small) from (k, n, u, t array<(df, token)>): the index entries of nodes; small: also of the shorter prefix."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for k, n, u, t in zip(*(batch.column(c).to_pylist() for c in ("k", "n", "u", "t")), strict=True):
            df, token = [x["df"] for x in t], [x["token"] for x in t]
            most, fewer = n + (-percent * n) // 100, n + (-2 * percent * n) // (100 + percent)
            top = n.bit_length() - 1
            for level in range((-(-percent * n // 100)).bit_length() - 1, top + 1):
                for errors, key in entries(token, df, level, most + 1 - u):
                    for column, x in zip(out, (key, k, n, u, level == top and errors + u <= fewer), strict=True):
                        column.append(x)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.bool_())], names=["key", "k", "n", "u", "small"])

    return map_batches(nodes.select("k", "n", "u", "t"), run, "key bigint, k bigint, n bigint, u bigint, small boolean")


def overlaps(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, b, common): the number of shingles that both nodes of a pair have, by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lru_cache(64)(lambda text: frozenset(shingles(text, width)))
        for batch in batches:
            common = [len(held(x) & held(y)) for x, y in zip(raw_texts(batch, "x"), raw_texts(batch, "y"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64())], names=["a", "b", "common"])

    texts = small_or_shuffled(texts, BROADCAST_ROWS, F.octet_length("text"))
    both = pairs.join(texts.select(F.col("k").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("k").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, common bigint")


def _room(common: str, a: str, b: str, percent: int) -> str:
    """Whether so many common shingles make sets of a and b shingles similar: 100 common >= percent (a + b - common)."""
    return f"{100 + percent} * ({common}) >= {percent} * ({a} + {b})"


def links(texts: DataFrame, nodes: DataFrame, hot: np.ndarray, total: int, width: int, percent: int) -> DataFrame:
    """(a, b): pairs of nodes (k, n, m) that are similar and connect all that similar pairs connect."""
    buckets = LEAST_BUCKETS
    while buckets * BUCKET < total:
        buckets *= 2
    shared = postings(texts, buckets, hot, width).groupBy("bucket").applyInPandas(shared_tokens, "k bigint, token bigint, df int")
    held = shared.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))  # of one document
    u = F.col("m") - F.size("t")
    alive = cut(held.join(nodes, "k").select("k", "n", u.alias("u"), "t").where(f"100 * (n - u) >= {percent} * n"))
    own = cut(texts.join(small_or_shuffled(alive.select("k"), BROADCAST_ROWS), "k").dropDuplicates(["k"]))
    entry = cut(prefixes(alive, percent))
    led = entry.groupBy("key").agg(F.min(F.struct((F.col("u") / F.col("n")).alias("x"), "k")).alias("h"), F.count(F.lit(1)).alias("c"), F.max("small").alias("any"))
    led = cut(led.where("c > 1 and any").select("key", F.col("h.k").alias("head")))
    member = cut(entry.join(small_or_shuffled(led, BROADCAST_ROWS), "key").where("k <> head"))
    met = cut(overlaps(member.select(F.col("k").alias("a"), F.col("head").alias("b")).distinct(), own, width))
    sizes = alive.select("k", "n")
    near = met.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").where(_room("common", "na", "nb", percent)).select("a", "b")
    near = cut(near)
    root = cut(components(near))
    rooted = member.join(small_or_shuffled(root.toDF("k", "root"), BROADCAST_ROWS), "k", "left").withColumn("root", F.coalesce("root", "k"))
    known = rooted.join(small_or_shuffled(met.toDF("k", "head", "c"), BROADCAST_ROWS), ["k", "head"]).drop("head")
    several = known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("small").alias("any")).where("low <> high and any").select("key")
    rest = cut(known.join(several, "key").withColumn("r", F.expr("n - c - u")))
    a = rest.where("small").select("key", *(F.col(x).alias(f"{x}1") for x in ("k", "n", "c", "r", "root")))
    b = rest.select("key", *(F.col(x).alias(f"{x}2") for x in ("k", "n", "c", "r", "root")))
    apart = f"root1 <> root2 and (n1 < n2 or (n1 = n2 and k1 < k2)) and 100 * n1 >= {percent} * n2 and " + _room("least(c1, c2) + least(r1, r2)", "n1", "n2", percent)
    pairs = a.join(b, "key").where(apart).select(F.col("k1").alias("a"), F.col("k2").alias("b"), "n1", "n2").distinct()
    pairs = cut(pairs)
    if pairs.isEmpty():
        return near
    more = pairs.join(cut(overlaps(pairs.select("a", "b"), own, width)), ["a", "b"]).where(_room("common", "n1", "n2", percent)).select("a", "b")
    return near.union(more)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles, component_id) of each row of docs.

    A row's set is its distinct shingles of ``width`` words, A-Z lower-cased; of fewer words the whole sequence. Rows link if the sets' Jaccard
    similarity is ``percent`` or more; component_id is the smallest id reachable by links, the row's own included. Null texts and those without words have
    an empty set and link with nothing. A null id isn't a component_id unless nothing else is there; repeated rows stay
    repeated and link; texts of any length count whole; an empty table gives an empty one; other columns are ignored.
    """
    found = cut(digested(docs, id_col, text_col, width))
    rows = found.where("sid is not null").select("at", F.col("at.id").alias("id"), "sid", "n", "m")
    often = found.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen"))
    of = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("m"), F.lit(0)).alias("tokens")).first()
    most = often.where(F.col("seen") * HOT >= of.rows)  # at most HOT times the mean size of a set
    hot = np.sort(np.array([r.token for r in most.select("token").collect()], np.int64).view(np.uint64))
    by_sid = rows.where("n > 0").groupBy("sid").agg(F.min("n").alias("n"), F.min("m").alias("m"), F.min("at").alias("at"), F.min("id").alias("first"))
    nodes = cut(by_sid.withColumn("k", F.monotonically_increasing_id()))  # written, so that numbers stay
    linked = nodes.where(f"100 * n >= {percent} * (n + 1)").select("k", "n", "m", "at")  # smaller sets are similar to equal ones only
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("th")).alias("at"), text.alias("text"))
    texts = keyed.join(small_or_shuffled(linked.select("k", "at"), BROADCAST_ROWS), "at").select("k", "text")
    root = cut(components(links(texts, linked, hot, of.tokens, width, percent)))
    rooted = nodes.join(small_or_shuffled(root.toDF("k", "root"), BROADCAST_ROWS), "k", "left").select("sid", "first", F.coalesce("root", "k").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(rooted.join(least, "root").select("sid", "component_id"))
    some = rows.where("n > 0").join(small_or_shuffled(named, BROADCAST_ROWS), "sid").select("id", "n", "component_id")
    none = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return some.union(none).toDF(id_col, *fresh(docs.select(id_col), "n_shingles", "component_id"))


#: The same rows by all pairs with a common shingle, for DuckDB.
ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(least.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = w.doc_id
"""
