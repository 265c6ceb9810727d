"""Byte-level BPE by backtracking from longest matches, in linear time, with the ids of the exact merges.

Bytes stand as Latin-1 characters in an Aho-Corasick automaton, which lists the tokens that start at each
byte. Going left to right the longest one is taken that fits behind its left neighbour: two adjacent tokens fit
if merging their joined bytes would give just these two. That test is memoised. A position from which nothing
fits is dead for good, since a prefix has one encoding, so that each position is left at most once.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_batches, raw_texts

#: Entries of a worker's memo tables.
PIECES, PAIRS = 250_000, 200_000


class Memo(dict):
    """A dict that computes what is missing. At ``limit`` entries it starts anew, and takes what is asked for again from the full one."""

    def __init__(self, compute, limit: int) -> None:
        super().__init__()
        self.compute, self.limit, self.before = compute, limit, {}

    def __missing__(self, key):
        value = self.before.get(key, self)
        if value is self:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class Coder:
    """Encodes and decodes by a table of token bytes and ranks, pieces of a pattern separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.whole: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._merged(token, rank)
                if len(parts) != 2:
                    continue  # no merges lead to it: it only stands for a piece of just these bytes
                self.halves[rank] = (parts[0], parts[1])
                self.whole[parts[0], parts[1]] = rank
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.fits = Memo(self._fits, PAIRS)
        self.piece = Memo(self._piece, PIECES)

    def _merged(self, token: bytes, below: int) -> list[int]:
        """Merges of the ranks under ``below`` applied to the bytes of a token, lowest rank and leftmost first."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[k] + parts[k + 1], below), k) for k in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Undo the later of two touching merges again and again: no merge across the seam may come earlier than what it needs."""
        left, right = pair
        before = len(self.bytes_of) + 1
        while True:
            across = self.whole.get((left, right))
            if across is not None and across < before:
                return False
            undo_left = left in self.halves and (left > right or right not in self.halves)
            if undo_left:
                before, left = left, self.halves[left][1]
            elif right in self.halves:
                before, right = right + 1, self.halves[right][0]
            else:
                return True

    def _piece(self, piece: str) -> tuple[int, ...]:
        return self.encode_piece(piece.encode("utf-8"))

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece."""
        if piece in self.ranks:
            return (self.ranks[piece],)
        starting: list[list[int]] = [[] for _ in piece]
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            starting[end - length + 1].append(token)
        out: list[int] = []
        tried: list[int] = []
        dead = bytearray(len(piece) + 1)
        at, k = 0, len(starting[0]) - 1 if piece else -1
        while at < len(piece):
            here = starting[at]
            while k >= 0:
                end = at + self.size[here[k]]
                if not dead[end] and (not out or self.fits[out[-1], here[k]]):
                    break
                k -= 1
            if k >= 0:
                out.append(here[k])
                tried.append(k)
                at = end
                k = len(starting[at]) - 1 if at < len(piece) else -1
            elif not out:
                raise ValueError("the table lacks single bytes that the text has")
            else:
                dead[at] = 1
                at -= self.size[out.pop()]
                k = tried.pop() - 1
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.piece.__getitem__, self.pattern.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    """The coder of a rank file (base64 token and rank on each line), made once in each worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    return Coder(ranks, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of each row: token ids and the bytes that decoding them gives.

    Null texts count as empty and have no ids; texts are encoded whole, whatever their length; repeated rows
    stay repeated; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(path, pattern)
        ids = [c.encode(t.decode("utf-8")) for t in raw_texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(_rows(docs, id_col, text_col), run, f"doc_id {kind}, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() reduced to digests where it runs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(path, pattern)
        decimal = Decimals.of(len(c.bytes_of))
        n, ids_sha, decoded_sha = [], [], []
        for text in raw_texts(batch):
            ids = c.encode(text.decode("utf-8"))
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(_rows(docs, id_col, text_col), run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_rows(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with all columns, where text is what decoding its ids gives, and ids and n_tokens are added (null texts stay null, with no ids).

    Where docs has columns of these names, the added ones get underscores behind theirs. Repeated rows stay repeated; an empty table gives an empty one.
    """
    names, added = docs.columns, fresh(docs, "ids", "n_tokens")
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(path, pattern)
        ids = [c.encode(t.decode("utf-8")) for t in raw_texts(batch, f"c{at}")]
        own = [None if null else c.decode(x).decode("utf-8") for x, null in zip(ids, batch.column(at).is_null().to_pylist(), strict=True)]
        columns = [pa.array(own, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())], names=[*(f"c{k}" for k in range(len(names))), "ids", "n"])

    rows = docs.select(*[(F.col(c).cast("string") if k == at else F.col(c)).alias(f"c{k}") for k, c in enumerate(names)])
    schema = ", ".join(f"c{k} {kind}" for k, (_, kind) in enumerate(rows.dtypes))
    out = map_batches(rows, run, f"{schema}, ids array<int>, n bigint")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], F.col("ids").alias(added[0]), F.col("n").alias(added[1]))


class Decimals:
    """Decimal strings of ids, made once in each worker."""

    @staticmethod
    @lru_cache(maxsize=2)
    def of(n: int) -> list[str]:
        return [str(i) for i in range(n)]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
