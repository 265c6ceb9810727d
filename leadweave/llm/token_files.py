"""Token ids as flat files of unsigned integers with 64-bit document offsets, written in parts and memory-mapped.

A part NNNNN is three files: .bin, the ids of its documents on end (little-endian, 16 bits if the vocabulary
allows it, else 32); .off, one 64-bit offset into .bin for each document and one for the end, counted from the
part's own start; .doc, the document ids as 64-bit integers. Parts are in ascending order of document ids; the
ids before a part are the sum of the lengths of the parts before it.
"""

from __future__ import annotations

import os
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from math import ceil
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, raw_texts, shared_dir, slices

#: Words whose ids a worker keeps; the characters it gives the library at once.
WORDS, BLOCK = 500_000, 50_000
#: Bytes of text that a part holds, about.
PART = 256 << 20


class WordEncoder:
    """The library's ids for texts, put together from the ids of their words.

    White space never is part of a token of this vocabulary, and neither normaliser nor pre-tokeniser looks
    across it, so that words can be encoded apart. A run of Latin-1 letters, lower-cased and with its bytes
    mapped to characters as the pre-tokeniser maps them, is one unit of the library's BPE model, which is asked
    directly; a single mark behind it is a unit of its own. Other new words go to the library in blocks. With ``special``,
    special tokens that stand in the text are matched, which is the library's own way; without, they are text.
    """

    def __init__(self, path: str, end: int, special: bool = True) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        self.model = self.library.model
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 and end < 1 << 16 else "<u4")
        self.end = np.array([end], self.dtype).tobytes()
        self.known: dict[bytes, bytes] = {}
        self.letters: dict[str, bytes] = {}
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.mapped = {chr(c): level.pre_tokenize_str(chr(c))[0][0] for c in range(256) if chr(c).isalpha()}
        self.marks = {m: self._library(m) for m in ".,;:!?"}

    def _library(self, text: str) -> bytes:
        return self._bytes(self.library.encode(text, add_special_tokens=False).ids)

    def _bytes(self, ids: list[int]) -> bytes:
        out = array("H" if self.dtype.itemsize == 2 else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _simple(self, word: bytes) -> bytes | None:
        """The ids of Latin-1 letters with at most one mark behind them; None for any other word."""
        text = word.decode("utf-8")
        mark = self.marks.get(text[-1])
        base = text[:-1] if mark else text
        if not base.isalpha() or max(base) > "\xff":
            return None
        base = base.lower()
        ids = self.letters.get(base)
        if ids is None:
            unit = base if base.isascii() else "".join(map(self.mapped.__getitem__, base))
            ids = self._bytes([t.id for t in self.model.tokenize(unit)])
            if len(self.letters) >= WORDS:
                self.letters = {}
            self.letters[base] = ids
        return ids + mark if mark else ids

    def learn(self, words: set[bytes]) -> None:
        """Get the ids of new words."""
        block: list[bytes] = []
        size = 0
        for word in words:
            simple = self._simple(word)
            if simple is not None:
                self.known[word] = simple
                continue
            if block and size > BLOCK:
                self._learn(block)
                block, size = [], 0
            block.append(word)
            size += len(word) + 1
        if block:
            self._learn(block)

    def _learn(self, block: list[bytes]) -> None:
        texts = [w.decode("utf-8") for w in block]
        starts = np.fromiter(accumulate((len(t) + 1 for t in texts[:-1]), initial=0), np.int64, len(texts))
        found = self.library.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(found.ids, self.dtype)
        at = np.searchsorted(np.array([a for a, _ in found.offsets], np.int64), starts)
        for word, a, b in zip(block, at.tolist(), [*at[1:].tolist(), len(ids)], strict=True):
            self.known[word] = ids[a:b].tobytes()

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, with the end id, as bytes."""
        words = [t.split() for t in texts]
        every = set().union(*words)
        fresh = every - self.known.keys()
        if len(self.known) + len(fresh) > WORDS:
            fresh, self.known = every, {}
        self.learn(fresh)
        for own in words:
            yield b"".join(map(self.known.__getitem__, own)) + self.end


@lru_cache(maxsize=1)
def encoder(path: str, end: int, special: bool = True) -> WordEncoder:
    return WordEncoder(path, end, special)


def local_folder(url: str) -> Path:
    """The mounted path of a shared folder; other stores cannot be memory-mapped."""
    parts = urlparse(url)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"token files are memory-mapped and need a mounted shared folder, not {url}")
    return Path(parts.path)


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text", special: bool = True) -> DataFrame:
    """Write the token files of docs to ``folder`` (shared by all executors); (part, n_docs, n_null, n_tokens) of each part.

    Rows are dealt out by ranges of (id, hash of the text) and sorted, before they are encoded, so that texts are
    shuffled once, into as many parts as their bytes ask for. Ids are numbers of 64 bits (others fail as casts do). Null ids come first and are counted in n_null; null texts are empty and have the end id only; repeated
    rows stay. A task writes under a name of its own and renames at the end, so that a repeated task replaces equal files.
    """
    at = local_folder(folder)
    at.mkdir(parents=True, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        names = {kind: (at / f"{part:05d}.{attempt}.{kind}.tmp", at / f"{part:05d}.{kind}") for kind in ("bin", "off", "doc")}
        coder = encoder(tokenizer, end, special)
        total = n = null = 0
        with open(names["bin"][0], "wb") as ids, open(names["off"][0], "wb") as offsets, open(names["doc"][0], "wb") as doc_ids:
            offsets.write(np.zeros(1, "<u8").tobytes())
            for batch in (b for whole in batches for b in slices(whole)):
                lengths = [ids.write(x) // coder.dtype.itemsize for x in coder.encode(raw_texts(batch))]
                offsets.write((total + np.cumsum(lengths)).astype("<u8").tobytes())
                column = batch.column(0)
                doc_ids.write(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                total, n, null = total + sum(lengths), n + len(lengths), null + column.null_count
        for own, final in names.values():
            os.replace(own, final)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, n, null, total)], names=["part", "n_docs", "n_null", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(size / PART))
    dealt = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return cut(dealt.mapInArrow(run, "part bigint, n_docs bigint, n_null bigint, n_tokens bigint"))


def read(parts: DataFrame, folder: str, dtype: str = "<u2", fold: int = 20_000) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files of ``parts`` (what write() returned).

    The parts' lengths, one row a part, are summed up on the driver to the parts' bases. Each part is mapped, not
    loaded, and read in runs of ``fold`` documents.
    """
    at = local_folder(folder)
    sizes = sorted((r.part, r.n_docs, r.n_null, r.n_tokens) for r in parts.collect())
    bases = list(accumulate((s[3] for s in sizes), initial=0))
    runs = [(p, first, min(fold, n - first), max(0, null - first), base) for (p, n, null, _), base in zip(sizes, bases, strict=False) for first in range(0, n, fold)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                part, first, n, null, base = (x[k] for k in ("part", "first", "n", "n_null", "base"))
                ids = np.memmap(at / f"{part:05d}.bin", dtype, "r")
                offsets = np.memmap(at / f"{part:05d}.off", "<u8", "r")[first : first + n + 1].astype(np.int64)
                doc_ids = np.memmap(at / f"{part:05d}.doc", "<i8", "r")[first : first + n]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                columns = [pa.array(np.array(doc_ids), mask=np.arange(n) < null), pa.array(offsets[:-1] + base), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = parts.sparkSession
    table = spark.createDataFrame(runs, "part bigint, first bigint, n bigint, n_null bigint, base bigint")
    spread = max(1, min(len(runs), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return table.repartition(spread).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str, end: int = 1, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", special: bool = True) -> DataFrame:
    """write() and read(); without a folder, the files go to a new one in the shared checkpoint folder."""
    folder = folder or f"{shared_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    parts = write(docs, folder, tokenizer, end, id_col, text_col, special)
    return read(parts, folder, encoder(tokenizer, end, special).dtype.str)


__all__ = ["WordEncoder", "read", "round_trip", "write"]
