"""Vector codes: each part of a vector is replaced by the nearest of a few entries learned by weighted Lloyd rounds.

Components become integers, so that equal parts are equal exactly, whatever order rows come in. Equal parts of a position are
one weighted row; rounds run over these only, and a task sends back one partial sum for each entry. Codes and errors are then
joined back to the vectors. Parts that a thousandth of the vectors share are a thousand a position at most, by counting, and
are broadcast, so that no key of the shuffled join is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, small_batches, small_or_shuffled

ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
#: Components of this magnitude or more are dropped with their vector, as non-finite ones are: squared distances of parts of up to 2,048 components then fit in 63 bits.
LARGEST = 1 << 15
#: A part is joined by broadcast if one vector in so many has it.
HOT = 1000


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry of each row (the lowest of equally near ones) and its squared distance, in exact integers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * top * top < 1 << 53 else np.int64  # doubles hold these sums exactly
    code, error, c = np.empty(len(x), np.int64), np.empty(len(x), np.int64), book.astype(kind)
    own = (c * c).sum(axis=1)
    for at in range(0, len(x), 8_192):
        part = x[at : at + 8_192].astype(kind)
        d = own - 2 * (part @ c.T)
        code[at : at + 8_192] = low = d.argmin(axis=1)
        error[at : at + 8_192] = d[np.arange(len(part)), low] + (part * part).sum(axis=1)
    return code, error


def integers(rows: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int, scale: int) -> DataFrame:
    """(id, label, v): the vectors as integers; see compress() for those that are dropped."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    kept = rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & (F.size(vector_col) % parts == 0)).where(fine)
    v = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return kept.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))


def _numbers(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def lloyd_round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries after one round over ``distinct`` (part, x, n): floored means, or what they were where no part is nearest."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            part, x, n = batch.column("part").to_numpy(), _numbers(batch, "x", width), batch.column("n").to_numpy()
            for p in range(parts):
                own = part == p
                code, _ = nearest(x[own], books[p])
                np.add.at(total[p], code, np.column_stack([n[own], x[own] * n[own, None]]))
        p, e = np.nonzero(total[:, :, 0])
        held = total[p, e]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, held.size + 1, width + 1, dtype=np.int32)), pa.array(held.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), lists], names=["part", "code", "s"])

    partial = distinct.select("part", "x", "n").mapInArrow(sums, "part int, code int, s array<bigint>")
    each = partial.select("part", "code", F.posexplode("s").alias("d", "s")).groupBy("part", "code", "d").agg(F.sum("s").alias("s"))
    total = np.zeros((parts, entries, width + 1), np.int64)
    for r in each.collect():  # at most parts * entries * (width + 1) numbers
        total[r.part, r.code, r.d] = r.s
    count = total[:, :, :1]
    return np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), books)


def compress(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """((id, label, codes, error) of each kept row, the entries as an array of parts x entries x width).

    Component x counts as floor(scale * x). A part's entries start as that part of the rows of the ``entries`` smallest ids (of fewer
    rows, all), null ids last, equal ids by their vectors; the rounds assign and average, and codes are of a last assignment. Dropped are vectors that
    are null or empty, that hold null, NaN, infinite components or ones of magnitude LARGEST, whose length is no multiple of ``parts``,
    or another than that of the smallest id. Repeated rows are kept and weigh as often. Without rows left the result is
    empty and so are the entries. Other columns are ignored.
    """
    spark = rows.sparkSession
    small_batches(spark)
    kept = cut(integers(rows, id_col, vector_col, label_col, parts, scale).withColumn("row", F.monotonically_increasing_id()))
    order = [F.col("id").asc_nulls_last(), "v"]
    first = kept.orderBy(*order).select(F.size("v").alias("width")).first()
    if first is None:
        none = kept.select("id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("bigint").alias("error"))
        return none, np.empty((parts, 0, 0), np.int64)
    same = kept.where(F.size("v") == first.width)
    width = first.width // parts
    start = np.array([r.v for r in same.orderBy(*order).limit(entries).select("v").collect()], np.int64)
    books = start.reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    long = same.select("row", "id", "label", F.posexplode(F.array(*[F.slice("v", p * width + 1, width) for p in range(parts)])).alias("part", "x"))
    distinct = cut(long.groupBy("part", "x").agg(F.count(F.lit(1)).alias("n")))
    for _ in range(rounds):
        books = lloyd_round(distinct, books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, x = batch.column("part").to_numpy(), _numbers(batch, "x", width)
            code, error = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
            for p in range(parts):
                own = part == p
                code[own], error[own] = nearest(x[own], books[p])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "x", "n")), pa.array(code), pa.array(error)], names=["part", "x", "n", "code", "error"])

    coded = cut(distinct.select("part", "x", "n").mapInArrow(assign, "part int, x array<int>, n bigint, code int, error bigint"))
    total = distinct.where("part = 0").agg(F.sum("n")).first()[0]
    hot = F.broadcast(coded.where(F.col("n") * HOT >= total).drop("n"))
    rare = coded.where(F.col("n") * HOT < total).drop("n")
    joined = long.join(hot, ["part", "x"]).unionByName(long.join(hot.select("part", "x"), ["part", "x"], "left_anti").join(rare, ["part", "x"]))
    codes = F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda c: c["code"])  # as many as there are parts
    return joined.groupBy("row", "id", "label").agg(codes.alias("codes"), F.sum("error").alias("error")).drop("row"), books


def digests(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept row, by compress(); null labels count as one label."""
    found, books = compress(rows)
    found = cut(found)
    by_label = cut(found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    joined = found.join(small_or_shuffled(by_label, BROADCAST_ROWS), F.col("label").eqNullSafe(F.col("of")))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return joined.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The same rows by distances to all entries, for DuckDB."""
    near = "min({{'d': list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'code': b.code}})"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT p.id, p.part, any_value(p.x) AS x, {near.format()} AS m FROM p JOIN b{k} b USING (part) GROUP BY p.id, p.part)")
        if k < ROUNDS:
            mean = f"SELECT part, m.code AS code, d, CAST(floor(sum(x[d]) / count(*)) AS BIGINT) AS c FROM a{k}, w, range(1, w + 1) r(d) GROUP BY part, m.code, d"
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.code, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT part, code, list(c ORDER BY d) AS c FROM ({mean}) GROUP BY part, code) n USING (part, code))")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), w AS (SELECT any_value(len(v)) // {PARTS} AS w FROM kept),
p AS MATERIALIZED (SELECT id, part, list_slice(v, part * w + 1, (part + 1) * w) AS x FROM kept, w, range({PARTS}) r(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS code, x AS c FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY id) <= {ENTRIES}),
{", ".join(steps)},
coded AS (SELECT id, string_agg(format('{{:02x}}', m.code), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY id),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, code)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (id), books
"""


ORACLE_SQL = _sql()
