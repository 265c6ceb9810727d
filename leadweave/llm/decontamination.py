"""Benchmark decontamination: MinHash containment search for short test items inside long documents.

Jaccard signatures of long documents say nothing about a short item within, so the sketch is the item's: of its
shingles the m of least hash. Items are partitioned by size, and m is made for a partition's largest
item so that an item of which at least the threshold is contained can't miss all of its sketch: with
q shingles and m > (1 - t) q, one of any m must be in the document. Documents look all their shingles up
in the sketches; what is found is verified by exact containment of shingles, as strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, cut, fresh, small_or_shuffled
from .text import plain_words

SHINGLE, THRESHOLD = 5, 0.8
#: Width of a size partition of items, as a ratio of shingle counts.
SIZE_STEP = 1.5


def _windows(words: str, width: int, of: str) -> Column:
    """All windows of ``width`` words of a column: their hashes or their strings. Empty if there are fewer words."""
    at = lambda x, i: [x if k == 0 else F.get(F.col(words), i + F.lit(k)) for k in range(width)]
    made = (lambda x, i: F.xxhash64(*at(x, i))) if of == "hash" else (lambda x, i: F.concat_ws(" ", *at(x, i)))
    n = F.size(words)
    return F.when(n >= width, F.slice(F.transform(F.col(words), made), F.lit(1), F.greatest(n - F.lit(width - 1), F.lit(1)))).otherwise(F.array().cast("array<bigint>" if of == "hash" else "array<string>"))


def items_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(item_id, k, width, hashes, shingles, q) of the items that have words; fewer than ``width`` of them are one shingle. Equal sets of shingles share k."""
    words = benchmark.select(F.col(item_col).alias("item_id"), plain_words(F.col(text_col).cast("string")).alias("w")).where("size(w) > 0")
    of = lambda kind: F.coalesce(*[F.when(F.least(F.size("w"), F.lit(width)) == k, F.array_distinct(_windows("w", k, kind))) for k in range(1, width + 1)])
    rows = words.select("item_id", F.least(F.size("w"), F.lit(width)).alias("width"), of("hash").alias("hashes"), of("string").alias("shingles"))
    ordered = F.sort_array("shingles")
    return rows.withColumn("q", F.size("shingles")).withColumn("k", F.struct(F.xxhash64("width", ordered).alias("k1"), F.xxhash64("width", ordered, F.lit(11)).alias("k2")))


def sketch_of(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(k, width, q, h): the sketch entries of each distinct item (one row for each k), as many as its size partition asks for."""
    step = F.log(F.lit(SIZE_STEP))
    largest = F.floor(F.pow(F.lit(SIZE_STEP), F.floor(F.log("q") / step + F.lit(1e-9)) + 1))
    m = F.floor(F.lit(1 - threshold) * F.greatest(largest, F.col("q")) + F.lit(1e-9)) + 1
    long = items.select("k", "width", "q", m.alias("m"), F.explode("hashes").alias("h"))
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("h", F.lit(5)), "h"))
    return long.withColumn("place", place).where("place <= m").select("k", "width", "q", "h")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_cols: list[str] | None = None, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """(*id_cols, item_id, n_found, q, containment): each row of docs with each item of which it contains ``threshold``.

    Containment is the share of an item's distinct shingles that the document has. Null and empty texts and items
    contain nothing and are in nothing; items of one id are told apart by their shingles and each gets a row,
    equal ones one row; a null item_id is an id like others; repeated rows of docs repeat their rows; an empty table on either side gives an
    empty one; other columns are ignored, and id columns that have a result's name make that get underscores behind it.
    """
    ids = id_cols or ["doc_id"]
    listed = cut(items_of(benchmark, item_col, item_text, width))
    names = cut(listed.select("k", "item_id").distinct())
    items = cut(listed.drop("item_id").dropDuplicates(["k"]))
    sketch = cut(sketch_of(items, threshold))
    widths = sorted(r[0] for r in sketch.select("width").distinct().collect())
    rows = docs.select(*[F.col(c).alias(f"_id{k}") for k, c in enumerate(ids)], F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64("text", F.lit(11))})
    words = rows.select("t1", "t2", plain_words(F.col("text")).alias("w"))
    found = None
    for k in widths:
        probes = words.where(F.size("w") >= k).select("t1", "t2", F.size("w").alias("n"), F.explode(_windows("w", k, "hash")).alias("h"))
        own = small_or_shuffled(sketch.where(F.col("width") == k).drop("width"), BROADCAST_ROWS)
        hits = probes.join(own, "h").where(F.col("n") - (k - 1) >= F.col("q") * F.lit(threshold) - 1e-9).select("t1", "t2", "k")
        found = hits if found is None else found.union(hits)
    if found is None:
        found = words.select("t1", "t2", F.lit(None).cast(items.schema["k"].dataType).alias("k")).limit(0)
    candidates = cut(found.groupBy("t1", "t2").agg(F.collect_set("k").alias("items")))
    near = rows.join(small_or_shuffled(candidates, BROADCAST_ROWS, F.size("items") * 16), ["t1", "t2"])
    near = near.select(*[f"_id{k}" for k in range(len(ids))], "items", plain_words(F.col("text")).alias("w"))
    have = F.create_map(*[x for k in widths for x in (F.lit(k), F.array_distinct(_windows("w", k, "string")))]) if widths else F.create_map().cast("map<int,array<string>>")
    near = near.select(*[f"_id{k}" for k in range(len(ids))], have.alias("have"), F.explode("items").alias("k"))
    exact = near.join(small_or_shuffled(items.drop("hashes"), BROADCAST_ROWS, F.size("shingles") * 60), "k")
    n_found = F.size(F.array_intersect(F.col("shingles"), F.element_at("have", F.col("width"))))
    exact = exact.select(*[f"_id{k}" for k in range(len(ids))], "k", n_found.cast("bigint").alias("n_found"), F.col("q").cast("bigint").alias("q"))
    held = exact.where(F.col("n_found") >= F.col("q") * F.lit(threshold) - 1e-9).join(small_or_shuffled(names, BROADCAST_ROWS), "k")
    item, n, q, share = fresh(docs.select(*ids), "item_id", "n_found", "q", "containment")
    return held.select(*[F.col(f"_id{k}").alias(c) for k, c in enumerate(ids)], F.col("item_id").alias(item), F.col("n_found").alias(n), F.col("q").alias(q), (F.col("n_found") / F.col("q")).alias(share))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """The rows of docs that contain no item, with all their columns: null and empty texts stay, repeated rows stay or go together."""
    text = F.col(text_col).cast("string")
    t = fresh(docs, "_t1", "_t2")
    keyed = docs.select("*", F.xxhash64(text).alias(t[0]), F.xxhash64(text, F.lit(11)).alias(t[1]))
    bad = cut(contaminated(keyed, benchmark, t, text_col, item_col, item_text, threshold, width).select(*t).distinct())
    return keyed.join(small_or_shuffled(bad, BROADCAST_ROWS), t, "left_anti").select(*docs.columns)


#: The same pairs by brute force, for DuckDB.
ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM benchmark
), widths AS (SELECT DISTINCT least(len(w), 5) AS width FROM i WHERE len(w) > 0),
ds AS (
  SELECT DISTINCT doc_id, width, array_to_string(w[k : k + width - 1], ' ') AS s
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS k FROM w CROSS JOIN widths WHERE len(w) >= width)
), s AS (
  SELECT DISTINCT item_id, width, array_to_string(w[k : k + width - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), 5) AS width, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS k FROM i WHERE len(w) > 0)
), q AS (SELECT item_id, count(*) AS q FROM s GROUP BY item_id)
SELECT ds.doc_id, s.item_id, count(*) AS n_found, any_value(q.q) AS q, count(*) / any_value(q.q) AS containment
FROM ds JOIN s USING (width, s) JOIN q USING (item_id)
GROUP BY ds.doc_id, s.item_id HAVING count(*) >= 0.8 * any_value(q.q) - 1e-9
"""
