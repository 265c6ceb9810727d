"""Importance resampling towards a target: documents are drawn by how much likelier their n-grams are in the target's texts.

Words stand in a position table, a row each; window leads over a document concatenate the words that follow, for
each order. Texts are dealt out by a key of their row before words are made, so that the windows need no shuffle of words.
Buckets of features are written once: counted over the corpus, and joined to the gains.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh

#: What stands between words, once A-Z count as letters.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
ORDERS, BUCKETS, SHARE, LEAST_WORDS, SEED = 2, 10_000, 25, 20, 7
#: Bytes of text whose words a task sorts at once, about.
TASK_BYTES = 8 << 20


def lowered(word: Column) -> Column:
    """The word with a-z for A-Z and all else as it is; words of ASCII take the short way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def features(rows: DataFrame, id_col: str, text_col: str, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(id, th, source, copy, f1, f2, ...): a row for each word, with the bucket of the n-gram of each order that starts there; one row of nulls for a text without words.

    th, source and copy tell rows of one id apart: the text's hash, the input partition, and a number within these. A row's words are
    thus never together with those of rows of other input partitions, however often an id or a whole row is repeated.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = rows.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"), F.spark_partition_id().alias("source"))
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES + 1)
    dealt = own.repartition(parts, "id", "th", "source")
    row = ["id", "th", "source", "copy"]
    numbered = dealt.withColumn("copy", F.row_number().over(Window.partitionBy("id", "th", "source").orderBy("th")))
    words = numbered.select(*row, F.posexplode_outer(F.array_remove(F.split("text", SEPARATORS), "")).alias("pos", "w")).withColumn("w", lowered(F.col("w")))
    along = Window.partitionBy(*row).orderBy("pos")
    follow = [F.lead("w", k).over(along).alias(f"w{k}") for k in range(1, orders)]
    out, gram = words.select(*row, "w", *follow), F.col("w")
    columns = []
    for k in range(1, orders + 1):
        columns.append((F.crc32(gram.cast("binary")) % buckets).cast("int").alias(f"f{k}"))
        gram = F.concat(gram, F.lit(" "), F.col(f"w{k}"))  # null beyond the last word
    return out.select(*row, *columns)


def bucket_counts(table: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(bucket, n): the features of each bucket, which has at least one."""
    each = table.select(F.explode(F.array(*[f"f{k}" for k in range(1, orders + 1)])).alias("bucket")).where("bucket is not null")
    return each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: a thousand times the log of its smoothed share in the target over that in the corpus, floored."""
    spark = corpus.sparkSession
    s, t = corpus.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    whole = F.sum("s").over(Window.partitionBy()), F.sum("t").over(Window.partitionBy())  # over as many rows as buckets
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    d = lambda c: c.cast("double")
    ratio = (d(F.col("t")) + 1) * (d(whole[0]) + buckets) / ((d(F.col("s")) + 1) * (d(whole[1]) + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS,
    seed: int = SEED, orders: int = ORDERS, buckets: int = BUCKETS,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of each row of docs; rank counts the drawn rows from 1, and is null for the others.

    weight is the floored mean of the gains of all n-grams of 1 to ``orders`` words, 0 without words; score adds a Gumbel draw by a hash of seed
    and id, so that the highest scores are a sample without replacement. Drawn are ``share`` percent of the rows with ``least_words`` words, ties to smaller ids. Null texts are
    empty; a null id has no draw: its score is null, it isn't drawn and isn't counted among those to draw from. Repeated rows are documents of
    their own with equal scores; an empty docs gives an empty table, an empty target no feature; other columns are ignored.

    Ranks come from counts by score, which is an integer: there are as many of them as gains have range, a few ten thousands, however many rows there are.
    """
    table = cut(features(docs, id_col, text_col, orders, buckets))
    gained = cut(gains(bucket_counts(table, orders), bucket_counts(features(target, target_id, target_text, orders, buckets), orders), buckets))
    summed = table
    for k in range(1, orders + 1):  # a row for each bucket: the broadcast has a fixed size
        summed = summed.join(F.broadcast(gained.select(F.col("bucket").alias(f"f{k}"), F.col("gain").alias(f"g{k}"))), f"f{k}", "left")
    columns = range(1, orders + 1)
    n = sum((F.count(f"f{k}") for k in columns), F.lit(0))
    total = sum((F.coalesce(F.sum(f"g{k}"), F.lit(0)) for k in columns), F.lit(0))
    by_row = summed.groupBy("id", "th", "source", "copy").agg(F.count("f1").alias("n_words"), n.cast("bigint").alias("n_features"), total.cast("bigint").alias("total"))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("bigint")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    draw = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = cut(by_row.select("id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + draw))
    eligible = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    by_score = cut(scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")))
    take = share * (by_score.agg(F.sum("n")).first()[0] or 0) // 100
    ahead = F.sum("n").over(Window.orderBy(F.col("score").desc())) - F.col("n")  # over distinct integers
    places = cut(by_score.select("score", ahead.alias("ahead")).where(F.col("ahead") < take))
    cutoff = places.agg(F.min("score")).first()[0]
    top = eligible & (F.col("score") >= cutoff) if cutoff is not None else F.lit(False)
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("score").orderBy("id"))
    ranked = scored.where(top).join(F.broadcast(places), "score").withColumn("rank", F.when(place <= take, place))
    rest = scored.where(~F.coalesce(top, F.lit(False))).withColumn("rank", F.lit(None).cast("bigint"))
    out = ranked.select("id", "n_features", "weight", "score", "rank").union(rest.select("id", "n_features", "weight", "score", "rank"))
    return out.toDF(id_col, *fresh(docs.select(id_col), "n_features", "weight", "score", "rank"))


#: The same rows for DuckDB, which has no crc32: a table of 256 remainders, and a step for each byte of each distinct feature.
ORACLE_SQL = """
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
words AS MATERIALIZED (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)
), grams AS MATERIALIZED (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS g FROM words
), hashed AS MATERIALIZED (
  SELECT g, xor(list_reduce(list_transform(range(octet_length(encode(g))), lambda k: CAST(('0x' || substr(hex(encode(g)), 2 * k + 1, 2)) AS BIGINT)),
    lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT g FROM grams), crc
), counts AS (
  SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM grams JOIN hashed USING (g) GROUP BY bucket
), sums AS (SELECT sum(s) AS s, sum(t) AS t FROM counts),
gain AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln((CAST(c.t AS DOUBLE) + 1) * (CAST(sums.s AS DOUBLE) + 10000) / ((CAST(c.s AS DOUBLE) + 1) * (CAST(sums.t AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM counts c, sums
), means AS (SELECT id, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM grams JOIN hashed USING (g) JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (
  SELECT id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('7:' || id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN means USING (id) WHERE side = 0
), ranked AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored WHERE n_words >= 20)
SELECT id AS doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (id)
"""
