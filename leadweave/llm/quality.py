"""Quality rules whose cut-offs come from the data: mergeable quantile sketches per language and source.

A sketch counts values in buckets of equal relative width (a log-bucket histogram), so that sketches of parts
merge by adding counts and give the same quantiles however the rows are split up. A rule's cut-off in a group lies
FENCE interquartile ranges above the upper quartile of the group's values; ratios of repetition, which most texts have none
of, leave out zeros for that, and the others have SLACK on top, for groups that are all alike. Groups lean on what they are part
of: a cut-off is the mean of the group's own, weighed by its rows, and its language's, weighed as PRIOR rows; the
language's own leans on all rows in the same way.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, BROADCAST_ROWS, cut, fresh, map_batches, mix, raw_texts, rolling

#: The base rules' fixed values.
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW, SYMBOLS = 20, 30, 8, b"#*$%&|<>"
#: Relative width of a sketch's buckets, the fence, the rows that a wider group counts as, and the slack. A bucket holds the zeros.
WIDTH, FENCE, PRIOR, SLACK, ZERO = 1.02, 6.0, 50.0, 0.01, -(10**6)
#: Salts for the hot groups of a threshold join that is too large to broadcast.
SALTS = 32


@dataclass(frozen=True)
class Rule:
    """A ratio that may not be above its group's cut-off; zeros: whether its sketch counts them."""

    name: str
    above: str
    below: str
    zeros: bool = True


RULES = (
    Rule("symbols", "n_symbols", "word_chars"),
    Rule("upper", "n_upper", "word_chars"),
    Rule("punctuation", "n_punct", "word_chars"),
    Rule("word_length", "word_chars", "n_words"),
    Rule("dup_lines", "n_dup_lines", "n_lines", zeros=False),
    Rule("repeats", "n_repeat_words", "n_words", zeros=False),
    Rule("stutter", "n_stutter", "n_words", zeros=False),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct", "n_stutter")
_CONTINUATION, _UPPER = bytes(range(0x80, 0xC0)), bytes(range(65, 91))
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def count(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text (UTF-8)."""
    words = text.split()
    joined = b"".join(words)
    without = lambda chars: len(joined) - len(joined.translate(None, chars))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    return (len(words), len(joined) - without(_CONTINUATION), without(SYMBOLS), dup, repeated_words(words), lines, without(_UPPER), without(_PUNCT), sum(map(eq, words, words[1:])))


def repeated_words(words: list[bytes], width: int = REPEAT_WINDOW) -> int:
    """Words within windows of ``width`` words that are found twice or more, first ones included."""
    if len(words) <= width:
        return 0
    numbers: dict[bytes, int] = {}
    own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    with np.errstate(over="ignore"):
        h = rolling(mix(own.view(np.uint64) + np.uint64(1)), width)
    order = np.argsort(h, kind="stable")
    a, b = order[:-1], order[1:]
    same = h[a] == h[b]
    if not same.any():
        return 0
    a, b = a[same], b[same]
    if not all(np.array_equal(own[a + k], own[b + k]) for k in range(width)):  # two windows share a hash: count by the words themselves
        at: dict[tuple, list[int]] = {}
        for k in range(len(h)):
            at.setdefault(tuple(own[k : k + width].tolist()), []).append(k)
        a = b = np.array([k for places in at.values() if len(places) > 1 for k in places], np.int64)
    twice = np.zeros(len(h), bool)
    twice[a] = twice[b] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[np.flatnonzero(twice)] += 1
    edge[np.flatnonzero(twice) + width] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counted(rows: DataFrame, text_col: str, name: str) -> DataFrame:
    """rows with COUNTS of their text in a struct column ``name``; texts are counted whole, a slice of rows at a time."""
    own = rows.columns
    at = own.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [count(t) for t in raw_texts(batch, f"c{at}")]
        columns = [pa.array([r[k] for r in found], pa.int64()) for k in range(len(COUNTS))]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *COUNTS])

    numbered = rows.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(own)])
    schema = ", ".join([*(f"c{k} {kind}" for k, (_, kind) in enumerate(numbered.dtypes)), *(f"{c} bigint" for c in COUNTS)])
    return map_batches(numbered, run, schema).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(own)], F.struct(*COUNTS).alias(name))


def base_failed(n: str) -> Column:
    return (F.col(f"{n}.n_words") < MIN_WORDS) | (100 * F.col(f"{n}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{n}.n_words"))


def value(rule: Rule, n: str) -> Column:
    low = F.col(f"{n}.{rule.below}")
    return F.when(low > 0, F.col(f"{n}.{rule.above}") / low).otherwise(F.lit(0.0))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n) over the rows of ``measured`` (lang, source, n) that pass the base rules."""
    long = measured.where(~base_failed("n")).select("lang", "source", F.inline(F.array(*[F.struct(F.lit(r.name).alias("rule"), value(r, "n").alias("v")) for r in RULES])))
    bucket = F.when(F.col("v") <= 0, F.lit(ZERO)).otherwise(F.ceil(F.log(F.col("v")) / F.log(F.lit(WIDTH))).cast("int"))
    return long.groupBy("lang", "source", "rule", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _fences(sketch: DataFrame, keys: list[str], level: str) -> DataFrame:
    """(*keys, rule, <level>_n, <level>): the rows that count and the cut-off of each merged sketch (0 and null if it has none)."""
    counts = (F.col("bucket") > ZERO) | F.col("rule").isin([r.name for r in RULES if r.zeros])
    merged = sketch.where(counts).groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "rule")
    ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    mid = F.when(F.col("bucket") > ZERO, F.pow(F.lit(WIDTH), F.col("bucket"))).otherwise(F.lit(0.0))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), mid))
    slack = F.when(F.col("rule").isin([r.name for r in RULES if r.zeros]), F.lit(SLACK)).otherwise(F.lit(0.0))
    found = ranked.groupBy(*keys, "rule").agg(F.max("total").alias(f"{level}_n"), at(0.25).alias("low"), at(0.75).alias("high"))
    limits = found.select(*keys, "rule", f"{level}_n", (F.col("high") + F.lit(FENCE) * (F.col("high") - F.col("low")) + slack).alias(level))
    every = sketch.select(*keys, "rule").distinct()
    same = reduce(lambda x, k: x & F.col(f"e.{k}").eqNullSafe(F.col(f"f.{k}")), [*keys, "rule"], F.lit(True))
    return every.alias("e").join(limits.alias("f"), same, "left").select(*[f"e.{k}" for k in [*keys, "rule"]], F.coalesce(f"f.{level}_n", F.lit(0)).alias(f"{level}_n"), f"f.{level}")


def cutoffs(sketch: DataFrame) -> DataFrame:
    """(lang, source, limits: map from rule to cut-off) of every group in ``sketch``.

    Null languages and sources are groups like others. A rule has no cut-off (null) if no row counts for it.
    """
    leaning = lambda n, own, wide: F.coalesce((F.col(n) * F.col(own) + F.lit(PRIOR) * wide) / (F.col(n) + F.lit(PRIOR)), own, wide)
    wide, every = _fences(sketch, ["lang"], "wide").alias("w"), _fences(sketch, [], "every")
    by_lang = wide.join(F.broadcast(every), "rule").select("rule", "lang", leaning("wide_n", "wide", F.col("every")).alias("limit"))
    own = _fences(sketch, ["lang", "source"], "own").alias("o")
    joined = own.join(by_lang.alias("w"), F.col("o.lang").eqNullSafe(F.col("w.lang")) & (F.col("o.rule") == F.col("w.rule"))).select("o.lang", "o.source", "o.rule", leaning("own_n", "own", F.col("limit")).alias("v"))
    return joined.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("rule", "v"))).alias("limits"))


def with_cutoffs(rows: DataFrame, limits: DataFrame, lang: Column, source: Column, name: str = "_limits") -> DataFrame:
    """rows with the cut-offs of their group in column ``name``; broadcast if the groups are few, else salted against hot groups."""
    n = limits.count()
    k, salt = fresh(rows, "_k", "_salt")
    own = lambda c: F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))
    key = lambda a, b: F.concat(own(a), F.lit("\x00"), own(b)).alias(k)
    left, right = rows.select("*", key(lang, source)), limits.select(key(F.col("lang"), F.col("source")), F.col("limits").alias(name))
    if n * 300 <= BROADCAST_BYTES and n <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), k, "left").drop(k)
    place = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if rows.schema[c].dataType.simpleString() in ("bigint", "string")]), F.lit(SALTS)).cast("bigint")
    salted = right.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return left.withColumn(salt, place).join(salted, [k, salt], "left").drop(k, salt)


def verdict(n: str, limits: str = "_limits") -> Column:
    """kept: the base rules pass and no ratio is above its group's cut-off."""
    above = [F.coalesce(value(r, n) > F.col(limits)[r.name], F.lit(False)) for r in RULES]
    return ~base_failed(n) & ~F.greatest(*above)


def _group(docs: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, the five counts, base_failed, kept, and the first rule that rejected it (null if none) of each row.

    Null texts count as empty and fail the base rules; texts are counted whole; an empty table gives an empty one; repeated rows
    are judged alike, each counting in the sketches; a value equal to its cut-off passes; other columns are ignored.
    """
    rows = cut(counted(docs.select(F.col(id_col).alias("doc_id"), _group(docs, lang).alias("lang"), _group(docs, source).alias("source"), F.col(text_col).cast("string").alias("text")), "text", "n").drop("text"))
    limits = cut(cutoffs(cut(sketches(rows))))
    joined = with_cutoffs(rows, limits, F.col("lang"), F.col("source"))
    reason = F.coalesce(F.when(base_failed("n"), F.lit("base")), *[F.when(value(r, "n") > F.col("_limits")[r.name], F.lit(r.name)) for r in RULES])
    return joined.select("doc_id", *[F.col(f"n.{c}").alias(c) for c in COUNTS[:5]], base_failed("n").alias("base_failed"), verdict("n").alias("kept"), reason.alias("rejected_by"))


def filter_documents(docs: DataFrame, text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns; texts are read twice and never shuffled.

    Null texts go, as those of too few words; an empty table gives an empty one; repeated rows stay or go together;
    columns may have any names. Without a language or source column all rows count as of one.
    """
    grouped = counted(docs.select(_group(docs, lang).alias("lang"), _group(docs, source).alias("source"), F.col(text_col).cast("string").alias("text")), "text", "n").drop("text")
    limits = cut(cutoffs(cut(sketches(grouped))))
    n, own = fresh(docs, "_n", "_limits")
    rows = counted(docs.withColumn(text_col, F.col(text_col).cast("string")), text_col, n)
    return with_cutoffs(rows, limits, _group(docs, lang), _group(docs, source), own).where(verdict(n, own)).select(*docs.columns)


__all__ = ["Rule", "RULES", "count", "counted", "cutoffs", "filter_documents", "judge", "sketches"]
