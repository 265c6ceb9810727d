"""Order over all rows without gathering them: running sums by ranges of a key, and exact quantiles by refining ranges.

Both deal rows out by cut points that come from a mergeable sketch. Sketches only decide where ranges lie; what is returned
comes from exact counts and sums, so that results don't depend on them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Keys of a range, about, and the most ranges that are made.
RANGE_ROWS, MOST_RANGES = 100_000, 10_000
#: A sketch's relative accuracy in ranks is one in so many; rows of a bracket whose values the driver takes.
ACCURACY, FEW = 10_000, 10_000


def range_of(value: Column, points: list, strict: bool = False) -> Column:
    """How many of the ascending points are at most ``value`` (strict: below it), by bisection."""
    if not points:
        return F.lit(0)
    under = (lambda x: x < value) if strict else (lambda x: x <= value)
    held, steps = F.array(*[F.lit(p) for p in points]), F.array(*[F.lit(1 << k) for k in reversed(range(len(points).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(points)) & under(F.get(held, at + s - 1)), at + s).otherwise(at))


def cut_points(df: DataFrame, key: str, range_rows: int = RANGE_ROWS) -> list:
    """Ascending values of a numeric column that leave about range_rows rows between them; none for few rows."""
    return counted_cut_points(df, key, range_rows)[1]


def counted_cut_points(df: DataFrame, key: str, range_rows: int = RANGE_ROWS) -> tuple[int, list]:
    """The rows of df, and cut_points()."""

    def sketch(ranges: int) -> Column:
        return F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 20 * ranges)

    rows, n, points = df.agg(F.count(F.lit(1)), F.count(key), sketch(1_000)).first()
    ranges = min(MOST_RANGES, -(-n // range_rows))
    if ranges > 1_000:
        return rows, sorted(set(df.agg(sketch(ranges)).first()[0]))
    return rows, sorted({points[999 * k // ranges] for k in range(1, ranges)})


def running_sums(df: DataFrame, key: str, sums: list[str], by: list[str] | None = None, range_rows: int = RANGE_ROWS, points: list | None = None) -> DataFrame:
    """df with ``<name>_before`` for each of ``sums``: the sum over the rows of a smaller key, of the same ``by`` if given.

    Each (by, key) is one row, as a groupBy leaves them, so that no key is hot. Rows are summed up within ranges of about
    range_rows keys; to these come the sums of all ranges before, of which there are as many as ranges. ``points`` that lie
    about so are taken as given, which saves a pass over df.
    """
    by, points = by or [], cut_points(df, key, range_rows) if points is None else points
    if not points:  # one range
        all_before = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(c).over(all_before), F.lit(0)).alias(f"{c}_before") for c in sums])
    ranged = df.withColumn("_range", range_of(F.col(key), points))
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0)).alias(f"_{c}") for c in sums])
    within = Window.partitionBy(*by, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*by, "_range"]]
    both = ranged.alias("r").join(F.broadcast(offsets).alias("o"), same)
    own = both.select("r.*", *[F.col(f"o._{c}") for c in sums])
    return own.select(*df.columns, *[(F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_{c}")).alias(f"{c}_before") for c in sums])


@dataclass(frozen=True)
class _Aim:
    """A rank (from 0) of a column, whose value lies in [least, most]: ``below`` rows lie before, ``held`` inside."""

    column: str
    rank: int
    least: float
    most: float
    below: int
    held: int


def quantiles(df: DataFrame, columns: list[str], shares: list[float], few: int = FEW, accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """The exact quantiles of each column at ``shares``, with linear interpolation; null and NaN are left out, None if nothing is left.

    A sketch brackets each rank, and counts say exactly what lies below, at and between the brackets' ends. A rank at an end is found; what lies
    between is taken if it is at most ``few`` rows, and is bracketed again otherwise, without the ends, so that ties can't hold
    it up. What is kept at once are sketches, counts of brackets and ``few`` values of each: it doesn't grow with the rows.
    """
    rows = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{k}") for k, c in enumerate(columns)]).persist()
    first = rows.agg(*[f(f"c{k}").alias(f"{n}{k}") for k in range(len(columns)) for n, f in (("n", F.count), ("a", F.min), ("b", F.max))]).first()
    size = [first[f"n{k}"] for k in range(len(columns))]
    aims, known = [], {}
    for k, n in enumerate(size):
        at = {int((n - 1) * s) for s in shares} | {min(int((n - 1) * s) + 1, n - 1) for s in shares} if n else set()
        aims += [_Aim(f"c{k}", rank, first[f"a{k}"], first[f"b{k}"], 0, n) for rank in sorted(at)]
    while aims:
        aims = _refined(rows, aims, known, few, accuracy)
    rows.unpersist()
    out: dict[str, list[float | None]] = {}
    for k, c in enumerate(columns):
        out[c] = []
        for h in [(size[k] - 1) * s for s in shares]:
            low, high = (known[f"c{k}", int(h)], known[f"c{k}", min(int(h) + 1, size[k] - 1)]) if size[k] else (None, None)
            out[c].append(low if low == high else low + (high - low) * (h - int(h)))
    return out


def _refined(rows: DataFrame, aims: list[_Aim], known: dict[tuple[str, int], float], few: int, accuracy: int) -> list[_Aim]:
    """The aims that remain after a round, in narrower brackets; values that the round finds go to ``known``."""
    same: dict[tuple[str, float, float], list[_Aim]] = {}
    for a in aims:
        same.setdefault((a.column, a.least, a.most), []).append(a)
    sketches = []
    for (column, least, most), own in same.items():
        share, room = [(a.rank - a.below + 0.5) / a.held for a in own], 2 / accuracy
        wanted = [x for s in share for x in (max(0.0, s - room), min(1.0, s + room))]
        sketches.append(F.percentile_approx(F.when(F.col(column).between(least, most), F.col(column)), wanted, accuracy))
    found = rows.agg(*[s.alias(f"s{k}") for k, s in enumerate(sketches)]).first()
    bracket = {a: (found[k][2 * j], found[k][2 * j + 1]) for k, own in enumerate(same.values()) for j, a in enumerate(own)}
    edges = {c: sorted({e for a, pair in bracket.items() if a.column == c for e in (*pair, a.least, a.most)}) for c in {a.column for a in aims}}

    def place(c: str) -> Column:
        """2i - 1 at edge i (from 1), 2i between it and the next."""
        at = range_of(F.col(c), edges[c])
        return F.when(F.col(c).isNotNull(), 2 * at - F.when((at > 0) & (F.get(F.array(*[F.lit(e) for e in edges[c]]), at - 1) == F.col(c)), 1).otherwise(0))

    placed = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), place(c).alias("p"), F.col(c).alias("v")) for c in edges])).alias("x")).select("x.*").where("p is not null")
    n: dict[str, dict[int, int]] = {c: {} for c in edges}
    for r in placed.groupBy("c", "p").agg(F.count(F.lit(1)).alias("n")).collect():
        n[r.c][r.p] = r.n
    left, wanted = [], []
    for a, (low, high) in bracket.items():
        own = n[a.column]
        i, j = (edges[a.column].index(e) + 1 for e in (low, high))
        before, at_low = sum(v for p, v in own.items() if p < 2 * i - 1), own.get(2 * i - 1, 0)
        between, at_high = sum(v for p, v in own.items() if 2 * i - 1 < p < 2 * j - 1), own.get(2 * j - 1, 0)
        if before <= a.rank < before + at_low:
            known[a.column, a.rank] = low
        elif before + at_low <= a.rank < before + at_low + between:
            left.append(replace(a, least=math.nextafter(low, math.inf), most=math.nextafter(high, -math.inf), below=before + at_low, held=between))
            wanted += [(a.column, p) for p in own if 2 * i - 1 < p < 2 * j - 1] if between <= few else []
        elif before + at_low + between <= a.rank < before + at_low + between + at_high:
            known[a.column, a.rank] = high
        else:  # the sketch was off: halve the bracket by value
            middle = a.least + (a.most - a.least) / 2
            under = rows.where(F.col(a.column) <= middle).count()
            left.append(replace(a, most=middle, held=under - a.below) if a.rank < under else replace(a, least=math.nextafter(middle, math.inf), below=under, held=a.below + a.held - under))
    if wanted:
        near = placed.join(F.broadcast(rows.sparkSession.createDataFrame(sorted(set(wanted)), "c string, p int")), ["c", "p"])
        values: dict[str, list[tuple[float, int]]] = {c: [] for c in edges}
        for r in near.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).collect():
            values[r.c].append((r.v, r.n))
        for a in left:
            seen = a.below
            for v, m in sorted(x for x in values[a.column] if a.least <= x[0] <= a.most) if a.held <= few else ():
                if seen <= a.rank < seen + m:
                    known[a.column, a.rank] = v
                seen += m
    return [a for a in left if (a.column, a.rank) not in known]
