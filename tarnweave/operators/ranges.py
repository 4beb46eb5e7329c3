"""Range joins: pairs of intervals that overlap, by an equi-join on bins.

An interval lies in the bins that it touches, at the finest level at which those are few; a level's bins are sixteen times as
wide as those of the level below. At coarser levels it is only looked for: it has its one or two bins there too, so that it meets
the longer intervals of the other side that live there. A pair meets at the level of the longer one, in one or more bins, of which the
last that both begin before counts: so each pair comes once, without a distinct. Two intervals that are only looked for never meet,
and no interval goes to levels at which nothing of the other side lives: the coarsest bins hold all rows, and their pairs would be
the square. A bin's rows of one side are dealt to several tasks where they are many (hubs.meet()).

Cases: an interval with a null or NaN end, or whose first end is greater than its last one, overlaps nothing; ends belong to the interval,
so a point is an interval of equal ends; infinite ends are those of the largest numbers; repeated rows are pairs each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.operators import hubs

#: How many bins of a level an interval touches at most, and the ratio of the widths of two levels.
TOUCHED, RATIO = 4, 16
#: The coarsest level: a single bin beyond what 60 bits tell.
LEVELS = 24


def _bin_of(x: Column, width: float, level: Column) -> Column:
    return F.floor(x / (F.pow(F.lit(float(RATIO)), level) * width)).cast("long")


def _inside(x: str, width: float) -> Column:
    most = float(2**52) * width
    return F.greatest(F.lit(-most), F.least(F.lit(most), F.col(x).cast("double")))


def _lives(df: DataFrame, first: str, last: str, width: float, levels: int, own: str) -> DataFrame:
    """df's intervals with the level that each lives at, as `own`."""
    low, high = _inside(first, width), _inside(last, width)
    fits = [F.when(_bin_of(high, width, F.lit(k)) - _bin_of(low, width, F.lit(k)) < TOUCHED, F.lit(k)) for k in range(levels)]
    whole = F.col(first).isNotNull() & F.col(last).isNotNull() & ~F.isnan(F.col(first).cast("double")) & ~F.isnan(F.col(last).cast("double")) & (F.col(first) <= F.col(last))
    return df.filter(whole).withColumn(own, F.coalesce(*fits, F.lit(levels)))


def _bins(rows: DataFrame, first: str, last: str, width: float, levels: int, at: list[int], names: tuple[str, ...]) -> DataFrame:
    """The rows of _lives(), once for each bin at their own level and at those of `at` above: level, bin, the row's own level and
    its first bin at this level, under `names`."""
    level, bin_, own, begins = names
    above = F.filter(F.array(*map(F.lit, at)).cast("array<int>"), lambda k: k > F.col(own))
    rows = rows.withColumn(level, F.explode(F.concat(F.array(own), above)))
    # the last level has one bin for everything that is longer than all others
    at_level = lambda x: F.when(F.col(level) == levels, F.lit(0).cast("long")).otherwise(_bin_of(_inside(x, width), width, F.col(level)))
    rows = rows.withColumn(begins, at_level(first))
    return rows.withColumn(bin_, F.explode(F.sequence(F.col(begins), at_level(last))))


def width_for(df: DataFrame, first: str, last: str) -> float:
    """The middle length of the intervals, so that most touch one or two bins; for points, a share of their spread."""
    x, y = F.col(first).cast("double"), F.col(last).cast("double")
    got = df.select(F.percentile_approx(F.when(y > x, y - x), 0.5).alias("middle"), (F.max(x) - F.min(x)).alias("spread"), F.count("*").alias("n")).first()
    width = got.middle or (got.spread or 0) / max(1.0, got.n / 1000)
    return width if width and math.isfinite(width) else 1.0


def overlapping(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], width: float | None = None, levels: int = 8, condition: Column | None = None) -> DataFrame:
    """Pairs of rows of left and right whose intervals overlap, and for which `condition` holds. The two have no column name in
    common. width: of the finest bins; by default the middle length of the longer side's intervals."""
    if not 0 <= levels <= LEVELS or width is not None and not (width > 0 and math.isfinite(width)):
        raise ValueError(f"a positive width and up to {LEVELS} levels: {width}, {levels}")
    clash = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if clash:
        raise ValueError(f"columns of both sides: {', '.join(sorted(clash))}")
    width = width or max(width_for(left, *left_ends), width_for(right, *right_ends))
    names = lambda side: tuple(f"_{side}_{x}" for x in ("level", "bin", "own", "begins"))
    a, b = names("a"), names("b")
    one, two = _lives(left, *left_ends, width, levels, a[2]), _lives(right, *right_ends, width, levels, b[2])
    lived = [sorted(r[0] for r in side.select(x[2]).distinct().collect()) for side, x in ((one, a), (two, b))]
    one, two = _bins(one, *left_ends, width, levels, lived[1], a), _bins(two, *right_ends, width, levels, lived[0], b)
    once = (F.greatest(a[2], b[2]) == F.col(a[0])) & (F.greatest(a[3], b[3]) == F.col(a[1]))
    overlap = (F.col(left_ends[0]) <= F.col(right_ends[1])) & (F.col(right_ends[0]) <= F.col(left_ends[1]))
    holds = once & overlap & (condition if condition is not None else F.lit(True))
    lives = lambda x: F.col(x[2]) == F.col(x[0])
    hashed = lambda df: F.xxhash64(*[n for n, kind in df.dtypes if "map<" not in kind and "variant" not in kind])
    one, two = (side.withColumn(f"{x[1]}_at", F.struct(x[0], x[1])).withColumn(f"{x[1]}_row", hashed(df)) for side, x, df in ((one, a, left), (two, b, right)))

    def met(few: DataFrame, x: tuple[str, ...], many: DataFrame, y: tuple[str, ...]) -> DataFrame:
        return hubs.meet(few, many, f"{x[1]}_at", f"{y[1]}_at", f"{y[1]}_row", holds).select(*left.columns, *right.columns)

    pairs = met(two.filter(lives(b)), b, one.filter(lives(a)), a)
    if lived[0] and lived[1] and lived[0][0] < lived[1][-1]:
        pairs = pairs.union(met(two.filter(lives(b)), b, one.filter(~lives(a)), a))
    if lived[0] and lived[1] and lived[1][0] < lived[0][-1]:
        pairs = pairs.union(met(one.filter(lives(a)), a, two.filter(~lives(b)), b))
    return pairs
