"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

The rows lie in blocks. The result's places lie in cells: runs of places within a
shard. How many rows go from each block to each cell is drawn first, as a table with
fixed row sums (block sizes) and column sums (cell sizes), which is how a uniform
permutation would deal them. Then each block permutes its rows and hands them out by
that table, and each cell permutes what it gets. Blocks and cells are bounded, so no
task sorts a whole shard. All draws are hashes of a seed, so a repeated task deals the
same rows the same way.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import let
from .files import stored

LEAST_ROWS = 1 << 14  # rows of a block or cell; tables beyond its square get blocks of the square root


def _uniform(*keys: Column) -> Column:
    """A number in [0, 1) from a hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) * F.lit(2.0**-53)


def _log_factorial(n: Column) -> Column:
    """Stirling's series from n + 8 on, brought back to n; better than 1e-12 of a step for any count."""
    x = n.cast("double") + 8
    up = reduce(lambda a, k: a + F.log(n.cast("double") + k), range(1, 9), F.lit(0.0))
    series = (x + 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x)
    return series + 1 / (1260 * x * x * x * x * x) - up


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` from ``total`` are among the ``good``, for a uniform ``u``.

    Inversion from the mode outwards, up and down in turn, with each probability from
    the one before. The steps cover the whole support or twelve deviations to each side,
    beyond which less than 1e-30 is left, far below the steps of ``u``.
    """
    given = F.struct(
        total.cast("double").alias("n"), good.cast("double").alias("k"), drawn.cast("double").alias("m"), u.alias("u")
    )
    return let(given, lambda v: let(_bounds(v), lambda b: _invert(v, b)))


def _bounds(v: Column) -> Column:
    """Support, mode, the mode's probability and the number of steps."""
    n, k, m = v.n, v.k, v.m
    low, high = F.greatest(F.lit(0.0), m + k - n), F.least(k, m)
    mode = F.least(high, F.greatest(low, F.floor((m + 1) * (k + 1) / (n + 2)).cast("double")))
    share = k / F.greatest(n, F.lit(1.0))
    spread = F.sqrt(F.greatest(F.lit(0.0), m * share * (1 - share) * (n - m) / F.greatest(n - 1, F.lit(1.0))))
    reach = F.least(high - low, F.ceil(12 * F.coalesce(spread, F.lit(0.0))) + 20)

    def choose(a: Column, b: Column) -> Column:
        return _log_factorial(a) - _log_factorial(b) - _log_factorial(a - b)

    ends = F.struct(low.alias("low"), high.alias("high"), mode.alias("mode"), reach.cast("int").alias("reach"))
    return let(
        ends,
        lambda e: F.struct(
            e.low.alias("low"), e.high.alias("high"), e["mode"].alias("mode"), e.reach.alias("reach"),
            F.exp(choose(k, e["mode"]) + choose(n - k, m - e["mode"]) - choose(n, m)).alias("peak"),
        ),
    )


def _invert(v: Column, b: Column) -> Column:
    start = F.struct(
        (v.u - b.peak).alias("left"), b["mode"].alias("answer"), b["mode"].alias("up"), b.peak.alias("p_up"),
        b["mode"].alias("down"), b.peak.alias("p_down"),
    )

    def odds(s: Column) -> Column:
        up = s.p_up * (v.k - s.up) * (v.m - s.up) / ((s.up + 1) * (v.n - v.k - v.m + s.up + 1))
        down = s.p_down * s.down * (v.n - v.k - v.m + s.down) / ((v.k - s.down + 1) * (v.m - s.down + 1))
        return F.struct(
            F.when(s.up < b.high, up).otherwise(0.0).alias("up"),
            F.when(s.down > b.low, down).otherwise(0.0).alias("down"),
        )

    def move(s: Column, p: Column) -> Column:
        return F.struct(
            F.when(s.left < p.up, s.left - p.up).otherwise(s.left - p.up - p.down).alias("left"),
            F.when(s.left < p.up, s.up + 1).when(s.left < p.up + p.down, s.down - 1).otherwise(s.answer).alias("answer"),
            F.least(s.up + 1, b.high).alias("up"), p.up.alias("p_up"),
            F.greatest(s.down - 1, b.low).alias("down"), p.down.alias("p_down"),
        )

    def step(s: Column, _: Column) -> Column:
        return F.when(s.left < 0, s).otherwise(let(odds(s), lambda p: move(s, p)))

    steps = F.sequence(F.lit(1), F.greatest(b.reach, F.lit(1)))
    found = F.aggregate(steps, start, step, lambda s: s.answer)
    return F.when(b.low >= b.high, b.low).otherwise(found).cast("long")


def _split(sizes: Column, drawn: Column, seed: Column) -> Column:
    """Deal ``drawn`` rows over columns of the given sizes: one draw per column from what is left."""

    def step(s: Column, size: Column) -> Column:
        taken = hypergeometric(s.total, size, s.drawn, _uniform(seed, F.size(s.out)))
        return F.struct(
            (s.total - size).alias("total"), (s.drawn - taken).alias("drawn"),
            F.concat(s.out, F.array(taken)).alias("out"),
        )

    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(
        total.alias("total"), drawn.cast("long").alias("drawn"), F.array().cast("array<long>").alias("out")
    )
    return F.aggregate(sizes, start, step, lambda s: s.out)


def communication_matrix(counts: DataFrame, levels: int, sizes: DataFrame, seed: int) -> DataFrame:
    """Rows that each block sends to each cell: ``block, deal`` (array over the cells).

    ``counts``: block, n for blocks below 2**levels, missing ones are empty. ``sizes``: one row, ``deal``, the
    cells' sizes, which sum to all rows. The blocks are halved again and again; at each halving the left half's
    share of every cell is drawn, so the draws of a level are independent rows, and there are ``levels`` levels.
    """
    nodes = sizes.select(F.lit(0).cast("long").alias("block"), "deal")
    for level in range(levels):
        half = levels - level - 1
        left = (
            counts.withColumn("child", F.shiftright("block", half))
            .filter("child % 2 = 0")
            .groupBy(F.shiftright("child", 1).alias("block"))
            .agg(F.sum("n").alias("n_left"))
        )
        split = nodes.join(left, "block", "left").withColumn(
            "first", _split(F.col("deal"), F.coalesce("n_left", F.lit(0)), F.xxhash64(F.lit(seed), F.lit(level), "block"))
        )
        both = F.array(
            F.struct((F.col("block") * 2).alias("block"), F.col("first").alias("deal")),
            F.struct(
                (F.col("block") * 2 + 1).alias("block"),
                F.zip_with("deal", "first", lambda a, b: a - b).alias("deal"),
            ),
        )
        nodes = split.select(F.explode(both).alias("half")).select("half.*")
    return nodes


def shuffle_into_shards(
    docs: DataFrame, shards: int, key: list[str], seed: int = 0, rows: int | None = None
) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0), a uniform random shuffle.

    Shard sizes differ by one row at most; the first shards are the larger ones. The order of the shuffle is a
    hash of ``key`` and ``seed``; give columns that tell rows apart, such as an id and the text. Rows with equal
    keys, nulls included, are dealt like any others, as each takes a place of its own, but they share a block; if a
    third of all rows are equal, give a salt column in the key. An empty table gives an empty result. Columns
    named ``shard`` or ``slot`` are replaced. ``rows`` is the number of rows a block or cell may hold.

    Whole rows move twice, to their block and to their cell; the counts move as one small table.
    """
    total = docs.count()
    limit = rows or max(LEAST_ROWS, int(total**0.5))
    levels = max(0, (max(1, -(-total // limit)) - 1).bit_length())
    cells = max(1, -(-total // (limit * shards)))  # of each shard
    # The row travels as one struct, so that no column of it can have the name of a column made here.
    own = [F.col(f"row.`{k}`") for k in key]

    def order(first: int) -> list[Column]:
        # Two hashes and not the keys themselves: a window copies them beside the row, and the copies of the texts would move too.
        return [F.xxhash64(F.lit(first), *own), F.xxhash64(F.lit(first + 1000003), *own)]

    packed = docs.drop("shard", "slot").select(F.struct("*").alias("row"))
    placed = packed.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), *own), F.lit(1 << levels)))
    counts = stored(placed.groupBy(F.col("_block").alias("block")).agg(F.count("*").alias("n")), "blocks")

    # Cell c = shard * cells + part has an exact size and a first slot that follow from the row count alone.
    number = F.sequence(F.lit(0).cast("long"), F.lit(shards * cells - 1).cast("long"))

    def shard_size(s: Column) -> Column:
        return F.lit(total // shards) + (s < total % shards).cast("long")

    def cell_start(c: Column) -> Column:
        size, part = shard_size(F.floor(c / cells)), F.pmod(c, F.lit(cells))
        return F.floor(size / cells) * part + F.least(part, F.pmod(size, F.lit(cells)))

    def cell_size(c: Column) -> Column:
        size, part = shard_size(F.floor(c / cells)), F.pmod(c, F.lit(cells))
        return F.floor(size / cells) + (part < F.pmod(size, F.lit(cells))).cast("long")

    spark = docs.sparkSession
    sizes = spark.range(1).select(F.transform(number, cell_size).alias("deal"))
    matrix = stored(communication_matrix(counts, levels, sizes, seed), "matrix")
    # Places of a block's rows, handed out cell by cell: the running ends of its matrix row.
    ends = F.aggregate(
        "deal", F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("ends")),
        lambda s, n: F.struct((s["sum"] + n).alias("sum"), F.concat(s.ends, F.array(s["sum"] + n)).alias("ends")),
        lambda s: s.ends,
    )
    runs = matrix.select(F.col("block").alias("_block"), ends.alias("_ends"))

    inside = placed.withColumn("_place", F.row_number().over(Window.partitionBy("_block").orderBy(*order(seed + 1))) - 1)
    dealt = inside.join(runs, "_block")
    cell = F.aggregate(
        F.sequence(F.lit(1), F.lit(max(1, (shards * cells - 1).bit_length() + 1))),
        F.struct(F.lit(0).cast("long").alias("low"), F.lit(shards * cells - 1).cast("long").alias("high")),
        _halve,
        lambda s: s.low,
    )
    sent = dealt.withColumn("_cell", cell).drop("_ends", "_place", "_block")
    again = Window.partitionBy("_cell").orderBy(*order(seed + 2))
    slot = F.row_number().over(again) - 1 + cell_start(F.col("_cell"))
    return sent.select(
        "row", F.floor(F.col("_cell") / cells).cast("int").alias("shard"), slot.cast("long").alias("slot")
    ).select("row.*", "shard", "slot")


def _halve(s: Column, _: Column) -> Column:
    """One step of the search for the first cell whose end lies beyond the row's place."""
    middle = F.floor((s.low + s.high) / 2)
    beyond = F.get(F.col("_ends"), middle.cast("int")) > F.col("_place")
    return F.struct(
        F.when(s.low >= s.high, s.low).when(beyond, s.low).otherwise(middle + 1).alias("low"),
        F.when(s.low >= s.high, s.high).when(beyond, middle).otherwise(s.high).alias("high"),
    )
