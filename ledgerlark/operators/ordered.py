"""Windows over ordered rows that survive a key holding much of the table.

A window partitioned by key sends all rows of a key to one task. Here the heavy
keys are found first with one narrow aggregate. If there are none, the plain
window is used. Otherwise a sample of each heavy key gives quantiles of its order
columns. These are kept as values, and rows are compared with them as values, in the
order in which Spark sorts, so that columns of any type are cut where they really
differ. The rows between two of them are a slice. If a key needs so many slices that the
search would carry a long array along with every row, the quantiles only cut it into groups
that a task holds, and inside a group slices are counted off in order. Neighbouring slices
are joined to chunks, and every chunk also receives the few rows before it that its window frames
can reach. The result is the same as that of the plain window, wherever the cuts are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .copies import repeat_rows

# Rows and bytes of one key that a single window task may hold; see row_bound.
SPLIT_ROWS = 4_000_000
SPLIT_BYTES = 512 << 20
# Slices that the bound is cut into, and sampled rows per slice.
SLICES = 4
POINTS = 8
# Most fences that a row is compared with, and groups of a key that needs more slices.
FENCES = 512
GROUPS = 64
# Largest helper table, in rows of about 100 bytes, that is sent to all executors.
BROADCAST_ROWS = 500_000

WindowColumns = Callable[[WindowSpec], dict[str, Column] | list[dict[str, Column]]]

SLICE = "_slice"
TIE = "_tie"
_CHUNK, _OWN, _TARGETS, _TIMES = "_chunk", "_own", "_targets", "_times"
_FENCES, _NUMBER = "_fences", "_number"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys, NULL matching NULL; only the left keys stay."""
    renamed = {key: f"_right_{key}" for key in keys}
    right = right.withColumnsRenamed(renamed)
    condition = [F.col(key).eqNullSafe(F.col(other)) for key, other in renamed.items()]
    joined = left.join(right, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*renamed.values())


def broadcast_if_small(
    table: DataFrame, counted: DataFrame | None = None, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Broadcast hint for a table of at most ``max_rows`` rows; beyond that the
    table is joined by shuffle. ``counted`` is a settled table with as many rows."""
    return F.broadcast(table) if (table if counted is None else counted).count() <= max_rows else table


def row_bound(df: DataFrame, split_rows: int = SPLIT_ROWS) -> int:
    """Rows a window task may hold: a bound that was set stays, the default one
    also keeps to ``SPLIT_BYTES`` by the width of the columns."""
    if split_rows != SPLIT_ROWS:
        return split_rows
    width = sum(_width(f.dataType) for f in df.schema.fields if not f.name.startswith("_"))
    return max(1, min(split_rows, SPLIT_BYTES // max(width, 1)))


def _width(kind: T.DataType) -> int:
    if isinstance(kind, T.StructType):
        return sum(_width(f.dataType) for f in kind.fields)
    return 8 if isinstance(kind, (T.NumericType, T.DatetimeType, T.BooleanType)) else 32


def slice_heavy_keys(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    split_rows: int = SPLIT_ROWS,
    slices: int = SLICES,
    heavy: bool | None = None,
) -> DataFrame | None:
    """Add ``_slice``, an array that rises with the order inside each key.

    Rows of ordinary keys get an empty array, others one with the number of their slice.
    Only if equal order values alone are too many for a slice, ``_tie``, a hash of the
    row, is added and cuts them too, as the order of ties is free; copies of one row stay
    together then. Returns None when no key is heavy. ``heavy`` tells whether one is,
    where that is known. ``slices`` is how many slices the bound is cut into.
    """
    cut, tied = cut_heavy_keys(df, keys, order, split_rows, slices, heavy)
    if not tied:
        return cut
    # The hash reads all columns, so it is used only where ties must be cut.
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    with_hash = df.withColumn(TIE, F.shiftright(F.xxhash64(*hashed), 2))
    return cut_heavy_keys(with_hash, keys, [*order, TIE], row_bound(df, split_rows), slices, True)[0]


def cut_heavy_keys(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    split_rows: int,
    slices: int = SLICES,
    heavy: bool | None = None,
) -> tuple[DataFrame | None, bool]:
    """``df`` with ``_slice``, or None if no key is heavy, and whether rows with equal
    order values are too many for a slice."""
    split_rows = row_bound(df, split_rows)
    if heavy is False:
        return None, False
    big = settle(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > split_rows))
    longest = big.agg(F.max("_rows")).first()[0]
    if longest is None:
        return None, False
    big = big.select(*keys)
    for name in order:
        kind = df.schema[name].dataType
        if not isinstance(kind, T.AtomicType):
            raise TypeError(f"rows of a heavy key cannot be cut along {name}, of type {kind.simpleString()}")
    every = max(1, split_rows // slices)
    if longest > FENCES * every:
        return _cut_in_groups(df, keys, order, big, longest, split_rows, every)
    numbered, tied = _numbered_slices(df, keys, order, big, split_rows, slices)
    return numbered.withColumn(SLICE, _slice_of(F.col(_NUMBER))).drop(_NUMBER), tied


def _slice_of(*numbers: Column) -> Column:
    return F.when(numbers[0].isNotNull(), F.array(*numbers)).otherwise(F.array().cast("array<bigint>"))


def _numbered_slices(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], big: DataFrame, split_rows: int, slices: int
) -> tuple[DataFrame, bool]:
    """``df`` with the number of the slice in ``_number``, NULL for ordinary keys, and
    whether a value is too frequent for a slice."""
    place = F.struct(*[F.col(f"`{name}`") for name in order])
    found = _fences(df.select(*keys, place.alias("_place")), big, keys, split_rows, slices)
    # A heavy key without a sampled row is one slice.
    empty = F.array().cast(found.schema[_FENCES].dataType)
    fences = settle(null_safe_join(big, found, keys, "left").withColumn(_FENCES, F.coalesce(_FENCES, empty)))
    most, total, tied = fences.agg(F.max(F.size(_FENCES)), F.sum(F.size(_FENCES)), F.max("_tied")).first()
    table = fences.select(*keys, _FENCES)
    fenced = null_safe_join(df, F.broadcast(table) if total <= BROADCAST_ROWS else table, keys, "left")
    number = F.when(F.col(_FENCES).isNotNull(), _fences_before(place, F.col(_FENCES), most))
    return fenced.withColumn(_NUMBER, number).drop(_FENCES), bool(tied)


def _cut_in_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], big: DataFrame, longest: int, split_rows: int, every: int
) -> tuple[DataFrame, bool]:
    """The same for keys of many slices: groups of about equal size, whose number does not
    rise with the slices, and in each of them slices of ``every`` rows by their rank.

    Ties have one rank, so they stay in one slice. Rows are shuffled once for this and kept,
    as all that follows reads them more than once.
    """
    size = max(1, min(-(-longest // GROUPS), row_bound(df) // SLICES))
    grouped, _ = _numbered_slices(df, keys, order, big, size, 1)
    in_order = Window.partitionBy(*keys, _NUMBER).orderBy(*order)
    rank = F.rank().over(in_order)
    ranked = grouped.select("*", rank.alias("_rank"), (F.row_number().over(in_order) - rank + 1).alias("_nth_tie"))
    within = F.floor((F.col("_rank") - 1) / F.lit(every)).cast("bigint")
    cut = settle(ranked.select(*df.columns, _slice_of(F.col(_NUMBER), within).alias(SLICE), "_nth_tie"))
    most_tied = cut.agg(F.max("_nth_tie")).first()[0]
    return cut.drop("_nth_tie"), most_tied > split_rows


def _fences(places: DataFrame, big: DataFrame, keys: Sequence[str], split_rows: int, slices: int) -> DataFrame:
    """Quantiles of ``_place`` for each key of ``big``, and whether one value holds
    about as many rows as the bound.

    They come from a sample of about ``POINTS`` rows per slice, or of all rows if the bound is
    small. Which rows are sampled does not matter for results, as the fences are settled.
    """
    share = min(1.0, POINTS * slices / split_rows)
    sample = places if share == 1.0 else places.where(F.rand(17) < share)
    sample = null_safe_join(sample, broadcast_if_small(big), keys, "left_semi")
    every = POINTS if share < 1.0 else max(1, split_rows // slices)
    numbered = sample.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy("_place")))
    values = numbered.groupBy(*keys, "_place").agg(F.count(F.lit(1)).alias("_times"), F.max((F.col("_nth") % every == 0).cast("int")).alias("_is_fence"))
    # A key always has a row, so that it counts as heavy.
    fence = F.when(F.col("_is_fence") == 1, F.col("_place"))
    return values.groupBy(*keys).agg(F.sort_array(F.collect_list(fence)).alias(_FENCES), (F.max("_times") > split_rows * share).alias("_tied"))


def _fences_before(place: Column, fences: Column, most: int) -> Column:
    """How many of the sorted ``fences``, ``most`` at most, are less than ``place``."""
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(max(1, most.bit_length())))])

    def forward(at: Column, step: Column) -> Column:
        further = (at + step <= F.size(fences)) & (F.get(fences, at + step - 1) < place)
        return F.when(further, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), forward).cast("bigint")


def _slice_sizes(cut: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cut.where(F.size(SLICE) > 0).groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_rows"))


def _chunk_plan(sizes: DataFrame, keys: Sequence[str], reach: int, chunk_rows: int) -> DataFrame:
    """Own chunk of every slice, and all chunks that need the slice.

    A chunk starts with the first slice at or after a multiple of ``chunk_rows``
    rows. As ``chunk_rows`` is at least ``reach``, only the next two chunks can
    reach back into a slice.
    """
    so_far = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sizes.withColumn("_end", F.sum("_rows").over(so_far)).withColumn(
        _OWN, F.floor((F.col("_end") - F.col("_rows")) / F.lit(chunk_rows)).cast("bigint")
    )
    following = Window.partitionBy(*keys).orderBy(_OWN)
    chunks = (
        placed.groupBy(*keys, _OWN)
        .agg(F.min(F.col("_end") - F.col("_rows")).alias("_first"))
        .select(
            *keys,
            _OWN,
            *[F.lead(F.struct(_OWN, "_first"), ahead).over(following).alias(f"_next{ahead}") for ahead in (1, 2)],
        )
    )
    reached = [
        F.when(F.col(f"_next{ahead}._first") < F.col("_end") + F.lit(reach), F.col(f"_next{ahead}.{_OWN}"))
        for ahead in (1, 2)
    ]
    return null_safe_join(placed, chunks, [*keys, _OWN], "left").select(
        *keys, SLICE, _OWN, F.array_compact(F.array(F.col(_OWN), *reached)).alias(_TARGETS)
    )


def _fold_copies(cut: DataFrame, sizes: DataFrame, keys: Sequence[str], reach: int, split_rows: int) -> DataFrame:
    """Replace the many copies of one row by ``reach + 1`` of them.

    From copy ``reach + 1`` on, a frame holds nothing but copies, so the window
    results no longer change; ``_times`` on the last copy says how many rows it
    stands for.
    """
    full = broadcast_if_small(sizes.where(F.col("_rows") > split_rows).select(*keys, SLICE))
    group = [*keys, SLICE]
    rest = null_safe_join(cut, full, group, "left_anti").withColumn(_TIMES, F.lit(1).cast("bigint"))
    runs = null_safe_join(cut, full, group, "left_semi").groupBy(*cut.columns).agg(F.count(F.lit(1)).alias("_copies"))
    kept = F.least(F.col("_copies"), F.lit(reach + 1))
    folded = runs.select(
        *cut.columns, "_copies", kept.alias("_kept"), F.explode(F.sequence(F.lit(1).cast("bigint"), kept)).alias("_nth")
    ).select(
        *cut.columns,
        F.when(F.col("_nth") == F.col("_kept"), F.col("_copies") - F.col("_kept") + 1)
        .otherwise(F.lit(1))
        .cast("bigint")
        .alias(_TIMES),
    )
    return rest.unionByName(folded)


def has_heavy_keys(df: DataFrame, keys: Sequence[str], split_rows: int = SPLIT_ROWS) -> bool:
    """Whether any key has more rows than the bound."""
    split_rows = row_bound(df, split_rows)
    return not df.groupBy(*keys).count().where(F.col("count") > split_rows).isEmpty()


def lookback_window(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    reach: int,
    columns: WindowColumns,
    split_rows: int = SPLIT_ROWS,
    slices: int = SLICES,
    heavy: bool | None = None,
) -> DataFrame:
    """Add window columns whose frames reach at most ``reach`` rows back.

    ``columns`` gets the ordered window of a key and returns the new columns by
    name, or a list of such stages, of which each may use the columns of those
    before and only the last one stays. Ordering is ascending, NULL first; it
    should end with the columns that the frames read, so that ties do not matter.
    """
    cut = slice_heavy_keys(df, keys, order, split_rows, slices, heavy)
    if cut is None:
        return plain_window(df, keys, order, columns)
    return chunked_window(cut, keys, order, reach, columns, split_rows)


def plain_window(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: WindowColumns) -> DataFrame:
    """Window columns with one task per key."""
    added, new = _add_columns(df, columns(Window.partitionBy(*keys).orderBy(*order)))
    return added.select(*df.columns, *new)


def _add_columns(df: DataFrame, stages: dict[str, Column] | list[dict[str, Column]]) -> tuple[DataFrame, list[str]]:
    """All stages one after another, and the column names of the last one."""
    stages = [stages] if isinstance(stages, dict) else stages
    for stage in stages:
        df = df.select("*", *[value.alias(name) for name, value in stage.items()])
    return df, list(stages[-1])


def chunked_window(
    cut: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    reach: int,
    columns: WindowColumns,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Window columns over the output of ``slice_heavy_keys``, heavy keys in chunks."""
    names = [c for c in cut.columns if c not in (SLICE, TIE)]
    rows, bound = cut.withColumn(_TIMES, F.lit(1).cast("bigint")), max(row_bound(cut, split_rows), reach)
    ties = [TIE] if TIE in cut.columns else []
    full_order = [*order, *ties]
    sizes = settle(_slice_sizes(cut, keys))
    folded = not sizes.where(F.col("_rows") > bound).isEmpty()
    if folded:
        rows = _fold_copies(cut, sizes, keys, reach, bound)
        sizes = settle(_slice_sizes(rows, keys))
        full_order += [c for c in names if c not in order]  # copies side by side
    plan = broadcast_if_small(_chunk_plan(sizes, keys, reach, bound), counted=sizes)
    routed = null_safe_join(rows, plan, [*keys, SLICE], "left")
    only_chunk = F.array(F.lit(0).cast("bigint"))
    spread = routed.select(
        *names,
        *ties,
        _TIMES,
        F.coalesce(_OWN, F.lit(0)).alias(_OWN),
        F.explode(F.coalesce(F.col(_TARGETS), only_chunk)).alias(_CHUNK),
    )
    added, new = _add_columns(spread, columns(Window.partitionBy(*keys, _CHUNK).orderBy(*full_order)))
    done = added.where(F.col(_OWN) == F.col(_CHUNK))
    return repeat_rows(done, F.col(_TIMES), [*names, *new]) if folded else done.select(*names, *new)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    split_rows: int = SPLIT_ROWS,
    slices: int = SLICES,
) -> DataFrame:
    """Add the running sum of ``value``; ties are summed in the order of the values.
    Each slice of a heavy key sums alone and adds the total of the slices before it."""
    order = [*order, *([value] if value not in order else [])]
    cut = slice_heavy_keys(df, keys, order, split_rows, slices)
    if cut is None:
        return plain_window(df, keys, order, lambda w: {name: F.sum(value).over(w.rowsBetween(*_SO_FAR))})
    group = [*keys, SLICE]
    window = Window.partitionBy(*group).orderBy(*order).rowsBetween(*_SO_FAR)
    local = cut.select("*", F.sum(value).over(window).alias("_local"))
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    totals = (
        cut.where(F.size(SLICE) > 0)
        .groupBy(*group)
        .agg(F.sum(value).alias("_sum"))
        .select(*group, F.sum("_sum").over(earlier).alias("_before"))
    )
    total = F.coalesce(F.col("_local") + F.col("_before"), F.col("_local"), F.col("_before"))
    return null_safe_join(local, totals, group, "left").select(*df.columns, total.alias(name))


_SO_FAR = (Window.unboundedPreceding, Window.currentRow)
