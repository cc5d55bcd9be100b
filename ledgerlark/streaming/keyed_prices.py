"""Rolling price means from keyed state: a batch reads no stored price.

The state of a symbol is a ring: its prices of the last ``lateness`` days, and the
``period - 1`` rows before them, that a mean can still need. A batch merges its rows into
the rings of its symbols and passes on only the rows whose mean changes: the new and
restated ones, and up to ``period - 1`` rows after each. Of a day that landed more than once
the newest file counts, and within a file the greatest prices.

A row older than its ring can judge is late. No row is dropped for that: the symbols of late
rows are computed anew from the stored table by ``plans.rolling_average``, which also splits a heavy
symbol, and what is late goes into the ring as far as later means can reach it. So files may
come in any order, ``lateness`` sets only what is cheap, and neither a watermark nor a timer
decides about a result.

The rings of many symbols are one state value: a symbol belongs to one of ``SLOTS`` slots by a hash,
and a batch merges all symbols of a slot at once. A call of Python and a trip to the state store cost
some milliseconds, so these follow the slots and not the symbols. A batch reads and writes the
rings of the slots that it touches, which is less than ``sources.upsert_version`` rewrites of the table.

The new rows of a slot in one batch, and its rings, are in one task. Bound a batch by the
``max_files`` of the stream, so that a long history lands in several batches.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.numbers import nan_to_null
from ..operators.columns import conform
from ..operators.joins import latest_rows, upsert
from ..plans.history import PERIOD, rolling_average, truncate_before
from ..schema import HISTORY_SCHEMA
from ..session import settle
from ..sources.versioned import current_table, upsert_version

KEYS = ["symbol", "date"]
PRICES = [f.name for f in HISTORY_SCHEMA.fields if f.name not in KEYS]
VERSION = "landed_version"
LATENESS = 30

# Part of what a checkpoint holds: another number would not find the rings that are stored.
SLOTS = 1024

_DAY = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def mean_name(price: str) -> str:
    """Column of the rolling mean of a price column."""
    return f"{price}_mean"


_TEXTS = ["symbol", "day", "version"]
_MEANS = [mean_name(p) for p in PRICES]
_OUT = T.StructType(
    [T.StructField(name, T.StringType()) for name in _TEXTS]
    + [T.StructField(name, T.DoubleType()) for name in [*PRICES, *_MEANS]]
    + [T.StructField("late", T.BooleanType())]
)
# ``open_from``: the first day of a symbol whose mean its ring can tell, once rows before it were let go.
_RING = pa.schema([(name, pa.string()) for name in [*_TEXTS, "open_from"]] + [(name, pa.float64()) for name in PRICES])


def rolling_means(prices: np.ndarray, period: int) -> np.ndarray:
    """Means over the last ``period`` rows by column, NaN where a row is missing or NaN.

    Short sums are added in the order of ``plans.rolling_average``, so the figures are the same
    to the last digit.
    """
    length = max(1, round(period**0.5))
    whole, rest = divmod(period, length)

    def back(table: np.ndarray, rows: int) -> np.ndarray:
        moved = np.full_like(table, np.nan)
        moved[rows:] = table[: len(table) - rows]
        return moved

    def short_sum(rows: int) -> np.ndarray:
        total = back(prices, rows - 1)
        for at in reversed(range(rows - 1)):
            total = total + back(prices, at)
        return total

    short = short_sum(length)
    total = short
    for at in range(1, whole):
        total = total + back(short, length * at)
    if rest:
        total = total + back(short_sum(rest), length * whole)
    return total / period


def _cut(day: str, lateness: int) -> str:
    """The day ``lateness`` days before, as text; days of text sort as days."""
    try:
        return (dt.datetime.fromisoformat(day) - dt.timedelta(days=lateness)).isoformat(" ", "microseconds")
    except (OverflowError, ValueError):  # no day, or none so long before it
        return ""


def _newest(order: np.ndarray, among: np.ndarray, symbol: np.ndarray, day: np.ndarray) -> np.ndarray:
    """The last row in ``order`` of each symbol and day, of the rows ``among``."""
    at = order[among[order]]
    after = at[1:]
    return at[np.append((symbol[after] != symbol[at[:-1]]) | (day[after] != day[at[:-1]]), True)[: len(at)]]


class Rings(StatefulProcessor):
    """Prices of the symbols of a slot that a mean can still need."""

    def __init__(self, period: int, lateness: int):
        self.period, self.lateness = period, lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rings = handle.getValueState("rings", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        known = self._load()
        size = sum(map(len, known))
        rows = pd.concat([*known, *rows], ignore_index=True)
        texts = {name: rows[name].to_numpy(dtype=object) for name in _TEXTS}
        prices = rows[PRICES].to_numpy(dtype=float)
        stored = np.arange(len(rows)) < size
        # Numbers instead of texts; a symbol of NULL is one of them, and days are numbered in their order.
        symbol, names = pd.factorize(texts["symbol"], use_na_sentinel=False)
        day, days = pd.factorize(texts["day"], sort=True)
        version, _ = pd.factorize(texts["version"], sort=True)
        open_from = np.full(len(names), "", dtype=object)
        oldest = np.full(len(names), len(days))
        if size:
            open_from[symbol[:size]] = rows["open_from"].to_numpy(dtype=object)[:size]
            np.minimum.at(oldest, symbol[:size], day[:size])
        open_at = np.searchsorted(days, open_from)

        # Late rows are judged against the stored table, where their older versions are.
        late = ~stored & (day < open_at[symbol])
        # What tells rows of a day apart: the file, and within a file the greater prices, as in
        # ``latest_rows``; of equal rows the stored one stays.
        ages = [version, *np.where(np.isnan(prices), -np.inf, prices).T]
        order = np.lexsort([stored, *reversed(ages), day, symbol])
        at = _newest(order, ~(late & (day < oldest[symbol])), symbol, day)
        count, changed = np.arange(len(at)), ~stored[at]
        first = np.append(True, symbol[at[1:]] != symbol[at[:-1]])
        begin = np.maximum.accumulate(np.where(first, count, 0))
        change = np.maximum.accumulate(np.where(changed, count, -1))
        reached = (change >= begin) & (count - change < self.period) & (day[at] >= open_at[symbol[at]])
        with np.errstate(all="ignore"):
            means = rolling_means(prices[at], self.period)
        means[count - begin < self.period - 1] = np.nan
        late = _newest(order, late, symbol, day)
        out = np.concatenate([at[reached], late])
        if len(out):
            means = np.concatenate([means[reached], np.full((len(late), len(PRICES)), np.nan)])
            yield self._frame(texts, prices, out, **dict(zip(_MEANS, means.T)), late=np.arange(len(out)) >= len(out) - len(late))
        if changed.any():
            ends = np.append(np.flatnonzero(first)[1:], len(at)) - 1
            cuts = np.array([max(open_from[symbol[i]], _cut(days[day[i]], self.lateness)) for i in at[ends]], dtype=object)
            ring = np.cumsum(first) - 1
            before = np.add.reduceat(day[at] < np.searchsorted(days, cuts)[ring], np.flatnonzero(first), dtype=int)
            gone = np.maximum(0, before - (self.period - 1))
            kept = count - begin >= gone[ring]
            opened = np.where(gone > 0, cuts, open_from[symbol[at[ends]]])
            self._store(self._frame(texts, prices, at[kept], open_from=opened[ring[kept]]))

    @staticmethod
    def _frame(texts: dict[str, np.ndarray], prices: np.ndarray, at: np.ndarray, **more: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({name: text[at] for name, text in texts.items()} | dict(zip(PRICES, prices[at].T)) | more)

    def _load(self) -> list[pd.DataFrame]:
        if not self.rings.exists():
            return []
        return [pa.ipc.open_stream(self.rings.get()[0]).read_pandas()]

    def _store(self, rows: pd.DataFrame) -> None:
        """One value per slot, so that a batch reads and writes the state once per slot."""
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _RING, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
            stream.write_table(pa.Table.from_pandas(rows, schema=_RING, preserve_index=False))
        self.rings.update((sink.getvalue().to_pybytes(),))

    def close(self) -> None:
        pass


def _keyed(landed: DataFrame, start: str) -> DataFrame:
    """Prices with the slot of their symbol, and with the time and name of their file as version."""
    time = lambda c: F.coalesce(F.date_format(c, _DAY), F.lit(""))
    versions = {"_modified": F.col("_metadata.file_modification_time"), "_file": F.col("_metadata.file_name")}
    fields = T.StructType([*HISTORY_SCHEMA.fields, T.StructField("_modified", T.TimestampType()), T.StructField("_file", T.StringType())])
    panel = truncate_before(nan_to_null(conform(landed.withColumns(versions), fields)), start)
    return panel.select(
        F.pmod(F.hash("symbol"), F.lit(SLOTS)).alias("slot"),
        "symbol",
        time(F.col("date")).alias("day"),
        F.concat_ws(" ", time(F.col("_modified")), "_file").alias("version"),
        *PRICES,
    )


def _with_means(rows: DataFrame, period: int) -> DataFrame:
    """Table rows from plain prices, computed as a batch."""
    copied = rows.select(*KEYS, *PRICES, VERSION, *[F.col(p).alias(mean_name(p)) for p in PRICES])
    return rolling_average(copied, period, [mean_name(p) for p in PRICES])


def keyed_averages(
    landed: DataFrame,
    table_path: str,
    checkpoint_path: str,
    period: int = PERIOD,
    start: str = "2017-01-01",
    lateness: int = LATENESS,
    buckets: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Keep a versioned table of prices and their rolling means at ``table_path`` up to date
    with the price files of ``landed``; ``sources.current_table`` reads it.

    It has one row per symbol and day, the prices, ``<price>_mean`` and ``landed_version``. The session's state
    store must be able to hold maps (``use_keyed_state``). A batch is visible in one step, and
    one that runs again is skipped. Days within ``lateness`` days of a symbol's newest cost no
    read of the table. By default all that has landed is processed and the query stops;
    ``trigger`` takes the arguments of ``writeStream.trigger``.
    """

    def refresh(reached: DataFrame, batch_id: int) -> None:
        rows = settle(reached)
        date = F.to_timestamp_ntz("day", F.lit(_DAY))
        plain = rows.select(
            "symbol",
            F.when(F.col("day") != "", date).alias("date"),
            *PRICES,
            *_MEANS,
            F.col("version").alias(VERSION),
            "late",
        )
        new = plain.drop("late")
        if not rows.where("late").isEmpty():
            new = _after_late(plain, current_table(reached.sparkSession, table_path), period)
        upsert_version(new, table_path, KEYS, ["symbol"], buckets, f"{checkpoint_path}#{batch_id}")

    reached = _keyed(landed, start).groupBy("slot").transformWithStateInPandas(Rings(period, lateness), _OUT, "update", "none")
    return (
        reached.writeStream.foreachBatch(refresh)
        .outputMode("update")
        .option("checkpointLocation", checkpoint_path)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _after_late(plain: DataFrame, stored: DataFrame | None, period: int) -> DataFrame:
    """Rows of a batch, with all rows of the symbols that late rows belong to."""
    symbols = plain.where("late").select("symbol").distinct()
    named = F.col("symbol").eqNullSafe(F.col("_late_symbol"))
    late = symbols.withColumnRenamed("symbol", "_late_symbol")
    prices = plain.select(*KEYS, *PRICES, VERSION).join(late, named, "left_semi")
    if stored is not None:
        prices = stored.select(*KEYS, *PRICES, VERSION).join(late, named, "left_semi").unionByName(prices)
    anew = _with_means(latest_rows(prices, KEYS, [VERSION, *PRICES]), period)
    return upsert(plain.where("NOT late").drop("late").join(late, named, "left_anti"), anew, KEYS)
