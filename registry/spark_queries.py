"""Registered queries: name to ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark import plans
from ledgerlark.functions import camel_to_snake, derived_names, iso_timestamp, stamp_text
from ledgerlark.operators import (
    asof_join,
    bad_cells,
    concat_tables,
    conform,
    drop_all_null_columns,
    drop_columns,
    merge_new_columns,
    move_column,
    outer_merge,
    pending,
    ranked,
    running_total,
    sort_columns,
    upsert,
)
from ledgerlark.operators.ordered import has_heavy_keys, null_safe_join
from ledgerlark.plans import extensions
from ledgerlark.schema import HISTORY_SCHEMA, KEY_COLUMNS
from ledgerlark.session import ensure_checkpoint_dir, written
from ledgerlark.sources import (
    column_types,
    current_table,
    drifting_quotes,
    drifting_rejects,
    field_drift,
    infer_types,
    lookup,
    parse_quotes,
    typed,
    upsert_version,
)
from ledgerlark.sources.writers import touched_partitions
from ledgerlark.streaming import keyed_averages, use_keyed_state

from . import standins as given

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Row bound of a window task in the *_split queries, low enough to cut the given tables.
SMALL_SPLIT = 400


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


PANEL_KPIS = (
    "total_net_liabilities",
    "debt_to_equity",
    "net_debt_to_equity",
    "quick_ratio",
    "current_ratio",
    "intangible_assets",
    "book_value",
    "market_value",
    "price_to_book",
    "cash_to_current_assets",
    "cash_per_share",
    "debt_quality_ratio",
    "debt_ratio",
    "enterprise_value",
)


@register
def kpi_panel(spark, sf_dir):
    kpis = plans.compute_kpis(given.statements(spark, sf_dir), given.quotes(spark, sf_dir))
    return kpis.select("symbol", "as_of_date", *PANEL_KPIS)


@register
def kpi_wide(spark, sf_dir):
    panel = given.statements(spark, sf_dir, with_lines=True)
    kpis = plans.compute_kpis(panel, given.quotes(spark, sf_dir))
    return kpis.select(*KEY_COLUMNS, "currency_code", *derived_names())


@register
def kpi_wide_split(spark, sf_dir):
    panel = given.statements(spark, sf_dir, with_lines=True)
    kpis = plans.compute_kpis(panel, given.quotes(spark, sf_dir), split_rows=5)
    return kpis.select(*KEY_COLUMNS, "currency_code", *derived_names())


@register
def kpi_debt_service(spark, sf_dir):
    panel = given.statements(spark, sf_dir).select(*KEY_COLUMNS, "total_debt")
    return plans.with_debt_change(panel).withColumnRenamed("_debt_change", "debt_change")


@register
def kpi_debt_service_split(spark, sf_dir):
    panel = given.statements(spark, sf_dir).select(*KEY_COLUMNS, "total_debt")
    return plans.with_debt_change(panel, split_rows=2).withColumnRenamed("_debt_change", "debt_change")


@register
def kpi_ebit_fallback(spark, sf_dir):
    panel = given.statements(spark, sf_dir, with_lines=True)
    return plans.with_ebit(panel.select(*KEY_COLUMNS, "ebit", "operating_income"))


def _partly_unnamed(spark, sf_dir):
    panel = given.statements(spark, sf_dir, with_lines=True)
    named = F.when(~F.col("symbol").endswith("7"), F.col("symbol"))
    return panel.select(named.alias("symbol"), *KEY_COLUMNS[1:], "ebit", "operating_income")


@register
def kpi_ebit_unnamed(spark, sf_dir):
    """Rows without a symbol are one group."""
    return plans.with_ebit(_partly_unnamed(spark, sf_dir))


@register
def kpi_ebit_unnamed_split(spark, sf_dir):
    return plans.with_ebit(_partly_unnamed(spark, sf_dir), split_rows=3)


@register
def kpi_ebit_missing(spark, sf_dir):
    panel = given.statements(spark, sf_dir, with_lines=True)
    return plans.with_ebit(panel.select(*KEY_COLUMNS, "ebit", "operating_income"), "missing")


@register
def screen_safe(spark, sf_dir):
    kept = plans.safe_metrics(given.metrics(spark, sf_dir))
    return kept.select("symbol", "shortRatio", "pegRatio", "payoutRatio", "debtToEquity").orderBy("symbol")


@register
def screen_rank(spark, sf_dir):
    rows = given.metrics(spark, sf_dir).select("symbol", "recommendationMean")
    return ranked(rows, plans.recommendation_order(), "position")


@register
def beta_rank(spark, sf_dir):
    rows = given.metrics(spark, sf_dir).select("symbol", "beta")
    return ranked(rows, plans.beta_order(), "position")


@register
def screen_full(spark, sf_dir):
    program = (("move", 4, 126), ("drop", "address2"), ("move", 5, 0), ("move", 2, 116))
    return plans.screen(given.metrics(spark, sf_dir), program=program)


@register
def drop_all_null(spark, sf_dir):
    filled = drop_all_null_columns(given.metrics(spark, sf_dir))
    return sort_columns(move_column(drop_columns(filled, ["sector", "tradeable"]), 0, 116))


@register
def scatter_data(spark, sf_dir):
    return plans.scatter_data(plans.beta_view(given.metrics(spark, sf_dir)))


@register
def tickers_by_exchange(spark, sf_dir):
    return plans.tickers(given.screener(spark, sf_dir), ["economy", "standard"])


@register
def ticker_lists(spark, sf_dir):
    listed = plans.tickers(given.screener(spark, sf_dir), ["promo"])
    regional = plans.tickers_by_region(given.companies(spark, sf_dir), "EUROPE", given.REGIONS)
    return concat_tables(listed, regional, given.companies(spark, sf_dir).select("symbol"))


@register
def tickers_filtered(spark, sf_dir):
    return plans.tickers_filtered(
        given.screener(spark, sf_dir),
        mktcap_min=10,
        mktcap_max=20_000,
        sectors=["Brand#3", "Brand#7", "Brand#12"],
        exchanges=given.EXCHANGES,
        valid_sectors=given.BRANDS,
    )


@register
def tickers_small_caps(spark, sf_dir):
    return plans.tickers_filtered(given.screener(spark, sf_dir), mktcap_max=1, exchanges=given.EXCHANGES)


@register
def biggest_n(spark, sf_dir):
    return plans.biggest_n(given.screener(spark, sf_dir), 25, exchanges=given.EXCHANGES)


@register
def biggest_n_in_sector(spark, sf_dir):
    return plans.biggest_n(
        given.screener(spark, sf_dir), 5, "Brand#7", given.EXCHANGES, given.BRANDS, strict=False
    )


@register
def tickers_by_region(spark, sf_dir):
    return plans.tickers_by_region(given.companies(spark, sf_dir), "ASIA", given.REGIONS)


def _rolled_by_type(spark, sf_dir, **split):
    recent = plans.truncate_before(given.history_by_type(spark, sf_dir), "2024-01-08")
    rolled = plans.rolling_average(recent, 120, ["close"], order=["date", "event_id"], **split)
    return rolled.withColumn("close", F.round("close", 6))


@register
def rolling_history(spark, sf_dir):
    return _rolled_by_type(spark, sf_dir)


@register
def rolling_history_split(spark, sf_dir):
    return _rolled_by_type(spark, sf_dir, split_rows=SMALL_SPLIT)


def _landed_prices(spark, sf_dir):
    """Price files in the order of landing: 20 days, the days after them, then late days and
    right prices for days that landed with wrong ones."""
    prices = given.history_by_user(spark, sf_dir).groupBy("symbol", "date").agg(F.max("close").alias("close"))
    number = F.pmod(F.xxhash64("symbol", "date"), F.lit(20))
    first = F.col("date") < iso_timestamp("2024-01-21")
    wrong = F.when(number == 1, F.col("close") + 50).otherwise(F.col("close")).alias("close")
    in_time = prices.where(number > 0).select("symbol", "date", wrong)
    return [in_time.where(first), in_time.where(~first), prices.where(number <= 1)]


@register
def rolling_keyed(spark, sf_dir):
    """Rolling means that a stream keeps in a versioned table, one run per landing."""
    path = f"{ensure_checkpoint_dir(spark)}/registry-{uuid.uuid4().hex}"
    store = "spark.sql.streaming.stateStore.providerClass"
    provider = spark.conf.get(store)
    use_keyed_state(spark)
    try:
        for at, prices in enumerate(_landed_prices(spark, sf_dir)):
            conform(prices, HISTORY_SCHEMA).write.parquet(f"{path}/landed/{at}")
            landed = spark.readStream.schema(HISTORY_SCHEMA).parquet(f"{path}/landed/*")
            keyed_averages(landed, f"{path}/table", f"{path}/progress", 12, lateness=3).awaitTermination()
    finally:
        spark.conf.set(store, provider)
    return current_table(spark, f"{path}/table").select("symbol", "date", "close", F.round("close_mean", 6).alias("close_mean"))


def _rolled_with_ties(spark, sf_dir, order, **split):
    """Many rows share an hour; each text and each number orders the same rows in its own way."""
    rows = given.history_by_type(spark, sf_dir).select("symbol", order.alias("place"), "close")
    rolled = plans.rolling_average(rows, 12, ["close"], order=["place"], **split)
    return rolled.withColumn("close", F.round("close", 6))


def _hour():
    return F.substring(F.col("date").cast("string"), 1, 13)


@register
def rolling_ties(spark, sf_dir):
    return _rolled_with_ties(spark, sf_dir, _hour())


@register
def rolling_ties_split(spark, sf_dir):
    return _rolled_with_ties(spark, sf_dir, _hour(), split_rows=25)


@register
def rolling_numbers_split(spark, sf_dir):
    return _rolled_with_ties(spark, sf_dir, -F.col("close"), split_rows=25)


def _rolled_by_place(spark, sf_dir, place):
    """Order values that differ in their last digits alone."""
    rows = given.history_by_type(spark, sf_dir).select("symbol", place.alias("place"), "event_id", "close")
    rolled = plans.rolling_average(rows, 12, ["close"], order=["place"], split_rows=25)
    return rolled.select("symbol", "event_id", F.round("close", 6).alias("close"))


@register
def rolling_decimals_split(spark, sf_dir):
    """38 digits, rising with the id."""
    start = F.lit("10000000000000000000000000000000000000").cast("decimal(38,0)")
    return _rolled_by_place(spark, sf_dir, (start + F.col("event_id")).cast("decimal(38,0)"))


@register
def rolling_micros_split(spark, sf_dir):
    """Seconds as doubles, a microsecond apart."""
    return _rolled_by_place(spark, sf_dir, F.lit(1.7e9) - F.col("event_id") / F.lit(1e6))


@register
def rolling_texts_split(spark, sf_dir):
    """Texts that differ after 300 characters."""
    return _rolled_by_place(spark, sf_dir, F.concat(F.lit("x" * 300), F.lpad(F.col("event_id").cast("string"), 12, "0")))


@register
def running_total_split(spark, sf_dir):
    """Running sums along 38 digits."""
    start = F.lit("10000000000000000000000000000000000000").cast("decimal(38,0)")
    rows = given.history_by_type(spark, sf_dir).select(
        "symbol", "event_id", (start - F.col("event_id")).cast("decimal(38,0)").alias("place"), F.col("close").cast("decimal(18,4)").alias("close")
    )
    totals = running_total(rows, ["symbol"], ["place"], "close", "total", split_rows=25)
    return totals.select("symbol", "event_id", F.col("total").cast("decimal(28,4)").cast("string").alias("total"))


@register
def history_at_dates(spark, sf_dir):
    averaged = plans.average_history(
        given.history_by_user(spark, sf_dir), given.error_dates(spark, sf_dir), period=20, start="2024-01-03"
    )
    return averaged.withColumn("close", F.round("close", 6))


@register
def history_asof(spark, sf_dir):
    return asof_join(
        given.day_ends(spark, sf_dir), given.history_by_user(spark, sf_dir), ["symbol"], "date", "date", ["close"]
    )


@register
def history_asof_split(spark, sf_dir):
    dates = given.history_by_type(spark, sf_dir).select("symbol", F.date_add("date", 1).cast("timestamp_ntz").alias("date"))
    return asof_join(
        dates.distinct(),
        given.history_by_type(spark, sf_dir).select("symbol", "date", "close"),
        ["symbol"],
        "date",
        "date",
        ["close"],
        split_rows=SMALL_SPLIT,
        slices=64,
    )


@register
def average_history_asof(spark, sf_dir):
    averaged = plans.average_history_asof(
        given.history_by_user(spark, sf_dir), given.day_ends(spark, sf_dir), period=5, start="2024-01-03"
    )
    return averaged.withColumn("close", F.round("close", 6))


@register
def symbol_lookup(spark, sf_dir):
    return lookup(given.history_by_type(spark, sf_dir), "click")


def _companies_of_year(spark, sf_dir, year):
    orders = given.table(spark, sf_dir, "orders")
    first, last = (iso_timestamp(f"{y}-01-01") for y in (year, year + 1))
    inside = (F.col("o_orderdate") >= first) & (F.col("o_orderdate") < last)
    return orders.where(inside).select(given.code("C", "o_custkey").alias("symbol"))


@register
def refresh_pending(spark, sf_dir):
    listed = given.table(spark, sf_dir, "customer").select(given.code("C", "c_custkey").alias("symbol"))
    return pending(listed, _companies_of_year(spark, sf_dir, 1998))


def _slices_of_panel(spark, sf_dir):
    panel = given.statements(spark, sf_dir).select(
        *KEY_COLUMNS, "total_debt", F.nullif("stockholders_equity", F.lit(0.0)).alias("stockholders_equity")
    )
    year = F.year("as_of_date")
    restated = F.when(F.col("stockholders_equity").isNull() & (year == 1998), F.col("total_debt") + 1)
    old = panel.where(year <= 1998)
    new = panel.where(year >= 1998).withColumn("total_debt", F.coalesce(restated, F.col("total_debt")))
    return old, new


@register
def refresh_merge(spark, sf_dir):
    return outer_merge(*_slices_of_panel(spark, sf_dir))


@register
def refresh_upsert(spark, sf_dir):
    return upsert(*_slices_of_panel(spark, sf_dir), KEY_COLUMNS)


@register
def refresh_versioned(spark, sf_dir):
    """The same upsert in a stored table whose versions become visible in one step."""
    old, new = _slices_of_panel(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark)}/versioned-{uuid.uuid4().hex}"
    upsert_version(old, path, KEY_COLUMNS, ["symbol"], buckets=8)
    upsert_version(new, path, KEY_COLUMNS, ["symbol"], batch="second")
    upsert_version(new.limit(0), path, KEY_COLUMNS, ["symbol"], batch="second")  # a batch that runs again
    return current_table(spark, path)


@register
def conform_bad_cells(spark, sf_dir):
    """Cells that are no numbers become NULL and stop nothing."""
    price = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("n/a "), "o_orderstatus")).otherwise(F.col("o_totalprice").cast("string"))
    raw = given.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"), price.alias("total_debt"), F.col("o_orderstatus").alias("ebit"), F.lit(1).alias("unknown")
    )
    fields = T.StructType([T.StructField("order_id", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("total_debt", "ebit", "net_income")]])
    return conform(raw, fields)


@register
def conform_bad_counts(spark, sf_dir):
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice").cast("string")).otherwise(F.lit("-"))
    raw = given.table(spark, sf_dir, "orders").select(price.alias("total_debt"), F.col("o_orderstatus").alias("ebit"))
    return bad_cells(raw, T.StructType([T.StructField(c, T.DoubleType()) for c in ("total_debt", "ebit", "net_income")]))


@register
def refresh_upsert_nulls(spark, sf_dir):
    """Rows with NULL dates and NULL partitions: what the touched ones keep, what is new, and the others."""
    undated = F.when(F.col("total_debt") > 0, F.col("as_of_date"))
    number = F.substring("symbol", 2, 20).cast("int") % 9
    part = F.when(number > 0, number)
    old, new = (rows.withColumns({"as_of_date": undated, "part": part}) for rows in _slices_of_panel(spark, sf_dir))
    new = new.where(F.coalesce("part", F.lit(0)) % 3 == 0)
    touched = touched_partitions(old, new, ["part"])
    others = null_safe_join(old, new.select("part").distinct(), ["part"], "left_anti")
    return upsert(touched, new, KEY_COLUMNS).unionByName(others)


@register
def refresh_kpis(spark, sf_dir):
    """Companies without KPI rows of 1998 are computed and added to the table."""
    quotes = given.quotes(spark, sf_dir)
    panel = given.statements(spark, sf_dir)
    existing = plans.compute_kpis(panel, quotes, symbols=_companies_of_year(spark, sf_dir, 1998))
    table = plans.refresh_kpis(quotes.select("symbol"), panel, quotes, existing)
    return table.select("symbol", "as_of_date", "debt_ratio", "market_value")


def _restated_panel(spark, sf_dir):
    """The panel up to 1997 as old rows; later ones as new, and some old ones restated: other
    debt, an EBIT that becomes 0 or stops being it, and rows that say the same again."""
    # Old and landed rows are read several times, the lines behind them once.
    panel, _ = written(given.statements(spark, sf_dir, with_lines=True), {"rows": F.count(F.lit(1))})
    year, number = F.year("as_of_date"), F.substring("symbol", 2, 20).cast("int")
    old = panel.where(year <= 1997)
    again = (year > 1997) | (number % 11 == F.pmod(year, F.lit(11)))
    debt = F.when((year <= 1997) & (number % 2 == 0), F.col("total_debt") + 1000).otherwise(F.col("total_debt"))
    ebit = F.when((year <= 1997) & (number % 3 == 0), F.when(F.col("ebit") == 0, F.lit(7.0)).otherwise(F.lit(0.0))).otherwise(F.col("ebit"))
    return old, panel.where(again).withColumns({"total_debt": debt, "ebit": ebit})


RESTATED_KPIS = ("debt_service", "return_on_capital_employed", "debt_ratio", "market_value")


@register
def refresh_restated(spark, sf_dir):
    """The stored KPI table after restated statements, of which only the reached rows are computed."""
    quotes = given.quotes(spark, sf_dir)
    old, landed = _restated_panel(spark, sf_dir)
    table = plans.propagate(old, landed, quotes, plans.compute_kpis(old, quotes))
    return table.select("symbol", "as_of_date", *RESTATED_KPIS)


@register
def refresh_reach(spark, sf_dir):
    """Which rows the restated statements reach, and why."""
    old, landed = _restated_panel(spark, sf_dir)
    reached = plans.reached_rows(old, plans.restated(old, landed))
    return reached.select("symbol", "as_of_date", "reason", F.round("_debt_change", 6).alias("debt_change"))


@register
def merge_columns(spark, sf_dir):
    left = given.table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    right = given.table(spark, sf_dir, "nation").withColumn("c_name", F.col("n_name"))
    return merge_new_columns(left, right, ["n_nationkey"])


@register
def html_rows(spark, sf_dir):
    pages = given.table(spark, sf_dir, "pages").select("page_id", "html")
    rows = plans.html_rows(pages, r"(?is)<li>(.*?)</li>", r"[\">]([^\"<>]*)[\"<]")
    target, text = F.get("cells", F.lit(0)), F.get("cells", F.lit(1))
    return rows.select(
        "page_id",
        target.alias("target"),
        text.alias("label"),
        F.concat_ws(":", target, text).alias("pair"),
        target.contains("th").alias("has_th"),
        text.isin("the", "The", "to").alias("is_word"),
    )


@register
def snake_values(spark, sf_dir):
    joined = F.concat("p_type", "p_brand", F.lit("NetPPEValue"), "p_name")
    return given.table(spark, sf_dir, "part").select("p_partkey", camel_to_snake(joined).alias("snake"))


def _quote_replies(spark, sf_dir):
    """Each event's JSON is extended to a quote reply, then parsed as one."""
    body = F.replace(F.col("props"), F.lit('"k"'), F.lit('"sharesOutstanding"'))
    price = F.concat(F.lit(', "twoHundredDayAverage": '), F.col("value"), F.lit(', "bidSize": '), F.col("user_id"), F.lit("}"))
    reply = F.concat(F.lit('{"'), "event_type", F.lit('": '), F.replace(body, F.lit("}"), price), F.lit("}"))
    return given.table(spark, sf_dir, "events").select("ts", reply.alias("value"))


@register
def json_fields(spark, sf_dir):
    return parse_quotes(_quote_replies(spark, sf_dir))


@register
def quotes_newest(spark, sf_dir):
    """Of the many replies for a symbol, the one that landed last, on each of its events."""
    quotes = parse_quotes(_quote_replies(spark, sf_dir), landed="ts")
    events = given.history_by_type(spark, sf_dir).select("symbol", "event_id")
    return extensions.with_order_sizes(plans.with_quotes(events, quotes), quotes)


@register
def stamp_texts(spark, sf_dir):
    return given.table(spark, sf_dir, "events").select("event_id", stamp_text(F.col("ts")).alias("stamp"))


@register
def kpi_growth(spark, sf_dir):
    panel = given.statements(spark, sf_dir, with_lines=True)
    heavy = has_heavy_keys(panel, ["symbol"])  # measured once for both windows
    kpis = plans.compute_kpis(panel, given.quotes(spark, sf_dir), heavy=heavy)
    return extensions.growth_and_yields(kpis, heavy=heavy).select(
        "symbol",
        "as_of_date",
        "free_cash_flow_growth",
        "earnings_per_share_growth",
        "peg_ratio",
        "free_cash_flow_yield",
    )


@register
def amounts_in_usd(spark, sf_dir):
    return extensions.to_usd(given.segment_amounts(spark, sf_dir), given.segment_rates(spark, sf_dir), ["total_debt"])


@register
def split_effects(spark, sf_dir):
    history = given.splits_by_user(spark, sf_dir)
    return extensions.split_effect(history).withColumn("split_effect", F.round("split_effect", 6))


@register
def split_effects_split(spark, sf_dir):
    history = given.splits_by_user(spark, sf_dir)
    effects = extensions.split_effect(history, split_rows=40)
    return effects.withColumn("split_effect", F.round("split_effect", 6))


@register
def insider_purchases(spark, sf_dir):
    panel = given.statements(spark, sf_dir).select("symbol", "as_of_date", "total_debt")
    return extensions.insider_purchases(panel, given.urgent_purchases(spark, sf_dir))


@register
def metrics_types(spark, sf_dir):
    """The narrowest type of every column of a metrics file."""
    return column_types(given.text_metrics(spark, sf_dir))


@register
def metrics_typed(spark, sf_dir):
    """The cells in these types."""
    text = given.text_metrics(spark, sf_dir)
    return typed(text, infer_types(text))


@register
def quotes_drifting(spark, sf_dir):
    """Quotes from replies with missing, unknown and wrongly typed fields."""
    return drifting_quotes(given.drifting_replies(spark, sf_dir))


@register
def quotes_drift(spark, sf_dir):
    """What became of every field of these replies."""
    return field_drift(given.drifting_replies(spark, sf_dir))


@register
def quotes_rejected(spark, sf_dir):
    """The replies, and the symbols in them, that gave no quote."""
    return drifting_rejects(given.drifting_replies(spark, sf_dir)).select("event_id", "symbol", "reason", "reply")


@register
def host_list(spark, sf_dir):
    """Hosts of chosen countries in the tables of all pages."""
    return plans.host_list(plans.html_rows(plans.table_bodies(given.host_pages(spark, sf_dir))))


@register
def host_names(spark, sf_dir):
    """Cells with entities, of the rows that have them."""
    cells = plans.html_rows(plans.table_bodies(given.host_pages(spark, sf_dir)))
    return cells.select("page_id", F.get("cells", F.lit(0)).alias("host"), F.get("cells", F.lit(3)).alias("name"))


@register
def column_program(spark, sf_dir):
    """The whole column program on 130 columns; the order of the columns is in the result."""
    placed = plans.reorder_columns(given.wide_metrics(spark, sf_dir))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in placed.columns]
    return placed.select("symbol", F.concat_ws(" ", *cells).alias("cells"))


@register
def sorted_columns(spark, sf_dir):
    placed = sort_columns(given.wide_metrics(spark, sf_dir).drop("recommendationMean"))
    return placed.select("symbol", F.concat_ws(" ", *placed.columns).alias("cells"))


@register
def kpi_valuation(spark, sf_dir):
    """All figures of the valuation extension, with both order sizes."""
    panel, quotes = given.valued_statements(spark, sf_dir), given.quotes(spark, sf_dir)
    sized = quotes.withColumns({"bidSize": F.col("sharesOutstanding") + 1, "askSize": F.col("twoHundredDayAverage") * 2})
    heavy = has_heavy_keys(panel, ["symbol"])
    figures = extensions.growth_and_yields(plans.compute_kpis(panel, quotes, heavy=heavy), heavy=heavy)
    return extensions.with_order_sizes(figures, sized).select(
        "symbol",
        "as_of_date",
        "net_cash",
        "free_cash_flow_margin",
        "ev_to_sales",
        "ev_to_ebitda",
        "buyback_yield",
        "return_on_invested_capital",
        "payout_ratio",
        "bid_size",
        "ask_size",
    )


@register
def short_interest(spark, sf_dir):
    """Shares sold short, over the float and over all shares."""
    rows = given.table(spark, sf_dir, "part").select(
        given.code("P", "p_partkey").alias("symbol"),
        F.col("p_size").cast("double").alias("sharesShort"),
        (F.col("p_partkey") % 10).cast("double").alias("floatShares"),
        F.col("p_retailprice").alias("sharesOutstanding"),
    )
    return extensions.short_interest(rows)


@register
def biggest_n_lazy(spark, sf_dir):
    """The same largest companies; too few of them would be found by the plan itself."""
    return plans.biggest_n(given.screener(spark, sf_dir), 25, exchanges=given.EXCHANGES, lazy=True)


@register
def kpi_all_columns(spark, sf_dir):
    """All 184 columns."""
    return plans.compute_kpis(given.statements(spark, sf_dir, with_lines=True), given.quotes(spark, sf_dir))
