"""The given tables in the shape of the engine's inputs.

Sums of money are rounded to the digits that the exact sum has, so that they do
not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import ratio
from ledgerlark.operators import latest_rows
from ledgerlark.sources import parse_statements

EXCHANGES = ("economy", "standard", "promo", "large", "medium", "small")
BRANDS = tuple(f"Brand#{n}" for n in range(1, 26))
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def raw_statements(spark: SparkSession, sf_dir: str, with_lines: bool = False) -> DataFrame:
    """Annual statements: one row per customer and order year, camelCase columns.

    Lines are summed per order before they meet the orders.
    """
    price = F.col("o_totalprice")
    status, urgency = F.col("o_orderstatus"), F.col("o_orderpriority")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, price).otherwise(F.lit(0.0)))

    measures = {
        "TotalAssets": F.sum(price),
        "TotalDebt": total(status == "O"),
        "StockholdersEquity": total(status == "F"),
        "CurrentLiabilities": total(status == "P"),
        "TotalLiabilitiesNetMinorityInterest": total(status != "F"),
        "CurrentAssets": total(urgency.isin("1-URGENT", "2-HIGH")),
        "CashAndCashEquivalents": total(urgency == "1-URGENT"),
        "NetTangibleAssets": total(urgency != "5-LOW"),
    }
    orders = table(spark, sf_dir, "orders")
    if with_lines:
        orders = orders.join(_order_lines(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        measures |= {
            "EBIT": F.sum("accepted"),
            "OperatingIncome": F.sum(F.col("accepted") + F.col("kept")),
            "PretaxIncome": F.sum("shipped"),
            "NetIncome": F.sum("after_tax"),
            "InterestExpense": F.sum("open_tax"),
            "FreeCashFlow": F.sum(F.col("kept") - F.col("returned")),
        }
    summed = orders.groupBy("o_custkey", F.year("o_orderdate").alias("_year")).agg(
        *[F.round(value, 6).alias(name) for name, value in measures.items()]
    )
    return summed.select(
        code("C", "o_custkey").alias("symbol"),
        F.make_timestamp_ntz("_year", F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0)).alias("asOfDate"),
        F.lit("12M").alias("periodType"),
        F.lit("USD").alias("currencyCode"),
        *measures,
    )


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    extended, tax, net = F.col("extended"), F.col("tax"), F.col("net")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")

    def total(condition: Column, value: Column) -> Column:
        return F.sum(F.when(condition, value).otherwise(F.lit(0.0)))

    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_returnflag",
        "l_linestatus",
        F.col("l_extendedprice").alias("extended"),
        F.col("l_tax").alias("tax"),
        (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("net"),
    )
    return lines.groupBy("l_orderkey").agg(
        total(flag == "A", net).alias("accepted"),
        total(flag == "N", net).alias("kept"),
        total(flag == "R", net).alias("returned"),
        total(status == "F", net).alias("shipped"),
        total(status == "F", net * (F.lit(1) - tax)).alias("after_tax"),
        F.sum(F.when(status == "O", extended * tax)).alias("open_tax"),
    )


def statements(spark: SparkSession, sf_dir: str, with_lines: bool = False) -> DataFrame:
    """The same rows as the conformed snake_case panel."""
    return parse_statements(raw_statements(spark, sf_dir, with_lines))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes: a negative balance is no price, and nation 0 has no shares."""
    balance = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        code("C", "c_custkey").alias("symbol"),
        F.when(balance >= 0, balance).alias("twoHundredDayAverage"),
        (F.col("c_nationkey") * 1000).cast("double").alias("sharesOutstanding"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every customer from its latest statement; three columns are all NULL."""
    latest = latest_rows(
        statements(spark, sf_dir).select(
            "symbol",
            "as_of_date",
            "total_assets",
            "total_debt",
            "stockholders_equity",
            "current_liabilities",
            "current_assets",
            "cash_and_cash_equivalents",
        ),
        ["symbol"],
        ["as_of_date"],
    )
    customer = table(spark, sf_dir, "customer").select(
        code("C", "c_custkey").alias("symbol"), "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    col = F.col
    grade = F.when(col("c_acctbal") >= 0, (col("c_nationkey") % 5 + 1).cast("double"))
    return customer.join(latest, "symbol", "left").select(
        "symbol",
        F.lit(None).cast("string").alias("address2"),
        F.lit(None).cast("string").alias("fax"),
        F.lit(None).cast("double").alias("maxAge"),
        ratio(col("current_liabilities"), col("total_debt")).alias("shortRatio"),
        ratio(col("total_debt"), col("current_assets")).alias("pegRatio"),
        ratio(col("cash_and_cash_equivalents"), col("total_assets")).alias("payoutRatio"),
        (ratio(col("total_debt"), col("stockholders_equity")) * F.lit(100.0)).alias("debtToEquity"),
        grade.alias("recommendationMean"),
        F.when(col("c_acctbal") >= 0, col("c_acctbal") / F.lit(1000.0)).alias("beta"),
        col("c_mktsegment").alias("sector"),
        F.when(grade < 2.5, "buy").when(grade < 3.5, "hold").when(grade.isNotNull(), "sell").alias("recommendationKey"),
    )


def screener(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screener rows: every part is a company, some with class suffixes or no market cap."""
    key, size = F.col("p_partkey"), F.col("p_size")
    suffix = F.when(key % 14 == 0, ".A").when(key % 14 == 7, "^B").otherwise("")
    unit = F.when(key % 3 == 0, "M").when(key % 3 == 1, "B").otherwise("")
    cap = F.when(size == 50, None).when(size == 49, "").otherwise(F.concat(F.lit("$"), size.cast("string"), unit))
    return table(spark, sf_dir, "part").select(
        F.concat(code("P", "p_partkey"), suffix).alias("symbol"),
        F.lower("p_type").alias("exchange"),
        F.col("p_brand").alias("sector"),
        cap.alias("marketCap"),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their region; a low balance marks a class share."""
    suffix = F.when(F.col("s_acctbal") < 1000, ".A").otherwise("")
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.concat(code("S", "s_suppkey"), suffix).alias("symbol"), F.col("r_name").alias("region"))
    )


def history_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price history with the event type as symbol: five symbols hold all rows."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").alias("date"), "event_id", F.col("value").alias("close")
    )


def history_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price history with the user as symbol."""
    return table(spark, sf_dir, "events").select(
        code("U", "user_id").alias("symbol"), F.col("ts").alias("date"), F.col("value").alias("close")
    )


def error_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI dates that are trading dates: the times of error events."""
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "error")
        .select(code("U", "user_id").alias("symbol"), F.col("ts").alias("date"))
    )


def day_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI dates off the trading dates: the midnight after each active day of a user."""
    midnight = F.date_add(F.col("ts").cast("date"), 1).cast("timestamp_ntz")
    return (
        table(spark, sf_dir, "events")
        .select(code("U", "user_id").alias("symbol"), midnight.alias("date"))
        .distinct()
    )


def segment_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange rates: a customer segment is a currency, and its orders of a day give the rate."""
    return (
        _segment_orders(spark, sf_dir)
        .groupBy("currency_code", F.col("o_orderdate").alias("date"))
        .agg((F.count(F.lit(1)) / F.lit(10.0)).alias("usd_rate"))
    )


def segment_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in the currency of the segment, dated a day before the order."""
    return _segment_orders(spark, sf_dir).select(
        "o_orderkey",
        "currency_code",
        F.date_sub(F.col("o_orderdate").cast("date"), 1).cast("timestamp_ntz").alias("as_of_date"),
        F.col("o_totalprice").alias("total_debt"),
    )


def _segment_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    currency = F.when(F.col("c_mktsegment") == "BUILDING", "USD").otherwise(F.col("c_mktsegment"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("currency_code", currency)


def splits_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split factors: a high value is a split, a low one a reverse split."""
    value = F.col("value")
    factor = F.when(value > 90, F.lit(2.0)).when(value < 2, F.lit(0.5)).otherwise(F.lit(0.0))
    return table(spark, sf_dir, "events").select(
        code("U", "user_id").alias("symbol"), F.col("ts").alias("date"), factor.alias("splits")
    )


def urgent_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insider purchases: urgent orders of a company, dated by the end of their year."""
    year_end = F.make_timestamp_ntz(F.year("o_orderdate"), F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0))
    return (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderpriority") == "1-URGENT")
        .select(code("C", "o_custkey").alias("symbol"), year_end.alias("as_of_date"), (F.col("o_orderkey") % 90 + 1).alias("shares"))
    )


def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as a metrics file has them: mixed kinds, missing ones, and a column without any."""
    key = F.col("o_orderkey")
    whole, fraction = key.cast("string"), F.concat(key.cast("string"), F.lit(".25"))

    def every(n: int, cell: str, other: Column) -> Column:
        return F.when(key % n == 0, F.lit(cell)).otherwise(other)

    return table(spark, sf_dir, "orders").select(
        whole.alias("order_id"),
        every(5, "NA", every(7, "  12 ", whole)).alias("whole"),
        every(2, "1e3", every(3, "nan", fraction)).alias("mixed"),
        every(2, "True", every(3, "", F.lit("false"))).alias("flag"),
        every(2, "true", F.lit("1")).alias("flag_or_number"),
        every(4, "n/a", fraction).alias("price"),
        every(1000, "-", whole).alias("dashed"),
        F.concat(F.lit("9000000000000000"), F.lpad((key % 1000).cast("string"), 6, "0")).alias("long_number"),
        every(2, "null", F.lit(None).cast("string")).alias("nothing"),
        every(9, "#N/A", F.col("o_orderpriority")).alias("level"),
    )


def drifting_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote replies in which fields come and go, change their type or are renamed, and replies that are none."""
    at, value = F.col("event_id"), F.col("value").cast("decimal(18,2)").cast("string")
    price = F.when(at % 6 == 1, F.concat(F.lit('"'), value, F.lit('"'))).when(at % 6 == 2, '"n/a"').when(at % 6 == 3, "null").otherwise(value)
    size = F.when(at % 4 == 0, F.concat(F.lit(', "bidSize": '), "user_id")).when(at % 4 == 1, ', "bidSize": {"lots": 3}').otherwise("")
    more = F.when(at % 5 == 0, ', "note": "late"').otherwise("")
    fields = F.concat(F.lit('{"twoHundredDayAverage": '), price, size, more, F.lit(', "askSize": '), at.cast("string"), F.lit("}"))
    entry = F.concat(F.lit('{"'), "event_type", F.lit('": '), fields, F.lit("}"))
    reply = (
        F.when(at % 11 == 1, "Too Many Requests")
        .when(at % 11 == 2, "[1, 2]")
        .when(at % 11 == 3, F.concat(F.lit('{"gone": null, '), F.substring(entry, 2, 1_000_000)))
        .when(at % 11 == 4, "")
        .otherwise(entry)
    )
    return table(spark, sf_dir, "events").select("event_id", reply.alias("value"))


def host_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of hosts per page, from its address; some cells have entities, some rows too few cells."""
    at = F.col("page_id")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    country = F.upper(F.regexp_extract("url", "://[^/]*/([a-z]*)", 1))
    secure = F.when(at % 3 == 0, "yes").when(at % 3 == 1, "no").otherwise("yes, maybe")
    cells = [host, (at % 100 + 8000).cast("string"), country, F.concat(country, F.lit(" &amp; Co. &lt;&#233;&#xE9;&amp;lt;")), F.lit("elite"), F.lit("no"), secure]
    row = F.concat(*[F.concat(F.lit('<td class="c">'), c, F.lit("</td>")) for c in cells])
    body = F.concat(F.lit("<table><thead><tr><td>h</td></tr></thead><tbody><tr>"), row, F.lit("</tr>\n<tr><td>short</td></tr></tbody></table>"))
    return table(spark, sf_dir, "pages").select("page_id", body.alias("html"))


# Columns of the wide metrics table, apart from the symbol and the recommendation.
WIDE = tuple(f"c{n}" for n in range(118)) + ("address2", "uuid", "companyOfficers", "maxAge", "tradeable", "fax", "messageBoardId", "quoteType", "gmtOffSetMilliseconds", "isEsgPopulated")


def wide_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """130 columns whose cells tell the column they come from."""
    customer = table(spark, sf_dir, "customer")
    return customer.select(
        code("C", "c_custkey").alias("symbol"),
        F.when(F.col("c_acctbal") >= 0, (F.col("c_nationkey") % 5 + 1).cast("double")).alias("recommendationMean"),
        *[F.concat(F.lit(f"{name}="), F.col("c_custkey").cast("string")).alias(name) for name in WIDE],
    )


# Statement columns that the extension figures read, from those the panel has.
VALUED = {
    "total_revenue": "total_assets",
    "normalized_ebitda": "current_assets",
    "cash_cash_equivalents_and_short_term_investments": "cash_and_cash_equivalents",
    "repurchase_of_capital_stock": "-current_liabilities",
    "invested_capital": "net_tangible_assets",
    "cash_dividends_paid": "-interest_expense",
    "tax_rate_for_calcs": "CASE WHEN total_debt > stockholders_equity THEN 0.25D ELSE 0.5D END",
}


def valued_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with the columns of the extension figures filled."""
    return statements(spark, sf_dir, with_lines=True).withColumns({name: F.expr(value) for name, value in VALUED.items()})
