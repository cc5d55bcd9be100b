"""Fixed layout of the statement and KPI tables."""

from __future__ import annotations

from pyspark.sql import types as T

KEY_COLUMNS = ("symbol", "as_of_date", "period_type")

# The base columns of the statement panel, in output order.
BASE_COLUMNS = tuple(
    """
    as_of_date symbol period_type currency_code
    accounts_payable accounts_receivable accumulated_depreciation
    available_for_sale_securities basic_average_shares basic_eps
    beginning_cash_position capital_expenditure capital_stock
    cash_and_cash_equivalents cash_cash_equivalents_and_short_term_investments
    cash_dividends_paid cash_equivalents cash_financial
    cash_flow_from_continuing_financing_activities
    cash_flow_from_continuing_investing_activities
    cash_flow_from_continuing_operating_activities
    change_in_account_payable change_in_cash_supplemental_as_reported
    change_in_inventory change_in_other_current_assets
    change_in_other_current_liabilities change_in_other_working_capital
    change_in_payable change_in_payables_and_accrued_expense
    change_in_receivables change_in_working_capital
    changes_in_account_receivables changes_in_cash commercial_paper
    common_stock common_stock_dividend_paid common_stock_equity
    common_stock_issuance common_stock_payments cost_of_revenue
    current_assets current_debt current_debt_and_capital_lease_obligation
    current_deferred_liabilities current_deferred_revenue current_liabilities
    deferred_income_tax deferred_tax depreciation_amortization_depletion
    depreciation_and_amortization diluted_average_shares diluted_eps
    diluted_ni_availto_com_stockholders ebit end_cash_position
    financing_cash_flow free_cash_flow
    gains_losses_not_affecting_retained_earnings gross_ppe gross_profit
    income_tax_paid_supplemental_data interest_expense
    interest_expense_non_operating interest_income
    interest_income_non_operating interest_paid_supplemental_data inventory
    invested_capital investing_cash_flow investmentin_financial_assets
    investments_and_advances issuance_of_capital_stock issuance_of_debt
    land_and_improvements leases long_term_debt
    long_term_debt_and_capital_lease_obligation long_term_debt_issuance
    long_term_debt_payments machinery_furniture_equipment
    net_business_purchase_and_sale net_common_stock_issuance net_debt
    net_income net_income_common_stockholders
    net_income_continuous_operations
    net_income_from_continuing_and_discontinued_operation
    net_income_from_continuing_operation_net_minority_interest
    net_income_from_continuing_operations
    net_income_including_noncontrolling_interests net_interest_income
    net_investment_purchase_and_sale net_issuance_payments_of_debt
    net_long_term_debt_issuance net_non_operating_interest_income_expense
    net_other_financing_charges net_other_investing_changes net_ppe
    net_ppe_purchase_and_sale net_short_term_debt_issuance
    net_tangible_assets non_current_deferred_liabilities
    non_current_deferred_revenue non_current_deferred_taxes_liabilities
    normalized_ebitda normalized_income operating_cash_flow
    operating_expense operating_income operating_revenue
    ordinary_shares_number other_current_assets other_current_borrowings
    other_current_liabilities other_income_expense other_non_cash_items
    other_non_current_assets other_non_current_liabilities
    other_non_operating_income_expenses other_receivables
    other_short_term_investments payables payables_and_accrued_expenses
    pretax_income properties purchase_of_business purchase_of_investment
    purchase_of_ppe receivables reconciled_cost_of_revenue
    reconciled_depreciation repayment_of_debt repurchase_of_capital_stock
    research_and_development retained_earnings sale_of_investment
    selling_general_and_administration share_issued
    short_term_debt_payments stock_based_compensation stockholders_equity
    tangible_book_value tax_effect_of_unusual_items tax_provision
    tax_rate_for_calcs total_assets total_capitalization total_debt
    total_equity_gross_minority_interest total_expenses
    total_liabilities_net_minority_interest total_non_current_assets
    total_non_current_liabilities_net_minority_interest
    total_operating_income_as_reported total_revenue
    tradeand_other_payables_non_current working_capital
    """.split()
)

_NON_MEASURES = {
    "as_of_date": T.TimestampNTZType(),
    "symbol": T.StringType(),
    "period_type": T.StringType(),
    "currency_code": T.StringType(),
}

STATEMENT_SCHEMA = T.StructType(
    [T.StructField(name, _NON_MEASURES.get(name, T.DoubleType())) for name in BASE_COLUMNS]
)

TICKER_SCHEMA = T.StructType([T.StructField("symbol", T.StringType())])

QUOTE_SCHEMA = T.StructType(
    [
        T.StructField("twoHundredDayAverage", T.DoubleType()),
        T.StructField("sharesOutstanding", T.DoubleType()),
        T.StructField("bidSize", T.DoubleType()),
        T.StructField("askSize", T.DoubleType()),
    ]
)
# When a quote reply landed: tells which of several for one symbol counts.
LANDED = "landed_at"

HISTORY_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("date", T.TimestampNTZType())]
    + [
        T.StructField(name, T.DoubleType())
        for name in ("open", "high", "low", "close", "volume", "adjclose", "dividends", "splits")
    ]
)

SCREENER_ROW_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("marketCap", T.StringType()),
        T.StructField("sector", T.StringType()),
    ]
)

METRIC_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType())]
    + [
        T.StructField(name, T.DoubleType())
        for name in ("shortRatio", "pegRatio", "payoutRatio", "debtToEquity", "recommendationMean", "beta")
    ]
    + [T.StructField("sector", T.StringType()), T.StructField("recommendationKey", T.StringType())]
)
