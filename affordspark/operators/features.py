"""Row-wise engineered features, redundant-column drop, target separation and
the loan summary shown to an applicant. All single projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affordspark.functions.scalar import format_currency, format_percent, ratio_plus_one
from affordspark.schema import COLS_TO_DROP, EXPENSE_COLS, REPORT_LINES, TARGET_CLF, TARGET_REG

_NEEDED = ["Monthly_Salary", "Current_Emi_Amount", "Bank_Balance", "Emergency_Fund",
           "Family_Size", "Dependents", "Requested_Amount", "Requested_Tenure"]


def engineered_features(df: DataFrame) -> DataFrame:
    """Append the seven affordability columns.

    Total_Expenses sums the expense columns that exist, a NULL counting as 0.
    Ratios divide by (x + 1); a zero divisor gives NULL (not an error/inf)."""
    missing = [c for c in _NEEDED if c not in df.columns]
    if missing:
        raise ValueError(f"engineered_features needs columns {missing}")
    present = [c for c in EXPENSE_COLS if c in df.columns]
    total = F.lit(0.0)
    for c in present:
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    sal = F.col("Monthly_Salary")
    return df.select(
        "*",
        total.alias("Total_Expenses"),
        ratio_plus_one(total, sal).alias("Expense_Salary_Ratio"),
        ratio_plus_one("Current_Emi_Amount", sal).alias("Emi_Salary_Ratio"),
        ratio_plus_one(F.col("Bank_Balance") + F.col("Emergency_Fund"), sal).alias("Liquidity_Score"),
        (F.col("Family_Size") + F.lit(1.5) * F.col("Dependents")).cast("double").alias("Household_Load"),
        ratio_plus_one("Requested_Amount", sal).alias("Requested_Amount_Ratio"),
        ratio_plus_one("Requested_Amount", F.col("Requested_Tenure")).alias("Expected_Emi_If_Approved"),
    )


def drop_redundant(df: DataFrame, cols=None) -> DataFrame:
    return df.drop(*[c for c in (cols or COLS_TO_DROP) if c in df.columns])


def separate_targets(df: DataFrame, key: str = "application_id"):
    """(X, y_reg, y_clf) as three projections of the same keyed table."""
    x = df.drop(TARGET_REG, TARGET_CLF)
    y_reg = df.select(key, TARGET_REG)
    y_clf = df.select(key, TARGET_CLF)
    return x, y_reg, y_clf


def loan_summary(df: DataFrame, emi: str = "emi_amount", label: str = "eligibility_label",
                 salary: str = "Monthly_Salary", amount: str = "Requested_Amount",
                 tenure: str = "Requested_Tenure") -> DataFrame:
    """Loan-to-income %, total payment and total interest, only for applicants
    labelled Eligible or High_Risk (NULL otherwise)."""
    ok = F.col(label).isin("Eligible", "High_Risk")
    total = F.col(emi) * F.col(tenure)
    return df.select(
        "*",
        F.when(ok, F.try_divide(F.col(emi), F.col(salary)) * 100).alias("loan_to_income_pct"),
        F.when(ok, total).alias("total_payment"),
        F.when(ok, total - F.col(amount)).alias("total_interest"),
    )


def report_text(df: DataFrame, label: str = "eligibility_label", confidence: str = "confidence", emi: str = "emi_amount",
                age: str = "Age", salary: str = "Monthly_Salary", credit: str = "Credit_Score", amount: str = "Requested_Amount",
                tenure: str = "Requested_Tenure", out: str = "report") -> DataFrame:
    """df plus the applicant's report as text; NULL if a value is missing."""
    whole = lambda c: F.col(c).cast("bigint").cast("string")
    values = {
        "age": whole(age), "income": format_currency(salary), "credit_score": whole(credit),
        "eligibility": F.upper(F.replace(F.col(label), F.lit("_"), F.lit(" "))), "confidence": format_percent(confidence),
        "emi": format_currency(emi), "requested": format_currency(amount), "tenure": F.concat(whole(tenure), F.lit(" months")),
        "total": format_currency(F.col(emi) * F.col(tenure)),
    }
    lines = [F.lit(text) if value is None else F.concat(F.lit(text), values[value]) for text, value in REPORT_LINES]
    parts = [x for i, line in enumerate(lines) for x in ([F.lit("\n")] if i else []) + [line]]
    return df.withColumn(out, F.concat(*parts))
