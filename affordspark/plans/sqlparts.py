"""SQL building blocks for the DuckDB oracles.

The oracles restate each operator in plain SQL over the same parquet views
(no Spark code involved), so a Spark-side mistake cannot hide in both.
"""

from __future__ import annotations

from affordspark.operators.validate import DEFAULT_FIELDS
from affordspark.schema import CATEGORICAL_COLS, NUMERIC_COLS, VALIDATE_MESSAGES, VALIDATE_MISSING
from affordspark.sources.fixtures import APPLICATIONS_SQL

NUM = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"

RAW_COLS = [
    "application_id", "age", "gender", "marital_status", "education", "monthly_salary",
    "employment_type", "years_of_employment", "company_type", "house_type", "monthly_rent",
    "family_size", "dependents", "school_fees", "college_fees", "travel_expenses",
    "groceries_utilities", "other_monthly_expenses", "existing_loans", "current_emi_amount",
    "credit_score", "bank_balance", "emergency_fund", "emi_scenario", "requested_amount",
    "requested_tenure", "max_monthly_emi", "emi_eligibility",
]
CLEAN_COLS = ["application_id", "Age", "Gender", "Marital_Status", "Education", "Monthly_Salary",
              "Employment_Type", "Years_Of_Employment", "Company_Type", "House_Type", "Monthly_Rent",
              "Family_Size", "Dependents", "School_Fees", "College_Fees", "Travel_Expenses",
              "Groceries_Utilities", "Other_Monthly_Expenses", "Existing_Loans", "Current_Emi_Amount",
              "Credit_Score", "Bank_Balance", "Emergency_Fund", "Emi_Scenario", "Requested_Amount",
              "Requested_Tenure", "Max_Monthly_Emi", "Emi_Eligibility"]
ENG_COLS = ["Total_Expenses", "Expense_Salary_Ratio", "Emi_Salary_Ratio", "Liquidity_Score",
            "Household_Load", "Requested_Amount_Ratio", "Expected_Emi_If_Approved"]
DOUBLE_COLS = set(NUMERIC_COLS) | set(ENG_COLS)


def num(x: str) -> str:
    """Strict text -> double, NULL when not a finite number."""
    v = f"TRY_CAST(trim({x}) AS DOUBLE)"
    return (f"(CASE WHEN regexp_matches({x}, {NUM}) AND isfinite({v}) "
            f"THEN {v} END)")


def extract(x: str) -> str:
    return rf"nullif(replace(regexp_extract(CAST({x} AS VARCHAR), '([\d\.,]+)', 1), ',', ''), '')"


def gender(x: str) -> str:
    return rf"nullif(substr(regexp_replace(upper({x}), '^\s+|\s+$', '', 'g'), 1, 1), '')"


def not_null(cols) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


def R(x: str, decimals: int = 4) -> str:
    """Round with the same tie nudge as ``common.rounded``."""
    return f"round(CAST({x} AS DOUBLE) + 1e-7, {decimals})"


def rnd(cols, alias_prefix: str = "", decimals: int = 4) -> str:
    """Select list that rounds the double columns."""
    out = []
    for c in cols:
        if c in DOUBLE_COLS:
            out.append(f"{R(alias_prefix + c, decimals)} AS {c}")
        else:
            out.append(f"{alias_prefix}{c} AS {c}")
    return ", ".join(out)


def clamp(x: str, lo, hi) -> str:
    parts = []
    if lo is not None:
        parts.append(f"WHEN {x} < {lo} THEN CAST({lo} AS DOUBLE)")
    if hi is not None:
        parts.append(f"WHEN {x} > {hi} THEN CAST({hi} AS DOUBLE)")
    return f"(CASE {' '.join(parts)} ELSE {x} END)"


RULES_VALUES = """(VALUES
  ('E-commerce Shopping EMI', 10000.0, 200000.0, 3.0, 24.0),
  ('Home Appliances EMI', 20000.0, 300000.0, 6.0, 36.0),
  ('Vehicle EMI', 80000.0, 1500000.0, 12.0, 84.0),
  ('Personal Loan EMI', 50000.0, 1000000.0, 12.0, 60.0),
  ('Education EMI', 50000.0, 500000.0, 6.0, 48.0)
) AS r(scen, amount_min, amount_max, tenure_min, tenure_max)"""

RAW_CTE = f"raw AS ({APPLICATIONS_SQL})"

PARSED_CTE = f"""parsed AS (
  SELECT application_id,
    {num(extract('age'))} AS Age,
    {gender('gender')} AS Gender,
    marital_status AS Marital_Status, education AS Education,
    {num('monthly_salary')} AS Monthly_Salary,
    employment_type AS Employment_Type, years_of_employment AS Years_Of_Employment,
    company_type AS Company_Type, house_type AS House_Type, monthly_rent AS Monthly_Rent,
    family_size AS Family_Size, dependents AS Dependents, school_fees AS School_Fees,
    college_fees AS College_Fees, travel_expenses AS Travel_Expenses,
    groceries_utilities AS Groceries_Utilities, other_monthly_expenses AS Other_Monthly_Expenses,
    existing_loans AS Existing_Loans, current_emi_amount AS Current_Emi_Amount,
    credit_score AS Credit_Score, {num(extract('bank_balance'))} AS Bank_Balance,
    emergency_fund AS Emergency_Fund, emi_scenario AS Emi_Scenario,
    requested_amount AS Requested_Amount, requested_tenure AS Requested_Tenure,
    max_monthly_emi AS Max_Monthly_Emi, emi_eligibility AS Emi_Eligibility
  FROM raw WHERE {not_null(RAW_COLS)}
)"""

DROPPED_CTE = f"dropped AS (SELECT * FROM parsed WHERE {not_null(CLEAN_COLS)})"

CAPPED_CTE = f"""capped AS (
  SELECT d.* REPLACE (
    CASE WHEN d.Requested_Amount < r.amount_min THEN r.amount_min
         WHEN d.Requested_Amount > r.amount_max THEN r.amount_max
         ELSE d.Requested_Amount END AS Requested_Amount,
    CASE WHEN d.Requested_Tenure < r.tenure_min THEN r.tenure_min
         WHEN d.Requested_Tenure > r.tenure_max THEN r.tenure_max
         ELSE d.Requested_Tenure END AS Requested_Tenure)
  FROM dropped d LEFT JOIN {RULES_VALUES} ON d.Emi_Scenario = r.scen
)"""

CLIPPED_CTE = f"""clipped AS (
  SELECT * REPLACE (
    {clamp('Credit_Score', 300, 850)} AS Credit_Score,
    {clamp('Years_Of_Employment', 0, None)} AS Years_Of_Employment,
    {clamp('Requested_Tenure', 1, 120)} AS Requested_Tenure,
    {clamp('Max_Monthly_Emi', 500, 50000)} AS Max_Monthly_Emi)
  FROM capped
)"""

P99 = ["Monthly_Salary", "Monthly_Rent", "College_Fees", "Travel_Expenses", "Groceries_Utilities",
       "Other_Monthly_Expenses", "Current_Emi_Amount", "Bank_Balance", "Emergency_Fund",
       "Requested_Amount", "Max_Monthly_Emi"]


def winsor_ctes(src: str = "clipped", name: str = "cleaned") -> str:
    qs = ", ".join(f"quantile_cont({c}, 0.99) AS q_{c}" for c in P99)
    rep = ",\n    ".join(
        f"(CASE WHEN (CASE WHEN c.{c} > q.q_{c} THEN q.q_{c} ELSE c.{c} END) < 0 THEN 0.0 "
        f"ELSE (CASE WHEN c.{c} > q.q_{c} THEN q.q_{c} ELSE c.{c} END) END) AS {c}" for c in P99)
    return (f"q AS (SELECT {qs} FROM {src}),\n"
            f"{name} AS (SELECT c.* REPLACE (\n    {rep}) FROM {src} c CROSS JOIN q)")


CLEAN_CTES = ",\n".join([RAW_CTE, PARSED_CTE, DROPPED_CTE, CAPPED_CTE, CLIPPED_CTE, winsor_ctes()])


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) + 1 = 0 THEN NULL ELSE ({a}) / (({b}) + 1) END)"


TOTAL = ("(coalesce(Monthly_Rent, 0) + coalesce(School_Fees, 0) + coalesce(College_Fees, 0) + "
         "coalesce(Travel_Expenses, 0) + coalesce(Groceries_Utilities, 0) + "
         "coalesce(Other_Monthly_Expenses, 0))")


def engineered_cte(src: str, name: str = "eng") -> str:
    return f"""{name} AS (
  SELECT *,
    CAST({TOTAL} AS DOUBLE) AS Total_Expenses,
    {ratio(TOTAL, 'Monthly_Salary')} AS Expense_Salary_Ratio,
    {ratio('Current_Emi_Amount', 'Monthly_Salary')} AS Emi_Salary_Ratio,
    {ratio('Bank_Balance + Emergency_Fund', 'Monthly_Salary')} AS Liquidity_Score,
    CAST(Family_Size + 1.5 * Dependents AS DOUBLE) AS Household_Load,
    {ratio('Requested_Amount', 'Monthly_Salary')} AS Requested_Amount_Ratio,
    {ratio('Requested_Amount', 'Requested_Tenure')} AS Expected_Emi_If_Approved
  FROM {src}
)"""


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def input_checks() -> list[str]:
    """Messages of the single-row validator, one expression each (NULL: none)."""
    out = [f"CASE WHEN {c} IS NULL THEN '{VALIDATE_MISSING}{name}' END" for name, c in DEFAULT_FIELDS.items()]
    for name, bad in (("Age", "{c} < 18 OR {c} > 100"), ("Income", "{c} <= 0"), ("Loan_Amount_Request", "{c} <= 0")):
        out.append(f"CASE WHEN {bad.format(c=DEFAULT_FIELDS[name])} THEN '{VALIDATE_MESSAGES[name]}' END")
    return out


CAT_COLS = list(CATEGORICAL_COLS)
