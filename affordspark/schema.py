"""Fixed values, column lists and schemas.

Everything in the FIXED VALUES block must equal the behaviour being matched
(scenario rules, column lists, thresholds, missing-value tokens); the rest is
ours.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must stay equal to the matched behaviour)
# ---------------------------------------------------------------------------

# Per-scenario limits: scenario -> (amount_min, amount_max, tenure_min, tenure_max)
EMI_RULES = {
    "E-commerce Shopping EMI": (10_000, 200_000, 3, 24),
    "Home Appliances EMI": (20_000, 300_000, 6, 36),
    "Vehicle EMI": (80_000, 1_500_000, 12, 84),
    "Personal Loan EMI": (50_000, 1_000_000, 12, 60),
    "Education EMI": (50_000, 500_000, 6, 48),
}

NUMERIC_COLS = [
    "Age", "Monthly_Salary", "Years_Of_Employment", "Monthly_Rent", "Family_Size", "Dependents",
    "School_Fees", "College_Fees", "Travel_Expenses", "Groceries_Utilities", "Other_Monthly_Expenses",
    "Current_Emi_Amount", "Credit_Score", "Bank_Balance", "Emergency_Fund",
    "Requested_Amount", "Requested_Tenure", "Max_Monthly_Emi",
]

CATEGORICAL_COLS = [
    "Gender", "Marital_Status", "Education", "Employment_Type", "Company_Type", "House_Type",
    "Existing_Loans", "Emi_Scenario",
]

COLS_TO_DROP = [
    "Monthly_Rent", "School_Fees", "College_Fees", "Travel_Expenses", "Groceries_Utilities",
    "Other_Monthly_Expenses", "Family_Size", "Dependents",
]

EXPENSE_COLS = [
    "Monthly_Rent", "School_Fees", "College_Fees", "Travel_Expenses", "Groceries_Utilities",
    "Other_Monthly_Expenses",
]

# Domain clips: column -> (lower, upper); None means open.
DOMAIN_CLIPS = {
    "Credit_Score": (300, 850),
    "Years_Of_Employment": (0, None),
    "Requested_Tenure": (1, 120),
    "Max_Monthly_Emi": (500, 50_000),
}

# Columns capped at their 0.99 quantile and then floored at 0 (School_Fees is not here).
P99_COLS = [
    "Monthly_Salary", "Monthly_Rent", "College_Fees", "Travel_Expenses", "Groceries_Utilities",
    "Other_Monthly_Expenses", "Current_Emi_Amount", "Bank_Balance", "Emergency_Fund",
    "Requested_Amount", "Max_Monthly_Emi",
]
P99_QUANTILE = 0.99

TARGET_REG = "Max_Monthly_Emi"
TARGET_CLF = "Emi_Eligibility"

TRAIN_FRACTION = 0.70
TEMP_FRACTION = 0.30
TEST_FRACTION = 0.50
RANDOM_STATE = 42

CLASSIFICATION_ACCURACY_THRESHOLD = 0.90
REGRESSION_RMSE_THRESHOLD = 2000.0

# Registered names, and the formatted metrics and stage that a promotion carries
MODEL_NAME_REGRESSION = "emi_max_monthly_predictor"
MODEL_NAME_CLASSIFICATION = "emi_eligibility_classifier"
PROMOTION_TAGS = {
    "regression": [("rmse", "{:.2f}"), ("r2_score", "{:.4f}")],
    "classification": [("accuracy", "{:.4f}"), ("f1_score", "{:.4f}")],
}
PROMOTION_STAGE = "production_candidate"

# Class index -> label (sorted label order)
LABELS = ["Eligible", "High_Risk", "Not_Eligible"]

# Tokens a CSV reader treats as missing by default.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Words a CSV reader takes for booleans by default.
TRUE_FALSE = ["True", "TRUE", "true", "False", "FALSE", "false"]

# Allowed form values (scoring form).
FORM_ENUMS = {
    "Gender": ["M", "F"],
    "Marital_Status": ["Single", "Married"],
    "Education": ["High School", "Graduate", "Post Graduate", "Professional"],
    "Employment_Type": ["Private", "Government", "Self-employed"],
    "Company_Type": ["Large Indian", "MNC", "Mid-size", "Startup", "Small"],
    "House_Type": ["Rented", "Own", "Family"],
    "Existing_Loans": ["Yes", "No"],
    "Emi_Scenario": ["E-commerce Shopping EMI", "Education EMI", "Home Appliances EMI",
                     "Personal Loan EMI", "Vehicle EMI"],
}
# Allowed form ranges: column -> (min, max); None means open.
FORM_RANGES = {
    "Age": (25, 60),
    "Monthly_Salary": (15_000, 200_000),
    "Years_Of_Employment": (0, 40),
    "Monthly_Rent": (0, None),
    "Family_Size": (1, 20),
    "Dependents": (0, 10),
    "School_Fees": (0, None),
    "College_Fees": (0, None),
    "Travel_Expenses": (0, None),
    "Groceries_Utilities": (0, None),
    "Other_Monthly_Expenses": (0, None),
    "Current_Emi_Amount": (0, None),
    "Credit_Score": (300, 850),
    "Bank_Balance": (0, None),
    "Emergency_Fund": (0, None),
    "Requested_Amount": (10_000, None),
    "Requested_Tenure": (6, 360),
}

# Single-row validator: required field names and messages.
VALIDATE_REQUIRED = ["Age", "Income", "Loan_Amount_Request", "Loan_Tenure_Months"]
VALIDATE_MISSING = "Missing required field: "
VALIDATE_MESSAGES = {
    "Age": "Age must be between 18 and 100",
    "Income": "Income must be greater than 0",
    "Loan_Amount_Request": "Loan amount must be greater than 0",
}

RAW_COLUMNS = [
    "age", "gender", "marital_status", "education", "monthly_salary", "employment_type",
    "years_of_employment", "company_type", "house_type", "monthly_rent", "family_size",
    "dependents", "school_fees", "college_fees", "travel_expenses", "groceries_utilities",
    "other_monthly_expenses", "existing_loans", "current_emi_amount", "credit_score",
    "bank_balance", "emergency_fund", "emi_scenario", "requested_amount", "requested_tenure",
    "max_monthly_emi", "emi_eligibility",
]

ENGINEERED_COLS = [
    "Total_Expenses", "Expense_Salary_Ratio", "Emi_Salary_Ratio", "Liquidity_Score",
    "Household_Load", "Requested_Amount_Ratio", "Expected_Emi_If_Approved",
]

# ---------------------------------------------------------------------------
# Schemas (ours)
# ---------------------------------------------------------------------------

KEY = "application_id"

# Raw CSV is read with every column as text; parsing happens in the cleaner.
RAW_CSV_SCHEMA = T.StructType(
    [T.StructField(KEY, T.StringType(), True)]
    + [T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS]
)

RULES_SCHEMA = T.StructType([
    T.StructField("Emi_Scenario", T.StringType(), False),
    T.StructField("amount_min", T.DoubleType(), False),
    T.StructField("amount_max", T.DoubleType(), False),
    T.StructField("tenure_min", T.DoubleType(), False),
    T.StructField("tenure_max", T.DoubleType(), False),
])

# FIXED VALUES: the lines of the downloadable report, as (text, value) pairs
REPORT_LINES = [
    ("EMI Prediction Report", None),
    ("                ", None),
    ("Applicant Details:", None),
    ("- Age: ", "age"),
    ("- Income: ", "income"),
    ("- Credit Score: ", "credit_score"),
    ("", None),
    ("Prediction Results:", None),
    ("- Eligibility: ", "eligibility"),
    ("- Confidence: ", "confidence"),
    ("- Maximum EMI: ", "emi"),
    ("- Requested Loan: ", "requested"),
    ("- Tenure: ", "tenure"),
    ("- Total Payment: ", "total"),
    ("                ", None),
]
