"""Input validation as projections: one message column per rule, joined
with ``concat_ws`` (which skips NULLs), so a batch of any size is checked in
one map-only stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affordspark.schema import FORM_ENUMS, FORM_RANGES, VALIDATE_MESSAGES, VALIDATE_MISSING

# Form field -> table column (the single-row validator's names are configurable).
DEFAULT_FIELDS = {"Age": "Age", "Income": "Monthly_Salary",
                  "Loan_Amount_Request": "Requested_Amount", "Loan_Tenure_Months": "Requested_Tenure"}


def validate_input(df: DataFrame, fields: dict | None = None) -> DataFrame:
    """Adds ``is_valid`` and ``errors`` (messages joined by '; ').

    A missing (NULL) field only reports "Missing required field"; range
    messages apply to present values."""
    f = fields or DEFAULT_FIELDS
    msgs = []
    for name, col in f.items():
        msgs.append(F.when(F.col(col).isNull(), F.lit(VALIDATE_MISSING + name)))
    if "Age" in f:
        a = F.col(f["Age"])
        msgs.append(F.when((a < 18) | (a > 100), F.lit(VALIDATE_MESSAGES["Age"])))
    if "Income" in f:
        msgs.append(F.when(F.col(f["Income"]) <= 0, F.lit(VALIDATE_MESSAGES["Income"])))
    if "Loan_Amount_Request" in f:
        msgs.append(F.when(F.col(f["Loan_Amount_Request"]) <= 0,
                           F.lit(VALIDATE_MESSAGES["Loan_Amount_Request"])))
    errors = F.concat_ws("; ", *msgs)
    return df.select("*", (errors == F.lit("")).alias("is_valid"), errors.alias("errors"))


def _fmt(v) -> str:
    return str(int(v)) if float(v).is_integer() else str(v)


def form_rules(ranges: dict | None = None, enums: dict | None = None):
    """(column, condition-for-violation, message) for every form constraint."""
    out = []
    for c, (lo, hi) in (ranges or FORM_RANGES).items():
        x = F.col(c)
        if lo is not None and hi is not None:
            out.append((c, (x < lo) | (x > hi), f"{c} not in [{_fmt(lo)}, {_fmt(hi)}]"))
        elif lo is not None:
            out.append((c, x < lo, f"{c} below {_fmt(lo)}"))
        else:
            out.append((c, x > hi, f"{c} above {_fmt(hi)}"))
    for c, allowed in (enums or FORM_ENUMS).items():
        out.append((c, ~F.col(c).isin(*allowed), f"{c} not an allowed value"))
    return out


def form_domain_check(df: DataFrame, ranges: dict | None = None, enums: dict | None = None) -> DataFrame:
    """Adds ``domain_ok`` and ``violations`` (', '-joined) for the rules whose
    columns exist. NULL values count as violations."""
    rules = [r for r in form_rules(ranges, enums) if r[0] in df.columns]
    msgs = [F.when(F.coalesce(cond, F.lit(True)), F.lit(msg)) for _, cond, msg in rules]
    v = F.concat_ws(", ", *msgs)
    return df.select("*", (v == F.lit("")).alias("domain_ok"), v.alias("violations"))


def split_valid_invalid(df: DataFrame, **kw):
    """(valid rows, invalid rows): two filters over one checked projection."""
    checked = form_domain_check(df, **kw)
    return checked.where("domain_ok"), checked.where("NOT domain_ok")
