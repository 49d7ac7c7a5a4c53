"""Cleaning: missing rows, names, parsing, scenario caps, domain clips, p99 caps.

Every step is ``f(df, ...) -> DataFrame`` and a single projection or filter,
so the whole chain collapses into one scan stage. Only ``winsorize_p99``
needs an extra aggregate pass (one job for all columns at once).
"""

from __future__ import annotations

import math
import re
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affordspark.functions.scalar import clamp, extracted_number, gender_code, to_numeric_safe
from affordspark.schema import (DOMAIN_CLIPS, EMI_RULES, KEY, NUMERIC_COLS, P99_COLS,
                                P99_QUANTILE, RULES_SCHEMA)


# ---- drop_na_rows -------------------------------------------------------------

def drop_na_rows(df: DataFrame, subset=None) -> DataFrame:
    """Drop a row if any column (of ``subset``) is NULL (or NaN)."""
    return df.dropna(how="any", subset=subset)


PARSED_COLS = ["Age", "Bank_Balance", "Monthly_Salary", "Gender"]


def parsed_columns(df: DataFrame, parse_all_numeric: bool = False) -> list:
    """Columns ``parse_and_cast`` may turn into NULL. After a full drop_na
    only these need re-checking, which keeps the second filter small."""
    cols = list(PARSED_COLS) + (list(NUMERIC_COLS) if parse_all_numeric else [])
    return [c for c in dict.fromkeys(cols) if c in df.columns]


# ---- normalize_columns ---------------------------------------------------------

def normalized_name(name: str) -> str:
    """Whitespace runs -> '_', then Python title case (capital after any non-letter)."""
    return re.sub(r"\s+", "_", name).title()


def normalize_columns(df: DataFrame, keep=(KEY,)) -> DataFrame:
    """Rename columns (names only, no job). Key columns keep their name."""
    new = [c if c in keep else normalized_name(c) for c in df.columns]
    dup = {n for n in new if new.count(n) > 1}
    if dup:
        raise ValueError(f"normalized column names collide: {sorted(dup)}")
    return df.toDF(*new)


# ---- parse_and_cast -----------------------------------------------------------

def parse_and_cast(df: DataFrame, parse_all_numeric: bool = False) -> DataFrame:
    """Age and Bank_Balance: first number in the text; Monthly_Salary: strict
    number only; Gender: upper, strip, first letter. With
    ``parse_all_numeric`` every listed numeric column goes through the strict
    parser too (text in them becomes NULL and is dropped later)."""
    from affordspark.session import prepare
    prepare(df.sparkSession)  # alias-heavy chains need constraint propagation off
    cols = set(df.columns)
    exprs = {}
    if "Age" in cols:
        exprs["Age"] = extracted_number("Age")
    if "Bank_Balance" in cols:
        exprs["Bank_Balance"] = extracted_number("Bank_Balance")
    if "Monthly_Salary" in cols:
        exprs["Monthly_Salary"] = to_numeric_safe("Monthly_Salary")
    if "Gender" in cols:
        exprs["Gender"] = gender_code("Gender")
    if parse_all_numeric:
        for c in NUMERIC_COLS:
            if c in cols and c not in exprs:
                exprs[c] = to_numeric_safe(c)
    return df.select(*[exprs[c].alias(c) if c in exprs else F.col(c) for c in df.columns])


def parsed_once(df: DataFrame, cols) -> DataFrame:
    """The same table with ``cols`` worked out once a row. A filter or an
    expression that reads a parsed column several times is otherwise put below
    the projection with the whole parse in place of each mention; Spark moves
    nothing below the one-row expansion. The other columns stay prunable."""
    cols = [c for c in df.columns if c in set(cols)]
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    out = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in cols], F.inline(F.array(row)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


# ---- scenario rules -----------------------------------------------------------

def rules_frame(spark: SparkSession, rules: dict | None = None) -> DataFrame:
    """The rule table (one row per scenario); ``rules`` may be injected."""
    rules = rules or EMI_RULES
    rows = []
    for scen, r in rules.items():
        if isinstance(r, dict):
            r = (r["amount_min"], r["amount_max"], r["tenure_min"], r["tenure_max"])
        rows.append((scen, *[float(x) for x in r]))
    return spark.createDataFrame(rows, RULES_SCHEMA)


_REQUIRED_CAP = ("Emi_Scenario", "Requested_Amount", "Requested_Tenure")


def _with_rules(df: DataFrame, rules: dict | None) -> DataFrame:
    r = rules_frame(df.sparkSession, rules)
    # The rule table has one row per scenario (a handful): broadcasting it is
    # bounded by construction; the fact side is never shuffled.
    return df.join(F.broadcast(r), on="Emi_Scenario", how="left")


def scenario_cap(df: DataFrame, rules: dict | None = None) -> DataFrame:
    """Clamp Requested_Amount / Requested_Tenure into the scenario's range.
    Unknown scenarios and NULL values are left as they are."""
    if not set(_REQUIRED_CAP).issubset(df.columns):
        warnings.warn("scenario_cap skipped: required columns missing")
        return df
    j = _with_rules(df, rules)
    capped = {
        "Requested_Amount": clamp("Requested_Amount", F.col("amount_min"), F.col("amount_max")),
        "Requested_Tenure": clamp("Requested_Tenure", F.col("tenure_min"), F.col("tenure_max")),
    }
    # where no rule matched the bounds are NULL and the comparisons are false
    return j.select(*[capped[c].alias(c) if c in capped else F.col(c) for c in df.columns])


def cap_audit(df: DataFrame, rules: dict | None = None) -> DataFrame:
    """Per scenario: how many amounts / tenures fall below or above the rule."""
    j = _with_rules(df.select(*_REQUIRED_CAP), rules).where(F.col("amount_min").isNotNull())
    a, t = F.col("Requested_Amount"), F.col("Requested_Tenure")
    return j.groupBy("Emi_Scenario").agg(
        F.count_if(a < F.col("amount_min")).cast("bigint").alias("amount_low"),
        F.count_if(a > F.col("amount_max")).cast("bigint").alias("amount_high"),
        F.count_if(t < F.col("tenure_min")).cast("bigint").alias("tenure_low"),
        F.count_if(t > F.col("tenure_max")).cast("bigint").alias("tenure_high"),
    )


# ---- domain_clip --------------------------------------------------------------

def domain_clip(df: DataFrame, clips: dict | None = None) -> DataFrame:
    clips = clips or DOMAIN_CLIPS
    return df.select(*[clamp(c, *clips[c]).alias(c) if c in clips else F.col(c)
                       for c in df.columns])


# ---- quantiles / winsorize ----------------------------------------------------

def quantiles(df: DataFrame, cols, q: float, method: str = "select",
              accuracy: int = 100_000) -> dict:
    """{col: q-quantile} for all columns at once.

    ``select`` (default): exact linear-interpolated order statistic by
    distributed histogram narrowing (``select_quantiles``), bounded memory
    per task at any scale. ``exact``: Spark's ``percentile`` (a value->count
    map per column merged in one task; fine for bounded cardinality).
    ``approx``: Greenwald-Khanna sketch (rank error <= n / accuracy)."""
    if not cols:
        return {}
    if method == "select":
        return select_quantiles(df, cols, q)
    if method == "exact":
        aggs = [F.percentile(F.col(c), F.lit(q)).alias(c) for c in cols]
    elif method == "approx":
        aggs = [F.percentile_approx(F.col(c), F.lit(q), F.lit(accuracy)).alias(c) for c in cols]
    else:
        raise ValueError(f"unknown quantile method {method}")
    row = df.agg(*aggs).first()
    return {c: row[c] for c in cols}


def select_quantiles(df: DataFrame, cols, q: float, bins: int = 4096) -> dict:
    """{col: exact q-quantile}; see ``select_quantiles_multi``."""
    got = select_quantiles_multi(df, [(c, q) for c in cols], bins)
    return {c: got[(c, q)] for c in cols}


def _bin(x: np.ndarray, lo: float, hi: float, bins: int) -> np.ndarray:
    """Equal-width bins of ascending values in [lo, hi]. lo and hi never share
    a bin, also where they are infinite, NaN (the largest value) or next to each other."""
    if math.isfinite(lo) and math.isfinite(hi) and (hi - lo) / bins > 0 and math.isfinite(hi - lo):
        inner = np.clip(np.floor((x - lo) / ((hi - lo) / bins)), 0, bins - 1).astype(np.int64)
        return np.where(x == hi, bins - 1, np.where(x == lo, 0, inner))
    middle = np.where(x == lo, 1, np.where(x == hi, 3, 2))
    if not math.isfinite(hi - lo):
        middle = np.where(x < 0, 2, 3)
    return np.where(np.isnan(x), 5, np.where(x == math.inf, 4, np.where(x == -math.inf, 0, middle)))


def _cells(df: DataFrame, x: dict, spans: list, bins: int) -> DataFrame:
    """(span, bin, count, least, largest value) of the values within each span
    (column, lo, hi). A batch's column is sorted once: a span is a slice of it and
    a bin a run in the slice. A task adds its batches up and returns at most spans x bins rows."""
    names = list(dict.fromkeys(c for c, _, _ in spans))
    by = [[(s, lo, hi) for s, (c, lo, hi) in enumerate(spans) if c == name] for name in names]

    def count(batches):
        k = np.zeros((len(spans), max(bins, 6)), dtype=np.int64)
        least, largest = np.full(k.shape, np.inf), np.full(k.shape, -np.inf)
        for batch in batches:
            for column, its in zip(batch.columns, by):
                v = np.sort(column.drop_null().to_numpy(zero_copy_only=False))
                for s, lo, hi in its:
                    some = v[np.searchsorted(v, lo, "left"):np.searchsorted(v, hi, "right")]
                    if len(some):
                        b = _bin(some, lo, hi, bins)
                        at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                        end, b = np.r_[at[1:], len(some)], b[at]
                        k[s, b] += end - at
                        least[s, b] = np.minimum(least[s, b], some[at])
                        largest[s, b] = np.maximum(largest[s, b], some[end - 1])
        s, b = np.nonzero(k)
        yield pa.RecordBatch.from_arrays([pa.array(z) for z in (s, b, k[s, b], least[s, b], largest[s, b])], ["s", "b", "k", "lo", "hi"])

    return (df.select(*[x[c].alias(f"x{i}") for i, c in enumerate(names)]).mapInArrow(count, "s bigint, b bigint, k bigint, lo double, hi double")
            .groupBy("s", "b").agg(F.sum("k").alias("k"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))


def select_quantiles_multi(df: DataFrame, targets, bins: int = 4096) -> dict:
    """Exact quantiles for many (column, q) targets: {(col, q): value}.

    p = q (n - 1); the answer interpolates the order statistics of the ranks
    floor(p) and ceil(p) (as Spark's ``percentile``); each rank is narrowed on
    its own. A round is one job: for every open bracket [lo, hi] the count, the
    least and the largest value of each of its ``bins`` bins. The next bracket
    is the observed range of the bin that holds the rank, so it ends on a
    value (least = largest), however often values repeat; a bracket loses at
    least one of its ends each round and usually all but 1/bins of its width.
    What is sent to the driver is at most brackets x bins rows of four numbers,
    whatever the number of rows. Pass a materialised input: each round scans
    the columns that are still open."""
    targets = list(dict.fromkeys(targets))
    cols = list(dict.fromkeys(c for c, _ in targets))
    x = {c: F.col(c).cast("double") for c in cols}
    st = df.agg(*[a for c in cols for a in (F.count(x[c]).alias(f"{c}__n"), F.min(x[c]).alias(f"{c}__lo"),
                                          F.max(x[c]).alias(f"{c}__hi"))]).first() if cols else None
    bracket, found = {}, {}  # (column, rank) -> (lo, hi, values below lo) / value
    for c, q in targets:
        n = st[f"{c}__n"]
        if n:
            p = q * (n - 1)
            for rank in (math.floor(p), math.ceil(p)):
                bracket[(c, rank)] = (st[f"{c}__lo"], st[f"{c}__hi"], 0)
    while True:
        for key in [k for k, (lo, hi, _) in bracket.items() if lo == hi or (math.isnan(lo) and math.isnan(hi))]:
            found[key] = float(bracket.pop(key)[0])
        if not bracket:
            break
        spans = list(dict.fromkeys((c, lo, hi) for (c, _), (lo, hi, _) in bracket.items()))
        cells = {}
        for r in _cells(df, x, spans, bins).collect():
            cells.setdefault(r["s"], []).append((r["b"], r["k"], r["lo"], r["hi"]))
        for (c, rank), (lo, hi, below) in list(bracket.items()):
            for _, k, first, last in sorted(cells[spans.index((c, lo, hi))]):
                if rank < below + k:
                    bracket[(c, rank)] = (first, last, below)
                    break
                below += k
    out = {}
    for c, q in targets:
        n = st[f"{c}__n"]
        if not n:
            out[(c, q)] = None
            continue
        p = q * (n - 1)
        lo_r, hi_r = math.floor(p), math.ceil(p)
        v_lo, v_hi = found[(c, lo_r)], found[(c, hi_r)]
        out[(c, q)] = v_lo if lo_r == hi_r or v_lo == v_hi else (hi_r - p) * v_lo + (p - lo_r) * v_hi
    return out


def winsorize_p99(df: DataFrame, cols=None, q: float = P99_QUANTILE, method: str = "select",
                  uppers: dict | None = None, materialize: bool = True) -> DataFrame:
    """Cap each listed column at its q-quantile, then floor it at 0. The
    quantiles are taken over the input as given (after the domain clips),
    for all columns together; pass ``uppers`` to reuse quantiles fitted
    elsewhere (e.g. on the train split only). The input is read by the
    quantile passes and by the capping projection, so it is written once to
    the shared checkpoint folder first (the parse upstream runs once)."""
    cols = [c for c in (cols or P99_COLS) if c in df.columns]
    if uppers is None:
        if materialize:
            from affordspark.sources.io import materialize as _materialize
            df = _materialize(df, "clipped")
        uppers = quantiles(df, cols, q, method)
    out = {}
    for c in cols:
        u = uppers.get(c)
        x = F.col(c).cast("double")
        if u is not None:
            x = F.when(x > F.lit(float(u)), F.lit(float(u))).otherwise(x)
        out[c] = F.when(x < 0, F.lit(0.0)).otherwise(x)
    return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


# ---- dedup (optional) ---------------------------------------------------------

def dedup_exact(df: DataFrame, key: str | None = KEY) -> DataFrame:
    """Exact duplicate rows (ignoring the key column) removed, the one with the
    least key stays; off by default."""
    cols = [c for c in df.columns if c != key]
    if key is None or key not in df.columns:
        return df.dropDuplicates(cols)
    return df.groupBy(*cols).agg(F.min(key).alias(key)).select(*df.columns)


# ---- the whole cleaning chain (clean_pipeline) --------------------------------

def clean_applications(df: DataFrame, rules: dict | None = None, quantile_method: str = "select",
                       parse_all_numeric: bool = False, dedup: bool = False, cut: bool = True) -> DataFrame:
    """drop_na -> names -> parse -> drop_na -> scenario_cap -> domain_clip -> p99.

    The p99 caps read the clipped table more than once (quantile passes, then
    the projection), so it is written once before (unless ``cut`` is off)."""
    out = drop_na_rows(df)
    out = normalize_columns(out)
    out = parse_and_cast(out, parse_all_numeric=parse_all_numeric)
    parsed = parsed_columns(out, parse_all_numeric)
    out = domain_clip(scenario_cap(out, rules))
    # Clamps keep NULL as NULL and non-NULL as non-NULL, so dropping the rows
    # the parser nulled can wait until after the clamps: on the written table
    # it is a plain IS NOT NULL pushed into the parquet reader, instead of a
    # filter that Catalyst pushes below the parse and evaluates it twice.
    from affordspark.sources.io import materialize
    out = drop_na_rows(materialize(out, "clipped") if cut else out, subset=parsed)
    if dedup:
        out = dedup_exact(out)
    return winsorize_p99(out, method=quantile_method, materialize=False)
