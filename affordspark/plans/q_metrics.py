"""Registered queries: metrics, selection, validation, loan summary.

The metric operators are fed by rule-made predictions over the driver's
tables (no model needed), so each has an exact SQL oracle:
- 3-class: applications, actual = eligibility index, predicted = credit-score
  bands, probabilities from the score (ties on purpose);
- binary: ``labels`` (quality vs toxic);
- regression: order total price vs the sum of its line items.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from affordspark.operators import features, metrics, selection, validate
from affordspark.plans import sqlparts as S
from affordspark.plans.catalog import parsed_apps, raw_apps, register
from affordspark.plans.common import round_doubles
from affordspark.plans.q_prepare import LABEL_SQL
from affordspark.operators import clean
from affordspark.schema import MODEL_NAME_CLASSIFICATION, MODEL_NAME_REGRESSION, PROMOTION_STAGE
from affordspark.sources.io import materialize, read_table

# rule "models" (same text on Spark and DuckDB)
ACTUAL = LABEL_SQL
PRED = "CAST(CASE WHEN Credit_Score >= 700 THEN 0 WHEN Credit_Score >= 500 THEN 1 ELSE 2 END AS INTEGER)"
PRED_TUNED = "CAST(CASE WHEN Credit_Score >= 650 THEN 0 WHEN Credit_Score >= 450 THEN 1 ELSE 2 END AS INTEGER)"
P0 = "floor((Credit_Score - 250) / 650 / 1.5 * 100) / 100"
P1 = "floor(0.5 / 1.5 * 100) / 100"
P2 = "floor((1 - (Credit_Score - 250) / 650) / 1.5 * 100) / 100"

SCORED_SQL = S.with_(S.RAW_CTE, S.PARSED_CTE, S.DROPPED_CTE, select="")[len("WITH "):].rstrip("\n") \
    + f""",
scored AS (SELECT application_id, Emi_Scenario, {ACTUAL} AS actual, {PRED} AS predicted,
  {PRED_TUNED} AS predicted_tuned, CAST({P0} AS DOUBLE) AS p0, CAST({P1} AS DOUBLE) AS p1,
  CAST({P2} AS DOUBLE) AS p2 FROM dropped)"""


def scored_apps(spark, sf_dir):
    return parsed_apps(spark, sf_dir).select(
        "application_id", "Emi_Scenario", F.expr(ACTUAL).alias("actual"),
        F.expr(PRED).alias("predicted"), F.expr(PRED_TUNED).alias("predicted_tuned"),
        F.expr(P0).cast("double").alias("p0"), F.expr(P1).cast("double").alias("p1"),
        F.expr(P2).cast("double").alias("p2"))


REG_SQL = """ol AS (
  SELECT o.o_orderkey, c.c_mktsegment, o.o_totalprice AS y,
    sum(l.l_extendedprice) AS yhat_base,
    sum(l.l_extendedprice * (1 - l.l_discount) * (1 + l.l_tax)) AS yhat
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  GROUP BY o.o_orderkey, c.c_mktsegment, o.o_totalprice)"""


def order_predictions(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    per_order = li.groupBy("l_orderkey").agg(
        F.sum("l_extendedprice").alias("yhat_base"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("yhat"))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("y"))
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey) \
        .join(per_order, F.col("o_orderkey") == F.col("l_orderkey")) \
        .select("o_orderkey", "c_mktsegment", "y", "yhat_base", "yhat")


# ---- classification -----------------------------------------------------------

@register("confusion_matrix", """
SELECT g.a AS actual, g.p AS predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM (SELECT a.v AS a, p.v AS p FROM (VALUES (0), (1), (2)) a(v), (VALUES (0), (1), (2)) p(v)) g
LEFT JOIN (SELECT actual, predicted, count(*) AS n FROM scored GROUP BY 1, 2) c
  ON c.actual = g.a AND c.predicted = g.p""".replace("FROM scored", "FROM (WITH " + SCORED_SQL
                                                       + " SELECT * FROM scored) s"))
def q_confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(scored_apps(spark, sf_dir), "actual", "predicted", [0, 1, 2])


@register("confusion_matrix_binary", """
SELECT g.a AS actual, g.p AS predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM (SELECT a.v AS a, p.v AS p FROM (VALUES (0), (1)) a(v), (VALUES (0), (1)) p(v)) g
LEFT JOIN (SELECT quality AS actual, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2) c
  ON c.actual = g.a AND c.predicted = g.p""")
def q_confusion_matrix_binary(spark, sf_dir):
    return metrics.confusion_matrix(read_table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])


def _cls_sql(src: str, actual: str, predicted: str, group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    on = f"a.{group} = p.{group} AND " if group else ""
    coal = f"coalesce(a.{group}, p.{group}) AS {group}, " if group else ""
    return f"""
cc AS (SELECT {g}{actual} AS actual, {predicted} AS predicted, count(*) AS n FROM {src} GROUP BY ALL),
ca AS (SELECT {g}actual AS cls, sum(n) AS support, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp
       FROM cc GROUP BY ALL),
cp AS (SELECT {g}predicted AS cls, sum(n) AS pn FROM cc GROUP BY ALL),
pc AS (SELECT {coal}coalesce(a.support, 0) AS support, coalesce(a.tp, 0) AS tp, coalesce(p.pn, 0) AS pn
       FROM ca a FULL OUTER JOIN cp p ON {on}a.cls = p.cls),
pm AS (SELECT *, CASE WHEN pn = 0 THEN 0.0 ELSE tp / pn END AS prec,
              CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS rec FROM pc),
pf AS (SELECT *, CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END AS f1 FROM pm)
SELECT {g}CAST(sum(support) AS BIGINT) AS n, {S.R('sum(tp) / sum(support)')} AS accuracy,
  {S.R('sum(prec * support) / sum(support)')} AS precision,
  {S.R('sum(rec * support) / sum(support)')} AS recall,
  {S.R('sum(f1 * support) / sum(support)')} AS f1_score,
  {S.R('avg(prec)')} AS macro_precision, {S.R('avg(rec)')} AS macro_recall, {S.R('avg(f1)')} AS macro_f1,
  CAST(count(*) FILTER (WHERE support > 0) AS BIGINT) AS n_classes
FROM pf {gb}"""


@register("cls_metrics", "WITH " + SCORED_SQL + "," + _cls_sql("scored", "actual", "predicted"))
def q_cls_metrics(spark, sf_dir):
    return round_doubles(metrics.cls_metrics(scored_apps(spark, sf_dir), "actual", "predicted"))


@register("cls_metrics_binary", "WITH " + _cls_sql("labels", "quality", "toxic").lstrip("\n"))
def q_cls_metrics_binary(spark, sf_dir):
    return round_doubles(metrics.cls_metrics(read_table(spark, sf_dir, "labels"), "quality", "toxic"))


def _auc_sql() -> str:
    parts = []
    for c, p in ((0, "p0"), (1, "p1"), (2, "p2")):
        parts.append(f"""
SELECT {c} AS cls, CAST(sum(is_pos) AS BIGINT) AS npos, CAST(sum(1 - is_pos) AS BIGINT) AS nneg,
  sum(CASE WHEN is_pos = 1 THEN rk ELSE 0 END) AS rank_sum
FROM (SELECT is_pos, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk
      FROM (SELECT {p} AS s, CASE WHEN actual = {c} THEN 1 ELSE 0 END AS is_pos FROM scored) x) y""")
    return ("WITH " + SCORED_SQL + ",\nper AS (" + " UNION ALL ".join(parts) + "),\n"
            "auc AS (SELECT cls, CASE WHEN npos = 0 OR nneg = 0 THEN NULL ELSE "
            "(rank_sum - npos * (npos + 1) / 2.0) / (npos * nneg) END AS auc, npos FROM per)\n"
            f"SELECT CAST(cls AS VARCHAR) AS class, {S.R('auc')} AS auc, npos AS support FROM auc\n"
            f"UNION ALL SELECT 'weighted' AS class, "
            f"{S.R('sum(auc * npos) / sum(CASE WHEN auc IS NOT NULL THEN npos END)')} AS auc, "
            "CAST(sum(npos) AS BIGINT) AS support FROM auc")


@register("roc_auc_ovr", _auc_sql())
def q_roc_auc_ovr(spark, sf_dir):
    return round_doubles(metrics.roc_auc_ovr(scored_apps(spark, sf_dir), "actual",
                                             {0: "p0", 1: "p1", 2: "p2"}))


@register("class_distribution", "SELECT quality AS class, count(*) AS count FROM labels GROUP BY quality")
def q_class_distribution(spark, sf_dir):
    return metrics.class_distribution(read_table(spark, sf_dir, "labels"), "quality")


@register("target_summary", S.with_(S.CLEAN_CTES, select=f"""
SELECT count(*) AS n, {S.R('min(Max_Monthly_Emi)')} AS reg_min, {S.R('max(Max_Monthly_Emi)')} AS reg_max,
  list_sort(list_distinct(list(Emi_Eligibility))) AS classes FROM cleaned"""))
def q_target_summary(spark, sf_dir):
    from affordspark.plans import prepare
    cleaned = prepare.clean_stage(raw_apps(spark, sf_dir))
    return round_doubles(metrics.target_summary(cleaned, "Max_Monthly_Emi", "Emi_Eligibility"))


# ---- regression ---------------------------------------------------------------

def _reg_sql(yhat: str, group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""SELECT {g}count(*) AS n, {S.R(f'sqrt(avg((y - {yhat}) * (y - {yhat})))')} AS rmse,
  {S.R(f'avg(abs(y - {yhat}))')} AS mae,
  {S.R(f"CASE WHEN var_pop(y) = 0 THEN (CASE WHEN sum((y - {yhat}) * (y - {yhat})) = 0 THEN 1.0 ELSE 0.0 END) ELSE 1 - sum((y - {yhat}) * (y - {yhat})) / (var_pop(y) * count(*)) END")} AS r2_score,
  {S.R(f'avg(abs((y - {yhat}) / (y + 1e-10))) * 100')} AS mape
FROM ol {gb}"""


@register("reg_metrics", "WITH " + REG_SQL + "\n" + _reg_sql("yhat"))
def q_reg_metrics(spark, sf_dir):
    return round_doubles(metrics.reg_metrics(order_predictions(spark, sf_dir), "y", "yhat"))


@register("residuals", "WITH " + REG_SQL + f"""
SELECT o_orderkey, {S.R('yhat')} AS predicted, {S.R('y - yhat')} AS residual FROM ol""")
def q_residuals(spark, sf_dir):
    return round_doubles(metrics.residuals(order_predictions(spark, sf_dir), "o_orderkey", "y", "yhat"))


@register("pred_range", "WITH " + REG_SQL + f"""
SELECT {S.R('least(min(y), min(yhat))')} AS min_val, {S.R('greatest(max(y), max(yhat))')} AS max_val FROM ol""")
def q_pred_range(spark, sf_dir):
    return round_doubles(metrics.pred_range(order_predictions(spark, sf_dir), "y", "yhat"))


# ---- selection over per-segment metrics ---------------------------------------

def segment_metrics_of(spark, sf_dir, variants):
    """Long (variant, task, model, metric, value): each market segment / loan
    scenario plays one candidate model; the rule sets ``variants`` (base, tuned)
    are measured in the same pass over the rows."""
    def stacked(df, column):
        both = {"base": f"{column}_base" if column == "yhat" else column, "tuned": column if column == "yhat" else f"{column}_tuned"}
        return F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(both[v]).alias("p")) for v in variants])).alias("v")
    op = order_predictions(spark, sf_dir)
    op = op.select(F.col("c_mktsegment").alias("model"), "y", stacked(op, "yhat")).select("model", "y", "v.*")
    reg = metrics.reg_metrics(op, "y", "p", by=["variant", "model"])
    sc = scored_apps(spark, sf_dir)
    sc = sc.select(F.col("Emi_Scenario").alias("model"), "actual", stacked(sc, "predicted")).select("model", "actual", "v.*")
    cls = metrics.cls_metrics(sc, "actual", "p", by=["variant", "model"])
    r = metrics.metric_rows(reg.withColumn("task", F.lit("regression")), ["variant", "task", "model"],
                            ["rmse", "mae", "r2_score", "mape"])
    c = metrics.metric_rows(cls.withColumn("task", F.lit("classification")), ["variant", "task", "model"],
                            ["accuracy", "precision", "recall", "f1_score"])
    return r.unionByName(c)


def segment_metrics(spark, sf_dir, tuned: bool = False):
    """Long (task, model, metric, value) of one rule set."""
    return segment_metrics_of(spark, sf_dir, ["tuned" if tuned else "base"]).drop("variant")


def _segment_sql(tuned: bool) -> str:
    yhat = "yhat" if tuned else "yhat_base"
    pred = "predicted_tuned" if tuned else "predicted"
    reg = _reg_sql(yhat, "c_mktsegment")
    cls = _cls_sql("scored", "actual", pred, "Emi_Scenario")
    # wide -> long
    return f"""
rw AS ({reg}),
cw AS (WITH {cls.strip()}),
seg AS (
  SELECT 'regression' AS task, c_mktsegment AS model, 'rmse' AS metric, rmse AS value FROM rw
  UNION ALL SELECT 'regression', c_mktsegment, 'mae', mae FROM rw
  UNION ALL SELECT 'regression', c_mktsegment, 'r2_score', r2_score FROM rw
  UNION ALL SELECT 'regression', c_mktsegment, 'mape', mape FROM rw
  UNION ALL SELECT 'classification', Emi_Scenario, 'accuracy', accuracy FROM cw
  UNION ALL SELECT 'classification', Emi_Scenario, 'precision', precision FROM cw
  UNION ALL SELECT 'classification', Emi_Scenario, 'recall', recall FROM cw
  UNION ALL SELECT 'classification', Emi_Scenario, 'f1_score', f1_score FROM cw)"""


SEG_PREFIX = "WITH " + SCORED_SQL + ",\n" + REG_SQL + ","


@register("leaderboard", SEG_PREFIX + _segment_sql(False) + """
SELECT task, model, metric, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY task ORDER BY value DESC, model) AS rank FROM seg
  WHERE (task = 'classification' AND metric = 'f1_score') OR (task = 'regression' AND metric = 'r2_score')
) t WHERE rank <= 2""")
def q_leaderboard(spark, sf_dir):
    return selection.leaderboard(round_doubles(segment_metrics(spark, sf_dir)), n=2)


@register("select_best", SEG_PREFIX + _segment_sql(False) + """
SELECT task, model, metric, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY task ORDER BY value DESC, model) AS rank FROM seg
  WHERE (task = 'classification' AND metric = 'f1_score') OR (task = 'regression' AND metric = 'r2_score')
) t WHERE rank = 1""")
def q_select_best(spark, sf_dir):
    return selection.select_best(round_doubles(segment_metrics(spark, sf_dir)))


def _tuned_sql() -> str:
    base = _segment_sql(False)
    tuned = _segment_sql(True).replace("rw AS", "rw2 AS").replace("cw AS", "cw2 AS") \
        .replace("seg AS", "seg2 AS").replace("FROM rw", "FROM rw2").replace("FROM cw", "FROM cw2") \
        .replace("cc AS", "cc2 AS").replace("ca AS", "ca2 AS").replace("cp AS", "cp2 AS") \
        .replace("pc AS", "pc2 AS").replace("pm AS", "pm2 AS").replace("pf AS", "pf2 AS") \
        .replace("FROM cc", "FROM cc2").replace("FROM pc", "FROM pc2").replace("FROM pm", "FROM pm2") \
        .replace("FROM pf", "FROM pf2").replace("FROM ca a", "FROM ca2 a").replace("JOIN cp p", "JOIN cp2 p")
    pick = ("(task = 'classification' AND metric = 'f1_score') OR "
            "(task = 'regression' AND metric = 'r2_score')")
    return SEG_PREFIX + base + "," + tuned + f"""
SELECT b.task, b.model, b.value AS baseline_value, t.value AS tuned_value,
  coalesce(t.value > b.value, false) AS improved,
  CASE WHEN coalesce(t.value > b.value, false) THEN t.value ELSE b.value END AS chosen_value
FROM (SELECT * FROM seg WHERE {pick}) b LEFT JOIN (SELECT * FROM seg2 WHERE {pick}) t
  ON b.task = t.task AND b.model = t.model"""


@register("tuned_replaces", _tuned_sql())
def q_tuned_replaces(spark, sf_dir):
    both = materialize(round_doubles(segment_metrics_of(spark, sf_dir, ["base", "tuned"])), "segments")  # a few rows a segment
    return selection.tuned_replaces(*[both.where(F.col("variant") == v).drop("variant") for v in ("base", "tuned")])


@register("promotion_gate", SEG_PREFIX + _segment_sql(True) + """
SELECT task, model, metric, value,
  coalesce(CASE WHEN task = 'classification' THEN value > 0.9 ELSE value < 2000.0 END, false) AS promoted
FROM seg WHERE (task = 'classification' AND metric = 'accuracy') OR (task = 'regression' AND metric = 'rmse')""")
def q_promotion_gate(spark, sf_dir):
    return selection.promotion_gate(round_doubles(segment_metrics(spark, sf_dir, tuned=True)))


# ---- validation ---------------------------------------------------------------

def _unchecked(spark, sf_dir):
    """Parsed applications before the second NULL drop (so missing values show)."""
    return clean.parse_and_cast(clean.normalize_columns(raw_apps(spark, sf_dir)))


_UNCHECKED_SQL = S.PARSED_CTE.replace(f"FROM raw WHERE {S.not_null(S.RAW_COLS)}", "FROM raw")


@register("validate_input", S.with_(S.RAW_CTE, _UNCHECKED_SQL, select=f"""
SELECT application_id, msgs = '' AS is_valid, msgs AS errors FROM (
  SELECT application_id, concat_ws('; ', {', '.join(S.input_checks())}) AS msgs FROM parsed) t"""))
def q_validate_input(spark, sf_dir):
    return validate.validate_input(_unchecked(spark, sf_dir)).select("application_id", "is_valid", "errors")


def _form_sql() -> str:
    from affordspark.schema import FORM_ENUMS, FORM_RANGES
    parts = []
    for c, (lo, hi) in FORM_RANGES.items():
        f = lambda v: str(int(v))
        if lo is not None and hi is not None:
            parts.append(f"CASE WHEN coalesce({c} < {lo} OR {c} > {hi}, true) THEN '{c} not in [{f(lo)}, {f(hi)}]' END")
        elif lo is not None:
            parts.append(f"CASE WHEN coalesce({c} < {lo}, true) THEN '{c} below {f(lo)}' END")
        else:
            parts.append(f"CASE WHEN coalesce({c} > {hi}, true) THEN '{c} above {f(hi)}' END")
    for c, allowed in FORM_ENUMS.items():
        vals = ", ".join("'" + v + "'" for v in allowed)
        parts.append(f"CASE WHEN coalesce(NOT {c} IN ({vals}), true) THEN '{c} not an allowed value' END")
    return ("SELECT application_id, v = '' AS domain_ok, v AS violations FROM (SELECT application_id, "
            "concat_ws(', ', " + ", ".join(parts) + ") AS v FROM parsed) t")


@register("form_domain_check", S.with_(S.RAW_CTE, _UNCHECKED_SQL, select=_form_sql()))
def q_form_domain_check(spark, sf_dir):
    return validate.form_domain_check(_unchecked(spark, sf_dir)) \
        .select("application_id", "domain_ok", "violations")


# ---- loan summary / report ----------------------------------------------------

@register("loan_summary", S.with_(S.RAW_CTE, S.PARSED_CTE, S.DROPPED_CTE, select=f"""
SELECT application_id, Emi_Eligibility,
  CASE WHEN Emi_Eligibility IN ('Eligible', 'High_Risk') THEN {S.R('Max_Monthly_Emi / Monthly_Salary * 100')} END AS loan_to_income_pct,
  CASE WHEN Emi_Eligibility IN ('Eligible', 'High_Risk') THEN {S.R('Max_Monthly_Emi * Requested_Tenure')} END AS total_payment,
  CASE WHEN Emi_Eligibility IN ('Eligible', 'High_Risk') THEN {S.R('Max_Monthly_Emi * Requested_Tenure - Requested_Amount')} END AS total_interest
FROM dropped"""))
def q_loan_summary(spark, sf_dir):
    df = parsed_apps(spark, sf_dir)
    out = features.loan_summary(df, emi="Max_Monthly_Emi", label="Emi_Eligibility")
    return round_doubles(out.select("application_id", "Emi_Eligibility", "loan_to_income_pct",
                                    "total_payment", "total_interest"))


# the confidence of a label that is given stands in for a classifier's: the credit score's share of 1000
@register("report_text", S.with_(S.RAW_CTE, S.PARSED_CTE, S.DROPPED_CTE, select="""
SELECT application_id, concat('EMI Prediction Report', chr(10), repeat(' ', 16), chr(10), 'Applicant Details:', chr(10),
  '- Age: ', CAST(Age AS BIGINT), chr(10),
  '- Income: ₹ ', format('{:,.2f}', Monthly_Salary), chr(10),
  '- Credit Score: ', CAST(Credit_Score AS BIGINT), chr(10), chr(10), 'Prediction Results:', chr(10),
  '- Eligibility: ', upper(replace(Emi_Eligibility, '_', ' ')), chr(10),
  '- Confidence: ', format('{:.1f}', Credit_Score / 1000.0 * 100), '%', chr(10),
  '- Maximum EMI: ₹ ', format('{:,.2f}', Max_Monthly_Emi), chr(10),
  '- Requested Loan: ₹ ', format('{:,.2f}', Requested_Amount), chr(10),
  '- Tenure: ', CAST(Requested_Tenure AS BIGINT), ' months', chr(10),
  '- Total Payment: ₹ ', format('{:,.2f}', Max_Monthly_Emi * Requested_Tenure), chr(10), repeat(' ', 16)) AS report
FROM dropped"""))
def q_report_text(spark, sf_dir):
    df = parsed_apps(spark, sf_dir).withColumn("confidence", F.col("Credit_Score") / 1000.0)
    return features.report_text(df, "Emi_Eligibility", emi="Max_Monthly_Emi").select("application_id", "report")


def _wide(task, metric_names):
    return "SELECT '" + task + "' AS task, model, " + ", ".join(f"max(CASE WHEN metric = '{m}' THEN value END) AS {m}" for m in metric_names) + f" FROM seg WHERE task = '{task}' GROUP BY model"


@register("promotions", SEG_PREFIX + _segment_sql(False) + f"""
SELECT '{MODEL_NAME_CLASSIFICATION}' AS name, CAST(row_number() OVER (ORDER BY model) AS INTEGER) AS version, task, model,
  printf('%.4f', accuracy) AS main, printf('%.4f', f1_score) AS second, '{PROMOTION_STAGE}' AS stage
FROM ({_wide('classification', ['accuracy', 'f1_score'])}) WHERE accuracy > 0.32
UNION ALL
SELECT '{MODEL_NAME_REGRESSION}', CAST(row_number() OVER (ORDER BY model) AS INTEGER), task, model,
  printf('%.2f', rmse), printf('%.4f', r2_score), '{PROMOTION_STAGE}'
FROM ({_wide('regression', ['rmse', 'r2_score'])}) WHERE rmse < 192000""")
def q_promotions(spark, sf_dir):
    """Every segment's rule is put before the gate in turn; the promotions are
    read back from the table. (Thresholds of its own: the rules are no models.)"""
    import uuid

    from affordspark.operators import promotions
    from affordspark.session import checkpoint_dir
    from affordspark.sources.io import delete_at_exit
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/promotions-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    by: dict = {}
    for r in round_doubles(segment_metrics(spark, sf_dir)).collect():  # a few metrics a segment
        by.setdefault((r["task"], r["model"]), {})[r["metric"]] = r["value"]
    for (task, model), m in sorted(by.items()):
        promotions.promote(spark, path, f"run:{model}", task, model, m, acc=0.32, rmse=192_000.0)
    out, tag = promotions.promotions(spark, path), lambda c, r: F.when(F.col("task") == "classification", F.col("tags")[c]).otherwise(F.col("tags")[r])
    return out.select("name", "version", "task", "model", tag("accuracy", "rmse").alias("main"), tag("f1_score", "r2_score").alias("second"), F.col("tags")["stage"].alias("stage"))
