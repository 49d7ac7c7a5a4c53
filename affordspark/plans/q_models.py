"""Registered queries: resampling, training, tuning, final fit, scoring.
Learners differ from the original libraries, so these are rows-only checks
(except ``class_weights``, which SQL can state)."""

from __future__ import annotations

from pyspark.sql import functions as F

from affordspark.operators import linear, models, resample
from affordspark.plans import prepare, search
from affordspark.plans import q_prepare as P
from affordspark.plans import sqlparts as S
from affordspark.plans import train as T
from affordspark.plans.catalog import parsed_apps, raw_apps, register
from affordspark.plans.common import round_doubles
from affordspark.schema import CATEGORICAL_COLS, KEY, TARGET_REG
from affordspark.sources.io import read_table
from affordspark.streaming import score

# Every query runs the functions' and learners' own defaults; a search is 20
# draws x 3 folds x top 2 from the whole search spaces.


def prepared(spark, sf_dir):
    """Model-ready table, reused across the training queries as a stage
    hand-off (written once per source and code version)."""
    return prepare.prepared_stage(spark, sf_dir, lambda: raw_apps(spark, sf_dir))


def _near_sql(key: str, labels: str = "") -> str:
    """Nearest rows of the same class by plain pairs of e(key, label, v); ties by key."""
    return f"""d AS (SELECT a.{key}, a.label, b.{key} AS nn_id, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.label = b.label AND a.{key} <> b.{key} {labels}),
near AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {key} ORDER BY dist, nn_id) AS INT) AS rank FROM d) WHERE rank <= 5)"""


def _smote_sql(key: str, number: str) -> str:
    """CTEs over e and the result; ``number`` makes an integer of a coordinate z."""
    return f"""n AS (SELECT label, count(*) AS n, max(count(*)) OVER () - count(*) AS need FROM e GROUP BY label),
p AS (SELECT *, need // n AS q, need % n AS rem, least(5, n - 1) AS k,
  CASE WHEN gcd(1000003, n) = 1 THEN 1000003 WHEN gcd(1000033, n) = 1 THEN 1000033 WHEN gcd(1000037, n) = 1 THEN 1000037 ELSE 1000039 END AS stride FROM n WHERE need > 0),
{_near_sql(key, "AND a.label IN (SELECT label FROM p)")},
r AS (SELECT {key}, label, row_number() OVER (PARTITION BY label ORDER BY {key}) - 1 AS r FROM e),
c AS (SELECT {key}, label, k, unnest(range(1, q + CASE WHEN (r * stride) % n < rem THEN 2 ELSE 1 END)) AS copy_no FROM r JOIN p USING (label)),
h AS (SELECT *, md5(concat('42|', {key}, '|', copy_no)) AS h FROM c),
s AS (SELECT h.{key}, h.label, copy_no, nn_id, CAST('0x' || substr(h, 9, 8) AS BIGINT) / 4294967296.0 AS u
  FROM h JOIN near ON near.{key} = h.{key} AND near.rank = CAST('0x' || substr(h, 1, 8) AS BIGINT) % k + 1),
o AS (
  SELECT {key}, label, v, {key} AS base_id, 0 AS copy_no, false AS synthetic FROM e
  UNION ALL SELECT -1, s.label, list_transform(list_zip(x.v, y.v), lambda z: z[1] + u * (z[2] - z[1])), s.{key}, copy_no, true
  FROM s JOIN e x ON x.{key} = s.{key} JOIN e y ON y.{key} = nn_id
)
SELECT {key}, label, base_id, CAST(copy_no AS INT) AS copy_no, synthetic,
  array_to_string(list_transform(v, lambda z: CAST(CAST({number} AS BIGINT) AS VARCHAR)), ',') AS vector FROM o"""


def _as_text(df, key: str, vec: str, number, *more):
    """Resampled rows with whole numbers for coordinates, key -1 for synthetic rows."""
    text = F.array_join(F.transform(vec, lambda z: number(z).cast("bigint").cast("string")), ",")
    return df.select(F.coalesce(key, F.lit(-1).cast("bigint")).alias(key), "label", "base_id", "copy_no", "synthetic", text.alias("vector"), *more)


_EMBEDDINGS = "e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings)"
_FEATURES = "WITH " + P.ENG_SPLIT_CTES + ",\n" + P.PARAMS_CTE + ",\ne AS (SELECT CAST(application_id AS BIGINT) AS application_id, " + P.LABEL_SQL + " AS label, [" + ", ".join(
    [f"CAST((sp.{c} - params.m_{c}) / params.s_{c} AS DOUBLE)" for c in P.NUM9]
    + [f"CASE WHEN {c} = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for c in CATEGORICAL_COLS for v in P.CATS[c]]
    + [f"CAST({c} AS DOUBLE)" for c in S.ENG_COLS]) + "] AS v FROM sp CROSS JOIN params WHERE split = 'train')"


@register("smote", _FEATURES + ",\n" + _smote_sql("application_id", "floor(z * 10000 + 0.501)"))
def q_smote(spark, sf_dir):
    """Oversampled training split of the model-ready table (all classes
    brought to the majority count), features in ten-thousandths."""
    p = prepared(spark, sf_dir)
    tr = p.table.where(F.col("split") == "train") \
        .select(KEY, F.array(*p.feature_cols).alias("x"), "label")
    return _as_text(resample.smote(tr, KEY, "label", "x"), KEY, "x", lambda z: F.floor(z * 10000 + 0.501))


@register("smote_embeddings", f"WITH {_EMBEDDINGS},\n" + _smote_sql("vec_id", "round(z * 1000000)"))
def q_smote_embeddings(spark, sf_dir):
    """SMOTE on the embedding vectors, classes = ``label``; in millionths."""
    e = read_table(spark, sf_dir, "embeddings")
    return _as_text(resample.smote(e, "vec_id", "label", "embedding"), "vec_id", "embedding", lambda z: F.round(z * 1000000))


_FOLDED = _EMBEDDINGS.replace("e AS", "e0 AS") + """, f AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42|' || CAST(vec_id AS VARCHAR)), vec_id) - 1) % 3 AS INTEGER) AS fold FROM e0)"""


@register("smote_per_fold", f"WITH {_FOLDED} " + " UNION ALL ".join(
    f"SELECT {i} AS for_fold, * FROM (WITH e AS (SELECT vec_id, label, v FROM f WHERE fold <> {i}), {_smote_sql('vec_id', 'round(z * 1000000)')})" for i in range(3)))
def q_smote_per_fold(spark, sf_dir):
    """Embeddings resampled for each of three stratified folds by itself."""
    from affordspark.operators import split
    e = split.cv_folds(read_table(spark, sf_dir, "embeddings"), 3, label="label", key="vec_id", exact=True)
    out = resample.smote_per_fold(e, "vec_id", "label", "embedding")
    return _as_text(out, "vec_id", "embedding", lambda z: F.round(z * 1000000), "for_fold")


@register("knn_within_class", f"WITH {_EMBEDDINGS},\n{_near_sql('vec_id')} SELECT vec_id, label, rank, nn_id, {S.R('dist')} AS dist FROM near")
def q_knn(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    near = resample.knn_within_class(e, "vec_id", "label", "embedding", k=5)
    near = near.select("vec_id", "label", F.posexplode(F.arrays_zip("nn_ids", "nn_dist")).alias("i", "nn"))
    return round_doubles(near.select("vec_id", "label", (F.col("i") + 1).alias("rank"), F.col("nn.nn_ids").alias("nn_id"), F.col("nn.nn_dist").alias("dist")))


@register("class_weights", S.with_(S.CLEAN_CTES, select=f"""
SELECT application_id, Emi_Eligibility,
  {S.R("CAST(count(*) OVER () AS DOUBLE) / (3 * count(*) OVER (PARTITION BY Emi_Eligibility))")} AS weight
FROM cleaned"""))
def q_class_weights(spark, sf_dir):
    c = parsed_apps(spark, sf_dir).select(KEY, "Emi_Eligibility")  # the caps drop no row and leave labels alone
    return round_doubles(resample.class_weights(c, "Emi_Eligibility"))


def model_table(spark, sf_dir, p, task, splits, oversample, to_fit=False):
    """Model input (vector + label, resampled for classification) as a stage
    table: the resampling runs once per source / code version and split set,
    and every training query scans the result. ``to_fit``: in partitions that
    suit a learner."""
    from affordspark.sources.io import stage_table
    name = f"input-{task}-{'-'.join(splits)}-{oversample or 'none'}"
    table = stage_table(spark, name, [f"{sf_dir}/orders.parquet", f"{sf_dir}/customer.parquet"],
                        lambda: T.model_input(p, task, splits, oversample))
    return search.sized(table, table.count()) if to_fit else table


def _inputs(spark, sf_dir, task, oversample="smote"):
    p = prepared(spark, sf_dir)
    train = model_table(spark, sf_dir, p, task, ["train"], oversample if task == T.CLS else None)
    val = model_table(spark, sf_dir, p, task, ["val"], None)
    return p, train, val


@register("train_cls_baseline")
def q_train_cls(spark, sf_dir):
    _, train, val = _inputs(spark, sf_dir, T.CLS)
    return T.train_baseline(T.CLS, train, val).metrics_frame(spark)


@register("train_reg_baseline")
def q_train_reg(spark, sf_dir):
    _, train, val = _inputs(spark, sf_dir, T.REG)
    return T.train_baseline(T.REG, train, val).metrics_frame(spark)


def _flow_folder(spark, sf_dir, task) -> str:
    """Folder of a task's trainer: one for each source and code version."""
    from affordspark.sources.io import stage_path
    return stage_path(spark, f"flow-{task}", [f"{sf_dir}/orders.parquet", f"{sf_dir}/customer.parquet"])[0]


def _exists(spark, path: str) -> bool:
    from affordspark.sources.io import _fs
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


@register("tune_top")
def q_tune_top(spark, sf_dir):
    """The trainer of both tasks with the whole search. Its saved parameters
    are what the final trainer reads from then on."""
    out = []
    for task in (T.CLS, T.REG):
        _, train, val = _inputs(spark, sf_dir, task)
        res = T.train_task(spark, task, train, val, _flow_folder(spark, sf_dir, task), smote_applied=True if task == T.CLS else None)
        out += res.rows
    return spark.createDataFrame(out, T.RUN_METRICS_SCHEMA)


def _flow(spark, sf_dir, task):
    """The final trainer of one task, once per source and code version. Where
    nobody has run the search (hours, see README), the trainer saves the best
    baseline first."""
    folder = _flow_folder(spark, sf_dir, task)
    if not _exists(spark, f"{folder}/params"):
        _, train, val = _inputs(spark, sf_dir, task)
        T.train_task(spark, task, train, val, folder, tune=False, smote_applied=True if task == T.CLS else None)
    if not _exists(spark, f"{folder}/predictions"):
        p = prepared(spark, sf_dir)
        smote = "smote" if task == T.CLS else None
        return T.final_task(spark, task, model_table(spark, sf_dir, p, task, ["train", "val"], smote),
                            model_table(spark, sf_dir, p, task, ["test"], None), folder)
    return T.final_outcome(spark, folder)


@register("final_fit_eval")
def q_final_fit_eval(spark, sf_dir):
    """Metrics log of the trainer and the final trainer of both tasks."""
    return _flow(spark, sf_dir, T.CLS)[0].unionByName(_flow(spark, sf_dir, T.REG)[0])


@register("sink_predictions")
def q_predictions(spark, sf_dir):
    """Actual and predicted instalment of the test rows, as written."""
    return _flow(spark, sf_dir, T.REG)[1]


@register("score_batch")
def q_score_batch(spark, sf_dir):
    p = prepared(spark, sf_dir)
    cls_in = model_table(spark, sf_dir, p, T.CLS, ["train", "val"], "smote", True)
    reg_in = model_table(spark, sf_dir, p, T.REG, ["train", "val"], None, True)
    clf = models.model_factory("Random_Forest", T.CLS).fit(cls_in)
    reg = models.model_factory("Random_Forest", T.REG).fit(reg_in)
    test = T.model_input(p, T.CLS, ["test"], None)
    return models.score_batch(test, clf, reg, [r["label"] for r in
                                               p.label_classes.orderBy("idx").collect()])


@register("feature_importance_topk")
def q_feature_importance(spark, sf_dir):
    p = prepared(spark, sf_dir)
    reg_in = model_table(spark, sf_dir, p, T.REG, ["train"], None, True)
    reg = models.model_factory("Random_Forest", T.REG).fit(reg_in)
    return models.feature_importance_topk(reg, p.feature_cols, 10, spark)


# ---- scoring from raw applications -----------------------------------------------

_NUMBERS = P.NUM9 + S.ENG_COLS
_FEATURE_NAMES = P.NUM9 + P.OHE_COLS + S.ENG_COLS


def _features_sql(t: str) -> list[str]:
    """SQL of every model feature over the engineered columns of ``t``."""
    return ([f"CAST(({t}.{c} - params.m_{c}) / params.s_{c} AS DOUBLE)" for c in P.NUM9]
            + [f"CASE WHEN {t}.{c} = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for c in CATEGORICAL_COLS for v in P.CATS[c]]
            + [f"CAST({t}.{c} AS DOUBLE)" for c in S.ENG_COLS])


_AS = lambda t: ", ".join(f"{x} AS x{i}" for i, x in enumerate(_features_sql(t)))
_MISSING = ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _NUMBERS)
_ERRORS = f"concat_ws('; ', {', '.join(S.input_checks())}, 'Missing value: ' || nullif(concat_ws(', ', {_MISSING}), ''))"
_RAW_PARSED = S.PARSED_CTE.split("FROM raw WHERE")[0].replace("parsed AS", "form AS") + "FROM raw)"
_SCORING = ("WITH " + P.ENG_SPLIT_CTES + ",\n" + P.PARAMS_CTE + ",\n" + _RAW_PARSED + ",\n" + S.engineered_cte("form", "feng")
            + f",\nchecked AS (SELECT *, {_ERRORS} AS errors FROM feng)")


@register("score_features", _SCORING + "\nSELECT application_id, " + ", ".join(f'{S.R(x)} AS "{n}"' for n, x in zip(_FEATURE_NAMES, _features_sql("checked")))
          + " FROM checked CROSS JOIN params WHERE errors = ''")
def q_score_features(spark, sf_dir):
    """Model features of the valid raw applications, with the parameters fitted
    on the training rows and without the cleaning caps."""
    df = score.score_features(raw_apps(spark, sf_dir), prepared(spark, sf_dir))
    return round_doubles(df.where("is_valid").drop("is_valid", "errors", "raw"))


@register("score_rejects", _SCORING + "\nSELECT application_id, errors FROM checked WHERE errors <> ''")
def q_score_rejects(spark, sf_dir):
    """Raw applications that cannot be scored, with the reasons."""
    return score.reject_frame(raw_apps(spark, sf_dir), prepared(spark, sf_dir)).select(KEY, "errors")


def _linear_sql() -> str:
    k, n = range(3), range(len(_FEATURE_NAMES))
    stats = [f"avg(x{i}) FILTER (WHERE label = {c}) AS m{c}_{i}" for c in k for i in n]
    stats += ["(" + " + ".join(f"count(*) FILTER (WHERE label = {c}) * var_pop(x{i}) FILTER (WHERE label = {c})" for c in k) + f") / count(*) AS s{i}" for i in n]
    stats += [f"count(*) FILTER (WHERE label = {c}) / count(*) AS prior{c}" for c in k]
    stats += [f"regr_slope(y, x{i}) AS b{i}, regr_intercept(y, x{i}) AS a{i}, var_pop(x{i}) AS v{i}" for i in n]
    margin = lambda c: f"ln(prior{c}) + " + " + ".join(f"CASE WHEN s{i} > {linear.VARIANCE} THEN (x.x{i} - m{c}_{i} / 2) * m{c}_{i} / s{i} ELSE 0 END" for i in n)
    used = " + ".join(f"CASE WHEN v{i} > {linear.VARIANCE} THEN 1 ELSE 0 END" for i in n)
    amount = "(" + " + ".join(f"CASE WHEN v{i} > {linear.VARIANCE} THEN a{i} + b{i} * x.x{i} ELSE 0 END" for i in n) + f") / ({used})"
    top = "greatest(z0, z1, z2)"
    total = f"(exp(z0 - {top}) + exp(z1 - {top}) + exp(z2 - {top}))"
    return _SCORING + f""",
f AS (SELECT {P.LABEL_SQL} AS label, Max_Monthly_Emi AS y, {_AS('sp')} FROM sp CROSS JOIN params WHERE split = 'train'),
st AS (SELECT {', '.join(stats)} FROM f),
x AS (SELECT application_id, {_AS('checked')} FROM checked CROSS JOIN params WHERE errors = ''),
z AS (SELECT application_id, {', '.join(f'{margin(c)} AS z{c}' for c in k)}, {amount} AS amount FROM x CROSS JOIN st),
r AS (SELECT application_id, amount, {', '.join(f'exp(z{c} - {top}) / {total} AS p{c}' for c in k)}, CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS c FROM z)
SELECT application_id, CAST(c AS INTEGER) AS eligibility_class, CASE c WHEN 0 THEN 'Eligible' WHEN 1 THEN 'High_Risk' ELSE 'Not_Eligible' END AS eligibility_label,
  {S.R('greatest(p0, p1, p2)')} AS confidence, {S.R('CASE WHEN c < 2 THEN amount ELSE 0.0 END')} AS emi_amount,
  {S.R('p0')} AS "prob_Eligible", {S.R('p1')} AS "prob_High_Risk", {S.R('p2')} AS "prob_Not_Eligible" FROM r"""


@register("score_linear", _linear_sql())
def q_score_linear(spark, sf_dir):
    """Raw applications scored by two linear models that are fitted on the
    training rows and compiled to one projection."""
    p = prepared(spark, sf_dir)
    train = p.table.where(F.col("split") == "train")
    cls = linear.diagonal_discriminant(train, p.feature_cols, "label", 3)
    reg = linear.averaged_slopes(train, p.feature_cols, TARGET_REG)
    return round_doubles(score.score_frame(raw_apps(spark, sf_dir), p, cls, reg))
