"""Linear models as column expressions.

A linear model needs no model object to score: with the fitted scaler and
categories its margins are sums over the columns of the application, so one
projection scores any table or stream and SQL can restate it. Parts come from
fitted Spark ML models or from the two closed-form fits below, which are plain
aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affordspark.schema import KEY, LABELS


@dataclass
class Linear:
    features: list       # names, as in Prepared.feature_cols
    coefficients: list   # a row for each output
    intercepts: list


def linear_parts(model, features) -> Linear:
    """Parts of a fitted multinomial logistic or linear regression."""
    if hasattr(model, "coefficientMatrix"):
        rows = model.coefficientMatrix.toArray().tolist()
        if len(rows) == 1:  # binomial: the other class's margin is 0
            return Linear(list(features), [[0.0] * len(features), rows[0]], [0.0, float(model.interceptVector[0])])
        return Linear(list(features), rows, [float(x) for x in model.interceptVector])
    return Linear(list(features), [[float(x) for x in model.coefficients]], [float(model.intercept)])


def diagonal_discriminant(df: DataFrame, features, label: str, n_classes: int) -> Linear:
    """Linear discriminant with a diagonal covariance: class means, and the
    variance within classes of every feature. Features
    without such variance have no say; a class without rows gets no margin
    that wins."""
    import math
    rows = {c: r for (c,), r in _statistics(df, features, lambda i, x: [F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")], [label]).items()}
    total = sum(r["n"] for r in rows.values())
    within = [sum(r["n"] * r[f"v{i}"] for r in rows.values()) / total for i in range(len(features))] if total else []
    coefficients, intercepts = [], []
    for c in range(n_classes):
        r = rows.get(c)
        if r is None:
            coefficients.append([0.0] * len(features))
            intercepts.append(-1e30)
            continue
        w = [r[f"m{i}"] / s if s > VARIANCE else 0.0 for i, s in enumerate(within)]
        coefficients.append(w)
        intercepts.append(math.log(r["n"] / total) - sum(x * r[f"m{i}"] for i, x in enumerate(w)) / 2)
    return Linear(list(features), coefficients, intercepts)


VARIANCE = 1e-9  # of a feature, below which it counts as constant


AT_ONCE = 6  # features of one aggregate: the code Java makes of more is too long for its compiler


def _statistics(df: DataFrame, features, aggs_of, by=()) -> dict:
    """{group: {name: value}} of ``aggs_of(i, column)`` for every feature: an
    aggregate for each few of them, which reads their columns alone."""
    out: dict = {}
    for at in range(0, len(features), AT_ONCE):
        aggs = [a for i in range(at, min(at + AT_ONCE, len(features))) for a in aggs_of(i, F.col(f"`{features[i]}`"))]
        for r in df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs).collect():  # a row a group
            out.setdefault(tuple(r[c] for c in by), {}).update(r.asDict())
    return out


def averaged_slopes(df: DataFrame, features, y: str) -> Linear:
    """The mean of the simple regressions of y on every feature that varies."""
    r = _statistics(df, features, lambda i, x: [F.regr_slope(F.col(y), x).alias(f"b{i}"), F.regr_intercept(F.col(y), x).alias(f"a{i}"), F.var_pop(x).alias(f"v{i}")]).get((), {})
    used = [i for i in range(len(features)) if r[f"v{i}"] is not None and r[f"v{i}"] > VARIANCE]
    m = max(1, len(used))
    return Linear(list(features), [[r[f"b{i}"] / m if i in used else 0.0 for i in range(len(features))]], [sum(r[f"a{i}"] for i in used) / m])


def margins(model: Linear, scaler: dict, categories: dict) -> list[Column]:
    """One expression an output, over the engineered columns before scaling:
    scaling and one-hot are folded into the coefficients. scaler: {column:
    (center, scale)}, categories: {column: values}. NULL where a number is."""
    dummies = {f"{c}_{v}": (c, v) for c, values in categories.items() for v in values}
    out = []
    for weights, intercept in zip(model.coefficients, model.intercepts):
        total, by_category = F.lit(float(intercept)), {}
        for f, w in zip(model.features, weights):
            if f in dummies:
                by_category.setdefault(dummies[f][0], []).append((dummies[f][1], w))
            elif f in scaler:
                center, scale = scaler[f]
                total = total + (F.col(f) - F.lit(center)) / F.lit(scale) * F.lit(float(w))
            else:
                total = total + F.col(f).cast("double") * F.lit(float(w))
        for c, pairs in by_category.items():
            chosen = F.lit(0.0)
            for v, w in reversed(pairs):
                chosen = F.when(F.col(c) == v, F.lit(float(w))).otherwise(chosen)
            total = total + chosen
        out.append(total)
    return out


def linear_score(df: DataFrame, classifier: Linear, regressor: Linear, scaler: dict, categories: dict, labels=None, key: str = KEY) -> DataFrame:
    """key, eligibility_class (least index on ties), eligibility_label,
    confidence, emi_amount (0 beyond classes 0 and 1) and a probability a class,
    as ``score_batch`` gives, from engineered columns, in one projection."""
    labels = labels or LABELS
    k = len(classifier.intercepts)
    names = [labels[i] if i < len(labels) else f"class_{i}" for i in range(k)]
    m = df.select(key, F.array(*margins(classifier, scaler, categories)).alias("m_"), margins(regressor, scaler, categories)[0].alias("amount_"))
    e = m.select(key, "amount_", F.transform("m_", lambda x: F.exp(x - F.array_max("m_"))).alias("e_"))
    p = e.select(key, "amount_", F.transform("e_", lambda x: x / F.aggregate("e_", F.lit(0.0), lambda a, y: a + y)).alias("p_"))
    p = p.select("*", (F.array_position("p_", F.array_max("p_")) - 1).cast("int").alias("c_"))
    return p.select(key, F.col("c_").alias("eligibility_class"), F.element_at(F.array(*[F.lit(n) for n in names]), F.col("c_") + 1).alias("eligibility_label"),
                    F.array_max("p_").alias("confidence"), F.when(F.col("c_").isin(0, 1), F.col("amount_")).otherwise(F.lit(0.0)).alias("emi_amount"),
                    *[F.col("p_")[i].alias(f"prob_{n}") for i, n in enumerate(names)])
