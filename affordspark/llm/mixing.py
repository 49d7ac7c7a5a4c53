"""Mixing sources to target weights by hierarchical budgets. DataFrame
functions only.

The corpus is a tree of levels (domain, language, source). A token budget flows
down it: a node's budget is shared among its children by their weights, no
child gets more than its subtree can give, and what a child cannot use goes to
its siblings by weight. Only what all siblings together cannot use would reach
the ancestors, and there it is shared in the same way, because a node's limit
is the sum of its leaves' limits. A leaf gives whole seeded epochs and then a
token-prefix of one more epoch in seeded order.

A leaf may hold a third of all rows: prefixes are found from token sums by the
first digits of the seeded hash, and only the rows under the digits where the
budget ends are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affordspark.llm.quality_rules import _trimmed, _words
from affordspark.llm.storage import dropped, tagged, written

DIGITS = 3  # hex digits of the coarse order: 4096 sums a leaf
MOST_BROADCAST = 200_000  # leaves up to which the table of cuts is broadcast


def word_tokens(text: str = "text") -> Column:
    """Number of words of a text; null: 0."""
    return F.size(_words(_trimmed(F.coalesce(F.col(text), F.lit(""))))).cast("long")


def _filled(nodes: DataFrame, parent: list[str], name: str, budget: str) -> DataFrame:
    """nodes (parent columns, name, weight, limit, ``budget`` of the parent)
    plus share: the children's budgets. The level w * t is the highest of the
    levels that fill the first i children by limit / weight.

    A parent may have millions of children: they are sorted by ranges, and the
    sums before and after a child are those of its task's rows and of the other
    tasks' totals, one row a task and parent."""
    order = ["ratio", name]
    placed = written(nodes.withColumn("ratio", F.col("limit") / F.col("weight")).repartitionByRange(*parent, *order)
                     .sortWithinPartitions(*parent, *order).withColumn("task", F.spark_partition_id()), "siblings")
    by = [*parent, "task"]
    tasks = Window.partitionBy(*(parent or [F.lit(0)])).orderBy("task")
    up_to, after = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    totals = placed.groupBy(*by).agg(F.sum("limit").alias("t_limit"), F.sum("weight").alias("t_weight"))
    totals = totals.select(*by, F.coalesce(F.sum("t_limit").over(tasks.rowsBetween(*up_to)), F.lit(0.0)).alias("used_before"),
                           F.coalesce(F.sum("t_weight").over(tasks.rowsBetween(*after)), F.lit(0.0)).alias("rest_after"))
    own = Window.partitionBy(*by).orderBy(*order)
    used = F.coalesce(F.sum("limit").over(own.rowsBetween(*up_to)), F.lit(0.0)) + F.col("used_before")
    rest = F.sum("weight").over(own.rowsBetween(Window.currentRow, Window.unboundedFollowing)) + F.col("rest_after")
    levels = placed.join(_small(totals), by).withColumn("level", (F.col(budget) - used) / rest)
    if parent:
        highest = _small(written(levels.groupBy(*parent).agg(F.max("level").alias("level")), "levels"))
        out = placed.join(highest, parent)
    else:
        out = placed.withColumn("level", F.lit(levels.agg(F.max("level")).first()[0]).cast("double"))
    share = F.least("limit", F.greatest(F.lit(0.0), F.col("weight") * F.col("level")))
    return out.withColumn("share", share).drop("level", "ratio", "task")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: list[Column], budget: Column, max_epochs: int) -> DataFrame:
    """leaves (levels, available tokens) plus budget: whole tokens of each.

    ``weights`` are positive-or-zero columns over the levels, one per level; a
    subtree of weight 0 (or null) gets nothing. ``budget`` is a column over the
    total ``available``. Leaves can give ``max_epochs`` times their tokens; a
    budget above all limits is cut to them."""
    usable = F.lit(True)
    for w in weights:
        usable = usable & (F.coalesce(w, F.lit(0.0)) > 0)
    base = (leaves.withColumn("limit", (F.col("available") * max_epochs).cast("double")).where(usable & (F.col("available") > 0)))
    total = leaves.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("available")).select(budget.cast("double").alias("share")).first()["share"]
    above = None
    for i, (name, weight) in enumerate(zip(levels, weights)):
        parent, path = levels[:i], levels[:i + 1]
        nodes = base.groupBy(*path).agg(F.sum("limit").alias("limit")).withColumn("weight", weight.cast("double"))
        nodes = nodes.join(above.select(*parent, F.col("share").alias("of")), parent) if parent else nodes.withColumn("of", F.lit(float(total)))
        above = _filled(nodes, parent, name, "of").select(*path, "share")
    # a hair above the floor: sums of doubles in another order end a bit below whole numbers
    return leaves.join(above, levels, "left").withColumn("budget", F.coalesce(F.floor(F.col("share") + 1e-6), F.lit(0)).cast("long")).drop("share")


def _place(seed: int, epoch: Column, key: Column) -> Column:
    """Seeded order of an epoch: 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))))


def cuts(rows: DataFrame, levels: list[str], weights: list[Column], budget: Column, seed: int, max_epochs: int, key: str) -> DataFrame:
    """For each leaf: full (whole epochs) and cut (the last place of the epoch
    after them that is taken; null: none). rows: levels, key, tokens."""
    leaves = rows.groupBy(*levels).agg(F.sum("tokens").alias("available"))
    planned = leaf_budgets(leaves, levels, weights, budget, max_epochs)
    whole = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("long")
    planned = written(planned.withColumn("full", whole).withColumn("rest", F.col("budget") - F.col("full") * F.col("available")), "budgets")
    open_ = planned.where("rest > 0").select(*levels, "full", "rest")
    placed = (rows.join(_small(open_), levels).withColumn("place", _place(seed, F.col("full"), F.col(key)))
              .select(*levels, "rest", "tokens", "place", F.substring("place", 1, DIGITS).alias("head")))
    sums = placed.groupBy(*levels, "rest", "head").agg(F.sum("tokens").alias("t"), F.max("place").alias("last"))
    running = sums.withColumn("to", F.sum("t").over(Window.partitionBy(*levels).orderBy("head")))
    # the heads before the one in which the budget ends, and that one
    ends = written(running.groupBy(*levels, "rest").agg(
        F.min(F.when(F.col("to") > F.col("rest"), F.col("head"))).alias("end"),
        F.max(F.when(F.col("to") <= F.col("rest"), F.col("to"))).alias("before"),
        F.max(F.when(F.col("to") <= F.col("rest"), F.col("last"))).alias("last")), "ends")
    inside = (placed.join(_small(ends.where("end IS NOT NULL").select(*levels, "end", "before")), levels).where("head = end")
              .groupBy(*levels, "rest", "before", "place").agg(F.sum("tokens").alias("t"))
              .withColumn("to", F.coalesce("before", F.lit(0)) + F.sum("t").over(Window.partitionBy(*levels).orderBy("place")))
              .where("to <= rest").groupBy(*levels).agg(F.max("place").alias("inner")))
    cut = ends.select(*levels, "last").join(inside, levels, "left").select(*levels, F.coalesce("inner", "last").alias("cut"))
    return planned.join(cut, levels, "left").select(*levels, "available", "budget", "full", "cut")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast hint for a table of leaves that is checked to be small."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def mix(docs: DataFrame, levels: dict[str, Column | None], weights: list, budget: Column, seed: int = 0, max_epochs: int = 4,
        key: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """The chosen rows of docs with all their columns, plus the levels that are
    not columns of docs, n_tokens and epoch (0, 1, ...).

    ``levels`` maps level names, outermost first, to columns over docs (None:
    the column of that name). ``weights`` has one function for each level that
    takes a dict of level values (columns of text) and gives a weight. A null
    level value is a node of its own. Rows with equal keys stand at one place
    of the order and are taken together; so are rows with a null key. Texts
    without tokens cost nothing and are taken where the prefix passes them; a
    leaf without budget gives no rows. An empty table gives an empty result.
    Columns of docs named like a new column get the suffix _in."""
    names = list(levels)
    tokens = word_tokens() if tokens is None else tokens
    new = [n for n in names if levels[n] is not None]
    taken = {*new, "n_tokens", "epoch"}
    value = {n: F.col(n) if levels[n] is None else levels[n] for n in names}
    # inside, all columns have names that docs cannot have
    inner, mine, level = (tagged(*[f"{x}{i}" for i in range(n)]) for x, n in (("n", len(names)), ("d", len(docs.columns)), ("l", len(new))))
    size, number, key_ = tagged("tokens", "times", "key")
    node = [F.concat(F.when(value[n].isNull(), "").otherwise("="), F.coalesce(value[n].cast("string"), F.lit(""))).alias(c) for n, c in zip(names, inner)]
    whole = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(docs.columns, mine)], *[levels[n].alias(x) for n, x in zip(new, level)],
                        F.col(f"`{key}`").alias(key_), *node, tokens.alias(size))
    rows = written(whole.select(*inner, F.col(key_).alias("key_"), F.col(size).alias("tokens")), "mix")
    # inside, a value is "=" and its text, or "" for null
    plain = {n: F.when(F.col(c) != "", F.substr(F.col(c), F.lit(2))) for n, c in zip(names, inner)}
    decided = written(cuts(rows, inner, [w(plain) for w in weights], budget, seed, max_epochs, "key_"), "cuts")
    dropped(rows)
    joined = whole.join(_small(decided.select(*inner, "full", "cut", "budget")), inner)
    more = F.coalesce((_place(seed, F.col("full"), F.col(key_)) <= F.col("cut")).cast("int"), F.lit(0))
    n = F.when(F.col("budget") > 0, F.col("full") + more).otherwise(0).cast("int")
    out = joined.withColumn(number, n).where(F.col(number) > 0)
    return out.select(*[F.col(x).alias(f"{c}_in" if c in taken else c) for c, x in zip(docs.columns, mine)],
                      *[F.col(x).alias(c) for c, x in zip(new, level)], F.col(size).alias("n_tokens"),
                      F.explode(F.sequence(F.lit(0), F.col(number) - 1)).alias("epoch"))


def by_name(level: str, table: dict[str, float], default: float):
    """A weight from a table of names."""
    def weight(plain):
        w = F.lit(float(default))
        for k, v in table.items():
            w = F.when(plain[level] == k, float(v)).otherwise(w)
        return w
    return weight
