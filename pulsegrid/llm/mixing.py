"""Mixing sources to target weights by hierarchical budgeting. SQL functions only.

Method. Documents are leaves of a tree, by default domain, language, source. A node's budget is divided among its children by weight; a child that has fewer
tokens than its share (times the epochs allowed) takes what it has, and its shortage goes to its siblings by weight, and so on
("water filling"). A node's own limit is that of all below it, so a shortage leaves a node only when all its
children are exhausted: siblings come before ancestors. A leaf's budget is spent on whole epochs, each in an order of its own by a seeded hash,
and on the prefix of the last epoch that fits in.

A leaf may hold a third of all rows, so no task sorts a leaf: the order is cut into ranges by the hash, the ranges' token counts are
summed by prefix, ranges wholly within the budget are taken as they are, and only the range where the budget ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.shared import save

RANGE_DIGITS = 3  # hexadecimal digits of the hash that make a range: 4,096 ranges a leaf and epoch


def _divide(nodes: DataFrame, parent: list[str], budget: str = "budget") -> DataFrame:
    """Adds `share` to nodes(parent..., weight, capacity, budget of the parent): min(capacity, level * weight), filling the budget.

    By ascending capacity / weight, children take all they have as long as the level stays above; the others divide the rest by weight.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    names, ratio = [c for c in nodes.columns if c.startswith("level_")], F.col("capacity") / F.col("weight")
    order = by.orderBy(ratio, *[F.col(c).asc_nulls_first() for c in names])
    downwards = by.orderBy(ratio.desc(), *[F.col(c).desc_nulls_last() for c in names])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("full_before", F.coalesce(F.sum("capacity").over(before), F.lit(0.0)))
    # frames that grow row by row, in either order: one that shrinks is evaluated anew for each row
    nodes = nodes.withColumn("weight_left", F.sum("weight").over(downwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    level = (F.col(budget) - F.col("full_before")) / F.col("weight_left")
    # the level of the first child that isn't exhausted holds for all that follow
    nodes = nodes.withColumn("level", F.when(level * F.col("weight") < F.col("capacity"), level))
    nodes = nodes.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    share = F.when(F.col("level").isNull(), F.col("capacity")).otherwise(F.least("capacity", F.col("level") * F.col("weight")))
    return nodes.withColumn("share", share).drop("full_before", "weight_left", "level")


def _weight(levels: list[str], weights: dict[str, dict[str, float]], depth: int) -> Column:
    """The weight of a node among its siblings: by the name of its level; 1 where none is given."""
    given = weights.get(levels[depth], {})
    name = F.coalesce(F.col(f"level_{depth}"), F.lit(""))
    out = F.lit(1.0)
    for value, weight in given.items():
        out = F.when(name == value, F.lit(float(weight))).otherwise(out)
    return out


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], tokens: Column | int, epochs: int) -> DataFrame:
    """Adds `budget` (whole tokens) to leaves(level_0, level_1, ..., tokens): a row for each leaf. tokens: the whole budget."""
    columns = [f"level_{i}" for i in range(len(levels))]
    every = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    whole = every.select((F.lit(tokens) if isinstance(tokens, int) else tokens).cast("double")).first()[0]  # one number
    budgets, parent = None, []
    for depth in range(len(levels)):
        own = columns[: depth + 1]
        nodes = leaves.groupBy(*own).agg((F.sum("tokens") * F.lit(float(epochs))).alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(levels, weights, depth)).filter("weight > 0")
        nodes = _null_safe(nodes, budgets, parent) if parent else nodes.withColumn("budget", F.lit(whole))
        budgets = _divide(nodes, parent).select(*own, F.col("share").alias("budget"))
        parent = own
    out = _null_safe(leaves, budgets, columns)
    # a millionth of a token is rounding of the arithmetic
    return out.withColumn("budget", F.floor(F.col("budget") + F.lit(1e-6)).cast("long"))


def _null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join in which null equals null."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") for c in on], *[c for c in right.columns if c not in on])
    condition = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]
    return left.join(renamed, condition).drop(*[f"__{c}" for c in on])


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, dict[str, float]],
    tokens: Column | int,
    epochs: int = 1,
    seed: int = 0,
) -> DataFrame:
    """docs(doc_id, text, ...), each row once for every epoch that selects it, with `epoch` (from 0) and `n_tokens`.

    Tokens are words `[^\\x20\\x09-\\x0D]+`; a null or empty text has none, costs nothing, and is selected where its leaf has a budget at its place in the order.
    levels: the tree from the root, names and expressions on docs; a null is a node of its own, weighted as ''. weights: for each
    level, weights by the node's name; 1 where none is given, and 0 leaves a node out. tokens: the budget, a number or an expression on
    `all_tokens`, the tokens of all documents. A leaf takes a document while the tokens up to and with it are within its budget. Order within an
    epoch: md5 of "seed:epoch:doc_id", then doc_id, then md5 of the text; rows equal in these are taken together or not at all. The docs' own columns `epoch` and `n_tokens` are replaced, and all
    others kept, whatever their names. An empty table gives an empty result.
    """
    columns = list(levels)
    given = [c for c in docs.columns if c not in ("epoch", "n_tokens")]
    # inside, the caller's columns have names of their own, so that none can clash with those used here
    inside = {c: f"own_{i}" for i, c in enumerate(given)}
    own = [inside[c] for c in given]
    counted = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inside.items()], *[levels[c].alias(f"level_{i}") for i, c in enumerate(columns)])
    text, doc_id = F.col(inside["text"]), F.col(inside["doc_id"])
    counted = counted.withColumn("n_tokens", F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))
    names = [f"level_{i}" for i in range(len(columns))]
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    small = counted.select(doc_id.alias("doc_id"), F.md5(text).alias("text_md5"), *names, "n_tokens")
    small = save(small, "counted")
    leaves = save(small.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    budgets = save(leaf_budgets(leaves, columns, weights, tokens, epochs), "budgets")

    # a row for each epoch that a leaf's budget reaches; a leaf without tokens, or one with none allotted, has none
    reached = budgets.filter("budget > 0").withColumn("last", F.least(F.floor((F.col("budget") - 1) / F.col("tokens")), F.lit(epochs - 1)))
    reached = reached.select(*names, F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias("epoch"), "tokens", "budget")
    reached = reached.withColumn("left", F.col("budget") - F.col("epoch") * F.col("tokens"))
    whole = reached.filter(F.col("left") >= F.col("tokens")).select(*names, "epoch")
    partial = save(reached.filter(F.col("left") < F.col("tokens")).select(*names, "epoch", "left"), "partial")

    ranked = _null_safe(small, F.broadcast(partial) if _few(partial) else partial, names).withColumn("place", order)
    ranked = ranked.withColumn("range", F.substring("place", 1, RANGE_DIGITS))
    ranges = ranked.groupBy(*names, "epoch", "left", "range").agg(F.sum("n_tokens").alias("tokens"))
    up_to = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = save(ranges.withColumn("end", F.sum("tokens").over(up_to)), "ranges")
    first_out = ranges.filter(F.col("end") > F.col("left"))
    edge = first_out.groupBy(*names).agg(F.min("range").alias("edge"), F.min_by(F.col("end") - F.col("tokens"), "range").alias("before"))
    ends = save(_null_safe(partial, edge, names), "ends")  # a partial epoch has fewer tokens than its leaf, so it has an edge

    # one text scan picks everything: a row's epochs are the whole ones, and the partial one up to its place
    placed = _null_safe(small, ends, names).withColumn("place", order).filter(F.substring("place", 1, RANGE_DIGITS) == F.col("edge"))
    same = placed.groupBy(*names, "epoch", "left", "before", "place", "doc_id", "text_md5").agg(F.sum("n_tokens").alias("tokens"))
    within = Window.partitionBy(*names).orderBy("place", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text_md5"))
    within = within.rowsBetween(Window.unboundedPreceding, 0)
    same = same.withColumn("end", F.col("before") + F.sum("tokens").over(within))
    cut = same.filter(F.col("end") <= F.col("left")).groupBy(*names).agg(
        F.max(F.struct("place", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.coalesce("text_md5", F.lit("")).alias("md5"))).alias("cut")
    )
    ends = _left_null_safe(ends, cut, names).select(*names, F.struct("epoch", "edge", "cut").alias("partial"))
    plan = whole.groupBy(*names).agg(F.sort_array(F.collect_list("epoch")).alias("whole"))
    plan = save(_full_null_safe(plan, ends, names), "plan")

    chosen = _null_safe(counted, F.broadcast(plan) if _few(plan) else plan, names)
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("partial.epoch"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    mine = F.struct(place.alias("place"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("id"), F.coalesce(F.md5(text), F.lit("")).alias("md5"))
    taken = F.coalesce((F.substring(place, 1, RANGE_DIGITS) < F.col("partial.edge")) | (mine <= F.col("partial.cut")), F.lit(False))
    epochs_of = F.concat(
        F.coalesce("whole", F.array().cast("array<int>")), F.when(taken, F.array("partial.epoch")).otherwise(F.array().cast("array<int>"))
    )
    return chosen.select(*[F.col(n).alias(c) for c, n in inside.items()], F.explode(epochs_of).alias("epoch"), "n_tokens")


def _few(df: DataFrame, most: int = 10_000) -> bool:
    """Whether a saved table of leaves is small enough to broadcast."""
    return df.limit(most + 1).count() <= most


def _left_null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"__{c}") for c in on], *[c for c in right.columns if c not in on])
    return left.join(renamed, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on], "left").drop(*[f"__{c}" for c in on])


def _full_null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"__{c}") for c in on], *[c for c in right.columns if c not in on])
    joined = left.withColumn("__l", F.lit(True)).join(renamed, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on], "full")
    keys = [F.when(F.col("__l"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in on]
    return joined.select(*keys, *[c for c in left.columns if c not in on], *[c for c in right.columns if c not in on])
