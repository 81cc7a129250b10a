"""Mixing sources to target weights by hierarchical budgeting.

A tree of domains, languages and sources carries a weight at every node; a parent's token budget is
divided among its children in proportion to their weights.  A leaf can give at most ``max_epochs``
times its tokens.  What a child cannot take goes to its siblings first; only what a whole subtree
cannot take goes to the siblings of its root.  That is one water level per parent: each child gets
the smaller of its capacity and level times weight, and since capacities are summed from the leaves
up, a shortage is settled at the lowest ancestor that can.

A leaf's budget is met by whole epochs plus a prefix of one more, in an order seeded per epoch.  No
leaf is ever sorted: rows are hashed into even buckets, whose token sums show in which bucket the
prefix ends, and only that bucket is put in order.  What comes out is one hash threshold per leaf,
so texts are neither shuffled nor written; a leaf with a third of all rows costs nothing extra.

Tokens here are words.  Defined results: null keys are the empty key; a null text has no tokens; a
row is in a prefix if the tokens before it do not fill the budget, so a prefix may exceed its budget
by less than one row (rows equal in id and text stand or fall together); a leaf without tokens or
with weight zero gives nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorspark.llm.common import free_name, text_of
from sensorspark.session import broadcast_if_small, materialize, with_scalars

# Rows that a bucket of a leaf holds on average.
BUCKET_ROWS = 1000
MAX_BITS = 30


@dataclass(frozen=True)
class Mix:
    """``weights`` maps a level to weights of its values; a value that is not listed has weight 1.

    ``share`` is the token budget as a share of all tokens there are.
    """

    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    share: float = 1.0
    max_epochs: int = 4
    seed: int = 17


def domain_of(source: Column) -> Column:
    """Sources named by a number form domains of five; all others share one domain."""
    number = F.regexp_extract(source, r"^src([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("group"), F.floor(number.cast("int") / 5).cast("string"))).otherwise(
        F.lit("other")
    )


def tokens(text: Column) -> Column:
    parts = F.split(text, r"[\x20\x09-\x0D]+")
    return F.size(F.filter(parts, lambda x: x != "")).cast("bigint")


def _weight(level: str, mix: Mix) -> Column:
    out = F.lit(1.0)
    for value, weight in mix.weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(float(weight))).otherwise(out)
    return out


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves`` (levels, supply) with the token ``budget`` of each.

    All tables here have a row per node of the tree.
    """
    nodes = {len(mix.levels): leaves.select(*mix.levels, (F.col("supply") * mix.max_epochs).alias("capacity"))}
    for depth in reversed(range(1, len(mix.levels) + 1)):
        level = nodes[depth].withColumn("weight", _weight(mix.levels[depth - 1], mix))
        # A node that may take nothing must not count in its parent's capacity.
        level = level.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0))
        nodes[depth] = level
        nodes[depth - 1] = level.groupBy(*mix.levels[: depth - 1]).agg(F.sum("capacity").alias("capacity"))
    total = leaves.agg((F.sum("supply") * F.lit(mix.share)).alias("wanted"))
    parent = with_scalars(nodes[0], total).select(
        F.least(F.coalesce("wanted", F.lit(0.0)), F.coalesce("capacity", F.lit(0)).cast("double")).alias("given")
    )
    for depth in range(1, len(mix.levels) + 1):
        above = list(mix.levels[: depth - 1])
        level = nodes[depth].where((F.col("weight") > 0) & (F.col("capacity") > 0))
        level = level.join(parent, above) if above else with_scalars(level, parent)
        ratio = F.col("capacity") / F.col("weight")
        own = Window.partitionBy(*above)
        before = own.orderBy(ratio, *mix.levels[:depth]).rowsBetween(Window.unboundedPreceding, -1)
        # The level if all children with a smaller ratio are full; the true level is the highest.
        candidate = (F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / (
            F.sum("weight").over(own) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
        )
        parent = (
            level.withColumn("level", candidate)
            .withColumn("level", F.max("level").over(own))
            .select(
                *mix.levels[:depth],
                F.least(F.col("capacity").cast("double"), F.col("level") * F.col("weight")).alias("given"),
            )
        )
    return leaves.join(parent.withColumnRenamed("given", "budget"), list(mix.levels), "left").fillna(
        0.0, ["budget"]
    )


def _order(row: Column, epoch: Column, mix: Mix) -> Column:
    return F.xxhash64(row, epoch, F.lit(mix.seed))


def leaf_plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """From (levels, n_tokens, row hash) to one row per leaf with tokens: whole epochs and the
    threshold of the prefix, null where there is none."""
    levels = list(mix.levels)
    leaves = materialize(
        rows.groupBy(*levels).agg(F.sum("n_tokens").alias("supply"), F.count(F.lit(1)).alias("n")), "leaves"
    )
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("n") / BUCKET_ROWS)), F.lit(0)), F.lit(MAX_BITS)).cast("int")
    planned = materialize(
        budgets(leaves, mix)
        .where("supply > 0")
        # A budget that misses a whole epoch by rounding only is that epoch.
        .withColumn("epochs", F.floor(F.col("budget") / F.col("supply") + 1e-9).cast("int"))
        .withColumn("rest", F.greatest(F.col("budget") - F.col("epochs") * F.col("supply"), F.lit(0.0)))
        .withColumn("rest", F.when(F.col("rest") > 1e-6 * F.col("supply"), F.col("rest")).otherwise(0.0))
        .withColumn("bits", bits),
        "leaf-budgets",
    )
    partial = broadcast_if_small(planned.where("rest > 0").select(*levels, "epochs", "rest", "bits"))
    hashed = rows.join(partial, levels).withColumn("h", _order(F.col("row"), F.col("epochs"), mix))
    # Signed order is kept by the arithmetic shift; no bits means one bucket.
    bucket = F.when(F.col("bits") == 0, F.lit(0).cast("bigint")).otherwise(
        F.call_function("shiftright", F.col("h"), F.lit(64) - F.col("bits"))
    )
    hashed = hashed.withColumn("bucket", bucket)
    sums = hashed.groupBy(*levels, "rest", "bucket").agg(F.sum("n_tokens").alias("n_tokens"))
    before = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = materialize(
        sums.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
        .where(F.col("before") < F.col("rest"))
        .groupBy(*levels)
        .agg(F.max_by(F.struct("bucket", "before"), "bucket").alias("end"))
        .select(*levels, F.col("end.bucket").alias("bucket"), F.col("end.before").alias("before")),
        "last-buckets",
    )
    ordered = Window.partitionBy(*levels).orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        hashed.join(broadcast_if_small(last), [*levels, "bucket"])
        .groupBy(*levels, "rest", "before", "h")
        .agg(F.sum("n_tokens").alias("n_tokens"))
        .withColumn("at", F.col("before") + F.coalesce(F.sum("n_tokens").over(ordered), F.lit(0)))
        .where(F.col("at") < F.col("rest"))
        .groupBy(*levels)
        .agg(F.max("h").alias("threshold"))
    )
    return materialize(
        planned.join(ends, levels, "left").select(*levels, "supply", "budget", "epochs", "threshold"), "leaf-plan"
    )


def mixed(docs: DataFrame, mix: Mix, domain: Column | None = None) -> DataFrame:
    """The chosen rows of ``docs``, one per epoch, with the columns of the tree that ``docs`` lacks and
    ``epoch`` and ``n_tokens``, under names that do not clash, in a struct ``mix``."""
    levels = list(mix.levels)
    name = free_name(docs, "mix")
    text = text_of(docs)
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    keys = {
        "domain": domain_of(source) if domain is None else F.coalesce(domain, F.lit("")),
        "source": source,
        "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
    }
    of_row = [keys.get(c, F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in levels]
    row = F.xxhash64(F.col("doc_id"), text)
    rows = materialize(docs.select(*of_row, tokens(text).alias("n_tokens"), row.alias("row")), "mix-rows")
    leaf, of_text, key, of_plan, plan, epoch = (
        free_name(docs, c) for c in ("leaf_", "n_tokens_", "row_", "leaf_of_plan_", "plan_", "epoch_")
    )
    planned = broadcast_if_small(
        leaf_plan(rows, mix).select(F.struct(*levels).alias(of_plan), F.struct("epochs", "threshold").alias(plan))
    )
    keyed = docs.withColumns({leaf: F.struct(*of_row), of_text: tokens(text), key: row})
    epochs = F.col(f"{plan}.epochs")
    in_prefix = _order(F.col(key), epochs, mix) <= F.col(f"{plan}.threshold")
    taken = epochs + F.when(in_prefix, 1).otherwise(0)
    return (
        keyed.join(planned, F.col(leaf) == F.col(of_plan))
        .where(taken > 0)
        .withColumn(epoch, F.explode(F.sequence(F.lit(0), taken - 1)))
        .select(
            *[F.col(f"`{c}`") for c in docs.columns],
            F.struct(f"{leaf}.*", F.col(epoch).alias("epoch"), F.col(of_text).alias("n_tokens")).alias(name),
        )
    )
