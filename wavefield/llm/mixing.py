"""Mixing sources to target weights (operator 6): hierarchical budgeting over domain, language, source.

The tree's leaves are (domain, lang, source) with the tokens they hold. A token budget goes down the
tree by the weights of each node's children; a child whose subtree cannot take its share (all its
tokens, EPOCHS times) takes what it can, and the shortage goes to its siblings by their weights.
Only what a whole group of siblings cannot take reaches the level above. Each leaf then takes a
prefix of its rows: epoch 0 in seeded hash order, then epoch 1 in its own order, and so on, as many
whole keys as fit the leaf's budget.

A prefix of a hash order needs no sort of a leaf: the leaf's tokens are summed by hash slice, the
slice in which the budget ends is found from these sums, and only the rows of that slice are summed
by key. The outcome is one cut per leaf, a table as small as the tree, against which every document
is compared in place: texts are never shuffled, and a leaf with a third of all rows is no burden.

Weights: children share equally unless `weights` names them by path. The tree is a table like any other:
shares are found level by level with windows over a node's children, ordered by how soon each is
exhausted, so any number of leaves will do. The cuts are broadcast if they take at most PLAN_BYTES, and
joined by leaf otherwise. `budgets` is the same rule for a tree in memory.

Defined results: null lang or source is the name '(none)'; null and empty texts have no token and
ride with their key; a leaf starts no epoch without budget, so one without tokens gives no rows; rows of one id in one leaf have one key and are taken together; an empty table
gives no rows; extra columns are carried through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavefield.llm.common import SPACE, stored, table

BUDGET_SHARE, EPOCHS, SEED = 0.5, 2, 17
#: A table of cuts of at most so many bytes is broadcast.
PLAN_BYTES = 32 << 20
#: Rows that a hash slice of a leaf holds, about.
SLICE_ROWS = 2_000
NONE = "(none)"
#: What the registered query and the pipeline aim for; children not named have weight 1.
WEIGHTS = {("curated",): 1.0, ("web",): 2.0, ("web", "en"): 3.0, ("curated", "en"): 2.0}


def domain(source: Column) -> Column:
    """The domain of a source: those numbered below 8 are curated, others (longer numbers too) are web."""
    number = F.regexp_extract(source, r"(\d+)$", 1)
    return F.when((number != "") & F.coalesce(number.try_cast("long") < 8, F.lit(False)), "curated").otherwise("web")


def tokens(text: Column) -> Column:
    """Words of a text, the unit of the budget."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(1 + F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit("")))).cast("long")


def share_out(budget: float, weights: list[float], room: list[float]) -> list[float]:
    """budget over siblings by weight; what a sibling cannot take goes to the others by their weights."""
    given = [0.0] * len(room)
    able = sorted((i for i in range(len(room)) if room[i] > 0 and weights[i] > 0), key=lambda i: room[i] / weights[i])
    left, total = min(budget, sum(room[i] for i in able)), sum(weights[i] for i in able)
    for at, i in enumerate(able):
        if left * weights[i] / total < room[i]:
            for j in able[at:]:
                given[j] = left * weights[j] / total
            break
        given[i] = room[i]
        left -= room[i]
        total -= weights[i]
    return given


def budgets(leaves: dict[tuple, int], budget: float, weights: dict[tuple, float], epochs: int = EPOCHS) -> dict[tuple, int]:
    """Tokens that each leaf (a path) may take. Siblings of weight 0 take what the others cannot."""
    out: dict[tuple, int] = {}

    def down(path: tuple, below: dict[tuple, int], amount: float) -> None:
        if len(below) == 1 and path in below:
            out[path] = math.floor(amount + 1e-6)
            return
        children: dict[tuple, dict[tuple, int]] = {}
        for x, n in below.items():
            children.setdefault(x[: len(path) + 1], {})[x] = n
        names = sorted(children)
        parts = [children[name] for name in names]
        room = [float(epochs * sum(x.values())) for x in parts]
        mine = [weights.get(name, 1.0) for name in names]
        given = share_out(amount, mine, room)
        rest = share_out(amount - sum(given), [1.0 if not w else 0.0 for w in mine], room)
        for name, part, a, b in zip(names, parts, given, rest, strict=True):
            down(name, part, a + b)

    if leaves:
        down((), leaves, min(budget, float(epochs * sum(leaves.values()))))
    return out


LEAF = ["l1_", "l2_", "l3_"]


def _shares(nodes: DataFrame, parent: list[str], weight: Column, amount: Column) -> Column:
    """share_out over the children of each parent: nodes have room_; amount is the parent's."""
    able = (F.col("room_") > 0) & (weight > 0)
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    # the first to be exhausted come first
    earlier = siblings.orderBy(F.when(able, F.col("room_") / weight).asc_nulls_last(), LEAF[len(parent)]).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda x, over: F.coalesce(F.sum(F.when(able, x)).over(over), F.lit(0.0))
    left = F.least(amount, total(F.col("room_"), siblings))
    return F.when(able, F.struct((left - total(F.col("room_"), earlier)).alias("left"), (total(weight, siblings) - total(weight, earlier)).alias("weight")))


def _divided(nodes: DataFrame, parent: list[str], weight: Column, amount: Column) -> DataFrame:
    """nodes with share_, what each gets of amount."""
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    found = nodes.withColumn("at_", _shares(nodes, parent, weight, amount))
    part = F.col("at_.left") / F.col("at_.weight")
    full = part * weight >= F.col("room_")
    # the first child that is not exhausted sets the level for all that follow
    level = F.max(F.when(~full, F.struct(F.col("at_.weight"), part.alias("part")))).over(siblings)["part"]
    share = F.when(F.col("at_").isNull(), F.lit(0.0)).when(full, F.col("room_")).otherwise(level * weight)
    return found.withColumn("share_", share).drop("at_")


def allowances(sizes: DataFrame, budget: float, weights: dict[tuple, float], epochs: int = EPOCHS) -> DataFrame:
    """`budgets` for a table of leaves (LEAF and n_ tokens): LEAF and allowed_."""
    above, parts = None, {"/".join(map(str, map(len, k))) + "/" + "/".join(k): float(v) for k, v in weights.items()}
    named = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]) if parts else None
    for depth in range(1, len(LEAF) + 1):
        names, parent = LEAF[:depth], LEAF[: depth - 1]
        # sizes of the names make a path's text unambiguous
        path = F.concat_ws("/", *[F.length(n).cast("string") for n in names], *names)
        nodes = sizes.groupBy(*names).agg((epochs * F.sum("n_")).cast("double").alias("room_"))
        nodes = nodes.withColumn("weight_", F.coalesce(named[path], F.lit(1.0)) if parts else F.lit(1.0))
        nodes = nodes.join(above, parent) if above is not None else nodes.withColumn("amount_", F.least(F.lit(float(budget)), F.sum("room_").over(Window.partitionBy(F.lit(0)))))
        nodes = _divided(nodes, parent, F.col("weight_"), F.col("amount_")).withColumnRenamed("share_", "given_")
        siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        rest = nodes.withColumn("rest_", F.col("amount_") - F.sum("given_").over(siblings))
        # children of weight 0 take what the others cannot
        nodes = _divided(rest, parent, F.when(F.col("weight_") > 0, F.lit(0.0)).otherwise(F.lit(1.0)), F.col("rest_"))
        above = nodes.select(*names, (F.col("given_") + F.col("share_")).alias("amount_"))
    return above.select(*LEAF, F.floor(F.col("amount_") + 1e-6).cast("long").alias("allowed_"))


def _keyed(docs: DataFrame, count: Column) -> DataFrame:
    """The leaf (l1_, l2_, l3_), tokens n_ and the text of the id, with the whole row beside them."""
    source = F.coalesce(F.col("source"), F.lit(NONE))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), domain(source).alias("l1_"), F.coalesce(F.col("lang"), F.lit(NONE)).alias("l2_"), source.alias("l3_"),
        count.alias("n_"), F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE)).alias("id_"),
    )


def _key(seed: int, epoch: Column) -> Column:
    """The order of rows in an epoch of a leaf: 60 bits of a seeded digest of the id."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), epoch.cast("string"), "id_")), 1, 15), 16, 10).cast("long")


def mix(
    docs: DataFrame, budget: float | None = None, weights: dict[tuple, float] | None = None, epochs: int = EPOCHS, seed: int = SEED, share: float = BUDGET_SHARE, count: Column | None = None
) -> DataFrame:
    """domain, lang, source, epoch, n_tokens and row (all columns of docs) of the rows that are selected;
    a row taken in several epochs comes several times. budget is in tokens; without it, share of all. count: a
    row's tokens, by default the words of its text."""
    keyed = _keyed(docs, tokens(F.col("text")) if count is None else count)
    # counted once: ids and counts are a few bytes a row, texts are not
    slim = stored(keyed.select(*LEAF, "id_", "n_"), "counts")
    sizes = stored(slim.groupBy(*LEAF).agg(F.sum("n_").alias("n_"), F.count("*").alias("rows_")), "leaves")
    amount = share * (sizes.agg(F.sum("n_")).first()[0] or 0) if budget is None else budget

    # the epoch in which each leaf's budget ends, what is left for it there, and into how many slices its keys are cut
    plan = sizes.join(allowances(sizes, amount, WEIGHTS if weights is None else weights, epochs), LEAF)
    whole = F.when(F.col("n_") > 0, F.least(F.floor(F.col("allowed_") / F.col("n_")), F.lit(epochs))).when(F.col("allowed_") > 0, epochs).otherwise(0).cast("int")
    plan = plan.withColumn("whole_", whole).withColumn("left_", F.col("allowed_") - F.col("whole_") * F.col("n_")).withColumn("slices_", F.greatest(F.lit(1), F.floor(F.col("rows_") / SLICE_ROWS)))
    plan = stored(plan.select(*LEAF, "whole_", "left_", "slices_"), "plan")
    bytes_ = plan.agg(F.sum(sum(F.octet_length(c) for c in LEAF) + 64)).first()[0] or 0
    small = F.broadcast if bytes_ <= PLAN_BYTES else lambda df: df
    top = F.lit(1 << 60)
    slice_of = F.floor(F.col("key_") / (top / F.col("slices_"))).cast("long")
    last = slim.join(small(plan.where(F.col("left_") > 0)), LEAF).withColumn("key_", _key(seed, F.col("whole_")))
    last = last.withColumn("slice_", F.least(slice_of, F.col("slices_") - 1))
    summed = last.groupBy(*LEAF, "left_", "slice_").agg(F.sum("n_").alias("n_"))
    running = F.sum("n_").over(Window.partitionBy(*LEAF).orderBy("slice_"))
    # the first slice that does not fit whole
    ends = summed.withColumn("upto_", running).where(F.col("upto_") > F.col("left_"))
    ends = ends.groupBy(*LEAF).agg(F.min_by(F.struct("slice_", (F.col("left_") - F.col("upto_") + F.col("n_")).alias("rest_")), "slice_").alias("end_")).select(*LEAF, "end_.*")
    inside = last.join(small(ends), [*LEAF, "slice_"]).groupBy(*LEAF, "rest_", "key_").agg(F.sum("n_").alias("n_"))
    upto = F.sum("n_").over(Window.partitionBy(*LEAF).orderBy("key_"))
    # the first key that does not fit: keys below it are taken; a leaf whose rest of the budget takes all of its
    # last epoch has no cut
    cuts = inside.withColumn("upto_", upto).where(F.col("upto_") > F.col("rest_")).groupBy(*LEAF).agg(F.min("key_").alias("cut_"))
    cut = F.when(F.col("left_") > 0, F.coalesce("cut_", top)).otherwise(0)
    final = stored(plan.join(cuts, LEAF, "left").select(*LEAF, "whole_", cut.alias("cut_")), "cuts")
    epoch = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    joined = keyed.join(small(final), LEAF).withColumn("epoch", epoch)
    taken = (F.col("epoch") < F.col("whole_")) | ((F.col("epoch") == F.col("whole_")) & (_key(seed, F.col("epoch")) < F.col("cut_")))
    return joined.where(taken).select(F.col("l1_").alias("domain"), F.col("l2_").alias("lang"), F.col("l3_").alias("source"), "epoch", F.col("n_").alias("n_tokens"), "row")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", tokens(F.col("text")).alias("words"))
    return mix(stored(docs, "words"), count=F.col("words")).select("row.doc_id", "domain", "lang", "source", "epoch", "n_tokens")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: what the budget takes; a row of two epochs comes twice."""
    return mix(docs).select("row.*")


QUERIES = {"op6_mixing": op6_mixing}
ORACLES: dict[str, str] = {}
