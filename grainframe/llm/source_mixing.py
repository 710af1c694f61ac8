"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree of domain, language and source. Among siblings it is shared by weight; a child that holds
less than its share (tokens times ``max_epochs``) takes what it has and the shortage goes to its siblings by weight. Since
a parent's capacity is the sum of its children's, a shortage reaches the parent's siblings only when all children are full.
The share of a node is ``min(capacity, weight * level)``; the level of a group of siblings has a closed form over the
siblings in order of capacity / weight, so each tree level is one window over its nodes.

A leaf then passes over its documents in whole epochs, and in the last, partial epoch takes the documents of a seeded order
whose running sum of tokens stays within the rest. Running sums are taken in two levels: over the sums of 4,096 slices of
the order, then inside a slice, so no task gets a whole leaf. Only ids, keys and token counts are shuffled.

Defined results: a null domain, language or source is the node ``unknown``. Nodes without a given weight get
``default_weight``. Null texts have no tokens; documents without tokens are taken with the documents around them. If the
budget exceeds all capacity, every leaf is taken ``max_epochs`` times. Leaves below a node of weight 0 are not taken, and what
they hold counts for no ancestor; a negative weight is refused. Rows of equal id, leaf and text are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainframe.llm.common import WORD, free_name, table, with_row_key

LEVELS = ("domain", "lang", "source")
WEIGHTS = {
    "domain": {"web": 50, "books": 30, "code": 20},
    "lang": {"en": 55, "de": 15, "fr": 15, "es": 15},
}
DEFAULT_WEIGHT = 10
MAX_EPOCHS = 2
#: Share of all tokens that the query budgets, in percent.
BUDGET_PERCENT = 80
SEED = "mix-1"
SLICE_DIGITS = 3


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """A source's domain, by its number: the tables have none of their own."""
    number = F.try_element_at(F.regexp_extract_all(source, F.lit(r"([0-9]+)"), F.lit(1)), F.lit(1)).try_cast("int") % 3
    return F.when(number == 0, "web").when(number == 1, "books").when(number == 2, "code").otherwise("unknown")


def _weight(level: str, weights: dict[str, dict[str, int]], default: int) -> Column:
    out = F.lit(default)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def _shared_out(nodes: DataFrame, parents: list[str], level: str, weights: dict[str, dict[str, int]], default: int) -> DataFrame:
    """``nodes`` (capacity, and the ``budget`` of their parent) with their own ``share``."""
    order = Window.partitionBy(*parents).orderBy((F.col("capacity") / F.col("w")).asc(), F.col(level))
    before = F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("capacity")
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    out = nodes.withColumn("w", _weight(level, weights, default)).withColumn("left", F.col("budget") - before).withColumn("among", rest)
    # whole numbers throughout, so that an only child gets all of its parent's share
    level_here = F.struct((F.col("left") / F.col("among")).alias("at"), "left", "among")
    fits = F.when(F.col("left") * F.col("w") <= F.col("capacity") * F.col("among"), level_here)
    out = out.withColumn("water", F.max(fits).over(Window.partitionBy(*parents)))
    share = F.when(F.col("water").isNull(), F.col("capacity")).otherwise(F.least(F.col("capacity"), F.expr("(w * water.left) div water.among")))
    return out.withColumn("share", share.cast("long")).drop("w", "left", "among", "water", "budget")


def leaf_budgets(leaves: DataFrame, budget: int, max_epochs: int, weights: dict[str, dict[str, int]] | None = None, default_weight: int = DEFAULT_WEIGHT) -> DataFrame:
    """``domain, lang, source, tokens, share`` from ``leaves`` (domain, lang, source, tokens)."""
    weights = WEIGHTS if weights is None else weights
    if default_weight < 0 or any(w < 0 for named in weights.values() for w in named.values()):
        raise ValueError("weights must not be negative")
    for level in LEVELS:  # a node without weight holds nothing that its parent could give
        leaves = leaves.where(_weight(level, weights, default_weight) > 0)
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    parent = None
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        if parent is None:
            nodes = nodes.withColumn("budget", F.lit(budget).cast("long"))
        else:
            nodes = nodes.join(parent.select(*keys[:-1], F.col("share").alias("budget")), keys[:-1])
        parent = _shared_out(nodes, keys[:-1], level, weights, default_weight)
    return parent.select(*LEVELS, "tokens", "share")


def mix_sources(docs: DataFrame, budget: int | None = None, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, weights: dict[str, dict[str, int]] | None = None, seed: str = SEED, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens, epochs`` of every row of ``docs`` (which has those but ``epochs``).

    ``epochs`` is how often the row is taken. Without a ``budget`` in tokens, it is a percentage of all tokens. A column
    ``tie`` of ``docs`` (a digest of the text) orders rows of one id, and stands for the id of rows without one. A column
    ``row_key`` comes back with the row.
    """
    tie = F.col("tie") if "tie" in docs.columns else F.lit("")
    extra = ["row_key"] if "row_key" in docs.columns else []
    rows = docs.select(F.col(doc_id).alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in LEVELS), F.col("n_tokens").cast("long").alias("n_tokens"), tie.alias("tie"), *extra)
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    if budget is None:
        budget = (leaves.agg(F.sum("tokens")).first()[0] or 0) * budget_percent // 100
    shares = leaf_budgets(leaves, budget, max_epochs, weights)
    whole = F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(F.lit(0))
    plan = shares.select(*LEVELS, whole.cast("long").alias("whole"), F.when(F.col("tokens") > 0, F.col("share") % F.col("tokens")).otherwise(F.lit(0)).cast("long").alias("rest"))

    joined = rows.join(plan, list(LEVELS), "left").withColumn("whole", F.coalesce("whole", F.lit(0))).withColumn("rest", F.coalesce("rest", F.lit(0)))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), "tie", F.lit(""))).cast("binary"))
    placed = joined.withColumn("h", order).withColumn("slice", F.substring("h", 1, SLICE_DIGITS))
    slices = placed.groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("n"))
    over_slices = Window.partitionBy(*LEVELS).orderBy("slice")
    earlier = slices.select(*LEVELS, "slice", (F.sum("n").over(over_slices) - F.col("n")).alias("earlier"))
    inside = Window.partitionBy(*LEVELS, "slice").orderBy("h", "doc_id", "n_tokens", "tie", *extra).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("within", F.sum("n_tokens").over(inside)).join(earlier, [*LEVELS, "slice"])
    taken = (F.col("rest") > 0) & (F.col("earlier") + F.col("within") <= F.col("rest"))
    return summed.select("doc_id", *LEVELS, "n_tokens", (F.col("whole") + taken.cast("long")).alias("epochs"), *extra)


def take_mixed(docs: DataFrame, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, weights: dict[str, dict[str, int]] | None = None, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source ...), each as often as mixing takes it.

    A decision is carried back by the row's own key, so rows that share an id, or have none, keep their own.
    """
    name, other, key = (free_name(docs, n) for n in ("epochs_taken", "mixed_key", "row_key_"))
    keyed = with_row_key(docs, key)
    counted = keyed.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", n_words().alias("n_tokens"), tie_of().alias("tie"), F.col(key).alias("row_key"))
    mixed = mix_sources(counted, None, budget_percent, max_epochs, weights, seed)
    taken = mixed.where("epochs > 0").select(F.col("row_key").alias(other), F.col("epochs").alias(name))
    again = keyed.join(taken, F.col(key) == F.col(other))
    return again.withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(name)))).drop(name, other, key)


def tie_of(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))


def op9(spark, sf_dir: str) -> DataFrame:
    """``op9_source_mixing``: how often every document is taken, for 80 % of all tokens (words) at the target weights."""
    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", n_words().alias("n_tokens"), tie_of().alias("tie")))


def _case(level: str) -> str:
    return "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in WEIGHTS[level].items()) + f" ELSE {DEFAULT_WEIGHT} END" if level in WEIGHTS else str(DEFAULT_WEIGHT)


def mixing_sql(docs: str = "documents", max_epochs: int = MAX_EPOCHS, budget_percent: int = BUDGET_PERCENT) -> str:
    """DuckDB SQL of ``op9``, as common table expressions that end in ``mixed``."""
    parts = [
        f"""rows_in AS (SELECT doc_id, CASE CAST(try_cast(nullif(regexp_extract(source, '[0-9]+'), '') AS INTEGER) % 3 AS INTEGER) WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'code' ELSE 'unknown' END AS domain,
  coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS n_tokens, md5(coalesce(text, '')) AS tie FROM {docs})""",
        f"leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {max_epochs} AS BIGINT) AS capacity FROM rows_in GROUP BY ALL)",
        f"share_root AS (SELECT CAST(coalesce(sum(tokens), 0) AS BIGINT) * {budget_percent} // 100 AS budget FROM leaves)",
    ]
    above = "share_root"
    for depth, level in enumerate(LEVELS):
        keys, up = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        by = f"PARTITION BY {up} " if up else ""
        join = f"JOIN (SELECT {up}, share AS budget FROM {above}) USING ({up})" if up else f"CROSS JOIN {above}"
        parts += [
            f"nodes_{level} AS (SELECT *, CAST({_case(level)} AS BIGINT) AS w FROM (SELECT {keys}, CAST(sum(capacity) AS BIGINT) AS capacity, CAST(sum(tokens) AS BIGINT) AS tokens FROM leaves GROUP BY {keys}) {join})",
            f"""level_{level} AS (SELECT *, CAST(budget - (sum(capacity) OVER (o ROWS UNBOUNDED PRECEDING) - capacity) AS BIGINT) AS unspent, CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS among
  FROM nodes_{level} WINDOW o AS ({by}ORDER BY CAST(capacity AS DOUBLE) / w, {level}))""",
            f"""share_{level} AS (SELECT {keys}, tokens, CASE WHEN water IS NULL THEN capacity ELSE least(capacity, (w * water.unspent) // water.among) END AS share
  FROM (SELECT *, max(CASE WHEN unspent * w <= capacity * among THEN {{'at_level': CAST(unspent AS DOUBLE) / among, 'unspent': unspent, 'among': among}} END) OVER ({by}) AS water FROM level_{level}))""",
        ]
        above = f"share_{level}"
    parts += [
        f"plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN share % tokens ELSE 0 END AS rest FROM {above})",
        f"placed AS (SELECT *, md5('{SEED}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), tie)) AS h FROM rows_in JOIN plan USING (domain, lang, source))",
        "mixed AS (SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n_tokens, tie ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS BIGINT) AS epochs FROM placed)",
    ]
    return "WITH " + ",\n".join(parts)


SQL = mixing_sql() + "\nSELECT * FROM mixed"
