"""Banks of prototypes and vectors held against them: similarity, prediction, assignment, diverse selection.

A bank is a model: its rows are counted, and one that passes ``MAX_BANK`` is refused. It travels as one broadcast row, so rows
meet it without a shuffle. Distances are made once, as a column of their own; later steps refer to that column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from grainframe.operators.ordered import counted_quantiles, join_nulls, vector_medians
from grainframe.sources.workspace import Workspace

MAX_BANK, MAX_BANK_BYTES = 20_000, 64_000_000
#: Rows that meet a bank at once.
STEP = 500


def one_row(bank: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """The rows of a bank as one sorted array ``bank``, in a broadcast frame of one row."""
    n = bank.count()
    if n > MAX_BANK:
        raise ValueError(f"a bank of {n} rows is more than {MAX_BANK}")
    return F.broadcast(bank.agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in columns if c not in order)))).alias("bank")))


def centroids(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``keys, centre, n``: means by dimension, summed before the shuffle."""
    long = rows.select(*keys, F.posexplode(vector).alias("at", "v"))
    means = long.groupBy(*keys, "at").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count("*").alias("n"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("centre"), F.max("n").alias("n"))


def squared_distance(x: Column, y: Column, scale: Column | None = None) -> Column:
    """Sum of squared differences of two arrays of equal length, in units of ``scale``."""
    gaps = F.zip_with(x, y, lambda a, b: a - b)
    if scale is not None:
        gaps = F.zip_with(gaps, scale, lambda g, s: g / s)
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)


def with_softmax(rows: DataFrame, logits: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the softmax of an array column. Its maximum and its powers are columns, made once each."""
    held = rows.withColumn("top__", F.array_max(logits))
    held = held.withColumn("powers__", F.transform(logits, lambda v: F.exp(v - F.col("top__"))))
    held = held.withColumn("total__", F.aggregate("powers__", F.lit(0.0), lambda s, v: s + v))
    return held.withColumn(name, F.transform("powers__", lambda v: v / F.col("total__"))).drop("top__", "powers__", "total__")


def prototype_similarity(rows: DataFrame, vector: str, bank: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """``rows`` with ``prototype`` and ``similarity``: the best of exp(-d / 2), d the mean squared scaled distance (30 at most).

    ``bank``: prototype, centre, scale, weight. A prototype's support, its weight against the largest, gives 78 to 100 %.
    Ties take the first prototype; an empty bank, or a vector that is null or holds a null, gives null and 0. A batch of rows meets
    the bank in one matrix product; a bank of more than ``MAX_BANK`` rows or ``MAX_BANK_BYTES`` is refused.
    """
    base = rows.drop("prototype", "similarity")
    size, width = bank.agg(F.count("*"), F.max(F.size("centre"))).first()
    if size > MAX_BANK or 16 * size * (width or 0) > MAX_BANK_BYTES:
        raise ValueError(f"a bank of {size} rows of {width} values is more than {MAX_BANK} or {MAX_BANK_BYTES} bytes")
    held = bank.select("prototype", "centre", "scale", "weight").orderBy("prototype").collect()
    kind, at = bank.schema["prototype"].dataType, base.columns.index(vector)
    names = [r["prototype"] for r in held]
    shape = (size, -1) if size else (0, 0)
    centres = np.array([r["centre"] for r in held], dtype=np.float64).reshape(shape)
    sharp = 1 / np.maximum(np.array([r["scale"] for r in held], dtype=np.float64).reshape(shape) * tolerance, 1e-4) ** 2
    weights = np.array([r["weight"] for r in held], dtype=np.float64)
    support = 0.78 + 0.22 * np.sqrt(weights / max(weights.max(initial=0.0), 1e-6))
    shared = rows.sparkSession.sparkContext.broadcast((names, sharp, centres * sharp, (centres**2 * sharp).sum(axis=1), support))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, inverse, scaled, constant, own = shared.value
        for batch in batches:
            found, best = [None] * batch.num_rows, np.zeros(batch.num_rows)
            sound = np.array([v is not None and None not in v for v in batch.column(at).to_pylist()], dtype=bool)
            places = np.flatnonzero(sound) if ids else []
            for i in range(0, len(places), STEP):
                part = places[i : i + STEP]
                x = np.array(batch.column(at).take(pa.array(part)).to_pylist(), dtype=np.float64)
                distance = np.clip((x**2 @ inverse.T - 2 * x @ scaled.T + constant) / x.shape[1], 0.0, 30.0)
                alike = np.exp(-0.5 * distance) * own
                top = alike.argmax(axis=1)
                best[part] = alike[np.arange(len(part)), top]
                for j, k in zip(part.tolist(), top.tolist()):
                    found[j] = ids[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, to_arrow_type(kind)), pa.array(best)], names=[*batch.schema.names, "prototype", "similarity"])

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField("prototype", kind), StructField("similarity", DoubleType())]))


def predict_linear(rows: DataFrame, row_id: str, vector: str, model: DataFrame, mean: list[float], scale: list[float], temperature: float = 1.0, threshold: float = 0.8) -> DataFrame:
    """``row_id, predicted, confidence, entropy, abstained, reason`` of a frozen linear model.

    ``model``: class, weights, bias. Features are standardised, logits divided by the temperature. A row abstains with
    ``invalid_features`` (a value that is null or not finite, or a wrong length) or with ``confidence_below_threshold``.
    """
    row = one_row(model.select("class", "weights", "bias"), ["class"], ["weights", "bias"])
    fixed = F.array(*(F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(mean, scale)))
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size(vector) == len(mean))
    held = rows.crossJoin(row).withColumn("ok__", F.coalesce(finite, F.lit(False)))
    held = held.withColumn("z__", F.zip_with(vector, fixed, lambda v, f: (v - f["m"]) / f["s"]))
    held = held.withColumn("logits__", F.transform("bank", lambda b: (b["bias"] + F.aggregate(F.zip_with("z__", b["weights"], lambda z, w: z * w), F.lit(0.0), lambda s, v: s + v)) / temperature))
    return _decided(with_softmax(held, "logits__", "p__"), row_id, threshold)


def predict_nearest(rows: DataFrame, row_id: str, vector: str, bank: DataFrame, threshold: float) -> DataFrame:
    """As ``predict_linear``, with negative squared distances to the centres of ``bank`` (class, centre) as logits."""
    row = one_row(bank.select("class", "centre"), ["class"], ["centre"])
    held = rows.crossJoin(row).withColumn("ok__", F.col(vector).isNotNull())
    held = held.withColumn("logits__", F.transform("bank", lambda b: -squared_distance(F.col(vector), b["centre"])))
    return _decided(with_softmax(held, "logits__", "p__"), row_id, threshold)


def _decided(held: DataFrame, row_id: str, threshold: float) -> DataFrame:
    held = held.withColumn("conf__", F.array_max("p__"))
    held = held.withColumn("class__", F.element_at("bank", F.array_position("p__", F.col("conf__")).cast("int"))["class"])
    entropy = F.aggregate("p__", F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log(p)).otherwise(0.0))
    reason = F.when(~F.col("ok__"), "invalid_features").when(F.col("conf__") < threshold, "confidence_below_threshold")
    known = lambda c: F.when(F.col("ok__"), c)
    return held.withColumn("reason", reason).select(row_id, F.when(F.col("reason").isNull(), F.col("class__")).alias("predicted"), known(F.col("conf__")).alias("confidence"), known(entropy).alias("entropy"), F.col("reason").isNotNull().alias("abstained"), "reason")


def leave_one_out(bank: DataFrame, held_out: str, class_name: str = "class") -> DataFrame:
    """``prototype, held_out, distance``: the least mean squared scaled distance to prototypes of the class from elsewhere.

    ``held_out`` names a source or a capture group; prototypes without one (null) are on neither side. The bank is a model of
    bounded size, so its classes are joined with themselves. Distances are in the scales of the other prototype.
    """
    if (n := bank.count()) > MAX_BANK:
        raise ValueError(f"a bank of {n} rows is more than {MAX_BANK}")
    named = bank.where(F.col(held_out).isNotNull())
    mine = named.select(F.col(class_name).alias("c"), "prototype", held_out, "centre")
    other = named.select(F.col(class_name).alias("c"), F.col(held_out).alias("h"), F.col("centre").alias("oc"), F.col("scale").alias("os"))
    pairs = mine.join(other, "c").where(F.col("h") != F.col(held_out))
    distance = squared_distance(F.col("centre"), F.col("oc"), F.col("os")) / F.size("centre")
    return pairs.groupBy("prototype", held_out).agg(F.min(distance).alias("distance"))


def assign_nearest(rows: DataFrame, vector: str, bank: DataFrame, scale: list[float] | None = None) -> DataFrame:
    """``rows`` with ``cluster``: the nearest centre of ``bank`` (cluster, centre), the first on ties."""
    row = one_row(bank.select("cluster", "centre"), ["cluster"], ["centre"])
    fixed = None if scale is None else F.array(*(F.lit(float(s)) for s in scale))
    held = rows.crossJoin(row).withColumn("d__", F.transform("bank", lambda b: squared_distance(F.col(vector), b["centre"], fixed)))
    return held.withColumn("cluster", F.element_at("bank", F.array_position("d__", F.array_min("d__")).cast("int"))["cluster"]).drop("bank", "d__")


def median_update(assigned: DataFrame, vector: str, floor: float = 0.045) -> DataFrame:
    """``cluster, centre, scale, n``: medians by dimension (mean of middles) and 1.4826 times the median distance from them.

    Values are counted by cluster and dimension; medians come from running counts by ranges, never from one group.
    """
    work = Workspace(assigned.sparkSession, "medians")
    long = assigned.select("cluster", F.posexplode(vector).alias("at", "v"))
    counts = work.save(long.groupBy("cluster", "at", "v").agg(F.count("*").alias("n")), "counts")
    keys = ["cluster", "at"]
    centre = work.save(counted_quantiles(counts, keys, "v", {"m": (0.5, "linear")}), "centres")
    away = counts.join(centre, keys).groupBy(*keys, F.abs(F.col("v") - F.col("m")).alias("v")).agg(F.sum("n").alias("n"))
    mad = counted_quantiles(away, keys, "v", {"s": (0.5, "linear")})
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("n"))
    joined = centre.join(mad, keys).join(sizes, keys)
    listed = F.array_sort(F.collect_list(F.struct("at", "m", F.greatest(F.lit(floor), 1.4826 * F.col("s")).alias("s"))))
    found = joined.groupBy("cluster").agg(listed.alias("l"), F.max("n").alias("n"))
    return found.select("cluster", F.transform("l", lambda x: x["m"]).alias("centre"), F.transform("l", lambda x: x["s"]).alias("scale"), "n")


def farthest_first(rows: DataFrame, keys: list[str], row_id: str, vector: str, weight: str, k: int, reserved: DataFrame | None = None, root: bool = True) -> DataFrame:
    """``keys, rank, row_id``: ``k`` rows of each key, each the farthest from those before it, by squared distance and weight.

    The first is the heaviest; then the score is d * (0.25 + 0.75 * share), where the share is weight / heaviest, or its
    ``root``. Ties take the least id. ``reserved`` (``keys, row_id``) have rank 0 and count among the ``k``. Rows carry their
    least distance, so a round is one pass with a grouped maximum over all keys.
    """
    work = Workspace(rows.sparkSession, "farthest")
    most = rows.groupBy(*keys).agg(F.max(weight).alias("most__"))
    share = F.col(weight) / F.greatest(F.col("most__"), F.lit(1e-12))
    held = join_nulls(rows.select(*keys, row_id, vector, weight), most, keys).withColumn("factor__", 0.25 + 0.75 * (F.sqrt(share) if root else share))
    held = held.withColumns({"near__": F.lit(None).cast("double"), "taken__": F.lit(False), "left__": F.lit(k)})
    chosen = None
    if reserved is not None:
        chosen = work.save(rows.join(reserved.select(row_id), row_id, "left_semi").select(*keys, F.lit(0).alias("rank"), row_id, F.col(vector).alias("picked__")), "reserved")
        before = chosen.groupBy(*keys).agg(F.collect_list("picked__").alias("before__"), F.collect_list(row_id).alias("ids__"))  # at most k of a key
        held = join_nulls(held, before, keys, "left")
        held = held.withColumns({"near__": F.array_min(F.transform("before__", lambda p: squared_distance(F.col(vector), p))), "taken__": F.coalesce(F.array_contains("ids__", F.col(row_id)), F.lit(False)), "left__": F.col("left__") - F.coalesce(F.size("ids__"), F.lit(0))}).drop("before__", "ids__")
    held = work.save(held.drop("most__"), "rows-0")
    rounds = held.agg(F.max("left__")).first()[0] or 0
    for rank in range(1, rounds + 1):
        score = F.coalesce(F.col("near__") * F.col("factor__"), F.col(weight))
        best = held.where((F.col("left__") >= rank) & ~F.col("taken__")).groupBy(*keys).agg(F.min(F.struct((-score).alias("s"), F.col(row_id).alias("i"), F.col(vector).alias("v"))).alias("b"))
        picked = work.save(best.select(*keys, F.lit(rank).alias("rank"), F.col("b.i").alias(row_id), F.col("b.v").alias("picked__")), f"picked-{rank}")
        chosen = picked if chosen is None else chosen.union(picked)
        if rank < rounds:
            nearer = join_nulls(held, picked.select(*keys, F.col(row_id).alias("id__"), "picked__"), keys)
            distance = squared_distance(F.col(vector), F.col("picked__"))
            held = work.save(nearer.withColumns({"near__": F.least("near__", distance), "taken__": F.col("taken__") | (F.col("id__") == F.col(row_id))}).drop("id__", "picked__"), f"rows-{rank}")
            work.drop(f"rows-{rank - 1}")
    return chosen.select(*keys, "rank", row_id) if chosen is not None else rows.select(*keys, F.lit(0).alias("rank"), row_id).limit(0)


def bounded_selection(bank: DataFrame, keys: list[str], row_id: str, vector: str, weight: str, source: str, maximum: int) -> DataFrame:
    """``keys, row_id`` of at most ``maximum`` rows of each key: all of a key that has no more, else one of each source, then farthest first.

    The representative of a source is its heaviest row (the lower id on ties); sources in their order until there are
    ``maximum``. Distances are those of vectors standardised by median and MAD; scores take weights without a root.
    """
    work = Workspace(bank.sparkSession, "selection")
    held = work.save(join_nulls(bank.select(*keys, row_id, vector, weight, source), bank.groupBy(*keys).agg(F.count("*").alias("all__")), keys), "bank")
    whole = held.where(F.col("all__") <= maximum).select(*keys, row_id)
    large = held.where(F.col("all__") > maximum)
    centres = work.save(vector_medians(large, keys, vector, "centre__", "linear"), "centres")
    away = join_nulls(large, centres, keys).withColumn("away__", F.zip_with(vector, "centre__", lambda v, c: F.abs(v - c)))
    scales = work.save(join_nulls(centres, vector_medians(away, keys, "away__", "mad__", "linear"), keys), "scales")
    gaps = F.zip_with(vector, "centre__", lambda v, c: v - c)
    standard = F.zip_with(gaps, "mad__", lambda g, m: g / F.greatest(1.4826 * m, F.lit(1e-6)))
    standard = work.save(join_nulls(large, scales, keys).select(*keys, row_id, weight, source, standard.alias(vector)), "standardised")
    top = standard.groupBy(*keys, source).agg(F.min(F.struct((-F.col(weight)).alias("w"), F.col(row_id).alias("i"))).alias("b"))
    order = Window.partitionBy(*keys).orderBy(source)  # one row a source
    first = work.save(top.withColumn("n__", F.row_number().over(order)).where(F.col("n__") <= maximum).select(*keys, F.col("b.i").alias(row_id)), "representatives")
    return whole.union(farthest_first(standard, keys, row_id, vector, weight, maximum, first, root=False).select(*keys, row_id))


def exclude_source(bank: DataFrame, source: str, excluded: DataFrame, group: str, weight: str) -> DataFrame:
    """``bank`` without the rows of the ``excluded`` sources, its ``weight`` balanced again by source within ``group``."""
    from grainframe.operators.hierarchy import source_balanced

    kept = bank.join(excluded.select(source).distinct(), source, "left_anti")
    return source_balanced(kept, group, source, weight)


def fallback(contexts: DataFrame, components: DataFrame, path: str = "path") -> DataFrame:
    """``contexts`` with the ``component`` of the most specific prefix of their ``path`` (an array), and ``matched_path``.

    Each path meets its prefixes by an equi-join; the longest that there is counts. Without any, both are null.
    """
    keyed = contexts.withColumn("key__", F.xxhash64(path))
    prefixes = keyed.select("key__", path).distinct().select("key__", F.explode(F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(F.col(path), 1, n))).alias("prefix__"))
    found = prefixes.join(components.select(F.col(path).alias("prefix__"), "component"), "prefix__").groupBy("key__").agg(F.max(F.struct(F.size("prefix__").alias("n"), "component", "prefix__")).alias("b"))
    return keyed.join(found, "key__", "left").withColumns({"component": F.col("b.component"), "matched_path": F.col("b.prefix__")}).drop("key__", "b")


def equal_quota(rows: DataFrame, keys: list[str], item: str, order: list[Column], maximum: int) -> DataFrame:
    """``rows`` of which each ``item`` keeps at most ceil(maximum / items of its key), at even places of ``order``."""
    from grainframe.operators.ordered import join_nulls, ranked

    items = rows.groupBy(*keys).agg(F.count_distinct(item).alias("items__"))
    sizes = rows.groupBy(*keys, item).agg(F.count("*").alias("size__"))
    quotas = join_nulls(sizes, items, keys).withColumn("quota__", F.least(F.ceil(F.lit(maximum) / F.col("items__")), F.col("size__")))
    placed = join_nulls(ranked(rows, order, "place__", [*keys, item]), quotas.drop("items__"), [*keys, item])
    # place p is the i-th of q even places when bround(i * (n - 1) / (q - 1)) = p; i can only be p * (q - 1) / (n - 1) or a neighbour
    step = F.when(F.col("quota__") > 1, (F.col("size__") - 1) / (F.col("quota__") - 1)).otherwise(F.lit(0.0))
    guess = F.when(step > 0, F.floor(F.col("place__") / step)).otherwise(F.lit(0))
    hit = F.lit(False)
    for d in (-1, 0, 1):
        i = guess + d
        hit = hit | ((i >= 0) & (i < F.col("quota__")) & (F.bround(i * step).cast("long") == F.col("place__")))
    return placed.where(hit).drop("place__", "size__", "quota__")
