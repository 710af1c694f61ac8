import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from grainframe.operators import joins, matching, ordered, statistics
from grainframe.plans import catalogue
from grainframe.sources.workspace import Workspace, clear, write_revision
from grainframe.streaming import outcomes

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small_dir}/{name}.parquet'")
    return con


def plain(v):
    return float(f"{v:.8g}") + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, small_dir, name):
    found = catalogue.queries()[name](spark, small_dir)
    cursor = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    mine = sorted(([plain(r[c]) for c in sorted(columns)] for r in found.collect()), key=str)
    theirs = sorted(([plain(r[columns.index(c)]) for c in sorted(columns)] for r in cursor.fetchall()), key=str)
    assert mine == theirs


def test_orders_by_cells(spark):
    rows = [(i % 3, float((i * 37) % 50)) for i in range(200)] + [(None, 1.0), (0, None), (1, 1e9)]
    frame = spark.createDataFrame(rows, "k int, v double")
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        for kind, sql in ((ordered.lower_quantile, "percentile_disc"), (ordered.linear_quantile, "percentile_cont")):
            expect = spark.sql(f"SELECT k, {sql}({q}) WITHIN GROUP (ORDER BY v) AS x FROM {{f}} GROUP BY k", f=frame)
            assert sorted(map(tuple, kind(frame, ["k"], "v", q, "x").collect()), key=str) == sorted(map(tuple, expect.collect()), key=str)
    assert ordered.lower_quantile(frame.limit(0), ["k"], "v", 0.5, "x").count() == 0


def test_nearest_equals_all_pairs(spark):
    left = [(i, i % 4, float((i * 53) % 997) / 7) for i in range(120)] + [(900, None, 1.0), (901, 9, 5.0)]
    right = [(i, i % 4, float((i * 31) % 991) / 7) for i in range(60)] + [(100, 0, 3.0), (99, 0, 3.0)]
    l, r = spark.createDataFrame(left, "id int, k int, x double"), spark.createDataFrame(right, "rid int, k int, x double")
    found = {t["id"]: t["near_id"] for t in joins.nearest(l, r, "k", "x", "rid").collect()}
    for i, k, x in left:
        expect = min(((abs(x - y), j) for j, m, y in right if m == k), default=(None, None))[1]
        assert found[i] == expect


def test_revisions_are_never_replaced(spark, tmp_path):
    write_revision(spark.range(3), str(tmp_path), "r1")
    with pytest.raises(Exception, match="already exists"):
        write_revision(spark.range(4), str(tmp_path), "r1")
    assert Workspace(spark, "t").save(spark.range(3), "a").count() == 3


def test_workspaces_are_freed(spark):
    import os

    work = Workspace(spark, "freed")
    work.save(spark.range(3), "a")
    work.append(spark.range(2), "b")
    work.append(spark.range(2), "b")
    assert work.read("b", "id long").count() == 4
    assert os.path.isdir(work.root.removeprefix("file://"))
    clear()
    assert not os.path.isdir(work.root.removeprefix("file://"))


def test_outcomes_stream_and_windows(spark, tmp_path):
    rows = [("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", None), ("d", None), ("d", "z")]
    found = {r[0]: (r[1], r["withheld"]) for r in outcomes.coalesce_outcomes(spark.createDataFrame(rows, "outcome_revision string, payload string")).collect()}
    assert found == {"a": ("x", False), "b": (None, True), "c": (None, False), "d": (None, True)}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = outcomes.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("counted").agg({"n": "sum"}).first()[0] == events.count()


def test_empty_curve(spark):
    none = spark.createDataFrame([], "s double, y int")
    assert tuple(statistics.roc_ap(none, "s", "y").first()) == (0, 0, None, None)


def test_assignment_equals_trying_all():
    rng = random.Random(1)

    def best(pairs, k=0, truths=frozenset(), predictions=frozenset()):
        if k == len(pairs):
            return 0, 0.0
        t, p, w = pairs[k]
        without = best(pairs, k + 1, truths, predictions)
        if t in truths or p in predictions:
            return without
        n, s = best(pairs, k + 1, truths | {t}, predictions | {p})
        return max(without, (n + 1, s + w))

    for _ in range(500):
        pairs = [(t, p, rng.choice([0.1, 0.25, 0.5, rng.random()])) for t in range(rng.randrange(1, 5)) for p in range(rng.randrange(1, 5)) if rng.random() < 0.6]
        chosen = matching.assign(pairs)
        n, s = best(pairs)
        assert len({pairs[k][0] for k in chosen}) == len({pairs[k][1] for k in chosen}) == len(chosen) == n
        assert sum(pairs[k][2] for k in chosen) == pytest.approx(s)


def test_matching_keeps_pairs_at_the_threshold(spark):
    pairs = spark.createDataFrame([("a", 1, 1, 0.75), ("a", 2, 2, 0.5), ("a", 2, 3, 0.5), ("b", 1, 1, 0.4)], "scope string, truth int, prediction int, iou double")
    assert matching.matches(pairs, ["scope"], 0.75).count() == 1
    assert sorted(r["truth"] for r in matching.matches(pairs, ["scope"], 0.5).collect()) == [1, 2]
    assert matching.matches(pairs.limit(0), ["scope"], 0.3).count() == 0


def test_ranges_split_outliers_and_single_values(spark):
    """Neither one far value nor one value of all rows makes a range that holds nearly all rows."""
    spread = spark.range(20000).selectExpr("CASE WHEN id = 7 THEN 1e15 ELSE id % 977 END AS v")
    same = spark.range(20000).selectExpr("1.0D AS v")
    for frame in (spread, same):
        sizes = [r["count"] for r in ordered.in_ranges(frame, [F.col("v")], []).groupBy("cell").count().collect()]
        assert len(sizes) == 1 or max(sizes) < 12000
    ranks = sorted(r["rank"] for r in ordered.ranked(same, [F.col("v")]).collect())
    assert ranks == list(range(20000))


@pytest.mark.parametrize("name,scans", [("ag07_robust_scale", 1), ("ag30_linear_quantile", 1), ("ag28_reliability_margin", 2), ("ag15_hierarchy_rollup", 3), ("j01_overlap_iou", 1), ("m04_overlap_metrics", 1), ("m05_split_merge", 1)])
def test_inputs_are_read_once(spark, small_dir, name, scans):
    """Scans of input tables over all plans that a query runs, its result included."""
    reads = []
    original = DataFrameWriter.parquet

    def counted(self, path, *args, **kwargs):
        reads.append(self._df._jdf.queryExecution().optimizedPlan().toString())
        return original(self, path, *args, **kwargs)

    DataFrameWriter.parquet = counted
    try:
        found = catalogue.queries()[name](spark, small_dir)
    finally:
        DataFrameWriter.parquet = original
    plans = [*reads, found._jdf.queryExecution().optimizedPlan().toString()]
    files = [found.sparkSession.read.parquet(f"{small_dir}/{t}.parquet").columns[0] for t in ("lineitem", "labels", "documents", "customer", "nation", "region")]
    n = sum(sum(1 for line in plan.splitlines() if "Relation [" in line and any(f"{c}#" in line for c in files)) for plan in plans)
    assert 1 <= n <= scans


def test_queries_without_sql_give_rows(spark, small_dir):
    """What SQL can't express is held against a plain version in the tests of its operator."""
    rest = sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()))
    assert rest == ["sh06_contour_modes"]
    assert all(catalogue.queries()[name](spark, small_dir).count() for name in rest)
