import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from grainframe.llm import common, external_shuffle, source_mixing

from .cases import frame, with_clashes


def test_shards_are_even_and_slots_gapless(spark):
    folder = "/root/testdata/sf0.01"
    rows = external_shuffle.op2(spark, folder).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    slots = {}
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(24))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(external_shuffle.op2(spark, folder).collect())]


def test_shuffle_of_many_buckets(spark):
    docs = with_clashes(frame(spark), "shard", "Slot", "bucket")
    one = external_shuffle.external_shuffle(docs, shards=3, bucket_bytes=1000).collect()
    assert len(one) == docs.count()
    for shard in range(3):
        slots = sorted(r["slot"] for r in one if r["shard"] == shard)
        assert slots == list(range(len(slots))) and 4 <= len(slots) <= 5
    other = external_shuffle.external_shuffle(docs, shards=3, bucket_bytes=1000, seed=5).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in one} != {(r["doc_id"], r["shard"], r["slot"]) for r in other}
    assert external_shuffle.external_shuffle(docs.limit(0)).count() == 0


def test_places_hang_on_the_rows_alone(spark, tmp_path):
    """The same rows from other files, partitions and orders, copies included, get the same places."""
    repeated = [(77, "the same row again and again", "en", "src_0", 28)] * 300 + [(78, None, None, None, None)] * 40
    docs = frame(spark).union(frame(spark, repeated)).union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars"))
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    docs.repartition(7).write.parquet(str(tmp_path / "other"))
    found = []
    for given in (spark.read.parquet(str(tmp_path / "one")), spark.read.parquet(str(tmp_path / "other")), docs.orderBy(F.rand(3)), docs.repartition(5, "lang")):
        out = external_shuffle.external_shuffle(given, shards=5, bucket_bytes=4000)
        found.append(sorted(map(tuple, out.select("doc_id", "text_crc32", "source", "bucket", "shard", "slot").collect()), key=str))
    assert len(found[0]) == docs.count() and len({r[3] for r in found[0]}) > 20
    assert found[0] == found[1] == found[2] == found[3]
    buckets = [r[3] for r in found[0] if r[0] == 77]
    assert max(map(buckets.count, set(buckets))) < 40


def test_written_shards_hold_all_rows(spark, tmp_path):
    found = external_shuffle.external_shuffle(frame(spark), shards=4)
    external_shuffle.write_shards(found, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").count().count() == 4


def budgets(spark, leaves, budget, epochs):
    rows = source_mixing.leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), budget, epochs).collect()
    return {(r["domain"], r["lang"], r["source"]): r["share"] for r in rows}


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = [("web", "en", "a", 10), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("books", "en", "d", 1000)]
    found = budgets(spark, leaves, 160, 1)
    assert found[("web", "en", "a")] == 10  # full; what it lacks goes to b alone
    assert found[("web", "de", "c")] == 21 and found[("books", "en", "d")] == 60
    assert found[("web", "en", "b")] == 68  # 78 of web / en, less 10
    assert budgets(spark, leaves, 10**6, 2) == {k[:3]: 2 * k[3] for k in leaves}
    assert set(budgets(spark, leaves, 0, 1).values()) == {0}


def mixed_by_sql(folder, spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
    return sorted(con.execute(source_mixing.SQL).fetchall(), key=str)


def test_awkward_rows_equal_sql(spark, tmp_path):
    docs = frame(spark)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = source_mixing.op9(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == mixed_by_sql(str(tmp_path / "documents.parquet"), spark)


def test_take_mixed_repeats_and_drops(spark, tmp_path):
    """Rows that share an id, or have none, keep decisions of their own: a leaf of 40 rows of one word is taken up to its budget."""
    rows = [(1 if i % 2 else None, "word", "en", f"src_{i % 3}", 4) for i in range(120)]
    frame(spark, rows).repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = with_clashes(spark.read.parquet(str(tmp_path / "docs")), "epochs", "epochs_taken", "mixed_key", "row_key_")
    taken = source_mixing.take_mixed(docs, 50, 1)
    assert taken.columns == docs.columns
    assert 55 <= taken.count() <= 60  # half of 120 words, shares of leaves rounded down
    assert source_mixing.take_mixed(docs, 100, 2).count() == 120
    assert source_mixing.take_mixed(docs.limit(0), 50, 1).count() == 0
    empty = source_mixing.mix_sources(docs.limit(0).select("doc_id", F.lit("web").alias("domain"), "lang", "source", F.lit(1).alias("n_tokens")))
    assert empty.count() == 0


def test_leaves_without_weight_leave_their_budget_to_others(spark):
    leaves = [("web", "en", "a", 500), ("web", "de", "b", 1000), ("books", "en", "c", 3000)]
    frame_ = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    weights = {"domain": {"web": 50, "books": 50}, "lang": {"en": 1, "de": 0}}
    found = {(r["domain"], r["lang"]): r["share"] for r in source_mixing.leaf_budgets(frame_, 2000, 1, weights).collect()}
    assert found == {("web", "en"): 500, ("books", "en"): 1500}
    with pytest.raises(ValueError, match="negative"):
        source_mixing.leaf_budgets(frame_, 2000, 1, {"domain": {"web": -1}})


def plain_shuffle(rows, shards, seed, n_buckets, bucket_of):
    """``{row: (shard, slot)}`` by plain lists: buckets one after another, each shuffled whole."""
    buckets = {}
    for row in rows:
        buckets.setdefault(bucket_of[row], []).append(row)
    order = []
    for b in sorted(buckets):
        held = sorted(buckets[b])
        order += [held[k] for k in np.random.default_rng([seed, b]).permutation(len(held))]
    n, out = len(order), {}
    for rank, row in enumerate(order):
        shard = rank * shards // n
        out[row] = (shard, rank - -(-shard * n // shards))
    return out


def test_query_equals_a_plain_shuffle(spark, small_dir):
    found = external_shuffle.external_shuffle(spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text"), bucket_bytes=20_000).collect()
    bucket_of = {(r["doc_id"], r["text_crc32"], r["size"]): r["bucket"] for r in found}
    assert len(set(bucket_of.values())) > 5
    expect = plain_shuffle(bucket_of, 24, external_shuffle.SEED, 0, bucket_of)
    assert {(r["doc_id"], r["text_crc32"], r["size"]): (r["shard"], r["slot"]) for r in found} == expect
    assert external_shuffle.op2(spark, small_dir).select("doc_id").distinct().count() == len(expect)


def test_equal_rows_are_scattered(spark):
    docs = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text in every row").alias("text"))
    sizes = [r["count"] for r in external_shuffle.external_shuffle(docs, bucket_bytes=200_000).groupBy("bucket").count().collect()]
    assert sum(sizes) == 100_000 and len(sizes) > 10 and max(sizes) < 2 * 100_000 / len(sizes)


def test_row_keys_stay_the_same_in_every_pass(spark):
    keyed = common.with_row_key(frame(spark).orderBy(F.rand()), "k")
    keys = lambda: sorted((r["k"], r["doc_id"] or -1) for r in keyed.collect())
    assert keys() == keys() and len({k for k, _ in keys()}) == frame(spark).count()
    mixed = [source_mixing.take_mixed(frame(spark).orderBy(F.rand()), 100, 1) for _ in range(2)]
    assert all(sorted(map(tuple, m.collect()), key=str) == sorted(map(tuple, m.collect()), key=str) for m in mixed)
