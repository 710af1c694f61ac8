import hashlib
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainframe.operators import audits
from grainframe.sources import labels, library, manifests
from grainframe.streaming import outcomes


def archive(raster):
    out = io.BytesIO()
    np.savez(out, labels=raster)
    return out.getvalue()


@pytest.fixture
def masks(tmp_path):
    rasters = {}
    for method in ("one", "two"):
        for i in range(2):
            raster = np.zeros((70, 90), np.uint16)
            raster[2 + i : 9, 3:12], raster[60:66, 70 : 80 + i] = 1, 7
            (tmp_path / method).mkdir(exist_ok=True)
            (tmp_path / method / f"m{i}.npz").write_bytes(archive(raster))
            rasters[f"{method}/m{i}.npz"] = raster
    return tmp_path, rasters


def test_label_rasters_as_cells(spark, masks):
    folder, rasters = masks
    cells = labels.label_cells(labels.files(spark, str(folder), "*.npz"), (70, 90)).withColumn("method", labels.method_of())
    found = {}
    for r in cells.collect():
        found.setdefault("/".join(r["image"].split("/")[-2:]), []).append((r["y"], r["x"], r["label"]))
        assert r["method"] == r["image"].split("/")[-2]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted((int(y), int(x), int(a[y, x])) for y, x in zip(*np.nonzero(a))) for k, a in rasters.items()}
    with pytest.raises(Exception, match="no label raster"):
        labels.label_cells(labels.files(spark, str(folder), "*.npz"), (70, 91)).count()


def test_files_by_digest_and_budget(spark, masks):
    folder, _ = masks
    held = labels.files(spark, str(folder), "*.npz")
    listed = held.collect()
    rows = [(r["path"], hashlib.sha256(r["content"]).hexdigest()) for r in listed[:2]] + [(listed[2]["path"], "0" * 64), ("nowhere", "0" * 64)]
    status = {r["path"]: r["status"] for r in labels.verified(spark.createDataFrame(rows, "path string, sha256 string"), held).collect()}
    assert [status[p] for p, _ in rows] == ["present", "present", "changed", "missing"]
    kept = [r["kept"] for r in labels.within_budget(held, 3, 10**9).collect()]
    assert sorted(kept) == [False, True, True, True]
    assert not any(r["kept"] for r in labels.within_budget(held, 3, 10).collect())


def test_tiles_and_crops(spark, masks):
    folder, rasters = masks
    cells = labels.label_cells(labels.files(spark, str(folder / "one"), "*.npz"))
    images = cells.select("image").distinct().withColumns({"height": F.lit(70), "width": F.lit(90)})
    tiles = labels.tiles_of(images, 32, 5, 1, 0)
    assert tiles.collect() == labels.tiles_of(images, 32, 5, 1, 0).collect() and tiles.collect() != labels.tiles_of(images, 32, 5, 1, 1).collect()
    assert tiles.where("y0 < 0 OR y0 > 38 OR x0 < 0 OR x0 > 58").count() == 0
    found = labels.tile_cells(cells, tiles, 32).groupBy("image", "tile").count().collect()
    at = {(r["image"], r["tile"]): (r["y0"], r["x0"]) for r in tiles.collect()}
    for r in found:
        y, x = at[(r["image"], r["tile"])]
        assert r["count"] == np.count_nonzero(rasters["/".join(r["image"].split("/")[-2:])][y : y + 32, x : x + 32])
    grid = images.select("image").crossJoin(spark.range(70 * 90)).select("image", F.floor(F.col("id") / 90).cast("int").alias("y"), (F.col("id") % 90).cast("int").alias("x"), F.col("id").cast("double").alias("value"))
    cut = {(r["image"].split("/")[-1], r["label"]): (r["n"], r["inside"]) for r in labels.crops(cells, grid, ["image", "label"], 2).groupBy("image", "label").agg(F.count("*").alias("n"), F.count_if("inside").alias("inside")).collect()}
    assert cut[("m0.npz", 1)] == (11 * 13, 7 * 9) and cut[("m0.npz", 7)] == (10 * 14, 6 * 10)


def test_manifests(spark, tmp_path):
    good = {"image_path": "a.png", "image_sha256": "a" * 64, "mask_path": "m.npz", "mask_sha256": "b" * 64, "width": 4, "height": 3, "instance_count": 2, "dish_instance_count": 1, "reviewed": True}
    (tmp_path / "masks.json").write_text(json.dumps([good, good | {"mask_sha256": "x"}, good | {"width": 0}, good | {"reviewed": False}]))
    assert [(r["problem"], r["is_truth"]) for r in manifests.mask_manifest(spark, str(tmp_path / "masks.json")).collect()] == [(None, True), ("no digest", False), ("no frame", False), (None, False)]
    sample = {"identifier": "s1", "group": "g", "split": "train", "species": "x", "reviewed": True, "annotation_author": "a", "provenance": {"source_sha256": "q"}, "component_sha256": {"features": "f"}}
    (tmp_path / "learning.json").write_text(json.dumps({"dataset_id": "d", "version": 1, "samples": [sample, sample | {"split": "test"}]}))
    samples = manifests.learning_samples(spark, str(tmp_path / "learning.json"))
    assert samples.count() == 2
    found = {(r["code"], r["key"]) for r in audits.dataset_audit(samples).collect()}
    assert found == {("duplicate_identifier", "s1"), ("group_crosses_splits", "g"), ("source_crosses_splits", "q"), ("features_cross_splits", "f")}
    (tmp_path / "traits.json").write_text(json.dumps({"version": 2, "traits": [{"identifier": "seed_coat"}, {"identifier": "Bad!"}, {"identifier": "twice", "title": "T"}, {"identifier": "twice"}]}))
    assert [(r["title"], r["usable"]) for r in manifests.trait_vocabulary(spark, str(tmp_path / "traits.json")).orderBy("place").collect()] == [("Seed Coat", True), ("Bad!", False), ("T", False), ("Twice", False)]
    bundle = spark.createDataFrame([("h1", 1), ("h2", 2), ("h9", 3)], "image_sha256 string, seed int")
    images = spark.createDataFrame([("b", "h1"), ("a", "h1"), ("c", "h2")], "image string, image_sha256 string")
    assert {r["seed"]: r["image"] for r in manifests.match_annotations(bundle, images).collect()} == {1: "a", 2: "c", 3: None}


def test_outcome_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps({"outcome_revision": r, "state": "done", "payload": p}) for r, p in (("x", "1"), ("x", "1"), ("y", "2"))))
    assert manifests.outcomes(spark, str(folder)).count() == 3
    stream = manifests.outcomes(spark, str(folder), stream=True).withColumn("ts", F.current_timestamp())
    query = outcomes.first_outcomes(stream).writeStream.outputMode("append").format("memory").queryName("first_seen").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["outcome_revision"] for r in spark.table("first_seen").collect()) == ["x", "y"]


def test_library_versions(spark, tmp_path):
    root = str(tmp_path / "lib")
    bank = spark.createDataFrame([("c", 1, 2.0), ("c", 2, 6.0)], "class string, source int, weight double")
    library.publish(bank, root, "oat", "main", 1)
    library.publish(bank.limit(1), root, "oat", "main", 2)
    with pytest.raises(Exception, match="already exists"):
        library.publish(bank, root, "oat", "main", 1)
    assert library.load(spark, root, "oat", "main", 1).count() == 2
    assert library.listed(spark, root).where("retired").count() == 0
    library.retire(spark, root, "oat", "main", 1)
    assert sorted((r["version"], r["retired"]) for r in library.listed(spark, root).collect()) == [(1, True), (2, False)]
    pins = spark.createDataFrame([("p1", "oat", "main", 2, "d2", "oat", "v"), ("p2", "oat", "main", 1, "d1", "oat", "v"), ("p3", "oat", "main", 2, "zz", "oat", "v"), ("p4", "oat", "main", 9, "d", "oat", "v"), ("p5", "oat", "main", 2, "d2", "rye", "v"), ("p6", "oat", "main", 2, "d2", "oat", "w")], "project string, species string, library string, version int, digest string, context_species string, vocabulary string")
    versions = spark.createDataFrame([("oat", "main", 1, "d1", "v", True), ("oat", "main", 2, "d2", "v", False)], "species string, library string, version int, digest string, vocabulary string, retired boolean")
    assert {r["project"]: r["status"] for r in library.resolve(pins, versions).collect()} == {"p1": "compatible", "p2": "retired", "p3": "changed", "p4": "missing", "p5": "other species", "p6": "incompatible_trait_vocabulary"}
    more = spark.createDataFrame([("c", 3, 1.0)], "class string, source int, weight double")
    assert sorted(round(r["balanced"], 6) for r in library.merged([bank, more], "class", "source", "weight").collect()) == [0.333333] * 3
    with pytest.raises(ValueError, match="several banks"):
        library.merged([bank, bank], "class", "source", "weight")
    with pytest.raises(ValueError, match="schemas"):
        library.merged([bank, more.drop("weight")], "class", "source", "weight")
    path = library.export_bundle(bank, str(tmp_path / "out"), "r1")
    assert spark.read.option("header", "true").csv(f"{path}/csv").count() == spark.read.json(f"{path}/json").count() == 2
