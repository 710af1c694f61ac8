from collections import Counter
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from grainframe.llm import near_dedup
from grainframe.operators.components import connected_components
from grainframe.llm.common import Workspace

from .cases import documents, frame, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, size):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is None or j is None or not x or not y:
                continue
            if 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return sorted(((i, len(s), root(i) if i is not None else None, i is None or root(i) == i) for i, s in sets), key=str)


@pytest.mark.parametrize("size", [4, 5])
def test_equals_all_pairs(spark, small_dir, size):
    found = near_dedup.near_duplicates(spark.read.parquet(f"{small_dir}/documents.parquet"), shingle=size)
    assert sorted(map(tuple, found.collect()), key=str) == brute(documents(spark, small_dir), size, 80)


def test_awkward_rows(spark):
    docs = frame(spark)
    found = near_dedup.near_duplicates(with_clashes(docs, "component_id", "kept", "digest"))
    assert sorted(map(tuple, found.collect()), key=str) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_large_groups_and_chains(spark):
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):  # one group of near copies, each with its own last word
        rows.append((i, " ".join([*base[:-1], f"own{i}"])))
    for i in range(40):  # a chain: neighbours alike, ends not
        rows.append((1000 + i, " ".join(f"c{j}" for j in range(i * 4, i * 4 + 60))))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, 4, 80)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test"))
    expect = {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)}
    assert {r["node"]: r["component"] for r in found.collect()} == expect
    assert connected_components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "test")).count() == 0


def test_blocks_find_what_pivots_cannot(spark, monkeypatch):
    """Many documents alike to the last few words under the limit: no pair of most of them is linked, some pairs are."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.choice(60, 2, replace=False):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 8000)
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, 4, 80)


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, copies without an id and near copies go; rows of one id with other texts, and texts without words, don't."""
    base = " ".join(f"w{i}" for i in range(60))
    near_copy = base + " end"
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(1, base), (1, base), (None, base), (2, near_copy), (None, near_copy), (3, other), (3, base + " x " + other), (None, other), (None, "alone in the world with nobody near it"), (4, ""), (5, None), (6, " "), (7, ""), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_key", F.lit("theirs"))
    found = sorted(((r["doc_id"], r["text"]) for r in near_dedup.without_near_duplicates(docs).collect()), key=str)
    expect = [(2, near_copy), (3, other), (3, base + " x " + other), (4, ""), (5, None), (6, " "), (7, "")]
    assert sorted(((i, t) for i, t in found if i is not None), key=str) == sorted(expect, key=str)
    assert sum(i is None for i, _ in found) == 2  # the text of its own, and one row of no id and no words
    assert near_dedup.without_near_duplicates(docs.limit(0)).count() == 0


def test_query_equals_exact_links_at_sf001(spark):
    """All links of a thousand documents by an inverted index of their full sets."""
    folder = "/root/testdata/sf0.01"
    docs = [(i, near_dedup.shingles((t or "").encode(), 4)) for i, t in documents(spark, folder)]
    index, common = {}, Counter()
    for i, found in docs:
        for s in found:
            index.setdefault(s, []).append(i)
    for ids in index.values():
        common.update((a, b) for a in ids for b in ids if a < b)
    size, parent = {i: len(s) for i, s in docs}, {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 80 * (size[a] + size[b] - n)]
    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert len(links) > 50
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.op3(spark, folder).collect()}
    assert found == {i: (size[i], root(i)) for i, _ in docs}
