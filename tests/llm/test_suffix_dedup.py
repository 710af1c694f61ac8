import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grainframe.llm import suffix_dedup

from .cases import documents, frame, with_clashes


def brute(rows, length):
    """``(id, bytes, removed, spans, kept digest)`` by counting every window."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[k : k + length] for _, d in texts for k in range(len(d) - length + 1))
    out = []
    for i, d in texts:
        gone = bytearray(len(d))
        end = 0
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                start = max(k, end)
                gone[start : k + length] = b"\x01" * (k + length - start)
                end = k + length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        runs = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digests(found):
    return sorted(map(tuple, found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept_bytes")).alias("n"), F.size("removed"), F.sha2("kept_bytes", 256)).collect()), key=str)


def test_query_equals_counting_windows(spark, small_dir):
    assert sorted(map(tuple, suffix_dedup.op7(spark, small_dir).collect()), key=str) == brute(documents(spark, small_dir), 400)


def test_awkward_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in frame(spark).collect() if r["text"] is None or len(r["text"]) < 9000]
    rows += [(50, "ab" * 600), (51, "x" * 399), (52, "y" * 400), (53, "y" * 400), (54, "z" * 1200), (55, ("é" * 150 + "q" * 200) * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(suffix_dedup.suffix_dedup(with_clashes(docs, "n_bytes", "kept_bytes"))) == brute(rows, 400)
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("max_group", [2, 512])
def test_small_lengths_and_extended_groups(spark, max_group):
    rng = random.Random(5)
    common = "".join(rng.choice("abcd") for _ in range(80))
    rows = []
    for i in range(120):
        own = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
        rows.append((i, own(rng.randrange(40)) + common[rng.randrange(40) : 40 + rng.randrange(40)] + own(rng.randrange(40))))
    rows += [(500 + i, common) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.suffix_dedup(docs, length=24, anchor=8, max_group=max_group)
    assert digests(found) == brute(rows, 24)


def test_groups_beyond_a_task(spark):
    """Passages in more documents than one suffix sort takes: cut short on either side, at document ends, and in copies."""
    rng = random.Random(9)
    common = "".join(rng.choice("abcd") for _ in range(90))
    rows = []
    for i in range(3 * suffix_dedup.MAX_GROUP):
        own = lambda n: "".join(rng.choice("abc") for _ in range(n))
        lo, hi = rng.randrange(12), 90 - rng.randrange(12)
        rows.append((i, own(rng.randrange(12)) + common[lo:hi] + own(rng.randrange(12))))
    rows += [(None, common + "xyz")] * 3 + [(7, common[::-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert digests(suffix_dedup.suffix_dedup(docs, length=60, anchor=30)) == brute(rows, 60)


def test_long_texts_go_by_pieces():
    import numpy as np

    data = np.frombuffer(random.Random(3).randbytes(5000), dtype=np.uint8)
    whole = suffix_dedup.anchors(data, np.array([0]), np.array([5000]), 40, 20)
    pieces = suffix_dedup.long_anchors(data, 40, 20, 700)
    assert all((a == b).all() for a, b in zip(whole, pieces))
