import hashlib
import random
import zlib

import numpy as np
import pytest

from grainframe.llm import periodic_runs as pr

from .cases import documents, frame, with_clashes


def brute_runs(words):
    """All runs by comparing every word with the one a period later, for every period."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(all(words[k] == words[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return b" ".join(w for k, w in enumerate(words) if k not in gone)


def planted(i, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(i).encode()), len(words)
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words[a:] = [words[a + (k - a) % p] for k in range(a, n)]
    return words


def test_query_equals_comparing_all_words(spark, small_dir):
    expect = []
    for i, text in documents(spark, small_dir):
        words = planted(i, text)
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        expect.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines.encode()), sha(collapsed(words, runs))))
    assert sorted(map(tuple, pr.op11(spark, small_dir).collect())) == sorted(expect)
    assert sum(e[1] > 0 for e in expect) > 5


def repetitive(rng):
    """Blocks repeated as a whole and in part, blocks of blocks, and single words between."""
    words = []
    for _ in range(rng.randrange(1, 6)):
        block = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 8, 17, 40]))]
        if rng.random() < 0.3:
            block = block * 5 + [rng.choice("abc")]
        words += block * rng.randrange(1, 9) + block[: rng.randrange(len(block) + 1)]
        words += [rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 30]))]
    return words


def texts_of(seed, n):
    rng = random.Random(seed)
    return [" ".join(repetitive(rng)) for _ in range(n)]


def check(spark, docs, rows):
    found = sorted(((r["doc_id"], r["n_words"], [(x["start"], x["length"], x["period"]) for x in r["runs"]], r["collapsed"].encode()) for r in docs.collect()), key=str)
    expect = []
    for i, text in rows:
        words = (text or "").encode().split()
        runs = brute_runs(words)
        expect.append((i, len(words), runs, collapsed(words, runs)))
    for a, b in zip(found, sorted(expect, key=str), strict=True):
        assert a == b


def test_repetitive_texts(spark):
    texts = texts_of(1, 300) + ["a " * 700, "a b " * 400, "\n".join(["x y z"] * 300), " ".join(f"w{i}" for i in range(900)), " ".join(f"w{i % 150}" for i in range(1300)), "a a a b b b c c c " * 40]
    rows = list(enumerate(texts))
    check(spark, pr.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)), rows)


def test_awkward_rows(spark):
    docs = frame(spark, [(i, t if t is None or len(t) < 5000 else t[:5000], *rest) for i, t, *rest in map(tuple, frame(spark).collect())])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(spark, pr.periodic_runs(with_clashes(docs, "runs", "Collapsed", "row_key", "width", "key", "start")), rows)
    assert pr.periodic_runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("least_tile", [1, 64])
def test_tiles_by_themselves(least_tile, monkeypatch):
    """Fragments of a tile are what comparing words within the tile gives."""
    monkeypatch.setattr(pr, "LEAST_TILE", least_tile)
    rng = random.Random(5)
    for _ in range(150):
        words = repetitive(rng)
        ids, bounds = pr.numbered([" ".join(words).encode()])
        assert [words[i] for i in ids] == words
        stretches = {}
        for _, width, at, own, places, first, last in pr.tiles(ids, bounds):
            for q, start, stop in pr.fragments(own, places.tolist(), width, first, last):
                assert (own[start : stop - q] == own[start + q : stop]).all()
                assert start == 0 or own[start - 1] != own[start - 1 + q]
                assert stop == len(own) or own[stop] != own[stop - q]
                stretches.setdefault(q, np.zeros(len(words), dtype=bool))[at + start : at + stop] = True
        for s, n, q in brute_runs(words):
            assert stretches[q][s : s + n].all()
