import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from grainframe.llm import token_alignment as ta

from .cases import documents, frame, with_clashes


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(ta.A_PATH)
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    return a, sentencepiece.SentencePieceProcessor(model_file=ta.B_PATH)


def brute(rows, libraries):
    """Each row's numbers and groups, by walking over both lists of tokens."""
    a_lib, b_lib = libraries
    letters = ta.byte_alphabet()
    linked, found = Counter(), []
    for i, text in rows:
        a = b = []
        if text:
            data = (" " + text).encode()
            a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
            a_bytes = [bytes(letters[c] for c in a_lib.id_to_token(x)) for x in a]
            b_bytes = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [b_lib.id_to_piece(x)]]
            if b"".join(a_bytes) != data or b"".join(b_bytes) != data:
                a = b = []
        groups, links, k, end_b = [], [], 0, 0
        end_a, group_a, group_b = 0, [], []
        for x, own in zip(a, a_bytes if a else ()):
            end_a += len(own)
            group_a.append(x)
            while end_b < end_a:
                end_b += len(b_bytes[k])
                group_b.append(b[k])
                k += 1
            if end_a == end_b:
                groups.append((group_a, group_b))
                links.append((group_a[-1], group_b[-1]))
                group_a, group_b = [], []
        linked.update(links)
        found.append((i, len(a), len(b), groups, links))
    best = {}
    for (_, y), n in linked.items():
        best[y] = max(best.get(y, 0), n)
    named = lambda groups: ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
    return [(i, n_a, n_b, len(g), len(ls), sum(linked[x] == best[x[1]] for x in ls), sum(linked[x] for x in ls), named(g)) for i, n_a, n_b, g, ls in found]


def hard_texts(seed, n):
    rng = random.Random(seed)
    parts = ["<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "don't ", "  ", "   ", "\n\n", "\t", "é", "中文字", "😀👍🏽", "한국", "1234567", "...", "==", "the ", " of", "ﬁ", " ", "　", "\x00", "x"]
    parts += ["".join(rng.choice("abcdehilnorst") for _ in range(rng.randrange(1, 14))) + " " for _ in range(25)]
    return ["".join(rng.choice(parts) * rng.choice([1, 1, 1, 3]) for _ in range(rng.randrange(1, 120))) for _ in range(n)]


def test_query_equals_the_libraries(spark, small_dir, libraries):
    expect = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(documents(spark, small_dir), libraries)]
    assert sorted(map(tuple, ta.op12(spark, small_dir).collect())) == sorted(expect)


@pytest.mark.parametrize("piece", [2, 7, 64, 32_768])
def test_pieces_are_stitched(spark, piece, libraries):
    texts = [None, "", " ", "▁", "a▁b", "\n", *hard_texts(piece, 60), "a" * 700, " " * 2500 + "x", "é" * 300, "\n" * 400]
    rows = list(enumerate(texts))
    found = ta.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), piece=piece)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(brute(rows, libraries))


def test_awkward_rows(spark, libraries):
    docs = frame(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = ta.align(with_clashes(docs, "n_links", "Groups", "row_key", "pieces", "pair"), piece=5000)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted(map(tuple, found.select(*names).collect()), key=str) == sorted(brute(rows, libraries), key=str)
    assert "text" not in found.columns and {r["row_key"] for r in found.collect()} == {"theirs"}
    assert ta.align(docs.limit(0)).count() == 0


def test_diagonals_cut_equal_pieces():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 90, rng.integers(1, 60))) for _ in range(2))
        for piece in (2, 3, 10):
            i, j = ta.diagonals(a, b, piece)
            for k in range(len(i) - 1):
                before, after = np.concatenate([a[: i[k]], b[: j[k]]]), np.concatenate([a[i[k] :], b[j[k] :]])
                assert not len(before) or not len(after) or before.max() < after.min()
                assert abs(int(i[k + 1] - i[k] + j[k + 1] - j[k]) - piece) <= 1 or k == len(i) - 2


def test_linked_tokens_are_known_pairs():
    with open(ta.A_PATH, encoding="utf-8") as a, open(ta.B_PATH, "rb") as b:
        own = ta.vocabularies(a.read(), b.read())
    pairs = own.pairs()
    assert len(pairs) < 1_000_000
    for key in pairs[:: len(pairs) // 2000].tolist():
        x, y = own.a_bytes[key // len(own.b_bytes)], own.b_bytes[key % len(own.b_bytes)]
        assert x.endswith(y) or y.endswith(x)
