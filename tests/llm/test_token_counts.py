import random

import pytest
from tokenizers import Tokenizer

from grainframe.llm import token_counts

from .cases import documents, frame, with_clashes


def library():
    found = Tokenizer.from_file(token_counts.VOCABULARY)
    found.no_truncation()
    found.no_padding()
    return found


def brute(own, text):
    return len((text or "").encode()), len(own.encode(text or "", add_special_tokens=False).ids)


def hard_texts(seed, n):
    """Texts whose pieces begin inside words, marks, contractions, special tokens and long runs."""
    rng = random.Random(seed)
    parts = ["don't ", "we'll've", "'s", "'", "!!!'re", "<|endoftext|>", "<|startoftext|>x", "é", "́̂", "한국어", "한", "İstanbul", "ΣΑΣ ", "½⅓12345", "😀👍🏽", "中文字", "  \n\t ", "ABCdefGHI", "...---...", "naïve", "  ", "\U0001f7ff", "्क", "\u0000"]
    parts += ["".join(rng.choice("abcdehilnorst") for _ in range(rng.randrange(1, 30))) for _ in range(20)]
    return ["".join(rng.choice(parts) * rng.choice([1, 1, 1, 2, 9]) for _ in range(rng.randrange(1, 90))) for _ in range(n)]


def test_query_equals_the_library(spark, small_dir):
    own = library()
    expect = [(i, *brute(own, t), brute(own, t)[1] > 2048) for i, t in documents(spark, small_dir)]
    assert sorted(map(tuple, token_counts.op13(spark, small_dir).collect())) == sorted(expect)


@pytest.mark.parametrize("piece,overlap", [(200, 50), (420, 100)])
def test_spliced_pieces_equal_whole_texts(spark, piece, overlap):
    own = library()
    texts = hard_texts(piece, 150)
    texts += ["a" * 3001, "ab" * 1700, "́" * 900, "x" + "́" * 900 + "y z" * 300, "!" * 2500, "'" * 1000, "1" * 1000, " " * 1500, "<|endoftext|>" * 120, "'s" * 700, "é" * 1500, "中" * 1500, "the valley " * 300, "lo" * 300 + " " + "ha" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = token_counts.count_tokens(docs, piece=piece, overlap=overlap).collect()
    assert len(found) == len(texts)
    for row in found:
        assert (row["n_bytes"], row["n_tokens"]) == brute(own, texts[row["doc_id"]]), texts[row["doc_id"]][:80]


def test_awkward_rows(spark):
    own = library()
    for piece, overlap in ((60_000, 2000), (1000, 100)):
        found = token_counts.count_tokens(with_clashes(frame(spark), "n_tokens", "N_BYTES", "row_key", "key"), piece=piece, overlap=overlap).collect()
        assert len(found) == frame(spark).count()
        for row in found:
            assert (row["n_bytes"], row["n_tokens"]) == brute(own, row["text"])
            assert row["row_key"] == row["key"] == "theirs"
    assert token_counts.count_tokens(frame(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(frame(spark), piece=300, overlap=100)


def test_cuts_cover_the_text_and_overlap():
    for text in [*hard_texts(3, 60), "́" * 500, "a" * 500]:
        found = list(token_counts.cuts(text, 200, 45))
        assert found[0][0] == 0 and found[-1][1] == len(text)
        for (a, b), (c, d) in zip(found, found[1:]):
            assert a < c <= b - 45 and b <= d
