import hashlib

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grainframe.llm import bpe

from .cases import documents, frame, with_clashes


def library():
    found = Tokenizer.from_file(bpe.VOCABULARY)
    found.no_truncation()
    found.no_padding()
    return found


def test_query_equals_the_library(spark, small_dir):
    own = library()
    expect = []
    for i, text in documents(spark, small_dir):
        ids = own.encode(text or "", add_special_tokens=False).ids
        back = own.decode(ids, skip_special_tokens=False)
        expect.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.op10(spark, small_dir).collect())) == sorted(expect)


def test_awkward_rows_and_round_trip(spark):
    own = library()
    extra = [(90, "don't  stop\n\n\tnow 123 it's  ", None, None, None), (91, "<|endoftext|><|endoftext|> a<|endoftext|>", None, None, None), (92, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, None, None, None), (93, "​  　x  y\r\n", None, None, None)]
    docs = frame(spark).union(frame(spark, extra))
    found = bpe.bpe_encode(with_clashes(docs, "ids", "decoded"), decoded="decoded").collect()
    assert len(found) == docs.count()
    for row in found:
        assert row["ids"] == own.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["decoded"] == (row["text"] or "")
    again = bpe.bpe_decode(bpe.bpe_encode(docs))
    assert again.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0
    assert bpe.bpe_encode(docs.limit(0)).count() == 0
