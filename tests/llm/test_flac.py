import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainframe.llm import flac

from .cases import documents, frame, with_clashes


def payload(text):
    data = (text or "").encode()
    return data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))


def test_query_reads_back_what_it_stored(spark, small_dir):
    texts = dict(documents(spark, small_dir))
    for r in flac.op5(spark, small_dir).collect():
        p = payload(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len((texts[r["doc_id"]] or "").encode()), len(p))
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        stream = flac.encode([p])[0]
        assert (r["media_bytes"], r["media_sha256"]) == (len(stream), hashlib.sha256(stream).hexdigest())


@pytest.mark.parametrize("data", [b"", b"\0" * 192, bytes(range(192)), b"\x80\x7f" * 96, b"a" * 1920, np.random.default_rng(1).integers(0, 256, 19200, dtype=np.uint8).tobytes()])
def test_round_trip(data):
    stream = flac.encode([data])[0]
    assert stream[:4] == b"fLaC"
    assert flac.decode([stream])[0] == [data]


def test_seek_reads_any_range():
    data = np.random.default_rng(2).integers(30, 120, 192 * 300, dtype=np.uint8).tobytes()
    stream = flac.encode([data])[0]
    for start, count in ((0, 10), (191, 3), (192 * 200 + 5, 1000), (len(data) - 7, 7)):
        assert flac.read_samples(stream, start, count) == data[start : start + count]


def test_damage_is_found():
    data = bytes(range(192)) * 20
    stream = bytearray(flac.encode([data])[0])
    stream[-40] ^= 1
    with pytest.raises(ValueError):
        flac.decode([bytes(stream)])


def test_awkward_rows_and_blocks(spark):
    docs = with_clashes(frame(spark), "media", "block")
    stored = flac.flac_store(docs.withColumn("payload", F.when(F.col("text").isNotNull(), F.rpad("lang", 192, "."))), back="back")
    assert stored.where("payload IS NOT NULL AND payload <> CAST(back AS STRING)").count() == 0
    blocks = flac.flac_blocks(stored).select("sample_offset", F.octet_length("pcm").alias("n")).distinct().collect()
    assert [tuple(b) for b in blocks] == [(0, 192)]
    assert flac.flac_blocks(flac.flac_store(docs.limit(0).withColumn("payload", F.lit(b"")))).count() == 0
