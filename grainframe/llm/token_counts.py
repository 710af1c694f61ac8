"""Token counts of whole texts, huge ones by overlapping pieces that are encoded apart and spliced.

A text of at most ``PIECE`` characters is encoded in its task. No token, special token or normalisation spans a space, so the
parts between spaces are encoded by themselves, and up to ``CACHE`` of them are remembered. A longer text is cut into overlapping pieces, each a row of its
own, so that one huge document is spread over the cluster. Both neighbours of an overlap encode it, with offsets; they are
spliced behind a token that both have: the same id at the same characters. A document in which some overlap has no such
token is cut again, with pieces and overlaps ``WIDEN`` times as wide, until all of its overlaps agree or it is one piece.

Why a splice is exact. A sequence of tokens is what byte-pair encoding gives for their joined symbols if each two
neighbours encode to themselves (given merges whose parts are made by earlier merges, which ``Counter`` checks). Behind a
shared token each neighbouring pair comes from one of the two pieces, so all pairs do. Words are cut by character classes from left to right:
a shared token that ends a word ends it in both pieces; one inside a word lies in a run of one class, whose end is the
same in both. Inside a word, tokens near an apostrophe aren't trusted (contractions are words of their own), nor are those
near the end of the left piece, where a word or a special token may be cut. Pieces begin before a
character that no normalisation joins to the one before, and tokens that share a character don't count.

Defined results: a null or empty text has no bytes and no tokens. Special tokens inside a text count as the library does
by default: as one token. Ids play no part, so rows without one or with a repeated one are rows like others. Extra columns
pass through; ``n_bytes`` and ``n_tokens`` replace others of their names.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainframe.llm.common import Workspace, byte_lengths, columns_of, free_name, lean, slices, table, with_row_key, without

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Characters of a piece, and of the stretch that two neighbours share.
PIECE = 60_000
OVERLAP = 2_000
WIDEN = 4
#: Tokens so near the right end of a piece may hang on what is cut off: longer than any special token or contraction.
GUARD = 40
TOKEN_LIMIT = 2048
#: Bytes of text encoded at once.
SLICE_BYTES = 400_000
#: Words whose counts a worker remembers, and the length of those it does.
CACHE, CACHED_LENGTH = 600_000, 48
_TOKENS = "array<struct<start:bigint,stop:bigint,id:int,place:bigint>>"


class Counter:
    """Tokens of texts by the tokenizers library."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.known: dict[str, int] = {}
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        parsed = json.loads(spec)
        model = parsed["model"]
        suffix = model["end_of_word_suffix"]
        self.ends_word = np.zeros(1 + max([*model["vocab"].values(), *(t["id"] for t in parsed["added_tokens"])]), dtype=bool)
        self.ends_word[[i for token, i in model["vocab"].items() if suffix and token.endswith(suffix)] + [t["id"] for t in parsed["added_tokens"]]] = True
        made = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made.setdefault(left + right, rank)
            if max(made.get(left, -1), made.get(right, -1)) >= rank:
                raise ValueError("a merge comes before those that make its parts")

    def counts(self, texts: list[str | None]) -> list[int]:
        parts = [t.split(" ") if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        new = list({w for words in parts for w in words if w not in self.known})
        found = dict(zip(new, map(len, self.library.encode_batch_fast(new, add_special_tokens=False))))
        self.known.update(found)
        counts = [sum(map(self.known.__getitem__, words)) for words in parts]
        for w in [w for w in new if len(w) > CACHED_LENGTH]:
            del self.known[w]
        return counts

    def shared(self, text: str, at: int, overlap: int, last: bool) -> tuple[int, list, list]:
        """Tokens of a piece that starts at ``at``: their number, and those at either end that a neighbour may share."""
        found = self.library.encode(text, add_special_tokens=False)
        n = len(found.ids)
        if not n:
            return 0, [], []
        ids, spans = np.array(found.ids), np.array(found.offsets)
        start, stop = spans[:, 0], spans[:, 1]
        clear = np.ones(n, dtype=bool)
        clear[1:] &= start[1:] >= stop[:-1]
        clear[:-1] &= stop[:-1] <= start[1:]

        def listed(chosen: np.ndarray) -> list[tuple[int, int, int, int]]:
            return [(at + s, at + e, int(ids[i]), i) for i in np.flatnonzero(chosen & clear).tolist() if (s := int(start[i])) < (e := int(stop[i])) and (self.ends_word[ids[i]] or "'" not in text[max(0, s - 3) : e + 3])]

        head = listed(stop <= overlap) if at else []
        tail = [] if last else listed((start >= len(text) - overlap) & (stop <= len(text) - GUARD))
        return n, head, tail


@lru_cache(maxsize=2)
def counter(spec: str) -> Counter:
    return Counter(spec)


def _joins(letter: str) -> bool:
    """Whether normalisation may join a character to the one before it: marks, and vowels and finals of Hangul."""
    return unicodedata.category(letter)[0] == "M" or "ᅠ" <= letter <= "ᇿ" or "\U00016d63" <= letter <= "\U00016d6a"


def cuts(text: str, piece: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Starts and stops of the pieces of a text; each shares at least ``overlap`` characters with the next."""
    start = 0
    while start + piece < len(text):
        following = start + piece - overlap
        while following > start and _joins(text[following]):
            following -= 1
        if following <= start:  # nothing but marks: the piece goes on to where one can begin
            following = start + piece - overlap
            while following < len(text) and _joins(text[following]):
                following += 1
        if following >= len(text):
            break
        yield start, min(len(text), max(start + piece, following + overlap))
        start = following
    yield start, len(text)


def _spliced(held: DataFrame, key: str, text: str, spec, piece: int, overlap: int) -> DataFrame:
    """``key, n_tokens`` of long texts; no number where two neighbours share no token."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, whole in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = whole.as_py()
                for i, (a, b) in enumerate(cuts(whole, piece, overlap)):
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([i]), pa.array([a]), pa.array([b == len(whole)]), pa.array([whole[a:b]])], names=["key", "piece", "at", "last", "part"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(spec.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("id", pa.int32()), ("place", pa.int64())]))
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                at, last, part = (row.column(c)[0].as_py() for c in (2, 3, 4))
                n, head, tail = own.shared(part, at, overlap, last)
                names = ["start", "stop", "id", "place"]
                shared = [pa.array([[dict(zip(names, t)) for t in side]], kind) for side in (head, tail)]
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), pa.array([n]), *shared], names=["key", "piece", "n", "head", "tail"])

    pieces = held.select(F.col(key).alias("key"), F.col(f"`{text}`")).mapInArrow(lean(cut), "key string, piece bigint, at bigint, last boolean, part string")
    encoded = pieces.repartition("key", "piece").mapInArrow(lean(encode), f"key string, piece bigint, n bigint, head {_TOKENS}, tail {_TOKENS}")
    encoded = Workspace(held.sparkSession, "token-pieces").save(encoded, "encoded")
    left = encoded.select("key", F.col("piece"), F.col("n"), F.explode("tail").alias("t")).select("key", "piece", "n", "t.start", "t.stop", "t.id", F.col("t.place").alias("left"))
    right = encoded.select("key", (F.col("piece") - 1).alias("piece"), F.explode("head").alias("t")).select("key", "piece", "t.start", "t.stop", "t.id", F.col("t.place").alias("right"))
    common = left.join(right, ["key", "piece", "start", "stop", "id"])
    # tokens behind the splice in the left piece, and up to it in the right one, are given up
    splices = common.groupBy("key", "piece").agg(F.max_by(F.col("n") - F.col("left") + F.col("right"), F.col("stop")).alias("twice"))
    given_up = splices.groupBy("key").agg(F.sum("twice").alias("twice"), F.count("*").alias("splices"))
    totals = encoded.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("pieces")).join(given_up, "key", "left")
    whole = F.coalesce("splices", F.lit(0)) == F.col("pieces") - 1
    return totals.select(F.col("key").alias(key), F.when(whole, F.col("n") - F.coalesce("twice", F.lit(0))).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str = VOCABULARY, text: str = "text", piece: int = PIECE, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with ``n_bytes`` and ``n_tokens`` of each whole text."""
    if piece < 4 * overlap or overlap <= GUARD:
        raise ValueError("a piece holds four overlaps at least, and an overlap more than its guard")
    with open(path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    base = without(docs, "n_bytes", "n_tokens").withColumn("n_bytes", F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)).cast("long"))
    names = base.columns
    at = [n.lower() for n in names].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(spec.value)
        for batch in batches:
            for start, n in slices(byte_lengths(batch.column(at)), SLICE_BYTES):
                part = batch.slice(start, n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.counts(part.column(at).to_pylist()), pa.int64())], names=[*names, "n_tokens"])

    is_long = F.coalesce(F.char_length(f"`{text}`") > piece, F.lit(False))
    short = base.where(~is_long).mapInArrow(lean(run), f"{columns_of(base)}, n_tokens bigint")

    work = Workspace(docs.sparkSession, "token-counts")
    key = free_name(base, "row_key")
    held = work.save(with_row_key(base, key).where(is_long), "long")
    open_docs, found = held, []
    while not open_docs.isEmpty():
        totals = work.save(_spliced(open_docs, key, text, spec, piece, overlap), f"totals-{len(found)}")
        found.append(totals.where("n_tokens IS NOT NULL"))
        open_docs = open_docs.join(totals.where("n_tokens IS NULL"), key, "left_semi")
        piece, overlap = piece * WIDEN, overlap * WIDEN
    if not found:
        return short
    totals = found[0]
    for more in found[1:]:
        totals = totals.union(more)
    return short.union(held.join(totals, key).select(*(F.col(f"`{n}`") for n in names), "n_tokens"))


def op13(spark, sf_dir: str) -> DataFrame:
    """``op13_token_counts``: bytes and tokens of every document, and whether it is over the limit."""
    found = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))
