"""Byte-level BPE by a pair occurrence index.

The distinct pre-tokens of a batch lie in one array of symbols with links to their neighbours. An index maps each active
merge rank to all positions of its pair. Ranks are applied in ascending order: all positions of a rank merge at once,
and the pairs that a merge forms enter the lists of their own ranks. Merging whole lists gives the ids of the greedy
encoder, because a pair that holds a merge's product always has a higher rank than that merge.

The vocabulary (fixed size) is read where the driver runs and broadcast; documents are never shuffled. The memory of a
task is bounded by a batch of rows, its slices of ``SLICE_BYTES`` and ``CACHE`` remembered words.

Defined results: a null or empty text has no ids and decodes to an empty text. The strings of special tokens inside a
text become those tokens. Ids without an entry, or null ids in a list, raise ``ValueError``. Bytes that are no UTF-8
decode to U+FFFD. Columns named like a result are replaced; all others pass through, whatever their names.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from grainframe.llm.common import columns_of, free_name, lean, table, without

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The pre-tokenizer's pattern, published with the byte-level vocabularies.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: A space where cutting at spaces could cut a run of white space.
_RUN = regex.compile(r" (?:\s|\Z)")
#: Words remembered between slices of a batch, and bytes of text in a slice: together they bound a task's memory.
CACHE = 60_000
SLICE_BYTES = 2_500_000


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens: list[bytes | None] = [None] * self.size
        for token, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.byte_ids = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], dtype=np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = self.left * self.size + self.right
        self._order = np.argsort(keys)
        self._keys = keys[self._order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where the pair doesn't merge."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._order[at], -1)


def _first_of_overlaps(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Positions to merge, left to right, where a pair of two equal symbols can overlap itself."""
    taken, used = [], set()
    for p, q in zip(at.tolist(), following.tolist()):
        if p not in used:
            taken.append(p)
            used.add(q)
    return np.array(taken, dtype=np.int64)


def merge_all(words: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """The ids of each pre-token as little-endian int32 bytes, by the pair occurrence index over all of them."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    n = len(data)
    if not n:
        return [b""] * len(words)
    ends = np.cumsum(lengths)
    symbol = vocabulary.byte_ids[data]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends[lengths > 0] - 1] = -1
    before[(ends - lengths)[lengths > 0]] = -1

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(at: np.ndarray) -> None:
        """Put pairs that begin at these positions into the lists of their ranks."""
        rank = vocabulary.ranks(symbol[at], symbol[after[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for r, i, j in zip(rank[starts].tolist(), starts, [*starts[1:], len(at)]):
            if r in index:
                index[r].append(at[i:j])
            else:
                index[r] = [at[i:j]]
                heapq.heappush(active, r)

    enter(np.flatnonzero(after >= 0))
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        left, right = vocabulary.left[rank], vocabulary.right[rank]
        at = at[(symbol[at] == left) & (after[at] >= 0)]
        at = at[symbol[after[at]] == right]
        if not len(at):
            continue
        if left == right:
            at = _first_of_overlaps(np.sort(at), after[np.sort(at)])
        gone = after[at]
        symbol[at] = vocabulary.made[rank]
        symbol[gone] = -1
        beyond = after[gone]
        after[at] = beyond
        linked = beyond >= 0
        before[beyond[linked]] = at[linked]
        earlier = before[at]
        enter(np.unique(np.concatenate([earlier[earlier >= 0], at[linked]])))

    alive = symbol >= 0
    ids = symbol[alive].astype("<i4").tobytes()
    stops = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])] * 4
    return [ids[i:j] for i, j in zip(stops[:-1].tolist(), stops[1:].tolist())]


class Encoder:
    """Ids of texts, with a bounded memory of words seen before."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.tokens: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        special = sorted(vocabulary.special, key=len, reverse=True)
        self._special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self._names = special

    def _plain(self, text: str) -> list[str]:
        """Parts between special tokens, at even places."""
        if any(name in text for name in self._names):
            return self._special.split(text)
        return [text]

    def _learn(self, parts: Iterable[str]) -> None:
        words: set[str] = set()
        odd: set[str] = set()
        for part in parts:
            if _RUN.search(part):
                odd.update(PATTERN.findall(part))
            else:
                first, *rest = part.split(" ")
                odd.update(PATTERN.findall(first))
                words.update(rest)
        if len(self.spaced) > CACHE or len(self.tokens) > CACHE:
            self.spaced.clear()
            self.tokens.clear()
        words -= self.spaced.keys()
        cut = {w: PATTERN.findall(" " + w) for w in words}
        new = list(odd.union(*cut.values()) - self.tokens.keys())
        self.tokens.update(zip(new, merge_all([t.encode() for t in new], self.vocabulary)))
        get = self.tokens.__getitem__
        self.spaced.update((w, b"".join(map(get, t))) for w, t in cut.items())

    def _ids(self, part: str) -> bytes:
        if _RUN.search(part):
            return b"".join(map(self.tokens.__getitem__, PATTERN.findall(part)))
        first, *rest = part.split(" ")
        return b"".join(map(self.tokens.__getitem__, PATTERN.findall(first))) + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """int32 ids of each text."""
        self._learn(p for t in texts if t for p in self._plain(t)[::2])
        for text in texts:
            parts = self._plain(text or "")
            parts[::2] = map(self._ids, parts[::2])
            parts[1::2] = (np.int32(self.vocabulary.special[p]).tobytes() for p in parts[1::2])
            yield b"".join(parts)


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Places and numbers of rows of consecutive slices of about ``SLICE_BYTES``; a longer text is a slice by itself."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > SLICE_BYTES:
            yield start, i - start
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield start, len(lengths) - start


def _decoded(ids: np.ndarray, tokens: list[bytes | None]) -> str:
    if len(ids) and not 0 <= ids.min() <= ids.max() < len(tokens):
        raise ValueError("an id has no entry in the vocabulary")
    parts = [tokens[i] for i in ids.tolist()]
    if None in parts:
        raise ValueError("an id has no entry in the vocabulary")
    return b"".join(parts).decode("utf-8", "replace")


def bpe_encode(docs: DataFrame, vocabulary: Vocabulary | None = None, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with ``ids``: an int array with the BPE ids of each whole text.

    With a name for ``decoded``, the ids are decoded again in the same pass, as ``bpe_decode`` does.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary())
    made = [ids] if decoded is None else [ids, decoded]
    base = without(docs, *made)
    names = base.columns

    # a text that passes through anyway is sent to the workers once
    passed = [i for i, f in enumerate(base.schema.fields) if f.name.lower() == text.lower() and f.dataType == StringType()]
    at = passed[0] if passed else len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        tokens = shared.value.tokens
        for batch in batches:
            for start, n in _slices(batch.column(at)):
                part = batch.slice(start, n)
                rows = list(encoder.encode(part.column(at).to_pylist()))
                offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
                flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(rows))])
                found = [pa.ListArray.from_arrays(pa.array(offsets), flat)]
                if decoded is not None:
                    found.append(pa.array([_decoded(np.frombuffer(r, dtype="<i4"), tokens) for r in rows], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *found], names=[*names, *made])

    source = base if passed else docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text}`").cast("string").alias(free_name(base, "text_given")))
    types = f"`{ids}` array<int>" + ("" if decoded is None else f", `{decoded}` string")
    return source.mapInArrow(lean(run), f"{columns_of(base) + ', ' if names else ''}{types}")


def bpe_decode(frame: DataFrame, vocabulary: Vocabulary | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``frame`` with ``decoded``: the text of each list of ids, special tokens included."""
    shared = frame.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary())
    base = without(frame, decoded)
    names = base.columns
    at = [n.lower() for n in names].index(ids.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value.tokens
        for batch in batches:
            texts = []
            for row in batch.column(at):
                found = row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.zeros(0, np.int32)
                if found.dtype.kind != "i":
                    raise ValueError("a list of ids holds a null")
                texts.append(_decoded(found, tokens))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, decoded])

    return base.mapInArrow(lean(run), f"{columns_of(base)}, `{decoded}` string")


def op10(spark, sf_dir: str) -> DataFrame:
    """``op10_byte_pair_encoding``: digests of the ids of every document, and of the text they decode to."""
    encoded = bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
