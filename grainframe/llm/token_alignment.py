"""Alignment of two tokenizers over the same bytes, and how often each pair of tokens is linked in the corpus.

Tokens of A (byte-level BPE) and B (BPE pieces) both cover the bytes of a space and the text. Their ends are two ascending
lists; offsets that are in both cut the tokens into groups, and the two tokens that end there are linked.

1. One map encodes each text. By merge path, a binary search along each diagonal of the two lists of ends cuts their merge
   into pieces of ``PIECE`` tokens, however the tokens of A and B mix. A common end never falls between two pieces. A document
   of at most one piece stays where it is; the pieces of a longer one are rows that Spark spreads over the cluster. The table
   of pieces is saved.
2. Pieces are merged apart. Each gives its links, its closed groups and the tokens after its last common end. Links are
   counted within a task and then summed. Linked tokens end together, so the bytes of one end those of the other:
   the vocabularies alone bound the number of different links, ``Vocabularies.pairs`` lists them, and the counts are
   broadcast under that bound.
3. Pieces are merged again with the counts at hand, and those of a long document are stitched in their order: what a piece
   leaves open goes before what the next one closes.

Defined results: null and empty texts, and texts whose tokens of A or B don't join to a space and the text (B writes spaces as
U+2581, so a text that holds one is such), have no tokens. Special tokens inside a text are plain text. Ids play no part, so
rows without one or with a repeated one are rows like others. The text is not returned; other columns pass through, and
those made here replace others of their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainframe.llm.bpe import byte_alphabet
from grainframe.llm.common import Workspace, byte_lengths, columns_of, free_name, lean, slices, table, without

A_PATH = public_tokenizers.path("byte_bpe_50k.json")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")
#: Tokens of A and B together in one piece of a merge.
PIECE = 32_768
#: Bytes of text encoded at once, and tokens merged at once.
SLICE_BYTES = 500_000
SLICE_TOKENS = 400_000
#: White space that the regular expression of a fast encoder may be too deep for; the slower one takes such texts.
_LONG_SPACE = regex.compile(r"\s{2000}")
_MADE = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


class Vocabularies:
    """Bytes of the tokens of both files, encoders for them, and the pairs that can end together."""

    def __init__(self, a_spec: str, b_model: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        spec, letters = json.loads(a_spec), byte_alphabet()
        vocab = spec["model"]["vocab"]
        added = {t["content"] for t in spec["added_tokens"]}
        self.a_bytes: list[bytes] = [b""] * len(vocab)
        for token, i in vocab.items():
            self.a_bytes[i] = token.encode() if token in added else bytes(letters[c] for c in token)
        ranks = {self.a_bytes[i]: i for token, i in vocab.items() if token not in added}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids don't follow the order of merges")
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_str(a_spec)
        self.slow.encode_special_tokens = True
        self.slow.no_truncation()
        self.slow.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.a_length = np.array(list(map(len, self.a_bytes)), dtype=np.int64)
        self.b_length = np.array(list(map(len, self.b_bytes)), dtype=np.int64)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and B; none where their bytes aren't a space and the text."""
        if text:
            spaced = " " + text
            a = self.slow.encode(spaced, add_special_tokens=False).ids if _LONG_SPACE.search(text) else self.fast.encode_ordinary(spaced)
            b = self.b.encode(text)
            data = spaced.encode()
            if b"".join(map(self.b_bytes.__getitem__, b)) == data and b"".join(map(self.a_bytes.__getitem__, a)) == data:
                return np.array(a, dtype=np.uint16), np.array(b, dtype=np.uint16)
        return np.zeros(0, np.uint16), np.zeros(0, np.uint16)

    def pairs(self) -> np.ndarray:
        """All pairs that can be linked, as ``a * size of B + b`` in ascending order: one's bytes end the other's."""

        def by_bytes(tokens: list[bytes]) -> dict[bytes, list[int]]:
            found: dict[bytes, list[int]] = {}
            for i, t in enumerate(tokens):
                found.setdefault(t, []).append(i)
            found.pop(b"", None)
            return found

        of_a, of_b, size = by_bytes(self.a_bytes), by_bytes(self.b_bytes), len(self.b_bytes)
        keys = {a * size + b for t, own in of_a.items() for k in range(len(t)) for b in of_b.get(t[k:], ()) for a in own}
        keys |= {a * size + b for t, own in of_b.items() for k in range(1, len(t)) for a in of_a.get(t[k:], ()) for b in own}
        return np.array(sorted(keys), dtype=np.int64)


@lru_cache(maxsize=2)
def vocabularies(a_spec: str, b_model: bytes) -> Vocabularies:
    return Vocabularies(a_spec, b_model)


def diagonals(a_ends: np.ndarray, b_ends: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge path: how many ends of A and of B lie before each cut, for cuts after every ``piece`` merged ends.

    All diagonals are searched at once. Where A and B end together, A comes first; a cut between the two moves behind both.
    """
    cut = np.arange(0, len(a_ends) + len(b_ends), piece)
    low, high = np.maximum(0, cut - len(b_ends)), np.minimum(cut, len(a_ends))
    while (low < high).any():
        mid = (low + high) // 2
        a_first = a_ends[np.minimum(mid, len(a_ends) - 1)] <= b_ends[np.clip(cut - mid - 1, 0, len(b_ends) - 1)]
        going = low < high
        low, high = np.where(going & a_first, mid + 1, low), np.where(going & ~a_first, mid, high)
    of_b = cut - low
    inner = (low > 0) & (of_b < len(b_ends))
    of_b[inner] += a_ends[low[inner] - 1] == b_ends[of_b[inner]]
    return np.append(low, len(a_ends)), np.append(of_b, len(b_ends))


class Merged:
    """Merges of many pieces at once: common ends, links and groups. Pieces lie one after another on one axis of offsets."""

    def __init__(self, own: Vocabularies, a: list[bytes], b: list[bytes], lead: np.ndarray):
        """``lead``: by how many bytes the tokens of A in a piece begin after those of B."""
        n_a, n_b = (np.array([len(x) // 2 for x in side], dtype=np.int64) for side in (a, b))
        self.a, self.b = (np.frombuffer(b"".join(side), dtype=np.uint16).astype(np.int64) for side in (a, b))
        self.a_row, self.b_row = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        a_sum, b_sum = np.cumsum(own.a_length[self.a]), np.cumsum(own.b_length[self.b])
        a_before, b_before = np.concatenate([[0], a_sum])[self.a_row], np.concatenate([[0], b_sum])[self.b_row]
        a_from, b_from = np.maximum(lead, 0), np.maximum(-lead, 0)
        span = np.maximum(a_from + np.diff(a_before), b_from + np.diff(b_before)) + 1
        shift = np.concatenate([[0], np.cumsum(span)])
        a_ends = a_sum + np.repeat(shift[:-1] + a_from - a_before[:-1], n_a)
        b_ends = b_sum + np.repeat(shift[:-1] + b_from - b_before[:-1], n_b)
        at = np.searchsorted(b_ends, a_ends)
        shared = b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends if len(b_ends) else np.zeros(len(a_ends), dtype=bool)
        self.a_at, self.b_at = np.flatnonzero(shared), at[shared]
        self.row = np.searchsorted(a_ends[shared], shift)
        self.links = self.a[self.a_at] * len(own.b_bytes) + self.b[self.b_at]

    def texts(self, names: list[str]) -> tuple[list[str], list[str], list[str]]:
        """Of each piece, its closed groups and the tokens of A and of B behind them. ``names``: each number with a comma, a bar and a semicolon."""
        last = np.where(self.row[1:] > self.row[:-1], self.row[1:] - 1, -1)

        def closed(at: np.ndarray, row: np.ndarray) -> np.ndarray:
            return np.where(last >= 0, at[np.maximum(last, 0)] + 1 if len(at) else 0, row[:-1])

        a_stop, b_stop = closed(self.a_at, self.a_row), closed(self.b_at, self.b_row)

        def chosen(row: np.ndarray, stop: np.ndarray) -> np.ndarray:
            return np.repeat(row[:-1], stop - row[:-1]) + _counted(stop - row[:-1])

        a, b = chosen(self.a_row, a_stop), chosen(self.b_row, b_stop)
        a_group, b_group = np.searchsorted(self.a_at, a), np.searchsorted(self.b_at, b)
        place_a = np.arange(len(a)) + np.searchsorted(b_group, a_group, "left")
        place_b = np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        codes[place_a] = self.a[a] * 3 + _among(a, self.a_at)
        codes[place_b] = self.b[b] * 3 + 2 * _among(b, self.b_at)
        items = [names[c] for c in codes.tolist()]
        stops = np.cumsum((a_stop - self.a_row[:-1]) + (b_stop - self.b_row[:-1])).tolist()
        groups = ["".join(items[i:j]) for i, j in zip([0, *stops[:-1]], stops)]
        open_a = ["".join(names[c * 3] for c in self.a[i:j].tolist()) for i, j in zip(a_stop.tolist(), self.a_row[1:].tolist())]
        open_b = ["".join(names[c * 3] for c in self.b[i:j].tolist()) for i, j in zip(b_stop.tolist(), self.b_row[1:].tolist())]
        return groups, open_a, open_b


def _counted(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each length, one after another."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _among(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """1 where an ascending value is one of the ascending ``chosen``, else 0."""
    at = np.minimum(np.searchsorted(chosen, values), max(0, len(chosen) - 1))
    return (chosen[at] == values).astype(np.int64) if len(chosen) else np.zeros(len(values), np.int64)


def _by_tokens(a: pa.Array, b: pa.Array) -> Iterator[tuple[int, int]]:
    return slices((byte_lengths(a) + byte_lengths(b)) // 2, SLICE_TOKENS)


def align(docs: DataFrame, text: str = "text", a_path: str = A_PATH, b_path: str = B_PATH, piece: int = PIECE) -> DataFrame:
    """``docs`` without the text, with ``n_a, n_b, n_groups, n_links, n_best, count_sum`` and ``groups`` (``a1,a2|b1;a3|b2``)."""
    spark = docs.sparkSession
    with open(a_path, encoding="utf-8") as a_file, open(b_path, "rb") as b_file:
        specs = (a_file.read(), b_file.read())
    shared = spark.sparkContext.broadcast(specs)
    base = without(docs, *_MADE, text)
    names = base.columns
    own_names = [free_name(base, n) for n in ("row_key", "piece_no", "pieces", "ids_a", "ids_b", "lead")]
    kinds = ["string", "int", "int", "binary", "binary", "bigint"]
    at = len(names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabularies(*shared.value)
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start, n in slices(byte_lengths(batch.column(at)), SLICE_BYTES):
                part, rows, of = batch.slice(start, n), [], []
                for i, whole in enumerate(part.column(at).to_pylist()):
                    a, b = own.encode(whole)
                    count += 1
                    a_ends, b_ends = np.cumsum(own.a_length[a]), np.cumsum(own.b_length[b])
                    i_a, i_b = diagonals(a_ends, b_ends, piece) if len(a) + len(b) > piece else (np.array([0, len(a)]), np.array([0, len(b)]))
                    for k, (i, j, p, q) in enumerate(zip(i_a.tolist(), i_a[1:].tolist(), i_b.tolist(), i_b[1:].tolist())):
                        lead = int(a_ends[i - 1] if i else 0) - int(b_ends[p - 1] if p else 0)
                        rows.append((f"{task}:{count}", k, len(i_a) - 1, a[i:j].tobytes(), b[p:q].tobytes(), lead))
                        of.append(len(of) and of[-1] + (k == 0))
                made = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()))]
                passed = [part.column(c).take(pa.array(of)) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays([*passed, *made], names=[*names, *own_names])

    head = f"{columns_of(base)}, " if names else ""
    encoded = docs.select(*(F.col(f"`{n}`") for n in names), F.col(f"`{text}`").cast("string").alias(free_name(base, "text_given")))
    cut_up = encoded.mapInArrow(lean(cut), head + ", ".join(f"`{n}` {k}" for n, k in zip(own_names, kinds)))
    pieces = Workspace(spark, "token-alignment").save(cut_up, "pieces", compression="zstd")
    key, number, n_pieces, ids_a, ids_b, lead = own_names

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabularies(*shared.value)
        keys = possible.value
        total = np.zeros(len(keys), dtype=np.int64)
        for batch in batches:
            for start, n in _by_tokens(batch.column(0), batch.column(1)):
                a, b, leads = (c.slice(start, n) for c in batch.columns)
                links = np.searchsorted(keys, Merged(own, a.to_pylist(), b.to_pylist(), leads.to_numpy()).links)
                total += np.bincount(links, minlength=len(keys))
        linked = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[linked]), pa.array(total[linked])], names=["pair", "n"])

    own = vocabularies(*specs)
    possible = spark.sparkContext.broadcast(own.pairs())
    # at most one row for each pair of the vocabularies that can end together
    counts = pieces.select(ids_a, ids_b, lead).mapInArrow(lean(count), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    counts = counts.sort_values("pair")
    pair, times = counts["pair"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    size_b = len(own.b_bytes)
    highest = np.zeros(size_b, dtype=np.int64)
    np.maximum.at(highest, pair % size_b, times)
    known = spark.sparkContext.broadcast((pair, times, times == highest[pair % size_b]))
    tail = "n_a bigint, n_b bigint, n_groups bigint, n_best bigint, count_sum bigint, groups string"
    open_names = [free_name(base, n) for n in ("open_a", "open_b")]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (pair, times, best) = vocabularies(*shared.value), known.value
        texts = [f"{i}{end}" for i in range(max(len(own.a_bytes), len(own.b_bytes))) for end in ",|;"]
        for batch in batches:
            for start, n in _by_tokens(batch.column(at + 3), batch.column(at + 4)):
                part = batch.slice(start, n)
                found = Merged(own, part.column(at + 3).to_pylist(), part.column(at + 4).to_pylist(), part.column(at + 5).to_numpy())
                place = np.searchsorted(pair, found.links)
                sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[found.row]) for x in (best[place], times[place])]
                numbers = [np.diff(found.a_row), np.diff(found.b_row), np.diff(found.row), *sums]
                made = [*(pa.array(x.astype(np.int64)) for x in numbers), *(pa.array(x, pa.string()) for x in found.texts(texts))]
                yield pa.RecordBatch.from_arrays([*part.columns[: at + 2], *made], names=[*names, key, number, "n_a", "n_b", "n_groups", "n_best", "count_sum", "groups", *open_names])

    solved_kinds = f"{head}`{key}` string, `{number}` int, {tail}, `{open_names[0]}` string, `{open_names[1]}` string"
    last = [F.col(f"`{n}`") for n in names]

    def finished(frame: DataFrame) -> DataFrame:
        return frame.select(*last, "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", F.expr("substring(groups, 1, greatest(length(groups) - 1, 0))").alias("groups"))

    whole = pieces.where(F.col(n_pieces) == 1).mapInArrow(lean(solve), solved_kinds)
    apart = pieces.where(F.col(n_pieces) > 1).repartition(key, number).mapInArrow(lean(solve), solved_kinds)

    def stitch(rows):
        rows = rows.sort_values(number)
        open_a, open_b, groups = [], [], []
        for closed, a, b in zip(rows["groups"], rows[open_names[0]], rows[open_names[1]]):
            if closed:
                ahead, rest = closed.split("|", 1)
                groups += [*open_a, ahead, "|", *open_b, rest]
                open_a, open_b = [], []
            open_a.append(a)
            open_b.append(b)
        first = rows.head(1).copy()
        for n in ("n_a", "n_b", "n_groups", "n_best", "count_sum"):
            first[n] = rows[n].sum()
        first["groups"] = "".join(groups)
        return first[[key, "n_a", "n_b", "n_groups", "n_best", "count_sum", "groups"]]

    parts = apart.select(key, number, "n_a", "n_b", "n_groups", "n_best", "count_sum", "groups", *open_names)
    stitched = parts.groupBy(key).applyInPandas(stitch, f"`{key}` string, {tail}")
    passed = pieces.where((F.col(n_pieces) > 1) & (F.col(number) == 0)).select(*last, key)
    return finished(whole).union(finished(passed.join(stitched, key)))


def op12(spark, sf_dir: str) -> DataFrame:
    """``op12_tokenizer_alignment``: groups and links of every document, with how the corpus links their tokens."""
    found = align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_groups") == 0, F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
