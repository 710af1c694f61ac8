"""Suffix-array dedup of long byte strings: every byte covered by a ``LENGTH``-byte string that also starts elsewhere goes.

Strings never span documents. The work is split so that each repeated string is whole in one group of bounded size:

1. One map picks anchors by winnowing: in each window of ``LENGTH`` bytes the least of its ``ANCHOR``-byte hashes. Equal
   windows have the same anchor at the same place, so a repeated window has an anchor that two occurrences share, and lies
   in the context of both: the ``SLACK`` bytes on either side.
2. Anchors found once are dropped by a grouped count. Occurrences whose whole contexts are equal settle each other; one of
   them stays as partner of the others.
3. The distinct contexts of an anchor form a group; the anchor, which all share, counts as one symbol. A task sorts the
   suffixes of many groups together, takes their Burrows-Wheeler transform and derives longest common prefixes by increasing
   value: intervals of equal prefixes are extended backwards by one symbol, breadth first, and an interval is followed only
   if it sets a new boundary. At ``SLACK`` + 1 symbols, which are ``LENGTH`` bytes, the expansion stops; boundaries not set
   by then lie between suffixes that share ``LENGTH`` bytes or more.
4. An interval of more than ``MAX_GROUP`` contexts is extended by Spark until it fits a task. A string of a context is known
   by the number of bytes it has before the anchor, 0 to ``SLACK``. What a whole interval shares, by the least and the
   greatest of its contexts, settles some of these numbers; the rest is halved, and each half is extended by the bytes that
   all its strings have. So each number is open in one interval at a time, and after log2(``SLACK``) + 1 rounds none is. Rounds and
   plans don't grow with the data, and no group is capped.
5. One map applies each document's spans to its bytes.

Equality: an anchor stands for its bytes by two 64-bit hashes of different kinds, a whole context by one of these and a
third; bytes around an anchor are compared themselves. A text is known by its MD5.

Defined results: a null or empty text has no bytes and no spans. Texts shorter than ``LENGTH`` lose nothing. Rows of equal
text, whatever their ids, are other occurrences of each other. Ids play no part, so rows without one or with a repeated one
are rows like others. Extra columns pass through; the columns made here replace others of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainframe.llm.common import Workspace, columns_of, free_name, table, without
from grainframe.llm.runs import sorted_runs

LENGTH = 400
ANCHOR = 300
#: Contexts of a group, and symbols of a chunk, that one suffix sort takes.
MAX_GROUP = 2500
CHUNK_SYMBOLS = 1_000_000
#: Bytes of text that one pass of anchors takes; a longer text is taken in overlapping pieces.
PASS_BYTES = 2_000_000
MAX_BROADCAST_IDS = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: The code of an anchor, after those of the 256 bytes (1 to 256); 0 ends a context.
_ANCHOR_CODE = 257


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """Minimum or maximum of each ``width`` neighbouring values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = least(values[:-span], values[span:])
        span *= 2
    return least(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of documents that lie one after another in ``data``."""
    n, width = len(data), length - anchor + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
    hashes = (sums[anchor:] - sums[:-anchor]) * _powers(_INVERSE, n - anchor + 1)
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(29)
    least = _sliding(hashes, width, np.minimum)
    inside = np.zeros(n + 1, dtype=np.int32)
    long = ends - starts >= length
    inside[starts[long]] += 1
    inside[ends[long] - length + 1] -= 1
    least[np.cumsum(inside)[: len(least)] <= 0] = 0  # a window over an end of a document chooses nothing
    pad = np.zeros(width - 1, dtype=np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == hashes)
    return chosen, hashes[chosen]


def long_anchors(data: np.ndarray, length: int, anchor: int, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """``anchors`` of one long document, from pieces that overlap so that each window is whole in one of them."""
    places, hashes = [], []
    for start in range(0, len(data) - length + 1, piece):
        part = data[start : start + piece + length - 1]
        at, keys = anchors(part, np.array([0]), np.array([len(part)]), length, anchor)
        places.append(at + start)
        hashes.append(keys)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def _anchored(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """``key`` (hash of the anchor), ``ctx`` (hash of its context), ``doc`` and ``pos`` of each anchor."""
    slack = length - anchor

    def of_pass(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        blob = b"".join(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        starts = np.concatenate([[0], ends[:-1]])
        data = np.frombuffer(blob, dtype=np.uint8)
        at, keys = anchors(data, starts, ends, length, anchor) if len(texts) > 1 or len(blob) <= PASS_BYTES else long_anchors(data, length, anchor, PASS_BYTES)
        of = np.searchsorted(ends, at, side="right")
        lo, hi = np.maximum(starts[of], at - slack), np.minimum(ends[of], at + length)
        digest = xxhash.xxh3_64_intdigest
        ctx = np.fromiter((digest(blob[i:j], left) for i, j, left in zip(lo.tolist(), hi.tolist(), (at - lo).tolist())), np.uint64, len(at))
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ctx.view(np.int64)), ids.take(pa.array(of)), pa.array((at - starts[of]).astype(np.int32))], names=["key", "ctx", "doc", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            start = 0
            while start < batch.num_rows:
                stop, total = start + 1, lengths[start]
                while stop < batch.num_rows and total + lengths[stop] <= PASS_BYTES:
                    total += lengths[stop]
                    stop += 1
                yield of_pass(batch.column(0)[start:stop], batch.column(1)[start:stop].to_pylist())
                start = stop

    long_enough = docs.where(F.octet_length("text") >= length)
    return long_enough.select("doc", "text").mapInArrow(run, "key bigint, ctx bigint, doc binary, pos int")


def suffix_order(codes: np.ndarray, group: np.ndarray, last: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of group, then of their first ``depth`` codes (at least). ``last`` is the place of each one's terminator.

    Codes are packed into one key as far as 62 bits go; ranks are doubled from there.
    """
    n = len(codes)
    bits, group_bits = max(1, int(codes.max()).bit_length()), max(1, int(group.max()).bit_length())
    packed = (62 - group_bits) // bits
    key = group.astype(np.int64)
    padded = np.concatenate([codes, np.zeros(packed, dtype=codes.dtype)])
    place = np.arange(n)
    for i in range(packed):
        key = (key << bits) | np.where(place + i <= last, padded[i : i + n], 0)
    reach = packed
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        ranks = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if reach >= depth or ranks[-1] == n - 1:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = ranks
        ahead = np.minimum(place + reach, n - 1)
        key = rank * (n + 1) + np.where(place + reach <= last, rank[ahead] + 1, 0)
        reach *= 2


def shared_starts(lefts: list[bytes], rights: list[bytes], groups: np.ndarray, depth: int) -> list[tuple[int, int] | None]:
    """Least and most bytes before the anchor of the strings of ``depth`` symbols that a context shares with its group.

    A context is the bytes before an anchor, nearest first, the anchor (one symbol) and the bytes after it, ``depth`` - 1 at
    most on each side: each string of ``depth`` symbols holds the anchor. ``groups`` numbers the group of each context, from
    0 without gaps.
    """
    before_n = np.fromiter(map(len, lefts), np.int64, len(lefts))
    lengths = before_n + np.fromiter(map(len, rights), np.int64, len(rights)) + 1
    blob = b"".join(part for left, right in zip(lefts, rights) for part in (left[::-1], b"\x00", right, b"\x00"))
    data = np.frombuffer(blob, dtype=np.uint8).astype(np.int64) + 1
    n = len(data)
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    data[starts + before_n] = _ANCHOR_CODE
    owner = np.repeat(np.arange(len(lefts)), lengths + 1)
    present = np.bincount(data, minlength=_ANCHOR_CODE + 1) > 0
    codes = np.cumsum(present)[data]
    codes[stops] = 0
    group, last = groups[owner], stops[owner]
    order = suffix_order(codes, group, last, depth)

    # the transform: the code before each suffix, 0 at the start of a context; and its map to the next longer suffixes
    before = np.where(order == starts[owner[order]], 0, codes[order - 1])
    group_at = group[order]
    by_code = np.argsort(group_at * 512 + before, kind="stable")
    longer = np.empty(n, dtype=np.int64)
    longer[by_code] = np.arange(n)
    same = (group_at[by_code][1:] == group_at[by_code][:-1]) & (before[by_code][1:] == before[by_code][:-1])
    next_same = np.full(n, n, dtype=np.int64)
    next_same[by_code[:-1][same]] = by_code[1:][same]
    previous_same = np.full(n, -1, dtype=np.int64)
    previous_same[by_code[1:][same]] = by_code[:-1][same]

    # boundaries by increasing common prefix: True once the prefix is known to be below ``depth``
    known = np.zeros(n + 1, dtype=bool)
    left = np.concatenate([[0], np.flatnonzero(group_at[1:] != group_at[:-1]) + 1])
    right = np.concatenate([left[1:], [n]]) - 1
    known[left] = known[n] = True
    for step in range(depth):
        sizes = right - left + 1
        shift = np.cumsum(sizes) - sizes
        inside = np.arange(int(sizes.sum())) + np.repeat(left - shift, sizes)
        real = (before[inside] != 0) | (step == 0)  # starts of contexts lead to the terminators, and no further
        first = inside[real & (previous_same[inside] < np.repeat(left, sizes))]
        final = inside[real & (next_same[inside] > np.repeat(right, sizes))]
        left, right = np.sort(longer[first]), np.sort(longer[final])
        fresh = ~known[right + 1]
        left, right = left[fresh], right[fresh]
        if not len(left):
            break
        known[right + 1] = True

    # blocks of suffixes that share ``depth`` symbols; the anchor is once in a context, so suffixes of a block are of several
    sizes = np.diff(np.concatenate([np.flatnonzero(known[:-1]), [n]]))
    at = order[np.repeat(sizes > 1, sizes)]
    at = at[last[at] - at >= depth]
    of = owner[at]
    bytes_before = starts[of] + before_n[of] - at
    low, high = np.full(len(lefts), n), np.full(len(lefts), -1)
    np.minimum.at(low, of, bytes_before)
    np.maximum.at(high, of, bytes_before)
    return [(int(i), int(j)) if j >= 0 else None for i, j in zip(low, high)]


_SPAN = "doc binary, lo int, hi int"
#: A context in an interval. ``low`` to ``high``: bytes before the anchor of the strings that are open; ``left`` is reversed.
_CONTEXT = "grp bigint, anchor bigint, doc binary, pos int, single boolean, low int, high int, left binary, right binary"
_GROUP = ["grp", "anchor"]


def _by_transform(contexts: DataFrame, length: int, anchor: int) -> DataFrame:
    """Spans of the contexts that are alone, from groups that each fit one chunk."""
    slack = length - anchor

    def settle(held: list[pa.Table]) -> pa.RecordBatch | None:
        groups = np.repeat(np.arange(len(held)), [t.num_rows for t in held])
        rows = pa.concat_tables(held)
        found = shared_starts(rows["left"].to_pylist(), rows["right"].to_pylist(), groups, slack + 1)
        spans = [(d, p - f[1], p - f[0] + length) for d, p, s, f in zip(*(rows[c].to_pylist() for c in ("doc", "pos", "single")), found) if s and f]
        if not spans:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*spans), (pa.binary(), pa.int32(), pa.int32()))], names=["doc", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, symbols = [], 0
        for group in sorted_runs(batches, _GROUP):
            if group.num_rows < 2 or not pc.any(group["single"]).as_py():
                continue
            size = pc.sum(pc.binary_length(group["left"])).as_py() + pc.sum(pc.binary_length(group["right"])).as_py() + 2 * group.num_rows
            if held and symbols + size > CHUNK_SYMBOLS:
                if (out := settle(held)) is not None:
                    yield out
                held, symbols = [], 0
            held.append(group)
            symbols += size
        if held and (out := settle(held)) is not None:
            yield out

    return contexts.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(run, _SPAN)


def _agreement(a: Column, b: Column, most: int) -> Column:
    """Length of the common prefix of two byte strings of ``most`` bytes or less."""
    same = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.least(F.size(same), F.octet_length(a), F.octet_length(b))


def _extend(held: DataFrame, shared: DataFrame, length: int, anchor: int, step: int) -> tuple[DataFrame, DataFrame]:
    """Spans that whole intervals share, and the intervals that stay open, each of half the range or less.

    ``shared`` gives ``l`` and ``r``: the bytes before and after the anchor that all contexts of an interval have in common.
    Strings with slack - r to l bytes before the anchor are common to all. Each other open number is in one half, and a half
    is extended by the bytes that all of its strings have: ``low`` before the anchor, slack - ``high`` after it.
    """
    slack = length - anchor
    joined = held.join(shared, _GROUP)
    first, last = F.greatest("low", slack - F.col("r")), F.least("high", "l")
    settled = joined.where((first <= last) & F.col("single")).select("doc", (F.col("pos") - last).alias("lo"), (F.col("pos") - first + length).alias("hi"))
    # with nothing settled the whole range stays open: its lower part is all of it, its upper part empty
    none = first > last
    ranges = [(F.col("low"), F.when(none, F.col("high")).otherwise(first - 1)), (F.when(none, F.col("high")).otherwise(last) + 1, F.col("high"))]
    halves = []
    for lo, hi in ranges:
        middle = F.floor((lo + hi) / 2).cast("int")
        halves += [F.struct(lo.alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), hi.alias("high"))]
    opened = joined.withColumn("open", F.explode(F.filter(F.array(*halves), lambda h: h["low"] <= h["high"])))
    x, y = F.col("open.low"), F.col("open.high")
    opened = opened.where((F.octet_length("left") >= x) & (F.octet_length("right") >= slack - y))
    grp = F.xxhash64(F.lit(step), "grp", x, y, F.substring("left", F.lit(1), x), F.substring("right", F.lit(1), slack - y))
    return settled, opened.select(grp.alias("grp"), "anchor", "doc", "pos", "single", x.alias("low"), y.alias("high"), "left", "right")


def repeated_spans(docs: DataFrame, work: Workspace, length: int = LENGTH, anchor: int = ANCHOR, max_group: int = MAX_GROUP) -> DataFrame:
    """``doc, spans`` (an array of ``lo, hi``) of the bytes to remove, from ``doc`` (a digest of the text) and ``text`` (binary).

    Spans overlap and may pass a text's end.
    """
    slack = length - anchor
    found = work.save(_anchored(docs, length, anchor), "anchors")
    shared = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    suspects = work.save(found.join(shared, "key", "left_semi"), "suspects")
    work.drop("anchors")
    classes = work.save(suspects.groupBy("key", "ctx").agg(F.count("*").alias("c"), F.min(F.struct("doc", "pos")).alias("first")), "classes")
    copied = suspects.join(classes.where("c > 1").select("key", "ctx"), ["key", "ctx"], "left_semi")
    work.append(copied.select("doc", F.greatest(F.lit(0), F.col("pos") - slack).alias("lo"), (F.col("pos") + length).alias("hi")).distinct(), "spans")
    work.drop("suspects")

    groups = classes.groupBy("key").agg(F.count("*").alias("m"), F.count_if(F.col("c") == 1).alias("alone")).where("m > 1 AND alone > 0").select("key")
    asked = classes.join(groups, "key", "left_semi").select(F.col("first.doc").alias("doc"), F.struct("key", F.col("first.pos").alias("pos"), (F.col("c") == 1).alias("single")).alias("a"))
    asked = work.save(asked.groupBy("doc").agg(F.collect_list("a").alias("asked")), "asked")  # one text's own anchors
    work.drop("classes")
    ids = asked.select("doc")
    texts = docs.select("doc", "text").join(F.broadcast(ids) if asked.count() <= MAX_BROADCAST_IDS else ids, "doc", "left_semi").dropDuplicates(["doc"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _CONTEXT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        for batch in batches:
            for doc, value, asked_here in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = value.as_py()
                rows = []
                for a in asked_here.as_py():
                    p, end = a["pos"], a["pos"] + anchor
                    check = signed(xxhash.xxh3_64_intdigest(data[p:end]))
                    rows.append((a["key"], check, doc, p, a["single"], 0, slack, data[max(0, p - slack) : p][::-1], data[end : end + slack]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    open_ = work.save(texts.join(asked, "doc").select("doc", "text", "asked").mapInArrow(cut, _CONTEXT), "open-0")
    work.drop("asked")
    step = 0
    while True:
        large = open_.groupBy(*_GROUP).agg(F.count("*").alias("m"), F.max("single").alias("alone")).where(F.col("m") > max_group)
        large = work.save(large, f"large-{step}")
        n_large = large.count()
        held_by = lambda frame: F.broadcast(frame) if n_large <= MAX_BROADCAST_IDS else frame
        fit = open_.join(held_by(large.select(*_GROUP)), _GROUP, "left_anti") if n_large else open_
        work.append(_by_transform(fit, length, anchor), "spans")
        if not n_large:
            break
        held = open_.join(held_by(large.where("alone").select(*_GROUP)), _GROUP, "left_semi")
        ends = held.groupBy(*_GROUP).agg(*(f(c).alias(f"{c}_{k}") for c in ("left", "right") for k, f in (("least", F.min), ("most", F.max))))
        shared = work.save(ends.select(*_GROUP, _agreement(F.col("left_least"), F.col("left_most"), slack).alias("l"), _agreement(F.col("right_least"), F.col("right_most"), slack).alias("r")), f"shared-{step}")
        settled, opened = _extend(held, held_by(shared), length, anchor, step)
        work.append(settled, "spans")
        opened = work.save(opened, f"open-{step + 1}")
        work.drop(f"open-{step}", f"large-{step}", f"shared-{step}")
        open_, step = opened, step + 1
    work.drop(f"open-{step}", f"large-{step}")
    spans = work.read("spans", _SPAN)
    return work.save(spans.distinct().groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "merged")


def suffix_dedup(docs: DataFrame, text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, max_group: int = MAX_GROUP) -> DataFrame:
    """``docs`` without ``text``, with ``n_bytes``, ``removed`` (maximal spans of bytes) and ``kept_bytes`` (binary)."""
    made = ["n_bytes", "removed", "kept_bytes"]
    base = without(docs, *made, text)
    names = base.columns
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    work = Workspace(docs.sparkSession, "suffix-dedup")
    doc = F.unhex(F.md5(data))
    spans = repeated_spans(docs.select(doc.alias("doc"), data.alias("text")), work, length, anchor, max_group)
    work.drop("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for batch in batches:
            sizes, removed, kept = [], [], []
            for value, found in zip(batch.column(len(names)), batch.column(len(names) + 1)):
                bytes_ = value.as_py()
                sizes.append(len(bytes_))
                if not found.is_valid:
                    removed.append([])
                    kept.append(bytes_)
                    continue
                lo, hi = (found.values.field(i).to_numpy() for i in (0, 1))
                edges = np.zeros(len(bytes_) + 1, dtype=np.int32)
                np.add.at(edges, lo, 1)
                np.add.at(edges, np.minimum(hi, len(bytes_)), -1)
                gone = np.cumsum(edges[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                removed.append([{"lo": i, "hi": j} for i, j in zip(turns[::2].tolist(), turns[1::2].tolist())])
                kept.append(np.frombuffer(bytes_, dtype=np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())], names=[*names, *made])

    at, bytes_name, spans_name = (free_name(base, n) for n in ("span_key", "text_bytes", "span_list"))
    source = docs.select(*[F.col(f"`{n}`") for n in names], doc.alias(at), data.alias(bytes_name))
    joined = source.join(spans.select(F.col("doc").alias(at), F.col("spans").alias(spans_name)), at, "left").select(*[F.col(f"`{n}`") for n in names], bytes_name, spans_name)
    types = "`n_bytes` bigint, `removed` array<struct<lo:int,hi:int>>, `kept_bytes` binary"
    return joined.mapInArrow(run, f"{columns_of(base) + ', ' if names else ''}{types}")


def op7(spark, sf_dir: str) -> DataFrame:
    """``op7_suffix_array_dedup``: counts and a digest of what stays of every document."""
    found = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_kept = F.octet_length("kept_bytes").cast("long")
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - n_kept).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))
