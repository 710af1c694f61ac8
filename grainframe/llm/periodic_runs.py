"""Runs of repeated words: maximal stretches with a smallest period and at least four of it, found in tiles by octave of period.

1. A map numbers the words of each text and looks at one octave of periods after another, ``S`` to ``2 S - 1``. A run with such a
   period is so long that for some multiple ``c`` of ``S`` the ``2 S`` words from ``c`` on come again a period later, inside the
   run. Rolling hashes of ``2 S`` words find these anchors; hashes only choose where to look. A document is exploded into
   tiles of ``TILE`` times ``S`` words, each with ``MARGIN`` times ``S`` words more on either side; tiles without an anchor are
   left out, as no run needs them. Documents without any tile are done here.
2. Each tile is a row and is solved by itself. At an anchor, the Z-function of the words from the anchor on and that of the
   words before it, backwards, give for all periods of the octave how far the words stay periodic. That is a fragment of a
   run. Fragments whose period isn't the smallest are dropped, for their words are a power of a shorter block.
3. Fragments are shuffled by document and period. Those that overlap by a period or more belong to one run, as tiles
   overlap by four times ``S`` and more; stitched, they are whole runs.
4. Documents with tiles get their runs and lose the words behind the first period of each.

A huge document is read by one task, which only hashes it; its tiles are spread over the cluster.

Defined results: null and empty texts, and those without words, have no words and no runs, and collapse to an empty text. Words
are runs without ASCII white space. Ids play no part, so rows without one or with a repeated one are rows like others. Extra
columns pass through; ``n_words``, ``runs`` and ``collapsed`` replace others of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainframe.llm.common import Workspace, byte_lengths, columns_of, crc32_of, free_name, lean, slices, table, without, words_of

REPEATS = 4
LEAST_WORDS = 6
#: A tile holds anchors of so many octave widths, of so many words at least, and a margin of so many widths on either side.
TILE = 8
LEAST_TILE = 64
MARGIN = 4
#: Bytes of text looked at together.
SLICE_BYTES = 2_000_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_MADE = ("n_words", "runs", "collapsed")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def numbered(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of documents one after another, each as the place in its document where it is first, and where documents begin and end."""
    rows = []
    for text in texts:
        words = words_of(text)
        rows.append(np.fromiter(map({}.setdefault, words, range(len(words))), np.int64, len(words)))
    return np.concatenate([*rows, np.zeros(0, np.int64)]), np.cumsum([0, *map(len, rows)])


def anchors(ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each octave width, the anchors: places at multiples of it whose words come again a period later.

    What is found in a document hangs on that document alone.
    """
    lengths = np.diff(bounds)
    width, hashes = 1, _mixed((ids.astype(np.uint64) + np.uint64(1)) * _ODD)
    while width * REPEATS <= lengths.max(initial=0):
        twice = _mixed(hashes[:-width] * _ODD + hashes[width:])  # of 2 * width words
        per_doc = np.maximum(0, (lengths - 3 * width) // width + 1) * (lengths >= REPEATS * width)
        at = np.repeat(bounds[:-1], per_doc) + width * (np.arange(per_doc.sum()) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc))
        room = np.repeat(bounds[1:], per_doc) - 2 * width  # the last place where so many words are left
        found = np.zeros(len(at), dtype=bool)
        if len(at) > width:
            for period in range(width, 2 * width):
                there = at + period
                found |= (twice[np.minimum(there, len(twice) - 1)] == twice[at]) & (there <= room)
        else:
            for i, (c, end) in enumerate(zip(at.tolist(), room.tolist())):
                found[i] = (twice[c + width : min(c + 2 * width, end + 1)] == twice[c]).any()
        yield width, at[found]
        hashes, width = twice, 2 * width


def tiles(ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, bool, bool]]:
    """``document, width, start, words, anchors, first, last`` of the tiles that have anchors; starts and anchors count from the document and the tile."""
    for width, at in anchors(ids, bounds):
        size = max(TILE * width, LEAST_TILE)
        doc = np.searchsorted(bounds, at, side="right") - 1
        number = (at - bounds[doc]) // size
        cut = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(number, prepend=-1))
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(at)]):
            begin, end = bounds[doc[i]], bounds[doc[i] + 1]
            low = max(begin, begin + number[i] * size - MARGIN * width)
            high = min(end, begin + (number[i] + 1) * size + MARGIN * width)
            yield int(doc[i]), width, int(low - begin), ids[low:high].astype(np.int32), (at[i:j] - low).astype(np.int32), bool(low == begin), bool(high == end)


def z_function(words: list, places: list[int]) -> dict[int, int]:
    """For ascending places, how many words from there on are those from the beginning on."""
    n, z, left, right = len(words), {}, 0, 0
    for i in places:
        k = min(right - i, z.get(i - left, 0)) if i < right else 0
        while i + k < n and words[k] == words[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _is_power(block: np.ndarray) -> bool:
    """Whether a block of words is a shorter one repeated."""
    n, rest, factor = len(block), len(block), 2
    while rest > 1:
        factor = factor if factor * factor <= rest else rest
        if rest % factor == 0:
            d = n // factor
            if (block[d:] == block[:-d]).all():
                return True
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return False


def fragments(words: np.ndarray, places: list[int], width: int, first: bool, last: bool) -> list[tuple[int, int, int]]:
    """``period, start, stop`` of stretches of a tile that are periodic around its anchors, with the octave's periods.

    ``first`` and ``last``: the tile begins or ends with its document, so that a stretch isn't cut there.
    """
    found, n, listed = [], len(words), words.tolist()
    periods = np.arange(width, 2 * width)
    low, high = np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)  # the last stretch of each period
    for c in places:
        open_periods = periods[(c + periods + 2 * width <= n) & ~((low <= c) & (c + periods <= high))]
        for k in {0, 1, width, 2 * width - 1}:
            open_periods = open_periods[words[c + k + open_periods] == words[c + k]]
        if not len(open_periods):
            continue
        forward = z_function(listed[c:], list(range(1, 2 * width)))
        # backwards from the anchor, and then the words behind it, backwards: where a period ends there, and how far it goes on
        ahead = min(2 * width, n - c)
        both = [*listed[c - 1 :: -1], -1, *listed[c + ahead - 1 : c - 1 if c else None : -1]] if c else [-1, *listed[ahead - 1 :: -1]]
        backward = z_function(both, [*range(1, min(c, 2 * width)), *range(c + 1, len(both))])
        for q in open_periods.tolist():
            right = forward[q]
            if right < 2 * width:
                continue
            left = backward[c + 1 + ahead - q]
            if left == q:
                left += backward.get(q, 0) if q < c else 0
            start, stop = c - left, c + q + right
            low[q - width], high[q - width] = start, stop
            whole = (first or start > 0) and (last or stop < n)
            if (whole and stop - start < max(LEAST_WORDS, REPEATS * q)) or _is_power(words[start : start + q]):
                continue
            found.append((q, start, stop))
    return found


def _stitched(parts: DataFrame) -> DataFrame:
    """Whole runs, from fragments that share a period or more: ``key, start, length, period``."""
    ordered = Window.partitionBy("key", "period").orderBy("start", "stop")
    reach = F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opened = parts.withColumn("opens", F.coalesce(F.col("start") + F.col("period") > reach, F.lit(True)).cast("long"))
    runs = opened.withColumn("run", F.sum("opens").over(ordered)).groupBy("key", "period", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    runs = runs.select("key", "start", (F.col("stop") - F.col("start")).alias("length"), "period")
    return runs.where((F.col("length") >= LEAST_WORDS) & (F.col("length") >= REPEATS * F.col("period")))


def _kept(words: list[bytes], runs: list[dict]) -> bytes:
    dropped = np.zeros(len(words), dtype=bool)
    for r in runs:
        dropped[r["start"] + r["period"] : r["start"] + r["length"]] = True
    return b" ".join([w for w, gone in zip(words, dropped.tolist()) if not gone]) if runs else b" ".join(words)


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (by start, then period) and ``collapsed``: the words outside repetitions, joined by spaces."""
    base = without(docs, *_MADE)
    names = base.columns
    given = free_name(base, "text_bytes")
    source = base.withColumn(given, F.col(f"`{text}`").cast("binary"))
    at = len(names)
    head = columns_of(base)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, list]]:
        for batch in batches:
            for start, n in slices(byte_lengths(batch.column(at)), SLICE_BYTES):
                part = batch.slice(start, n)
                texts = part.column(at).to_pylist()
                yield part, texts, list(tiles(*numbered(texts)))

    def done(part: pa.RecordBatch, texts: list, runs: list) -> pa.RecordBatch:
        words = list(map(words_of, texts))
        collapsed = pa.array([_kept(w, r) for w, r in zip(words, runs)], pa.binary()).cast(pa.string())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        made = [pa.array(list(map(len, words)), pa.int64()), pa.array(runs, kind), collapsed]
        return pa.RecordBatch.from_arrays([*part.columns[: len(names)], *made], names=[*names, *_MADE])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without tiles."""
        for part, texts, found in sliced(batches):
            rest = sorted(set(range(part.num_rows)) - {t[0] for t in found})
            chosen = pa.RecordBatch.from_arrays([part.column(i).take(pa.array(rest, pa.int64())) for i in range(len(names))], names=names)
            yield done(chosen, [texts[i] for i in rest], [[]] * len(rest))

    tile_names = [free_name(base, n) for n in ("row_key", "width", "at", "words", "anchors", "first", "last")]
    tile_kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_()]
    key, width = tile_names[:2]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with tiles, and their tiles under the key of their document."""
        task, count = TaskContext.get().partitionId(), 0
        for part, _, found in sliced(batches):
            with_tiles = sorted({t[0] for t in found})
            keys = {doc: f"{task}:{count + i}" for i, doc in enumerate(with_tiles)}
            count += len(keys)
            columns = [part.column(i) for i in range(len(names))]
            empty = [pa.nulls(len(keys), k) for k in tile_kinds[1:]]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(with_tiles, pa.int64())) for c in columns), pa.array(list(keys.values()), pa.string()), *empty], names=[*names, *tile_names])
            rows = [(keys[doc], w, low, words.tobytes(), places.tobytes(), *ends) for doc, w, low, words, places, *ends in found]
            for i in range(0, len(rows), 1000):
                some = rows[i : i + 1000]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), c.type) for c in columns), *(pa.array(v, k) for v, k in zip(zip(*some), tile_kinds))], names=[*names, *tile_names])

    tile_schema = "`{}` string, `{}` bigint, `{}` bigint, `{}` binary, `{}` binary, `{}` boolean, `{}` boolean".format(*tile_names)
    work = Workspace(docs.sparkSession, "periodic-runs")
    tiled = work.save(source.mapInArrow(lean(explode), f"{head}, {tile_schema}"), "tiles", compression="zstd")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, q, low + start, low + stop) for k, w, low, words, places, *ends in zip(*(c.to_pylist() for c in batch.columns)) for q, start, stop in fragments(np.frombuffer(words, np.int32), np.frombuffer(places, np.int32).tolist(), w, *ends)]
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["key", "period", "start", "stop"])

    apart = tiled.where(F.col(width).isNotNull()).select(*tile_names).repartition(*tile_names[:3])
    runs = _stitched(apart.mapInArrow(lean(solve), "key string, period bigint, start bigint, stop bigint"))
    by_doc = runs.groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("found"))
    listed = free_name(base, "found_runs")
    by_doc = by_doc.select(key, F.expr("transform(found, r -> named_struct('start', r.start, 'length', r.length, 'period', r.period))").alias(listed))
    held = tiled.where(F.col(width).isNull()).select(*(F.col(f"`{n}`") for n in names), F.col(f"`{text}`").cast("binary").alias(given), key)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield done(batch, batch.column(at).to_pylist(), [r or [] for r in batch.column(at + 1).to_pylist()])

    made = f"{head}, n_words bigint, runs {RUNS}, collapsed string"
    joined = held.join(by_doc, key, "left").select(*(F.col(f"`{n}`") for n in names), given, listed)
    return source.mapInArrow(lean(plain), made).union(joined.mapInArrow(lean(collapse), made))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; of one document in ten, by checksum of its id, the words from some place on repeat the first of them."""
    hashed = docs.select("doc_id", "text", crc32_of(F.col("doc_id")).alias("h")).withColumn("g", F.expr("h div 10"))
    repeated = F.expr(
        r"""element_at(transform(array(regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0)), w ->
            element_at(transform(array(cast(g % greatest(size(w), 1) as int)), a ->
                array_join(concat(slice(w, 1, a), slice(flatten(array_repeat(
                    slice(w, a + 1, cast(1 + (size(w) - a) div (3 + g % 8) as int)), cast(3 + g % 8 as int))), 1, size(w) - a)), ' ')), 1)), 1)"""
    )
    return hashed.select("doc_id", F.when(F.col("h") % 10 == 0, repeated).otherwise(F.col("text")).alias("text"))


def op11(spark, sf_dir: str) -> DataFrame:
    """``op11_periodic_runs``: runs of every document, the longest of them, and digests of all and of what is left."""
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.expr("array_max(transform(runs, r -> named_struct('length', r.length, 'before', -r.start, 'under', -r.period, 'start', r.start, 'period', r.period)))")
    lines = F.expr(r"concat_ws('', transform(runs, r -> concat_ws('', r.start, ',', r.length, ',', r.period, '\n')))")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
