"""MinHash near-dedup: documents whose sets of word shingles have a Jaccard similarity of at least ``percent`` / 100.

1. One map computes each document's exact set of shingles, the minima of ``BANDS * ROWS`` universal hashes, a key for each
   band of minima, and a sketch of one byte per minimum. Documents with equal sets are one class from here on.
2. Classes that share a band's key are candidates. In each of ``PIVOT_ROUNDS`` rounds, the members of a key outside its
   largest component are held against one member of that component (its pivot): first by sketches, then exactly, on the
   full sets. Components are joined after the first round, which finds most links, and before step 3. A group of m near copies
   costs a few times m pairs, not m squared.
3. Members still in different components are compared on their full sets, in blocks of bounded size; only links that join
   two components leave a block, to be confirmed again on the texts. No key is capped.
4. Links are joined to components by alternating large-star and small-star.

At the default 80 % a linked pair shares a band with probability 1 - (1 - 0.8 ** 5) ** 38 = 1 - 3e-7 or more, and its sketch
may fall ``SKETCH_SLACK`` deviations below the limit; both misses together are a few in a million, at the very limit.

Defined results: texts without words (null, empty, only white space) have the empty set, link with nothing and are kept.
A text of fewer words than a shingle has its whole sequence as its one shingle. Rows without an id take part in nothing:
their component is null and they are kept. Rows that repeat an id and a text get equal results. Of rows of one id with
different texts, candidates are confirmed on one of the texts; ``without_near_duplicates`` tells such rows apart. Extra
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainframe.llm.common import WORD, Workspace, free_name, lean, table, with_row_key
from grainframe.operators.components import connected_components
from grainframe.llm.runs import sorted_runs

BANDS, ROWS = 38, 5
HASHES = BANDS * ROWS
SHINGLE = 5
PERCENT = 80
#: Standard deviations that a sketch may fall below the limit.
SKETCH_SLACK = 4.5
#: Rounds of holding a key's members against one of its largest component, before the rest is compared in blocks.
PIVOT_ROUNDS = 4
#: Bytes of the sets in a block.
BLOCK_BYTES = 4_000_000
#: Up to so many ids of candidates go to every executor; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_MIX = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, size: int) -> set[bytes]:
    """Distinct shingles of ``size`` words, A-Z in lower case; the words of a shingle are joined by one space."""
    words = text.lower().split() if text else []
    if not words:
        return set()
    joined = b" ".join(words)
    if len(words) <= size:
        return {joined}
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-size] + 1).tolist()]
    return {joined[i:j] for i, j in zip(starts, ends[size - 1 :].tolist())}


def minima(hashes: np.ndarray) -> np.ndarray:
    """Minimum of each universal hash (odd multiplier, modulo 2 ** 64) over a set of 64-bit values; the upper halves."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[i : i + 1024] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    return least >> np.uint64(32)


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """``doc``, size of its set, digest of its set, band keys and sketch; the last three are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            ids = batch.column(0)
            counts, digests, least = [], [], []
            for value in batch.column(1):
                found = shingles(value.as_py(), size)
                counts.append(len(found))
                if found:
                    hashes = np.sort(np.fromiter(map(digest, found), np.uint64, len(found)))
                    digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    least.append(minima(hashes))
                else:
                    digests.append(None)
            least = np.array(least, dtype=np.uint64).reshape(-1, BANDS, ROWS)
            mixed = (least * _MIX).sum(axis=2, dtype=np.uint64)
            mixed ^= mixed >> np.uint64(29)
            bands = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist()
            sketches = [x.tobytes() for x in (least & np.uint64(255)).astype(np.uint8).reshape(-1, HASHES)]
            full = iter(zip(bands, sketches))
            pairs = [next(full) if n else (None, None) for n in counts]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array([b for b, _ in pairs], pa.list_(pa.int64())), pa.array([s for _, s in pairs], pa.binary())],
                names=["doc", "n", "digest", "bands", "sketch"],
            )

    return docs.mapInArrow(lean(run), "doc bigint, n bigint, digest binary, bands array<bigint>, sketch binary")


def least_agreement(percent: int) -> int:
    """Bytes of two sketches that agree at least, for pairs at the limit less the slack; unlike minima agree once in 256."""
    p = percent / 100 + (1 - percent / 100) / 256
    return int(np.floor(HASHES * p - SKETCH_SLACK * np.sqrt(HASHES * p * (1 - p))))


def _agreeing(pairs: DataFrame, sketches: DataFrame, least: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose sets can reach the limit by their sizes, and whose sketches agree in at least ``least`` bytes."""
    first, second = (sketches.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    both = pairs.join(second, "b").join(first, "a").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, HASHES) for i in (2, 3))
            alike = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(alike) for i in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(lean(run), "a bigint, b bigint")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the limit."""
    both = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, set()
        for batch in batches:
            linked = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, mine = a, shingles(x.as_py(), size)
                theirs = shingles(y.as_py(), size)
                common = len(mine & theirs)
                linked.append(100 * common >= percent * (len(mine) + len(theirs) - common))
            kept = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(kept) for i in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(lean(run), "a bigint, b bigint")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """``doc, n, hashes``: the whole set of each text, as sorted 64-bit hashes in one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            found = [np.sort(np.fromiter(map(digest, shingles(x.as_py(), size)), np.uint64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())], names=["doc", "n", "hashes"])

    return texts.select("doc", "text").mapInArrow(lean(run), "doc bigint, n bigint, hashes binary")


def block_links(sets: list[np.ndarray], component: np.ndarray, rows: np.ndarray, columns: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between different components that join what the links before them leave apart: fewer than there are members.

    One row is held against all columns at once: its values are marked, and marks are summed over each set.
    """
    sizes = np.array([len(sets[c]) for c in columns], dtype=np.int64)
    flat, numbers = np.unique(np.concatenate([*(sets[c] for c in columns), *(sets[r] for r in rows)]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    own = np.concatenate([[0], np.cumsum([len(sets[r]) for r in rows])]) + starts[-1]
    marks = np.zeros(len(flat), dtype=np.int32)
    label, links = component.copy(), []
    for i, r in enumerate(rows):
        mine = numbers[own[i] : own[i + 1]]
        marks[mine] = 1
        common = np.add.reduceat(marks[numbers[: starts[-1]]], starts[:-1])
        marks[mine] = 0
        near = columns[100 * common >= percent * (sizes + len(mine) - common)]
        for c in near[label[near] != label[r]]:
            if label[c] != label[r]:
                label[label == label[c]] = label[r]
                links.append((int(r), int(c)))
    return links


def _blockwise(members: DataFrame, percent: int) -> DataFrame:
    """Linked pairs of members of a key that join its components, found on full sets in blocks of about ``BLOCK_BYTES``.

    ``members``: key, doc, component, hashes, size (bytes of all sets of the key). Each block gives fewer pairs than it has
    members, however many are alike.
    """
    blocks = F.ceil(F.col("size") / BLOCK_BYTES).cast("int")
    own = F.pmod(F.xxhash64("doc"), blocks).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "component", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_runs(batches, ["key", "i", "j"]):
            i, j = group["i"][0].as_py(), group["j"][0].as_py()
            docs, own, component = (group[c].to_numpy() for c in ("doc", "own", "component"))
            rows, columns = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if not len(rows) or not len(columns) or (component == component[0]).all():
                continue
            sets = [np.frombuffer(x, dtype=np.uint64) for x in group["hashes"].to_pylist()]
            if links := block_links(sets, component, rows, columns, percent):
                a, b = docs[np.array(links)].T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lean(run), "a bigint, b bigint")


def _pivots(held: DataFrame, seed: int) -> DataFrame:
    """Of each key with several components: its largest one, and the member of it that is first in a seeded order.

    The order is one for all keys, so keys with the same members choose the same pivot.
    """
    by_component = held.groupBy("key", "component").agg(F.count("*").alias("n"), F.max(F.struct(F.xxhash64("doc", F.lit(seed)).alias("h"), "doc")).alias("first"))
    best = by_component.groupBy("key").agg(F.count("*").alias("k"), F.max(F.struct("n", "first", "component")).alias("best")).where("k > 1")
    return best.select("key", F.col("best.first.doc").alias("pivot"), F.col("best.component").alias("main"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    spark = docs.sparkSession
    work = Workspace(spark, "near-dedup")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
    least = least_agreement(percent)

    signed = work.save(_signatures(texts, shingle), "signatures")
    classes = signed.where("digest IS NOT NULL AND doc IS NOT NULL").groupBy("digest").agg(F.min("doc").alias("class"))
    heads = signed.join(classes.withColumnRenamed("class", "doc"), ["digest", "doc"], "left_semi").dropDuplicates(["digest", "doc"])
    heads = work.save(heads.select("doc", "n", "sketch", "bands"), "heads")
    sketches = heads.select("doc", "n", "sketch")

    keyed = heads.select("doc", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = work.save(keyed.join(shared, "key"), "members")
    ids = work.save(members.select("doc").distinct(), "member-ids")
    few = ids.count() <= MAX_BROADCAST_IDS
    texts = work.save(texts.join(F.broadcast(ids) if few else ids, "doc", "left_semi").dropDuplicates(["doc"]), "member-texts")

    none = spark.createDataFrame([], "a bigint, b bigint")
    links, tested, components = none, none, spark.createDataFrame([], "node bigint, component bigint")
    joined_links = True  # whether components hold all links
    for step in range(PIVOT_ROUNDS + 1):
        if step == PIVOT_ROUNDS and not joined_links:
            components, joined_links = connected_components(links, work, "components-before"), True
        held = members if step == 0 else members.where("m > 2")
        held = held.join(components.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        pivots = _pivots(held, step)
        if step < PIVOT_ROUNDS:
            open_ = held.join(pivots, "key").where("component <> main")
            pairs = open_.select(F.least("pivot", "doc").alias("a"), F.greatest("pivot", "doc").alias("b")).distinct()
            near = work.save(_agreeing(pairs.join(tested, ["a", "b"], "left_anti"), sketches, least, percent), f"near-{step}")
        else:
            rest = work.save(held.join(pivots.select("key"), "key", "left_semi").select("key", "doc", "component"), "rest")
            sets = work.save(_sets(texts.join(rest.select("doc").distinct(), "doc", "left_semi"), shingle), "rest-sets")
            size = rest.join(sets.select("doc", "n"), "doc").groupBy("key").agg(F.sum(8 * F.col("n")).alias("size"))
            near = work.save(_blockwise(rest.join(size, "key").join(sets, "doc"), percent).distinct(), f"near-{step}")
        if near.isEmpty():
            continue
        tested = tested.union(near)
        found = work.save(_confirmed(near, texts, shingle, percent), f"links-{step}")
        if not found.isEmpty():
            links, joined_links = links.union(found), False
        if step == 0 and not joined_links:
            components, joined_links = connected_components(links, work, "components-first"), True
    if not joined_links:
        components = connected_components(links, work, "components-last")
    work.drop("members", "heads", "member-texts", "member-ids", "rest", "rest-sets", *(f"near-{i}" for i in range(PIVOT_ROUNDS + 1)))

    joined = components.withColumnRenamed("node", "class")
    whole = classes.join(joined, "class", "left").select("digest", F.coalesce("component", "class").alias("component"))
    found = signed.select("doc", "n", "digest").join(whole, "digest", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` of which one of each group of near duplicates stays.

    Rows without an id, or with an id that other rows have too, go by a number of their text, above all ids. Of rows with
    one such number one stays (one with an id, if there is), so repeated rows and copies without an id go too. Other texts without words all stay.
    """
    key, own = free_name(docs, "row_key"), free_name(docs, "own_id")
    work = Workspace(docs.sparkSession, "near-dedup-rows")
    keyed = with_row_key(docs, key)
    ids = keyed.select(F.col(doc_id).cast("long").alias("id__"))
    repeated = work.save(ids.where("id__ IS NOT NULL").groupBy("id__").agg(F.count("*").alias("n__")).where("n__ > 1").select("id__"), "repeated-ids")
    few = repeated.count() <= MAX_BROADCAST_IDS
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    number = F.xxhash64(data).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    joined = keyed.join(F.broadcast(repeated) if few else repeated, F.col(doc_id).cast("long") == F.col("id__"), "left")
    numbered = F.col("id__").isNotNull() | F.col(doc_id).isNull()
    rows = joined.withColumn(own, F.when(numbered, number).otherwise(F.col(doc_id).cast("long"))).drop("id__")
    found = near_duplicates(rows.select(F.col(own), F.col(text)), text, own, shingle, percent)
    gone = work.save(found.where("NOT kept").select(F.col("doc_id").alias(own)).distinct(), "gone")
    again = rows.where(F.col(own) >= F.lit(1 << 62)).select(own, F.struct(F.col(doc_id).isNull().alias("last"), F.col(key).alias("key")).alias("place__"))
    first = again.groupBy(own).agg(F.min("place__").alias("first__"))
    copies = work.save(again.join(first, own).where("place__ <> first__").select(F.col("place__.key").alias(key)), "copies")
    kept = rows
    for name, frame in ((own, gone), (key, copies)):
        kept = kept.join(F.broadcast(frame) if frame.count() <= MAX_BROADCAST_IDS else frame, name, "left_anti")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def op3(spark, sf_dir: str) -> DataFrame:
    """``op3_minhash_near_dedup``: components of documents at 80 % of their 4-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ``op3`` in DuckDB: all pairs that share a shingle, their exact overlap, and the closure of the links.
SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""
