"""Quality rules by distribution divergence.

Base rules count words, symbols, repeated lines and repeated word windows of each whole text. The verdict compares a
document's character-class histogram and its common-word histogram with references of each language, by Jensen-Shannon
distance (base 2, so 0 to 1). Most of a reference's words are the bin of all other words, so a text without any common word
lies only 0.31 to 0.35 from it: the common-word test wants a text within ``MAX_WORD_DISTANCE`` of a reference and nearer to
one than such a text. References are built from all documents: one pass sums integer shares per language, so a
document counts once however long it is, and the sums don't depend on the order of tasks. Only the sums of
``len(LANGUAGES) * (classes + words)`` cells reach the driver. A second pass scores each document by itself; no row is
shuffled.

Defined results: a null or empty text has no words and all counts 0, and fails the base rule. A text below a test's
minimum length isn't judged by that test (its distance is null). With no reference at all (empty table, or no document
of a listed language) every distance is null and only the base rules decide. A null or unknown language adds to no
reference; its documents are judged like all others, against the nearest reference. A reference without any common word
tells nothing about their lack; if all are so, only the distance counts. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainframe.llm.common import lean, without

#: Common words of each reference language, lower case.
LANGUAGES = {
    "en": "the of and to in is that it for was with as be by on at this are from or an not have which you",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus avec elle ce il",
    "es": "de la que el en y los del se las por un para con no una su al lo como más pero sus",
}
SYMBOLS = b"#*$%&|<>"
SENTENCE_MARKS = b".,;:!?'\"()-"
CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "other")
#: A document adds this many units to a reference, shared out over its histogram.
UNITS = 1_000_000

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Production settings of the verdict.
MIN_CHARS_CLASSES = 200
MIN_WORDS_COMMON = 50
MAX_CLASS_DISTANCE = 0.28
#: Below the distance of a text without common words from every reference of the test tables (0.306, es at sf0.001).
MAX_WORD_DISTANCE = 0.30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ADDED = f"{', '.join(f'`{c}` bigint' for c in COUNTS)}, `class_distance` double, `word_distance` double, `base_failed` boolean, `kept` boolean"


@lru_cache
def common_words() -> list[str]:
    return sorted({w for words in LANGUAGES.values() for w in words.split()})


def _class_table() -> np.ndarray:
    """Class of each UTF-8 byte; continuation bytes get one past the last, so each code point counts once."""
    kind = np.full(256, CLASSES.index("symbol"))
    kind[list(range(ord("a"), ord("z") + 1))] = CLASSES.index("lower")
    kind[list(range(ord("A"), ord("Z") + 1))] = CLASSES.index("upper")
    kind[list(range(ord("0"), ord("9") + 1))] = CLASSES.index("digit")
    kind[[32, *range(9, 14)]] = CLASSES.index("space")
    kind[list(SENTENCE_MARKS)] = CLASSES.index("mark")
    kind[0x80:0xC0] = len(CLASSES)
    kind[0xC0:] = CLASSES.index("other")
    return kind


KINDS = _class_table()
_ONE_HOT = np.eye(len(CLASSES) + 1, dtype=np.int64)[KINDS]


def class_histogram(bytes_seen: np.ndarray) -> np.ndarray:
    """Counts of code points by class, from counts of the 256 byte values."""
    return (bytes_seen @ _ONE_HOT)[: len(CLASSES)]


def word_index() -> dict[bytes, int]:
    """Bin of each common word as written: in small letters, capitalised or in capitals."""
    return {form.encode(): i for i, w in enumerate(common_words()) for form in (w, w.capitalize(), w.upper())}


def word_histogram(numbers: dict[bytes, int], counts: np.ndarray, index: dict[bytes, int]) -> np.ndarray:
    """Counts of the common words, then of all other words; ``numbers`` has each word's place in ``counts``."""
    seen = np.zeros(len(common_words()) + 1, dtype=np.int64)
    for word in index.keys() & numbers.keys():
        seen[index[word]] += counts[numbers[word]]
    seen[-1] = counts.sum() - seen.sum()
    return seen


#: Odd multipliers, so that sums of windows seldom agree by chance; the exact count follows where they do.
_MIX = {1: np.uint64(0x9E3779B97F4A7C15), 2: np.uint64(0xC2B2AE3D27D4EB4F), 4: np.uint64(0x165667B19E3779F9)}


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in windows of ``window`` words (a power of two) found twice or more; ``ids`` are exact word numbers.

    Windows get exact numbers by doubling: windows of 2s words are pairs of windows of s words.
    """
    n = len(ids)
    if n <= window:
        return 0
    mixed = ids.astype(np.uint64) + np.uint64(1)
    step = 1
    while step < window:
        mixed = mixed[:-step] * _MIX[step] + mixed[step:]
        step *= 2
    mixed.sort()
    if (mixed[1:] != mixed[:-1]).all():  # equal windows have equal sums, so none is there twice
        return 0
    grams, step = ids, 1
    while step < window:
        grams = np.unique(grams[:-step] * np.int64(n) + grams[step:], return_inverse=True)[1]
        step *= 2
    again = np.flatnonzero(np.bincount(grams)[grams] > 1)
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + window, -1)
    return int((np.cumsum(edges[:n]) > 0).sum())


def nearest_distance(seen: np.ndarray, references: list[np.ndarray]) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to the nearest reference; NaN where there is none."""
    best = np.full(len(seen), np.nan)
    p = seen / np.maximum(1, seen.sum(axis=1, keepdims=True))
    for reference in references:
        q = reference / reference.sum()
        m = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            parts = np.where(p > 0, p * np.log2(p / m), 0.0) + np.where(q > 0, q * np.log2(q / m), 0.0)
        best = np.fmin(best, np.sqrt(np.maximum(0.0, parts.sum(axis=1) / 2)))
    return best


def lacks_common_words(each: list[np.ndarray], references: list[np.ndarray]) -> np.ndarray:
    """Whether texts at the distances ``each`` of ``references`` are nearer to none than a text without any common word."""
    bare = np.zeros((1, len(common_words()) + 1), dtype=np.int64)
    bare[0, -1] = 1
    lacks = [d > limit - 1e-9 for d, limit in zip(each, (nearest_distance(bare, [r])[0] for r in references)) if limit > 1e-6]
    return np.logical_and.reduce(lacks) if lacks else np.False_


def _byte_counts(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)


def _numbered(words: list[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
    """A number for each distinct word, and the numbers of all words in order."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return numbers, np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[list[int], list[int]]]:
    """Class and common-word histograms of each listed language, over all its documents that the minimum lengths admit."""
    index, bins = word_index(), len(common_words()) + 1
    languages = sorted(LANGUAGES)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), len(CLASSES) + bins), dtype=np.int64)
        for batch in batches:
            for of, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if of not in LANGUAGES or not (text_bytes := data.as_py()):
                    continue
                row, words = total[languages.index(of)], text_bytes.split()
                classes = class_histogram(_byte_counts(text_bytes))
                if classes.sum() >= MIN_CHARS_CLASSES:
                    row[: len(CLASSES)] += classes * UNITS // classes.sum()
                if len(words) >= MIN_WORDS_COMMON:
                    counts = Counter(words)
                    seen = np.zeros(bins, dtype=np.int64)
                    for word in index.keys() & counts.keys():
                        seen[index[word]] += counts[word]
                    seen[-1] = len(words) - seen.sum()
                    row[len(CLASSES) :] += seen * UNITS // len(words)
        at, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([languages[i] for i in at], pa.string()), pa.array(cell, pa.int32()), pa.array(total[at, cell], pa.int64())], names=["of", "cell", "units"])

    summed = docs.select(F.col(lang).cast("string"), F.col(text).cast("binary")).mapInArrow(shares, "of string, cell int, units bigint").groupBy("of", "cell").agg(F.sum("units").alias("units")).collect()
    found = {k: np.zeros(len(CLASSES) + bins, dtype=np.int64) for k in languages}
    for row in summed:
        found[row["of"]][row["cell"]] = row["units"]
    return {k: (v[: len(CLASSES)].tolist(), v[len(CLASSES) :].tolist()) for k, v in found.items() if v.any()}


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    references: dict[str, tuple[list[int], list[int]]] | None = None,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """``docs`` with the counts, both distances (to the nearest reference), ``base_failed`` and ``kept``.

    Columns of those names in ``docs`` are replaced. ``references`` are built from ``docs`` if not given.
    """
    if references is None:
        references = language_references(docs, text, lang)
    by_class = [np.array(c) for c, _ in references.values() if sum(c)]
    by_word = [np.array(w) for _, w in references.values() if sum(w)]
    index = word_index()
    space = [32, *range(9, 14)]
    symbols = list(SYMBOLS)

    def counted(data: bytes | None) -> tuple:
        data = data or b""
        seen = _byte_counts(data)
        numbers, ids = _numbered(data.split())
        n_dup = 0
        if b"\n" in data:
            lines = [x for x in data.split(b"\n") if x.strip()]
            n_dup = len(lines) - len(set(lines))
        classes = class_histogram(seen)
        counts = len(ids), int(classes.sum() - seen[space].sum()), int(seen[symbols].sum()), n_dup, repeat_words(ids)
        return *counts, classes, word_histogram(numbers, np.bincount(ids, minlength=len(numbers)), index)

    def verdicts(found: list[tuple]) -> list[pa.Array]:
        *counts, classes, words = zip(*found) if found else [()] * (len(COUNTS) + 2)
        classes = np.array(classes, dtype=np.int64).reshape(len(found), len(CLASSES))
        words = np.array(words, dtype=np.int64).reshape(len(found), -1)
        n_words, repeated = np.array(counts[0], dtype=np.int64), np.array(counts[4], dtype=np.int64)
        far = np.where(classes.sum(axis=1) >= MIN_CHARS_CLASSES, nearest_distance(classes, by_class), np.nan)
        each = [np.where(n_words >= MIN_WORDS_COMMON, nearest_distance(words, [r]), np.nan) for r in by_word]
        odd = np.fmin.reduce([np.full(len(found), np.nan), *each])
        failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n_words)
        kept = ~failed & ~(far > max_class_distance) & ~(odd > max_word_distance) & ~lacks_common_words(each, by_word)
        return [*(pa.array(c, pa.int64()) for c in counts), *(pa.array(x, pa.float64(), from_pandas=True) for x in (far, odd)), pa.array(failed), pa.array(kept)]

    names = [*COUNTS, "class_distance", "word_distance", "base_failed", "kept"]
    base = without(docs, *names)
    kept_names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = verdicts([counted(x.as_py()) for x in batch.column(len(kept_names))])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept_names)], *made], names=[*kept_names, *names])

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    source = base.select("*", F.col(text).cast("binary").alias("\x01text")) if text in kept_names else None
    if source is None:
        raise ValueError(f"no column {text}")
    return source.mapInArrow(lean(run), f"{given}, {_ADDED}")


def op4(spark, sf_dir: str) -> DataFrame:
    """``op4_quality_rules``: the base counts and the verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = quality_rules(docs)
    return found.select("doc_id", *COUNTS, "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))
