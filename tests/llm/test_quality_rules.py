import math
import re
from collections import Counter

from grainframe.llm import quality_rules as q

from .cases import awkward, frame, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def histograms(text):
    kinds = Counter()
    for c in text or "":
        if c > "\x7f":
            kinds["other"] += 1
        elif c.islower():
            kinds["lower"] += 1
        elif c.isupper():
            kinds["upper"] += 1
        elif c.isdigit():
            kinds["digit"] += 1
        elif c in " \t\n\v\f\r":
            kinds["space"] += 1
        elif c in ".,;:!?'\"()-":
            kinds["mark"] += 1
        else:
            kinds["symbol"] += 1
    bins = q.common_words()
    forms = {f: w for w in bins for f in (w, w.capitalize(), w.upper())}
    words = Counter(forms.get(w, "") for w in WORD.findall(text or ""))
    return [kinds[k] for k in q.CLASSES], [words[w] for w in [*bins, ""]]


def distance(p, q_):
    p, q_ = ([x / sum(v) for x in v] for v in (p, q_))
    total = 0.0
    for a, b in zip(p, q_):
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(0.0, total / 2))


def brute(rows):
    refs = {k: [[0] * 7, [0] * (len(q.common_words()) + 1)] for k in q.LANGUAGES}
    for text, lang in rows:
        if lang in refs and text:
            for at, (seen, least) in enumerate(zip(histograms(text), (q.MIN_CHARS_CLASSES, q.MIN_WORDS_COMMON))):
                if sum(seen) >= least:
                    refs[lang][at] = [a + b * q.UNITS // sum(seen) for a, b in zip(refs[lang][at], seen)]
    out = []
    for text, _ in rows:
        n, *rest, failed = counts(text)
        classes, words = histograms(text)
        near = lambda seen, at: min((distance(seen, r[at]) for r in refs.values() if sum(r[at])), default=None)
        far = near(classes, 0) if sum(classes) >= q.MIN_CHARS_CLASSES else None
        odd = near(words, 1) if n >= q.MIN_WORDS_COMMON else None
        kept = not failed and not (far is not None and far > q.MAX_CLASS_DISTANCE) and not (odd is not None and odd > q.MAX_WORD_DISTANCE)
        out.append((n, *rest, None if far is None else round(far, 6), None if odd is None else round(odd, 6), failed, kept))
    return out


def result(found):
    rows = found.collect()
    pick = lambda x: None if x is None else round(x, 6)
    return [(*(r[c] for c in q.COUNTS), pick(r["class_distance"]), pick(r["word_distance"]), r["base_failed"], r["kept"]) for r in rows]


def test_equals_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert sorted(result(q.quality_rules(docs)), key=str) == sorted(brute(rows), key=str)
    assert q.op4(spark, small_dir).count() == len(rows)


def test_awkward_rows(spark):
    found = q.quality_rules(with_clashes(frame(spark), "n_words", "kept", "Base_Failed"))
    assert sorted(result(found), key=str) == sorted(brute([(r[1], r[2]) for r in awkward()]), key=str)
    assert q.quality_rules(frame(spark, [])).count() == 0


def test_most_labelled_good_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    found = q.op4(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    kept = {r["quality"]: (r["k"], r["n"]) for r in found.groupBy("quality").agg({"kept": "count"}).withColumnRenamed("count(kept)", "n").join(found.where("kept").groupBy("quality").count().withColumnRenamed("count", "k"), "quality", "left").fillna(0).collect()}
    assert kept[1][0] >= 0.95 * kept[1][1]


def test_long_text_without_common_words_is_not_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    references = q.language_references(docs)
    bare = " ".join(f"{a}{b}{c}" for a in ("gor", "mal", "tev", "sin") for b in ("da", "li", "po", "ru", "ne") for c in ("ck", "st", "rm", "nd"))
    rows = [(1, bare.capitalize() + ".", "en"), (2, bare + " of", None), (3, " ".join(f"{w} {x}" if i % 4 == 0 else w for i, (w, x) in enumerate(zip(bare.split(), "the of and to in is that it for was".split() * 8))), "en")]
    few = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in q.quality_rules(few, references=references).collect()}
    assert not any(r["base_failed"] for r in found.values()) and all(r["class_distance"] < q.MAX_CLASS_DISTANCE for r in found.values())
    assert [found[i]["kept"] for i in (1, 2, 3)] == [False, False, True]
    # a reference with few common words lowers the limit with it
    thin = [0] * len(q.common_words()) + [95]
    thin[0] = 5
    one = q.quality_rules(few, references={"en": (references["en"][0], thin)}, max_word_distance=0.42).where("doc_id = 1").first()
    assert one["word_distance"] < 0.2 and not one["kept"]


def test_few_labelled_bad_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    found = q.op4(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("quality = 0")
    assert found.where("kept").count() <= 0.1 * found.count()
