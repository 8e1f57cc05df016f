"""Language identification by word-first backoff.

A known word counts with the logarithm of its relative frequency in each language. A word
that was never seen falls back to the longest character n-grams of it that were, four
characters first, then three, two and one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmesh.llm.arrow import map_batches, slices
from trailmesh.session import checkpointed

WORD = re.compile(r"[^\W\d_]+")
LONGEST_GRAM = 4
UNKNOWN = "und"
#: Partial counts a task holds before it hands them on.
HELD_COUNTS = 300_000
#: Sums of weights that cross tasks are whole numbers of 1 / FIXED.
FIXED = float(1 << 32)
HITS = "array<struct<lang: int, weight: long>>"
#: In place of a language: how often the base score of words or n-grams counts, and how many n-grams were found.
WORDS, GRAMS, COUNT = -1, -2, -3


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams; from two characters on, the word's ends count as characters."""
    padded = word if n == 1 else f"_{word}_"
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """The most frequent words and n-grams, small enough to be sent, and the tables of all of them."""

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray  # a row per word, a column per language
    grams: dict[str, int]
    gram_scores: np.ndarray
    word_base: np.ndarray | None = None  # score of a word that a language does not have
    gram_base: np.ndarray | None = None
    word_table: DataFrame | None = None  # (piece, hits) of every counted word
    gram_table: DataFrame | None = None

    def known(self, word: str, n: int) -> tuple[list[int], list[str]]:
        """Rows of the word's n-grams that were sent, and its other n-grams."""
        rows, others = [], []
        for gram in grams_of(word, n):
            row = self.grams.get(gram)
            if row is None:
                others.append(gram)
            else:
                rows.append(row)
        return rows, others

    def unseen(self, word: str) -> np.ndarray:
        """The score of a word by the n-grams that were sent alone."""
        for n in range(LONGEST_GRAM, 0, -1):
            rows, _ = self.known(word, n)
            if rows:
                return self.gram_scores[rows].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)

    def part(self, text: str | None) -> tuple[bool, np.ndarray, Counter]:
        """Has the text letters, the score of its words that were sent, and its other words."""
        counts = Counter(words_of(text)) if text else Counter()
        total, others = np.zeros(len(self.languages)), Counter()
        if not self.languages or not any(any(map(str.isalpha, w)) for w in counts):
            return False, total, others
        rows, times = [], []
        for word, k in counts.items():
            row = self.words.get(word)
            if row is None:
                others[word] = k
            else:
                rows.append(row)
                times.append(k)
        if rows:
            total += np.array(times, np.float64) @ self.word_scores[rows]
        return True, total, others


def _counted(rows: DataFrame, columns: list[str], pieces, schema: str) -> DataFrame:
    """Sums of counts per (lang, piece); tasks add up what they can hold before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[str, Counter] = {}

        def emptied() -> dict:
            out = {
                "lang": [lang for lang, c in held.items() for _ in c],
                "piece": [p for c in held.values() for p in c],
                "n": [k for c in held.values() for k in c.values()],
            }
            held.clear()
            return out

        for part in slices(batches, columns[1]):
            for lang, text, *more in zip(*(part.column(c).to_pylist() for c in columns), strict=True):
                pieces(held.setdefault(lang, Counter()), text, *more)
            if sum(map(len, held.values())) >= HELD_COUNTS:
                yield emptied()
        if held:
            yield emptied()

    return map_batches(rows, work, schema).groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def _add_words(counts: Counter, text: str) -> None:
    counts.update(words_of(text))


def _add_grams(counts: Counter, word: str, n: int) -> None:
    for size in range(1, LONGEST_GRAM + 1):
        for gram in grams_of(word, size):
            counts[gram] += n


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of the pieces whose total reaches the lowest total at which at most ``most`` pieces remain."""
    totals = counts.groupBy("piece").agg(F.sum("n").alias("_total"))
    # Totals fall into a few hundred logarithmic steps, so the histogram is small whatever the corpus.
    steps = totals.groupBy(F.floor(F.log2(F.col("_total").cast("double")) * 16).alias("step")).count().collect()
    left, cut = most, None
    for step, n in sorted(steps, reverse=True):
        if n > left:
            break
        left, cut = left - n, step
    if cut is None:
        return counts.limit(0)
    kept = totals.filter(F.floor(F.log2(F.col("_total").cast("double")) * 16) >= cut).select("piece")
    return counts.join(kept, "piece", "left_semi")


def _scores(rows: list, languages: list[str], totals: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    index: dict[str, int] = {}
    column = {lang: i for i, lang in enumerate(languages)}
    counts = Counter()
    for lang, piece, n in rows:
        counts[index.setdefault(piece, len(index)), column[lang]] += n
    table = np.full((len(index), len(languages)), 0.5)
    for (r, c), n in counts.items():
        table[r, c] += n
    return index, np.log(table / totals).astype(np.float32)


def _entry(lang: Column, weight: Column) -> Column:
    return F.struct(lang.cast("int").alias("lang"), weight.cast("long").alias("weight"))


def _hits(counts: DataFrame, languages: list[str]) -> DataFrame:
    """(piece, hits): per language that has the piece, how far its score lies above that of a language without it.

    Weights are whole numbers of 1 / FIXED, so that sums do not depend on the order.
    """
    lang = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1
    weight = F.round(F.log((F.col("n") + 0.5) / 0.5) * FIXED)
    return counts.groupBy("piece").agg(F.collect_list(_entry(lang, weight)).alias("hits"))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 200_000,
        max_grams: int = 100_000) -> Model:
    """Counts words and n-grams of all rows whose language and text are not null.

    Every counted word and n-gram belongs to the model. At most ``max_words`` words and
    ``max_grams`` n-grams, the most frequent ones, are held in memory; the others stay in
    tables and are joined to the words that need them, with the same result. Without rows
    the model knows no language.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter("lang is not null and text is not null")
    words = checkpointed(_counted(rows, ["lang", "text"], _add_words, "lang string, piece string, n long"))
    spelled = words.select("lang", F.col("piece").alias("word"), "n")
    grams = checkpointed(_counted(spelled, ["lang", "word", "n"], _add_grams, "lang string, piece string, n long"))
    sizes = {r[0]: r[1] for r in words.groupBy("lang").agg(F.sum("n")).collect()}
    gram_sizes = {r[0]: r[1] for r in grams.groupBy("lang").agg(F.sum("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        nothing = np.zeros((0, 0), np.float32)
        return Model([], {}, nothing, {}, nothing)
    held, bases, tables = [], [], []
    for counts, most, size in ((words, max_words, sizes), (grams, max_grams, gram_sizes)):
        distinct = counts.select("piece").distinct().count()
        totals = np.array([size.get(lang, 0) + 0.5 * (distinct + 1) for lang in languages])
        found = [tuple(r) for r in _most_frequent(counts, most).select("lang", "piece", "n").collect()]
        held += _scores(found, languages, totals)
        bases.append(np.log(0.5 / totals).astype(np.float32))
        tables.append(_hits(counts, languages))
    return Model(languages, *held, *bases, *tables)


def _backed_off(unseen: DataFrame, model: Model, sent) -> DataFrame:
    """(word, hits) of words that were never counted: means over their longest n-grams that were."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = sent.value
        above = np.rint((held.gram_scores.astype(np.float64) - held.gram_base) * FIXED).astype(np.int64)
        names = ("word", "level", "gram", "times", "hits")
        for part in slices(batches, "word"):
            out = []
            for word in part.column("word").to_pylist():
                for n in range(LONGEST_GRAM, 0, -1):
                    rows, others = held.known(word, n)
                    out += [(word, n, gram, k, None) for gram, k in Counter(others).items()]
                    if rows:
                        sums = above[rows].sum(axis=0)
                        hits = [{"lang": int(c), "weight": int(sums[c])} for c in np.flatnonzero(sums)]
                        out.append((word, n, None, 1, [*hits, {"lang": COUNT, "weight": len(rows)}]))
                        break  # shorter n-grams are not asked for
            if out:
                yield dict(zip(names, zip(*out, strict=True), strict=True))

    asked = checkpointed(map_batches(unseen, work, f"word string, level int, gram string, times long, hits {HITS}"))
    sought = asked.filter("gram is not null").drop("hits")
    joined = sought.join(model.gram_table.withColumnRenamed("piece", "gram"), "gram").withColumn(
        "hits", F.array_append("hits", _entry(F.lit(COUNT), F.lit(1))))
    both = joined.select("word", "level", "times", "hits").unionByName(
        asked.filter("gram is null").select("word", "level", "times", "hits"))
    sums = both.select("word", "level", "times", F.inline("hits")).groupBy("word", "level", "lang").agg(
        F.sum(F.col("times") * F.col("weight")).alias("weight"))
    levels = sums.groupBy("word", "level").agg(
        F.max(F.when(F.col("lang") == COUNT, F.col("weight"))).alias("n"),
        F.collect_list(F.when(F.col("lang") >= 0, _entry(F.col("lang"), F.col("weight")))).alias("hits"))
    longest = levels.groupBy("word").agg(F.max_by(F.struct("n", "hits"), "level").alias("best"))
    mean = F.transform("best.hits", lambda h: _entry(h["lang"], F.round(h["weight"] / F.col("best.n"))))
    return longest.select("word", F.array_append(mean, _entry(F.lit(GRAMS), F.lit(1))).alias("hits"))


def _rest(parts: DataFrame, model: Model, sent) -> DataFrame:
    """(_row, rest): what the words of each row that were not sent add, by language."""
    pairs = parts.select("_row", F.inline("others"))
    known = pairs.select("word").distinct().join(
        model.word_table.withColumnRenamed("piece", "word"), "word", "left")
    looked = checkpointed(known)
    backed = _backed_off(looked.filter("hits is null").select("word"), model, sent)
    scored = checkpointed(looked.filter("hits is not null").withColumn(
        "hits", F.array_append("hits", _entry(F.lit(WORDS), F.lit(1)))).unionByName(backed))
    added = pairs.join(scored, "word").select("_row", "times", F.inline("hits"))
    sums = added.groupBy("_row", "lang").agg(F.sum(F.col("times") * F.col("weight")).alias("weight"))
    return sums.groupBy("_row").agg(F.collect_list(_entry(F.col("lang"), F.col("weight"))).alias("rest"))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score), one row per input row, in the order of the input.

    ``und`` with score 0 for a text that is null or has no letter. Texts of any length are
    read whole. Equal scores go to the language first in the alphabet. The words and n-grams
    that the model holds in memory are sent to every executor once; only the other words
    leave their row, are joined to the whole tables, once each, and come back as sums.
    """
    sent = docs.sparkSession.sparkContext.broadcast(replace(model, word_table=None, gram_table=None))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    rows = rows.withColumn("_row", F.monotonically_increasing_id())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in slices(batches, "_text"):
            found = [sent.value.part(t) for t in part.column("_text").to_pylist()]
            yield {"_row": part.column("_row"), "_id": part.column("_id"), "letters": [f[0] for f in found],
                   "sums": [f[1] for f in found],
                   "others": [[{"word": w, "times": k} for w, k in f[2].items()] for f in found]}

    parts = checkpointed(map_batches(rows, work, f"_row long, _id {kind}, letters boolean, sums array<double>, "
                                                 "others array<struct<word: string, times: long>>"))
    whole = parts.drop("others")
    if model.word_table is None:
        whole = whole.withColumn("rest", F.lit(None).cast(HITS))
    else:
        whole = whole.join(_rest(parts, model, sent), "_row", "left")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = sent.value
        for batch in batches:
            found = []
            for letters, sums, rest in zip(*(batch.column(c).to_pylist() for c in ("letters", "sums", "rest")),
                                           strict=True):
                if not letters:
                    found.append((UNKNOWN, 0.0))
                    continue
                total = np.array(sums)
                for lang, weight in sorted((h["lang"], h["weight"]) for h in rest or ()):
                    if lang >= 0:
                        total[lang] += weight / FIXED
                    else:
                        total += weight * (held.word_base if lang == WORDS else held.gram_base).astype(np.float64)
                best = int(np.argmax(total))
                found.append((held.languages[best], float(1.0 / np.exp(total - total[best]).sum())))
            yield {"_row": batch.column("_row"), "_id": batch.column("_id"), "lang_pred": [f[0] for f in found],
                   "score": [f[1] for f in found]}

    judged = map_batches(whole, judge, f"_row long, _id {kind}, lang_pred string, score double")
    return judged.orderBy("_row").drop("_row").withColumnRenamed("_id", id_col)


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3
