"""Spelling variants through a bit-sliced position index (operator 11).

Two words are near if one inserted, deleted or replaced code point makes one the other. Steps:

1. Words are counted over all documents; from there on only the vocabulary is worked on.
2. One edit leaves the first half or the second half of a word as it is. So a word of length L goes to the groups of its halves
   for pairs whose shorter word has length L, and for those whose shorter word has L - 1. Each near pair meets in the group of its first
   half, or else of its second. A group of more than BLOCK words is dealt to parts, and every part of the index meets every part of the queries in a
   unit of its own, so a unit is bounded however many words share a half.
3. In a unit, the index has a bitset over the unit's words for each (position, letter). A query word is led through it letter by letter with
   three sets: the words without error so far, those with one replaced letter, and those with one letter more, which read the position
   one further on. A step is a few operations on whole bitsets.
4. A unit returns for each word how many words are near and the best of them, not the pairs.

A word's form is its most frequent near word if that is at least RATIO times as frequent, so forms lead to ever more frequent
words and end; the last is found by doubling the steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderloom.llm._shared import written

LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Words of one part of a group.
BLOCK = 4096


def lowered(word: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(word.rlike("[A-Z]"), F.translate(word, upper, upper.lower())).otherwise(word)


def occurrences(docs: DataFrame, *, text: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, word): each run of letters of each whole text, lower-cased, of at least ``least_length`` code points."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(LETTERS), 0)).alias("word"))
    return runs.filter(F.length("word") >= least_length).select("doc_id", lowered(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


class Index:
    """Bitsets over words of length m and m + 1: bit i of the set of (position, letter) is word i's."""

    def __init__(self, words: list[str], m: int):
        self.m, self.all, self.shorter = m, (1 << len(words)) - 1, 0
        places: dict[tuple[int, str], list[int]] = {}
        for i, word in enumerate(words):
            if len(word) == m:
                self.shorter |= 1 << i
            for place in enumerate(word):
                places.setdefault(place, []).append(i)
        self.sets = {}
        for place, members in places.items():
            bits = bytearray(len(words) // 8 + 1)
            for i in members:
                bits[i >> 3] |= 1 << (i & 7)
            self.sets[place] = int.from_bytes(bits, "little")

    def near(self, query: str, half: int, second: bool) -> int:
        """The words that one replacement in ``query`` (of length m) or one letter more makes; with ``second`` only those that
        differ from it in its first ``half`` letters."""
        clean, replaced, longer, same_half = self.all, 0, self.all, 0 if half else self.all
        for i, letter in enumerate(query):
            here = self.sets.get((i, letter), 0)
            replaced = (replaced & here) | (clean & ~here)
            clean &= here
            longer = (longer & self.sets.get((i + 1, letter), 0)) | clean
            if i == half - 1:
                same_half = clean
        found = (replaced & self.shorter) | (longer & ~self.shorter)
        return found & ~same_half if second else found


def _members(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _of_unit(m: int, second: bool, indexed: list[tuple[str, int]], queries: list[tuple[str, int]]) -> dict[str, list]:
    """For each word with near ones in the unit: their number and the most frequent (ties: the least) with its count."""
    best: dict[str, list] = {}

    def add(word: str, near: str, n: int) -> None:
        have = best.setdefault(word, [0, -1, ""])
        have[0] += 1
        if n > have[1] or n == have[1] and near < have[2]:
            have[1:] = [n, near]

    index, half = Index([w for w, _ in indexed], m), m // 2
    for word, n in queries:
        for i in _members(index.near(word, half, second)):
            near, k = indexed[i]
            add(word, near, k)
            if len(near) > m:  # the longer word is no query here
                add(near, word, n)
    return best


def _units(words: DataFrame, block: int) -> DataFrame:
    """(m, second, part of the word, i, j, word, n, indexed): words of index part i and query part j of each group."""
    length = F.length("word")

    def keys(m: Column) -> list[Column]:
        half = F.floor(m / 2).cast("int")
        first = F.struct(m.alias("m"), F.lit(False).alias("second"), F.substring("word", F.lit(1), half).alias("piece"))
        return [first, F.struct(m.alias("m"), F.lit(True).alias("second"), F.substring("word", length - (m - half) + 1, m - half).alias("piece"))]

    dealt = words.select("word", "n", F.explode(F.array(*keys(length), *keys(length - 1))).alias("g")).select("g.*", "word", "n").filter("m >= 0")
    key = ["m", "second", "piece"]
    sizes = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.count_if(F.length("word") == F.col("m")).alias("short")).filter("size > 1 and short > 0")
    parts = F.ceil(F.col("size") / block).cast("int")
    met = dealt.join(sizes.select(*key, parts.alias("parts")), key).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    indexed = F.transform(every, lambda x: F.struct(F.col("part").alias("i"), x.alias("j"), F.lit(True).alias("indexed")))
    asks = F.when(F.length("word") == F.col("m"), F.transform(every, lambda x: F.struct(x.alias("i"), F.col("part").alias("j"), F.lit(False).alias("indexed"))))
    roles = F.concat(indexed, F.coalesce(asks, F.array().cast("array<struct<i:int,j:int,indexed:boolean>>")))
    return met.select(*key, "word", "n", F.explode(roles).alias("u")).select(*key, "u.*", "word", "n")


def near_words(words: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(word, n_near, near, near_n) of each word of (word, n) that has near ones: ``near`` is the most frequent, ties the least."""
    key = ["m", "second", "piece", "i", "j"]
    units = _units(words, block).repartition(*key).sortWithinPartitions(*key)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, indexed, queries, rows = None, [], [], []
        names = ["word", "n_near", "near_n", "near"]

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())]))
                rows.clear()

        def close() -> None:
            if at and indexed and queries:
                rows.extend((w, *b) for w, b in _of_unit(at[0], at[1], indexed, queries).items())
            indexed.clear()
            queries.clear()

        for batch in found:
            columns = [batch.column(c).to_pylist() for c in (*key, "indexed", "word", "n")]
            for *unit, is_indexed, word, n in zip(*columns, strict=True):
                if unit != at:
                    close()
                    at = unit
                (indexed if is_indexed else queries).append((word, n))
            yield from flush()
        close()
        yield from flush()

    some = units.mapInArrow(run, "word string, n_near long, near_n long, near string")
    least = F.min(F.struct((-F.col("near_n")).alias("o"), "near")).alias("best")
    return some.groupBy("word").agg(F.sum("n_near").alias("n_near"), least).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.o")).alias("near_n"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form): where forms lead to. Steps are doubled until none goes further; the driver sees one row of the test."""
    step = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not step.join(on, "root", "left_semi").limit(1).count():
            return step
        step = written(step.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "forms")


def spelling_variants(words: DataFrame, *, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``words`` (distinct word, its count n): word, n, n_near, form, form_n, root.

    Defined cases: rows whose word is null are left out; an empty word is near to each one-letter word; words of any length and letters are taken, compared by
    code point; of equally frequent near words the least in code-point order is the form; a word without a form is its own root; an empty table gives
    no rows; other columns are not used. Of documents, null, empty and letterless texts give no words, texts are read whole, repeated rows count again.
    """
    own = written(words.filter("word is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(own, block=block)
    fits = F.col("near_n") >= ratio * F.col("n")
    found = own.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n"))
    found = written(found, "variants")
    out = found.join(last_forms(found.filter("form is not null")), "word", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
