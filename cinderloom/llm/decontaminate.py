"""Benchmark decontamination with a generalised suffix automaton (operator 1).

The normalised words of all benchmark items go into one generalised suffix automaton. Document
words stream through it; at each word the automaton holds the longest run of words ending there
that some item contains. A run of ``window`` words or more (or a whole item that is shorter) makes
its words hits. Before streaming, runs of words that no match can touch are skipped: every match of
L words is made of item ``SEED``-grams (shorter ones where the window is), so positions outside long enough runs of seeds cannot match.
That is lossless and vectorised; the automaton alone decides what is a hit, on words compared letter by letter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderloom.llm import _words
from cinderloom.llm._shared import append_columns, written

SEED = 4
#: Words of all items together that one automaton may hold (some 300 bytes of memory a word); more are looked for automaton after automaton.
MAX_ITEM_WORDS = 2_000_000
#: Characters that count as one word when items are dealt to automata.
WORD_CHARS = 4


class SuffixAutomaton:
    """Generalised suffix automaton over word hashes, with the items that own each state."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.owners: list[set[int]] = [set() for _ in self.next]
        self.short: list[dict[int, set[int]]] = [{} for _ in self.next]
        self.names = [name for name, _ in items]
        for i, (_, words) in enumerate(items):
            self._own(i, words)
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        #: Nearest state on the path of suffix links, itself included, that ends a whole short item.
        self.ending = [0] * len(self.next)
        for v in order[1:]:
            self.ending[v] = v if self.short[v] else self.ending[self.link[v]]

    def _extend(self, last: int, w: int) -> int:
        seen = self.next[last].get(w)
        if seen is not None:
            return seen if self.length[seen] == self.length[last] + 1 else self._split(last, w, seen)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _own(self, i: int, words: list[int]) -> None:
        v = 0
        for w in words:
            v = self.next[v][w]
            u = v
            while u > 0 and self.length[u] >= self.window and i not in self.owners[u]:
                self.owners[u].add(i)
                u = self.link[u]
        if 0 < len(words) < self.window:
            while self.length[self.link[v]] >= len(words):
                v = self.link[v]
            self.short[v].setdefault(len(words), set()).add(i)

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans (first word, end) of windows, in order of their ends, and the items they are from."""
        spans, found, window = [], set(), self.window
        v = length = 0
        for p, w in enumerate(words):
            while v and w not in self.next[v]:
                v = self.link[v]
                length = self.length[v]
            step = self.next[v].get(w)
            if step is None:
                length = 0
                continue
            v, length = step, length + 1
            if length >= window:
                u = v
                while self.length[self.link[u]] >= window:
                    u = self.link[u]
                found |= self.owners[u]
                spans.append((p - window + 1, p + 1))
            u, most = self.ending[v], length
            while u:
                for n, owners in self.short[u].items():
                    if n <= most:
                        found |= owners
                        spans.append((p - n + 1, p + 1))
                u = self.ending[self.link[u]]
        return spans, found


class Matcher(NamedTuple):
    """What each task needs: the automaton and the seeds that find where it has work."""

    automaton: SuffixAutomaton
    words: dict[bytes, int]  # the number of each word of the items
    seed: int  # words of a seed
    seeds: np.ndarray
    least: int  # words of the shortest match that is made of seeds
    tiny: list[tuple[int, np.ndarray]]  # (words, hashes) of items too short for a seed
    bitmap: np.ndarray


def _bitmap(values: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 22, dtype=bool)
    bits[values >> np.uint64(42)] = True
    return bits


def build(items: list[tuple[str, str | None]], window: int) -> Matcher:
    cut, known, seed = [], {}, min(SEED, window)
    for name, text in items:
        for _, words in _words.batches([text]):
            blob = words.blobs[0].lower()
            numbers = [known.setdefault(blob[a:b], len(known)) for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]
            cut.append((name, words.hashes, numbers))
    cut = [x for x in cut if x[2]]
    long = [h for _, h, _ in cut if len(h) >= seed]
    seeds = np.unique(np.concatenate([_words.grams(h, seed) for h in long] or [np.empty(0, np.uint64)]))
    tiny = [(n, np.unique(np.concatenate(hs))) for n in range(1, seed) if (hs := [_words.grams(h, n) for _, h, _ in cut if len(h) == n])]
    least = min([window, *(len(h) for h in long)])
    return Matcher(SuffixAutomaton([(n, numbers) for n, _, numbers in cut], window), known, seed, seeds, least, tiny, _bitmap(seeds))


def _inside(first: np.ndarray, positions: np.ndarray, n: int) -> np.ndarray:
    """Those positions whose n words lie in one text."""
    text = np.searchsorted(first, positions, side="right") - 1
    return positions[positions + n <= first[text + 1]]


def _stretches(m: Matcher, words: _words.Words) -> list[tuple[int, int]]:
    """Word ranges, each inside one text, that hold every possible match."""
    ranges = []
    if len(m.seeds):
        g = _words.grams(words.hashes, m.seed)
        near = np.flatnonzero(m.bitmap[g >> np.uint64(42)])
        at = np.searchsorted(m.seeds, g[near])
        near = near[m.seeds[np.minimum(at, len(m.seeds) - 1)] == g[near]]
        near = _inside(words.first, near, m.seed)
        if len(near):
            text = np.searchsorted(words.first, near, side="right")
            new = np.flatnonzero(np.concatenate(([True], (np.diff(near) != 1) | (np.diff(text) != 0))))
            starts, ends = near[new], near[np.concatenate((new[1:], [len(near)])) - 1] + m.seed
            keep = ends - starts >= m.least
            ranges += zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)
    for n, known in m.tiny:
        g = _words.grams(words.hashes, n)
        at = np.minimum(np.searchsorted(known, g), len(known) - 1)
        ranges += ((p, p + n) for p in _inside(words.first, np.flatnonzero(known[at] == g), n).tolist())
    ranges.sort()
    merged: list[tuple[int, int]] = []
    borders = set(words.first.tolist())
    for s, e in ranges:
        if merged and s < merged[-1][1] or merged and s == merged[-1][1] and s not in borders:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged


def _same_words(m: Matcher, words: _words.Words, s: int, e: int) -> list[int]:
    """Numbers of words s to e, -1 for what is no word of the items: words are compared by their bytes, hashes only tell where to look."""
    text = int(np.searchsorted(words.first, s, side="right")) - 1
    at, blob = int(words.at[text]), words.blobs[text]
    spans = zip((words.starts[s:e] - at).tolist(), (words.ends[s:e] - at).tolist(), strict=True)
    return [m.words.get(blob[a:b].lower(), -1) for a, b in spans]


def _hits(m: Matcher, words: _words.Words) -> tuple[dict[int, set[str]], dict[int, list[tuple[int, int]]]]:
    """By text the items found, and the hit word ranges in order, apart from each other and counted from the text's first word."""
    items: dict[int, set[str]] = {}
    spans: dict[int, list[tuple[int, int]]] = {}
    for s, e in _stretches(m, words):
        windows, found = m.automaton.stream(_same_words(m, words, s, e))
        if windows:
            text = int(np.searchsorted(words.first, s, side="right")) - 1
            items.setdefault(text, set()).update(m.automaton.names[x] for x in found)
            s -= int(words.first[text])
            spans.setdefault(text, []).extend((s + a, s + b) for a, b in windows)
    return items, {text: _merged(found) for text, found in spans.items()}


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _shards(items: DataFrame, window: int, most_words: int) -> Iterator[Matcher]:
    """An automaton for each share of the items; the driver holds one share at a time."""
    chars = items.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    n = max(1, -(-chars // (WORD_CHARS * most_words)))
    dealt = items.distinct().withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    for k in range(n):
        yield build([(r.i, r.t) for r in dealt.filter(F.col("shard") == k).drop("shard").collect()], window)


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_span: int = 10, max_coverage: float = 0.5, clean: bool = True, prefix: str = "", most_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """Every row of ``docs`` with what of it is benchmark text, all its columns kept.

    New columns: ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``n_items`` and
    ``items_sha256`` (items with occurring windows), ``contaminated``; and with ``clean`` also
    ``clean_text`` (the text without the hit spans of ``max_span`` words or more) and ``dropped`` (more than
    ``max_coverage`` of its words are hits: not worth keeping). ``prefix`` goes before these names; one that is taken gets
    underscores (free_name).

    Items of more than about ``most_words`` words are dealt to several automata (an item of its own beyond that to one); documents stream
    through one after the other, what was found is written between them and put together in the end. Nothing is left out.

    Defined cases: a null or empty text has no words and no hits; null or wordless items match
    nothing; a null item_id counts as ''; an item given twice counts once for each different id; an
    empty benchmark leaves all documents clean; empty ``docs`` give no rows; repeated rows and ids are looked at each. Words of very long
    texts are cut in pieces; memory is a few times the text.
    """
    picked = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    names = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())]
    if clean:
        names += [("clean_text", T.StringType()), ("dropped", T.BooleanType())]
    matchers, columns, found = _shards(picked, window, most_words), docs.columns, []
    m, after = next(matchers), next(matchers, None)
    while after is not None:
        fields = [T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
        docs = written(append_columns(docs, text, fields, _finding(docs, m), also=found), "found")
        found = docs.columns[-2:]
        m, after = after, next(matchers, None)
    fields = [T.StructField(prefix + n, t) for n, t in names]
    out = append_columns(docs, text, fields, _reporting(docs, m, clean, max_span, max_coverage), also=found)
    return out.select(*[F.col(f"`{c}`") for c in columns], *[F.col(f"`{c}`") for c in out.columns[-len(names) :]])


def _together(i: int, mine: tuple[dict, dict], spans: list | None, items: list | None) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans and items of a text with those that earlier automata found."""
    own, found = list(mine[1].get(i, ())), set(mine[0].get(i, ()))
    if spans is not None:
        own = _merged([*own, *zip(spans[::2], spans[1::2], strict=True)])
        found.update(items)
    return own, found


def _finding(docs: DataFrame, m: Matcher):
    shared = docs.sparkSession.sparkContext.broadcast(m)  # MAX_ITEM_WORDS

    def make():
        def compute(texts: list, spans: list | None = None, items: list | None = None) -> list[pa.Array]:
            a, b = [], []
            for first, words in _words.batches(texts):
                mine = _hits(shared.value, words)
                for i in range(len(words.blobs)):
                    own, found = _together(i, mine, spans and spans[first + i], items and items[first + i])
                    a.append([x for span in own for x in span])
                    b.append(sorted(found))
            return [pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.string()))]

        return compute

    return make


def _reporting(docs: DataFrame, m: Matcher, clean: bool, max_span: int, max_coverage: float):
    shared = docs.sparkSession.sparkContext.broadcast(m)  # MAX_ITEM_WORDS
    kinds = [T.LongType, T.LongType, T.LongType, T.StringType, T.BooleanType] + ([T.StringType, T.BooleanType] if clean else [])

    def make():
        nothing = hashlib.sha256(b"").hexdigest()

        def compute(texts: list, spans: list | None = None, items: list | None = None) -> list[pa.Array]:
            columns: list[list] = [[] for _ in kinds]
            for first, words in _words.batches(texts):
                mine = _hits(shared.value, words)
                for i, blob in enumerate(words.blobs):
                    own, found = _together(i, mine, spans and spans[first + i], items and items[first + i])
                    n, n_hit = int(words.first[i + 1] - words.first[i]), sum(b - a for a, b in own)
                    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest() if found else nothing
                    row = [n, n_hit, len(found), digest, n_hit > 0]
                    if clean:
                        row += [_cut_out(blob, words, i, own, max_span), n_hit > max_coverage * n] if n_hit else [texts[first + i], False]
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            return [pa.array(c, type=_ARROW[k]) for c, k in zip(columns, kinds, strict=True)]

        return compute

    return make


_ARROW = {T.LongType: pa.int64(), T.StringType: pa.string(), T.BooleanType: pa.bool_()}


def _cut_out(blob: bytes, words: _words.Words, i: int, spans: list[tuple[int, int]], max_span: int) -> str:
    at, own, kept, done = int(words.at[i]), int(words.first[i]), [], 0
    for a, b in spans:
        if b - a >= max_span:
            kept.append(blob[done : int(words.starts[own + a]) - at])
            done = int(words.ends[own + b - 1]) - at
    return b"".join([*kept, blob[done:]]).decode("utf-8", "surrogatepass")
