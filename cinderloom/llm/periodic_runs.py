"""Periodic runs of words by block convolution (operator 12).

A run is a longest stretch of words in which words q apart are equal, q being its smallest period, of at least
LEAST words and TIMES periods. For the scale B = 1, 2, 4... a text is cut into aligned blocks of B words. A run
with B <= q < 2B holds a block and, q words on, the same block again. So for each block the squared differences
to the B windows that begin B to 2B - 1 words on are summed by a number-theoretic transform, in whole numbers: a sum of zero
is an occurrence without mismatch, and its distance seeds an extension, word by word, to both sides. The sums
are modulo a prime, which can only add seeds, and the extension looks at the words themselves, so no run is missed or made up.

What cannot seed a run is left out before the transform: blocks with a word that does not come again within 2B words, and
blocks that lie with their windows in a run already found (their distances are multiples of its period).

Many texts are one array with words of their own between them, so a scale is a few array operations for all of them.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cinderloom.llm._shared import append_columns

LEAST, TIMES = 6, 4
#: 15 * 2**27 + 1: transforms of up to 2**27 words; products of two residues fit 64 bits.
PRIME, ROOT, TWOS = 2013265921, 31, 27
#: Words of several texts looked at together, and elements of one array of windows.
BATCH_WORDS, CELLS = 1 << 18, 1 << 20
_P = np.uint64(PRIME)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _twiddles(h: int, inverse: bool) -> np.ndarray:
    """Powers 0..h-1 of a root of unity of order 2h."""
    if (h, inverse) not in _powers:
        w = pow(ROOT, (PRIME - 1) // (2 * h), PRIME)
        w = pow(w, -1, PRIME) if inverse else w
        out = np.ones(1, dtype=np.uint64)
        while len(out) < h:
            out = np.concatenate((out, out * np.uint64(pow(w, len(out), PRIME)) % _P))
        _powers[h, inverse] = out
    return _powers[h, inverse]


def transformed(rows: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row (length a power of two); the values come out in bit-reversed order."""
    a = rows.copy()
    h = a.shape[1] // 2
    while h:
        v = a.reshape(len(a), -1, 2, h)
        x, y = v[:, :, 0, :].copy(), v[:, :, 1, :]
        low = (x + y) % _P
        v[:, :, 1, :] = (x + _P - y) * _twiddles(h, False) % _P
        v[:, :, 0, :] = low
        h //= 2
    return a


def restored(rows: np.ndarray) -> np.ndarray:
    """The inverse of transformed()."""
    a = rows.copy()
    n, h = a.shape[1], 1
    while h < n:
        v = a.reshape(len(a), -1, 2, h)
        x, y = v[:, :, 0, :].copy(), v[:, :, 1, :] * _twiddles(h, True) % _P
        v[:, :, 0, :] = (x + y) % _P
        v[:, :, 1, :] = (x + _P - y) % _P
        h *= 2
    return a * np.uint64(pow(n, -1, PRIME)) % _P


def block_matches(t: np.ndarray, squares: np.ndarray, starts: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of each block of ``b`` words whose squared differences to the words ``distance`` on, b to 2b - 1, sum to zero.

    ``t`` is padded by 3b words at least; ``squares`` are the running sums of its squared values modulo the prime.
    """
    found = []
    step = max(1, CELLS // (2 * b))
    for i in range(0, len(starts), step):
        s = starts[i : i + step]
        window = t[s[:, None] + np.arange(b, 3 * b)]
        block = np.zeros((len(s), 2 * b), dtype=np.uint64)
        block[:, :b] = t[s[:, None] + np.arange(b - 1, -1, -1)]
        products = restored(transformed(window) * transformed(block) % _P)[:, b - 1 : 2 * b - 1]
        own = squares[s + b] - squares[s]
        at = s[:, None] + np.arange(b, 2 * b)
        total = own[:, None] + squares[at + b] - squares[at]
        row, k = np.nonzero(total % _P == 2 * products % _P)
        found.append((s[row], k + b))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _reach(t: np.ndarray, at: np.ndarray, d: np.ndarray, step: int) -> np.ndarray:
    """How many words from each position on (step 1) or back (-1) equal those ``d`` further; a mismatch is certain before the array ends."""
    out, live, width = np.zeros(len(at), dtype=np.int64), np.arange(len(at)), 16
    while len(live):
        unlike = []
        for i in range(0, len(live), max(1, CELLS // width)):
            part = live[i : i + max(1, CELLS // width)]
            spot = at[part, None] + step * (out[part, None] + np.arange(width))
            # Beyond either end the word of that end stands, which equals no other.
            left, right = np.clip(spot, 0, len(t) - 1), np.clip(spot + d[part, None], 0, len(t) - 1)
            unlike.append((t[left] != t[right]) | (spot < 0) | (left == right))
        unlike = np.concatenate(unlike)
        ends = unlike.any(axis=1)
        out[live] += np.where(ends, unlike.argmax(axis=1), width)
        live, width = live[~ends], min(width * 2, 1 << 14)
    return out


def find_runs(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run of whole numbers below the prime; ``longest`` bounds a run's length. The first and the last number come once."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    again = np.flatnonzero(words[order[1:]] == words[order[:-1]])
    gap = np.full(n, n + 1)
    gap[order[again]] = order[again + 1] - order[again]
    cover, seen, b = np.zeros(n, dtype=np.int64), {}, 1
    while TIMES * b <= longest:
        blocks = n // b
        starts = np.flatnonzero((gap[: blocks * b] < 2 * b).reshape(blocks, b).all(axis=1)) * b
        starts = starts[cover[starts] < starts + 3 * b - 1]
        if len(starts):
            t = np.concatenate((words, np.full(8 * b, words[-1]))).astype(np.uint64)
            squares = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(t * t % _P)))
            s, d = block_matches(t, squares, starts, b)
            keep = cover[s] < s + d + b
            s, d = s[keep], d[keep]
            # A run's first block has at least two more periods behind it; of a stretch's blocks the first is enough.
            keep = (t[s + d] == t[s + 2 * d]) & (t[s + 2 * d] == t[s + 3 * d])
            s, d = s[keep], d[keep]
            keys = s // b * (2 * b) + d
            first = ~np.isin(keys - 2 * b, keys)
            s, d = s[first], d[first]
            right = _reach(words, s, d, 1)
            s, d, right = (x[right >= b] for x in (s, d, right))
            a, e = s - _reach(words, s - 1, d, -1), s + right + d
            long = e - a >= np.maximum(LEAST, TIMES * d)
            for x, y, q in sorted({*zip(a[long].tolist(), e[long].tolist(), d[long].tolist(), strict=True)}, key=lambda r: r[2]):
                if (x, y) not in seen:
                    seen[x, y] = q
                    np.maximum(cover[x:y], y, out=cover[x:y])
        b *= 2
    found = np.array(sorted((x, q, y) for (x, y), q in seen.items()), dtype=np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 2], found[:, 1]


class _Numbers(dict):
    """A number for each word, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _of_batch(texts: list[list[bytes]]) -> tuple[list[list[dict]], list[bytes]]:
    """Runs and collapsed text of each list of words."""
    number = _Numbers()
    ids = [list(map(number.__getitem__, w)) for w in texts]
    first = np.concatenate(([0], np.cumsum([len(w) + 1 for w in texts]))) + 1
    flat = np.arange(len(number), len(number) + first[-1], dtype=np.int64)
    for at, own in zip(first.tolist(), ids, strict=False):
        flat[at : at + len(own)] = own
    start, end, period = find_runs(flat, max(map(len, texts)))
    owner = np.searchsorted(first, start, side="right") - 1
    runs, dropped = [[] for _ in texts], np.zeros(len(flat) + 1, dtype=np.int64)
    for k, a, e, q in zip(owner.tolist(), start.tolist(), end.tolist(), period.tolist(), strict=True):
        runs[k].append({"start": a - int(first[k]), "length": e - a, "period": q})
        dropped[a + q] += 1
        dropped[e] -= 1
    kept = np.cumsum(dropped) == 0
    collapsed = [b" ".join(compress(w, kept[at : at + len(w)].tolist()) if r else w) for w, r, at in zip(texts, runs, first.tolist(), strict=False)]
    return runs, collapsed


RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` and, for each row, n_words, runs (array of start, length and period, by start and period) and collapsed_text.

    Words are the stretches between ASCII white space, numbered from 0. A word goes from the collapsed text, which has
    single spaces, if a run holds it after that run's first period.

    Defined cases: null, empty and blank texts have no words, no runs and an empty collapsed text; texts are looked at whole,
    each in one task's memory, however long; repeated rows get equal results; columns that ``docs`` has under
    these names are kept and the new ones get underscores; an empty table gives no rows.
    """

    def make():
        def compute(texts: list) -> list[pa.Array]:
            sizes, runs, collapsed, held, total = [], [], [], [], 0

            def flush() -> None:
                nonlocal total
                if held:
                    found = _of_batch(held)
                    runs.extend(found[0])
                    collapsed.extend(x.decode("utf-8", "surrogatepass") for x in found[1])
                    held.clear()
                    total = 0

            for t in texts:
                held.append(t.encode("utf-8", "surrogatepass").split() if t else [])
                sizes.append(len(held[-1]))
                total += sizes[-1] + 1
                if total >= BATCH_WORDS:
                    flush()
            flush()
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
            return [pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.string())]

        return compute

    return append_columns(docs, text, [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed_text", T.StringType())], make)
