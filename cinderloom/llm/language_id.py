"""Language identification by nearest centroid (operator 4).

A text becomes a TF-IDF vector of hashed letter pairs and triples, scaled to length one. Each language has
several centroids, from spherical k-means over its training vectors. The nearest centroid by cosine
names the language. A vector too far from its centroid is rejected: how near is near enough depends on how many
different pairs and triples the text has, since the vector of a short text fills little of any centroid. The least
cosine accepted is learnt for each power of two of that number, from training texts and short pieces of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderloom.llm._shared import append_columns

DIMS = 4096
#: Bounds on the sample of training rows: of each language, and of all together (each language has at least LEAST_ROWS).
FIT_ROWS, ALL_ROWS, LEAST_ROWS = 400, 40_000, 8
CENTROIDS = 4
#: Rows that a centroid must be nearest to; smaller clusters are given up.
LEAST_CLUSTER = 8
#: A text is rejected below this share of the cosine that all but one in 200 training texts and pieces of its length reach.
REJECT_SHARE, LOW = 0.8, 0.005
#: Words of the pieces of training texts that show what short texts look like.
PIECE_WORDS = (1, 2, 4, 8, 16)
#: Powers of two of the number of different pairs and triples.
LENGTHS = 13
UNKNOWN = "und"
#: Code points worked on at once.
_BATCH = 1 << 20

_letters: dict[str, np.ndarray] = {}


def _letter_table() -> np.ndarray:
    """Code point -> itself if it is a letter, else a space."""
    if "t" not in _letters:
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
        _letters["t"] = np.where(letter, np.arange(0x110000), 32).astype(np.uint32)
    return _letters["t"]


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x DIMS) counts of hashed letter pairs and triples over whole texts, and which texts have a letter."""
    table = _letter_table()
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    lettered = np.zeros(len(texts), dtype=bool)
    for i, text in enumerate(texts):
        if not text:
            continue
        text = f" {text.lower()} "
        for a in range(0, len(text) - 1, _BATCH):
            # Pairs and triples that start in this piece; two code points more complete them.
            c = table[np.frombuffer(text[a : a + _BATCH + 2].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
            space = c == 32
            lettered[i] |= not space.all()
            pair = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
            triple = (pair[:-1] * np.uint32(0x85EBCA77) + c[2:]) * np.uint32(0xC2B2AE3D)
            pair, both = (pair * np.uint32(0x27D4EB2F))[:_BATCH], (space[:-1] & space[1:])[:_BATCH]
            h = np.concatenate((pair[~both], triple[~space[1:-1]])) >> np.uint32(20)
            out[i] += np.bincount(h.astype(np.int64), minlength=DIMS)
    return out, lettered


def _weighed(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


class Model(NamedTuple):
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]  # of each centroid
    floor: np.ndarray  # least cosine accepted, of each centroid and length

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, cosine of its nearest centroid and whether it is too far, of each text."""
        names, scores, far = [], [], []
        for a in range(0, len(texts), 64):
            tf, lettered = counts(texts[a : a + 64])
            if not len(self.centroids):
                lettered[:] = False
            length = _length(tf)
            cosine = _weighed(tf, self.idf) @ self.centroids.T if len(self.centroids) else np.zeros((len(tf), 1))
            best = cosine.argmax(axis=1)
            for i, j in enumerate(best.tolist()):
                s = float(min(max(cosine[i, j], 0.0), 1.0)) if lettered[i] else 0.0
                names.append(self.languages[j] if lettered[i] else UNKNOWN)
                scores.append(s)
                far.append(bool(not lettered[i] or s < self.floor[j, length[i]]))
        return names, scores, far


def _length(tf: np.ndarray) -> np.ndarray:
    """Power of two of the number of different pairs and triples."""
    return np.minimum(np.log2(np.maximum((tf > 0).sum(axis=1), 1)).astype(int), LENGTHS - 1)


def _clusters(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts are drawn by their distance from earlier ones (seeded), clusters of a few odd texts are given up."""
    rng = np.random.default_rng(len(v))
    starts = [int(rng.integers(len(v)))]
    while len(starts) < min(k, len(v)):
        far = np.maximum(1 - (v @ v[starts].T).max(axis=1), 0) ** 2
        if far.sum() <= 1e-9:
            break
        starts.append(int(rng.choice(len(v), p=far / far.sum())))
    c = v[starts]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        held = np.bincount(own, minlength=len(c))
        least = min(LEAST_CLUSTER, int(held.max()))
        c = np.stack([v[own == j].mean(axis=0) for j in range(len(c)) if held[j] >= least])
        c /= np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)
    return c


def _pieces(text: str) -> list[str]:
    """Runs of a few words from the middle of a text, for each of PIECE_WORDS that is shorter than it."""
    words = text.split()
    return [" ".join(words[len(words) // 2 :][:n]) for n in PIECE_WORDS if n <= len(words) // 2]


def fit(docs: DataFrame, *, learn: Column, text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS, all_rows: int = ALL_ROWS, centroids: int = CENTROIDS) -> Model:
    """Centroids from rows where ``learn`` holds, ``lang`` is not null and the text has a letter.

    The sample is bounded: different texts, the least by a hash, ``fit_rows`` of each language and fewer where languages are so many that
    ``all_rows`` would be passed. Every language is learnt. Sparse counts of those rows, not texts, go to the driver.
    """
    known = docs.filter(learn).select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    known = known.withColumn("h", F.xxhash64("text"))
    # Copies count once. A cut by hash leaves some twice the texts wanted of a language, however large it is.
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    none = Model(np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [], np.zeros((0, LENGTHS)))
    if not sizes:
        return none
    rows_each = max(LEAST_ROWS, min(fit_rows, all_rows // len(sizes)))
    cuts = docs.sparkSession.createDataFrame([(k, 2.0 * rows_each / max(n, 1)) for k, n in sizes.items()], "lang string, cut double")
    near = known.join(F.broadcast(cuts), "lang").filter(F.pmod("h", F.lit(1 << 31)) / float(1 << 31) < F.col("cut")).select("lang", "text", "h")  # a row a language
    order = Window.partitionBy("lang").orderBy("h")
    chosen = near.select("lang", "h").distinct().withColumn("k", F.row_number().over(order)).filter(F.col("k") <= rows_each).drop("k")
    rows = near.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"])  # rows_each a language

    def sparse(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            named = [(name, part, i > 0) for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, part in enumerate([t, *_pieces(t)])]
            for a in range(0, len(named), 256):
                some = named[a : a + 256]
                tf, lettered = counts([t for _, t, _ in some])
                at = [np.flatnonzero(x) for x in tf]
                columns = [pa.array([n for n, _, _ in some]), pa.array([x for _, _, x in some])]
                columns += [pa.array([i.astype(np.int16).tobytes() for i in at]), pa.array([x[i].tobytes() for x, i in zip(tf, at, strict=True)]), pa.array(lettered)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "piece", "at", "tf", "ok"])

    made = rows.select("lang", "text").mapInArrow(sparse, "lang string, piece boolean, at binary, tf binary, ok boolean").filter("ok").collect()
    got = sorted((r["lang"], r["piece"], bytes(r["at"]), bytes(r["tf"])) for r in made)
    whole, pieces = ([(n, np.frombuffer(a, np.int16), np.frombuffer(t, np.float32)) for n, p, a, t in got if p == kind] for kind in (False, True))
    return train(whole, pieces, centroids) if whole else none


def _dense(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> np.ndarray:
    tf = np.zeros((len(rows), DIMS), dtype=np.float32)
    for i, (_, at, n) in enumerate(rows):
        tf[i, at] = n
    return tf


def train(whole: list[tuple[str, np.ndarray, np.ndarray]], pieces: list[tuple[str, np.ndarray, np.ndarray]], centroids: int = CENTROIDS) -> Model:
    """From (language, places, counts) of whole texts, which make the centroids, and of pieces, which help to set the floors."""
    seen = np.zeros(DIMS)
    for _, at, _ in whole:
        seen[at] += 1
    idf = (np.log((1 + len(whole)) / (1 + seen)) + 1).astype(np.float32)
    made, owner, floor = [], [], []
    for name in sorted({n for n, _, _ in whole}):
        tf = _dense([r for r in whole if r[0] == name])
        c = _clusters(_weighed(tf, idf), centroids)
        tf = np.concatenate((tf, _dense([r for r in pieces if r[0] == name])))
        best, length = (_weighed(tf, idf) @ c.T).max(axis=1), _length(tf)
        low = [float(np.quantile(best[length == n], LOW)) if (length == n).any() else np.nan for n in range(LENGTHS)]
        # A length that no text has takes the floor of the next shorter one, the first ones none.
        for n in range(LENGTHS):
            low[n] = (low[n - 1] if n else 0.0) if np.isnan(low[n]) else low[n]
        made.append(c)
        owner += [name] * len(c)
        floor += [[REJECT_SHARE * x for x in low]] * len(c)
    return Model(idf, np.concatenate(made).astype(np.float32), owner, np.array(floor))


def identify(docs: DataFrame, model: Model, *, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with the predicted language, its score (cosine, 0 to 1) and whether it is rejected.

    Texts that are null, empty or without a letter are ``und``, score 0, rejected; so is everything where
    no language was learnt. Ties go to the first language by name. Repeated texts get equal results, very long ones are
    counted whole. All columns of ``docs`` are kept; a name that is taken gets underscores (free_name). Empty tables give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS x DIMS floats a language: 64 KB each

    def make():
        def compute(texts: list) -> list[pa.Array]:
            lang, score, far = shared.value.predict(texts)
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())]

        return compute

    return append_columns(docs, text, [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())], make)
