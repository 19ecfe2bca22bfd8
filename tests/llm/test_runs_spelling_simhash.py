"""Spelling variants, periodic runs and SimHash components against brute force, and their odd inputs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cinderloom.llm import periodic_runs, queries, simhash, spelling

LOWER = {c: c + 32 for c in range(65, 91)}
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def written(spark, tmp_path, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


# Spelling variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_variants(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    best = {w: min(near[w], key=lambda x: (-counts[x], x)) for w in counts if near[w]}
    form = {w: b for w, b in best.items() if counts[b] >= 2 * counts[w]}
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None)
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_variants_against_brute_force(spark, block):
    """Short and long words, every kind of edit, ties, and groups dealt to many units."""
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé"), int(rng.integers(1, 9)))) for _ in range(400)} | {"", "receive", "recieve", "receeve", "x" * 300, "x" * 299 + "y", "x" * 301}
    counts = {w: int(rng.integers(1, 40)) for w in sorted(words)}
    table = spark.createDataFrame([(w, n, "clash") for w, n in counts.items()] + [(None, 3, "clash")], "word string, n long, form string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(table, block=block).collect()}
    assert got == brute_variants(counts)


def test_spelling_query_on_odd_texts(spark, tmp_path):
    """The query's own counting: deleted letters, null and long texts, rows without doc_id, repeated rows."""
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("abcDÉ"), int(rng.integers(4, 8)))) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(vocabulary, 30))) for i in range(150)] + [(7, None), (8, ""), (9, "12 - ..."), (None, "abcdé-abcde1 ABCDE"), (3, "abcde"), (3, "abcde"), (10, "longword×÷ß " * 20000)]
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    want = brute_variants({w: n for w, n in counts.items() if n >= 3 and len(w) >= 5})
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op11_spelling(spark, written(spark, tmp_path, rows)).collect()}
    assert got == want and len(want) > 20


def test_spelling_of_nothing(spark, empty):
    words = spelling.vocabulary(spelling.occurrences(empty))
    assert spelling.spelling_variants(words).count() == 0


# Periodic runs


def brute_runs(w):
    seen = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - a >= max(6, 4 * q):
                seen.setdefault((a, i + q), q)
    return sorted((a, e - a, q) for (a, e), q in seen.items())


def brute_loop(i, text):
    w = SPLIT.findall(text or "")
    h = zlib.crc32(str(i).encode())
    if i is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def test_transforms_are_exact():
    """A transform and its inverse, and products of rows as cyclic convolutions of whole numbers."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 16, 256):
        a, b = (rng.integers(0, 1 << 30, (2, n)).astype(np.uint64) for _ in range(2))
        assert (periodic_runs.restored(periodic_runs.transformed(a)) == a).all()
        got = periodic_runs.restored(periodic_runs.transformed(a) * periodic_runs.transformed(b) % np.uint64(periodic_runs.PRIME))
        for row in range(2):
            want = [sum(int(a[row, j]) * int(b[row, (k - j) % n]) for j in range(n)) % periodic_runs.PRIME for k in range(n)]
            assert got[row].tolist() == want


def test_runs_against_brute_force(monkeypatch):
    """Small alphabets, loops of every length, many texts in one batch and windows cut into many arrays."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(periodic_runs, "CELLS", 64)
    for _ in range(120):
        texts = []
        for _ in range(int(rng.integers(1, 5))):
            n = int(rng.integers(0, 160))
            w = [b"w%d" % x for x in rng.integers(0, rng.integers(1, 4), n)]
            if n > 8:
                a, p = int(rng.integers(0, n)), int(rng.integers(1, n // 3))
                w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
            texts.append(w)
        runs, collapsed = periodic_runs._of_batch(texts)
        for w, r, c in zip(texts, runs, collapsed, strict=True):
            want = brute_runs(w)
            assert [(x["start"], x["length"], x["period"]) for x in r] == want
            gone = {i for a, n, q in want for i in range(a + q, a + n)}
            assert c == b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_periodic_runs_query(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, "  ".join(rng.choice(list("abcdefghijklm"), int(rng.integers(0, 120)))) + "\n") for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t"), (203, "é é é é é é"), (203, "é é é é é é"), (None, "a b " * 40), (204, "x " * 30000 + "y z " * 20000), (205, "a b c d " * 3 + "a b c"), (206, "a b c d " * 4)]
    got = sorted(map(tuple, queries.op12_periodic_runs(spark, written(spark, tmp_path, rows)).drop("n_words").collect()), key=repr)
    want = []
    for i, text in rows:
        w = brute_loop(i, text) if i != 204 or zlib.crc32(b"204") % 10 == 0 else None
        if w is None:  # two runs too long for brute force
            runs, w = [(0, 30000, 1), (30000, 40000, 2)], SPLIT.findall(text)
        else:
            runs = brute_runs(w)
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines, kept = "".join(f"{a},{n},{q}\n" for a, n, q in sorted(runs, key=lambda r: (r[0], r[2]))), " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(runs), *top, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))))
    assert got == sorted(want, key=repr)


def test_periodic_runs_keep_columns(spark, empty):
    own = spark.createDataFrame([(1, "a a a a a a b", "mine")], "doc_id long, text string, runs string")
    row = periodic_runs.periodic_runs(own).first()
    assert row.runs == "mine" and [tuple(r) for r in row.runs_] == [(0, 6, 1)] and row.collapsed_text == "a b" and row.n_words == 7
    assert periodic_runs.periodic_runs(empty).count() == 0


# SimHash components


def brute_print(text):
    w = SPLIT.findall((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """Component of each (doc_id, fingerprint): by all pairs."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(rows))]


@pytest.mark.parametrize("piece", [5, 1 << 20])
def test_fingerprints_against_brute_force(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    for text in ("", " \n", "One", "a B", "A b\tc", "x y z w  v\n é É q\x85r", "lorem ipsum dolor " * 40, " ".join(map(str, range(700)))):
        assert simhash.fingerprint(text.encode()) == brute_print(text)


def test_spark_hash_is_the_same(spark):
    """The shingle's hash is Spark's own xxhash64 of the string."""
    text = "ünï code shingle"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % 2**64 == xxhash.xxh64(text.encode(), seed=42).intdigest()


@pytest.mark.parametrize("tree", [8, 4096])
def test_links_against_all_pairs(spark, tree):
    """Chains and dense groups of fingerprints, in shards that are dealt to many units and in whole ones."""
    rng = np.random.default_rng(tree)
    base = rng.integers(0, 2**63, 15).astype(np.uint64)
    p = base[rng.integers(0, 15, 500)]
    for _ in range(5):
        p = np.where(rng.random(500) < 0.7, p ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)), p)
    p = np.unique(p)
    from cinderloom.llm.near_dedup import components

    links = simhash.near_links(spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "print long"), tree=tree)
    root = {r.node: r.root for r in components(links).collect()}
    got, want, seen = [root.get(int(x), int(x)) for x in p.view(np.int64)], brute_components([(i, int(x)) for i, x in enumerate(p)]), {}
    for a, b in zip(got, want, strict=True):
        assert seen.setdefault(a, b) == b and seen.setdefault(("back", b), a) == a


def test_simhash_query(spark, tmp_path, empty):
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(list("abcdefghijklmnop"), 60)) for _ in range(20)]
    rows = [(i, texts[i % 20] + " end" * (i % 3)) for i in range(80)] + [(90, None), (91, ""), (92, " "), (None, texts[0]), (None, "alone here"), (5, "other"), (5, "other"), (93, "Other"), (94, "word " * 100000)]
    got = sorted(map(tuple, queries.op13_simhash(spark, written(spark, tmp_path, rows)).collect()), key=repr)
    prints = [(i, brute_print(t)) for i, t in rows]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints), strict=True)]
    assert got == sorted(want, key=repr)
    assert simhash.simhash_components(empty).count() == 0
