"""Training-data operators against brute force, round trips and held-out accuracy, and their odd inputs."""

import hashlib
import re
import sys
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderloom.llm import _words, chat_format, decontaminate, fingerprint, language_id, mixing, near_dedup, quality, queries, token_counts, url_filter, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "One"), (5, "é" * 3 + " ÀB c9"), (6, "a b c d e f g h i j k l " * 3000), (7, "x y z"), (7, "x y z"), (None, "x y z")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame([(i, t, "k", 9) for i, t in ODD], "doc_id long, text string, score string, size int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def test_words_are_the_pattern():
    texts = [t for _, t in ODD] + ["Ünïcode, ÅB-cd 12_3", "\x00a\x7fb"]
    for first, w in _words.batches(texts):
        for i in range(len(w.blobs)):
            a, b = w.first[i], w.first[i + 1]
            got = [w.blobs[i][s - w.at[i] : e - w.at[i]].decode().translate(LOWER) for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)]
            assert got == words(texts[first + i])
    same = _words.cut([b"alpha beta", b"BETA  alpha"]).hashes
    assert same[0] == same[3] and same[1] == same[2] and same[0] != same[1]


def twins():
    """Two words of 2048 letters that any polynomial hash modulo 2**64 takes for one."""
    word, swap = "a", {97: 98, 98: 97}
    for _ in range(11):
        word += word.translate(swap)
    return word, word.translate(swap)


def test_words_that_polynomials_confuse(spark):
    """Such words are two in the hashes, in the items of a benchmark, and in near duplicates."""
    a, b = twins()
    assert len(set(_words.cut([f"{a} {b}".encode()]).hashes.tolist())) == 2
    rest = " ".join(f"w{i}" for i in range(9))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {b}"), (4, f"{b} {a}"), (5, f"{b}  {a.upper()}")], "doc_id long, text string")
    items = spark.createDataFrame([("x", f"{a} {rest}"), ("y", b)], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {1: (10, 1), 2: (1, 1), 3: (1, 1), 4: (1, 1), 5: (1, 1)}
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4}


def test_sequence_digests():
    """Equal for equal word sequences, whatever stands between the words; a border of words counts."""
    texts = ["aB c", "Ab\n\tC!", "", "...", "ab cd", "abc d", "é x", "É x", "a b c d"]
    one, two = _words.digests([t.encode() for t in texts])
    both = list(zip(one.tolist(), two.tolist(), strict=True))
    for i, j in combinations(range(len(texts)), 2):
        assert (both[i] == both[j]) == (words(texts[i]) == words(texts[j]))


def test_tokens_of_long_white_space(monkeypatch):
    """Runs of white space that the pattern cannot walk through are cut as it would cut them."""
    encoding = token_counts._encoder(token_counts.VOCABULARY)
    for text in (" " * 1_000_000, " " * 1_000_000 + "a", "a" + "\n" * 1_000_000 + "\tb"):
        assert token_counts.encoded_length(encoding, text) > 0
    monkeypatch.setattr(token_counts, "LONG_SPACE", 3)
    rng = np.random.default_rng(4)
    for _ in range(500):
        text = "".join(rng.choice(["a", "b1", "'s", " ", "  ", "\n", "\t", "\u3000", "\x85", "\x1c", ".", "é", "   ", "\r\n"], int(rng.integers(0, 14))))
        assert token_counts.encoded_length(encoding, text) == len(encoding.encode_ordinary(text))


def test_mixing_without_ids(spark):
    """A source whose rows have no doc_id comes as near its target as the others."""
    rows = [(None if i % 3 == 0 else i, f"t{i} " * (1 + i % 7), "abc"[i % 3]) for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r in out:
        taken, _ = by.get(round(r.target, 6), (0, 0))
        by[round(r.target, 6)] = (taken + r.taken, r.target)
    assert len(by) == 3 and all(0 <= target - taken < 8 for taken, target in by.values())


def brute_hits(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(window, len(v))
        for j in range(len(v) - n + 1) if n else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[j : j + n]:
                    hit |= set(range(i, i + n))
                    found.add(name)
    return len(w), len(hit), sorted(found)


def test_decontaminate_against_brute_force(spark):
    rng = np.random.default_rng(3)
    items = [(str(i), " ".join(rng.choice(list("abcd"), n))) for i, n in enumerate([30, 14, 10, 9, 6, 4, 3, 1, 0, 25])] + [("n", None), ("10", "a b")]
    docs = [(i, " ".join(rng.choice(list("abcdefgh"), 40)) + " " + (items[i % len(items)][1] or "")[: int(rng.integers(0, 60))]) for i in range(60)] + [(99, None), (98, "")]
    out = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    for r in out.collect():
        n, hit, found = brute_hits(r.text, items)
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found)) and r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r.contaminated == (hit > 0) and (hit or r.clean_text == r.text)


@pytest.mark.parametrize("window", [1, 2, 3, 6])
def test_decontaminate_with_small_windows_and_many_automata(spark, window):
    """Windows shorter than a seed, items dealt to many automata, repeated rows, clashing names, null ids."""
    rng = np.random.default_rng(window)
    items = [(str(i), " ".join(rng.choice(list("abcdefgh"), n))) for i, n in enumerate([12, 7, 5, 3, 2, 1, 9])] + [(None, "A b c d e f g h"), ("z", None)]
    docs = [(i, " ".join(rng.choice(list("abcdefghijklmnop"), 30))) for i in range(20)] + [(1, "a b"), (1, "a b"), (None, "a b c d e f g h a")]
    table = spark.createDataFrame([(*d, "own") for d in docs], "doc_id long, text string, n_hit string")
    for most in (10**6, 3):
        out = decontaminate.decontaminate(table, spark.createDataFrame(items, "item_id string, text string"), window=window, most_words=most)
        assert out.columns[:5] == ["doc_id", "text", "n_hit", "n_words", "n_hit_"] and out.count() == len(docs)
        for r in out.collect():
            n, hit, found = brute_hits(r.text, [(i or "", t) for i, t in items], window)
            assert (r.n_words, r.n_hit_, r.n_items) == (n, hit, len(found)) and r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_decontaminate_cuts_whole_spans(spark, odd, empty):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"before {passage.upper()}, after it all of this stays here as it was and more"), (2, passage)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, spark.createDataFrame([("q", passage)], "item_id string, text string")).collect()}
    assert got[1].clean_text == "before , after it all of this stays here as it was and more" and not got[1].dropped and got[2].dropped
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.decontaminate(odd, none).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(empty, none).count() == 0


def bag(text, n=5):
    w = words(text)
    return Counter(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else Counter()


def brute_classes(docs):
    """doc_id -> least id of its class, over all pairs."""
    bags, root = {i: bag(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(bags, 2):
        total = (bags[a] | bags[b]).total()
        if total and (bags[a] & bags[b]).total() >= 0.8 * total:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in bags}


def test_near_duplicates_against_all_pairs(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    base = docs[3][1].split(" ")
    docs += [(1000 + i, " ".join(base[:i] + ["zz"] + base[i:])) for i in range(0, 60, 5)] + [(2000, " ".join(base[: len(base) * 7 // 10]))]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_classes(docs)


def test_near_duplicates_recall_at_the_threshold(spark):
    """Of pairs whose likeness is barely over 0.8 (to 0.85) at least 0.9 are found; of those under it none."""
    rng, docs, over, under = np.random.default_rng(12), [], 0, 0
    for k in range(400):
        base = [f"{k}w{x}" for x in rng.integers(10_000, size=200)]
        copy = list(base)
        for at in rng.choice(np.arange(5, 195), 4 + k % 2, replace=False):
            copy[at] = f"{k}new{at}"
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    likeness = {}
    for k in range(400):
        a, b = bag(docs[2 * k][1]), bag(docs[2 * k + 1][1])
        likeness[k] = (a & b).total() / (a | b).total()
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    near = [k for k, x in likeness.items() if 0.8 <= x <= 0.85]
    found = sum(got[2 * k + 1] == 2 * k for k in near)
    assert len(near) > 50 and found >= 0.9 * len(near)
    assert all(got[2 * k + 1] == 2 * k + 1 for k, x in likeness.items() if x < 0.8)


def test_near_duplicates_odd_inputs(odd, empty):
    got = [(r.doc_id, r.class_id) for r in near_dedup.near_duplicates(odd).collect()]
    assert sorted(got, key=str) == sorted([(i, i) for i, _ in ODD], key=str)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_bag_min_hash_is_unbiased():
    rng, off = np.random.default_rng(5), []
    for k in range(30):
        shingles = np.sort(_words.mix(np.arange(50, dtype=np.uint64) + np.uint64(1000 * k)))
        a = rng.integers(1, 9, 50)
        b = np.where(rng.random(50) < 0.3, rng.integers(1, 9, 50), a)
        s = near_dedup.bag_min_hash([(shingles, a), (shingles, b)])
        assert (near_dedup.bag_min_hash([(shingles, b)])[0] == s[1]).all()
        off.append((s[0] == s[1]).mean() - near_dedup.jaccard((shingles, a), (shingles, b)))
    assert abs(np.mean(off)) < 4 * 0.5 / np.sqrt(30 * near_dedup.SIZE)


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90)], "a long, b long")
    assert {(r.node, r.root) for r in near_dedup.components(e).collect()} == {(i, 1) for i in range(1, 41)} | {(90, 90), (100, 90)}


def test_token_counts_against_brute_force(spark, odd, empty):
    encode = token_counts._encoder(token_counts.VOCABULARY).encode_ordinary
    lengths = [len(encode(t or "")) for _, t in ODD]
    for r in token_counts.token_counts(odd).collect():
        x = r.n_tokens
        assert r.n_docs == lengths.count(x) and r.docs_from == sum(n >= x for n in lengths) and r.tokens_from == sum(n for n in lengths if n >= x)
        assert r.tokens_upto == sum(n for n in lengths if n <= x) and r.truncated_tokens == sum(min(n, x) for n in lengths)
        assert abs(r.share_upto - sum(n <= x for n in lengths) / len(lengths)) < 1e-12
    totals = {r.limit: (r.docs_over, r.truncated_tokens) for r in token_counts.totals_at(token_counts.token_counts(odd), [0, 2, 10**6]).collect()}
    assert totals == {x: (sum(n > x for n in lengths), sum(min(n, x) for n in lengths)) for x in (0, 2, 10**6)}
    some = spark.createDataFrame([(n, 1 + n % 3) for n in (0, 1, 7, 1023, 1024, 1025, 5000, 70_000)], "n_tokens long, n_docs long")
    all_of = sorted(n for n in (0, 1, 7, 1023, 1024, 1025, 5000, 70_000) for _ in range(1 + n % 3))
    sums, asked = token_counts.suffix_sums(some), [-1, 0, 1, 2, 6, 7, 1022, 1023, 1024, 3000, 4999, 5000, 69_999, 70_000, 10**7]
    totals = {r.limit: (r.docs_over, r.truncated_tokens) for r in token_counts.totals_at(sums, asked).collect()}
    assert totals == {x: (sum(n > x for n in all_of), sum(min(n, max(x, 0)) for n in all_of)) for x in asked}
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r.share: r.n_tokens for r in token_counts.quantiles(sums, shares).collect()}
    assert got == {q: next(n for n in all_of if sum(m <= n for m in all_of) >= q * len(all_of)) for q in shares}
    assert token_counts.totals_at(token_counts.suffix_sums(some.limit(0)), [5]).collect()[0][1:] == (0, 0) and token_counts.quantiles(token_counts.suffix_sums(some.limit(0)), shares).count() == 0
    assert token_counts.token_counts(empty).count() == 0


def brute_grams(text):
    """Counts of hashed pairs and triples, character by character."""
    chars, out = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "], Counter()
    for i in range(len(chars) - 1):
        if chars[i : i + 2] != [32, 32]:
            out[((chars[i] * 0x9E3779B1 + chars[i + 1]) * 0x27D4EB2F) % 2**32 >> 20] += 1
        if i + 2 < len(chars) and chars[i + 1] != 32:
            out[((((chars[i] * 0x9E3779B1 + chars[i + 1]) * 0x85EBCA77) + chars[i + 2]) * 0xC2B2AE3D) % 2**32 >> 20] += 1
    return out


def test_language_id_against_brute_force(monkeypatch):
    """Counts over seams, letters of every plane, and cosines and labels as the definition has them."""
    texts = ["Straße ÀÉ x1y", "a", "İstanbul ıI", "\U00030001\U00030002 \U00031350", "\U00020000", "1 2 3", "", None, "ab " * 50]
    for size in (1 << 20, 7):
        monkeypatch.setattr(language_id, "_BATCH", size)
        got, lettered = language_id.counts(texts)
        for t, row, ok in zip(texts, got, lettered, strict=True):
            want = brute_grams(t or "") if t and any(c.isalpha() for c in t) else Counter()
            assert {i: n for i, n in enumerate(row.tolist()) if n} == want and ok == bool(want)
    rng, rows = np.random.default_rng(1), []
    for name, letters in (("x", "abcde"), ("y", "fghij")):
        for _ in range(40):
            tf = language_id.counts([" ".join("".join(rng.choice(list(letters), 4)) for _ in range(30))])[0][0]
            at = np.flatnonzero(tf)
            rows.append((name, at, tf[at]))
    model = language_id.train(rows, [])
    tests = ["abc bcd cde aabb", "fgh hij jjig", "xyz", "abc fgh"]
    for t, name, score in zip(tests, *model.predict(tests)[:2], strict=True):
        v = np.zeros(language_id.DIMS)
        for i, n in brute_grams(t).items():
            v[i] = np.log1p(n) * model.idf[i]
        cosines = [float(v @ c) / float(np.sqrt(v @ v)) for c in model.centroids]
        assert abs(score - max(max(cosines), 0)) < 1e-5 and name == model.languages[int(np.argmax(cosines))]


def test_language_id_learns_every_language_and_rejects_junk(spark):
    """Over 100 languages, one held by copies; hex strings and foreign scripts are rejected, short clean texts are not."""
    rng = np.random.default_rng(4)
    alphabet = [chr(0x4E00 + i) for i in range(2000)]
    rows = [(k, f"l{k:03d}", " ".join("".join(rng.choice(alphabet[k * 15 : k * 15 + 15], 3)) for _ in range(20))) for k in range(120) for _ in range(9)]
    rows += [(-1, "l000", rows[0][2])] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.fit(docs, learn=F.lit(True), all_rows=500)
    assert set(model.languages) == {f"l{k:03d}" for k in range(120)}
    seen = docs.filter("doc_id >= 0").toPandas()
    assert (np.array(model.predict(seen.text.tolist())[0]) == seen.lang).mean() > 0.99
    own = language_id.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), learn=F.lit(True))
    junk = ["".join(rng.choice(list("0123456789abcdef"), 32)) + " " for _ in range(20)]
    assert all(own.predict(["".join(junk), "Это русский текст о погоде и природе", " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 6)) for _ in range(100))])[2])
    many = own.predict([r.text.split(".")[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()])
    assert np.mean(many[2]) < 0.05


def test_language_id_held_out(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98 and got.score.between(0, 1).all() and got.rejected.mean() < 0.02
    model = language_id.fit(docs, learn=F.lit(True))
    names = ("p", "s", "r")
    got = [r for r in language_id.identify(odd, model).collect()]
    assert {r.lang_pred for r in got if r.doc_id and r.doc_id <= 3} == {"und"} and len(got) == len(ODD) and len({r.score_ for r in got if r.doc_id == 7}) == 1
    assert language_id.identify(empty, model, names=names).count() == 0
    none = language_id.fit(empty, learn=F.lit(True))
    assert {r.p for r in language_id.identify(odd, none, names=names).collect()} == {"und"}


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 500), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # Weights 5, 2, 1, 5: a and null stop at 300 and 150; 1200 are left for b and c by 2 to 1.
    assert got == pytest.approx({"a": 300, None: 150, "b": 800, "c": 400})


def test_mixing_fills_behind_a_long_document(spark):
    """The long document at the cut leaves a gap that takes far more than 200 short ones; every source follows the whole order."""

    def unit(i):
        return (int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 4503599627370496.0

    long_id = next(i for i in range(10_000, 20_000) if 0.1 < unit(i) < 0.11)
    rows = [(i, "w " * (5 + i % 11), "a") for i in range(3000)] + [(long_id, "w " * 20_000, "a")]
    rows += [(i, "w " * (1 + i * i % 600), "b") for i in range(4000, 4200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    for source in "ab":
        own = [got[i] for i, _, s in rows if s == source]
        whole = int(own[0].target / own[0].source_size)
        f, left, want = own[0].target / own[0].source_size - whole, own[0].target - whole * own[0].source_size, {}
        bits = {r.doc_id: r.size.bit_length() for r in own}
        mean = sum(bits[r.doc_id] * r.size for r in own) / own[0].source_size
        p = {i: f + min(f, 1 - f) * (mean - b) / max(bits.values()) for i, b in bits.items()}
        for r in sorted(own, key=lambda r: (unit(r.doc_id) / (1 - unit(r.doc_id)) / (p[r.doc_id] / (1 - p[r.doc_id])), r.doc_id)):
            more = r.size <= left
            left -= r.size * more
            want[r.doc_id] = r.size * (whole + more)
        assert {r.doc_id: r.taken for r in own} == want
        assert sum(r.taken for r in own) > 0.999 * own[0].target
    kept = {r.doc_id: r.taken for r in mixing.mixed(docs).collect()}
    assert kept == {i: r.taken for i, r in got.items() if r.taken}


def test_mixing_draws_with_unequal_probabilities(spark):
    """How often documents of each size get a copy more, over many like sources, follows their inclusion probabilities."""
    rows = [(s * 60 + i, "w " * (4, 8, 16, 32)[i % 4], f"s{s:04d}") for s in range(150) for i in range(60)]
    m = mixing.decided(*mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))).toPandas()
    m["third"], m["extra"] = m.source.str[1:].astype(int) % 3, m.n_copies - m.whole
    by = m.groupby(["third", "size"]).agg(p=("p", "mean"), got=("extra", "mean"), many=("p", "nunique"))
    assert (by.groupby("third").p.nunique() == 4).all() and ((by.p - by.got).abs() < 0.1).all()
    for _, g in by.reset_index().groupby("third"):
        assert g.sort_values("size").got.is_monotonic_decreasing


def test_mixing_takes_what_it_should(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    by = m.groupby("source").agg(taken=("taken", "sum"), target=("target", "max"))
    assert ((by.taken - by.target).abs() <= 0.02 * by.target).all() and (m.taken <= 3 * m["size"]).all()
    assert abs(by.target.sum() - m["size"].sum()) < 1 and m["size"].sum() == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.select("text").collect())
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(odd.withColumn("source", F.lit(None).cast("string"))).count() == len(ODD) and mixing.mix(empty).count() == 0
    kept = mixing.mixed(odd.withColumn("source", F.lit("s")))
    assert kept.columns == ["doc_id", "text", "score", "source", "size", "source_size", "target", "taken"]


def brute_pieces(line):
    """Words up to one that does not end in one of the letters, eight at most, else the first word alone."""
    found, out, i = list(re.finditer(r"[^ \t\n\x0b\f\r]+", line)), [], 0
    while i < len(found):
        last = next((j for j in range(i, min(i + 8, len(found))) if found[j][0][-1] not in "adnosty"), i)
        out.append(line[found[i].start() : found[last].end()])
        i = last + 1
    return out


def brute_print(text):
    import xxhash

    exact, lanes, n = [0] * fingerprint.EXACT, [0] * fingerprint.LANES, 0
    for p in (text or "").split("\n"):
        h = hashlib.sha256(p.encode()).hexdigest()
        exact = [(e + int(h[8 * i : 8 * i + 8], 16)) % 2**32 for i, e in enumerate(exact)]
        for piece in brute_pieces(p):
            x, n = xxhash.xxh64(piece.encode(), seed=42).intdigest(), n + 1
            for j in range(fingerprint.PAIRS):
                lanes[2 * j] += 2 * (x >> j & 1) - 1
                lanes[2 * j + 1] += 2 * (x >> (j + 31) & 1) - 1
    return ("".join(f"{e:08X}" for e in exact) + f"{n:08X}" + "".join(f"{v % 2**32:08X}" for v in lanes)).lower()


def test_fingerprints_against_brute_force(spark, odd, empty):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40).collect()] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "Ünï\ncode")]
    got = {r.doc_id: r for r in fingerprint.fingerprint_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, (i, t) in enumerate(docs):
        t, after = t or "", docs[(k + 1) % len(docs)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (brute_print(t), brute_print(edited)) and 0 <= r.near_next <= 1
        assert len(t) < 200 or r.near_edited > r.near_next
    assert fingerprint.fingerprint_documents(odd).count() == 7 and fingerprint.fingerprint_documents(empty).count() == 0


def test_fingerprints_of_shifted_and_long_texts(spark):
    """A word in front of a one-line text leaves it alike; so are texts of over 32,767 equal pieces."""
    rng = np.random.default_rng(2)
    line = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(400))
    rows = [(1, line), (2, "zzz " + line), (3, "one two three four " * 70_000), (4, "one two three four " * 69_000)]
    p = {r.k: r.fingerprint for r in fingerprint.fingerprints(spark.createDataFrame(rows, "k int, t string"), ["k"], "t").collect()}
    one = spark.createDataFrame([(p[1], p[2], p[3], p[4])], "a string, b string, c string, d string")
    r = one.select(fingerprint.likeness(F.col("a"), F.col("b")).alias("x"), fingerprint.likeness(F.col("c"), F.col("d")).alias("y"), fingerprint.likeness(F.col("a"), F.col("c")).alias("z")).first()
    assert r.x > 0.95 and r.y > 0.95 and r.z < 0.3


def test_fingerprints_add_and_take_away(spark):
    df = spark.createDataFrame([(1, "a b c\nd e"), (2, "d e\na b c"), (3, "a b c"), (4, "d e")], "k int, t string")
    p = {r.k: r.fingerprint for r in fingerprint.fingerprints(df, ["k"], "t").collect()}
    assert p[1] == p[2] != p[3]
    one = spark.createDataFrame([(p[1], p[3], p[4])], "x string, y string, z string")
    r = one.select(fingerprint.combined(F.col("y"), F.col("z")).alias("sum"), fingerprint.combined(F.col("x"), F.col("z"), -1).alias("left")).first()
    assert (r["sum"], r["left"]) == (p[1], p[3])


def test_quality_against_brute_force(spark):
    """Scores from compressed sizes taken one by one; the curve is where the likelihood is greatest; whole labelled texts are learnt from."""
    import zstandard

    rng = np.random.default_rng(6)
    filler = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(6000))
    mark = {0: "zzyx wwvu ttsr qqpo " * 30, 1: "mmno llkj iihg yyxw " * 30}
    # What tells the classes apart stands behind 36,000 characters.
    rows = [(f"k{i}", filler() + mark[i % 2] * 8, i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [("k0", None)], "doc_id string, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [("k1", 1), (None, 1), ("k2", None), ("no", 0)], "doc_id string, quality int")
    model = quality.fit(docs, labels, learn=F.lit(True))
    probe = spark.createDataFrame([(mark[0], 1.0), (mark[1], 1.0), ("", 1.0), (None, 1.0), (mark[1], 1.0)], "text string, score double")
    got = [r.score_ for r in quality.scored(probe, model).collect()]
    assert got[0] < 0.5 < got[1] == got[4] and got[2] == got[3]
    for text, s in zip((mark[0], mark[1], ""), got, strict=False):
        size = {}
        for name, raw in (("good", model.good), ("bad", model.bad)):
            c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
            size[name] = sum(len(c.compress(text.encode()[i : i + quality.PIECE])) for i in range(0, len(text), quality.PIECE))
        x = (size["bad"] - size["good"]) / (len(text) + quality.SMALL)
        assert abs(s - 1 / (1 + np.exp(-(model.curve[0] * x + model.curve[1])))) < 1e-9
    x, y = np.stack([rng.standard_normal(200), np.ones(200)], 1), (rng.random(200) < 0.7).astype(float)
    likelihood = lambda c: float(np.sum(np.log(np.where(y == 1, quality._score(x, c), 1 - quality._score(x, c)))))
    best = quality._logistic(x, y, np.ones(200))
    assert all(likelihood(best) >= likelihood((best[0] + a, best[1] + b)) - 1e-4 for a in (-0.1, 0, 0.1) for b in (-0.1, 0, 0.1))


def test_quality_held_out(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.93 and got.score.between(0, 1).all()
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels, learn=F.lit(True))
    assert quality.scored(odd, model, name="q").filter("q between 0 and 1").count() == len(ODD) and quality.scored(empty, model).count() == 0
    plain = quality.fit(docs, labels.limit(0), learn=F.lit(True))
    assert {round(r.q, 3) for r in quality.scored(odd, plain, name="q").collect()} == {0.5}


def test_url_rules():
    trie = url_filter.Trie([*queries.RULES, url_filter.Rule("allow", "a.net", "/p"), url_filter.Rule("block", "a.net", "/p")])
    name = lambda u: (r := trie.match(*url_filter.split_url(u))) and (r.verdict, r.name)
    assert name("http://x.NET/") == ("block", "net/") and name("http://x.net") is None and name("http://knet/") is None
    assert name("https://b.example.net/en/1?q#f") == ("allow", "example.net/en/") and name("https://example.net/enx") == ("block", "net/")
    assert name("http://a.net/page") == ("block", "a.net/p") and name("http://z.a.net/q") == ("block", "net/")
    assert url_filter.split_url(None) == url_filter.split_url("no") == ("", "") and url_filter.split_url("s://H?x/y") == ("h", "")


def brute_rule(rules, host, path):
    """The rule that decides by the definition alone: all rules looked at."""
    fits = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)


def test_url_filter_on_tables(spark):
    """Nulls, odd and very long urls, repeated rows, clashing names, rules split over many tries, and an empty table."""
    rules = [*queries.RULES, url_filter.Rule("allow", "a.net", "/p"), url_filter.Rule("block", "a.net", "/p")]
    rules += [url_filter.Rule("allow" if i % 3 else "block", "a.net", "/" + "abcdef"[: i % 6 + 1] * (i % 4) + ("/" if i % 2 else "") + str(i % 7)) for i in range(60)]
    urls = [None, "", "x", "://", "http://A.NET/p", "http://q.a.net/pa?x", "http://example.com/de/x", "http://a.net/" + "ab" * 200_000, "http://net/", "http://net/", "ftp://z.org/fr/#"]
    urls += [f"http://{'q.' * (i % 3)}a.net{r.path}{'z' * (i % 2)}" for i, r in enumerate(rules)]
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id int, url string, host string")
    for most in (10**6, 7):
        out = url_filter.judge(pages, rules, most_rules=most)
        assert out.columns == ["page_id", "url", "host", "host_", "path", "rule", "verdict"]
        for r in out.collect():
            want = brute_rule(rules, *url_filter.split_url(r.url))
            assert (r.rule, r.verdict, r.host) == (want.name if want else None, want.verdict if want else "allow", "own")
    assert url_filter.judge(pages.limit(0), rules).count() == 0 and url_filter.judge(pages, []).filter("verdict = 'allow'").count() == len(urls)


def test_chat_round_trip():
    texts = ["", "plain", queries.CONFLICT, r"<\|im_end|>", r"<\\|", "<|", "<<|\\|>", "\n<|im_end|>\n<|im_start|>user\n", "é<\\<|"]
    for role in ["user", "assistant", "", "a\nb", "<|x", "\\n"]:
        for t in texts:
            piece, a, b = chat_format.render(role, t)
            assert [x[:2] for x in chat_format.parse(piece)] == [(role, t)] and chat_format.unescape(piece[a:b]) == t
    assert chat_format.parse("<|im_start|>user") is None and chat_format.parse("x") is None


def test_chat_nulls(spark):
    rows = [(1, 1, "assistant", None, 0), (1, 0, None, "q", 0), (None, 0, "assistant", "a", 0), (None, 0, "assistant", "a", 0)]
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int"))).collect()}
    assert (got[1].n_turns, got[1].loss_chars) == (2, 0) and (got[None].n_turns, got[None].loss_chars) == (2, 2)
    assert got[1].turns_sha256 == hashlib.sha256(b"\nq\nassistant\n\n").hexdigest()


def test_chat_empty_and_long(spark):
    """An empty table gives no rows; a conversation of many long turns is read as a stream."""
    kind = "conv_id long, turn long, role string, text string"
    assert chat_format.read_back(chat_format.format_turns(spark.createDataFrame([], kind))).count() == 0
    text = "<|im_end|> line\n" * 5000
    long = spark.range(300).selectExpr("5L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role").withColumn("text", F.lit(text))
    r = chat_format.read_back(chat_format.format_turns(long)).first()
    digest = hashlib.sha256()
    for i in range(300):
        digest.update(f"{('user', 'assistant')[i % 2]}\n{text}\n".encode())
    assert (r.n_turns, r.turns_sha256, r.loss_chars) == (300, digest.hexdigest(), 150 * len(text))


def test_warc_round_trip_in_small_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    big = rng.bytes(300_000).hex()
    rows = [(1, "http://a/\n", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "ü", big), (6, "u", big + "!"), (7, "u", "WARC/1.0 \x1f\x8b\x08"), (None, "u", "alone"), (8, "u", "same")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int")
    listed = warc.write_archives(pages.repartition(2), str(tmp_path / "w"))
    got = warc.read_archives(listed, split_bytes=1000, with_payload=True).collect()
    assert len(got) == len(rows)
    last = {h or "": max((i for i, _, x in rows if (x or "") == (h or "") and i), default=None) for _, _, h in rows}
    text = dict((i, h or "") for i, _, h in rows)
    for r in got:
        body = text[r.page_id].encode()
        revisit = r.page_id is not None and last[text[r.page_id]] != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(body), warc.base32_sha1(body))
        assert (r.record_type, r.refers_to) == (("revisit", last[text[r.page_id]]) if revisit else ("response", None)) and (revisit or r.payload == body)
    assert warc.archive_and_read(pages.limit(0), folder=str(tmp_path / "e")).count() == 0


def test_warc_large_pages_across_blocks_and_long_urls(tmp_path):
    """A page that inflates to a whole chunk is read wherever its header is cut by a block's end; so is a url over 1 MiB."""
    body = b"the same line again\n" * 105_000
    member = warc.record("7", "http://host/page", body, None)
    at = tmp_path / "x.warc.gz"
    for before in range(1, 420):
        at.write_bytes(bytes((1 << 20) - before) + member)
        assert [(r[0], r[3]) for r in warc.scan(str(at), 0, at.stat().st_size)] == [(7, len(body))], before
    at.write_bytes(warc.record("8", "http://host/" + "ab" * (1 << 20), b"x", None))
    assert [(r[0], r[3]) for r in warc.scan(str(at), 0, at.stat().st_size)] == [(8, 1)]


def test_warc_damage_is_told(tmp_path):
    """Records that are cut short, or whose payload is not what the header's digest says, come out as damaged."""
    good, at = [warc.record(str(i), "http://host/", bytes(200) + bytes([i]) * 50, None) for i in (1, 2, 3)], tmp_path / "x.warc.gz"
    wrong = warc.zlib.compressobj(4, warc.zlib.DEFLATED, 31)
    raw = warc.zlib.decompress(good[1], 31).replace(b"sha1:", b"sha1:A")
    at.write_bytes(good[0] + wrong.compress(raw) + wrong.flush() + good[2][:-30])
    assert [(r[0], r[1]) for r in warc.scan(str(at), 0, at.stat().st_size)] == [(1, "response"), (2, "damaged"), (None, "damaged")]


def test_warc_oversize_header_is_an_error(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "_HEAD_LIMIT", 1000)
    at = tmp_path / "x.warc.gz"
    at.write_bytes(warc.record("8", "http://host/" + "a" * 2000, b"x", None))
    with pytest.raises(RuntimeError):
        list(warc.scan(str(at), 0, at.stat().st_size))


def _same(a, b):
    norm = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v
    return sorted(tuple(map(norm, r)) for r in a if r) == sorted(tuple(map(norm, r)) for r in b) if None not in {x for r in b for x in r} else sorted(str(tuple(map(norm, r))) for r in a) == sorted(str(tuple(map(norm, r))) for r in b)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    columns, want = [d[0] for d in cur.description], cur.fetchall()
    assert _same([tuple(r) for r in queries.queries()[name](spark, SF).select(columns).collect()], want)


def test_near_dedup_stage_on_rows_without_or_with_a_shared_id(spark):
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import corpus_pipeline as p

    text = [" ".join(f"{w}{k}x{i}" for i in range(60)) for k, w in enumerate(("red", "blue", "green", "grey"))]
    rows = [(1, text[0], "a"), (2, text[0], "b"), (2, text[1], "c"), (3, text[2], "e"), (3, text[2], "d"), (4, text[2] + " end", "f"), (5, "", "g"), (None, text[3], "h"), (None, text[3], "i"), (None, text[0], "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rows += [(None, None, "k"), (None, None, "l"), (None, "", "m"), (None, text[3] + " end", "n"), (None, text[1] + " end", "o"), (None, "other words", "p")]
    docs = spark.createDataFrame(rows, docs.schema)
    # Of rows without doc_id those stay that copy neither each other nor a document with one.
    want = [(1, text[0], "a"), (2, text[1], "c"), (3, text[2], "d"), (5, "", "g"), (None, None, "k"), (None, "", "m"), (None, "other words", "p")]
    ends = [("h", text[3]), ("n", text[3] + " end")]
    want.append((None, *min(ends, key=lambda x: hashlib.md5(x[1].encode()).hexdigest())[::-1]))
    for dealt in (docs.coalesce(1), docs.repartition(5)):
        assert sorted(map(str, p.one_of_each(spark, dealt, SF).select("doc_id", "text", "source").collect())) == sorted(str(r) for r in spark.createDataFrame(want, docs.schema).collect())


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names and empty tables, stage by stage."""
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import corpus_pipeline as p

    own = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    passage = " ".join(f"w{i}" for i in range(30))
    odd = [(None, None, None, None, None), (7001, None, "en", "a", 0), (7002, "", None, None, 0), (7003, "x", "en", "a", 1), (7003, "x", "en", "a", 1), (None, passage, None, "a", 9), (7004, passage, "en", "a", 9)]
    odd += [(7005, "word and another one " * 60_000, "en", "b", 9)]
    docs = own.unionByName(spark.createDataFrame(odd, own.schema))
    for c in ("quality_score", "lang_pred", "print", "node", "dc_n_hit", "score"):
        docs = docs.withColumn(c, F.lit("mine"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").schema
    spark.createDataFrame([(None, passage), (None, None)], item).write.mode("append").parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    rows = lambda df: sorted(map(str, df.collect()))
    everything, shared = rows(docs), Counter(rows(docs))
    good = p.good_quality(spark, docs, sf)
    assert good.columns == docs.columns and set(rows(good)) <= set(everything) and Counter(rows(good))[[x for x in everything if "7003" in x][0]] in (0, 2)
    known = p.known_language(spark, docs, sf)
    assert known.columns == docs.columns and known.filter("text is null or text = ''").count() == 0 and not Counter(rows(known)) - shared
    single = p.one_of_each(spark, docs, sf)
    assert single.columns == docs.columns and single.filter("doc_id is null").count() == 1 and single.filter("doc_id = 7003").count() == 1
    clean = p.no_benchmark(spark, docs, sf)
    assert clean.columns == docs.columns and clean.filter("text is null").count() == 2 and clean.filter(F.col("text").contains("w1 w2")).count() == 0
    mix = p.target_mix(spark, docs, sf)
    assert mix.columns == [*docs.columns, "size", "source_size", "target", "taken"] and mix.filter("text is null or text = '' or taken > 3 * size").count() == 0
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_pipeline_against_brute_force(spark):
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import corpus_pipeline as p

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs = documents.withColumn("size", F.lit("x"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = p.good_quality(spark, docs, SF)
    assert good.columns == docs.columns and good.count() > 0.7 * len(rows)
    known = p.known_language(spark, docs, SF)
    assert known.columns == docs.columns and known.count() >= len(rows) - 2
    single = p.one_of_each(spark, docs, SF)
    assert {r.doc_id for r in single.collect()} == set(brute_classes(list(rows.items())).values())
    clean = {r.doc_id: r.text for r in p.no_benchmark(spark, docs, SF).collect()}
    items = [tuple(map(str, r)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for i, t in rows.items():
        n, hit, _ = brute_hits(t, items)
        assert (i not in clean) == (hit > 0.5 * n) and (i not in clean or brute_hits(clean[i], items)[1] == 0) and (hit or clean[i] == t)
    out = p.run(spark, SF)
    assert out.count() > 0 and set(documents.columns) <= set(out.columns) and out.filter("taken > 3 * size").count() == 0
