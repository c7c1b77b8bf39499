"""Hard negatives, periodic runs and languages against plain versions, and on awkward rows."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelight.llm import langid, negatives, runs

WS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "very long text " * 20_000


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---- 11


VECTORS = "vec_id long, embedding array<float>, label int, id long, row string, score double"


def plain_negatives(given, asks):
    """given: (vec_id, label, whole numbers), rows that take part."""
    out, key = [], lambda x: (-x[0], x[1] is None, x[1] or 0)
    for a, (anchor, label, q) in enumerate(given):
        if not asks(anchor):
            continue
        scored = [(sum(x * y for x, y in zip(q, v, strict=True)), i, k == label) for r, (i, k, v) in enumerate(given) if r != a and len(v) == len(q)]
        near = sorted((s[:2] for s in scored if s[2]), key=key)[:5]
        far = sorted((s[:2] for s in scored if not s[2]), key=key)
        for p, positive in near:
            fits = [x for x in far if 30 * p <= 100 * x[0] <= 90 * p][:10]
            out += [(anchor, positive, n + 1, i, p, s) for n, (s, i) in enumerate(fits)]
    return sorted(out, key=repr)


def mined(df):
    return sorted(((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows(df)), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_negatives_like_brute_force(spark, monkeypatch, small):
    """Clusters, ties, equal vectors and rows, rows without id; small: many blocks of anchors and rows."""
    if small:
        monkeypatch.setattr(negatives, "ANCHOR_BYTES", 1000)
        monkeypatch.setattr(negatives, "ROWS", 64)
        monkeypatch.setattr(negatives, "ANCHORS", 3)
        monkeypatch.setattr(negatives, "CELLS", 8)
        monkeypatch.setattr(negatives, "SAMPLE", 100)
    rng = np.random.default_rng(3)
    centres = rng.integers(-60, 60, (6, 6))
    given = [(i, int(rng.integers(4)), (centres[rng.integers(6)] + rng.integers(-9, 9, 6)).tolist()) for i in range(700)]
    given += [(i, 1, [5, 5, 5, 5, 5, 5]) for i in range(700, 760)] + [(20, 1, [5] * 6), (20, 1, [5] * 6), (None, 2, [4] * 6), (None, 1, [900, 0, 0, 0, 0, -900])]
    given += [(800, 1, [1, 2]), (801, 1, [2, 2]), (802, 3, [1, 1]), (803, 1, []), (820, 2, [])]
    df = spark.createDataFrame(given, "vec_id long, label int, v array<long>").repartition(5)
    out = negatives.hard_negatives(df, F.col("vec_id") % 20 == 0)
    want = plain_negatives(given, lambda i: i is not None and i % 20 == 0)
    assert len(want) > 500 and mined(out) == want


def test_negatives_leave_most_rows_unscored(monkeypatch):
    """The bounds hold for every row, and the windows' candidates are few."""
    rng = np.random.default_rng(5)
    v = rng.integers(-100, 100, (6000, 32))
    made = negatives.Approximation.of(v[:2000], v.min(axis=0), v.max(axis=0))
    cells = made.cells(v)
    lower, upper = negatives._bounds(cells, made.tables(v[:7]))
    score = v @ v[:7].T
    assert (lower <= score).all() and (score <= upper).all()
    scored = []
    plain = np.einsum
    monkeypatch.setattr(negatives.np, "einsum", lambda how, a, b: scored.append(len(a)) or plain(how, a, b))
    asked = negatives.Asked(np.arange(7), np.zeros(7, np.int64), v[:7], np.full((7, 1), 20000), np.full((7, 1), 60000), True, 5)
    scan = negatives._Scan(asked, made)
    for s in range(0, 6000, 1000):
        p = slice(s, s + 1000)
        scan.add(np.arange(s, s + 1000), np.arange(s, s + 1000), np.zeros(1000, np.int64), cells[p], v[p])
    assert sum(scored) < 7 * 6000 / 20
    for a in range(7):
        best = sorted(((-score[r, a], r) for r in range(6000) if r != a and 20000 <= score[r, a] <= 60000))[:5]
        assert [(-s, r) for s, r in best] == [(s, r) for w, s, r in zip(*scan.held[:3], strict=True) if w == a]


def test_negatives_awkward(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    given = [(0, [0.5, 0.25], 0), (7, [0.5, 0.5], 0), (1, [0.25, 0.25], 2), (2, [0.5, 0.5], 2), (3, None, 1), (4, [0.5, None], 1), (5, [nan, 0.5], 1), (6, [0.5, inf], 1), (8, [0.5, 0.5], None), (None, [0.25, 0.0], 3), (100, [], 1), (200, [0.5], 1)]
    folder = str(tmp_path)
    spark.createDataFrame([(*g, 1, "x", 0.5) for g in given], VECTORS).write.parquet(f"{folder}/embeddings.parquet")
    # The labels of 0 and 7 become 1, so 7 alone is a positive of 0; rows in the window: 2, 1 and the one without id.
    floor = [(0, 1, [128, 64]), (7, 1, [128, 128]), (1, 2, [64, 64]), (2, 2, [128, 128]), (None, 3, [64, 0]), (100, 1, []), (200, 1, [128])]
    want = plain_negatives(floor, lambda i: i is not None and i % 100 == 0)
    assert mined(negatives.op11_negatives(spark, folder)) == want and [w[3] for w in want] == [1, None]
    empty = str(tmp_path / "none")
    spark.createDataFrame([], VECTORS).write.parquet(f"{empty}/embeddings.parquet")
    assert rows(negatives.op11_negatives(spark, empty)) == []
    with pytest.raises(ArithmeticError):
        negatives.hard_negatives(spark.createDataFrame([(0, 1, [1 << 40]), (1, 1, [1 << 40])], "vec_id long, label int, v array<long>"), F.lit(True))


# ---- 12


def plain_runs(words, least=12):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        at = 0
        while at < len(words) - q:
            end = at
            while end < len(words) - q and words[end] == words[end + q]:
                end += 1
            if end - at + q >= max(least, 2 * q):
                out.setdefault((at, end - at + q), q)
            at = max(end, at + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_like_brute_force():
    rnd = random.Random(2)
    cases = [[], [0] * 11, [0] * 12, [0] * 300, thue_morse(400), fibonacci(400), [0, 1, 2] * 60 + [7] + [0, 1, 2] * 60, list(range(40)) * 3, list(range(6)) * 2, list(range(5)) * 2]
    for _ in range(700):
        w = [rnd.randrange(rnd.choice([1, 2, 2, 3, 5, 30])) for _ in range(rnd.randrange(200))]
        for _ in range(rnd.randrange(4)):
            s, p, n = rnd.randrange(len(w) + 1), rnd.randrange(1, 40), rnd.randrange(150)
            for i in range(s + p, min(len(w), s + n)):
                w[i] = w[i - p]
        cases.append(w)
    for w in cases:
        words = [b"w%d" % x for x in w]
        assert runs.runs_in_words(words) == plain_runs(w)
        assert runs.runs_of(np.array(w, np.int64)) == plain_runs(w)
    for least in (2, 3, 5, 13):
        for w in cases[:60]:
            assert runs.runs_in_words([b"w%d" % x for x in w], least) == plain_runs(w, least)


def test_runs_keep_only_repeated_grams():
    """Words outside of repeated 6-grams never reach the search."""
    words = [b"a%d" % i for i in range(100)] + [b"x%d" % (i % 7) for i in range(30)] + [b"b%d" % i for i in range(100)]
    ids = np.unique(words, return_inverse=True)[1].astype(np.uint64)
    assert runs.segments(ids, runs.overlap(12)) == [(100, 130)] and runs.runs_in_words(words) == [(100, 30, 7)]


def plain_looped(doc_id, text):
    words = WS.findall(text or "")
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_query(spark, sf):
    given = {r["doc_id"]: r["text"] for r in rows(spark.read.parquet(f"{sf}/documents.parquet"))}
    out, found = rows(runs.op12_runs(spark, sf)), 0
    assert len(out) == len(given)
    for r in out:
        words = plain_looped(r["doc_id"], given[r["doc_id"]])
        if len(words) > 2500:
            continue
        want = plain_runs(words)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in want)]
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(want), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        found += len(want)
    assert found > 5


def test_runs_awkward(spark, tmp_path):
    names = "doc_id long, text string, runs int, collapsed int, start string, best string, words string"
    given = [(1, "a b " * 6), (2, None), (3, ""), (3, ""), (None, "x " * 12), (5, LONG), (6, " \t\n 　"), (7, "a b " * 13), (8, "ü ö " * 7)]
    df = spark.createDataFrame([(i, t, 1, 2, "s", "b", "w") for i, t in given], names)
    out = rows(runs.periodic_runs(df))
    assert sorted(out[0]) == sorted(df.columns) and len(out) == len(given)
    by = [(r["text"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out]
    assert (given[0][1], [(0, 12, 2)], "a b") in by and ("x " * 12, [(0, 12, 1)], "x") in by
    assert (None, [], "") in by and by.count(("", [], "")) == 2 and (" \t\n 　", [], " 　") in by
    assert (LONG, [(0, 60_000, 3)], "very long text") in by and ("a b " * 13, [(0, 13, 1)], "a b") in by
    assert rows(runs.periodic_runs(df.where("false"))) == []
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert len(rows(runs.op12_runs(spark, str(tmp_path)))) == len(given)


# ---- 13


def plain_shares(texts, text):
    """texts: (lang, text) learned from. Each language's share of the text's n-grams, by sets."""

    def grams(t):
        out = Counter()
        for w in "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in t.lower()).split():
            for n in langid.ORDERS:
                out.update(f" {w} "[i : i + n] for i in range(len(w) + 3 - n))
        return out

    if (lambda own=plain_shares.__dict__: own.get("of") is not texts)():
        plain_shares.of, counts = texts, {}
        for lang, t in texts:
            counts.setdefault(lang, Counter()).update(grams(t))
        plain_shares.sets = {k: {g for g, n in c.items() if n >= langid.SHARE * c.total()} for k, c in counts.items()}
    own = grams(text)
    return {k: sum(n for g, n in own.items() if g in s) / max(1, own.total()) for k, s in plain_shares.sets.items()}


def test_language_query_like_sets(spark, sf):
    docs = {r["doc_id"]: r for r in rows(spark.read.parquet(f"{sf}/documents.parquet"))}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learned = [(r["lang"], r["text"]) for i, r in docs.items() if not held(i) and r["text"] and r["lang"]]
    out = rows(langid.op13_language(spark, sf))
    assert len(out) == len(docs) and {r["held_out"] for r in out} == {True, False}
    right = 0
    for r in out:
        assert r["held_out"] == held(r["doc_id"])
        want = plain_shares(learned, docs[r["doc_id"]]["text"] or "")
        # False positives are corrected for, so shares differ from the sets' by little.
        assert r["score"] == pytest.approx(max(want.values()), abs=0.02) and 0 <= r["score"] <= 1
        if sorted(want.values())[-1] - sorted(want.values())[-2] > 0.05:
            assert r["lang_pred"] == max(want, key=want.get)
        right += r["held_out"] and r["lang_pred"] == docs[r["doc_id"]]["lang"]
    assert right >= 0.97 * sum(r["held_out"] for r in out)


TAUGHT = [("aa", "lorem ipsum dolor sit amet"), ("aa", None), ("bb", "quick brown foxes jump"), (None, "quick brown foxes jump"), ("cc", "123 456"), ("dd", "größe über straße"), ("ee", "привет мир"), ("bb", "")]


@pytest.mark.parametrize("langs", [256, 1])
def test_language_awkward(spark, monkeypatch, langs):
    """langs 1: a filter for each language, whose answers are joined."""
    monkeypatch.setattr(langid, "LANGS", langs)
    filters = langid.learn(spark.createDataFrame(TAUGHT, "lang string, text string"))
    assert sorted(n for f in filters for n in f.names) == ["aa", "bb", "dd", "ee"] and len(filters) == (1 if langs > 1 else 4)
    given = [(1, "IPSUM Dolor!"), (2, None), (3, ""), (4, "123 ?!"), (4, "123 ?!"), (None, "quick, brown"), (6, "Größe"), (7, "мир"), (8, "漢字"), (9, LONG), (10, "x")]
    names = "doc_id long, text string, lang_pred int, score string, margin int, i int, best int"
    df = spark.createDataFrame([(*g, 1, "s", 2, 3, 4) for g in given], names)
    out = rows(langid.identified(df, filters))
    assert len(out) == len(given) and sorted(out[0]) == sorted(df.columns)
    by = {r["text"]: r for r in out}
    assert [by[t]["lang_pred"] for t in ("IPSUM Dolor!", "quick, brown", "Größe", "мир")] == ["aa", "bb", "dd", "ee"]
    assert all(by[t]["lang_pred"] == "und" and by[t]["score"] == 0 for t in (None, "", "123 ?!"))
    assert by["漢字"]["lang_pred"] in {"aa", "bb", "dd", "ee"} and by["漢字"]["score"] < 0.01
    assert all(0 <= r["margin"] <= r["score"] <= 1 for r in out) and by["мир"]["margin"] > 0.9
    assert rows(langid.identified(df.where("false"), filters)) == []
    none = langid.learn(spark.createDataFrame([], "lang string, text string"))
    assert none == [] and {r["lang_pred"] for r in rows(langid.identified(df, none))} == {"und"}


def test_language_false_positives_are_corrected(monkeypatch):
    """A filter so full that most n-grams seem to be of every language still tells them apart."""
    monkeypatch.setattr(langid, "SPARSE", 1)
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 900, dtype=np.uint64), rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    bits = np.zeros((1024, 1), np.uint8)
    for j, own in enumerate((a, b)):
        for p in langid.places(own, 1024):
            bits[p, 0] |= 1 << j
    made = langid.Filter(["a", "b"], bits)
    assert made.false[0] > 0.8 > made.false[1]
    mixed = np.concatenate([a[:100], b[:200], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    share = made.shares(mixed)
    assert share[1] > share[0] and abs(share[1] - 0.5) < 0.15
