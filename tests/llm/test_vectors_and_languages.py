"""Clustering, whitening and language identification against brute force, on ordinary and odd rows."""

import collections
import hashlib
import math
import random
import unicodedata

import duckdb
import numpy as np
import pytest

from wayline.llm import clustering, language_id, registry, whitening

VECTORS = "vec_id long, embedding array<float>, label int, x array<int>, h string, cluster int, n long"


def vectors(rng, n, dims, spread=0.2, groups=5):
    centres = rng.normal(size=(groups, dims))
    return [(i, (centres[i % groups] + spread * rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, [1], "h", 3, 4) for i, v in rows], VECTORS).repartition(3)


def odd_rows(rng, dims):
    good = vectors(rng, 60, dims)
    return good + [good[0], good[1], (900, good[2][1]), (None, good[3][1]), (901, None), (902, []), (903, [0.0] * dims), (904, [1.0] * (dims - 1)), (905, [float("nan")] + [0.0] * (dims - 1)), (906, [float("-inf")] + [0.0] * (dims - 1)), (907, [None] + [0.0] * (dims - 1)), (908, [1e30] + [0.0] * (dims - 1)), (909, [3.0] * dims)]


def scaled(rows, scale, dims):
    fine = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) * scale < 2**31 for x in v)]
    return [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in fine]


def lloyd(rows, k, rounds, seed="3"):
    """The clusters by the definition, with Python's integers."""
    named = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [x for _, x in named[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    nearest = lambda x: min((far(x, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, x in rows:
            own[nearest(x)[1]].append(x)
        cs = [[sum(col) // len(own[j]) for col in zip(*own[j])] if j in own else c for j, c in enumerate(cs)]
    found = [(i, *nearest(x)[::-1]) for i, x in rows]
    sums = collections.Counter()
    for _, j, d in found:
        sums[j] += d
    return [(i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, j, d in found]


def key(r):
    return [(v is None, v) for v in r]


@pytest.mark.parametrize(("k", "rounds"), [(1, 2), (4, 3), (8, 10), (200, 1)])
def test_clusters_by_definition(spark, k, rounds):
    rows = odd_rows(np.random.default_rng(k), 6)
    got = clustering.centroid_clusters(table(spark, rows), k, rounds, dims=6).collect()
    assert sorted(map(tuple, got), key=key) == sorted(lloyd(scaled(rows, 1024, 6), k, rounds), key=key)


def test_no_vectors(spark):
    assert clustering.centroid_clusters(table(spark, [])).count() == 0 and clustering.centroid_clusters(table(spark, [(1, None), (2, [1.0])])).count() == 0
    assert whitening.whitened(table(spark, [])).count() == 0 and whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0


def test_orchard_finds_the_nearest_and_smallest():
    """Ties are frequent on a small grid; large components leave 64 bits."""
    rng = np.random.default_rng(5)
    for top, k in ((2, 30), (3, 7), (50, 64), (1 << 30, 9)):
        c, x = rng.integers(-top, top + 1, (k, 3)), rng.integers(-top, top + 1, (400, 3))
        best, dist = clustering.orchard(x, c, clustering.neighbour_lists(c))
        for row, b, d in zip(x.tolist(), best.tolist(), dist.tolist()):
            assert (int(d), b) == min((sum((p - q) ** 2 for p, q in zip(row, m)), j) for j, m in enumerate(c.tolist()))


def test_orchard_stops_early():
    """A vector near its centroid compares with few others."""
    rng = np.random.default_rng(6)
    c = rng.integers(-100_000, 100_000, (500, 8))
    order, apart = clustering.neighbour_lists(c)
    assert (apart[:, 0] // 4 > 100).all()
    best, dist = clustering.orchard(c + 1, c, (order, apart))
    assert (best == np.arange(500)).all() and (dist == 8).all()


def test_op12_against_its_sql(spark, tmp_path):
    rows = odd_rows(np.random.default_rng(8), 64)
    rows = [r for r in dict((r[0], r) for r in rows if r[0] is not None).values() if r[0] != 908]
    table(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = registry.QUERIES["op12_centroid_clusters"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(registry.ORACLE_SQL["op12_centroid_clusters"]).fetchall()) == sorted(lloyd(scaled(rows, 1024, 64), 8, 10))


def direct(rows, k, scale=64):
    """Whitened values, explained shares and deviations from the covariance itself."""
    x = np.array([[v + 1_000_000 for v in r] for _, r in rows], dtype=np.int64)
    d = np.unique(x, axis=0)
    n, s = len(d), d.sum(axis=0)
    c = (n * d - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    return n, dev, ((n * x - s) / n) @ u / np.sqrt(e), e / np.trace(c.T @ c / n)


@pytest.mark.parametrize(("dims", "k"), [(6, 4), (40, 16), (3, 16)])
def test_whitening_against_the_covariance(spark, dims, k):
    rows = odd_rows(np.random.default_rng(dims), dims)
    kept = scaled([r for r in rows if r[0] != 904], 64, dims)
    n, dev, white, explained = direct(kept, min(k, dims))
    got = whitening.whitened(table(spark, rows), k).collect()
    assert len(got) == len(kept) * min(k, dims) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-12
    by = collections.defaultdict(list)
    for r in got:
        by[r.vec_id, r.component].append(r)
    for j in range(min(k, dims)):
        sign = 0
        for (i, _), d, w in zip(kept, dev, white[:, j]):
            for r in by[i, j + 1]:
                assert r.deviation == d and abs(r.explained - explained[j]) < 1e-12
                sign = sign or np.sign(r.whitened * w)
                assert abs(sign * r.whitened - w) < 1e-8


def test_jacobi_davidson_reaches_double_precision():
    rng = np.random.default_rng(3)
    for dims, values in ((150, 1 / np.arange(1, 151.0) ** 2), (120, np.r_[np.ones(20) + 1e-6 * np.arange(20), rng.random(100) * 0.9]), (40, np.r_[3.0, 2.0, 1.0, np.zeros(37)]), (2, np.ones(2))):
        q = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        v = (q * values) @ q.T
        v, widths = (v + v.T) / 2, []
        got, axes, norms = whitening.jacobi_davidson(lambda b, v=v, widths=widths: widths.append(b.shape[1]) or v @ b, dims, 16)
        k = min(16, dims)
        assert np.abs(got - np.sort(values)[::-1][:k]).max() < 1e-13 * values.max() and np.abs(axes.T @ axes - np.eye(k)).max() < 1e-13
        assert np.linalg.norm(v @ axes - axes * got, axis=0).max() < 5e-14 * values.max() and max(widths) <= 32


def test_minres_solves():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(12, 12))
    a, b = a + a.T, rng.normal(size=(12, 3))
    b[:, 1] = 0
    assert np.abs(a @ whitening.minres(lambda z: a @ z, b, 12) - b).max() < 0.02 * np.linalg.norm(b)


def test_deviations_beyond_long(spark):
    rows = [(1, [1e7, 0.0]), (2, [-1e7, 0.0]), *((i, [0.0, float(i)]) for i in range(3, 20))]
    got = {r.vec_id: r.deviation for r in whitening.whitened(table(spark, rows), 2).collect()}
    n, dev, *_ = direct(scaled(rows, 64, 2), 2)
    assert [got[i] for i, _ in rows] == [d if d < 2**63 else None for d in dev] and None in got.values() and n == 19


def naive_counts(text):
    """Buckets by the definition: words of letters and marks with gaps around them, hashed grams of 1 to 4 symbols."""
    low = lambda c: (c.lower() if len(c.lower()) == 1 else c.lower()[0]) if unicodedata.category(c)[0] in "LM" else " "
    out = collections.Counter()
    symbols = " " + "".join(low(c) for c in unicodedata.normalize("NFC", text or ""))
    for word in symbols.split(" "):
        if word:
            for n in (1, 2, 3, 4):
                marked = word if n == 1 else f" {word} "
                for i in range(len(marked) - n + 1):
                    h = 2166136261 + n
                    for c in marked[i : i + n]:
                        h = (h ^ (0 if c == " " else ord(c))) * 16777619 % 2**32
                    h = (h ^ (h >> 15)) * 2654435769 % 2**32
                    out[h >> 17] += 1
    return out


ODD_TEXTS = [None, "", " ", "12 34 !!", "a", "ab", " ab ", "Ab-cd, ef.", "ÉTÉ été", "Straße İstanbul ΑΣ", "été ́", "日本語 テキスト", "नमस्ते दुनिया", "😀 x", "x" * 3000, "one two  three\n\nfour" * 50]


def test_subwords(monkeypatch):
    for step in (1 << 20, 7, 1):
        monkeypatch.setattr(language_id, "STEP", step)
        for t in ODD_TEXTS:
            counts, found = language_id.subword_counts(t)
            assert {int(i): int(counts[i]) for i in np.flatnonzero(counts)} == dict(naive_counts(t)) and found == any(c.isalpha() for c in t or "")


SYLLABLES = {"xa": ["ka", "to", "mi", "ren", "su"], "xb": ["gra", "pli", "ost", "en", "wi"], "xc": ["ça", "ñu", "ora", "ell", "ima"]}
DOCS = "doc_id long, text string, lang string, source string, u long, y int, at string, score double"


def language_rows(n):
    rng = random.Random(11)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4)))
    langs = [rng.choice([*SYLLABLES]) for _ in range(n)]
    return [(i, " ".join(word(lang) for _ in range(rng.randrange(3, 40))), lang) for i, lang in enumerate(langs)]


def test_languages_are_learned_from_the_other_folds(spark, tmp_path):
    import zlib

    rows = language_rows(400)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    odd = [(1000 + i, t, None) for i, t in enumerate(ODD_TEXTS)] + [(None, "kato mi ren", "zz"), (rows[0][0], rows[0][1], rows[0][2]), (2000, "", "xa"), (2001, "123", "xb"), (2002, None, "xc")]
    lying = next(i for i in range(3000, 4000) if held(i))
    odd.append((lying, "qqq qqq", "only held out"))
    docs = spark.createDataFrame([(i, t, lang, "s", 1, 2, "at", 0.5) for i, t, lang in rows + odd], DOCS).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["op11_language_id"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows + odd) and all(0 <= r.score <= 1 for r in got) and {r.lang_pred for r in got} <= {*SYLLABLES, "und"}
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == held(i) for i, _, _ in rows)
    wrong = [i for i, _, lang in rows if held(i) and by[i].lang_pred != lang]
    assert len(wrong) <= 2
    for i, t, _ in odd:
        assert (by[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    again = registry.QUERIES["op11_language_id"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)


def test_uncertain_texts_are_unknown(spark):
    rows = language_rows(300)
    docs = spark.createDataFrame([(i, t, lang, "s", 1, 2, "at", 0.5) for i, t, lang in rows], DOCS)
    model = language_id.train(docs)
    found = language_id.detect(docs, model).where("lang <> 'und'").count()
    strict = language_id.dataclasses.replace(model, least=2.0)
    assert found > 280 and {r.lang for r in language_id.detect(docs, strict).collect()} == {"und"}


def test_no_languages(spark):
    docs = spark.createDataFrame([(1, "abc", None, "s", 1, 2, "at", 0.5)], DOCS)
    assert [(r.lang_pred, r.score) for r in language_id.predict(docs, language_id.train(docs)).collect()] == [("und", 0.0)]
    empty = docs.limit(0)
    assert language_id.predict(empty, language_id.train(empty)).count() == 0


def test_rejection_follows_the_calibrating_rows(spark):
    """Scores below which the model errs are refused; the temperature lowers overconfident scores."""
    model = language_id.Model(["a", "b"], np.zeros((1 << language_id.BITS, 2), np.float32), np.zeros(2))
    model.table[1], model.table[2] = [4, -4], [0.2, -0.2]
    one = np.array([1], "<i4").tobytes()  # a count
    rows = [(i, 0 if i % 2 or i < 60 else 1, np.array([1 if i < 60 else 2], "<u2").tobytes(), one) for i in range(100)]
    fitted = language_id.calibrated(model, spark.createDataFrame(rows, "u long, y int, at binary, n binary"))
    low = fitted.probabilities(language_id._dense(language_id.pa.table({"at": [rows[99][2]], "n": [one]})))
    high = fitted.probabilities(language_id._dense(language_id.pa.table({"at": [rows[0][2]], "n": [one]})))
    assert low.max() < fitted.least <= high.max()
