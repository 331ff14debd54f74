"""The pipeline on small made documents: every stage takes effect and keeps clean documents."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["ba", "ri", "to", "ne", "lu", "sa"]) for _ in range(rng.randrange(1, 4)))
    text = lambda: " ".join(word() for _ in range(rng.randrange(60, 160))) + "."
    clean = [text() for _ in range(120)]
    junk = [" ".join(word().upper() + "!!" + rng.choice("#$%&") * 3 for _ in range(80)) for _ in range(60)]
    special = {500: clean[0], 501: clean[0] + " " + clean[1], 502: "too short", 503: " ".join(["one two three four five"] * 30), 504: clean[2] + " mail me at some.one@mail3.example.com now"}
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in [*enumerate(clean), *((200 + k, t) for k, t in enumerate(junk)), *special.items()]]
    rows.append((600, None, "en", None, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200), 0) for i in [*range(120), *range(200, 260)]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path)).cache()
        assert at.columns == docs.columns
        seen[name] = {r.doc_id: r.text for r in at.collect()}
    good = seen["quality classifier"]
    assert set(range(120)) <= set(good) and not set(range(200, 260)) & set(good)
    ruled = seen["quality rules"]
    assert set(range(120)) <= set(ruled) and not {502, 503, 600} & set(ruled)
    assert set(range(120)) <= set(seen["SimHash near-dedup"]) and 500 not in seen["SimHash near-dedup"]
    last = seen["PII"]
    assert all(last[i] == clean[i] for i in range(120)) and "some.one@mail3" not in str(last.values())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(last) and all(p.length > 0 for p in pieces)


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(90))
    a, b, c, d = (text() for _ in range(4))
    rows = [(None, a), (None, a), (None, b), (7, b), (5, b), (9, c), (9, c), (9, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.one_of_each(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(None, a), (5, b), (9, c), (9, d)], key=str)
