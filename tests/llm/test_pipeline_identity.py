"""Stages of the pipeline on rows whose ids are null or repeated."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_null_and_repeated_ids_escape_no_stage(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60))
    near = lambda t, w: t.rsplit(" ", 1)[0] + " " + w
    a, b, c, d, e, bad = (text() for _ in range(6))
    rows = [(None, a), (None, near(a, "x")), (None, near(a, "y")), (None, a)]  # a group without ids
    rows += [(3, b), (None, near(b, "x")), (None, b), (4, near(b, "y"))]  # copies of a kept document
    rows += [(5, c), (5, d), (5, near(c, "x")), (1, near(d, "x"))]  # one id in two groups
    rows += [(None, e), (None, bad), (7, bad + " z"), (7, text()), (8, None), (None, None), (9, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    kept = p.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    of = lambda t: [(i, x) for i, x in got if x and x.split()[:50] == t.split()[:50]]
    assert len(of(a)) == 1 and of(a)[0] in rows
    assert of(b) == [(3, b)]
    assert len(of(c)) == 1 and of(c)[0][0] == 5
    assert of(d) == [(1, near(d, "x"))]
    assert of(e) == [(None, e)] and of(bad) == [(7, bad + " z")]
    assert {x for x in got if not x[1]} == {(8, None), (None, None), (9, ""), (None, "")} and len(got) == 11

    spark.createDataFrame([(1, bad)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = sorted((str(r.doc_id), str(r.text)) for r in p.decontamination(spark, docs, str(tmp_path)).collect())
    assert clean == sorted((str(i), str(t)) for i, t in rows if not (t or "").startswith(bad))
