"""Sources that share a long prefix are told apart by the tree."""

from boxwright.llm.sharding import ranks, shard


def test_sources_of_one_prefix_are_split(spark):
    rows = [(i, f"text number {i:04d}", "en", f"common_crawl_{'ab'[i % 2]}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r.shard for r in shard(docs, 2).collect()}
    assert len(out) == 400 and all(out[i] == out[i % 2] for i in out) and out[0] != out[1]


def test_ranks_are_the_order_of_the_values(spark):
    values = [None, "", "b", "common_crawl_a", "common_crawl_b", "z" * 300]
    docs = spark.createDataFrame([(s, None) for s in values * 3], "source string, lang string")
    got = {(r.kind, r.x): r["rank"] for r in ranks(docs).collect()}
    assert len(got) == 7 and [got[("source", v)] for v in values] == sorted(got[("source", v)] for v in values) and len(set(got.values())) == 7
