"""Small cases whose results are known, and laws that results keep."""

import math

import pytest
from pyspark.sql import functions as F

from textloom.operators import graph, index, search, spelling
from textloom.sources import files
from textloom.streaming import ingest


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(0, "the cat sat on the mat"), (1, "the dog"), (2, "cat and dog and cat"), (3, "the"), (4, "")], "doc_id long, text string")


def found(df):
    return sorted((r.query_id, r.doc_id) for r in df.collect())


def test_boolean(spark, docs):
    q = search.parse_queries(spark, ["the cat", "cat the", "the nosuch", "nosuch the", "The  THE", ""])
    toks = index.tokens(docs)
    tf = index.counts(toks)
    assert found(search.intersection(q, tf)) == [(0, 0), (1, 0), (4, 0), (4, 1), (4, 3)]
    assert found(search.union(q, index.postings(toks)))[:4] == [(0, 0), (0, 1), (0, 2), (0, 3)]
    ends = {(r.query_id, r.doc_id): r.offsets for r in search.phrase(q, toks).collect()}
    assert ends == {(0, 0): [1]}


def test_wildcards(spark, docs):
    vocab = index.vocabulary(index.counts(index.tokens(docs)))
    q = search.parse_queries(spark, ["*at", "c*", "m*t", "*", "d*g", "x%*"])
    got = sorted((r.query_id, r.term) for r in search.expand_wildcards(q, vocab).collect())
    assert got == [(0, "cat"), (0, "mat"), (0, "sat"), (1, "cat"), (2, "mat"), (4, "dog")]


def test_tfidf_by_hand(spark, docs):
    q = search.parse_queries(spark, ["cat"])
    tf = index.counts(index.tokens(docs))
    scores = {r.doc_id: r.score for r in search.tfidf(q, tf, index.doc_lengths(docs), index.n_docs(docs), "n_tokens").collect()}
    assert scores == pytest.approx({0: math.log(5 / 2) / 6, 2: 2 * math.log(5 / 2) / 5})


def test_zero_length_scores_zero(spark):
    docs = spark.createDataFrame([(0, "a"), (1, "a")], "doc_id long, text string")
    tf = index.counts(index.tokens(docs))
    n = index.n_docs(docs)
    lengths = index.euclidean_lengths(tf, index.vocabulary(tf), n)
    got = [r.score for r in search.tfidf(search.parse_queries(spark, ["a"]), tf, lengths, n, "euclid_len").collect()]
    assert got == [0.0, 0.0]


def test_rocchio_without_relevant_documents_changes_nothing(spark, docs):
    q = search.parse_queries(spark, ["cat cat dog"])
    tf = index.counts(index.tokens(docs))
    none = spark.createDataFrame([], "query_id int, doc_id long")
    got = sorted((r.idx, r.term, r.weight) for r in search.rocchio(q, none, tf, index.vocabulary(tf), index.n_docs(docs)).collect())
    assert got == [(0, "cat", 1.0), (1, "cat", 1.0), (2, "dog", 1.0)]
    some = spark.createDataFrame([(0, 2)], "query_id int, doc_id long")
    got = {(r.idx, r.term): r.weight for r in search.rocchio(q, some, tf, index.vocabulary(tf), index.n_docs(docs)).collect()}
    assert got[0, "cat"] == pytest.approx(0.2 + 0.8 * 2 * math.log(5 / 2)) and got[1, "cat"] == pytest.approx(0.2)
    assert got[None, "and"] == pytest.approx(0.8 * 2 * math.log(5))


def test_suggestions(spark, docs):
    toks = index.tokens(docs)
    vocab = index.vocabulary(index.counts(toks))
    q = search.parse_queries(spark, ["catt dog", "the dog", "cat nosuchthing"])
    needed = search.suggestions_needed(q, search.intersection(q, index.counts(toks)), vocab)
    assert sorted(r.query_id for r in needed.collect()) == [0, 2]
    best = spelling.correct(q.where("query_id = 0"), vocab).orderBy("rank").collect()
    assert best[0].phrase == "cat dog"
    assert not spelling.correct(q.where("query_id = 2"), vocab).collect()


def test_pagerank(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("a", "c"), ("d", "d")], "src string, dst string")
    got = {r.node: r.pr for r in graph.pagerank(links, tolerance=1e-9, rounds=60).collect()}
    ranks = dict.fromkeys("abcd", 0.25)
    out = {"a": "bc", "b": "a", "c": "", "d": "d"}
    for _ in range(200):
        lost = sum(ranks[v] for v in out if not out[v])
        ranks = {v: 0.15 / 4 + 0.85 * lost / 4 + 0.85 * sum(ranks[u] / len(out[u]) for u in out if v in out[u]) for v in ranks}
    assert sum(got.values()) == pytest.approx(1) and got == pytest.approx(ranks, abs=1e-6)


def test_hits_counts_repeated_links(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("d", "c")], "src string, dst string")
    v = {r.node: (r.hub, r.auth) for r in graph.hits(links, rounds=40).collect()}
    assert sum(h * h for h, _ in v.values()) == pytest.approx(1) and sum(a * a for _, a in v.values()) == pytest.approx(1)
    assert v["b"][1] > v["c"][1] > 0 and v["b"][0] == 0


def test_walks_agree_with_pagerank(spark):
    nodes = spark.range(40).select(F.col("id").alias("node"))
    links = nodes.where("node % 4 <> 0").select(F.col("node").alias("src"), ((F.col("node") * 3 + 1) % 40).alias("dst")).union(nodes.select(F.col("node").alias("src"), (F.col("node") % 7).alias("dst")).where("src % 4 <> 0"))
    exact = graph.pagerank(links, nodes, tolerance=0, rounds=30)
    walks = graph.monte_carlo(links, nodes, start="cyclic", path="complete", walks=200, most_steps=40)
    assert graph.goodness(exact, walks).first().ssd < 1e-3
    assert walks.agg(F.sum("pr")).first()[0] == pytest.approx(1)


def test_save_and_load(spark, docs, tmp_path):
    index.Index.build(docs).save(str(tmp_path))
    loaded = index.Index.load(spark, str(tmp_path))
    assert sorted((r.doc_id, r.tf, r.offsets) for r in loaded.lookup("cat").collect()) == [(0, 1, [1]), (2, 2, [0, 4])]
    plan = loaded.lookup("cat")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,cat)" in plan


def test_stream_segments(spark, docs, tmp_path):
    source = f"{tmp_path}/in"
    for part in (docs.where("doc_id < 2"), docs.where("doc_id >= 2")):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, text string").parquet(source)
        ingest.ingest(stream, f"{tmp_path}/segments", f"{tmp_path}/state").awaitTermination(120)
    rows = lambda df: sorted((r.term, r.doc_id, r.tf, r.offsets) for r in df.collect())
    assert rows(ingest.merged(spark, f"{tmp_path}/segments")) == rows(index.postings(index.tokens(docs)))


def test_files(spark, tmp_path):
    (tmp_path / "links").write_text("1;2,3,3\n2;\nno line\nx;1\n3;1,y\n")
    assert sorted(tuple(r) for r in files.links_by_number(spark, f"{tmp_path}/links").collect()) == [(1, 2), (1, 3), (1, 3), (3, 1)]
    assert ("x", "1") in {tuple(r) for r in files.links_by_name(spark, f"{tmp_path}/links").collect()}
    (tmp_path / "titles").write_text("7;a;b\n")
    assert files.titles(spark, f"{tmp_path}/titles").first().title == "a;b"
    assert files.titles(spark, f"{tmp_path}/titles", whole=False).first().title == "a"
    assert files.pattern_lines(["// no", " ", " a+ ", "b"]) == ("a+", "b")
    (tmp_path / "corpus" / "sub").mkdir(parents=True)
    (tmp_path / "corpus" / "b.txt").write_text("two\nlines")
    (tmp_path / "corpus" / "sub" / "c.txt").write_text("three")
    docs = files.corpus(spark, f"{tmp_path}/corpus")
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(0, "two\nlines"), (1, "three")]
    name = docs.where("doc_id = 0").first()["name"]
    (tmp_path / "pr").write_text(f"{name} 0.25\nunknown 1\n")
    assert [tuple(r) for r in files.pagerank_scores(spark, f"{tmp_path}/pr", docs).collect()] == [(0, 0.25)]
    files.write_doc_info(docs.withColumn("n_tokens", F.lit(2)), f"{tmp_path}/info")
    assert {tuple(r)[1:] for r in files.doc_info(spark, f"{tmp_path}/info").collect()} == {(r["name"], 2) for r in docs.collect()}
    top = files.top_lines(spark.createDataFrame([(5, 0.5), (6, 0.25)], "node long, hub double"), "hub").orderBy("rank").collect()
    assert top[0].line == "5: 0.50000"


def test_entry_without_corpus_operators(spark):
    import __spark_entry__ as entry

    assert set(entry.queries()) >= {"tok_standard", "pagerank", "ranked_batch_topk"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
