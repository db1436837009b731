"""Cases of the second round's findings."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_queries import rows

from textloom.functions import strings
from textloom.operators import graph, index, search
from textloom.plans import registry


@pytest.fixture(scope="module")
def umlauts(spark, tmp_path_factory):
    """Terms near `teh` and `ationx` with letters of two bytes."""
    d = str(tmp_path_factory.mktemp("umlauts"))
    spark.createDataFrame([(0, "teäch teöch tech täh teh1 the of thing"), (1, "ationä äationx ation und te"), (2, None)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def same(name, spark, d):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    got = rows(registry.QUERIES[name](spark, d).toPandas())
    assert got == rows(c.sql(registry.ORACLES[name]).df())
    return got[1]


@pytest.mark.parametrize("name", ["spell_candidates", "spell_multiword"])
def test_edits_count_as_in_their_sql(name, spark, umlauts):
    assert same(name, spark, umlauts)


@pytest.mark.parametrize("few", [10**6, 0])
def test_rounds_read_links_between_classes(spark, monkeypatch, few):
    """Leaves that one node links to have one score, so rounds read one link to them and one from them."""
    monkeypatch.setattr(graph, "FEW_NODES", few, raising=False)
    sizes, real = [], graph.bucketed
    monkeypatch.setattr(graph, "bucketed", lambda df, *a, **k: "share" in df.columns and sizes.append(df.where("share > 0").count()) or real(df, *a, **k))
    leaves = [f"l{i}" for i in range(50)]
    links = [("a", x) for x in leaves] + [(x, "b") for x in leaves] + [("b", "a"), ("b", "sink"), ("c", "a"), ("c", "a")]
    got = {r.node: r.pr for r in graph.pagerank(spark.createDataFrame(links, "src string, dst string"), tolerance=0, rounds=4).collect()}
    assert sizes and sizes[0] <= 7
    out = {v: {d for s, d in links if s == v} for v in {x for link in links for x in link}}
    ranks = dict.fromkeys(out, 1 / len(out))
    for _ in range(4):
        lost = sum(ranks[v] for v in out if not out[v])
        ranks = {v: (0.15 + 0.85 * lost) / len(out) + 0.85 * sum(ranks[u] / len(out[u]) for u in out if v in out[u]) for v in out}
    assert got == pytest.approx(ranks, abs=1e-12)


def test_hits_broadcasts_or_shuffles_its_vector(spark, monkeypatch):
    """Both ways give the same scores, and a round over few nodes shuffles no links."""
    links = spark.createDataFrame([(i, (i * 7 + j * j) % 30) for i in range(30) for j in range(4)], "src long, dst long")
    base = spark.createDataFrame([(q, i) for q in (0, 1) for i in range(30 - 9 * q)], "query_id int, node long")
    run = lambda: {(r.query_id, r.node): pytest.approx((r.hub, r.auth), abs=1e-9) for r in graph.hits(links, base, rounds=3, by=("query_id",)).collect()}
    shared = run()
    monkeypatch.setattr(graph, "FEW_NODES", 0)
    assert {k: v.expected for k, v in run().items()} == shared and len(shared) == 51


def test_postings_are_made_in_their_rows(spark):
    """No shuffle of tokens; ids given twice and empty texts give what sums over tokens give."""
    docs = spark.createDataFrame([(0, "b a b, c"), (1, ""), (2, None), (3, "A a"), (4, "É x1")], "doc_id long, text string")
    plan = index.document_postings(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    key = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    for rows_ in (docs, docs.unionByName(docs.where("doc_id <> 1"))):
        toks = index.tokens(rows_)
        assert key(index.document_postings(rows_)) == key(index.postings(toks))
        assert key(index.document_counts(rows_)) == key(index.counts(toks))
        assert key(index.document_vocabulary(rows_)) == key(index.vocabulary(index.counts(toks)))


def test_a_documents_terms_are_grouped_by_number(spark):
    """Postings, counts, merged segments and a saved index are made without interpreted lambdas over tokens; batches that are slices, and of several rows, keep their rows apart."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["b a b, c", "", None, "A a", "é x1 É", "c b a c", ""])], "doc_id long, text string").coalesce(1)
    found = index.document_tokens(docs)
    key = lambda df: sorted(tuple(map(str, r)) for r in df.select("term", "doc_id", "tf", "offsets").collect())
    whole = key(index.postings(index.tokens(docs)))
    parts = [index.document_segment(found, lambda pos, k=k: pos % 3 == k) for k in (2, 0, 1)]
    for made in (index.document_postings(docs), index.merge_document_segments(*parts), index.merge_document_segments(index.document_segment(found))):
        assert key(made) == whole
        assert "MapInArrow" in made._jdf.queryExecution().toString()
    assert index.document_postings(docs.limit(0)).count() == 0
    batch = pa.RecordBatch.from_pydict({"doc_id": [5, 6, 7], "found": [["q"], ["b", "a", "b"], []]})
    assert index._grouped(batch.slice(1)).to_pydict() == {"term": ["b", "a"], "doc_id": [6, 6], "tf": [2, 1], "offsets": [[0, 2], [1]]}


def test_phrases_meet_in_their_row(spark, tmp_path):
    """What is shuffled is whole phrases; slots with several terms, words said twice, gaps of idx and short texts give what a join of all tokens gives."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["the the thing the the", "of the of the", "the", "", None, "of", "b a c a", "a b a"])], "doc_id long, text string")
    q = search.parse_queries(spark, ["the the", "of the of", "the", "the nosuch", "nosuch", "", "thing the the"])
    gaps = spark.createDataFrame([(8, 1, "b"), (8, 3, "c"), (9, 0, "a"), (9, 2, "a")], "query_id int, idx int, term string").withColumn("weight", F.lit(1.0))
    several = q.select("query_id", "idx", "term").unionByName(spark.createDataFrame([(0, 1, "thing"), (3, 1, "thing"), (3, 1, "the"), (2, 0, "of")], "query_id int, idx int, term string"))
    key = lambda df: sorted((r.query_id, r.doc_id, tuple(r.offsets)) for r in df.collect())
    for batch, slots in ((q, None), (gaps, None), (q, several)):
        made = search.document_phrase(batch, index.document_tokens(docs), slots=slots)
        assert key(made) == key(search.phrase(batch, index.tokens(docs), slots=slots)) and key(made)
        assert made._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(") <= 1 + 2


def test_kgrams_of_any_characters(spark):
    """Windows go by code points, also beyond U+FFFF and across line ends; no lambda is run for a term of usual characters."""
    terms = ["", "a", "aaa", "ation", "x\ny", "é𝒜b𝒜", "𝒜", "ß", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "i int, term string")
    for k in (1, 2, 3, 5):
        got = {r.i: r.g for r in df.select("i", strings.kgrams(F.col("term"), k).alias("g")).collect()}
        want = {i: [] if t is None else list(dict.fromkeys(f"^{t}$"[j : j + k] for j in range(len(t) + 3 - k))) for i, t in enumerate(terms)}
        assert got == want
    assert "regexp_extract_all" in df.select(strings.kgrams(F.col("term")).alias("g"))._jdf.queryExecution().toString()


def test_lengths_shuffle_rare_terms_alone(spark, monkeypatch):
    """Frequent and rare terms add up to the same lengths, however many are broadcast."""
    docs = spark.createDataFrame([(i, f"the of w{i} w{i} v{i % 3} the") for i in range(20)] + [(20, ""), (21, "the")], "doc_id long, text string")
    tf = index.written(index.document_counts(docs), "counts")
    vocab, n = index.written(index.vocabulary(tf), "vocab"), index.n_docs(docs)
    lengths = lambda **how: {r.doc_id: r.euclid_len for r in index.euclidean_lengths(tf, vocab, n, **how).collect()}
    whole = lengths()
    for few in (1, 4, 100):
        monkeypatch.setattr(index, "FREQUENT", few)
        assert lengths(held=True) == pytest.approx(whole, abs=1e-12) and len(whole) == 21


def test_lines_are_decoded_and_encoded_again_without_a_shuffle(spark):
    """Decoded postings keep their line's part, so lines meet where they were; lines without a part are decoded too."""
    docs = spark.createDataFrame([(i, f"a b{i % 3} a c") for i in range(7)], "doc_id long, text string")
    lines = index.encode_postings(index.document_postings(docs), span=4)
    again = index.encode_postings(index.decode_postings(lines), span=4)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(again) == key(lines) and len(key(lines)) == 10
    assert again._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    bare = index.decode_postings(lines.select("term", "line"))
    assert bare.columns == ["term", "doc_id", "tf", "offsets"] and bare.count() == index.document_postings(docs).count()


@pytest.mark.parametrize("path", ["endpoint", "complete"])
def test_a_step_of_walks_shuffles_walkers_alone(spark, monkeypatch, path):
    """Links carry their target's degree and are bucketed, so no step shuffles links or degrees."""
    plans, real = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: name == "going" and plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = spark.createDataFrame([(i, (i * j + 1) % 40) for i in range(40) if i % 5 for j in (1, 2, 3)], "src long, dst long")
        got = {r.node: r.pr for r in graph.monte_carlo(links, spark.range(40).select(F.col("id").alias("node")), start="cyclic", path=path, walks=3, most_steps=4).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 40 and sum(got.values()) == pytest.approx(1.0)
    assert len(plans) == 5  # the start and four steps
    assert all(p.count("Exchange hashpartitioning") == (1 if path == "complete" else 2) for p in plans[1:])


def test_a_saved_index_is_written_in_blocks(spark, tmp_path):
    """Postings and k-grams are saved as a row for many, without a shuffle of either; what is loaded are the same rows, ids in any order or given twice."""
    docs = spark.createDataFrame([(i * 7 % 40, f"the of w{i} the v{i % 3} é{i % 5} the") for i in range(40)] + [(41, ""), (42, None), (43, "the")], "doc_id long, text string").coalesce(2)
    key = lambda df: sorted(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())
    for n, rows_ in enumerate((docs, docs.unionByName(docs.where("doc_id < 3")), docs.limit(0))):
        path = f"{tmp_path}/{n}"
        built = index.Index.build(rows_, k=3, patterns=None)
        built.save(path)
        loaded = index.Index.load(spark, path)
        for made, kept in ((loaded.postings, index.postings(index.tokens(rows_))), (loaded.vocab, built.vocab), (loaded.kgrams, built.kgrams), (loaded.docs, built.lengths)):
            assert key(made) == key(kept)
        assert {r.doc_id: r.euclid_len for r in loaded.doc_stats.collect()} == pytest.approx({r.doc_id: r.euclid_len for r in built.doc_stats.collect()})
    blocks = spark.read.parquet(f"{tmp_path}/0/postings")
    assert blocks.count() < index.postings(index.tokens(docs)).count() / 2
    assert spark.read.parquet(f"{tmp_path}/0/kgrams").count() < index.kgram_index(index.document_vocabulary(docs), 3).count()
    assert all(r.doc_ids == sorted(r.doc_ids) and len(r.offsets) == r.ends[-1] for r in blocks.collect())
    assert "Exchange" not in index.posting_blocks(index.document_tokens(docs))._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_kgrams_are_those_of_each_term():
    """Windows of all terms at once: letters beyond U+FFFF, line ends, terms that are too short, and more letters than a key has room for."""
    many = ["".join(chr(0x4E00 + (i * 37 + j * j * 101) % 20000) for j in range(i % 9)) for i in range(2000)]
    for terms in (["", "a", "aaa", "ation", "x\ny", "é𝒜b𝒜", "𝒜", "ß"], list(dict.fromkeys(many)), [""], []):
        for k in (1, 2, 3, 6):
            want = {}
            for t in terms:
                for g in {f"^{t}$"[j : j + k] for j in range(len(t) + 3 - k)}:
                    want.setdefault(g, []).append(t)
            made = index._windows(pa.array(terms, pa.string()), k)
            assert made.num_rows == len(want)
            assert dict(zip(made.column(0).to_pylist(), made.column(1).to_pylist())) == want
    batches = [pa.record_batch([pa.array([1] * n, pa.int64())], ["x"]) for n in (2, 3, 0, 1)]
    assert [b.num_rows for b in index._gathered(batches, 4, len)] == [5, 1]


def test_a_batch_of_graphs_is_summed_by_hash_and_its_root_is_made_once(spark, monkeypatch):
    """Graphs go by a number, so no round sorts for its sums; what a root is made of is no part of the base set's plan. A graph may have a null for a name."""
    links = spark.createDataFrame([(i, (i * 7 + j * j) % 30) for i in range(30) for j in range(4)], "src long, dst long")
    root = spark.createDataFrame([(q, i) for q in (0, None) for i in range(0, 30, 6)], "query_id int, node long")
    made = root.mapInArrow(lambda batches: batches, "query_id int, node long")
    base = graph.base_set(links, made, by=("query_id",))
    assert "MapInArrow" not in base._jdf.queryExecution().toString()
    plans, real = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: name == "step" and plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    got = {(r.query_id, r.node): (r.hub, r.auth) for r in graph.hits(links, base, rounds=3, by=("query_id",)).collect()}
    assert plans and not any("SortAggregate" in p for p in plans)
    one = {r.node: (r.hub, r.auth) for r in graph.hits(links, base.where("query_id = 0").select("node"), rounds=3).collect()}
    assert one and got == {(q, node): pytest.approx(v, abs=1e-9) for q in (0, None) for node, v in one.items()}
