import pytest

from textloom import __main__ as cli
from textloom.operators import index
from textloom.plans.engine import Normalization, QueryType, Ranking, SearchEngine

DOCS = [(0, "the cat sat on the mat"), (1, "the dog"), (2, "cat and dog and cat"), (3, "the")]


@pytest.fixture(scope="module")
def engine(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    pr = spark.createDataFrame([(0, 0.5), (2, 0.25)], "doc_id long, pr double")
    links = spark.createDataFrame([(0, 2), (1, 2), (2, 0), (2, 2)], "src long, dst long")
    return SearchEngine(index.Index.build(docs), pagerank=pr, links=links)


def ids(df):
    return sorted((r.query_id, r.doc_id) for r in df.collect())


def test_kinds(engine):
    assert ids(engine.search(["c* dog", "the"], QueryType.INTERSECTION)) == [(0, 2), (1, 0), (1, 1), (1, 3)]
    assert ids(engine.search(["d* and"], QueryType.PHRASE)) == [(0, 2)]
    assert ids(engine.search(["cat dog"], QueryType.UNION)) == [(0, 0), (0, 1), (0, 2)]


def test_rankings(engine):
    words = {r.doc_id: r.score for r in engine.search(["cat"]).collect()}
    both = {r.doc_id: r.score for r in engine.search(["cat"], ranking=Ranking.COMBINATION).collect()}
    rank = {r.doc_id: r.score for r in engine.search(["the"], ranking=Ranking.PAGERANK).collect()}
    assert both == pytest.approx({0: words[0] + 250, 2: words[2] + 125}) and rank == {0: 0.5, 1: 0.0, 3: 0.0}
    assert {r.doc_id for r in engine.search(["cat"], normalization=Normalization.EUCLIDEAN).collect()} == {0, 2}
    hits = {r.doc_id: r.score for r in engine.search(["mat"], ranking=Ranking.HITS).collect()}
    assert set(hits) == {0, 2} and hits[2] > 0
    assert engine.search([""]).count() == 0


def test_feedback_and_suggestions(engine, spark):
    more = engine.feedback(["cat"], spark.createDataFrame([(0, 0)], "query_id int, doc_id long"))
    assert {r.doc_id for r in engine.search(more).collect()} == {0, 1, 2, 3}
    found = engine.search(["catt", "dog"], QueryType.INTERSECTION)
    assert [(r.query_id, r.phrase) for r in engine.suggest(["catt", "dog"], found).orderBy("rank").collect()][:1] == [(0, "cat")]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c").mkdir()
    for i, t in DOCS:
        (tmp_path / "c" / f"{i}.txt").write_text(t)
    cli.main(["index", "--corpus", f"{tmp_path}/c", "--out", f"{tmp_path}/i"])
    cli.main(["search", "--index", f"{tmp_path}/i", "--query", "cat", "--top", "1"])
    assert capsys.readouterr().out.split("\t")[:3] == ["0", "1", "2"]
    cli.main(["kgrams", "--index", f"{tmp_path}/i", "--kgram", "at"])
    assert capsys.readouterr().out.split() == ["3", "terms", "cat", "mat", "sat"]
    cli.main(["kgrams", "--corpus", f"{tmp_path}/c", "--kgram", "at$"])
    assert capsys.readouterr().out.split() == ["3", "terms", "cat", "sat", "mat"]
    with pytest.raises(SystemExit):
        cli.main(["kgrams", "--corpus", f"{tmp_path}/c", "--kgram", "at"])
    capsys.readouterr()
    (tmp_path / "links").write_text("1;2,3\n2;3\n")
    cli.main(["pagerank", "--links", f"{tmp_path}/links"])
    assert capsys.readouterr().out.startswith("3\t0.")
    cli.main(["hits", "--links", f"{tmp_path}/links"])
    assert "hub\n1: " in capsys.readouterr().out


def test_hits_by_titles(spark):
    """Documents are nodes by their file names; queries of a batch are scaled and stop by themselves."""
    docs = spark.createDataFrame([(0, "/corpus/Alpha", "the cat"), (1, "corpus\\\\b\\\\Beta", "a dog"), (2, "/corpus/none", "cat")], "doc_id long, name string, text string")
    titles = spark.createDataFrame([(10, "Alpha"), (11, "Beta"), (12, "Gamma"), (13, "Beta")], "node long, title string")
    links = spark.createDataFrame([(10, 11), (12, 11), (11, 10), (12, 10), (99, 11)], "src long, dst long")
    e = SearchEngine(index.Index.build(docs), links=links, titles=titles)
    both = {(r.query_id, r.doc_id): r.score for r in e.search(["cat", "dog"], ranking=Ranking.HITS).collect()}
    assert set(both) == {(0, 0), (0, 1), (1, 0), (1, 1)}
    for i, q in enumerate(["cat", "dog"]):
        one = {r.doc_id: r.score for r in e.search([q], ranking=Ranking.HITS).collect()}
        assert {d: s for (k, d), s in both.items() if k == i} == pytest.approx(one)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from textloom import session

    context = N(getConf=lambda: N(get=lambda _: None), _jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isEmpty=lambda: True))), master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(N(sparkContext=context))


def test_copies_are_deleted(spark):
    from textloom import session

    for made in (session.written(spark.range(5), "one"), session.bucketed(spark.range(5), "two", "id")):
        path = made._textloom_path
        assert made.count() == 5 and spark.read.parquet(path).count() == 5
        session.dropped(made)
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            spark.read.parquet(path)
