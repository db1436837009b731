"""Command line: python -m textloom tokens | index | search | suggest | kgrams | pagerank | walks | hits."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .functions import text
from .operators import graph, index, search
from .plans.engine import Normalization, QueryType, Ranking, SearchEngine
from .session import get_session
from .sources import files


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textloom")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, *flags):
        p = sub.add_parser(name)
        for flag, how in flags:
            p.add_argument(flag, **how)

    pattern, one, yes = ("--patterns", {}), {"required": True}, {"action": "store_true"}
    command("tokens", ("--corpus", one), pattern, ("--case-folding", yes), ("--remove-diacritics", yes), ("--remove-punctuation", yes))
    command("index", ("--corpus", one), ("--out", one), pattern, ("--no-patterns", yes), ("--k", {"type": int, "default": 2}))
    command("search", ("--index", one), ("--query", one | {"action": "append"}), ("--kind", {"default": "ranked"}), ("--ranking", {"default": "tf_idf"}), ("--normalization", {"default": "n_tokens"}), ("--links", {}), ("--pagerank", {}), ("--top", {"type": int, "default": 10}))
    command("suggest", ("--index", one), ("--query", one | {"action": "append"}), ("--top", {"type": int, "default": 10}))
    command("kgrams", ("--index", {}), ("--corpus", {}), pattern, ("--k", {"type": int, "default": 3}), ("--kgram", one | {"action": "append"}), ("--top", {"type": int, "default": 10}))
    command("pagerank", ("--links", one), ("--titles", {}), ("--out", {}), ("--top", {"type": int, "default": 30}))
    command("walks", ("--links", one), ("--start", {"default": "random"}), ("--path", {"default": "endpoint"}), ("--walks", {"type": int, "required": True}), ("--trials", {"type": int, "default": 1}), ("--top", {"type": int, "default": 30}))
    command("hits", ("--links", one), ("--titles", {}), ("--top", {"type": int, "default": 30}))
    return top


def main(argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    spark = get_session()
    pick = lambda: files.patterns(spark, a.patterns) if a.patterns else None
    show = lambda df, *cols: [print(*r, sep="\t") for r in df.select(*cols).toLocalIterator()]
    if a.command == "tokens":
        toks = index.tokens(files.corpus(spark, a.corpus), patterns=pick(), case_folding=a.case_folding, remove_diacritics=a.remove_diacritics, remove_punctuation=a.remove_punctuation)
        show(toks.orderBy("doc_id", "pos"), "term")
    elif a.command == "index":
        index.Index.build(files.corpus(spark, a.corpus), k=a.k, patterns=None if a.no_patterns else pick() or text.PATTERNS).save(a.out)
    elif a.command == "search":
        loaded = index.Index.load(spark, a.index)
        engine = SearchEngine(loaded, pagerank=spark.read.parquet(a.pagerank) if a.pagerank else None, links=files.links_by_number(spark, a.links) if a.links else None)
        kind = QueryType(a.kind)
        found = engine.search(a.query, kind, Ranking(a.ranking), Normalization(a.normalization))
        show(search.top(found if kind is QueryType.RANKED else found.withColumn("score", F.lit(0.0)), a.top).orderBy("query_id", "rank"), "query_id", "rank", "doc_id", F.format_string("%.5f", "score"))
    elif a.command == "suggest":
        engine = SearchEngine(index.Index.load(spark, a.index))
        show(engine.suggest(a.query, engine.search(a.query, QueryType.INTERSECTION), a.top).orderBy("query_id", "rank"), "query_id", "phrase", "score")
    elif a.command == "kgrams":
        if a.corpus:  # terms in the order in which they are first seen
            toks = index.tokens(files.corpus(spark, a.corpus), patterns=pick() or text.PATTERNS)
            order, k = toks.groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("at")), a.k
            grams = index.kgram_index(order, k)
        else:
            loaded = index.Index.load(spark, a.index)
            grams, order = loaded.kgrams, loaded.vocab.select("term", F.col("term").alias("at"))
            k = (loaded.kgrams.agg(F.max(F.length("kgram"))).first()[0]) or a.k
        if wrong := [x for x in a.kgram if len(x) != k]:
            raise SystemExit(f"k-grams of {k} characters are asked for, not {', '.join(wrong)}")
        terms = index.kgram_intersect(grams, a.kgram)
        print(terms.count(), "terms")
        show(terms.join(order, "term").orderBy("at").limit(a.top), "term")
    elif a.command in ("pagerank", "walks"):
        links = files.links_by_name(spark, a.links)
        if a.command == "pagerank":
            scores = graph.pagerank(links)
        else:
            scores = graph.averaged(*(graph.monte_carlo(links, graph.nodes_of(links), start=a.start, path=a.path, walks=a.walks, seed=1 + t) for t in range(a.trials)))
        if a.command == "pagerank" and a.titles:
            scores = graph.with_titles(scores, files.titles(spark, a.titles).withColumn("node", F.col("node").cast("string")))
        else:
            scores = scores.withColumn("name", F.col("node"))
        if a.command == "pagerank" and a.out:
            files.write_pagerank(scores, a.out)
        show(scores.orderBy(F.desc("pr"), "node").limit(a.top), "name", F.format_string("%.6f", "pr"))
    else:
        links = files.links_by_number(spark, a.links)
        base = graph.nodes_of(links)
        if a.titles:
            base = base.union(files.titles(spark, a.titles).select("node")).distinct()
        v = graph.hits(links, base)
        for side in ("hub", "auth"):
            print(side)
            show(files.top_lines(v, side, a.top).orderBy("rank"), "line")


if __name__ == "__main__":
    main()
