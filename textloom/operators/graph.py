"""Link analysis: PageRank, HITS and Monte Carlo walks.

Iterations are joins and sums over numbered nodes. Up to `FEW_NODES` nodes the
vector is broadcast and links are bucketed by the end that a round sums to, so
that a round is one stage and shuffles nothing; beyond, links and vector are
bucketed by the end that a round joins on, so that a round shuffles sums and the
vector, never the links. The vector's copy cuts lineage; the one before it is
deleted. What decides about stopping is observed while a vector is written, and
only such scalars reach the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import bucketed, dropped, written

#: Nodes up to which a round's vector is broadcast, some 60 bytes each.
FEW_NODES = 2_000_000
#: Steps of walks between two sums of their visits.
CUT = 5


def dense_ids(df: DataFrame, *key: str) -> DataFrame:
    """df with idx = 0, 1, ... by ascending key, from counts of range partitions."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = written(df.repartitionByRange(parts, *key).withColumn("_p", F.spark_partition_id()), "ids")
    sizes = held.groupBy("_p").agg(F.count("*").alias("n"))  # one row a partition
    before = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*key)) - 1
    return held.withColumn("_own", own).join(F.broadcast(before), "_p").withColumn("idx", F.col("_before") + F.col("_own")).drop("_p", "_own", "_before")


def nodes_of(links: DataFrame) -> DataFrame:
    return links.select(F.col("src").alias("node")).union(links.select(F.col("dst").alias("node"))).distinct()


def sinks(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes without a link of their own."""
    return nodes.join(links.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def _numbered(df: DataFrame) -> DataFrame:
    """df with a number `id` for each row, written."""
    return written(df.withColumn("id", F.monotonically_increasing_id()), "ids")


def _near(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _steps(df: DataFrame, few: bool) -> DataFrame:
    """Rows (s, d, ...) as a round reads them: sums by d need no shuffle if the vector is broadcast, else the join by s needs none."""
    held = written(df, "steps")
    out = bucketed(held, "steps", "d" if few else "s", rows=held.count() if few else None)
    dropped(held)
    return out


def _vector(df: DataFrame, few: bool) -> DataFrame:
    return written(df, "vector") if few else bucketed(df, "vector", "s")


def pagerank(links: DataFrame, nodes: DataFrame | None = None, *, damping: float = 0.85, tolerance: float = 1e-7, rounds: int = 1000) -> DataFrame:
    """node, pr by power iteration, until no score changes by `tolerance`; links count once however often they are given.

    Nodes without a link to them, and nodes whose only link comes from the same node, have
    equal scores in every round. One of them stands for all, and a link's share is summed
    over its class of sources, so rounds read the links between classes."""
    links = written(links.select("src", "dst").distinct(), "links")
    ids = _numbered((nodes if nodes is not None else nodes_of(links)).select("node").distinct())
    n = ids.count()
    if not n:
        return ids.select("node", F.lit(0.0).alias("pr"))
    few = n <= FEW_NODES
    at = lambda end, c: _near(ids.select(F.col("node").alias(end), F.col("id").alias(c)), few)
    pairs = written(links.join(at("src", "s"), "src").join(at("dst", "d"), "dst", "left").select("s", "d"), "pairs")
    inner = pairs.where("d is not null")
    out = pairs.groupBy(F.col("s").alias("id")).agg(F.count("*").alias("deg"))
    into = inner.groupBy(F.col("d").alias("id")).agg(F.count("*").alias("n_in"), F.min("s").alias("only"))
    kin = ids.select("id").join(into, "id", "left").select("id", F.when(F.col("n_in").isNull(), F.lit(-1)).when(F.col("n_in") == 1, F.col("only")).alias("only"))
    first = kin.where("only is not null").groupBy("only").agg(F.min("id").alias("first"))
    members = written(kin.join(_near(first, few), "only", "left").join(out, "id", "left").select("id", F.coalesce("first", "id").alias("class"), "deg"), "members")
    groups = members.groupBy(F.col("class").alias("s")).agg(F.count("*").cast("double").alias("size"), F.sum(F.when(F.col("deg").isNull(), 1.0).otherwise(0.0)).alias("sinks"))
    sources = _near(members.where("deg is not null").select(F.col("id").alias("s"), "class", "deg"), few)
    shown = _near(members.where("id = class").select(F.col("id").alias("d")), few)
    shares = inner.join(shown, "d", "left_semi").join(sources, "s").groupBy(F.col("class").alias("s"), "d").agg(F.sum(F.lit(1.0) / F.col("deg")).alias("share"))
    own = groups.select("s", F.col("s").alias("d"), F.lit(0.0).alias("share"), "size", "sinks")
    steps = _steps(shares.withColumns({"size": F.lit(None).cast("double"), "sinks": F.lit(None).cast("double")}).unionByName(own), few)
    seen = Observation()
    ranks = _vector(groups.observe(seen, F.sum(F.col("sinks") / n).alias("lost")).select("s", F.lit(1.0 / n).alias("pr")), few)
    said = seen.get
    for _ in range(rounds):
        base = (1 - damping) / n + damping * (said["lost"] or 0.0) / n
        summed = steps.join(_near(ranks.select("s", "pr"), few), "s").groupBy("d").agg(F.sum(F.col("pr") * F.col("share")).alias("f"), F.max(F.when(F.col("size").isNotNull(), F.col("pr"))).alias("was"), F.max("size").alias("size"), F.max("sinks").alias("sinks"))
        # out of an array and by a column, so that no round's code holds its number and is compiled anew
        given = F.array(F.lit(base))[F.when(F.col("size") < 0, 1).otherwise(0)]
        new = summed.select(F.col("d").alias("s"), (given + damping * F.col("f")).alias("pr"), "was", "size", "sinks")
        seen = Observation()
        watched = new.observe(seen, F.sum(F.col("sinks") * F.col("pr")).alias("lost"), F.sum(F.col("size") * F.col("pr")).alias("total"), F.max(F.abs(F.col("pr") - F.col("was"))).alias("change")).select("s", "pr")
        before, ranks = ranks, _vector(watched, few)
        said = seen.get
        dropped(before)
        if said["change"] < tolerance:
            break
    dropped(steps, pairs, links)
    # each round keeps the sum at 1 but for rounding
    scores = members.select("id", F.col("class").alias("s")).join(_near(ranks, few), "s").select("id", (F.col("pr") / F.lit(said["total"])).alias("pr"))
    return ids.join(scores, "id").select("node", "pr")


def hits(links: DataFrame, base: DataFrame | None = None, *, tolerance: float = 1e-6, rounds: int = 1000, by: tuple[str, ...] = ()) -> DataFrame:
    """node, hub, auth. Both vectors come from the round before; repeated links count as often as given.

    by: columns of `base` that tell graphs apart (queries, say); each is scaled and
    stops by itself, and all are iterated together."""
    links = written(links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("m")), "links")
    base = (base if base is not None else nodes_of(links)).select(*by, "node").distinct()
    if by:
        # a graph goes by a number, which sums by hash can hold, unlike a struct
        base = written(base.withColumn("of", F.struct(*by)), "base")
        graphs = written(base.select("of").distinct().withColumn("graph", F.monotonically_increasing_id()), "graphs")
        ids = _numbered(base.join(graphs, "of").drop("of"))
        dropped(base, graphs)
    else:
        ids = _numbered(base.withColumn("graph", F.lit(0)))
    few = ids.count() <= FEW_NODES
    at = lambda end, c: _near(ids.select(F.col("graph"), F.col("node").alias(end), F.col("id").alias(c)), few)
    pairs = written(links.join(at("src", "s"), "src").join(at("dst", "d"), ["graph", "dst"] if by else "dst").select("s", "d", "m"), "pairs")
    auths = pairs.select("s", "d", F.col("m").alias("to_auth"), F.lit(0.0).alias("to_hub"), F.lit(False).alias("own"))
    hubs = pairs.select(F.col("d").alias("s"), F.col("s").alias("d"), F.lit(0.0).alias("to_auth"), F.col("m").alias("to_hub"), F.lit(False).alias("own"))
    own = ids.select(F.col("id").alias("s"), F.col("id").alias("d"), F.lit(0.0).alias("to_auth"), F.lit(0.0).alias("to_hub"), F.lit(True).alias("own"))
    steps = _steps(auths.unionByName(hubs).unionByName(own), few)
    v = _vector(ids.select(F.col("id").alias("s"), "graph", F.lit(1.0).alias("hub"), F.lit(1.0).alias("auth"), F.lit(False).alias("done")), few)
    mine = lambda c: F.max(F.when(F.col("own"), F.col(c))).alias(c)
    for _ in range(rounds):
        met = steps.join(_near(v, few), "s").groupBy("d").agg(F.sum(F.col("to_hub") * F.col("auth")).alias("h"), F.sum(F.col("to_auth") * F.col("hub")).alias("a"), mine("graph"), mine("hub"), mine("auth"), mine("done"))
        raw = written(met, "step")
        # one row for each graph
        size = raw.groupBy("graph").agg(*(F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"n{c}") for c in "ha"))
        few_graphs = few or not by
        scaled = raw.join(_near(size, few_graphs), "graph").select("d", "graph", "hub", "auth", "done", *((F.col(c) / F.when(F.col(f"n{c}") == 0, 1.0).otherwise(F.col(f"n{c}"))).alias(c) for c in "ha"))
        gap = F.max(F.greatest(F.abs(F.col("h") - F.col("hub")), F.abs(F.col("a") - F.col("auth")))) <= tolerance
        moved = scaled.join(_near(scaled.groupBy("graph").agg(gap.alias("stop")), few_graphs), "graph")
        pick = lambda new, old: F.when(F.col("done"), F.col(old)).otherwise(F.col(new)).alias(old)
        seen = Observation()
        new = moved.select(F.col("d").alias("s"), "graph", pick("h", "hub"), pick("a", "auth"), (F.col("done") | F.col("stop")).alias("done")).observe(seen, F.min("done").alias("done"))
        before, v = v, _vector(new, few)
        dropped(before, raw)
        if seen.get["done"] in (True, None):
            break
    dropped(steps, pairs, links)
    return ids.join(v.select(F.col("s").alias("id"), "hub", "auth"), "id").select(*by, "node", "hub", "auth")


def base_set(links: DataFrame, root: DataFrame, titled: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Root nodes, what they link to, and what links to them; nodes without a title go. by: as for `hits`."""
    r = written(root.select(*by, "node").distinct(), "root")  # it may stand for a search of all texts, and is read three times
    out = links.join(r.withColumnRenamed("node", "src"), "src").select(*by, F.col("dst").alias("node"))
    into = links.join(r.withColumnRenamed("node", "dst"), "dst").select(*by, F.col("src").alias("node"))
    every = r.union(out).union(into).distinct()
    return every.join(titled.select("node").distinct(), "node", "left_semi").select(*by, "node") if titled is not None else every


def hits_ranking(links: DataFrame, root: DataFrame, titled: DataFrame | None = None, *, hub_weight: float = 0.5, auth_weight: float = 0.5, by: tuple[str, ...] = (), **how) -> DataFrame:
    """node, score of the root's base set."""
    v = hits(links, base_set(links, root, titled, by), by=by, **how)
    return v.select(*by, "node", (hub_weight * F.col("hub") + auth_weight * F.col("auth")).alias("score"))


def document_nodes(docs: DataFrame, titles: DataFrame) -> DataFrame:
    """doc_id, node: documents whose file name without its folders is a node's title; of equal titles the least node."""
    named = titles.groupBy("title").agg(F.min("node").alias("node"))
    return docs.select("doc_id", basename(F.col("name")).alias("title")).join(named, "title").select("doc_id", "node")


def basename(name: Column) -> Column:
    return F.regexp_extract(name, r"[^\\/]+$", 0)


def chance(walk: Column, step: int, salt: int, seed: int) -> Column:
    """A number in [0, 1) from walk, step and salt by integer arithmetic; the same in any engine.

    The squares part the steps of a walk, which a linear generator would keep in step."""
    m = F.lit(2147483647)
    h = (F.pmod(walk, F.lit(1000003)) * F.lit(7919) + F.lit(step * 104729 + salt * 1299709 + seed)) % m
    for _ in range(2):
        h = (h * F.lit(48271) + F.lit(11)) % m
        h = (h * h + F.lit(7)) % m
    return (h * F.lit(48271)) % m / F.lit(2147483647.0)


def _walkers(nodes: DataFrame, n: int, start: str, walks: int, seed: int) -> DataFrame:
    """walk, idx: walks starts at random, or `walks` from every node in turn."""
    spark = nodes.sparkSession
    if start == "cyclic":
        return spark.range(walks * n).select(F.col("id").alias("walk"), (F.col("id") % n).alias("idx"))
    return spark.range(walks).select(F.col("id").alias("walk"), F.floor(chance(F.col("id"), 0, 9, seed) * n).cast("long").alias("idx"))


def monte_carlo(links: DataFrame, nodes: DataFrame, *, start: str = "random", path: str = "endpoint", walks: int, damping: float = 0.85, most_steps: int = 200, seed: int = 1) -> DataFrame:
    """node, pr by walks over distinct links.

    path "endpoint": where walks end; at a sink a walk jumps anywhere. "complete": every
    visit counts; a sink ends the walk. A walk that still goes after most_steps ends where
    it is. walks: their number, or for cyclic starts their number from each node."""
    ids = written(dense_ids(nodes.select("node").distinct(), "node"), "nodes")
    n = ids.count()
    pair = links.select("src", "dst").distinct().join(ids.select(F.col("node").alias("src"), F.col("idx").alias("s")), "src").join(ids.select(F.col("node").alias("dst"), F.col("idx").alias("d")), "dst")
    # link numbers: (s, k) for k = 0, 1, ... so that a walk picks one without gathering a node's links;
    # links are numbered by range partitions, so a node with very many does not stand in one task either
    numbered = written(dense_ids(pair.select("s", "d"), "s", "d"), "numbered")
    first = numbered.groupBy("s").agg(F.min("idx").alias("first"), F.count("*").alias("deg"))
    # both are bucketed by what a step joins on and links carry their target's degree, so a step shuffles walkers alone
    degree = bucketed(ids.select("idx").join(first.select(F.col("s").alias("idx"), "deg"), "idx", "left").select("idx", F.coalesce("deg", F.lit(0)).alias("deg")), "degrees", "idx")
    out = numbered.join(first.select("s", "first"), "s").select("s", (F.col("idx") - F.col("first")).alias("k"), "d")
    edges = bucketed(out.join(degree.select(F.col("idx").alias("d"), "deg"), "d").select("s", "k", "d", "deg"), "walks", "s", "k")
    going = written(_walkers(ids, n, start, walks, seed).join(degree, "idx").select("walk", "idx", "deg"), "going")
    visits, ends = None, None
    add = lambda a, b: b if a is None else a.unionByName(b)
    for step in range(1, most_steps + 1):
        stop = chance(F.col("walk"), step, 1, seed) < 1 - damping
        if path == "complete":
            visits = add(visits, going.groupBy("idx").agg(F.count("*").alias("c")))
            live = going.where((F.col("deg") > 0) & ~stop)
        else:
            ends = add(ends, going.where(stop).groupBy("idx").agg(F.count("*").alias("c")))
            live = going.where(~stop)
        picked = live.withColumn("k", F.floor(chance(F.col("walk"), step, 2, seed) * F.col("deg")).cast("long"))
        moved = picked.where("deg > 0").select("walk", "idx", "k").join(edges.select(F.col("s").alias("idx"), "k", "d", "deg"), ["idx", "k"]).select("walk", F.col("d").alias("idx"), "deg")
        if path == "endpoint":
            jumped = live.where("deg = 0").select("walk", F.floor(chance(F.col("walk"), step, 3, seed) * n).cast("long").alias("idx"))
            moved = moved.unionByName(jumped.join(degree, "idx").select("walk", "idx", "deg"))
        going = written(moved, "going")
        if step % CUT == 0:
            if going.isEmpty():
                break
            if visits is not None:
                visits = written(visits.groupBy("idx").agg(F.sum("c").alias("c")), "visits")
            else:
                ends = written(ends.groupBy("idx").agg(F.sum("c").alias("c")), "ends")
    rest = going.groupBy("idx").agg(F.count("*").alias("c"))
    counted = (visits if path == "complete" else add(ends, rest)).groupBy("idx").agg(F.sum("c").alias("c"))
    total = counted.agg(F.sum("c").cast("double").alias("t")).scalar()
    return ids.join(counted, "idx", "left").select("node", F.coalesce(F.col("c") / total, F.lit(0.0)).alias("pr"))


def averaged(*trials: DataFrame) -> DataFrame:
    """node, pr: the mean of several walks' results; all hold every node."""
    whole = trials[0]
    for t in trials[1:]:
        whole = whole.unionByName(t)
    return whole.groupBy("node").agg((F.sum("pr") / len(trials)).alias("pr"))


def goodness(exact: DataFrame, estimate: DataFrame, k: int = 30) -> DataFrame:
    """ssd: the sum of squared differences over the exact top k."""
    best = exact.orderBy(F.desc("pr"), "node").limit(k)
    return best.join(estimate.select("node", F.col("pr").alias("e")), "node", "left").agg(F.sum(F.pow(F.col("pr") - F.coalesce("e", F.lit(0.0)), 2)).alias("ssd"))


def with_titles(scores: DataFrame, titles: DataFrame) -> DataFrame:
    """Scores with the node's title, or the node itself where it has none."""
    return scores.join(titles.select("node", "title"), "node", "left").withColumn("name", F.coalesce("title", F.col("node").cast("string"))).drop("title")
