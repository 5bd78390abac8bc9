"""Problem 2: one group identifier for all records linked directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Cuts

#: A node with more links than this is split into virtual nodes of at most so many links each.
HUB_LINKS = 50_000


def _split_hubs(cuts: Cuts, both: DataFrame, hub_links: int) -> DataFrame:
    """Bound the links of every node: hub h becomes h and virtual nodes (h, 1..k), linked to h.

    Components stay the same, and no later join or aggregate meets a key with more than
    ``hub_links`` rows. Nodes are structs (id, part); part is 0 except on virtual nodes.
    """
    degree = both.groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") > hub_links)
    # written, so that the planner knows whether it is small enough to be broadcast
    parts = cuts.write(degree.select(F.col("u").alias("hub"), F.ceil(F.col("n") / hub_links).cast("long").alias("k")))
    placed = (
        both.join(parts, both.u == parts.hub, "left")
        .select("u", "v", F.when(F.col("k").isNotNull(), 1 + F.pmod(F.xxhash64("v"), "k")).otherwise(F.lit(0)).alias("pu"))
    )
    # each undirected link stands twice; both ends must agree on their parts, so join the two views
    mine = placed.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), (F.col("u") < F.col("v")).alias("fwd"), "pu")
    links = mine.groupBy("a", "b").agg(F.max(F.when(F.col("fwd"), F.col("pu"))).alias("pa"), F.max(F.when(~F.col("fwd"), F.col("pu"))).alias("pb"))
    inner = links.select(F.struct(F.col("a").alias("id"), F.col("pa").alias("part")).alias("x"), F.struct(F.col("b").alias("id"), F.col("pb").alias("part")).alias("y"))
    ties = parts.select(F.col("hub").alias("id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("part")).select(
        F.struct("id", F.lit(0).cast("long").alias("part")).alias("x"), F.struct("id", "part").alias("y")
    )
    return inner.unionByName(ties)


def connected_components(links: DataFrame, a: str, b: str, *, hub_links: int = HUB_LINKS, max_rounds: int = 200) -> DataFrame:
    """Label every linked record with the smallest record value of its component.

    Minimum labels travel along the links; each round also hooks the parents of the linked nodes
    and jumps every pointer to its grandparent, so a chain of n records takes about log n rounds
    instead of n. Every round is written to the shared folder; the loop ends when no label changes.

    Input: one row per link, columns ``a`` and ``b`` of one type that has an order (other columns are
    ignored, whatever their names). Rows with a NULL end, self links and repeated links in either
    orientation count for nothing. Result: ``node``, ``label``; one row per record with at least one
    link to another; an empty input gives an empty result. Two equal results never depend on the
    order or partitioning of the rows.
    """
    spark = links.sparkSession
    cuts = Cuts(spark)
    pairs = links.select(links[a].alias("a"), links[b].alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = cuts.write(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # 64-bit numbers instead of the values; they are drawn once, the written table fixes them
    nodes = cuts.write(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("nid", F.monotonically_increasing_id()))
    numbered = (
        pairs.join(nodes.select(F.col("node").alias("a"), F.col("nid").alias("u")), "a")
        .join(nodes.select(F.col("node").alias("b"), F.col("nid").alias("v")), "b")
        .select("u", "v")
    )
    numbered = cuts.write(numbered)
    both = numbered.unionByName(numbered.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if both.groupBy("u").count().filter(F.col("count") > hub_links).limit(1).count():
        split = cuts.write(_split_hubs(cuts, both, hub_links))
        key = F.struct("id", "part")
        named = cuts.write(split.select(F.explode(F.array("x", "y")).alias("s")).distinct().select("s.id", "s.part").withColumn("n", F.monotonically_increasing_id()))
        left, right = named.select(key.alias("x"), F.col("n").alias("u")), named.select(key.alias("y"), F.col("n").alias("v"))
        edges = cuts.write(split.join(left, "x").join(right, "y").select("u", "v"))
        # part 0 exists for every node: a split hub keeps the ties to its parts there
        home = named.filter("part = 0").select(F.col("id").alias("nid"), F.col("n").alias("k"))
    else:
        edges, home = numbered, None
    labels = _propagate(spark, cuts, edges, max_rounds)
    labelled = labels if home is None else home.join(labels, "k").select(F.col("nid").alias("k"), "p")
    members = cuts.write(nodes.join(labelled, nodes.nid == labelled.k).select("node", "p"))
    # written, so that the join has a plain exchange on both sides and a giant component is split
    smallest = cuts.write(members.groupBy("p").agg(F.min("node").alias("label")))
    out = cuts.write(members.join(smallest, "p").select("node", "label"))
    cuts.drop_others(out)
    return out


def _propagate(spark, cuts: Cuts, edges: DataFrame, max_rounds: int) -> DataFrame:
    """Table (k, p): p the same for all k of one component, different between components."""
    both = cuts.write(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    # the first labels need no join: the smallest neighbour, or the node itself
    state = cuts.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")).select(F.col("u").alias("k"), "p"))
    state_gp = cuts.write(_grandparents(state))
    cuts.drop(state)
    state = state_gp
    for _ in range(max_rounds):
        near = both.join(state.select(F.col("k").alias("v"), F.col("gp").alias("m")), "v").groupBy("u").agg(F.min("m").alias("m"))
        seen = state.join(near, state.k == near.u).select("k", "p", "gp", "m")
        # one pass proposes labels for the node itself and for its present parent
        offers = seen.select(F.explode(F.array(F.struct(F.col("k").alias("k"), F.least("gp", "m", "p").alias("q")), F.struct(F.col("p").alias("k"), F.least("gp", "m").alias("q")))).alias("o")).select("o.k", "o.q")
        best = offers.groupBy("k").agg(F.min("q").alias("p"))
        after = cuts.write(best)
        jumped = cuts.write(_grandparents(after))
        changed = jumped.join(state.select("k", F.col("p").alias("p0"), F.col("gp").alias("g0")), "k").filter("gp <> g0 OR p <> p0").limit(1).count()
        cuts.drop(after, state)
        state = jumped
        if not changed:
            return state.select("k", F.col("gp").alias("p"))
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def _grandparents(state: DataFrame) -> DataFrame:
    """(k, p, gp): the label that the label itself carries. Hot parents are read, not grouped."""
    up = state.select(F.col("k").alias("p"), F.col("p").alias("gp"))
    return state.join(up, "p").select("k", "p", "gp")


def found(spark, sf_dir: str) -> DataFrame:
    """p2_found: every file on at least one linking report, with the smallest path of its component."""
    reports = spark.read.parquet(f"{sf_dir}/evidence_reports.parquet")
    linking = reports.filter(~F.col("classification").isin("NO_MATCH", "UNCERTAIN"))
    out = connected_components(linking, "track_a_path", "track_b_path")
    return out.select(F.col("node").alias("filepath"), F.col("label").alias("group_key"))


SQL = """
WITH RECURSIVE l AS (
  SELECT track_a_path AS a, track_b_path AS b FROM evidence_reports
  WHERE track_a_path IS NOT NULL AND track_b_path IS NOT NULL AND track_a_path <> track_b_path
    AND classification NOT IN ('NO_MATCH', 'UNCERTAIN')
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS filepath, a AS reached FROM e UNION SELECT r.filepath, e.b FROM r JOIN e ON e.a = r.reached)
SELECT filepath, min(reached) AS group_key FROM r GROUP BY filepath
"""
