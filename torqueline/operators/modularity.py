"""Communities by modularity: local moving, refinement to connected parts, contraction, level by level.

links are (a, b, weight), each link once each way; (a, a, weight) carries twice the weight
inside a contracted node.  Every round of moves and every level is written, so plans stay
short.  Ties go to the smallest community; of candidates the half that a hash of node and
round picks moves at once, and where that doesn't raise modularity only moves whose communities no
better move touches are made, whose gains add up exactly.  So modularity never falls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stored
from .preprocess import similar_words

#: Least gain of modularity for another round, and for another level.
ROUND_GAIN, LEVEL_GAIN = 1e-3, 1e-6


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, weight) of edges (source, target[, weight]): summed, without loops, each way; a missing weight is 1, those of 0 or less go."""
    w = F.coalesce("weight", F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    e = edges.where("source <> target").select("source", "target", w.cast("double").alias("weight")).where("weight > 0")
    ends = F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b")))).alias("e")
    return e.select(ends, "weight").groupBy("e.a", "e.b").agg(F.sum("weight").alias("weight"))


def degrees(links: DataFrame) -> DataFrame:
    """(id, degree): the weight of each node's links."""
    return links.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("degree"))


def modularity(links: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity): of the partition labels (id, community); null without links.  Nodes without links don't count."""
    c = labels.select("id", "community")
    ends = links.join(c.withColumnsRenamed({"id": "a", "community": "ca"}), "a").join(c.withColumnsRenamed({"id": "b", "community": "cb"}), "b")
    per = ends.groupBy("ca").agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside"))
    m2 = F.sum("total")
    return per.agg((F.sum("inside") / m2 - resolution * F.sum(F.col("total") * F.col("total")) / (m2 * m2)).alias("modularity"))


def moves(links: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(id, community, best, gain): the move of each node that raises modularity most, of those that raise it, were it made alone.

    A node's links are added up by community before they meet; the communities' totals
    are joined by community, so a node with very many links is not one group.
    """
    k = degrees(links)
    own = labels.select("id", "community").join(k, "id")
    total = own.groupBy("community").agg(F.sum("degree").alias("total"))
    m2 = k.agg(F.sum("degree").alias("m2"))
    near = links.where("a <> b").join(labels.select(F.col("id").alias("b"), F.col("community").alias("to")), "b").groupBy(F.col("a").alias("id"), "to").agg(F.sum("weight").alias("w"))
    stay = own.select("id", F.col("community").alias("to"), F.lit(0.0).alias("w"))
    choice = near.unionByName(stay).groupBy("id", "to").agg(F.sum("w").alias("w")).join(own, "id").join(total.withColumnRenamed("community", "to"), "to").crossJoin(F.broadcast(m2))  # one row
    inside = F.when(F.col("to") == F.col("community"), F.col("total") - F.col("degree")).otherwise(F.col("total"))
    choice = choice.withColumn("score", F.round(F.col("w") - resolution * F.col("degree") * inside / F.col("m2"), 10))
    best = choice.groupBy("id", "community").agg(
        F.max(F.when(F.col("to") == F.col("community"), F.col("score"))).alias("here"),
        F.min(F.struct((-F.col("score")).alias("score"), "to")).alias("best"),
        F.first("m2").alias("m2"),
    )
    gain = 2 * (-F.col("best.score") - F.col("here")) / F.col("m2")
    return best.where(gain > 0).select("id", "community", F.col("best.to").alias("best"), gain.alias("gain"))


def _apart(found: DataFrame) -> DataFrame:
    """The moves that are the best of all that touch their two communities."""
    order = F.struct((-F.col("gain")).alias("gain"), "id").alias("order")
    touch = found.select(order, F.explode(F.array("community", "best")).alias("touched"))
    first = touch.groupBy("touched").agg(F.min("order").alias("order"))
    won = first.groupBy("order").agg(F.count("*").alias("n")).where("n = 2").select(F.col("order.id").alias("id"))
    return found.join(won, "id", "left_semi")


def _moved(labels: DataFrame, made: DataFrame) -> DataFrame:
    return labels.join(made.select("id", "best"), "id", "left").select("id", F.coalesce("best", "community").alias("community"))


def local_moving(links: DataFrame, labels: DataFrame, resolution: float = 1.0, rounds: int = 50, least: float = ROUND_GAIN) -> tuple[DataFrame, float]:
    """labels after rounds of moves, until one raises modularity by less than ``least`` (or ``rounds``), and their modularity."""
    value = modularity(links, labels, resolution).first()[0] or 0.0
    for i in range(rounds):
        found = moves(links, labels, resolution)
        for many in (True, False):
            new = stored(_moved(labels, found.where(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(2)) == 0) if many else _apart(stored(found))))
            now = modularity(links, new, resolution).first()[0] or 0.0
            if now > value:
                break
        if now <= value:
            break
        gain, labels, value = now - value, new, now
        if gain < least:
            break
    return labels, value


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the least node that each node of ``nodes`` reaches over links (a, b), each way.

    Nodes take the least label around them and then follow labels twice, so rounds grow
    with the logarithm of the longest path.
    """
    labels = stored(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = links.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", "near").alias("c0"))
        for k in (0, 1):
            up = labels.select(F.col("id").alias(f"c{k}"), F.col("component").alias("up"))
            step = step.join(up, f"c{k}", "left").select("id", "was", F.least(f"c{k}", "up").alias(f"c{k + 1}"))
        step = stored(step.select("id", "was", F.col("c2").alias("component")))
        if not step.where("was <> component").limit(1).count():
            return step.select("id", "component")
        labels = step.select("id", "component")


def similar_entities(nodes: DataFrame, threshold: float = 92.0) -> DataFrame:
    """(id, label, entity): nodes with the least label that theirs reaches over labels of Indel ratio ``threshold`` or more.

    Different labels (lower case, single spaces) are compared once each, by the index of
    letter pairs; links between them are hooked to components.  Null and empty labels stay by themselves.
    """
    clean = F.trim(F.regexp_replace(F.lower("label"), r"\s+", " "))
    own = nodes.select("id", "label", clean.alias("word"))
    names = stored(own.select("word").where("word <> ''").distinct())
    pairs = similar_words(names, names, threshold).where("word <> match").select(F.col("word").alias("a"), F.col("match").alias("b"))
    found = components(stored(pairs), names.withColumnRenamed("word", "id"))
    return own.join(found.select(F.col("id").alias("word"), "component"), "word", "left").select("id", "label", F.coalesce("component", "label").alias("entity"))


def connected(links: DataFrame, labels: DataFrame) -> DataFrame:
    """labels with each community split into its connected parts, named by their least node; this never lowers modularity."""
    c = labels.select("id", "community")
    inside = links.where("a <> b").join(c.withColumnsRenamed({"id": "a", "community": "ca"}), "a").join(c.withColumnsRenamed({"id": "b", "community": "cb"}), "b").where("ca = cb").select("a", "b")
    return components(stored(inside), labels).withColumnRenamed("component", "community")


def contracted(links: DataFrame, labels: DataFrame) -> DataFrame:
    """links between communities; what is inside one becomes its loop."""
    c = labels.select("id", "community")
    ends = links.join(c.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(c.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    return ends.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("weight").alias("weight"))


def partition(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, levels: int = 20) -> DataFrame:
    """(id, community): a partition of nodes (id) by modularity; every community is connected and named by its least node.

    A node without links is a community of its own.  edges are (source, target[, weight]), those
    with ends outside nodes don't count, repeated ones add up.  Rounds go on until no
    move gains, as what one node of a large graph gains is below any bound, and in the end nodes move once more by themselves.
    """
    ids = nodes.select("id").where("id is not null").distinct()
    held = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    links = every = stored(both_ways(held))
    whole = stored(ids.select("id", F.col("id").alias("community")))
    value = modularity(links, whole, resolution).first()[0]
    for _ in range(levels if value is not None else 0):
        here = links.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id"))
        found, now = local_moving(links, stored(here), resolution, least=0.0)
        if now <= value + LEVEL_GAIN:
            break
        value, found = now, connected(links, found)
        up = found.select(F.col("id").alias("community"), F.col("community").alias("up"))
        whole = stored(whole.join(up, "community", "left").select("id", F.coalesce("up", "community").alias("community")))
        links = stored(contracted(links, found))
    if value is not None:
        found, now = local_moving(every, whole, resolution, least=0.0)
        whole = connected(every, found) if now > value else whole
    return whole


def numbered(labels: DataFrame) -> DataFrame:
    """(id, community): communities numbered from the largest, ties by name; numbers come from the list of sizes, one row a community."""
    from pyspark.sql import Window

    size = labels.groupBy("community").agg(F.count("*").alias("n"))
    order = size.select("community", (F.row_number().over(Window.orderBy(F.desc("n"), "community")) - 1).alias("number"))
    return labels.join(order, "community").select("id", F.col("number").alias("community"))


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community): ``partition``, numbered from the largest."""
    return numbered(partition(nodes, edges))
