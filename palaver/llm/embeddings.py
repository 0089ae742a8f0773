"""Near-duplicate vectors by robust-pruned flat graphs on overlapping cluster shards.

Vectors are assigned to every cluster whose centroid is nearly as close as the closest one, their
home; too large clusters are divided in the same way.  Centroids that crowd together, as in a large
group of vectors that are all near each other, are one cluster, of which each vector is a member
once; it is cut into blocks that meet in pairs.  Each shard gets a flat graph (see flatgraph),
and a vector's adjacency lists from all of its shards are united.  A shard is then searched for its
home vectors: greedy walks from the medoid, expanded over everything in range, through its members
and through the vectors of other shards to which the united lists of its home vectors lead.  Links
are verified in double precision; only their numbers and a forest of them leave a task.  Recall is
audited against brute force, and the overlap widened while it is too low.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm import flatgraph
from palaver.llm.common import checkpoint
from palaver.llm.graph import connected_components, forest

LOG = logging.getLogger(__name__)

#: Vectors that the centroids of one level are fitted on, vectors to a cluster, and the first level's centroids at most.
CENTROID_SAMPLE, PER_CLUSTER, MOST_CENTROIDS = 12_000, 250, 4096
#: A vector belongs to clusters within this cosine of its best one; doubled while recall is too low.
MARGIN = 0.06
#: Members of a shard at most; a larger cluster is divided, by centroids while they divide it, else by a hash.
MOST_MEMBERS = 2000
#: Centroids near one of them (by half the margin) that are one cluster with it, and members of a block of such a cluster.
CROWD, BLOCK_MEMBERS = 12, 6000
#: Audit queries to begin with and at most, those with links that are enough, and the recall to reach.
AUDIT_QUERIES, MOST_QUERIES, LINKED_QUERIES, LEAST_RECALL = 1000, 16_000, 50, 0.9


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of normalised vectors."""
    rng = np.random.default_rng(0)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres


def _normalised(column) -> np.ndarray:
    vectors = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def usable(vector):
    """Not null, no null or non-finite component, and not all zero."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(doubles, lambda x: x != 0)


def crowds(centres: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """For each centre the one that stands for it, and whether that is a crowd of more than CROWD within half the margin.

    Without this each vector amid a large group of near ones would belong to all of the group's clusters.
    """
    near = (centres.astype(np.float32) @ centres.astype(np.float32).T) >= 1 - margin / 2
    label, crowded, left = np.arange(len(centres)), np.zeros(len(centres), dtype=bool), np.ones(len(centres), dtype=bool)
    for i in np.argsort(-near.sum(axis=1), kind="stable"):
        own = near[i] & left
        if left[i] and own.sum() > CROWD:
            label[own], crowded[own], left = i, True, left & ~own
    return label, crowded


def nearest_clusters(vectors: np.ndarray, centres: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row, cluster), each once, of all clusters within the margin of a row's best, and whether it is the best.

    A crowd of centres is one cluster, numbered below 0.
    """
    label, crowded = crowds(centres, margin)
    number = np.where(crowded, -1 - label, label)
    sims = vectors @ centres.T
    best = sims.argmax(axis=1)
    row, cluster = np.nonzero(sims >= sims[np.arange(len(sims)), best][:, None] - margin)
    row, cluster = np.unique(np.stack([row, number[cluster]]), axis=1)
    return row, cluster, number[best][row] == cluster


def first_level(nodes: DataFrame, margin: float) -> DataFrame:
    """(node, vector, copies, cluster, home): the memberships of all nodes, one of each being its home."""
    n = nodes.count()
    every = max(1, -(-n // CENTROID_SAMPLE))
    rows = nodes.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).orderBy(F.xxhash64("node")).limit(2 * CENTROID_SAMPLE).collect()
    sample = _normalised([r["vector"] for r in rows]) if rows else None
    k = max(1, min(MOST_CENTROIDS, n // PER_CLUSTER))
    centres = nodes.sparkSession.sparkContext.broadcast(centroids(sample, k) if rows else None)  # MOST_CENTROIDS rows at most

    def assigned(batches):
        for pdf in batches:
            if len(pdf):
                known = centres.value if centres.value is not None else np.zeros((1, len(pdf["vector"].iloc[0])))
                row, cluster, home = nearest_clusters(_normalised(pdf["vector"]), known, margin)
                yield pdf.iloc[row].reset_index(drop=True).assign(cluster=cluster, home=home)

    return checkpoint(nodes.mapInPandas(assigned, _members(nodes)))


def _members(nodes: DataFrame) -> str:
    return f"node long, vector {nodes.schema['vector'].dataType.simpleString()}, copies long, cluster long, home boolean"


def divided(members: DataFrame, margin: float) -> DataFrame:
    """Members with their clusters of over MOST_MEMBERS divided by centroids, level by level, as long as that makes them smaller.

    Crowds (numbered below 0) aren't divided.
    A cluster's centroids are fitted on a sample of about 2 * MOST_MEMBERS of it; its members are
    dealt to tasks by a hash.
    """
    kind = members.schema["vector"].dataType.simpleString()
    done, most, size = None, None, PER_CLUSTER
    while True:
        sizes = checkpoint(members.where("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_MEMBERS))
        largest = sizes.agg(F.max("n")).first()[0]
        if largest is None or most is not None and largest > 0.7 * most:
            return members if done is None else done.unionByName(members)
        most = largest
        small = members.join(sizes.select("cluster"), "cluster", "left_anti").select(*members.columns)
        done = checkpoint(small if done is None else done.unionByName(small))
        large = members.join(sizes, "cluster").withColumn("every", F.ceil(F.col("n") / (2 * MOST_MEMBERS)))

        def fitted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            centres = centroids(_normalised(pdf.sort_values("node")["vector"]), max(2, int(pdf["n"].iloc[0]) // size))
            return pd.DataFrame({"cluster": key[0], "centre": list(centres)})

        centres = large.where(F.pmod(F.xxhash64("node"), F.col("every")) == 0).groupBy("cluster").applyInPandas(fitted, "cluster long, centre array<double>")
        parts = F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / MOST_MEMBERS))
        centres = centres.join(sizes, "cluster").select("cluster", "centre", F.explode(parts).alias("part"))
        large = large.withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.ceil(F.col("n") / MOST_MEMBERS) + 1))

        def assigned(key: tuple, pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf) or not len(known):
                return pdf.iloc[:0][["node", "vector", "copies", "cluster", "home"]]
            known = np.stack(sorted(known["centre"], key=tuple))
            row, child, home = nearest_clusters(_normalised(pdf["vector"]), known, margin)
            out = pdf.iloc[row].reset_index(drop=True)
            number = np.where(child < 0, -1 - (key[0] * 65_599 - child), key[0] * 65_599 + child + 1)
            return out.assign(cluster=number, home=out["home"].to_numpy() & home)[["node", "vector", "copies", "cluster", "home"]]

        split = large.groupBy("cluster", "part").cogroup(centres.groupBy("cluster", "part"))
        members = checkpoint(split.applyInPandas(assigned, f"node long, vector {kind}, copies long, cluster long, home boolean"))


def _graph(least: float):
    """Of a shard its graph as lists of nodes; ``far``: neighbours about in range that are not in the node's home cluster."""

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, homes, everywhere = pdf["node"].to_numpy(), pdf["at_home"].to_numpy(), pdf["clusters"].tolist()
        vectors = _normalised(pdf["vector"])
        flat, ends = flatgraph.build(vectors)
        own = np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))
        near = np.flatnonzero(flatgraph.cosines(vectors, own, vectors, flat) >= least - flatgraph.SLACK)
        away = near[[homes[i] not in everywhere[j] for i, j in zip(own[near], flat[near], strict=True)]] if len(near) else near
        lists = np.split(ids[flat], ends[:-1])
        far = np.split(ids[flat[away]], np.searchsorted(own[away], np.arange(1, len(ids))))
        return pd.DataFrame({"node": ids, "edges": [x.tolist() for x in lists], "far": [x.tolist() for x in far]})

    return graph


def _searched(least: float):
    """Of a shard's rows: the home vectors' numbers of links (``found`` nodes, ``copies`` rows), and a forest of all links."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        role, ids = pdf["role"].to_numpy(), pdf["node"].to_numpy()
        vectors, copies = _normalised(pdf["vector"]), pdf["copies"].to_numpy()
        target, asked = np.flatnonzero(role != QUERY), np.flatnonzero((role == QUERY) | (role == BOTH))
        if not len(target) or not len(asked):
            return pd.DataFrame({"node": ids[:0], "found": ids[:0], "copies": ids[:0], "root": ids[:0]})
        order = np.argsort(ids[target], kind="stable")
        target = target[order]
        known = ids[target]
        lists = [np.asarray(x if x is not None else (), dtype=np.int64) for x in pdf["edges"].iloc[target]]
        flat, counts = np.concatenate([*lists, known[:0]]), np.array([len(x) for x in lists])
        place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        here = known[place] == flat
        own = np.repeat(np.arange(len(known)), counts)[here]
        graph = place[here], np.cumsum(np.bincount(own, minlength=len(known)))
        found, sums, trees = np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=np.int64), [(ids[:0], ids[:0])]
        for first in range(0, len(asked), flatgraph.QUERIES):  # amid near vectors the pairs are many: counts and a forest are kept of them
            part = asked[first : first + flatgraph.QUERIES]
            q, at = flatgraph.in_range(vectors[part], graph, vectors[target], least)
            other = ids[part][q] != known[at]
            q, at = q[other], at[other]
            found[first : first + len(part)] = np.bincount(q, minlength=len(part))
            sums[first : first + len(part)] = np.bincount(q, weights=copies[target][at], minlength=len(part))
            if len(q):
                trees.append(forest(ids[part][q], known[at]))
        own = np.flatnonzero(found)
        u, v = (np.concatenate([t[k] for t in trees]) for k in range(2))
        node, root = forest(u, v) if len(u) else (u, v)
        none = np.zeros(len(node), dtype=np.int64)
        return pd.DataFrame({
            "node": np.concatenate([ids[asked][own], node]), "found": np.concatenate([found[own], none]),
            "copies": np.concatenate([sums[own], none]), "root": np.concatenate([ids[asked][own], root]),
        })

    return search


FOUND = "node long, found long, copies long, root long"
#: Rows of a shard: members that are found and searched for, only found, or only searched for.
BOTH, TARGET, QUERY = range(3)


def links_within(nodes: DataFrame, least: float, margin: float) -> DataFrame:
    """FOUND rows for nodes (node long, vector, copies long) of one dimension, all vectors different.

    The sums of ``found`` and ``copies`` are a node's links; ``root`` is the smallest node that a
    shard's links reach, so components need one edge a row.
    """
    members = divided(first_level(nodes, margin), margin)
    where = members.groupBy("node").agg(F.collect_set("cluster").alias("clusters"), F.max(F.when(F.col("home"), F.col("cluster"))).alias("at_home"))
    # a cluster that centroids don't divide has g blocks: each has a graph, and is searched for the home vectors of all of them
    most = F.when(F.col("cluster") < 0, BLOCK_MEMBERS).otherwise(MOST_MEMBERS)
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).select("cluster", F.ceil(F.col("n") / most).alias("g"))
    members = members.join(sizes, "cluster").join(where, "node").withColumn("b", F.pmod(F.xxhash64("node", F.lit(3)), F.col("g")))
    members = checkpoint(members)
    lists = checkpoint(members.groupBy("cluster", "b").applyInPandas(_graph(least), "node long, edges array<bigint>, far array<bigint>"))
    united = checkpoint(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges")))
    nothing = F.lit(None).cast("array<bigint>")
    columns = ["cluster", "q", "t", "node", "vector", "copies", "edges", "role"]
    here = members.join(united, "node")
    role = F.when(F.col("home"), BOTH).otherwise(TARGET)
    own = here.select("cluster", F.col("b").alias("q"), F.col("b").alias("t"), "node", "vector", "copies", "edges", role.alias("role"))
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("g") - 1))
    cut = here.where("g > 1")
    found = cut.select("*", blocks.alias("q")).where("q != b").select("cluster", "q", F.col("b").alias("t"), "node", "vector", "copies", "edges", F.lit(TARGET).alias("role"))
    asked = cut.where("home").select("*", blocks.alias("t")).where("t != b").select("cluster", F.col("b").alias("q"), "t", "node", "vector", "copies", nothing.alias("edges"), F.lit(QUERY).alias("role"))
    # vectors of other clusters that lists lead to: each is a target in one block, for the home vectors of all blocks
    homes = members.where("home").select("node", "cluster", "g")
    far = lists.select("node", F.explode("far").alias("other")).join(homes, "node").select("cluster", "g", F.col("other").alias("node")).distinct()
    halo = far.join(nodes, "node").join(united, "node").select("*", blocks.alias("q"), F.pmod(F.xxhash64("node", F.lit(5)), F.col("g")).alias("t"))
    halo = halo.select("cluster", "q", "t", "node", "vector", "copies", "edges", F.lit(TARGET).alias("role"))
    shards = own.unionByName(found).unionByName(asked).unionByName(halo).select(*columns)
    return checkpoint(shards.groupBy("cluster", "q", "t").applyInPandas(_searched(least), FOUND))


def audited_recall(nodes: DataFrame, found: DataFrame, least: float) -> float:
    """Mean share of a query's links that are in ``found``, in the worst class of queries by number of links.

    Queries are drawn from all nodes alike, by a hash, until enough have links; each is compared
    with all nodes in blocks.  Classes of fewer than 5 queries are judged together.
    """
    spark, n = nodes.sparkSession, nodes.count()
    links = found.groupBy("node").agg(F.sum("found").alias("mine"))
    size = AUDIT_QUERIES
    while True:
        chosen = nodes.where(F.pmod(F.xxhash64("node", F.lit(11)), F.lit(max(1, n // size))) == 0).select("node", "vector").orderBy(F.xxhash64("node")).limit(2 * MOST_QUERIES).collect()
        if not chosen:
            return 1.0
        ids = np.array([r["node"] for r in chosen])
        shipped = spark.sparkContext.broadcast(_normalised([r["vector"] for r in chosen]))  # 2 * MOST_QUERIES vectors at most

        def compared(batches):
            counts = np.zeros(len(ids), dtype=np.int64)
            for pdf in batches:
                for at in range(0, len(pdf), 1000):
                    part = pdf.iloc[at : at + 1000]
                    counts += (shipped.value @ _normalised(part["vector"]).T >= least + 1e-12).sum(axis=1)
                    counts -= np.isin(ids, part["node"].to_numpy())  # itself
            yield pd.DataFrame({"node": ids, "real": counts})  # once a task

        truth = nodes.mapInPandas(compared, "node long, real long").groupBy("node").agg(F.sum("real").alias("real")).where("real > 0")
        rows = truth.join(links, "node", "left").select("real", F.coalesce("mine", F.lit(0)).alias("mine")).collect()  # a row for each query
        if len(rows) >= LINKED_QUERIES or size >= min(n, MOST_QUERIES):
            break
        size *= 4
    classes: dict[int, list[float]] = {}
    for r in rows:
        classes.setdefault(int(np.log10(r["real"])), []).append(min(1.0, r["mine"] / r["real"]))
    few = [x for c in classes.values() if len(c) < 5 for x in c]
    means = [float(np.mean(c)) for c in [*(c for c in classes.values() if len(c) >= 5), few] if c]
    return min(means, default=1.0)


def all_links(nodes: DataFrame, least: float) -> DataFrame:
    """FOUND rows by comparing all vectors, in pairs of blocks: the exact way where graphs don't find enough."""
    g = max(1, -(-nodes.count() // BLOCK_MEMBERS))
    b = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(g))
    dealt = nodes.withColumn("b", b).withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(g - 1).cast("bigint"))))
    dealt = dealt.select("node", "vector", "copies", "b", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"))

    def compared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, copies, vectors, block = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), _normalised(pdf["vector"]), pdf["b"].to_numpy()
        left, right = np.flatnonzero(block == key[0]), np.flatnonzero(block == key[1])
        found, sums, trees = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64), [(ids[:0], ids[:0])]
        for at in range(0, len(left), flatgraph.QUERIES):
            part = left[at : at + flatgraph.QUERIES]
            q, other = np.nonzero(vectors[part] @ vectors[right].T >= least)
            a, c = part[q], right[other]
            once = a < c if key[0] == key[1] else np.ones(len(a), dtype=bool)  # in one block every pair is met twice
            a, c = a[once], c[once]
            for i, j in ((a, c), (c, a)):
                found += np.bincount(i, minlength=len(ids))
                sums += np.bincount(i, weights=copies[j], minlength=len(ids)).astype(np.int64)
            if len(a):
                trees.append(forest(ids[a], ids[c]))
        own = np.flatnonzero(found)
        u, v = (np.concatenate([t[k] for t in trees]) for k in range(2))
        node, root = forest(u, v) if len(u) else (u, v)
        none = np.zeros(len(node), dtype=np.int64)
        return pd.DataFrame({"node": np.concatenate([ids[own], node]), "found": np.concatenate([found[own], none]), "copies": np.concatenate([sums[own], none]), "root": np.concatenate([ids[own], root])})

    return checkpoint(dealt.groupBy("x", "y").applyInPandas(compared, FOUND))


def audited_links(nodes: DataFrame, least: float) -> tuple[DataFrame, float]:
    """FOUND rows and their audited recall, with the clusters' margin doubled while that is below LEAST_RECALL.

    Where it stays below with every vector in every cluster, all vectors are compared.
    """
    margin = MARGIN
    while True:
        found = links_within(nodes, least, margin)
        recall = audited_recall(nodes, found, least)
        LOG.info("margin %.2f: audited recall %.4f", margin, recall)
        if recall >= LEAST_RECALL:
            return found, recall
        if margin >= 2:
            return all_links(nodes, least), 1.0
        margin *= 2


def near_duplicate_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows of equal vectors are one node and link with each other; a node's rows each link with all
    rows of the nodes it links with.  Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, vectors of different dimensions neither.  A null id takes part in
    links but names no component (null where a component has none else).  Repeated rows are rows of
    their own; an empty table gives no rows; other columns are not read.  The margin between
    clusters is doubled until the audited recall is at least LEAST_RECALL, and at last all vectors
    are compared; the recall is logged.
    """
    rows = checkpoint(table.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector"), usable(F.col(vector)).alias("fine")))
    fine = rows.where("fine").select("vec_id", "vector", F.xxhash64("vector").alias("hash"))
    nodes = fine.groupBy("hash", "vector").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    nodes = checkpoint(nodes.withColumn("node", F.xxhash64("hash", "vector")))
    found = rows.sparkSession.createDataFrame([], FOUND)
    for size in [r[0] for r in nodes.select(F.size("vector")).distinct().collect()]:
        found = found.union(audited_links(nodes.where(F.size("vector") == size).select("node", "vector", "copies"), least)[0])
    beyond = checkpoint(found.groupBy("node").agg(F.sum("copies").alias("beyond")))
    parts = checkpoint(connected_components(found.select("node", "root")))
    named = checkpoint(parts.join(nodes.select("node", "first_id"), "node"))
    least_ids = checkpoint(named.groupBy("component").agg(F.min("first_id").alias("least_id")))
    named = checkpoint(named.join(least_ids, "component").select("node", "least_id"))
    full = nodes.join(beyond, "node", "left").join(named, "node", "left")
    full = checkpoint(full.select("hash", "vector", (F.col("copies") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"), F.coalesce("least_id", "first_id").alias("component_id")))
    linked = fine.join(full.select("hash", F.col("vector").alias("v"), "n_links", "component_id"), (fine["hash"] == full["hash"]) & (F.col("vector") == F.col("v")))
    out = linked.select("vec_id", "n_links", "component_id").union(rows.where("not fine").select("vec_id", F.lit(0).cast("bigint"), "vec_id"))
    return out.select(F.col("vec_id").alias(vec_id), F.col("n_links").cast("bigint").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
