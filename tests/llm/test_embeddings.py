import numpy as np

from palaver.llm import embeddings, flatgraph
from palaver.llm.embeddings import audited_recall, near_duplicate_vectors
from palaver.llm.queries import op9_embeddings


def brute(rows, least=0.95):
    """(id, links, component) by all pairs in double precision."""
    n = len(rows)
    fine = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    link = np.zeros((n, n), dtype=bool)
    for size in {len(v) for (_, v), f in zip(rows, fine, strict=True) if f}:
        own = [i for i in range(n) if fine[i] and len(rows[i][1]) == size]
        x = np.array([np.array(rows[i][1], dtype=np.float32).astype(np.float64) for i in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        link[np.ix_(own, own)] = x @ x.T >= least - 1e-12
    np.fill_diagonal(link, False)
    label = list(range(n))
    for start in range(n):
        if label[start] == start:
            walk = [start]
            while walk:
                for j in np.flatnonzero(link[walk.pop()]):
                    if label[j] > start:
                        label[j] = start
                        walk.append(int(j))
    least_id = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least_id[label[i]] = min(least_id.get(label[i], d), d)
    return [(d, int(link[i].sum()), least_id.get(label[i])) for i, (d, _) in enumerate(rows)]


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in op9_embeddings(spark, sf_dir).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_near_groups_over_several_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "PER_CLUSTER", 30)
    monkeypatch.setattr(embeddings, "MOST_CENTROIDS", 4)  # so that clusters are divided again
    monkeypatch.setattr(embeddings, "MOST_MEMBERS", 60)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 16))
    pairs = base[:100] + 0.05 * rng.normal(size=(100, 16))
    group = rng.normal(size=16) + 0.1 * rng.normal(size=(150, 16))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate([base, group, pairs]))]
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()]
    want = {r[0]: r for r in brute(rows)}
    assert all(n <= want[v][1] for v, n, _ in got)
    # recall of each kind by itself: the links of pairs aren't outweighed by those of the group
    assert sum(r[1] for r in got if r[0] in range(300, 450)) >= 0.97 * sum(want[v][1] for v in range(300, 450)) > 0
    lone = [r for r in got if 0 < want[r[0]][1] <= 3]
    assert len(lone) > 150 and np.mean([r[1] / want[r[0]][1] for r in lone]) >= 0.95
    assert sum(r[2] == want[r[0]][2] for r in got) >= 0.97 * len(want)


def test_flat_graph_finds_what_is_in_range():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(500, 32))
    group = rng.normal(size=32) + 0.1 * rng.normal(size=(300, 32))
    x = np.concatenate([base, base[:200] + 0.05 * rng.normal(size=(200, 32)), group, base[:1]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, at = flatgraph.in_range(x, flatgraph.build(x), x, 0.95)
    truth = x @ x.T >= 0.95
    assert truth[q, at].all() and len(set(zip(q.tolist(), at.tolist(), strict=True))) == len(q)
    assert len(q) >= 0.99 * truth.sum()
    for n in (1, 2, 3):
        q, at = flatgraph.in_range(x[:n], flatgraph.build(x[:n]), x[:n], 0.95)
        assert sorted(zip(q.tolist(), at.tolist(), strict=True)) == [(i, i) for i in range(n)]


def test_odd_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a), (3, [0.99, 0.05, 0.0]), (9, a), (9, a), (1, b), (2, None), (4, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [float("inf"), 0.0, 0.0]), (10, [1.0, 0.0]), (None, [0.0, 2.0, 0.0]), (11, [])]
    frame = spark.createDataFrame([(*r, 0, 1) for r in rows], "vec_id long, embedding array<float>, node int, hash int")
    got = near_duplicate_vectors(frame).collect()
    assert sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in got], key=str) == sorted(brute(rows), key=str)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert near_duplicate_vectors(frame.limit(0)).count() == 0


def test_audit_sees_lost_links(spark):
    nodes = spark.createDataFrame([(i, [1.0, i / 1000]) for i in range(10)], "node long, vector array<double>")

    def found(numbers):
        return spark.createDataFrame([(i, n, n, 0) for i, n in enumerate(numbers)], embeddings.FOUND)

    assert audited_recall(nodes, found([9] * 10), 0.95) == 1.0
    assert audited_recall(nodes, found([1] * 10), 0.95) < 0.2
    assert audited_recall(nodes, found([]), 0.95) == 0.0


def test_audit_does_not_weigh_queries_by_links(spark):
    # one group of many links, all found; pairs of which none is found
    rng = np.random.default_rng(4)
    group = np.array([1.0] + [0.0] * 15) + 0.02 * rng.normal(size=(100, 16))
    single = rng.normal(size=(100, 16))
    x = np.concatenate([group, single, single + 0.01 * rng.normal(size=(100, 16))])
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, vector array<double>")
    rows = spark.createDataFrame([(i, 99, 99, 0) for i in range(100)], embeddings.FOUND)
    assert audited_recall(nodes, rows, 0.95) < 0.1


def hot_group(n, others, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=16)
    near = base / np.linalg.norm(base) + 0.04 * rng.normal(size=(n, 16))
    return np.concatenate([near, rng.normal(size=(others, 16))])


def test_vectors_of_a_hot_group_are_members_once(spark, monkeypatch):
    """A group of mutually near vectors, of more than a block: few memberships, and every link."""
    for name, value in {"PER_CLUSTER": 20, "MOST_MEMBERS": 200, "BLOCK_MEMBERS": 250}.items():
        monkeypatch.setattr(embeddings, name, value)
    x = hot_group(900, 200)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    nodes = spark.createDataFrame([(i, v, 1) for i, v in rows], "node long, vector array<float>, copies long")
    members = embeddings.divided(embeddings.first_level(nodes, embeddings.MARGIN), embeddings.MARGIN)
    assert members.count() < 3 * len(rows) and members.where("home").count() == len(rows)
    want = {r[0]: r for r in brute(rows)}
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()]
    assert all(n <= want[v][1] for v, n, _ in got) and sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want.values()) > 100_000
    assert sum(r[2] == want[r[0]][2] for r in got) >= 0.99 * len(got)


def test_all_pairs_where_graphs_find_too_little(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_MEMBERS", 40)
    monkeypatch.setattr(embeddings, "audited_recall", lambda *a: 0.5)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(hot_group(100, 60))] + [(500, [1.0] * 16), (501, [1.0] * 16)]
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()]
    assert sorted(got) == sorted(brute(rows))
