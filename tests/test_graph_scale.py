"""Forests of any shape and impact over hubs, against plain walks."""

import random

from lexlake import refdata as R
from lexlake.operators import dashboard, forest, graph


def plain_forest(nodes):
    """key → (depth, size, children, position, path) by a walk from the roots."""
    known = {k for k, *_ in nodes}
    below, roots = {}, []
    for k, parent, title in sorted(nodes, key=lambda n: (n[2] is not None, n[2] or "", n[0])):
        below.setdefault(parent, []).append((k, title)) if parent in known and parent != k else roots.append((k, title))
    out, todo = {}, [(k, t, 0, ()) for k, t in reversed(roots)]
    while todo:
        k, title, depth, path = todo.pop()
        path = (*path, title)
        children = below.get(k, [])
        out[k] = [depth, 1, len(children), len(out), path]
        todo += [(c, t, depth + 1, path) for c, t in reversed(children)]
    parent = {k: p for k, p, _ in nodes}
    for k in sorted(out, key=lambda k: -out[k][0]):
        if parent[k] in out and parent[k] != k:
            out[parent[k]][1] += out[k][1]
    return {k: tuple(v) for k, v in out.items()}


def check(spark, nodes):
    df = spark.createDataFrame(nodes, "key long, parent long, title string").repartition(3)
    got = {r.key: (r.depth, r["size"], r.child_count, r.position, tuple(r.path)) for r in forest.number_forest(df, ["title"], "title").collect()}
    assert got == plain_forest(nodes)
    return got


def test_chain_wide_and_random_forests(spark):
    chain = [(i, i - 1 if i else None, f"t{i % 7}") for i in range(40)]
    assert check(spark, chain)[39][0] == 39
    wide = [(i, 0 if 0 < i < 200 else None, f"t{i * 7 % 5}") for i in range(230)]
    assert check(spark, wide)[0][1] == 200
    rnd = random.Random(4)
    nodes = [(i, rnd.choice([None, i, 10**6, *[rnd.randrange(i) for _ in range(6)]] if i else [None]), rnd.choice(["a", "b", None, "税"])) for i in range(150)]
    cycle = [(1000, 1001, "x"), (1001, 1002, "x"), (1002, 1000, "x"), (1003, 1002, "below a cycle")]
    assert not {1000, 1001, 1002, 1003} & set(check(spark, nodes + cycle))
    assert forest.number_forest(spark.createDataFrame([], "key long, parent long, title string"), ["title"]).count() == 0


def test_document_forest_is_deeper_than_five(spark, monkeypatch):
    monkeypatch.setattr(graph, "parent_key", lambda c: graph.F.nullif(graph.F.substring(c, graph.F.lit(1), graph.F.length(c) - 1), graph.F.lit("")))
    docs = spark.createDataFrame([(i, "k" * i, f"t{i}", "ruling") for i in range(1, 13)] + [(0, "kkk", "older", "ruling"), (99, None, "no key", "ruling")], "document_id long, entity_key string, title string, doc_type string")
    got = {r.document_id: (r.depth, r.position, r.child_count) for r in graph.document_forest(docs).collect()}
    assert got == {i: (i - 1, i - 1, int(i < 12)) for i in range(1, 13)}


def test_impact_of_many_seeds(spark):
    rnd = random.Random(9)
    edges = {(f"n{rnd.randrange(80)}", f"n{int(rnd.paretovariate(0.7)) % 80}") for _ in range(260)}
    seeds = [f"n{i}" for i in range(150)]
    into = {}
    for a, b in edges:
        into.setdefault(b, set()).add(a)
    want = set()
    for s in seeds:
        seen, level = set(), {s}
        for depth in range(1, 5):
            level = {a for b in level for a in into.get(b, ())} - seen
            want |= {(s, n, depth) for n in level}
            seen |= level
    relations = spark.createDataFrame([(*e, "cites") for e in edges] + [("n1", None, "cites")], "from_key string, to_key string, relation_type string")
    frame = spark.createDataFrame([(s,) for s in seeds * 2] + [(None,)], "seed string").repartition(3)
    got = graph.impact_spread(frame, relations, 4).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 500
    assert graph.impact_spread(frame, relations.where("false"), 4).count() == 0


def small_graph(spark, folder, seed):
    rnd = random.Random(seed)
    node = lambda: rnd.choice(["", "臺"]) + f"K{rnd.randrange(9)}" + rnd.choice(["", "", "#1"])
    edges = [(node().replace("臺", "台"), node().replace("臺", "台"), rnd.choice(["authority_of", "interprets", "cites", None])) for _ in range(60)]
    spark.createDataFrame(edges, "from_key string, to_key string, relation_type string").write.parquet(folder)
    keys = [node() for _ in range(12)] + ["nobody", None]
    return spark.createDataFrame([(k,) for k in keys], "entity_key string"), keys, edges


def plain_context(keys, edges):
    out = set()
    for key in {k.replace("臺", "台") for k in keys if k is not None}:
        named = [(a, b) for a, b, t in edges if t in R.IMPLEMENTING]
        docs = [(a, b) for a, b, t in edges if t == "authority_of" and "#" not in a + b]
        parents = {b for a, b in named if a == key}
        out |= {(key, "parent_law", b) for b in parents} | {(key, "child", a) for a, b in named if b == key}
        out |= {(key, "sibling", a) for a, b, _ in edges if b in parents and a != key}
        stem = key.split("#")[0]
        out |= {(key, "parent_document", b) for a, b in docs if a == stem} | {(key, "child_document", a) for a, b in docs if b == stem}
    return out


def test_context_reads_relations_once(spark, tmp_path):
    asked, keys, edges = small_graph(spark, str(tmp_path / "relations"), 3)
    found = graph.entity_context(asked, spark.read.parquet(str(tmp_path / "relations")))
    assert not [f for f in found.inputFiles() if "relations" in f]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_context(keys, edges)


def test_analysis_inputs_make_only_their_roles(spark, tmp_path):
    asked, keys, edges = small_graph(spark, str(tmp_path / "relations"), 5)
    changes = spark.createDataFrame([(i, i, 1, 2, k) for i, k in enumerate(keys)], "change_id long, document_id long, from_snapshot_id long, to_snapshot_id long, node_key string")
    documents = spark.createDataFrame([(0, "t")], "document_id long, title string")
    provisions = spark.createDataFrame([(2, keys[0], 1, "new")], "snapshot_id long, node_key string, ordinal int, text string")
    evidence = spark.createDataFrame([], "change_id long, rank int, origin string, title string, snippet string, url string")
    out = dashboard.analysis_inputs(changes, documents, provisions, spark.read.parquet(str(tmp_path / "relations")), evidence)
    assert "_document" not in out._jdf.queryExecution().optimizedPlan().toString().replace("document_id", "")
    want = plain_context(keys, edges)
    for r in out.collect():
        key = r.node_key and r.node_key.replace("臺", "台")
        for role in ("parent_law", "child", "sibling"):
            assert r[role] == (sorted(o for k, n, o in want if (k, n) == (key, role)) or None)
        assert r.new_text == ("new" if r.node_key == keys[0] else None)
