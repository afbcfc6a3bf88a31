"""Official evidence of many documents of few titles, against plain loops."""

import datetime as dt
import random

from lexlake.operators import corpus


def test_official_evidence_equals_loops_and_pairs_stay_few(spark):
    rnd = random.Random(3)
    at = lambda: dt.datetime(2026, 1, 1, rnd.choice([0, 9]), tzinfo=dt.timezone.utc) + dt.timedelta(days=rnd.randrange(30))
    titles = ["资源税法", "资源税法实施条例", "环境保护税法"]
    docs = [(i, rnd.choice(titles), rnd.choice(["", "", f"n{i % 5}"]), rnd.choice([at(), at(), at(), None])) for i in range(1500)]
    lib = [(rnd.choice(titles), f"n{i % 4}" if i % 9 == 0 else f"m{i}", rnd.choice([at(), at(), at(), None])) for i in range(1500)]
    d = spark.createDataFrame(docs, "document_id long, title string, external_id string, issued_at timestamp")
    found = corpus.official_evidence(d, spark.createDataFrame(lib, "title string, document_number string, pub_date timestamp"), 3, 4)
    got = {}
    for r in found.collect():
        got.setdefault(r.document_id, []).append((r["rank"], r.title, r.document_number))
    key = lambda e: (e[2] is None, -(e[2].timestamp() if e[2] else 0), e[0].encode(), e[1].encode())
    for i, title, number, issued in docs:
        hits = [e for e in lib if number and e[1] == number]
        hits = hits or [e for e in lib if issued and e[2] and title in e[0] and abs((e[2].date() - issued.date()).days) <= 4]
        assert sorted(got.get(i, [])) == [(k + 1, t, m) for k, (t, m, _) in enumerate(sorted(hits, key=key)[:3])]
    # Every aggregate, join and window stays near the size of its inputs: 1,500 of each.
    todo, most = [found._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        rows = node.metrics().get("numOutputRows")
        if rows.isDefined():
            most = max(most, rows.get().value())
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    assert 0 < most < 20_000, most
