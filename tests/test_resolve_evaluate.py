"""Resolution and evaluation."""

import itertools
import random

from quillmask.operators import evaluate, resolve

MENTIONS = "doc_id long, entity_type string, ord int, start int, mention string"


def ids(spark, mentions, cache=None, threshold=0.8):
    rows = spark.createDataFrame([(1, "NAME", i, i * 10, m) for i, m in enumerate(mentions)], MENTIONS)
    known = spark.createDataFrame([(1, "NAME", i, a) for i, a in cache], "doc_id long, entity_type string, id int, alias string") if cache else None
    return [r["id"] for r in resolve.resolved(rows, threshold, known).orderBy("ord").collect()]


def test_cache_cases(spark):
    assert ids(spark, ["Louise"], [(1, "Louise"), (1, "Louise Smith")]) == [1]
    assert ids(spark, ["Pedro", "d A"], [(3, "Louise")]) == [4, 5]
    assert ids(spark, ["Tom", "Tom"], [(2, "Tom")]) == [2, 2]
    assert ids(spark, ["Louise"], [(7, "Louise")], threshold=1.0) == [7]


def test_similar_mentions_share_an_id(spark):
    assert ids(spark, ["Acme Corporation", "Bob", "ACME  Corporation", "", "", "Acme Corporatio"], threshold=0.75) == [1, 2, 1, 3, 4, 1]
    assert ids(spark, ["a", "b"], threshold=0.0) == [1, 1]


def pairs(spark, rows):
    preds = spark.createDataFrame([("global", d, i, *s) for d, p, _ in rows for i, s in enumerate(p)], "scope string, doc_id long, ord int, start int, stop int, entity_type string, id string")
    golds = spark.createDataFrame([("global", d, i, *s) for d, _, g in rows for i, s in enumerate(g)], preds.schema)
    return evaluate.paired(preds, golds)


def plain_iou(a, b):
    i = min(a[1], b[1]) - max(a[0], b[0])
    u = a[1] - a[0] + b[1] - b[0] - i
    return i / u if i > 0 and u > 0 else 0.0


def test_greedy_iou_on_random_documents(spark):
    rng = random.Random(3)
    some = lambda: [(s := rng.randrange(20), s + rng.randrange(1, 8), "NAME", None) for _ in range(rng.randrange(1, 6))]
    rows = [(d, some(), some()) for d in range(300)]
    frame = pairs(spark, rows).cache()
    for t in (0.0, 0.25, 0.5):
        got = {r["doc_id"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.counted(frame, "iou", t).collect()}
        for d, p, g in rows:
            used = set()
            for a in p:
                best = max(((plain_iou(a, b), -j) for j, b in enumerate(g) if j not in used), default=None)
                if best and best[0] >= t:
                    used.add(-best[1])
            assert got[d] == (len(used), len(p) - len(used), len(g) - len(used))


def test_by_id_ignores_names_of_ids(spark):
    gold = [(0, 3, "NAME", "1"), (10, 13, "NAME", "1"), (20, 23, "NAME", "2"), (30, 33, "NAME", None)]
    pred = [(0, 3, "NAME", "x"), (10, 13, "NAME", "x"), (20, 23, "NAME", "x"), (30, 33, "NAME", None)]
    row = evaluate.counted_by_id(pairs(spark, [(1, pred, gold)]), "exact_by_id", None).first()
    assert (row["tp"], row["fp"], row["fn"]) == (2, 2, 2)


def test_assignment_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        n, m = rng.randrange(1, 6), rng.randrange(1, 6)
        cost = [[rng.choice([-3, -2, -1, 10**9]) for _ in range(m)] for _ in range(n)]
        got = sum(cost[i][j] for i, j in evaluate.assignment(cost))
        size = max(n, m)
        full = [[cost[i][j] if i < n and j < m else 0 for j in range(size)] for i in range(size)]
        assert got == min(sum(full[i][p[i]] for i in range(size)) for p in itertools.permutations(range(size)))


def test_sums_and_rates(spark):
    rows = [(1, [(0, 3, "PERSON", None)], [(0, 3, "NAME", None), (5, 6, "NAME", None)]), (2, [(0, 1, None, None)], [(0, 1, "COMPANY", None)])]
    got = {(r["variant"], r["entity_type"]): r for r in evaluate.summed(evaluate.evaluated(pairs(spark, rows), thresholds=(0.5,))).collect()}
    total = got["exact", None]
    assert (total["tp"], total["fp"], total["fn"], total["precision"]) == (1, 1, 2, 0.5)
    assert got["iou@0.50", "UNKNOWN"]["fp"] == 1 and ("iou@0.50_by_id", "NAME") in got
