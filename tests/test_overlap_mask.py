"""The overlap walk and the mask splice against plain Python statements of their rules."""

import random

from pyspark.sql import functions as F

from quillmask.operators import mask, overlap

COLS = "doc_id long, component string, comp_idx int, det_idx int, start int, stop int, entity_type string, id string, replacement string, confidence double, prio int, hier int"


def iou(a, b):
    i = min(a["stop"], b["stop"]) - max(a["start"], b["start"])
    u = a["stop"] - a["start"] + b["stop"] - b["start"] - i
    return i / u if i > 0 and u > 0 else 0.0


def plain_walk(rows, threshold, cross):
    kept = []
    for x in sorted(rows, key=lambda r: (r["prio"], r["hier"], r["comp_idx"], r["det_idx"])):
        blocked = False
        for n, k in enumerate(kept):
            same = k["entity_type"] is not None and k["entity_type"] == x["entity_type"]
            if not ((same or cross) and iou(k, x) > threshold):
                continue
            blocked = True
            if k["prio"] == x["prio"]:
                weight = lambda s: (s["confidence"] or 0, s["stop"] - s["start"], -s["start"])
                if not (k["comp_idx"] == x["comp_idx"] and (k["start"], k["stop"]) == (x["start"], x["stop"])) and weight(x) > weight(k):
                    del kept[n]
                    kept.append(x)
                break
        if not blocked:
            kept.append(x)
    return [(k["comp_idx"], k["det_idx"]) for k in kept]


def test_walk_on_random_documents(spark):
    rng = random.Random(5)
    rows = []
    for d in range(400):
        for i in range(rng.randrange(1, 8)):
            c, s = rng.randrange(1, 3), rng.randrange(12)
            rows.append((d, f"0{c}-X", c, i, s, s + rng.randrange(1, 7), rng.choice(["NAME", "COMPANY", None]), None, None, rng.choice([None, 0.2, 0.5, 0.9]), rng.randrange(2), c % 2))
    df = spark.createDataFrame(rows, COLS)
    names = [c.split()[0] for c in COLS.split(", ")]
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r[0], []).append(dict(zip(names, r, strict=True)))
    for threshold, policy in ((0.0, "same_type_only"), (0.2, "cross_type"), (0.75, "same_type_only")):
        got = {r["doc_id"]: [(e["comp_idx"], e["det_idx"]) for e in r["entities"]] for r in overlap.resolved(df, threshold, policy).collect()}
        for d, found in by_doc.items():
            seen, distinct = set(), []
            for r in sorted(found, key=lambda r: r["det_idx"]):
                key = (r["component"], r["start"], r["stop"], r["entity_type"])
                if key not in seen:
                    seen.add(key)
                    distinct.append(r)
            assert got[d] == plain_walk(distinct, threshold, policy == "cross_type"), (d, threshold, policy)


def spans(spark, text, found):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ents = spark.createDataFrame([(1, [(*f, None) if len(f) == 3 else f for f in found])], "doc_id long, entities array<struct<start:int,stop:int,entity_type:string,id:string>>")
    return docs, ents


def test_mask_tokens_and_clamping(spark):
    docs, ents = spans(spark, "Ana met Bob", [(8, 99, "NAME", "2"), (0, 3, "NAME", "1"), (5, 5, "NAME", None)])
    assert mask.masked(docs, ents).first()["masked_text"] == "[NAME1] met [NAME2]"
    assert mask.masked(docs, ents, "ASTERISK").first()["masked_text"] == "*** met ***"


def test_overlapping_spans_stay_hidden_unless_compatible(spark):
    docs, ents = spans(spark, "abcdefghij", [(0, 8, "NAME"), (2, 4, "NAME")])
    assert mask.masked(docs, ents).first()["masked_text"] == "[NAME][NAME]ij"
    assert mask.masked(docs, ents, compat=True).first()["masked_text"] == "[NAME][NAME]efghij"


def test_documents_without_spans_and_highlight(spark):
    docs = spark.createDataFrame([(1, "a <b>"), (2, "")], "doc_id long, text string")
    _, ents = spans(spark, "", [(2, 5, "NAME")])
    out = mask.masked(docs, ents).orderBy("doc_id").collect()
    assert [r["masked_text"] for r in out] == ["a [NAME]", ""]
    html = mask.masked(docs, ents).where("doc_id = 1").select(mask.highlighted(F.col("original_text"), F.col("entities"))).first()[0]
    assert html == 'a <mark title="NAME">&lt;b&gt;</mark>'
