import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom.functions import geometry
from paperloom.functions.text import GAP_MARK
from paperloom.operators import match, sample


def test_words_fold():
    assert [w for w, *_ in match.fold_words("Été ⟦f1⟧ naïve [1, 2] co-\noperate x-ray")] == ["ete", "naive", "cooperate", "x", "ray"]
    w, a, b = match.fold_words("ab  Éc")[1]
    assert (w, a, b) == ("ec", 4, 6)


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_and_alignment():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        got = match.lcs(a, b)
        assert len(got) == brute_lcs(a, b) and all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    a = [f"w{k}" for k in range(200)]
    b = a[:50] + ["x", "y"] + a[60:]
    got = match.align_words(a, b)
    assert len(got) == 190 and all(a[i] == b[j] for i, j in got)


def test_greedy_uses_each_side_once():
    rng = random.Random(2)
    pairs = [(rng.random(), i, j) for i in range(12) for j in range(9)]
    got = match.greedy_pairs(pairs)
    assert len({i for _, i, _ in got}) == len({j for *_, j in got}) == len(got) == 9
    assert match.greedy_pairs([(0.5, 1, 0), (0.5, 0, 0)]) == [(0.5, 0, 0)]


def test_monotone_match():
    assert match.monotone_match([[0.9, 0.2], [0.9, 0.8]]) == [(0, 0), (1, 1)]
    assert match.monotone_match([[0.4, 0.4]]) == [] and match.monotone_match([]) == []


def test_unit_accuracy(spark):
    schema = "doc int, id int, elementIds array<string>"
    truth = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["c"]), (1, 2, ["z"]), (2, 0, ["q"])], schema)
    pred = spark.createDataFrame([(1, 0, ["b", "a"]), (1, 1, ["c", "d"]), (1, 2, ["c", "e", "f"])], schema)
    got = {r["doc"]: (r["correct"], r["total"], round(r["meanJaccard"], 3)) for r in match.unit_accuracy(truth, pred).collect()}
    assert got == {1: (1, 3, 0.5), 2: (0, 1, 0.0)}


def test_floats_take_the_later_of_a_tie(spark):
    schema = "doc int, id string, ord int, words array<string>"
    left = spark.createDataFrame([(1, "l0", 0, ["a", "b"]), (1, "l1", 1, ["a", "b"])], schema)
    right = spark.createDataFrame([(1, "r0", 0, ["a", "b"]), (1, "r1", 1, ["b", "a"]), (1, "r2", 2, ["z"])], schema)
    got = {(r["lid"], r["rid"]) for r in match.match_floats(left, right).collect()}
    assert got == {("l0", "r1"), ("l1", "r0")}


BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def page(spark, rows):
    return spark.createDataFrame(rows, f"page int, id string, ord int, box {BOX}, text string")


def test_reconcile(spark):
    model = page(spark, [(1, "m1", 1, (0.0, 0.0, 1.0, 0.2), "We used 5 mg of it in the test."), (1, "m2", 2, (0.0, 0.9, 1.0, 1.0), "Invented prose here.")])
    layer = page(spark, [
        (1, "t1", 1, (0.0, 0.0, 1.0, 0.2), "We used 7 mg of it in the test. A lost sentence stands here too. ⟦f1⟧"),
        (1, "t2", 2, (0.0, 0.4, 1.0, 0.5), "A block that the model left out."),
    ])
    rows = {r["id"]: r for r in match.reconcile(model, layer, GAP_MARK).collect()}
    assert "7 mg" in rows["m1"]["text"] and "⟦f1⟧" in rows["m1"]["text"] and rows["m1"]["flags"] == ["restored"]
    assert rows["m2"]["flags"] == ["mm-only"] and rows["t2"]["flags"] == ["inserted"] and rows["t2"]["ord"] == 2


def test_gaps():
    m = GAP_MARK
    assert match.filled_gaps(f"value of {m} in the text {m} end", "value of x in the text", m) == (2, 1)
    assert match.filled_gaps("no gap", "x", m) == (0, 0)


def test_anchor_cascade(spark):
    notes = spark.createDataFrame(
        [("n1", "d", 2, "b1", "", ""), ("n2", "d", 2, "old", "", ""), ("n3", "d", 2, "x", "head3", ""), ("n4", "d", 2, "x", "", "quoted words"), ("n5", "d", 2, "x", "", "absent"), ("n6", "d", 9, "b1", "", "")],
        "id string, docHash string, page int, bid string, srcHead string, quote string",
    )
    blocks = spark.createDataFrame(
        [("d", 2, "b1", [], "h", "t"), ("d", 3, "b2", ["old"], "h", "t"), ("d", 1, "b3", [], "head3", "t"), ("d", 2, "b4", [], "h", "some quoted words here")],
        "docHash string, page int, bid string, aliases array<string>, head string, text string",
    )
    got = {r["id"]: (r["status"], r["anchored"], r["drift"]) for r in match.reanchor(notes, blocks).collect()}
    assert got == {
        "n1": ("exact", "b1", False), "n2": ("alias", "b2", True), "n3": ("head", "b3", True), "n4": ("quote", "b4", True), "n5": ("lost", None, False), "n6": ("lost", None, False),
    }
    ready = spark.createDataFrame([("d", 2)], "docHash string, page int")
    assert {r["id"]: r["status"] for r in match.reanchor(notes, blocks, ready).collect()}["n6"] == "pending"


def test_bind_rejects_ambiguity(spark):
    s = f"page int, id string, box {BOX}"
    boxes = spark.createDataFrame([(1, "a", (0.0, 0.0, 1.0, 1.0)), (1, "b", (9.0, 9.0, 10.0, 10.0)), (1, "c", (20.0, 0.0, 21.0, 1.0))], s)
    targets = spark.createDataFrame([(1, "t", (0.0, 0.0, 1.0, 1.0)), (1, "u", (20.0, 0.0, 21.0, 1.0)), (1, "v", (20.0, 0.0, 21.0, 1.01))], s)
    got = {r["id"]: (r["bound"], r["conflict"]) for r in match.bind(boxes, targets).collect()}
    assert got == {"a": ("t", False), "b": (None, False), "c": (None, True)}


def test_joins_by_cascade(spark):
    f = spark.createDataFrame([("a", 1, "1"), ("b", 1, "2"), ("c", 2, None)], "id string, page int, number string")
    t = spark.createDataFrame([("a", 9, "9", "A"), ("z", 1, "2", "B")], "id string, page int, number string, latex string")
    assert {r["id"]: r["reference"] for r in match.attach_references(f, t).collect()} == {"a": "A", "b": "B", "c": None}
    e = spark.createDataFrame([(1, 0, "2.1 Methods", None), (1, 1, "Results", 7)], "doc int, ord int, title string, page int")
    h = spark.createDataFrame([(1, 0, 3, "h0", "methods"), (1, 1, 4, "h1", "2 Methods"), (1, 2, 8, "h2", "Results")], "doc int, ord int, page int, id string, title string")
    assert [r["heading"] for r in match.match_headings(e, h).orderBy("ord").collect()] == ["h0", None]


def test_headings_that_begin_with_a_number(spark):
    e = spark.createDataFrame([(1, 0, "2.1 56.187.231.175 Keit", None), (1, 1, "3 Results", None), (1, 2, "2.1 I have", None), (1, 3, "7 Other", None)], "doc int, ord int, title string, page int")
    h = [(1, 0, 1, "h0", "4763 Results"), (1, 1, 1, "h1", "56.187.231.175 Keit"), (1, 2, 1, "h2", "results"), (1, 3, 1, "h3", "I have"), (1, 4, 1, "h4", "8 Other"), (1, 5, 1, "h5", "9 Other")]
    h = spark.createDataFrame(h, "doc int, ord int, page int, id string, title string")
    assert [r["heading"] for r in match.match_headings(e, h).orderBy("ord").collect()] == ["h1", "h2", "h3", "h4"]


def test_similarities(spark):
    df = spark.createDataFrame([("abc", "cab "), ("", "x"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(match.charset_jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    assert [round(r[0], 3) for r in df.select(match.sentence_distance(F.col("a"), F.col("b"))).collect()] == [0.667, 1.0, 0.0]


def round_robin(sizes, quota):
    out, left, moved = dict.fromkeys(sizes, 0), quota, True
    while left and moved:
        moved = False
        for k in sorted(sizes):
            if left and out[k] < sizes[k]:
                out[k], left, moved = out[k] + 1, left - 1, True
    return out


def test_allocation_equals_round_robin():
    rng = random.Random(4)
    for _ in range(300):
        sizes = {f"k{i}": rng.randrange(12) for i in range(rng.randrange(1, 6))}
        q = rng.randrange(40)
        assert sample.allocate(sizes, q) == round_robin(sizes, q)


def test_generator():
    a, b = sample.mulberry32(7), sample.mulberry32(7)
    x = [a() for _ in range(100)]
    assert x == [b() for _ in range(100)] and all(0 <= v < 1 for v in x) and len(set(x)) == 100


@pytest.fixture(scope="module")
def units():
    rng = random.Random(5)
    rows = []
    for k in range(900):
        f = rng.choice(sample.FIELDS)
        rows.append((f"p{rng.randrange(9)}", f, rng.choice(["pub", "pre"]), rng.randrange(5), f"u{k}", rng.random(), rng.choice(["display", "inline"]), rng.random() < 0.3))
    return pd.DataFrame(rows, columns=["paperId", "field", "sourceType", "page", "unitId", "confidence", "type", "equationNumber"])


def test_stratified_sample(spark, units):
    df = spark.createDataFrame(units)
    pick = lambda seed: sample.stratified(df, ["field", "sourceType"], 120, ["unitId"], seed, "confidence").toPandas()
    a, b = pick(1), pick(1)
    assert sorted(a.unitId) == sorted(b.unitId) and len(a) == 120 and sorted(a.unitId) != sorted(pick(2).unitId)
    n = a.groupby("field").size()
    assert n.max() - n.min() <= 1
    assert a.confidence.mean() < units.confidence.mean()


def test_replay(units):
    a, b = sample.replay(units, 100), sample.replay(units.sample(frac=1, random_state=3), 100)
    assert sorted(a.unitId) == sorted(b.unitId) and len(a) == 100
    assert len(sample.replay(units, 10_000)) == len(units)


def test_queue_interleaves(spark):
    df = spark.createDataFrame([("f1", "p1", 1, "a", 0.1), ("f1", "p1", 1, "b", 0.2), ("f1", "p2", 1, "c", 0.3), ("f2", "p3", 1, "d", 0.9)], "field string, paperId string, page int, unitId string, confidence double")
    got = [r["unitId"] for r in sample.review_queue(df).orderBy("queue").collect()]
    assert got == ["a", "d", "c", "b"]


def test_unit_accuracy_covers_every_line(spark):
    import __spark_entry__ as entry

    sf, query = "/root/testdata/sf0.001", entry.queries()["greedy_unit_accuracy"]
    from paperloom.plans.document_queries import blocks

    got = {r["doc"]: r["total"] for r in query(spark, sf).collect()}
    wanted = {r["doc_id"]: r["count"] for r in blocks(spark, sf).groupBy("doc_id").count().collect()}
    assert got == wanted and max(got.values()) > 6


def test_distances_of_many_pairs(spark):
    import random

    from paperloom.functions.distance import levenshtein

    rng = random.Random(1)
    some = lambda n: "".join(rng.choice("abcdé字\U0001f600 ") for _ in range(n))
    rows = [(some(n), some(rng.choice([0, 1, 64, 65, 130, 400]))) for n in (0, 1, 2, 63, 64, 65, 127, 128, 129, 200, 399, 400) for _ in range(4)]
    rows += [(a, "".join(c for c in a if rng.random() < 0.9) + b[:3]) for a, b in rows]
    df = spark.createDataFrame(rows, "a string, b string").select(levenshtein("a", "b").alias("own"), F.levenshtein("a", "b").alias("plain"))
    assert all(r["own"] == r["plain"] for r in df.collect())


def test_alignment_measures_only_what_can_be_best(spark):
    """Best pairs equal those over all pairs: repeats, empty texts, boxes, long texts, ties."""
    import random

    from pyspark.sql import Window

    rng = random.Random(2)
    words = [" ".join(rng.choice(["the", "old", "Mill", "on", "a", "river"]) for _ in range(rng.choice([0, 1, 4, 9, 120]))) for _ in range(24)]
    rows = [(p, k, k, (float(k % 3 * 5), 0.0, float(k % 3 * 5 + 8), 4.0), rng.choice(words)) for p in range(4) for k in range(16)]
    layer = spark.createDataFrame(rows, f"page int, id int, ord int, box {BOX}, text string")
    model = layer.where("id % 2 = 0").withColumn("text", F.expr("concat(text, if(id % 4 = 0, ' mill', ''))"))
    got = match.align_blocks(model, layer)
    assert "pythonudf" in got._jdf.queryExecution().optimizedPlan().toString().lower()  # measured in batches, after the bounds
    m, t = model.select("page", F.col("id").alias("mid"), F.col("box").alias("mb"), F.col("text").alias("mt")), layer.select("page", F.col("id").alias("tid"), F.col("box").alias("tb"), F.col("text").alias("tt"))
    score = 2 * geometry.iou(F.col("mb"), F.col("tb")) + (1 - match.sentence_distance(F.col("mt"), F.col("tt")))
    every = m.join(t, "page").withColumn("score", score).where("score >= 0.45")
    every = every.withColumn("k", F.row_number().over(Window.partitionBy("page", "tid").orderBy(F.col("score").desc(), "mid"))).where("k = 1")
    key = lambda df: sorted(tuple(r) for r in df.select("page", "tid", "mid", "score").collect())
    assert key(got) == key(every)
    left = match.unmatched(layer, got).select("page", "id").collect()
    assert sorted(map(tuple, left)) == sorted(set((r[0], r[1]) for r in rows) - {(r["page"], r["tid"]) for r in every.collect()})


def test_align_blocks_reads_whole_texts(spark):
    """What lies beyond 400 characters decides, by code points; equal scores go to the first by order, and without a partner nothing comes."""
    head, far = "the old mill " * 40, (0.0, 50.0, 1.0, 51.0)
    own = (0.0, 0.0, 1.0, 1.0)
    layer = spark.createDataFrame([(1, 7, 0, own, head + "é" * 300), (1, 8, 1, own, "x" * 900), (1, 9, 2, own, ""), (2, 7, 0, own, "alone"), (None, 7, 0, own, head)], f"page int, id int, ord int, box {BOX}, text string")
    model = spark.createDataFrame([(1, "a", 5, far, head + "z" * 300), (1, "b", 6, far, head + "é" * 270), (1, "d", 4, far, head + "é" * 240 + "z" * 30), (1, "c", 3, far, "x" * 400 + "y" * 500), (None, "a", 1, far, head)], f"page int, id string, ord int, box {BOX}, text string")
    got = match.align_blocks(model, layer, first=None)
    size = len(head) + 300
    assert got.schema.simpleString() == "struct<page:int,tid:int,mid:string,score:double>"
    assert [tuple(r) for r in got.collect()] == [(1, 7, "b", 1 - 30 / size)]  # x and y differ in 500 of 900: 0.444
    same = model.where("id = 'b'").withColumn("ord", F.lit(9)).withColumn("id", F.lit("0"))
    assert [r["mid"] for r in match.align_blocks(model.union(same), layer, first=None).collect()] == ["b"]
    assert match.unmatched_blocks(layer.limit(0).withColumns({"model": F.lit(True), "layer": F.lit(True)}), first=None).collect() == []


def test_unmatched_blocks_without_best_pairs(spark, monkeypatch):
    """As by ``align_blocks``: repeats, empty texts, boxes, long texts, nulls; what bounds decide is not measured."""
    import datetime

    from paperloom.functions import distance
    from paperloom.plans import registry

    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcdé字\U0001f600 ") for _ in range(n))
    texts = [some(n) for n in (0, 1, 5, 63, 64, 65, 130, 400)]
    for t in texts:
        for lo, hi in ((0, len(texts)), (2, 6)):
            assert distance.Patterns(texts).distances(t, lo, hi).tolist() == distance.distances([t] * (hi - lo), texts[lo:hi]).tolist()

    words = [" ".join(rng.choice(["the", "old", "Mill", "on", "a", "river"]) for _ in range(rng.choice([0, 1, 4, 9, 120]))) for _ in range(24)] + [None]
    day = lambda p: datetime.date(2024, 1, 1 + p) if p else None
    rows = [(day(p), rng.choice([k, k, k % 7, None]), k, (float(k % 5 * 5), 0.0, float(k % 5 * 5 + 8), 4.0) if k % 9 else None, rng.choice(words), rng.choice([True, False, None]), k % 4 > 0) for p in range(9) for k in range(24)]
    df = spark.createDataFrame(rows, f"page date, id int, ord int, box {BOX}, text string, model boolean, layer boolean").repartition(3)
    layer = df.where("layer")
    got = match.unmatched_blocks(df)
    assert got.schema == df.select("page", "id").schema
    key = lambda d: sorted(map(str, d.select("page", "id").collect()))
    want = key(match.unmatched(layer, match.align_blocks(df.where("model"), layer)))
    assert key(got) == want and 0 < len(want) < layer.count()
    assert match.unmatched_blocks(df.limit(0)).collect() == []

    def fail(*_):
        raise AssertionError("measured")

    monkeypatch.setattr(match, "Patterns", fail)
    box = np.array([[0.0, k * 9.0, 1.0, k * 9.0 + 1] for k in range(5)])
    flags = np.array([True, False, False, False, True]), np.ones(5, bool)
    missed = match._missed(["one text", "one text", "b" * 90, "c", "d" * 400], np.array([8, 8, 90, 1, 400]), [None] * 5, box, *flags)
    assert missed.tolist() == [False, False, True, True, False]
    plan = registry.QUERIES["blocks_unmatched"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "pythonudf" not in plan and plan.count("relation [") == 1  # one scan, no pair of lines leaves Python
