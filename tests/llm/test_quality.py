import itertools
import math
import random
import zlib

import numpy as np

from paperloom.llm import quality as q

from .conftest import prose


def corpus(n=300):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        lines = [prose(i * 31 + k, rng.randrange(4, 20)).capitalize() + "." for k in range(rng.randrange(1, 9))]
        if i % 4 == 0:
            lines = [" ".join(w + rng.choice(["###", "$$$", "!!"]) for w in x.split()) for x in lines]
        docs.append((i, "\n".join(lines), "x"))
        labels.append((i, int(i % 4 > 0), 0))
    return docs, labels


def frames(spark, docs, labels):
    return (
        spark.createDataFrame(docs, "doc_id long, text string, score string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    field = q.Field(rng.normal(size=q.WIDTH), rng.normal(size=2), rng.normal(size=(2, 2)))
    x = rng.normal(size=(6, q.WIDTH)) * 0.3
    s = x @ field.weights
    weight = {}
    for y in itertools.product((0, 1), repeat=6):
        e = field.first[y[0]] + sum(s[t] for t in range(6) if y[t]) + sum(field.pair[a, b] for a, b in zip(y, y[1:]))
        weight[y] = math.exp(e)
    total = sum(weight.values())
    wanted = [sum(w for y, w in weight.items() if y[t]) / total for t in range(6)]
    assert np.allclose(field.marginals(x), wanted)


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    rows = q.score(*frames(spark, docs, labels)).collect()
    truth = {i: y for i, y, _ in labels}
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 40
    assert sum((r["score"] >= 0.3) == bool(truth[r["doc_id"]]) for r in held) >= 0.97 * len(held)


def test_labels_held_out_are_never_learnt(spark):
    docs, labels = corpus(120)
    a = q.score(*frames(spark, docs, labels)).collect()
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, t) for i, y, t in labels]
    assert sorted(a) == sorted(q.score(*frames(spark, docs, turned)).collect())


def test_odd_rows_and_empty_tables(spark, odd, none):
    docs, labels = corpus(60)
    _, some = frames(spark, docs, labels)
    for l in (some, some.limit(0), spark.createDataFrame([(None, 1, 1), (6, None, 0), (6, 9, 0), (7, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")):
        rows = q.score(odd, l).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert q.score(none, l).collect() == []


def test_lines_are_labelled(spark):
    docs, labels = corpus()
    field = q.fit(*frames(spark, docs, labels))
    bad, good = next(t for i, t, _ in docs if i % 4 == 0), next(t for i, t, _ in docs if i % 4)
    for text, share in ((bad, 0.0), (good, 1.0)):
        _, up, down = field.score(text)
        assert up + down == text.count("\n") + 1 and abs(up / (up + down) - share) <= 0.25
    repeated = docs + [(docs[1][0], "another text under the same id", "x")] * 50
    assert len(q.score(*frames(spark, repeated, labels)).collect()) == len(repeated)


def test_extreme_lines_stay_finite():
    field = q.Field(np.full(q.WIDTH, 50.0), np.zeros(2), np.full((2, 2), 3.0))
    assert 0 <= field.score("#" * 100_000)[0] <= 1 and 0 <= field.score("\n" * 5000)[0] <= 1
