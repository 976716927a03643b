import math
import random
import zlib

import numpy as np

from paperloom.llm import toxicity as tox

from .conftest import prose

BAD = "vilething nastyword awfulterm".split()


def corpus(n=400):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = prose(i, rng.randrange(5, 120)).split()
        for _ in range(1 + len(words) // 20 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return (
        spark.createDataFrame(docs, "doc_id long, text string, toxic string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    rows = tox.score(*frames(spark, docs, labels)).collect()
    truth = {i: y for i, _, y in labels}
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 50 and all((r["score"] >= 0.3) == bool(truth[r["doc_id"]]) for r in held)
    for r in rows:
        assert bool(r["evidence"]) == bool(r["terms"])
        assert not (r["score"] >= 0.9 and not set(r["terms"]) & set(BAD))


def test_labels_held_out_are_never_learnt(spark):
    docs, labels = corpus()
    a = tox.score(*frames(spark, docs, labels)).select("doc_id", "score").collect()
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in labels]
    b = tox.score(*frames(spark, docs, turned)).select("doc_id", "score").collect()
    assert sorted(a) == sorted(b)


def dense(index, texts):
    """Unit vectors over all words of the examples by a plain loop; other words count in the length alone."""
    out = np.zeros((len(texts), len(index.names)))
    for row, t in zip(out, texts):
        square = 0.0
        for w in set(tox.words(t)):
            k = index.terms.get(w, -1)
            v = (1 + math.log(tox.words(t).count(w))) * index.weight[k]
            square += v * v
            if k >= 0:
                row[k] = v
        row /= math.sqrt(square) or 1.0
    return out


def test_whole_texts_against_brute_force(spark):
    docs, labels = corpus(300)
    docs = [(i, t, x) for i, t, x in docs] + [(900, docs[3][1], "x"), (901, docs[5][1] + " unheard", "x"), (902, "unheard words alone", "x")]
    index = tox.fit(*frames(spark, docs, labels))
    used = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(i for m in index.ids for i in m) == [i for i, _ in used]
    assert set(index.names) == {w for i, t, _ in docs if i in dict(used) for w in tox.words(t)}  # every term of every example
    df = {w: sum(w in set(tox.words(t)) for _, t, _ in docs) for w in index.names}
    held = {w: [y for i, y in used if w in tox.words(docs[i][1])] for w in index.names}
    n, p = len(used), sum(y for _, y in used) / len(used)
    for w, k in index.terms.items():
        z = (sum(held[w]) - p * len(held[w])) / math.sqrt((len(held[w]) + tox.SHRINK) * p * (1 - p))
        assert abs(index.weight[k] - (math.log((1 + len(docs)) / (1 + df[w])) + 1e-3) * (tox.LEAST_RELEVANCE + max(0, z))) < 1e-9
    entry = {i: d for d, m in enumerate(index.ids) for i in m}
    cosines = dense(index, [t for _, t, _ in docs]) @ dense(index, [docs[i][1] for i, _ in used]).T
    for (i, t, _), row in zip(docs, cosines):
        near = index.nearest(*index.unit(*index.counts(t)[:3]), 20)
        best = {entry[j]: c for (j, _), c in zip(used, row) if c > 1e-12}
        assert np.allclose([s for s, _ in near], sorted(best.values(), reverse=True)[:20], atol=1e-9)
        assert all(abs(best[d] - s) < 1e-9 for s, d in near)


def test_blocks_are_skipped():
    """Bounds leave blocks out, and the result is that of all blocks."""
    rng = random.Random(4)
    terms = [f"t{k}" for k in range(4000)]
    examples = []
    for i in range(3000):
        own = np.array(sorted(rng.sample(range(i // 300 * 400, i // 300 * 400 + 400), 12)))
        examples.append((i, int(i < 300), own, np.ones(12, int)))
    index = tox.Index(terms, np.full(4000, 20), 10_000, examples)
    t, w = index.unit(np.arange(400, 440), np.ones(40), 0.0)
    scored = np.zeros(len(index.ids))
    for d, m in enumerate(index.ids):
        x, v = index.unit(examples[m[0]][2], np.ones(12), 0.0)
        scored[d] = sum(w[np.flatnonzero(t == a)[0]] * b for a, b in zip(x, v) if a in t)
    near = index.nearest(t, w, 20)
    assert np.allclose([s for s, _ in near], np.sort(scored)[::-1][:20])
    assert [d for _, d in near] == sorted((d for _, d in near), key=lambda d: (-round(scored[d], 12), d))


def test_long_clean_text_with_one_suspect_word(spark):
    docs, labels = corpus()
    docs += [(10_000, prose(77, 3000) + " " + BAD[0], "x"), (10_001, " ".join(BAD * 3), "x")]
    rows = {r["doc_id"]: r["score"] for r in tox.score(*frames(spark, docs, labels)).collect()}
    assert rows[10_001] > 0.9 and rows[10_000] < rows[10_001]


def test_odd_rows_and_empty_tables(spark, odd, none):
    docs, labels = corpus(60)
    _, some = frames(spark, docs, labels)
    odd_labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 7), (6, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for l in (some, odd_labels, some.limit(0)):
        rows = tox.score(odd, l).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert tox.score(none, l).collect() == []
    kept = tox.keep(odd, frames(spark, *corpus())[1].join(spark.createDataFrame([(0,)], "doc_id long"), "doc_id", "left_anti"), 0.9)
    assert kept.dtypes == odd.dtypes and kept.count() == odd.count()
