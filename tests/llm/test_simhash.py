import random

import numpy as np
import pytest

from paperloom.llm import simhash
from paperloom.llm.components import connected_components

from .conftest import ODD, prose


def plain(text, size=3):
    import xxhash

    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in (text or "").encode().split()]
    if not words:
        return 0
    own = [b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_fingerprints(odd):
    got = {(r["doc_id"], r["fp"] % 2**64) for r in simhash.fingerprints(odd).collect()}
    assert got == {(i, plain(t)) for i, t in ODD}


def test_golay_decodes_to_the_nearest_codeword():
    g = simhash.Golay()
    words = np.arange(1 << 12)
    code = (words << 11) | np.array([g.syndrome_of_high[w] for w in words])
    assert min(int(c).bit_count() for c in code[1:]) == 7
    rng = random.Random(2)
    for _ in range(500):
        k = rng.randrange(4096)
        x = int(code[k])
        for b in rng.sample(range(23), rng.randrange(4)):
            x ^= 1 << b
        assert g.index(np.array([x]))[0] == k


def test_keys_meet_within_two_bits():
    rng = random.Random(4)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randrange(3)):
            b ^= 1 << k
        row, key = simhash.keys(np.array([a, b], np.uint64))
        shared = set(key[row == 0]) & set(key[row == 1])
        assert shared
        both = [simhash.finer_keys(np.array(sorted(shared)), np.full(len(shared), x, np.uint64))[1] for x in (a, b)]
        assert set(both[0]) & set(both[1])


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_connect_what_brute_force_links(spark, monkeypatch, bucket):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for f in list(fps)[:60]:
        for _ in range(6):  # chains and dense clusters
            for k in rng.sample(range(64), rng.randrange(1, 4)):
                f ^= 1 << k
            fps.add(f)
    centre = rng.getrandbits(64)
    fps |= {centre ^ 1 << a ^ 1 << b for a in range(14) for b in range(a)}
    fps = sorted(fps)
    rng.shuffle(fps)
    monkeypatch.setattr(simhash, "BUCKET_PAIRS", bucket)
    nodes = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    edges = [(r["u"], r["v"]) for r in simhash.links(nodes).collect()]
    wanted = components((i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2)
    assert components(e for e in edges if e[0] != e[1]) == wanted


def test_components_of_documents(spark, odd, none):
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6), (4, 4)} <= got
    assert len(simhash.near_duplicates(odd).collect()) == len(ODD)
    assert simhash.near_duplicates(none).collect() == []


def test_keep_one(spark, odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert {1, 4, 6, None} <= {r["doc_id"] for r in kept.collect()}
    assert not {2, 3, 7} & {r["doc_id"] for r in kept.collect()}
    assert simhash.keep_one(none).collect() == []


def test_connected_components(spark):
    rng = random.Random(6)
    chain = [(i, i + 1) for i in range(0, 400)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    rest = [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(250)]
    edges = chain + star + rest
    rng.shuffle(edges)
    df = spark.createDataFrame(edges + edges[:50] + [(7, 7)], "a long, b long").repartition(4)
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {x: c for x, c in components(e for e in edges if e[0] != e[1]).items() if x != c}
    assert connected_components(df.limit(0)).collect() == []


def test_keep_one_links_by_five_word_similarity(spark):
    rng = random.Random(7)
    texts = []
    for k in range(25):
        words = prose(500 + k, 120).split()
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 5, 8):
            own = list(words)
            for c in rng.sample(range(len(own)), edits):
                own[c] = f"edited{c}"
            texts.append(" ".join(own))
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in map(str.split, texts)]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert any((plain(texts[i]) ^ plain(texts[j])).bit_count() > 8 for i, j in near)
    top = components(near)
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(len(texts)) if top.get(i, i) == i}


def test_keep_one_takes_candidates_from_fingerprints(spark, monkeypatch):
    """Without any shared minima the verified pairs within two bits are still found, and no others."""
    from paperloom.llm import shingles

    rng = random.Random(8)
    texts = []
    for k in range(20):
        words = prose(700 + k, 400).split()
        texts.append(" ".join(words))
        for edits in (1, 2, 4):
            own = list(words)
            for c in rng.sample(range(len(own)), edits):
                own[c] = f"edited{c}"
            texts.append(" ".join(own))
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in map(str.split, texts)]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    close = [(i, j) for i, j in near if (plain(texts[i]) ^ plain(texts[j])).bit_count() <= 2]
    assert 5 < len(close) < len(near)
    monkeypatch.setattr(shingles, "bands", lambda own: own[:1].view("int64") ^ shingles.number(own))  # a bucket of its own for each set
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    top = components(close)
    assert kept == {i for i in range(len(texts)) if top.get(i, i) == i}


def test_components_in_rounds_and_by_one_task(spark, monkeypatch):
    from paperloom.llm import components as own

    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)] + [(3, 3)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    want = {x: c for x, c in components(e for e in edges if e[0] != e[1]).items() if x != c}
    for most in (len(edges), 0):
        monkeypatch.setattr(own, "LAST_EDGES", most)
        assert {r["node"]: r["component"] for r in connected_components(df).collect()} == want
    monkeypatch.setattr(own, "LAST_EDGES", len(edges))
    monkeypatch.setattr(own, "_large_star", None)  # no round is planned
    assert connected_components(df).count() == len(want)
