import random
import zlib

import numpy as np
import pytest

from paperloom.llm import packing

from .conftest import ODD, prose


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_tokenizers(tokenizer):
    rng = random.Random(1)
    texts = [t or "" for _, t in ODD if len(t or "") < 1000]
    texts += ["a  b", " lead", "trail ", "line\n next", "tab\t x", "it's 's ' s", "  x", "x  y", "<|endoftext|> z", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>", "<|endoftext", " <|endoftext|>  ", "1 22 333,4"]
    texts += ["".join(rng.choice("ab1 .,'s\n\té ß") for _ in range(rng.randrange(40))) for _ in range(500)]
    enc = packing.encoder("byte_bpe_50k.json")
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def check(rows, capacity=1024):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_places(spark, odd, tokenizer):
    rows = packing.pack(odd, with_ids=True).collect()
    n = check(rows)
    assert n <= -(-sum(r["length"] for r in rows) // 1024) + 1
    by = {}
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        assert len(r["ids"]) == r["length"]
        by.setdefault(r["doc_id"], []).append((r["start"], r["piece"], r["ids"]))
    assert set(by) == {i for i, _ in ODD}
    for i, t in ODD:
        if i != 7:
            own = sorted(by[i])
            assert [p for _, p, _ in own] == list(range(len(own)))
            assert all(len(x) == 1024 for _, _, x in own[1:])
            assert sum((x for *_, x in own), []) == tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    assert len(by[7]) == 2
    whole = packing.sequences(packing.pack(odd, with_ids=True)).collect()
    assert len(whole) == n and max(len(r["ids"]) for r in whole) <= 1024


def test_empty_table(spark, none):
    assert packing.pack(none).collect() == []


def fewest(sizes, capacity):
    """By exhaustive search."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= sizes[k]:
                left = list(rooms)
                left[left.index(r)] -= sizes[k]
                go(k + 1, left)
        go(k + 1, [*rooms, capacity - sizes[k]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum_and_plan_packs_all():
    rng = random.Random(7)
    for _ in range(150):
        capacity = rng.choice([10, 13, 20])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        count = {s: sizes.count(s) for s in sizes}
        fixed, left = packing.reduce_by_dominance(count, capacity)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sorted(rest + [s for t, own in fixed for s in own * t]) == sorted(sizes)
        assert sum(t for t, _ in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(sizes, capacity)
        whole = packing.plan(count, capacity)
        assert all(sum(own) <= capacity for _, own in whole)
        assert sorted(s for t, own in whole for s in own * t) == sorted(sizes)
        assert sum(t for t, _ in whole) <= fewest(sizes, capacity) + 1


def test_plan_is_near_the_bound_and_bounded():
    rng = random.Random(3)
    count = {}
    for _ in range(50_000):
        s = min(1024, max(1, int(rng.lognormvariate(5.5, 1))))
        count[s] = count.get(s, 0) + 1
    whole = packing.plan(count)
    bound = -(-sum(s * n for s, n in count.items()) // 1024)
    assert sum(t for t, _ in whole) <= 1.01 * bound
    assert len(packing.slots(whole)) < 64 * 1024


def test_one_length_for_all(spark):
    docs = spark.createDataFrame([(i, prose(1, 30)) for i in range(300)], "doc_id long, text string").repartition(7)
    rows = packing.pack(docs).collect()
    each = rows[0]["length"]
    assert check(rows) == -(-300 // (1024 // each))
