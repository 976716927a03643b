from paperloom.llm import decontaminate as dec

from .conftest import prose

ITEM = "A train leaves Geneva at 9 and travels 120 km in 2 hours before it stops in Zurich. How many km does the train travel in 5 hours if it keeps the same speed all day long?"
OTHER = "A train leaves Verona at 7 and travels 300 km in 4 hours before it stops in Trieste. How many km does the train travel in 6 hours if it keeps the same speed all day long?"


def run(spark, texts, items=(ITEM,), **more):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(100 + i, t) for i, t in enumerate(items)], "item_id long, text string")
    return {(r["doc_id"], r["item_id"], r["kind"]) for r in dec.matches(docs, bench, **more).collect()}


def test_templates():
    assert dec.templates("Then Anna ran 5 km, or 7kg? Bob said NASA won.".split()) == [
        "then", "<name>", "ran", "<num>", "<unit>", "or", "<num><unit>", "bob", "said", "nasa", "won",
    ]


def test_verbatim_reparameterised_and_clean(spark):
    long = prose(1, 40_000) + " . " + ITEM + " " + prose(2, 300)
    near = ITEM.replace("all day long", "all the way there")
    inconsistent = "Two men at 3 and 4, " + ITEM.replace("Zurich", "9")
    texts = [f"{prose(3, 50)}. {ITEM} {prose(4, 50)}", OTHER, prose(5, 300), None, "", "one", long, near, inconsistent, ITEM.split(". ")[0]]
    got = run(spark, texts)
    assert {(0, 100, "verbatim"), (1, 100, "reparameterised"), (6, 100, "verbatim"), (7, 100, "verbatim")} <= got
    assert {d for d, *_ in got} <= {0, 1, 6, 7, 8}


def test_slots_must_be_consistent():
    item = "then old Mia gave 3 red apples to young Tom and so Mia kept 3 green pears while poor Tom ate them all"
    w = dec.Windows([(1, item)])
    kinds = lambda t: [m[3] for m in w.matches([t], 0.8)]
    other = item.replace("Mia", "Ada").replace("Tom", "Bob")
    assert kinds(other) == ["reparameterised"]
    # numbers are bound by place: equal ones may become different ones
    assert kinds(item.replace("3 red", "5 red").replace("3 green", "7 green")) == ["reparameterised"]
    # a name stays one name
    mixed = item.replace("Mia", "Ada", 1)
    assert kinds(mixed) == []
    # an occurrence further on is judged by itself
    assert kinds(mixed + " filler" * 60 + " " + item) == ["verbatim"]


def brute(texts, items, least=0.8):
    out = set()
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for i, t in enumerate(texts):
        own = grams(dec.templates(t.split()))
        for j, b in enumerate(items):
            tokens = dec.templates(b.split())
            places = [k for k in range(len(tokens) - 4) if sum(x[0] != "<" for x in tokens[k : k + 5]) >= 3]
            if places and sum(tuple(tokens[k : k + 5]) in own for k in places) >= least * len(places):
                out.add((i, 100 + j))
    return out


def test_against_brute_force(spark):
    items = [prose(k, 30 + k) for k in range(20)]
    texts = []
    for k in range(60):
        own = items[k % 20].split()
        for c in range(k % 4):
            own[(7 * c + k) % len(own)] = "changed"
        texts.append(prose(100 + k, 80) + " " + " ".join(own) + " " + prose(200 + k, 40))
    texts += [prose(400 + k, 120) for k in range(40)]
    got = {(d, i) for d, i, _ in run(spark, texts, items)}
    assert got == brute(texts, items) and len(got) > 30
    assert {(d, i) for d, i, _ in run(spark, texts, items, part_chars=500)} == got


def test_repeats_nulls_and_empty_tables(spark, odd, none):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, ITEM), (5, ITEM), (None, OTHER)], "item_id long, text string")
    assert dec.matches(odd, bench).collect() == []
    assert dec.matches(none, bench).collect() == []
    assert dec.matches(odd, bench.limit(0)).collect() == []
    two = spark.createDataFrame([(1, ITEM), (1, ITEM)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in dec.matches(two, bench.where("item_id > 0")).collect()) == [(1, 4), (1, 4), (1, 5), (1, 5)]


def test_clean_keeps_whole_rows(spark, odd):
    bench = spark.createDataFrame([(1, "same text of several plain words here")], "item_id long, text string")
    kept = dec.clean(odd, bench)
    assert kept.dtypes == odd.dtypes
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in odd.collect() if r["doc_id"] not in (6, 7))


def test_clean_with_empty_tables(spark, odd, none):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert dec.clean(none, bench).collect() == [] and dec.clean(none, bench.limit(0)).collect() == []
    assert dec.clean(odd, bench.limit(0)).count() == odd.count()
    twice = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in dec.clean(twice, bench).collect()] == [2]


def test_occurrences_side_by_side_and_repeated_windows():
    w = dec.Windows([(1, ITEM)])
    third = ITEM.replace("5 hours", "8 hours").replace("120", "240")
    for text in (f"{OTHER} {third}", f"{third} {OTHER}"):
        assert [m[3] for m in w.matches([text], 0.8)] == ["reparameterised"]
    edited = ITEM.replace("before it stops", "before it finally stops")
    for text in (f"{ITEM} {OTHER}", f"{OTHER} {ITEM}", f"{third} {edited} {OTHER}"):
        assert [m[3] for m in w.matches([text], 0.8)] == ["verbatim"]
    item = "she put 3 red apples in her bag and then 5 red apples in her bag and then 7 red apples in her bag"
    w = dec.Windows([(1, item)])
    assert [m[3] for m in w.matches([prose(1, 20) + " " + item], 0.8)] == ["verbatim"]
    assert [m[3] for m in w.matches([item.replace("5", "6")], 0.8)] == ["reparameterised"]


def test_items_without_windows():
    w = dec.Windows([(1, "Add 2 and 2"), (2, "How many are 7?"), (3, "12 34 56 78 90 11")])
    texts = ["he asked: Add 2 and 2 twice", "so Add 2 and 2!", "Add 3 and 3", "how many are 9?", "x 12 34 56 78 90 11 y", "1 2 3 4 5 6", None or ""]
    got = {(r, i, k) for r, i, _, k in w.matches(texts, 0.8)}
    assert got == {(0, 1, "verbatim"), (1, 1, "verbatim"), (3, 2, "reparameterised"), (4, 3, "verbatim")}
