from collections import defaultdict

from paperloom.llm import substring as sub

from .conftest import ODD, prose


def test_units():
    text = "Short one\nThis  LINE has\tother words\n\né 😀 more 中文 here"
    form, start, end, size = sub.units(text)
    assert " ".join(f.decode() for f in form) == "short one this line has other words é 😀 more 中 文 here"
    for f, a, b, n in zip(form, start, end, size):
        assert [w.decode() for w in f.split()] == [w.lower() for w in sub._WORD.findall(text[a:b])] and len(f.split()) == n
    assert all("\n" not in text[a:b] for a, b in zip(start, end))


def brute(docs, least):
    """doc_id: words (as numbers) in passages whose earliest place is elsewhere, and in earliest places."""
    at = defaultdict(list)
    for i, t in sorted(docs):
        form, _, _, size = sub.units(t)
        for a in range(len(form)):
            for b in range(a, len(form)):
                if sum(size[a : b + 1]) >= least:
                    at[b" ".join(form[a : b + 1])].append((i, a, sum(size[:a]), sum(size[: b + 1])))
                    break
    gone, kept = defaultdict(set), defaultdict(set)
    for places in at.values():
        for k, (i, _, x, y) in enumerate(sorted(places)):
            if len(places) > 1:
                (gone if k else kept)[i].update(range(x, y))
    return gone, kept


def test_passages_against_brute_force(spark):
    shared = [prose(k, 60 + 5 * k) for k in range(4)]
    docs = [(i, prose(100 + i, 30) + " " + shared[i % 4].upper() + "\n" + prose(200 + i, 40)) for i in range(12)]
    docs += [(20, prose(900, 300)), (21, shared[0] + "\n" + shared[0]), (22, prose(901, 20)), (23, "same short line\n" * 40)]
    rows = sub.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    gone, kept = brute(docs, sub.LEAST_WORDS)
    texts = dict(docs)
    for want, flag in ((gone, False), (kept, True)):
        own = defaultdict(int)
        for r in rows:
            if r["kept"] == flag:
                own[r["doc_id"]] += r["words"]
                assert len(sub._WORD.findall(texts[r["doc_id"]][r["start"] : r["end"]])) == r["words"] >= sub.LEAST_WORDS
        assert dict(own) == {i: len(x) for i, x in want.items() if x}
    assert {r["doc_id"] for r in rows} == set(range(12)) | {21, 23}  # every copy of a passage of over fifty words, no other
    assert all((r["kept_doc_id"] == r["doc_id"]) >= r["kept"] for r in rows)


def test_removal_keeps_the_first(spark):
    a, b = prose(1, 80), prose(2, 80)
    df = spark.createDataFrame(
        [(3, f"{a}\nfine words of its own\n{b}", "c"), (1, f"{b}\n{a.upper()}", "c"), (2, f"x\n  {a}", "c"), (4, "nothing shared", "c")],
        "doc_id long, text string, digest string",
    )
    rows = {r["doc_id"]: r for r in sub.without_repeats(df).collect()}
    assert rows[1]["text"] == f"{b}\n{a.upper()}" and rows[4]["removed"] is None
    for i, whole in ((3, f"{a}\nfine words of its own\n{b}"), (2, f"x\n  {a}")):
        text, at = "", 0
        for start, end in map(tuple, rows[i]["removed"]):
            assert whole[start:end].lower() in (a, b) or len(whole[start:end].split()) > 60  # all but a last unit too short for a run
            text, at = text + whole[at:start], end
        assert rows[i]["text"].split() == (text + whole[at:]).split()
    assert "fine words of its own\n" in rows[3]["text"] and rows[2]["text"].startswith("x\n  ")


def test_rows_of_one_id(spark):
    a, b = prose(5, 90), prose(6, 90)
    ends = [sub.runs(x) for x in (a, b)]
    a, b = (x[: max(r[3] for r in own)] for x, own in zip((a, b), ends))  # whole runs
    df = spark.createDataFrame([(7, a), (7, b), (7, a), (8, b), (None, a)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in sub.without_repeats(df).collect())
    assert got == sorted([(7, ""), (7, b), (7, ""), (8, ""), (0, a)])  # a null id ranks first; the other text of id 7 is whole


def test_odd_rows(spark, odd, none):
    rows = sub.passages(odd).collect()
    assert rows == []  # a word that ends no unit, however often repeated, is one unit
    assert sub.passages(odd, least_words=3).where("doc_id = 7 and not kept and kept_doc_id = 6").count() == 1
    assert len(sub.without_repeats(odd).collect()) == len(ODD)
    assert sub.passages(none).collect() == [] and sub.without_repeats(none).collect() == []
