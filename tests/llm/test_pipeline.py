import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from paperloom.llm import pii

from .test_decontaminate import brute
from .test_simhash import components

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    own = docs
    for name, stage in corpus_pipeline.STAGES:
        own = stage(spark, own, SF)
        kept[name] = own.toPandas()
        if name != "packing":
            assert own.dtypes == docs.dtypes
            own = spark.createDataFrame(kept[name], docs.schema)
    tox = {r["doc_id"] for r in entry.queries()["op8_toxicity"](spark, SF).where("predicted = 1").collect()}
    assert set(kept["toxicity"].doc_id) == {r["doc_id"] for r in docs.collect()} - tox
    sets = {r.doc_id: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for r in kept["toxicity"].itertuples() for w in [r.text.lower().split()]}
    ids = sorted(sets)
    top = components((a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert sorted(kept["simhash"].doc_id) == [i for i in ids if top.get(i, i) == i]
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in kept["simhash"].itertuples()}
    plain = lambda t: " ".join(t.split())
    whole = {i for i, t in texts.items() if any(plain(b) in plain(t) for b in bench)}  # hold an item word for word
    order = sorted(texts)
    near = {order[i] for i, _ in brute([texts[i] for i in order], bench)}  # hold a share of an item's windows, slots aside
    gone = set(texts) - set(kept["decontamination"].doc_id)
    assert whole and whole <= gone <= near
    before = {r.doc_id: r.text for r in kept["decontamination"].itertuples()}
    for r in kept["pii"].itertuples():
        assert r.text == pii.mask(before[r.doc_id]) and r.n_chars == len(r.text)
    packed = kept["packing"]
    assert sorted(set(packed.doc_id)) == sorted(before)
    assert (packed.groupby("sequence_id").length.sum() <= 1024).all()


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_run_over_odd_and_empty_tables(spark, odd, none, tmp_path, rows):
    """Nulls, empty and long texts, repeats and clashing columns; each of the other tables may be empty."""
    docs = odd if rows == "odd" else none
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for k, empty in enumerate(("labels", "benchmark", None)):
        sf = tmp_path / f"sf{k}"
        sf.mkdir()
        (sf / "documents.parquet").symlink_to(tmp_path / "documents.parquet")
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{name}.parquet").limit(0 if name == empty else 500).coalesce(1).write.parquet(f"{sf}/{name}.parquet")
        out = [r["doc_id"] for r in corpus_pipeline.run(spark, str(sf)).select("doc_id").distinct().collect()]
        if rows == "none":
            assert out == []
        elif empty != "labels":  # without labels every score is one half, which rejects all
            assert {1, 4, 6, None} <= set(out) and not {2, 3, 7} & set(out)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    con.sql("set timezone = 'UTC'")
    key = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    for name in ("op3_chat_formatting", "op7_url_filters", "op10_line_dedup"):
        df = entry.queries()[name](spark, SF)
        cols = ", ".join(f'"{c}"' for c in df.columns)
        assert key(df.collect()) == key(con.sql(f"select {cols} from ({entry.oracle_sql()[name]})").fetchall()), name
