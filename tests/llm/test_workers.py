import gc

from paperloom.llm import decontaminate, packing, pii, simhash, toxicity

from .conftest import prose


def test_a_task_begins_without_what_another_stage_kept(spark, monkeypatch):
    """Workers live on through the stages: what each had kept would add up beside the executor's heap."""
    docs = spark.createDataFrame([(i, prose(i, 40), 1) for i in range(8)], "doc_id long, text string, n_chars int")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(8)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, prose(900, 20))], "item_id long, text string")
    taken, own = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *more: taken.append(f) or own(self, f, *more))
    for stage in (lambda: toxicity.keep(docs, labels), lambda: decontaminate.clean(docs, items), lambda: pii.masked(docs), lambda: simhash.keep_one(docs)):
        taken.clear()
        stage()
        assert taken
        for f in taken:
            packing.encoder("byte_bpe_50k.json").encode("some words")
            list(f(iter(())))
            assert not any(isinstance(x, packing.Encoder) for x in gc.get_objects())


def test_packing_keeps_its_encoder():
    enc = packing.encoder("byte_bpe_50k.json")
    assert packing.encoder("byte_bpe_50k.json") is enc


def test_small_tables_go_through_no_python_worker(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(8)], "doc_id long, quality int, toxic int").localCheckpoint()
    plan = toxicity._chosen(labels, 4, "doc_id")._jdf.queryExecution().toRdd().toDebugString()
    assert "PythonRDD" not in plan
