"""The pipeline's stages act on what they get, and its registered queries keep their columns."""

import collections

import corpus_pipeline
from loomstone.llm import decontaminate, mixing, near_dedup
from loomstone.llm.common import Scratch, table


def test_stages_take_effect_in_order(spark, data):
    docs = table(spark, data, "documents")
    columns = docs.columns
    scratch = Scratch(spark, "test")
    kept, ids = [], {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, data), name)
        assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids
        ids = now
        kept.append(len(now))
    assert kept[-1] > 100
    assert near_dedup.near_duplicates(docs).where("NOT kept").count() == 0
    assert decontaminate.find_items(docs, table(spark, data, "benchmark")).count() == 0
    labels = {r.doc_id: r for r in table(spark, data, "labels").collect()}
    wrong = collections.Counter((labels[i].quality, labels[i].toxic) for i in ids if i in labels)
    good = sum(n for (q, t), n in wrong.items() if q and not t)
    assert sum(wrong.values()) - good <= 3
    mixed = corpus_pipeline.mix(spark, docs, data).collect()
    assert {r.doc_id for r in mixed} == ids and all(r.taken <= mixing.MOST * r.size for r in mixed)


def test_stages_on_an_empty_table(spark, data):
    docs = table(spark, data, "documents")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), data).count() == 0
