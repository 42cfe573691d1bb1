import re

import numpy as np
import pytest
from oracle import canonical, connect, schema_of

import corpus_pipeline
from propensity.llm.bpe import encoding
from propensity.llm.common import stage
from propensity.llm.mixing import mix_sources
from propensity.llm.oracles import ORACLES_LLM
from propensity.llm.queries import LLM_QUERIES
from propensity.llm.toxicity import fit_toxicity, score_toxicity


@pytest.mark.parametrize("name", sorted(ORACLES_LLM))
def test_query_equals_sql(spark, tables, name):
    ours = LLM_QUERIES[name](spark, tables).toPandas()
    theirs = connect(tables).execute(ORACLES_LLM[name]).df()
    assert len(ours) == len(theirs) > 0 and canonical(ours) == canonical(theirs)
    assert set(schema_of(ours)) == set(schema_of(theirs))


def test_stages_by_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    step = docs
    kept = []
    for _, function in corpus_pipeline.STAGES[:-1]:
        step = function(spark, step, tables).persist()
        assert step.columns == docs.columns
        kept.append(step.collect())
    toxic, exact, near, mixed = kept
    model = fit_toxicity(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    clean = {r.doc_id for r in score_toxicity(docs, model).collect() if not r.predicted}
    assert {r.doc_id for r in toxic} == clean

    last = {}
    for r in toxic:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in exact} == set(last.values())

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {r.doc_id: shingles(r.text) for r in exact}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    assert {r.doc_id for r in near} == {root(i) for i in ids}

    words = {}
    for r in mixed:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    plan = {r.doc_id: r.taken for r in mix_sources(spark.createDataFrame(near, docs.schema)).collect() if r.taken}
    assert words == plan

    enc = encoding()
    final = corpus_pipeline.STAGES[-1][1](spark, step, tables).collect()
    assert sorted(bytes(r.decoded).decode() for r in final) == sorted(r.text for r in mixed)
    assert all(np.frombuffer(bytes(r.ids), "<u4").tolist() == enc.encode_ordinary(bytes(r.decoded).decode()) for r in final)


def test_run_applies_all_stages(spark, tables):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "byte bpe"]
    found = corpus_pipeline.run(spark, tables)
    assert found.columns == ["doc_id", "ids", "decoded"] and found.count() > 0


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def through(spark, docs, tables):
    """Rows after each stage; all but the last keep the columns."""
    found = []
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, tables), "edge-" + name.replace(" ", "-"))
        found.append(docs)
    return found


def test_odd_rows_pass_all_stages(spark, clashing, tables, words):
    one, two = words(60, 1), words(60, 2)
    rows = [
        (900_001, one, "en", "a", 1), (900_002, one, "en", "a", 1), (900_003, one + " tail", "en", "a", 1), (900_004, two, None, None, None),
        (None, two + " more", "en", "b", 1), (None, words(60, 3), "en", "b", 1), (None, words(60, 3), "en", "b", 1), (900_005, None, "en", "b", 0),
        (900_006, "", "en", "b", 0), (900_007, "  ", "en", "c", 2), (900_008, words(40, 4), "en", "c", 1), (900_008, words(40, 4), "en", "c", 1),
    ]
    docs = clashing(rows, SCHEMA)
    toxic, exact, near, mixed, last = through(spark, docs, tables)
    for step in (toxic, exact, near, mixed):
        assert step.columns == docs.columns
    assert toxic.count() == len(rows)

    def kept(step):
        return sorted(((r.doc_id, r.text or "") for r in step.select("doc_id", "text").collect()), key=repr)

    assert kept(exact) == sorted([
        (900_002, one), (900_003, one + " tail"), (900_004, two), (None, two + " more"), (None, words(60, 3)), (900_006, ""), (900_007, "  "),
        (900_008, words(40, 4)),
    ], key=repr)
    assert kept(near) == [row for row in kept(exact) if row[0] != 900_003]
    assert last.columns == ["doc_id", "ids", "decoded"]
    assert sorted(bytes(r.decoded).decode() for r in last.collect()) == sorted(text for _, text in kept(mixed))


def test_empty_table_passes_all_stages(spark, clashing, tables):
    for step in through(spark, clashing([], SCHEMA), tables):
        assert step.count() == 0
