"""Stage by stage on a small table, each against a brute-force version on the stage's own input."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from brute import classes, leaked, quality, targets, words

import __spark_entry__
from edgetide.llm import quality_rules
from edgetide.llm.common import Scratch


@pytest.fixture(scope="module")
def stages(spark, sf):
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf}/documents.parquet")
    found = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = found[name] = scratch.save(stage(spark, docs, sf), name)
    return found


def rows(df):
    return df.collect()


def test_columns_and_registration(stages):
    want = stages["documents"].columns
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)[1:]
    assert all(stages[n].columns == want for n in list(stages)[:-1])
    assert __spark_entry__.queries()["pipeline"] and "pipeline" not in __spark_entry__.oracle_sql()


def test_quality(stages):
    def kept(text):
        m = quality(text)
        return not (m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"] or 10 * m["n_symbols"] > m["n_words"]
                    or 100 * m["n_dup_lines"] > 30 * m["n_lines"] or m["word_chars"] < 2 * m["n_words"]
                    or m["word_chars"] > 20 * m["n_words"] or (m["n_words"] >= 50 and 100 * m["n_unique_words"] < 10 * m["n_words"]))

    assert quality_rules.POLICY == "v2"
    assert {r.doc_id for r in rows(stages["quality_rules"])} == {r.doc_id for r in rows(stages["documents"]) if kept(r.text)}


def test_near_duplicates(stages):
    before = rows(stages["quality_rules"])
    first = {min(before[i].doc_id for i in c) for c in classes([r.text for r in before])}
    assert sorted(r.doc_id for r in rows(stages["near_duplicates"])) == sorted(first)


def test_mixing(stages):
    before, after = rows(stages["decontamination"]), Counter(r.doc_id for r in rows(stages["mixing"]))
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        n = len(words(r.text))
        sizes[r.source] += n
        taken[r.source] += n * after[r.doc_id]
        most[r.source] = max(most[r.source], n)
    want = targets(sizes)
    assert max(after.values()) <= 2 and set(after) <= {r.doc_id for r in before}
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 for s in sizes)


def test_sharding(stages):
    got = rows(stages["sharding"])
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows(stages["mixing"]))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_edge_rows(spark, sf, edge_docs):
    scratch, docs = Scratch(spark), edge_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, sf), name)
        assert name == "sharding" or docs.columns == edge_docs.columns
    assert {r.doc_id for r in docs.collect()} <= {1, 6}


def test_decontamination(spark, sf, stages):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    before = [(r.doc_id, r.text) for r in rows(stages["near_duplicates"])]
    leaking = {d for d, _ in leaked(before, [tuple(r) for r in bench.collect()])}
    assert leaking and sorted(r.doc_id for r in rows(stages["decontamination"])) == sorted({d for d, _ in before} - leaking)
