"""The pipeline: stage by stage against the operators, planted cases, messy rows."""

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from check import compare
from pollgauge.llm.registry import MODULES, RUNS, TWINS, load_corpus_queries, table
from test_simhash import plain_components, shingles

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def test_every_operator_is_registered():
    runs, twins = load_corpus_queries()
    assert sorted(int(n[2:].split("_")[0]) for n in runs) == list(range(1, 14)) == list(range(1, len(MODULES) + 1))
    assert set(runs) | {"pipeline"} <= set(contract.queries()) and set(twins) <= set(contract.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "packing"]


@pytest.mark.parametrize("name", ["op1_warc_packages", "op4_top_k_search", "op9_chat_format"])
def test_twins(spark, name):
    load_corpus_queries()
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ok, text, _ = compare(spark, con, name, RUNS[name], TWINS[name], SF)
    assert ok, text


def test_stages_on_documents(spark):
    docs = table(spark, SF, "documents")
    seen, columns = docs, docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, seen, SF).persist()
        assert after.columns == columns and after.join(seen, "doc_id", "left_anti").count() == 0
        counts.append(after.count())
        if name == "near_duplicates":  # one of each component of what came in
            before = sorted((r.doc_id, r.text) for r in seen.select("doc_id", "text").collect())
            sets = [shingles(t, corpus_pipeline.SHINGLE) for _, t in before]
            label = plain_components(sets, 0.8)
            first = {}
            for (d, _), root in zip(before, label):
                first.setdefault(root, d)
            assert sorted(r.doc_id for r in after.collect()) == sorted(first.values())
        seen = after
    assert counts[0] > counts[1] >= counts[2] > counts[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in seen.collect()}


def test_planted_cases(spark):
    """Toxic documents, copies and near copies go, clean documents stay."""
    docs = table(spark, SF, "documents")
    clean = [(r.doc_id, r.text) for r in docs.join(table(spark, SF, "labels").filter("toxic = 0 AND quality = 1"), "doc_id").filter("n_chars > 1500").orderBy("doc_id").limit(20).collect()]
    bad = ["idiot", "moron", "trash", "scum", "loser"]
    planted = []
    for i, (_, text) in enumerate(clean):
        words = text.split(" ")
        planted.append((10_000 + i, text, "en", "p", len(text)))
        near = [w if k != len(words) // 2 else "changed" for k, w in enumerate(words)]
        planted.append((30_000 + i, " ".join(near), "en", "p", 0))
        planted.append((20_000 + i, " ".join(w + (" " + bad[k % 5] if k % 25 == 0 else "") for k, w in enumerate(words)), "en", "p", 0))
    mixed = docs.unionByName(spark.createDataFrame(planted, docs.schema)).persist()
    left = mixed
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF).persist()
    ids = {r.doc_id for r in left.collect()}
    assert not ids & {20_000 + i for i in range(20)} and not ids & {10_000 + i for i in range(20)}
    assert len(ids & {30_000 + i for i in range(20)}) <= 2
    dropped = sum(1 for d, _ in clean if d not in ids)
    assert dropped <= 4  # clean documents go only as copies of a smaller number


def test_messy_documents(spark, documents):
    left = documents([(1, None), (2, ""), (3, "the and of " * 50), (3, "the and of " * 50), (None, "the and of"), (4, "the " * 50_000)], clashes=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF).persist()
    assert sorted(r.doc_id for r in left.collect()) == [3, 4]
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, left, SF).collect()} == {3, 4}
    left = documents([])
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, SF)
    assert left.collect() == []
