"""The stages against plain versions of them, one after another on the same documents."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetops.llm import common
from fleetops.llm.common import below, cut, release, table
from fleetops.llm.decontaminate import shingles, words
from fleetops.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_quality_rules import brute
from tests.llm.test_near_copies import components
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stage_by_stage(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near duplicates", "decontamination", "mixing", "sharding"]
    got = {"documents": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), name.replace(" ", "-"))
        got[name] = docs.toPandas()
        assert list(got[name].columns)[:5] == COLUMNS or name == "sharding"
    ids = {n: set(p.doc_id) for n, p in got.items()}
    text = dict(zip(got["documents"].doc_id, got["documents"].text))
    # quality rules: nothing that fails the base rules stays, every text labelled good that passes them does
    failed = {d for d, t in text.items() if brute(t)[5]}
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert not ids["quality rules"] & failed
    assert all(d in ids["quality rules"] for d, q in labels.items() if q == 1 and d not in failed)
    # near duplicates: the smallest document of each component stays, by comparing all pairs of sets of five-word shingles
    assert ids["near duplicates"] == set(components({d: text[d] for d in ids["quality rules"]}).values())
    # decontamination
    items = [shingles(words(r.text)) for r in table(spark, SF, "benchmark").collect()]
    dirty = {d for d in ids["near duplicates"] if any(len(s & shingles(words(text[d]))) >= 0.8 * len(s) - 1e-9 for s in items)}
    assert dirty and ids["decontamination"] == ids["near duplicates"] - dirty
    # mixing keeps the documents as they are, sharding every row
    assert ids["mixing"] <= ids["decontamination"]
    assert pd.concat([got["mixing"][COLUMNS], got["sharding"][COLUMNS]]).groupby("doc_id").size().mod(2).sum() == 0
    sizes = got["sharding"].groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert set(COLUMNS) < set(out.columns) and out.count() > 0


@pytest.mark.parametrize("case", ["empty", "odd"])
def test_stages_on_odd_documents(spark, case):
    schema = ", ".join(f"{c} {t}" for c, t in zip(COLUMNS, ["long", "string", "string", "string", "long"])) + ", shard string, _row string, copies int"
    odd = [(None, None, None, None, None, "a", "b", 1), (1, "", "en", None, 0, "a", None, 1), (1, "", "en", None, 0, "a", None, 1), (2, "word " * 30000, None, "s", 1, None, None, None)]
    odd += [(i, " ".join(f"w{i}x{j} of the long text." for j in range(30)), "en", "s", 1, "a", "b", 2) for i in range(3, 30)] + [(40, " ".join(f"w5x{j} of the long text." for j in range(30)), "en", None, 1, "a", "b", 2)]
    docs = spark.createDataFrame(odd if case == "odd" else [], schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), "odd")
        assert "_row" in docs.columns and docs.columns.count("shard") == 1
        if name == "near duplicates" and case == "odd":
            assert sorted(r.doc_id for r in docs.collect()) == list(range(3, 30))
    assert case == "odd" or docs.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(connect(SF).sql(ORACLE_SQL[name]).df())


def test_sums_below(spark):
    keys = [0, 1, 2, 4095, 4096, 4097, 9000, 50000]
    df = spark.createDataFrame([(k, k + 1) for k in keys], "k long, v long")
    got = {r.k: r.v_below for r in below(df, "k", ["v"]).collect()}
    assert got == {k: sum(x + 1 for x in keys if x < k) for k in keys}
    assert below(df.filter(F.lit(False)), "k", ["v"]).count() == 0


def test_cuts_can_be_released(spark):
    with common.noted([]) as names:
        kept = cut(spark.range(5), "kept")
    other = cut(spark.range(6), "other")
    assert kept.count() == 5 and release(spark, names) == 1 and release(spark, names) == 0 and other.count() == 6
    spark.catalog.clearCache()
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|FAILED_READ_FILE"):
        kept.count()
