import corpus_pipeline
import oracle_check as oc
import pytest
from fixtures import edge_docs, no_docs, shingles
from test_neardup import brute

from runledger.llm.catalog import ORACLE, QUERIES
from runledger.llm.sharding import write_shards


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, small, name):
    con = oc.connect(small)
    df = QUERIES[name](spark, small)
    assert oc.spark_rows(df) == oc.sql_rows(con, ORACLE[name])


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_keep_what_they_should(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    before = docs
    for name in ("language_id", "near_dedup", "decontamination", "mixing"):
        stages[name](spark, before, small).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == columns
        assert after.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0 or name == "mixing"
        rows = {r.doc_id: r.text for r in before.collect()}
        kept = [r.doc_id for r in after.collect()]
        if name == "language_id":
            assert set(kept) == set(rows)
        if name == "near_dedup":
            want = brute(list(rows.items()), 5, 4, 5)
            assert sorted(kept) == sorted(i for i, (_, c) in want.items() if i == c)
        if name == "decontamination":
            items = [shingles(r.text, 5) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            leaks = {
                i for i, t in rows.items()
                for own in [shingles(t, 5)]
                if any(5 * len(own & s) >= 4 * len(s) for s in items)
            }
            assert leaks and sorted(kept) == sorted(set(rows) - leaks)
        if name == "mixing":
            assert max(kept.count(i) for i in set(kept)) <= 2
        before = after
    corpus = stages["sharding"](spark, before, small).cache()
    assert corpus.select(columns).exceptAll(before).count() == 0 and corpus.count() == before.count()
    write_shards(corpus, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, before.collect()))
    assert back.where("text IS NULL").count() == 0


def test_odd_documents_pass_all_stages(spark, small):
    docs = edge_docs(spark)
    for source in (docs, no_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, source, small)
            if name != "sharding":
                assert out.columns == docs.columns
            out.collect()
