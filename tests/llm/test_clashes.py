"""Extra columns, named like those that operators and stages add themselves, change no result and come back unchanged."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from driftspark.llm import pii, queries

NAMES = "_row _row_ entities Entities_ key hash kept0 matches names parts told row doc id n size score digest node fp bands component label part bits kept text_ runs spans term terms salt first last rank value v q fingerprint n_words n_hit items token_ids decoded n_rows".split()
TABLES = {"documents": 80, "embeddings": 60, "labels": 200, "benchmark": 40, "conversations": 60}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    plain, clash = (str(tmp_path_factory.mktemp(x)) for x in ("plain", "clash"))
    for name, n in TABLES.items():
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").orderBy(*{"labels": ["doc_id"], "conversations": ["conv_id", "turn"]}.get(name, [F.expr("1")])).limit(n).coalesce(1)
        rows.write.parquet(f"{plain}/{name}.parquet")
        rows = spark.read.parquet(f"{plain}/{name}.parquet")
        taken = {c.lower() for c in rows.columns}
        rows.select("*", *[F.lit(f"own {c}").alias(c) for c in NAMES if c.lower() not in taken]).write.parquet(f"{clash}/{name}.parquet")
    return plain, clash


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_operators(spark, folders, name, monkeypatch):
    monkeypatch.setattr(queries, "PII_KEY", "k")
    plain, clash = (queries.QUERIES[name](spark, f) for f in folders)
    assert plain.columns == clash.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, clash.collect()))


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_stages(spark, folders, name, stage, monkeypatch):
    monkeypatch.setattr(queries, "PII_KEY", "k")
    docs = spark.read.parquet(f"{folders[1]}/documents.parquet")
    odd = docs.filter("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.filter("doc_id = 3"))
    docs = docs.unionByName(odd)  # rows without an id, and a repeated one
    after = stage(spark, docs, folders[1])
    assert after.columns == docs.columns and after.count() > 0
    own = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    assert [tuple(r) for r in after.select(own).distinct().collect()] == [tuple(f"own {c}" for c in own)]
    assert pii.pseudonymise(docs, "k", entities="found").columns == ["doc_id", "text", "found"]
