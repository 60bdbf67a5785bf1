import pathlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm import registry

from . import test_decontam, test_line_dedup, test_quality, test_simhash
from .helpers import CLASHES, SCHEMA, awkward_rows, rows_of
from .test_packing import check


def brute_pipeline(rows, items):
    """(doc_id, text) that reach the packing, by the brute-force versions of the stages."""
    kept = [r for r in rows if test_quality.brute_kept(r[1])]
    kept = [r[:2] for r in test_line_dedup.brute(kept)]
    kept = [min(group) for group in test_simhash.brute_keep(kept)]
    bad = {d for d, *_, c in test_decontam.brute(kept, items) if c}
    return [r for r in kept if r[0] not in bad]


def test_run_equals_brute_force(spark, sf_dir):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*c).collect()]
    left = brute_pipeline(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    check(corpus_pipeline.run(spark, sf_dir).collect(), left, lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    assert 100 < len(left) < 200


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.createDataFrame(awkward_rows(), spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert rows_of(docs.select("n_chars", docs.text), "n_chars", "text") == sorted(((len(r.text), r.text) for r in docs.collect()), key=repr)


def write_tables(spark, folder, docs, sf_dir):
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    return folder


def test_awkward_and_empty_tables(spark, sf_dir, tmp_path):
    names = ("doc_id", "start", "length", "ids_crc32")
    plain = spark.createDataFrame(awkward_rows(), SCHEMA).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000)).repartition(3)
    plain = plain.withColumn("source", F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.col("source")))
    clash = plain.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASHES.split(", ")])
    found = corpus_pipeline.run(spark, write_tables(spark, f"{tmp_path}/a", clash, sf_dir)).collect()
    want = corpus_pipeline.run(spark, write_tables(spark, f"{tmp_path}/b", plain, sf_dir))
    tokens = lambda rows: sorted((r.doc_id, n) for r in rows if (n := r.doc_tokens) and not r.start and r.doc_id is not None)
    assert tokens(found) == tokens(want.collect()) and len(found) > 100
    assert corpus_pipeline.run(spark, write_tables(spark, f"{tmp_path}/c", plain.limit(0), sf_dir)).select(*names).count() == 0


def test_two_pipelines_at_once(spark, sf_dir):
    """Each keeps its tables until its result is read, and deletes what its stages wrote on the way."""
    from quern.llm import _common

    names = ("doc_id", "start", "length", "ids_crc32", "sequence_id", "offset")
    folder = pathlib.Path(_common.own_folder(spark).removeprefix("file:"))
    before = {p.name for p in folder.glob("*")}
    with ThreadPoolExecutor(2) as pool:
        runs = [pool.submit(corpus_pipeline.run, spark, sf_dir) for _ in range(2)]
        one, other = (sorted(map(tuple, r.result().select(*names).collect())) for r in runs)
    assert one == other and len(one) > 100
    left = {p.name.rsplit("-", 1)[0] for p in folder.glob("*") if p.name not in before}
    assert left <= {"tokens", "bases", "parts", "sources"}


def test_registry_is_whole():
    assert list(dict.fromkeys(name.split("_")[0] for name in registry.QUERIES)) == [f"op{i}" for i in range(1, 14)]
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert len(corpus_pipeline.STAGES) == 5
