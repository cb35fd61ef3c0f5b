"""The pipeline's stages on the documents table and on odd rows."""

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from vellum.llm.common import written
from vellum.llm.decontaminate import contaminated
from vellum.llm.secrets import BASE_RULES, scan_secrets
from vellum.llm.simhash import near_duplicates


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {"documents": docs}
    for name, stage in pipeline.STAGES:
        docs = out[name] = written(stage(spark, docs, sf_dir))
    return out


def test_stage_columns(stages):
    assert all(stages[n].columns == pipeline.COLUMNS for n, _ in pipeline.STAGES[:-1])


def test_language_keeps_clean_documents(stages):
    assert stages["language"].count() == stages["documents"].filter(F.col("text").rlike(r"\p{L}")).count()


def test_one_document_of_each_group_stays(stages):
    before, after = near_duplicates(stages["language"]), near_duplicates(stages["near_dedup"])
    assert stages["near_dedup"].count() == before.select("component_id").distinct().count()
    assert {r.doc_id for r in stages["near_dedup"].select("doc_id").collect()} == {r.component_id for r in before.select("component_id").collect()}
    assert after.groupBy("fingerprint").count().filter("count > 1").count() == 0


def test_no_item_is_left_and_only_leaks_go(spark, sf_dir, stages):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = {r.doc_id for r in contaminated(stages["near_dedup"], items).collect()}
    assert contaminated(stages["decontamination"], items).count() == 0
    assert {r.doc_id for r in stages["near_dedup"].collect()} - {r.doc_id for r in stages["decontamination"].collect()} == leaks


def test_secrets_are_gone_and_documents_stay(stages):
    assert stages["secrets"].count() == stages["decontamination"].count()
    assert scan_secrets(stages["secrets"], rules=BASE_RULES).filter("size(spans) > 0").count() == 0
    clean = scan_secrets(stages["decontamination"]).filter("size(spans) = 0").select("doc_id", "text")
    assert clean.join(stages["secrets"], ["doc_id", "text"]).count() == clean.count()


def test_mix_is_whole(spark, sf_dir, stages):
    assert sorted(r.doc_id for r in pipeline.run(spark, sf_dir).collect()) == sorted(r.doc_id for r in stages["mixing"].collect())


def test_odd_rows_pass_all_stages(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = "the of and to in a is that it was for on are as with his they at be this"
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, words, "en", "a", 5), (2, words, "en", "a", 5), (None, words + " other", "en", None, 5), (3, "mot le la les des une est que qui", "fr", "b", 4)], schema)
    for _, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir))
    assert set(docs.columns) >= set(pipeline.COLUMNS)
    empty = spark.createDataFrame([], schema)
    for _, stage in pipeline.STAGES:
        empty = written(stage(spark, empty, sf_dir))
    assert empty.count() == 0


def test_null_and_repeated_ids_lose_no_document(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("size(split(text, ' ')) > 20").first().text
    a, b, c = ("a copy of the text that two rows of this table hold", "nobody else has these words of an own clean text", "yet another clean document with a null for its id")
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (None, a, "en", "s", 1), (None, b, "en", "s", 1), (None, c, "en", "s", 1), (2, a, "en", "s", 1), (2, c + " too", "en", "s", 1), (None, item, "en", "s", 1)], schema)
    kept = written(pipeline.near_dedup(spark, docs, sf_dir))
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(1, a), (None, b), (None, c), (2, c + " too"), (None, item)}
    clean = pipeline.decontamination(spark, kept, sf_dir)
    assert {(r.doc_id, r.text) for r in clean.collect()} == {(1, a), (None, b), (None, c), (2, c + " too")}


def test_language_rejects_unlearned_scripts_and_letter_junk(spark, sf_dir, stages):
    odd = {-1: "Быстрая коричневая лиса прыгает через ленивую собаку", -2: "敏捷的棕色狐狸跳过懒狗然后继续跑", -3: "qzxjv wkqpz xvbqj zzkwq jxqvk pqwzx vjkqx zqwkv", -4: "123 4 x 99 12"}
    clean = {-5: "the house", -6: "the and for la maison est und das Haus ist"}
    added = spark.createDataFrame([(i, t, None, "s", 1) for i, t in (odd | clean).items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.language(spark, stages["documents"].select(*pipeline.COLUMNS).unionByName(added), sf_dir)
    assert {r.doc_id for r in kept.filter("doc_id < 0").collect()} == set(clean)
