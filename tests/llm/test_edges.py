"""Nulls, empty tables, very long texts, clashing columns: every operator and pipeline stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from edictum.llm import decontaminate, lines, mixing, nearcopies, quality, rules, sharding, simhash, substring, suffix

CLASHES = ("id", "text_key", "key", "size", "shard", "slot", "kept", "_row", "_keep", "_copy", "_s", "n", "w", "c", "half", "law", "taken", "copies", "place", "print", "tokens", "ck", "_gone_doc_id")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(31)
    long = words(rng, 60_000)
    rows = [(i, words(rng, rng.randint(12, 40)), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(30, long, "en", "s0", 1), (31, long[: len(long) // 2] + " x", "en", "s1", 1), (32, None, None, None, None), (33, "", "en", "s1", 0), (None, words(rng, 20), "en", "s2", 1), (None, None, None, None, None)]
    rows += [rows[3], rows[3], (4, rows[5][1], "en", "s1", 1), (34, "\n" * 50, "", "", 1), (35, "a" * 100_000, "xx", "s2", 1)]
    frame = spark.createDataFrame(rows, COLUMNS).repartition(4)
    return frame.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").withColumn("kept", F.lit(1))


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "never said here by anyone at all in any of these texts"), (2, None), (3, ""), (None, "nameless item that nobody has in any text of this table")], "item_id long, text string").withColumn("n", F.lit(2))


ONE_ROW_EACH = {
    "suffix": lambda d, *_: suffix.removal_report(d),
    "lines": lambda d, *_: lines.dedup_lines(d),
    "quality": lambda d, labels, _: quality.classify(d, labels),
    "sharding": lambda d, *_: sharding.shard_rows(d),
    "sharded": lambda d, *_: sharding.sharded_documents(d),
    "rules": lambda d, *_: rules.judged(d),
    "simhash": lambda d, *_: simhash.near_duplicates(d),
    "substring": lambda d, *_: substring.removal_report(d),
    "mixing": lambda d, *_: mixing.mix(d),
    "nearcopies": lambda d, *_: nearcopies.near_copies(d),
}


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_one_row_for_each_document(docs, labels, benchmark, name):
    found = ONE_ROW_EACH[name](docs, labels, benchmark)
    assert sorted(map(str, (r.doc_id for r in found.select("doc_id").collect()))) == sorted(map(str, (r.doc_id for r in docs.select("doc_id").collect())))
    assert ONE_ROW_EACH[name](docs.limit(0), labels.limit(0), benchmark.limit(0)).count() == 0


def test_long_texts_are_compared_whole(docs):
    half = {r.doc_id: r for r in suffix.removal_report(docs).where("doc_id IN (30, 31, 35)").collect()}
    assert half[31].n_bytes - half[31].n_removed == 2 and half[30].n_removed == half[31].n_removed and half[35].n_removed == 100_000
    taken = {r.doc_id: r for r in substring.removal_report(docs).where("doc_id IN (30, 31)").collect()}
    assert taken[30].n_removed == 0 and taken[31].n_words - taken[31].n_removed in (1, 2)


def test_every_stage_on_empty_and_odd_rows(spark, docs, labels, benchmark, tmp_path):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    names = [c for c in docs.columns if c not in ("size", "shard", "slot", "law")]
    for rows, some in ((docs.select(*names), True), (docs.select(*names).limit(0), False), (docs.select(*names).where("doc_id IS NULL"), None)):
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            found = stage(spark, rows, folder)
            assert found.columns[: len(names)] == names and (number == 4) == (len(found.columns) > len(names))
            count = found.count()
            assert (count > 0) if some else count == 0 if some is False else count <= 2 * rows.count()


def test_decontamination_of_odd_rows(docs, benchmark):
    assert decontaminate.leaks(docs, benchmark).count() == 0
    kept = decontaminate.clean_documents(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_run_leaves_only_the_stages_tables(spark, docs, labels, benchmark, tmp_path):
    import glob

    folder = str(tmp_path)
    for name, rows in (("documents", docs.select("doc_id", "text", "lang", "source", "n_chars")), ("labels", labels), ("benchmark", benchmark)):
        rows.write.parquet(f"{folder}/{name}.parquet")
    shared = f"{spark.conf.get('spark.checkpoint.dir')}/{spark.sparkContext.applicationId}"
    before = set(glob.glob(f"{shared}/*"))
    found = corpus_pipeline.run(spark, folder)
    assert found.count() > 20 and "text" in found.columns
    assert len(set(glob.glob(f"{shared}/*")) - before) == len(corpus_pipeline.STAGES)
