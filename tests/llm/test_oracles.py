"""Queries with SQL equivalents against them, on the smallest tables and on random texts."""

import glob
import os
import random

import duckdb
import pytest

from edictum.llm import decontaminate, lines, queries, substring, suffix

FOLDER = "/root/testdata/sf0.001"


def rows_of(found, columns):
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(columns)
    return sorted(tuple(map(str, (r[names.index(c)] for c in columns))) for r in found.fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")
@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    frame = queries.QUERIES[name](spark, FOLDER)
    assert sorted(tuple(map(str, r)) for r in frame.collect()) == rows_of(c.execute(queries.ORACLES[name]), frame.columns)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_sql_on_random_texts(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(("Anna", "Bob", "12", "5 km", "walks", "to", "the", "mill", "and", "eats", "3%", "é.")) for _ in range(rng.choice((4, 30, 90)))) for _ in range(12)]
    docs = [(i, rng.choice(("\n", " ")).join(rng.choices(pool, k=rng.randint(0, 6)))) for i in range(60)] + [(60, None), (61, "")]
    items = [(i, rng.choice(pool)) for i in range(8)] + [(8, "Anna walks"), (9, None)]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    c.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for made, sql in (
        (suffix.removal_report(frame), suffix.ORACLE),
        (lines.dedup_lines(frame), lines.ORACLE),
        (substring.removal_report(frame), substring.ORACLE),
        (decontaminate.leaks(frame, bench).drop("text_key"), decontaminate.ORACLE),
    ):
        assert sorted(tuple(map(str, r)) for r in made.collect()) == rows_of(c.execute(sql), made.columns)
