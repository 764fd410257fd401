"""Ops 2, 5 and 10 and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from edictum.llm import chat, mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_preference_pairs(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 2, "user", None),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (5, 0, None, "alone"), (4, 1, "b", "x"), (4, 1, "a", "y"), (None, 0, "user", "lost"),
        *[(2**60 + k, 0, "user", f"far{k}") for k in range(3)],
    ]
    frame = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, prompt int")
    got = {r.pair_id: r for r in chat.preference_pairs(frame).collect()}
    assert set(got) == {0, 1, 2, 2**59, 2**59 + 1}
    assert got[2**59].chosen.count("far0") == 1 and got[2**59].rejected.count("far1") == 1 and got[2**59 + 1].rejected is None
    assert got[0].prompt == "<|user|>\nhi<|end|>\n" and got[0].chosen == "<|assistant|>\ngood<|end|>\n"
    assert got[0].rejected_mask == f"1:{len('<|assistant|>') + 1 + 3 + 8},0:{len('<|user|>') + 1 + 8}"
    assert got[1].n_prompt_turns == 1 and got[1].chosen == "" and got[1].rejected == ""
    assert got[2].n_prompt_turns == 0 and got[2].chosen.startswith("<|a|>") and got[2].rejected == "<||>\nalone<|end|>\n"
    assert chat.preference_pairs(frame.limit(0)).count() == 0
    for r in got.values():
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert text is None or sum(int(m.split(":")[1]) for m in mask.split(",") if m) == len(text)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 40), "en", "hot" if rng.random() < 0.5 else rng.choice(("b", "c", "é", None))) for i in range(2000)]
    rows += [(2000, None, "en", "b"), (2001, "", "en", "solo"), (7, rows[7][1], "en", rows[7][3]), (None, "x y", "en", "b"), (2002, "long " * 5000, "en", "c")]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, shard int").repartition(6)


def test_shards_match_the_mixture(docs):
    rows = sharding.shard_rows(docs, carry=("source",)).collect()
    assert len(rows) == 2005
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    counts = [len(v) for v in shards.values()]
    assert len(shards) == 40 and max(counts) - min(counts) <= 1
    overall = Counter(r.source for r in rows)
    for members in shards.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        here = Counter(r.source for r in members)
        assert all(abs(here[s] - n / 40) <= 2 for s, n in overall.items())
    assert {r.law for r in rows} == {"rows"} and all(r.grown_shard is None for r in rows)
    assert next(r for r in rows if r.doc_id == 2000).size == 16
    again = sharding.shard_rows(docs.repartition(3)).collect()
    key = lambda rs: sorted((str(r.doc_id), r.shard, r.slot) for r in rs if r.doc_id != 7)
    assert key(rows) == key(again)
    assert sharding.shard_rows(docs.limit(0)).count() == 0
    few = sharding.shard_rows(docs.limit(3)).collect()
    assert [r.slot for r in few] == [0, 0, 0]


def test_places_by_brute_force(spark, docs):
    """Every row's shard and slot from the definition; equal texts; sources of one row."""
    from zlib import crc32

    rng = random.Random(21)
    rows = [(i, rng.choice((None, "", "same", "é" * i)), rng.choice(("a", "b", None, f"only{i}"))) for i in range(300)]
    frame = spark.createDataFrame([(*r, 5, "x", 1) for r in rows], "doc_id long, text string, source string, slot int, law string, _n int")
    keys = {r.doc_id: r.k for r in frame.selectExpr("doc_id", "xxhash64(7, doc_id, source) AS k").collect()}
    by_source = defaultdict(list)
    for d, t, s in rows:
        by_source[s].append((keys[d] % 2**64, d))
    order = []
    for s, members in by_source.items():
        for r, (_, d) in enumerate(sorted(members), 1):
            order.append(((2 * r - 1) / (2 * len(members)), (s is not None, s or ""), r, d))
    place = {x[3]: i for i, x in enumerate(sorted(order))}
    found = {r.doc_id: r for r in sharding.shard_rows(frame, shards=7).collect()}
    for d, t, _ in rows:
        r, shard = found[d], place[d] * 7 // 300
        assert (r.size, r.text_crc32) == (16 + len((t or "").encode()), crc32((t or "").encode()))
        assert (r.shard, r.slot) == (shard, place[d] - -(-shard * 300 // 7))
    whole = sharding.sharded_documents(frame.union(frame.limit(3)), shards=7)
    assert whole.columns == ["doc_id", "text", "source", "_n", "size", "text_crc32", "law", "shard", "slot"]
    got = whole.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in frame.union(frame.limit(3)).collect())
    assert len({(r.shard, r.slot) for r in got}) == 303
    assert sharding.sharded_documents(frame.limit(0)).count() == 0


def test_mixed_rows_go_to_the_shards_of_their_blocks(spark, docs):
    rows = mixing.mix(docs).collect()
    want = Counter()
    for r in rows:
        want.update((r.doc_id, s) for s in (r.first_shard, r.second_shard) if s is not None)
    named = docs.withColumn("_shard", F.lit("clash")).withColumn("_d0", F.lit(3))
    mixed = mixing.mixed_documents(named)
    assert mixed.columns == named.columns
    placed = mixing.mixed_documents(named, shard_column="to").withColumn("part", F.spark_partition_id()).collect()
    assert Counter((r.doc_id, r.to) for r in placed) == want
    assert len({s for _, s in want}) == 16
    parts = defaultdict(list)
    for r in placed:
        parts[r.part].append(r.to)
    assert all(p == sorted(p) for p in parts.values())


def test_running_sums(spark):
    from edictum.llm.common import running

    rng = random.Random(4)
    rows = [(rng.randint(0, 50), rng.randint(0, 9), i) for i in range(500)]
    got = running(spark.createDataFrame(rows, "a int, b int, i int").repartition(7), [F.col("a"), F.col("i")], ("b",)).collect()
    want, total = {}, 0
    for n, (_, b, i) in enumerate(sorted(rows, key=lambda r: (r[0], r[2]))):
        want[i] = (n, total)
        total += b
    assert {r.i: (r._before, r._b_before) for r in got} == want


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    left = goal
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        for s in over or open_:
            target[s] = 2 * sizes[s] if over else level * weights[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    return target


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == 2005
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.mix_source] += r.size
        taken[r.mix_source] += r.taken
        target[r.mix_source] = r.target
        assert r.taken in (0, r.size, 2 * r.size) and (r.first_shard is None) == (r.copies < 1) and (r.second_shard is None) == (r.copies < 2)
    want = brute_targets(sizes)
    longest = {s: max(r.size for r in rows if r.mix_source == s) for s in sizes}
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= longest[s]
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    copies = Counter(r.doc_id for r in mixing.mixed_documents(docs).select("doc_id").collect())
    assert copies == Counter({k: v for k, v in Counter({}).items()}) + sum((Counter({r.doc_id: r.copies}) for r in rows), Counter())
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_tree_deals_exact_quotas(spark):
    goals = spark.createDataFrame([("a", 1, 10, 600.0), ("b", 2, 10, 300.0), ("c", 3, 10, 100.0), ("d", 4, 0, 0.0)], "source string, sid int, source_size long, target double")
    dealt = mixing.split_tree(goals, 8, 16, 3).collect()
    assert Counter(r.shard for r in dealt) == dict.fromkeys(range(8), 16)
    assert Counter(r.sid for r in dealt) == {1: 77, 2: 38, 3: 13}
    assert len({(r.sid, r.block) for r in dealt}) == len(dealt)


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    item = " ".join("".join(rng.choices("klmnop", k=4)) for _ in range(30))

    def text(n=60):
        return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))

    rows, marks = [], []
    for i in range(300):
        bad = i % 6 == 0
        t = " | ".join(text().split()) if bad else text()
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        marks.append((i, int(not bad), 0))
    rows += [(300, rows[1][1], "en", "s1", 9), (301, text() + " " + item, "en", "s1", 9), (302, None, "en", "s1", 0)]
    for name, data, schema in (
        ("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", marks, "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, item)], "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    kept = {}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if i < 4:
            assert docs.columns == columns
    good, single, clean, mixed, placed = kept.values()
    assert not [i for i in good if i is not None and i < 300 and i % 6 == 0] and len([i for i in good if i < 300]) >= 248
    assert 300 not in single and 1 in single
    assert 301 not in clean and set(single) - set(clean) == {301}
    assert max(Counter(mixed).values()) == 2 and set(mixed) <= set(clean)
    assert sorted(placed) == sorted(mixed)
    sizes = docs.agg(F.min("slot"), F.countDistinct("shard")).first()
    assert tuple(sizes) == (0, 40)
