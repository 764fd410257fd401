"""The pipeline's near-dedup against all pairs by brute force."""

import os
import random
import time

import pytest

from edictum.llm import common, graph, nearcopies, simhash


def brute_first(rows):
    sets = {i: set(nearcopies.shingle_set(t).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and 5 * both >= 4 * either:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, find(i)) for i in sets)


@pytest.mark.parametrize(("bucket", "hot"), [(64, 8), (2, 1)])
def test_edited_copies(spark, monkeypatch, bucket, hot):
    monkeypatch.setattr(nearcopies, "HOT", hot)
    rng = random.Random(3)
    names = ["w" + str(i) for i in range(3000)]
    shared = rng.choices(names, k=60)
    texts = []
    for _ in range(12):
        base = rng.choices(names, k=rng.randint(80, 400)) + shared
        for edits in (0, 1, 2, 3, 5, 8):
            edited = list(base)
            for _ in range(edits):
                edited[rng.randrange(len(edited))] = rng.choice(names)
            texts.append(" ".join(edited))
    texts += [None, " ", "one two", "One  two", texts[0].upper()]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_first(rows)
    got = sorted(tuple(r) for r in nearcopies.near_copies(frame, bucket).select("doc_id", "component_id").collect())
    assert got == want
    first = [i for i, c in want if i == c]
    assert len(first) < 40  # an exact digest within two bits keeps nearly all edited copies
    assert sorted(r.doc_id for r in nearcopies.first_of_each(frame).collect()) == first
    assert nearcopies.near_copies(frame.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (3, "x y z u v w"), (1, "x y z u v w"), (None, "a b c d e f"), (None, "only here is it said so"), (None, None), (9, "")]
    frame = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, _d0 int, _key string")
    kept = nearcopies.first_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None) == [(1, "x y z u v w"), (3, "a b c d e f"), (9, "")]
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["only here is it said so"]


def test_fingerprints_come_first(spark, monkeypatch):
    """The links of op 7's operator over five-word sets, and only those that the sets bear out."""
    rng = random.Random(11)
    names = ["w" + str(i) for i in range(3000)]
    texts = []
    for _ in range(4):
        base = rng.choices(names, k=1500)
        for _ in range(12):
            edited = list(base)
            edited[rng.randrange(1500)] = rng.choice(names)
            texts.append(" ".join(edited))
    texts += [" ".join(rng.choices(names, k=300)) for _ in range(20)] + [None, "", texts[0]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {nearcopies.set_id(x): x for x in map(nearcopies.shingle_set, texts)}
    fps = {i: nearcopies.majority(x) for i, x in sets.items()}
    near = {(a, b) for a in sets for b in sets if a < b and ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 2}
    assert sum(fps[a] != fps[b] for a, b in near) > 5
    asked = []
    monkeypatch.setattr(nearcopies, "links", lambda fps: asked.append(1) or simhash.links(fps))
    rows = nearcopies._set_ids(frame)
    got = {(min(r), max(r)) for r in map(tuple, nearcopies.fingerprint_links(frame, rows).collect())}
    assert got <= near and asked == [1]

    def groups(pairs):
        root = {i: i for i in sets}
        for _ in sets:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert groups(got) == groups(near)
    # A fingerprint that is close by chance links nothing.
    monkeypatch.setattr(nearcopies, "majority", lambda x: 5)
    kept = nearcopies.first_of_each(frame.where("doc_id >= 47")).collect()
    assert sorted(r.doc_id for r in kept) == [*range(47, 69), 70] and asked == [1, 1]


def test_tables_and_shuffle_files_go(spark, monkeypatch):
    """Only the chosen rows' ids outlast the stage, and few tables and shuffles lie there at once."""
    rng = random.Random(5)
    names = ["w" + str(i) for i in range(500)]
    shared, texts = rng.choices(names, k=60), []
    for _ in range(6):
        base = rng.choices(names, k=150) + shared
        for _ in range(4):
            base[rng.randrange(len(base))] = rng.choice(names)
            texts.append(" ".join(base))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = f"{common.shared_dir(spark).removeprefix('file:')}/{spark.sparkContext.applicationId}"
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def tables():
        return set(os.listdir(folder)) if os.path.isdir(folder) else set()

    def shuffles():
        return {n.split("_")[1] for n in (disk.getAllFiles().apply(i).getName() for i in range(disk.getAllFiles().size())) if n.startswith("shuffle_")}

    old, asked, most, real = (tables(), shuffles()), spark.conf.get(common.SHUFFLES, None), [], common.saved

    def counted(df, name):
        found = real(df, name)
        most.append(len(tables() - old[0]))
        return found

    for module in (common, graph, nearcopies, simhash):
        monkeypatch.setattr(module, "saved", counted)
    nearcopies.first_of_each(frame)
    assert sorted(n.rsplit("-", 1)[0] for n in tables() - old[0]) == ["kept-ids"]
    assert max(most) <= 10 < len(most)
    for _ in range(50):
        if len(left := shuffles() - old[1]) <= 10:
            break
        time.sleep(0.2)
    assert len(left) <= 10
    assert spark.conf.get(common.SHUFFLES, None) == asked


def test_components(spark):
    rng = random.Random(2)
    for edges in ([], [(1, 2)], [(i, i + 1) for i in range(40)], [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], [(5, 5), (7, -3), (-3, 9), (7, 9)]):
        root = {x: x for e in edges for x in e}
        for _ in root:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        got = graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
        assert sorted(map(tuple, got)) == sorted((x, r) for x, r in root.items() if x != r)
    assert graph._is_forest(spark.createDataFrame([(2, 1), (3, 1), (5, 4)], "u long, v long"))
    assert not graph._is_forest(spark.createDataFrame([(2, 1), (3, 2)], "u long, v long"))
    assert not graph._is_forest(spark.createDataFrame([(3, 1), (3, 2)], "u long, v long"))
