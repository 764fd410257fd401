"""Ops 1, 3, 7 and 9 against brute force on fixtures with nulls, copies, ties and edge texts."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash

from edictum.llm import lines, simhash, substring, suffix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard int, kept boolean, id int, text_key string"


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefgéñ", k=rng.randint(1, 7))) for _ in range(n))


def corpus():
    rng = random.Random(4)
    shared = [sentence(rng, n) for n in (60, 120, 49, 50)]
    texts = [sentence(rng, rng.randint(1, 300)) for _ in range(40)]
    for i in range(12):
        texts[i] = texts[i] + "\n" + shared[i % 4] + " " + texts[i + 12]
    texts += [texts[3], texts[3], texts[20], None, "", " \n\t", "x", "ab " * 400, "ab " * 400 + "z", "a" * 1500, texts[30] + " tail", "head " + texts[31]]
    near = texts[33].split()
    for i in range(12):
        near2 = list(near)
        near2[(i * 7) % len(near2)] = f"w{i}"
        texts.append(" ".join(near2))
    texts.append("\x1c".join(["odd"] * 60))  # \x1c is no word separator
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, shared[1]), (None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, 2, 3, True, 5, "clash") for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_suffix_array_orders_all_suffixes():
    rng = random.Random(1)
    for _ in range(60):
        raw = bytes(rng.choice(b"ab c") for _ in range(rng.randint(1, 200)))
        assert suffix.suffix_array(raw, 10**6).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def brute_bytes(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    starts = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(rows, raws, strict=True):
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - length + 1):
            if starts[r[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(r, gone, strict=False) if not g)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [20_000, 1])  # bytes: the second sends every group past the blocks
def test_repeated_bytes(docs, most):
    found = suffix.removal_report(docs, most_in_group=most).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, found), key=str) == brute_bytes(corpus(), 400)


def test_groups_beyond_one_block(spark, monkeypatch):
    """Variants of one passage share least hashes: their group outgrows a block, and with the
    lower limit the way of large groups is taken for it and not for the others."""
    rng = random.Random(13)
    passage = sentence(rng, 150)
    rows = []
    for i in range(150):
        at = rng.randrange(len(passage) - 40)
        rows.append((i, sentence(rng, 5) + " " + passage[:at] + f"<{i % 40}>" + passage[at:]))
    rows.append((150, sentence(rng, 20_000)))
    rows.append((151, rows[150][1][3000:9000] + " " + sentence(rng, 10)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(suffix, "BLOCK", 1 << 12)
    want = brute_bytes(rows, 400)
    for most in (suffix.MOST_IN_GROUP, 20_000):
        found = suffix.removal_report(frame, most_in_group=most).collect()
        assert sorted(map(tuple, found), key=str) == want


def test_order_with_zero_bytes():
    rng = random.Random(5)
    for _ in range(40):
        raw = bytes(rng.choice(b"\0\0a") for _ in range(rng.randint(1, 120)))
        assert suffix.suffix_array(raw, 10**6).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def brute_words(rows, window):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_repeated_passages(docs, spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups span batches
    try:
        found = substring.removal_report(docs).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, found), key=str) == brute_words(corpus(), 50)


def test_texts_of_one_doc_id_lose_their_own_words(spark):
    rng = random.Random(17)
    a, b = sentence(rng, 90), sentence(rng, 70)
    rows = [(1, a + " " + b), (2, sentence(rng, 30) + " " + a), (2, b + " " + sentence(rng, 200)), (2, sentence(rng, 3)), (3, a + " " + b), (2, "x " * 60), (4, "x " * 30_000)]
    found = substring.removal_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, found), key=str) == brute_words(rows, 50)


def test_every_shift_meets_the_cover():
    cover, v = set(substring.COVER), substring.PERIOD
    assert all(any((i + d) % v in cover and (j + d) % v in cover for d in range(v)) for i in range(v) for j in range(v))


def test_golay_keys_meet_within_two_bits():
    tables = simhash.golay_tables()
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 60)
    for i in range(23):
        for j in range(i, 23):
            pairs = [simhash.codeword_indices(v, tables) for v in (x, x ^ (1 << i | 1 << j))]
            for k in range(len(x)):
                a, b = ({*index[k][counts[k]].tolist()} for index, counts in pairs)
                assert a & b


def brute_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_fingerprints(docs):
    rows = corpus()
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    want = sorted(((d, f"{prints[i]:016x}", least.get(top(i))) for i, (d, _) in enumerate(rows)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == want


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 0])
def test_links_of_dense_groups(spark, bucket):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    from edictum.llm.graph import components

    found = dict(components(simhash.links(frame, bucket=bucket)).collect())
    root = {f: f for f in signed}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in signed:
        for b in signed:
            if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert {f: found.get(f, f) for f in signed} == {f: top(f) for f in signed}


def test_repeated_lines(spark):
    rng = random.Random(3)
    a, b = ([sentence(rng, 4) for _ in range(6)] for _ in range(2))
    rows = [(1, "\n".join(a)), (2, "\n".join(["new", *a[:4], "", "other"])), (3, "\n".join(a[:3] + b)), (4, "\n".join(b + b)), (5, None), (6, ""), (7, "\n".join(b)), (None, "\n".join(a[1:]))]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_lines int")
    runs, order = {}, sorted(set(rows), key=lambda r: (r[0] is not None, r[0]))
    split = {r: [x for x in (r[1] or "").split("\n") if WORD.search(x)] for r in order}
    for r in order:
        for k in range(len(split[r]) - 3):
            place = (r[0] is not None, r[0] or 0, 0, k)
            key = tuple(split[r][k : k + 4])
            runs[key] = min(runs.get(key, place), place)
    want = []
    for r in rows:
        gone = set()
        for k in range(len(split[r]) - 3):
            if runs[tuple(split[r][k : k + 4])] < (r[0] is not None, r[0] or 0, 0, k):
                gone |= set(range(k, k + 4))
        kept, n = [], 0
        for x in (r[1] or "").split("\n"):
            if not WORD.search(x):
                kept.append(x)
                continue
            if n not in gone:
                kept.append(x)
            n += 1
        want.append((r[0], len(split[r]), len(gone), "\n".join(kept) if gone else r[1]))
    assert sorted(map(tuple, lines.dedup_lines(frame).collect()), key=str) == sorted(want, key=str)
    assert any(w[2] for w in want)


def test_lines_by_words_and_whole_documents(spark):
    """Single long lines, blocks of short ones, short documents as a whole, blanks in between."""
    rng = random.Random(14)
    pool = [sentence(rng, rng.choice((1, 2, 3, 8, 25))) for _ in range(12)] + ["", "  "]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(150)] + [(7, "other\ntext"), (None, pool[3])]
    frame = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, place int, print string").repartition(5)
    text_key = {r.text: r.k for r in frame.selectExpr("text", "xxhash64(text) AS k").collect()}
    places, windows = {}, {}
    for r in rows:
        lines_ = [(n, x) for n, x in enumerate(r[1].split("\n")) if WORD.search(x)]
        mine = windows[r] = []
        for i in range(len(lines_)):
            for j in range(i, len(lines_)):
                if j - i == 3 or sum(len(WORD.findall(x)) for _, x in lines_[i : j + 1]) >= 20:
                    mine.append(lines_[i : j + 1])
                    break
        if not mine and lines_:
            mine.append(lines_)
        for w in mine:
            key, place = tuple(x for _, x in w), (r[0] is not None, r[0] or 0, text_key[r[1]], w[0][0])
            places[key] = min(places.get(key, place), place)
    want = []
    for r in rows:
        gone = set()
        for w in windows[r]:
            if places[tuple(x for _, x in w)] < (r[0] is not None, r[0] or 0, text_key[r[1]], w[0][0]):
                gone |= {n for n, _ in w}
        total = sum(bool(WORD.search(x)) for x in r[1].split("\n"))
        want.append((r[0], total, len(gone), "\n".join(x for n, x in enumerate(r[1].split("\n")) if n not in gone)))
    assert sorted(map(tuple, lines.dedup_lines(frame).collect()), key=str) == sorted(want, key=str)


def test_long_documents_take_time_in_proportion(spark):
    def seconds(n):
        text = "\n".join(f"line {i % (n // 2)} of many" for i in range(n))
        frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.monotonic()
        assert lines.dedup_lines(frame).first().n_removed == n - n // 2
        return time.monotonic() - start

    seconds(1000)
    assert seconds(60_000) < 8 * seconds(15_000)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    for op in (suffix.removal_report, substring.removal_report, simhash.near_duplicates, lines.dedup_lines):
        assert op(none).count() == 0
