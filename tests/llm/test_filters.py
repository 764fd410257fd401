"""Ops 4, 6 and 8: held-out accuracy, features against brute force, leaks by hand."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from edictum.llm import decontaminate, quality, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(600):
        kind = rng.random()
        text = words(rng, rng.randint(20, 120))
        if kind < 0.15:
            text = " | ".join(text.split())
        elif kind < 0.3:
            cut = text.split()
            cut.insert(rng.randrange(len(cut)), rng.choice(("vilewordx", "vilewordy")))
            text = " ".join(cut)
        rows.append((i, text, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, 1.0))
        marks.append((i, int(kind >= 0.15), int(0.15 <= kind < 0.3)))
    rows += [(600, None, "en", "s1", 1.0), (601, "", None, None, 1.0), (None, words(rng, 30), "en", "s1", 1.0), (5, rows[5][1], "en", "s1", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, p_bad double")
    return docs, marks


def test_classifier_on_held_out_rows(spark, labelled):
    docs, marks = labelled
    labels = spark.createDataFrame([m for m in marks if m[0] % 2], "doc_id long, quality int, toxic int").withColumn("kept", F.lit(1))
    got = {r.doc_id: r.kept for r in quality.classify(docs, labels).collect()}
    assert len(got) == 603
    held = [(got[i], q == 1 and t == 0) for i, q, t in marks if i % 2 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert got[600] is not None and quality.kept_documents(docs, labels).columns == docs.columns


def test_classifier_without_labels_keeps_all(spark, labelled):
    docs, _ = labelled
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs.limit(20), none).where("NOT kept").count() == 0
    assert quality.classify(docs.limit(0), none).count() == 0


def test_sparse_sites_stay_near_their_parents(spark):
    rows = [("big", "en", 3.0, -3.0)] * 400 + [("good", "en", -3.0, -3.0)] * 400 + [("tiny", "en", 3.0, -3.0)]
    frame = spark.createDataFrame(rows, "source string, lang string, bad double, toxic double")
    sites, overall = quality.site_rates(frame)
    rate = {r._s: r.bad_site for r in sites.collect()}
    base = overall.first().bad_global
    assert abs(rate["tiny"] - base) < abs(rate["big"] - base) and rate["good"] < base < rate["big"]


def test_verdicts_from_the_evidence(spark, labelled):
    """Hierarchical posteriors and verdicts recomputed from the documents' log odds."""
    docs, marks = labelled
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rows = quality.evidence(docs, labels, 8000, 3).toPandas()
    found = quality.classify(docs, labels).toPandas()
    key = ["doc_id", "text_key", "source", "lang"]
    for head in ("bad", "toxic"):
        rows[f"p_{head}"] = 1 / (1 + np.exp(-rows[head]))

    def shrunk(sums, parent):
        """Posterior rates of sites (n, total) towards ``parent``, and the prior's strength."""
        n, rate = sums["count"], sums["sum"] / sums["count"]
        between = (n * (rate - parent) ** 2).sum() / n.sum()
        within = (parent * (1 - parent)).sum() / n.sum()
        mean = (n * parent * (1 - parent)).sum() / n.sum()
        m = max(5.0, min(1e4, mean / max(between - within, mean * 1e-4) - 1))
        return (sums["sum"] + m * parent) / (n + m), m

    odds = {}
    for head in ("bad", "toxic"):
        p = rows[f"p_{head}"]
        overall = (p.sum() + 0.5) / (len(p) + 1)
        hosts = p.groupby(rows.source.fillna("-")).agg(["count", "sum"])
        host_rate, _ = shrunk(hosts, hosts["sum"] * 0 + overall)
        paths = p.groupby([rows.source.fillna("-"), rows.lang.fillna("-")]).agg(["count", "sum"])
        parent = paths["sum"] * 0 + [host_rate[s] for s, _ in paths.index]
        _, m = shrunk(paths, parent)
        at = list(zip(rows.source.fillna("-"), rows.lang.fillna("-"), strict=True))
        rate = np.array([(paths["sum"][k] - own + m * parent[k]) / (paths["count"][k] - 1 + m) for k, own in zip(at, p, strict=True)])
        odds[head] = rows[head] + np.log(rate / (1 - rate)) - np.log(overall / (1 - overall))
    rows["kept"] = (odds["bad"] < 0) & (odds["toxic"] < 0)
    for head in odds:
        rows[f"p_{head}"] = 1 / (1 + np.exp(-odds[head]))
    a, b = (x.fillna({"doc_id": -1, "source": "-", "lang": "-"}).sort_values(key).reset_index(drop=True) for x in (rows, found))
    assert (a[key] == b[key]).all().all() and (a.kept == b.kept).all() and 0 < a.kept.sum() < len(a)
    assert np.allclose(a.p_bad, b.p_bad) and np.allclose(a.p_toxic, b.p_toxic)


def test_rows_of_one_id_are_judged_by_their_texts(spark, labelled):
    docs, marks = labelled
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rng = random.Random(23)
    bad, good = " | ".join(words(rng, 60).split()), words(rng, 60)
    more = spark.createDataFrame([(9000, bad, "en", "s1", 1.0), (9000, good, "en", "s1", 1.0), (None, bad, "en", "s1", 1.0), (None, good, "en", "s1", 1.0), (9001, good * 300, "en", "s1", 1.0)], docs.schema)
    kept = quality.kept_documents(docs.union(more).withColumn("_gone_doc_id", F.lit(1)).withColumn("bad", F.lit("x")), labels)
    assert sorted(((r.doc_id, r.text) for r in kept.where("doc_id >= 9000 OR doc_id IS NULL").collect() if r.text in (bad, good, good * 300)), key=str) == sorted([(9000, good), (9001, good * 300), (None, good)], key=str)


def brute_features(text):
    text = text or ""
    ws = WORD.findall(text)
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_base_features():
    rng = random.Random(6)
    texts = [None, "", " \n ", "a b c d e a b c d e", "x\nx\n x\n\n\n", "é#*$%&|<>\x1cz \x0b\x0c", "q " * 9] + [words(rng, 40, "ab") + "\n" + words(rng, 9, "ab") for _ in range(20)]
    for t in texts:
        assert rules.base_features(t) == brute_features(t), t


def test_model_probabilities_sum_to_one():
    grams = np.concatenate([rules.text_grams(words(random.Random(i), 50), 3) for i in range(5)])
    g, n = np.unique(grams, return_counts=True)
    model = rules.estimate(g, n, 3)
    for context in (g[0] >> 8, g[-1] >> 8, (ord("z") << 8) | ord("z")):
        p = np.exp(rules.scores(model, (int(context) << 8) | np.arange(256), 3))
        assert math.isclose(p.sum(), 1, abs_tol=1e-6)


def test_bands_and_batches_of_languages(spark):
    rng = random.Random(7)
    rows = [(i, words(rng, rng.randint(30, 90)), ("en", "xx", None)[i % 3], "s") for i in range(300)]
    noise = "".join(chr(rng.randrange(33, 120)) for _ in range(400))
    rows += [(300, " ".join(noise[i : i + 6] for i in range(0, 400, 6)), "en", "s"), (301, None, "en", "s"), (302, "few words", "", "s"), (303, "a b c d e f " * 20, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    one = {r.doc_id: r for r in rules.judged(docs, reach=2.0).collect()}
    assert len(one) == 304 and not one[300].kept and not one[300].base_failed
    assert one[301].base_failed and one[302].base_failed and one[303].base_failed and not one[303].kept
    assert all(one[i].kept for i in range(300))
    many = {r.doc_id: r for r in rules.judged(docs, reach=2.0, most_entries=1).collect()}
    assert {i: round(r.log_ppl or 0, 9) for i, r in many.items()} == {i: round(r.log_ppl or 0, 9) for i, r in one.items()}
    counted = {(r.lang, r.gram): r.n for r in rules.gram_counts(docs).groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()}
    whole = {}
    for _, t, lang, _ in rows:
        for gram in rules.text_grams(t, 3).tolist():
            whole[(lang, gram)] = whole.get((lang, gram), 0) + 1
    assert counted == whole
    assert rules.judged(docs.limit(0)).count() == 0


def brute_model(texts, order=3):
    """Probability of a byte after a context, from the textbook formulas, as a function."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        raw = b"\n" * (order - 1) + t.encode()
        if t:
            counts[order].update(raw[i : i + order] for i in range(len(raw) - order + 1))
    for k in range(order - 1, 0, -1):  # in how many contexts
        counts[k].update(g[1:] for g in counts[k + 1])
    cuts = [None] + [rules.discounts(np.array(list(c.values()))) for c in counts[1:]]
    follows = [defaultdict(list) for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, n in counts[k].items():
            follows[k][g[:-1]].append(n)

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / 256
        seen = follows[k].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        n = counts[k][gram]
        taken = sum(cuts[k][min(c, 3) - 1] for c in seen)
        own = max(n - cuts[k][min(n, 3) - 1], 0) if n else 0
        return own / sum(seen) + taken / sum(seen) * p(gram[1:])

    return p


def test_verdicts_by_brute_force_with_production_parameters(spark):
    """Held-out perplexity, quartile bands and verdicts from the definitions; noise, salad of
    symbols and repetition go, prose stays."""
    rng = random.Random(19)
    stems = ["".join(rng.choices("aeioustnrl", k=rng.randint(2, 5))) for _ in range(60)]

    def prose():
        return " ".join(rng.choice(stems) for _ in range(rng.randint(40, 120)))

    def noise():
        return " ".join("".join(chr(rng.randrange(33, 126)) for _ in range(6)) for _ in range(50))

    rows = [(i, prose(), "en" if i % 4 else "de") for i in range(160)]
    rows += [(200 + i, noise(), "en") for i in range(4)] + [(210, " ".join(f"aaa{c}" for c in "abcdefghij" * 4), "en"), (220, prose(), "solo"), (221, "", "en"), (222, None, None), (223, prose() * 200, "en")]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, lang string, half int, log_ppl double").repartition(3)
    half = {r.doc_id: r.h for r in docs.select("doc_id", rules.half_of(F.col("text")).alias("h")).collect()}
    got = {r.doc_id: r for r in rules.judged(docs).collect()}
    assert len(got) == len(rows)
    score = {}
    for lang in ("en", "de", "solo", None):
        for h in (0, 1):
            p = brute_model([t or "" for d, t, x in rows if x == lang and half[d] == h])
            other = any(t for d, t, x in rows if x == lang and half[d] == h)
            for d, t, x in rows:
                if x == lang and half[d] == 1 - h and t and other:
                    raw = b"\n\n" + t.encode()
                    score[d] = -sum(math.log(p(raw[i : i + 3])) for i in range(len(raw) - 2)) / len(t.encode())
    for d, t, lang in rows:
        r = got[d]
        base = brute_features(t)
        assert r.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        if d not in score:
            assert r.log_ppl is None and r.kept == (not r.base_failed)
            continue
        assert math.isclose(r.log_ppl, score[d], rel_tol=1e-4)
        same = sorted(score[e] for e, _, x in rows if x == lang and e in score)
        low, high = (same[math.ceil(q * len(same)) - 1] for q in (0.25, 0.75))
        margin = 3.0 * (high - low) + 2.0 / math.sqrt(len(t.encode()))
        assert math.isclose(r.lower_band, low - margin, rel_tol=1e-4) and math.isclose(r.upper_band, high + margin, rel_tol=1e-4)
        assert r.kept == (not r.base_failed and low - margin <= score[d] <= high + margin)
    assert not any(got[200 + i].kept or got[200 + i].base_failed for i in range(4)) and not got[210].kept
    assert all(got[i].kept for i in range(160))


QUESTION = "A train leaves Paris at 12 hours and covers 300 km before it meets Anna who walks 5 km from the other station"


def test_leaks(spark):
    rng = random.Random(8)
    changed = QUESTION.replace("Paris", "Rome").replace("12", "7").replace("300", "1,250").replace("Anna", "Bruno").replace("5 km", "9 km")
    twisted = "A train leaves X " + words(rng, 3) + " at 12 hours"
    docs = [
        (1, words(rng, 30) + " " + QUESTION + " " + words(rng, 20)),
        (2, words(rng, 10) + ". " + changed + ". " + words(rng, 5)),
        (3, words(rng, 50)), (4, None), (5, ""), (6, twisted), (1, words(rng, 10)), (None, QUESTION), (7, QUESTION), (7, QUESTION),
    ]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int")
    items = [(10, QUESTION), (11, None), (12, "too short"), (9, QUESTION.replace("Paris", "Oslo"))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(frame, bench).collect()}
    # Items 9 and 10 are one class: its least stands for it unless a member is there verbatim.
    assert set(found) == {(1, 10), (2, 9), (7, 10), (None, 10)}
    assert found[(2, 9)] == "reparameterised"
    kept = sorted((r.doc_id for r in decontaminate.clean_documents(frame, bench).collect()), key=str)
    assert kept == [1, 3, 4, 5, 6]
    assert decontaminate.leaks(frame.limit(0), bench).count() == 0
    assert decontaminate.clean_documents(frame, bench.limit(0)).count() == len(docs)


def test_inconsistent_slots_are_no_leak(spark):
    item = "He paid 5 then 5 then 7 then 9 then 11 then 13"
    docs = [(1, item.replace("5", "8").replace("13", "40")), (2, "He paid 1 then 2 then 3 then 4 then 5 then 6")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    # Document 2 gives one value of the item (5) two values of its own.
    assert [r.doc_id for r in decontaminate.leaks(frame, bench).collect()] == [1]
