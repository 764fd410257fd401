"""Op 8 against brute force: every diagonal of every document and item."""

import random
from collections import defaultdict

import pytest
import regex

from edictum.llm import decontaminate as D

NAMED = r"\p{Lu}\p{Ll}[\p{L}\p{M}\p{N}]*"
TOKENS = regex.compile(NAMED + "(?: " + NAMED + r"){0,3}|\p{L}[\p{L}\p{M}\p{N}]*|[0-9]+(?:[.,][0-9]+){0,8}|\p{N}|[%°€£$]")


def brute_tokens(text):
    """(type or "", lower-cased value) of each token."""
    raw = []
    for t in TOKENS.findall(text or ""):
        named = len(t) > 1 and t[0].lower() != t[0] and t[1].upper() != t[1]
        raw.append(("#" if "0" <= t[0] <= "9" else "N" if named else "", t.lower()))
    out = []
    for i, (kind, t) in enumerate(raw):
        unit = t in D.UNITS and kind != "#"
        if unit and i and raw[i - 1][0] == "#":
            continue
        if kind == "#" and i + 1 < len(raw) and raw[i + 1][0] != "#" and raw[i + 1][1] in D.UNITS:
            out.append(("Q", t + " " + raw[i + 1][1]))
        else:
            out.append((kind, t))
    return out


def shape(t):
    return t[0] or t[1]


def inner(tokens):
    """A run's tokens with names at its ends cut to the word inside."""
    out = list(tokens)
    for at, word in ((len(out) - 1, 0), (0, -1)):
        if out[at][0] == "N":
            out[at] = ("N", tokens[at][1].split(" ")[word])
    return out


def brute_leaks(docs, items, least=13):
    """{(doc_id, text, item_id): (kind, n_tokens, n_slots)}"""
    classes = defaultdict(list)
    for item_id, text in items:
        t = brute_tokens(text)
        if t:
            key = tuple(shape(x) for x in t), tuple(t.index(x) if x[0] else -1 for x in t)
            classes[key].append((item_id, t))
    found = {}
    for doc_id, text in docs:
        mine = brute_tokens(text)
        for members in classes.values():
            name, n = min(m[0] for m in members), len(members[0][1])
            runs = []
            for diagonal in range(-n, len(mine)):
                run = 0
                for i in range(n + 1):
                    if i < n and 0 <= i + diagonal < len(mine) and shape(mine[i + diagonal]) == shape(members[0][1][i]):
                        run += 1
                        continue
                    if run and run >= min(n, least):
                        runs.append((i - run, run, diagonal))
                    run = 0
            rows = []
            for at, size, diagonal in runs:
                here = mine[at + diagonal : at + diagonal + size]
                slots = sum(bool(t[0]) for t in here)
                for item_id, t in members:
                    if inner(here) == inner(t[at : at + size]):
                        rows.append((item_id, "verbatim", size, slots, at))
                theirs = members[0][1][at : at + size]
                pairs = {(a, b) for k, (a, b) in enumerate(zip(theirs, here, strict=True)) if a[0] and not (a[0] == "N" and k in (0, size - 1))}
                fits = len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})
                if n >= 8 and (fits and 3 * (size - slots) >= size or size - slots >= least):
                    rows.append((name, "reparameterised", size, slots, at))
            if any(r[1] == "verbatim" for r in rows):
                rows = [r for r in rows if r[1] == "verbatim"]
            for r in rows:
                key, value = (doc_id, text, r[0]), (r[1], r[2], -r[4], -r[3])
                found[key] = max(found.get(key, value), value)
    return {(d, i, k, n, -s) for (d, _, i), (k, n, _, s) in found.items()}


def spark_leaks(spark, docs, items):
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, n int, ck string, size int")
    bench = spark.createDataFrame([(*i, 1, 3) for i in items], "item_id long, text string, at int, n int")
    return {(r.doc_id, r.item_id, r.kind, r.n_tokens, r.n_slots) for r in D.leaks(frame, bench).collect()}


def test_random_documents(spark):
    rng = random.Random(12)
    names = ["Anna", "Bob Lee", "Paris", "Rosa Maria Paz", "Élodie", "The", "When Tom"]
    things = ["apples", "stones", "green", "runs", "then", "buys", "to", "and", "with"]

    def part():
        x = rng.random()
        if x < 0.15:
            return rng.choice(names)
        if x < 0.3:
            return str(rng.randint(1, 4)) + rng.choice(("", "", " km", " hours", "%", ",5"))
        return rng.choice(things) + rng.choice(("", "", "", ".", ",", "\n"))

    def made(n):
        return " ".join(part() for _ in range(n))

    items = [(i, made(rng.randint(1, 30))) for i in range(24)]
    for i in range(24, 48):
        changed = items[i - 24][1]
        for a, b in rng.choice(((("Anna", "Paris"),), (("1", "3"),), (("2", "4"), ("apples", "apples")))):
            changed = changed.replace(a, b)
        items.append((i, changed))
    docs = [(i, made(rng.randint(0, 60))) for i in range(20)]
    for i in range(20, 90):
        item = rng.choice(items)[1]
        for a, b in rng.sample((("1", "7"), ("Anna", "Bruno Kant"), ("Paris", "Rome"), ("3", "1"), ("km", "miles"), ("2", "2")), 2):
            item = item.replace(a, b) if rng.random() < 0.7 else item.replace(a, b, 1)
        cut = item.split(" ")
        if rng.random() < 0.4:
            cut = cut[rng.randrange(3) :]
        docs.append((i, made(rng.randint(0, 10)) + rng.choice((". ", " ", "\n")) + " ".join(cut) + " " + made(rng.randint(0, 10))))
    want = brute_leaks(docs, items)
    assert spark_leaks(spark, docs, items) == want
    assert {w[2] for w in want} == {"verbatim", "reparameterised"}


PAID = "He paid {} then {} then {} then {} then {} then {}"


def test_each_member_of_a_template_is_searched(spark):
    items = [(1, PAID.format(5, 5, 7, 9, 11, 13)), (2, PAID.format(5, 6, 7, 9, 11, 13)), (3, PAID.format(8, 6, 7, 9, 11, 13))]
    assert spark_leaks(spark, [(1, items[1][1]), (2, items[2][1])], items) == {(1, 2, "verbatim", 13, 7), (2, 3, "verbatim", 13, 7)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, D.item_classes(bench).collect())) == [(1, 1), (2, 2), (2, 3)]


def test_every_run_is_judged(spark):
    item = "We carry 3 kg and 3 kg of rice for 2 days over the hill and far away from all"
    twisted = item.replace("3 kg and 3 kg", "4 kg and 5 kg").split(" over")[0]
    assert {x[:3] for x in spark_leaks(spark, [(1, twisted + ". " + item), (2, twisted)], [(1, item)])} == {(1, 1, "verbatim")}


def test_one_placeholder_for_a_name_or_a_quantity(spark):
    item = "then Anna Maria walks 5 km to the old mill, meets Bob and eats 3 red apples there"
    docs = [(1, item.replace("Anna Maria", "Kim").replace("5 km", "12 miles").replace("Bob", "Jo Ann Lee")), (2, item.replace("Anna Maria", "Bob"))]
    assert {x[:3] for x in spark_leaks(spark, docs, [(1, item)])} == {(1, 1, "reparameterised")}


@pytest.mark.parametrize(
    ("item", "changed"),
    [
        ("Tom has 12 apples. Anna gives him 7 more. Tom then eats 3 of the apples. How many are left?", "Ben has 15 apples. Lucy gives him 4 more. Ben then eats 6 of the apples. How many are left?"),
        ("Janet buys 3 pens at the shop. Olga pays 4 dollars for each of them and Janet pays 2.", "Olga buys 6 pens at the shop. Janet pays 9 dollars for each of them and Olga pays 1."),
    ],
)
def test_names_that_open_sentences(spark, item, changed):
    assert {x[:3] for x in spark_leaks(spark, [(1, "Some text here. " + changed)], [(1, item)])} == {(1, 1, "reparameterised")}


def test_short_items_count_as_a_whole(spark):
    items = [(1, "what is 7 times 8"), (2, "name the capital"), (3, "why")]
    docs = [(1, "ask what is 7 times 8 now"), (2, "what is 6 times 8"), (3, "do name the capital"), (4, "name the"), (5, "Why not")]
    assert {x[:3] for x in spark_leaks(spark, docs, items)} == {(1, 1, "verbatim"), (3, 2, "verbatim")}


def test_windows_of_many_items_and_long_texts(spark):
    """A beginning that all items share is no anchor; a document of many tokens is searched whole."""
    rng = random.Random(2)

    def tail():
        return " ".join("".join(rng.choices("klmnop", k=5)) for _ in range(20))

    items = [(i, "what is the value of the sum " + tail()) for i in range(300)]
    docs = [(1, "what is the value of the sum of all " * 2000), (2, "x y " * 30_000 + items[7][1])]
    assert {x[:3] for x in spark_leaks(spark, docs, items)} == {(2, 7, "verbatim")}
    bench = spark.createDataFrame(items, "item_id long, text string")
    classes = D._members(bench).withColumnRenamed("item_id", "class_id")
    shared = D._anchors(classes, (), D.LEAST).groupBy("window").count().where("count > 1").count()
    assert shared == 0
