"""Op 8: benchmark decontamination by template canonicalisation.

Documents and benchmark items become token sequences in which a capitalised word, with up to
three more that follow it (a name, or what opens a sentence), a number, and a number with
its unit are one typed placeholder each; other tokens are lower-cased words.

1. Items with one template and one pattern of equal slot values are a class; whatever holds for one
   of them in a re-parameterised text holds for all.  Classes are searched, not items.
2. A match is a run of at least ``least`` tokens on one diagonal (all of an item of ``WINDOW``
   to ``least`` tokens).  Of every such stretch of a template the window of ``WINDOW`` tokens that
   the fewest templates hold is an anchor; the windows of the documents are joined with anchors.
3. Each joined diagonal is laid out whole, and all its runs are judged:
   verbatim where the slots hold an item's own values, else reparameterised where the slots are
   consistent (each value of the item stands for one of the document and the other way round)
   and a third of the tokens are words, or where ``least`` tokens are words anyway.
   A name at an end of a run may have merged with its surroundings: its inner word is all that
   verbatim asks for, and consistency doesn't look at it.
4. Items of fewer than ``WINDOW`` tokens are joined as a whole, and count if verbatim.

Result: for each document the items that it holds verbatim, and the classes of which it holds a
re-parameterised one, named by their least item_id; ``class_id`` is that of either, and
``item_classes`` has the members.

Only DataFrame functions are used.  Window hashes are built by doubling.  A document's
windows are never shuffled where the anchors are below Spark's broadcast threshold (they are
written first, so their size is known); beyond it Spark joins by shuffle and splits hot keys.

Defined cases: null and empty texts have no tokens; very long ones are taken whole; a
document row is told from others of its doc_id by its text; a null doc_id or item_id is
reported as such; repeated rows give one leak; of several runs the verbatim, longest, first
one is reported; empty tables give no rows; columns other than doc_id, item_id and text are
not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edictum.llm.common import saved

WINDOW = 8
LEAST = 13
NUM, NAME, QUANTITY = "\x01", "\x02", "\x03"
SLOT = "\x04"  # all slot tokens, and no others, sort below it
_NAMED = r"\p{Lu}\p{Ll}[\p{L}\p{M}\p{N}]*"
#: Bounded repetitions: the JVM matches repeated groups recursively.
TOKEN = _NAMED + f"(?: {_NAMED})" + r"{0,3}|\p{L}[\p{L}\p{M}\p{N}]*|[0-9]+(?:[.,][0-9]+){0,8}|\p{N}|[%°€£$]"
UNITS = tuple(
    "% ° € £ $ kg g mg lb lbs oz t ton tons km m cm mm mi ft in inch inches l ml cl h hr hrs min mins s sec secs ms mph kmh hz mb gb tb kb w kw v "
    "usd eur gbp mile miles feet foot yard yards meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms "
    "litre litres liter liters gallon gallons hour hours minute minutes second seconds day days week weeks month months year years percent degree degrees "
    "dollar dollars cent cents euro euros pound pounds mètre mètres kilomètre kilomètres gramme grammes heure heures seconde secondes jour jours semaine "
    "semaines mois an ans année années pourcent degré degrés metro metros kilómetro kilómetros gramo gramos litro litros hora horas minuto minutos segundo "
    "segundos día días semana semanas mes meses año años grados dólar dólares libra libras kilo kilos stunde stunden minuten sekunde sekunden tag tage tagen "
    "woche wochen monat monate jahr jahre jahren prozent grad pfund gramm tonnen tonne tonnes".split()
)
_UNIT_VALUES = UNITS + tuple(NAME + u for u in UNITS)


def with_tokens(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the tokens ``name`` in place of ``text``; a slot token is its type's
    control character and its value.  Each step is a projection, so that none is computed twice."""
    others = [c for c in rows.columns if c != "text"]

    def typed(t: Column) -> Column:
        first, second = F.substring(t, 1, 1), F.substring(t, 2, 1)
        named = (F.lower(first) != first) & (F.upper(second) != second)
        return F.when((t >= "0") & (t < ":"), F.concat(F.lit(NUM), t)).when(named, F.concat(F.lit(NAME), F.lower(t))).otherwise(F.lower(t))

    def is_number(t: Column) -> Column:
        return (t >= NUM) & (t < NAME)

    raw = F.coalesce(F.regexp_extract_all(F.col("text").cast("string"), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))
    rows = rows.select(*others, F.transform(raw, typed).alias(name))
    after = F.slice(name, F.lit(2), F.size(name))
    quantity = F.zip_with(name, after, lambda t, u: F.when(is_number(t) & u.isin(*_UNIT_VALUES), F.concat(F.lit(QUANTITY), F.substring(t, 2, 1 << 30), F.lit(" "), F.translate(u, NAME, ""))).otherwise(t))
    before = F.concat(F.array(F.lit("")), F.slice(name, F.lit(1), F.greatest(F.size(name) - 1, F.lit(0))))
    rows = rows.select(*others, before.alias("_before"), quantity.alias("_tokens"))
    left = F.zip_with("_before", "_tokens", lambda p, t: F.when(~(is_number(p) & t.isin(*_UNIT_VALUES)), t))
    return rows.select(*others, F.array_compact(left).alias(name))


def outline(t: Column) -> Column:
    return F.when(t < SLOT, F.substring(t, 1, 1)).otherwise(t)


def windows(rows: DataFrame, found: str, short: tuple[int, ...] = ()) -> DataFrame:
    """One row per window of the tokens ``found``: the other columns, at, size, window (a
    hash of its template).  Sizes are ``WINDOW`` and those of ``short``, all below it."""
    others = [c for c in rows.columns if c != found]
    rows = rows.select(*others, F.transform(found, lambda t: F.xxhash64(outline(t))).alias("w"))
    extra: list[str] = []
    for width in (1, 2, 4, 8):
        if width > 1:
            rest = F.greatest(F.size("w") - width // 2, F.lit(0))
            pairs = F.zip_with(F.slice("w", F.lit(1), rest), F.slice("w", F.lit(width // 2 + 1), rest), lambda a, b: F.xxhash64(a, b))
            rows = rows.select(*others, *extra, pairs.alias("w"))
        # Of a size between two powers of two: the windows at its beginning and at its end.
        sizes = [k for k in short if width <= k < 2 * width]
        for k in sizes:
            rest = F.greatest(F.size("w") - (k - width), F.lit(0))
            ends = F.zip_with(F.slice("w", F.lit(1), rest), F.slice("w", F.lit(k - width + 1), rest), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            rows = rows.withColumn(f"_w{k}", F.transform(ends, lambda e: F.xxhash64(e["a"], e["b"])))
        extra += [f"_w{k}" for k in sizes]

    def placed(name: str, size: int) -> Column:
        return F.transform(name, lambda w, i: F.struct(i.alias("at"), F.lit(size).alias("size"), w.alias("window")))

    # posexplode_outer: for posexplode Spark would infer a filter on the array's size and
    # compute the array once more in every projection that the filter passes.
    if not extra:
        return rows.select(*others, F.posexplode_outer("w").alias("at", "window")).withColumn("size", F.lit(WINDOW))
    every = F.concat(placed("w", WINDOW), *[placed(name, int(name[2:])) for name in extra])
    return rows.select(*others, F.explode_outer(every).alias("z")).select(*others, "z.*")


def _members(benchmark: DataFrame) -> DataFrame:
    """ck, item_id, item_tokens, n: every item with tokens and the key of its class."""
    rows = with_tokens(benchmark.select("item_id", "text"), "item_tokens").where(F.size("item_tokens") > 0)
    equal = F.transform("item_tokens", lambda t: F.when(t < SLOT, F.array_position("item_tokens", t)).otherwise(F.lit(0)))
    key = F.md5(F.concat_ws("\x1f", F.transform("item_tokens", outline), F.transform(equal, lambda i: i.cast("string"))))
    return rows.select(key.alias("ck"), "item_id", "item_tokens", F.size("item_tokens").alias("n")).distinct()


def item_classes(benchmark: DataFrame) -> DataFrame:
    """class_id, item_id: the members of every class of items."""
    rows = _members(benchmark)
    return rows.join(rows.groupBy("ck").agg(F.min("item_id").alias("class_id")), "ck").select("class_id", "item_id").distinct()


def _anchors(classes: DataFrame, short: tuple[int, ...], least: int) -> DataFrame:
    """window, size, ck, item_at: where the documents' windows are joined."""
    every = windows(classes.select("ck", "n", "item_tokens"), "item_tokens", short).where("window IS NOT NULL")
    whole = every.where((F.col("n") < WINDOW) & (F.col("size") == F.col("n"))).select("window", "size", "ck", F.col("at").alias("item_at"))
    long = every.where((F.col("n") >= WINDOW) & (F.col("size") == WINDOW)).withColumn("c", F.count("*").over(Window.partitionBy("window")))
    stretch = F.least(F.col("n"), F.lit(least)) - WINDOW
    ahead = Window.partitionBy("ck").orderBy("at").rowsBetween(0, max(least - WINDOW, 0))
    # Of fewer windows than ``least`` tokens have, the item has one stretch, which starts at 0.
    rarest = long.withColumn("x", F.min(F.struct("c", "window", "at")).over(ahead)).where(F.col("at") + stretch + WINDOW <= F.col("n"))
    return whole.union(rarest.select("x.window", "size", "ck", F.col("x.at").alias("item_at")).distinct())


def _ends(pair: Column, i: Column, n: Column, side: str) -> Column:
    """A slot value; of a name at an end of a run the word that lies inside."""
    words = F.split(F.substring(pair[side], 2, 1 << 30), " ")
    t = pair[side]
    inside = F.when(i == 0, F.element_at(words, -1)).when(i == n - 1, F.element_at(words, 1))
    return F.when((t >= NAME) & (t < QUANTITY) & ((i == 0) | (i == n - 1)), F.concat(F.lit(NAME), inside)).otherwise(t)


def _trimmed(tokens: str) -> Column:
    return F.transform(F.transform(tokens, lambda t: F.struct(t.alias("t"))), lambda p, i: _ends(p, i, F.size(tokens), "t"))


def _runs(hits: DataFrame, texts: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """doc_id, text_key, ck, item_at, mine, theirs: the runs on the joined diagonals."""
    same_doc = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("text_key").eqNullSafe(F.col("_k"))
    begin = F.greatest(F.lit(0), -F.col("diagonal"))
    length = F.least("n", F.size("tokens") - F.col("diagonal")) - begin
    laid = (
        hits.join(texts.withColumnsRenamed({"doc_id": "_d", "text_key": "_k"}), same_doc)
        .join(classes.select("ck", "n", "item_tokens"), "ck")
        .select("doc_id", "text_key", "ck", "n", begin.alias("begin"), F.slice("tokens", begin + F.col("diagonal") + 1, length).alias("mine"), F.slice("item_tokens", begin + 1, length).alias("theirs"))
    )
    same = F.zip_with("mine", "theirs", lambda d, i: outline(d) == outline(i))
    breaks = F.filter(F.transform(same, lambda s, i: F.when(~s, i)), lambda i: i.isNotNull())
    laid = laid.withColumn("breaks", F.concat(F.array(F.lit(-1)), breaks, F.array(F.size("mine"))))
    needed = F.least("n", F.lit(least))
    found = F.zip_with(F.slice("breaks", F.lit(1), F.size("breaks") - 1), F.slice("breaks", F.lit(2), F.size("breaks")), lambda a, b: F.struct((a + 1).alias("at"), (b - a - 1).alias("n_tokens")))
    laid = laid.withColumn("runs", found).select("*", F.explode(F.filter("runs", lambda r: r["n_tokens"] >= needed)).alias("r"))
    return laid.select(
        "doc_id", "text_key", "ck", "n", (F.col("begin") + F.col("r.at")).alias("item_at"), F.col("r.n_tokens").alias("n_tokens"),
        F.slice("mine", F.col("r.at") + 1, F.col("r.n_tokens")).alias("mine"), F.slice("theirs", F.col("r.at") + 1, F.col("r.n_tokens")).alias("theirs"),
    )


def _digest(tokens: str) -> Column:
    return F.md5(F.concat_ws("\x1f", tokens))


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text_key, item_id, class_id, n_tokens, n_slots, kind of the leaks in each document."""
    assert least >= WINDOW, "a run must hold a window"
    rows = docs.select("doc_id", "text").withColumn("text", F.col("text").cast("string")).withColumn("text_key", F.xxhash64("text"))
    members = saved(_members(benchmark), "members")
    classes = saved(members.groupBy("ck").agg(F.min("item_id").alias("class_id"), F.min("n").alias("n"), F.min("item_tokens").alias("item_tokens")), "classes")
    # Seven sizes at most.
    short = tuple(r.n for r in classes.where(F.col("n") < WINDOW).select("n").distinct().orderBy("n").collect())
    anchors = saved(_anchors(classes, short, least), "anchors")
    placed = windows(with_tokens(rows.select("doc_id", "text_key", "text"), "t"), "t", short)
    hits = saved(placed.join(anchors, ["window", "size"]).select("doc_id", "text_key", "ck", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct(), "hits")
    concerned = hits.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct()
    same_doc = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("text_key").eqNullSafe(F.col("_k"))
    texts = rows.join(concerned, same_doc, "left_semi").dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", "text")
    texts = saved(with_tokens(texts, "tokens"), "leak-tokens")
    runs = _runs(hits, texts, classes, least)
    both = F.zip_with("theirs", "mine", lambda i, d: F.struct(i.alias("i"), d.alias("d")))
    inner = F.filter(both, lambda s, at: (s["i"] < SLOT) & ~((s["i"] >= NAME) & (s["i"] < QUANTITY) & ((at == 0) | (at == F.col("n_tokens") - 1))))
    runs = runs.withColumn("pairs", inner).withColumn("n_slots", F.size(F.filter("theirs", lambda t: t < SLOT))).withColumn("mine", _trimmed("mine"))
    kinds = F.size(F.array_distinct("pairs"))
    consistent = (kinds == F.size(F.array_distinct("pairs.i"))) & (kinds == F.size(F.array_distinct("pairs.d")))
    literal = F.col("n_tokens") - F.col("n_slots")
    other = (F.col("n") >= WINDOW) & ((consistent & (3 * literal >= F.col("n_tokens"))) | (literal >= least))
    runs = saved(runs.select("doc_id", "text_key", "ck", "item_at", "n_tokens", "n_slots", _digest("mine").alias("digest"), other.alias("other")), "runs")
    # Members are compared by the stretches that some run covers, never with every document.
    stretches = runs.select("ck", "item_at", "n_tokens").distinct()
    part = F.slice("item_tokens", F.col("item_at") + 1, F.col("n_tokens"))
    own = members.join(stretches, "ck").withColumn("part", part).withColumn("part", _trimmed("part")).select("ck", "item_at", "n_tokens", "item_id", _digest("part").alias("digest"))
    verbatim = runs.join(own, ["ck", "item_at", "n_tokens", "digest"]).withColumn("kind", F.lit("verbatim"))
    held = verbatim.select("doc_id", "text_key", "ck").distinct().withColumnsRenamed({"doc_id": "_d", "text_key": "_k", "ck": "_c"})
    others = runs.where("other").join(held, same_doc & (F.col("ck") == F.col("_c")), "left_anti").withColumn("kind", F.lit("reparameterised"))
    names = classes.select("ck", "class_id")
    columns = ["doc_id", "text_key", "item_id", "class_id", "n_tokens", "item_at", "n_slots", "kind"]
    found = verbatim.join(names, "ck").select(*columns).union(others.join(names, "ck").withColumn("item_id", F.col("class_id")).select(*columns))
    best = F.max_by(F.struct("class_id", "n_tokens", "n_slots", "kind"), F.struct("kind", "n_tokens", -F.col("item_at"), -F.col("n_slots"), -F.col("class_id")))
    return found.groupBy("doc_id", "text_key", "item_id").agg(best.alias("b")).select("doc_id", "text_key", "item_id", "b.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` without a leak."""
    found = saved(leaks(docs, benchmark, least).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct(), "leaks")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_d"]) & (F.xxhash64(docs["text"].cast("string")) == found["_k"]), "left_anti")


def _tokens_sql(source: str, made: str) -> str:
    """(id, pos, tok) of the texts of ``source`` (id, text), as ``with_tokens`` has them."""
    units = ", ".join("'" + u + "'" for u in UNITS)
    return f"""{made}_0 AS (SELECT id, unnest(regexp_extract_all(text, '{TOKEN}')) AS t, generate_subscripts(regexp_extract_all(text, '{TOKEN}'), 1) AS pos FROM {source}),
{made}_1 AS (SELECT id, pos, CASE WHEN t >= '0' AND t < ':' THEN chr(1) || t WHEN lower(t[1]) <> t[1] AND upper(t[2]) <> t[2] THEN chr(2) || lower(t) ELSE lower(t) END AS t FROM {made}_0),
{made}_2 AS (SELECT *, t >= chr(1) AND t < chr(2) AS num, replace(t, chr(2), '') IN ({units}) AND NOT (t >= chr(1) AND t < chr(2)) AS unit FROM {made}_1),
{made}_3 AS (SELECT *, lag(num) OVER w AS after_num, lead(unit) OVER w AS before_unit, lead(t) OVER w AS following FROM {made}_2 WINDOW w AS (PARTITION BY id ORDER BY pos)),
{made} AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS pos, tok, CASE WHEN tok < chr(4) THEN tok[1] ELSE tok END AS shape FROM (
  SELECT id, pos, CASE WHEN num AND before_unit THEN chr(3) || substr(t, 2) || ' ' || replace(following, chr(2), '') ELSE t END AS tok FROM {made}_3 WHERE NOT (unit AND coalesce(after_num, false))) s)"""


_TRIM = "CASE WHEN {0}[1] = chr(2) AND pos = first THEN chr(2) || string_split(substr({0}, 2), ' ')[-1] WHEN {0}[1] = chr(2) AND pos = last THEN chr(2) || string_split(substr({0}, 2), ' ')[1] ELSE {0} END"

#: Every diagonal of every document and class of items, by a join of equal template tokens.
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL) x),
items AS (SELECT row_number() OVER () AS id, item_id, text FROM benchmark WHERE text IS NOT NULL),
{_tokens_sql("docs", "d")},
{_tokens_sql("items", "b")},
patterned AS (SELECT *, CASE WHEN tok < chr(4) THEN min(pos) OVER (PARTITION BY id, tok) ELSE -1 END AS equal FROM b),
keyed AS (SELECT id, string_agg(shape || '/' || equal, chr(31) ORDER BY pos) AS ck, count(*) AS n FROM patterned GROUP BY id),
classes AS (SELECT ck, min(item_id) AS class_id, any_value(n) AS n, min(keyed.id) AS id FROM keyed JOIN items USING (id) GROUP BY ck),
met AS (SELECT d.id AS doc, ck, class_id, n, b.pos, d.pos - b.pos AS diagonal, d.tok AS mine, b.tok AS theirs, b.shape FROM classes JOIN b USING (id) JOIN d ON d.shape = b.shape),
islands AS (SELECT *, pos - row_number() OVER (PARTITION BY doc, ck, diagonal ORDER BY pos) AS island FROM met),
runs AS (SELECT doc, ck, diagonal, island, min(pos) AS first, max(pos) AS last, count(*) AS n_tokens, count(*) FILTER (shape < chr(4)) AS n_slots
  FROM islands GROUP BY doc, ck, diagonal, island HAVING count(*) >= least({LEAST}, any_value(n))),
held AS (SELECT i.*, first, last, n_tokens, n_slots FROM islands i JOIN runs r USING (doc, ck, diagonal, island)),
judged AS (SELECT doc, ck, diagonal, first, any_value(last) AS last, any_value(class_id) AS class_id, any_value(n) AS n, any_value(n_tokens) AS n_tokens, any_value(n_slots) AS n_slots,
    count(DISTINCT theirs || chr(31) || mine) FILTER (inner_slot) AS pairs, count(DISTINCT theirs) FILTER (inner_slot) AS lefts, count(DISTINCT mine) FILTER (inner_slot) AS rights
  FROM (SELECT *, shape < chr(4) AND NOT (shape = chr(2) AND pos IN (first, last)) AS inner_slot FROM held) h GROUP BY doc, ck, diagonal, first),
verbatim AS (SELECT h.doc, h.ck, h.diagonal, h.first, m.id FROM held h JOIN keyed m USING (ck) JOIN b ON b.id = m.id AND b.pos = h.pos
  GROUP BY h.doc, h.ck, h.diagonal, h.first, m.id HAVING bool_and({_TRIM.format("h.mine").replace("pos =", "h.pos =")} = {_TRIM.format("b.tok").replace("pos =", "h.pos =")})),
found AS (
  SELECT doc, item_id, class_id, n_tokens, n_slots, 'verbatim' AS kind, first FROM verbatim v JOIN judged USING (doc, ck, diagonal, first) JOIN items ON items.id = v.id
  UNION ALL SELECT doc, class_id, class_id, n_tokens, n_slots, 'reparameterised', first FROM judged j
  WHERE n >= {WINDOW} AND ((pairs = lefts AND pairs = rights AND 3 * (n_tokens - n_slots) >= n_tokens) OR n_tokens - n_slots >= {LEAST}) AND NOT EXISTS (SELECT 1 FROM verbatim v WHERE v.doc = j.doc AND v.ck = j.ck)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc, item_id ORDER BY kind DESC, n_tokens DESC, first, n_slots, class_id) AS r FROM found)
SELECT doc_id, item_id, class_id, CAST(n_tokens AS INTEGER) AS n_tokens, CAST(n_slots AS INTEGER) AS n_slots, kind FROM best JOIN docs ON docs.id = best.doc WHERE r = 1
"""
