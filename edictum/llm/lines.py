"""Op 3: removal of repeated runs of lines by winnowing.

A window is the shortest run of non-blank lines, from any line on, that has ``GUARANTEE`` lines
or ``WORDS`` words; a document that has neither is one window as a whole.  The least line hash
of a window is selected as its fingerprint, so equal runs of lines of that size have a
fingerprint in common, at the same place in them.

1. Only selected fingerprints are dealt by their hash, each once with the windows that
   select it; they are counted with map-side partial counts, and those in one place only are done.
2. The places of the others are joined.  A match is extended from the fingerprint to the left
   and to the right as far as a window reaches: of each window of lines around it the first
   place (least doc_id, then least line) is found, again with partial minima.
3. The lines of all later places go; longer repeated passages go as the union of windows.

No pairs of places are formed: of each window only its first place is joined.  First places are
written before they are joined, so that Spark can split a window that very many documents hold.

Defined cases: null texts have no lines and stay null; blank lines (no word) are not
compared and stay; a row without doc_id comes before all others; rows with the same doc_id and
text are one document; texts with one doc_id are ordered by hash; repeats inside a document count;
very long texts are taken whole, in time in proportion to their lines; an empty table gives no rows;
columns other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edictum.llm.common import WORD, saved

GUARANTEE = 4
WORDS = 20
NON_BLANK = r"[^\x20\x09-\x0D]"


def _shifted(name: str, by: int) -> Column:
    return F.slice(name, F.lit(by + 1), F.greatest(F.size(name) - by, F.lit(0)))


def fingerprints(docs: DataFrame, guarantee: int = GUARANTEE, words: int = WORDS) -> DataFrame:
    """doc_id, text_key, print, place, windows (at, last, h1, h2): each selected fingerprint,
    the line where it stands and the windows around it that select it."""
    rows = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_key"), F.split("text", "\n", -1).alias("lines"))
    hashed = F.transform("lines", lambda x, i: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), i.alias("i"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    rows = rows.select("doc_id", "text_key", F.filter(hashed, lambda x: x["w"] > 0).alias("line"))
    # An open window takes lines until it has enough words; ``n`` counts its lines.
    opened = F.transform("line", lambda x: F.struct(x["a"].alias("h1"), x["b"].alias("h2"), x["a"].alias("print"), x["i"].alias("place"), x["i"].alias("at"), x["i"].alias("last"), x["w"].alias("w"), F.lit(1).alias("n")))
    rows = rows.select("doc_id", "text_key", "line", opened.alias("open"))
    for by in range(1, guarantee):

        def longer(o: Column, x: Column) -> Column:
            less = x["a"] < o["print"]
            more = F.struct(
                F.xxhash64(o["h1"], x["a"]).alias("h1"), F.xxhash64(o["h2"], x["b"]).alias("h2"), F.when(less, x["a"]).otherwise(o["print"]).alias("print"), F.when(less, x["i"]).otherwise(o["place"]).alias("place"),
                o["at"].alias("at"), x["i"].alias("last"), (o["w"] + x["w"]).alias("w"), (o["n"] + 1).alias("n"),
            )
            return F.when(x.isNull() | (o["w"] >= words), o).otherwise(more)

        # zip_with fills the shorter array with nulls.
        rows = rows.select("doc_id", "text_key", "line", F.zip_with("open", _shifted("line", by), longer).alias("open"))
    whole = (F.size("line") < guarantee) & (F.aggregate("line", F.lit(0), lambda s, x: s + x["w"]) < words)
    full = F.filter("open", lambda o, i: (o["w"] >= words) | (o["n"] >= guarantee) | ((i == 0) & whole))
    rows = rows.select("doc_id", "text_key", full.alias("full"))

    def group(o: Column, i: Column) -> Column:
        # Places never go back from a window to the next: those of one place stand together.
        mine = F.filter(F.slice("full", i + 1, F.lit(guarantee)), lambda x: x["place"] == o["place"])
        windows = F.transform(mine, lambda x: F.struct(x["at"].alias("at"), x["last"].alias("last"), x["h1"].alias("h1"), x["h2"].alias("h2")))
        return F.when((i == 0) | (F.get("full", i - 1)["place"] != o["place"]), F.struct(o["print"].alias("print"), o["place"].alias("place"), windows.alias("windows")))

    rows = rows.select("doc_id", "text_key", F.transform("full", group).alias("g"))
    return rows.select("doc_id", "text_key", F.explode_outer("g").alias("g")).where("g IS NOT NULL").select("doc_id", "text_key", "g.*")


def later_runs(docs: DataFrame, guarantee: int = GUARANTEE, words: int = WORDS) -> DataFrame:
    """doc_id, text_key, spans (at, last): the windows of lines that stand earlier as well."""
    places = saved(fingerprints(docs, guarantee, words), "line-prints")
    shared = saved(places.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "line-shared")
    live = places.join(shared, "print").select("doc_id", "text_key", F.explode("windows").alias("w")).select("doc_id", "text_key", "w.*")
    live = saved(live, "line-live")
    where = F.struct("doc_id", "text_key", "at")
    firsts = live.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.max(where).alias("final")).where("first < final").select("h1", "h2", "first")
    later = live.join(saved(firsts, "line-firsts"), ["h1", "h2"]).where(where > F.col("first"))
    return later.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "last")).alias("spans"))


def dedup_lines(docs: DataFrame, guarantee: int = GUARANTEE, words: int = WORDS) -> DataFrame:
    """doc_id, n_lines (non-blank), n_removed, kept_text of every document."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    spans = saved(later_runs(rows, guarantee, words), "line-spans").withColumnsRenamed({"doc_id": "_d", "text_key": "_k"})
    # Merged at every size: with a broadcast below some size the plan would change with it.
    joined = rows.withColumn("text_key", F.xxhash64("text")).join(spans.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")), "left")
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["last"]))))
    cut = joined.select("doc_id", "text", F.split("text", "\n", -1).alias("lines"), F.coalesce(covered, F.array().cast("array<int>")).alias("covered"))
    counts = F.transform("lines", lambda x: F.regexp_like(x, F.lit(NON_BLANK)))
    cut = cut.select("doc_id", "text", "lines", "covered", counts.alias("counts"))
    cut = cut.withColumn("gone", F.filter("covered", lambda i: F.get("counts", i)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    cut = cut.withColumn("kept", F.when(F.size("gone") > 0, kept))
    return cut.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter("counts", lambda c: c))).cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")).alias("kept_text"),
    )


ORACLE = r"""
WITH raw AS (
  SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM raw),
n AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l),
o AS (
  SELECT doc_id, text, line, pos, words, row_number() OVER d - 1 AS ln, count(*) OVER (PARTITION BY doc_id, text) AS lines,
         sum(words) OVER (PARTITION BY doc_id, text) AS total FROM n WHERE words > 0 WINDOW d AS (PARTITION BY doc_id, text ORDER BY pos)),
w AS (
  SELECT doc_id, text, ln, lines, total, words AS wa, lead(words, 1) OVER d AS wb, lead(words, 2) OVER d AS wc,
         line AS a, lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c, lead(line, 3) OVER d AS e
  FROM o WINDOW d AS (PARTITION BY doc_id, text ORDER BY ln)),
v AS (
  SELECT *, CASE WHEN wa >= 20 THEN 1 WHEN wa + wb >= 20 THEN 2 WHEN wa + wb + wc >= 20 THEN 3 WHEN e IS NOT NULL THEN 4
                 WHEN ln = 0 AND lines < 4 AND total < 20 THEN lines END AS k FROM w),
f AS (
  SELECT doc_id, text, ln, k, row_number() OVER (PARTITION BY a, CASE WHEN k > 1 THEN b END, CASE WHEN k > 2 THEN c END, CASE WHEN k > 3 THEN e END, k
                                                 ORDER BY doc_id NULLS FIRST, ln) AS r FROM v WHERE k IS NOT NULL),
g AS (
  SELECT DISTINCT doc_id, text, ln + x AS ln FROM f, (VALUES (0), (1), (2), (3)) AS xs(x) WHERE r > 1 AND x < k),
kept AS (
  SELECT n.doc_id, n.text, count(*) FILTER (n.words > 0) AS n_lines, count(g.ln) AS n_removed,
         string_agg(n.line, chr(10) ORDER BY n.pos) FILTER (g.ln IS NULL) AS kept_text
  FROM n LEFT JOIN o ON n.doc_id = o.doc_id AND n.text = o.text AND n.pos = o.pos
         LEFT JOIN g ON o.doc_id = g.doc_id AND o.text = g.text AND o.ln = g.ln
  GROUP BY n.doc_id, n.text)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN coalesce(n_removed, 0) = 0 THEN d.text ELSE coalesce(kept_text, '') END AS kept_text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.text
"""
