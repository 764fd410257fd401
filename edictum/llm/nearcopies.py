"""Near copies for the pipeline: documents whose sets of 5-word shingles have a Jaccard
similarity of 0.8 or more, found exactly.

Candidates come from op 7 first: the sets' SimHash fingerprints, joined by Golay keys and
verified to two bits (``simhash.links``).  Each such pair is compared by its whole sets, as
fingerprints can be close by chance, and what is linked then is one component.

At a similarity of 0.8 two fingerprints are about ten bits apart, some more, so no radius that
keys can serve finds all pairs.  Between the components the others come from prefix filtering:
with the shingles of every set in one global order, two sets that similar share one of
the first n - ceil(0.8 n) + 1 of each, and as many of them as ``_enough`` says.  Pairs that
meet both bounds are compared by their whole sets, so nothing is lost and nothing is guessed.

Order: shingles that a sixteenth of the documents holds ``HOT`` times or more come last, the
others by hash; any order is exact, this one keeps boilerplate out of the prefixes.

Large groups: documents with equal sets are one.  On prefix shingles of over ``BUCKET`` sets
each is first compared with one other, in ``TURNS`` turns; what these links join is one
component, and pairs inside a component are never compared.

Disk: a turn's components go on as one link for each set, and tables and shuffle files are deleted
once the next table is written; what a document puts on disk does not grow with turns or rounds.

Defined cases: words and shorter texts as in ``simhash.shingle_hashes``; null and wordless texts
have the empty set and are copies of each other; very long texts are taken whole; a null doc_id
takes part but is not chosen as a component's name where there is another; of repeated rows one
stays; an empty table gives no rows; columns other than doc_id and text are only carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edictum.llm.common import done_with, handed_on, saved, scratch, shuffles_deleted, slices
from edictum.llm.graph import components
from edictum.llm.simhash import links, majority, shingle_hashes

SIZE = 5
HOT = 8
BUCKET = 64
TURNS = 5
MOST_HOT = 1_000_000  # of the order only: shingles beyond it come by hash


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, SIZE))


def set_id(found: np.ndarray) -> int:
    """Signed 64-bit hash that stands for a set."""
    return int(np.array([xxhash.xxh3_64_intdigest(found.tobytes())], np.uint64).view(np.int64)[0])


def prefix(found: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of a sorted set, its hot shingles last."""
    if not len(found):
        return found
    length = len(found) - (4 * len(found) + 4) // 5 + 1
    if len(hot):
        at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
        last = hot[at] == found
        found = np.concatenate([found[~last], found[last]])
    return found[:length]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def _hot(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that come last in the order."""

    def run(batches):
        for batch in slices(batches):
            found = [shingle_set(t) for t in batch.column(0).to_pylist()]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    some = _texts(docs).where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0).select("text")
    counted = some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    rows = counted.orderBy(F.desc("n"), "h").limit(MOST_HOT).select("h").toArrow()
    return np.sort(rows.column("h").to_numpy().view(np.uint64))


def _set_ids(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, id, fp (the set's fingerprint) of every row."""

    def run(batches):
        for batch in slices(batches):
            found = [shingle_set(t) for t in batch.column(2).to_pylist()]
            made = [pa.array([f(x) for x in found], pa.int64()) for f in (set_id, majority)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "text_key", "id", "fp"])

    rows = _texts(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, id long, fp long")


def _postings(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """key, id, n, of every set's prefix; once for each set."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        for batch in slices(batches):
            keys, ids, ns = [], [], []
            for text in batch.column(0).to_pylist():
                found = shingle_set(text)
                first = prefix(found, shared.value)
                keys.append(first.view(np.int64))
                ids.append(np.full(len(first), set_id(found), np.int64))
                ns.append(np.full(len(first), len(found), np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, ids, ns)], names=["key", "id", "n"])

    return _texts(docs).select("text").mapInArrow(run, "key long, id long, n int").repartition("key").distinct()


def _sets(docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, shingles of the sets in ``pairs``, each from one of its texts."""

    def run(batches):
        for batch in slices(batches):
            found = [shingle_set(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], names=["id", "shingles"])

    wanted = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    keys = rows.join(wanted, "id").groupBy("id").agg(F.min("text_key").alias("text_key"))
    texts = _texts(docs).select(F.xxhash64("text").alias("text_key"), "text")
    return texts.join(keys, "text_key").select("id", "text").dropDuplicates(["id"]).mapInArrow(run, "id long, shingles array<long>")


def _similar(docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """u, v: the pairs whose Jaccard similarity is 0.8 or more; a table that is written."""
    with scratch(docs.sparkSession):
        pairs = saved(pairs.select("u", "v"), "pairs")
        sets = saved(_sets(docs, rows, pairs), "sets")
        both = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
        return handed_on(saved(both.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v"), "similar-pairs"))


def _near_sizes(n, m):
    return (5 * n >= 4 * m) & (5 * m >= 4 * n)


def _enough(n, m, met):
    """Whether sets of n and m that share ``met`` of their prefixes may be similar: beyond the
    prefix that ends first they share ceil(0.8 n) - 1 of that set at most."""
    rest = F.ceil(F.greatest(n, m) * 4 / F.lit(5)) - 1
    return 9 * (met + rest) >= 4 * (n + m)


def _rooted(posts: DataFrame, linked: DataFrame) -> DataFrame:
    """``posts`` with the least id of its component in ``linked`` as each set's root."""
    root = linked.withColumnsRenamed({"u": "id", "v": "root"})
    return saved(posts.select("key", "id", "n", "c").join(root, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")


def _star_pairs(rooted: DataFrame, bucket: int, turn: int) -> DataFrame:
    """u, v: for each set with prefix shingles of over ``bucket`` sets the centre of another root
    that most of these have.  A shingle's centre is another one in each turn."""
    hot = rooted.where(F.col("c") > bucket)
    # Sets that hold the shingles most others hold lie in the middle of their group.
    middle = hot.groupBy("id").agg((F.sum("c") / F.max("n")).alias("score"))
    drawn = F.col("score") * (1 + F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1000)) / 5000 * min(turn, 1))
    ranked = hot.join(middle, "id").withColumn("score", drawn)
    centres = ranked.groupBy("key").agg(F.max_by(F.struct("id", "n", "root"), F.struct("score", "id")).alias("x"))
    met = hot.join(centres, "key").where((F.col("root") != F.col("x.root")) & _near_sizes(F.col("n"), F.col("x.n")))
    counted = met.groupBy("id", F.col("x.id").alias("x")).agg(F.count("*").alias("met"))
    return counted.groupBy(F.col("id").alias("v")).agg(F.max_by("x", F.struct("met", "x")).alias("u")).select("u", "v")


def fingerprint_links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """u, v: similar sets whose fingerprints are two bits apart or less; for each fingerprint
    its least set is held against its others and against those of the linked fingerprints."""
    with scratch(docs.sparkSession):
        sets = saved(rows.groupBy("id").agg(F.min("fp").alias("fp")), "set-fps")
        least = saved(sets.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fps")
        alike = sets.join(least, "fp").where("id <> least").select(F.col("least").alias("u"), F.col("id").alias("v"))
        first, second = (least.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}")) for c in ("u", "v"))
        near = links(least).join(first, "u").join(second, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
        return handed_on(_similar(docs, rows, alike.union(near)))


def similar_links(docs: DataFrame, rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """u, v: links between set ids that connect all pairs of similar sets."""
    with scratch(docs.sparkSession):
        found = saved(_postings(docs, _hot(docs)), "prefixes")
        counts = found.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
        posts = saved(found.join(counts, "key"), "shared-prefixes")
        done_with(found)
        linked = fingerprint_links(docs, rows)
        rooted = posts.withColumn("root", F.col("id"))
        for turn in range(TURNS):
            more = _similar(docs, rows, _star_pairs(rooted, bucket, turn))
            if turn and more.isEmpty():
                continue
            before, linked = linked, components(linked.union(more))
            done_with(before, more, rooted)
            rooted = _rooted(posts, linked)
        done_with(posts)
        sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("c"))
        main = sizes.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("key", "main")
        live = saved(rooted.join(main, "key"), "mixed-prefixes")
        done_with(rooted)
        left = live.where("root <> main").select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
        right = live.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), "main")
        met = left.join(right, "key").where((F.col("ra") != F.col("rb")) & ((F.col("rb") == F.col("main")) | (F.col("a") < F.col("b"))) & _near_sizes(F.col("na"), F.col("nb")))
        u, v = F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")
        pairs = met.groupBy(u, v).agg(F.count("*").alias("met"), F.first("na").alias("na"), F.first("nb").alias("nb")).where(_enough(F.col("na"), F.col("nb"), F.col("met")))
        return handed_on(saved(linked.union(_similar(docs, rows, pairs)), "similar"))


def near_copies(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, component_id of every document (and text_key and the component's set id)."""
    rows = saved(_set_ids(docs), "set-ids")
    root = components(similar_links(docs, rows, bucket)).withColumnsRenamed({"u": "id", "v": "root"})
    named = rows.groupBy("id").agg(F.min("doc_id").alias("first")).join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(least, "root").select("id", "root", "component_id"), "id").select("doc_id", "component_id", "text_key", "root")


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: of least doc_id (null last), then of least text hash;
    of rows that are equal in both any one."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key"))
    with scratch(docs.sparkSession), shuffles_deleted(docs.sparkSession):
        found = near_copies(docs)
        keep = handed_on(saved(found.groupBy("root").agg(first.alias("f")).select(F.col("f.doc_id").alias("_keep"), F.col("f.text_key").alias("_key")), "kept-ids"))
    names = [f"_d{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)], docs["doc_id"].alias("_id"), F.xxhash64(docs["text"].cast("string")).alias("_text"))
    mine = rows.join(keep, F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_text") == F.col("_key")), "left_semi").dropDuplicates(["_id", "_text"])
    return mine.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
