"""Op 1: removal of repeated 400-byte strings by suffix arrays.

A byte goes if a 400-byte string that covers it also starts anywhere else.

1. Texts equal as a whole are found by their hashes: every string of such a text (of 400
   bytes or more) starts in the other as well.  One of them goes on to the search.
2. Every 400-byte window has a least 32-byte hash.  Equal windows have equal ones, so only
   windows with the same least hash need comparing.  A maximal run of windows with one
   least hash is a segment; segments are dealt by that hash (about one per 185 bytes) and
   those whose hash occurs once, in one place of the segment, are done.
3. Equal segments among the rest are counted with map-side partial counts: all windows of a
   segment that occurs twice are repeated, and one suffix array would only show the same of
   each of a thousand copies.  One of each different segment goes on.
4. Segments that share a least hash are concatenated, whole groups to a block of about half a
   megabyte, and the block's suffix array is built in two stages: suffixes smaller than
   their successors are sorted directly, the others are put in place by one scan over the
   buckets of first bytes.  Adjacent common prefixes of 400 bytes then show the repeated
   windows.  Order and prefixes are taken to 400 bytes, all that is asked for.

What the suffix arrays decide is thus the windows that different segments share; equal texts and
equal segments are settled by their hashes before, since no task could hold their copies.
A block holds ``BLOCK`` + ``most_in_group`` bytes at most.  A group of more bytes would not
fit: its windows are compared by 128-bit hashes in a distributed aggregate, exact as well.

Defined cases: a null text is empty; texts under 400 bytes lose nothing; rows are told
apart by doc_id and text, so repeated doc_ids are documents of their own and repeated rows
are copies; null doc_ids are kept; very long texts are cut into segments whole; empty tables give
no rows; columns other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edictum.llm.common import saved, slices

LENGTH = 400
GRAM = 32
BASE = 0x9E3779B97F4A7C15
MOST_WINDOWS = 1024  # of a segment; longer runs are cut
BLOCK = 1 << 19  # bytes; a block ends with the group that reaches it
MOST_IN_GROUP = 1 << 21  # bytes of the different segments with one least hash
NO_ID = -(1 << 63)


# --- the suffix array of one block ----------------------------------------------------


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a byte later."""
    n = len(data)
    ends = np.flatnonzero(np.r_[data[1:] != data[:-1], True])  # last places of byte runs
    rises = np.r_[data[ends[:-1]] < data[ends[:-1] + 1], False]
    return np.repeat(rises, np.diff(np.r_[-1, ends]))[:n]


def sorted_directly(raw: bytes, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the ``depth`` bytes from each on, eight bytes at a time: after
    the first eight only starts that are still tied are sorted on.  Holds a few numbers
    per start, no copies of text.  Where one text ends inside another it comes first.
    """
    padded = raw + bytes(8)
    words = np.ndarray((len(raw) + 1,), ">u8", padded, strides=(1,))
    order = starts[::-1].copy()  # of equal texts the later start is the shorter one
    lead = words[order].astype(np.uint64)
    at = np.argsort(lead, kind="stable")
    order, lead = order[at], lead[at]
    tied = np.r_[False, lead[1:] == lead[:-1]]  # equal to the one before
    for offset in range(8, min(depth, len(raw)), 8):
        group = np.flatnonzero(tied | np.r_[tied[1:], False])
        if not len(group):
            break
        label = np.cumsum(~tied[group])  # groups of tied starts stand together
        lead = words[np.minimum(order[group] + offset, len(raw))].astype(np.uint64)
        joined = tied[group]
        uneven = np.zeros(len(group) + 1, bool)
        uneven[label[joined & np.r_[False, lead[1:] != lead[:-1]]]] = True
        moved = np.flatnonzero(uneven[label])  # of groups that are not equal throughout
        at = moved[np.lexsort((lead[moved], label[moved]))]
        order[group[moved]], lead[moved] = order[group[at]], lead[at]
        tied[group] = joined & np.r_[False, lead[1:] == lead[:-1]]
    return order


def suffix_array(raw: bytes, depth: int) -> np.ndarray:
    """Suffixes of ``raw`` in the order of their first ``depth`` bytes."""
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    small = smaller_than_next(data)
    direct = sorted_directly(raw, np.flatnonzero(small), depth)
    sizes = np.bincount(data, minlength=256)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    induced = sizes - np.bincount(data[direct], minlength=256)
    ends = starts + sizes
    order = np.empty(n, np.int64)
    order[starts[data[direct]] + induced[data[direct]] + _rank_in_run(data[direct])] = direct
    free = starts.copy()

    def put(found: np.ndarray) -> None:
        found = found[found > 0] - 1
        found = found[~small[found]]
        byte = data[found]
        at = np.argsort(byte, kind="stable")
        found, byte = found[at], byte[at]
        order[free[byte] + _rank_in_run(byte)] = found
        np.add(free, np.bincount(byte, minlength=256), out=free)

    put(np.array([n]))  # the empty suffix comes first
    for c in np.flatnonzero(sizes):
        done = starts[c]
        while done < free[c]:
            upto = free[c]
            put(order[done:upto])
            done = upto
        put(order[starts[c] + induced[c] : ends[c]])
    return order


def _rank_in_run(values: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of equal values."""
    if not len(values):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return np.arange(len(values)) - np.repeat(first, np.diff(np.r_[first, len(values)]))


def common_prefixes(raw: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """Of each suffix and the one before it in ``order``: common bytes, in steps of eight."""
    padded = raw + bytes(depth + 8)
    words = np.ndarray((len(raw) + depth,), np.uint64, padded, strides=(1,))
    found = np.zeros(len(order), np.int64)
    active = np.arange(1, len(order))
    for at in range(0, depth, 8):
        active = active[words[order[active] + at] == words[order[active - 1] + at]]
        found[active] = at + 8
    return found


def repeated_windows(raw: bytes, valid: np.ndarray, length: int) -> np.ndarray:
    """Which valid starts have a window that another valid start has as well."""
    order = suffix_array(raw, length)
    run = np.cumsum(common_prefixes(raw, order, length) < length)
    starts = valid[order]
    twice = np.bincount(run, starts)[run] > 1
    found = np.zeros(len(raw), bool)
    found[order[twice & starts]] = True
    return found


# --- segments -------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, powers: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    up, down = powers
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * down[: n - size + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    rows = -(-n // width)
    grid = np.full(rows * width, np.uint64(2**64 - 1), np.uint64)
    grid[:n] = values
    grid = grid.reshape(rows, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def segments_of(raw: bytes, powers, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(least hash, first window, windows, whether the hash stands in several places) of
    each segment of a text."""
    hashes = gram_hashes(np.frombuffer(raw, np.uint8), powers, gram)
    least = sliding_least(hashes, length - gram + 1)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    sizes = np.diff(np.r_[first, len(least)])
    if sizes.max() > MOST_WINDOWS:
        parts = -(-sizes // MOST_WINDOWS)
        first = np.repeat(first, parts) + _rank_in_run(np.repeat(np.arange(len(parts)), parts)) * MOST_WINDOWS
        sizes = np.diff(np.r_[first, len(least)])
    reach = first + sizes + length - gram
    several = [np.count_nonzero(hashes[a:b] == k) > 1 for a, b, k in zip(first.tolist(), reach.tolist(), least[first], strict=True)]
    return least[first].view(np.int64), first, sizes, np.array(several)


def power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """key, c1, c2, id, text_key, at (first window * 2048 + windows), several of every segment."""

    def run(batches):
        powers = power_tables(1 << 16)
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(7)]
            for id_, text_key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                if len(raw) >= len(powers[0]):
                    powers = power_tables(2 * len(raw))
                keys, first, sizes, several = segments_of(raw, powers, length, gram)
                digest = xxhash.xxh3_128_digest
                ends = (first + sizes + length - 1).tolist()
                content = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(first.tolist(), ends, strict=True)]), np.int64).reshape(-1, 2)
                for column, value in zip(out, (keys, content[:, 0], content[:, 1], np.full(len(keys), id_, np.int64), np.full(len(keys), text_key, np.int64), first * 2048 + sizes, several), strict=True):
                    column.append(value)
            if out[0]:
                columns = [np.concatenate(c) for c in out]
                for i in range(0, len(columns[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], names=["key", "c1", "c2", "id", "text_key", "at", "several"])

    return docs.select("id", "text_key", "text").mapInArrow(run, "key long, c1 long, c2 long, id long, text_key long, at long, several boolean")


def pieces(found: DataFrame, length: int) -> DataFrame:
    """Of texts with their wanted segments: the segments' bytes, or for large groups one
    row for each window with its hash (``raw`` null)."""

    def run(batches):
        for batch in slices(batches):
            names = ("key", "id", "text_key", "at", "raw", "h1", "h2")
            out: list[list] = [[] for _ in names]

            def flush(out=out):
                kinds = (pa.int64(),) * 4 + (pa.binary(),) + (pa.int64(),) * 2
                done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=list(names))
                for c in out:
                    c.clear()
                return done

            for id_, text_key, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    a, n = divmod(w["at"], 2048)
                    if not w["large"]:
                        rows = [(w["key"], id_, text_key, w["at"], raw[a : a + n + length - 1], None, None)]
                    else:
                        hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i : i + length]) for i in range(a, a + n)), np.int64).reshape(-1, 2).tolist()
                        rows = [(w["key"], id_, text_key, (a + i) * 2048 + 1, None, *h) for i, h in enumerate(hashes)]
                    for row in rows:
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                if len(out[0]) > 20_000:
                    yield flush()
            yield flush()

    return found.mapInArrow(run, "key long, id long, text_key long, at long, raw binary, h1 long, h2 long")


def repeated_in_blocks(rows: DataFrame, length: int) -> DataFrame:
    """id, text_key, at: repeated windows of pieces dealt and sorted by key."""

    def block(held):
        raw = b"".join(h[3] for h in held)
        valid = np.zeros(len(raw), bool)
        begins = np.cumsum([0] + [len(h[3]) for h in held[:-1]])
        for b, h in zip(begins.tolist(), held, strict=True):
            valid[b : b + h[2] % 2048] = True
        hit = repeated_windows(raw, valid, length)
        ids, keys, ats = [], [], []
        for b, (id_, text_key, at, piece) in zip(begins.tolist(), held, strict=True):
            a, n = divmod(at, 2048)
            mine = hit[b : b + n].astype(np.int8)
            if not mine.any():
                continue
            edge = np.diff(np.r_[0, mine, 0])
            for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                ids.append(id_)
                keys.append(text_key)
                ats.append((a + s) * 2048 + e - s)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, keys, ats)], names=["id", "text_key", "at"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in slices(batches):
            for key, id_, text_key, at, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last and size >= BLOCK:
                    yield block(held)
                    held, size = [], 0
                held.append((id_, text_key, at, raw))
                size += len(raw)
                last = key
        if held:
            yield block(held)

    return rows.select("key", "id", "text_key", "at", "raw").mapInArrow(run, "id long, text_key long, at long")


# --- the operator ---------------------------------------------------------------------


def _affected(rows: DataFrame, later: DataFrame, length: int, gram: int, most_in_group: int) -> DataFrame:
    """id, text_key, text, spans of texts with repeated windows, but for the ``later`` ones.

    Those are taken out of the narrow segment rows: taking them out of the texts would mean
    to shuffle all texts once more.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = saved(segments(rows, length, gram), "segments")
    shared = every.groupBy("key").agg(F.count("*").alias("n"), F.max("several").alias("several")).where("n > 1 OR several").select("key")
    # Written before it is joined: only then can Spark split a key that very many segments have.
    live = saved(every.join(saved(shared, "shared-keys"), "key").join(later, ["id", "text_key"], "left_anti"), "live-segments")
    contents = saved(live.groupBy("key", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("id", "text_key", "at")).alias("first"), F.max("several").alias("several")), "contents")
    twice = saved(contents.where("n > 1").select("key", "c1", "c2"), "equal-segments")
    whole = live.join(twice, ["key", "c1", "c2"]).select("id", "text_key", "at")
    size = F.sum(F.col("first.at") % 2048 + (length - 1))
    groups = contents.groupBy("key").agg(F.count("*").alias("n"), F.max("several").alias("several"), size.alias("bytes")).where("n > 1 OR several").select("key", (F.col("bytes") > most_in_group).alias("large"))
    wanted = contents.join(saved(groups, "groups"), "key").select("first.*", "key", "large")
    wanted = wanted.groupBy("id", "text_key").agg(F.collect_list(F.struct("key", "at", "large")).alias("wanted"))
    concerned = live.select("id", "text_key").distinct().join(wanted, ["id", "text_key"], "left")
    # Merged at every size: with a broadcast below some size the plan would change with it.
    found = saved(rows.join(concerned.hint("merge"), ["id", "text_key"]).select("id", "text_key", "text", "wanted").dropDuplicates(["id", "text_key"]), "concerned")
    bits = saved(pieces(found.where("wanted IS NOT NULL"), length), "pieces")
    blocks = repeated_in_blocks(bits.where("raw IS NOT NULL").repartition(parts, "key").sortWithinPartitions("key"), length)
    large = bits.where("raw IS NULL")
    often = large.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    beyond = large.join(often, ["h1", "h2"]).select("id", "text_key", "at")
    spans = whole.union(blocks).union(beyond).groupBy("id", "text_key").agg(F.collect_list("at").alias("spans"))
    return found.select("id", "text_key", "text").join(spans, ["id", "text_key"])


def cut_spans(raw: bytes, spans: list[int], length: int) -> tuple[bytes, int, int]:
    """What stays, the bytes that go, and the number of their maximal runs."""
    at = np.array(spans, np.int64)
    edges = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edges, at // 2048, 1)
    np.add.at(edges, at // 2048 + at % 2048 + length - 1, -1)
    gone = np.cumsum(edges[:-1]) > 0
    runs = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _shortened(found: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            left = [cut_spans(t.encode("utf-8", "surrogatepass"), s, length) for t, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in left], pa.binary()), pa.array([x[1] for x in left], pa.int64()), pa.array([x[2] for x in left], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in left], pa.string())],
                names=["id", "text_key", "left", "removed", "spans", "digest"],
            )

    return found.select("id", "text_key", "text", "spans").mapInArrow(run, "id long, text_key long, left binary, removed long, spans long, digest string")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "text": text}).withColumn("text_key", F.xxhash64("text"))


def _plan(docs: DataFrame, length: int, gram: int, most_in_group: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keyed rows; (id, text_key) of texts that occur twice; what is left of the others."""
    rows = _keyed(docs.select("doc_id", "text"))
    marked = rows.where(F.octet_length("text") >= length).select("id", "text_key", F.md5("text").alias("m"))
    groups = marked.groupBy("text_key", "m").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    members = saved(marked.join(saved(groups, "equal-texts"), ["text_key", "m"]).select("id", "text_key", (F.col("id") > F.col("first")).alias("later")).distinct(), "copies")
    later = members.where("later").select("id", "text_key")
    left = _shortened(_affected(rows.select("id", "text_key", "text"), later, length, gram, most_in_group), length)
    return rows, members.select("id", "text_key"), left


def removal_report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_in_group: int = MOST_IN_GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows, copies, left = _plan(docs, length, gram, most_in_group)
    base = rows.select("doc_id", "id", "text_key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("whole"))
    judged = base.join(left.drop("left"), ["id", "text_key"], "left").join(copies.withColumn("copy", F.lit(True)), ["id", "text_key"], "left")
    copy = F.col("copy").isNotNull()
    return judged.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("digest", "whole")).alias("kept_sha256"),
    )


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_in_group: int = MOST_IN_GROUP) -> DataFrame:
    """doc_id and ``kept``, the remaining bytes of every document."""
    rows, copies, left = _plan(docs, length, gram, most_in_group)
    judged = rows.join(left.select("id", "text_key", "left"), ["id", "text_key"], "left").join(copies.withColumn("copy", F.lit(True)), ["id", "text_key"], "left")
    return judged.select("doc_id", F.when(F.col("copy").isNotNull(), F.lit(b"")).otherwise(F.coalesce("left", F.encode("text", "UTF-8"))).alias("kept"))


#: Every window by itself, as 800 hexadecimal digits; runs of covered bytes as islands.
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS m FROM (SELECT r, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS i FROM docs WHERE len(h) >= {2 * LENGTH}) x),
hit AS (SELECT r, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
marked AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS fresh FROM hit),
numbered AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS island FROM marked),
spans AS (SELECT r, min(i) AS a, max(i) + {LENGTH} AS b FROM numbered GROUP BY r, island),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT g.r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || any_value(substr(h, 2 * last + 1)) AS kept
  FROM gaps g JOIN docs USING (r) JOIN (SELECT r, max(b) AS last FROM spans GROUP BY r) l USING (r) GROUP BY g.r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM docs LEFT JOIN cut USING (r)
"""
