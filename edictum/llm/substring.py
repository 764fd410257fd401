"""Op 9: removal of repeated 50-word passages by difference-cover anchors.

A difference cover of period v holds, for any two offsets, a shift that moves both onto
cover positions modulo v.  So if 50 equal words start at i in one document and at j in
another, some anchor of 50 - v + 1 words lies at cover positions in both.  Hence:

1. Texts equal as a whole are reduced to the one of least doc_id; in the others every
   window also starts in that one.
2. Anchors of the remaining documents are hashed at cover positions only (6 in 31) and
   dealt by hash, without their places; those found in two documents or more are marked.
   Equal anchors in several documents of one batch are known there and then: one row goes on
   for all, so a passage in a third of all documents costs one row a batch.
3. Matches are extended from the marks: every 50-word window that covers a marked anchor
   is hashed (128 bits) and dealt with its doc_id; the least doc_id of each window decides.
   Before dealing, a batch keeps one row per window, that of its least doc_id.
4. The words covered by the windows of a larger doc_id go.

Windows are compared by 128-bit hashes of their words, two 64-bit sums over independent
word hashes.  Anchors decide only where to look.

Defined cases: a null text has no words; texts under 50 words keep all; very long texts are taken
whole; repeated doc_ids count as one document, each of their texts judged by itself; rows with
a null doc_id neither remove nor are removed; empty tables give no rows; columns other than
doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edictum.llm.common import WORD, saved, slices

WINDOW = 50
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)  # every residue modulo 31 is a difference of two of these
#: Odd multipliers of the two window sums.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
CHUNK = 4_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """(2, words) hashes of 64 bits each."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(map(digest, words)), np.uint64).reshape(-1, 2).T


def powers(base: int, count: int) -> np.ndarray:
    found = np.full(count, base, np.uint64)
    found[:1] = 1
    return np.cumprod(found)


def window_sums(hashes: np.ndarray, base: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Sum over i < size of hash[start + i] * base**i, modulo 2**64."""
    n = len(hashes)
    up, down = powers(base, n + 1), powers(pow(base, -1, 1 << 64), n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    return (sums[starts + size] - sums[starts]) * down[starts]


def anchor_starts(n: int, size: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
    every = np.arange(max(0, n - size + 1))
    return every[np.isin(every % period, cover)]


def _chunks(batches, convert, size):
    """Lists of converted rows with about ``size`` words each."""
    held, weight = [], 0
    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found, n = convert(row)
            if found is not None:
                held.append(found)
                weight += n
            if weight >= size:
                yield held
                held, weight = [], 0
    if held:
        yield held


def document_anchors(words: list[bytes], window: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a text's anchors."""
    size = window - period + 1
    at = anchor_starts(len(words), size, period, cover)
    return window_sums(word_hashes(words)[0], BASES[0], at, size).view(np.int64), at


def anchors(docs: DataFrame, window: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """pk, doc_id, several, known: a row for each anchor of a document to compare, ``several`` where
    it stands for more documents of the batch; of the latter all are ``known`` (and dealt anyhow)."""

    def convert(row):
        words = words_of(row[1])
        if len(words) < window:
            return None, 0
        return (row[0], np.unique(document_anchors(words, window, period, cover)[0])), len(words)

    def run(batches):
        for chunk in _chunks(batches, convert, CHUNK):
            key = np.concatenate([c[1] for c in chunk])
            doc = np.repeat(np.array([c[0] for c in chunk], np.int64), [len(c[1]) for c in chunk])
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
            several = (doc[np.r_[first[1:], len(key)] - 1] != doc[first])[group]
            rep = np.zeros(len(key), bool)
            rep[first] = True
            sent = np.flatnonzero(rep | ~several)
            known = np.flatnonzero(several)
            spread = (doc[known].view(np.uint64) * np.uint64(BASES[1]) ^ key[known].view(np.uint64) * np.uint64(BASES[0])).view(np.int64)
            pk, docs_out = np.concatenate([key[sent], spread]), np.concatenate([doc[sent], doc[known]])
            flag = np.concatenate([several[sent], np.zeros(len(known), bool)])
            mark, missing = np.concatenate([key[sent], key[known]]), np.arange(len(pk)) < len(sent)
            for i in range(0, len(pk), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(pk[part]), pa.array(docs_out[part]), pa.array(flag[part]), pa.array(mark[part], mask=missing[part])], names=["pk", "doc_id", "several", "known"])

    return docs.mapInArrow(run, "pk long, doc_id long, several boolean, known long")


def marks(rows: DataFrame) -> DataFrame:
    """doc_id, mark: the anchors that two documents or more hold.

    Reads rows sorted by hash and document as a stream; of a group that goes on in the next
    batch it holds the first document.
    """

    def run(batches):
        last, doc, shared = None, None, False
        for batch in batches:
            pks, docs, several = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:3])
            known = batch.column(3)
            fresh = np.flatnonzero(known.is_null().to_numpy(zero_copy_only=False))
            out_d, out_m = [docs[known.is_valid().to_numpy(zero_copy_only=False)]], [known.drop_null().to_numpy(zero_copy_only=False)]
            pks, docs, several = pks[fresh], docs[fresh], several[fresh]
            if len(pks):
                first = np.flatnonzero(np.r_[True, pks[1:] != pks[:-1]])
                group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(pks)]))
                hit = np.maximum.reduceat(several, first) | (np.maximum.reduceat(docs, first) != np.minimum.reduceat(docs, first))
                if pks[0] == last:
                    hit[0] |= shared or bool((docs[: first[1] if len(first) > 1 else len(docs)] != doc).any())
                    if hit[0] and not shared:  # the rows so far were of one document
                        out_d.append(np.array([doc]))
                        out_m.append(np.array([last]))
                out_d.append(docs[hit[group]])
                out_m.append(pks[hit[group]])
                if pks[-1] != last or len(first) > 1:
                    doc = docs[first[-1]]
                last, shared = pks[-1], bool(hit[-1])
            out_d, out_m = np.concatenate(out_d), np.concatenate(out_m)
            yield pa.RecordBatch.from_arrays([pa.array(out_d, pa.int64()), pa.array(out_m, pa.int64())], names=["doc_id", "mark"])

    # Batches cut groups anywhere, hence the state above.
    return rows.mapInArrow(run, "doc_id long, mark long")


def candidate_windows(found: DataFrame, window: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """h1, h2, doc_id, at: the windows over marked anchors; local duplicates reduced.

    ``at`` is 2 x the numbered start (version << 40 | start), + 1 where a smaller doc_id of the
    same batch has the window.
    """
    span = period - 1

    def convert(row):
        words = words_of(row[1])
        n = len(words) - window + 1
        if n < 1:
            return None, 0  # another text of the doc_id has the marks
        keys, places = document_anchors(words, window, period, cover)
        at = places[np.isin(keys, np.array(row[3], np.int64))]
        flags = np.zeros(n + 1, np.int64)
        np.add.at(flags, np.clip(at - span, 0, n), 1)
        np.add.at(flags, np.clip(at + 1, 0, n), -1)
        starts = np.flatnonzero(np.cumsum(flags[:-1]) > 0)
        hashes = word_hashes(words)
        return (row[0], *(window_sums(hashes[i], BASES[i], starts, window) for i in (0, 1)), starts | row[2] << 40), len(words)

    def run(batches):
        for chunk in _chunks(batches, convert, CHUNK):
            h1, h2, at = (np.concatenate([c[i] for c in chunk]) for i in (1, 2, 3))
            doc = np.repeat(np.array([c[0] for c in chunk], np.int64), [len(c[1]) for c in chunk])
            order = np.lexsort((at, doc, h2, h1))
            h1, h2, doc, at = h1[order], h2[order], doc[order], at[order]
            first = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(doc)]))
            later = doc > doc[first][group]
            out = [h1.view(np.int64), h2.view(np.int64), doc, at * 2 + later]
            for i in range(0, len(doc), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in out], names=["h1", "h2", "doc_id", "at"])

    return found.mapInArrow(run, "h1 long, h2 long, doc_id long, at long")


def _sound(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _copies(rows: DataFrame) -> DataFrame:
    """doc_id, text_key of the rows whose whole text a smaller doc_id has."""
    keyed = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_key"), F.md5("text").alias("_m"))
    shared = keyed.groupBy("text_key", "_m").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last")
    # Written first: only a join of plain tables can be split at a text that very many rows have.
    return saved(keyed.join(saved(shared, "equal-texts"), ["text_key", "_m"]).where("doc_id > _first").select("doc_id", "text_key").distinct(), "copies")


def affected(docs: DataFrame, copies: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """doc_id, text_key, text, version, starts: documents that lose windows, and where the windows
    start that a smaller doc_id holds (of all texts of the doc_id, by version)."""
    differences = {(a - b) % period for a in cover for b in cover}
    assert len(differences) == period and window >= period, "no difference cover"
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    single = texts.withColumn("text_key", F.xxhash64("text")).join(copies, ["doc_id", "text_key"], "left_anti").select("doc_id", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = anchors(single, window, period, cover).repartition(n, "pk").sortWithinPartitions("pk", "doc_id")
    found_in = marks(dealt).groupBy("doc_id").agg(F.collect_set("mark").alias("marks"))
    # Copies need not be taken out of the texts again: their windows only confirm the others'.
    # The texts of one doc_id are numbered; the join has brought them together.
    version = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("text_key")).cast("long")
    keyed = texts.withColumn("text_key", F.xxhash64("text")).join(found_in.hint("merge"), "doc_id")
    found = saved(keyed.withColumn("version", version).select("doc_id", "text", "version", "marks", "text_key"), "candidates")
    windows = saved(candidate_windows(found.drop("text_key"), window, period, cover), "windows")
    least = windows.where("at % 2 = 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    known = windows.where("at % 2 = 1").select("doc_id", F.expr("at div 2").alias("at"))
    beyond = windows.where("at % 2 = 0").join(least, ["h1", "h2"]).where("doc_id > first").select("doc_id", F.expr("at div 2").alias("at"))
    starts = known.union(beyond).groupBy("doc_id").agg(F.collect_list("at").alias("starts"))
    return found.select("doc_id", "text_key", "text", "version").dropDuplicates(["doc_id", "version"]).join(starts, "doc_id")


def kept_words(text: str | None, version: int, starts: list[int], window: int) -> tuple[list[bytes], int]:
    """The words that stay and the number of those that go."""
    words = words_of(text)
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.unique(np.array(starts, np.int64))
    at = at[at >> 40 == version] & ((1 << 40) - 1)
    edges[at] += 1
    edges[at + window] -= 1
    gone = np.cumsum(edges[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())


def _shortened(found: DataFrame, window: int) -> DataFrame:
    """doc_id, text_key, left_text, left_removed, left_sha256 of documents that lose words."""

    def run(batches):
        for batch in slices(batches):
            removed, kept, digest = [], [], []
            for text, version, starts in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                left, gone = kept_words(text, version, starts, window)
                line = b" ".join(left)
                removed.append(gone)
                kept.append(line.decode("utf-8", "surrogatepass"))
                digest.append(hashlib.sha256(line).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(kept, pa.string()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
                names=["doc_id", "text_key", "left_text", "left_removed", "left_sha256"],
            )

    return found.select("doc_id", "text_key", "text", "version", "starts").mapInArrow(run, "doc_id long, text_key long, left_text string, left_removed long, left_sha256 string")


def _whole(rows: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, and the digest of all words, of every row."""

    def run(batches):
        for batch in slices(batches):
            total, digest = [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                total.append(len(words))
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "text_key", "n_words", "whole_sha256"])

    return rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, n_words long, whole_sha256 string")


def removal_report(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; moves no unshared text."""
    rows = _sound(docs)
    copies = _copies(rows)
    left = _shortened(affected(rows, copies, window, period, cover), window).drop("left_text")
    judged = _whole(rows).join(left, ["doc_id", "text_key"], "left").join(copies.withColumn("copy", F.lit(True)), ["doc_id", "text_key"], "left")
    all_gone = F.col("copy").isNotNull() & (F.col("n_words") >= window)
    return judged.select(
        "doc_id",
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("left_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("left_sha256", "whole_sha256")).alias("kept_sha256"),
    )


def dedup_substrings(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """``docs`` with ``kept_text``: unchanged where nothing goes, else the words that stay,
    joined by single spaces."""
    rows = _sound(docs)
    copies = _copies(rows)
    left = _shortened(affected(rows, copies, window, period, cover), window).select("doc_id", "text_key", "left_text")
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    found = keyed.join(left, ["doc_id", "text_key"], "left").join(copies.withColumn("_copy", F.lit(True)), ["doc_id", "text_key"], "left")
    long = F.regexp_count("text", F.lit(WORD)) >= window
    kept = F.when(F.col("_copy").isNotNull() & long, F.lit("")).otherwise(F.coalesce("left_text", "text"))
    return found.select(*docs.columns, kept.alias("kept_text"))


#: Every window by itself; a window's first document is the one of least doc_id.
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT r, doc_id, i, md5(array_to_string(ws[i + 1 : i + {WINDOW}], ' ')) AS m FROM (SELECT r, doc_id, ws, unnest(range(0, len(ws) - {WINDOW - 1})) AS i FROM docs WHERE len(ws) >= {WINDOW} AND doc_id IS NOT NULL) x),
firsts AS (SELECT m, min(doc_id) AS first FROM w GROUP BY m),
hit AS (SELECT r, i FROM w JOIN firsts USING (m) WHERE doc_id > first),
gone AS (SELECT DISTINCT r, i + k AS pos FROM hit, range(0, {WINDOW}) ks(k)),
every AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM docs),
cut AS (SELECT e.r, count(g.pos) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY e.pos) FILTER (g.pos IS NULL), '') AS kept FROM every e LEFT JOIN gone g ON e.r = g.r AND e.pos = g.pos GROUP BY e.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN cut USING (r)
"""
