"""Op 7: SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 21, 21 and 22 bits.  Of two
fingerprints at most two bits apart, some segment is equal (pigeonhole) and the segment
after it differs in two bits at most.  That one is read as a word of the perfect binary
Golay code (23, 12, 7): it is decoded to the codewords near it, one where the nearest is
within two bits and six (the nearest, and those four bits away) where it is three bits
away.  Words two bits apart or less always share a codeword, so the key

    (number of the equal segment, its bits, codeword index of the next segment)

is shared by every linked pair; a fingerprint has 3 to 18 keys.  Candidates joined on a key
are verified by counting bits.

Large groups: only distinct fingerprints are joined.  Keys with more than ``BUCKET``
fingerprints emit no pairs; all fingerprints that have such a key are linked through the
65 words within one bit of them: two fingerprints share such a word exactly if they are
two bits apart or less, at most 65 fingerprints share one, and the least of these is
linked to the others.  Both ways are exact, and the work grows linearly.

Defined cases: null and wordless texts have fingerprint 0 and link like any other; a
null doc_id takes part but is not chosen as a component's name; repeated rows repeat; an
empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edictum.llm.common import saved, slices
from edictum.llm.graph import components

GENERATOR = 0xAE3  # of the cyclic (23, 12, 7) code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit, bits
BUCKET = 64
SEED = 42


def _lower(text: bytes) -> bytes:
    return text.lower()  # bytes.lower() changes A-Z only


def shingle_hashes(text: str | None, size: int = 3) -> np.ndarray:
    words = _lower((text or "").encode("utf-8", "surrogatepass")).split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None) -> int:
    return majority(shingle_hashes(text))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the shingles' hashes; signed 64-bit."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) of every document."""

    def run(batches):
        for batch in slices(batches):
            found = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: nearest error pattern, its weight, and the five patterns of weight 4
    (zeros where the nearest has a weight below 3)."""
    syndromes = syndrome(np.arange(1 << 23, dtype=np.int64)[[1 << i for i in range(23)]])
    leader, weight = np.zeros(2048, np.int64), np.zeros(2048, np.int64)
    fours: list[list[int]] = [[] for _ in range(2048)]
    for w in range(1, 5):
        for places in combinations(range(23), w):
            s, pattern = 0, 0
            for i in places:
                s ^= int(syndromes[i])
                pattern |= 1 << i
            if w < 4:
                leader[s], weight[s] = pattern, w
            else:
                fours[s].append(pattern)
    table = np.zeros((2048, 5), np.int64)
    for s in range(2048):
        if fours[s]:
            table[s] = fours[s]
    return leader, weight, table


def syndrome(words: np.ndarray) -> np.ndarray:
    left = words.copy()
    for bit in range(22, 10, -1):
        left = np.where(left >> bit & 1, left ^ (GENERATOR << (bit - 11)), left)
    return left


def codeword_indices(words: np.ndarray, tables: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 6) codeword indices of 23-bit words, and which of them count."""
    leader, weight, fours = tables
    s = syndrome(words)
    near = np.concatenate([(words ^ leader[s])[:, None], words[:, None] ^ fours[s]], axis=1)
    counts = np.ones_like(near, dtype=bool)
    counts[:, 1:] = (weight[s] == 3)[:, None]
    return near >> 11, counts


def keys_of(fps: np.ndarray, tables: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs of signed 64-bit fingerprints."""
    words = fps.view(np.uint64)
    parts = [(words >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        index, counts = codeword_indices(parts[(i + 1) % 3], tables)
        key = (np.int64(i) << np.int64(40)) | (parts[i] << np.int64(12))
        row, column = np.nonzero(counts)
        rows.append(row)
        keys.append(key[row] | index[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def fuzzy_keys(fps: DataFrame) -> DataFrame:
    """key, fp for every Golay key of every fingerprint."""
    tables = golay_tables()

    def run(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            rows, keys = keys_of(values, tables)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[rows])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def links(fps: DataFrame, most: int = 2, bucket: int = BUCKET) -> DataFrame:
    """u, v: links that connect all distinct fingerprints ``most`` (2) bits apart or less."""
    keys = saved(fuzzy_keys(fps), "golay-keys")
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sides = saved(keys.join(counts, "key"), "golay-shared")
    cold = sides.where(F.col("n") <= bucket).select("key", "fp")
    other = cold.select("key", F.col("fp").alias("v"))
    pairs = cold.join(other, "key").where((F.col("fp") < F.col("v")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= most)).select(F.col("fp").alias("u"), "v")
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)])
    hot = sides.where(F.col("n") > bucket).select("fp").distinct()
    middles = hot.withColumn("flip", F.explode(flips)).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"), "fp")
    stars = middles.groupBy("middle").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    rows = saved(fingerprints(docs), "fingerprints")
    distinct = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fp")
    root = components(links(distinct))
    named = distinct.join(root, distinct["fp"] == root["u"], "left").select("fp", "first", F.coalesce("v", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = named.join(least, "root").select("fp", "component_id")
    return rows.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
