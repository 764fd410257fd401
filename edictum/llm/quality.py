"""Op 4: quality classification by hierarchical empirical Bayes.

Document evidence: two logistic models (bad quality, toxic) over binary hashed features of
the whole text: lower-cased words, their beginnings, and banded shares of symbols, capitals,
table bars, repeated lines and word windows.  Features enter a model if their chi-square
against the label is over ``chi2``.  They are fitted on the driver from the labelled rows
with the least seeded hashes, ``most_labelled`` of them at most; everything else covers all
documents.

Site posteriors: the documents' probabilities are summed by host (``source``) and by path
(``source`` and ``lang``) with map-side partial sums.  A host's rate is shrunk towards the
global rate, a path's towards its host's; the strength of either prior is estimated from
the spread of the rates between sites (method of moments), so sparse sites stay near
their parents.

Verdict: log odds of a document = evidence + ``site_weight`` * (logit of its path's rate -
logit of the global rate); it is kept if both log odds stay below ``cut``.  The path's rate is
that of its other documents: a document's own evidence counts once.

Defined cases: a null text has the features of the empty one; null sources and languages
are sites of their own; very long texts are read whole; without labelled rows of both kinds a
model has one low rate for all and rejects nothing; labels without a document, and repeated ones,
count as they join; a null label is no label; rows are judged by text, source and language,
so rows of one doc_id, or of none, may differ and repeated rows don't; empty tables give no
rows; columns other than doc_id, text, source and lang are not looked at, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edictum.llm.common import saved, slices

BITS = 20
STRIP = b".,;:!?\"'()"
UNKNOWN = -4.0  # log odds where the labels tell nothing
HEADS = (("bad", "quality", 0), ("toxic", "toxic", 1))


def banded_shares(text: str, words: list[bytes]) -> list[bytes]:
    n = max(len(words), 1)
    chars = max(len(text), 1)
    lines = Counter(x for x in text.split("\n") if x.strip())
    fives = {b" ".join(words[i : i + 3]) for i in range(0, max(len(words) - 2, 0), 3)}
    shares = {
        "symbols": sum(map(text.count, "#*$%&<>|")) / chars,
        "bars": text.count("|") / n,
        "shout": text.count("!") / n,
        "capitals": sum(map(str.isupper, text)) / chars,
        "lines": (lines.total() - len(lines)) / max(lines.total(), 1),
        "distinct": len(set(words)) / n,
        "runs": 1 - 3 * len(fives) / n if n > 5 else 0.0,
        "length": chars / n / 20,
    }
    return [f"\x00{k}:{int(20 * v)}".encode() for k, v in shares.items()] + [f"\x00{k}>{v > 0.05}".encode() for k, v in shares.items()]


def features(text: str | None) -> np.ndarray:
    text = text or ""
    words = [w.strip(STRIP) for w in text.encode("utf-8", "surrogatepass").lower().split()]
    found = set(words)
    found |= {w[:5] + b"~" for w in found} | {w[:4] + b"~" for w in found}
    found.update(banded_shares(text, words))
    digest = xxhash.xxh32_intdigest
    return np.unique(np.fromiter((digest(w) >> (32 - BITS) for w in found), np.int32, len(found)))


def fit(rows: list[np.ndarray], y: np.ndarray, chi2: float = 25.0, rounds: int = 150, decay: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights by feature number, and the intercept, of a logistic model on chosen features."""
    weights = np.zeros(1 << BITS, np.float32)
    n, ones = len(y), float(y.sum())
    rate = (ones + 0.5) / (n + 1)
    if not 0 < ones < n:
        return weights, UNKNOWN
    sizes = np.array([len(r) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(n), sizes)
    seen = np.bincount(flat, minlength=1 << BITS).astype(float)
    hit = np.bincount(flat, y[owner], 1 << BITS)
    expect = seen * ones / n
    score = (hit - expect) ** 2 * n / np.maximum(expect * (1 - ones / n) * (n - seen), 1e-9)
    chosen = np.flatnonzero((score > chi2) & (seen >= 3) & (seen < n))
    number = np.full(1 << BITS, -1)
    number[chosen] = np.arange(len(chosen))
    keep = number[flat] >= 0
    f, o = number[flat[keep]], owner[keep]
    w, bias = np.zeros(len(chosen)), float(np.log(rate / (1 - rate)))
    speed, speed_bias = np.full(len(chosen), 1e-6), 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(o, w[f], n) + bias, -30, 30)))
        g = np.bincount(f, (p - y)[o], len(chosen)) + decay * w
        speed += g * g
        w -= 0.3 * g / np.sqrt(speed)
        b = (p - y).sum()
        speed_bias += b * b
        bias -= 0.3 * b / np.sqrt(speed_bias)
    weights[chosen] = w
    return weights, float(bias)


def training_rows(docs: DataFrame, labels: DataFrame, most_labelled: int, seed: int) -> tuple[list[np.ndarray], dict]:
    """Features and labels of the labelled documents of least seeded hash."""
    chosen = labels.select("doc_id", "quality", "toxic").where("doc_id IS NOT NULL").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "quality", "toxic").limit(most_labelled)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("quality", "toxic", "text")

    def run(batches):
        for batch in slices(batches):
            found = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["quality", "toxic", "f"])

    kinds = {k: rows.schema[k].dataType.simpleString() for k in ("quality", "toxic")}
    got = rows.mapInArrow(run, f"quality {kinds['quality']}, toxic {kinds['toxic']}, f array<int>").toArrow()
    ends = got.column("f").combine_chunks()
    values = np.asarray(ends.values if hasattr(ends, "values") else ends.flatten())
    offsets = np.asarray(ends.offsets) if hasattr(ends, "offsets") else np.zeros(1, int)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], {k: got.column(k).to_pylist() for k in ("quality", "toxic")}


def evidence(docs: DataFrame, labels: DataFrame, most_labelled: int, seed: int) -> DataFrame:
    """doc_id, text_key, source, lang, bad, toxic: log odds of every document from its text."""
    rows, marks = training_rows(docs, labels, most_labelled, seed)
    models = []
    for _, column, positive in HEADS:
        known = [i for i, v in enumerate(marks[column]) if v is not None]
        models.append(fit([rows[i] for i in known], np.array([marks[column][i] == positive for i in known], float)))
    shared = docs.sparkSession.sparkContext.broadcast([(np.flatnonzero(w), w[w != 0], b) for w, b in models])
    text = F.col("text").cast("string")
    picked = docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.alias("text"))

    def run(batches):
        dense = []
        for at, value, bias in shared.value:
            w = np.zeros(1 << BITS, np.float32)
            w[at] = value
            dense.append((w, bias))
        for batch in slices(batches):
            found = [features(t) for t in batch.column(4).to_pylist()]
            odds = [pa.array([float(w[f].sum()) + b for f in found], pa.float64()) for w, b in dense]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *odds], names=["doc_id", "text_key", "source", "lang", "bad", "toxic"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, text_key long, source string, lang string, bad double, toxic double")


def _strength(rates: DataFrame, head: str) -> F.Column:
    """Prior strength from the weighted spread of site rates around their parents' rate."""
    p = F.col(f"{head}_parent")
    between = F.sum(F.col("n") * (F.col(f"{head}_rate") - p) ** 2) / F.sum("n")
    within = F.sum(p * (1 - p)) / F.sum("n")  # mean over sites of the binomial part, by n
    mean = F.sum(F.col("n") * p * (1 - p)) / F.sum("n")
    spread = F.greatest(between - within, mean * 1e-4)
    return F.greatest(F.lit(5.0), F.least(F.lit(1e4), mean / spread - 1)).alias(f"{head}_m")


def site_rates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, lang, and of each head the posterior rate, the sum, the prior's strength and
    its rate) of paths, and the global rates."""
    heads = [h for h, _, _ in HEADS]
    soft = rows.select("source", "lang", *[(1 / (1 + F.exp(-F.col(h)))).alias(h) for h in heads])
    paths = saved(soft.groupBy("source", "lang").agg(F.count("*").alias("n"), *[F.sum(h).alias(h) for h in heads]), "paths")
    overall = paths.agg(*[((F.sum(h) + 0.5) / (F.sum("n") + 1)).alias(f"{h}_global") for h in heads])
    hosts = paths.groupBy("source").agg(F.sum("n").alias("n"), *[F.sum(h).alias(h) for h in heads])
    level = hosts.crossJoin(F.broadcast(overall)).select("source", "n", *heads, *[(F.col(h) / F.col("n")).alias(f"{h}_rate") for h in heads], *[F.col(f"{h}_global").alias(f"{h}_parent") for h in heads])
    level = level.crossJoin(F.broadcast(level.agg(*[_strength(level, h) for h in heads])))
    host = level.select(F.col("source").alias("_s"), *[((F.col(h) + F.col(f"{h}_m") * F.col(f"{h}_parent")) / (F.col("n") + F.col(f"{h}_m"))).alias(f"{h}_parent") for h in heads])
    path = paths.join(host, F.col("source").eqNullSafe(F.col("_s"))).withColumns({f"{h}_rate": F.col(h) / F.col("n") for h in heads})
    path = path.crossJoin(F.broadcast(path.agg(*[_strength(path, h) for h in heads])))
    rates = [((F.col(h) + F.col(f"{h}_m") * F.col(f"{h}_parent")) / (F.col("n") + F.col(f"{h}_m"))).alias(f"{h}_site") for h in heads]
    held = [c for h in heads for c in (F.col(h).alias(f"{h}_sum"), F.col(f"{h}_m"), F.col(f"{h}_parent"))]
    sites = path.select(F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("n").alias("_n"), *rates, *held)
    return sites, overall


def classify(docs: DataFrame, labels: DataFrame, most_labelled: int = 8000, site_weight: float = 1.0, cut: float = 0.0, seed: int = 3) -> DataFrame:
    """doc_id, p_bad, p_toxic, kept of every document (and text_key, source and lang)."""
    rows = saved(evidence(docs, labels, most_labelled, seed), "evidence")
    sites, overall = site_rates(rows)
    joined = rows.join(saved(sites.crossJoin(F.broadcast(overall)), "sites"), F.col("source").eqNullSafe(F.col("_s")) & F.col("lang").eqNullSafe(F.col("_l")))

    def logit(p):
        return F.log(p / (1 - p))

    def others(head: str):
        own = 1 / (1 + F.exp(-F.col(head)))
        rate = (F.greatest(F.col(f"{head}_sum") - own, F.lit(0.0)) + F.col(f"{head}_m") * F.col(f"{head}_parent")) / (F.col("_n") - 1 + F.col(f"{head}_m"))
        return F.least(F.greatest(rate, F.lit(1e-9)), F.lit(1 - 1e-9))

    odds = {h: F.col(h) + site_weight * (logit(others(h)) - logit(F.col(f"{h}_global"))) for h, _, _ in HEADS}
    return joined.select(
        "doc_id", "text_key", "source", "lang",
        *[(1 / (1 + F.exp(-odds[h]))).alias(f"p_{h}") for h in odds],
        ((odds["bad"] < cut) & (odds["toxic"] < cut)).alias("kept"),
    )


def kept_documents(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps."""
    names = ("doc_id", "text_key", "source", "lang")
    rejected = classify(docs, labels, **settings).where(~F.col("kept"))
    gone = saved(rejected.select(*[F.col(n).alias(f"_gone_{n}") for n in names]).distinct(), "rejected")
    own = {"doc_id": docs["doc_id"], "text_key": F.xxhash64(docs["text"].cast("string")), "source": docs["source"].cast("string"), "lang": docs["lang"].cast("string")}
    same = F.lit(True)
    for n in names:
        same = same & own[n].eqNullSafe(gone[f"_gone_{n}"])
    return docs.join(gone, same, "left_anti")
