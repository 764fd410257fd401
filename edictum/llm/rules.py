"""Op 6: quality rules and n-gram perplexity bands.

Model: per language, counts of byte n-grams (order 3) of whole texts are made by Spark;
a modified Kneser-Ney model (three discounts per order, continuation counts below the
highest order) is estimated from them and stored as sorted arrays of packed n-grams with
log probabilities and back-off weights, looked up by binary search.  Texts are in one of two
halves by their hash, equal texts in the same; a text is scored by the model of the other half, so
none is judged by counts of its own.

Size: a model has 256**3 n-grams of the highest order at most whatever the corpus, eight bytes
each, that is some 135 MB; this bound is what lets it be broadcast, and why the order is 3.
Models are scored in batches of ``most_entries`` n-grams at most (or of one model), each over
its own texts.

Verdict: a text's mean log perplexity per byte is compared with its language's bands:
the quartiles over all texts of the language that have one, widened by ``reach`` times their
distance and by ``slack`` over the root of its bytes, as means of short texts vary more.  Below the
lower band (repetitive) or above the upper one (noise) a text is rejected.  The base rules
reject texts of few words or with many words in repeated 5-word windows.

Defined cases: a null text has no words and fails the base rule; null and empty languages
are languages of their own; very long texts are scored whole; where a half of a language has no
text, texts of the other can't be scored and pass the bands; a language whose quartiles coincide
has bands at the margin for short texts only; empty tables give no rows; repeated rows are judged
alike; columns other than doc_id, text and lang are not looked at, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edictum.llm.common import saved, slices

ORDER = 3
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
PIECE = 1 << 20


def packed(data: bytes, order: int) -> np.ndarray:
    """Every run of ``order`` bytes as a number."""
    kind = np.int32 if order <= 3 else np.int64
    raw = np.frombuffer(data, np.uint8).astype(kind)
    n = len(raw) - order + 1
    found = np.zeros(max(n, 0), kind)
    for i in range(order):
        found = found << 8 | raw[i : i + n] if n > 0 else found
    return found


def text_grams(text: str | None, order: int) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return packed(b"\n" * (order - 1) + raw, order) if raw else np.zeros(0, np.int32)


def half_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, half, gram, n over all whole texts; a batch sends one row per n-gram and half at most."""

    def run(batches):
        for batch in slices(batches, 2048):
            by_part: dict = {}
            for text, lang, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_part.setdefault((lang, half), []).append(text)
            for (lang, half), texts in by_part.items():
                total_grams, total_counts, held, size = [], [], [], 0
                for i, text in enumerate(texts):
                    grams = text_grams(text, order)
                    held.append(grams)
                    size += len(grams)
                    if size >= PIECE or i == len(texts) - 1:
                        g, c = np.unique(np.concatenate(held), return_counts=True)
                        total_grams.append(g)
                        total_counts.append(c)
                        held, size = [], 0
                g, back = np.unique(np.concatenate(total_grams), return_inverse=True)
                c = np.bincount(back, np.concatenate(total_counts), len(g)).astype(np.int64)
                parts = [pa.array([lang] * len(g), pa.string()), pa.array(np.full(len(g), half, np.int32)), pa.array(g.astype(np.int64)), pa.array(c, pa.int64())]
                yield pa.RecordBatch.from_arrays(parts, names=["lang", "half", "gram", "n"])

    text = F.col("text").cast("string")
    rows = docs.select(text.alias("text"), F.col("lang").cast("string").alias("lang"), half_of(text).alias("half"))
    return rows.mapInArrow(run, "lang string, half int, gram long, n long").groupBy("lang", "half", "gram").agg(F.sum("n").alias("n"))


def discounts(counts: np.ndarray) -> tuple[float, float, float]:
    """Of n-grams seen once, twice, and more often."""
    n1, n2, n3, n4 = (float((counts == k).sum()) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    three = 3 - 4 * y * n4 / n3 if n3 else 0.9
    return tuple(float(min(max(d, 0.05), k - 0.05)) for d, k in ((1 - 2 * y * n2 / n1, 1), (2 - 3 * y * (n3 / n2), 2), (three, 3)))


def _level(grams: np.ndarray, counts: np.ndarray, lower: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interpolated probabilities of ``grams`` (sorted), given those one order below; the
    back-off weights and the contexts they belong to."""
    context = grams >> 8
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(grams)]))
    total = np.add.reduceat(counts.astype(float), first)
    d = np.array([0.0, *discounts(counts)])[np.minimum(counts, 3)]
    gamma = np.add.reduceat(d, first) / total
    return np.maximum(counts - d, 0) / total[group] + gamma[group] * lower, gamma, context[first]


def estimate(grams: np.ndarray, counts: np.ndarray, order: int) -> dict:
    """Modified Kneser-Ney of one language: by order the sorted n-grams with their log
    probabilities, and the contexts with their log back-off weights."""
    at = np.argsort(grams)
    levels = [(grams[at], counts[at])]
    for k in range(order - 1, 0, -1):
        suffix = levels[0][0] & ((1 << 8 * k) - 1)
        levels.insert(0, np.unique(suffix, return_counts=True))  # in how many contexts
    model: dict = {"grams": [], "logs": [], "contexts": [], "backoffs": []}
    lower: np.ndarray | float = 1 / 256
    for k, (g, c) in enumerate(levels, 1):
        if k > 1:
            below, prob = model["grams"][-1], np.exp(model["logs"][-1])
            lower = prob[np.searchsorted(below, g & ((1 << 8 * (k - 1)) - 1))]
        prob, gamma, contexts = _level(g, c, lower)
        for name, value in (("grams", g), ("logs", np.log(prob)), ("contexts", contexts), ("backoffs", np.log(np.maximum(gamma, 1e-12)))):
            model[name].append(value)
    if order <= 3:  # packed n-grams fit four bytes
        model = {k: [np.asarray(v, np.int32 if k in ("grams", "contexts") else np.float32) for v in values] for k, values in model.items()}
    return model


def scores(model: dict, grams: np.ndarray, k: int) -> np.ndarray:
    """Log probability of the last byte of each k-gram, backing off where it is unseen."""
    if k == 0:
        return np.full(len(grams), float(model["backoffs"][0][0]) - np.log(256))
    known = model["grams"][k - 1]
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    found, missing = model["logs"][k - 1][at].astype(float), np.flatnonzero(known[at] != grams)
    if len(missing):
        left = grams[missing]
        contexts = model["contexts"][k - 1]
        at = np.minimum(np.searchsorted(contexts, left >> 8), len(contexts) - 1)
        weight = np.where(contexts[at] == left >> 8, model["backoffs"][k - 1][at], 0.0) if k > 1 else 0.0
        found[missing] = weight + scores(model, left & ((1 << 8 * (k - 1)) - 1), k - 1)
    return found


def base_features(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = Counter(x for x in text.split("\n") if x.strip(SPACES))
    repeats = 0
    if n >= 6:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        w = np.zeros(n - 4, np.uint64)
        for i in range(5):
            w = w * np.uint64(0x9E3779B97F4A7C15) + (h[i : n - 4 + i] ^ (w >> np.uint64(29)))
        _, back, counts = np.unique(w, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(counts[back] > 1)
        edges = np.zeros(n + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + 5, -1)
        repeats = int((np.cumsum(edges[:-1]) > 0).sum())
    return n, chars, symbols, lines.total() - len(lines), repeats


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _batches(counts: DataFrame, most_entries: int) -> list[list[tuple]]:
    """(language, half) of the models, in batches that have ``most_entries`` n-grams together,
    or hold one model."""
    batches, size = [], 0
    for lang, half, n in sorted(counts.groupBy("lang", "half").count().collect(), key=lambda r: (r[0] is not None, r[0], r[1])):
        if not batches or size + n > most_entries:
            batches.append([])
            size = 0
        batches[-1].append((lang, half))
        size += n
    return batches


def _one_of(parts: list[tuple], half: Column) -> Column:
    """Rows of one of the (language, half) pairs."""
    found = F.lit(False)
    for h in (0, 1):
        named = [x for x, y in parts if y == h and x is not None]
        here = F.coalesce(F.col("lang").cast("string").isin(named), F.lit(False)) if named else F.lit(False)
        if (None, h) in parts:
            here = here | F.col("lang").isNull()
        found = found | ((half == h) & here)
    return found


def _scored(docs: DataFrame, models: dict, order: int) -> DataFrame:
    """doc_id, lang, the base features, n_grams and log_sum."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text"), half_of(text).alias("half"))

    def run(batches):
        for batch in slices(batches):
            lang, text, half = (batch.column(i).to_pylist() for i in (1, 2, 3))
            found = [base_features(t) for t in text]
            grams = [len((t or "").encode("utf-8", "surrogatepass")) for t in text]
            used = [shared.value.get((k, 1 - h)) for k, h in zip(lang, half, strict=True)]
            grams = [n if m else 0 for n, m in zip(grams, used, strict=True)]
            logs = [float(scores(m, text_grams(t, order), order).sum()) if n else 0.0 for m, t, n in zip(used, text, grams, strict=True)]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(grams, pa.int64()), pa.array(logs, pa.float64())], names=["doc_id", "lang", *FEATURES, "n_grams", "log_sum"])

    kinds = ", ".join(f"{f} long" for f in FEATURES)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, {kinds}, n_grams long, log_sum double")


def judged(docs: DataFrame, order: int = ORDER, reach: float = 3.0, slack: float = 2.0, min_words: int = 10, most_repeated: int = 20, most_entries: int = 2_000_000) -> DataFrame:
    """doc_id, the base features, base_failed, kept, log_ppl and its language's bands."""
    counts = saved(gram_counts(docs, order), "grams")
    parts = []
    half, left = half_of(F.col("text").cast("string")), F.lit(True)
    for pairs in _batches(counts, most_entries):
        models = {part: estimate(grams, n, order) for part, grams, n in _by_part(counts.where(_one_of(pairs, F.col("half"))))}
        theirs = _one_of([(lang, 1 - h) for lang, h in pairs], half)
        parts.append(_scored(docs.where(theirs), models, order))
        left = left & ~theirs
    # Texts that no model is for: of a language with texts in one half only.
    parts.append(_scored(docs.where(left), {}, order))
    rows = saved(reduce(DataFrame.union, parts), "scored")
    rows = rows.withColumn("log_ppl", F.when(F.col("n_grams") > 0, -F.col("log_sum") / F.col("n_grams")))
    quartiles = rows.where("log_ppl IS NOT NULL").groupBy("lang").agg(F.percentile_approx("log_ppl", F.array(F.lit(0.25), F.lit(0.75)), 1000).alias("q"))
    bands = quartiles.select(F.col("lang").alias("_lang"), F.col("q")[0].alias("low_q"), F.col("q")[1].alias("high_q"))
    spread = F.col("high_q") - F.col("low_q")
    margin = reach * spread + slack / F.sqrt(F.greatest("n_grams", F.lit(1)))
    banded = (
        rows.join(F.broadcast(bands), F.col("lang").eqNullSafe(F.col("_lang")), "left")
        .withColumn("lower_band", F.col("low_q") - margin)
        .withColumn("upper_band", F.col("high_q") + margin)
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    inside = F.coalesce(F.col("log_ppl").between(F.col("lower_band"), F.col("upper_band")), F.lit(True))
    return banded.select("doc_id", *FEATURES, failed.alias("base_failed"), (~failed & inside).alias("kept"), "log_ppl", "lower_band", "upper_band")


def _by_part(counts: DataFrame):
    """((language, half), n-grams, counts) of each model; 256**order rows of a model at most."""
    table = counts.toArrow()
    parts = list(zip(table.column("lang").to_pylist(), table.column("half").to_pylist(), strict=True))
    grams, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    names: dict = {}
    codes = np.fromiter((names.setdefault(part, len(names)) for part in parts), np.int64, len(parts))
    for part, code in names.items():
        yield part, grams[codes == code], n[codes == code]
