"""Language identification by interpolated Kneser-Ney character models.

Character 4-grams of labelled training texts are counted by Spark, the counts become one interpolated
model per language on the driver (its size is bounded), and all models together one sorted array of gram
hashes with a row of log probabilities each.  A text gets the language whose model gives it the lowest
cross-entropy per character; texts that no model explains as well as its own language are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprep.llm.common import annotate, mix, ranges
from tableprep.session import written

ORDER = 4
BITS = 16  # of a character in a packed gram; rarer characters beyond them share codes
SPACE = 32
TRAIN_ROWS = 4_000  # labelled documents per language that a model is fitted on, on average over draws
MODEL_GRAMS = 1 << 19  # most frequent grams kept per language
MOST_LANGUAGES = 512  # more are refused: every gram has a log probability in each language
CALIBRATION = 4  # every so manyth drawn document of a language calibrates instead of training
STRICTNESS = 8.0  # deviations above a language's usual cross-entropy at which a text is rejected
LEAST_SPREAD = 0.02  # deviation of cross-entropies between texts, in nats, that every language has at least
UNDETERMINED = "und"

OUTPUTS = "lang_pred string, score double, cross_entropy double, rejected boolean"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


class Grams:
    """Packed character grams of texts: letters lower-cased, anything else one space."""

    def __init__(self, texts: list[bytes | None]):
        lowered = [(t or b"").decode("utf-8", "replace").lower().replace("\0", " ") for t in texts]
        pad = "\0" * ORDER
        codes = np.frombuffer((pad + pad.join([*lowered, ""])).encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter((len(t) for t in lowered), dtype=np.int64, count=len(lowered))
        begin = np.cumsum(lengths + ORDER) - lengths
        is_letter = letters()[codes]
        symbols = np.where(is_letter, np.where(codes < 1 << BITS, codes, codes % 65521), np.where(codes == 0, 0, SPACE))
        kept = np.ones(len(symbols), dtype=bool)
        kept[1:] = (symbols[1:] != SPACE) | (symbols[:-1] != SPACE)
        place = np.concatenate([[0], np.cumsum(kept)])
        self.first, self.last = place[begin], place[begin + lengths]
        self.counts = self.last - self.first
        letter_sums = np.concatenate([[0], np.cumsum(is_letter)])
        self.has_letter = letter_sums[begin + lengths] > letter_sums[begin]
        symbols = symbols[kept].astype(np.uint64)
        packed = symbols.copy()
        for back in range(1, ORDER):
            packed[back:] |= symbols[:-back] << np.uint64(BITS * back)
        inside = symbols != 0
        self.keys = packed[inside]  # one per character of the texts, in order
        self.ends = np.cumsum(self.counts)


class KneserNey:
    """One language's interpolated model, from counts of packed grams of the highest order."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.levels = []
        order = np.argsort(grams)
        keys, values = grams[order], counts[order].astype(np.float64)
        for n in range(ORDER, 0, -1):
            once, twice = float((values == 1).sum()), float((values == 2).sum())
            discount = min(max(once / (once + 2 * twice), 0.1), 0.95) if once and twice else 0.5
            contexts, first, sizes = np.unique(keys >> np.uint64(BITS), return_index=True, return_counts=True)
            totals = np.add.reduceat(values, first) if len(first) else np.zeros(0)
            self.levels.append((keys, values, contexts, totals, sizes.astype(np.float64), discount))
            # below the highest order a gram counts once for every different character before it
            shorter = keys & np.uint64((1 << (BITS * (n - 1))) - 1)
            keys, values = np.unique(shorter, return_counts=True)
            values = values.astype(np.float64)
        self.levels.reverse()
        self.floor = 1.0 / (len(self.levels[0][0]) + 64)

    def probability(self, grams: np.ndarray) -> np.ndarray:
        p = np.full(len(grams), self.floor)
        for n, (keys, values, contexts, totals, kinds, discount) in enumerate(self.levels, 1):
            gram = grams & np.uint64((1 << (BITS * n)) - 1)
            seen = looked_up(keys, values, gram)
            context = gram >> np.uint64(BITS)
            total = looked_up(contexts, totals, context)
            spread = looked_up(contexts, kinds, context)
            p = np.where(total > 0, (np.maximum(seen - discount, 0) + discount * spread * p) / np.maximum(total, 1), p)
        return p


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


class LanguageModels:
    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.names = sorted(counts)
        self.models = [KneserNey(*counts[name]) for name in self.names]
        keys = np.unique(np.concatenate([counts[name][0] for name in self.names])) if counts else np.zeros(0, np.uint64)
        hashes = mix(keys)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.logs = self.evaluate(keys[order])
        # per language: usual cross-entropy, its variance between texts, variance per character
        self.usual = np.full((len(self.names), 3), np.inf)

    def evaluate(self, keys: np.ndarray) -> np.ndarray:
        if not self.models:
            return np.zeros((len(keys), 0), dtype=np.float32)
        return np.stack([np.log(m.probability(keys)) for m in self.models], axis=1).astype(np.float32)

    def entropies(self, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance of the negative log probability per character: text by language."""
        n, langs = len(grams.counts), len(self.names)
        sums, squares = np.zeros((n, langs)), np.zeros((n, langs))
        if len(grams.keys) and langs:
            hashes = mix(grams.keys)
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            logs = self.logs[at]
            missing = np.flatnonzero(self.hashes[at] != hashes)
            if len(missing):
                keys, inverse = np.unique(grams.keys[missing], return_inverse=True)
                logs[missing] = self.evaluate(keys)[inverse]
            full = np.flatnonzero(grams.counts)
            starts = (grams.ends - grams.counts)[full]
            sums[full] = np.add.reduceat(logs, starts, axis=0, dtype=np.float64)
            squares[full] = np.add.reduceat(logs * logs, starts, axis=0, dtype=np.float64)
        size = np.maximum(grams.counts, 1)[:, None]
        mean = -sums / size
        return mean, np.maximum(squares / size - mean * mean, 0)

    def predict(self, texts: list[bytes | None]) -> list[list]:
        out: list[list] = [[], [], [], []]
        for i, j in ranges([len(t or b"") for t in texts], 1 << 19):
            grams = Grams(texts[i:j])
            mean, _ = self.entropies(grams)
            for k, has_letter in enumerate(grams.has_letter.tolist()):
                if not has_letter or not self.names:
                    values = (UNDETERMINED, 0.0, None, True)
                else:
                    best = int(np.argmin(mean[k]))
                    n = int(grams.counts[k])
                    gaps = np.minimum((mean[k] - mean[k][best]) * n, 700.0)
                    usual, between, within = self.usual[best]
                    limit = usual + STRICTNESS * float(np.sqrt(between + within / n)) if np.isfinite(usual) else np.inf
                    entropy = float(mean[k][best])
                    values = (self.names[best], float(1 / np.exp(-gaps).sum()), entropy, bool(entropy > limit))
                for column, value in zip(out, values):
                    column.append(value)
        return out


def drawn(docs: DataFrame, rows: int) -> DataFrame:
    """Different labelled documents, at most about ``rows`` of each language, chosen by a hash of the text."""
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages among the labels")
    share: Column = F.lit(0)
    for lang, size in sizes.items():
        share = F.when(F.col("lang") == lang, min(1_000_000, rows * 1_000_000 // size + 1)).otherwise(share)
    chosen = docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share)
    # a copied text counts once; copies meet under a digest, one of each per task
    return chosen.groupBy("lang", F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text")).drop("digest")


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` of the labelled documents; counted per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0).cast(pa.binary()).to_pylist(), np.array(batch.column(1).to_pylist())
            for lang in np.unique(langs):
                mine = [texts[i] for i in np.flatnonzero(langs == lang)]
                for i, j in ranges([len(t or b"") for t in mine], 1 << 19):
                    keys, n = np.unique(Grams(mine[i:j]).keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([str(lang)] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "gram", "n"],
                    )

    return docs.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_languages(labelled: DataFrame, rows: int = TRAIN_ROWS) -> LanguageModels:
    """Models of all languages among the labelled documents (``text, lang``; null labels and texts are left out).

    Every language gets a model, from one text on: of its drawn texts every fourth in the order of a hash
    calibrates, so with fewer than four none does, and nothing is rejected as that language.  A repeated
    text counts once.  More than ``MOST_LANGUAGES`` labels are refused with a ValueError.  Very long texts are
    read whole, one at a time.
    """
    sample = drawn(labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL"), rows)
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("text", F.lit("calibrate")), "text")
    sample = written(sample.withColumn("at", F.row_number().over(by_hash)), "sample")
    calibrates = F.col("at") % CALIBRATION == 0
    counts = written(count_grams(sample.where(~calibrates)), "grams")
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for (lang,) in counts.select("lang").distinct().collect():
        own = counts.where(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(MODEL_GRAMS)
        kept = own.select("gram", "n").toArrow()
        found[lang] = (kept["gram"].to_numpy().view(np.uint64), kept["n"].to_numpy())
    models = LanguageModels(found)
    return calibrate(models, sample.where(calibrates).drop("at"))


def calibrate(models: LanguageModels, docs: DataFrame) -> LanguageModels:
    """What cross-entropies texts usually have under their own language's model."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def compute(texts):
        out: list[list] = [[], [], []]
        for i, j in ranges([len(t or b"") for t in texts], 1 << 19):
            grams = Grams(texts[i:j])
            mean, variance = shared.value.entropies(grams)
            for k, n in enumerate(grams.counts.tolist()):
                best = int(np.argmin(mean[k])) if n and models_known else None
                out[0].append(best)
                out[1].append(None if best is None else float(mean[k][best]))
                out[2].append(None if best is None else float(variance[k][best]))
        return out

    models_known = bool(models.names)
    scored = annotate(docs, "text", "best int, entropy double, variance double", compute).where("best IS NOT NULL")
    usual = scored.groupBy("best").agg(
        F.percentile_approx("entropy", [0.16, 0.5, 0.84], 10_000).alias("q"), F.avg("variance").alias("within")
    )
    for row in usual.collect():
        low, middle, high = row["q"]
        models.usual[row["best"]] = (middle, max((high - low) / 2, LEAST_SPREAD) ** 2, row["within"])
    shared.destroy()  # what predicts is handed out anew; executors need not hold both
    return models


def predict_languages(docs: DataFrame, models: LanguageModels, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred, score, cross_entropy, rejected``.

    Null texts and texts without a letter are ``und`` with score 0 and rejected, as is everything when no
    language was learned.  ``score`` is the best language's share of the likelihood; ``rejected`` says
    that the text's cross-entropy is far above what its language usually has.  Equally good languages go
    to the first by name.  Columns of ``docs`` named like a result column are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def compute(texts):
        return shared.value.predict(texts)

    return annotate(docs, text, OUTPUTS, compute)


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds


def language_report(docs: DataFrame) -> DataFrame:
    """Predictions for all documents by models of those outside the held-out fold."""
    models = fit_languages(docs.where(fold("doc_id", 5) != 0))
    held_out = docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    return predict_languages(held_out, models).select("doc_id", "held_out", "lang_pred", "score", "rejected")
