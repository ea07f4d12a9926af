"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's features are the hashed byte n-grams of the whole text, A-Z lower-cased. The model averages one
embedding for each n-gram and applies a linear softmax; both are trained by stochastic gradient descent in
numpy, on whole texts and on random excerpts of them, so that short texts are learned too. A second part of
the sample calibrates: a temperature for the probabilities, and the score below which a text is rejected.

As averaging and the linear layer commute, workers hold one table of class scores for each n-gram (of
embeddings, where there are more languages than dimensions). The model learns from a sample of SAMPLE_ROWS
texts; every text is read whole for its prediction.

Rows with null text or without a letter get `und`, score 0 and are rejected. Null languages aren't learned;
without any labelled text every prediction is `und`. Null and repeated identifiers are kept, a row for each
row; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from . import _common

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
DIMENSIONS = 16
#: Bounds of the sample: its rows over all languages together (each language gets about an equal share at
#: most), the characters of a text, and the n-grams of a training step.
SAMPLE_ROWS, SAMPLE_CHARS, STEP_NGRAMS = 6_000, 20_000, 4_096
#: Share of calibration texts that may score below the rejection threshold.
REJECTED_SHARE = 0.0005
ASCII_LETTER = re.compile("[A-Za-z]")
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))


def has_letter(text: str) -> bool:
    return ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text))


def ngrams(text: str) -> np.ndarray:
    """Bucket of every byte n-gram of the whole text."""
    b = np.frombuffer(b" " + text.encode().lower() + b" ", dtype=np.uint8).astype(np.uint32)
    h, out = b.copy(), []
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * _MULTIPLIERS[0] + b[n - 1 :] * _MULTIPLIERS[n - 1 & 3] + np.uint32(n)
        if not len(h):
            break
        if n in ORDERS:
            out.append((h ^ (h >> np.uint32(15))) * _MULTIPLIERS[1] >> np.uint32(32 - 16))
    return np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: class scores of an n-gram; or its embedding, where that is shorter
    bias: np.ndarray
    temperature: float
    reject_below: float
    weights: np.ndarray | None = None  # DIMENSIONS x languages, with embeddings

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), len(self.languages)), dtype=np.float64)
        for k, x in enumerate(texts):
            grams = ngrams(x)
            total = np.zeros(self.table.shape[1])
            for i in range(0, len(grams), 1 << 18):
                total += self.table[grams[i : i + (1 << 18)]].sum(axis=0, dtype=np.float64)
            mean = total / len(grams)
            out[k] = (mean if self.weights is None else mean @ self.weights) + self.bias
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        return [self.languages[k] for k in best], p[np.arange(len(best)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 1, epochs: int = 2, rate: float = 40.0, step_ngrams: int = STEP_NGRAMS) -> Model:
    """Embeddings and softmax by SGD; one fifth of the texts is held back for calibration."""
    languages = sorted(set(labels))
    if len(languages) < 2:
        return Model(languages or ["und"], np.zeros((BUCKETS, 1), dtype=np.float32), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels])
    order = rng.permutation(len(texts))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]

    def excerpt(text: str) -> str:
        n = int(rng.integers(20, 400))
        at = int(rng.integers(0, max(1, len(text) - n)))
        return text[at : at + n]

    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, len(languages)), dtype=np.float32), np.zeros(len(languages), dtype=np.float32)
    steps, step = 3 * epochs * len(fit), 0
    for _ in range(epochs):
        for k in rng.permutation(fit):
            for x in (texts[k], excerpt(texts[k]), excerpt(texts[k])):
                lr = 1 - step / steps
                step += 1
                if not has_letter(x):
                    continue
                grams = ngrams(x)
                if len(grams) > step_ngrams:  # drawn from the whole text
                    grams = rng.choice(grams, step_ngrams, replace=False)
                mean = embed[grams].mean(axis=0)
                p = softmax((mean @ weights + bias)[None].astype(np.float64))[0]
                p[y[k]] -= 1
                p = p.astype(np.float32)
                back = weights @ p
                weights -= 0.5 * lr * np.outer(mean, p)
                bias -= 0.05 * lr * p
                np.subtract.at(embed, grams, (rate * lr / len(grams)) * back)
    model = Model(languages, embed, bias.astype(np.float64), 1.0, 0.0, weights)
    if len(languages) <= DIMENSIONS:
        model.table, model.weights = (embed @ weights).astype(np.float32), None
    sure = [k for k in held if has_letter(texts[k])]
    if sure:
        z = model.logits([texts[k] for k in sure] + [excerpt(texts[k]) or texts[k] for k in sure])
        true = np.concatenate([y[sure], y[sure]])
        grid = np.geomspace(0.05, 10, 40)
        model.temperature = float(min(grid, key=lambda t: -np.log(softmax(z / t)[np.arange(len(true)), true] + 1e-12).mean()))
        scores = softmax(z[: len(sure)] / model.temperature).max(axis=1)
        # Reject only what scores lower than (nearly) all texts of known language, and is no clear majority.
        model.reject_below = float(min(np.quantile(scores, REJECTED_SHARE), 0.5))
    return model


def fold(id_col: str, of: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of))


def sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str]]:
    """`rows` labelled texts at most, about an equal share of each language, chosen by a hash.

    Of equal texts of a language one counts. Of a longer text an excerpt of `chars` characters at a place given
    by the hash is taken, so that the driver gets rows * chars characters at most.
    """
    own = docs.select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), F.xxhash64(text_col, label_col, F.lit(11)).alias("h"))
    labelled = own.where("label is not null and text is not null")
    sizes = _common.written(labelled.groupBy("label").agg(F.count("*").alias("n")), f"{_common.work_dir(docs.sparkSession)}/labels")
    languages = sizes.count()
    if not languages:
        return [], []
    share = max(1.0, rows / languages)
    # Languages are few or else small beside the rows: adaptive execution broadcasts them by their size.
    fitting = labelled.join(sizes, "label").where(F.pmod("h", F.lit(1 << 30)) < F.lit(float(1 << 30)) * F.least(F.lit(1.0), share / F.col("n")))
    at = F.pmod(F.shiftright("h", 20), F.greatest(F.lit(1), F.char_length("text") - chars + 1)).cast("int") + 1
    one = fitting.select("h", "label", F.when(F.char_length("text") > chars, F.substring("text", at, F.lit(chars))).otherwise(F.col("text")).alias("text"))
    got = one.dropDuplicates(["h", "label"]).orderBy("h", "label").limit(rows).toPandas()
    return got["text"].tolist(), got["label"].tolist()


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    folds: int = 4,
    held_fold: int = 2,
) -> DataFrame:
    """identifier, held_out, lang_pred, score, accepted; the model learns from the other folds only."""
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(label_col).alias("_label"))
    language = recognised(own, "_id", "_text", "_label", folds, held_fold)
    out = own.select("_id", language(F.col("_text")).alias("_found"))
    return out.select(F.col("_id").alias(id_col), F.coalesce(fold("_id", folds) == held_fold, F.lit(False)).alias("held_out"), "_found.*")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The rows of docs whose language the model accepts, with their own columns."""
    language = recognised(docs, id_col, text_col, label_col)
    return docs.where(language(F.col(text_col))["accepted"])


_FOUND = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("accepted", BooleanType())])


def recognised(docs: DataFrame, id_col: str, text_col: str, label_col: str, folds: int = 4, held_fold: int = 2):
    """Learns from docs; returns what gives (lang_pred, score, accepted) of a text column."""
    spark = docs.sparkSession
    _common.shipped(spark)
    held = F.coalesce(fold(id_col, folds) == held_fold, F.lit(False))
    # The table of scores has the lesser of DIMENSIONS and the languages as its width.
    shared = spark.sparkContext.broadcast(train(*sample(docs.where(~held), id_col, text_col, label_col)))

    @F.arrow_udf(_FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _common.worker_memory("language_id")
        m = shared.value
        for batch in batches:
            names, scores, taken = [], [], []
            for _, part in _common.text_parts(pa.RecordBatch.from_arrays([batch], ["text"]), 0):
                have = [k for k, x in enumerate(part) if x and has_letter(x)]
                name, score, good = ["und"] * len(part), np.zeros(len(part)), np.zeros(len(part), dtype=bool)
                if have:
                    best, p = m.predict([part[k] for k in have])
                    score[have], good[have] = p, p >= m.reject_below
                    for k, x in zip(have, best):
                        name[k] = x
                names += name
                scores.append(score)
                taken.append(good)
            flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), flat(scores, pa.float64()), flat(taken, pa.bool_())], _FOUND.names)
        _common.trim()

    return run


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "held_out", "lang_pred", "score", "accepted")
