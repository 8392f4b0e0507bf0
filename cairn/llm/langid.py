"""Language identification: averaged hashed subword embeddings with a linear softmax.

Features are hashed byte n-grams (two to four bytes) of the lower-cased text, with every run of
characters that are neither letters nor beyond ASCII as one space. A text is the mean of its n-gram
embeddings; a linear softmax over the languages follows. Embeddings and weights are trained together
by stochastic gradient descent in numpy on a bounded sample of labelled rows, balanced over the
languages. A part of the sample that isn't trained on sets the temperature of the scores and the
score below which a prediction counts as rejected. For predictions of few languages, embeddings and weights fold
into one table of n-gram scores; for more than ``DIMENSION`` the embeddings stay, so the table's size depends on the
buckets only.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, as is everything if no
row is labelled. Texts are read whole; only training takes evenly spaced n-grams of a long text. Ties
go to the language that comes first in order. Repeated rows give repeated results, an empty table an
empty one. A null ``doc_id`` counts as neither held out nor trained on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import table
from cairn.sources.scratch import cut_lineage

BUCKET_BITS = 15
DIMENSION = 16
#: Bounds of the training sample: labelled rows in all, n-grams of one text.
SAMPLE_ROWS = 3000
SAMPLE_GRAMS = 4096
EPOCHS = 5
#: Step of a text's mean embedding and of the weights; it falls to zero over the epochs.
RATE = 0.3
ACCEPTED_ACCURACY = 0.99
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def _clean_table() -> np.ndarray:
    kept = [b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)]
    return np.array(kept, np.uint8)


CLEAN = _clean_table()


def grams(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text, orders one after the other."""
    raw = CLEAN[np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)]
    raw = raw[np.r_[True, (raw[1:] != 32) | (raw[:-1] != 32)]].astype(np.uint32)
    found, code = [], raw
    for order in range(1, 4):
        code = code[: len(raw) - order] * np.uint32(256) + raw[order:]
        found.append(
            (code * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
            + ((order - 1) << BUCKET_BITS)
        )
    return np.concatenate(found)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # by bucket, and by language or by dimension of the embedding
    weight: np.ndarray | None  # by language and dimension where that is the smaller form
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, buckets: np.ndarray, share: np.ndarray | None = None) -> np.ndarray:
        rows = self.scores[buckets]
        mean = rows.mean(0, dtype=np.float64) if share is None else share @ rows
        return (mean if self.weight is None else self.weight @ mean) + self.bias

    def parts(self) -> tuple:
        """Plain values, which a worker without this package can read: ``Model(*parts)``."""
        return self.languages, self.scores, self.weight, self.bias, self.temperature, self.least

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not LETTER.search(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(grams(text)) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def descend(table_: np.ndarray, weight: np.ndarray, bias: np.ndarray, text: tuple, rate: float) -> None:
    """One step down the cross entropy of one text (language number, different buckets, their shares), in place.

    The step of the embeddings is scaled so that their mean moves by ``rate`` times its slope.
    """
    y, index, share = text
    rows = table_[index]
    x = share @ rows
    slope = softmax(weight @ x + bias)
    slope[y] -= 1
    back = weight.T @ slope
    weight -= rate * np.outer(slope, x)
    bias -= rate * slope
    table_[index] = rows - (rate / float(share @ share)) * share[:, None] * back


def train(samples: list[tuple[int, np.ndarray]], languages: list[str], seed: int = 7) -> Model:
    """Fit on (language number, buckets) pairs; every fifth one calibrates."""
    rng = np.random.default_rng(seed)
    n = len(languages)
    table_ = rng.uniform(-1, 1, (3 << BUCKET_BITS, DIMENSION)).astype(np.float32) / DIMENSION
    weight = np.zeros((n, DIMENSION), np.float32)
    bias = np.zeros(n, np.float32)
    prepared = []
    for y, buckets in samples:
        if not len(buckets):
            continue
        index, count = np.unique(buckets, return_counts=True)
        prepared.append((y, index, (count / count.sum()).astype(np.float32)))
    held = [s for k, s in enumerate(prepared) if k % 5 == 4]
    fit = [s for k, s in enumerate(prepared) if k % 5 != 4] or prepared
    done, total = 0, EPOCHS * len(fit)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(fit)):
            descend(table_, weight, bias, fit[k], RATE * (1 - done / total))
            done += 1
    fold = n <= DIMENSION
    model = Model(languages, table_ @ weight.T if fold else table_, None if fold else weight, bias)
    logits = np.array([model.logits(i, s) for _, i, s in held]) if held else np.zeros((0, n))
    truth = np.array([y for y, _, _ in held], int)
    if len(truth):
        losses = {
            t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
            for t in np.geomspace(0.1, 10, 41)
        }
        model.temperature = float(min(losses, key=losses.get))
        p = softmax(logits / model.temperature)
        top, right = p.max(1), p.argmax(1) == truth
        order = np.argsort(-top)
        accuracy = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(accuracy >= ACCEPTED_ACCURACY)
        model.least = float(top[order][good[-1]]) if len(good) else 1.0
    return model


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Train on about ``rows`` rows of (text, lang), as many different texts of each language.

    A language gets at least one text, so ``rows`` bounds the sample as long as it isn't below the number of
    languages. The sample follows a hash of the text, so it doesn't depend on partitions or retries; of equal
    texts it takes one.
    """
    drawn = F.xxhash64("text", F.lit(11)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    known = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", drawn.alias("drawn"))
    # Estimated to a few per cent, which the wider draw covers.
    sizes = cut_lineage(known.groupBy("lang").agg(F.approx_count_distinct("drawn", 0.02).alias("texts")))
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())
    if not languages:
        return Model([], np.zeros((1, 0)), None, np.zeros(0))
    each = max(1, rows // len(languages))
    width = F.least(F.lit(1.0), (each + 4 * each**0.5) * 1.2 / F.col("texts"))
    order = Window.partitionBy("lang").orderBy("drawn")
    sample = (
        known.join(sizes.select("lang", width.alias("width")), "lang")
        .filter("drawn < width")
        .groupBy("lang", "drawn")
        .agg(F.min("text").alias("text"))
        .withColumn("at", F.row_number().over(order))
        .filter(F.col("at") <= each)
        .select("lang", "text", "drawn")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                buckets = grams(text)
                step = max(1, -(-len(buckets) // SAMPLE_GRAMS))
                found.append(buckets[::step].copy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))],
                names=["lang", "drawn", "buckets"],
            )

    got = sample.mapInArrow(run, "lang string, drawn double, buckets array<int>").toArrow()
    number = {x: k for k, x in enumerate(languages)}
    order = np.lexsort((got["lang"].to_numpy(zero_copy_only=False).astype(str), got["drawn"].to_numpy()))
    langs, buckets = got["lang"].to_pylist(), got["buckets"].combine_chunks()
    return train([(number[langs[k]], buckets[k].values.to_numpy()) for k in order.tolist()], languages)


def predict(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of every row."""
    sent = df.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([x for x, _ in found], pa.string()),
                    pa.array([p for _, p in found], pa.float64()),
                    pa.array([x != UNKNOWN and p >= model.least for x, p in found], pa.bool_()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean"
    )


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train_on = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return predict(docs, fit(train_on.select("text", "lang")))
