"""The language of a text: averaged embeddings of hashed subwords under a linear softmax.

A text is the mean of the embeddings of all its byte 3-grams and 4-grams (letters lower-cased,
everything else a blank), hashed into a fixed number of buckets. Embeddings and the softmax are
trained together by stochastic gradient descent in numpy, on the whole texts of a bounded sample of labelled rows;
other labelled rows calibrate the probabilities by a temperature and set the least probability
that is not rejected. A prediction depends on the text alone. Since the model is linear after
the mean, prediction looks up one row of class scores per n-gram.

Cases: a NULL text and one without a letter are `und` with score 0, rejected. Texts too short for
a 3-gram are predicted from the classes' bias. Without labelled rows every text is `und`. Rows
whose label is NULL are not learned from. Texts are read whole, however long. Repeated rows are predicted alike; equal
ids that tie for the sample are taken by their texts' checksums. An empty table gives no rows. Further
columns may have any name but those added, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from weblens.llm.text import Block, blocks, text_of

BUCKETS = 1 << 15
#: Labelled rows per language that are learned from and that calibrate, whatever the size of the input.
LEARN, CALIBRATE = 400, 200
DIMENSIONS, EPOCHS, RATE, BATCH = 16, 8, 0.5, 32
UNKNOWN = "und"
#: The share of right answers to calibration rows that the least probability may cost.
REJECTED = 0.001

_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def _grams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a block, text by text, and where each text begins in them."""
    b = _PLAIN[block.data].astype(np.uint32)
    blank = b == 0x20
    ends = np.repeat(block.offsets[1:], np.diff(block.offsets))
    buckets, texts = [], []
    for n, factor in ((3, 2654435761), (4, 2246822519)):
        if len(b) < n:
            continue
        size = len(b) - n + 1
        code = b[:size].copy()
        for k in range(1, n):
            code |= b[k:size + k] << np.uint32(8 * k)
        hashed = (code * np.uint32(factor)) >> np.uint32(32 - 15)
        keep = (np.arange(size) + n <= ends[:size]) & ~(blank[:size] & blank[1:size + 1])
        at = np.flatnonzero(keep)
        buckets.append(hashed[at].astype(np.int64) + (n - 3) * BUCKETS)
        texts.append(np.searchsorted(block.offsets, at, "right") - 1)
    if not buckets:
        return np.empty(0, np.int64), np.zeros(len(block.offsets), np.int64)
    all_texts = np.concatenate(texts)
    order = np.argsort(all_texts, kind="stable")
    return np.concatenate(buckets)[order], np.searchsorted(all_texts[order], np.arange(len(block.offsets)))


@dataclass
class Model:
    """Class scores per bucket, the bias, the temperature and the least accepted probability."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), len(self.languages)))
        for block in blocks(column):
            sums = np.zeros((block.stop - block.first, len(self.languages)))
            buckets, at = _grams(block)
            counts = np.diff(at)
            filled = np.flatnonzero(counts)
            if len(filled):
                for k in range(len(self.languages)):
                    sums[filled, k] = np.add.reduceat(self.scores[k][buckets], at[:-1][filled])
            out[block.first:block.stop] = sums / np.maximum(counts, 1)[:, None] + self.bias
        return out

    def probabilities(self, column: pa.Array) -> np.ndarray:
        return _softmax(self.logits(column) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str], seed: int = 7) -> Model:
    """Fit embeddings and softmax to texts, each its different buckets and how often each occurs, by
    stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    classes = len(languages)
    embedding = rng.normal(0, 0.1, (2 * BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = np.zeros((DIMENSIONS, classes), np.float32)
    bias = np.zeros(classes, np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for part in np.array_split(rng.permutation(len(features)), max(1, len(features) // BATCH)):
            bags = [features[i][0] for i in part]
            lengths = [len(x) for x in bags]
            flat = np.concatenate(bags)
            # A text is the mean over all its n-grams: a bucket weighs as often as it occurs.
            shares = np.concatenate([features[i][1] / max(1, features[i][1].sum()) for i in part]).astype(np.float32)[:, None]
            begin = np.cumsum([0, *lengths])[:-1]
            filled = np.array([n > 0 for n in lengths])
            mean = np.zeros((len(bags), DIMENSIONS), np.float32)
            if len(flat):
                mean[filled] = np.add.reduceat(embedding[flat] * shares, begin[filled])
            error = _softmax(mean @ weights + bias)
            error[np.arange(len(part)), labels[part]] -= 1
            error = error.astype(np.float32)
            # n-grams of a text share its gradient; hot ones add up over the batch.
            back = (error @ weights.T) * np.float32(rate * 50)
            np.subtract.at(embedding, flat, np.repeat(back, lengths, axis=0) * shares)
            weights -= rate * 20 * mean.T @ error / len(part)
            bias -= rate * 0.1 * error.mean(axis=0)
    return Model(languages, np.ascontiguousarray((embedding @ weights).T.astype(np.float32)), bias.astype(float))


def calibrate(model: Model, logits: np.ndarray, labels: np.ndarray) -> Model:
    """Set temperature and least probability from logits of rows that were not learned from."""
    if len(labels):
        def loss(t: float) -> float:
            return -float(np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean())

        model.temperature = min(np.geomspace(0.05, 20, 60), key=loss)
        best = _softmax(logits / model.temperature)
        right = best.max(axis=1)[best.argmax(axis=1) == labels]
        if len(right):
            model.least = min(0.5, float(np.quantile(right, REJECTED)))
    return model


def _fold(docs: DataFrame) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))


def fit(docs: DataFrame) -> Model | None:
    """A model from the rows of `docs` (doc_id, text, lang) whose fold, crc32(doc_id) mod 5, is not 0.

    Fold 4 calibrates, the others are learned from. Of each language the rows with the least
    hashes are taken, at most LEARN and CALIBRATE; None without any.
    """
    fold = _fold(docs)
    known = docs.select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), (fold == 4).alias("check"),
        F.xxhash64(F.lit("sample"), "doc_id").alias("h"),
    ).where((fold != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {(r.lang, r.check): r.n for r in known.groupBy("lang", "check").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted({lang for lang, _ in counts})
    # A hash below a bound leaves about twice the rows that are wanted; the least of them count.
    share = F.lit(0.0)
    for (lang, check), n in counts.items():
        most = CALIBRATE if check else LEARN
        share = F.when((F.col("lang") == lang) & (F.col("check") == check), F.lit(min(1.0, (2 * most + 50) / n))).otherwise(share)
    uniform = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    turn = F.row_number().over(Window.partitionBy("lang", "check").orderBy("h", F.crc32(F.col("text").cast("binary"))))
    chosen = known.where(uniform < share).withColumn("turn", turn).where(
        F.col("turn") <= F.when(F.col("check"), CALIBRATE).otherwise(LEARN))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for block in blocks(batch.column("text")):
                buckets, at = _grams(block)
                for low, high in zip(at[:-1], at[1:]):
                    out.append(np.stack(np.unique(buckets[low:high], return_counts=True)).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("h"), pa.array(out, pa.binary())], ["lang", "h", "bag"])

    learned = sorted(chosen.where("not check").select("lang", "h", "text").mapInArrow(
        bags, "lang string, h long, bag binary").collect())
    place = {lang: i for i, lang in enumerate(languages)}
    features = [tuple(np.frombuffer(r.bag, np.int32).reshape(2, -1).astype(np.int64)) for r in learned]
    model = train(features, np.array([place[r.lang] for r in learned], np.int64), languages)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.logits(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array(list(found), pa.list_(pa.float64()))], ["lang", "logits"])

    checked = chosen.where("check").select("lang", "text").mapInArrow(logits, "lang string, logits array<double>").collect()
    return calibrate(
        model, np.array([r.logits for r in checked]).reshape(-1, len(languages)),
        np.array([place[r.lang] for r in checked], np.int64))


ADDED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def _told(docs: DataFrame, model: Model | None) -> DataFrame:
    """row (all columns), lang_pred, score and rejected."""
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    if model is None:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    schema = T.StructType([rows.schema["row"], *ADDED.fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages, dtype=object)
        for batch in batches:
            some = np.asarray(batch.column("letter"))
            odds = model.probabilities(text_of(batch))
            score = np.where(some, odds.max(axis=1), 0.0)
            language = np.where(some, names[odds.argmax(axis=1)], UNKNOWN)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(language, pa.string()), pa.array(score), pa.array(~some | (score < model.least))],
                names=schema.names)

    return rows.mapInArrow(task, schema)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with lang_pred, score (the calibrated probability) and rejected, of like-named
    columns the only ones that stay."""
    return _told(docs, model).select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in ADDED.names), *ADDED.names)


def identified_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each row."""
    thin = docs.select("doc_id", F.coalesce(_fold(docs) == 0, F.lit(False)).alias("held_out"), "text")
    return identify(thin, fit(docs)).drop("text")


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The rows whose language is told with enough certainty, columns unchanged."""
    return _told(docs, fit(docs)).where("not rejected").select("row.*")
