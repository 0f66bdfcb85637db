"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text's words (runs of letters) give their character n-grams, with word bounds; each n-gram hashes to a row of an
embedding table; the mean of the rows goes through a linear softmax. The model is fitted in one task from a bounded
sample of labelled rows; prediction reads every whole text on the executors. The confidence is calibrated by a
temperature, and texts below a calibrated threshold can be rejected.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, free_name, join, mix, pieces

#: Bounds of the training sample: rows (or one for each language, if those are more), and characters of each row.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 1000
BUCKETS, DIM, GRAMS = 1 << 15, 16, (1, 2, 3, 4)
EPOCHS, LEAST_STEPS, RATE, BATCH = 4, 300, 8.0, 64
#: Share of rightly predicted calibration rows that rejection may cost, and the highest threshold.
REJECTED, HIGHEST = 0.002, 0.5
UNKNOWN = "und"
#: Words kept by a Python worker, and the longest that is.
CACHE, CACHE_LEN = 500_000, 40

LETTERS = re.compile(r"[^\W\d_]+").findall


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, with word bounds, and the word (its place) of each, in order of the words.

    A long word is taken in parts of CACHE_LEN, each with bounds of its own.
    """
    parts, owner = [], []
    for i, w in enumerate(words):
        for a in range(0, len(w), CACHE_LEN):
            parts.append(f"<{w[a : a + CACHE_LEN]}>")
            owner.append(i)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    one = mix(np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64))
    part = np.repeat(np.arange(len(parts)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(one))  # characters of the part from here on
    two = join(one[:-1], one[1:])
    runs = {1: one, 2: two, 3: join(two[:-1], one[2:]), 4: join(two[:-2], two[2:])}
    buckets, of = [], []
    for n in GRAMS:
        some = np.flatnonzero(left[: len(runs[n])] >= n)
        buckets.append((runs[n][some] >> np.uint64(20)) % np.uint64(BUCKETS))
        of.append(part[some])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.concatenate(buckets).astype(np.int64)[order], np.array(owner, np.int64)[of[order]]


@dataclass
class LanguageModel:
    """labels; table: for each bucket, its embedding times the softmax weights; bias; temperature; threshold."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def predictor(self) -> Predictor:
        return Predictor(self)


class Predictor:
    """Remembers, for each word, the row in which the sum of its n-grams' logits and their number stand."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.labels) + 1))

    def learn(self, new: list[str]) -> None:
        bucket, of = grams(new)
        begin = np.flatnonzero(np.diff(of, prepend=-1))  # every word has an n-gram
        sums = np.add.reduceat(self.model.table[bucket], begin)
        n = np.diff(np.append(begin, len(of)))
        self.at.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, np.column_stack([sums, n])])

    def many(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and confidence of each text: UNKNOWN and 0 if it has no letter, or if nothing could be learned."""
        words = [LETTERS(t.lower()) if t and self.model.labels else [] for t in texts]
        words = [w if any(c.isalpha() for x in w for c in x) else [] for w in words]
        out = [(UNKNOWN, 0.0)] * len(texts)
        own = [i for i, w in enumerate(words) if w]
        if not own:
            return out
        every = [w for i in own for w in words[i]]
        distinct = dict.fromkeys(every)
        new = [w for w in distinct if w not in self.at]
        if len(self.rows) + len(new) > CACHE:
            self.__init__(self.model)
            new = list(distinct)
        if new:
            self.learn(new)
        rows = self.rows[np.fromiter(map(self.at.__getitem__, every), np.int64, len(every))]
        for w in [w for w in new if len(w) > CACHE_LEN]:
            del self.at[w]
        sizes = np.array([len(words[i]) for i in own])
        total = np.add.reduceat(rows, np.cumsum(sizes) - sizes)
        p = softmax((total[:, :-1] / total[:, -1:] + self.model.bias) / self.model.temperature)
        for i, k, row in zip(own, p.argmax(1).tolist(), p, strict=True):
            out[i] = (self.model.labels[k], float(row[k]))
        return out

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.many([text])[0]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 5) -> LanguageModel:
    """Fit on texts: each gives its whole and some short spans, so that short texts are learned too."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    spans, target = [], []
    for t, lang in zip(texts, langs, strict=True):
        words = LETTERS(t.lower())
        if not words:
            continue
        cuts = [(0, len(words))]
        for size in (2, 6):
            at = int(rng.integers(0, max(1, len(words) - size + 1)))
            cuts.append((at, at + size))
        for a, b in cuts:
            spans.append(words[a:b])
            target.append(labels.index(lang))
    if not spans:
        return LanguageModel(labels if len(labels) == 1 else [], np.zeros((BUCKETS, len(labels))), np.zeros(len(labels)))
    distinct = list(dict.fromkeys(w for s in spans for w in s))
    bucket, of = grams(distinct)
    known = dict(zip(distinct, np.split(bucket.astype(np.uint16), np.flatnonzero(np.diff(of)) + 1), strict=True))
    data = [np.concatenate([known[w] for w in s]) for s in spans]  # two bytes an n-gram
    del distinct, bucket, of, known, spans
    y = np.array(target)
    order = rng.permutation(len(data))
    held, fit = order[: len(data) // 5], order[len(data) // 5 :]
    fit = fit if len(fit) else order
    e = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    w, b = np.zeros((DIM, len(labels))), np.zeros(len(labels))
    each = -(-len(fit) // BATCH)
    epochs = max(EPOCHS, LEAST_STEPS // each)
    steps, step = epochs * each, 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for i in range(0, len(fit), BATCH):
            some = fit[i : i + BATCH]
            flat = np.concatenate([data[k] for k in some])
            sizes = np.array([len(data[k]) for k in some])
            mean = np.add.reduceat(e[flat], np.cumsum(sizes) - sizes) / sizes[:, None]
            g = softmax(mean @ w + b)
            g[np.arange(len(some)), y[some]] -= 1
            rate = RATE * (1 - step / steps)
            back = g @ w.T / sizes[:, None]
            w -= rate / len(some) * mean.T @ g
            b -= rate / len(some) * g.sum(0)
            np.add.at(e, flat, np.repeat(-rate * back / len(some), sizes, 0))
            step += 1
    model = LanguageModel(labels, e @ w, b)
    if len(held):
        z = np.stack([model.table[data[k]].mean(0) + b for k in held])
        loss = {t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in np.geomspace(0.2, 5, 30)}
        model.temperature = min(loss, key=loss.get)
        p = softmax(z / model.temperature)
        right = p.max(1)[p.argmax(1) == y[held]]
        model.threshold = float(min(HIGHEST, np.quantile(right, REJECTED))) if len(right) else 0.0
    return model


def fold(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 5


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> LanguageModel:
    """Fit from labelled rows outside the held-out fold.

    At most `rows` rows, spread over all languages (one row each, if those are more), with `chars` characters from a
    random place of each. The rows are those with the smallest hashes of their keys, so that reruns agree.
    """
    labelled = docs.select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").where(fold("k") != 0)
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row per language
    if not counts:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    each = max(1, rows // len(counts))
    u = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit("sample")), F.lit(1 << 30))
    wanted = 1.5 * each + 10  # more than each, for chance
    shares = docs.sparkSession.createDataFrame([(r.lang, float(1 << 30) * min(1.0, wanted / r.n)) for r in counts], "lang string, share double")
    room = F.greatest(F.length("text") - chars, F.lit(0)) + 1
    span = F.substring("text", (F.pmod(u, room) + 1).cast("int"), F.lit(chars))
    drawn = labelled.join(F.broadcast(shares), "lang").where(u < F.col("share"))
    sample = drawn.select("lang", span.alias("text"), u.alias("u"), "k", (u / F.col("share")).alias("nth"))
    sample = sample.orderBy("nth", "u", "k", "lang", "text").limit(2 * int(wanted * len(counts))).select("lang", "text")

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[str, list[str]] = {}
        for b in batches:
            for k, t in zip(b["lang"], b["text"]):
                by.setdefault(k, []).append(t)
        pairs = [(t, k) for k in sorted(by) for t in by[k][:each]]
        yield pd.DataFrame({"model": [pickle.dumps(train([t for t, _ in pairs], [k for _, k in pairs]))]})

    # The sample has a bound, so one task holds it; the driver gets the model alone.
    return pickle.loads(sample.coalesce(1).mapInPandas(fitted, "model binary").first()[0])


def identified(docs: DataFrame, model: LanguageModel, out: str, text: str = "text") -> DataFrame:
    """docs with a column `out` of lang_pred, score (calibrated confidence, 0 to 1) and rejected.

    A null text, or one without a letter, is `und` with score 0, and rejected; so is every text if nothing could be
    learned. Any other text has a learned language, and is rejected if its score is below the model's threshold.
    Whole texts count, however long; rows are judged one by one. Other columns pass through unchanged.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    held = spark.sparkContext.broadcast(model)  # a table of fixed rows and a column per language

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor, least = held.value.predictor(), held.value.threshold
        for batch in texts:
            rows = [x for piece in pieces(zip(batch), 0) for x in predictor.many([t for (t,) in piece])]
            found = pd.DataFrame(rows, columns=["lang_pred", "score"])
            yield found.assign(rejected=(found["lang_pred"] == UNKNOWN) | (found["score"] < least))

    return docs.withColumn(out, predict(F.col(text)))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with the columns lang_pred, score and rejected of identified(); columns of these names are replaced."""
    held = free_name(docs, "language")
    return identified(docs, model, held, text).withColumns({c: F.col(f"{held}.{c}") for c in ("lang_pred", "score", "rejected")}).drop(held)


def without_rejected(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of docs that identified() doesn't reject, with their own columns, whatever their names."""
    held = free_name(docs, "language")
    return identified(docs, model, held, text).where(f"NOT {held}.rejected").drop(held)
