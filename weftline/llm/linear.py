"""Text classifiers: logistic regression over hashed word n-grams, fitted by FTRL-proximal.

Texts are cut into runs of letters and digits and runs of other marks. Word n-grams and skip-grams
are hashed to 64 bits; a word right after itself is hashed as a sign of repetition, so that invented
words that repeat are told from others. FTRL keeps a learning rate for each coordinate and its L1 term
leaves few weights, which are sorted by hash and broadcast: scoring looks the hashes of a text up in
them and sums, a sparse dot product.

Learning takes at most ``sample`` different labelled rows with at most ``letters`` letters together
(those with the smallest hash of their id, so the choice does not depend on partitions; whole texts,
and the first one whatever its length) and never rows held out. It runs in one task, whose memory the
two bounds bound; the weights alone reach the driver. Scoring reads all rows in place, without a shuffle.

Edge cases: null and empty texts get the score of the bias alone; null ids are held out; rows without a
label or with a null label teach nothing; where no row can be learnt from, all scores are 0.5; repeated
rows get the same score and teach once; texts of any length are scored whole; an empty table gives no rows; texts, lang, source and ids are never features.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut, prepare

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
#: Rows and letters that are learnt from at most.
SAMPLE, LETTERS = 8000, 26_000_000
#: Token hashes that a worker keeps.
CACHE = 120_000
AGAIN = np.uint64(0x5851F42D4C957F2D)
MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
BIAS = np.uint64(1)


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        found = xxhash.xxh64_intdigest(token)
        if len(self) < CACHE:
            self[token] = found
        return found


_KNOWN = _Hashes()
_STEMS: dict[int, _Hashes] = {}


@dataclass(frozen=True)
class Features:
    """What a text is turned into.

    grams: lengths of n-grams. skips: distances of the two words of a skip-gram. stems: numbers of
    first letters that are hashed as words of their own, so that inflected words share a feature. presence: whether a
    feature counts once a text, however often it occurs; else its value is the root of its share.
    """

    grams: tuple[int, ...] = (1, 2)
    skips: tuple[int, ...] = ()
    stems: tuple[int, ...] = ()
    presence: bool = False
    lower: bool = True

    def keys(self, text: str | None) -> np.ndarray:
        """Hashes of all occurrences of all features of a text."""
        text = text or ""
        tokens = TOKEN.findall(text.lower() if self.lower else text)
        if len(_KNOWN) >= CACHE:
            _KNOWN.clear()
        h = np.fromiter(map(_KNOWN.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        if len(h) > 1:
            h[1:][h[1:] == h[:-1]] = AGAIN
        parts = []
        for n in self.grams:
            if len(h) >= n:
                made = h[: len(h) - n + 1] * MIX[0]
                for i in range(1, n):
                    made = (made ^ (made >> np.uint64(29))) * MIX[1] + h[i : len(h) - n + 1 + i]
                parts.append(made * MIX[2] + np.uint64(n))
        for d in self.skips:
            if len(h) > d:
                made = (h[:-d] * MIX[3] ^ (h[:-d] >> np.uint64(31))) + h[d:]
                parts.append(made * MIX[1] + np.uint64(64 + d))
        for n in self.stems:
            cut = _STEMS.setdefault(n, _Hashes())
            if len(cut) >= CACHE:
                cut.clear()
            h = np.fromiter((cut[t[:n]] for t in tokens if len(t) >= n), dtype=np.uint64)
            parts.append(h * MIX[3] + np.uint64(128 + n))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def values(self, counts: np.ndarray, total: int) -> np.ndarray:
        return np.ones(len(counts)) if self.presence else np.sqrt(counts / max(1, total))


@dataclass(frozen=True)
class Ftrl:
    """FTRL-proximal: per-coordinate rates from the sums of squared gradients, L1 and L2."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    epochs: int = 4
    least_docs: int = 3

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """rows: distinct hashes and values of each text. Returns sorted hashes and their weights."""
        if not rows:
            return np.zeros(0, np.uint64), np.zeros(0)
        every = np.concatenate([k for k, _ in rows])
        every.sort()
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        often = np.diff(np.append(first, len(every))) >= self.least_docs
        every = every[first[often]]
        every = np.append(every[every != BIAS], BIAS)
        every.sort()
        bias = int(np.searchsorted(every, BIAS))
        z, n = np.zeros(len(every)), np.zeros(len(every))
        l1 = np.full(len(every), self.l1)
        l1[bias] = 0
        data = []
        for keys, values in rows:
            at = np.minimum(np.searchsorted(every, keys), len(every) - 1)
            ok = every[at] == keys
            data.append((np.append(at[ok], bias).astype(np.int32), np.append(values[ok], 1.0).astype(np.float32)))
        order = np.random.default_rng(11)
        for _ in range(self.epochs):
            for i in order.permutation(len(data)):
                at, x = data[i]
                w = self._weights(z[at], n[at], l1[at])
                p = 1 / (1 + math.exp(-min(35.0, max(-35.0, float(w @ x)))))
                g = (p - labels[i]) * x
                sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / self.alpha
                z[at] += g - sigma * w
                n[at] += g * g
        w = self._weights(z, n, l1)
        return every[w != 0], w[w != 0]

    def _weights(self, z: np.ndarray, n: np.ndarray, l1: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))


class Model:
    """Sorted hashes, their weights, and a table of the hashes' last bits that turns most away."""

    BITS = np.uint64((1 << 20) - 1)

    def __init__(self, features: Features, keys: np.ndarray, weights: np.ndarray) -> None:
        self.features = features
        self.bias = float(weights[keys == BIAS].sum())
        self.keys, self.weights = keys[keys != BIAS], weights[keys != BIAS]
        self.maybe = np.zeros(int(self.BITS) + 1, dtype=bool)
        self.maybe[self.keys & self.BITS] = True

    def score(self, text: str | None) -> float:
        keys = self.features.keys(text)
        total = len(keys)
        keys = keys[self.maybe[keys & self.BITS]]
        s = self.bias
        if len(keys) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            at, counts = np.unique(at[self.keys[at] == keys], return_counts=True)
            s += float(self.weights[at] @ self.features.values(counts, total))
        return 1 / (1 + math.exp(-min(35.0, max(-35.0, s))))


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label: str, features: Features, ftrl: Ftrl, *, sample: int = SAMPLE, letters: int = LETTERS, text: str = "text", key: str = "doc_id") -> Model:
    """Learn ``label`` from rows that are not held out."""
    prepare(docs.sparkSession)
    taught = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    some = taught.orderBy(F.xxhash64(key), key).limit(sample)
    turn = F.xxhash64(key, text).alias("turn")
    known = docs.select(key, text).join(F.broadcast(some), key).select(key, "label", turn, F.coalesce(F.length(text), F.lit(0)).cast("long").alias("size")).distinct()
    # at most ``sample`` rows of four numbers
    order = (F.xxhash64(key), F.col("turn"))
    before = F.sum("size").over(Window.orderBy(*order)) - F.col("size")
    chosen = cut(known.orderBy(*order).limit(sample).withColumn("before", before).filter((F.col("before") + F.col("size") <= letters) | (F.col("before") == 0)).select(key, "label", "turn"))
    found = docs.select(key, text, turn).join(F.broadcast(chosen), [key, "turn"])
    rows = found.groupBy("turn", "label").agg(F.min(text).alias(text))

    def extract(batches):
        for batch in batches:
            made = [np.unique(features.keys(t), return_counts=True) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "turn": batch.column(0),
                    "label": batch.column(1),
                    "keys": pa.array([k.tobytes() for k, _ in made], pa.binary()),
                    "amounts": pa.array([features.values(c, int(c.sum())).astype("<f4").tobytes() for _, c in made], pa.binary()),
                }
            )

    def learn(batches):
        turns, taught, data = [], [], []
        for batch in batches:
            turns += batch.column(0).to_pylist()
            taught += batch.column(1).to_pylist()
            data += [(np.frombuffer(k, dtype=np.uint64), np.frombuffer(v, dtype="<f4")) for k, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        order = sorted(range(len(turns)), key=lambda i: (turns[i], taught[i]))
        keys, weights = ftrl.fit([data[i] for i in order], [taught[i] for i in order])
        yield pa.RecordBatch.from_pydict({"keys": pa.array([keys.tobytes()], pa.binary()), "weights": pa.array([weights.tobytes()], pa.binary())})

    features_of = rows.mapInArrow(extract, "turn long, label int, keys binary, amounts binary")
    got = features_of.repartition(1).mapInArrow(learn, "keys binary, weights binary").first()
    if got is None:
        return Model(features, np.zeros(0, np.uint64), np.zeros(0))
    return Model(features, np.frombuffer(bytes(got["keys"]), dtype=np.uint64), np.frombuffer(bytes(got["weights"])))


def score(docs: DataFrame, model: Model, threshold: float, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: the key, held_out, score and predicted."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(key, held_out(key).alias("held_out"), text)
    kind = kept.schema[0].dataType.simpleString()

    def work(batches):
        for batch in batches:
            scores = [shared.value.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {key: batch.column(0), "held_out": batch.column(1), "score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= threshold) for s in scores], pa.int32())}
            )

    return kept.mapInArrow(work, f"`{key}` {kind}, held_out boolean, score double, predicted int")


def passing(docs: DataFrame, model: Model, threshold: float, *, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def work(batches):
        for batch in batches:
            good = pa.array([shared.value.score(t) >= threshold for t in batch.column(place).to_pylist()], pa.bool_())
            yield batch.filter(good)

    return docs.mapInArrow(work, docs.schema)


#: Toxicity: presence of words, pairs and skip-grams; strong L1.
TOXIC = (Features(grams=(1, 2), skips=(2, 3), stems=(4, 5), presence=True), Ftrl(alpha=0.3, l1=3.0, l2=0.1, epochs=3, least_docs=5))
#: Quality: shares of n-grams, in which marks, case and repetition show.
QUALITY = (Features(grams=(1, 2, 3), lower=False), Ftrl(alpha=1.0, l1=0.3, l2=0.1))


def toxicity(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    return score(docs, fit(docs, labels, "toxic", *TOXIC, sample=sample), threshold)


def quality(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    return score(docs, fit(docs, labels, "quality", *QUALITY, sample=sample), threshold)
