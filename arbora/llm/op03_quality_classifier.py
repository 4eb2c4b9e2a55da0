"""A factorisation machine that scores the quality of documents.

Features of a text are hashed words (square roots of their shares, so that the
word vector has length 1), structure statistics from the bytes, lines and words
of the whole text, and the one piece of metadata that is no forbidden input,
n_chars. The score is sigmoid(w0 + <w, x> + sum over pairs <v_i, v_j> x_i x_j);
the pairs are summed in linear time as half of the squares of sums less the sums
of squares, factor by factor.

Training uses a bounded sample: the first ``max_rows`` labelled rows of the
training folds in the order of a hash of doc_id. Only their features reach the
driver. Everything else - scoring - covers every document.

Defined results: a null or empty text has no words and gets the score of its
structure alone; null labels are skipped and of repeated labels the lowest
counts; without any usable label every score is 0.5; a null doc_id is not held
out; repeated rows score alike, and of rows that repeat a labelled id the one with
the smallest text counts; ids may be numbers or text; an empty table gives an
empty result; extra columns are dropped.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.common import table

STATISTICS = (
    "words", "word_length", "upper", "digit", "symbol", "punctuation", "non_ascii", "blank", "lines_per_word", "repeated_lines",
    "distinct_words", "top_word", "exclamation", "bar", "longest_word", "upper_words", "n_chars",
)
# Bytes of the statistics.
_CLASSES = {
    "upper": bytes(range(65, 91)), "digit": b"0123456789", "symbol": b"#*$%&|<>@~^=_{}[]\\/", "punctuation": b".,;:?'\"()-",
    "non_ascii": bytes(range(128, 256)), "blank": b" \t\n\x0b\x0c\r", "exclamation": b"!", "bar": b"|",
}


@dataclass(frozen=True)
class MachineSpec:
    buckets: int = 1 << 15
    factors: int = 8
    max_rows: int = 12_000
    epochs: int = 12
    batch: int = 128
    rate: float = 0.05
    decay: float = 1e-5
    threshold: float = 0.3
    folds: int = 5
    seed: int = 7


def _statistics(raw: bytes, words: list[bytes], counts: Counter, n_chars) -> list[float]:
    import numpy as np

    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, n = max(1, len(raw)), max(1, len(words))
    share = {k: int(hist[list(v)].sum()) / size for k, v in _CLASSES.items()}
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, share["upper"], share["digit"], share["symbol"], share["punctuation"],
        share["non_ascii"], share["blank"], len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), len(counts) / n,
        max(counts.values(), default=0) / n, share["exclamation"], share["bar"], math.log1p(max(map(len, words), default=0)),
        sum(w.isupper() for w in raw.split()) / n, math.log1p(max(0, n_chars or 0)),
    ]


class _Features:
    """Features of texts in one worker; remembers a bounded number of word buckets."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def __call__(self, text, n_chars):
        import numpy as np

        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.lower().split()
        counts, known = Counter(words), self.known
        if len(known) > 300_000:
            known.clear()
        at = np.empty(len(counts), np.int64)
        for i, w in enumerate(counts):
            b = known.get(w)
            if b is None:
                b = zlib.crc32(w) % self.buckets
                if len(w) < 40:
                    known[w] = b
            at[i] = b
        shares = np.bincount(at, weights=np.fromiter(counts.values(), np.float64, len(counts)), minlength=0) if len(at) else np.zeros(0)
        index = np.flatnonzero(shares)
        return index.astype(np.int32), np.sqrt(shares[index] / max(1, len(words))).astype(np.float32), np.array(_statistics(raw, words, counts, n_chars), np.float32)


def _pairs(rows_v):
    """Half of (sum squared less sum of squares), over the factors."""
    total = rows_v.sum(0)
    return 0.5 * float(total @ total - (rows_v * rows_v).sum())


def train(rows: list[tuple], spec: MachineSpec) -> dict:
    """Fit on rows of (index, value, statistics, label) by minibatch Adagrad; a fixed seed makes it repeatable."""
    import numpy as np

    s, d, k = len(STATISTICS), spec.buckets, spec.factors
    model = {"w0": 0.0, "w": np.zeros(d + s, np.float32), "v": np.zeros((d + s, k), np.float32), "mean": np.zeros(s, np.float32), "scale": np.ones(s, np.float32)}
    if not rows:
        return model
    stats = np.stack([r[2] for r in rows])
    model["mean"], model["scale"] = stats.mean(0), stats.std(0) + 1e-3
    rng = np.random.default_rng(spec.seed)
    model["v"] = rng.normal(0, 0.02, (d + s, k)).astype(np.float32)
    y = np.array([r[3] for r in rows], np.float32)
    own = np.arange(d, d + s)
    ids = [np.concatenate([r[0], own]) for r in rows]
    xs = [np.concatenate([r[1], np.clip((r[2] - model["mean"]) / model["scale"], -5, 5)]).astype(np.float32) for r in rows]
    gw, gv, g0 = np.full(d + s, 1e-2, np.float32), np.full((d + s, k), 1e-2, np.float32), 1e-2
    w, v, w0 = model["w"], model["v"], float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for _ in range(spec.epochs):
        order = rng.permutation(len(rows))
        for first in range(0, len(rows), spec.batch):
            chosen = order[first:first + spec.batch]
            at, x = np.concatenate([ids[i] for i in chosen]), np.concatenate([xs[i] for i in chosen])
            starts = np.concatenate([[0], np.cumsum([len(ids[i]) for i in chosen])[:-1]])
            vx = v[at] * x[:, None]
            sums = np.add.reduceat(vx, starts)
            z = w0 + np.add.reduceat(w[at] * x, starts) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chosen]) / len(chosen)
            row = np.repeat(np.arange(len(chosen)), np.diff(np.append(starts, len(at))))
            e = err[row]
            touched, place = np.unique(at, return_inverse=True)
            dw, dv = np.zeros(len(touched), np.float32), np.zeros((len(touched), k), np.float32)
            np.add.at(dw, place, e * x)
            np.add.at(dv, place, (e * x)[:, None] * (sums[row] - vx))
            dw += spec.decay * w[touched]
            dv += spec.decay * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            w[touched] -= spec.rate * dw / np.sqrt(gw[touched])
            v[touched] -= spec.rate * dv / np.sqrt(gv[touched])
            g0 += float(err.sum()) ** 2
            w0 -= spec.rate * float(err.sum()) / g0**0.5
    model["w0"] = w0
    return model


def fold_of(column: str, folds: int = 5):
    """crc32 of the column's text, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, spec: MachineSpec = MachineSpec()) -> dict:
    """Train on at most ``spec.max_rows`` labelled documents outside the held-out fold."""
    known = labels.where("doc_id is not null and quality is not null").where(fold_of("doc_id", spec.folds) != 0)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(spec.max_rows)
    # At most max_rows ids and labels, so this side may be broadcast.
    sample = docs.select("doc_id", "text", "n_chars").join(F.broadcast(known), "doc_id")
    # Rows that repeat an id count once, so max_rows bounds what the driver gets.
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("text", "n_chars", "quality")).alias("x")).select(F.col("doc_id").cast("string").alias("id"), "x.*")
    buckets = spec.buckets

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features = _Features(buckets)
        for batch in batches:
            for one in batch.to_pylist():
                index, value, stats = features(one["text"], one["n_chars"])
                yield pa.RecordBatch.from_arrays([
                    pa.array([one["id"]], pa.string()), pa.array([index.tobytes()], pa.binary()), pa.array([value.tobytes()], pa.binary()),
                    pa.array([stats.tobytes()], pa.binary()), pa.array([one["quality"]], pa.int32())], ["id", "i", "x", "s", "y"])

    import numpy as np

    got = sample.mapInArrow(run, "id string, i binary, x binary, s binary, y int").toArrow().sort_by("id")
    rows = [
        (np.frombuffer(i, np.int32), np.frombuffer(x, np.float32), np.frombuffer(s, np.float32), 1 if y else 0)
        for i, x, s, y in zip(*(got.column(c).to_pylist() for c in "ixsy"), strict=True)
    ]
    return train(rows, spec)


def score(docs: DataFrame, model: dict, spec: MachineSpec = MachineSpec()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, from text and n_chars alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by buckets * (factors + 1)
    buckets = spec.buckets

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        m, features = shared.value, _Features(buckets)
        w0, w, v = m["w0"], m["w"], m["v"]
        own = np.arange(buckets, len(w))
        for batch in batches:
            out = []
            for text, n_chars in zip(batch.column("text"), batch.column("n_chars"), strict=True):
                index, value, stats = features(text.as_py(), n_chars.as_py())
                at = np.concatenate([index, own])
                x = np.concatenate([value, np.clip((stats - m["mean"]) / m["scale"], -5, 5)])
                z = w0 + float(w[at] @ x) + _pairs(v[at] * x[:, None])
                out.append(1 / (1 + math.exp(-min(30.0, max(-30.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    out = docs.select("doc_id", "text", "n_chars").mapInArrow(run, schema)
    held = F.coalesce(fold_of("doc_id", spec.folds) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= spec.threshold).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"), "n_chars")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
