"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is described by shares and means
of its words and by the words themselves, each hashed to a learned vector. It
is encoded by a learned layer and weighted by a gated attention. Vectors,
layer and attention are learned together, from document labels alone. The weighted sum of the encoded
passages is what is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from hangarlog.llm.frames import record
from hangarlog.llm.language_id import held_out
from hangarlog.llm.textbytes import buffer_of, slices, span_hashes, words

PASSAGE_WORDS = 64
#: Documents fitted on at most (those whose labels have the smallest hash), and passages of one of them.
SAMPLE_DOCUMENTS, SAMPLE_PASSAGES = 8000, 1000
#: Bytes of text fitted on at most. A passage of 64 words takes 200 bytes at the driver, its text 128 at the least.
SAMPLE_BYTES = 96 << 20
#: Words are hashed to so many learned vectors.
BUCKETS = 1 << 12
THRESHOLD = 0.7
FEATURES = 18

_KIND = np.zeros((256, 6), dtype=np.float64)  # letter, upper, digit, common mark, other mark, start of a character
_KIND[[c for c in range(256) if c >= 192 or chr(c).isascii() and chr(c).isalpha()], 0] = 1
_KIND[ord("A"):ord("Z") + 1, 1] = 1
_KIND[ord("0"):ord("9") + 1, 2] = 1
_KIND[[ord(c) for c in ".,;:!?'\"-()"], 3] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"-()"], 4] = 1
_KIND[[c for c in range(256) if not 128 <= c < 192], 5] = 1


class Passages(NamedTuple):
    """x: FEATURES numbers a passage; begins: where each text's passages begin; buckets: all words; sizes: words of each passage."""

    x: np.ndarray
    begins: np.ndarray
    buckets: np.ndarray
    sizes: np.ndarray


def passages(column: pa.Array) -> Passages:
    """The passages of each text. A text without words has one, of zeros."""
    data, rows = buffer_of(column)
    starts, ends, first = words(data, rows)
    count = np.diff(first)
    parts = np.maximum(-(-count // PASSAGE_WORDS), 1)
    begins = np.concatenate(([0], np.cumsum(parts)))
    out = np.zeros((begins[-1], FEATURES))
    if not len(starts):
        return Passages(out, begins, np.zeros(0, np.uint16), np.zeros(len(out), np.int64))
    row = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(starts)) - first[:-1][row]
    passage = begins[:-1][row] + inside // PASSAGE_WORDS
    hashes = span_hashes(data, starts, ends)
    kinds = np.empty((len(starts), 6))
    for k in range(6):
        running = np.concatenate(([0.0], np.cumsum(_KIND[:, k][data])))
        kinds[:, k] = running[ends] - running[starts]
    length = np.maximum(kinds[:, 5], 1.0)
    follows = inside > 0
    repeat, second = np.zeros(len(starts)), np.zeros(len(starts))
    repeat[1:] = (hashes[1:] == hashes[:-1]) & follows[1:]
    second[2:] = (hashes[2:] == hashes[:-2]) & (inside[2:] > 1)
    breaks = np.zeros(len(starts))
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    breaks[1:] = (lines[starts[1:]] > lines[ends[:-1]]) & follows[1:]
    last = data[ends - 1]
    order = np.lexsort((hashes, passage))
    fresh = np.ones(len(starts))
    same = (hashes[order][1:] == hashes[order][:-1]) & (passage[order][1:] == passage[order][:-1])
    fresh[order[1:][same]] = 0.0
    values = [length / 10, (length / 10) ** 2, repeat, second, kinds[:, 0] / length, kinds[:, 1] / length, kinds[:, 2] / length,
              kinds[:, 3] / length, kinds[:, 4] / length, kinds[:, 0] == 0, last == ord("."), last == ord(","), breaks,
              length <= 3, length >= 13, fresh, kinds[:, 4] > 0]
    n = np.bincount(passage, minlength=len(out))
    for k, v in enumerate(values):
        out[:, k] = np.bincount(passage, np.asarray(v, dtype=np.float64), minlength=len(out)) / np.maximum(n, 1)
    out[:, 1] = np.sqrt(np.maximum(out[:, 1] - out[:, 0] ** 2, 0.0))
    out[:, 17] = n / PASSAGE_WORDS
    return Passages(out, begins, (hashes % np.uint64(BUCKETS)).astype(np.uint16), n)


def word_means(vectors: np.ndarray, buckets: np.ndarray, sizes: np.ndarray, step: int = 2048) -> np.ndarray:
    """The mean vector of each passage's words; zeros for one without words."""
    out, ends = np.zeros((len(sizes), vectors.shape[1])), np.cumsum(sizes)
    for low in range(0, len(sizes), step):
        part, stops = sizes[low:low + step], ends[low:low + step]
        full = np.flatnonzero(part)
        if len(full):
            first = stops[0] - part[0]
            out[low + full] = np.add.reduceat(vectors[buckets[first:stops[-1]]], (stops - part)[full] - first, axis=0)
    return out / np.maximum(sizes, 1)[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class AttentionModel:
    """An encoder, a gated attention over a bag's passages, and a linear score."""

    def __init__(self, width: int = 16, gate: int = 8, seed: int = 3):
        draw = np.random.default_rng(seed)
        shape = {"W": (FEATURES, width), "b": (width,), "V": (width, gate), "U": (width, gate), "w": (gate,), "c": (width,), "d": (1,)}
        self.p = {"E": np.zeros((BUCKETS, width))} | {k: draw.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s) for k, s in shape.items()}
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def _forward(self, of: Passages) -> dict[str, np.ndarray]:
        p, begins, bag = self.p, of.begins, np.repeat(np.arange(len(of.begins) - 1), np.diff(of.begins))
        h = np.tanh(of.x @ p["W"] + p["b"] + word_means(p["E"], of.buckets, of.sizes))
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, begins[:-1])[bag])
        a /= np.add.reduceat(a, begins[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, begins[:-1], axis=0)
        return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"])}

    def score(self, of: Passages) -> np.ndarray:
        """Every bag has at least one passage."""
        return self._forward(of._replace(x=(of.x - self.mean) / self.scale))["y"] if len(of.begins) > 1 else np.zeros(0)

    def _gradients(self, of: Passages, label, decay):
        p, begins, f = self.p, of.begins, self._forward(of)
        bag, h, a = f["bag"], f["h"], f["a"]
        out = (f["y"] - label) / len(label)
        dz = out[:, None] * p["c"]
        dh = a[:, None] * dz[bag]
        da = (h * dz[bag]).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, begins[:-1])[bag])
        dg = de[:, None] * p["w"]
        dt, du = dg * f["g"] * (1 - f["t"] ** 2), dg * f["t"] * f["g"] * (1 - f["g"])
        dh = (dh + dt @ p["V"].T + du @ p["U"].T) * (1 - h ** 2)
        each = np.repeat(dh / np.maximum(of.sizes, 1)[:, None], of.sizes, axis=0)
        words = np.column_stack([np.bincount(of.buckets, column, minlength=BUCKETS) for column in each.T])
        made = {"E": words, "W": of.x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ du, "w": (f["t"] * f["g"]).T @ de,
                "c": f["z"].T @ out, "d": np.array([out.sum()])}
        return {k: v + decay * p[k] for k, v in made.items()}

    def fit(self, bags: list[Passages], labels: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01,
            decay: float = 1e-5, seed: int = 5) -> "AttentionModel":
        if not bags:
            return self
        every = np.concatenate([b.x for b in bags])
        self.mean, self.scale = every.mean(axis=0), np.maximum(every.std(axis=0), 1e-3)
        bags = [b._replace(x=(b.x - self.mean) / self.scale) for b in bags]
        draw, step = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(epochs):
            order = draw.permutation(len(bags))
            now = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.02)
            for at in range(0, len(order), batch):
                chosen = [bags[i] for i in order[at:at + batch]]
                begins = np.concatenate(([0], np.cumsum([len(b.x) for b in chosen])))
                whole = Passages(np.concatenate([b.x for b in chosen]), begins, np.concatenate([b.buckets for b in chosen]), np.concatenate([b.sizes for b in chosen]))
                made, step = self._gradients(whole, labels[order[at:at + batch]], decay), step + 1
                for k, v in made.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.p[k] -= now * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id",
                  sample: int = SAMPLE_DOCUMENTS, most_passages: int = SAMPLE_PASSAGES, most_bytes: int = SAMPLE_BYTES) -> AttentionModel:
    """Fit on at most `sample` labelled documents that are not held out, the first by hash up to `most_bytes` of text.

    Labels that are null or contradict each other for an identifier are left
    out, and so are sample documents of more than most_passages passages.
    Repeated rows count each. With no labelled document the model is the
    untrained one.
    """
    known = (labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("id")).agg(F.min(label).cast("double").alias("label"), F.max(label).cast("double").alias("other"))
             .filter(F.col("label") == F.col("other")))
    chosen = known.orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(sample).select("id", "label")  # so many rows at most
    joined = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    # At most `sample` rows of an identifier and a size in this window.
    sizes = joined.groupBy("id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    running = F.sum("bytes").over(Window.orderBy(F.xxhash64(F.lit(11), "id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    within = sizes.withColumn("running", running).filter(F.col("running") <= most_bytes).select("id")
    schema = pa.schema([("id", pa.int64()), ("label", pa.float64()), ("x", pa.binary()), ("words", pa.binary()), ("sizes", pa.binary())])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x, begins, buckets, sizes = passages(batch.column("text"))
                fits = np.diff(begins) <= most_passages
                spans = [(a, b) for a, b, f in zip(begins, begins[1:], fits) if f]
                ends = np.concatenate(([0], np.cumsum(sizes)))
                yield record(schema, [batch.column("id").filter(pa.array(fits)), batch.column("label").filter(pa.array(fits)),
                                      [x[a:b].astype(np.float32).tobytes() for a, b in spans], [buckets[ends[a]:ends[b]].tobytes() for a, b in spans],
                                      [sizes[a:b].astype(np.uint16).tobytes() for a, b in spans]])

    rows = joined.join(F.broadcast(within), "id").select(F.col("id").cast("long"), "label", "text").mapInArrow(
        describe, "id long, label double, x binary, words binary, sizes binary")
    found = rows.orderBy("id", "x", "words").limit(sample).collect()
    read = lambda part, kind: np.frombuffer(part, dtype=kind)
    bags = [Passages(read(r["x"], np.float32).reshape(-1, FEATURES).astype(np.float64), np.zeros(0, np.int64), read(r["words"], np.uint16),
                     read(r["sizes"], np.uint16).astype(np.int64)) for r in found]
    return AttentionModel().fit(bags, np.array([r["label"] for r in found]))


def score_quality(docs: DataFrame, model: AttentionModel, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1) and predicted (1 from the threshold on).

    Every passage of the whole text counts, however long it is. Null, empty and
    blank texts have one empty passage and so a score too; repeated rows are
    scored each; an empty table gives no rows. Further columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield record(schema, [batch.column("doc_id"), batch.column("held_out"), model.score(passages(batch.column("text")))])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text).alias("text"))
    scored = source.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
                                                  T.StructField("score", T.DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
