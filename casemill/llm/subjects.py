"""Subject areas of documents.

A sentence is the average of the embeddings of its words, a word the average of its own and its subwords' embeddings
(hashed into a fixed table), and every subject an independent logistic output on it. A document treats a subject as
far as its second-best sentence does, so a single passing mention is no case. The model is trained on whole labelled
documents with full gradients that are summed over the partitions after each round, and scores every document.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.runtime import arrow_safe, cut

#: Rows of the embedding table, and its width.
BUCKETS, WIDTH = 1 << 14, 16
#: Labelled documents to train on, those with the least hash of their id: the only bound on a sample here.
TRAIN_DOCUMENTS = 6_000
ROUNDS, RATE, DECAY = 50, 0.03, 0.2
#: Weight of the absence of a label, which readers forget more easily than they invent one.
ABSENT = 0.5
#: Factor on averages before the output, so that a few telling words among many carry a sentence.
SCALE = 8.0
#: Sentences of a document that must be about a subject.
SENTENCES = 2
#: Partitions that share the training documents.
TRAIN_PARTITIONS = 4

_BREAK = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD = re.compile(r"[^\W\d_]{2,}")


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence that has any."""
    return [w for s in _BREAK.split(text.lower()) if (w := _WORD.findall(s))]


def buckets(word: str) -> list[int]:
    """Rows of the table for a word and its subwords of four and five characters."""
    marked = f"<{word}>"
    parts = [word, *(marked[k : k + n] for n in (4, 5) for k in range(len(marked) - n + 1))]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


class Model:
    """Table, output weights and biases."""

    def __init__(self, outputs: int, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        self.weights = rng.normal(0, 0.3, (WIDTH, outputs)).astype(np.float32)
        self.bias = np.full(outputs, -2.0, np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.weights, self.bias]


class Scorer:
    """Logits of documents; what a word adds is worked out once for each word."""

    def __init__(self, model: Model) -> None:
        self.model, self.ids = model, {}
        self.rows = np.zeros((1024, len(model.bias)), np.float32)

    def _id(self, word: str) -> int:
        n = len(self.ids)
        if n >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.ids[word] = n
        self.rows[n] = self.model.table[buckets(word)].mean(axis=0) @ self.model.weights
        return n

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """Logit of the SENTENCES-th best sentence for each text and output; minus infinity with fewer sentences."""
        out = np.full((len(texts), len(self.model.bias)), -np.inf, np.float32)
        if len(self.ids) > 300_000:
            self.ids.clear()
        get, new = self.ids.get, self._id
        ids: list[int] = []
        sizes: list[int] = []
        owner: list[int] = []
        counts: list[int] = []
        for n, text in enumerate(texts):
            found = sentences(text) if text else []
            if len(found) < SENTENCES:
                continue
            owner.append(n)
            counts.append(len(found))
            for s in found:
                sizes.append(len(s))
                ids.extend([i if (i := get(w)) is not None else new(w) for w in s])
        if not owner:
            return out
        size = np.array(sizes)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        z = np.add.reduceat(self.rows[np.array(ids)], starts, axis=0) / size[:, None] * SCALE + self.model.bias
        at = 0
        for n, k in zip(owner, counts, strict=True):
            part = z[at : at + k]
            out[n] = np.partition(part, k - SENTENCES, axis=0)[k - SENTENCES]
            at += k
        return out


class _Batch:
    """Training documents of a partition as flat arrays."""

    def __init__(self, texts: list[str], labels: list[list[int]], outputs: int) -> None:
        known: dict[str, int] = {}
        spelled: list[list[int]] = []
        ids, sizes, per_doc, kept = [], [], [], []
        for text, own in zip(texts, labels, strict=True):
            found = sentences(text)
            if len(found) < SENTENCES:
                continue
            kept.append(own)
            per_doc.append(len(found))
            for s in found:
                sizes.append(len(s))
                for w in s:
                    if w not in known:
                        known[w] = len(spelled)
                        spelled.append(buckets(w))
                    ids.append(known[w])
        self.docs = len(kept)
        self.ids, self.sizes, self.per_doc = np.array(ids, np.int32), np.array(sizes, np.int64), np.array(per_doc, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]) if sizes else np.empty(0, np.int64)
        self.doc_first = np.concatenate([[0], np.cumsum(self.per_doc)[:-1]]) if per_doc else np.empty(0, np.int64)
        self.doc_of = np.repeat(np.arange(self.docs), self.per_doc) if self.docs else np.empty(0, np.int64)
        self.y = np.zeros((self.docs, outputs), np.float32)
        for n, own in enumerate(kept):
            self.y[n, own] = 1
        self.lengths = np.array([len(x) for x in spelled])
        self.flat = np.array([b for x in spelled for b in x], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]) if spelled else np.empty(0, np.int64)

    def gradient(self, model: Model, warm: bool) -> list[np.ndarray]:
        """Gradient sums of the logistic loss of each document's second-best sentence; while warm, also of the best
        sentence for the labels that a document has."""
        outputs = len(model.bias)
        words = np.add.reduceat(model.table[self.flat], self.starts, axis=0) / self.lengths[:, None]
        adds = (words @ model.weights).astype(np.float32)
        z = np.add.reduceat(adds[self.ids], self.first, axis=0) / self.sizes[:, None] * SCALE + model.bias
        best = np.maximum.reduceat(z, self.doc_first, axis=0)
        is_best = z == best[self.doc_of]
        others = np.where(is_best, -np.inf, z)
        second = np.maximum.reduceat(others, self.doc_first, axis=0)
        chance = 1 / (1 + np.exp(-np.where(np.isfinite(second), second, -30.0)))
        pull = (chance - self.y) * np.where(self.y > 0, 1, ABSENT)
        g = np.where((others == second[self.doc_of]) & np.isfinite(others), pull[self.doc_of], 0)
        if warm:
            g += np.where(is_best, ((1 / (1 + np.exp(-best)) - 1) * self.y)[self.doc_of], 0)
        d_adds = np.zeros((len(self.lengths), outputs))
        for k in range(outputs):  # only the sentences that move the output
            s = np.flatnonzero(g[:, k])
            size = self.sizes[s]
            at = np.repeat(self.first[s] - np.cumsum(size) + size, size) + np.arange(size.sum())
            d_adds[:, k] = np.bincount(self.ids[at], np.repeat(g[s, k] / size * SCALE, size), len(self.lengths))
        d_words = (d_adds @ model.weights.T) / self.lengths[:, None]
        wide = np.repeat(d_words, self.lengths, axis=0)
        d_table = np.stack([np.bincount(self.flat, wide[:, j], BUCKETS) for j in range(WIDTH)], axis=1)
        return [x.astype(np.float32) for x in (d_table, words.T @ d_adds, g.sum(axis=0))]

    def message(self, model: Model, warm: bool) -> bytes:
        """The gradient, of the table only the rows that the documents move, after their number and their places."""
        table, *rest = self.gradient(model, warm)
        moved = np.flatnonzero(table.any(axis=1)).astype(np.int32)
        return b"".join((np.int32(len(moved)).tobytes(), moved.tobytes(), table[moved].tobytes(), *(x.tobytes() for x in rest)))


def added(messages: list[bytes], model: Model) -> list[np.ndarray]:
    """The sum of the gradients of some messages, in the shapes of the parts of a model."""
    sums = [np.zeros(p.shape, np.float32) for p in model.parts()]
    for m in messages:
        n = int(np.frombuffer(m, np.int32, 1)[0])
        moved = np.frombuffer(m, np.int32, n, 4)
        rest = np.frombuffer(m, np.float32, -1, 4 + 4 * n)
        sums[0][moved] += rest[: n * sums[0].shape[1]].reshape(n, -1)
        at = n * sums[0].shape[1]
        for x in sums[1:]:
            x += rest[at : at + x.size].reshape(x.shape)
            at += x.size
    return sums


def train(examples: DataFrame, outputs: int, seed: int = 0) -> Model:
    """Fits a model. examples: part int, text string, labels array<int>; at most TRAIN_DOCUMENTS rows, by part. In each
    round every partition returns one gradient, of fixed size at most and of the table only what its documents move, and
    the sum moves the model (Adam)."""
    model = Model(outputs, seed)
    sc = examples.sparkSession.sparkContext

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"part": [], "text": [], "labels": []})])
        for part, own in rows.groupby("part"):
            yield pd.DataFrame({"part": [part], "batch": [pickle.dumps(_Batch(own.text.tolist(), [list(x) for x in own.labels], outputs))]})

    laid = examples.repartition(TRAIN_PARTITIONS, "part").sortWithinPartitions("part", F.xxhash64("text"))
    ready = cut(laid.mapInPandas(arrow_safe(prepare), "part int, batch binary"))
    means, squares = ([np.zeros_like(p) for p in model.parts()] for _ in range(2))
    for step in range(ROUNDS):
        shared = sc.broadcast((model, step < ROUNDS // 2))  # about a megabyte

        def partial(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            now, warm = shared.value
            for b in batches:
                for part, packed in zip(b.part, b.batch, strict=True):
                    batch = pickle.loads(packed)
                    if batch.docs:
                        yield pd.DataFrame({"part": [part], "docs": [batch.docs], "g": [batch.message(now, warm)]})

        got = ready.mapInPandas(arrow_safe(partial), "part int, docs bigint, g binary").collect()  # TRAIN_PARTITIONS gradients
        shared.destroy()
        docs = sum(r.docs for r in got)
        if not docs:
            break
        total = added([r.g for r in sorted(got, key=lambda r: r.part)], model)
        for p, m, v, g in zip(model.parts(), means, squares, total, strict=True):
            g = g / docs
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p *= 1 - RATE * DECAY * (p.ndim > 1)
            p -= RATE * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-8)
    return model


def assign_subjects(documents: DataFrame, doc_id: str, text: str, labels: DataFrame, label_doc: str, label: str, subjects: list[str], least: float = 0.5, train_documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """One row (doc_id, subject, score) per document and subject whose probability is at least least.

    Every document is scored over its whole text; null and empty texts, and texts of one sentence, have no subject.
    Rows with a null id are left out, repeated rows give one row. Labels that are null, of unknown documents or unknown
    subjects are left out; without any usable label there is no result. Other columns are ignored.
    """
    names = sorted(set(subjects))
    docs = documents.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text")).where("doc is not null and text is not null")
    number = F.create_map(*(x for n, s in enumerate(names) for x in (F.lit(s), F.lit(n)))) if names else None
    if number is None:
        return docs.select(F.col("doc").alias(doc_id), F.lit("").alias("subject"), F.lit(0.0).alias("score")).limit(0)
    known = labels.select(F.col(f"`{label_doc}`").alias("doc"), F.element_at(number, F.col(f"`{label}`")).alias("n")).where("doc is not null and n is not null")
    sample = known.groupBy("doc").agg(F.array_sort(F.collect_set("n")).alias("labels")).orderBy(F.xxhash64("doc"), "doc").limit(train_documents)
    examples = docs.join(F.broadcast(sample), "doc").select(F.pmod(F.xxhash64("doc"), F.lit(TRAIN_PARTITIONS)).cast("int").alias("part"), "text", "labels")
    model = docs.sparkSession.sparkContext.broadcast(train(examples, len(names)))
    cutoff = float(np.log(least / (1 - least)))
    kind = docs.schema["doc"].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, spelled = Scorer(model.value), np.array(names, dtype=object)
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                z = scorer(part.text.tolist())
                row, k = np.nonzero(z >= cutoff)
                yield pd.DataFrame({"doc": part.doc.to_numpy()[row], "subject": spelled[k], "score": 1 / (1 + np.exp(-z[row, k].astype(float)))})

    return docs.mapInPandas(arrow_safe(score), f"doc {kind}, subject string, score double").groupBy("doc", "subject").agg(F.max("score").alias("score")).withColumnRenamed("doc", doc_id)
