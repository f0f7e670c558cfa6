"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from document labels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, materialize, release

WORDS = re.compile(r"[^\W\d_]+")
SENTENCES = re.compile(r"[^.!?\n]+[.!?]*")
PREFIX = 5
#: Part of the documents, at most, that are taken to be toxic by what isn't learned.
LEAK = 1e-3
NEW = ("score", "predicted", "offending")


@dataclass
class ToxicityModel:
    """Weights of words and word prefixes, and the bias of a sentence."""

    weights: dict[str, float]
    bias: float
    threshold: float
    counts: dict[str, int] = field(default_factory=dict)


def features_of(word: str) -> tuple[str, ...]:
    """A lower-cased word and its prefix, which stands for the word's inflected forms."""
    return ("w" + word, "p" + word[:PREFIX]) if len(word) > PREFIX else ("w" + word,)


def _sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in SENTENCES.finditer(text) if not m.group().isspace()]


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, by label; flushed before the table of a task grows large."""
    held: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([v[1] for v in held.values()], pa.int64()), pa.array([v[0] for v in held.values()], pa.int64())], ["feature", "with_1", "with_0"])
        return out

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {f for w in set(WORDS.findall((text or "").lower())) for f in features_of(w)}
            for f in found:
                held.setdefault(f, [0, 0])[label] += 1
        if len(held) > 300_000:
            yield flush()
            held = {}
    if held:
        yield flush()


def _bags(index: dict[str, int]):
    """A document as the feature numbers of those of its sentences that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = []
            for text in batch.column(0).to_pylist():
                text = (text or "").lower()
                spans = _sentences(text)
                sets = ({index[f] for w in WORDS.findall(text[a:b]) for f in features_of(w) if f in index} for a, b in spans)
                bags.append([sorted(s) for s in sets if s])
            entries = [sum(len(s) + 1 for s in bag) for bag in bags]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(entries, pa.int64()), pa.array(bags, pa.list_(pa.list_(pa.int32())))], ["doc_id", "label", "entries", "bags"])

    return run


def fitting(sizes: list[tuple], most: int) -> list | None:
    """Ids of the (id, size) pairs, in order, that ``most`` holds, passing over those that no longer fit; None for all."""
    if sum(n for _, n in sizes) <= most:
        return None
    out, left = [], most
    for doc_id, n in sizes:
        if n <= left:
            out.append(doc_id)
            left -= n
    return out


def train(labels: np.ndarray, bags: list[list[list[int]]], width: int, steps: int = 400, rate: float = 0.2, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the likelihood of document labels under noisy-or, by Adam on all rows.

    A sentence scores sigmoid(bias + its features' weights); a document is toxic unless none of its sentences is.
    A sentence counts by what it exceeds the bias by: without features, or with a sum of weights under 0, it adds
    nothing, so a document isn't likelier toxic for its length.
    """
    doc_of = np.array([d for d, bag in enumerate(bags) for _ in bag], np.int64)
    flat = [s for bag in bags for s in bag]
    sizes = np.array([len(s) for s in flat], np.int64)
    ids = np.array([i for s in flat for i in s], np.int64)
    row_of = np.repeat(np.arange(len(flat)), sizes)
    # Both labels weigh the same in sum, as toxic documents are few.
    balance = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    # Weights start over 0, as a sentence at the bias has no slope.
    w, b = np.ones(width), -7.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(row_of, w[ids], minlength=len(flat)) if len(flat) else np.empty(0)
        p, p0, over = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b)), z > b
        none = -np.bincount(doc_of, np.where(over, np.logaddexp(0, z) - np.logaddexp(0, b), 0.0), minlength=len(labels))
        none += np.log1p(-LEAK)
        whole = -np.expm1(none)
        # d(-log likelihood)/dz of a sentence over the bias is p where the label is 0, and -p (1 - P) / P where it is 1.
        slope = balance * np.where(labels == 1, -np.exp(none) / whole, 1.0)
        g_rows = slope[doc_of] * over * p
        g = np.append(np.bincount(ids, g_rows[row_of], minlength=width), (slope[doc_of] * over * (p - p0)).sum())
        g[:width] += decay * w / max(1, width) ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        w, b = w - change[:width], b - change[width]
    return w, float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = 20_000, most_entries: int = 20_000_000, most_features: int = 4096, least_docs: int = 3, least_ratio: float = 4.0, threshold: float = 0.7) -> ToxicityModel:
    """Fit on up to ``sample_rows`` labelled documents where ``learn`` (over doc_id) holds.

    The sample is the labelled ids with the smallest hashes; of an id with several labels the largest counts, and
    rows with a null id or label don't. Only the sample's ids and labels are broadcast (bounded by ``sample_rows``).
    Of documents that repeat an id the smallest text counts, so the sample has one row for each id. What the driver
    trains on has at most ``most_entries`` sentences and features of them: where whole documents of the sample hold
    more, those that no longer fit are left out in the order of the hashes. Features are words and prefixes that at least ``least_docs`` toxic
    documents have and that are ``least_ratio`` times as frequent among toxic documents as among others. Without
    labelled rows of both kinds every score is under ``LEAK``.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    sample = known.where(learn).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label", "doc_id")
    rows = materialize(rows, "labelled")
    counts = rows.mapInArrow(_count_features, "feature string, with_1 long, with_0 long").groupBy("feature").agg(F.sum("with_1").alias("a"), F.sum("with_0").alias("b"))
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    ratio = (F.col("a") + 0.5) * (totals.get(0, 0) + 1.0) / ((F.col("b") + 0.5) * (totals.get(1, 0) + 1.0))
    best = counts.where((F.col("a") >= least_docs) & (ratio >= least_ratio)).orderBy((F.log(ratio) * F.col("a")).desc(), "feature").limit(most_features)
    names = [r["feature"] for r in best.collect()]
    if not names:
        release(rows)
        return ToxicityModel({}, -9.0, threshold, totals)
    ids = rows.select("doc_id").schema
    bags = materialize(rows.mapInArrow(_bags({f: i for i, f in enumerate(names)}), extended(ids, "label int, entries long, bags array<array<int>>")), "bags")
    sizes = bags.select("doc_id", "entries").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    fit = fitting([tuple(r) for r in sizes], most_entries)
    kept = bags if fit is None else bags.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in fit], ids)), "doc_id", "left_semi")
    # In the order of ids, so that sums, and so reruns, agree to the last bit.
    made = sorted(kept.select("doc_id", "label", "bags").collect(), key=lambda r: r["doc_id"])
    release(rows, bags)
    w, b = train(np.array([r["label"] for r in made]), [r["bags"] for r in made], len(names))
    return ToxicityModel({f: float(x) for f, x in zip(names, w, strict=True) if x}, b, threshold, totals)


class Scorer:
    """Scores texts; remembers what words weigh."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.memo = model, {}

    def weigh(self, word: str) -> tuple[str, ...]:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            found = self.memo[word] = tuple(f for f in features_of(word) if f in self.model.weights)
        return found

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and start, length and score of the sentences that are likelier toxic than not."""
        if not text:
            return 0.0, []
        lower = text.lower()
        if len(lower) != len(text):  # offsets must be those of the text
            lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        spans = _sentences(lower)
        weigh, bias = self.weigh, self.model.bias
        # Ranks texts without learned features by length, and ends at LEAK however long they are.
        unlearned = LEAK * len(spans) / (len(spans) + 1)
        if not any(map(weigh, set(WORDS.findall(lower)))):
            return unlearned, []
        none, offending, nothing = np.log1p(-unlearned), [], np.logaddexp(0, bias)
        for a, b in spans:
            z = bias + sum(self.model.weights[f] for f in {f for w in WORDS.findall(lower[a:b]) for f in weigh(w)})
            none -= max(0.0, np.logaddexp(0, z) - nothing)
            if z > 0:
                offending.append((a, b - a, float(1 / (1 + np.exp(-z)))))
        return float(-np.expm1(none)), offending


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The columns of ``docs`` with score, predicted and offending (start, length and score of toxic sentences).

    Columns of ``docs`` with these names are replaced. Null and empty texts have no sentence and score 0. Rows are
    independent, whole texts are read, and nothing is shuffled.
    """
    kept = docs.select(*[n for n in docs.columns if n not in NEW])
    names, at = kept.columns, kept.columns.index("text")
    spans = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            made = [scorer.score(x.as_py()) for x in batch.column(at)]
            scores = pa.array([s for s, _ in made], pa.float64())
            predicted = pa.array([int(s >= model.threshold) for s, _ in made], pa.int32())
            places = pa.array([[{"start": a, "length": n, "score": s} for a, n, s in o] for _, o in made], spans)
            yield pa.RecordBatch.from_arrays([*batch.columns, scores, predicted, places], [*names, *NEW])

    schema = extended(kept.schema, "score double, predicted int, offending array<struct<start:int,length:int,score:double>>")
    return kept.mapInArrow(run, schema)
