"""Log-bilinear language model: trained with noise-contrastive estimation, scored with batched matrix products.

The model predicts a token from the four tokens before it, in two steps: first its cluster, then its item among the
items of the cluster. Both steps are log-bilinear over the same context vector, and both are normalised by a matrix
product, so a token costs the number of clusters and the size of one cluster instead of the number of items. Frequent
tokens are items of their own; the others share an item with those of the same last bytes and split its probability
by their counts, so the probabilities of all known tokens, and of one unknown token for each ending, add up to one.
Counts come from the whole training text; so do the parameters: every task trains on all the tokens of its partition,
and results are averaged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: The token that ends a text; no word is empty.
END = b""
ORDER, DIMS = 4, 16
#: Tokens that are items of their own, endings that are items for all other tokens, bytes of an ending, and clusters.
WORDS, ENDINGS, ENDING_BYTES, CLUSTERS = 4096, 511, 3, 96
#: Tokens whose counts travel to the tasks; the counts of all others are joined.
VOCABULARY = 1 << 18
#: Noise clusters of a batch, noise items of a cluster in a batch, tokens of a training batch, of a piece of it and of a scoring batch.
NOISE, NOISE_WITHIN, BATCH, PIECE, CHUNK, RATE = 16, 1, 4096, 32, 1 << 16, 0.15
#: Rows of a matrix product.
ROWS = 2048
#: Bytes of text that are counted at once and that are numbered at once, and rows that a task's parameters are sent in.
COUNT_BYTES, SLICE_BYTES, CHUNKS_OF_PARAMETERS = 32 << 20, 4 << 20, 8


@dataclass
class Model:
    """Everything that scoring needs: bounded by VOCABULARY tokens and the number of items.

    ``items`` has the item of each vocabulary token, ``endings`` the ending of each item of an ending and
    ``ending_items`` that item; ``first`` has the first item of each cluster, and the number of items at its end.
    """

    tokens: pa.BinaryArray
    counts: np.ndarray
    items: np.ndarray
    endings: pa.BinaryArray
    ending_items: np.ndarray
    other: int
    shared: np.ndarray
    mass: np.ndarray
    first: np.ndarray
    train_tokens: int
    distinct: int
    parameters: list[np.ndarray] | None = None

    @property
    def size(self) -> int:
        return len(self.mass)

    @property
    def clusters(self) -> int:
        return len(self.first) - 1

    @property
    def cluster_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.clusters), np.diff(self.first))


def split_batch(texts: pa.Array, most: int) -> Iterator[tuple[int, np.ndarray, pa.BinaryArray]]:
    """The tokens of texts, about ``most`` bytes of text at a time: the first text's place, the words of each text, and all words as bytes.

    Arrow's ASCII kernels lower-case A to Z and split at the six ASCII white-space characters.
    """
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(sizes)) if len(sizes) else np.zeros(1, int)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts[a:b]))
        counts, words = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
        real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
        if not real.all():  # white space at either end leaves an empty piece
            ends = np.append(0, np.cumsum(real))[np.append(0, np.cumsum(counts))]
            counts, words = np.diff(ends), words.filter(pa.array(real))
        yield a, counts, words.cast(pa.binary())


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, counts, words in split_batch(batch.column(0), COUNT_BYTES):
            found = words.value_counts()
            tokens = pa.concat_arrays([found.field("values"), pa.array([END], pa.binary())])
            times = pa.concat_arrays([found.field("counts"), pa.array([len(counts)], pa.int64())])
            yield pa.RecordBatch.from_arrays([tokens, times], ["token", "c"])


def count_tokens(texts: DataFrame) -> DataFrame:
    """token and its number c over all rows of ``texts``; combined in the tasks before the shuffle."""
    return texts.select("text").mapInArrow(_token_counts, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _clusters(items: list[tuple[bytes, bool]], mass: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the items in which clusters are runs, and each run's first place.

    Items stand in the order of their reversed bytes, so those of a cluster end alike; runs are cut at equal sums of
    the mass's root, so clusters of frequent items are small.
    """
    order = np.array(sorted(range(len(items)), key=lambda i: (items[i][0][::-1], items[i][1])), np.int64)
    root = np.sqrt(mass[order] + 1e-9)
    run = np.minimum((np.cumsum(root) - root / 2) / root.sum() * clusters, clusters - 1).astype(np.int64)
    return order, np.append(np.flatnonzero(np.append(True, run[1:] != run[:-1])), len(items))


def make_vocabulary(counts: DataFrame, most: int = VOCABULARY, words: int = WORDS, endings: int = ENDINGS, clusters: int = CLUSTERS) -> Model:
    """Items, their masses and clusters from the table of all counts.

    The tokens that travel are those with a count over a level that a histogram of the counts' logarithms gives, so
    at most ``most`` are collected, and the end. The most frequent ``words`` are items; of the others' endings the
    most frequent ``endings`` are, and what is left is one item.
    """
    level = F.floor(F.log2("c") * 16)
    bars = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()
    total, distinct, kept, least = sum(b["c"] for b in bars), sum(b["n"] for b in bars), 0, None
    for bar in sorted(bars, key=lambda b: -b["level"]):
        if kept + bar["n"] > most:
            break
        kept, least = kept + bar["n"], bar["level"]
    travel = F.col("token") == F.lit(END)
    rows = counts.where(travel if least is None else travel | (level >= least)).collect()
    known = {bytes(r["token"]): r["c"] for r in rows}
    known.setdefault(END, 0)
    rows = sorted(known.items(), key=lambda r: (r[0] != END, -r[1], r[0]))
    heads = rows[:words] if total else []
    rest = counts.where(~F.col("token").isin([t for t, _ in heads]))
    by_ending = rest.groupBy(F.substring("token", -ENDING_BYTES, ENDING_BYTES).alias("ending")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n"))
    top = by_ending.orderBy(F.col("c").desc(), "ending").limit(endings).collect()
    mass = np.array([c + 0.1 for _, c in heads] + [r["c"] + 0.1 * r["n"] for r in top] + [0.0])
    mass[-1] = max(0.0, total + 0.1 * distinct - mass.sum())
    names = [(t, False) for t, _ in heads] + [(bytes(r["ending"]), True) for r in top] + [(b"", True)]
    order, first = _clusters(names, mass, clusters)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    shared = np.zeros(len(names), bool)
    shared[place[len(heads) :]] = True
    tokens = pa.array([t for t, _ in rows], pa.binary())
    ending_items, ending_names = place[len(heads) : -1], pa.array([t for t, _ in names[len(heads) : -1]], pa.binary())
    model = Model(tokens, np.array([c for _, c in rows], np.int64), np.empty(0, np.int64), ending_names, ending_items, int(place[-1]), shared, mass[order], first, total, distinct)
    model.items = np.append(place[: len(heads)], ending_of(model, tokens[len(heads) :]))
    return model


def ending_of(model: Model, tokens: pa.BinaryArray) -> np.ndarray:
    """The items of tokens that aren't items of their own."""
    if not len(tokens):
        return np.empty(0, np.int64)
    found = pc.index_in(pc.binary_slice(tokens, -ENDING_BYTES), model.endings)
    return np.append(model.ending_items, model.other)[pc.fill_null(found, len(model.endings)).to_numpy(zero_copy_only=False)]


def read_batch(model: Model, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, pa.BinaryArray]]:
    """Texts as numbers, some at a time: the first text's place, and by token, ends included, the tokens of each text,
    vocabulary numbers (-1: not in it), items, and the tokens that aren't in it."""
    for at, counts, words in split_batch(texts, SLICE_BYTES):
        found = pc.fill_null(pc.index_in(words, model.tokens), -1).to_numpy(zero_copy_only=False)
        items = model.items[found]
        far = np.flatnonzero(found < 0)
        tokens = words.take(pa.array(far))
        items[far] = ending_of(model, tokens)
        ends = np.cumsum(counts)
        # The end is the first of the vocabulary.
        yield at, counts + 1, np.insert(found, ends, 0), np.insert(items, ends, model.items[0]), tokens


def start_parameters(model: Model, seed: int = 1) -> list[np.ndarray]:
    """Columns of clusters and items (bias first), of contexts (the start of a text is the last), and of positions.

    The biases start at the unigram model. A position before the token scales its context's vector by dimension.
    """
    rng = np.random.default_rng(seed)
    mass = np.maximum(model.mass, 0.1)
    sums = np.add.reduceat(mass, model.first[:-1])
    outputs = rng.normal(0, 0.1, (DIMS + 1, model.clusters + model.size))
    outputs[0] = np.log(np.append(sums / sums.sum(), mass / sums[model.cluster_of]))
    contexts = rng.normal(0, 0.1, (DIMS, model.size + 1))
    return [x.astype(np.float32) for x in (outputs, contexts, np.repeat(0.7 ** np.arange(ORDER)[None], DIMS, 0))]


def in_line(items: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """The items of texts one after another, with ORDER starts before each: what precedes a token is what it depends on."""
    return np.insert(items, np.repeat(np.cumsum(sizes) - sizes, ORDER), start)


def _sums(places: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The sums by place of each row of ``values``."""
    return np.stack([np.bincount(places, x, minlength=size) for x in values])


def before(vectors: np.ndarray, scale: np.ndarray, wide: int) -> np.ndarray:
    """From vectors in lines of ORDER tokens more than ``wide``, the context vectors of each line's last ``wide``."""
    out = scale[:, 0, None, None] * vectors[..., ORDER - 1 : ORDER - 1 + wide]
    for i in range(1, ORDER):
        out += scale[:, i, None, None] * vectors[..., ORDER - 1 - i : ORDER - 1 - i + wide]
    return out


def _fall(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)) in place."""
    np.minimum(x, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive estimation by Adagrad, of the clusters and of the items within them.

    The noise of a batch is drawn once: clusters by their mass, and for each cluster some of its items by theirs.
    """

    def __init__(self, model: Model, parameters: list[np.ndarray], seed: int) -> None:
        self.size, self.clusters, self.first, self.rng = model.size, model.clusters, model.first, np.random.default_rng(seed)
        self.parameters = [x.astype(np.float32) for x in parameters]
        self.squares = [np.full_like(x, 1e-4) for x in parameters]
        mass = np.maximum(model.mass, 0.1)
        sums = np.add.reduceat(mass, self.first[:-1])
        self.cluster_of = model.cluster_of
        self.edges, self.cluster_edges = np.cumsum(mass), np.cumsum(sums)
        self.several = (np.diff(self.first) > 1).astype(np.float32)
        self.log_noise = np.log(NOISE * sums / sums.sum()).astype(np.float32)
        self.log_within = np.log(NOISE_WITHIN * mass / sums[self.cluster_of]).astype(np.float32)
        self.seen = 0

    def learn(self, items: np.ndarray, sizes: np.ndarray) -> None:
        """One pass over texts, in batches of short pieces from all over them."""
        line = in_line(items, sizes, self.size)
        pieces = -(-(len(line) - ORDER) // PIECE)
        line = np.append(line, np.full(pieces * PIECE + ORDER - len(line), self.size))
        pieces = np.lib.stride_tricks.sliding_window_view(line, PIECE + ORDER)[::PIECE]
        order = self.rng.permutation(len(pieces))
        for at in range(0, len(order), BATCH // PIECE):
            self.step(pieces[order[at : at + BATCH // PIECE]])
        self.seen += len(items)

    def draw(self) -> tuple[np.ndarray, np.ndarray]:
        clusters = np.searchsorted(self.cluster_edges, self.rng.random(NOISE) * self.cluster_edges[-1])
        low = np.append(0, self.cluster_edges[:-1])[:, None]
        within = np.searchsorted(self.edges, low + self.rng.random((self.clusters, NOISE_WITHIN)) * (self.cluster_edges[:, None] - low))
        return np.minimum(clusters, self.clusters - 1), np.clip(within, self.first[:-1, None], self.first[1:, None] - 1)

    def step(self, pieces: np.ndarray) -> None:
        """One update from lines of ORDER tokens and PIECE tokens behind them, which are the targets."""
        k, (p, table, scale) = self.clusters, self.parameters
        targets = pieces[:, ORDER:].ravel()
        real = (targets < self.size).astype(np.float32)  # starts of texts are in line too
        targets = np.minimum(targets, self.size - 1)
        vectors = table.take(pieces, 1)
        q = np.ones((DIMS + 1, len(targets)), np.float32)  # the bias is a dimension in which all contexts have a one
        q[1:] = before(vectors, scale, PIECE).reshape(DIMS, -1)
        cluster = self.cluster_of[targets]
        several = real * self.several[cluster]
        noise, table_within = self.draw()
        # Slopes of the log likelihood: towards the target, away from the noise, whose part within a cluster is the same for all its tokens.
        own, own2, others = p.take(cluster, 1), p.take(targets + k, 1), p.take(noise, 1)
        up = _fall((own * q).sum(0) - self.log_noise[cluster]) * real
        up2 = _fall((own2 * q).sum(0) - self.log_within[targets]) * several
        down = _fall(self.log_noise[noise][:, None] - others.T @ q) * real
        g_q = up * own
        g_q += up2 * own2
        g_q -= others @ down
        g = np.empty_like(p)
        g[:, :k] = _sums(cluster, up * q, k) - _sums(noise, q @ down.T, k)
        g[:, k:] = _sums(targets, up2 * q, self.size)
        for within in table_within.T:
            others2 = p.take(within + k, 1).take(cluster, 1)
            down2 = _fall(self.log_within[within][cluster] - (others2 * q).sum(0)) * several
            g_q -= down2 * others2
            g[:, within + k] -= _sums(cluster, down2 * q, k)
        g_q = g_q[1:].reshape(DIMS, -1, PIECE)
        g_vectors, g_scale = np.zeros_like(vectors), np.empty_like(scale)
        for i in range(ORDER):
            at = slice(ORDER - 1 - i, ORDER - 1 - i + PIECE)
            g_vectors[..., at] += scale[:, i, None, None] * g_q
            g_scale[:, i] = np.einsum("dbs,dbs->d", g_q, vectors[..., at])
        slopes, n = (g, _sums(pieces.ravel(), g_vectors.reshape(DIMS, -1), self.size + 1).astype(np.float32), g_scale), len(targets)
        for x, square, slope in zip(self.parameters, self.squares, slopes, strict=True):
            slope /= n
            square += slope * slope
            slope /= np.sqrt(square)
            slope *= RATE
            x += slope


def flattened(parameters: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in parameters])


def _train(shared, start):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, task = shared.value, TaskContext.get().partitionId()
        trainer = Trainer(model, start.value, task)
        for batch in batches:
            for _, sizes, _, items, _ in read_batch(model, batch.column(0)):
                trainer.learn(items, sizes)
        if trainer.seen:
            parts = np.array_split(flattened(trainer.parameters) * np.float32(trainer.seen), CHUNKS_OF_PARAMETERS)
            columns = [pa.array(range(len(parts)), pa.int32()), pa.array([task] * len(parts), pa.int64()), pa.array([trainer.seen] * len(parts), pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "task", "seen", "values"])

    return run


def _sum_parameters(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float32).astype(float) for x in rows.column("values")).astype(np.float32)
    first = rows.slice(0, 1)
    return pa.table({"part": first["part"], "task": first["task"], "seen": [sum(rows["seen"].to_pylist())], "values": pa.array([total.tobytes()], pa.binary())})


def fit(texts: DataFrame, counts: DataFrame) -> Model:
    """Train on all rows of ``texts``, whose token counts are ``counts``.

    Each task makes one pass over its tokens from the same start, and the parameters are averaged by the number of
    tokens: summed in groups of tasks first, so no task gathers those of all. The driver gets the sum, whose size
    depends on the number of items only.
    """
    model = make_vocabulary(counts)
    start = start_parameters(model)
    context = texts.sparkSession.sparkContext
    schema = "part int, task long, seen long, values binary"
    made = texts.select("text").mapInArrow(_train(context.broadcast(model), context.broadcast(start)), schema)
    groups = max(1, math.isqrt(context.defaultParallelism * 16))
    part = made.groupBy("part", (F.col("task") % groups).alias("_group")).applyInArrow(_sum_parameters, schema)
    rows = sorted(part.groupBy("part").applyInArrow(_sum_parameters, schema).collect(), key=lambda r: r["part"])
    if rows:
        flat = np.concatenate([np.frombuffer(bytes(r["values"]), np.float32) / np.float32(r["seen"]) for r in rows])
        cuts = np.cumsum([x.size for x in start])[:-1]
        start = [x.reshape(y.shape) for x, y in zip(np.split(flat, cuts), start, strict=True)]
    model.parameters = start
    return model


def _log_share(q: np.ndarray, outputs: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The log probability of one output for each row, among all of them."""
    s = q @ outputs
    own = s[np.arange(len(s)), chosen]
    return own - np.log(np.exp(s, out=s) @ np.ones(s.shape[1], np.float32))


class Scorer:
    """Normalised log10 probabilities of items, a batch of tokens at a time."""

    def __init__(self, model: Model) -> None:
        (p, self.table, self.scale), k = model.parameters, model.clusters
        self.size, self.first, self.cluster_of = model.size, model.first, model.cluster_of
        self.by_cluster = np.ascontiguousarray(p[:, :k])
        self.by_item = [np.ascontiguousarray(p[:, k + a : k + b]) for a, b in zip(self.first[:-1], self.first[1:], strict=True)]

    def score(self, items: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        line = in_line(items, sizes, self.size)
        out = np.empty(len(line))
        for at in range(ORDER, len(line), CHUNK):
            out[at : at + CHUNK] = self._score_line(line[at - ORDER : at + CHUNK])
        return out[line < self.size] / math.log(10)

    def _score_line(self, line: np.ndarray) -> np.ndarray:
        n = len(line) - ORDER
        q = np.ones((n, DIMS + 1), np.float32)  # the bias is a dimension of its own, in which all contexts have a one
        q[:, 1:] = before(self.table.take(line[None], 1), self.scale, n)[:, 0].T
        # In the order of clusters, each of which is then a run of rows; starts of texts count as any item.
        targets = np.minimum(line[ORDER:], self.size - 1)
        cluster = self.cluster_of[targets]
        order = np.argsort(cluster, kind="stable")
        q, cluster, targets = q.take(order, 0), cluster[order], targets[order]
        made = np.empty(n)
        for a in range(0, n, ROWS):
            made[a : a + ROWS] = _log_share(q[a : a + ROWS], self.by_cluster, cluster[a : a + ROWS])
        edges = np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1])).tolist()
        for a, b in zip(edges, [*edges[1:], n], strict=True):
            c = cluster[a]
            if self.by_item[c].shape[1] > 1:
                made[a:b] += _log_share(q[a:b], self.by_item[c], targets[a:b] - self.first[c])
        out = np.empty(n)
        out[order] = made
        return out


PARTIAL = "token binary, row long, times long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
_KINDS = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents' own rows, and a row for each token outside the vocabulary of each."""
        model = shared.value
        scorer, names = Scorer(model), [x.split()[0] for x in PARTIAL.split(", ")]
        log_counts = np.append(np.log10(model.counts + 0.1), 0.0)  # the last is for tokens outside, whose counts are joined
        known = np.append(model.counts > 0, False)
        floor = math.log10(model.train_tokens + 0.1 * (model.distinct + 1))
        # A token's share of its item: 1 where it is the item, count over mass for the others.
        share = np.log10(model.mass + 0.1)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, sizes, numbers, items, far in read_batch(model, batch.column(2)):
                starts, n = np.cumsum(sizes) - sizes, len(sizes)
                scores = scorer.score(items, sizes) + np.where(model.shared[items], log_counts[numbers] - share[items], 0.0)
                by_text = lambda x, starts=starts: pa.array(np.add.reduceat(x, starts))
                rows = np.arange(row, row + n)
                own = [pa.array([b" %d" % r for r in rows.tolist()], pa.binary()), pa.array(rows), pa.array(np.zeros(n, np.int64)), batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(sizes), by_text(known[numbers].astype(np.int64)), pa.array(np.add.reduceat(log_counts[numbers], starts) - floor * sizes), by_text(scores)]
                yield pa.RecordBatch.from_arrays(own, names)
                if len(far):
                    coded = far.dictionary_encode()
                    owner = np.repeat(np.arange(n), sizes)[numbers < 0]
                    pair, times = np.unique(owner * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
                    owner, code = np.divmod(pair, len(coded.dictionary))
                    yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code)), pa.array(row + owner), pa.array(times), *(pa.nulls(len(pair), k) for k in _KINDS[3:])], names)
                row += n

    return run


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs`` (doc_id, text).

    The model and the counts come from the rows where ``held_out`` is false. ``base_score`` is the smoothed unigram
    model's log10 probability of the text, ``score`` the log-bilinear model's. Null and empty texts are a single
    end. Repeated rows are rows of their own; without training rows all scores are 0; other columns are not read.
    Texts are read where they are; what is shuffled are counts, and the tokens outside the vocabulary with their
    document's row, which meet their counts by token and then their row. The table of counts stays in the shared folder
    until the caller clears it.
    """
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    train = rows.where(~F.col("held_out"))
    counts = materialize(count_tokens(train), "counts")
    model = fit(train, counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    met = rows.mapInArrow(_score(shared), PARTIAL).join(counts, "token", "left")
    log_count = F.when(F.col("times") > 0, F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1))
    summed = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0))).alias("n_known"),
        F.max("base").alias("base"),
        F.max("score").alias("part"),
        F.coalesce(F.sum(log_count), F.lit(0.0)).alias("far"),
    )
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), (F.col("base") + F.col("far")).alias("base_score"), (F.col("part") + F.col("far")).alias("score"))
