"""Quality classifier by co-training (Blum and Mitchell, COLT 1998): a view of the text and a view of the page's metadata.

Each view has a logistic regression. In every round each view scores all unlabelled documents and hands those that it
is surest of, of either class, to the other view as pseudo-labels: a share of them, and all beyond some calibrated
probability. A pseudo-label is that probability, so a view that knows little takes part and misleads little. Documents
are scored where they are; fitting gets sums of gradients and Hessians. After the last round both views are calibrated on labelled documents that they were not fitted on and combined by a
logistic regression over their logits, fitted on the same documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspan.llm.common import discard, materialize, words_of
from voxelspan.llm.toxicity import held_out, sigmoid

#: Labelled documents that fitting uses at most: those whose hashed doc_id comes first.
LABELLED = 4000
#: SHARE of the unlabelled documents is handed over in any case, split by the labels' rate.
ROUNDS, SURE, SHARE = 5, 0.95, 0.3
#: Hashed values of language and of source, steps of the stated length (four an octave), steps of a probability.
BUCKETS, SIZES, STEPS = 32, 80, 1000
#: Tasks that add up what the others have summed.
ADDERS = 16


def text_view(texts: pa.Array) -> np.ndarray:
    """Measures of each whole text, none of which is its length: that is the other view's; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    codes, offsets, _ = words_of(texts)
    n = np.diff(offsets)
    per = lambda x: x / np.maximum(n, 1)
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float)
    count = lambda p: pc.count_substring_regex(texts, p).to_numpy(zero_copy_only=False).astype(float)
    row = np.repeat(np.arange(len(n)), n)
    pairs = np.unique(row * (int(codes.max(initial=0)) + 1) + codes, return_counts=True) if len(codes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    own = pairs[0] // (int(codes.max(initial=0)) + 1)
    distinct, top = np.bincount(own, minlength=len(n)), np.zeros(len(n))
    np.maximum.at(top, own, pairs[1])
    symbols, bangs, upper, digits, bars, lines = (per(count(p)) for p in ("[#*$%&<>]", "!", "[A-Z]", "[0-9]", r"\|", "\n"))
    length = per(chars)
    rare = per(distinct) * np.log1p(n)  # long texts repeat more words
    cols = [length, np.abs(length - 7), np.minimum(symbols, 3), np.sqrt(symbols), np.minimum(bangs, 3), np.sqrt(bangs), np.minimum(upper, 5), np.sqrt(upper), digits, np.minimum(bars, 2), np.sqrt(bars), lines, per(distinct), rare, per(top)]
    return np.stack([np.asarray(c, float) for c in cols], 1)


def meta_codes(lang: pa.Array, source: pa.Array, chars: pa.Array) -> np.ndarray:
    """Numbers of hashed language and source and of the step of the stated length; nulls are values of their own."""
    hashed = [np.array([zlib.crc32(repr(v).encode()) % BUCKETS for v in c.to_pylist()], int).reshape(-1) for c in (lang, source)]
    size = pc.fill_null(chars.cast(pa.float64()), -1.0).to_numpy(zero_copy_only=False)
    step = np.where(size < 0, 0, np.minimum(1 + np.floor(4 * np.log2(1 + np.maximum(size, 0))), SIZES - 1)).astype(int)
    return np.stack([*hashed, step], 1)


def spelled(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), 2 * BUCKETS + SIZES))
    for k in range(3):
        out[np.arange(len(codes)), k * BUCKETS + codes[:, k]] = 1
    return out


def meta_view(lang: pa.Array, source: pa.Array, chars: pa.Array) -> np.ndarray:
    return spelled(meta_codes(lang, source, chars))


@dataclass
class Logistic:
    """Weights over standardised features, by Newton's method with a ridge."""

    ridge: float = 1.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = self.standard(x)
        w, rate = np.zeros(z.shape[1]), np.ones(len(y)) if weight is None else weight
        ridge = np.full(len(w), self.ridge)
        ridge[0] = 1e-3
        for _ in range(30):
            p = sigmoid(z @ w)
            s = rate * p * (1 - p) + 1e-9
            move = np.linalg.solve((z * s[:, None]).T @ z + np.diag(ridge), z.T @ (rate * (p - y)) + ridge * w)
            w = w - np.clip(move, -4, 4)
            if np.abs(move).max() < 1e-6:
                break
        self.weights = w
        return self

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.concatenate([np.ones((len(x), 1)), (x - self.mean) / self.scale], 1), -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        if not len(self.mean):
            return np.full(len(x), self.weights[0])
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return self.weights[0] + z @ self.weights[1:]


@dataclass
class Model:
    """Views, their calibration and their combination; exchanged says what each round handed over."""

    views: tuple[Logistic, Logistic]
    calibrated: tuple[Logistic, Logistic]
    combined: Logistic
    exchanged: list[tuple[int, int]]

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        logits = [v.logit(x) for v, x in zip(self.views, (text, meta))]
        each = [c.logit(z[:, None]) for c, z in zip(self.calibrated, logits)]
        return sigmoid(each[0]), sigmoid(each[1]), sigmoid(self.combined.logit(np.stack(each, 1)))


class Rows:
    """Unlabelled rows in memory: sums(f) is the sum of f(text, meta), a vector, over parts of the rows; None without rows."""

    def __init__(self, text: np.ndarray, meta: np.ndarray):
        self.views = text, meta

    def sums(self, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
        return f(*self.views) if len(self.views[0]) else None


class Table:
    """The same for a table of _packed() measures (column x); each task sums its rows, ADDERS tasks their sums."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def sums(self, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = f(*_unpacked(batch.column(0).to_pylist()))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = sorted(x for batch in batches for x in batch.column(0).to_pylist())
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([sum(np.frombuffer(x) for x in got).tobytes()], pa.binary())], ["s"])

        sums = self.rows.select("x").mapInArrow(run, "s binary").repartition(ADDERS, "s").mapInArrow(add, "s binary")
        got = sorted(bytes(r["s"]) for r in sums.collect())
        return sum(np.frombuffer(x) for x in got) if got else None


def _packed(text: np.ndarray, codes: np.ndarray) -> list[bytes]:
    """A row's measures, of the metadata only the numbers."""
    return [x.tobytes() for x in np.concatenate([codes, text], 1).astype(float)]


def _unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(rows)).reshape(len(rows), -1)
    return x[:, 3:], spelled(x[:, :3].astype(int))


def _newton(w: np.ndarray, z: np.ndarray, y: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the rows' loss, one after another."""
    p = sigmoid(z @ w)
    return np.concatenate([z.T @ (rate * (p - y)), ((z * (rate * p * (1 - p) + 1e-9 * (rate > 0))[:, None]).T @ z).ravel()])


def surest(counts: np.ndarray, prior: float, share: float, sure: float) -> tuple[float, float]:
    """(low, high): a view hands over what it gives less than low or at least high, from how often it gives each step."""
    total, steps = counts.sum(), len(counts)
    above = np.cumsum(counts[::-1])[::-1]  # at least step k
    high = np.flatnonzero(above >= share * prior * total).max(initial=0) / steps
    low = (np.flatnonzero(np.cumsum(counts) >= share * (1 - prior) * total).min(initial=steps) + 1) / steps
    return max(low, 1 - sure), min(high, sure)


def co_train(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray] | Table, rounds: int = ROUNDS, sure: float = SURE, share: float = SHARE) -> Model | None:
    """labelled and pool hold the two views' features of the same rows; None if a label is missing.

    A pseudo-label weighs half a label, less where all together would weigh more than half the labelled documents.
    """
    y = np.asarray(y, float)
    if not 0 < y.sum() < len(y):
        return None
    part = np.arange(len(y)) % 4 == 3  # calibration and combination
    if not all(0 < y[m].sum() < m.sum() for m in (part, ~part)):
        part = np.ones(len(y), bool)  # too few labels to set some apart
    fitting = ~part if not part.all() else part
    prior = y[fitting].mean()
    rest = Rows(*pool) if isinstance(pool, tuple) else pool
    known = [x[fitting] for x in labelled]

    def calibrate(pair: tuple[Logistic, Logistic]) -> tuple[Logistic, Logistic]:
        a, b = (Logistic(0.1).fit(v.logit(x[part])[:, None], y[part]) for v, x in zip(pair, labelled))
        return a, b

    def moments(text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(text)], *(s for x in (text, meta) for s in (x.sum(0), (x * x).sum(0)))])

    def refitted(pair: tuple[Logistic, Logistic], start: tuple[Logistic, Logistic]) -> tuple[tuple[Logistic, Logistic], tuple[int, int]]:
        """Both views by Newton's method on the labelled rows and on what the other view of pair is sure of."""
        sources = calibrate(pair)
        known_by = lambda v, x: sigmoid(sources[v].logit(pair[v].logit(x)[:, None]))
        steps = lambda text, meta: np.concatenate([np.bincount(np.minimum(known_by(v, x) * STEPS, STEPS - 1).astype(int), minlength=STEPS) for v, x in enumerate((text, meta))]).astype(float)
        bounds = [surest(h, prior, share, sure) for h in rest.sums(steps).reshape(2, -1)]
        out = tuple(Logistic(v.ridge, v.weights.copy(), v.mean, v.scale) for v in start)
        mine = [v.standard(x) for v, x in zip(out, known)]
        sizes = [len(v.weights) for v in out]
        given, open_ = (0, 0), [True, True]
        for _ in range(30):

            def measure(text: np.ndarray, meta: np.ndarray, out=out) -> np.ndarray:
                parts = []
                for v, (x, other) in enumerate(((text, meta), (meta, text))):
                    p, (low, high) = known_by(1 - v, other), bounds[1 - v]
                    ok = (p >= high) | (p < low)
                    parts += [[ok.sum()], _newton(out[v].weights, out[v].standard(x[ok]), p[ok], np.ones(ok.sum()))]
                return np.concatenate(parts)

            got, at = rest.sums(measure), 0
            counts = []
            for v, d in enumerate(sizes):
                n, sums = got[at], got[at + 1 : at + 1 + d + d * d]
                at += 1 + d + d * d
                counts.append(int(n))
                total = _newton(out[v].weights, mine[v], y[fitting], np.ones(len(mine[v]))) + 0.5 * min(1, len(mine[v]) / max(n, 1)) * sums
                ridge = np.full(d, out[v].ridge)
                ridge[0] = 1e-3
                move = np.linalg.solve(total[d:].reshape(d, d) + np.diag(ridge), total[:d] + ridge * out[v].weights)
                out[v].weights = out[v].weights - np.clip(move, -4, 4)
                open_[v] = np.abs(move).max() >= 1e-6
            given = (counts[1], counts[0])  # by the text view, by the metadata view
            if not any(open_) or not any(given):
                break
        return (out[0], out[1]), given

    exchanged = []
    pair = tuple(Logistic().fit(x, y[fitting]) for x in known)
    total = rest.sums(moments) if rounds else None
    if total is not None:
        n, at, start = total[0] + fitting.sum(), 1, []
        for x in known:  # all rows give the scales, so that they stay the same in all rounds
            d = x.shape[1]
            mean = (total[at : at + d] + x.sum(0)) / n
            square = (total[at + d : at + 2 * d] + (x * x).sum(0)) / n
            start.append(Logistic(1.0, np.zeros(d + 1), mean, np.maximum(np.sqrt(np.maximum(square - mean * mean, 0)), 1e-6)))
            at += 2 * d
        for _ in range(rounds):
            fitted, given = refitted(pair, start)
            exchanged.append(given)
            if not any(given):
                break
            pair = start = fitted
    both = calibrate(pair)
    stacked = np.stack([c.logit(v.logit(x[part])[:, None]) for c, v, x in zip(both, pair, labelled)], 1)
    return Model(pair, both, Logistic(0.1).fit(stacked, y[part]), exchanged)


def _measured(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_view(rows.column("text")), meta_codes(rows.column("lang"), rows.column("source"), rows.column("n_chars"))


def _views(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text, codes = _measured(rows)
    return text, spelled(codes)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("double"))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | None:
    """Fitted on at most ``labelled`` labelled documents that are not held out and on all unlabelled ones.

    Texts are measured where they are; the driver gets the measures of the labelled rows and sums over the others. Of
    several labels of one document the largest counts, null labels don't; of several rows of one labelled document one is
    fitted on, whichever measures sort first.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg((F.max("quality") > 0).cast("double").alias("_y"))
    some = F.broadcast(marked.where(~held_out("_id")).orderBy(F.xxhash64("_id"), "_id").limit(labelled))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_packed(*_measured(part)), pa.binary())], ["doc_id", "x"])

    measured = lambda rows: rows.mapInArrow(measure, "doc_id bigint, x binary")
    chosen = measured(_plain(docs).join(some, F.col("doc_id") == F.col("_id"), "left_semi")).join(some, F.col("doc_id") == F.col("_id"))
    got = sorted((r["doc_id"], bytes(r["x"]), r["_y"]) for r in chosen.groupBy("doc_id").agg(F.min("x").alias("x"), F.first("_y").alias("_y")).collect())
    if not got:
        return None
    rest = materialize(measured(_plain(docs)).join(marked, F.col("doc_id") == F.col("_id"), "left_anti").select("x"))
    model = co_train(_unpacked([x for _, x, _ in got]), np.array([y for *_, y in got]), Table(rest))
    discard(rest)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score_text, score_meta, score and kept (score of 0.5 or more) of each row of docs.

    Without a model every score is 1: nothing is known against any document. Rows with nulls, empty or very long texts
    and repeated rows are scored each. Columns other than doc_id, text, lang, source and n_chars are not looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                some = batch.slice(k, 2000)
                s = (np.ones(some.num_rows),) * 3 if held.value is None else held.value.scores(*_views(some))
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(v, pa.float64()) for v in s)], ["doc_id", "score_text", "score_meta", "score"])

    scored = _plain(docs).mapInArrow(run, "doc_id bigint, score_text double, score_meta double, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score_text", "score_meta", "score", (F.col("score") >= 0.5).alias("kept"))
