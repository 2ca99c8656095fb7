"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters, without marks at its ends, as two kinds of input: the word itself, if the training texts have it, and its
characters, as n-grams of bytes with the word's borders. Each kind has a learned embedding, trained with the network (the characters' is the
mean over a word's n-grams), and a table of shrunken log-odds that the training labels give (of the n-grams maximum and
mean), in training without a text's own label. The network reads windows of WINDOW words that overlap by WINDOW -
STRIDE; a document's score is the calibrated maximum over all its windows. A fifth of the labelled texts is kept out of
training and calibrates.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspan.llm.common import give_back, words_of

WINDOW, STRIDE, HIDDEN, ATTEND = 32, 24, 8, 6
GRAMS, BUCKETS = (4, 5), 1 << 19
#: Labelled documents that the model is fitted on at most: those whose hashed doc_id comes first, as long as their texts
#: together stay within SAMPLE_BYTES; a text of more than a sixteenth of that is left out of fitting.
SAMPLE, SAMPLE_BYTES = 3000, 12 << 20
SHRINK = 4.0
#: Values of a word from the tables, of its own embedding and of its characters', whose n-grams share CHARS rows.
BASE, WORD_DIM, CHAR_DIM, CHARS = 3 + 2 * len(GRAMS), 8, 8, 1 << 15
FEATURES = BASE + WORD_DIM + CHAR_DIM
#: Bytes of text that are scored at a time.
PART_BYTES = 2 << 20


def bare(words: pa.Array) -> pa.Array:
    """Words in lower case without the ASCII marks at their ends, which stand at words of every kind; of marks alone nothing is left."""
    return pc.utf8_trim(pc.utf8_lower(words), characters=string.punctuation)


def gram_buckets(words: pa.Array, n: int, step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word with its borders, one after another, and how many each word has."""
    found, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for k in range(0, len(words), step):  # some words at a time: an n-gram takes several numbers on its way
        some = words.slice(k, step)
        joined = b"\x01" + b"\x01".join(w.encode("utf-8", "surrogatepass") for w in some.to_pylist()) + b"\x01"
        sizes = pc.binary_length(some).to_numpy(zero_copy_only=False).astype(np.int64)
        count = np.maximum(0, sizes - n + 3)
        starts = np.cumsum(sizes + 1) - sizes - 1  # of the border before each word
        ends = np.cumsum(count)
        at = np.repeat(starts - (ends - count), count) + np.arange(int(count.sum()))
        raw = np.frombuffer(joined, np.uint8).astype(np.uint64)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = h * np.uint64(1099511628211) + raw[at + i] + np.uint64(1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        found.append((h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
        counts.append(count)
    return np.concatenate(found), np.concatenate(counts)


def log_odds(toxic: np.ndarray, clean: np.ndarray, rate: float) -> np.ndarray:
    """Of what toxic and clean texts have it, drawn towards none."""
    return np.log((toxic + SHRINK * rate) / (clean + SHRINK * (1 - rate)) * ((1 - rate) / rate)).astype(np.float32)


def pool(values: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum and mean of each word's run of values; 0 for a word without any."""
    top, mean = np.zeros(len(count), np.float32), np.zeros(len(count), np.float32)
    some = np.flatnonzero(count)
    if len(some):
        cuts = (np.cumsum(count) - count)[some]
        top[some] = np.maximum.reduceat(values, cuts)
        mean[some] = np.add.reduceat(values, cuts) / count[some]
    return top, mean


@dataclass
class Tables:
    """Words that at least two training texts have, their log-odds, and those of the n-gram buckets."""

    vocabulary: pa.Array
    words: np.ndarray
    grams: list[np.ndarray]

    def features(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """(word, BASE) for distinct words, the place of each in the vocabulary (-1: none), and its first kind of n-grams."""
        lower = bare(words)
        at = pc.fill_null(pc.index_in(lower, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
        out, grams = np.zeros((len(words), BASE), np.float32), None
        if len(self.words):
            out[:, 0] = np.where(at >= 0, self.words[at], 0)
        out[:, 1] = at >= 0
        out[:, 2] = np.minimum(pc.utf8_length(lower).to_numpy(zero_copy_only=False), 20) / 10
        for k, n in enumerate(GRAMS):
            h, count = gram_buckets(lower, n)
            out[:, 3 + 2 * k], out[:, 4 + 2 * k] = pool(self.grams[k][h], count)
            grams = (h, count) if grams is None else grams
        return out, at, grams


class Embeddings:
    """Rows of words, the first for those outside the vocabulary, and of character n-grams by bucket; learned by Adagrad."""

    def __init__(self, vocabulary: int, rng: np.random.Generator):
        self.words = (0.1 * rng.normal(size=(vocabulary + 1, WORD_DIM))).astype(np.float32)
        self.chars = (0.1 * rng.normal(size=(CHARS, CHAR_DIM))).astype(np.float32)
        self._seen = (np.zeros_like(self.words), np.zeros_like(self.chars))

    def of(self, rows: np.ndarray, buckets: np.ndarray, count: np.ndarray) -> np.ndarray:
        """(word, WORD_DIM + CHAR_DIM) from each word's row and its n-grams' buckets, one word's after another's."""
        mean = np.zeros((len(rows), CHAR_DIM), np.float32)
        some = np.flatnonzero(count)
        if len(some):
            mean[some] = np.add.reduceat(self.chars[buckets & (CHARS - 1)], (np.cumsum(count) - count)[some]) / count[some, None]
        return np.concatenate([self.words[rows], mean], 1)

    def learn(self, grad: np.ndarray, rows: np.ndarray, buckets: np.ndarray, count: np.ndarray, rate: float = 0.01) -> None:
        """One step against the gradient of what of() returned."""
        own = np.zeros_like(self.words)
        np.add.at(own, rows, grad[:, :WORD_DIM])
        part = np.repeat(grad[:, WORD_DIM:] / np.maximum(count, 1)[:, None], count, axis=0)
        key = buckets & (CHARS - 1)
        grams = np.stack([np.bincount(key, part[:, k], CHARS) for k in range(CHAR_DIM)], 1).astype(np.float32)
        for table, seen, g in zip((self.words, self.chars), self._seen, (own, grams)):
            seen += g * g
            table -= rate * g / (np.sqrt(seen) + 1e-4)

    def __getstate__(self) -> dict:
        return {"words": self.words, "chars": self.chars}


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of every window; each text has one at least."""
    count = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(lengths)), count)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return text, start, np.minimum(WINDOW, lengths[text] - start)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters p: for each direction d input (Wd), recurrent (Ud) and bias (bd) of update, reset and candidate; attention A, a, v; output o, c."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"A": draw(2 * HIDDEN, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": draw(ATTEND), "o": draw(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": draw(FEATURES, 3 * HIDDEN) * 0.5, f"U{d}": draw(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}

    def project(self, x: np.ndarray) -> np.ndarray:
        """What a word adds to the gates of both directions."""
        return np.concatenate([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], 1)

    def run(self, gates: np.ndarray, index: np.ndarray, lengths: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows in order of falling length; index (window, WINDOW) names rows of gates."""
        n, H = len(index), HIDDEN
        active = [int(np.searchsorted(-lengths, -t)) for t in range(WINDOW)]  # windows with more than t words
        states = np.zeros((WINDOW, n, 2 * H), np.float32)
        for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            U, side, h = self.p[f"U{d}"], slice(0, H) if d == "f" else slice(H, 2 * H), np.zeros((n, H), np.float32)
            for t in order:
                if not (m := active[t]):
                    continue
                g = gates[index[:m, t], 0 if d == "f" else 3 * H : 3 * H if d == "f" else 6 * H]
                zr = sigmoid(g[:, : 2 * H] + h[:m] @ U[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                rh = r * h[:m]
                new = np.tanh(g[:, 2 * H :] + rh @ U[:, 2 * H :])
                if keep is not None:
                    keep.append((d, t, m, h[:m].copy(), z, r, rh, new))
                h[:m] += z * (new - h[:m])
                states[t, :m, side] = h[:m]
        u = np.tanh(states @ self.p["A"] + self.p["a"])
        e = u @ self.p["v"]
        e[np.arange(WINDOW)[:, None] >= np.maximum(lengths, 1)[None, :]] = -1e9
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[:, :, None] * states).sum(0)
        if keep is not None:
            keep.append((states, u, w, pooled))
        return pooled @ self.p["o"] + self.p["c"]

    def gradients(self, x: np.ndarray, index: np.ndarray, lengths: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict:
        """Of the weighted cross-entropy of windows, by every parameter, and by x under that name."""
        p, H, keep = self.p, HIDDEN, []
        logits = self.run(self.project(x), index, lengths, keep)
        states, u, w, pooled = keep.pop()
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        dl = (sigmoid(logits) - target) * weight
        grad["o"], grad["c"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
        dpool = dl[:, None] * p["o"]
        dw = (states * dpool).sum(2)
        de = w * (dw - (w * dw).sum(0))
        grad["v"] = (u * de[:, :, None]).sum((0, 1))
        du = de[:, :, None] * p["v"] * (1 - u * u)
        grad["A"], grad["a"] = np.einsum("tni,tnj->ij", states, du), du.sum((0, 1))
        ds = w[:, :, None] * dpool + du @ p["A"].T
        dgates = np.zeros((len(x), 6 * H), np.float32)
        dh = {d: np.zeros((len(index), H), np.float32) for d in "fb"}
        for d, t, m, before, z, r, rh, new in reversed(keep):
            U, side = p[f"U{d}"], slice(0, H) if d == "f" else slice(H, 2 * H)
            g = dh[d][:m] + ds[t, :m, side]
            dn = g * z * (1 - new * new)
            dz = g * (new - before) * z * (1 - z)
            drh = dn @ U[:, 2 * H :].T
            dr = drh * before * r * (1 - r)
            dzr = np.concatenate([dz, dr], 1)
            grad[f"U{d}"][:, : 2 * H] += before.T @ dzr
            grad[f"U{d}"][:, 2 * H :] += rh.T @ dn
            dh[d][:m] = g * (1 - z) + drh * r + dzr @ U[:, : 2 * H].T
            np.add.at(dgates[:, 0 if d == "f" else 3 * H : 3 * H if d == "f" else 6 * H], index[:m, t], np.concatenate([dzr, dn], 1))
        for d, part in (("f", dgates[:, : 3 * H]), ("b", dgates[:, 3 * H :])):
            grad[f"W{d}"], grad[f"b{d}"] = x.T @ part, part.sum(0)
        grad["x"] = dgates[:, : 3 * H] @ p["Wf"].T + dgates[:, 3 * H :] @ p["Wb"].T
        return grad

    def logits(self, gates: np.ndarray, codes: np.ndarray, offsets: np.ndarray, size: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Text and logit of every window of the texts whose words are codes[offsets[i]:offsets[i + 1]]."""
        text, start, length = windows_of(np.diff(offsets))
        order = np.argsort(-length, kind="stable")
        out = np.zeros(len(text), np.float32)
        padded = np.concatenate([codes, np.zeros(WINDOW, codes.dtype)])
        for a in range(0, len(order), size):
            some = order[a : a + size]
            index = padded[(offsets[text[some]] + start[some])[:, None] + np.arange(WINDOW)]
            out[some] = self.run(gates, index, length[some])
        return text, out


def runs(sizes: np.ndarray, most: int, rows: int = 1500) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of at most ``rows`` whose sizes add up to ``most`` or less; a larger one alone."""
    ends, a = np.cumsum(sizes), 0
    while a < len(ends):
        before = ends[a - 1] if a else 0
        b = min(a + rows, max(a + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield a, b
        a = b


def parts(texts: pa.Array, rows: int = 1500) -> Iterator[pa.Array]:
    """texts in runs of at most ``rows`` and some PART_BYTES, a longer text alone."""
    for a, b in runs(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64), PART_BYTES, rows):
        yield texts.slice(a, b - a)


@dataclass
class Model:
    tables: Tables
    embeddings: Embeddings
    network: Network
    scale: float = 1.0
    shift: float = 0.0

    def inputs(self, words: pa.Array) -> np.ndarray:
        """(word, FEATURES) of distinct words."""
        base, at, (h, count) = self.tables.features(words)
        return np.concatenate([base, self.embeddings.of(at + 1, h, count)], 1)

    def highest(self, texts: pa.Array) -> np.ndarray:
        """The highest logit of each text's windows."""
        out = [np.zeros(0)]
        for part in parts(texts):
            codes, offsets, words = words_of(part)
            gates = self.network.project(np.concatenate([self.inputs(words), np.zeros((1, FEATURES), np.float32)]))
            text, logit = self.network.logits(gates, codes, offsets)
            top = np.full(len(offsets) - 1, -np.inf, np.float64)
            np.maximum.at(top, text, logit)
            out.append(top)
        return np.concatenate(out)

    def score(self, texts: pa.Array) -> np.ndarray:
        """From 0 to 1 for each text, null and empty ones too."""
        return sigmoid(self.scale * self.highest(texts) + self.shift)


def calibrated(top: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of logits, by Newton's method, drawn slightly to a scale of 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        q = sigmoid(a * top + b)
        g = np.array([((q - y) * top).sum() + 0.5 * (a - 1), (q - y).sum()])
        s = q * (1 - q) + 1e-6
        h = np.array([[(s * top * top).sum() + 0.5, (s * top).sum()], [(s * top).sum(), s.sum() + 1e-3]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(a - move[0], 0.05), b - move[1]
    return float(a), float(b)


def fit(texts: list[str | None], labels: list[int], epochs: int = 14, seed: int = 0) -> Model | None:
    """None if one of the two labels is missing. With too few of either to set some apart, all train and calibrate."""
    y = np.asarray(labels, np.int64)
    if not 0 < y.sum() < len(y):
        return None
    apart = np.zeros(len(y), bool)
    apart[np.argsort(y, kind="stable")] = np.arange(len(y)) % 5 == 4
    if not all(0 < y[m].sum() < m.sum() for m in (apart, ~apart)):
        apart[:] = False
    model, top = trained([t for t, m in zip(texts, apart) if not m], y[~apart], epochs, seed)
    give_back()  # what training held is not there while the other texts are scored
    if apart.any():
        top = model.highest(pa.array([t for t, m in zip(texts, apart) if m], pa.large_string()))
    model.scale, model.shift = calibrated(top, y[apart] if apart.any() else y)
    return model


def trained(texts: list[str | None], y: np.ndarray, epochs: int, seed: int) -> tuple[Model, np.ndarray]:
    """An uncalibrated model, and the highest logit of each text."""
    rng, rate = np.random.default_rng(seed), float(y.mean())
    codes, offsets, words = words_of(pa.array(texts, pa.large_string()))
    lower = bare(words).dictionary_encode()
    codes, words = lower.indices.to_numpy().astype(np.int64)[codes], lower.dictionary
    text_of = np.repeat(np.arange(len(y)), np.diff(offsets))
    pairs = np.unique(text_of * len(words) + codes)  # each text's distinct words
    text, word = pairs // max(1, len(words)), pairs % max(1, len(words))

    def counts(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(key[y[doc] == 1], minlength=n).astype(float), np.bincount(key[y[doc] == 0], minlength=n).astype(float)

    both = counts(text, word, len(words))
    seen = [both]
    for n in GRAMS:
        h, count = gram_buckets(words, n)
        first, sums = np.cumsum(count) - count, (np.zeros(BUCKETS), np.zeros(BUCKETS))
        for lo, hi in runs(np.bincount(text, count[word], len(y)), 1_000_000):  # some texts at a time: their n-grams are many
            a, b = np.searchsorted(text, [lo, hi])
            m = count[word[a:b]]
            at = np.repeat(first[word[a:b]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            key = np.unique(np.repeat(text[a:b], m) * BUCKETS + h[at])
            for label, total in zip((1, 0), sums):
                total += np.bincount(key[y[key // BUCKETS] == label] % BUCKETS, minlength=BUCKETS)
        seen.append(sums)
    del pairs, text, word
    common = np.flatnonzero(both[0] + both[1] >= 2)
    made = lambda less: Tables(words, log_odds(np.maximum(both[0] - less[0], 0), np.maximum(both[1] - less[1], 0), rate), [log_odds(np.maximum(a - less[0], 0), np.maximum(b - less[1], 0), rate) for a, b in seen[1:]])
    final = Tables(words.take(pa.array(common)), log_odds(both[0][common], both[1][common], rate), [log_odds(a, b, rate) for a, b in seen[1:]])
    # a text's own label is left out: toxic texts see the tables with one toxic text less, clean ones with one clean less
    known = (both[0] + both[1] >= 2).astype(np.float32)
    (first_feats, _, (grams, n_grams)), (other_feats, _, _) = (made(less).features(words) for less in ((0, 1), (1, 0)))
    feats = [first_feats, other_feats]
    for f in feats:
        f[:, 0] *= known
        f[:, 1] = known
    x = np.concatenate([*feats, np.zeros((1, BASE), np.float32)])
    embeddings, row_of = Embeddings(len(common), rng), np.zeros(len(words) + 1, np.int64)
    row_of[common] = np.arange(len(common)) + 1
    first_gram = np.concatenate([np.cumsum(n_grams) - n_grams, [0]])
    n_grams = np.concatenate([n_grams, [0]])

    def learned(used: np.ndarray, forget: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedding rows, n-grams and their counts of rows of x; a share of the words is read as unknown."""
        word = np.where(used < 2 * len(words), used % max(1, len(words)), len(words))
        n = n_grams[word]
        at = np.repeat(first_gram[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.where(rng.random(len(word)) < forget, 0, row_of[word]), grams[at], n

    own = np.concatenate([codes + len(words) * y[text_of], np.full(WINDOW, len(x) - 1)])
    wtext, start, length = windows_of(np.diff(offsets))
    where = offsets[wtext] + start
    network, step = Network(seed), 0
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    strength = np.concatenate([[0], np.cumsum(np.maximum(x[own[: len(codes)], 3:BASE].max(1) if len(codes) else np.zeros(0), 0) ** 2)])
    logit = strength[where + length] - strength[where]  # before the first epoch
    for epoch in range(epochs):
        # windows of the epoch: each text's highest, and for clean texts some others
        order = np.lexsort((-logit, wtext))
        top = order[np.concatenate([[True], np.diff(wtext[order]) > 0])]
        clean = np.flatnonzero(y[wtext] == 0)
        others = rng.choice(clean, min(len(clean), 2 * len(y)), replace=False)
        chosen = np.concatenate([top, others])
        rng.shuffle(chosen)
        for a in range(0, len(chosen), 256):
            some = chosen[a : a + 256]
            some = some[np.argsort(-length[some], kind="stable")]
            index = own[where[some][:, None] + np.arange(WINDOW)]
            used, local = np.unique(index, return_inverse=True)
            t = y[wtext[some]].astype(np.float32)
            parts_of = learned(used, 0.2)
            grad = network.gradients(np.concatenate([x[used], embeddings.of(*parts_of)], 1), local.reshape(index.shape), length[some], t, np.full(len(some), 1 / len(some), np.float32))
            embeddings.learn(grad.pop("x")[:, BASE:], *parts_of)
            step += 1
            rate_now = 0.02 * (1 - epoch / epochs) + 0.001
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                network.p[k] -= (rate_now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        seen_logits = []
        for lo, hi in runs(np.diff(offsets), 50_000):
            cut = offsets[lo : hi + 1]
            used, local = np.unique(own[cut[0] : cut[-1]], return_inverse=True)
            inputs = np.concatenate([x[used], embeddings.of(*learned(used))], 1)
            gates = network.project(np.concatenate([inputs, np.zeros((1, FEATURES), np.float32)]))
            seen_logits.append(network.logits(gates, local, cut - cut[0])[1])
        logit = np.concatenate(seen_logits)
    top = np.full(len(y), -np.inf)
    np.maximum.at(top, wtext, logit.astype(np.float64))
    return Model(final, embeddings, network), top


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """True where crc32(doc_id as text) is divisible by folds; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Fitted on at most ``sample`` labelled documents and ``sample_bytes`` of text, none of them held out.

    Null labels don't count, of several for one document the largest does. Of rows that repeat a document's text one
    counts. Only ids, hashes and lengths of the candidates come to the driver before the texts that fit are chosen.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("_toxic"))
    some = marked.where(~held_out("_id")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").alias("_d"), text.alias("_t"), F.xxhash64(text).alias("_h"))
    sized = own.join(F.broadcast(some), F.col("_d") == F.col("_id")).where(F.octet_length("_t") <= sample_bytes // 16)
    sized = sized.groupBy("_id", "_h").agg(F.max("_toxic").alias("_toxic"), F.max(F.octet_length("_t")).alias("_n"))
    chosen, room = [], sample_bytes
    for r in sized.orderBy(F.xxhash64("_id"), "_id", "_h").limit(sample).collect():
        if r["_n"] <= room:
            chosen.append((r["_id"], r["_h"], r["_toxic"]))
            room -= r["_n"]
    if not 0 < sum(t for *_, t in chosen) < len(chosen):
        return None
    picked = F.broadcast(docs.sparkSession.createDataFrame([c[:2] for c in chosen], "_i bigint, _k bigint"))  # at most ``sample`` rows
    texts = own.join(picked, (F.col("_d") == F.col("_i")) & (F.col("_h") == F.col("_k"))).groupBy("_i", "_k").agg(F.first("_t").alias("_t"))
    found = {(r["_i"], r["_k"]): r["_t"] for r in texts.collect()}
    chosen = sorted(c for c in chosen if c[:2] in found)
    model = fit([found[c[:2]] for c in chosen], [c[2] for c in chosen])
    give_back()
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs; without a model every score is 0.

    Null and empty texts are scored as a text without words. Repeated rows are scored each. Columns other than doc_id
    and text are not looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.zeros(batch.num_rows) if held.value is None else held.value.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])
            give_back()

    scored = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs whose score is below 0.5, with all their columns; only texts go to Python, only marks come back."""
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)

    def clean(texts: pa.Array) -> pa.Array:
        marks = pa.array(held.value.score(texts) < 0.5)
        give_back()
        return marks

    return docs.where(F.arrow_udf(clean, "boolean")(F.col("text").cast("string")))
