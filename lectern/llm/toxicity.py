"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import U64, folded, mix64, prepare, words_of
from .quality import labelled_sample

#: Labelled documents fitted on, half of each class if there are so many. A documented bound.
SAMPLE = 3_000
EPOCHS, DOCS_PER_STEP, SEED = 8, 32, 7
#: Share of the epochs in which documents learn through random windows, so that what many share is learnt before what one
#: of them holds. Chosen by four-fold runs inside the learning rows.
WARM = 0.75
#: A small sample is gone through more often, for about this many steps.
LEAST_STEPS = 600
WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
WORD_ROWS, CHAR_ROWS = 1 << 12, 1 << 13
#: Character runs of a word that are looked up, in bytes: all of them, wherever they start.
GRAMS = (2, 3, 4)
#: A longer word (a sentence without spaces) is so many bytes at a time a place of its own in the windows; each
#: piece but the first begins LAP bytes early, so that every run is whole in one of them.
PIECE, LAP = 16, max(GRAMS) - 1
WINDOWS_AT_ONCE = 2048
#: Distinct words whose inputs a task keeps between batches (50 MB).
KEPT_WORDS = 1 << 18
#: Texts, and their bytes, that are scored together.
TEXTS_AT_ONCE, BYTES_AT_ONCE = 500, 4 << 20
#: A labelled document longer than this (characters) is not fitted on, so that the sample stays below 150 MB; it is scored like all others.
SAMPLE_CHARS = 50_000


def _char_rows(data: np.ndarray, start: np.ndarray, end: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character table, of all words one after another, and how many each has; where lead is 1 a mark before the start tells prefixes apart."""
    size = end - start + lead
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(owner)) - begin[owner]
    chars = np.zeros(len(owner) + LAP, dtype=U64)
    chars[: len(owner)] = data[np.maximum(start[owner] + nth - lead[owner], 0)]
    chars[begin[lead == 1]] = 1
    left = size[owner] - nth
    out = np.zeros((len(owner), len(GRAMS)), dtype=np.int32)
    for g, n in enumerate(GRAMS):
        acc = np.full(len(owner), U64(n))
        for k in range(n):
            acc = acc * U64(0x100000001B3) + chars[k : k + len(owner)]
        out[:, g] = np.where(left >= n, (mix64(acc) % U64(CHAR_ROWS - 1)).astype(np.int32) + 1, 0)
    there = out > 0
    return out[there], np.add.reduceat(there.sum(axis=1), begin)


def places_of(folded_bytes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and lead (1: begins a word) of every word of folded bytes, long words in pieces."""
    h, s, e = words_of(folded_bytes)
    count = -(-(e - s) // PIECE)
    owner = np.repeat(np.arange(len(h)), count)
    nth = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    start, end = s[owner] + nth * PIECE - LAP * (nth > 0), np.minimum(e[owner], s[owner] + (nth + 1) * PIECE)
    hashes, lead = h[owner], (nth == 0).astype(np.int64)
    cut = np.flatnonzero(count[owner] > 1)
    if len(cut):
        data = np.frombuffer(folded_bytes, dtype=np.uint8)
        acc = mix64(lead[cut].astype(U64) + U64(0x632BE59BD9B4E019))
        for k in range(PIECE + LAP):
            at = start[cut] + k
            own = np.where(at < end[cut], data[np.minimum(at, len(data) - 1)].astype(U64) + U64(1), U64(0))
            acc = (acc ^ own) * U64(0x9E3779B97F4A7C15)
            acc ^= acc >> U64(29)
        hashes[cut] = mix64(acc)
    return hashes, start, end, lead


class WordRows:
    """Rows of the embedding tables for some words: one each of the word table, and a run of the character table's."""

    def __init__(self, words, data, start, end, lead):
        self.word_rows = (words % U64(WORD_ROWS - 1)).astype(np.int32) + 1
        none = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.rows, self.count = _char_rows(data, start, end, lead) if len(words) else none  # every word has one at least
        self.begin = np.cumsum(self.count) - self.count


class Vocabulary:
    """The distinct words of a batch of texts, and each text as places in it (0 is padding)."""

    def __init__(self, texts):
        hashes, starts, ends, leads, data, offset, sizes = [], [], [], [], [], 0, []
        for text in texts:
            own = folded(text)
            h, s, e, lead = places_of(own)
            hashes.append(h)
            starts.append(s + offset)
            ends.append(e + offset)
            leads.append(lead)
            sizes.append(len(h))
            data.append(own)
            offset += len(own)
        self.data = np.frombuffer(b"".join(data), dtype=np.uint8)
        every = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.words, first, place = np.unique(every, return_index=True, return_inverse=True)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.places = place.astype(np.int32) + 1
        none = np.zeros(0, np.int64)
        self.start = np.concatenate(starts)[first] if hashes else none
        self.end = np.concatenate(ends)[first] if hashes else none
        self.lead = np.concatenate(leads)[first] if hashes else none

    def part(self, words: np.ndarray) -> WordRows:
        return WordRows(self.words[words], self.data, self.start[words], self.end[words], self.lead[words])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows, WINDOW) places, and the text of each window: all overlapping windows; a text without words has one of padding."""
        count = 1 + np.maximum(0, -(-(self.sizes - WINDOW) // STRIDE))
        owner = np.repeat(np.arange(len(self.sizes)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        begin = np.cumsum(self.sizes) - self.sizes
        at = nth[:, None] * STRIDE + np.arange(WINDOW)
        inside = at < self.sizes[owner][:, None]
        if not len(self.places):
            return np.zeros(at.shape, np.int32), owner
        return np.where(inside, self.places[np.clip(at + begin[owner][:, None], 0, len(self.places) - 1)], 0), owner


class Known:
    """Projected inputs of the words that a task has met, in order of their hashes; emptied when full."""

    def __init__(self):
        self.words, self.rows = np.zeros(0, U64), np.zeros((0, 6 * HIDDEN), np.float32)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.words):
            return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return self.words[at] == words, at

    def add(self, words: np.ndarray, rows: np.ndarray) -> None:
        if len(self.words) + len(words) > KEPT_WORDS:
            self.words, self.rows = words[:KEPT_WORDS], rows[:KEPT_WORDS]
            return
        at = np.searchsorted(self.words, words)
        self.words, self.rows = np.insert(self.words, at, words), np.insert(self.rows, at, rows, axis=0)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Word and character embeddings, a gated recurrent unit each way, attention over its states, one logit per window."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, WORD_DIM + CHAR_DIM
        f = lambda *s, by=0.3: rng.normal(0, by, s).astype(np.float32)
        self.p = {
            "word": f(WORD_ROWS, WORD_DIM, by=0.1), "char": f(CHAR_ROWS, CHAR_DIM, by=0.3), "wx": f(d, 6 * h), "bx": np.zeros(6 * h, np.float32),
            "uf": f(h, 3 * h), "ub": f(h, 3 * h), "wa": f(2 * h, h), "va": f(h), "wo": f(2 * h), "bo": np.zeros(1, np.float32),
        }
        self.p["word"][0] = self.p["char"][0] = 0
        self.shift = 0.0

    def inputs(self, words: WordRows, drop: np.ndarray | None = None) -> np.ndarray:
        """Embeddings of words: the word's own, and the scaled sum over its character runs."""
        word = self.p["word"][words.word_rows]
        if drop is not None:
            word = word * drop[:, None]
        if not len(words.rows):
            return np.zeros((len(word), WORD_DIM + CHAR_DIM), np.float32)
        chars = np.add.reduceat(self.p["char"][words.rows], words.begin, axis=0)
        return np.hstack([word, chars / np.sqrt(words.count)[:, None].astype(np.float32)])

    def projected(self, vocabulary: Vocabulary, known: Known | None = None) -> np.ndarray:
        """Inputs times wx for each place of a vocabulary (row 0: padding); known: keeps those of words met before."""
        out = np.empty((len(vocabulary.words) + 1, 6 * HIDDEN), np.float32)
        out[0] = self.p["bx"]
        missing = np.arange(len(vocabulary.words))
        if known is not None:
            found, at = known.find(vocabulary.words)
            out[1:][found] = known.rows[at[found]]
            missing = np.flatnonzero(~found)
        for at in range(0, len(missing), 8192):
            part = missing[at : at + 8192]
            out[part + 1] = self.inputs(vocabulary.part(part)) @ self.p["wx"] + self.p["bx"]
        if known is not None:
            known.add(vocabulary.words[missing], out[missing + 1])
        return out

    def _direction(self, x, mask, u, keep):
        """States over time of one direction; x (time, windows, 3h). keep: also what the way back needs."""
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        states, saved = np.empty((len(x), *h.shape), np.float32), []
        k = HIDDEN
        for t in range(len(x)):
            a = h @ u
            gates = _sigmoid(x[t, :, : 2 * k] + a[:, : 2 * k])
            z, r = gates[:, :k], gates[:, k:]
            n = np.tanh(x[t, :, 2 * k :] + r * a[:, 2 * k :])
            new = n + z * (h - n)
            if keep:
                saved.append((h, z, r, n, a[:, 2 * k :]))
            h = np.where(mask[t], new, h)
            states[t] = h
        return states, saved

    def forward(self, table: np.ndarray, places: np.ndarray, keep: bool = False):
        """Logits of windows. table: inputs times wx, by place."""
        x = table[places.T]
        mask = (places.T > 0)[:, :, None]
        f, save_f = self._direction(x[:, :, : 3 * HIDDEN], mask, self.p["uf"], keep)
        b, save_b = self._direction(x[::-1, :, 3 * HIDDEN :], mask[::-1], self.p["ub"], keep)
        states = np.concatenate([f, b[::-1]], axis=2)
        act = np.tanh(states @ self.p["wa"])
        e = np.where(mask[:, :, 0], act @ self.p["va"], np.float32(-30))
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = (alpha[:, :, None] * states).sum(axis=0)
        logit = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logit, (mask, save_f, save_b, states, act, alpha, pooled)) if keep else logit

    def logits(self, vocabulary: Vocabulary, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
        places, owner = vocabulary.windows()
        table = self.projected(vocabulary, known)
        parts = [self.forward(table, places[at : at + WINDOWS_AT_ONCE]) for at in range(0, len(places), WINDOWS_AT_ONCE)]
        return (np.concatenate(parts) if parts else np.zeros(0, np.float32)), owner

    def scored(self, texts: list[str | None], known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Per text the number of its windows and the highest one's probability."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0)
        logit, owner = self.logits(Vocabulary(texts), known)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, logit.astype(float))
        return np.bincount(owner, minlength=len(texts)), 1 / (1 + np.exp(-np.clip(best - self.shift, -30, 30)))

    def _back_direction(self, grad, saved, mask, u, g, name, dx):
        k = HIDDEN
        dh = np.zeros_like(grad[0])
        for t in range(len(grad) - 1, -1, -1):
            h, z, r, n, an = saved[t]
            dh = dh + grad[t]
            dnew = np.where(mask[t], dh, 0)
            through = np.where(mask[t], 0, dh)
            dn = dnew * (1 - z) * (1 - n * n)
            dz = dnew * (h - n) * z * (1 - z)
            dr = dn * an * r * (1 - r)
            da = np.concatenate([dz, dr, dn * r], axis=1)
            dx[t] = np.concatenate([dz, dr, dn], axis=1)
            g[name] += h.T @ da
            dh = through + dnew * z + da @ u.T

    def gradients(self, vocabulary, places, target, weight, drop):
        """Loss gradients over the given windows (cross entropy, weighted)."""
        inputs = np.vstack([np.zeros((1, WORD_DIM + CHAR_DIM), np.float32), self.inputs(vocabulary, drop)])
        logit, (mask, sf, sb, states, act, alpha, pooled) = self.forward(inputs @ self.p["wx"] + self.p["bx"], places, True)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = ((1 / (1 + np.exp(-logit)) - target) * weight / len(target)).astype(np.float32)
        g["wo"], g["bo"] = pooled.T @ d, np.array([d.sum()], np.float32)
        dpool = d[:, None] * self.p["wo"]
        dalpha = (states * dpool).sum(axis=2)
        dstates = alpha[:, :, None] * dpool
        de = np.where(mask[:, :, 0], alpha * (dalpha - (alpha * dalpha).sum(axis=0)), 0)
        g["va"] = np.einsum("tw,twk->k", de, act)
        dact = de[:, :, None] * self.p["va"] * (1 - act * act)
        g["wa"] = np.einsum("twi,twk->ik", states, dact)
        dstates = dstates + dact @ self.p["wa"].T
        dx = np.zeros((*states.shape[:2], 6 * HIDDEN), np.float32)
        own = np.zeros((*states.shape[:2], 3 * HIDDEN), np.float32)
        self._back_direction(dstates[:, :, :HIDDEN], sf, mask, self.p["uf"], g, "uf", own)
        dx[:, :, : 3 * HIDDEN] = own
        own = np.zeros_like(own)
        self._back_direction(dstates[::-1, :, HIDDEN:], sb, mask[::-1], self.p["ub"], g, "ub", own)
        dx[:, :, 3 * HIDDEN :] = own[::-1]
        used, slot = np.unique(places.T, return_inverse=True)
        dtable = np.zeros((len(used), 6 * HIDDEN), np.float32)
        np.add.at(dtable, slot.ravel(), dx.reshape(-1, 6 * HIDDEN))
        g["bx"], g["wx"] = dtable.sum(axis=0), inputs[used].T @ dtable
        dinput = dtable @ self.p["wx"].T
        real = used > 0
        rows = used[real] - 1
        dinput = dinput[real]
        np.add.at(g["word"], vocabulary.word_rows[rows], dinput[:, :WORD_DIM] * (1 if drop is None else drop[rows][:, None]))
        dchar = np.zeros((len(vocabulary.word_rows), CHAR_DIM), np.float32)
        dchar[rows] = dinput[:, WORD_DIM:] / np.sqrt(vocabulary.count[rows])[:, None]
        np.add.at(g["char"], vocabulary.rows, np.repeat(dchar, vocabulary.count, axis=0))
        g["word"][0] = g["char"][0] = 0
        return g

    def fit(self, texts: list[str | None], y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
        """Each document learns through its highest window (a toxic text has one at least, a clean one none), clean ones also through random ones.

        In the first epochs windows are drawn at random, later the highest ones are found anew each epoch. Adam steps over shuffled documents; half of the words' own vectors are dropped at a time, so
        that characters carry unseen words. At the end the shift that parts the sample best becomes 0.5.
        """
        y = np.asarray(y, dtype=np.float32)
        if not len(y) or y.min() == y.max():
            self.shift = np.inf if not len(y) or y.max() == 0 else -np.inf
            return self
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        vocabulary = Vocabulary(texts)
        places, owner = vocabulary.windows()
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        balance = min(8.0, float((y == 0).sum() / (y == 1).sum()))
        epochs = max(epochs, min(30, LEAST_STEPS * DOCS_PER_STEP // len(y)))
        step, steps = 0, epochs * -(-len(y) // DOCS_PER_STEP)
        for epoch in range(epochs):
            logit = self.logits(vocabulary)[0] if epoch >= WARM * epochs else rng.random(len(owner))
            top = np.lexsort((-logit, owner))[first]
            order = rng.permutation(len(y))
            for at in range(0, len(y), DOCS_PER_STEP):
                part = order[at : at + DOCS_PER_STEP]
                others = rng.integers(0, len(owner), DOCS_PER_STEP // 2)
                chosen = np.concatenate([top[part], others[y[owner[others]] == 0]])
                target = y[owner[chosen]]
                weight = np.where(target == 1, balance, 1.0).astype(np.float32)
                used, place = np.unique(np.append(places[chosen], 0), return_inverse=True)
                own = vocabulary.part(used[1:] - 1)
                drop = (rng.random(len(own.word_rows)) < 0.5).astype(np.float32)
                g = self.gradients(own, place[:-1].reshape(-1, WINDOW), target, weight, drop)
                step += 1
                rate = 0.02 * (1 - 0.9 * step / steps)
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.99 * s[k] + 0.01 * v * v
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
        logit = self.logits(vocabulary)[0].astype(float)
        self.shift = best_cut(np.maximum.reduceat(logit, first), y)
        return self


def best_cut(value: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best balanced accuracy; of several, the middle of the widest gap."""
    order = np.argsort(value)
    v, t = value[order], y[order]
    below = np.cumsum(t)[:-1] / t.sum()  # toxic ones that a cut after here misses
    right = np.cumsum(1 - t)[:-1] / (1 - t).sum() - below
    top = np.flatnonzero(right >= right.max() - 1e-9)
    k = top[np.argmax(v[top + 1] - v[top])]
    return float((v[k] + v[k + 1]) / 2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Network:
    rows = labelled_sample(docs, labels, label, id_col, text_col, 5, 0, sample, chars=SAMPLE_CHARS).select("_o", "y", "text").collect()
    rows.sort(key=lambda r: (r["_o"], r["y"], r["text"] or ""))
    return Network().fit([r["text"] for r in rows], np.array([int(r["y"] == 1) for r in rows]))


def stretches(sizes: list[int | None], texts: int = TEXTS_AT_ONCE, most: int = BYTES_AT_ONCE):
    """(from, to) of runs of at most so many texts, and of so many bytes unless one text alone has more."""
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if k > start and (k - start == texts or held + (size or 0) > most):
            yield start, k
            start, held = k, 0
        held += size or 0
    if start < len(sizes):
        yield start, len(sizes)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", model: Network | None = None
) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 if the score is 0.5 or more), ``n_windows``.

    The score is that of the highest of all overlapping windows (32 words, 16 apart) over the whole
    text, and of a word all character runs count; each 16 bytes of a longer word are as a word in the
    windows. The network is trained on the driver on at most 3,000 labelled documents of up to 50,000
    characters outside the held-out fold; its weights (0.4 MB) go to the tasks. Null and empty texts
    have one window of padding. Without labels, or with one class only, all scores are that class's.
    Repeated rows give repeated rows; a null id is not held out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    model = model or fit_toxicity(docs, labels, id_col, text_col, label)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        net, known = shared.value, Known()
        for batch in batches:
            for at, to in stretches(pc.binary_length(batch.column(1)).to_pylist()):
                part = batch.slice(at, to - at)
                texts = part.column(1).to_pylist()
                windows, scores = net.scored(texts, known)
                held = [v is not None and zlib.crc32(str(v).encode()) % 5 == 0 for v in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(held, pa.bool_()), pa.array(scores, pa.float64()), pa.array(scores >= 0.5).cast(pa.int32()), pa.array(windows, pa.int64())],
                    [id_col, "held_out", "score", "predicted", "n_windows"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, held_out boolean, score double, predicted int, n_windows long")
