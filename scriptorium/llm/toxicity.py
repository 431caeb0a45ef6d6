"""Toxicity: a bidirectional gated recurrent network with attention pooling,
trained in numpy, that scores all overlapping windows of every whole text.

Each word enters by two ways: an embedding of the whole word, and one pooled
over its character n-grams, so that invented endings and spellings of a known
stem are still seen; beside them stand the log-odds of word and n-grams among
the labelled texts.  A forward and a backward recurrence run over a window, an
attention layer weighs their states, and a logistic unit scores the mean.  A
text's score is that of its highest window.

The network is fitted on the driver and broadcast; its size does not depend on the
data.  It learns from a bounded sample of labelled rows, at most SAMPLE of either
class, one row per id.  Their whole texts stay in executors, which count in how many
texts of each class a feature stands, choose the windows to learn from, and score
all windows to set the threshold; what reaches the driver is those counts, a few
windows of each text, and one number for each.  Since a label holds for a whole
text, each text takes part by those of its windows that look worst, and for clean
ones by some others too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.llm.common import RollingHash, Scratch, map_batches, slices, texts_of

WINDOW, STRIDE = 48, 24
BUCKETS, WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 1 << 15, 6, 6, 8, 8
GRAMS = (3, 4, 5)
#: Labelled rows of each class that are used at most, least passes over them and steps, and windows at once.
SAMPLE, EPOCHS, STEPS, BATCH, RATE = 1000, 5, 80, 256, 0.02
#: Bytes of a window above which it is not learned from: words of such length are no words.
WINDOW_BYTES = 1 << 14
THRESHOLD = 0.7
#: Words a worker remembers, and windows that it scores at once.
CACHE_WORDS, AT_ONCE = 150_000, 4096
#: Inputs: word embedding, n-gram embedding, log-odds of both.
INPUTS = WORD_DIM + CHAR_DIM + 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().split()


def windows_of(n: int) -> list[tuple[int, int]]:
    """All overlapping windows over n words; the last ends with the text."""
    return [(a, min(n, a + WINDOW)) for a in range(0, max(1, n - WINDOW + STRIDE), STRIDE)] if n else []


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word; buckets of all their n-grams, and where each word's begin."""
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8)
    end = np.cumsum(length)
    start = end - length
    rolling = RollingHash(data)
    bucket = (rolling.of(start, end) % np.uint64(BUCKETS)).astype(np.int64)
    at = np.arange(len(data))
    owner = np.repeat(np.arange(len(words)), length)
    grams, owners = [], []
    for n in GRAMS:
        ok = at + n <= end[owner]
        grams.append((rolling.of(at[ok], at[ok] + n) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[ok])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return bucket, np.concatenate(grams)[order], np.searchsorted(owners[order], np.arange(len(words)))


class Network:
    """Parameters by name, and what is done with them."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale=0.3: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"word": draw(BUCKETS, WORD_DIM, scale=0.03), "char": draw(BUCKETS, CHAR_DIM, scale=0.03), "va": draw(ATTEND), "Wa": draw(2 * HIDDEN, ATTEND), "ba": draw(ATTEND) * 0, "w": draw(2 * HIDDEN), "b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": draw(INPUTS, 3 * HIDDEN), f"U{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.word_odds = np.zeros(BUCKETS, np.float32)
        self.char_odds = np.zeros(BUCKETS, np.float32)

    def inputs(self, feats: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        bucket, grams, first = feats
        count = np.diff(np.append(first, len(grams)))[:, None].astype(np.float32)
        mean = np.add.reduceat(self.p["char"][grams], first, axis=0) / count
        peak = np.maximum.reduceat(self.char_odds[grams], first)
        return np.concatenate([self.p["word"][bucket], mean, self.word_odds[bucket][:, None], peak[:, None]], axis=1).astype(np.float32)

    def _pass(self, gates: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States of one direction over gates (steps, windows, 3 * HIDDEN)."""
        U, H = self.p["U" + d], HIDDEN
        h = np.zeros((gates.shape[1], H), np.float32)
        states, saved = np.empty((*gates.shape[:2], H), np.float32), []
        for t in range(len(gates)) if d == "f" else range(len(gates) - 1, -1, -1):
            a = h @ U
            zr = _sigmoid(gates[t, :, : 2 * H] + a[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(gates[t, :, 2 * H :] + r * a[:, 2 * H :])
            new = n + z * (h - n)
            new = np.where(mask[t][:, None], new, h)
            if keep:
                saved.append((t, h, z, r, n, a[:, 2 * H :]))
            states[t] = h = new
        return states, saved

    def forward(self, x_f: np.ndarray, x_b: np.ndarray, mask: np.ndarray, keep: bool = False):
        hf, sf = self._pass(x_f, mask, "f", keep)
        hb, sb = self._pass(x_b, mask, "b", keep)
        h = np.concatenate([hf, hb], axis=2)
        u = np.tanh(h @ self.p["Wa"] + self.p["ba"])
        e = np.where(mask, u @ self.p["va"], -1e9)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tb,tbh->bh", a, h)
        return pooled @ self.p["w"] + self.p["b"][0], (h, u, a, pooled, sf, sb)

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]

    def gradients(self, feats, index: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over windows of word numbers (steps,
        windows; -1 after the end)."""
        bucket, grams, first = feats
        count = np.diff(np.append(first, len(grams)))
        table, mask = self.inputs(feats), index >= 0
        x = table[np.maximum(index, 0)]
        score, (h, u, a, pooled, sf, sb) = self.forward(*self.gates(x), mask, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        ds = (_sigmoid(score) - label) / len(label)
        g["b"][0], g["w"] = ds.sum(), pooled.T @ ds
        dp = ds[:, None] * self.p["w"]
        dh = a[:, :, None] * dp
        da = np.einsum("tbh,bh->tb", h, dp)
        de = a * (da - (a * da).sum(0))
        g["va"] = np.einsum("tb,tbk->k", de, u)
        du = de[:, :, None] * self.p["va"] * (1 - u * u)
        g["Wa"], g["ba"] = np.einsum("tbh,tbk->hk", h, du), du.sum((0, 1))
        dh = dh + du @ self.p["Wa"].T
        dx, H = np.zeros_like(x), HIDDEN
        for d, saved, part in (("f", sf, dh[:, :, :H]), ("b", sb, dh[:, :, H:])):
            carry = np.zeros_like(part[0])
            for t, before, z, r, n, an in reversed(saved):
                live = mask[t][:, None]
                total = part[t] + carry
                here = np.where(live, total, 0)
                dn = here * (1 - z) * (1 - n * n)
                dz = here * (before - n) * z * (1 - z)
                dr = dn * an * r * (1 - r)
                dgate = np.concatenate([dz, dr, dn], 1)
                drec = np.concatenate([dz, dr, dn * r], 1)
                g["W" + d] += x[t].T @ dgate
                g["c" + d] += dgate.sum(0)
                g["U" + d] += before.T @ drec
                dx[t] += dgate @ self.p["W" + d].T
                carry = np.where(live, here * z, total) + drec @ self.p["U" + d].T
        dt = np.zeros_like(table)
        np.add.at(dt, index[mask], dx[mask])
        np.add.at(g["word"], bucket, dt[:, :WORD_DIM])
        np.add.at(g["char"], grams, np.repeat(dt[:, WORD_DIM : WORD_DIM + CHAR_DIM] / count[:, None], count, axis=0))
        return g


def presence(words: list[bytes]) -> dict[str, np.ndarray]:
    """The buckets of a text's words and n-grams, each once."""
    kinds = list(dict.fromkeys(words))
    if not kinds:
        return {"word": np.zeros(0, np.int64), "char": np.zeros(0, np.int64)}
    bucket, grams, _ = word_features(kinds)
    return {"word": np.unique(bucket), "char": np.unique(grams)}


def odds_of(seen: dict[str, np.ndarray], n: np.ndarray) -> dict[str, np.ndarray]:
    """Log-odds of buckets from in how many texts of each class (2, BUCKETS) they are."""
    n = np.asarray(n, float)[:, None]
    odds = {k: np.log((v[1] + 0.5) / (n[1] + 1)) - np.log((v[0] + 0.5) / (n[0] + 1)) for k, v in seen.items()}
    return {k: (np.where(seen[k].sum(0) >= 5, v, 0).clip(-3, 6) / 3).astype(np.float32) for k, v in odds.items()}


def learned_windows(words: list[bytes], odds: dict[str, np.ndarray], label: int, seed: int) -> list[list[bytes]]:
    """The windows of a labelled text to learn from: the one that looks worst, of a
    clean text the three worst and one at random."""
    spans = windows_of(len(words))
    if not spans:
        return []
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    bucket, grams, first = word_features(list(number))
    look = (odds["word"][bucket] + np.maximum.reduceat(odds["char"][grams], first))[ids]
    size = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    spans = [(a, b) for a, b in spans if size[b] - size[a] <= WINDOW_BYTES]
    order = sorted(range(len(spans)), key=lambda k: -look[slice(*spans[k])].max())
    chosen = order[:1] if label else order[:3] + [seed % len(spans)] * bool(spans)
    return [words[slice(*spans[k])] for k in dict.fromkeys(chosen)]


def train(windows: list[list[bytes]], labels: list[int], odds: dict[str, np.ndarray], seed: int = 5) -> Network:
    """A network for labelled windows, its last bias not yet set."""
    net, rng = Network(seed), np.random.default_rng(seed)
    net.word_odds, net.char_odds = odds["word"], odds["char"]
    number: dict[bytes, int] = {}
    index = np.full((len(windows), WINDOW), -1, np.int64)
    for row, words in zip(index, windows):
        row[: len(words)] = [number.setdefault(w, len(number)) for w in words]
    target = np.array(labels, np.float32)
    bucket, grams, first = word_features(list(number))
    ends = np.append(first[1:], len(grams))
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(index)))
    for epoch in range(epochs):
        order = rng.permutation(len(index))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            part, inverse = np.unique(index[pick], return_inverse=True)
            inverse = inverse.reshape(len(pick), WINDOW)
            if part[0] < 0:
                part, inverse = part[1:], inverse - 1
            each = [np.arange(first[k], ends[k]) for k in part]
            sub = (bucket[part], grams[np.concatenate(each)], np.cumsum([0, *map(len, each[:-1])]))
            g = net.gradients(sub, inverse.T, target[pick])
            step += 1
            rate = RATE * (1 - epoch / epochs) + 0.002
            for k, v in g.items():
                mean[k] += 0.1 * (v - mean[k])
                square[k] += 0.01 * (v * v - square[k])
                # embeddings move less, or they would learn single texts by heart
                net.p[k] -= rate * (0.5 if k in ("word", "char") else 1) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
    return net


def set_bias(net: Network, worst: np.ndarray, y: np.ndarray) -> None:
    """Shift the last bias so that THRESHOLD parts the texts it was fitted on, by the
    scores of their worst windows: a text is as bad as that, so long texts score higher."""
    order = np.argsort(worst, kind="stable")
    # errors if the cut lies before each text; a clean text taken for toxic weighs double
    errors = np.concatenate([[0], np.cumsum(y[order] == 1)]) + 2 * ((y == 0).sum() - np.concatenate([[0], np.cumsum(y[order] == 0)]))
    best = np.flatnonzero(errors == errors.min())
    k = int(best[len(best) // 2])
    edge = np.concatenate([[worst[order[0]] - 2], worst[order], [worst[order[-1]] + 2]])
    net.p["b"][0] += np.log(THRESHOLD / (1 - THRESHOLD)) - (0.8 * edge[k] + 0.2 * edge[k + 1])


class Scorer:
    """Scores all windows of texts, with the gates of words met before at hand."""

    def __init__(self, net: Network):
        self.net = net
        self.number: dict[bytes, int] = {}
        self.table = [np.zeros((1, 3 * HIDDEN), np.float32)] * 2

    def _learn(self, split: list[list[bytes]]) -> None:
        new = list({w for ws in split for w in ws if w not in self.number})
        if new and len(self.number) + len(new) > CACHE_WORDS:
            self.number.clear()
            self.table = [t[:1] for t in self.table]
            new = list({w for ws in split for w in ws})
        if new:
            more = self.net.gates(self.net.inputs(word_features(new)))
            start = len(self.table[0])
            self.number.update(zip(new, range(start, start + len(new))))
            self.table = [np.concatenate([t, m]) for t, m in zip(self.table, more)]

    def worst(self, split: list[list[bytes]], none: float) -> tuple[np.ndarray, list[int]]:
        """Per text, the logit of its worst window (``none`` without one), and its windows."""
        best, counts = np.full(len(split), -np.inf), [len(windows_of(len(ws))) for ws in split]
        if any(counts):
            self._learn(split)
            owner = np.repeat(np.arange(len(split)), counts)
            rows = np.zeros((len(owner), WINDOW), np.int32)
            at = 0
            for ws in split:
                ids = np.fromiter(map(self.number.__getitem__, ws), np.int32, len(ws))
                for s, e in windows_of(len(ws)):
                    rows[at, : e - s] = ids[s:e]
                    at += 1
            for a in range(0, len(rows), AT_ONCE):
                index = np.ascontiguousarray(rows[a : a + AT_ONCE].T)
                got = self.net.forward(self.table[0][index], self.table[1][index], index > 0)[0]
                np.maximum.at(best, owner[a : a + AT_ONCE], got)
        return np.where(np.isneginf(best), none, best), counts


def fit(labelled: DataFrame, seed: int = 5) -> Network | None:
    """A network for labelled texts (doc_id, text, label), at most ``2 * SAMPLE`` rows;
    none if either class is missing or no text has a word.  Texts stay in executors."""
    spark = labelled.sparkSession
    n = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(n) < 2:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in texts_of(b):
                for kind, buckets in presence(words_of(text)).items():
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(buckets), pa.string()), pa.array(np.full(len(buckets), b.column("label")[i].as_py()), pa.int32()), pa.array(buckets)], names=["kind", "label", "bucket"])

    # at most two kinds of two classes of BUCKETS numbers
    seen = {k: np.zeros((2, BUCKETS)) for k in ("word", "char")}
    for kind, label, bucket, m in map_batches(labelled, count, "kind string, label int, bucket long").groupBy("kind", "label", "bucket").count().collect():
        seen[kind][label, bucket] = m
    odds = odds_of(seen, [n[0], n[1]])
    given = spark.sparkContext.broadcast(odds)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text in texts_of(b):
                doc, label = b.column("doc_id")[i].as_py(), b.column("label")[i].as_py()
                out += [(doc, label, k, b" ".join(ws)) for k, ws in enumerate(learned_windows(words_of(text), given.value, label, zlib.crc32(f"{seed}:{doc}".encode())))]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["doc_id", "label", "k", "words"])

    # four windows of WINDOW_BYTES a row at most
    windows = sorted(map(tuple, map_batches(labelled, choose, "doc_id long, label int, k int, words binary").collect()))
    if not windows:
        return None
    net = train([bytes(w).split(b" ") for *_, w in windows], [label for _, label, *_ in windows], odds, seed)
    model = spark.sparkContext.broadcast(net)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            for b in slices(batch, limit=1 << 19):
                worst, _ = scorer.worst([words_of(t) for _, t in texts_of(b)], none=-20.0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(worst)], names=["doc_id", "label", "worst"])

    judged = sorted(map(tuple, map_batches(labelled, judge, "doc_id long, label int, worst double").collect()))
    set_bias(net, np.array([w for *_, w in judged]), np.array([y for _, y, _ in judged]))
    return net


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; those without id among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str = "toxic", most: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, text, label) to learn from, whole texts: at most ``most`` ids of each class,
    by hash.  An id that is labelled both ways is not learned from; of rows that
    share an id the least text is."""
    known = labels.where(F.col(column).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("other")).where("label = other").select("doc_id", "label")
    draw = F.xxhash64("doc_id", F.lit(3))
    chosen = known.where("label = 1").orderBy(draw, "doc_id").limit(most).unionByName(known.where("label = 0").orderBy(draw, "doc_id").limit(most))
    # 2 * most rows of two integers: a proven bound
    rows = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def score_toxicity(docs: DataFrame, labels: DataFrame, column: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, n_windows.

    A null, empty or blank text has no windows and scores 0; without labels of
    both classes everything scores 0; rows without doc_id are scored too, as
    held out; repeated rows score alike; scores are rounded to six places, and one
    that is equal to ``threshold`` counts as above it; a text of any length is
    scored whole, some windows at a time; an empty table gives none; other columns
    are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        net = fit(scratch.put(labelled_sample(docs, labels, column), "labelled"))
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value) if model.value is not None else None
        for batch in batches:
            for b in slices(batch, limit=1 << 19):
                split = [words_of(t) for _, t in texts_of(b)]
                if scorer is None:
                    best, counts = np.zeros(len(split)), [len(windows_of(len(ws))) for ws in split]
                else:
                    best, counts = scorer.worst(split, none=-np.inf)
                    best = np.round(np.where(np.isneginf(best), 0, _sigmoid(best)), 6)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(best), pa.array((best >= threshold).astype(np.int32)), pa.array(counts, pa.int64())], names=["doc_id", "score", "predicted", "n_windows"])

    scored = map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int, n_windows long")
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "score", "predicted", "n_windows")
