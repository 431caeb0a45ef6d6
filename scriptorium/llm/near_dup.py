"""Near duplicates by SetSketch registers.

A document is its set of word shingles.  Its sketch holds, for each of m
independent hash functions, the least exponentially distributed value of the
set, truncated to a scale of powers of a base: register = floor(1 - log_b(x)),
clipped.  Registers of a union are the maxima of those of its parts, and two
registers agree about as often as the sets overlap.  Documents meet where all
registers of a band agree.  Of each pair that meets, the Jaccard similarity is
estimated by maximum likelihood from how many registers are above, below and
equal, given both cardinalities; what may reach the threshold is confirmed on
the full sets.

Documents with equal sets form a class, represented by its smallest doc_id, so
groups of copies cost one sketch.  Within a band's group every class is first
compared with the smallest and the greatest only.  Members of groups that are
then still in several components meet again by their rarest shingles (an exact
prefix filter), and pairs across components, and only these, are compared.  So
the work stays linear in groups of near copies, and no link that could join two
components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from scriptorium.llm.common import RollingHash, Scratch, joined_bytes, map_batches, mix, slices, word_bounds
from scriptorium.llm.components import connected_components

#: Registers, the scale's base, the rate of the exponential values, the highest
#: register value, and how the bands choose registers.
REGISTERS, BASE, RATE, TOP = 256, 1.02, 20.0, 2047
#: A pair of similarity 0.8 shares none of 60 bands of 6 of 256 registers with a
#: chance near 1e-6; its estimate lies 0.11 below (5 deviations) with one near 1e-7.
BANDS, ROWS, MARGIN = 60, 6, 0.11


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each of some joined texts, the sorted distinct hashes of its runs of
    ``words`` words, A-Z lower-cased; of fewer words, the hash of them all."""
    start, end, first = word_bounds(data, offsets)
    if not len(start):
        yield from (np.zeros(0, np.uint64) for _ in offsets[1:])
        return
    h = RollingHash(data, fold_case=True).of(start, end)
    n = np.diff(first)

    def run_hash(h: np.ndarray, k: int) -> np.ndarray:
        out = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            out = mix(out * np.uint64(0x2545F4914F6CDD1D) + h[i : len(h) - k + 1 + i])
        return out + np.uint64(k)

    runs = run_hash(h, words) if len(h) >= words else None
    for i in range(len(n)):
        a, b = first[i], first[i + 1]
        if n[i] >= words:
            yield np.unique(runs[a : b - words + 1])
        elif n[i]:
            yield run_hash(h[a:b], int(n[i]))
        else:
            yield np.zeros(0, np.uint64)


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    flip = rng.integers(0, 2**64, REGISTERS, dtype=np.uint64)
    scale = rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    chosen = np.stack([np.sort(rng.permutation(REGISTERS)[:ROWS]) for _ in range(BANDS)])
    return flip, scale, chosen


def sketch_many(sets: list[np.ndarray]) -> np.ndarray:
    """The registers (uint16, a row each) of some sets of hashes, none empty.
    Least values are found as 64-bit hashes first: a smaller hash is a smaller
    value.  Cost: a multiplication and a comparison per element and register."""
    flip, scale, _ = _functions()
    starts = np.cumsum([0, *map(len, sets[:-1])])
    every = np.concatenate(sets)
    least, v = np.empty((REGISTERS, len(sets)), np.uint64), np.empty_like(every)
    for j in range(REGISTERS):
        np.bitwise_xor(every, flip[j], out=v)
        np.multiply(v, scale[j], out=v)
        np.minimum.reduceat(v, starts, out=least[j])
    x = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype("<u2")


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of registers."""
    _, _, chosen = _functions()
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(registers), BANDS))
    for r in range(ROWS):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + registers[:, chosen[:, r]].astype(np.uint64))
    return out.view(np.int64)


def estimate(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities from the registers of a above and
    below those of b, given the sets' sizes; all arrays."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * grid), p(v - u * grid)
    same = np.clip(1 - up - down, 1e-12, 1)
    equal = (REGISTERS - above - below)[:, None]
    fit = above[:, None] * np.log(np.clip(up, 1e-12, 1)) + below[:, None] * np.log(np.clip(down, 1e-12, 1)) + equal * np.log(same)
    return grid[np.arange(len(grid)), fit.argmax(axis=1)]


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, fingerprint, registers) of every row; the latter two
    null for an empty set.  Copies in a batch are sketched once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[bytes, bytes] = {}
        for batch in batches:
            for b in slices(batch):
                sets = list(shingle_sets(*joined_bytes(b), words))
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                if len(last) > 20_000:
                    last.clear()
                new = {f: k for k, f in enumerate(prints) if f is not None and f not in last}
                if new:
                    last |= zip(new, map(bytes, sketch_many([sets[k] for k in new.values()])))
                regs = [None if f is None else last[f] for f in prints]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "fingerprint", "registers"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, fingerprint binary, registers binary")


def band_rows(classes: DataFrame) -> DataFrame:
    """(key, id): a row for each band of each class.  Sets that are too small to
    be within the threshold of any other set have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            for a in range(0, len(ids), 2048):
                raw = b.column("registers").slice(a, 2048).to_pylist()
                keys = band_keys(np.frombuffer(b"".join(raw), "<u2").reshape(len(raw), REGISTERS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids[a : a + 2048], BANDS))], names=["key", "id"])

    return map_batches(classes.select("id", "registers"), run, "key long, id long")


def likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose estimate leaves the threshold within reach."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    near = near.where((F.col("n_a") >= threshold * F.col("n_b")) & (F.col("n_b") >= threshold * F.col("n_a")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            r = [np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("r_a", "r_b")]
            size = [b.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")]
            j = estimate((r[0] > r[1]).sum(1), (r[0] < r[1]).sum(1), *size)
            yield b.select(["a", "b"]).filter(pa.array(j >= threshold - MARGIN))

    return map_batches(near.select("a", "b", "n_a", "n_b", "r_a", "r_b"), run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs whose full sets reach the threshold: 100 * intersection >=
    percent * union.  ``texts`` has the text of every id in them."""
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def sets(b: pa.RecordBatch, which: str) -> list[np.ndarray]:
            ids = b.column(which).to_pylist()
            need = {i: k for k, i in enumerate(ids) if i not in known}
            out = {i: known[i] for i in ids if i in known}
            if need:
                part = b.column(f"t_{which}").take(pa.array(list(need.values())))
                found = shingle_sets(*joined_bytes(pa.RecordBatch.from_arrays([part], names=["text"])), words)
                out |= dict(zip(need, found))
            return [out[i] for i in ids]

        for batch in batches:
            for b in slices(batch, "t_a", "t_b"):
                left, right = sets(b, "a"), sets(b, "b")
                keep = []
                for x, y in zip(left, right):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                known = {b.column("b")[-1].as_py(): right[-1]}
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(both, run, "a long, b long")


def prefix_pairs(open_: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """All pairs (a, b) of different parts that may reach the threshold, from
    rows (id, part, text).

    Let t be the threshold, a the smaller set and b the larger one (of equal sizes
    the smaller id first), and rank elements by frequency, the rarest first.  Two
    sets within t have at least 2t / (1 + t) * |a| and at least t * |b| elements
    in common, so they share one of the first |a| - ceil(2t / (1 + t) |a|) + 1 of
    a and of the first |b| - ceil(t |b|) + 1 of b.  A copy's own changes are rare
    and come first: copies of one text that differ by more than the threshold
    allows fill the smaller set's part with them and do not meet, however many
    they are, while those that differ by less are of one part already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                sets = list(shingle_sets(*joined_bytes(b), words))
                n = np.array([len(s) for s in sets], np.int64)
                if n.sum():
                    spread = pa.array(np.repeat(np.arange(len(n)), n))
                    yield pa.RecordBatch.from_arrays([b.column("id").take(spread), b.column("part").take(spread), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "part", "n", "s"])

    rows = scratch.put(map_batches(open_.select("id", "part", "text"), run, "id long, part long, n long, s long"), "shingles")
    often = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(W.partitionBy("id").orderBy("df", "s"))
    n = F.col("n")
    ahead = rows.join(often, "s").withColumn("rank", rank).where(F.col("rank") <= n - F.ceil(n * percent / 100 - 1e-9) + 1)
    ahead = scratch.put(ahead, "prefixes")
    side = lambda x: ahead.select("s", F.col("id").alias(x), F.col("part").alias(f"p_{x}"), F.col("n").alias(f"n_{x}"), F.col("rank").alias(f"r_{x}"))
    few = side("a").where(F.col("r_a") <= F.col("n_a") - F.ceil(F.col("n_a") * (2 * percent) / (100 + percent) - 1e-9) + 1)
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    # from the first element they share on, they can share no more than either has left
    most = 1 + F.least(F.col("n_a") - F.col("r_a"), F.col("n_b") - F.col("r_b"))
    fits = (100 * F.col("n_a") >= percent * F.col("n_b")) & (most * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b")))
    met = few.join(side("b"), "s").where(smaller & (F.col("p_a") != F.col("p_b")) & fits)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked from a Jaccard similarity of ``percent`` / 100; a
    component is named by its smallest doc_id.  A null, empty or blank text is
    linked with nothing; rows with a null doc_id are linked with nothing and
    kept, their component null; rows that share a doc_id are one document, each
    with a row of its own; texts of any length take part whole, a few at a time;
    an empty table gives none; other columns are ignored.
    """
    threshold = percent / 100
    with Scratch(docs.sparkSession) as scratch:
        put, drop = scratch.put, scratch.drop
        all_ = put(sketches(docs, words), "sketches")
        linked = all_.where("doc_id is not null and fingerprint is not null")
        classes = linked.groupBy("fingerprint").agg(F.min(F.struct("doc_id", "n_shingles", "registers")).alias("c"))
        classes = put(classes.select(F.col("c.doc_id").alias("id"), "c.n_shingles", "c.registers", "fingerprint"), "classes")
        members = all_.select("doc_id", "n_shingles", "fingerprint").join(classes.select("id", "fingerprint"), "fingerprint", "left")
        members = put(members.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("id")).alias("id")), "members")
        drop(all_)

        # a set within the threshold of another, different set has this many elements at least
        least = int(np.ceil(threshold / (1 - threshold) - 1e-9)) if percent < 100 else 1
        bands = put(band_rows(classes.where(F.col("n_shingles") >= least)), "bands")
        groups = put(bands.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high"), "groups")
        met = put(bands.join(groups, "key").select("key", "id", "low", "high"), "met")
        drop(bands, groups)

        first = met.select(F.col("id").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b")
        first = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        first = put(likely(first, classes, threshold), "pairs")
        # texts of classes that met any other, once; later joins move these only
        wanted = met.select("id").distinct()
        texts = put(docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id").dropDuplicates(["id"]), "texts")
        edges = put(confirmed(first, texts, words, percent), "links")

        part = connected_components(edges, scratch)
        parts = put(met.select("key", "id").join(part, "id", "left").select("key", "id", F.coalesce("component", "id").alias("part")), "parts")
        drop(part, met)
        split = parts.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("key")
        open_ = parts.join(split, "key").select("id", "part").distinct().join(texts, "id")
        rest = prefix_pairs(open_, words, percent, scratch).join(first, ["a", "b"], "left_anti")
        rest = put(likely(rest, classes, threshold), "more-pairs")
        drop(parts, classes, first)
        more = put(confirmed(rest, texts, words, percent), "links")
        drop(texts, rest)

        same = members.where("id is not null").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct()
        found = connected_components(edges.unionByName(more).unionByName(same), scratch)
        out = members.select("doc_id", "n_shingles").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        return put(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-duplicates", keep=True)
