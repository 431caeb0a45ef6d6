"""Best-fit packing by linear grouping.

Documents are tokenized once, in the scan's tasks, into piece descriptors
(start, length, checksum); texts go no further.  Pieces are dealt by a hash of
their document into shards of bounded size and each shard is packed on its own;
a shard wastes part of one sequence at most for being separate, against tens of
thousands that it fills.

Within a shard: pieces of full length stand alone.  Other large lengths are
sorted and cut into groups of equal cardinality, and each is rounded up to its
group's greatest.  Over these few sizes, configurations (how many pieces of
each size share a sequence) are chosen by a bounded knapsack, the fullest
first, each used as often as its sizes last.  Then the actual pieces take the
places of the rounded ones, and small pieces, with what no configuration took,
are put by best fit into the room that is left.
"""

from __future__ import annotations

import json
import math
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from scriptorium.llm.common import ODD_SPACE, materialize, texts_of
from scriptorium.llm.token_counts import load

CAPACITY, EOS = 1024, 2
#: Pieces a shard holds on average, groups of equal cardinality, and the share
#: of the capacity from which a length counts as large.
SHARD_PIECES, GROUPS, LARGE = 60_000, 400, 1 / 3
CACHE_ENTRIES = 300_000

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Runs of white space in which a boundary before a single space isn't one
#: between tokens.
_RUNS = re.compile(r"\s \s|\s \Z")


def chunk_encoder(path: str, encode: Callable[[list[str]], list[list[int]]]) -> Callable[[list[str]], list[list[int]]]:
    """A faster way to encode many short texts without special tokens.

    In a byte-level file whose merges stand in the order of their ids, the ids
    are ranks of byte strings, which tiktoken merges by the same rule.  Any
    other file is left to ``encode``.
    """
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, pre = whole["model"], whole.get("pre_tokenizer") or {}
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
    first = min((model["vocab"].get(m, -1) for m in merges[:1]), default=-1)
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not whole.get("normalizer") and not model.get("ignore_merges")
    if not plain or any(model["vocab"].get(m) != first + k for k, m in enumerate(merges)):
        return encode
    # the byte-level alphabet: printable bytes stand for themselves, others for letters from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in printable}
    letter |= {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printable)))}
    special = {a["content"] for a in whole.get("added_tokens", []) if a.get("special")}
    ranks = {bytes(letter[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [fast.encode_ordinary(t) for t in texts]


class ByteLevelEncoder:
    """Packed little-endian ids of whole texts for a byte-level tokenizer whose
    pre-tokens begin at a space: each space-delimited chunk is encoded once and
    its bytes are cached, and a text is the concatenation of its chunks."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.encode = load(path)
        self.encode_chunks = chunk_encoder(path, self.encode)
        t = Tokenizer.from_file(path)
        self.special = [a.content for a in t.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self.entries = entries

    def whole(self, text: str) -> bytes:
        return np.array(self.encode([text])[0], "<u4").tobytes() if text else b""

    def __call__(self, text: str) -> bytes:
        if ODD_SPACE.search(text) or _RUNS.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        get = self.cache.get
        got = [get(x) for x in rest]
        if None in got:
            new = list({x for x, y in zip(rest, got) if y is None})
            if len(self.cache) + len(new) > self.entries:
                self.cache.clear()
                new = list(set(rest))
            for x, ids in zip(new, self.encode_chunks([" " + x for x in new])):
                self.cache[x] = struct.pack(f"<{len(ids)}I", *ids)
            got = map(self.cache.__getitem__, rest)
        head = struct.pack(f"<{len(h)}I", *h) if first and (h := self.encode_chunks([first])[0]) else b""
        return head + b"".join(got)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, eos: int = EOS) -> DataFrame:
    """One row per piece of each document: its ids, then ``eos``, cut into pieces
    of ``capacity`` tokens if longer; the first piece takes the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = ByteLevelEncoder(path), np.array([eos], "<u4").tobytes()
        for b in batches:
            ids, rows = b.column("doc_id"), []
            for i, text in texts_of(b):
                data = encode(text) + end
                n = len(data) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                rows += [(i, k, s, e - s, zlib.crc32(data[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:]))]
            i, k, s, n, c = zip(*rows) if rows else [()] * 5
            take = pa.array(i, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(take), take, pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def configurations(sizes: np.ndarray, count: np.ndarray, capacity: int) -> Iterator[tuple[np.ndarray, int]]:
    """(how many of each size, times used): the greatest size that is left with
    the best filling beside it, as often as the sizes last, until none is left.
    Taking the greatest first keeps the small sizes, which fit anywhere."""
    count = count.copy()
    while (live := np.flatnonzero(count)).size:
        top = live[np.argmax(sizes[live])]
        count[top] -= 1
        space = capacity - int(sizes[top])
        kinds = [k for k in live[np.argsort(-sizes[live], kind="stable")] if sizes[k] <= space and count[k]]
        # best[c]: greatest fill not above c from the sizes so far; took[j][c]: how many of kind j it holds
        best, took = np.zeros(space + 1, np.int64), np.zeros((len(kinds), space + 1), np.int16)
        for j, k in enumerate(kinds):
            now, step = best.copy(), int(sizes[k])
            for n in range(1, min(int(count[k]), space // step) + 1):
                fill = best[: space + 1 - n * step] + n * step
                better = fill > now[n * step :]
                now[n * step :][better] = fill[better]
                took[j, n * step :][better] = n
            best = now
        use, c = np.zeros(len(sizes), np.int64), space
        for j in range(len(kinds) - 1, -1, -1):
            n = int(took[j, c])
            use[kinds[j]] = n
            c -= n * int(sizes[kinds[j]])
        use[top] += 1
        count[top] += 1
        held = use > 0
        times = int((count[held] // use[held]).min())
        count -= use * times
        yield use, times


def pack(length: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length; deterministic in their order."""
    n = len(length)
    sequence, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    full = np.flatnonzero(length == capacity)
    sequence[full] = np.arange(len(full))
    room = [0] * len(full)
    big = np.flatnonzero((length >= large * capacity) & (length < capacity))
    big = big[np.argsort(-length[big], kind="stable")]
    rest = np.flatnonzero(length < large * capacity)
    left: list[int] = []
    if len(big):
        cut = np.unique(np.linspace(0, len(big), min(groups, len(big)) + 1).astype(np.int64))
        members = [list(big[a:b]) for a, b in zip(cut[:-1], cut[1:])]
        sizes = np.array([length[m[0]] for m in members])
        for use, times in configurations(sizes, np.array([len(m) for m in members]), capacity):
            kinds = [(k, int(use[k])) for k in np.flatnonzero(use)]
            for _ in range(times):
                at = 0
                for k, m in kinds:
                    for _ in range(m):
                        i = members[k].pop()
                        sequence[i], offset[i] = len(room), at
                        at += int(length[i])
                room.append(capacity - at)
        left = [i for m in members for i in m]
    rest = np.concatenate([np.array(left, np.int64), rest])
    rest = rest[np.argsort(-length[rest], kind="stable")]
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0
    for s in range(len(room) - 1, -1, -1):
        if room[s]:
            by_room[room[s]].append(s)
            some |= 1 << room[s]
    for i in rest:
        size = int(length[i])
        fits = some >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            s = by_room[r].pop()
            if not by_room[r]:
                some ^= 1 << r
        else:
            s, r = len(room), capacity
            room.append(capacity)
        sequence[i], offset[i] = s, capacity - r
        room[s] = r - size
        if room[s]:
            by_room[room[s]].append(s)
            some |= 1 << room[s]
    return sequence, offset


def best_fit_pack(docs: DataFrame, path: str, capacity: int = CAPACITY, eos: int = EOS) -> DataFrame:
    """All pieces of ``docs``, each with its sequence and its place there.

    A null or empty text is the end token alone; repeated rows are packed each
    by itself; rows without doc_id are packed too; a very long text is cut into
    pieces that are packed like any other; pieces of equal length are placed in the
    order of document and piece; an empty table gives none; other columns are
    ignored.  Sequence ids are unique over shards and otherwise without meaning.
    """
    pieces = materialize(token_pieces(docs, path, capacity, eos), "pieces")
    shards = max(1, math.ceil(pieces.count() / SHARD_PIECES))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable", ignore_index=True)
        sequence, offset = pack(pdf["length"].to_numpy(np.int64), capacity)
        pdf["sequence_id"] = sequence * shards + key[0]
        pdf["offset"] = offset
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInPandas(run, PACKED)
