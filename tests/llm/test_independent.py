"""Brute-force versions that share nothing with the operators they check."""

import struct
from collections import Counter, defaultdict

import xxhash

from scriptorium.llm import mixing, substring_dedup
from tests.llm.test_operators import SCHEMA, WORD, brute_targets, linked, rows_of


def exact_runs(texts, n):
    """Pairs of documents (later, earlier) that have ``n`` words in a row in common,
    words compared with A-Z lower-cased."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = defaultdict(set)
    for doc, text in texts.items():
        words = WORD.findall(text.translate(fold))
        for k in range(len(words) - n + 1):
            holders[hash(tuple(words[k : k + n]))].add(doc)
    return {(b, a) for docs in holders.values() if len(docs) > 1 for a in docs for b in docs if a < b}


def test_passages_against_word_runs(spark):
    """Over all of sf0.01: documents with 60 words in a row in common are joined, nearly
    all of the later ones by a link of their own; documents that have not even 8 in a
    row in common with any other are linked with nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts, seen = {}, set()
    for r in docs.orderBy("doc_id").collect():
        if r.doc_id is not None and r.text and r.text not in seen:
            seen.add(r.text)
            texts[r.doc_id] = r.text
    got = substring_dedup.shared_passages(docs).collect()
    root, links = linked(got), {r.doc_id: r.n_links for r in got}
    pairs = exact_runs(texts, 60)
    later = {b for b, _ in pairs}
    assert len(pairs) > 30
    assert sum(root[a] == root[b] for a, b in pairs) >= 0.97 * len(pairs)
    assert sum(links[b] > 0 for b in later) >= 0.97 * len(later)
    near = {d for pair in exact_runs(texts, 8) for d in pair}
    alone = [d for d in texts if d not in near]
    assert len(alone) > 300 and sum(links[d] > 0 for d in alone) == 0


def long_hash(value, seed):
    """Spark's xxhash64 of a long column, and of None."""
    return seed if value is None else xxhash.xxh64_intdigest(struct.pack("<q", value), seed)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def draw(doc_id, seed):
    return signed(xxhash.xxh64_intdigest(struct.pack("<i", seed), long_hash(doc_id, 42)))


def highest_quotients(weight, seats):
    """Seats by highest quotients weight / (2k + 1), ties to the lower unit."""
    won = Counter({u: 0 for u in weight})
    for _ in range(seats):
        won[min(weight, key=lambda u: (-weight[u] / (2 * won[u] + 1), u))] += 1
    return won


def brute_taken(rows, shard_docs, block, seed=17):
    """What the mix takes of every row, by the rules alone."""
    sources = defaultdict(list)
    for r in rows:
        sources[r[2]].append((r[0], len(WORD.findall(r[1] or ""))))
    sizes = {s: sum(n for _, n in docs) for s, docs in sources.items()}
    target = brute_targets(sizes)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    whole = {s: int(target[s] / sizes[s] + 1e-9) if sizes[s] else 0 for s in order}
    part = {k: max(0.0, target[s] - whole[s] * sizes[s]) for k, s in enumerate(order)}
    seats = highest_quotients(part, round(sum(part.values()) / block))
    out = []
    for k, s in enumerate(order):
        n_shards = max(1, -(-len(sources[s]) // shard_docs))
        shards = defaultdict(list)
        for doc, size in sources[s]:
            shards[draw(doc, seed + 1) % n_shards].append((draw(doc, seed), doc, size))
        quota = highest_quotients({h: float(sum(x[2] for x in docs)) for h, docs in shards.items()}, seats[k] * block)
        for h, docs in shards.items():
            left = quota[h]
            for _, doc, size in sorted(docs, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2])):
                out.append((doc, size, whole[s] * size + max(0, min(size, left)), s))
                left -= size
    return Counter(out)


def test_taken_of_every_document(spark, monkeypatch):
    """Seats of sources, quotas of shards and the seeded order, document by document."""
    rows = rows_of(3)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for shard_docs, block in ((2_000, None), (5, 1), (7, 9)):
        monkeypatch.setattr(mixing, "SHARD_DOCS", shard_docs)
        got = Counter((r.doc_id, r["size"], r.taken, r.source) for r in mixing.mix_sources(docs, block=block).collect())
        assert got == brute_taken(rows, shard_docs, block or 1)
