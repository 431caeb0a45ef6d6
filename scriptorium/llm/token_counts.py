"""Token counts: a map-side lookup in two tiers, without a shuffle.

The tokenizer drops white space and never joins what stands on both sides of
it, so the tokens of a text are those of its space-delimited pre-tokens, one
after the other.  The lengths of frequent pre-tokens are counted once on the
driver from a bounded sample and broadcast as a compact hash table; whatever a
task doesn't find there it encodes once and keeps in its worker's own bounded
cache.  Both tiers only spare work: any table gives the same counts.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.common import ODD_SPACE, byte_len, texts_of

#: Entries of the broadcast table, rows of the sample it is counted from and the
#: bytes below which a text takes part, and entries a worker's own cache holds
#: before it is emptied.
TABLE_ENTRIES, SAMPLE_ROWS, SAMPLE_BYTES, CACHE_ENTRIES = 40_000, 1_000, 1 << 16, 250_000

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_misses long"
_SPLIT = re.compile("[^ \t\n\r]+")


def load(path: str):
    """The tokenizer of a .json or .model file as a function: list of texts to
    list of id lists, without special tokens added, truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def pretokens(text: str) -> list[str]:
    return _SPLIT.findall(text) if ODD_SPACE.search(text) else text.split()


def frequent_lengths(docs: DataFrame, path: str, entries: int = TABLE_ENTRIES, sample_rows: int = SAMPLE_ROWS) -> dict[str, int]:
    """Lengths of the commonest pre-tokens of the first ``sample_rows`` rows at
    hand, which a take reads from as few partitions as it needs."""
    if not path.endswith(".json"):
        return {}
    total: Counter = Counter()
    for r in docs.select("text").where(f"octet_length(text) < {SAMPLE_BYTES}").take(sample_rows):
        total.update(pretokens(r["text"]))
    words = [w for w, _ in total.most_common(entries)]
    return dict(zip(words, map(len, load(path)(words)))) if words else {}


def token_counts(docs: DataFrame, path: str, limit: int = 2048, table: dict[str, int] | None = None) -> DataFrame:
    """Per row: UTF-8 bytes, tokens of the whole text as the library gives them,
    and whether there are more than ``limit``.

    A null or empty text has 0 tokens; repeated rows are counted alike; a null
    doc_id stays null; rows are not compared, so there are no ties; a very long
    text is cut at pre-token borders and counted whole; an empty table gives none;
    other columns are ignored.  ``path`` names a tokenizer file that every executor has.  A .model file, whose pieces may cross spaces,
    is encoded text by text.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_lengths(docs, path) if table is None else table)
    by_word = path.endswith(".json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, table, own = load(path), shared.value, {}
        get = table.get
        for b in batches:
            n_bytes, n_tokens, n_miss = [], [], []
            for _, text in texts_of(b):
                n_bytes.append(byte_len(text))
                if not by_word:
                    n_tokens.append(len(encode([text])[0]) if text else 0)
                    n_miss.append(1)
                    continue
                words = pretokens(text)
                found = [get(w) for w in words]
                total = missed = 0
                if None in found:
                    out = [w for w, n in zip(words, found) if n is None]
                    missed = len(out)
                    new = list({w for w in out if w not in own})
                    if new:
                        if len(own) + len(new) > CACHE_ENTRIES:
                            own.clear()
                            new = list(set(out))
                        own.update(zip(new, map(len, encode(new))))
                    total = sum(map(own.__getitem__, out))
                    found = [n for n in found if n is not None]
                n_tokens.append(total + sum(found))
                n_miss.append(missed)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(n_miss, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_misses"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
