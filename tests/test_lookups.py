"""Term search, near codes and turn ownership: equal to comparing all pairs, and far
fewer pairs than that."""

import math
import random

from pyspark.sql import functions as F

from scriptorium.operators import matching, metering, validation


def tokens(s):
    return set("".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split())


def plain_scores(phrases, terms):
    """Every phrase against every text, as the score is defined."""
    texts = {(t, s.strip().lower()) for t, names in terms.items() for s in names}
    by_term = {}
    for t, s in texts:
        by_term.setdefault(t, set()).update(tokens(s))
    df = {}
    for has in by_term.values():
        for k in has:
            df[k] = df.get(k, 0) + 1
    idf = {k: math.log(len(terms) / n) for k, n in df.items()}
    rarest = max(idf.values(), default=1.0)
    out = {}
    for p in phrases:
        q = p.strip().lower()
        weights = {k: idf.get(k, rarest) for k in tokens(q)}
        mass = sum(weights.values())
        if mass <= 0:
            continue
        for _, s in texts:
            shared = [k for k in weights if k in tokens(s)]
            covered = 60 * sum(weights[k] for k in shared) / mass
            score = 100.0 if s == q else 0 if not shared else max(covered, 60 + len(shared)) if q in s else covered
            if score >= 20 - 1e-9:
                out[p, s] = (s == q, round(score, 6))
    return out


def test_term_search_equals_all_pairs(spark):
    rng = random.Random(7)
    words = ["low", "virulence", "vir", "host", "in", "of", "a", "ab", "cell", "cells", "wall-less", "b", "7", "x9", "oxynivalenol", "deoxynivalenol", "é"]
    said = lambda n: rng.choice(["", "", " ", "("]) + rng.choice([" ", "-", ", "]).join(rng.choice(words) for _ in range(rng.randint(1, n)))
    terms = {k: [said(5) for _ in range(rng.randint(1, 3))] for k in range(120)}
    phrases = sorted({said(4) for _ in range(150)} | {t[0][1:-1] for t in terms.values() if len(t[0]) > 3})
    df = spark.createDataFrame([(k, v[0], v[1:]) for k, v in terms.items()], "term_id long, name string, synonyms array<string>")
    texts = matching.term_texts(df)
    got = matching.scores(spark.createDataFrame([(p, p) for p in phrases], "phrase_id string, phrase string"), texts, matching.idf(texts))
    found = {(r.phrase_id, r.text): (r.exact, round(r.score, 6)) for r in got.collect()}
    assert found == plain_scores(phrases, terms)


def test_term_search_of_phrases_that_begin_alike(spark):
    """Phrases and texts that share one common word at an end do not meet by it."""
    phrases = [(f"p{i}", f"common alpha{i} beta{i}" if i % 2 else f"common gamma{i}") for i in range(400)]
    terms = [(i, f"common delta{i} epsilon{i}" if i < 400 else f"zeta{i} eta{i}", None) for i in range(800)]
    t = matching.term_texts(spark.createDataFrame(terms, "term_id long, name string, synonyms array<string>"))
    q = matching.weighed(spark.createDataFrame(phrases, "phrase_id string, phrase string"), matching.idf(t))
    assert matching.candidates(q, t).count() < 20 * len(phrases)


def plain_near(value, codes):
    v = value.lower()
    return sorted(c for c in codes if (len(v) >= 5 and v in c.lower()) or (len(c) >= 5 and c.lower() in v))[:3]


def test_near_codes_equal_all_pairs(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcAB ") for _ in range(n))
    codes = sorted({(rng.choice("xy"), letters(rng.randint(1, 9))) for _ in range(400)})
    values = sorted({(rng.choice("xyz"), letters(rng.randint(1, 14))) for _ in range(300)} | {("x", ""), ("x", "é assay é")})
    c = spark.createDataFrame(codes, "type string, code string")
    v = spark.createDataFrame([*values, ("x", None)], "type string, value string")
    of = {t: [x for k, x in codes if k == t] for t in "xyz"}
    got = {(r.type, r.value): r.suggestions for r in validation.near_codes(v, c).collect()}
    assert got == {(t, x): plain_near(x, of[t]) for t, x in values} | {("x", None): []}
    one = {(r.type, r.value): (r.valid, r.did_you_mean) for r in validation.one_vocabulary(v.where("value is not null"), c).collect()}
    for t, x in values:
        near = sorted(y for y in of[t] if x.lower() in y.lower())
        assert one[t, x] == (x in of[t], near if near and x not in of[t] else None)


def test_near_codes_of_a_long_list(spark):
    """A hundred thousand codes are looked up by pieces: no row carries the list."""
    codes = spark.range(100_000).select(F.lit("t").alias("type"), F.concat(F.lit("Code-"), F.hex(F.xxhash64("id")), F.lit(" assay")).alias("code"))
    some = codes.orderBy("code").limit(200).select("type", F.concat(F.lit("the "), "code", F.lit(" evidence")).alias("value"))
    got = validation.near_codes(some, codes)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan
    assert all(len(r.suggestions) == 1 and r.suggestions[0] in r.value for r in got.collect())


def test_ownership_of_a_long_session(spark):
    """Keys are sought all at once; a session in many shares gives what one does."""
    rng = random.Random(9)
    keys = [("s", k % 300, f"key{k}x") for k in range(1000)] + [("s", 1, ""), ("s", 2, None), ("t", 5, "Art"), ("u", 6, "never asked")]
    turns = []
    for n in range(4000):
        said = " ".join(rng.choice([f"key{rng.randint(0, 1200)}x", "word", "other text"]) for _ in range(rng.randint(0, 3)))
        turns.append(("s", n, said if n % 50 else None))
    turns += [("t", 0, "an artery"), ("t", 1, "none"), ("none", 0, "key1x"), (None, 0, "key1x")]
    df = spark.createDataFrame(turns, "session string, turn long, blob string")
    k = spark.createDataFrame(keys, "session string, article long, key string")
    of = {}
    for s, a, key in keys:
        if key:
            of.setdefault(s, []).append((key.lower(), a))
    want = {}
    for s, n, blob in turns:
        owners = {a for key, a in of.get(s, []) if key in (blob or "")}
        want[s, n] = (len(owners), owners.pop() if len(owners) == 1 else None)
    for share in (metering.SHARE_BYTES, 20_000):
        got = metering.attribute(df, k, share)
        assert {(r.session, r.turn): (r.n_owners, r.owner) for r in got.collect()} == want
