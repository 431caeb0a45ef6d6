"""Conversation repair and fill-in-the-middle against brute force, and their edge cases."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from scriptorium.llm import conversation_repair as repair
from scriptorium.llm import fill_middle
from scriptorium.llm.common import Scratch, read

SF = "/root/testdata/sf0.01"
CONV = "conv_id long, turn long, role string, text string, cost string, audit string, pos long, head string"


def damaged(rows):
    """The contract's damage, row by row."""
    for conv, turn, role, text, *_ in rows:
        said = [" " if x is None else str(x) for x in (conv, turn)]
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(":".join(said).encode()) % 20
        if what == 1:
            text = ""
        elif what == 2:
            text = re.sub("[.!?]", "", text)
        elif what == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if what == 0 else 2 if what == 3 else 1)


def cheapest(rows):
    """Least (cost, audit), and what it gives, by search over whole outputs: every
    edit of every row, up to three insertions on end, best first."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, out, kept = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            return cost, audit, kept
        if (i, out, audit[-3:] == "III") in seen or not re.fullmatch("s?(ua)*u?", out):
            continue
        seen.add((i, out, audit[-3:] == "III"))
        if not audit.endswith("III"):
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 3, audit + "I", i, out + role[0], kept + ((role, ""),)))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out, kept))
            if fault in (None, "truncated"):
                more = 3 if fault else 0
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, out + (role[:1] or "-"), kept + ((role, text),)))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, out + new[0], kept + ((new, text),)))


def brute(rows):
    groups = {r[0]: [] for r in rows}
    for r in damaged(rows):
        groups[r[0]].append(r)
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, counts, judged = set(), defaultdict(int), []
        for _, _, role, text in group:
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            judged.append((role, text, fault))
        turns = [r[1] for r in group if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit, kept = cheapest(judged)
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest()
        yield conv, (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha)


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def results(df):
    got = df.collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got}


def made(n, seed=3):
    """Conversations of every shape, with nulls, ties, repeated rows and odd roles."""
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for t in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Assistant"])
            text = rng.choice(["Yes.", "No", "Why?", "", None, "\t\n", "So. It \x0b\r", "ok", f"line {rng.randint(0, 3)}.", " ", "é!"])
            rows.append((conv, rng.choice([t, t, t, t + 3, None, 0]), role, text, "x", "x", 1, "x"))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows + [(None, 1, "user", "A.", "x", "x", 1, "x"), (None, None, None, None, None, None, None, None)]


def test_made_conversations_equal_brute_force(spark):
    rows = made(500)
    assert results(repair.repair_conversations(spark.createDataFrame(rows, CONV).repartition(3))) == dict(brute(rows))


def test_every_conversation_equals_brute_force(spark):
    df = read(spark, SF, "conversations")
    assert results(repair.repair_conversations(df)) == dict(brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]))


def test_long_conversation_over_many_tasks(spark):
    """One conversation holds most rows, so that its spans lie in every task; its
    cost equals a parse from left to right, its turns alternate."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "user"]), rng.choice(["A.", "B", "b c d.", f"{t}."]), "", "", 0, "") for t in range(3000)] + made(40)
    df = spark.createDataFrame([r for r in rows if r[0] != 7 or r[4] == ""], CONV).repartition(6)
    with Scratch(spark) as scratch:
        edits, turns = repair.repair(repair.damage(df.where("conv_id = 7 and text <> 'x'")), scratch)
        found = edits.first()
        got = turns.collect()
        faults = spark.createDataFrame(repair.with_faults(repair.damage(df.where("conv_id = 7"))).where("not dropped").collect()).orderBy(*repair.ORDER).collect()
    spans, before = {0: (0, "")}, None
    reached = {k[1]: v for k, v in repair.INSERTED.items() if k[0] == 0}
    for r in faults:
        this = (r.turn, r.role, r.text)
        dead = r.blank or r.again == 2 or (r.again == 1 and this == before)
        before, new = this, {}
        for (p, q), (cost, audit) in repair.row_cell(repair.kind_of(r.role[:1], dead, r.truncated)).items():
            if p in reached:
                whole = (reached[p][0] + cost, reached[p][1] + audit)
                new[q] = min(new.get(q, whole), whole)
        reached = new
    assert (found.cost, found.audit) == min(reached[q] for q in repair.ENDS if q in reached)
    assert [r.pos for r in got] == list(range(len(got)))
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in got))
    assert len([c for c in found.audit if c != "I"]) == len(faults)


def test_conversations_without_rows(spark):
    empty = spark.createDataFrame([], CONV)
    assert repair.repair_conversations(empty).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = results(repair.repair_conversations(spark.createDataFrame([(gone, 0, "user", "A.", "", "", 0, "")], CONV)))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_very_long_turns(spark):
    rows = [(1, 0, "user", "word " * 300_000 + "end.", "", "", 0, ""), (1, 1, "assistant", ". " * 600_000, "", "", 0, ""), (1, 2, "user", " " * 1_500_000, "", "", 0, "")]
    assert results(repair.repair_conversations(spark.createDataFrame(rows, CONV))) == dict(brute(rows))


FIELDS = "doc_id long, text string, n string, form long, output string, h1 string, key string"


def fim(doc_id, text, rate=100):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text, text
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if out[1] == "S" else "psm", len(p), len(m), out, text


@pytest.mark.parametrize("rate", [100, 40])
def test_fill_in_middle(spark, rate):
    rng = random.Random(2)
    texts = ["", None, "\n", "\n\n\n", "a", "a\n", "\na", "x<P>y\nz", "é\n \r\n\x0b b\n", "<M>", "<", "P>\n<", "line\n" * 300_000, "x" * 1_200_000] + ["\n".join("ab é"[: rng.randint(0, 4)] for _ in range(rng.randint(0, 9))) for _ in range(300)]
    rows = [(i if i % 11 else None, t, "x", 1, "x", "x", "x") for i, t in enumerate(texts)]
    rows += rows[4:8]
    df = fill_middle.fill_in_middle(spark.createDataFrame(rows, FIELDS).repartition(3), rate=rate)
    assert df.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr((r[0], *fim(r[0], r[1], rate))) for r in rows)
    assert {r.form for r in df.select("form").collect()} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(spark.createDataFrame([], FIELDS)).collect() == []
