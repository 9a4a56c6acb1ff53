"""Structure repair against brute force over edits, with the odd cases."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import pairwise, product

import pytest

from patternloom.llm.queries import op11_structure_repair
from patternloom.llm.structure import Grammar, apart, damaged, digests, emptied, learn_grammar, repair_structure

SCHEMA = "conv_id long, turn long, role string, text string, audit string, piece int, `a.b` int"
LEGAL = re.compile(r"(s?(ua)+)?\Z")
BARE = re.compile("[^\x20\x09-\x0d]")


def fault(rows, k):
    role, text = rows[k]
    found = BARE.findall(text)
    if not found:
        return "blank"
    if (role, text) in rows[:k]:
        return "duplicate"
    return "" if found[-1] in ".!?" else "truncated"


def cheapest(rows):
    """Uniform-cost search over edits: (cost, audit, lines) least by cost, then audit."""
    faults = [fault(rows, k) for k in range(len(rows))]
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, k, initials, lines = heapq.heappop(queue)
        if k == len(rows) and LEGAL.match(initials):
            return cost, audit, "\n".join(lines)
        state = (k, initials[-1:], len(audit) - audit.rstrip("I").__len__())
        if state in done:
            continue
        done.add(state)
        ways = [(2, "I", 0, r) for r in ("user", "assistant")] if not audit.endswith("II") else []
        if k < len(rows):
            ways.append((3, "D", 1, None))
            if faults[k] not in ("blank", "duplicate"):
                late = faults[k] == "truncated"
                ways += [(late, "K", 1, rows[k][0])] + [(2 + late, "R", 1, r) for r in ("user", "assistant")]
        for extra, letter, step, role in ways:
            after = initials if role is None else initials + (role[:1] or "?")
            if role is None or re.match(r"(s?(ua)*u?)\Z", after):
                text = () if role is None else (f"{role}:{'' if letter == 'I' else rows[k][1]}",)
                heapq.heappush(queue, (cost + extra, audit + letter, k + step, after, lines + text))


def brute(rows):
    """The whole result for one conversation given as (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    plain = [r[1:] for r in rows]
    faults = [fault(plain, k) for k in range(len(rows))]
    at = [r[0] for r in rows if r[0] is not None]
    cost, audit, lines = cheapest(plain)
    counts = [max(at) - min(at) + 1 - len(set(at)) if at else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")]]
    counts.append(sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairwise(plain)))
    return (*counts, cost, audit, hashlib.sha256(lines.encode()).hexdigest())


@pytest.mark.parametrize("piece_rows", [2048, 3, 1])
def test_against_search(spark, piece_rows):
    rng = random.Random(4)
    texts = ["Yes.", "No", "", " \t", "Why?", None, "x" * 70_000 + "!", "é …", "  ok.  "]
    data = []
    for conv in [*range(40), None]:
        for k in range(rng.randrange(1, 9)):
            data.append((conv, rng.choice([k, k, k, 2, None]), rng.choice(["user", "assistant", "system", "tool", "", None, "Uma"]), rng.choice(texts)))
    want = {c: brute([r[1:] for r in data if r[0] == c]) for c in {r[0] for r in data}}
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in data], SCHEMA).repartition(3)
    parts = repair_structure(frame, piece_rows=piece_rows)
    got = {r[0]: tuple(r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in digests(parts).collect()}
    assert got == want
    assert piece_rows > 3 or parts.where("not whole").count() > 0


def test_query_against_search(spark):
    sf = "/root/testdata/sf0.001"
    rows: dict = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        mine = rows.setdefault(r.conv_id, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", r.text) if kind == 2 else r.text
            mine += [(r.turn, "user" if kind == 4 else r.role, text)] * (2 if kind == 3 else 1)
    got = {r[0]: tuple(r)[1:] for r in op11_structure_repair(spark, sf).collect()}
    assert got == {c: brute(mine) for c, mine in rows.items()}


def test_long_conversation_and_none(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(400), rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "c?", ""]) + str(rng.randrange(60)) * rng.randrange(2)) for _ in range(700)]
    frame = spark.createDataFrame([(1, *r, "x", 1, 2) for r in rows], SCHEMA).repartition(4)
    one, many = (digests(repair_structure(frame, piece_rows=n)).collect() for n in (2048, 40))
    assert one == many and tuple(one[0])[1:] == brute(rows)
    assert digests(repair_structure(frame.limit(0))).count() == 0


def test_emptied(spark):
    dropped = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(dropped, 0), (dropped + 100, 1), (dropped + 100, 2), (None, None)], "conv_id long, turn long")
    assert [r[0] for r in emptied(rows).collect()] == [dropped]
    whole = rows.selectExpr("conv_id", "turn", "'u' as role", "'t' as text")
    assert damaged(whole).where(f"conv = {dropped}").count() == 0


def test_any_grammar_gives_the_same(spark):
    rng = random.Random(6)
    sequences = ["".join(rng.choice("xsuaoSUAO" + "ua" * 4) for _ in range(rng.randrange(1, 30))) for _ in range(60)] + ["ua" * 50] * 3
    frame = spark.createDataFrame([(s, 2) for s in sequences], "symbols string, n long")
    plain, learnt = Grammar([]), learn_grammar(frame, rules=200)
    assert 10 < len(learnt.rules) <= 200 and len(learnt.parse("ua" * 50)) < 10
    for s in sequences:
        a, b = plain.matrix(s), learnt.matrix(s)
        for i, j in product(range(4), repeat=2):
            assert a[i][j][:2] == b[i][j][:2]
        for i in range(4):
            ends = [0 if j in (0, 3) else 2 for j in range(4)]
            assert plain.between(s, i, ends) == learnt.between(s, i, ends)


def test_apart():
    assert apart(["ab", "bc", "cd", "aa", "ad"], 9) == ["ab", "cd", "ad"]
