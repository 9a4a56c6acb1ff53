import itertools
import random

import pytest

from patternloom.llm import roles as R


def brute_cost(codes):
    """Least cost over all role choices, merges and insertions, by search over legal renderings."""
    best = {R.START: 0.0}
    for r in codes:
        new = {}
        for s, c in best.items():
            for o in (R.SYSTEM, R.USER, R.ASSISTANT):
                name = 0 if o == r else R.RELABEL if r else R.UNKNOWN
                if s == o:
                    new[o] = min(new.get(o, 99), c + name + R.MERGE)
                for n in range(4):
                    for path in itertools.product((R.SYSTEM, R.USER, R.ASSISTANT), repeat=n):
                        if all(b in R.FOLLOWS[a] for a, b in zip((s, *path), (*path, o))):
                            new[o] = min(new.get(o, 99), c + name + R.INSERT * n)
        best = new
    ends = {R.ASSISTANT: 0.0, R.USER: R.INSERT, R.SYSTEM: 2 * R.INSERT, R.START: 0.0}
    return min(c + ends[s] for s, c in best.items())


def legal(rendering):
    roles = [x.split("|>")[0] for x in rendering.split("<|") if x.split("|>")[0] in R.ROLES]
    roles = roles[1:] if roles[0] == "system" else roles
    return roles == ["user", "assistant"] * (len(roles) // 2) and rendering.count(R.TAIL) == rendering.count("<|") - rendering.count("<|end|>")


@pytest.mark.parametrize("piece", [2048, 2])
def test_repairs_against_search(spark, piece):
    rng = random.Random(6)
    names = [None, "system", "user", "assistant", "tool", " User "]
    rows = [(c, t, rng.choice(names), rng.choice(["x", "", None])) for c in range(60) for t in range(rng.randrange(1, 9))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    made = {}
    for r in R.repair_roles(frame, piece_rows=piece).collect():
        made.setdefault(r.conv_id, []).append(r)
    for conv in range(60):
        turns = sorted(made[conv], key=lambda r: r.position)
        assert [r.position for r in turns] == list(range(len(turns)))
        assert [r.turn for r in turns] == [t for c, t, *_ in rows if c == conv]
        codes = R.role_codes([x[2] for x in rows if x[0] == conv])
        assert sum(r.cost for r in turns) == brute_cost(codes)
        assert legal("".join(r.rendered for r in turns))


def test_odd_turns(spark):
    schema = "conv_id long, turn long, role string, text string, position int, cost string"
    rows = [(None, None, None, None, 1, "x")] * 3 + [(1, 0, "user", "a" * 200_000, 1, "x"), (1, 0, "user", "b", 1, None), (1, None, "assistant", "c", 1, None)]
    got = R.repair_roles(spark.createDataFrame(rows, schema), piece_bytes=1000).collect()
    assert len(got) == 6
    for conv in (None, 1):
        turns = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in turns] == [0, 1, 2] and legal("".join(r.rendered for r in turns))
    assert R.repair_roles(spark.createDataFrame([], schema)).count() == 0


def test_clean_conversation_is_kept(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")]
    got = sorted(R.repair_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.position)
    assert {r.change for r in got} == {"keep"} and sum(r.cost for r in got) == 0
    assert "".join(r.rendered for r in got) == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\na<|end|>\n"
