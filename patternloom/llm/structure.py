"""Repair of conversation structure: Re-Pair grammar, one min-plus matrix with an audit rope per rule.

Every turn is a symbol of its role and fault; a conversation is a sequence of symbols. Frequent neighbours become
rules of a grammar (Re-Pair), counted over all conversations. The edits that make a run of turns legal
are a min-plus matrix over the states of the automaton ``(s?(ua)+)?``: least cost from each state before to each
state after. A rule's matrix is the product of those of its two symbols, made once, bottom-up, for all
conversations, and its audit is a rope: of each cell only the state between its two parts is kept.

Of equal costs the audit least in ASCII counts. From one state before, the letters of the edits decide the state
after, and every run's audit ends in the edit of its last turn (insertions stand before the next turn). So
audits to different states differ, and none is the beginning of another: their order, a rank in each cell, is all
that products need to compare, and no audit is written out before it is known.

Long conversations are cut into pieces: each gives a matrix, these give the states at the cuts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternloom.session import cut_lineage, ship

EMPTY, SYSTEM, USER, ASSISTANT = range(4)  # the initial written last
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 60
#: Fixed costs of the edits; a truncated turn that stays costs one more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: One letter a turn: its role's initial (o: another), upper case if truncated; x must go. b and d are x with their fault.
SYMBOLS = "xsuaoSUAO"
RULES, ROUND, ROUNDS = 256, 32, 8  # rules of the grammar, rules made in one round, rounds
RARE = 32  # a pair this many times rarer than the most frequent one is not made a rule in the same round
FIRST = 0x4E00  # code point of the first rule's symbol
PIECE_ROWS, PIECE_CHARS = 2048, 1 << 16

Cell = tuple[int, int, int | str]  # cost, rank among the cells of its row, state between the two parts or the audit itself


class Grammar:
    """Matrices by symbol; those of rules refer to the two symbols they stand for."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.rules = rules
        self.parts = {x: (a, b) for x, a, b in rules}
        self.matrices = {s: symbol_matrix(s) for s in SYMBOLS}
        for x, a, b in rules:
            self.matrices[x] = product(self.matrices[a], self.matrices[b])

    def parse(self, symbols: str) -> str:
        for x, a, b in self.rules:
            symbols = symbols.replace(a + b, x)
        return symbols

    def audit(self, symbol: str, i: int, j: int) -> str:
        """The letters of one cell, read off the rope."""
        out, todo = [], [(symbol, i, j)]
        while todo:
            s, i, j = todo.pop()
            via = self.matrices[s][i][j][2]
            if isinstance(via, str):
                out.append(via)
            else:
                a, b = self.parts[s]
                todo += [(b, via, j), (a, i, via)]
        return "".join(out)

    def matrix(self, symbols: str) -> list[list[Cell]]:
        """The matrix of a sequence that is not empty; its ropes are not kept."""
        return reduce(product, (self.matrices[s] for s in self.parse(symbols)))

    def between(self, symbols: str, i: int, ends: list[int]) -> tuple[int, str, int]:
        """Cost, audit and last state of the cheapest way from state i, where ending in a state costs ``ends`` more."""
        parsed = self.parse(symbols)
        togo = [ends]
        for s in reversed(parsed):
            m = self.matrices[s]
            togo.append([min(m[i][j][0] + togo[-1][j] for j in range(4)) for i in range(4)])
        togo.reverse()
        cost, out = togo[0][i], []
        for s, rest in zip(parsed, togo[1:]):
            m = self.matrices[s][i]
            j = min(range(4), key=lambda j: (m[j][0] + rest[j], m[j][1]))
            out.append(self.audit(s, i, j))
            i = j
        return cost, "".join(out), i


def inserted(i: int, j: int) -> int:
    """Fewest insertions that lead from one state to another; NEVER if none do."""
    if i == j:
        return 0
    if j in (EMPTY, SYSTEM):
        return NEVER
    return 1 if (j == ASSISTANT) == (i == USER) else 2


#: What ends in a state costs, and its letters.
ENDS = [0, 2 * INSERT, INSERT, 0]
END_AUDIT = ["", "II", "I", ""]


def ranked(costs: list[list[tuple[int, str] | None]]) -> list[list[Cell]]:
    out = []
    for row in costs:
        order = sorted(a for _, a in filter(None, row))
        out.append([(NEVER, 4, "") if c is None else (c[0], order.index(c[1]), c[1]) for c in row])
    return out


def symbol_matrix(symbol: str) -> list[list[Cell]]:
    """One turn: insertions before it, then its own edit."""
    role, late = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    ways: list[list[list[tuple[int, str]]]] = [[[] for _ in range(4)] for _ in range(4)]
    for i in range(4):
        for m in range(4):
            n = inserted(i, m)
            if n >= NEVER:
                continue
            put = lambda j, cost, letter: ways[i][j].append((n * INSERT + cost, "I" * n + letter))  # noqa: B023, E731
            put(m, DELETE, "D")
            if symbol == "x":
                continue
            legal = ASSISTANT if m == USER else USER
            put(legal, REROLE + late, "R")
            if role == "ua"[legal == ASSISTANT]:
                put(legal, KEEP + late, "K")
            if role == "s" and m == EMPTY:
                put(SYSTEM, KEEP + late, "K")
    return ranked([[min(w) if w else None for w in row] for row in ways])


def product(a: list[list[Cell]], b: list[list[Cell]]) -> list[list[Cell]]:
    """Min-plus product; of equal costs the way whose first part is least, and the order of the ways to each state."""
    out = []
    for i in range(4):
        row = []
        for j in range(4):
            k = min(range(4), key=lambda k: (a[i][k][0] + b[k][j][0], a[i][k][1]))
            row.append((min(NEVER, a[i][k][0] + b[k][j][0]), k))
        # Ways through different states differ in their first parts, those through one state in their second.
        order = sorted((j for j in range(4) if row[j][0] < NEVER), key=lambda j: (a[i][row[j][1]][1], b[row[j][1]][j][1]))
        out.append([(c, order.index(j) if c < NEVER else 4, k) for j, (c, k) in enumerate(row)])
    return out


# -- grammar ---------------------------------------------------------------------


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each pair stands side by side, without overlaps of equal symbols."""
    held: Counter = Counter()
    for batch in batches:
        for s, n in zip(batch.column("work").to_pylist(), batch.column("n").to_pylist()):
            last = False
            for a, b in pairwise(s):
                last = a == b and not last if a == b else False
                if a != b or last:
                    held[a + b] += n
    yield pa.RecordBatch.from_pydict({"pair": pa.array(held, pa.string()), "n": pa.array(held.values(), pa.int64())})


def apart(pairs: list[str], most: int) -> list[str]:
    """The first pairs none of which can share a symbol of a sequence with another."""
    out, before, after = [], set(), set()
    for p in pairs:
        if len(out) < most and p[0] not in after and p[1] not in before:
            out.append(p)
            before.add(p[0])
            after.add(p[1])
    return out


def learn_grammar(sequences: DataFrame, rules: int = RULES, rounds: int = ROUNDS) -> Grammar:
    """Re-Pair over all sequences (``symbols``, ``n`` how often): every round counts neighbours and replaces some pairs.

    The number of rules bounds the grammar, not the sequences: what no rule stands for is left as it is.
    """
    spark = sequences.sparkSession
    ship(spark)
    made: list[tuple[str, str, str]] = []
    work = sequences.select(F.col("symbols").alias("work"), "n")
    for _ in range(rounds):
        counts = work.mapInArrow(_pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n >= 2")
        found = counts.orderBy(F.desc("n"), "pair").limit(8 * ROUND).collect()
        # Rare neighbours wait until the frequent ones are rules.
        chosen = apart([r["pair"] for r in found if r["n"] * RARE >= found[0]["n"]], min(ROUND, rules - len(made)))
        if not chosen:
            break
        new = [(chr(FIRST + len(made) + k), *p) for k, p in enumerate(chosen)]
        made += new
        text = F.col("work")
        for x, a, b in new:
            text = F.replace(text, F.lit(a + b), F.lit(x))
        # Sequences that have become equal, and those of one symbol, need not be kept apart or at all.
        work = cut_lineage(work.select(text.alias("work"), "n").where(F.length("work") > 1).groupBy("work").agg(F.sum("n").alias("n")))
    return Grammar(made)


# -- faults ----------------------------------------------------------------------

WHITE = " \t\n\v\f\r"


def turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text and the symbol of each row by its own text; nulls of role and text are one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    bare = F.rtrim(text, F.lit(WHITE))
    initial = F.substring(role, 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), letter).otherwise(F.upper(letter))
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), symbol.alias("symbol"))


LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
PIECE = "piece long, inner boolean, symbols string, roles array<string>, texts array<string>, low long, high long, distinct long, illegal long, first string, last string"


def _cut(conv: pa.DataType, rows_most: int, chars_most: int):
    """Sorted turns to pieces of one conversation; repeated turns of a piece are marked.

    ``inner`` pieces are surely whole conversations: not cut, and neither the first nor the last one of their task.
    """
    text = pa.list_(pa.string())
    schema = pa.schema(
        [("conv", conv), ("piece", pa.int64()), ("inner", pa.bool_()), ("symbols", pa.string()), ("roles", text), ("texts", text), ("low", pa.int64()), ("high", pa.int64()), ("distinct", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size, now, inner = 0, None, False  # inner: a conversation before, and no piece of this one yet

        def piece(ends: bool) -> dict:
            nonlocal number, inner
            number += 1
            alone, inner = inner and ends, ends
            seen, symbols = set(), []
            for _, role, text, symbol in held:
                symbols.append("d" if (role, text) in seen and symbol != "b" else symbol)
                seen.add((role, text))
            initials = [h[1][:1] for h in held]
            at = [h[0] for h in held if h[0] is not None]
            return {
                "conv": now, "piece": number, "inner": alone, "symbols": "".join(symbols), "roles": [h[1] for h in held], "texts": [h[2] for h in held],
                "low": min(at, default=None), "high": max(at, default=None), "distinct": len(set(at)),
                "illegal": sum(p not in LEGAL for p in pairwise(initials)), "first": initials[0], "last": initials[-1],
            }

        for batch in batches:
            out = []
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "symbol"))):
                if held and (conv != now or len(held) >= rows_most or size + len(row[2]) > chars_most):
                    out.append(piece(conv != now))
                    held, size = [], 0
                now = conv
                held.append(tuple(row))
                size += len(row[2])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([piece(False)], schema)

    return run


def plain(symbols: str) -> str:
    return symbols.replace("b", "x").replace("d", "x")


def repaired(audit: str, roles: list[str], texts: list[str], state: int) -> list[str]:
    """``role:text`` of the turns that an audit leaves, from the state before it."""
    out, k = [], 0
    for letter in audit:
        if letter == "D":
            k += 1
            continue
        if letter == "K" and state == EMPTY and roles[k][:1] == "s":
            state = SYSTEM
        else:
            state = ASSISTANT if state == USER else USER
        out.append(f"{ROLES[state] if letter != 'K' else roles[k]}:{'' if letter == 'I' else texts[k]}")
        k += letter != "I"
    return out


SHAPE = ("symbols", "low", "high", "distinct", "illegal")
PART = "cost long, audit string, lines string"


def _lines(left: list[list[str]]) -> pa.Array:
    return pa.array(["\n".join(x) if x else None for x in left], pa.string())


def _solve(shared):
    """Whole conversations: one way through the matrices of their symbols, and the repaired text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, known = shared.value, {}
        for batch in batches:
            costs, audits, left = [], [], []
            for s, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("symbols", "roles", "texts"))):
                s = plain(s)
                if s not in known:
                    if len(known) >= 100_000:
                        known.clear()
                    cost, audit, last = grammar.between(s, EMPTY, ENDS)
                    known[s] = cost, audit + END_AUDIT[last]
                costs.append(known[s][0])
                audits.append(known[s][1])
                left.append(repaired(audits[-1], roles, texts, EMPTY))
            columns = {n: batch.column(n) for n in batch.schema.names if n not in ("roles", "texts")}
            yield pa.RecordBatch.from_pydict(columns | {"cost": pa.array(costs, pa.int64()), "audit": pa.array(audits, pa.string()), "lines": _lines(left)})

    return run


def _matrices(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [[c[:2] for row in shared.value.matrix(plain(s)) for c in row] for s in batch.column("symbols").to_pylist()]
            columns = {n: batch.column(n) for n in ("conv", "piece")}
            columns |= {n: pa.array([[c[k] for c in x] for x in cells], pa.list_(pa.int64())) for k, n in enumerate(("costs", "ranks"))}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _ends(pieces: pd.DataFrame) -> pd.DataFrame:
    """States before and after every piece of one conversation, from one matrix per piece."""
    pieces = pieces.sort_values("piece")
    costs, ranks, togo = list(pieces["costs"]), list(pieces["ranks"]), [ENDS]
    for m in reversed(costs):
        togo.append([min(int(m[4 * i + j]) + togo[-1][j] for j in range(4)) for i in range(4)])
    togo.reverse()
    i, entries, exits = EMPTY, [], []
    for m, r, rest in zip(costs, ranks, togo[1:]):
        j = min(range(4), key=lambda j: (int(m[4 * i + j]) + rest[j], int(r[4 * i + j])))
        entries.append(i)
        exits.append(j)
        i = j
    return pd.DataFrame({"piece": pieces["piece"].to_numpy(), "entry": entries, "exit": exits, "ends": [False] * (len(exits) - 1) + [True], "total": togo[0][EMPTY]})


def _solve_pieces(shared):
    """Audit and repaired text of a piece between two known states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, left = [], []
            for r in batch.select(["symbols", "roles", "texts", "entry", "exit", "ends"]).to_pylist():
                only = [0 if j == r["exit"] else NEVER for j in range(4)]
                audits.append(shared.value.between(plain(r["symbols"]), r["entry"], only)[1] + (END_AUDIT[r["exit"]] if r["ends"] else ""))
                left.append(repaired(audits[-1], r["roles"], r["texts"], r["entry"]))
            columns = {n: batch.column(n) for n in ("conv", "piece")}
            yield pa.RecordBatch.from_pydict(columns | {"cost": batch.column("total"), "audit": pa.array(audits, pa.string()), "lines": _lines(left)})

    return run


def _join(conv: pa.DataType):
    """Sorted parts to conversations: one running hash, so texts pass by and are not held."""
    schema = pa.schema([("conv", conv), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, digest, begun, some = None, [], hashlib.sha256(), False, False
        done = lambda: pa.RecordBatch.from_pylist([{"conv": now, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)
        for batch in batches:
            for conv, letters, lines in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "lines"))):
                if some and conv != now:
                    yield done()
                    audit, digest, begun = [], hashlib.sha256(), False
                now, some = conv, True
                audit.append(letters)
                if lines is not None:
                    digest.update((("\n" if begun else "") + lines).encode())
                    begun = True
        if some:
            yield done()

    return run


def _mark_repeats(pieces: DataFrame) -> DataFrame:
    """Pieces of long conversations, where turns that an earlier piece has are marked as repeated too.

    Only a digest of each turn is compared: the first piece that has it is a grouped minimum.
    """
    each = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("roles") - 1).alias("k"), F.col("roles").alias("role"), F.col("texts").alias("text"))).alias("t")
    digest = F.sha2(F.concat(F.length("t.role").cast("string"), F.lit(":"), F.col("t.role"), F.col("t.text")).cast("binary"), 256)
    long = cut_lineage(pieces.select("conv", "piece", "symbols", each).where(~F.substring("symbols", F.col("t.k") + 1, F.lit(1)).isin("b", "d")).select("conv", "piece", F.col("t.k").alias("k"), digest.alias("digest")))
    firsts = long.groupBy("conv", "digest").agg(F.min("piece").alias("_first")).withColumnsRenamed({"conv": "_conv", "digest": "_digest"})
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    late = long.join(firsts, same).where("piece > _first").groupBy(F.col("piece").alias("_piece")).agg(F.collect_list("k").alias("_late"))  # turns of one piece
    letters = F.split("symbols", "")
    marked = F.array_join(F.transform(letters, lambda s, k: F.when(F.array_contains("_late", k), "d").otherwise(s)), "")
    joined = pieces.join(late, F.col("piece") == F.col("_piece"), "left")
    return joined.withColumn("symbols", F.when(F.col("_late").isNull(), F.col("symbols")).otherwise(marked)).select(*pieces.columns)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_structure(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS, rules: int = RULES,
) -> DataFrame:
    """Repaired conversations in parts: conv, part, whole, gaps, blank, duplicate, truncated, illegal, cost, audit and lines.

    The turns of a conversation are taken by turn number (null first, then role and text in code-point order). The first
    fault of a turn counts: no character but white space, the role and text of an earlier turn, or a last
    character other than ``.!?``. ``illegal`` counts neighbours whose initials are not su, ua or au. The audit has a letter
    for each edit: K keeps a turn, R gives it the role user or assistant that may follow, D deletes it, I inserts an
    empty one. ``lines`` is what is left, ``role:text`` of each turn on a line, or null if nothing is. Most conversations
    are ``whole``, one part; the audits and lines of the others follow each other by the number ``part``,
    while counts and cost are those of the conversation on each of its parts. A null role or text is one space, a
    null conversation is one conversation, repeated rows are turns of their own. A role without a known initial is
    never kept. Other columns are not read; a table without rows gives none.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = conversations.sparkSession
    ship(spark)
    rows = turns(conversations, conv_col, turn_col, role_col, text_col)
    conv = rows.schema["conv"]
    struct = lambda text: T.StructType([conv, *T._parse_datatype_string(text).fields])
    # The ranges need only the beginning of a text: equal beginnings stay in one task, where the whole text decides.
    ranges = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text")
    pieces = cut_lineage(ranges.mapInArrow(_cut(to_arrow_type(conv.dataType), piece_rows, piece_chars), struct(PIECE)))
    unsure = pieces.where("not inner")
    several = cut_lineage(unsure.groupBy("conv").count().where("count > 1").select(F.col("conv").alias("_several")))
    in_several = F.col("conv").eqNullSafe(F.col("_several"))
    whole = pieces.where("inner").unionByName(unsure.join(several, in_several, "left_anti"))
    cut = cut_lineage(_mark_repeats(unsure.join(several, in_several, "left_semi")))

    symbols = F.translate("symbols", "bd", "xx").alias("symbols")
    sequences = whole.select(symbols).unionByName(cut.select(symbols)).groupBy("symbols").agg(F.count(F.lit(1)).alias("n"))
    shared = spark.sparkContext.broadcast(learn_grammar(cut_lineage(sequences), rules))

    shape = struct("piece long, " + ", ".join(f"{n} {pieces.schema[n].dataType.simpleString()}" for n in SHAPE) + f", {PART}")
    solved = whole.select("conv", "piece", *SHAPE, "roles", "texts").mapInArrow(_solve(shared), shape)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).alias("gaps")
    columns = ["conv", F.col("piece").alias("part"), "whole", *COUNTS, "audit", "lines"]
    one = solved.select("*", gaps, *_faults(F.col("symbols")), F.lit(True).alias("whole")).select(*columns)

    matrices = cut.select("conv", "piece", "symbols").mapInArrow(_matrices(shared), struct("piece long, costs array<long>, ranks array<long>"))
    ends = cut_lineage(matrices.groupBy("conv").applyInPandas(_ends, "piece long, entry long, exit long, ends boolean, total long"))
    made = cut.join(ends, "piece").select("conv", "piece", "symbols", "roles", "texts", "entry", "exit", "ends", "total")
    parts = made.mapInArrow(_solve_pieces(shared), struct(f"piece long, {PART}"))
    counts = _shapes(cut).withColumnRenamed("conv", "_conv")
    many = parts.join(counts, F.col("conv").eqNullSafe(F.col("_conv"))).withColumn("whole", F.lit(False)).select(*columns)
    return one.unionByName(many).withColumnRenamed("conv", conv_col)


def digests(parts: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation of ``repair_structure``: its counts, whole audit, and repaired_sha256 of all its lines.

    The hash of a conversation in several parts runs over them in order, in one task that holds one batch of them.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    conv = T.StructField("conv", parts.schema[conv_col].dataType)
    parts = parts.withColumnRenamed(conv_col, "conv")
    sha = F.sha2(F.coalesce("lines", F.lit("")).cast("binary"), 256).alias("repaired_sha256")
    one = parts.where("whole").select("conv", *COUNTS, "audit", sha)
    cut = cut_lineage(parts.where("not whole"))
    line = cut.select("conv", "part", "audit", "lines").repartition("conv").sortWithinPartitions("conv", "part")
    joined = line.mapInArrow(_join(to_arrow_type(conv.dataType)), T.StructType([conv, *T._parse_datatype_string("audit string, repaired_sha256 string").fields]))
    counts = cut.groupBy(F.col("conv").alias("_conv")).agg(*[F.min(c).alias(c) for c in COUNTS])
    many = joined.join(counts, F.col("conv").eqNullSafe(F.col("_conv"))).select(*one.columns)
    return one.unionByName(many).withColumnRenamed("conv", conv_col)


def _faults(symbols: Column) -> list[Column]:
    """blank, duplicate and truncated turns of a sequence."""
    count = lambda letters: (F.length(symbols) - F.length(F.translate(symbols, letters, ""))).cast("long")
    return [count("b").alias("blank"), count("d").alias("duplicate"), count("SUAO").alias("truncated")]


def _shapes(cut: DataFrame) -> DataFrame:
    """Gaps and faults of conversations in several pieces; a turn number may be in two neighbouring pieces."""
    borders = F.array_sort(F.collect_list(F.struct("piece", "first", "last", "low", "high")))
    sums = cut.select("*", *_faults(F.col("symbols"))).groupBy("conv").agg(
        *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")], F.sum("illegal").alias("_illegal"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.sum("distinct").alias("distinct"), borders.alias("b"),
    )
    near = F.zip_with(F.slice("b", 1, F.size("b") - 1), F.slice("b", 2, F.size("b")), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    pair = lambda p: F.concat(p["x"]["last"], p["y"]["first"])
    wrong = F.size(F.filter(near, lambda p: ~pair(p).isin("su", "ua", "au")))
    twice = F.size(F.filter(near, lambda p: p["x"]["high"] == p["y"]["low"]))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct") + twice, F.lit(0))
    return sums.select("conv", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", (F.col("_illegal") + wrong).cast("long").alias("illegal"))


def space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(conv_col: str, turn_col: str) -> Column:
    return F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role and text after a damage that the CRC-32 of ``conv:turn`` modulo 20 decides; nulls are one space.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes its role user.
    """
    kind = damage(conv_col, turn_col)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space(text_col), ".!?", "")).otherwise(space(text_col))
    role = F.when(kind == 4, "user").otherwise(space(role_col))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), kind.alias("_kind"), copies.alias("_copy"))
    return rows.where("_kind <> 0").drop("_kind", "_copy")


def emptied(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Conversations of which ``damaged`` leaves no row."""
    return conversations.groupBy(conv_col).agg(F.max(damage(conv_col, turn_col)).alias("_most")).where("_most = 0").drop("_most")
