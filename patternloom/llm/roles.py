"""Chat formatting: repair the roles of a conversation at least cost, then render it.

Legal turns are an automaton: an optional system turn, then user and assistant in turn, ended by the
assistant. For each turn of the input, dynamic programming over its states chooses whether the turn keeps
its role, is relabelled or is merged into the turn before, and which empty turns are inserted; it is a product of
min-plus matrices, one per turn. So a conversation may be cut into pieces: each piece gives one matrix, the
matrices of a conversation give the states at its cuts, and every piece is then traced back alone. The
input is sorted by range, so that a conversation with a third of all rows is spread over tasks like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternloom.session import cut_lineage, ship

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)  # the role written last; nothing at the start
#: Fixed costs of one change.
MERGE, RELABEL, UNKNOWN, INSERT = 1.0, 2.0, 1.0, 3.0
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
PIECE_ROWS, PIECE_BYTES = 2048, 4 << 20
HEAD, TAIL, JOINT = "<|{}|>\n", "<|end|>\n", "\n"
NEVER = float("inf")


def _insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest roles to insert between two states so that the second may follow."""
    best: dict[tuple[int, int], tuple[int, ...]] = {}
    for s in FOLLOWS:
        level = [((), s)]
        for _ in range(4):
            for path, at in level:
                for o in FOLLOWS[at]:
                    best.setdefault((s, o), path)
            level = [((*path, o), o) for path, at in level for o in FOLLOWS[at]]
    return best


BETWEEN = _insertions()


def _choices() -> tuple[np.ndarray, np.ndarray]:
    """Cost of going from state s by a turn of role r (0: unknown) to state o, and whether by merging."""
    cost = np.full((4, 4, 4), NEVER)
    merged = np.zeros((4, 4, 4), bool)
    for r in range(4):
        for s in range(4):
            for o in (SYSTEM, USER, ASSISTANT):
                name = 0.0 if r == o else RELABEL if r else UNKNOWN
                insert = INSERT * len(BETWEEN[s, o]) if (s, o) in BETWEEN else NEVER
                cost[r, s, o] = name + min(insert, MERGE if s == o else NEVER)
                merged[r, s, o] = s == o and MERGE <= insert
    return cost, merged


STEP, MERGED = _choices()
END = np.array([0.0] + [0.0 if s == ASSISTANT else INSERT * (1 + len(BETWEEN[s, ASSISTANT])) for s in (SYSTEM, USER, ASSISTANT)])


def role_codes(roles: list[str | None]) -> np.ndarray:
    code = {r: k + 1 for k, r in enumerate(ROLES)}
    return np.array([code.get((r or "").strip().lower(), 0) for r in roles], np.int64)


def transfer(codes: np.ndarray) -> np.ndarray:
    """Least cost from each state before a run of turns to each state after it."""
    total = np.where(np.eye(4, dtype=bool), 0.0, NEVER)
    for r in codes:
        total = (total[:, :, None] + STEP[r][None]).min(axis=1)
    return total


def trace(codes: np.ndarray, entry: int, exit_: int) -> list[int]:
    """The states after each turn of a cheapest way; of equal ones the state first in order, from the end."""
    cost = np.full(4, NEVER)
    cost[entry] = 0.0
    before = np.zeros((len(codes), 4), np.int64)
    for k, r in enumerate(codes):
        ways = cost[:, None] + STEP[r]
        before[k] = ways.argmin(axis=0)
        cost = ways.min(axis=0)
    states = [exit_]
    for k in range(len(codes) - 1, 0, -1):
        states.append(int(before[k, states[-1]]))
    return states[::-1]


def render(codes: np.ndarray, texts: list[str | None], states: list[int], entry: int, last: bool):
    """For every turn its role, what was done, the cost and its fragment of the rendering."""
    s, out = entry, []
    for k, (r, text, o) in enumerate(zip(codes, texts, states)):
        done, cost = [], float(STEP[r, s, o])
        if MERGED[r, s, o]:
            fragment = JOINT + (text or "")
            done.append("merge")
        else:
            path = BETWEEN[s, o]
            fragment = TAIL if s != START else ""
            fragment += "".join(HEAD.format(ROLES[p - 1]) + TAIL for p in path) + HEAD.format(ROLES[o - 1]) + (text or "")
            done += [f"insert {ROLES[p - 1]}" for p in path]
        if r != o:
            done.append("relabel")
        if last and k == len(codes) - 1:
            fragment += TAIL
            if o != ASSISTANT:
                path = (*BETWEEN[o, ASSISTANT], ASSISTANT)
                fragment += "".join(HEAD.format(ROLES[p - 1]) + TAIL for p in path)
                done += [f"insert {ROLES[p - 1]}" for p in path]
                cost += float(END[o])
        out.append((ROLES[o - 1], ", ".join(done) or "keep", cost, fragment))
        s = o
    return out


def _cut(piece_rows: int, piece_bytes: int):
    """Sorted turns to pieces of one conversation, of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, conv, size = TaskContext.get().partitionId() << 32, [], None, 0

        def piece():
            nonlocal number
            number += 1
            cost = transfer(role_codes([h["role"] for h in held]))
            return {"piece": number, "conv": conv, "turns": list(held), "matrix": cost.ravel().tolist()}

        for batch in batches:
            kind, out = batch.schema.field("conv").type, []
            turn = batch.schema.field("turn").type
            for row in batch.to_pylist():
                length = len(row["text"] or "")
                if held and (row["conv"] != conv or len(held) >= piece_rows or size + length > piece_bytes):
                    out.append(piece())
                    held, size = [], 0
                conv = row["conv"]
                held.append({n: row[n] for n in ("turn", "role", "text")})
                size += length
            schema = _piece_schema(kind, turn)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([piece()], schema)

    return run


def _piece_schema(conv: pa.DataType, turn: pa.DataType) -> pa.Schema:
    turns = pa.list_(pa.struct([("turn", turn), ("role", pa.string()), ("text", pa.string())]))
    return pa.schema([("piece", pa.int64()), ("conv", conv), ("turns", turns), ("matrix", pa.list_(pa.float64()))])


def _ends(pieces: pd.DataFrame) -> pd.DataFrame:
    """States at the cuts of one conversation, from one small matrix per piece."""
    pieces = pieces.sort_values("piece")
    matrices = [np.array(m).reshape(4, 4) for m in pieces["matrix"]]
    costs = [np.array([0.0, NEVER, NEVER, NEVER])]
    for m in matrices:
        costs.append((costs[-1][:, None] + m).min(axis=0))
    state = int((costs[-1] + END).argmin())
    exits, entries = [], []
    for k in range(len(matrices) - 1, -1, -1):
        exits.append(state)
        state = int((costs[k] + matrices[k][:, state]).argmin())
        entries.append(state)
    sizes = pieces["size"].to_numpy()
    return pd.DataFrame(
        {
            "piece": pieces["piece"].to_numpy(),
            "entry": entries[::-1],
            "exit": exits[::-1],
            "offset": np.cumsum(sizes) - sizes,
            "last": np.arange(len(sizes)) == len(sizes) - 1,
        }
    )


def _write(kinds: tuple[pa.DataType, pa.DataType]):
    schema = pa.schema(
        [("conv", kinds[0]), ("position", pa.int64()), ("turn", kinds[1]), ("role", pa.string()), ("change", pa.string()), ("cost", pa.float64()), ("rendered", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                turns, texts = row["turns"], [t["text"] for t in row["turns"]]
                codes = role_codes([t["role"] for t in turns])
                entry, exit_ = row["entry"], row["exit"]
                if exit_ is None:  # the whole conversation
                    entry, exit_ = START, int((np.array(row["matrix"]).reshape(4, 4)[START] + END).argmin())
                last = row["last"] is None or row["last"]
                made = render(codes, texts, trace(codes, entry, exit_), entry, last)
                start = row["offset"] or 0
                rows = [
                    dict(zip(schema.names, (row["conv"], start + k, t["turn"], *m))) for k, (t, m) in enumerate(zip(turns, made))
                ]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def repair_roles(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """One row per turn of the input: conversation, position, turn, role, change, cost, rendered.

    ``position`` counts the turns of a conversation from 0, by turn number (null first), then role and a hash of the text;
    ``role`` is the repaired one and ``change`` what was done. The fragments ``rendered`` of a conversation,
    put together by position, are its rendering. A null text is empty, a null or other role unknown, and a null
    conversation is one conversation. Repeated rows are turns of their own. Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ship(conversations.sparkSession)
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).alias("text")
    )
    conv, turn = rows.schema["conv"], rows.schema["turn"]
    turns = T.ArrayType(T.StructType([turn, T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    piece = T.StructType(
        [T.StructField("piece", T.LongType()), conv, T.StructField("turns", turns), T.StructField("matrix", T.ArrayType(T.DoubleType()))]
    )
    # Equal rows are exchangeable; a number of their own spreads them over tasks too.
    numbered = rows.withColumns({"_hash": F.xxhash64("text"), "_n": F.monotonically_increasing_id()})
    keys = ["conv", "turn", "role", "_hash", "_n"]
    ranges = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    pieces = cut_lineage(ranges.drop("_hash", "_n").mapInArrow(_cut(piece_rows, piece_bytes), piece))
    several = pieces.groupBy("conv").count().where("count > 1").select(F.col("conv").alias("_several"))
    parts = pieces.select("piece", "conv", "matrix", F.size("turns").alias("size"))
    parts = parts.join(several, F.col("conv").eqNullSafe(F.col("_several")), "left_semi")
    ends = parts.groupBy("conv").applyInPandas(_ends, "piece long, entry int, exit int, offset long, last boolean")
    ends = cut_lineage(ends)
    cut = pieces.join(ends, "piece")
    whole = pieces.join(several, F.col("conv").eqNullSafe(F.col("_several")), "left_anti")
    whole = whole.select("*", *[F.lit(None).cast(k).alias(n) for n, k in (("entry", "int"), ("exit", "int"), ("offset", "long"), ("last", "boolean"))])
    schema = T.StructType(
        [conv, T.StructField("position", T.LongType()), turn, T.StructField("role", T.StringType()), T.StructField("change", T.StringType()), T.StructField("cost", T.DoubleType()), T.StructField("rendered", T.StringType())]
    )
    kinds = (to_arrow_type(conv.dataType), to_arrow_type(turn.dataType))
    made = cut.select(whole.columns).unionByName(whole).mapInArrow(_write(kinds), schema)
    return made.withColumnsRenamed({"conv": conv_col, "turn": turn_col})
