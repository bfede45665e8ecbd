"""Repair of conversations: the cheapest edits that give an optional system turn, then user and assistant in turn.

Each turn is a symbol of its role and its first fault, each conversation the string of its symbols, its signature. What is
to be done depends on the signature alone, so distinct signatures are sorted over the cluster and inserted into a prefix
trie, a range of signatures a task. A node of the trie holds one layer of the dynamic program; it is computed once for
all signatures with that prefix, and a terminal node gives the answer of its signature. As signatures come sorted, only
the path to the newest node is kept. The answers go back to the conversations, whose texts are shuffled once and
stream past their edits.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from atlasmill.llm.tables import small_batches
from atlasmill.session import materialize

SPACE = " \t\n\x0b\x0c\r"
#: Classes of roles and of faults; a turn's symbol is FIRST + 4 * role + fault.
ROLES, (GOOD, BLANK, DUPLICATE, TRUNCATED), FIRST = "sua?", range(4), 65
LEGAL = ("su", "ua", "au")
#: What an edit costs; an undeleted truncated turn adds TRUNCATION.
REROLE, DELETE, INSERT, TRUNCATION = 3, 4, 3, 3
#: Bytes of signatures and answers up to which the answers are broadcast; beyond, a signature meets its conversations in SALTS parts.
BROADCAST_BYTES = 8 << 20
SALTS = 32
ANSWER = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
#: What has been put out so far: nothing, a system turn, a user turn, an assistant turn. Ends may be NOTHING or ASSISTANT.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
OUT_OF_REACH = 1 << 60


def _moves(symbol: int) -> list[tuple[int, int, int, str]]:
    """(state, next state, cost, letters) of the ways to consume one turn: inserted turns, then one edit of it."""
    role, fault = ROLES[symbol >> 2], symbol & 3
    keeps = {"s": {NOTHING: SYSTEM}, "u": {q: USER for q in (NOTHING, SYSTEM, ASSISTANT)}, "a": {USER: ASSISTANT}, "?": {}}[role]
    out = []
    for state in range(4):
        at = state
        for n in range(3):
            lead, cost = "I" * n, INSERT * n
            out.append((state, at, cost + DELETE, lead + "D"))
            if fault not in (BLANK, DUPLICATE):
                cost += TRUNCATION * (fault == TRUNCATED)
                out.append((state, NEXT[at], cost + REROLE, lead + "R"))
                if at in keeps:
                    out.append((state, keeps[at], cost, lead + "K"))
            at = NEXT[at]
    return out


MOVES = [_moves(s) for s in range(16)]


class Trie:
    """The path of the newest signature: a layer a node, with the cost, the order and the last move of the best edits to each state.

    Edits that end at one layer have consumed equally many turns and end with a consuming letter, so none of them is the
    beginning of another: their order stays whatever follows, and a layer needs numbers for it, not the strings.
    """

    def __init__(self):
        self.path = b""
        self.cost, self.order, self.move = array("q", [0, *[OUT_OF_REACH] * 3]), bytearray(4), bytearray(4)
        self.layers = 0

    def insert(self, signature: bytes) -> tuple[int, str]:
        """Cost and letters of the cheapest edits, of equal ones the ASCII-least."""
        shared = _common(self.path, signature)
        for column in (self.cost, self.order, self.move):
            del column[4 * (shared + 1) :]
        for symbol in signature[shared:]:
            self._grow(MOVES[symbol - FIRST])
        self.path = signature
        return self._answer()

    def _grow(self, moves: list[tuple[int, int, int, str]]) -> None:
        cost, order = self.cost[-4:], self.order[-4:]
        best: dict[int, tuple] = {}
        for k, (state, then, c, letters) in enumerate(moves):
            if cost[state] < OUT_OF_REACH:
                key = (cost[state] + c, order[state], letters, k)
                if then not in best or key < best[then]:
                    best[then] = key
        ranks = {then: n for n, then in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
        for then in range(4):
            self.cost.append(best[then][0] if then in best else OUT_OF_REACH)
            self.order.append(ranks.get(then, 0))
            self.move.append(best[then][3] if then in best else 0)
        self.layers += 1

    def _answer(self) -> tuple[int, str]:
        ends = [(NOTHING, ""), (SYSTEM, "II"), (USER, "I"), (ASSISTANT, "")]
        cost, _, tail, state = min((self.cost[q - 4] + INSERT * len(tail), self.order[q - 4], tail, q) for q, tail in ends)
        letters = [tail]
        for depth in range(len(self.path), 0, -1):
            state, _, _, step = MOVES[self.path[depth - 1] - FIRST][self.move[4 * depth + state]]
            letters.append(step)
        return cost, "".join(reversed(letters))


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def counts(signature: bytes) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated turns, and neighbours whose roles do not follow each other."""
    codes = np.frombuffer(signature, np.uint8) - FIRST
    fault, role = np.bincount(codes & 3, minlength=4), codes >> 2
    legal = np.isin(role[:-1] * 4 + role[1:], [ROLES.index(a) * 4 + ROLES.index(b) for a, b in LEGAL])
    return int(fault[BLANK]), int(fault[DUPLICATE]), int(fault[TRUNCATED]), int(np.count_nonzero(~legal))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie, schema = Trie(), pa.schema([(n, pa.string() if n in ("signature", "audit") else pa.int64()) for n in (x.split(" ")[0] for x in ANSWER.split(", "))])
    for batch in batches:
        rows = []
        for signature in batch.column(0).to_pylist():
            key = signature.encode()
            rows.append((signature, *counts(key), *trie.insert(key)))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], type=f.type) for f in schema], schema=schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of each row, damaged by a checksum of its place; copies is 0 for a row that is dropped, 2 for one that is repeated."""

    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    text = F.when(code == 1, F.lit("")).when(code == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    copies = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(code == 4, F.lit("user")).otherwise(known("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _prepared(rows: DataFrame) -> DataFrame:
    """Add what orders the turns of one number (digest) and the symbol of each row as far as it can be told alone."""
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(GOOD)
    first = F.left("role", F.lit(1))
    role = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("symbol", (role * 4 + fault).cast("int"))


#: Ascending, so that a null turn is first.
ORDER = ("turn", "role", "digest")


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before; nulls are equal."""
    if len(column) < 2:
        return np.zeros(max(0, len(column) - 1), dtype=bool)
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    other = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(other, pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _signatures_of(kind: pa.DataType):
    """Work of a task that makes one row a conversation of rows sorted by conversation and order of turns."""
    schema = pa.schema([("conv_id", kind), ("signature", pa.string()), ("gaps", pa.int64())])

    def run(batches):
        now, symbols, turns, out, size = None, [], None, [], 0

        def close():
            gaps = 0 if turns is None else turns[1] - turns[0] + 1 - turns[2]
            out.append((now[0], b"".join(symbols).decode(), min(gaps, (1 << 63) - 1)))

        def flushed():
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()

        for batch in batches:
            conv, turn = batch.column(0), batch.column(1)
            there, number = turn.is_valid().to_numpy(zero_copy_only=False), turn.fill_null(0).to_numpy()
            code, copies, again = (batch.column(i).to_numpy() for i in (2, 3, 4))
            fault = np.where((again > 1) & (code & 3 != BLANK), DUPLICATE, code & 3)
            second = np.where(code & 3 == BLANK, BLANK, DUPLICATE)
            starts = np.concatenate(([0], np.flatnonzero(_differs(conv)) + 1, [len(conv)]))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                key = conv[a].as_py()
                if now is None or now[0] != key:
                    if now is not None:
                        close()
                        size += sum(map(len, symbols)) + 24
                        if size > 1 << 22:
                            yield from flushed()
                            size = 0
                    now, symbols, turns = (key,), [], None
                alive = copies[a:b] > 0
                role, n = code[a:b][alive] & ~3, copies[a:b][alive]
                line = np.repeat(role + fault[a:b][alive], n)
                line[np.cumsum(n)[n > 1] - 1] = (role + second[a:b][alive])[n > 1]
                symbols.append((line + FIRST).astype(np.uint8).tobytes())
                numbers = number[a:b][alive & there[a:b]]
                if len(numbers):
                    low, high = int(numbers[0]), int(numbers[-1])
                    distinct = int(np.count_nonzero(numbers[1:] != numbers[:-1])) + 1
                    turns = (low, high, distinct) if turns is None else (turns[0], high, turns[2] + distinct - (turns[1] == low))
        if now is not None:
            close()
        if out:
            yield from flushed()

    return run


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature, gaps of each conversation of rows with copies; gaps are turn numbers that are missing between its first and its last.

    One shuffle, without texts. A conversation's rows stream through one task, as their hash must later; that task keeps
    a byte a row of it. Whether a turn repeats an earlier one is told by its number among the rows of equal role and text.
    """
    light = _prepared(rows).select("conv_id", "turn", "role", "digest", "symbol", F.col("copies").cast("int").alias("copies"), (F.col("copies") > 0).alias("alive"))
    seen = Window.partitionBy("conv_id", "alive", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    marked = light.repartition("conv_id").withColumn("again", F.row_number().over(seen)).sortWithinPartitions("conv_id", *ORDER)
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("signature", T.StringType()), T.StructField("gaps", T.LongType())])
    return marked.select("conv_id", "turn", "symbol", "copies", "again").mapInArrow(_signatures_of(to_arrow_type(kind)), schema)


def plans(rows: DataFrame) -> DataFrame:
    """conv_id, signature, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation."""
    conversations = materialize(signatures(rows), "signatures")
    ranged = conversations.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    answers = materialize(ranged.mapInArrow(_answers, ANSWER), "answers")
    size = answers.agg(F.sum(F.length("signature") + F.length("audit"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return conversations.join(F.broadcast(answers), "signature")
    salted = answers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return conversations.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).join(salted, ["signature", "salt"]).drop("salt")


CARRIED = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _edited(rows: DataFrame, made: DataFrame) -> DataFrame:
    """Each conversation's edits, then its turns, in one stream: conv_id, kind, text, role, copies, plan (what plans() says)."""
    plan = F.struct(*CARRIED)
    turns = _prepared(rows.where("copies > 0")).select("conv_id", F.lit(1).alias("kind"), F.when(F.col("symbol").bitwiseAND(3) != BLANK, F.col("text")).alias("text"), "role", F.col("copies").cast("int").alias("copies"), "turn", "digest")
    heads = made.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("role"), F.lit(0).alias("copies"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), plan.alias("plan"))
    stream = heads.unionByName(turns, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    return stream.select("conv_id", "kind", "text", "role", "copies", "plan")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, None, plan, None) as a conversation begins, then (conv_id, letter, role, text) of each turn of its repaired form."""
    letters, at, state, conv = "", 0, NOTHING, None

    def put(letter, role=None, text=""):
        nonlocal state
        state = SYSTEM if letter == "K" and role[:1] == "s" else NEXT[state]
        return conv, letter, role if letter == "K" else "user" if state == USER else "assistant", text

    for batch in batches:
        for key, kind, text, role, copies, plan in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if kind == 0:
                while at < len(letters):
                    at += 1
                    yield put("I")
                letters, at, state, conv = plan["audit"], 0, NOTHING, key
                yield conv, None, plan, None
                continue
            for _ in range(copies):
                while letters[at] == "I":
                    at += 1
                    yield put("I")
                at += 1
                if letters[at - 1] != "D":
                    yield put(letters[at - 1], role, text)
    while at < len(letters):
        at += 1
        yield put("I")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position from 0, role, text, edit (K kept, R given another role, I inserted).

    rows: conv_id, turn, role, text, copies, as damaged() gives them. Turns go by number, nulls first; those of one
    number by role, then by the SHA-256 of their text. A conversation of no turns gives no rows; null ids are one
    conversation; a role that is not s..., u... or a... cannot be kept.
    """
    small_batches(rows.sparkSession)
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *(T.StructField(n, t) for n, t in (("position", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("edit", T.StringType())))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        held, size, position = [], 0, 0
        for conv, letter, role, text in _walk(batches):
            if letter is None:
                position = 0
                continue
            held.append((conv, position, role, text, letter))
            position, size = position + 1, size + len(text) + 32
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    return _edited(rows, plans(rows)).mapInArrow(run, schema)


def repair_digests(conversations: DataFrame) -> DataFrame:
    """Damage the conversations, and give each one's faults, cheapest edits and the hash of its repaired form.

    Every conv_id has a row, also those that lost all turns: zeros, an empty audit and the hash of nothing. Nulls stand for
    one space, but a null turn stays null and is before all others; null ids are one conversation; turns of one number
    go by role, then by the SHA-256 of their text; repeated rows are duplicates; very long texts stream by;
    an empty table gives no rows; extra columns are ignored.
    """
    small_batches(conversations.sparkSession)
    rows = damaged(conversations)
    made = plans(rows)
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *(T.StructField(c, made.schema[c].dataType) for c in CARRIED), T.StructField("repaired_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        held, digest, lines, size = [], None, 0, 0
        for conv, letter, role, text in _walk(batches):
            if letter is None:
                if held:
                    held[-1].append(digest.hexdigest())
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                    held, size = [], 0
                held.append([conv, *(role[c] for c in CARRIED)])
                digest, lines, size = hashlib.sha256(), 0, size + 200 + len(role["audit"])
                continue
            digest.update(f"{chr(10) if lines else ''}{role}:".encode())
            digest.update(text.encode())
            lines += 1
        if held:
            held[-1].append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    return _edited(rows, made).mapInArrow(run, schema)
