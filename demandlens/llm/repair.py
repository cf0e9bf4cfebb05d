"""Repair of damaged conversations by dynamic programming over a trie of role and fault signatures (operator 11).

A message is one letter of its conversation's signature: its role's initial and its first fault. A repaired conversation
has role initials ``(s?(ua)+)?``, which an automaton of four states accepts, so what a stretch of messages can do is known
by the cheapest edits between each pair of states. Stretches of up to BLOCK letters are sorted and walked as a trie: layers
of the dynamic program stay on a stack as long as the next signature shares their prefix, and the layer on top at a
signature's end is its answer. The answers of a conversation's stretches are then composed in order, so a conversation of
any length is dealt over many tasks up to that point; the last step streams each conversation through one task, since the
repaired texts are hashed in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm.util import doc_columns, stored

#: Letters of a stretch.
BLOCK = 1024
#: Signature letters by role initial (system, user, assistant, other), for each fault.
SOUND, TRUNCATED, BLANK, DUPLICATE = "suax", "SUAX", "0123", "4567"
BLANKS = " \t\n\x0b\x0c\r"
ROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: The automaton: nothing yet, after system, after user, after assistant. The second and third names end no conversation.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)

_KINDS = str.maketrans(BLANK + DUPLICATE, SOUND + SOUND)

Paths = dict[int, tuple[int, str]]


def following(state: int) -> int:
    """The state after the one role of user and assistant that may come next."""
    return ASSISTANT if state == USER else USER


def keeping(state: int, kind: str) -> int | None:
    """The state after a kept message, None where its role may not stand."""
    if kind == "s":
        return SYSTEM if state == START else None
    return following(state) if kind == "ua"[state == USER] else None


def put(paths: Paths, state: int, cost: int, audit: str) -> None:
    if state not in paths or (cost, audit) < paths[state]:
        paths[state] = (cost, audit)


def inserted(paths: Paths) -> Paths:
    """Cheapest edits to each state when messages may be inserted next; two always suffice, since a third leads back."""
    out = dict(paths)
    for _ in range(2):
        for state, (cost, audit) in list(out.items()):
            put(out, following(state), cost + INSERT, audit + "I")
    return out


def after(paths: Paths, letter: str) -> Paths:
    """Cheapest edits to each state once one more message is dealt with.

    Of edits of equal cost the ASCII-least stay. Edits up to the same message at equal cost are never a beginning of one
    another, so the least of them stay the least whatever follows.
    """
    out: Paths = {}
    deleted = letter in BLANK or letter in DUPLICATE
    more = CUT if letter in TRUNCATED else 0
    for state, (cost, audit) in inserted(paths).items():
        put(out, state, cost + DELETE, audit + "D")
        if not deleted:
            kept = keeping(state, letter.lower())
            if kept is not None:
                put(out, kept, cost + more, audit + "K")
            put(out, following(state), cost + ROLE + more, audit + "R")
    return out


def layers(signature: str, stack: list[tuple[str, list[Paths]]]) -> list[Paths]:
    """The layer at a signature's end; ``stack`` holds its prefixes' letters and layers, shared with the signature before.

    A signature begins with ^ if it surely begins a conversation, which fixes the first state, and else with *.
    """
    shared = 0
    while shared < min(len(stack), len(signature)) and stack[shared][0] == signature[shared]:
        shared += 1
    del stack[shared:]
    for letter in signature[shared:]:
        if not stack:
            layer = [{s: (0, "")} for s in range(1 if letter == "^" else 4)]
        else:
            layer = [after(paths, letter) for paths in stack[-1][1]]
        stack.append((letter, layer))
    return stack[-1][1]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    some = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pa.RecordBatch.from_pylist(some, schema)
            some = []
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


def stretches(faces: DataFrame) -> DataFrame:
    """(conv_id, part, seq, sig): the signatures of conversations in stretches, in order of part and seq."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("sig", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def blocks() -> Iterator[dict]:
            seq, conv, open_, begun = 0, None, None, False
            for row in _rows(batches):
                if open_ is None or row["conv_id"] != conv:
                    if open_ is not None:
                        yield {"conv_id": conv, "part": part, "seq": seq, "sig": open_}
                        seq += 1
                    conv, open_ = row["conv_id"], "^" if begun else "*"
                    begun = True
                letters = row["letter"] + row["again"] * (row["copies"] - 1)
                while letters:
                    if len(open_) > BLOCK:
                        yield {"conv_id": conv, "part": part, "seq": seq, "sig": open_}
                        seq, open_ = seq + 1, "*"
                    room = BLOCK + 1 - len(open_)
                    open_, letters = open_ + letters[:room], letters[room:]
            if open_ is not None:
                yield {"conv_id": conv, "part": part, "seq": seq, "sig": open_}

        yield from _batches(blocks(), schema)

    order = ["conv_id", "turn", "role", "digest"]
    return faces.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, "conv_id long, part int, seq long, sig string")


def answered(blocks: DataFrame) -> DataFrame:
    """Stretches with ``costs`` and ``audits``, four for each first state in turn; what can't be reached is null.

    Sorted signatures are dealt by range with the conversation below them, so one signature of a third of all
    conversations fills several tasks, each of which computes its layers once.
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("sig", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list = []

        def rows() -> Iterator[dict]:
            for row in _rows(batches):
                ends = [paths.get(s, (None, None)) for paths in layers(row["sig"], stack) for s in range(4)]
                yield row | {"costs": [c for c, _ in ends], "audits": [a for _, a in ends]}

        yield from _batches(rows(), schema, 64)

    order = ["sig", "conv_id", "part", "seq"]
    return (
        blocks.repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(solve, "conv_id long, part int, seq long, sig string, costs array<long>, audits array<string>")
    )


def joined(paths: Paths, row: dict) -> Paths:
    """The paths up to a stretch's beginning, continued by it."""
    out: Paths = {}
    for state, (cost, audit) in paths.items():
        for end in range(4):
            more = row["costs"][4 * state + end] if 4 * state + end < len(row["costs"]) else None
            if more is not None:
                put(out, end, cost + more, audit + row["audits"][4 * state + end])
    return out


class Repaired:
    """One conversation on its way: first its stretches, then its messages in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.paths, self.audit = conv_id, {START: (0, "")}, None
        self.counts, self.illegal, self.last = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, ""
        self.at, self.state, self.position = 0, START, 0
        self.turns, self.low, self.high = 0, None, None

    def stretch(self, row: dict) -> None:
        self.paths = joined(self.paths, row)
        sig = row["sig"][1:]
        for name, letters in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED)):
            self.counts[name] += sum(map(sig.count, letters))
        kinds = self.last + "".join(c.lower() for c in sig.translate(_KINDS))
        self.illegal += sum(kinds[i : i + 2] not in ("su", "ua", "au") for i in range(len(kinds) - 1))
        self.last = kinds[-1:]

    def settle(self) -> None:
        if self.audit is None:
            every = inserted(self.paths)
            self.cost, self.audit = min(every[s] for s in ENDS if s in every)

    def _message(self, edit: str, turn: int | None, role: str, text: str) -> dict:
        self.position += 1
        return {"conv_id": self.conv_id, "position": self.position, "edit": edit, "turn": turn, "role": role, "text": text}

    def _next(self) -> str:
        self.state = following(self.state)
        return "user" if self.state == USER else "assistant"

    def insertions(self) -> Iterator[dict]:
        self.settle()
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._message("I", None, self._next(), "")

    def message(self, row: dict) -> Iterator[dict]:
        turn = row["turn"]
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        yield from self.insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self._message(edit, turn, self._next(), row["text"])
        elif edit == "K":
            self.state = keeping(self.state, row["role"][:1])
            yield self._message(edit, turn, row["role"], row["text"])

    def summary(self, digest: str) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "illegal": self.illegal, "cost": self.cost, "audit": self.audit, "repaired_sha256": digest}


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MESSAGES = "conv_id long, position long, edit string, turn long, role string, text string"


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (c.split() for c in ddl.split(", "))])


def _walk(inputs: DataFrame, whole: bool) -> DataFrame:
    """Conversations from their sorted stretches and messages: the repaired messages if ``whole``, else a summary of each."""
    ddl = MESSAGES if whole else SUMMARY

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            now, sha, first = None, None, True

            def added(messages: Iterator[dict]) -> Iterator[dict]:
                nonlocal first
                for m in messages:
                    if whole:
                        yield m
                    else:
                        sha.update(("" if first else "\n").encode() + f"{m['role']}:{m['text']}".encode("utf-8", "surrogatepass"))
                        first = False

            for row in _rows(batches):
                if now is None or row["conv_id"] != now.conv_id:
                    if now is not None:
                        yield from added(now.insertions())
                        if not whole:
                            yield now.summary(sha.hexdigest())
                    now, sha, first = Repaired(row["conv_id"]), hashlib.sha256(), True
                if row["kind"] == 1:
                    now.stretch(row)
                elif row["kind"] == 2:
                    yield from added(now.message(row))
            if now is not None:
                yield from added(now.insertions())
                if not whole:
                    yield now.summary(sha.hexdigest())

        yield from _batches(out(), _arrow(ddl))

    return inputs.mapInArrow(walk, ddl)


def _prepared(conversations: DataFrame) -> DataFrame:
    rows = doc_columns(conversations, "conv_id", "turn", "role", "text")
    return rows.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})


def faces(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, copies, letter, again): messages without their text, equal ones of a turn together.

    ``letter`` is the first copy's signature letter, ``again`` that of the others. Messages that other turns hold before are found by
    one pre-aggregated row of each repeated message.
    """
    kind = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("x")
    text = F.rtrim("text", F.lit(BLANKS))
    face = F.when(text == "", "b").when(F.right(text, F.lit(1)).isin(".", "!", "?"), "k").otherwise("t")
    same = stored(rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), kind.alias("who"), face.alias("face")).groupBy("conv_id", "turn", "role", "digest", "who", "face").agg(F.count("*").alias("copies")), "faces")
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    firsts = same.where("face <> 'b'").groupBy("conv_id", "role", "digest").agg(F.count("*").alias("turns"), F.min(order).alias("first")).where("turns > 1")
    firsts = firsts.select(*(F.col(c).alias(f"f_{c}") for c in ("conv_id", "role", "digest")), "first")
    equal = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in ("conv_id", "role", "digest")]
    letter = lambda letters: F.translate("who", SOUND, letters)
    again = F.when(F.col("face") == "b", letter(BLANK)).otherwise(letter(DUPLICATE))
    own = F.when(F.col("face") == "b", letter(BLANK)).when(order > F.col("first"), letter(DUPLICATE)).when(F.col("face") == "t", letter(TRUNCATED)).otherwise(letter(SOUND))
    return same.join(firsts.hint("merge"), equal, "left").select("conv_id", "turn", "role", "digest", "copies", own.alias("letter"), again.alias("again"))


def _inputs(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    blocks = stored(answered(stored(stretches(faces(rows)), "stretches")), "answers")
    nothing = {c: F.lit(None).cast(t) for c, t in (("part", "int"), ("seq", "long"), ("sig", "string"), ("costs", "array<long>"), ("audits", "array<string>"), ("turn", "long"), ("role", "string"), ("digest", "string"), ("text", "string"))}
    columns = ["conv_id", "kind", *nothing]
    parts = [blocks.withColumn("kind", F.lit(1)), rows.withColumns({"kind": F.lit(2), "digest": F.sha2("text", 256)})]
    if ids is not None:
        parts.append(ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("kind", F.lit(0)))
    every = [p.select(*(c if c in p.columns else nothing[c].alias(c) for c in columns)) for p in parts]
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "seq", "turn", "role", "digest")


def repair(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row of each conversation: its faults, the cost and initials of the cheapest edits and the repaired text's SHA-256.

    Reads conv_id, turn, role and text; null roles and texts are one space, other columns aren't read. Messages stand in order of
    turn, null first, and of equal turns in order of role, then of their text's SHA-256. Equal rows are duplicates of one another. A
    null conv_id is a conversation too. Conversations of ``ids`` (conv_id) without messages have zeros, no edits and the hash of
    the empty text; an empty table without ids gives no rows. Memory of a task: a conversation's edits, one letter a message.
    """
    return _walk(_inputs(_prepared(conversations), ids), whole=False)


def repaired_messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, edit, turn, role, text): the messages of the repaired conversations; see ``repair``."""
    return _walk(_inputs(_prepared(conversations), None), whole=True)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults by crc32 of ``conv_id:turn`` (null: one space) modulo 20: 0 drops a row, 1 empties its text, 2 removes
    its sentence ends, 3 repeats it, 4 makes it the user's."""
    rows = _prepared(conversations)
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    key = F.concat(conv, F.lit(":"), turn)
    rows = rows.withColumn("_hit", F.crc32(key.cast("binary")) % 20).where("_hit <> 0")
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_hit") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_copy")).drop("_copy")


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damaged(conversations), conversations.select("conv_id"))
