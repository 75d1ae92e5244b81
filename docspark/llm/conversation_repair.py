"""Conversation structure repair by a dynamic programme that shares prefixes.

Each row of a conversation becomes one letter, of its role and its fault; a conversation is its letters in order of turn.
Rows are sorted over ranges of (conversation, turn), so that a long conversation is spread over tasks, and every task cuts
what it has of a conversation into pieces of at most PIECE letters. Distinct pieces are sorted and walked as a prefix
trie, of which the current path alone is in memory: a layer of the programme is worked out once for each node, that is
for each distinct prefix, and answers are given where a piece ends. A piece that doesn't begin a conversation is solved
for every state it may be entered in, so pieces are put together by a short fold. The repaired rows themselves stream past
their conversation's edits, sorted, in the one task that a hash of a whole conversation needs; memory is a letter a row.

A layer keeps for each of four states (nothing yet, system, user, assistant) the cheapest edits' cost and, since edits
that end with a row's letter are never prefixes of one another, just their rank among the layer's for ties.

Defined cases: null roles and texts, and null ids and turns within the damage's key, are one space. Rows without a
conversation id are one conversation; rows without a turn come first, and rows of one turn by the SHA-256 of role and text,
so equal ones are adjacent. Repeated rows are duplicates. Texts of any length are read whole; a role's initial is its
first character, and one that is neither s, u nor a, as an empty one, can't be kept. Conversations of any length are
repaired. An empty table gives no rows. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import SPACE_CHARS, give_back, sent_whole, stash, with_workers

#: Letters of a piece at most.
PIECE = 1024
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a state needs next if it isn't a system row, and where that leads.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
OWN = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Inserts that end a conversation from each state.
FINISH = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5


def _ways(letter: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits) of all that can be done about a row, up to two inserts before it."""
    out = []
    for begin in range(4):
        state = begin
        for n in range(3):
            lead, cost = "I" * n, INSERT * n
            out.append((begin, state, cost + DELETE, lead + "D"))
            if letter != "x":
                late = TRUNCATED if letter.isupper() else 0
                out.append((begin, NEXT[state], cost + REROLE + late, lead + "R"))
                if state in OWN.get(letter.lower(), {}):
                    out.append((begin, OWN[letter.lower()][state], cost + late, lead + "K"))
            state = NEXT[state]
    return out


#: By letter: x has to go; s, u, a and o (another role) may stay, and cost more as capitals.
WAYS = {letter: _ways(letter) for letter in "xsuaoSUAO"}


def step(layer: dict[int, tuple], letter: str) -> dict[int, tuple]:
    """{state: (cost, rank, state before, edits)} after one more row."""
    best: dict[int, tuple] = {}
    for begin, end, cost, edits in WAYS[letter]:
        if begin in layer:
            way = (layer[begin][0] + cost, layer[begin][1], edits, begin)
            if end not in best or way < best[end]:
                best[end] = way
    order = sorted(best, key=lambda s: best[s][1:3])
    return {s: (best[s][0], order.index(s), best[s][3], best[s][2]) for s in best}


class Trie:
    """The current path of a trie over signatures that come in order: layers by depth, one for each state of entry."""

    def __init__(self) -> None:
        self.path, self.layers = "", []

    def walk(self, signature: str) -> Iterator[dict]:
        """The answers of one signature. It begins with ^ where a conversation does, else with -."""
        shared = 0
        while shared < min(len(self.path), len(signature)) and self.path[shared] == signature[shared]:
            shared += 1
        del self.layers[shared:]
        for letter in signature[shared:]:
            if not self.layers:
                self.layers.append([{s: (0, 0, s, "")} for s in ((START,) if letter == "^" else range(4))])
            else:
                self.layers.append([step(layer, letter) for layer in self.layers[-1]])
        self.path = signature
        for entry, last in enumerate(self.layers[-1]):
            for state, (cost, rank, _, _) in last.items():
                edits, at = [], state
                for layers in reversed(self.layers[1:]):
                    edits.append(layers[entry][at][3])
                    at = layers[entry][at][2]
                yield {"entry": entry, "exit": state, "cost": cost, "rank": rank, "edits": "".join(reversed(edits))}


def joined(pieces: list[list[dict]]) -> tuple[int, str]:
    """(cost, edits) of a conversation from its pieces' answers."""
    layer, back = {START: (0, 0)}, []
    for answers in pieces:
        best: dict[int, tuple] = {}
        for a in answers:
            if a["entry"] in layer:
                way = (layer[a["entry"]][0] + a["cost"], layer[a["entry"]][1], a["rank"], a["entry"], a["edits"])
                if a["exit"] not in best or way < best[a["exit"]]:
                    best[a["exit"]] = way
        order = sorted(best, key=lambda s: best[s][1:3])
        layer = {s: (best[s][0], order.index(s)) for s in best}
        back.append(best)
    cost, _, state = min((cost + INSERT * FINISH[s], rank, s) for s, (cost, rank) in layer.items())
    edits = ["I" * FINISH[state]]
    for best in reversed(back):
        edits.append(best[state][4])
        state = best[state][3]
    return cost, "".join(reversed(edits))


# ---------------------------------------------------------------- plan


def damage(rows: DataFrame) -> DataFrame:
    """(id, turn, role, text, present) of conversations, damaged by crc32(conv_id:turn) % 20: 0 drops a row (present is
    false), 1 empties its text, 2 takes its points, 3 repeats it, 4 makes it the user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(what == 1, "").when(what == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(what == 4, "user").otherwise(said("role"))
    # A dropped row stands for its conversation alone.
    held = lambda c: F.when(what != 0, c)
    times = F.explode(F.array_repeat(F.lit(1), F.when(what == 3, 2).otherwise(1)))
    return rows.select(F.col("conv_id").cast("bigint").alias("id"), held(F.col("turn").cast("bigint")).alias("turn"), held(role).alias("role"), held(text).alias("text"), (what != 0).alias("present"), times.alias("times")).drop("times")


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))


def _letters(rows: DataFrame, most_broadcast: int) -> DataFrame:
    """(id, turn, key, initial, letter, again, present): again counts further copies; letter is b for a blank row, d for one seen earlier."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE_CHARS))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), kind).otherwise(F.upper(kind))
    each = rows.select("id", "turn", "present", F.when(F.col("present"), _digest()).alias("key"), initial.alias("initial"), F.when(F.col("present"), letter).alias("letter"))
    counted = stash(each.groupBy("id", "turn", "present", "key", "initial", "letter").agg(F.count("*").alias("n")), "turns")
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    seen = counted.filter("present").groupBy("id", "key").agg(F.min(order).alias("first"), F.sum("n").alias("copies")).filter("copies > 1")
    seen = sent_whole(stash(seen.select(F.col("id").alias("seen_id"), F.col("key").alias("seen_key"), "first"), "repeated"), most_broadcast)
    marked = counted.join(seen, counted["id"].eqNullSafe(seen["seen_id"]) & (counted["key"] == seen["seen_key"]), "left")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return marked.select("id", "turn", "key", "initial", F.when((F.col("letter") != "b") & later, "d").otherwise(F.col("letter")).alias("letter"), (F.col("n") - 1).alias("again"), "present")


PIECES = "id bigint, place bigint, signature string, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string, first_turn bigint, last_turn bigint, turns bigint"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to pieces of at most PIECE letters, with what can be counted of each."""
    names, done, at = [f.split()[0] for f in PIECES.split(", ")], [], TaskContext.get().partitionId() << 40
    own: dict | None = None

    def end() -> None:
        nonlocal own, at
        if own is not None:
            done.append(own | {"signature": "".join(own["signature"]), "place": at})
            at += 1
        own = None

    for batch in batches:
        for i, turn, initial, letter, again, present in zip(*(batch.column(c).to_pylist() for c in ("id", "turn", "initial", "letter", "again", "present")), strict=True):
            if own is not None and own["id"] != i:
                end()
            if not present:
                own = own or {"id": i, "signature": [], **dict.fromkeys(names[3:8], 0), **dict.fromkeys(names[8:12]), "turns": 0}
                continue
            for k in range(again + 1):
                if own is not None and own["n"] == PIECE:
                    end()
                own = own or {"id": i, "signature": [], **dict.fromkeys(names[3:8], 0), **dict.fromkeys(names[8:12]), "turns": 0}
                mark = letter if letter == "b" or not k else "d"
                own["signature"].append("x" if mark in "bd" else mark)
                own["blank"] += mark == "b"
                own["duplicate"] += mark == "d"
                own["truncated"] += mark.isupper()
                if own["n"]:
                    own["illegal"] += (own["last_initial"], initial) not in LEGAL
                else:
                    own["first_initial"] = initial
                own["last_initial"] = initial
                own["n"] += 1
                if turn is not None and turn != own["last_turn"]:
                    own["turns"] += 1
                    own["last_turn"] = turn
                    own["first_turn"] = turn if own["first_turn"] is None else own["first_turn"]
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist(done, PIECES_ARROW)
            done = []
    end()
    if done:
        yield pa.RecordBatch.from_pylist(done, PIECES_ARROW)


PIECES_ARROW = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in PIECES.split(", ")])
ANSWERS = "signature string, answers array<struct<entry: int, exit: int, cost: bigint, rank: int, edits: string>>"
ANSWERS_ARROW = pa.schema([("signature", pa.string()), ("answers", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("edits", pa.string())])))])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            found = [{"signature": s, "answers": list(trie.walk(s))} for s in batch.column(0).slice(at, 200).to_pylist()]
            yield pa.RecordBatch.from_pylist(found, ANSWERS_ARROW)


REPORT = "id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
REPORT_ARROW = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in REPORT.split(", ")])


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations' pieces to one row each."""
    for batch in batches:
        out = []
        for i, pieces in zip(batch.column("id").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
            cost, audit = joined([p["answers"] for p in pieces])
            row = {"id": i, "cost": cost, "audit": audit, **{c: sum(p[c] for p in pieces) for c in ("blank", "duplicate", "truncated", "illegal")}}
            turned = [p for p in pieces if p["turns"]]
            turns = sum(p["turns"] for p in turned) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(turned, turned[1:], strict=False))
            row["gaps"] = turned[-1]["last_turn"] - turned[0]["first_turn"] + 1 - turns if turned else 0
            spoken = [p for p in pieces if p["n"]]
            row["illegal"] += sum((a["last_initial"], b["first_initial"]) not in LEGAL for a, b in zip(spoken, spoken[1:], strict=False))
            out.append(row)
        yield pa.RecordBatch.from_pylist(out, REPORT_ARROW)


def report(rows: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit) for each conversation of (id, turn, role, text, present)."""
    with_workers(rows.sparkSession)
    keys = ["id", "turn", "key"]
    ordered = _letters(rows, most_broadcast).repartitionByRange(*keys).sortWithinPartitions(*keys)
    pieces = stash(ordered.mapInArrow(_pieces, PIECES), "pieces")
    begins = pieces.groupBy("id").agg(F.min("place").alias("begin"))  # a row for each task that has some of a conversation meets here
    begins = begins.select(F.col("id").alias("begin_id"), "begin")
    marked = pieces.join(begins, pieces["id"].eqNullSafe(begins["begin_id"])).drop("begin_id")
    marked = marked.withColumn("signature", F.concat(F.when(F.col("place") == F.col("begin"), "^").otherwise("-"), "signature"))
    distinct = marked.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    answers = stash(distinct.mapInArrow(_solved, ANSWERS), "answers")
    known = sent_whole(answers, 64 << 20, "sum(aggregate(answers, 0L, (n, a) -> n + 40 + length(a.edits)))")
    parts = [f.split()[0] for f in PIECES.split(", ")][3:]
    whole = marked.join(known, "signature").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "answers", *parts))).alias("pieces"))
    return whole.mapInArrow(_reported, REPORT)


def _streamed(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Each conversation's report, then its rows in order, all in one task and one after another."""
    own = [f.split()[0] for f in REPORT.split(", ")]
    told = reports.select(*own, F.lit(0).alias("kind"))
    said = rows.filter("present").select("id", F.lit(1).alias("kind"), "turn", "role", "text", _digest().alias("key"))
    every = told.unionByName(said, allowMissingColumns=True)
    return every.repartition("id").sortWithinPartitions("id", "kind", "turn", "key").drop("key")


class Editor:
    """One conversation's edits, as its rows pass."""

    NAMES = {USER: "user", ASSISTANT: "assistant"}

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield self.NAMES[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = OWN[role[0]][self.state]
            yield role, text
        elif edit == "R":
            self.state = NEXT[self.state]
            yield self.NAMES[self.state], text


def _edited(batches: Iterator[pa.RecordBatch], begin, put, end, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Runs edits over the stream. begin(report) is a conversation's state, put(state, role, text) takes a repaired row, and
    end(state) closes it; the rows that put and end give are the result."""
    editor = state = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if editor is not None:
                    for x in editor.inserted():
                        out += put(state, *x)
                    out += end(state)
                editor, state = Editor(row["audit"]), begin(row)
            else:
                for x in editor.row(row["role"], row["text"]):
                    out += put(state, *x)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if editor is not None:
        last = [r for x in editor.inserted() for r in put(state, *x)] + end(state)
        if last:
            yield pa.RecordBatch.from_pylist(last, schema)
    give_back()


def repaired(rows: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """(id, place, role, text): the repaired conversations' rows, places from 0."""
    schema = pa.schema([("id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def begin(r: dict) -> dict:
        return {"id": r["id"], "place": -1}

    def put(state: dict, role: str, text: str) -> list[dict]:
        state["place"] += 1
        return [state | {"role": role, "text": text}]

    stream = _streamed(rows, report(rows) if reports is None else reports)
    return stream.mapInArrow(lambda batches: _edited(batches, begin, put, lambda state: [], schema), "id bigint, place bigint, role string, text string")


def digests(rows: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """The reports, and the SHA-256 of each repaired conversation: `role:text`, joined by new lines."""
    schema = pa.schema([*REPORT_ARROW, ("repaired_sha256", pa.string())])

    def begin(r: dict) -> dict:
        return {"report": {c: r[c] for c in REPORT_ARROW.names}, "hash": hashlib.sha256(), "gap": ""}

    def put(state: dict, role: str, text: str) -> list[dict]:
        state["hash"].update(f"{state['gap']}{role}:{text}".encode())
        state["gap"] = "\n"
        return []

    def end(state: dict) -> list[dict]:
        return [state["report"] | {"repaired_sha256": state["hash"].hexdigest()}]

    stream = _streamed(rows, report(rows) if reports is None else reports)
    return stream.mapInArrow(lambda batches: _edited(batches, begin, put, end, schema), f"{REPORT}, repaired_sha256 string")
