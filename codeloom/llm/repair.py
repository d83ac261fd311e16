"""Conversation structure repair by generalised LR parsing with weighted edits.

The role grammar is `C -> nothing | s T | T`, `T -> P | T P`, `P -> u a`, over the initials of the
roles. Its SLR table is built here once. A conversation's rows are read in order; before each row,
and at the end, user or assistant may be inserted, and a row is kept, given another role, or
deleted. All of these act on a *graph-structured stack*: nodes are shared (state, node below), and
of the stacks that end in the same state only the one with the smallest (cost, audit) goes on.
That loses nothing: the words that can follow a stack depend on its top state alone, the two edits
that meet have read the same rows, and neither audit is a prefix of the other unless its cost is
smaller, so their order stays the same whatever is appended.

In Spark: faults are columns (duplicates a window), one exchange puts a conversation's rows
into one task in order, and the task reads them as a stream. It never holds a conversation: a stack
keeps its cost, the rank of its audit, the audit's letters and a running SHA-256. A conversation
can't be cut further, because its digest is one SHA-256 over all its texts.

Defined results: null role and text are one space (so the row is blank, or its role illegal); a null
conv_id is a conversation of its own; rows of one turn go by role, then text; an empty role, or one
that starts with another letter than s, u or a, can't be kept; a conversation with no rows has cost 0
and an empty audit. Columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
COST_REROLE, COST_DELETE, COST_INSERT, COST_TRUNCATED = 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}
GRAMMAR = (("C", ""), ("C", "sT"), ("C", "T"), ("T", "P"), ("T", "TP"), ("P", "ua"))
TAIL = 4096

SCHEMA = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string, n_rows long, n_repaired long")


class Node(NamedTuple):
    """The top of a stack: its state and what lies below."""

    state: int
    below: Node | None


class Table:
    """SLR actions of a grammar whose nonterminals are capitals and whose first rule's left side is the start."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.rules = (("", rules[0][0]), *rules)
        heads = {a for a, _ in rules}
        empty, first, follow = set(), {x: set() for x in heads}, {x: set() for x in heads} | {rules[0][0]: {"$"}}
        while True:  # least fixed point of what is empty, what comes first and what follows
            before = (len(empty), sum(map(len, first.values())), sum(map(len, follow.values())))
            for head, body in rules:
                if all(x in empty for x in body):
                    empty.add(head)
                for i, x in enumerate(body):
                    if all(y in empty for y in body[:i]):
                        first[head] |= first.get(x, {x})
                    if x in heads:
                        rest = body[i + 1 :]
                        for j, y in enumerate(rest):
                            if all(z in empty for z in rest[:j]):
                                follow[x] |= first.get(y, {y})
                        if all(z in empty for z in rest):
                            follow[x] |= follow[head]
            if before == (len(empty), sum(map(len, first.values())), sum(map(len, follow.values()))):
                break
        states = [self._closed({(0, 0)})]
        self.goto: list[dict[str, int]] = []
        for items in states:  # grows while it is read
            step: dict[str, set] = {}
            for r, dot in items:
                if dot < len(self.rules[r][1]):
                    step.setdefault(self.rules[r][1][dot], set()).add((r, dot + 1))
            self.goto.append({})
            for x, kernel in sorted(step.items()):
                to = self._closed(kernel)
                if to not in states:
                    states.append(to)
                self.goto[-1][x] = states.index(to)
        self.reduce = [{x: r for r, dot in items if r and dot == len(self.rules[r][1]) for x in follow[self.rules[r][0]]} for items in states]

    def _closed(self, items: set) -> frozenset:
        items, todo = set(items), list(items)
        while todo:
            r, dot = todo.pop()
            for k, (head, _) in enumerate(self.rules):
                if k and dot < len(self.rules[r][1]) and head == self.rules[r][1][dot] and (k, 0) not in items:
                    items.add((k, 0))
                    todo.append((k, 0))
        return frozenset(items)

    def read(self, stack: Node, symbol: str) -> Node | None:
        """The stack after reductions and the shift of a symbol; for "$" what it is reduced to; None where the grammar forbids it."""
        while (r := self.reduce[stack.state].get(symbol)) is not None:
            head, body = self.rules[r]
            for _ in body:
                stack = stack.below
            stack = Node(self.goto[stack.state][head], stack)
        if symbol == "$":
            return stack if stack.state == self.goto[0][self.rules[0][1]] else None
        to = self.goto[stack.state].get(symbol)
        return None if to is None else Node(to, stack)


class Move(NamedTuple):
    cost: int
    letters: str
    roles: str  # of what the move puts out: the inserted ones, then the row's own where it stays
    stack: Node


class Machine:
    """What may happen to a stack before and at a row of a kind; remembered, as there are few stacks and kinds."""

    def __init__(self):
        self.table = Table(GRAMMAR)
        self.start = Node(0, None)
        self.moves: dict[tuple, list[Move]] = {}

    def inserted(self, stack: Node) -> list[Move]:
        best = {stack.state: Move(0, "", "", stack)}
        todo = [best[stack.state]]
        while todo:
            m = todo.pop()
            for x in NAMES:
                to = self.table.read(m.stack, x)
                if to and (to.state not in best or best[to.state].cost > m.cost + COST_INSERT):
                    best[to.state] = Move(m.cost + COST_INSERT, m.letters + "I", m.roles + x, to)
                    todo.append(best[to.state])
        return list(best.values())

    def at_row(self, stack: Node, initial: str, doomed: bool, cut: bool) -> list[Move]:
        key = (stack, initial, doomed, cut)
        if key not in self.moves:
            out = []
            for m in self.inserted(stack):
                out.append(Move(m.cost + COST_DELETE, m.letters + "D", m.roles, m.stack))
                if not doomed:
                    more = COST_TRUNCATED if cut else 0
                    out += [Move(m.cost + more, m.letters + "K", m.roles + "=", to) for to in [initial in ("s", "u", "a") and self.table.read(m.stack, initial)] if to]
                    out += [Move(m.cost + more + COST_REROLE, m.letters + "R", m.roles + x.upper(), to) for x in NAMES if (to := self.table.read(m.stack, x))]
            self.moves[key] = out
        return self.moves[key]

    def at_end(self, stack: Node) -> list[Move]:
        key = (stack, "$")
        if key not in self.moves:
            self.moves[key] = [m for m in self.inserted(stack) if self.table.read(m.stack, "$")]
        return self.moves[key]


class Live(NamedTuple):
    """A stack that is still in the race; its audit is `chain` (a linked list of strings) and `tail`."""

    cost: int
    rank: int
    stack: Node
    chain: tuple | None
    tail: str
    sha: object
    n: int


class Conversation:
    """Reads the rows of one conversation."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.live = [Live(0, 0, machine.start, None, "", hashlib.sha256(), 0)]
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, again: bool, cut: bool) -> None:
        self.rows += 1
        fault = "b" if blank else "d" if again else "t" if cut else ""
        self.blank += fault == "b"
        self.duplicate += fault == "d"
        self.truncated += fault == "t"
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self._step(lambda x: self.machine.at_row(x, initial, fault in ("b", "d") and fault != "", fault == "t"), role, text)

    def _step(self, moves, role: str = "", text: str = "") -> None:
        best: dict[int, tuple] = {}
        for x in self.live:
            for m in moves(x.stack):
                new = (x.cost + m.cost, x.rank, m.letters)
                if m.stack.state not in best or new < best[m.stack.state][0]:
                    best[m.stack.state] = (new, x, m)
        ranks = {v: i for i, v in enumerate(sorted({new[1:] for new, _, _ in best.values()}))}
        self.live = [self._moved(new, ranks[new[1:]], x, m, role, text) for new, x, m in best.values()]

    @staticmethod
    def _moved(new: tuple, rank: int, x: Live, m: Move, role: str, text: str) -> Live:
        chain, tail, sha, n = x.chain, x.tail + m.letters, x.sha, x.n
        if m.roles:
            sha = sha.copy()
            for y in m.roles:
                line = f"{role}:{text}" if y == "=" else f"{NAMES[y]}:" if y in NAMES else f"{NAMES[y.lower()]}:{text}"
                sha.update((("\n" if n else "") + line).encode("utf-8", "surrogatepass"))
                n += 1
        if len(tail) >= TAIL:
            chain, tail = (chain, tail), ""
        return Live(new[0], rank, m.stack, chain, tail, sha, n)

    def result(self, conv_id: int | None) -> tuple:
        self._step(self.machine.at_end)
        won = min(self.live, key=lambda x: (x.cost, x.rank))
        parts, chain = [won.tail], won.chain
        while chain:
            chain, part = chain
            parts.append(part)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, won.cost, "".join(reversed(parts)), won.sha.hexdigest(), self.rows, won.n)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and order, one result for each conversation."""
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in SCHEMA.split(", "))])
    machine, at, done = Machine(), None, []
    for batch in batches:
        rows = [batch.column(name).to_pylist() for name in ("conv_id", "live", "turn", "role", "text", "blank", "again", "cut")]
        for conv_id, live, *row in zip(*rows):
            if at is None or at[0] != conv_id:
                done += [] if at is None else [at[1].result(at[0])]
                at = (conv_id, Conversation(machine))
            if live:
                at[1].add(*row)
        if len(done) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*done), schema)], schema=schema)
            done = []
    done += [] if at is None else [at[1].result(at[0])]
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*done), schema)], schema=schema)


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def faulty(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, live, and the faults blank, again (role and text seen earlier) and cut; rows of one conversation lie in one partition.

    A row that isn't `live` (where `rows` has that column) only keeps its conversation's id.
    """
    own = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), *([F.col("live")] if "live" in rows.columns else [F.lit(True).alias("live")]),
    )
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    seen = Window.partitionBy("conv_id", "live", "role", F.xxhash64("text"), "text").orderBy(F.col("turn").asc_nulls_first())
    return own.repartition("conv_id").withColumns({"again": F.row_number().over(seen) > 1, "blank": last == "", "cut": ~last.isin(".", "!", "?")})


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id: faults, cost and audit of the cheapest edits, and the digest of what they leave."""
    return faulty(rows).sortWithinPartitions("conv_id", *_order()).mapInArrow(_repaired, SCHEMA)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, position (from 1), role, text, action (Keep, Rerole, Insert).

    The audit's letters are laid beside the numbered rows; a letter's role follows from the position and from whether
    the first one that stays is a system row.
    """
    found = repair(rows).select(F.col("conv_id").alias("_conv"), "audit")
    letters = found.select("_conv", F.posexplode(F.split("audit", "")).alias("at", "letter")).filter("letter <> ''")
    by = Window.partitionBy("_conv").orderBy("at")
    letters = letters.withColumn("_n", F.sum((F.col("letter") != "I").cast("long")).over(by)).filter("letter <> 'D'").withColumn("position", F.row_number().over(by).cast("long"))
    numbered = faulty(rows).filter("live").withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy(*_order())).cast("long"))
    numbered = numbered.select(F.col("conv_id").alias("_id"), F.col("_n").alias("_m"), "role", "text")
    kept = letters.join(numbered, F.col("_conv").eqNullSafe(F.col("_id")) & (F.col("_n") == F.col("_m")) & (F.col("letter") != "I"), "left")
    system = F.max(F.when((F.col("position") == 1) & (F.col("letter") == "K") & F.col("role").startswith("s"), 1).otherwise(0)).over(Window.partitionBy("_conv"))
    due = F.when((F.col("position") + F.col("system")) % 2 == 1, "user").otherwise("assistant")
    return kept.withColumn("system", system).select(
        F.col("_conv").alias("conv_id"), "position", F.when(F.col("letter") == "K", F.col("role")).otherwise(due).alias("role"),
        F.when(F.col("letter") == "I", "").otherwise(F.col("text")).alias("text"),
        F.element_at(F.create_map(*[F.lit(x) for kv in {"K": "Keep", "R": "Rerole", "I": "Insert"}.items() for x in kv]), F.col("letter")).alias("action"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Damages rows by crc32 of `conv_id:turn`: 0 of 20 drops a row (it stays as one that isn't live), 1 empties its text, 2 takes its marks, 3 repeats it, 4 makes it the user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.withColumn("_kind", kind).select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (F.col("_kind") != 0).alias("live"), F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def repair_digest(conversations: DataFrame) -> DataFrame:
    """The query's columns over damaged conversations."""
    return repair(damaged(conversations)).drop("n_rows", "n_repaired")
