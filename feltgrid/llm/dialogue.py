"""Cheapest repair of conversations whose turns are damaged, over an automaton of shared suffixes.

A conversation is reduced to a signature, one symbol a row: its role's initial and whether the row is sound,
truncated or has to go. What a suffix of a signature costs depends on that suffix alone, so distinct signatures,
sorted from their ends, form an acyclic automaton whose nodes are the distinct suffixes: neighbours in that
order share the nodes of their common end. A task walks its range in order and keeps the nodes of one signature, so
each node's cost-to-go and first edit are computed once for each grammar state, for all conversations that
end this way. The grammar of roles is ``(s?(ua)+)?``: an optional system turn, then user and assistant in turn.

From a node and a state each edit leads to one node and state, so among cheapest repairs the least in
letters takes the least letter at each step, and a node keeps a letter instead of a text.

Texts are shuffled once, when the repair is known; rows stream through a task in order and nothing larger than a signature
is held. SHA-256 of a conversation is sequential by definition, so its rows meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feltgrid.llm.frames import column
from feltgrid.operators.stage import stage

#: White space of rows that count as blank.
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
FAR = 1 << 40

#: States of the role grammar: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: A user or assistant turn in each state, and where it leads.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
ACCEPTED = (START, ASSISTANT)
GONE = "x"  # symbol of blank and repeated rows, whatever their role


def kept_state(symbol: str, state: int) -> int | None:
    """Where a row that stays as it is leads, None if the grammar has no place for it."""
    role = symbol.lower()
    if role == "s":
        return SYSTEM if state == START else None
    if role in ("u", "a"):
        after = NEXT[state]
        return after if ROLE[after][0] == role else None
    return None


Node = tuple[tuple[int, ...], str]  # cost-to-go and first edit of each state; a blank where nothing is left to do


def with_insertions(costs: list[int], edits: list[str]) -> Node:
    """The best of each state when turns may be inserted first."""
    new, first = list(costs), list(edits)
    for state in (USER, ASSISTANT, START, SYSTEM):
        # A second insertion after a user or assistant turn would lead back to the same state.
        after = costs[NEXT[state]] if state in (USER, ASSISTANT) else new[NEXT[state]]
        options = sorted([(costs[state], edits[state]), (after + INSERT_COST, INSERT)])
        new[state], first[state] = options[0]
    return tuple(new), "".join(first)


def last_node() -> Node:
    return with_insertions([0 if s in ACCEPTED else FAR for s in range(4)], [" "] * 4)


def node_before(symbol: str, after: Node) -> Node:
    """The node of ``symbol`` followed by the suffix of ``after``."""
    costs, edits = [], []
    extra = TRUNCATED_COST if symbol.isupper() else 0
    for state in range(4):
        options = [(after[0][state] + DELETE_COST, DELETE)]
        if symbol != GONE:
            kept = kept_state(symbol, state)
            if kept is not None:
                options.append((after[0][kept] + extra, KEEP))
            options.append((after[0][NEXT[state]] + REROLE_COST + extra, REROLE))
        cost, edit = min(options)
        costs.append(cost)
        edits.append(edit)
    return with_insertions(costs, edits)


class SuffixAutomaton:
    """Nodes of the suffixes of the signature at hand; the next one reuses those of the common end."""

    def __init__(self):
        self.symbols: list[str] = []  # from the end
        self.nodes: list[Node] = [last_node()]
        self.made = 1

    def repair(self, signature: str) -> tuple[int, str]:
        """Cost and letters of the cheapest repair."""
        turned, shared = signature[::-1], 0
        for a, b in zip(turned, self.symbols):
            if a != b:
                break
            shared += 1
        del self.symbols[shared:], self.nodes[shared + 1 :]
        for symbol in turned[shared:]:
            self.symbols.append(symbol)
            self.nodes.append(node_before(symbol, self.nodes[-1]))
        self.made += len(turned) - shared
        letters, state, at = [], START, len(turned)
        while at or state not in ACCEPTED:
            edit = self.nodes[at][1][state]
            letters.append(edit)
            if edit == INSERT:
                state = NEXT[state]
                continue
            if edit == KEEP:
                state = kept_state(self.symbols[at - 1], state)
            elif edit == REROLE:
                state = NEXT[state]
            at -= 1
        return self.nodes[-1][0][START], "".join(letters)


# --- Rows -----------------------------------------------------------------------------------


def read_rows(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The four columns, null roles and texts as one blank."""
    blank = F.lit(" ")
    return conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text")
    )


def damage(rows: DataFrame) -> DataFrame:
    """Rows of ``read_rows`` with faults that depend on conversation and turn alone."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    hit = (F.crc32(key.cast("binary")) % 20).cast("int")
    damaged = rows.withColumn("_hit", hit).filter("_hit <> 0").select(
        "conv_id", "turn",
        F.when(F.col("_hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(0), F.when(F.col("_hit") == 3, 1).otherwise(0))).alias("_copy"),
    )
    return damaged.drop("_copy")


def content_digest() -> Column:
    """Tells rows apart by role and text, and orders the rows of one turn."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _in_order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("digest")]


def signatures(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature) for each id of ``ids``; no text is shuffled.

    Repeats are found by sorting a conversation's digests, so a conversation of any size needs no set of them.
    """
    stripped = F.btrim("text", F.lit(BLANKS))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    facts = rows.select(
        "conv_id", "turn", initial.alias("initial"), content_digest().alias("digest"), (stripped == "").alias("blank"),
        (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("cut"), F.lit(True).alias("row"),
    )
    none = ids.select("conv_id").distinct().select("conv_id", *(F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in facts.columns[1:-1]), F.lit(False).alias("row"))
    both = facts.unionByName(none).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "row", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    dealt = both.withColumn("again", again).sortWithinPartitions("conv_id", "row", *_in_order(), "again")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, one, id_type = None, None, None
        for batch in batches:
            id_type, out = batch.schema.field("conv_id").type, []
            for key, turn, initial, blank, cut, again, row in zip(*(column(batch, c) for c in ("conv_id", "turn", "initial", "blank", "cut", "again", "row"))):
                if one is None or key != current:
                    if one is not None:
                        out.append((current, *one.summary()))
                    current, one = key, Signature()
                if row:
                    one.add(turn, initial, blank, again, cut)
            if out:
                yield listed(out, id_type)
        if one is not None:
            yield listed([(current, *one.summary())], id_type)

    def listed(out: list, id_type: pa.DataType) -> pa.RecordBatch:
        key, *counts, signature = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(key, id_type), *(pa.array(c, pa.int64()) for c in counts), pa.array(signature, pa.string())], ["conv_id", *COUNTS, "signature"]
        )

    return dealt.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", signature string")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


class Signature:
    """What one conversation's rows, in order, add up to."""

    def __init__(self):
        self.first = self.last = self.role = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.symbols: list[str] = []

    def add(self, turn: int | None, initial: str, blank: bool, again: bool, cut: bool) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if self.role is not None and self.role + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.role = initial
        if blank:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif cut:
            self.truncated += 1
        self.symbols.append(GONE if blank or again else initial.upper() if cut else initial)

    def summary(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, "".join(self.symbols)


def repairs(signed: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each distinct signature, ranges of them sorted from their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton()
        for batch in batches:
            found = column(batch, "signature")
            cost, audit = zip(*map(automaton.repair, found)) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("signature")), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], ["signature", "cost", "audit"]
            )

    turned = F.reverse("signature")
    ordered = signed.select("signature").distinct().repartitionByRange(turned).sortWithinPartitions(turned)
    return ordered.mapInArrow(run, "signature string, cost long, audit string")


def _edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns of one conversation, whose rows come in order."""
    state = START
    for edit in audit:
        role, text = ("", "") if edit == INSERT else next(rows)
        if edit == DELETE:
            continue
        if edit == KEEP:
            state = kept_state(role[:1], state)
        else:
            state = NEXT[state]
            role = ROLE[state]
        yield edit, role, text


def _conversations(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
    """The summary row of each conversation and an iterator of the (role, text) of its rows, which must be used up before the next."""
    stream = (row for batch in batches for row in zip(*(column(batch, c) for c in ["_kind", "role", "text", *names])))
    head = next(stream, None)
    while head is not None:
        later = None

        def rows() -> Iterator[tuple[str, str]]:
            nonlocal later
            for row in stream:
                if row[0] == 0:
                    later = row
                    return
                yield row[1], row[2]

        own = rows()
        yield head[3:], own
        for _ in own:
            pass
        head = later


class Repair:
    """Plans of the repair of ``rows`` (columns of ``read_rows``); ``ids`` adds conversations that have lost all rows."""

    def __init__(self, rows: DataFrame, ids: DataFrame | None = None):
        self.rows = rows
        self.kind = rows.schema["conv_id"].dataType.simpleString()
        signed = stage(signatures(rows, rows if ids is None else ids))
        #: conv_id, the counts, cost and audit.
        self.summary = stage(signed.join(repairs(signed), "signature").select("conv_id", *COUNTS, "cost", "audit"))

    def _stream(self) -> DataFrame:
        """Each conversation's summary, then its rows in order."""
        kinds = {"turn": "turn", "role": "role", "text": "text"}
        missing = {c: F.lit(None).cast(self.rows.schema[k].dataType) for c, k in kinds.items()}
        heads = self.summary.withColumns({"_kind": F.lit(0), **missing, "digest": F.lit(None).cast("binary")})
        lines = self.rows.withColumns({"_kind": F.lit(1), "digest": content_digest(), **{c: F.lit(None).cast(self.summary.schema[c].dataType) for c in [*COUNTS, "cost", "audit"]}})
        return heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "_kind", *_in_order())

    def digests(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
        names = ["conv_id", *COUNTS, "cost", "audit"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = next(batches, None)
            if first is None:
                return
            id_type = first.schema.field("conv_id").type

            def whole() -> Iterator[pa.RecordBatch]:
                yield first
                yield from batches

            out = []
            for head, rows in _conversations(whole(), names):
                digest = hashlib.sha256()
                for i, (_, role, text) in enumerate(_edited(head[-1], rows)):
                    digest.update(("\n" if i else "").encode() + f"{role}:{text}".encode("utf-8", "replace"))
                out.append((*head, digest.hexdigest()))
                if len(out) == 4096:
                    yield listed(out, id_type)
                    out = []
            if out:
                yield listed(out, id_type)

        def listed(out: list, id_type: pa.DataType) -> pa.RecordBatch:
            types = [id_type, *[pa.int64()] * (len(COUNTS) + 1), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], [*names, "repaired_sha256"])

        schema = f"conv_id {self.kind}, " + ", ".join(f"{c} long" for c in [*COUNTS, "cost"]) + ", audit string, repaired_sha256 string"
        return self._stream().mapInArrow(run, schema)

    def turns(self) -> DataFrame:
        """(conv_id, place, edit, role, text): the repaired conversations, inserted turns with empty text."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = next(batches, None)
            if first is None:
                return
            id_type = first.schema.field("conv_id").type

            def whole() -> Iterator[pa.RecordBatch]:
                yield first
                yield from batches

            out, size = [], 0
            for (key, audit), rows in _conversations(whole(), ["conv_id", "audit"]):
                for place, (edit, role, text) in enumerate(_edited(audit, rows)):
                    out.append((key, place, edit, role, text))
                    size += len(text) + 64
                    if size > 4 << 20:
                        yield listed(out, id_type)
                        out, size = [], 0
            if out:
                yield listed(out, id_type)

        def listed(out: list, id_type: pa.DataType) -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], ["conv_id", "place", "edit", "role", "text"])

        return self._stream().mapInArrow(run, f"conv_id {self.kind}, place long, edit string, role string, text string")


def repair_conversations(conversations: DataFrame, ids: DataFrame | None = None, **columns: str) -> Repair:
    """The cheapest repair of each conversation; see ``Repair`` for its results.

    Nulls in role and text count as one blank, so such rows are blank or have no legal role. A null conversation id
    is one conversation; null turns come first; rows of one turn are ordered by the SHA-256 of role and text. Repeated rows are
    duplicates but for the first. Other columns are not read. An empty table gives no rows.
    """
    return Repair(read_rows(conversations, **columns), ids)
