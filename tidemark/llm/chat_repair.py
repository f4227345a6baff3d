"""Conversation structure repair: the cheapest edits that make a conversation alternate, by Knuth's lightest-derivation agenda."""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.registry import query

BLANK = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)                  # what came last, in a prefix of  s?(ua)+
COMPLETE = frozenset({START, ASSISTANT})
KEEP = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
TURN = {START: (USER, "user"), SYSTEM: (USER, "user"), ASSISTANT: (USER, "user"), USER: (ASSISTANT, "assistant")}
LEGAL = frozenset({"su", "ua", "au"})
DELETE, REROLE, INSERT, LEFT_TRUNCATED = 4, 3, 3, 3        # costs
FAN = 16                                                   # spans that one agenda joins
OUT = 1 << 22                                              # characters that leave a task at once

Arcs = tuple[tuple[tuple[int, int, str], ...], ...]        # by the state before: (state after, cost, edits)
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


@functools.lru_cache(64)
def row_arcs(symbol: str) -> Arcs:
    """A row's edits. Symbols: an initial (``x``: one the pattern has not), in capitals if truncated; ``-`` has to go."""
    out = []
    for p in range(4):
        edits = [(p, DELETE, "D")]
        if symbol != "-":
            left = LEFT_TRUNCATED if symbol.isupper() else 0
            edits.append((TURN[p][0], REROLE + left, "R"))
            if (symbol.lower(), p) in KEEP:
                edits.append((KEEP[symbol.lower(), p], left, "K"))
        out.append(tuple(edits))
    return tuple(out)


def lightest(spans: Sequence[Arcs], entry: int, goals: frozenset[int] | None = None) -> dict[int, tuple[int, str]]:
    """The lightest derivations from state ``entry`` before the first span to states after the last: state -> (cost, edits).

    Item (i, p) says that the spans before i can be repaired so that state p follows. Deductions: item (i, p) and an edit
    of span i that leads from p to q give item (i + 1, q); item (i, p) and an insertion give item (i, q). A deduction's
    value, (sum of costs, edits one after the other), grows with each of its antecedents and is never below them:
    a superior function, so the least item of the agenda is final when it is popped. Items of one place with equal costs
    have edits of which none begins another (that would take insertions, which cost), so the order of two values stays
    what it is when both are continued. With ``goals``, the first of these states to be final at the end is the answer.
    """
    final, found = set(), {}
    agenda = [(0, "", 0, entry)]
    while agenda:
        cost, edits, i, p = heapq.heappop(agenda)
        if (i, p) in final:
            continue
        final.add((i, p))
        if i == len(spans):
            found[p] = (cost, edits)
            if goals is not None and p in goals:
                return {p: found[p]}
        else:
            for q, c, e in spans[i][p]:
                if (i + 1, q) not in final:
                    heapq.heappush(agenda, (cost + c, edits + e, i + 1, q))
        heapq.heappush(agenda, (cost + INSERT, edits + "I", i, TURN[p][0]))
    return found


def joined(spans: Sequence[Arcs]) -> Arcs:
    """One span for several that follow each other."""
    return tuple(tuple((q, c, e) for q, (c, e) in sorted(lightest(spans, p).items())) for p in range(4))


@functools.lru_cache(1 << 12)
def _chunk(symbols: str) -> Arcs:
    return joined([row_arcs(s) for s in symbols])


def span_of(symbols: str) -> Arcs:
    """The lightest repairs of a run of rows from every state to every state; a tree of agendas over ``FAN`` spans each."""
    level = [_chunk(symbols[i:i + FAN]) for i in range(0, len(symbols), FAN)] or [joined([])]
    while len(level) > 1:
        level = [joined(level[i:i + FAN]) if i + 1 < len(level) else level[i] for i in range(0, len(level), FAN)]
    return level[0]


@functools.lru_cache(1 << 14)
def _short_repair(symbols: str) -> tuple[int, str]:
    return next(iter(lightest([row_arcs(s) for s in symbols], START, COMPLETE).values()))


def repair(symbols: str) -> tuple[int, str]:
    """(cost, edits) of the cheapest repair of a whole conversation, the ASCII-least edits among equals."""
    if len(symbols) <= 4 * FAN:
        return _short_repair(symbols)
    return next(iter(lightest([span_of(symbols)], START, COMPLETE).values()))


def conversation_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text alone; a null role or text is one space."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """:func:`conversation_rows` after the damage that crc32(``conv_id:turn``) % 20 says (a null number is one space there):
    0 drops a row, 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it, 4 makes its role user."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return (rows.withColumn("_d", F.crc32(F.concat(number("conv_id"), F.lit(":"), number("turn"))) % 20).where("_d <> 0")
            .withColumns({"text": F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
                          "role": F.when(F.col("_d") == 4, "user").otherwise(F.col("role")),
                          "_copy": F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))})
            .select("conv_id", "turn", "role", "text"))


def with_symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, tie, initial, fault) per row, texts as their SHA-256; ``fault`` is the first of blank,
    duplicate, truncated, or empty.

    A duplicate follows a row of its conversation with the same role and text. First rows are found by a minimum per
    (conversation, role, text), reduced inside tasks; only those held more than once are joined back.
    """
    trimmed = F.rtrim("text", F.lit(BLANK))
    fault = F.when(trimmed == "", "blank").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    light = stored(rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), F.monotonically_increasing_id().alias("tie"),
                               F.substring("role", 1, 1).alias("initial"), fault.alias("fault")), "rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), F.col("tie").alias("tie"))
    held = (light.where("fault <> 'blank'").groupBy("conv_id", "role", "digest")
            .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
            .select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first"))
    again = light.join(held, light["conv_id"].eqNullSafe(F.col("_c")) & (light["role"] == F.col("_r")) & (light["digest"] == F.col("_d")), "left")
    return again.select("conv_id", "turn", "role", "digest", "tie", "initial",
                        F.when((F.col("fault") != "blank") & (place > F.col("first")), "duplicate").otherwise(F.col("fault")).alias("fault"))


class _Piece:
    """Rows of one conversation that one task has seen, in order."""

    def __init__(self, conv_id, whole: bool):
        self.conv_id, self.whole = conv_id, whole
        self.symbols, self.counts = [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.turns = 0, 0
        self.initials, self.turn_ends = ["", ""], [None, None]

    def add(self, turn, initial: str, fault: str) -> None:
        if fault:
            self.counts[fault] += 1
        if self.symbols:
            self.illegal += self.initials[1] + initial not in LEGAL
        else:
            self.initials[0] = initial
        self.initials[1] = initial
        if turn is not None and turn != self.turn_ends[1]:
            self.turns += 1
            self.turn_ends = [turn if self.turn_ends[0] is None else self.turn_ends[0], turn]
        symbol = initial if initial in ("s", "u", "a") else "x"
        self.symbols.append("-" if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol)

    def row(self, number: int, whole: bool) -> dict:
        symbols = "".join(self.symbols)
        if whole:
            cost, audit = repair(symbols)
            arcs = [{"before": START, "after": ASSISTANT, "cost": cost, "edits": audit}]
        else:
            arcs = [{"before": p, "after": q, "cost": c, "edits": e} for p, a in enumerate(span_of(symbols)) for q, c, e in a]
        return {"conv_id": self.conv_id, "piece": number, **self.counts, "illegal": self.illegal, "turns": self.turns,
                "first_initial": self.initials[0], "last_initial": self.initials[1], "first_turn": self.turn_ends[0], "last_turn": self.turn_ends[1],
                "whole": whole, "arcs": arcs}


ARC = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
PIECE = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
                   ("illegal", pa.int64()), ("turns", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string()),
                   ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("whole", pa.bool_()), ("arcs", pa.list_(ARC))])
PIECE_SQL = ("conv_id long, piece long, blank long, duplicate long, truncated long, illegal long, turns long, first_initial string, "
             "last_initial string, first_turn long, last_turn long, whole boolean, "
             "arcs array<struct<before:int,after:int,cost:long,edits:string>>")


def _pieces(batches):
    """A conversation that starts and ends inside the task is repaired; of one that may go on in another, all spans are given."""
    from pyspark import TaskContext
    number = TaskContext.get().partitionId()
    piece, done = None, []
    for batch in batches:
        for conv_id, turn, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault"))):
            if piece is None or conv_id != piece.conv_id:
                if piece is not None:
                    done.append(piece.row(number, piece.whole))
                piece = _Piece(conv_id, piece is not None)
            piece.add(turn, initial, fault)
        if len(done) > 5000:
            yield pa.RecordBatch.from_pylist(done, schema=PIECE)
            done = []
    if piece is not None:
        done.append(piece.row(number, False))
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=PIECE)


def _summaries(batches):
    """Pieces of a conversation put together."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    for batch in batches:
        rows = []
        for conv_id, pieces in zip(batch.column("conv_id").to_pylist(), batch.column("pieces")):
            pieces = pieces.as_py()
            turns, illegal, last, spans = 0, 0, None, []
            for k, p in enumerate(pieces):
                turns += p["turns"] - (p["turns"] > 0 and p["first_turn"] == last)
                last = p["last_turn"] if p["turns"] else last
                illegal += p["illegal"] + (k > 0 and pieces[k - 1]["last_initial"] + p["first_initial"] not in LEGAL)
                spans.append(tuple(tuple((a["after"], a["cost"], a["edits"]) for a in p["arcs"] if a["before"] == s) for s in range(4)))
            first = next((p["first_turn"] for p in pieces if p["turns"]), None)
            if pieces[0]["whole"]:
                cost, audit = spans[0][START][0][1:]
            else:
                while len(spans) > FAN:
                    spans = [joined(spans[i:i + FAN]) for i in range(0, len(spans), FAN)]
                cost, audit = next(iter(lightest(spans, START, COMPLETE).values()))
            rows.append((conv_id, 0 if last is None else last - first + 1 - turns,
                         *(sum(p[c] for p in pieces) for c in ("blank", "duplicate", "truncated")), illegal, cost, audit))
        if rows:
            types = [pa.int64()] * 7 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def repair_summaries(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation in ``rows``.

    ``rows`` is as :func:`conversation_rows` gives it; it comes by turn (nulls first), then role and SHA-256 of the text,
    which gives ties a defined order. Rows without their texts are range-sorted by conversation and order, so a
    conversation of any size is spread over tasks: each repairs what starts and ends inside it and gives the lightest
    derivations between all states for the rest, which another agenda joins. ``audit`` has one letter for each row kept,
    deleted or reroled and for each insertion. A null conv_id is a conversation; no rows give no rows.
    """
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest", "tie"]
    light = with_symbols(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = light.select("conv_id", "turn", "initial", "fault").mapInArrow(_pieces, PIECE_SQL)
    rest = [c for c in PIECE.names if c not in ("conv_id", "piece")]
    return (pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", *rest))).alias("pieces"))   # one a task at most
            .mapInArrow(_summaries, f"conv_id long, {SUMMARY}"))


def _streamed(*frames: DataFrame) -> DataFrame:
    """Rows of several tables by conversation: first those of the first table, and so on, in the order of the rows."""
    parts = [f.withColumn("kind", F.lit(i)) for i, f in enumerate(frames)]
    out = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    order = [F.asc_nulls_first(c) for c in ("conv_id", "kind", "position", "turn", "role", "digest") if c in out.columns]
    return out.repartition("conv_id").sortWithinPartitions(*order)


def _apply(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    out, chars = [], 0
    conv_id, audit, at, state, position = None, "", 0, START, 0

    def inserted():
        nonlocal at, state, position
        while at < len(audit) and audit[at] == "I":
            state, role = TURN[state]
            out.append((conv_id, position, role, "", "I"))
            at, position = at + 1, position + 1

    for batch in batches:
        texts = batch.column("text")
        for i, (c, kind, role, edits) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("conv_id", "kind", "role", "audit")))):
            if kind == 0:
                inserted()
                conv_id, audit, at, state, position = c, edits, 0, START, 0
                continue
            inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = KEEP[role[:1], state]
            elif edit == "R":
                state, role = TURN[state]
            if edit != "D":
                out.append((conv_id, position, role, texts[i].as_py(), edit))
                position, chars = position + 1, chars + len(out[-1][3])
            if chars > OUT or len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), schema.types)], schema=schema)
                out, chars = [], 0
    inserted()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), schema.types)], schema=schema)


def repaired_turns(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit): the conversations after the edits of :func:`repair_summaries`.

    A conversation streams through one task row by row, behind its audit; no task holds its texts.
    """
    texts = rows.withColumn("digest", F.sha2("text", 256))
    return _streamed(summaries.select("conv_id", "audit"), texts).mapInArrow(
        _apply, "conv_id long, position long, role string, text string, edit string")


def _digests(batches):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    types = [pa.int64()] * 7 + [pa.string()] * 2
    rows, held, conv_id, facts, sha, first = [], False, None, None, None, True

    def close():
        rows.append((conv_id, *facts, sha.hexdigest()))

    def batch_of():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["conv_id", *names, "repaired_sha256"])

    for batch in batches:
        roles, texts, summary = batch.column("role"), batch.column("text"), [batch.column(n) for n in names]
        for i, (c, kind) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("kind").to_pylist())):
            if kind == 0:
                if held:
                    close()
                held, conv_id, facts, sha, first = True, c, [0] * 6 + [""], hashlib.sha256(), True
            elif kind == 1:
                facts = [s[i].as_py() for s in summary]
            else:
                sha.update(f"{'' if first else chr(10)}{roles[i].as_py()}:{texts[i].as_py()}".encode())
                first = False
        if len(rows) > 10_000:
            yield batch_of()
            rows.clear()
    if held:
        close()
    if rows:
        yield batch_of()


@query("op12_chat_repair")
def op12_chat_repair(spark, sf_dir):
    whole = conversation_rows(table(spark, sf_dir, "conversations"))
    rows = damaged(whole)
    summaries = stored(repair_summaries(rows), "repairs")
    turns = stored(repaired_turns(rows, summaries), "repaired")
    return _streamed(whole.select("conv_id").distinct(), summaries, turns).mapInArrow(_digests, f"conv_id long, {SUMMARY}, repaired_sha256 string")
