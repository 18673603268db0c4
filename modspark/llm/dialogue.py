"""Repair of conversation structure: the cheapest edits by a shortest path whose weights are single integers."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark.llm.common import stored

WHITE = " \t\n\x0b\x0c\r"
ENDS = [".", "!", "?"]
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5  # costs; CUT: a truncated row that stays
INSERTS = 2
SEGMENT = 512
LEGAL = {"su", "ua", "au"}
LONGEST = 2**63 - 1

# Letters of edits as octal digits, in ASCII order; 0 pads the end.
CODES = {"D": 1, "I": 2, "K": 3, "R": 4}
_TO_DIGITS = str.maketrans({k: str(v) for k, v in CODES.items()})
_TO_LETTERS = str.maketrans({str(v): k for k, v in CODES.items()})

# States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. STEP has what may follow.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STEP = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
TURN = ["u", "u", "a", "u"]  # what a reroled or inserted row has to be
ROLE = {"u": "user", "a": "assistant"}


def weight(cost: int, letter: str, place: int, width: int) -> int:
    """One edit at ``place`` of an audit of ``width`` letters at most: sums of weights compare by cost, then by audit."""
    return cost << 3 * width | CODES[letter] << 3 * (width - 1 - place)


def packed(cost: int, audit: str, width: int) -> int:
    return cost << 3 * width | int(audit.translate(_TO_DIGITS).ljust(width, "0") or "0", 8)


def unpacked(value: int, width: int) -> tuple[int, str]:
    low = value & ((1 << 3 * width) - 1)
    return value >> 3 * width, f"{low:0{width}o}".rstrip("0").translate(_TO_LETTERS) if width else ""


def shortest(symbols: str, start: int = NOTHING, inserts: int = INSERTS) -> dict[int, tuple[int, str]]:
    """Cost and audit of the cheapest edits of a run of rows, from state ``start`` to each state.

    A symbol is a row: ``-`` must be deleted; ``u a s`` by role initial, ``x`` another role; upper case
    is a truncated row. The nodes of the graph are (rows done, inserted rows, state). Two inserted
    rows are enough: where an inserted row stands beside a row that stays, deleting that row
    and not inserting is cheaper, unless the two are all there is, and no run needs more than
    two to get from one state to another.
    """
    width = len(symbols) + inserts
    layer: list[list[int | None]] = [[None] * 4 for _ in range(inserts + 1)]
    layer[0][start] = 0

    def reach(nodes: list[int | None], state: int, value: int) -> None:
        if nodes[state] is None or value < nodes[state]:
            nodes[state] = value

    for i in range(len(symbols) + 1):
        for k, nodes in enumerate(layer[:-1]):
            w = weight(INSERT, "I", i + k, width)
            for q, value in enumerate(nodes):
                if value is not None:
                    reach(layer[k + 1], STEP[q][TURN[q]], value + w)
        if i == len(symbols):
            break
        c = symbols[i]
        extra = CUT if c.isupper() else 0
        after: list[list[int | None]] = [[None] * 4 for _ in layer]
        for k, nodes in enumerate(layer):
            if all(v is None for v in nodes):
                continue
            drop = weight(DELETE, "D", i + k, width)
            keep = weight(KEEP + extra, "K", i + k, width)
            turn = weight(REROLE + extra, "R", i + k, width)
            for q, value in enumerate(nodes):
                if value is None:
                    continue
                reach(after[k], q, value + drop)
                if c != "-":
                    reach(after[k], STEP[q][TURN[q]], value + turn)
                    if c.lower() in STEP[q]:
                        reach(after[k], STEP[q][c.lower()], value + keep)
        layer = after
    best = {q: min(v) for q in range(4) if (v := [nodes[q] for nodes in layer if nodes[q] is not None])}
    return {q: unpacked(v, width) for q, v in best.items()}


_short = lru_cache(100_000)(shortest)


def cheapest(symbols: str) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of a whole conversation."""
    ends = _short(symbols) if len(symbols) <= 16 else shortest(symbols)
    width = max(len(a) for _, a in ends.values())
    return unpacked(min(packed(*ends[q], width) for q in (NOTHING, ASSISTANT) if q in ends), width)


Paths = dict[tuple[int, int], tuple[int, str]]


def joined(left: Paths, right: Paths) -> Paths:
    """Cheapest edits of two neighbouring runs from those of each, for each first and last state."""
    width = max(len(a) for _, a in left.values()) + max(len(a) for _, a in right.values())
    out: dict[tuple[int, int], int] = {}
    for ((p, q), (c, a)), ((r, s), (d, b)) in itertools.product(left.items(), right.items()):
        if q == r:
            value = packed(c + d, a + b, width)
            out[p, s] = min(value, out.get((p, s), value))
    return {k: unpacked(v, width) for k, v in out.items()}


@dataclass
class Repair:
    summary: DataFrame  # conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    messages: DataFrame  # conv_id, position, edit, role, text: what the conversations are after repair


def _symbol() -> Column:
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("u", "a", "s"), initial).otherwise("x")
    return F.when(F.col("gone"), "-").when(F.col("cut"), F.upper(kind)).otherwise(kind)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order become runs of up to ``SEGMENT`` rows of one conversation, with their cheapest edits."""
    part = TaskContext.get().partitionId()
    names = ["key", "part", "seq", "head", "tail", "illegal", "paths"]
    path = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(path)]
    out: list[tuple] = []

    def closed(whole: bool) -> None:
        run = "".join(symbols)
        paths: Paths = {}
        if whole:
            paths[NOTHING, ASSISTANT] = cheapest(run)
        else:
            for p in range(4):
                paths |= {(p, q): v for q, v in shortest(run, p).items()}
        flat = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in paths.items()]
        out.append((key, part, seq, head, tail, illegal, flat))

    def written() -> pa.RecordBatch:
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, names)

    key, seq, first_of_task = None, 0, True
    symbols: list[str] = []
    head = tail = ""
    illegal = 0
    for batch in batches:
        for k, initial, symbol, n in zip(*(batch.column(c).to_pylist() for c in ("key", "initial", "symbol", "n")), strict=True):
            if k != key:
                if key is not None:
                    closed(whole=seq == 0 and not first_of_task)
                    first_of_task = False
                key, seq, symbols, illegal, head, tail = k, 0, [], 0, initial, None
            for j in range(n):
                if len(symbols) == SEGMENT:
                    closed(whole=False)
                    seq, symbols, illegal, head, tail = seq + 1, [], 0, initial, None
                illegal += tail is not None and tail + initial not in LEGAL
                tail = initial
                symbols.append("-" if j else symbol)
        if len(out) > 1000:
            yield written()
    if key is not None:
        closed(whole=False)
    if out:
        yield written()


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's runs, neighbour with neighbour until one is left."""
    for batch in batches:
        cost, audit, illegal = [], [], []
        for runs in batch.column("runs").to_pylist():
            runs.sort(key=lambda r: (r["part"], r["seq"]))
            illegal.append(sum(r["illegal"] for r in runs) + sum(a["tail"] + b["head"] not in LEGAL for a, b in itertools.pairwise(runs)))
            parts = [{(x["p"], x["q"]): (x["cost"], x["audit"]) for x in r["paths"]} for r in runs]
            while len(parts) > 1:
                parts = [joined(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
            ends = [v for (p, q), v in parts[0].items() if p == NOTHING and q in (NOTHING, ASSISTANT)]
            width = max(len(a) for _, a in ends)
            c, a = unpacked(min(packed(*v, width) for v in ends), width)
            cost.append(c)
            audit.append(a)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(illegal, pa.int64()), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], ["key", "illegal", "cost", "audit"])


_MESSAGE = ["conv_id", "position", "edit", "role", "text"]
_MESSAGE_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An audit, then its conversation's rows in order: the rows that stay, and those put in."""
    audit, at, state, position, conv = "", 0, NOTHING, 0, None
    out: list[tuple] = []

    def put(edit: str, initial: str, role: str, text: str) -> None:
        nonlocal position, state
        out.append((conv, position, edit, role, text))
        position, state = position + 1, STEP[state][initial]

    def inserted() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            put("I", TURN[state], ROLE[TURN[state]], "")
            at += 1

    def written() -> pa.RecordBatch:
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _MESSAGE_TYPES, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, _MESSAGE)

    for batch in batches:
        size = 0
        for conv_id, row, role, text, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "row", "role", "text", "n")), strict=True):
            if row == 0:
                inserted()
                audit, at, state, position, conv = text, 0, NOTHING, 0, conv_id
                continue
            for _ in range(n):
                inserted()
                edit = audit[at]
                at += 1
                if edit == "K":
                    put("K", role[:1], role, text)
                elif edit == "R":
                    put("R", TURN[state], ROLE[TURN[state]], text)
                size += len(text)
                if size > 4_000_000 and out:
                    yield written()
                    size = 0
        if out:
            yield written()
    inserted()
    if out:
        yield written()


def _key() -> Column:
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(""))


def repair(rows: DataFrame, copies: str | None = None) -> Repair:
    """The cheapest repair of each conversation of ``rows(conv_id, turn, role, text)`` to an optional system row
    and pairs of user and assistant. ``copies`` may name a column of how often a row stands there.

    Rows are taken by turn, nulls first; within a turn by role, then by the SHA-256 of the text. A null role
    or text is one space; rows with a null conv_id are one conversation; an empty role has no initial
    and stays only reroled. Rows alike in all of these are copies: the first may stay. A row
    is blank (white space only), else a duplicate (role and text seen earlier), else truncated (its
    last character that isn't white is not one of ``.!?``). Blank rows and duplicates are deleted (2); others
    are kept (0), made user or assistant (1) or deleted (2), a truncated row that stays costs 5 more, and
    an empty row put in costs 5. Of all cheapest ways the audit, the letters K R D I in order,
    is the least in ASCII. An empty table gives no rows; other columns are ignored.

    ``gaps`` (at most the largest long) counts turns that are missing between the first and the last.
    Large conversations are cut into runs of 512 rows by range, solved apart for each pair of states and
    joined pairwise. An audit is one value with a letter a row: that much memory a conversation needs.
    ``messages`` streams: a conversation's rows come out together and in order, whatever their number.
    """
    space = F.lit(" ")
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
        (F.col(copies) if copies else F.lit(1)).cast("long").alias("n"),
    )
    rows = rows.select(_key().alias("key"), "conv_id", "turn", "role", "text", F.sha2("text", 256).alias("digest"), "n")
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    rows_ = rows.withColumn("blank", bare == "").withColumn("cut", (bare != "") & ~F.right(bare, F.lit(1)).isin(ENDS))
    lines = rows_.groupBy("key", "turn", "role", "digest").agg(F.sum("n").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.first("conv_id").alias("conv_id"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    lines = stored(lines.withColumn("place", place), "lines")
    first = lines.groupBy("key", "role", "digest").agg(F.min("place").alias("first"))
    lines = lines.join(first, ["key", "role", "digest"]).withColumn("again", ~F.col("blank") & (F.col("place") > F.col("first")))
    lines = lines.withColumn("gone", F.col("blank") | F.col("again")).withColumn("cut", F.col("cut") & ~F.col("again"))
    lines = stored(lines.select("key", "conv_id", "turn", "role", "digest", "n", "blank", "again", "cut", "gone"), "lines_marked")
    wide = "decimal(38,0)"
    span = F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.count_distinct("turn")
    counts = lines.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"),
        F.least(F.coalesce(span, F.lit(0).cast(wide)), F.lit(LONGEST).cast(wide)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("again"), F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.sum(F.col("cut").cast("long")).alias("truncated"),
    )
    ordered = lines.select("key", "turn", "role", "digest", "n", F.substring("role", 1, 1).alias("initial"), _symbol().alias("symbol"))
    ordered = ordered.repartitionByRange("key", "turn", "role", "digest").sortWithinPartitions("key", "turn", "role", "digest")
    path = "p int, q int, cost long, audit string"
    runs = ordered.select("key", "initial", "symbol", "n").mapInArrow(_segments, f"key string, part int, seq long, head string, tail string, illegal long, paths array<struct<{path.replace(' ', ':').replace(',:', ',')}>>")
    runs = runs.groupBy("key").agg(F.collect_list(F.struct("part", "seq", "head", "tail", "illegal", "paths")).alias("runs"))
    solved = stored(runs.mapInArrow(_solved, "key string, illegal long, cost long, audit string"), "audits")
    summary = counts.join(solved, "key").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    none = F.lit("")
    heads = solved.select("key", F.when(F.col("key") != "", F.col("key").cast("long")).alias("conv_id"), F.lit(0).alias("row"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("digest"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("n"))
    both = heads.union(rows.select("key", "conv_id", F.lit(1).alias("row"), "turn", "role", "digest", "text", "n"))
    both = both.repartition("key").sortWithinPartitions("key", "row", "turn", "role", "digest")
    messages = both.select("conv_id", "row", "role", "text", "n").mapInArrow(_edited, "conv_id long, position long, edit string, role string, text string")
    return Repair(summary, messages)


def transcripts(messages: DataFrame) -> DataFrame:
    """``conv_id, sha256`` (lowercase hex) of each conversation's ``role:text`` joined by newlines.

    ``messages`` are those of ``repair``: a conversation's rows lie together and in order, so it is
    hashed as they pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hasher, ids, digests = None, None, [], []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if hasher is None or conv != now:
                    if hasher is not None:
                        ids.append(now)
                        digests.append(hasher.hexdigest())
                    now, hasher = conv, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    hasher.update(f"\n{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], ["conv_id", "sha256"])
            ids, digests = [], []
        if hasher is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([hasher.hexdigest()])], ["conv_id", "sha256"])

    return messages.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` and ``n`` (copies) after damage by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes it a user's. Nulls
    are one space, but null turns and conv_ids stay null.
    """
    space = F.lit(" ")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("how", F.crc32(name) % 20).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("how") == 3, 2).otherwise(1).alias("n")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies)


def repaired_after_damage(conversations: DataFrame) -> DataFrame:
    """Per conv_id of ``conversations``: ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``
    of the repair (see ``repair``) of what ``damaged`` leaves of it.

    One of which no row is left has zeros, an empty audit and the hash of an empty string, as has one
    of which no row stays. The null conv_id is one conversation. An empty table gives no rows.
    """
    done = repair(damaged(conversations), "n")
    told = done.summary.select(_key().alias("key"), *(c for c in done.summary.columns if c != "conv_id"))
    texts = transcripts(done.messages).select(_key().alias("key"), "sha256")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("key", _key())
    out = every.join(told, "key", "left").join(texts, "key", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    sha = F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), sha)
