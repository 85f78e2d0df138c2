"""Conversation structure repair: a generalised LR parse of the roles whose stacks may also delete, rerole and insert.

The grammar of role initials is ``C -> | P | s P``, ``P -> u a | P u a``. A graph-structured stack goes over a conversation's
rows: a row is kept where the table shifts its initial, reroled to user or assistant, or deleted; an empty row of user or
assistant may come in anywhere. Stacks with equal tops are merged, the least (cost, audit) staying; a top decides what may
follow, and of two audits of equal cost at one top and row none begins with the other, so nothing is lost. The audit has a
letter for each edit: K, R, D, I.

Conversations are put in order by ranges of (conversation, turn), so that one of any size spreads over many chunks. A
chunk parses its rows; for its first conversation, which may have begun before, from each top at which the chunk may be
entered. The chunks' paths of a conversation are then joined end to end, and each chunk writes its repaired rows. Repeats
across chunks are found by a grouping of the keys of the conversations at the chunks' edges.

Cases: null roles and texts are taken as one space; null turns come first; rows of one turn follow in the order of role
and text; rows with a null conversation id form one conversation; an empty table gives no rows; other columns are left
out. A conversation's audit is one string, and its digest reads its rows one after the other, in a stream.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelry.llm.chunks import CHUNK_BYTES, TOGETHER, by_group, with_answers
from voxelry.llm.shared import materialize, shared_dir

#: LR states: 0 start, 1 P, 2 s, 3 u, 4 s P, 5 P u. Shifting ``a`` reduces at once, back to the state below.
SHIFT = {(0, "s"): 2, (0, "u"): 3, (2, "u"): 3, (1, "u"): 5, (4, "u"): 5}
PAIR = {0: 1, 2: 4}
ACCEPT, TOPS = (0, 1, 4), range(6)
#: What a stack must have below each top; for state 3 either, as what may follow is the same.
STACKS = {0: (0,), 1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (0, 2, 4), 5: (0, 1, 5)}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
WORD, ENDS = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
ROLE = {"u": "user", "a": "assistant"}


def shifted(stack: tuple[int, ...], initial: str) -> tuple[int, ...] | None:
    """The stack after one initial, reductions done; None if the table has an error there."""
    top = stack[-1]
    if initial == "a" and top in (3, 5):
        below = stack[:-1]
        return (*below, PAIR[below[-1]]) if top == 3 else below
    to = SHIFT.get((top, initial))
    return None if to is None else (*stack, to)


Paths = dict[int, tuple[int, str, tuple[int, ...]]]


def offered(paths: Paths, stack: tuple[int, ...] | None, cost: int, audit: str) -> bool:
    """Merge a path into the stack of its top; whether it is the least there."""
    if stack is None or (stack[-1] in paths and paths[stack[-1]][:2] <= (cost, audit)):
        return False
    paths[stack[-1]] = (cost, audit, stack)
    return True


def inserted(paths: Paths) -> Paths:
    """All tops that insertions reach."""
    fresh = list(paths)
    while fresh:
        on = []
        for top in fresh:
            cost, audit, stack = paths[top]
            for role in ROLE:
                to = shifted(stack, role)
                if offered(paths, to, cost + INSERT, audit + "I"):
                    on.append(to[-1])
        fresh = on
    return paths


def parsed(symbols: str, start: int = 0) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) from a top to each top over rows given by a symbol each: ``d`` must go, else its initial or
    ``x``, in upper case if truncated."""
    paths, settled = inserted({start: (0, "", STACKS[start])}), []
    for i, symbol in enumerate(symbols):
        on: Paths = {}
        more, initial = TRUNCATED * symbol.isupper(), symbol.lower()
        for cost, audit, stack in paths.values():
            offered(on, stack, cost + DELETE, audit + "D")
            if symbol != "d":
                offered(on, shifted(stack, initial), cost + KEEP + more, audit + "K")
                for role in ROLE:
                    offered(on, shifted(stack, role), cost + REROLE + more, audit + "R")
        paths = inserted(on)
        if i % 256 == 255:  # what all paths share is settled
            shared = len(os.path.commonprefix([p[1] for p in paths.values()]))
            settled.append(next(iter(paths.values()))[1][:shared])
            paths = {top: (cost, audit[shared:], stack) for top, (cost, audit, stack) in paths.items()}
    head = "".join(settled)
    return {top: (cost, head + audit) for top, (cost, audit, _) in paths.items()}


@functools.lru_cache(maxsize=1 << 16)
def parsed_short(symbols: str, start: int) -> dict[int, tuple[int, str]]:
    return parsed(symbols, start)


def joined(parts: list[list[dict]]) -> list[dict]:
    """The chosen path of each part of a conversation; a part's paths are dicts of start, end, cost and audit."""
    best: dict[int, tuple[int, str, list[dict]]] = {0: (0, "", [])}
    for paths in parts:
        on: dict[int, tuple[int, str, list[dict]]] = {}
        for p in paths:
            if p["start"] in best:
                cost, audit, chosen = best[p["start"]]
                new = (cost + p["cost"], audit + p["audit"])
                if p["end"] not in on or new < on[p["end"]][:2]:
                    on[p["end"]] = (*new, [*chosen, p])
        best = on
    # an insertion between two parts may stand in either: equal cost and audit, either will do
    return min((best[t] for t in ACCEPT if t in best), key=lambda b: b[:2])[2]


def edits(audit: str, start: int, initials: Iterator[str]) -> Iterator[tuple[str, str | None]]:
    """Each edit's letter and the role that it gives, None if the row's own."""
    stack = STACKS[start]
    for letter in audit:
        initial = None if letter == "I" else next(initials)
        if letter == "D":
            yield letter, None
            continue
        if letter != "K":  # the only role that the table shifts here
            initial = next(r for r in ROLE if shifted(stack, r))
        stack = shifted(stack, initial)
        yield letter, None if letter == "K" else ROLE[initial]


def digest_key(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def rows_of(group: pa.Table) -> Iterator[tuple[int | None, list[tuple]]]:
    """Conversations of a chunk in order: id and (turn, role, text) of its rows."""
    group = group.take(pc.sort_indices(group, [("pos", "ascending")]))
    rows = zip(*(group.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True)
    for conv, part in groupby(rows, key=lambda r: r[0]):
        yield conv, [r[1:] for r in part]


def edge_keys(group: pa.Table) -> pa.Table:
    """Keys (role and text) of the conversations that a chunk begins and ends with."""
    chunk, found = group.column("chunk")[0].as_py(), list(rows_of(group))
    out = {(conv, digest_key(role, text)) for conv, rows in (found[0], found[-1]) for _, role, text in rows}
    return pa.table({"chunk": pa.array([chunk] * len(out), pa.int64()), "conv_id": pa.array([c for c, _ in out], pa.int64()), "key": pa.array([k for _, k in out], pa.binary())})


PATH = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
PART = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "turns")], ("first", pa.string()), ("last", pa.string()), ("paths", pa.list_(PATH))])
PART_SQL = "conv_id long, chunk long, blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, turns long, first string, last string, paths array<struct<start:int,end:int,cost:long,audit:string>>"
LEGAL = ("su", "ua", "au")


def parts_of(group: pa.Table, seen: pa.Table) -> pa.Table:
    """A row for each conversation of a chunk: faults, and its paths. ``seen`` has keys that occur in earlier chunks."""
    before: dict[int | None, set[bytes]] = {}
    for conv, key in zip(seen.column("conv_id").to_pylist(), seen.column("key").to_pylist(), strict=True):
        before.setdefault(conv, set()).add(key)
    chunk, out = group.column("chunk")[0].as_py(), []
    for k, (conv, rows) in enumerate(rows_of(group)):
        known, symbols, n = before.get(conv, set()), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            key = digest_key(role, text) if len(rows) > 1 or known else b""
            fault = "blank" if not WORD.search(text) else "duplicate" if key in known else None if ENDS.search(text) else "truncated"
            known.add(key)
            if fault:
                n[fault] += 1
            initial = role[0] if role[:1] in ("s", "u", "a") else "x"
            symbols.append("d" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
        symbols, turns = "".join(symbols), [t for t, _, _ in rows if t is not None]
        parse = parsed_short if len(symbols) <= 32 else parsed
        paths = [{"start": s, "end": e, "cost": c, "audit": a} for s in (TOPS if k == 0 else (0,)) for e, (c, a) in parse(symbols, s).items()]
        pairs = [x[1][:1] + y[1][:1] for x, y in zip(rows, rows[1:], strict=False)]
        out.append({"conv_id": conv, "chunk": chunk, **n, "illegal": sum(p not in LEGAL for p in pairs), "first_turn": min(turns, default=None), "last_turn": max(turns, default=None), "turns": len(set(turns)), "first": rows[0][1][:1], "last": rows[-1][1][:1], "paths": paths})
    return pa.Table.from_pylist(out, PART)


CHOSEN = pa.struct([("chunk", pa.int64()), ("start", pa.int32()), ("step", pa.int64()), ("audit", pa.string())])
REPORT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("chosen", pa.list_(CHOSEN))])
REPORT_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, chosen array<struct<chunk:long,start:int,step:long,audit:string>>"


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from batch.slice(at, 1024).to_pylist()


def reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation from its parts, which come in order."""
    out: list[dict] = []
    for conv, group in groupby(streamed(batches), key=lambda r: r["conv_id"]):
        parts = list(group)
        chosen, step, decided = joined([p["paths"] for p in parts]), 0, []
        for part, path in zip(parts, chosen, strict=True):
            decided.append({"chunk": part["chunk"], "start": path["start"], "step": step, "audit": path["audit"]})
            step += len(path["audit"])
        row = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
        row["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
        timed = [p for p in parts if p["turns"]]
        turns = sum(p["turns"] for p in timed) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:], strict=False))
        gaps = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - turns if timed else 0
        out.append({"conv_id": conv, "gaps": gaps, **row, "cost": sum(p["cost"] for p in chosen), "audit": "".join(p["audit"] for p in chosen), "chosen": decided})
        if len(out) >= 4096:
            yield pa.RecordBatch.from_pylist(out, REPORT)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, REPORT)


REPAIRED = "conv_id long, step long, edit string, role string, text string"


def repaired_rows(group: pa.Table, decided: pa.Table) -> pa.Table:
    ways = {c: (s, n, a) for c, s, n, a in zip(*(decided.column(x).to_pylist() for x in ("conv_id", "start", "step", "audit")), strict=True)}
    out: list[list] = [[], [], [], [], []]
    for conv, rows in rows_of(group):
        start, step, audit = ways[conv]
        left = iter(rows)
        for k, (letter, role) in enumerate(edits(audit, start, (r[1][:1] for r in rows))):
            _, own, text = (None, role, "") if letter == "I" else next(left)
            if letter != "D":
                for column, value in zip(out, (conv, step + k, letter, role or own, text), strict=True):
                    column.append(value)
    return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["conv_id", "step", "edit", "role", "text"])


def in_chunks(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """The rows in order: ``pos`` rises over (conversation, turn, role, text), a chunk is a range of it; bucketed by chunk."""
    spark = rows.sparkSession
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = int(max(1, -(-size // chunk_bytes)))
    # a text's beginning is enough to deal by: rows that agree in it stay together
    dealt = plain.repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    dealt = dealt.withColumn("pos", F.monotonically_increasing_id()).withColumn("chunk", F.shiftright("pos", 33))
    name = f"conversations_{uuid.uuid4().hex[:12]}"
    dealt.write.option("compression", "zstd").option("path", shared_dir(spark, "conversations")).bucketBy(max(1, min(100_000, n // TOGETHER)), "chunk").saveAsTable(name)
    return spark.table(name)


def repair(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (conv_id, turn, role, text): a report for each conversation (gaps, blank, duplicate, truncated, illegal,
    cost, audit), and the repaired rows (conv_id, step, edit, role, text), in order of step."""
    chunks = in_chunks(rows, chunk_bytes)
    keys = by_group(chunks, ["chunk"], edge_keys, "chunk long, conv_id long, key binary")
    first = F.min("chunk").over(Window.partitionBy("conv_id", "key"))  # a row for each chunk at most
    seen = keys.withColumn("first", first).filter("chunk > first").select("chunk", "conv_id", "key")
    parts = with_answers(chunks, seen, parts_of, PART_SQL)
    reports = materialize(parts.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(reported, REPORT_SQL), "reports")
    decided = reports.select("conv_id", F.explode("chosen").alias("c")).select("c.chunk", "conv_id", "c.start", "c.step", "c.audit")
    return reports.drop("chosen"), with_answers(chunks, decided, repaired_rows, REPAIRED)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its ``role:text`` lines joined by line feeds, read in a stream."""
    ordered = repaired.select("conv_id", "step", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "step")
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, lines in groupby(streamed(batches), key=lambda r: r["conv_id"]):
            whole = hashlib.sha256()
            for k, r in enumerate(lines):
                whole.update(f"{chr(10) if k else ''}{r['role']}:{r['text']}".encode())
            out.append({"conv_id": conv, "repaired_sha256": whole.hexdigest()})
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return ordered.mapInArrow(read, "conv_id long, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by the CRC-32 of ``conv_id:turn``, remainder 20 (nulls: one space): 0 drops the row, 1 empties its
    text, 2 takes its sentence ends, 3 repeats it, 4 makes its role user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).filter("kind > 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def report(rows: DataFrame, damage: bool = True) -> DataFrame:
    """A row for each conversation id of ``rows``, the rows being damaged first: its report and the repaired rows' digest."""
    reports, repaired = repair(damaged(rows) if damage else rows)
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    every = every.unionByName(reports, allowMissingColumns=True).unionByName(digests(repaired), allowMissingColumns=True)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return every.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in numbers], *[F.coalesce(F.max(c), F.lit(v)).alias(c) for c, v in none.items()])
