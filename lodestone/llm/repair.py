"""Conversation structure repair over a suffix-shared automaton of role and fault signatures.

Damage (seeded by crc32, part of the contract) comes first; then each conversation's rows, by turn, are judged
(blank, duplicate, truncated) and made legal by the cheapest edits: the role initials have to read (s?(ua)+)?.

1. Signatures. Equal rows of a conversation are one row with a count before anything is shuffled by order. Rows are range
   partitioned and sorted by (conversation, turn, role, text), so that a conversation of any length lies over as many
   tasks as it needs; each task cuts it into blocks of ``BLOCK`` symbols or ``BLOCK_BYTES`` of text at most. A symbol tells
   all that costs depend on: the role's initial (s, u, a or another), its capital where the text is truncated, or d where
   the row has to go.
2. Automaton. The distinct signatures of all conversations are sorted from their ends, so that those
   which share a suffix stand side by side. A node is a suffix; a task keeps the path of the last signature, and adds
   only the nodes in which the next one differs. Once for each node and grammar state, the cost-to-go and the best audit
   suffix to each state in which the suffix can end are those of the node after it, with one edit more.
3. Blocks. A conversation that is one block takes its signature's best end. Blocks of longer ones are put together in groups of
   ``GROUP``, the groups of a conversation (one for a million rows, and one for each task) give its best way, and the
   choices go down again. No audit of one way through a block is the beginning of another's, since inserts stand before
   a row; so ties are settled in the first block that differs.
4. Output. Audits are applied to the blocks' texts. SHA-256 runs along a conversation: its pieces go through one
   task in order, one block in memory at a time. The audit is one value, as its length is the contract's.

Defined results: a null role or text is one space, a null turn comes first and counts for no gap; rows of equal turn are
ordered by role and text, repeated rows lie side by side and all but the first are duplicates; a role is judged by
its initial as it is written, so an empty or unknown one has to be edited; a null conv_id is a conversation like any
other; one without rows after damage has zeros, an empty audit and the hash of nothing; an empty table gives no
rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import shuffle_partitions, table, written

BLOCK, BLOCK_BYTES, GROUP = 256, 1 << 20, 256
#: Costs of the contract.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Grammar states: before all, after the system turn, after a user turn, after an assistant turn.
STATES = START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role's initial leads from each state, and where an inserted or changed turn does.
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
MADE = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
#: What is inserted behind the last row.
END = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
LEGAL = ("su", "ua", "au")
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: A block's best way from one state to another: [from][to], (cost, audit) or None.
Ways = list[list[tuple[int, str] | None]]


def damage_kind() -> Column:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage, and copies (how often the row stands there)."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), damage_kind().alias("kind")).where("kind <> 0")
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("copies"))


def judged(rows: DataFrame) -> DataFrame:
    """Rows with their fault: blank, duplicate, truncated or null. Only keys and hashes of the texts are looked up."""
    rows = rows.withColumn("key", F.sha2("text", 256)).withColumn("since", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    first = rows.groupBy("conv_id", "role", "key").agg(F.min("since").alias("first"), F.max("since").alias("last")).where("first < last")
    first = first.select(F.col("conv_id").alias("of"), F.col("role").alias("by"), F.col("key").alias("what"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("by")) & (F.col("key") == F.col("what"))
    rows = rows.join(first, same, "left")
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(end == "", "blank").when(F.col("since") > F.col("first"), "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    return rows.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def gap_counts(turns: DataFrame) -> DataFrame:
    """conv_id, gaps."""
    there = turns.where(damage_kind() != 0).select("conv_id", "turn").distinct()
    return there.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))


def symbol() -> Column:
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)


def blocks(rows: DataFrame, size: int = BLOCK, size_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The conversations in blocks, in order of part and seq.

    whole (surely all of its conversation), signature, counts of faults, illegal (pairs inside), head and tail (first
    and last initials), roles and texts (of the rows that may stay).
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    counts = ["blank", "duplicate", "truncated", "illegal"]
    fields = {"conv_id": kind, "part": "long", "seq": "long", "whole": "boolean", "signature": "string"} | dict.fromkeys(counts, "long")
    fields |= {"head": "string", "tail": "string", "roles": "array<string>", "texts": "array<string>"}
    types = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, seen, seq, weight, kind_ = TaskContext.get().partitionId(), None, 0, 0, 0, None
        now: dict = {}

        def taken(whole: bool) -> pa.RecordBatch:
            nonlocal seq, weight, now
            row = now | {"conv_id": conv[0], "part": part, "seq": seq, "whole": whole and seq == 0 and seen > 1, "signature": "".join(now["signature"])}
            seq, weight, now = seq + 1, 0, {}
            return pa.RecordBatch.from_arrays([pa.array([row[f]], kind_ if f == "conv_id" else types[t]) for f, t in fields.items()], list(fields))

        for batch in batches:
            kind_ = batch.schema.field("conv_id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "copies", "fault", "symbol")), strict=True):
                of, role, text, copies, fault, own = row
                if conv != (of,):
                    if now:
                        yield taken(True)
                    conv, seen, seq = (of,), seen + 1, 0
                elif now and weight + len(text) > size_bytes:
                    yield taken(False)
                initial = role[:1]
                while copies:
                    if not now:
                        now = dict.fromkeys(counts, 0) | {"signature": [], "head": initial, "tail": None, "roles": [], "texts": []}
                    room = min(copies, size - len(now["signature"]))
                    now["illegal"] += (now["tail"] is not None and now["tail"] + initial not in LEGAL) + (room - 1) * (initial * 2 not in LEGAL)
                    now["tail"] = initial
                    if fault:
                        now[fault] += room if fault == "blank" else 1
                    if fault != "blank":
                        now["duplicate"] += room - 1
                    if own != "d":
                        now["roles"].append(role)
                        now["texts"].append(text)
                        weight += len(text)
                    now["signature"] += [own] + ["d"] * (room - 1)
                    copies -= room
                    if fault != "blank":
                        fault, own = "duplicate", "d"
                    if len(now["signature"]) == size:
                        yield taken(False)
        if now:
            yield taken(False)

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    ranged = rows.withColumn("symbol", symbol()).repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return ranged.select("conv_id", "role", "text", "copies", "fault", "symbol").mapInArrow(run, ", ".join(f"{f} {t}" for f, t in fields.items()))


def node(own: str, after: Ways) -> Ways:
    """The ways of a suffix, from those of the suffix without its first symbol."""
    kind, more = own.lower(), TRUNCATED if own.isupper() else 0
    row = []
    for state in STATES:
        options = [("D", DELETE, state)]
        if kind != "d":
            options.append(("R", REROLE + more, MADE[state]))
            if (state, kind) in STEP:
                options.append(("K", more, STEP[state, kind]))
        row.append([min(((cost + way[0], edit + way[1]) for edit, cost, to in options if (way := after[to][end])), default=None) for end in STATES])
    out = []
    for state in STATES:  # two turns at most are inserted before a row: more would lead to a state met before
        made = row[state], row[MADE[state]], row[MADE[MADE[state]]]
        out.append([min(((w[0] + INSERT * k, "I" * k + w[1]) for k, ways in enumerate(made) if (w := ways[end])), default=None) for end in STATES])
    return out


def solved(signatures: DataFrame) -> DataFrame:
    """signature, costs, audits (16 each, at 4 * from + to; null where there is no way): the automaton over signatures sorted from their ends."""
    names = ["signature", "costs", "audits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty: Ways = [[(0, "") if a == b else None for b in STATES] for a in STATES]
        path, last = [empty], ""  # path[k]: the node of the last k symbols of the last signature
        for batch in batches:
            costs, audits = [], []
            for backward in batch.column("backward").to_pylist():
                shared = 0
                while shared < min(len(last), len(backward)) and last[shared] == backward[shared]:
                    shared += 1
                del path[shared + 1 :]
                for own in backward[shared:]:
                    path.append(node(own, path[-1]))
                last = backward
                cells = [way for row in path[-1] for way in row]
                costs.append([w and w[0] for w in cells])
                audits.append([w and w[1] for w in cells])
            yield pa.RecordBatch.from_arrays([batch.column("signature"), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], names)

    backward = signatures.select("signature").distinct().withColumn("backward", F.reverse("signature"))
    ranged = backward.repartitionByRange(shuffle_partitions(signatures.sparkSession), "backward").sortWithinPartitions("backward")
    return ranged.mapInArrow(run, "signature string, costs array<long>, audits array<string>")


def best_end(costs: list, audits: list) -> int:
    """Where the last block, from its row of ways, should end."""
    return min((costs[b] + INSERT * len(END[b]), audits[b] + END[b], b) for b in STATES if costs[b] is not None)[2]


def rendered(audit: str, state: int, signature: str, roles: list[str], texts: list[str]) -> str:
    """The block's turns after the edits of ``audit``, newline-joined."""
    out, symbols, rows = [], iter(signature), iter(zip(roles, texts, strict=True))
    for edit in audit:
        if edit == "I":
            state = MADE[state]
            out.append(ROLE[state] + ":")
            continue
        own = next(symbols)
        if own == "d":
            continue
        role, text = next(rows)
        if edit == "K":
            state = STEP[state, own.lower()]
            out.append(f"{role}:{text}")
        elif edit == "R":
            state = MADE[state]
            out.append(f"{ROLE[state]}:{text}")
    return "\n".join(out)


def applied(held: DataFrame) -> DataFrame:
    """Blocks with costs and audits, and, but for whole ones, entry, leave and closing: conv_id, part, seq, cost, audit, repaired."""
    kind = held.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "part", "seq", "cost", "audit", "repaired"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one at a time: a block holds up to BLOCK_BYTES of text
                row = batch.slice(i, 1).to_pylist()[0]
                entry = row["entry"]
                costs, audits = (row[c][4 * entry : 4 * entry + 4] for c in ("costs", "audits"))
                leave = best_end(costs, audits) if row["leave"] is None else row["leave"]
                more = END[leave] if row["closing"] else ""
                audit = audits[leave] + more
                text = rendered(audit, entry, row["signature"], row["roles"], row["texts"])
                fixed = [pa.array([x]) for x in (costs[leave] + INSERT * len(more), audit, text)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in names[:3]), *fixed], names)

    columns = ("conv_id", "part", "seq", "entry", "leave", "closing", "signature", "costs", "audits", "roles", "texts")
    return held.select(*columns).mapInArrow(run, f"conv_id {kind}, part long, seq long, cost long, audit string, repaired string")


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces, with a conversation's side by side and in order: conv_id, cost, audit, repaired_sha256."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, cost, audit, hashed, begun = None, 0, [], hashlib.sha256(), False
        for batch in batches:
            out: list[tuple] = []
            kind_ = batch.schema.field("conv_id").type
            for of, more, edits, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "cost", "audit", "repaired")), strict=True):
                if conv != (of,):
                    if conv:
                        out.append((conv[0], cost, "".join(audit), hashed.hexdigest()))
                    conv, cost, audit, hashed, begun = (of,), 0, [], hashlib.sha256(), False
                cost += more
                audit.append(edits)
                if text:
                    hashed.update((("\n" if begun else "") + text).encode())
                    begun = True
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((kind_, pa.int64(), pa.string(), pa.string()))], names)
        if conv:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((conv[0], cost, "".join(audit), hashed.hexdigest()), (kind_, pa.int64(), pa.string(), pa.string()), strict=True)], names)

    return pieces.mapInArrow(run, f"conv_id {kind}, cost long, audit string, repaired_sha256 string")


def ranked(audits: list) -> list[int | None]:
    """Audits (or paths) as ranks among those from the same state: all that a choice between ends needs."""
    out = []
    for a in STATES:
        row = audits[4 * a : 4 * a + 4]
        place = sorted(x for x in row if x is not None)
        out += [None if x is None else place.index(x) for x in row]
    return out


def way(steps: list[dict], entry: int, leave: int | None) -> tuple[int, list[int], list[int]] | None:
    """The cheapest way through blocks in order, from ``entry`` to ``leave`` (None: to an end of the conversation): cost, the state after each block, and its audit's rank there.

    Costs-to-go are counted from the last block backwards; of equal costs the least audit is taken from the first block on.
    """
    to_go = [[INSERT * len(END[s]) if leave is None else 0 if s == leave else None for s in STATES]]
    for step in reversed(steps):
        cost, go = step["costs"], to_go[-1]
        to_go.append([min((cost[4 * a + b] + go[b] for b in STATES if cost[4 * a + b] is not None and go[b] is not None), default=None) for a in STATES])
    to_go.reverse()
    if to_go[0][entry] is None:
        return None
    states, ranks, at = [], [], entry
    for step, here, next_ in zip(steps, to_go, to_go[1:], strict=False):
        cost, rank = step["costs"], step["ranks"]
        fit = [b for b in STATES if cost[4 * at + b] is not None and next_[b] is not None and cost[4 * at + b] + next_[b] == here[at]]
        end = min(fit, key=lambda b: rank[4 * at + b])
        ranks.append(rank[4 * at + end])
        states.append(end)
        at = end
    return to_go[0][entry], states, ranks


def put_together(steps: list[dict]) -> dict:
    """Neighbouring blocks as one: costs, ranks, illegal, head, tail."""
    ways = [way(steps, a, b) for a in STATES for b in STATES]
    between = sum(x["tail"] + y["head"] not in LEGAL for x, y in zip(steps, steps[1:], strict=False))
    return {
        "costs": [w and w[0] for w in ways], "ranks": ranked([w and w[2] for w in ways]), "illegal": between + sum(x["illegal"] for x in steps),
        "head": steps[0]["head"], "tail": steps[-1]["tail"],
    }


PART = "costs: array<long>, ranks: array<long>, illegal: long, head: string, tail: string"


def choices(parts: DataFrame, group: int = GROUP) -> DataFrame:
    """conv_id, part, seq, entry, leave, closing of every block of conversations with several, and illegal (of the whole conversation, at its last block).

    parts: conv_id, part, seq, costs, audits, illegal, head, tail.
    """
    rank = F.udf(ranked, "array<long>")  # a row is a block of up to BLOCK turns
    step = F.struct("seq", "costs", rank("audits").alias("ranks"), "illegal", "head", "tail")
    groups = parts.withColumn("group", F.floor(F.col("seq") / group)).groupBy("conv_id", "part", "group").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    groups = written(groups.withColumn("one", F.udf(lambda steps: put_together([x.asDict() for x in steps]), f"struct<{PART}>")("steps")), "repair-groups")
    convs = groups.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "group", "one"))).alias("steps"))

    def down(steps, entry, leave):
        states = way(steps, entry, leave)[1]
        return list(zip([entry, *states[:-1]], states, strict=True))

    def over(steps):
        ones = [x["one"].asDict() for x in steps]
        total = put_together(ones)["illegal"]
        return [(x["part"], x["group"], a, b, x is steps[-1], total if x is steps[-1] else None) for x, (a, b) in zip(steps, down(ones, START, None), strict=True)]

    def inside(steps, entry, leave, closing, illegal):
        steps = [x.asDict() for x in steps]
        ends = [(closing, illegal) if x is steps[-1] else (False, None) for x in steps]
        return [(x["seq"], a, b, *end) for x, (a, b), end in zip(steps, down(steps, entry, leave), ends, strict=True)]

    places = convs.select("conv_id", F.explode(F.udf(over, "array<struct<part: long, group: long, entry: int, leave: int, closing: boolean, illegal: long>>")("steps")).alias("x")).select(F.col("conv_id").alias("of"), "x.*")
    met = groups.alias("g").join(places.alias("p"), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("g.part") == F.col("p.part")) & (F.col("g.group") == F.col("p.group")))
    each = F.udf(inside, "array<struct<seq: long, entry: int, leave: int, closing: boolean, illegal: long>>")
    return met.select("conv_id", "g.part", F.explode(each("steps", "entry", "leave", "closing", "illegal")).alias("x")).select("conv_id", "part", "x.*")


def repaired(turns: DataFrame, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    held = written(blocks(judged(damaged(turns)), block), "repair-blocks")
    automaton = written(solved(held), "repair-automaton")
    whole = held.where("whole").withColumns({"entry": F.lit(START), "leave": F.lit(None).cast("int"), "closing": F.lit(True)}).join(automaton, "signature")
    pieces = held.where("NOT whole").join(automaton, "signature")
    chosen = written(choices(pieces.select("conv_id", "part", "seq", "costs", "audits", "illegal", "head", "tail"), group), "repair-choices")
    marks = chosen.select(F.col("conv_id").alias("of"), F.col("part").alias("p"), F.col("seq").alias("q"), "entry", "leave", "closing")
    pieces = pieces.join(marks, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("p")) & (F.col("seq") == F.col("q")))
    in_order = applied(pieces).repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "seq")
    outcome = digests(applied(whole)).unionByName(digests(in_order))
    counts = held.where("whole").select("conv_id", "blank", "duplicate", "truncated", "illegal")
    counts = counts.unionByName(held.where("NOT whole").select("conv_id", "blank", "duplicate", "truncated", F.lit(0).cast("long").alias("illegal")))
    counts = counts.unionByName(chosen.where("illegal IS NOT NULL").select("conv_id", *(F.lit(0).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")), "illegal"))
    counts = counts.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    out = turns.select("conv_id").distinct()
    for more in (gap_counts(turns), counts, outcome):
        more = more.withColumnRenamed("conv_id", "of")
        out = out.join(more, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    nothing = hashlib.sha256().hexdigest()
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
