"""Repair of conversations: the cheapest edits that restore the order of roles.

Rows are dealt by range of (conversation, turn), so that one long conversation
spreads over many partitions.  A conversation that lies whole inside a partition
is repaired there.  Those that cross a partition's edge, or are long, go on as
blocks of rows: each block is solved from every role state to every other, the
blocks' results are multiplied per conversation, and the chosen edits are applied
block by block.

Every way through the rows is one integer: the high part is its cost, the low part
holds its edit letters as digits of fixed width from the left, zeros after the
last, so the smaller integer is the cheaper way and among equals the one whose
letters come first in ASCII.  Two ways of equal cost between the same states never
continue one another (the longer would have an insertion more), so the choice in a
block holds whatever follows.

Defined results: a null role or text is one space, so the row is blank; a null
turn comes first and reads as one space in the damage key, as does a null
conversation, which is a conversation of its own; rows of one turn follow by role,
then by text (64 characters, then its SHA-256); equal rows of one turn are
duplicates; a role whose first letter is not s, u or a must be reroled or deleted;
an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..checkpoints import stage
from .common import Batches, pick

BLOCK_ROWS, BLOCK_CHARS = 256, 1 << 20      # rows and characters of a block
WHOLE_ROWS, WHOLE_CHARS = 1024, 4 << 20     # a longer conversation is solved in blocks

# Role states: nothing yet, after a system, a user and an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)        # state after a row whose role may be chosen
ACCEPTED = (START, ASSISTANT)
ROLE_NAME = {USER: "user", ASSISTANT: "assistant"}

BITS, LETTERS = 3, "\0DIKR"                 # digits of the letters, in ASCII order
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}

Way = tuple[int, int]                       # (integer weight, letters so far)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows after damage; a dropped row stays as a mark with n = 0."""
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), hit.alias("hit"))
    dropped = F.col("hit") == 0
    text = F.when(dropped | (F.col("hit") == 1), "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(dropped, "").when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(1))).when(dropped, F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", F.when(~dropped, F.col("turn")).cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.explode(times).alias("n"))


# --- Ways as integers ---------------------------------------------------------

def _better(ways: dict[int, Way], state: int, way: Way) -> None:
    if state not in ways or way < ways[state]:
        ways[state] = way


@lru_cache(maxsize=20_000)
def solve(rows: str, start: int) -> tuple[int | None, ...]:
    """Least weight from ``start`` to each state over ``rows``, two characters a row: first letter of the role and fault.

    A weight has three digits a row: two insertions before it (more never pay,
    for two in a row lead back to the same state) and the row's own edit.
    """
    count = len(rows) // 2
    width = 3 * count
    unit = 1 << BITS * width

    def edge(way: Way, letter: int, extra: int = 0) -> Way:
        weight, used = way
        return weight + (COST[letter] + extra) * unit + (letter << BITS * (width - 1 - used)), used + 1

    ways: dict[int, Way] = {start: (0, 0)}
    for k in range(count):
        initial, fault = rows[2 * k], rows[2 * k + 1]
        ready = dict(ways)
        layer = ways
        for _ in range(2):
            inserted: dict[int, Way] = {}
            for state, way in layer.items():
                _better(inserted, NEXT[state], edge(way, INSERT))
            for state, way in inserted.items():
                _better(ready, state, way)
            layer = inserted
        ways = {}
        for state, way in ready.items():
            _better(ways, state, edge(way, DELETE))
            if fault in "bd":
                continue
            late = int(fault == "t")
            if (state, initial) in AFTER:
                _better(ways, AFTER[state, initial], edge(way, KEEP, late))
            _better(ways, NEXT[state], edge(way, REROLE, late))
    return tuple(ways[state][0] if state in ways else None for state in STATES)


def joined(a: int, a_digits: int, b: int, b_digits: int) -> int:
    """The weight of a way followed by another: costs add, the second's letters follow the first's."""
    a_cost, a_low = a >> BITS * a_digits, a & ((1 << BITS * a_digits) - 1)
    b_cost, b_low = b >> BITS * b_digits, b & ((1 << BITS * b_digits) - 1)
    free = ((a_low & -a_low).bit_length() - 1) // BITS if a_low else a_digits
    return (a_cost + b_cost << BITS * (a_digits + b_digits)) | (a_low << BITS * b_digits) | (b_low << BITS * free)


def multiply(a: list, a_digits: int, b: list, b_digits: int) -> list:
    """Least weights over two neighbouring blocks; both are 16 weights, state by state."""
    out: list[int | None] = []
    for i in STATES:
        for j in STATES:
            ways = [joined(a[4 * i + k], a_digits, b[4 * k + j], b_digits) for k in STATES if a[4 * i + k] is not None and b[4 * k + j] is not None]
            out.append(min(ways, default=None))
    return out


def finish(ends: tuple[int | None, ...] | list, digits: int) -> tuple[int, str]:
    """(cost, letters) of the least accepted way, given the weights of the end states; insertions may close it."""
    tail, cost = [0, INSERT << BITS, (INSERT << BITS) | INSERT], [0, COST[INSERT], 2 * COST[INSERT]]
    least = None
    for state, weight in zip(STATES, ends):
        for k in range(3):
            if weight is not None and state in ACCEPTED:
                way = joined(weight, digits, (cost[k] << 2 * BITS) | tail[k], 2)
                least = way if least is None else min(least, way)
            state = NEXT[state]
    return read(least, digits + 2)


def read(weight: int, digits: int) -> tuple[int, str]:
    low = weight & ((1 << BITS * digits) - 1)
    letters = "".join(LETTERS[(low >> BITS * (digits - 1 - k)) & 7] for k in range(digits))
    return weight >> BITS * digits, letters.rstrip("\0")


# --- Rows of one conversation -------------------------------------------------

def fault_of(text: str, met: bool) -> str:
    """First fault of a row: b(lank), d(uplicate), t(runcated) or none."""
    end = text.rstrip(" \t\n\x0b\x0c\r")
    return "b" if not end else "d" if met else "t" if end[-1] not in ".!?" else "-"


def signature(roles: list[str], faults: str) -> str:
    return "".join((role[:1] or "?") + fault for role, fault in zip(roles, faults))


def illegal_pairs(initials: list[str] | str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def apply_edits(letters: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], int]:
    """``role:text`` of the rows that the edits leave, and the state after them."""
    out, k = [], 0
    for letter in letters:
        if letter == "K":
            out.append(f"{roles[k]}:{texts[k]}")
            state = AFTER[state, roles[k][0]]
        elif letter in "IR":
            state = NEXT[state]
            out.append(f"{ROLE_NAME[state]}:{texts[k] if letter == 'R' else ''}")
        k += letter != "I"
    return out, state


DONE = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_one(turns: list, roles: list[str], texts: list[str]) -> tuple:
    """The result columns of one conversation, rows in order."""
    seen: set[tuple[str, str]] = set()
    faults = ""
    for row in zip(roles, texts):
        faults += fault_of(row[1], row in seen)
        seen.add(row)
    whole = signature(roles, faults)
    cost, audit = finish(solve(whole, START), 3 * len(roles))
    known = [t for t in turns if t is not None]
    gaps = known[-1] - known[0] + 1 - len(set(known)) if known else 0
    left, _ = apply_edits(audit, START, roles, texts)
    sha = hashlib.sha256("\n".join(left).encode("utf-8", "surrogatepass")).hexdigest()
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal_pairs([r[:1] for r in roles]), cost, audit, sha


# --- The job ------------------------------------------------------------------

def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row a conversation."""
    rows = damage(conversations)
    id_field = rows.schema["conv_id"]
    head, digest = F.substring("text", 1, 64), F.sha2("text", 256)
    keys = ["conv_id", "turn", "role", "head", "digest"]
    # The last range key spreads equal rows; it is the row's place in its input split.
    dealt = rows.withColumns({"head": head, "digest": digest, "salt": F.monotonically_increasing_id()})
    dealt = dealt.repartitionByRange(*keys, "salt").sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "n")
    fields = T.StructType.fromDDL(f"{DONE}, part int, seq int, turns array<bigint>, roles array<string>, texts array<string>")
    schema = T.StructType([id_field, *fields])
    walked = stage(dealt.mapInArrow(lambda batches: _walk(batches, to_arrow_schema(schema)), schema), "conversations")
    whole = walked.where("part is null").select("conv_id", *T.StructType.fromDDL(DONE).names)
    return whole.unionByName(_in_blocks(walked.where("part is not null").select("conv_id", "part", "seq", "turns", "roles", "texts"), id_field))


def _rows_of(batches: Batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)))


class _Blocks:
    """Collects the rows of a conversation and cuts full blocks off."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.chars = 0

    def add(self, turn, role, text) -> None:
        self.rows.append((turn, role, text))
        self.chars += len(text) + len(role)

    def cut(self, least_rows: int, least_chars: int) -> list[list[tuple]]:
        """Blocks of bounded size once the rows reach a size, and nothing before."""
        if len(self.rows) < least_rows and self.chars < least_chars:
            return []
        out: list[list[tuple]] = [[]]
        size = 0
        for row in self.rows:
            if out[-1] and (len(out[-1]) >= BLOCK_ROWS or size + len(row[2]) > BLOCK_CHARS):
                out.append([])
                size = 0
            out[-1].append(row)
            size += len(row[2])
        self.__init__()
        return out


def _walk(batches: Batches, arrow: pa.Schema) -> Batches:
    """Whole conversations repaired; those at the partition's edges and long ones as blocks."""
    part = TaskContext.get().partitionId()
    out: list[tuple] = []
    weight, seq = 0, 0
    missing = object()
    current, held, edge, long = missing, _Blocks(), True, False
    nothing = (None,) * 8

    def blocks(force: bool) -> Iterator[tuple]:
        nonlocal seq
        # An edge conversation without rows still needs its mark.
        cut = held.cut(0, 0) if force else held.cut(WHOLE_ROWS, WHOLE_CHARS)
        for block in cut:
            turns, roles, texts = zip(*block) if block else ((), (), ())
            yield (current, *nothing, part, seq, list(turns), list(roles), list(texts))
            seq += 1

    def close(last: bool) -> Iterator[tuple]:
        if current is missing:
            return
        if edge or long or last:
            yield from blocks(True)
        else:
            turns, roles, texts = zip(*held.rows) if held.rows else ((), (), ())
            yield (current, *repair_one(list(turns), list(roles), list(texts)), None, None, None, None, None)
            held.__init__()

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    for conv, turn, role, text, n in _rows_of(batches):
        if current is missing or conv != current:
            before = current
            out.extend(close(False))
            current, edge, long = conv, before is missing, False
        if n:
            held.add(turn, role, text)
            cut = list(blocks(False))
            long = long or bool(cut)
            out.extend(cut)
            weight += len(text)
        if len(out) >= 512 or weight > 8 << 20:
            if out:
                yield flush()
            weight = 0
    out.extend(close(True))
    if out:
        yield flush()


def _in_blocks(blocks: DataFrame, id_field: T.StructField) -> DataFrame:
    """The same result for conversations that lie in several blocks."""
    same = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id"))
    # Rows whose role and text stand earlier: narrow rows, grouped by digest; equal ones are combined before the shuffle.
    each = blocks.select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "row"))
    each = each.select("conv_id", F.sha2(F.concat(F.char_length("row.roles"), F.lit(":"), "row.roles", "row.texts"), 256).alias("digest"), F.struct("part", "seq", "pos").alias("place"))
    first = each.groupBy("conv_id", "digest").agg(F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1")
    later = each.alias("l").join(first.alias("r"), same & (F.col("l.digest") == F.col("r.digest"))).where(F.col("place") > F.col("first"))
    later = later.groupBy("place.part", "place.seq").agg(F.collect_list("place.pos").alias("met"))
    marked = blocks.join(later, ["part", "seq"], "left")
    facts = T.StructType.fromDDL("part int, seq int, rows string, weights array<binary>, turns array<bigint>, apart bigint")
    fact_schema = T.StructType([id_field, *facts])
    solved = stage(marked.select("conv_id", "part", "seq", "turns", "roles", "texts", "met").mapInArrow(lambda b: _solve_blocks(b, to_arrow_schema(fact_schema)), fact_schema), "blocks")
    # One task multiplies a conversation's blocks; what it holds is 16 weights of a few bits a row.
    numbers = T.StructType.fromDDL("part int, seq int, letters string, state int, " + DONE.removesuffix(", repaired_sha256 string"))
    chosen_schema = T.StructType([id_field, *numbers])
    chosen = stage(solved.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(lambda b: _choose(b, to_arrow_schema(chosen_schema)), chosen_schema), "edits")
    done_names = T.StructType.fromDDL(DONE).names[:-1]
    pieces_schema = T.StructType([id_field, *T.StructType.fromDDL("part int, seq int, piece string"), *[numbers[name] for name in done_names]])
    edits = chosen.select("part", "seq", "letters", "state", *done_names)
    pieces = blocks.join(edits, ["part", "seq"]).select("conv_id", "part", "seq", "roles", "texts", "letters", "state", *done_names)
    pieces = pieces.mapInArrow(lambda b: _edit_blocks(b, to_arrow_schema(pieces_schema)), pieces_schema)
    # The digest runs over a conversation's pieces in order, one piece in memory.
    final_schema = T.StructType([id_field, *T.StructType.fromDDL(DONE)])
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(lambda b: _digest(b, to_arrow_schema(final_schema)), final_schema)


def _to_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def _pack(weight: int | None) -> bytes | None:
    return None if weight is None else weight.to_bytes(weight.bit_length() // 8 + 1, "big")


def _solve_blocks(batches: Batches, arrow: pa.Schema) -> Batches:
    for batch in batches:
        for k in range(batch.num_rows):
            (conv, part, seq, turns, roles, texts, met), = _rows_of([batch.slice(k, 1)])
            again = set(met or ())
            faults = "".join(fault_of(text, i in again) for i, text in enumerate(texts))
            rows = signature(roles, faults)
            weights = [_pack(w) for start in STATES for w in solve(rows, start)]
            known = [t for t in turns if t is not None]
            yield _to_batch([(conv, part, seq, rows, weights, known[:1] + known[-1:], len(set(known)))], arrow)


def _conversations(batches: Batches) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for row in _rows_of(batches):
        if held and row[0] != held[0][0]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _choose(batches: Batches, arrow: pa.Schema) -> Batches:
    """The edits of every block: the product of all blocks gives the letters, which are cut after each block's last row."""
    for blocks in _conversations(batches):
        layer = [([int.from_bytes(w, "big") if w is not None else None for w in b[4]], 3 * (len(b[3]) // 2)) for b in blocks]
        while len(layer) > 1:
            layer = [(multiply(*layer[i], *layer[i + 1]), layer[i][1] + layer[i + 1][1]) if i + 1 < len(layer) else layer[i] for i in range(0, len(layer), 2)]
        cost, audit = finish(layer[0][0][:4], layer[0][1])
        turns = [t for b in blocks for t in b[5]]
        # A turn that goes on in the next block was counted twice.
        apart, last = 0, None
        for b in blocks:
            if b[5]:
                apart += b[6] - (last == b[5][0])
                last = b[5][1]
        gaps = turns[-1] - turns[0] + 1 - apart if turns else 0
        rows = "".join(b[3] for b in blocks)
        faults = rows[1::2]
        totals = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal_pairs(rows[::2]), cost, audit)
        at, state, out = 0, START, []
        for i, b in enumerate(blocks):
            left, start = b[3][::2], at
            k, entry = 0, state
            while k < len(left) or (i == len(blocks) - 1 and at < len(audit)):
                letter = audit[at]
                if letter != "D":
                    state = AFTER[state, left[k]] if letter == "K" else NEXT[state]
                k += letter != "I"
                at += 1
            out.append((b[0], b[1], b[2], audit[start:at], entry, *(totals if i == 0 else (None,) * 7)))
        yield _to_batch(out, arrow)


def _edit_blocks(batches: Batches, arrow: pa.Schema) -> Batches:
    for batch in batches:
        for k in range(batch.num_rows):
            (conv, part, seq, roles, texts, letters, state, *totals), = _rows_of([batch.slice(k, 1)])
            left, _ = apply_edits(letters, state, roles, texts)
            yield _to_batch([(conv, part, seq, "\n".join(left) if left else None, *totals)], arrow)


def _digest(batches: Batches, arrow: pa.Schema) -> Batches:
    current, sha, totals, any_yet = None, None, None, False
    for conv, _, _, piece, *numbers in _rows_of(small(batches)):
        if sha is None or conv != current:
            if sha is not None:
                yield _to_batch([(current, *totals, sha.hexdigest())], arrow)
            current, sha, totals, any_yet = conv, hashlib.sha256(), numbers, False
        if piece is not None:
            sha.update((("\n" if any_yet else "") + piece).encode("utf-8", "surrogatepass"))
            any_yet = True
    if sha is not None:
        yield _to_batch([(current, *totals, sha.hexdigest())], arrow)


def small(batches: Batches, rows: int = 16) -> Batches:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
