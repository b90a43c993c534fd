"""Repair of the structure of conversations by depth-first branch-and-bound.

The roles of a sound conversation are an optional system turn and then pairs of
user and assistant, ``(s?(ua)+)?`` in initials; none at all is sound too. Turns
can be kept, given another role, deleted, and empty ones inserted, each at a cost;
blank turns and repetitions have to go, and an undeleted truncated turn costs
extra. Of the cheapest ways the one is taken whose edits' initials (the audit)
come first in ASCII order.

The search is depth-first over edits, with an explicit stack. Its children are
taken in the order of their initials, so audits are met in order: of two equally
cheap ways to one node (turn, state of the roles) the one met first is the one to
take, and a node's table keeps the least cost it was reached at and stops all that
don't undercut it. A suffix's lower bound, from the costs of its turns and the
states that roles can be in, prunes what can't undercut the incumbent (cost, audit). When
the stack is empty, the incumbent is optimal.

A conversation's turns are sorted and streamed through one task, which holds the
texts of one conversation of at most ``MAX_TURNS`` turns and ``MAX_CHARS``
characters. Longer ones are numbered by ranges, cut into blocks that many tasks
search, once for each state that they can begin and end in, and put together
block after block by cost and audit. Only the digest of the repaired texts takes a
long conversation's turns one after the other, in a stream: a digest can't be divided.

Null ids, turns, roles and texts: a null id is a conversation of its own, null
turns come first, and null roles and texts are one space. Turns that tie are put in the order
of their roles and texts. An empty role has no initial and can't be kept. Repeated
rows are repetitions. Columns other than the four aren't looked at, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackloom.operators.ranges import running

from .common import check_names, materialize

#: A conversation above either is cut into blocks of MAX_TURNS.
MAX_TURNS, MAX_CHARS = 20_000, 16_000_000
#: States of the roles so far: none, a system turn, user last, assistant last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES, SOUND = (EMPTY, SYSTEM, USER, ASSISTANT), (EMPTY, ASSISTANT)
#: (state, role initial) -> state
_NEXT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that a state asks for, when one is made up.
_ASKS = {EMPTY: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
BLANK, DUPLICATE, TRUNCATED, FINE = "b", "d", "t", "."
LEGAL = frozenset(("su", "ua", "au"))
_SPACE = " \t\n\v\f\r"
_NEVER = 1 << 60
_RESULTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@dataclass(frozen=True)
class Costs:
    """What edits cost. All but keep must be above 0 for insert."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5  # for a truncated turn that isn't deleted


Turn = tuple[str, str]  # initial of the role, fault


def _edits(turn: Turn, state: int, costs: Costs) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, state after) of what can be done with the next turn, in
    the order of the initials; Insert isn't among them."""
    initial, fault = turn
    yield "D", costs.delete, state
    if fault not in (BLANK, DUPLICATE):
        extra = costs.truncated if fault == TRUNCATED else 0
        after = _NEXT.get((state, initial))
        if after is not None:
            yield "K", costs.keep + extra, after
        yield "R", costs.rerole + extra, _ASKS[state][1]


def bounds(turns: Sequence[Turn], goals: Iterable[int], costs: Costs) -> list[list[int]]:
    """For each place and state a lower bound of what the turns from there on
    cost: the edits of the turns one by one, with inserts where they let roles go on."""

    def inserted(row: list[int]) -> list[int]:
        # two inserts lead from user to user; so one before and one after any other state is enough
        for _ in range(2):
            row = [min(row[s], row[_ASKS[s][1]] + costs.insert) for s in STATES]
        return row

    out = [inserted([0 if s in goals else _NEVER for s in STATES])]
    for turn in reversed(turns):
        after = out[-1]
        out.append(inserted([min(cost + after[to] for _, cost, to in _edits(turn, s, costs)) for s in STATES]))
    return out[::-1]


def search(turns: Sequence[Turn], start: int = EMPTY, goals: Iterable[int] = SOUND, costs: Costs = Costs()) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest repair that leads from start to one of the
    goals; of equally cheap ones that with the first audit. None if none does."""
    goals = frozenset(goals)
    bound = bounds(turns, goals, costs)
    n = len(turns)
    best: tuple[int, str] | None = None
    limit = bound[0][start]  # no repair is cheaper, and one of this cost ends the search
    if limit >= _NEVER:
        return None
    table: list[list[int]] = [[_NEVER] * 4 for _ in range(n + 1)]
    path: list[str] = []
    stack = [(0, start, 0, 0, "")]  # turn, state, cost so far, edits so far, last edit
    while stack:
        at, state, cost, depth, edit = stack.pop()
        # what came to this node before has an earlier audit
        if cost >= table[at][state]:
            continue
        if best is not None and cost + bound[at][state] >= best[0]:
            continue
        table[at][state] = cost
        if depth:
            del path[depth - 1 :]
            path.append(edit)
        if at == n and state in goals:
            best = (cost, "".join(path))
            if cost == limit:
                break
        children = [] if at == n else [(at + 1, to, cost + price, depth + 1, e) for e, price, to in _edits(turns[at], state, costs)]
        children.insert(min(1, len(children)), (at, _ASKS[state][1], cost + costs.insert, depth + 1, "I"))  # after D
        # what can't be optimal any more isn't stacked; the last on the stack is taken first
        ceiling = limit if best is None else best[0] - 1
        stack += [c for c in reversed(children) if c[2] + bound[c[0]][c[1]] <= ceiling]
    return best


def apply_audit(audit: str, rows: Iterable[tuple[str, str]], state: int = EMPTY) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired turns."""
    rows = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit in "IR":
            role, state = _ASKS[state]
        elif edit == "K":
            state = _NEXT[state, role[:1]]
        if edit != "D":
            yield role, text


def fault_of(role: str, text: str, seen: set[bytes]) -> str:
    """A turn's first fault; seen holds digests of the turns before it."""
    end = text.rstrip(_SPACE)
    key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
    known = key in seen
    seen.add(key)
    return BLANK if not end else DUPLICATE if known else FINE if end[-1] in ".!?" else TRUNCATED


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, copy int, lost boolean): the rows damaged by
    crc32 of ``conv:turn`` modulo 20. A dropped row stays as a lost one, which
    names its conversation and nothing else."""
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col))
    name = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(name(conv), F.lit(":"), name(turn))) % 20
    rows = df.select(conv.alias("conv"), turn.cast("long").alias("turn"), draw.alias("draw"), name(role).alias("role"), name(text).alias("text"))
    hurt = F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", F.when(F.col("draw") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), hurt.alias("text"), F.explode(copies).alias("copy"), (F.col("draw") == 0).alias("lost"))


def plain(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows as they are, in the form that ``repair`` takes."""
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col))
    return df.select(conv.alias("conv"), turn.cast("long").alias("turn"), F.coalesce(role.cast("string"), F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), F.lit(0).alias("copy"), F.lit(False).alias("lost"))


@dataclass
class Tally:
    """What is told of the turns of a conversation, or of a block of one, in order."""

    turns: list[Turn] = field(default_factory=list)
    seen: set[bytes] = field(default_factory=set)
    illegal: int = 0
    low: int | None = None
    high: int | None = None
    distinct: int = 0

    def add(self, turn: int | None, role: str, text: str, fault: str | None = None) -> None:
        initial = role[:1]
        if self.turns and self.turns[-1][0] + initial not in LEGAL:
            self.illegal += 1
        self.turns.append((initial, fault or fault_of(role, text, self.seen)))
        if turn is not None:
            self.distinct += self.high is None or turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def count(self, fault: str) -> int:
        return sum(f == fault for _, f in self.turns)

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


def _sha(rows: Iterable[tuple[str, str]]) -> str:
    digest, first = hashlib.sha256(), True
    for role, text in rows:
        digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    return digest.hexdigest()


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _grouped(cells: Iterable[tuple], size: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows whose first ``size`` cells are equal."""
    key, rows = None, []
    for row in cells:
        if row[:size] != key:
            if rows:
                yield key, rows
            key, rows = row[:size], []
        rows.append(row)
    if rows:
        yield key, rows


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("copy")]


_FIELDS = [T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]


def _whole(rows: DataFrame, costs: Costs) -> DataFrame:
    """Results of conversations of bounded size, streamed through sorted partitions."""
    schema = T.StructType([rows.schema["conv"], *_FIELDS])

    def solve(conv: object, group: list[tuple]) -> tuple:
        tally, kept = Tally(), [r for r in group if not r[5]]
        for _, turn, role, text, _, _ in kept:
            tally.add(turn, role, text)
        cost, audit = search(tally.turns, costs=costs)
        return (conv, tally.gaps, tally.count(BLANK), tally.count(DUPLICATE), tally.count(TRUNCATED), tally.illegal, cost, audit, _sha(apply_audit(audit, ((r[2], r[3]) for r in kept))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], schema.names)

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal types
            for batch in batches:
                types = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
                yield batch

        for (conv,), group in _grouped(_cells(told()), 1):
            out.append(solve(conv, group))
            if len(out) == 1000:
                yield emit()
                out = []
        if out:
            yield emit()

    dealt = rows.select("conv", "turn", "role", "text", "copy", "lost").repartition("conv").sortWithinPartitions("conv", *_order())
    return dealt.mapInArrow(run, schema)


def _long(rows: DataFrame, costs: Costs, block: int) -> DataFrame:
    """The same for conversations of any length, in blocks of turns."""
    conv_field = rows.schema["conv"]
    rows = rows.where("NOT lost").withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    # a turn's place in its conversation, by ranges of the order; null turns are lower than all others
    place = rows.withColumns({"known": F.col("turn").isNotNull(), "at": F.coalesce("turn", F.lit(0).cast("long"))})
    place = materialize(place.withColumn("tie", F.monotonically_increasing_id()), "turns")  # equal rows are told apart
    place = materialize(running(place, ["conv"], ["known", "at", "role", "text", "copy", "tie"], {"place": F.lit(1).cast("long")}), "places")
    first = place.groupBy("conv", "digest").agg(F.min("place").alias("first"))
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*+\z", 1)
    fault = F.when(end == "", F.lit(BLANK)).when(F.col("place") > F.col("first"), F.lit(DUPLICATE)).when(end.isin(".", "!", "?"), F.lit(FINE)).otherwise(F.lit(TRUNCATED))
    marked = place.withColumnRenamed("conv", "c").join(first.withColumnRenamed("digest", "d"), F.col("c").eqNullSafe(F.col("conv")) & (F.col("digest") == F.col("d")))
    marked = materialize(marked.select("conv", ((F.col("place") - 1) / block).cast("long").alias("block"), "place", "turn", "role", "text", fault.alias("fault")), "faults")

    parts_schema = T.StructType(
        [conv_field, T.StructField("block", T.LongType())]
        + [T.StructField(c, T.LongType()) for c in ("low", "high", "distinct", "blank", "duplicate", "truncated", "illegal")]
        + [T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), T.StructField("ways", T.ArrayType(T.StructType([T.StructField("f", T.IntegerType()), T.StructField("t", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])))]
    )

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        for (conv, number), group in _grouped(_cells(told()), 2):
            tally = Tally()
            for *_, turn, initial, fault in group:
                tally.add(turn, initial, "", fault)
            ways = [(f, t, *found) for f in STATES for t in STATES if (found := search(tally.turns, f, (t,), costs))]
            row = [conv, number, tally.low, tally.high, tally.distinct, tally.count(BLANK), tally.count(DUPLICATE), tally.count(TRUNCATED), tally.illegal, group[0][4], group[-1][4]]
            arrays = [pa.array([v], t) for v, t in zip(row, [kind, *[pa.int64()] * 8, pa.string(), pa.string()], strict=True)]
            way = pa.array([[dict(zip(("f", "t", "cost", "audit"), w, strict=True)) for w in ways]], pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))
            yield pa.RecordBatch.from_arrays([*arrays, way], parts_schema.names)

    few = marked.select("conv", "block", "place", "turn", F.substring("role", 1, 1).alias("initial"), "fault")
    parts = materialize(few.repartition("conv", "block").sortWithinPartitions("conv", "block", "place").mapInArrow(part, parts_schema), "blocks")

    # a row for the whole, and one with each block's part of the audit
    told_schema = T.StructType([conv_field, *_FIELDS[:-1], T.StructField("block", T.LongType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        for (conv,), group in _grouped(_cells(told()), 1):
            best: dict[int, tuple[int, str, tuple]] = {EMPTY: (0, "", ())}
            low = high = None
            distinct, counts, last = 0, [0, 0, 0, 0], None
            for _, _, lo, hi, d, *these, first, end, ways in group:
                counts = [a + b for a, b in zip(counts, these, strict=True)]
                counts[3] += last is not None and last + first not in LEGAL
                last = end
                distinct += d - (lo is not None and lo == high)
                low, high = lo if low is None else low, hi if hi is not None else high
                found: dict[int, tuple[int, str, tuple]] = {}
                for way in ways:
                    if way["f"] in best:
                        cost, audit, ends = best[way["f"]]
                        whole = (cost + way["cost"], audit + way["audit"], (*ends, len(audit) + len(way["audit"])))
                        found[way["t"]] = min(whole, found.get(way["t"], whole))
                best = found
            cost, audit, ends = min(best[s] for s in SOUND if s in best)
            out = [[conv, 0 if low is None else high - low + 1 - distinct, *counts, cost, audit, None]]
            out += [[conv, *[None] * 6, audit[a:b], row[1]] for row, a, b in zip(group, (0, *ends), ends, strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([kind, *[pa.int64()] * 6, pa.string(), pa.int64()])], told_schema.names)

    told = materialize(parts.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(join, told_schema), "told")

    sha_schema = T.StructType([T.StructField("c", conv_field.dataType), T.StructField("repaired_sha256", T.StringType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, conv, sha = None, None, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for c, edits, role, text in _cells([batch]):
                if sha is None or c != conv:
                    if sha is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([sha.hexdigest()])], sha_schema.names)
                    conv, sha, state, first = c, hashlib.sha256(), EMPTY, True
                # the inserts before a turn, and the turn; after the last one there is none
                for r, t in apply_audit(edits, [(role, text)], state):
                    state = _NEXT[state, r[:1]]
                    sha.update(f"{'' if first else chr(10)}{r}:{t}".encode())
                    first = False
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([sha.hexdigest()])], sha_schema.names)

    # each turn's edit with the inserts around it: I*[DKR], those at the end with the last turn
    cut = told.where("block IS NOT NULL").select(F.col("conv").alias("c"), F.col("block").alias("b"), F.posexplode(F.regexp_extract_all("audit", F.lit("(I*+[DKR](?:I++$)?+)"), F.lit(1))).alias("p", "edits"))
    edits = marked.join(cut, F.col("conv").eqNullSafe(F.col("c")) & (F.col("place") - 1 == F.col("b") * block + F.col("p"))).select("conv", "place", "edits", "role", "text")
    shas = edits.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "edits", "role", "text").mapInArrow(digest, sha_schema)
    return told.where("block IS NULL").drop("block").join(shas, F.col("conv").eqNullSafe(F.col("c"))).drop("c")


def repair(rows: DataFrame, conv_name: str = "conv_id", costs: Costs = Costs(), max_turns: int = MAX_TURNS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost long, audit,
    repaired_sha256 string) for each conversation in rows (of ``damage`` or
    ``plain``)."""
    check_names(conv_name, _RESULTS)
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    big = materialize(sizes.where((F.col("n") > max_turns) | (F.col("chars") > max_chars)).select(F.col("conv").alias("c")), "long")
    if big.isEmpty():
        return _whole(rows, costs).withColumnRenamed("conv", conv_name)
    same = F.col("conv").eqNullSafe(F.col("c"))
    # a conversation whose rows are all lost isn't cut into blocks
    found = _long(rows.join(big, same, "left_semi"), costs, max_turns)
    done = found.select(F.col("conv").alias("c"))
    return found.unionByName(_whole(rows.join(big, same, "left_anti"), costs)).unionByName(_whole(rows.join(big, same, "left_semi").where("lost").join(done, same, "left_anti"), costs)).withColumnRenamed("conv", conv_name)


def repair_sql(table: str = "conversations") -> str:
    """DuckDB SQL for ``repair(damage(table))`` at the default costs, at which no
    cheapest repair inserts a turn: it deletes one instead. A conversation's repairs
    go on turn by turn, and of those that leave roles in one state the cheapest stays,
    of equally cheap ones that with the first audit."""
    space = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    return f"""
WITH RECURSIVE named AS (
  SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM {table}
), drawn AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(str_split(name, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda r, v: CASE WHEN v >= 0 THEN xor(r, v) ELSE xor(r // 2, 3988292384 * (r % 2)) END)) % 20 AS draw
  FROM named
), hurt AS (
  SELECT conv, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM (SELECT *, unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS copy FROM drawn WHERE draw <> 0)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS place, rtrim(text, {space}) AS body FROM hurt
), faulty AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY place) > 1 THEN 'd'
                 WHEN right(body, 1) IN ('.', '!', '?') THEN '.' ELSE 't' END AS fault,
         left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY place) AS before
  FROM placed
), told AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS n
  FROM faulty GROUP BY conv
), ways AS (
  SELECT conv, CAST(0 AS BIGINT) AS place, 'e' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit FROM told
  UNION ALL
  SELECT conv, place, state, min(cost), arg_min(audit, (cost, audit)) FROM (
    SELECT w.conv, f.place, o.state, w.cost + o.cost AS cost, w.audit || o.edit AS audit
    FROM ways w JOIN faulty f ON f.conv IS NOT DISTINCT FROM w.conv AND f.place = w.place + 1,
    LATERAL (
      SELECT 'D' AS edit, 2 AS cost, w.state AS state
      UNION ALL SELECT 'K', CASE fault WHEN 't' THEN 5 ELSE 0 END, f.initial
        WHERE fault IN ('t', '.') AND ((f.initial = 's' AND w.state = 'e') OR (f.initial = 'u' AND w.state <> 'u') OR (f.initial = 'a' AND w.state = 'u'))
      UNION ALL SELECT 'R', CASE fault WHEN 't' THEN 6 ELSE 1 END, CASE w.state WHEN 'u' THEN 'a' ELSE 'u' END WHERE fault IN ('t', '.')
    ) o
  ) GROUP BY conv, place, state
), chosen AS (
  SELECT t.conv, min(w.cost) AS cost, arg_min(w.audit, (w.cost, w.audit)) AS audit
  FROM told t JOIN ways w ON w.conv IS NOT DISTINCT FROM t.conv AND w.place = t.n WHERE w.state IN ('e', 'a') GROUP BY t.conv
), kept AS (
  SELECT f.conv, f.place, f.role, f.text, substr(c.audit, f.place, 1) AS edit,
         row_number() OVER (PARTITION BY f.conv ORDER BY f.place) AS k,
         bool_or(f.initial = 's' AND substr(c.audit, f.place, 1) = 'K') OVER (PARTITION BY f.conv) AS led
  FROM faulty f JOIN chosen c ON f.conv IS NOT DISTINCT FROM c.conv WHERE substr(c.audit, f.place, 1) <> 'D'
), shown AS (
  SELECT conv, string_agg((CASE WHEN edit = 'K' THEN role WHEN (k - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY place) AS body
  FROM kept GROUP BY conv
)
SELECT i.conv_id, coalesce(t.gaps, 0) AS gaps, coalesce(t.blank, 0) AS blank, coalesce(t.duplicate, 0) AS duplicate, coalesce(t.truncated, 0) AS truncated,
       coalesce(t.illegal, 0) AS illegal, CAST(coalesce(c.cost, 0) AS BIGINT) AS cost, coalesce(c.audit, '') AS audit, sha256(coalesce(s.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM {table}) i
LEFT JOIN told t ON t.conv IS NOT DISTINCT FROM i.conv_id LEFT JOIN chosen c ON c.conv IS NOT DISTINCT FROM i.conv_id LEFT JOIN shown s ON s.conv IS NOT DISTINCT FROM i.conv_id
"""
