"""Conversation structure repair: Knuth's lightest derivation over rows of a conversation, read as weighted deductions.

Of a conversation's rows in order, each row's fault is found (blank, duplicate, truncated) and the cheapest edits are sought
that leave roles `(s?(ua)+)?`. An item (i, q) stands for all ways to end well from row i on, when the roles before it
have brought the automaton to state q. A deduction takes the reading of row i - 1 (keep, rerole, delete) or an inserted
turn, and an item, and gives another item; its function adds the costs and puts the edit's letter in front of
the audit. It is monotone: of two audits of one item, the lesser stays so behind the same letter. It is superior in
the order (cost, rows spanned, audit), in which all values of one item compare as (cost, audit); so an item popped from
the agenda is final, and the search ends with the goal (0, start).

Conversations may be of any length. Rows are dealt by ranges of their order, so a long one lies in many tasks, and
cut into blocks; a block's lightest ways from each state to each are deductions of the conversation's own, much shorter
agenda, whose letters are the ranks of the audits within a block. Ranks do for audits as those are equally long: no cheapest
repair inserts (5), since with the inserted turn a neighbour can go (2), and a system turn left alone (2); ways through
a block that insert are no part of a cheapest repair either and are left out there. Copies of one row are counted first and
are one run of deletions. What meets in one task for one conversation are its blocks, one at a time, for the hash.

Costs: keep 0, rerole 1, delete 2 (a must for blank and duplicate rows), insert 5, a truncated row that stays 5.

Defined results: a null role or text is one space, so a null text is blank; rows are taken by turn, nulls first, ties by role
and text; a null id is a conversation of its own; a role counts by its first letter, and one that begins with no s, u or a
(or is empty) can't be kept; repeated rows are duplicates; an empty table gives none; texts are read whole; columns beyond
the four play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Fixed values. The automaton of `(s?(ua)+)?`: states nothing yet, after s, after u, after a; (state, role) -> state.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
BACK = {t: [(q, r) for (q, r), x in NEXT.items() if x == t] for t in range(4)}
START, ENDS = 0, (0, 3)
LEGAL = ("su", "ua", "au")
RENAMED = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
SPACES = " \t\n\x0b\x0c\r"

#: Runs of rows and bytes of text of a block.
ROWS, BYTES = 1024, 4 << 20

Item = tuple[int, ...]


def lightest(axioms: Iterable[Item], deduce: Callable[[Item], Iterator[tuple[int, int, str, Item]]], goal: Item | None = None) -> dict[Item, tuple[int, str]]:
    """(cost, audit) of the items popped until the goal is, or of all. deduce(item): cost, rows, letter and head of each deduction."""
    agenda, done = [(0, 0, "", item) for item in axioms], {}
    heapq.heapify(agenda)
    while agenda:
        cost, rows, audit, item = heapq.heappop(agenda)
        if item in done:
            continue
        done[item] = cost, audit
        if item == goal:
            break
        for more, spanned, letter, head in deduce(item):
            if head not in done:
                heapq.heappush(agenda, (cost + more, rows + spanned, letter + audit, head))
    return done


def row_deductions(codes: list[tuple[str, int]]) -> Callable[[Item], Iterator[tuple[int, int, str, Item]]]:
    """Deductions of rows, given as (code, copies); items carry the state in which they end. Codes: b blank, d duplicate, else the
    role's letter (o: other), upper-case if truncated."""

    def deduce(item: Item) -> Iterator[tuple[int, int, str, Item]]:
        i, state, end = item
        if i:
            code, copies = codes[i - 1]
            yield DELETE * copies, 1, "D", (i - 1, state, end)
            if code not in "bd":
                short = CUT_SHORT if code.isupper() else 0
                for before, role in BACK[state]:
                    if role == code.lower():
                        yield short, 1, "K", (i - 1, before, end)
                    elif role in RENAMED:
                        yield short + REROLE, 1, "R", (i - 1, before, end)
        for before, role in BACK[state]:
            if role in RENAMED:
                yield INSERT, 0, "I", (i, before, end)

    return deduce


def ways(codes: list[tuple[str, int]]) -> tuple[list[tuple[int, int, int, int]], list[str]]:
    """Lightest ways through a block: (state, state, cost, rank of the audit), and the audits by rank."""
    done = lightest([(len(codes), q, q) for q in range(4)], row_deductions(codes))
    found = {(q, end): done[0, q, end] for q in range(4) for end in range(4) if (0, q, end) in done and "I" not in done[0, q, end][1]}
    audits = sorted({audit for _, audit in found.values()})
    return [(q, end, cost, audits.index(audit)) for (q, end), (cost, audit) in found.items()], audits


def through(blocks: list[list[tuple[int, int, int, int]]]) -> tuple[int, list[tuple[int, int]]]:
    """The cost of a conversation, and for each block the state it is entered in and the rank of its audit."""

    def deduce(item: Item) -> Iterator[tuple[int, int, str, Item]]:
        b, state = item
        if b:
            for q, end, cost, rank in blocks[b - 1]:
                if end == state:
                    yield cost, 1, chr(ord("a") + rank), (b - 1, q)

    goal = (0, START)
    cost, audit = lightest([(len(blocks), q) for q in ENDS], deduce, goal)[goal]
    state, path = START, []
    for b, letter in enumerate(audit):
        rank = ord(letter) - ord("a")
        path.append((state, rank))
        state = next(end for q, end, _, r in blocks[b] if (q, r) == (state, rank))
    return cost, path


def damage(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with copies, by crc32(conv:turn) % 20: 0 none left, 1 no text, 2 no [.!?], 3 two copies, 4 role user."""
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)))) % 20
    old_role, old_text = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    return rows.select(
        F.col(conv).alias("conv"),
        F.when(kind != 0, F.col(turn)).alias("turn"),
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(old_role).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(old_text, "[.!?]", "")).otherwise(old_text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def undamaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    space = F.lit(" ")
    return rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"), F.lit(1).cast("long").alias("copies"))


_EDGE = "array<struct<q:int,end:int,cost:long,rank:int>>"
_BLOCK = f"part int, block long, total long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, ways {_EDGE}, codes array<struct<code:string,copies:long>>, audits array<string>, roles array<string>, texts array<string>"
#: What a conversation's own agenda needs of a block; the rest follows one block at a time.
_NARROW = ["part", "block", "total", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns", "ways"]


def _code(bare: Column) -> Column:
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(bare == "", "b").when(F.substring(bare, -1, 1).isin(".", "!", "?"), letter).otherwise(F.upper(letter))


class _Block:
    def __init__(self):
        self.total = self.size = self.illegal = self.turns = 0
        self.count = {"b": 0, "d": 0, "t": 0}
        self.first = self.last = self.low = self.high = None
        self.codes, self.roles, self.texts = [], [], []

    def add(self, turn, role: str, text: str, copies: int, code: str, later: bool) -> None:
        initial = role[:1]
        self.illegal += (copies - 1) * (initial + initial not in LEGAL) + (self.last is not None and self.last + initial not in LEGAL)
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.total += copies
        keeps = code != "b" and not later
        if keeps:
            self.codes.append((code, 1))
            self.roles.append(role)
            self.texts.append(text)
            self.size += len(role) + len(text)
            self.count["t"] += code.isupper()
        if copies > keeps:
            gone = code if code == "b" else "d"
            self.codes.append((gone, copies - keeps))
            self.count[gone] += copies - keeps

    def row(self, part: int, block: int) -> list:
        edges, audits = ways(self.codes)
        return [part, block, self.total, self.count["b"], self.count["d"], self.count["t"], self.illegal, self.first, self.last, self.low, self.high, self.turns, edges, self.codes, audits, self.roles, self.texts]


def _schema(ddl_conv: str, ddl: str) -> str:
    return f"conv {ddl_conv}, {ddl}"


def blocks_of(damaged: DataFrame) -> DataFrame:
    """Written blocks of all conversations in the order of their rows; rows without copies leave an empty block."""
    entries = materialize(damaged.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "turns")
    bare = F.rtrim("text", F.lit(SPACES))
    coded = entries.withColumn("code", _code(bare)).withColumn("key", F.when((F.col("code") != "b") & (F.col("copies") > 0), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    # only texts that stand at several turns of a conversation need the first of those
    firsts = coded.where("key IS NOT NULL").groupBy("conv", "key").agg(F.min(when).alias("at"), F.count("*").alias("places")).where("places > 1").select(F.col("conv").alias("_conv"), F.col("key").alias("_key"), "at")
    marked = coded.join(firsts, coded["conv"].eqNullSafe(firsts["_conv"]) & (coded["key"] == firsts["_key"]), "left")
    later = F.coalesce(~F.col("at.turn").eqNullSafe(F.col("turn")), F.lit(False)) & F.col("at").isNotNull()
    rows = marked.select("conv", "turn", "role", "text", "copies", "code", later.alias("later"))
    dealt = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text")
    kinds = dict(rows.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, current, held, out, size = TaskContext.get().partitionId(), 0, None, None, [], 0

        def batch(done: list) -> pa.RecordBatch:
            kinds = {f.name: f.type for f in target}
            columns = list(zip(*done, strict=True))
            arrays = [pa.array([[dict(zip(("q", "end", "cost", "rank"), e, strict=True)) for e in x] for x in c] if n == "ways" else [[{"code": a, "copies": b} for a, b in x] for x in c] if n == "codes" else list(c), kinds[n]) for n, c in zip(target.names, columns, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=target)

        for b in batches:
            target = _target(b.schema.field(0).type)
            for conv, turn, role, text, copies, code, later in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is None or conv != current or len(held.codes) >= ROWS or held.size >= BYTES:
                    if held is not None:
                        out.append([current, *held.row(part, number)])
                        size, number = size + held.size, number + 1
                        if len(out) >= 1000 or size >= BYTES:
                            yield batch(out)
                            out, size = [], 0
                    current, held = conv, _Block()
                if copies:
                    held.add(turn, role, text, copies, code, later)
        if held is not None:
            yield batch([*out, [current, *held.row(part, number)]])

    return materialize(dealt.mapInArrow(cut, _schema(kinds["conv"], _BLOCK)), "blocks")


def _target(conv: pa.DataType) -> pa.Schema:
    edge = pa.list_(pa.struct([("q", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32())]))
    text = pa.list_(pa.string())
    numbers = [(n, pa.int64()) for n in ("block", "total", "blank", "duplicate", "truncated", "illegal")]
    return pa.schema([("conv", conv), ("part", pa.int32()), *numbers, ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("ways", edge), ("codes", pa.list_(pa.struct([("code", pa.string()), ("copies", pa.int64())]))), ("audits", text), ("roles", text), ("texts", text)])


class _Conversation:
    """Faults and edits of one conversation: told from the narrow rows of its blocks; then each block's turns follow."""

    def __init__(self, blocks: list[dict]):
        full = [b for b in blocks if b["total"]]
        self.faults = {n: sum(b[n] for b in full) for n in ("blank", "duplicate", "truncated")}
        self.illegal = sum(b["illegal"] for b in full) + sum(x["last"] + y["first"] not in LEGAL for x, y in zip(full, full[1:], strict=False))
        turned = [b for b in full if b["low"] is not None]
        distinct = sum(b["turns"] for b in turned) - sum(x["high"] == y["low"] for x, y in zip(turned, turned[1:], strict=False))
        self.gaps = turned[-1]["high"] - turned[0]["low"] + 1 - distinct if turned else 0
        self.cost, path = through([[(e["q"], e["end"], e["cost"], e["rank"]) for e in b["ways"]] for b in full])
        self.path = {(b["part"], b["block"]): p for b, p in zip(full, path, strict=True)}

    def repaired(self, block: dict) -> tuple[str, list[tuple[str, str]]]:
        """The audit of a block's rows, and the turns it leaves."""
        if (block["part"], block["block"]) not in self.path:
            return "", []
        state, rank = self.path[block["part"], block["block"]]
        letters, turns, kept = [], [], 0
        for letter, run in zip(block["audits"][rank], block["codes"], strict=True):
            if letter != "D":
                role = run["code"].lower() if letter == "K" else next(r for (q, r), _ in NEXT.items() if q == state and r in RENAMED)
                turns.append((block["roles"][kept] if letter == "K" else RENAMED[role], block["texts"][kept]))
                state = NEXT[state, role]
            kept += run["code"] not in "bd"
            letters.append(letter * run["copies"])
        return "".join(letters), turns


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, _Conversation, Iterator[dict]]]:
    """Of rows sorted by conversation, narrow ones first: each conversation and its blocks, which must be taken before the next."""

    def rows() -> Iterator[dict]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                yield from b.slice(lo, 64).to_pylist()

    stream = rows()
    row = next(stream, None)
    while row is not None:
        conv, narrow = row["conv"], []
        while row is not None and row["conv"] == conv and not row["wide"]:
            narrow.append(row)
            row = next(stream, None)

        def wide() -> Iterator[dict]:
            nonlocal row
            while row is not None and row["conv"] == conv and row["wide"]:  # noqa: B023
                yield row
                row = next(stream, None)

        yield conv, _Conversation(narrow), wide()


def _sorted(blocks: DataFrame) -> DataFrame:
    gone = [F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in blocks.columns if c not in {"conv", *_NARROW}]
    narrow = blocks.select("conv", F.lit(False).alias("wide"), *_NARROW, *gone)
    wide = blocks.select("conv", F.lit(True).alias("wide"), *(F.col(c) if c in ("part", "block") else F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in _NARROW), *(c for c in blocks.columns if c not in {"conv", *_NARROW}))
    return narrow.unionByName(wide).repartition("conv").sortWithinPartitions("conv", "wide", "part", "block")


def repair_report(damaged: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """A row for each conversation: its faults, the cost and audit of its repair, and the hash of what it becomes."""
    blocks = blocks_of(damaged)
    schema = f"`{id_col}` {dict(blocks.dtypes)['conv']}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, kind = [], None

        def seen(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in of:
                kind = b.schema.field(0).type
                yield b

        def batch() -> pa.RecordBatch:
            ids, *rest = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, pa.int64()) for c in rest[:6]), *(pa.array(c, pa.string()) for c in rest[6:])], [id_col, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

        for conv, told, blocks in _conversations(seen(batches)):
            digest, audit, apart = hashlib.sha256(), [], False
            for block in blocks:
                letters, turns = told.repaired(block)
                audit.append(letters)
                for role, text in turns:
                    digest.update((("\n" if apart else "") + role + ":" + text).encode())
                    apart = True
            out.append((conv, told.gaps, *told.faults.values(), told.illegal, told.cost, "".join(audit), digest.hexdigest()))
            if len(out) >= 1000:
                yield batch()
                out = []
        if out:
            yield batch()

    return _sorted(blocks).mapInArrow(report, schema)


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: id, position (from 0), role and text of every turn that is left or new."""
    blocks = blocks_of(undamaged(rows, id_col, turn_col, role_col, text_col))
    schema = f"`{id_col}` {dict(blocks.dtypes)['conv']}, position long, role string, text string"

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def seen(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in of:
                kind = b.schema.field(0).type
                yield b

        for conv, told, blocks in _conversations(seen(batches)):
            at = 0
            for block in blocks:
                _, left = told.repaired(block)
                if left:
                    yield pa.RecordBatch.from_arrays([pa.array([conv] * len(left), kind), pa.array(range(at, at + len(left)), pa.int64()), pa.array([r for r, _ in left]), pa.array([t for _, t in left])], [id_col, "position", "role", "text"])
                at += len(left)

    return _sorted(blocks).mapInArrow(turns, schema)


def op12_repair(spark, sf_dir: str) -> DataFrame:
    return repair_report(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text"))


_CRC = """(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(key, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"""
#: Of the edits all but insertions, which no cheapest repair holds.
OP12_SQL = f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                      coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
     f AS (SELECT *, xor({_CRC}, 4294967295) % 20 AS kind FROM keyed),
     damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                        unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM f WHERE kind <> 0),
     n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
                  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) || role[1] AS pair,
                  rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
     m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM n),
     c AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN bare[-1] IN ('.', '!', '?') THEN 'w' ELSE 't' END AS fault FROM m),
     r AS (SELECT *, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS more, fault IN ('b', 'd') AS gone, role[1] AS x FROM c),
     walk AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': NULL::VARCHAR}} AS s0, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s1,
                     CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s2, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s3
              FROM (SELECT DISTINCT conv_id FROM conversations)
              UNION ALL
              SELECT w.conv_id, w.i + 1,
                     CASE WHEN s0 IS NOT NULL THEN {{'c': s0.c + 2, 'a': s0.a || 'D', 't': s0.t}} END,
                     list_min([CASE WHEN s1 IS NOT NULL THEN {{'c': s1.c + 2, 'a': s1.a || 'D', 't': s1.t}} END,
                               CASE WHEN NOT gone AND x = 's' AND s0 IS NOT NULL THEN {{'c': s0.c + more, 'a': s0.a || 'K', 't': r.role || ':' || r.text}} END]),
                     list_min(list_concat([CASE WHEN s2 IS NOT NULL THEN {{'c': s2.c + 2, 'a': s2.a || 'D', 't': s2.t}} END],
                       list_transform(list_filter([s0, s1, s3], lambda s: s IS NOT NULL AND NOT gone), lambda s:
                         {{'c': s.c + more + CASE WHEN x = 'u' THEN 0 ELSE 1 END, 'a': s.a || CASE WHEN x = 'u' THEN 'K' ELSE 'R' END,
                           't': coalesce(s.t || chr(10), '') || CASE WHEN x = 'u' THEN r.role ELSE 'user' END || ':' || r.text}}))),
                     list_min([CASE WHEN s3 IS NOT NULL THEN {{'c': s3.c + 2, 'a': s3.a || 'D', 't': s3.t}} END,
                               CASE WHEN NOT gone AND s2 IS NOT NULL THEN
                                 {{'c': s2.c + more + CASE WHEN x = 'a' THEN 0 ELSE 1 END, 'a': s2.a || CASE WHEN x = 'a' THEN 'K' ELSE 'R' END,
                                   't': s2.t || chr(10) || CASE WHEN x = 'a' THEN r.role ELSE 'assistant' END || ':' || r.text}} END])
              FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1),
     best AS (SELECT conv_id, list_min(list_filter([s0, s3], lambda s: s IS NOT NULL)) AS s FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
     told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                     count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, s.c AS cost, s.a AS audit, sha256(coalesce(s.t, '')) AS repaired_sha256
FROM best b LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM b.conv_id
"""
