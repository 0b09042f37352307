"""Repair of conversations: the cheapest edits that make turns alternate, found by bidirectional Dijkstra over the edit lattice.

A conversation's rows, ordered by turn (where turns tie, by role and the MD5 of the text), have to become one whose role initials match ``(s?(ua)+)?``. Keep costs 0, Rerole (to user or
assistant) 3, Delete 4, Insert (an empty turn of user or assistant) 3; a truncated row that is not deleted costs 3 more; blank rows and repetitions of a role and
text seen earlier have to be deleted. Of the cheapest ways the one with the least audit (the edits' initials in order) is taken.

The lattice has a node for (rows done, state), where the state is what the output ends with: nothing, a system, user or assistant turn. An audit determines
its path, because Rerole and Insert have one legal role in each state. A forward and a reverse heap meet; every crossing whose two costs add up to the
least cost is finished, and the least concatenation of a forward and a reverse label is the audit. Two equally cheap labels of a node are never
prefixes of each other (the rest would be Inserts, which cost), so the least label of a node is a part of the least audit through it. Rows that must be
deleted are left out of the lattice: an Insert beside them comes after them in any least audit.

On Spark: equal rows are counted first; all rows are sorted by ranges, so that a long conversation lies in several partitions, and numbered; pieces of at most
``PIECE`` numbered rows are searched on their own, a conversation of one piece from its start to its end, others between any two states; the pieces' costs and
labels are put together pair by pair. What meets in one task for a conversation is one letter a row and the labels of its pieces, never its texts; an audit
has to fit in a row. Repaired turns come out as rows.

Defined cases: null role and text are one space, null conv_id is a conversation of its own, null turns come first; rows that are equal are repetitions; an initial
other than s, u, a fits nowhere; a conversation without rows costs nothing and stays empty; no rows, no conversations; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm.shared import WORD_PATTERN, materialize, new_path, partitions

#: Rows whose edits are searched together.
PIECE = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: State after a Rerole or an Insert; after a kept row by its initial.
TURNED = (USER, USER, ASSISTANT, USER)
KEPT = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: A row's letter: its initial, a capital where it is truncated; digits for rows that have to go (blank from 0, repeated from 4); a dot where there is no row.
INITIALS = "suax"


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` after the damage that a row's number decides; a dropped row has 0 copies."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(lot == 1, "").when(lot == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return rows.select(
        "conv_id",
        F.when(lot != 0, F.col("turn")).alias("turn"),
        F.when(lot == 0, "").when(lot == 4, "user").otherwise(said("role")).alias("role"),
        F.when(lot == 0, "").otherwise(text).alias("text"),
        F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def plain(rows: DataFrame) -> DataFrame:
    """Rows as they are, in the shape that :func:`repair` takes."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", "turn", said("role"), said("text"), F.lit(1).cast("long").alias("copies"))


def _steps(letter: str) -> list[tuple[int, int, int, str]]:
    """Edges that a row offers: state before, state after, cost, initial of the edit."""
    more = TRUNCATED if letter.isupper() else 0
    found = [(s, s, DELETE, "D") for s in range(4)] + [(s, TURNED[s], REROLE + more, "R") for s in range(4)]
    return found + [(s, t, KEEP + more, "K") for (role, s), t in KEPT.items() if role == letter.lower()]


FORWARD = {x: [[(t, c, e) for s, t, c, e in _steps(x) if s == at] for at in range(4)] for x in "suaxSUAX"}
REVERSE = {x: [[(s, c, e) for s, t, c, e in _steps(x) if t == at] for at in range(4)] for x in "suaxSUAX"}
INSERTED = [[s for s in range(4) if TURNED[s] == at] for at in range(4)]


def _settle(heap: list, label: dict, done: set, other: dict, best: list, edges) -> None:
    """Finish the nearest open node of one side; ``best`` is the least sum of both sides' costs at a node so far."""
    cost, _, node = heappop(heap)
    if node in done:
        return
    done.add(node)
    for to, more, text in edges(node, label[node][1]):
        new = (cost + more, text)
        old = label.get(to)
        if old is None or new < old:  # an open node may still get a lesser label at the same cost
            label[to] = new
            if old is None or new[0] < old[0]:
                heappush(heap, (new[0], to[0], to))
            if to in other:
                best[0] = min(best[0], new[0] + other[to][0])


@lru_cache(maxsize=50_000)
def cheapest(letters: str, start: int = NOTHING, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Least cost and least audit from ``start`` to one of ``ends`` over rows that need not go; None where no edits lead there.

    Nodes are (rows done, state), in the reverse side with the rows negated: at one cost both sides take nodes along the free steps, so that a node's label is final when
    it is taken.
    """
    n = len(letters)

    def ahead(node, label):
        i, s = node
        yield (i, TURNED[s]), INSERT, label + "I"
        if i < n:
            for t, c, e in FORWARD[letters[i]][s]:
                yield (i + 1, t), c, label + e

    def back(node, label):
        i, s = -node[0], node[1]
        for t in INSERTED[s]:
            yield (-i, t), INSERT, "I" + label
        if i > 0:
            for t, c, e in REVERSE[letters[i - 1]][s]:
                yield (1 - i, t), c, e + label

    one, two = {(0, start): (0, "")}, {(-n, s): (0, "") for s in ends}
    heap_one, heap_two = [(0, 0, (0, start))], [(0, -n, (-n, s)) for s in ends]
    seen_one, seen_two = set(), set()
    best = [0 if n == 0 and start in ends else 1 << 60]
    flipped_one, flipped_two = _Flipped(one), _Flipped(two)
    while heap_one and heap_two and heap_one[0][0] + heap_two[0][0] <= best[0]:
        if heap_one[0][0] <= heap_two[0][0]:
            _settle(heap_one, one, seen_one, flipped_two, best, ahead)
        else:
            _settle(heap_two, two, seen_two, flipped_one, best, back)
    if best[0] == 1 << 60:
        return None
    audits = [label + two[-i, s][1] for (i, s), (cost, label) in one.items() if (-i, s) in two and cost + two[-i, s][0] == best[0]]
    return best[0], min(audits)


class _Flipped:
    """The other side's labels under this side's names of the nodes."""

    def __init__(self, label: dict):
        self.label = label

    def __contains__(self, node) -> bool:
        return (-node[0], node[1]) in self.label

    def __getitem__(self, node) -> tuple[int, str]:
        return self.label[-node[0], node[1]]


def _joined(a: dict, b: dict) -> dict:
    """(state, state) -> (cost, audit) over two neighbouring pieces."""
    found: dict = {}
    for (p, q), (c, x) in a.items():
        for (r, s), (d, y) in b.items():
            if q == r and ((p, s) not in found or (c + d, x + y) < found[p, s]):
                found[p, s] = (c + d, x + y)
    return found


def put_together(pieces: list[dict]) -> tuple[int, str]:
    """Least cost and audit over pieces, pair by pair, so that no long label is copied for every piece."""
    while len(pieces) > 1:
        pieces = [_joined(*pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return min(v for (p, q), v in pieces[0].items() if p == NOTHING and q in ENDS)


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs, audits = [], []
        for letters, whole in zip(batch["letters"].to_pylist(), batch["whole"].to_pylist(), strict=True):
            open_ = "".join(x for x in letters if x.isalpha())
            found = [cheapest(open_)] if whole else [cheapest(open_, p, (q,)) for p in range(4) for q in range(4)]
            costs.append([-1 if f is None else f[0] for f in found])
            audits.append(["" if f is None else f[1] for f in found])
        more = [pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "costs", "audits"])


def _initial(letter: str) -> str:
    return INITIALS[int(letter) % 4] if letter.isdigit() else letter.lower()


def conversation(pieces: list[dict]) -> dict:
    """Counts, cost and audit of one conversation, and for every piece what happens to its rows.

    ``edits`` has a letter a row: K, D, or the first letter of the new role; ``before`` has the roles inserted in front of the row as one letter (u, a, U for
    user and assistant, A for assistant and user); ``after`` those behind the last row.
    """
    parts = [{(0, 0): (p["costs"][0], p["audits"][0])} if len(p["costs"]) == 1 else {(k // 4, k % 4): (c, a) for k, (c, a) in enumerate(zip(p["costs"], p["audits"], strict=True)) if c >= 0} for p in pieces]
    cost, steps = put_together(parts)
    out = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": cost, "pieces": []}
    audit: list[str] = []
    state, at, last_initial, turns, least, most = NOTHING, 0, "", 0, None, None
    coded = {"": "-", "u": "u", "a": "a", "ua": "U", "au": "A"}

    def inserts() -> str:
        nonlocal state, at
        roles = ""
        while at < len(steps) and steps[at] == "I":
            state, at = TURNED[state], at + 1
            roles += "ua"[state == ASSISTANT]
            audit.append("I")
        return coded[roles]

    for p in pieces:
        edits, before = [], []
        for letter, n in zip(p["letters"], p["copies"], strict=True):
            if letter == ".":
                edits.append("."), before.append("-")
                continue
            initial = _initial(letter)
            out["illegal"] += (n - 1) + (last_initial != "" and last_initial + initial not in ("su", "ua", "au"))
            last_initial = initial
            if letter.isdigit():
                out["blank" if letter < "4" else "duplicate"] += n
                edits.append("D"), before.append("-")
                audit.append("D" * n)
                cost_of_rest = n
            else:
                out["duplicate"] += n - 1
                out["truncated"] += letter.isupper()
                before.append(inserts())
                edit, at = steps[at], at + 1
                audit.append(edit + "D" * (n - 1))
                if edit == "K":
                    state = KEPT[initial, state]
                elif edit == "R":
                    state = TURNED[state]
                edits.append("ua"[state == ASSISTANT] if edit == "R" else edit)
                cost_of_rest = n - 1
            out["cost"] += DELETE * cost_of_rest
        if p["least"] is not None:
            turns += p["turns"] - (most is not None and most == p["least"])
            least, most = p["least"] if least is None else least, p["most"]
        out["pieces"].append({"piece": p["piece"], "first": p["first"], "last": p["last"], "edits": "".join(edits), "before": "".join(before), "after": "-"})
    out["pieces"][-1]["after"] = inserts()
    if least is not None:
        out["gaps"] = most - least + 1 - turns
    return out | {"audit": "".join(audit)}


PARTS = "piece long, first long, last long, edits string, before string, after string"
RESULT = f"gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces array<struct<{PARTS}>>"
PARTS_ARROW = pa.list_(pa.struct([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in PARTS.split(", ")]))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [conversation(parts) for parts in batch["parts"].to_pylist()]
        kinds = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("pieces", PARTS_ARROW)]
        yield pa.RecordBatch.from_arrays([batch["cid"], *[pa.array([f[name] for f in found], kind) for name, kind in kinds]], names=["cid", *[k for k, _ in kinds]])


def numbered(rows: DataFrame) -> DataFrame:
    """Distinct rows with their copies and their place: places grow with (conv_id, turn, role, MD5 of the text) and are consecutive within a conversation and a partition."""
    n = partitions(rows.sparkSession)
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", F.md5(F.col("text").cast("binary"))]
    ranged = counted.repartitionByRange(n, *order).sortWithinPartitions(*order)
    blank = ~F.col("text").rlike(WORD_PATTERN)
    truncated = ~F.substring(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+$", ""), -1, 1).rlike("[.!?]")
    initial = F.substring("role", 1, 1)
    which = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    pick = lambda letters: F.substring(F.lit(letters), which + 1, F.lit(1))
    letter = F.when(F.col("copies") == 0, ".").when(blank, pick("0123")).when(truncated, pick("SUAX")).otherwise(pick("suax"))
    key = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    return materialize(ranged.select("*", letter.alias("letter"), key.alias("key"), F.monotonically_increasing_id().alias("place")), "turns")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows ``conv_id, turn, role, text, copies``: a row for each conversation with counts, cost, audit and edits by piece, and the numbered rows."""
    placed = numbered(rows)
    lean = placed.drop("text", "role")
    firsts = lean.filter("letter RLIKE '[A-Za-z]'").groupBy("key").agg(F.min("place").alias("seen"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    again = F.col("letter").rlike("[A-Za-z]") & (F.col("place") > F.col("seen"))
    letters = lean.join(firsts, "key", "left").withColumn("letter", F.when(again, F.translate(F.lower("letter"), INITIALS, "4567")).otherwise(F.col("letter")))
    turn = F.when(F.col("letter") != ".", F.col("turn"))
    pieces = (
        letters.groupBy(F.col("conv_id").alias("cid"), F.shiftright("place", PIECE.bit_length() - 1).alias("piece"))
        .agg(
            F.array_sort(F.collect_list(F.struct("place", "letter", "copies"))).alias("rows"),
            F.min(turn).alias("least"),
            F.max(turn).alias("most"),
            F.size(F.collect_set(turn)).cast("long").alias("turns"),
        )
        .select("cid", "piece", F.array_join("rows.letter", "").alias("letters"), F.col("rows.copies").alias("copies"), F.element_at("rows.place", 1).alias("first"), F.element_at("rows.place", -1).alias("last"), "least", "most", "turns")
    )
    pieces = materialize(pieces, "pieces")
    several = pieces.groupBy(F.col("cid").alias("long")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("long", F.lit(True).alias("parted"))
    marked = pieces.join(several, F.col("cid").eqNullSafe(F.col("long")), "left").select(*pieces.columns, F.col("parted").isNull().alias("whole"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema) + ", costs array<long>, audits array<string>"
    searched = marked.mapInArrow(_searched, schema)
    parts = searched.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("piece", "letters", "copies", "first", "last", "least", "most", "turns", "costs", "audits"))).alias("parts"))
    cid = marked.schema["cid"].dataType.simpleString()
    return materialize(parts.mapInArrow(_conversations, f"cid {cid}, {RESULT}"), "conversations").withColumnRenamed("cid", "conv_id"), placed


def repaired_turns(found: DataFrame, placed: DataFrame) -> DataFrame:
    """``conv_id, place, sub, role, text``: the turns of the repaired conversations, in the order of (place, sub)."""
    edits = found.select(F.col("conv_id").alias("cid"), F.explode("pieces").alias("p")).select("cid", "p.*")
    at = (F.col("place") - F.col("first") + 1).cast("int")
    joined = placed.join(edits, (F.shiftright("place", PIECE.bit_length() - 1) == F.col("piece")) & F.col("conv_id").eqNullSafe(F.col("cid")))
    line = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    empty = lambda role: line(F.lit(role), F.lit(""))

    def inserted(code: Column) -> Column:
        u, a = empty("user"), empty("assistant")
        return F.when(code == "u", F.array(u)).when(code == "a", F.array(a)).when(code == "U", F.array(u, a)).when(code == "A", F.array(a, u))

    edit = F.substring(F.col("edits"), at, F.lit(1))
    own = F.when(edit == "K", F.array(line(F.col("role"), F.col("text")))).when(edit == "u", F.array(line(F.lit("user"), F.col("text")))).when(edit == "a", F.array(line(F.lit("assistant"), F.col("text"))))
    none = F.array().cast("array<struct<role:string,text:string>>")
    behind = F.when(F.col("place") == F.col("last"), inserted(F.col("after")))
    lines = F.concat(*[F.coalesce(x, none) for x in (inserted(F.substring(F.col("before"), at, F.lit(1))), own, behind)])
    return joined.select("conv_id", "place", F.posexplode(lines).alias("sub", "line")).select("conv_id", "place", "sub", "line.role", "line.text")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose turns come in order; nothing is kept but the running digest."""
    now, digest = None, None
    ids: list = []
    found: list[str] = []
    schema = None
    for batch in batches:
        schema = batch.schema.field("conv_id").type
        for c, line in zip(batch["conv_id"].to_pylist(), batch["line"].to_pylist(), strict=True):
            if digest is not None and c == now:
                digest.update(b"\n")
            else:
                if digest is not None:
                    ids.append(now), found.append(digest.hexdigest())
                now, digest = c, hashlib.sha256()
            digest.update(line.encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, schema), pa.array(found, pa.string())], names=["cid", "repaired_sha256"])
        ids, found = [], []
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], schema), pa.array([digest.hexdigest()], pa.string())], names=["cid", "repaired_sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """``cid, repaired_sha256`` of each conversation that has turns: lines ``role:text`` joined by line breaks."""
    lines = turns.select("conv_id", "place", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
    sorted_ = lines.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "place", "sub").select("conv_id", "line")
    kind = turns.schema["conv_id"].dataType.simpleString()
    return sorted_.mapInArrow(_hashed, f"cid {kind}, repaired_sha256 string")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, placed = repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))
    hashes = digests(repaired_turns(found, placed))
    nothing = hashlib.sha256().hexdigest()
    return found.join(hashes, found["conv_id"].eqNullSafe(hashes["cid"]), "left").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )


def _sql() -> str:
    """The same by dynamic programming: a state's least (cost, audit, lines) after each row, in one recursive query."""

    def step(v: str, cost: str, edit: str, line: str = "", when: str = "true") -> str:
        lines = f"list_append({v}.t, {line})" if line else f"{v}.t"
        return f"CASE WHEN {v} IS NOT NULL AND {when} THEN {{'c': {v}.c + {cost}, 'a': {v}.a || '{edit}', 't': {lines}}} END"

    def closed(table: str) -> str:
        u = f"list_min([{table}.vu, " + ", ".join(step(f"{table}.{v}", "3", "I", "'user:'") for v in ("v0", "vs", "va")) + "])"
        return f"{table}.v0 AS v0, {table}.vs AS vs, {u} AS vu, {table}.va AS wa"

    user, assistant, own = "'user:' || p.text", "'assistant:' || p.text", "p.role || ':' || p.text"
    free, more = "p.fault NOT IN ('b', 'd')", "(CASE p.fault WHEN 't' THEN 3 ELSE 0 END)"
    drop = lambda v: step(f"x.{v}", "4", "D")
    turn = lambda v, line: step(f"x.{v}", f"3 + {more}", "R", line, free)
    keep = lambda v, role: step(f"x.{v}", more, "K", own, f"{free} AND p.initial = '{role}'")
    new = {
        "v0": [drop("v0")],
        "vs": [drop("vs"), keep("v0", "s")],
        "vu": [drop("vu"), *[turn(v, user) for v in ("v0", "vs", "va")], *[keep(v, "u") for v in ("v0", "vs", "va")]],
        "va": [drop("va"), turn("vu", assistant), keep("vu", "a")],
    }
    value = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])"
    blank = r"[^\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
lots AS (
  SELECT *, xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda d, z: xor(d >> 1, CAST(3988292384 AS BIGINT) * (d & 1))))) % 20 AS lot FROM raw),
damaged AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE lot WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM lots),
seen AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM seen),
placed AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{blank}') THEN 'b' WHEN nth > 1 THEN 'd' WHEN regexp_extract(text, '({blank})[ 	-
]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM counted),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, CAST({{'c': 0, 'a': '', 't': []}} AS {value}) AS v0, CAST(NULL AS {value}) AS vs, CAST(NULL AS {value}) AS vu, CAST(NULL AS {value}) AS va FROM raw
  UNION ALL
  SELECT x.conv_id, p.i, {", ".join(f"CAST(list_min([{', '.join(c)}]) AS {value})" for c in new.values())}
  FROM (SELECT conv_id, i, v0, vs, vu, list_min([wa, {step("y.vu", "3", "I", "'assistant:'")}]) AS va FROM (SELECT w.conv_id, w.i, {closed("w")} FROM walk w) y) x
  JOIN placed p ON p.conv_id IS NOT DISTINCT FROM x.conv_id AND p.i = x.i + 1),
ends AS (
  SELECT conv_id, list_min([v0, wa, {step("y.vu", "3", "I", "'assistant:'")}]) AS best
  FROM (SELECT w.conv_id, {closed("w")} FROM walk w WHERE w.i = (SELECT coalesce(max(p.i), 0) FROM placed p WHERE p.conv_id IS NOT DISTINCT FROM w.conv_id)) y),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM placed GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c AS cost, best.a AS audit, sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


QUERIES = {"op13_repair": op13_repair}
ORACLE = {"op13_repair": _sql()}
