"""Repair of conversations: the cheapest edits that give roles the order of a system turn, if any, and pairs of user and assistant.

A turn is a symbol: the initial of its role, in capitals where the text is truncated, or ``d`` where it must go (blank, or said before).
A conversation's symbols in order are its signature. Signatures are sorted over the cluster, and each task walks its part of their prefix
trie in that order: the nodes of the current path carry their layers of the dynamic program, so a prefix that signatures share is computed
once, and answers are read off at the nodes where signatures end.

A layer has the least cost of each of four states: nothing yet, after a system turn, after a user, after an assistant. Costs relative to
the last of these have few values, since states that another makes useless are struck out (see ``struck``); so layers are numbers, moves
between them are remembered, and a path takes 10 bytes a turn.

Texts are shuffled once, for the repaired turns: a conversation's edits come first in its rows and its turns follow in order, so a task
streams through conversations of any length with no more than a letter a turn in memory.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tuned, written

DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 2, 1, 5, 5
SPACE = " \t\n\x0b\f\r"
#: States: nothing, after system, after user, after assistant; what may end; and where a user or assistant leads.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 20
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a conversation table with seeded faults by crc32(``conv_id:turn``) % 20: 0 drops a turn (dropped is true,
    and its text empty), 1 empties it, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it a user's. Null ids, turns, roles and texts count as one space;
    the ids and turns themselves stay null. Repeated rows are damaged alike."""
    hole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(hole("conv_id"), F.lit(":"), hole("turn"))) % 20
    text = F.when(kind <= 1, "").when(kind == 2, F.translate(hole("text"), ".!?", "")).otherwise(hole("text"))
    role = F.when(kind == 4, "user").otherwise(hole("role"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (kind == 0).alias("dropped"), F.when(kind == 3, 2).otherwise(1).alias("n"))
    return rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")


def digest() -> Column:
    """Tells turns of equal role and text."""
    return F.md5(F.concat_ws(":", F.length("role"), "role", "text"))


# -- the dynamic program over the trie ------------------------------------------------------------------------------------------------


def moves(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of a turn, edits in the order of their letters; insertions aside."""
    out = [("D", DELETE_COST, state)]
    if symbol == "d":
        return out
    more, role = (TRUNCATED_COST if symbol.isupper() else 0), symbol.lower()
    if role == "s" and state == START:
        out.append(("K", more, SYSTEM))
    elif role in "ua" and ROLE[NEXT[state]][0] == role:
        out.append(("K", more, NEXT[state]))
    return [*out, ("R", REROLE_COST + more, NEXT[state])]


def struck(costs: list[int]) -> tuple[tuple[int, ...], int]:
    """Costs relative to the state after an assistant, and that one's. What follows a system turn may follow an assistant, at no more; what
    follows nothing may follow an assistant at two more, for deleting a system turn that only the beginning could keep. States beyond that are never used."""
    for _ in range(2):
        for state, to in NEXT.items():
            costs[to] = min(costs[to], costs[state] + INSERT_COST)
    least = costs[ASSISTANT]
    limit = {START: DELETE_COST, SYSTEM: 0}
    return tuple(c - least if c - least <= limit.get(s, INSERT_COST) else NEVER for s, c in enumerate(costs)), least


class Layers:
    """Layers of relative costs by number, and what has been found out about moves between them."""

    def __init__(self):
        self.costs: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.backs: dict[tuple[int, str, int], int] = {}
        self.first, self.base = self.named(*struck([0, NEVER, NEVER, NEVER]))

    def named(self, costs, least) -> tuple[int, int]:
        if costs not in self.number:
            self.number[costs] = len(self.costs)
            self.costs.append(costs)
        return self.number[costs], least

    def step(self, layer: int, symbol: str) -> tuple[int, int]:
        """The layer after a turn, and by how much its last state's cost is above that of the one before."""
        key = layer, symbol
        if key not in self.steps:
            after = [NEVER] * 4
            for state, cost in enumerate(self.costs[layer]):
                for _, more, to in moves(symbol, state) if cost < NEVER else ():
                    after[to] = min(after[to], cost + more)
            self.steps[key] = self.named(*struck(after))
        return self.steps[key]

    def within(self, layer: int, used: int) -> int:
        """Adds to a set of states (as bits) those from which insertions lead into it at least cost."""
        costs = self.costs[layer]
        for _ in range(2):
            for state, to in NEXT.items():
                if used >> to & 1 and costs[state] < NEVER and costs[state] + INSERT_COST == costs[to]:
                    used |= 1 << state
        return used

    def back(self, layer: int, symbol: str, used: int) -> int:
        """The states of a layer that lie on cheapest ways into ``used`` of the next."""
        key = layer, symbol, used
        if key not in self.backs:
            after, rise = self.step(layer, symbol)
            costs, to_costs = self.costs[layer], self.costs[after]
            found = 0
            for state, cost in enumerate(costs):
                if cost < NEVER and any(used >> to & 1 and cost + more == rise + to_costs[to] for _, more, to in moves(symbol, state)):
                    found |= 1 << state
            self.backs[key] = self.within(layer, found)
        return self.backs[key]


class Path:
    """The current path of the trie: layers and costs of its nodes."""

    def __init__(self):
        self.layers = Layers()
        self.signature, self.nodes, self.cost = "", array("H", [self.layers.first]), array("q", [self.layers.base])
        self.made = 0

    def move_to(self, signature: str) -> None:
        """From one signature to the next in order: back to their common prefix and down."""
        old, shared = self.signature, 0
        most = min(len(old), len(signature))
        while shared < most and old[shared : shared + 64] == signature[shared : shared + 64]:
            shared = min(shared + 64, most)
        while shared < most and old[shared] == signature[shared]:
            shared += 1
        del self.nodes[shared + 1 :], self.cost[shared + 1 :]
        for symbol in signature[shared:]:
            layer, rise = self.layers.step(self.nodes[-1], symbol)
            self.nodes.append(layer)
            self.cost.append(self.cost[-1] + rise)
        self.made += len(signature) - shared
        self.signature = signature

    def answer(self) -> tuple[int, str]:
        """Least cost, and of the cheapest edits those whose letters come first."""
        find, signature = self.layers, self.signature
        last = find.costs[self.nodes[-1]]
        best = min(last[s] for s in ENDS)
        used = bytearray(len(self.nodes))
        used[-1] = find.within(self.nodes[-1], sum(1 << s for s in ENDS if last[s] == best))
        for i in range(len(signature) - 1, -1, -1):
            used[i] = find.back(self.nodes[i], signature[i], used[i + 1])
        state, edits = START, []
        for i in range(len(signature) + 1):
            costs = find.costs[self.nodes[i]]
            while True:
                ways = []
                if i < len(signature):
                    after, rise = find.step(self.nodes[i], signature[i])
                    to_costs = find.costs[after]
                    ways = [(e, to) for e, more, to in moves(signature[i], state) if used[i + 1] >> to & 1 and costs[state] + more == rise + to_costs[to]]
                to = NEXT[state]
                if used[i] >> to & 1 and costs[state] + INSERT_COST == costs[to] and not (ways and ways[0][0] == "D"):
                    edits.append("I")
                    state = to
                    continue
                break
            if ways:
                edits.append(ways[0][0])
                state = ways[0][1]
        return self.cost[-1] + best, "".join(edits)


def _answers(batches):
    path, answer = Path(), (0, "")
    for batch in batches:
        costs, audits = [], []
        for signature in batch.column("signature").to_pylist():
            if signature != path.signature:
                path.move_to(signature)
                answer = path.answer()
            costs.append(answer[0])
            audits.append(answer[1])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", *COUNTS)), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], ["conv_id", *COUNTS, "cost", "audit"])


# -- streams of turns -----------------------------------------------------------------------------------------------------------------


def _signatures(batches):
    """Turns in order -> a row per conversation: counts of faults and the signature."""
    names = ("conv_id", "turn", "digest", "initial", "fault", "dropped", "repeated", "first_turn")
    now, out = None, []

    def closed():
        gaps = now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
        return {"conv_id": now["id"], "gaps": gaps, "signature": now["signature"].decode(), **{c: now[c] for c in COUNTS[1:]}}

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        schema = pa.schema([("conv_id", kind), *[(c, pa.int64()) for c in COUNTS], ("signature", pa.string())])
        for conv, turn, same, initial, fault, dropped, repeated, first in zip(*(batch.column(c).to_pylist() for c in names)):
            if now is None or now["id"] != conv:
                if now is not None:
                    out.append(closed())
                now = {"id": conv, "low": None, "high": None, "turns": 0, "before": None, "initial": None, "signature": bytearray()} | dict.fromkeys(COUNTS[1:], 0)
            if dropped:
                continue
            if turn is not None and turn != now["high"]:
                now["low"] = turn if now["low"] is None else now["low"]
                now["high"], now["turns"] = turn, now["turns"] + 1
            if now["initial"] is not None and now["initial"] + initial not in ("su", "ua", "au"):
                now["illegal"] += 1
            if fault != "blank" and (now["before"] == (turn, same) or repeated and first != turn):
                fault = "duplicate"
            if fault:
                now[fault] += 1
            symbol = "d" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
            now["signature"] += symbol.encode()
            now["before"], now["initial"] = (turn, same), initial
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([closed()], schema=schema)


RESULT = ("conv_id", *COUNTS, "cost", "audit")


def _repaired(batches):
    """A conversation's edits and then its turns in order -> its head again (position 0) and the repaired turns."""
    edits, at, state, position, conv, out = "", 0, START, 0, None, []
    schema = None

    def turn(edit, role, text):
        nonlocal position, state
        position += 1
        state = SYSTEM if state == START and role[0] == "s" else NEXT[state]
        out.append({"conv_id": conv, "position": position, "edit": edit, "role": role, "text": text})

    def inserted():
        nonlocal at
        while at < len(edits) and edits[at] == "I":
            at += 1
            turn("I", ROLE[NEXT[state]], "")

    for batch in batches:
        if schema is None:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *[(c, pa.int64()) for c in (*COUNTS, "cost")], ("audit", pa.string()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        for row in batch.to_pylist():
            if row["head"] == 0:
                inserted()
                edits, at, state, position, conv = row["audit"], 0, START, 0, row["conv_id"]
                out.append({c: row[c] for c in RESULT} | {"position": 0})
                continue
            inserted()
            edit, at = edits[at], at + 1
            if edit == "K":
                turn(edit, row["role"], row["text"])
            elif edit == "R":
                turn(edit, ROLE[NEXT[state]], row["text"])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if schema is not None:
        inserted()
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _digests(batches):
    """``_repaired`` -> a row per conversation with the SHA-256 of its repaired turns."""
    now, out, schema, sha = None, [], None, None
    for batch in batches:
        schema = pa.schema([*[batch.schema.field(c) for c in RESULT], ("repaired_sha256", pa.string())])
        positions, roles, texts = (batch.column(c).to_pylist() for c in ("position", "role", "text"))
        heads = batch.select(list(RESULT)).filter(pc.equal(batch.column("position"), 0)).to_pylist()
        k = 0
        for position, role, text in zip(positions, roles, texts):
            if position == 0:
                if now is not None:
                    out.append(now | {"repaired_sha256": sha.hexdigest()})
                now, sha, k = heads[k], hashlib.sha256(), k + 1
                continue
            sha.update((("\n" if position > 1 else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([now | {"repaired_sha256": sha.hexdigest()}], schema=schema)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def audited(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text, dropped) -> a row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit."""
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    fault = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated")
    small = turns.select("conv_id", "turn", digest().alias("digest"), initial.alias("initial"), fault.alias("fault"), "dropped")
    # a null turn comes first, as it does in the least of structs
    said = small.where("NOT dropped AND NOT fault <=> 'blank'").groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = small.alias("t").join(said.alias("r"), F.expr("t.conv_id <=> r.conv_id AND t.digest = r.digest"), "left")
    marked = marked.select("t.*", F.col("n").isNotNull().alias("repeated"), F.col("first.turn").alias("first_turn"))
    kind = _type(turns, "conv_id")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    stats = marked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest").mapInArrow(_signatures, f"conv_id {kind}, {counts}, signature string")
    stats = written(stats, "signatures")
    # ranges of signature and id, so that a signature of many conversations is spread
    return stats.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature").mapInArrow(_answers, f"conv_id {kind}, {counts}, cost long, audit string")


def _stream(turns: DataFrame) -> DataFrame:
    kind = _type(turns, "conv_id")
    none = {"turn": "long", "digest": "string", "role": "string", "text": "string"}
    heads = audited(turns).select(*RESULT, F.lit(0).alias("head"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    rest = turns.where("NOT dropped").select("conv_id", *[F.lit(None).cast("long").alias(c) for c in (*COUNTS, "cost")], F.lit(None).cast("string").alias("audit"), F.lit(1).alias("head"), "turn", digest().alias("digest"), "role", "text")
    both = heads.union(rest).repartition("conv_id").sortWithinPartitions("conv_id", "head", "turn", "digest")
    counts = ", ".join(f"{c} long" for c in (*COUNTS, "cost"))
    return both.mapInArrow(_repaired, f"conv_id {kind}, {counts}, audit string, position long, edit string, role string, text string")


def repaired(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text, dropped, as ``damage`` gives them) -> conv_id, position (from 1), edit (K, R or I), role, text.

    Turns go by turn, nulls first; those of one turn by an MD5 of role and text, so that equal ones are adjacent. Empty roles and ones of
    other initials than s, u, a can't be kept. Other columns are ignored, a null conv_id is a conversation, an empty table gives an empty result.
    Texts and conversations may be of any length: both are streamed."""
    return _stream(turns).where("position > 0").select("conv_id", "position", "edit", "role", "text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, ties and the like: see ``damage`` and ``repaired``. A conversation of which all turns are dropped has zeros, and an empty audit."""
    turns = damage(tuned(spark).read.parquet(f"{sf_dir}/conversations.parquet"))
    stream = _stream(turns)
    counts = ", ".join(f"{c} long" for c in (*COUNTS, "cost"))
    return stream.mapInArrow(_digests, f"conv_id {_type(stream, 'conv_id')}, {counts}, audit string, repaired_sha256 string")


def _crc(text: str) -> str:
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    digits = f"list_transform(string_split({text}, ''), lambda k: CAST(ord(k) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {digits}), lambda c, b: {bits}), 4294967295)"


def _sql() -> str:
    pair = lambda a, b, e: f"{{'c': {a}.c + {b}, 'a': {a}.a || '{e}'}}"
    least = lambda *x: f"list_sort([{', '.join(x)}])[1]"
    keep = "CASE WHEN sym = upper(sym) THEN 5 ELSE 0 END"
    able = lambda cond, x: f"CASE WHEN {cond} THEN {x} ELSE {{'c': 1000000, 'a': ''}} END"
    to_user = [f"CASE WHEN sym <> 'd' THEN {pair(s, keep + ' + 1', 'R')} ELSE {{'c': 1000000, 'a': ''}} END" for s in ("f0", "f1", "f3")]
    to_user += [able("lower(sym) = 'u'", pair(s, keep, "K")) for s in ("f0", "f1", "f3")]
    row = {
        "g0": pair("f0", "2", "D"),
        "g1": least(pair("f1", "2", "D"), able("lower(sym) = 's'", pair("f0", keep, "K"))),
        "g2": least(pair("f2", "2", "D"), *to_user),
        "g3": least(pair("f3", "2", "D"), able("sym <> 'd'", pair("f2", keep + " + 1", "R")), able("lower(sym) = 'a'", pair("f2", keep, "K"))),
    }
    # of one state and as many turns no edits are the beginning of others at equal cost, so the least of prefixes gives the least of all
    relaxed = f"SELECT id, i, g0 AS f0, g1 AS f1, {least('g2', pair('g0', '5', 'I'), pair('g1', '5', 'I'), pair('g3', '5', 'I'))} AS f2, g3 AS h3"
    return f"""
WITH RECURSIVE k AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
convs AS (SELECT conv_id, row_number() OVER () AS id FROM (SELECT DISTINCT conv_id FROM k)),
d AS (SELECT id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
      FROM k JOIN convs c ON k.conv_id IS NOT DISTINCT FROM c.conv_id WHERE kind > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || ':' || text)) AS i FROM d),
x AS (SELECT *, left(role, 1) AS ini, coalesce(row_number() OVER (PARTITION BY id, role, text ORDER BY i) > 1, FALSE) AS again, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM o),
y AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM x),
z AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN ini NOT IN ('s', 'u', 'a') THEN CASE fault WHEN '' THEN 'x' ELSE 'X' END WHEN fault = '' THEN ini ELSE upper(ini) END AS sym,
             lag(ini) OVER (PARTITION BY id ORDER BY i) || ini AS two FROM y),
st AS (SELECT id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
              count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM convs LEFT JOIN z USING (id) GROUP BY id),
f AS (SELECT id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS f0, {{'c': CAST(1000000 AS BIGINT), 'a': ''}} AS f1, {{'c': CAST(5 AS BIGINT), 'a': 'I'}} AS f2, {{'c': CAST(10 AS BIGINT), 'a': 'II'}} AS f3 FROM convs
      UNION ALL
      SELECT id, i, f0, f1, list_sort([f2, {pair('f3', '5', 'I')}])[1] AS f2, f3 FROM (
        SELECT id, i, f0, f1, f2, {least('h3', pair('f2', '5', 'I'))} AS f3 FROM ({relaxed} FROM (
          SELECT f.id, z.i, {', '.join(f'{v} AS {k}' for k, v in row.items())} FROM f JOIN z ON f.id = z.id AND z.i = f.i + 1)))),
best AS (SELECT f.id, list_sort([f0, f3])[1] AS b FROM f JOIN st ON f.id = st.id AND f.i = st.n),
-- the edit letters, each with the number of its turn and of its line
e AS (SELECT id, unnest(range(1, length(b.a) + 1)) AS p, b.a AS a FROM best),
w AS (SELECT id, p, substr(a, p, 1) AS ed, length(regexp_replace(left(a, p), 'I', '', 'g')) AS i FROM e),
v AS (SELECT w.*, z.role, z.text, row_number() OVER (PARTITION BY w.id ORDER BY p) AS pos FROM w LEFT JOIN z ON w.id = z.id AND w.i = z.i AND ed <> 'I' WHERE ed <> 'D'),
s AS (SELECT id, bool_or(pos = 1 AND ed = 'K' AND left(role, 1) = 's') AS sys FROM v GROUP BY id),
t AS (SELECT v.id, pos, CASE WHEN ed = 'K' THEN role WHEN (pos - CAST(sys AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN ed = 'I' THEN '' ELSE text END AS line FROM v JOIN s USING (id)),
h AS (SELECT id, string_agg(line, chr(10) ORDER BY pos) AS repaired FROM t GROUP BY id)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, b.c AS cost, b.a AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM convs JOIN st USING (id) JOIN best USING (id) LEFT JOIN h USING (id)
"""


OP11_SQL = _sql()
