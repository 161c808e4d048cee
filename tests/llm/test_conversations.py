"""Conversation repair against plain Python: every edit sequence in order of cost and letters, and odd tables."""

import hashlib
import heapq
import random
import re
import zlib

from tidemark.llm import conversations as cv

LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(signature):
    """Edits by a search over whole strings of (cost, letters, roles so far), with no states."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, edits, i, roles = heapq.heappop(heap)
        if i == len(signature) and LEGAL.fullmatch(roles):
            return cost, edits
        if (i, roles[-1:], edits) in done or not re.fullmatch(r"s?(ua)*u?", roles):
            continue
        done.add((i, roles[-1:], edits))
        if edits[-2:] != "II":
            heapq.heappush(heap, (cost + 5, edits + "I", i, roles + ("a" if roles[-1:] == "u" else "u")))
        if i < len(signature):
            c = signature[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, roles))
            if c != "d":
                more = 5 if c.isupper() else 0
                heapq.heappush(heap, (cost + more, edits + "K", i + 1, roles + c.lower()))
                for r in "ua":
                    heapq.heappush(heap, (cost + more + 1, edits + "R", i + 1, roles + r))
    return None


def test_answers_of_a_trie():
    r = random.Random(5)
    signatures = sorted({"".join(r.choice("suaxSUAXduaua") for _ in range(r.randrange(0, 7))) for _ in range(400)} | {"", "d", "s", "uauauaua", "suaua"})
    path = cv.Path()
    for s in signatures:
        path.move_to(s)
        assert path.answer() == cheapest(s), s
    assert path.made < sum(map(len, signatures))  # prefixes are shared
    long = "su" + "auUxd" * 20_000
    path.move_to(long)
    cost, edits = path.answer()
    assert len(edits.replace("I", "")) == len(long) and cost > 0 and len(path.layers.costs) < 2000


def plain(rows):
    """op11 of a list of (conv_id, turn, role, text)."""
    groups = {}
    for conv, turn, role, text in rows:
        kept = groups.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        kept += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, kept in groups.items():
        kept.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(f"{len(t[1])}:{t[1]}:{t[2]}".encode()).hexdigest()))
        seen, n, signature = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, ""
        for _, role, text in kept:
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            ini = role[:1] if role[:1] in ("s", "u", "a") else "x"
            signature += "d" if fault in ("blank", "duplicate") else ini.upper() if fault else ini
        turns = [t for t, _, _ in kept if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, edits = cheapest(signature)
        lines, at = [], 0
        for e in edits:
            then = {"": "user", "s": "user", "u": "assistant", "a": "user"}[lines[-1][:1] if lines else ""]
            if e == "I":
                lines.append(then + ":")
                continue
            _, role, text = kept[at]
            at += 1
            if e != "D":
                lines.append((role if e == "K" else then) + ":" + text)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


ODD = [(None, None, None, None), (None, 3, "user", "Hi."), (1, 0, "", "x."), (1, 1, "tool", "Out."), (2, None, "user", "A?"), (2, None, "user", "A?"), (2, 5, "assistant", " \n"), (2, 9, "assistant", "Done! \t"), (3, 0, "user", "long " * 90_000 + "."), (3, 1, "assistant", "ß."), (4, 2, "user", "same."), (4, 2, "user", "same."), (4, 2, "assistant", "same.")]


def test_query_by_brute_force(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, t, r.choice(["user", "assistant", "user", "assistant", "system", None]), r.choice(["Yes.", "No", " ", None, f"Text {i}!", "ok? "])) for i in range(5, 70) for t in range(r.randrange(1, 7))] + ODD
    folder = str(tmp_path)
    schema = "conv_id long, turn long, role string, text string, digest string, head int, dropped string, position string, audit string, n string"
    table = spark.createDataFrame([(*x, *["x", 1], *["x"] * 4) for x in rows], schema)
    table.repartition(5).write.parquet(f"{folder}/conversations.parquet")
    got = {x[0]: tuple(x)[1:] for x in cv.op11_conversation_repair(spark, folder).collect()}
    assert got == plain(rows)
    turns = cv.repaired(cv.damage(table))
    assert turns.columns == ["conv_id", "position", "edit", "role", "text"]
    lines = {}
    for x in turns.orderBy("position").collect():
        lines.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} == {c: x[-1] for c, x in got.items() if x[6].strip("D")}
    assert all(LEGAL.fullmatch("".join(line[0] for line in x)) for x in lines.values())
    table.where("false").write.parquet(f"{folder}/none/conversations.parquet")
    assert cv.op11_conversation_repair(spark, f"{folder}/none").count() == 0
