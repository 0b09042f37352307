"""Repair of conversations against plain dynamic programming, exhaustive search and one row at a time."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tilespark.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?")


def plain(letters, start=0, ends=repair.ENDS):
    """Least (cost, audit) by going over the rows once; at most two turns are worth inserting between two rows."""
    best = {start: (0, "")}

    def inserted(best):
        for _ in range(2):
            for s, (c, a) in list(best.items()):
                t = repair.TURNED[s]
                if t not in best or (c + 3, a + "I") < best[t]:
                    best[t] = (c + 3, a + "I")
        return best

    for x in letters:
        new = {}
        more = 3 if x.isupper() else 0
        for s, (c, a) in inserted(best).items():
            options = [(s, 4, "D"), (repair.TURNED[s], 3 + more, "R")]
            if (x.lower(), s) in repair.KEPT:
                options.append((repair.KEPT[x.lower(), s], more, "K"))
            for t, k, e in options:
                if t not in new or (c + k, a + e) < new[t]:
                    new[t] = (c + k, a + e)
        best = new
    best = inserted(best)
    return min((best[s] for s in ends if s in best), default=None)


def exhaustive(letters):
    """All audits of a short conversation, with at most three turns inserted."""
    found = []
    for k in range(4):
        for spots in itertools.combinations_with_replacement(range(len(letters) + 1), k):
            for edits in itertools.product("KRD", repeat=len(letters)):
                out, audit, cost = "", "", 0
                for i in range(len(letters) + 1):
                    for _ in range(spots.count(i)):
                        out += "a" if out.endswith("u") else "u"
                        audit, cost = audit + "I", cost + 3
                    if i < len(letters):
                        x, e = letters[i], edits[i]
                        out += {"K": x.lower(), "R": "a" if out.endswith("u") else "u", "D": ""}[e]
                        audit += e
                        cost += {"K": 0, "R": 3, "D": 4}[e] + (3 if x.isupper() and e != "D" else 0)
                if LEGAL.fullmatch(out):
                    found.append((cost, audit))
    return min(found)


@pytest.mark.parametrize("n", range(5))
def test_every_short_conversation(n):
    for letters in itertools.product("suaxSUA" if n < 4 else "suaU", repeat=n):
        assert repair.cheapest("".join(letters)) == exhaustive(letters) == plain(letters)


def test_long_conversations_and_any_two_states():
    rng = random.Random(3)
    for _ in range(400):
        letters = "".join(rng.choice("suaxSUAXuaua") for _ in range(rng.randrange(30)))
        assert repair.cheapest(letters) == plain(letters)
        for p in range(4):
            for q in range(4):
                assert repair.cheapest(letters, p, (q,)) == plain(letters, p, (q,))
    letters = "".join(rng.choice("suaUA") for _ in range(3000))
    pieces = [letters[i : i + 100] for i in range(0, 3000, 100)]
    tables = [{(p, q): f for p in range(4) for q in range(4) if (f := repair.cheapest(x, p, (q,)))} for x in pieces]
    assert repair.put_together(tables) == plain(letters)


def by_hand(rows, damage=True):
    """conv_id -> the expected row of the query."""
    out = {}
    for c in {r[0] for r in rows}:
        found = []
        for _, turn, role, text in (r for r in rows if r[0] == c):
            role, text, copies = " " if role is None else role, " " if text is None else text, 1
            lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            if lot == 0:
                continue
            text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
            found += [(turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, marks = set(), []
        for _, role, text in found:
            last = re.findall("[^\\x20\\x09-\\x0D]", text)
            x = role[:1] if role[:1] in ("s", "u", "a") else "x"
            marks.append("b" if not last else "d" if (role, text) in seen else x.upper() if last[-1] not in ".!?" else x)
            seen.add((role, text))
        cost, steps = plain([m for m in marks if m not in "bd"])
        # the edits of rows that must go, before any insert at the same spot
        audit, lines, k, state = "", [], 0, 0
        for (_, role, text), m in [*zip(found, marks, strict=True), ((None, "", ""), "")]:
            if m and m in "bd":
                audit, cost = audit + "D", cost + 4
                continue
            while k < len(steps) and steps[k] == "I":
                state = repair.TURNED[state]
                audit, k = audit + "I", k + 1
                lines.append("assistant:" if state == 3 else "user:")
            if m:
                e = steps[k]
                audit, k = audit + e, k + 1
                if e == "K":
                    state = repair.KEPT[m.lower(), state]
                    lines.append(f"{role}:{text}")
                elif e == "R":
                    state = repair.TURNED[state]
                    lines.append(("assistant:" if state == 3 else "user:") + text)
        turns = [t for t, _, _ in found if t is not None]
        initials = [r[:1] for _, r, _ in found]
        out[c] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            marks.count("b"),
            marks.count("d"),
            sum(m.isupper() for m in marks),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def result(spark, rows, make):
    df = spark.createDataFrame([(*r, "own", 3) for r in rows], "conv_id long, turn long, role string, text string, place string, letter int").repartition(3)
    found, placed = repair.repair(make(df))
    hashes = {r.cid: r.repaired_sha256 for r in repair.digests(repair.repaired_turns(found, placed)).collect()}
    nothing = hashlib.sha256().hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes.get(r.conv_id, nothing)) for r in found.collect()}


def odd_rows():
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "no", "", " \n", None, "Why?", "a!  \t", "Ünd"]
    rows = [(c, rng.choice([None, t, t, t + 3]), rng.choice(roles[: 3 if c % 2 else 6]), rng.choice(texts)) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(None, t % 5, rng.choice(roles), rng.choice(texts)) for t in range(40)]
    rows += [(900, t, ("user", "assistant")[t % 2], f"text {t} " * (5000 if t == 7 else 1) + ".") for t in range(30)] + rows[:20]
    return rows


@pytest.mark.parametrize("damage", [True, False])
def test_rows_against_one_at_a_time(spark, damage):
    rows = odd_rows()
    assert result(spark, rows, repair.damaged if damage else repair.plain) == by_hand(rows, damage)


def test_a_conversation_over_many_pieces(spark):
    rng = random.Random(6)
    rows = [(1, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", f"{t}.", f"{t}"])) for t in range(3000)] + [(2, 1, "user", "x.")] * 700
    assert result(spark, rows, repair.damaged) == by_hand(rows)


def test_no_conversations(spark):
    assert result(spark, [], repair.damaged) == {}


def test_the_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in repair.op13_repair(spark, "/root/testdata/sf0.001").collect()}
    assert got == by_hand(rows)
