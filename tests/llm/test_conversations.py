"""Conversation repair against a plain dynamic program over (cost, edits)."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from stationcast.llm import conversations as C
from stationcast.llm import turn_tables as B

WORD = re.compile("[^\x20\x09-\x0d]")
#: Per state: what an added row is, and where it leads.
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def spaced(v):
    return " " if v is None else v


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def brute_edits(rows):
    """rows of (initial, must go, truncated) -> (cost, audit): the least pair from every state, from the end."""
    def relaxed(best):
        for _ in range(4):
            for q in NEXT:
                cost, audit = best[NEXT[q]]
                best[q] = min(best[q], (cost + 2, "I" + audit))
        return best
    best = relaxed({"": (0, ""), "a": (0, ""), "s": (10**9, ""), "u": (10**9, "")})
    for initial, gone, cut in reversed(rows):
        now = {}
        for q in NEXT:
            ways = [(best[q][0] + 3, "D" + best[q][1])]
            if not gone:
                to = best[NEXT[q]]
                ways.append((to[0] + 2 + cut, "R" + to[1]))
                if initial == NEXT[q] or (initial == "s" and q == ""):
                    ways.append((best[initial][0] + cut, "K" + best[initial][1]))
            now[q] = min(ways)
        best = relaxed(now)
    return best[""]


def brute(rows):
    """The contract's row of every conversation, from damaged rows in any order."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        out[conv] = brute_conversation(brute_damage(mine))
    return out


def brute_conversation(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, coded, blank, duplicate, truncated = set(), [], 0, 0, 0
    for _, _, role, text in rows:
        is_blank, again = not WORD.search(text), (role, text) in seen
        seen.add((role, text))
        cut = not is_blank and text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?"
        blank += is_blank
        duplicate += again and not is_blank
        truncated += cut and not again
        coded.append((role[:1], is_blank or again, cut))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:]))
    cost, audit = brute_edits(coded)
    state, at, said = "", 0, []
    for edit in audit:
        if edit == "I":
            said.append(({"u": "user", "a": "assistant"}[NEXT[state]], ""))
        else:
            _, _, role, text = rows[at]
            at += 1
            if edit == "D":
                continue
            said.append((role if edit == "K" else {"u": "user", "a": "assistant"}[NEXT[state]], text))
        state = said[-1][0][0]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in said)) and at == len(rows)
    text = "\n".join(f"{r}:{t}" for r, t in said)
    return (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def planted(seed, conversations=120):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \t", None, "Fine. \n", "Done. ", "a.b", "é."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User", "user2"]
    rows = []
    for conv in [*range(conversations), None]:
        for _ in range(rng.choice([1, 2, 3, 8, 20])):
            turn = rng.choice([None, *range(12), 40])
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts) or rng.choice(["Word.", "", None])))
    return rows + rng.choices(rows, k=40)


def run(spark, tmp_path, rows):
    (spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
     .write.mode("overwrite").parquet(str(tmp_path / "conversations.parquet")))
    got = C.op12(spark, str(tmp_path)).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:] for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_brute_force(spark, tmp_path, seed):
    rows = planted(seed)
    assert run(spark, tmp_path, rows) == brute(rows)


def test_pieces_equal_whole_conversations(spark, tmp_path, monkeypatch):
    # Worker processes read the module anew, so the bound goes with the function.
    rows = planted(3, 4)
    rng = random.Random(4)
    rows += [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B", "C!", f"{t}."])) for t in range(900)]
    pieces = C._pieces
    monkeypatch.setattr(C, "_pieces", lambda batches: pieces(batches, 16))
    assert run(spark, tmp_path, rows) == brute(rows)


def test_a_third_of_all_rows_is_one_row(spark, tmp_path):
    rows = [(1, 5, "user", "Hello.")] * 400 + [(1, 6, "assistant", "Yes.")] + [(c, 0, "user", "Hi.") for c in range(2, 500)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_empty_table_and_other_columns(spark, tmp_path):
    assert run(spark, tmp_path, []) == {}
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 3)],
                                 "conv_id long, turn int, role string, text string, audit string, cost int")
    report = C.repair(rows)
    assert report.first()["audit"] == "KI" and report.first()["cost"] == 2
    said = C.repaired(rows, report).collect()
    assert [(r["place"], r["edit"], r["turn"], r["role"], r["text"]) for r in said] == [
        (1, "K", 0, "user", "Hi."), (2, "I", None, "assistant", "")]


def test_block_tables_equal_single_steps():
    rng = random.Random(5)
    t = B.tables()
    for _ in range(3000):
        rows = [(rng.choice("suuaax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(15))]
        symbols = [B.GONE if gone else 2 * "suax".index(role) + cut for role, gone, cut in rows]
        blocks = t.blocks(np.array(symbols, dtype=np.int64))
        vectors, cost = t.back(blocks)
        edits, state = t.trace(blocks, vectors)
        assert (cost + t.vectors[vectors[-1]][B.START], edits + B.END_EDITS[state]) == brute_edits(rows)
