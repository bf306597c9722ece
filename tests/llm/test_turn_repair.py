"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import re
import zlib

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from bookfeel.llm import queries, turn_repair

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
ACCEPTS = re.compile(r"(s?(ua)+)?")


def search(rows):
    """Cheapest edits of [(role, text, must_go, cut)] by Dijkstra over edit strings, least audit first."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, out, turns = heapq.heappop(heap)
        if at == len(rows) and ACCEPTS.fullmatch(out):
            return cost, audit, turns
        state = (at, (len(out), out[:1] == "s") if not out else (out[-1:], out == "s"))
        if state in done:
            continue
        done.add(state)

        def push(price, op, k, role=None, text=""):
            grown = out + (role[:1] if role else "")
            if not role or any(ACCEPTS.fullmatch(grown + rest) for rest in ("", "a", "ua")):
                heapq.heappush(heap, (cost + price, audit + op, at + k, grown, turns + (((role, text),) if role else ())))

        for role in ("user", "assistant"):
            push(2, "I", 0, role)
        if at < len(rows):
            role, text, must_go, cut = rows[at]
            push(3, "D", 1)
            if not must_go:
                if role[:1] in ("s", "u", "a"):
                    push(cut, "K", 1, role, text)
                for other in ("user", "assistant"):
                    push(2 + cut, "R", 1, other, text)


def expected(turns):
    """Digest rows of [(conv, turn, role, text)] by plain Python."""
    by_conv = {}
    for conv, turn, role, text in turns:
        plain = [" " if x is None else x for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{plain[0]}:{plain[1]}".encode()) % 20
        role, text = plain[2], plain[3]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        rows = by_conv.setdefault(conv, [])
        if kind:
            rows += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in by_conv.items():
        def place(r):
            said = r[1].encode() + r[2].encode()
            digest = hashlib.md5(f"{len(r[1].encode())}:".encode() + said).digest()
            return (r[0] is not None, r[0] or 0, r[1].encode(), digest)

        rows.sort(key=place)
        seen, marks, blank, duplicate, truncated = set(), [], 0, 0, 0
        for _, role, text in rows:
            bare = text.rstrip(SPACE)
            is_blank = not bare
            double = (role, text) in seen and not is_blank
            cut = not is_blank and not double and bare[-1] not in ".!?"
            seen.add((role, text))
            blank, duplicate, truncated = blank + is_blank, duplicate + double, truncated + cut
            marks.append((role, text, is_blank or double, int(cut)))
        turns_ = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns_) - min(turns_) + 1 - len(set(turns_)) if turns_ else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, kept = search(marks)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)
    return out


def digests(df):
    repair = turn_repair.Repair(queries.damaged(df), copies=F.col("copies"), gone=F.col("gone"))
    return {r[0]: tuple(r)[1:] for r in repair.digests().collect()}


def test_query_against_search(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    found = {r[0]: tuple(r)[1:] for r in queries.op11(spark, SMALL).collect()}
    assert found == expected([tuple(r) for r in rows])


def test_odd_rows(spark):
    rows = []
    texts = ["Good.", "Cut", "", None, " \t", "What?", "Yes!  ", "x" * 200_000 + ".", "Good."]
    roles = ["user", "assistant", "system", "tool", None, "", "assistant", "user"]
    for conv in [*range(60), None]:
        for k in range((conv or 0) % 9):
            seed = zlib.crc32(f"{conv}/{k}".encode())
            turn = None if seed % 11 == 0 else seed % 7
            rows.append((conv, turn, roles[seed % 8], texts[seed // 8 % 9]))
        if conv is None or conv % 5 == 0:
            rows += [(conv, 3, "user", "Again.")] * 3
    rows += [(None, None, None, None)] * 4
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "conv_id AS conv", "text AS said", "1 AS n", "turn AS place")
    want, got = expected(rows), digests(df)
    assert got == want
    assert digests(df.limit(0)) == {}


def test_hot_conversation_and_edits(spark):
    """One conversation holds most rows; the edits listed are those of the audit."""
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"Turn {i % 500}.") for i in range(4000)]
    rows += [(i, t, "user", "Hello.") for i in range(8, 300) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    repair = turn_repair.Repair(df)
    one = {r["conv"]: r for r in repair.digests().collect()}
    assert one[7]["duplicate"] == 3500 and one[7]["cost"] == 3500 * 3 and one[7]["audit"] == "K" * 500 + "D" * 3500
    assert all(one[i]["audit"] == one[8]["audit"] for i in range(8, 300))
    edits = repair.turns().where("conv in (7, 8)").orderBy("conv", "place").collect()
    for conv in (7, 8):
        mine = [r for r in edits if r["conv"] == conv]
        assert "".join(r["edit"] for r in mine) == one[conv]["audit"]
        text = "\n".join(f"{r['role']}:{r['said']}" for r in mine if r["edit"] != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == one[conv]["repaired_sha256"]


@pytest.mark.parametrize("seed", range(3))
def test_automaton_against_search(seed):
    import random

    draw = random.Random(seed)
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    signatures = {"".join(draw.choice("suaoSUAOX") for _ in range(draw.randrange(9))) for _ in range(150)}
    automaton, last, nodes = turn_repair.Automaton(), "", set()
    for back in sorted(s[::-1] for s in signatures):
        cost, audit = automaton.signature(back, turn_repair._shared(last, back))
        last = back
        rows = [(names.get(x.lower(), "user"), "", x == "X", int(x.isupper() and x != "X")) for x in back[::-1]]
        assert (cost, audit) == search(rows)[:2]
        nodes |= {back[:k] for k in range(1, len(back) + 1)}
    assert automaton.nodes == len(nodes)  # each suffix once
