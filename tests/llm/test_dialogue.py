"""op12: edits against an exhaustive search, digests against a plain version, edge cases."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasmill.llm import dialogue as D
from tests.conftest import SF

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("symbol", T.StringType()), T.StructField("a.b", T.StringType())])
WORD = r"[^\x20\x09-\x0d]"


def cheapest(turns):
    """Cost and letters by an exhaustive search in order of (cost, letters): turns are (initial, fault)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, letters, i, out = heapq.heappop(heap)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", out):
            return cost, letters
        if (i, out, letters) in seen or len(out) > len(turns) + 3:
            continue
        seen.add((i, out, letters))
        for role in "ua":
            heapq.heappush(heap, (cost + 3, letters + "I", i, out + role))
        if i < len(turns):
            initial, fault = turns[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, out))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + more, letters + "K", i + 1, out + initial))
                for role in "ua":
                    heapq.heappush(heap, (cost + more + 3, letters + "R", i + 1, out + role))


FAULTS = ["", "blank", "duplicate", "truncated"]


def test_edits_against_search():
    rng = random.Random(5)
    trie, cases = D.Trie(), []
    for n in range(5):
        for _ in range(60 if n else 1):
            cases.append(tuple((rng.choice("suuaa?"), rng.choice(["", "", "", *FAULTS])) for _ in range(n)))
    keys = sorted({bytes(D.FIRST + 4 * D.ROLES.index(r) + FAULTS.index(f) for r, f in c): c for c in cases}.items())
    for key, case in keys:
        assert trie.insert(key) == cheapest(case), case
    nodes = {key[:n] for key, _ in keys for n in range(1, len(key) + 1)}
    assert trie.layers == len(nodes)  # one layer for each prefix, however many signatures share it


def plain(rows):
    """All columns from the contract's words, one conversation at a time."""
    found = {}
    for conv, turn, role, text, *_ in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        here = found.setdefault(conv, [])
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        here += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = []
    for conv, turns in found.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).digest()))
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        marked = []
        for i, (_, role, text) in enumerate(turns):
            inner = re.findall(WORD, text)
            fault = "blank" if not inner else "duplicate" if (role, text) in [t[1:] for t in turns[:i]] else "truncated" if inner[-1] not in ".!?" else ""
            marked.append((role[:1] if role[:1] in ("s", "u", "a") else "?", fault))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit = D.Trie().insert(bytes(D.FIRST + 4 * D.ROLES.index(r) + FAULTS.index(f) for r, f in marked))
        if len(marked) < 6:
            assert (cost, audit) == cheapest(marked)
        lines, left, state = [], list(turns), ""
        for letter in audit:
            follows = "assistant" if state == "u" else "user"
            role, text = (follows, "") if letter == "I" else left.pop(0)[1:]
            if letter == "D":
                continue
            role = role if letter == "K" else follows
            state = role[0]
            lines.append(f"{role}:{text}")
        n = [sum(f == kind for _, f in marked) for kind in FAULTS[1:]]
        out.append((conv, gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def rows():
    rng = random.Random(9)
    texts = ["Yes.", "No", "Why?", "", " \t", "é!", "...", "a b c. ", "a b c.\x0b", None, " ", "end ", "x" * 50_000 + "."]
    out = []
    for conv in range(60):
        turn = rng.choice([-3, 0, 5])
        for _ in range(rng.choice([1, 2, 3, 4, 5, 9])):
            turn += rng.choice([1, 1, 1, 2, 7])
            out.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]), rng.choice(texts), "x", "y"))
    out += [(70, None, "user", "Hello.", None, None), (70, None, "assistant", "Hi.", None, None), (70, 4, "user", "Hello.", None, None), (71, None, "user", "a", None, None)]
    out += [(72, 1, r, t, None, None) for r in ("user", "assistant") for t in ("One.", "Two.", "One.")] + [out[0], out[0], (None, 1, "user", "Q?", None, None), (None, 2, "assistant", "A.", None, None), (None, None, None, None, None, None)]
    out += [(73, i, "user" if i % 2 == 0 else "assistant", f"Line {i % 7}.", None, None) for i in range(700)]
    return out


@pytest.mark.parametrize("bytes_", [8 << 20, -1])
def test_digests(spark, monkeypatch, bytes_):
    monkeypatch.setattr(D, "BROADCAST_BYTES", bytes_)
    data = rows()
    got = D.repair_digests(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(data)))


def test_repaired_rows(spark):
    data = rows()
    damaged = D.damaged(spark.createDataFrame(data, SCHEMA))
    lines = {}
    for r in sorted(D.repaired(damaged).collect(), key=lambda r: r["position"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, *_, sha in plain(data):
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == sha


def test_empty_and_lost(spark):
    assert D.repair_digests(spark.createDataFrame([], SCHEMA)).collect() == []
    lost = next(t for t in range(10**4) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    (row,) = D.repair_digests(spark.createDataFrame([(1, lost, "user", "a.", "", "")], SCHEMA)).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    got = D.repair_digests(table.withColumn("conv_id", F.col("conv_id"))).collect()
    assert sorted(map(tuple, got)) == sorted(plain([tuple(r)[:4] for r in table.select("conv_id", "turn", "role", "text").collect()]))
