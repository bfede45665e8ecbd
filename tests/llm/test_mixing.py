"""op11: targets against the rule followed step by step, words taken against a sorted scan, nested budgets, edge cases."""

import hashlib
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from atlasmill.llm import mixing
from tests.llm.data import SCHEMA, frame, rows


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(1, 2, 3), share=1.0, most=3):
    """Reshare the excess until no source is above: the contract's words, in fractions."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = round(share * sum(sizes.values())), set()
    while True:
        rest = sum(weight[s] for s in names if s not in full)
        left = total - sum(most * sizes[s] for s in full)
        now = {s: Fraction(most * sizes[s]) if s in full else Fraction(left * weight[s], rest) for s in names}
        above = {s for s in names if now[s] > most * sizes[s]}
        if not above:
            return {s: float(t) for s, t in now.items()}
        full |= above


def plain(some, **by):
    docs = [(r[0], r[1], r[3], size_of(r[1]), int(hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()[:15], 16)) for r in some]
    sizes = {}
    for d in docs:
        sizes[d[2]] = sizes.get(d[2], 0) + d[3]
    goal, out = targets(sizes, **by), []
    for source, total in sizes.items():
        mine = sorted((d for d in docs if d[2] == source), key=lambda d: d[4])
        whole = int(goal[source] // total) if total else 0
        left, cut = goal[source] - whole * total, -1
        for h in sorted({d[4] for d in mine}):
            n, before = sum(d[3] for d in mine if d[4] == h), sum(d[3] for d in mine if d[4] < h)
            if before + n <= left or n - (left - before) < left - before:
                cut = h
            if before + n > left:
                break
        out += [(d[0], d[3], total, round(goal[source], 6), d[3] * (whole + (d[4] <= cut))) for d in mine]
    return sorted(map(repr, out))


def shown(df):
    return sorted(repr((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"])) for r in df.collect())


@pytest.mark.parametrize(("few", "by"), [(50_000, {}), (0, {}), (50_000, {"share": 0.3}), (50_000, {"share": 2.9, "weights": (5, 1)})])
def test_against_plain(spark, monkeypatch, few, by):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
    some = rows() + [(100 + i, f"t{i % 9} " * (i % 13), None, f"z{i % 40}", 0, None, None) for i in range(300)]
    got = mixing.mix_digests(frame(spark, some), **by)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"] and dict(got.dtypes)["taken"] == "bigint"
    assert shown(got) == plain(some, **by)


def test_rows_keep_their_columns(spark):
    docs = frame(spark).withColumns({"h": F.lit(1), "a.b": F.lit(2), "target": F.lit("x"), "salt": F.lit(3), "row": F.lit(4)})
    got = mixing.mixed(docs)
    assert shown(got) == plain(rows())
    assert sorted(map(repr, got.select("row.*").collect())) == sorted(map(repr, docs.collect()))


def test_budgets_are_nested_and_close(spark):
    some = [(i, "w " * (1 + i * 7919 % 50), None, "hot" if i % 3 else f"s{i % 5}", 0, None, None) for i in range(20_000)]
    docs = frame(spark, some)
    light = mixing.sized(docs)
    small, large = ({(r["doc_id"]): r for r in mixing.apply_plan(light, mixing.mixing_plan(light, share=s)).collect()} for s in (0.4, 1.1))
    assert all(small[i]["taken"] <= large[i]["taken"] <= 3 * large[i]["size"] for i in small)
    for source in ["hot", *(f"s{i}" for i in range(5))]:
        mine = [large[r[0]] for r in some if r[3] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 25


def test_one_hash_in_the_last_bucket(spark):
    """Rows equal in id and text share a hash: they are taken alike, however many they are."""
    some = [(1, "a b c", None, "s", 0, None, None)] * 50 + [(2, "d", None, "s", 0, None, None), (3, None, None, "empty", 0, None, None)]
    assert shown(mixing.mix_digests(frame(spark, some))) == plain(some)


def test_empty(spark):
    assert mixing.mix_digests(spark.createDataFrame([], SCHEMA)).collect() == []
    blank = frame(spark, [(1, None, None, None, 0, None, None), (2, " ", None, "s", 0, None, None)])
    assert shown(mixing.mix_digests(blank)) == ["(1, 0, 0, 0.0, 0)", "(2, 0, 0, 0.0, 0)"]
