"""op3, op8, op10 and the pipeline's forms of them against brute force."""

import hashlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from atlasmill.llm import jaccard, substring, suffix
from tests.llm.data import SCHEMA, frame, rows, texts

BIG = (1 << 63) - 1


@pytest.mark.parametrize(("hot", "share"), [(suffix.HOT, suffix.SHARE), (2, 1 << 40), (2, 1), (0, 1), (8, 2)])
def test_repeated_bytes(spark, hot, share):
    count, holders = Counter(), defaultdict(set)
    for r in rows():
        b = (r[1] or "").encode()
        count.update(b[i : i + 400] for i in range(len(b) - 399))
        for i in range(len(b) - 255):
            holders[b[i : i + 256]].add((r[0], b))
    want = []
    for r in rows():
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        shared = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 255):
            if len(holders[b[i : i + 256]]) > 1:
                shared[i : i + 256] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want.append((r[0], len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()).hexdigest(), int(shared.sum())))
    got = [tuple(r) for r in suffix.repeated_bytes_removed(frame(spark), hot, share=share).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert suffix.repeated_bytes_removed(frame(spark, [])).count() == 0


def test_interval_tree_against_pairs():
    rng = np.random.default_rng(2)
    for _ in range(40):
        core = b"CORE"
        contexts, anchors = [], []
        for _ in range(rng.integers(2, 9)):
            left, right = bytes(rng.integers(97, 99, 8).astype(np.uint8)), bytes(rng.integers(97, 99, 8).astype(np.uint8))
            contexts.append(left + core + right)
            anchors.append(8)
        pairs = list(dict.fromkeys(contexts))
        contexts, anchors = pairs, anchors[: len(pairs)]
        if len(contexts) < 2:
            continue
        covered = defaultdict(set)
        for right, members, left, _ in suffix.maximal_repeats(contexts, anchors, 10):
            for m, n in zip(members.tolist(), left.tolist()):
                covered[m] |= set(range(8 - n, 8 + right))
        for i, a in enumerate(contexts):
            want = set()
            for j, b in enumerate(contexts):
                if i != j:
                    left = next((n for n in range(8) if a[7 - n] != b[7 - n]), 8)
                    right = next((n for n in range(12) if a[8 + n] != b[8 + n]), 12)
                    if left + right >= 10:
                        want |= set(range(8 - left, 8 + right))
            assert covered[i] == want


def test_interval_tree_across_documents():
    rng = np.random.default_rng(4)
    for _ in range(60):
        m = int(rng.integers(2, 12))
        contexts = [bytes(rng.integers(97, 99, 6).astype(np.uint8)) + b"CORE" + bytes(rng.integers(97, 99, 6).astype(np.uint8)) for _ in range(m)]
        documents = rng.integers(0, 3, m).astype(np.uint64)
        covered = defaultdict(set)
        for right, members, left, other in suffix.maximal_repeats(contexts, [6] * m, 12, documents, 8):
            for i, n in zip(members.tolist(), left.tolist()):
                covered[other, i] |= set(range(6 - n, 6 + right))
        for other, least in ((0, 12), (1, 8)):
            for i, a in enumerate(contexts):
                want = set()
                for j, b in enumerate(contexts):
                    if i != j and (not other or documents[i] != documents[j]):
                        left = next((n for n in range(6) if a[5 - n] != b[5 - n]), 6)
                        right = next((n for n in range(10) if a[6 + n] != b[6 + n]), 10)
                        if left + right >= least:
                            want |= set(range(6 - left, 6 + right))
                assert covered[other, i] == want


def removed_by_smaller(length):
    data = [(r[0] if r[0] is not None else BIG, (r[1] or "").encode().split()) for r in rows()]
    low = {}
    for did, w in data:
        for i in range(len(w) - length + 1):
            g = tuple(w[i : i + length])
            low[g] = min(low.get(g, BIG), did)
    for (did, w), r in zip(data, rows()):
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - length + 1):
            if low[tuple(w[i : i + length])] < did:
                gone[i : i + length] = True
        yield r, w, gone


@pytest.mark.parametrize(("hot", "share"), [(substring.HOT, substring.SHARE), (2, 1 << 40), (2, 1), (0, 1), (8, 2)])
def test_substring(spark, hot, share):
    want = [(r[0], len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()) for r, w, gone in removed_by_smaller(13)]
    got = [tuple(r) for r in substring.substring_dedup(frame(spark), hot=hot, share=share).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substring.substring_dedup(frame(spark, [])).count() == 0


def test_cut_repeats(spark):
    want = []
    for r, w, gone in removed_by_smaller(50):
        if not gone.any():
            want.append((r[0], r[1].split() if r[1] is not None else None, r[4]))
        elif (~gone).sum() >= 5:
            want.append((r[0], [x.decode() for x, g in zip(w, gone) if not g], None))
    got = substring.cut_repeats(frame(spark))
    assert got.schema.names == SCHEMA.names
    left = [(r.doc_id, r.text.split() if r.text is not None else None) for r in got.collect()]
    assert sorted(left, key=repr) == sorted([x[:2] for x in want], key=repr)
    assert all(r.n_chars == len(r.text) for r in got.where("text is not null and n_chars > 1").collect())


def lower(t):
    return (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()


def groups(k, least):
    sets = []
    for r in rows():
        w = lower(r[1])
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and Fraction(len(a & b), len(a | b)) >= least:
                up[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(sets)):
        members[root(i)].append(i)
    return sets, members


@pytest.mark.parametrize(("k", "least", "chunk", "shingles"), [(4, Fraction(85, 100), 4096, 1 << 20), (5, Fraction(80, 100), 4096, 1 << 20), (5, Fraction(80, 100), 3, 1 << 20), (5, Fraction(80, 100), 100, 500)])
def test_jaccard(spark, k, least, chunk, shingles):
    sets, members = groups(k, least)
    want = []
    for g in members.values():
        ids = [rows()[i][0] for i in g]
        known = [x for x in ids if x is not None]
        want += [(rows()[i][0], len(sets[i]), min(known) if known else None) for i in g]
    got = [tuple(r) for r in jaccard.jaccard_groups(frame(spark), k, least, chunk, shingles).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_any_list_of_common_shingles_gives_the_links():
    rng = np.random.default_rng(6)
    k, least = 4, Fraction(85, 100)
    texts = []
    for _ in range(30):
        base = rng.integers(0, 300, rng.integers(8, 120))
        for _ in range(4):
            w = base.copy()
            w[rng.integers(len(w))] = 999
            texts.append(" ".join(map(str, w if rng.random() < 0.7 else w[: len(w) - 2])).encode())
    buf, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    row, value = jaccard.shingle_sets(buf, offsets, k)
    sets = [set(value[row == i].tolist()) for i in range(len(texts))]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] != sets[j] and Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) >= least]
    assert len(linked) > 20
    for share in (0, 0.3, 0.6, 0.95, 1):
        common = np.unique(value)[rng.random(len(np.unique(value))) < share]
        rows_, signs = jaccard.range_signs(row, value, len(texts), least, jaccard.Common(common) if len(common) else None)
        by_row = [set(signs[rows_ == i].tolist()) for i in range(len(texts))]
        assert all(by_row[i] & by_row[j] for i, j in linked)


def test_one_of_each(spark):
    sets, members = groups(5, Fraction(80, 100))
    got = jaccard.one_of_each(frame(spark))
    assert got.schema.names == SCHEMA.names
    empty = {(rows()[i][0], rows()[i][1]) for i in range(len(sets)) if not sets[i]}
    whole = sum(1 for g in members.values() if sets[g[0]])
    assert got.count() == whole + len(empty)
    assert jaccard.jaccard_groups(frame(spark, [])).count() == 0


def test_tree_overlaps():
    rng = np.random.default_rng(5)
    base = np.sort(rng.choice(200, 60, replace=False)).astype(np.uint64)
    sets = []
    for _ in range(60):
        s = set(base.tolist()) if rng.random() < 0.7 else set(rng.choice(200, 50).tolist())
        for _ in range(rng.integers(0, 8)):
            s ^= {int(rng.integers(200))}
        sets.append(np.array(sorted(s), dtype=np.uint64))
    sets = [np.array(x, dtype=np.uint64) for x in {tuple(s.tolist()) for s in sets}]
    tree = jaccard.PrefixTree(sets)
    for q in range(len(sets)):
        got = jaccard.tree_overlaps(tree, q, Fraction(8, 10))
        for place, k in enumerate(tree.order):
            common = len(np.intersect1d(sets[q], sets[k]))
            linked = Fraction(common, len(sets[q]) + len(sets[k]) - common) >= Fraction(8, 10)
            assert (got[place] == common) if linked else (got[place] in (-1,))


@pytest.mark.parametrize("refine", [32 << 20, 1000])
def test_partitions_of_many_buckets(spark, monkeypatch, refine):
    """Buckets that share partitions, and rows packed for a partition, change no row of any operator."""
    from atlasmill.llm import decontam, jaccard, routing, substring, suffix

    docs, items = frame(spark), spark.createDataFrame([(i, t[:300]) for i, t in enumerate(texts()[:9]) if t], "item_id long, text string")
    work = [lambda: substring.substring_dedup(docs), lambda: substring.substring_dedup(docs, hot=1), lambda: suffix.repeated_bytes_removed(docs), lambda: suffix.repeated_bytes_removed(docs, hot=1), lambda: jaccard.jaccard_groups(docs).drop("group"), lambda: decontam.leaks(docs, items), lambda: substring.cut_repeats(docs, 20)]
    plain = [sorted(map(repr, f().collect())) for f in work]
    monkeypatch.setattr(routing, "BUCKET_BYTES", 400)
    monkeypatch.setattr(routing, "PARTITIONS", 2)
    monkeypatch.setattr(routing, "REFINE_BYTES", refine)
    assert routing.buckets(docs).width > 1
    assert [sorted(map(repr, f().collect())) for f in work] == plain


def test_numbers_of_partitions():
    from atlasmill.llm import routing

    for size, n, width, parts in ((30e9, 895, 1, 895), (1e12, 29803, 6, 4968), (100e12, 2980233, 54, 55190)):
        b = routing.Buckets.of(-(-int(size) // routing.BUCKET_BYTES))
        assert (int(b), b.width, -(-b // b.width)) == (n, width, parts)
        assert size / parts < 2e9
