"""Exact n-gram Jaccard join over prefix trees, and the groups its links form.

Sets of shingles are ordered by hash, one order for all documents. Candidates: the order is cut into m ranges, with m
above the largest symmetric difference that a linked pair of that size can have, so linked sets agree on at least one
whole range (pigeonhole). Documents meet on ranges that are equal, not on single shingles, and shingles that many sets
hold are left out of the ranges where enough others remain: common lines give hardly any candidates. All sets that meet
somewhere under one smallest set are its star, and any linked pair is in a star. A star's sets become the paths of a
compressed prefix tree: overlaps of shared prefixes are counted once for all sets below, and subtrees that cannot reach
the needed overlap with all their remaining shingles are pruned.

A star of more than CHUNK sets or CHUNK_SHINGLES shingles is dealt to several trees, each with the star's smallest set.
Sets that hang together with that one need no more comparison with each other; only the others are then looked up in
the star's other trees.

Equal sets are one node throughout, so copies never pair up with each other.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasmill.llm.arrays import LOWER, U64, byte_parts, gram_hashes, mix64, odd_numbers, word_hashes, words_of
from atlasmill.llm.routing import Buckets, MISSING, Pack, ROUTED, batches_of, buckets, by_bucket, by_document, document_bucket, keyed, text_hash, with_documents
from atlasmill.llm.suffix import common_prefix
from atlasmill.llm.tables import apart, small_batches
from atlasmill.operators.components import connected_components
from atlasmill.session import materialize

SHINGLE = 4
LEAST = Fraction(85, 100)
#: Sets and shingles of one tree; a larger star is dealt to several.
CHUNK, CHUNK_SHINGLES = 4096, 1 << 20
FLUSH = 2_000_000
#: Large stars up to which their table is broadcast; beyond, it is a shuffled join.
BROADCAST_STARS = 50_000
#: Rare shingles that a set needs, as a share of its size, to be found by them alone.
RARE_SHARE = 0.7
#: Common shingles: sets of one task that hold one to be reported, sets in all, and how many are broadcast.
COMMON_LOCAL, COMMON_LEAST, COMMON_MOST = 4, 16, 1 << 17
INFO, EDGE, SIGN, SETS, ASK, REST = 0, 1, 2, 3, 4, 5
INFOS = Pack(did="<i8", th="<i8", n="<u4", digest="<i8")
EDGES = Pack(src="<i8", dst="<i8")
SIGNS = Pack(key="<u4", digest="<i8")
#: What a tree is built from: role 1 for sets that are looked up, split where the star has other trees.
ASKS = Pack(did="<i8", th="<i8", digest="<i8", star="<i8", block="<i8", role="u1", split="u1")
LEAVES = Pack(digest="<i8", star="<i8", block="<i8", role="u1", split="u1")


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and shingle hashes of a buffer, sorted by both, each pair once. Fewer than k words make one shingle."""
    buf = LOWER[buf]
    starts, ends, rows = words_of(buf, offsets)
    words = word_hashes(buf, starts, ends)
    grams = gram_hashes(words, k, 31)
    whole = np.flatnonzero(rows[: len(grams)] == rows[k - 1 :]) if len(grams) else np.zeros(0, dtype=np.int64)
    base = np.searchsorted(rows, np.arange(len(offsets)))
    count = np.diff(base)
    short = np.flatnonzero((count > 0) & (count < k))
    by = odd_numbers(k, 32)
    few = np.array([int(mix64((words[base[r] : base[r + 1]] * by[: count[r]]).sum(keepdims=True) + U64(count[r]))[0]) for r in short], dtype=U64)
    row, value = np.concatenate((rows[whole], short)), np.concatenate((grams[whole], few))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def size_labels(most: int) -> list[int]:
    """Lower bounds of size classes, each a quarter larger than the last: a linked pair is in one class or two adjacent ones."""
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(max(bounds[-1] + 1, ceil(bounds[-1] * 1.25)))
    return bounds


def range_plan(bounds: list[int], label: int, least: Fraction) -> tuple[int, int, int]:
    """For pairs whose larger set is in class `label`: number of ranges, how many of them may be thin, shingles of a full one.

    A range with fewer than two shingles says little, as common lines fill it; large sets do without such ranges.
    """
    top = bounds[label + 1] - 1
    differ = int(2 * top * (1 - least) / (1 + least))
    if not differ:
        return 0, 0, 1
    full = 2 if top >= 48 else 1
    low, spare = float(least) * bounds[label], 2.0
    for _ in range(12):
        m = differ + 1 + ceil(spare)
        mean = low / m
        thin = m * exp(-mean) * (1 + mean * (full - 1))
        spare = max(2.0, thin + 2.5 * thin**0.5)
        if spare > differ + 4:
            spare = differ + 4
    return differ + 1 + ceil(spare), ceil(spare), full


def rare_plan(bounds: list[int], label: int, least: Fraction) -> tuple[int, int]:
    """Ranges over rare shingles for a size class, and the symmetric difference they must outnumber.

    Few enough that ranges stay long, many enough that a set with RARE_SHARE rare shingles has full ones to spare.
    """
    top = bounds[label + 1] - 1
    differ = int(2 * top * (1 - least) / (1 + least))
    if not differ:
        return 0, 0
    rare, m = RARE_SHARE * float(least) * bounds[label], differ + 1
    while m < 2 * (differ + 1):
        p = 1 - exp(-rare / m)
        if m * p - 2.5 * (m * p * (1 - p)) ** 0.5 > differ + 1:
            break
        m = max(m + 1, ceil(m * 1.05))
    return m, differ


def full_ranges(row: np.ndarray, value: np.ndarray, label: np.ndarray, m: np.ndarray, full: np.ndarray, family: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of the ranges that hold `full` shingles or more; label, m and full are per row, m = 0 leaves a row out."""
    total = np.concatenate(([U64(0)], np.cumsum(mix64(value), dtype=U64)))
    at = np.flatnonzero(m[row] > 0)
    r = row[at]
    part = ((value[at] >> U64(32)) * m[r].astype(U64)) >> U64(32)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(at)) if len(at) else first
    keep = stop - first >= full[r[first]]
    first, stop = first[keep], stop[keep]
    sums = total[at[stop - 1] + 1] - total[at[first]]
    tag = label[r[first]].astype(U64) * U64(0x9E3779B97F4A7C15) + part[first] * U64(0xD6E8FEB86659FD93) + U64(family)
    return r[first], mix64(sums ^ mix64(tag))


def range_signs(row: np.ndarray, value: np.ndarray, n_rows: int, least: Fraction, common: "Common | None" = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) for the full ranges of every set, under its own size class and the next where it can reach that.

    First the ranges of the rare shingles alone: linked sets differ in no more rare shingles than in all, so a set with
    more full ranges than linked sets can differ in shares one with each partner. Only sets with fewer, mostly made of
    common shingles, also sign the ranges of all their shingles; two linked sets either share a rare range or both do.
    A set with more thin ranges than that plan spares may share thin ones only, with sets of the same kind. These sign
    their prefixes: as many shingles, the least common first, as two linked sets can't both lack, and one more.
    """
    size = np.bincount(row, minlength=n_rows)
    bounds = size_labels(int(size.max(initial=1)) * 2)
    last = len(bounds) - 1
    whole = np.array([range_plan(bounds, i, least) if i < last else (0, 0, 1) for i in range(len(bounds))])
    some = np.array([rare_plan(bounds, i, least) if i < last else (0, 0) for i in range(len(bounds))])
    reach = np.array([-(-least.numerator * b // least.denominator) for b in bounds])
    own = np.searchsorted(bounds, size, side="right") - 1
    rare = ~common.holds(value) if common is not None else np.ones(len(value), dtype=bool)
    rare_row, rare_value = row[rare], value[rare]
    labels = [np.minimum(own + up, last) for up in (0, 1)]
    used = [(size > 0) & (size >= reach[label]) for label in labels]
    rows, signs, plain = [], [], np.zeros(n_rows, dtype=bool)
    for label, use in zip(labels, used):
        m, differ = (np.where(use, some[label, j], 0) for j in range(2))
        r, sign = full_ranges(rare_row, rare_value, label, m, np.ones(n_rows, dtype=np.int64), 1)
        plain |= (m > 0) & (np.bincount(r, minlength=n_rows) <= differ)
        rows.append(r)
        signs.append(sign)
    mine, bare = plain[row], np.zeros(n_rows, dtype=bool)
    for label, use in zip(labels, used):
        m, spare, full = (np.where(use & plain, whole[label, j], 0) for j in range(3))
        r, sign = full_ranges(row[mine], value[mine], label, m, full, 0)
        bare |= (m > 0) & (m - np.bincount(r, minlength=n_rows) > spare)
        rows.append(r)
        signs.append(sign)
    r, sign = prefixes(row[bare[row]], value[bare[row]], size, least, common)
    return np.concatenate([*rows, r]), np.concatenate([*signs, sign])


def prefixes(row: np.ndarray, value: np.ndarray, size: np.ndarray, least: Fraction, common: "Common | None") -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of the first n - ceil(least * n) + 1 shingles of each row in one order for all sets, the common ones last."""
    rank = common.rank(value) if common is not None else np.zeros(len(value), dtype=np.int64)
    order = np.lexsort((value, rank, row))
    row, value = row[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    take = place <= size[row] - -(-least.numerator * size[row] // least.denominator)
    return row[take], mix64(value[take] ^ U64(0x5A5A5A5A5A5A5A5A))


class Common:
    """The common shingles' hashes, given most common first, with a bitmap that settles most lookups."""

    def __init__(self, values: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.values, self.place = values[order], len(values) - order
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(self.values >> U64(42)).astype(np.int64)] = True

    def holds(self, value: np.ndarray) -> np.ndarray:
        out = self.maybe[(value >> U64(42)).astype(np.int64)]
        at = np.flatnonzero(out)
        place = np.minimum(np.searchsorted(self.values, value[at]), len(self.values) - 1)
        out[at] = self.values[place] == value[at]
        return out


    def rank(self, value: np.ndarray) -> np.ndarray:
        """0 where a shingle is not common, else the higher the more common it is."""
        at = np.minimum(np.searchsorted(self.values, value), len(self.values) - 1)
        return np.where(self.values[at] == value, self.place[at], 0)


def common_shingles(rows: DataFrame, k: int, most: int = COMMON_MOST) -> np.ndarray:
    """Hashes of the shingles that most sets hold, `most` at most.

    The list steers the choice of ranges only: any list gives the same links, a good one gives few false candidates.
    A task counts its different sets and reports shingles of COMMON_LOCAL sets or more.
    """

    def count(batches):
        held, size, seen = [], 0, np.zeros(0, dtype=np.int64)

        def report():
            value, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= COMMON_LOCAL
            return pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(n[often])], names=["shingle", "n"])

        for batch in batches:
            for _, buf, offsets in byte_parts(batch.column("text"), 1 << 20):
                row, value = shingle_sets(buf, offsets, k)
                digest = set_digests(row, value, len(offsets) - 1)
                fresh = np.zeros(len(digest), dtype=bool)
                fresh[np.unique(digest, return_index=True)[1]] = True
                fresh &= ~np.isin(digest, seen)
                seen = np.union1d(seen, digest[fresh])
                held.append(value[fresh[row]])
                size += len(held[-1])
                if size >= 2 * FLUSH:
                    yield report()
                    held, size = [], 0
        if size:
            yield report()

    counted = rows.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") >= COMMON_LEAST).orderBy(F.desc("n"), "shingle").limit(most).select("shingle")
    return np.array([r["shingle"] for r in top.collect()], dtype=np.int64).view(U64)


def set_digests(row: np.ndarray, value: np.ndarray, n_rows: int) -> np.ndarray:
    """A signed 64-bit digest of each row's set."""
    import xxhash

    edge = np.searchsorted(row, np.arange(n_rows + 1))
    view = memoryview(value.tobytes())
    return np.array([xxhash.xxh3_64_intdigest(view[8 * s : 8 * e], seed=41) for s, e in zip(edge[:-1].tolist(), edge[1:].tolist())], dtype=U64).astype(np.int64)


def find_signs(rows: DataFrame, n_keys: Buckets, k: int, least: Fraction, common: np.ndarray) -> DataFrame:
    held_common = rows.sparkSession.sparkContext.broadcast(common)

    def send(keys, digests, infos):
        key, digest = np.concatenate(keys), np.concatenate(digests)
        pair = {"key": (key >> U64(32)).astype(np.uint32), "digest": digest}
        out = SIGNS.split(pair, (key % U64(n_keys)).astype(np.int32), SIGN, n_keys.width) if len(key) else []
        info = {f: np.concatenate([i[f] for i in infos]) for f in INFOS.fields}
        return out + INFOS.split(info, (info["th"] % n_keys).astype(np.int32), INFO, n_keys.width)

    def run(batches):
        keys, digests, infos, seen, held = [], [], [], np.zeros(0, dtype=np.int64), 0
        often = Common(held_common.value) if len(held_common.value) else None
        for batch in batches:
            did, th = batch.column("did").to_numpy(), batch.column("th").to_numpy()
            for at, buf, offsets in byte_parts(batch.column("text"), 1 << 20):
                n = len(offsets) - 1
                row, value = shingle_sets(buf, offsets, k)
                digest = set_digests(row, value, n)
                infos.append({"did": did[at : at + n], "th": th[at : at + n], "n": np.bincount(row, minlength=n), "digest": digest})
                # Sets this task has signed already need no second signature.
                fresh = np.zeros(n, dtype=bool)
                fresh[np.unique(digest, return_index=True)[1]] = True
                fresh &= ~np.isin(digest, seen)
                seen = np.union1d(seen, digest[fresh])
                r, sign = range_signs(row, value, n, least, often)
                go = fresh[r]
                keys.append(sign[go])
                digests.append(digest[r[go]])
                held += int(go.sum())
                if held >= FLUSH:
                    yield from batches_of(send(keys, digests, infos))
                    keys, digests, infos, held = [], [], [], 0
        if infos:
            yield from batches_of(send(keys, digests, infos))

    return rows.select("did", "th", "text").mapInArrow(run, ROUTED)


def meet_on_signs(routed: DataFrame, n_keys: Buckets) -> DataFrame:
    """Candidate edges from the sets that share a signature to the smallest of them; the documents' sizes and digests pass through."""

    def work(got):
        rows = [(0, INFO, b) for b in got.get(INFO, [])]
        s = SIGNS.load(got.get(SIGN, []))
        if len(s["key"]):
            order = np.lexsort((s["digest"], s["key"]))
            key, digest = s["key"][order], s["digest"][order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            lead = np.repeat(digest[first], np.diff(np.append(first, len(key))))
            other = digest != lead
            pairs = np.unique(np.stack([lead[other], digest[other]]), axis=1)
            if pairs.shape[1]:
                rows.append((0, EDGE, EDGES.dump({"src": pairs[0], "dst": pairs[1]})))
        return rows

    return by_bucket(routed, n_keys, work)


def unpack(routed: DataFrame, kind: int, pack: Pack, schema: str) -> DataFrame:
    """Rows of the packed arrays of one kind."""

    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                got = pack.load([blob])
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in got.values()], names=list(got))

    return routed.where(F.col("kind") == kind).select("data").mapInArrow(run, schema)


class PrefixTree:
    """Compressed prefix tree of sets, as arrays. Shingles that more sets hold come first, so that prefixes are shared.

    Sets are sorted paths; each set owns the edge below the prefix it shares with its predecessor. `own` are the
    shingles on those edges, `parent` the set on whose edge it hangs, `attach` how many shingles of that edge it shares.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(values), dtype=np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(values))
        self.universe, edge = len(values), np.concatenate(([0], np.cumsum(self.size)))
        self.ids = [np.sort(rank[inverse[a:b]]) for a, b in zip(edge[:-1], edge[1:])]
        paths = [x.astype(">u4").tobytes() for x in self.ids]
        self.order = sorted(range(len(sets)), key=paths.__getitem__)
        own, start, parent, attach, level, depth = [], [0], [], [], [], []
        path: list[tuple[int, int]] = []
        for i, k in enumerate(self.order):
            shared = common_prefix(paths[self.order[i - 1]], paths[k]) // 4 if i else 0
            while path and path[-1][1] >= shared:
                path.pop()
            holder, begin = path[-1] if path else (-1, shared)
            parent.append(holder)
            attach.append(shared - begin)
            level.append(level[holder] + 1 if path else 0)
            depth.append(shared)
            own.append(self.ids[k][shared:])
            start.append(start[-1] + len(own[-1]))
            path.append((i, shared))
        self.own = np.concatenate(own)
        self.start, self.parent, self.attach, self.depth = (np.array(x, dtype=np.int64) for x in (start, parent, attach, depth))
        level = np.array(level)
        self.levels = [np.flatnonzero(level == v) for v in range(int(level.max()) + 1)]
        self.longest = self.size[self.order].copy()
        self.shortest = self.longest.copy()
        for i in range(len(parent) - 1, -1, -1):
            if parent[i] >= 0:
                self.longest[parent[i]] = max(self.longest[parent[i]], self.longest[i])
                self.shortest[parent[i]] = min(self.shortest[parent[i]], self.shortest[i])


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def tree_overlaps(tree: PrefixTree, query: int, least: Fraction) -> np.ndarray:
    """Overlap of one set with every set of the tree (in tree order); -1 where a bound pruned it.

    Going down level by level, an edge starts with the overlap its parent had where it branches off. It is dropped,
    with all below it, when even a match of all remaining shingles stays under the needed overlap.
    """
    mask = np.zeros(tree.universe, dtype=np.int64)
    mask[tree.ids[query]] = 1
    along = np.concatenate(([0], np.cumsum(mask[tree.own])))
    begin, total = np.zeros(len(tree.order), dtype=np.int64), np.full(len(tree.order), -1)
    size, mine = tree.size[tree.order], tree.size[query]
    num, den = least.numerator, least.numerator + least.denominator

    def need(other):
        return -((-num * (other + mine)) // den)

    alive = np.ones(len(tree.order), dtype=bool)
    for here in tree.levels:
        up = tree.parent[here]
        if up[0] >= 0:
            keep = alive[up]
            alive[here[~keep]] = False
            here, up = here[keep], up[keep]
            begin[here] = begin[up] + along[tree.start[up] + tree.attach[here]] - along[tree.start[up]]
        bound = begin[here] + np.minimum(mine - begin[here], tree.longest[here] - tree.depth[here])
        reach = bound >= need(tree.shortest[here])
        alive[here[~reach]] = False
        here = here[reach]
        total[here] = begin[here] + along[tree.start[here + 1]] - along[tree.start[here]]
    total[total < need(size)] = -1
    return total


def linked_forest(sets: list[np.ndarray], least: Fraction, first: int | None = None, queries: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect exactly the groups that all links (of the queries, where given) connect.

    Sets linked to the first query need no query of their own: any link between two groups has an end outside.
    """
    n = len(sets)
    tree, groups, links = PrefixTree(sets), Union(n), []
    order = np.array(tree.order)
    left = n - 1
    if queries is None:
        lead = first if first is not None else int(np.argsort(tree.size, kind="stable")[n // 2])
        queries = [lead, *(i for i in range(n) if i != lead)]
    else:
        lead = None
    spared: set[int] = set()
    for query in queries:
        if query in spared:
            continue
        hits = order[tree_overlaps(tree, query, least) > 0]
        if query == lead:
            spared = set(hits.tolist())
        for other in hits.tolist():
            if other != query and groups.join(query, other):
                links.append((query, other))
                left -= 1
        if not left:
            break
    return links


def _pack_asks(asked: DataFrame, n_docs: Buckets) -> DataFrame:
    def run(batches):
        for batch in batches:
            c = {k: batch.column(i).to_numpy() for i, k in enumerate(ASKS.fields)}
            yield from batches_of(ASKS.split(c, document_bucket(c["did"], c["th"], n_docs), ASK, n_docs.width))

    return asked.select(*ASKS.fields).mapInArrow(run, ROUTED)


def _plant(rows: DataFrame, asked: DataFrame, n_docs: Buckets, k: int) -> DataFrame:
    """The asked sets, each sent to its tree."""

    def prepare(got):
        asked = ASKS.load(got.get(ASK, []))
        return asked, by_document(asked["did"], asked["th"]), set()

    def rows_of(table, ready):
        asked, groups, seen = ready
        chosen = {}
        for i, key in enumerate(zip(table["did"].to_pylist(), table["th"].to_pylist())):
            if key in groups and key not in seen:
                chosen[key] = i
        seen.update(chosen)
        names = list(chosen)
        for at, buf, offsets in byte_parts(table["text"].cast(pa.binary()).take(pa.array(list(chosen.values()), type=pa.int64())), 1 << 20):
            row, value = shingle_sets(buf, offsets, k)
            edge = np.searchsorted(row, np.arange(len(offsets)))
            for r in range(len(offsets) - 1):
                body = value[edge[r] : edge[r + 1]].tobytes()
                for j in groups[names[at + r]].tolist():
                    yield int(asked["block"][j]) & 0x7FFFFFFF, SETS, LEAVES.dump({f: asked[f][j : j + 1] for f in LEAVES.fields}) + body

    def work(table, ready):
        return batches_of(rows_of(table, ready))

    return with_documents(rows.select("bucket", "did", "th", "text").where("text is not null"), _pack_asks(asked, n_docs), n_docs, prepare, work, ROUTED)


def _grow(sets: DataFrame, n_keys: Buckets, least: Fraction) -> DataFrame:
    """Links within each tree, and of split stars the sets that do not hang together with the star's smallest one."""
    size = 8 + sum(t.itemsize for t in LEAVES.fields.values())

    def work(got):
        trees: dict[int, dict[int, tuple]] = {}
        for blob in got.get(SETS, []):
            leaf = LEAVES.load([blob[:size]])
            trees.setdefault(int(leaf["block"][0]), {})[int(leaf["digest"][0])] = (leaf, np.frombuffer(blob, dtype=U64, offset=size))
        for members in trees.values():
            names = sorted(members)
            leaf = {f: np.concatenate([members[x][0][f] for x in names]) for f in LEAVES.fields}
            asked = np.flatnonzero(leaf["role"] == 1).tolist()
            pairs = []
            if len(names) > 1:
                second = leaf["split"][0] == 2
                pairs = linked_forest([members[x][1] for x in names], least, None if second else asked[0], asked if second else None)
            if pairs:
                src, dst = (np.array([names[i] for i in x], dtype=np.int64) for x in zip(*pairs))
                yield 0, EDGE, EDGES.dump({"src": src, "dst": dst})
            if leaf["split"][0] == 1:
                groups = Union(len(names))
                for a, b in pairs:
                    groups.join(a, b)
                apart = np.array([x for i, x in enumerate(names) if groups.root(i) != groups.root(asked[0])], dtype=np.int64)
                if len(apart):
                    yield 0, REST, EDGES.dump({"src": np.full(len(apart), leaf["star"][0]), "dst": apart})

    return by_bucket(sets, n_keys, work)


def find_links(rows: DataFrame, info: DataFrame, edges: DataFrame, n_keys: Buckets, n_docs: Buckets, k: int, least: Fraction, chunk: int, chunk_shingles: int) -> DataFrame:
    """(src, dst) digests of a forest of links among the stars of candidate edges."""
    place = info.groupBy("digest").agg(F.min(F.struct("did", "th")).alias("at"), F.max("n").alias("n"))
    stars = edges.select(F.col("src").alias("star"), F.col("dst").alias("digest")).union(edges.select(F.col("src").alias("star"), F.col("src").alias("digest")).distinct())
    stars = materialize(stars.join(place, "digest").select("star", "digest", "at.did", "at.th", "n"), "stars")
    parts = F.ceil(F.greatest(F.count("*") / F.lit(chunk), F.sum("n") / F.lit(chunk_shingles))).cast("int")
    large = materialize(stars.groupBy("star").agg(parts.alias("parts")).where("parts > 1"), "large")
    if large.limit(BROADCAST_STARS + 1).count() <= BROADCAST_STARS:
        large = F.broadcast(large)
    is_lead = F.col("star") == F.col("digest")
    part = F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")
    dealt = stars.join(large, "star", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # The star's smallest set is in each of its trees.
    first = dealt.withColumn("part", F.explode(F.when(is_lead, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))))
    first = first.select("did", "th", "digest", "star", F.xxhash64("star", "part").alias("block"), is_lead.cast("int").alias("role"), (F.col("parts") > 1).cast("int").alias("split"))
    found = materialize(_grow(_plant(rows, first, n_docs, k), n_keys, least), "links")
    links = unpack(found, EDGE, EDGES, "src long, dst long")
    rest = found.where(F.col("kind") == REST)
    if rest.isEmpty():
        return links
    apart = unpack(rest, REST, EDGES, "star long, digest long")
    groups = materialize(apart.join(stars, ["star", "digest"]), "apart")
    lots = groups.groupBy("star").agg(parts.alias("lots"))
    asked = groups.join(lots, "star").join(large, "star").withColumn("lot", F.pmod(F.xxhash64("digest", F.lit(1)), F.col("lots")).cast("int"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("role", F.lit(1))
    others = stars.join(large, "star").join(lots, "star").withColumn("part", part).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).withColumn("role", F.lit(0))
    both = asked.select("did", "th", "digest", "star", "lot", "part", "role").union(others.select("did", "th", "digest", "star", "lot", "part", "role"))
    second = both.groupBy("did", "th", "digest", "star", "lot", "part").agg(F.max("role").alias("role"))
    second = second.select("did", "th", "digest", "star", F.xxhash64("star", "lot", "part", F.lit(2)).alias("block"), "role", F.lit(2).alias("split"))
    more = materialize(_grow(_plant(rows, second, n_docs, k), n_keys, least), "links")
    return links.union(unpack(more, EDGE, EDGES, "src long, dst long"))


def jaccard_groups(docs: DataFrame, shingle: int = SHINGLE, least: Fraction = LEAST, chunk: int = CHUNK, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """One row per document: doc_id, did, th, n_shingles, component_id (smallest doc_id reachable by links), group (tells components of one id apart).

    Texts are lower-cased (A-Z); a text with fewer words than a shingle has is one shingle; one without words, or
    null, has none and is linked with nothing. Null ids count as larger than any other; a component of null ids only
    has a null id. Repeated rows are linked; an empty table gives no rows; extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    n_keys, n_docs = buckets(docs, 2), buckets(docs)
    rows = keyed(docs, n_docs)
    met = materialize(meet_on_signs(find_signs(rows, n_keys, shingle, least, common_shingles(rows, shingle)), n_keys), "signs")
    info = unpack(met, INFO, INFOS, "did long, th long, n long, digest long")
    edges = unpack(met, EDGE, EDGES, "src long, dst long").distinct()
    full = info.where("n > 0")
    links = find_links(rows, full, edges, n_keys, n_docs, shingle, least, chunk, chunk_shingles)
    labels = connected_components(links)
    low = full.groupBy("digest").agg(F.min("did").alias("low"))
    nodes = low.join(labels, F.col("digest") == F.col("node"), "left").select("digest", "low", F.coalesce("component", "digest").alias("component"))
    least_of = nodes.groupBy("component").agg(F.min("low").alias("id"))
    named = nodes.join(least_of, "component").select("digest", "id", F.col("component").alias("group"))
    out = info.join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("id")).otherwise(F.col("did"))
    return out.select(F.nullif("did", F.lit(MISSING)).alias("doc_id"), "did", "th", F.col("n").alias("n_shingles"), F.nullif(component, F.lit(MISSING)).alias("component_id"), "group")


def one_of_each(docs: DataFrame, shingle: int = 5, least: Fraction = Fraction(80, 100)) -> DataFrame:
    """The documents, one of each near-duplicate group: the one with the smallest id (then the smallest text hash).

    Documents without words stay. Of rows with one id and one text, one stays.
    """
    groups = jaccard_groups(docs, shingle, least)
    solo = groups.where("n_shingles = 0").select("did", "th").distinct()
    first = groups.where("n_shingles > 0").groupBy("group").agg(F.min(F.struct("did", "th")).alias("k")).select("k.did", "k.th")
    keep = first.union(solo)
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(MISSING))
    kept = apart(docs).select(did.alias("did"), text_hash().alias("th"), "text", "rest").join(keep, ["did", "th"], "left_semi").dropDuplicates(["did", "th"])
    others = iter(kept.schema["rest"].dataType.names)
    return kept.select(*[F.col("text") if c == "text" else F.col(f"rest.{next(others)}") for c in docs.columns]).toDF(*docs.columns)
