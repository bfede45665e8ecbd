"""Suffix-array dedup over bytes: every byte of a 400-byte string that starts more than once in the corpus goes.

The suffix array is sparse and partitioned. Anchors are the minimizers of each window's 32-byte grams, so equal windows
have the same anchor at the same place, and all suffixes that share an anchor's gram meet in one bucket. Windows have
256 bytes, some 50 words; the anchors of 400-byte windows are among theirs. An anchor's windows of both lengths make a
context of 256 to 768 bytes.

1. Tasks find contexts. Of one that several documents of a task hold, one travels as a leaf, and its occurrences by their
   places only.
2. Contexts meet by anchor: equal ones are one leaf that weighs as much as it has occurrences; where an anchor's contexts
   differ, their bytes are fetched, once for each different one.
3. There the contexts are sorted by what follows the anchor, and a stack scan over the common prefixes lists the
   prefix intervals, each with all its occurrences. Within an interval the bytes before the anchor, compared
   backwards, tell which occurrences extend left together and how far, up to where they differ: the maximal repeats,
   among all occurrences and among those of different documents. A heavy leaf is an interval of its own, and a context
   that met no other one is a tree of one leaf.
4. Repeats of 400 bytes and more are cut out of the texts; those of 256 bytes and more that another document holds are
   counted.

An anchor with more than HOT different contexts is not brought together: its windows are counted one by one by
their hash. Most such anchors are known beforehand from one text of SHARE, so their contexts never travel to one place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from atlasmill.llm.arrays import U64, byte_parts, cover, minimizers, mix64, runs_of
from atlasmill.llm.routing import Buckets, Pack, ROUTED, among, batches_of, buckets, by_bucket, by_document, document_bucket, hot_keys, keyed, ranges, with_documents
from atlasmill.llm.tables import small_batches
from atlasmill.session import materialize

LENGTH = 400
#: Bytes of a passage that counts as shared with another document: some 50 words.
SHARED = 256
GRAM = 32
FLUSH = 400_000
HOT, SHARE = 16_384, 64
CONTEXT, SPAN, REQUEST, WINDOW, BYTES, HELD = 0, 1, 2, 3, 4, 5
#: multi: 1 where the task's other occurrences are of the same document (they travel too), 2 where of other documents (they travel as occurrences of one leaf).
CONTEXTS = Pack(key="<u4", digest="<u8", did="<i8", th="<i8", pos="<u4", n="<u2", a="<u2", multi="u1")
#: other: the repeat is in another document too.
SPANS = Pack(did="<i8", th="<i8", pos="<u4", n="<u4", other="u1")
REQUESTS = Pack(did="<i8", th="<i8", pos="<u4", n="<u2", a="<u2", key="<u4", digest="<u8", home="<u4", wide="u1", hot="u1")
#: Occurrences of one context: what its leaf of the anchor's tree weighs. other: they are of several documents.
HELDS = Pack(key="<u4", digest="<u8", did="<i8", th="<i8", pos="<u4", n="<u2", a="<u2", other="u1")
WINDOWS = Pack(hash="<u8", did="<i8", th="<i8", pos="<u4", n="<u4", wide="u1")


def byte_grams(buf: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hash of each run of k bytes (k a power of two), by doubling the run length."""
    h, c, size = buf.astype(U64) + U64(1), 0x9E3779B97F4A7C15, 1
    while size < k:
        h = h[:-size] * U64(c) + h[size:]
        c, size = c * c % (1 << 64), size * 2
    return mix64(h)


def _windows_by_anchor(grams: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows of each row, and the start of the first and the last window of each; places are those of the buffer."""
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    anchor = minimizers(grams, length - GRAM + 1)
    count = sizes[long] - length + 1
    ends = np.cumsum(count)
    at = np.arange(ends[-1]) + np.repeat(offsets[long] - (ends - count), count)
    a = anchor[at]
    new = np.concatenate(([True], a[1:] != a[:-1]))
    new[ends[:-1]] = True
    first = np.flatnonzero(new)
    return a[first], at[first], at[np.append(first[1:], len(at)) - 1]


def anchor_contexts(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, shared: int = SHARED) -> dict[str, np.ndarray]:
    """Contexts of the rows of a buffer: row, anchor hash, digest, first byte in its row, bytes, anchor's distance from the first."""
    import xxhash

    grams = byte_grams(buf) if len(buf) >= GRAM else np.zeros(0, dtype=U64)
    a, lo, last = _windows_by_anchor(grams, offsets, shared)
    hi = last + shared
    # A longer window's anchor is the smallest of a shorter window as well, and its context reaches at least as far.
    some, low, last = _windows_by_anchor(grams, offsets, length)
    at = np.searchsorted(a, some)
    lo[at], hi[at] = low, last + length
    row = np.searchsorted(offsets, lo, side="right") - 1
    view, digest = memoryview(buf), xxhash.xxh3_64_intdigest
    digests = np.fromiter((digest(view[s:e]) for s, e in zip(lo.tolist(), hi.tolist())), dtype=U64, count=len(lo))
    return {"row": row, "seed": byte_grams_at(buf, a), "digest": mix64(digests ^ mix64((a - lo).astype(U64))), "pos": lo - offsets[row], "n": hi - lo, "a": a - lo}


def byte_grams_at(buf: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hashes of the grams that start at some places only."""
    import xxhash

    view, digest = memoryview(buf), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[s : s + GRAM]) for s in places.tolist()), dtype=U64, count=len(places))


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order, and the first position of each group in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _document(did: np.ndarray, th: np.ndarray) -> np.ndarray:
    """One number for a document."""
    return mix64(did.astype(U64) ^ mix64(th.astype(U64) + U64(1)))


def _differ(documents: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each group has more than one document."""
    if not len(order):
        return np.zeros(0, dtype=bool)
    return np.minimum.reduceat(documents[order], first) != np.maximum.reduceat(documents[order], first)


def _spans(columns: dict[str, np.ndarray], pick, n_docs: Buckets, other) -> list:
    part = {k: columns[k][pick] for k in ("did", "th", "pos", "n")}
    part["other"] = np.broadcast_to(other, len(part["did"]))
    return SPANS.split(part, document_bucket(part["did"], part["th"], n_docs), SPAN, n_docs.width)


def _windows_of(text: memoryview, pos: int, size: int, lengths: tuple[int, int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, first byte, length) arrays of the windows of both lengths in a context."""
    import xxhash

    out = []
    for k in lengths:
        n = max(0, size - k + 1)
        out.append((np.fromiter((xxhash.xxh3_64_intdigest(text[s : s + k], seed=k) for s in range(pos, pos + n)), dtype=U64, count=n), np.arange(pos, pos + n), np.full(n, k)))
    return out


def _send(found: list[dict[str, np.ndarray]], windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n_keys: Buckets, n_docs: Buckets) -> list:
    """Routed rows of one task's contexts; of those that several of its documents hold one travels as a leaf, and all as its occurrences.

    Contexts of hot anchors (those with windows) travel as their windows.
    """
    c = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
    order, first = _groups(c["digest"])
    size = np.diff(np.append(first, len(order)))
    wide = _differ(_document(c["did"], c["th"]), order, first)
    again = order[np.repeat(wide, size)]
    held = {k: c[k][again] for k in ("digest", "did", "th", "pos", "n", "a")} | {"key": (c["seed"][again] >> U64(32)).astype(np.uint32), "other": np.ones(len(again))}
    rows = HELDS.split(held, (c["seed"][again] % U64(n_keys)).astype(np.int32), HELD, n_keys.width)
    c["multi"] = np.zeros(len(order), dtype=np.uint8)
    c["multi"][order] = np.repeat((size > 1).astype(np.uint8) + wide, size)
    go = np.sort(np.concatenate((order[first], order[~np.repeat(wide, size)])))
    go = go[np.concatenate(([True], go[1:] != go[:-1]))] if len(go) else go
    is_hot = c["windows"][go] > 0
    if is_hot.any():
        hot = go[is_hot]
        hashes, pos, n = (np.concatenate(x) for x in zip(*windows))
        count = c["windows"][hot]
        at = ranges((np.cumsum(c["windows"]) - c["windows"])[hot], count)
        w = {"hash": hashes[at], "pos": pos[at], "n": n[at], "wide": np.repeat(c["multi"][hot] == 2, count)} | {k: np.repeat(c[k][hot], count) for k in ("did", "th")}
        rows += WINDOWS.split(w, (w["hash"] % U64(n_keys)).astype(np.int32), WINDOW, n_keys.width)
    part = {k: v[go[~is_hot]] for k, v in c.items()}
    part["key"] = (part["seed"] >> U64(32)).astype(np.uint32)
    return rows + CONTEXTS.split(part, (part["seed"] % U64(n_keys)).astype(np.int32), CONTEXT, n_keys.width)


def find_contexts(rows: DataFrame, n_keys: Buckets, n_docs: Buckets, length: int, shared: int, hot_anchors: np.ndarray) -> DataFrame:
    listed = rows.sparkSession.sparkContext.broadcast(hot_anchors)

    def run(batches):
        found, windows, size = [], [], 0
        for batch in batches:
            did, th = batch.column("did").to_numpy(), batch.column("th").to_numpy()
            for at, buf, offsets in byte_parts(batch.column("text"), 1 << 20):
                got = anchor_contexts(buf, offsets, length, shared)
                local = got.pop("row")
                count = np.zeros(len(local), dtype=np.int64)
                view = memoryview(buf)
                for i in np.flatnonzero(among(got["seed"], listed.value)).tolist():
                    begin = int(offsets[local[i]])
                    own = _windows_of(view[begin:], int(got["pos"][i]), int(got["n"][i]), (length, shared))
                    windows += own
                    count[i] = sum(len(w[0]) for w in own)
                row = local + at
                found.append(got | {"did": did[row], "th": th[row], "windows": count})
                size += len(row) + int(count.sum())
                if size >= FLUSH:
                    yield from batches_of(_send(found, windows, n_keys, n_docs))
                    found, windows, size = [], [], 0
        if size:
            yield from batches_of(_send(found, windows, n_keys, n_docs))

    return rows.select("did", "th", "text").mapInArrow(run, ROUTED)


def hot_anchors(rows: DataFrame, length: int, shared: int, hot: int, share: int) -> np.ndarray:
    def contexts(column):
        for _, buf, offsets in byte_parts(column, 1 << 20):
            got = anchor_contexts(buf, offsets, length, shared)
            yield got["seed"], got["digest"]

    return hot_keys(rows, contexts, hot, share)


def _window_spans(got: dict[int, list[bytes]], length: int, n_docs: Buckets) -> list:
    """Spans of the windows of hot anchors that start elsewhere too."""
    w = WINDOWS.load(got.get(WINDOW, []))
    if not len(w["did"]):
        return []
    order, first = _groups(w["hash"])
    size = np.diff(np.append(first, len(order)))
    other = np.repeat(_differ(_document(w["did"], w["th"]), order, first) | (np.maximum.reduceat(w["wide"][order], first) > 0), size)
    return _spans(w, order[other], n_docs, 1) + _spans(w, order[~other & np.repeat(size > 1, size) & (w["n"][order] >= length)], n_docs, 0)


def _home(held: dict[str, np.ndarray], n_keys: Buckets) -> list:
    """Occurrences on their way to the tree of their anchor."""
    return HELDS.split(held, (held["key"] % np.uint32(n_keys)).astype(np.int32), HELD, n_keys.width)


def meet_on_anchors(routed: DataFrame, n_keys: Buckets, n_docs: Buckets, hot: int, length: int) -> DataFrame:
    def work(got):
        held = HELDS.load(got.get(HELD, []))
        rows = _window_spans(got, length, n_docs)
        c = CONTEXTS.load(got.get(CONTEXT, []))
        if not len(c["did"]):
            return rows + _home(held, n_keys)
        order, first = _groups(c["key"], c["digest"])
        size = np.diff(np.append(first, len(order)))
        multi = np.maximum.reduceat(c["multi"][order], first)
        wide = _differ(_document(c["did"], c["th"]), order, first) | (multi == 2)
        again = order[np.repeat(wide, size) & (c["multi"][order] < 2)]
        own = order[np.repeat(~wide & (size > 1), size) & (c["n"][order] >= length)]
        for some, other in ((again, 1), (own, 0)):
            held = {k: np.concatenate((v, c[k][some] if k != "other" else np.full(len(some), other))) for k, v in held.items()}
        rows += _home(held, n_keys)
        key = c["key"][order][first]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        kinds = np.diff(np.append(start, len(key)))
        ask = np.repeat((kinds > 1) & (np.minimum.reduceat(wide, start) == 0), kinds)
        # Of a settled context one occurrence is enough as a witness; of the others each is asked for.
        one = np.zeros(len(order), dtype=bool)
        one[first] = True
        pick = np.repeat(ask, size) & (one | ~np.repeat(wide, size))
        part = {k: c[k][order[pick]] for k in ("did", "th", "pos", "n", "a", "key", "digest")}
        part |= {"wide": np.repeat(wide, size)[pick], "hot": np.repeat(np.repeat(kinds > hot, kinds), size)[pick], "home": (part["key"] % np.uint32(n_keys))}
        return rows + REQUESTS.split(part, document_bucket(part["did"], part["th"], n_docs), REQUEST, n_docs.width)

    return by_bucket(routed, n_keys, work)


def fetch(docs: DataFrame, asked: DataFrame, n_keys: Buckets, n_docs: Buckets, length: int, shared: int) -> DataFrame:
    """The bytes of the asked contexts, sent to their anchor's bucket; of hot anchors the hashes of their windows."""

    def prepare(got):
        asked = REQUESTS.load(got.get(REQUEST, []))
        return asked, by_document(asked["did"], asked["th"]), set()

    def rows_of(table, ready):
        asked, groups, seen = ready
        for did, th, i in zip(table["did"].to_pylist(), table["th"].to_pylist(), range(len(table))):
            if (did, th) not in groups or (did, th) in seen:
                continue
            seen.add((did, th))
            text = table["text"][i].as_py().encode()
            view = memoryview(text)
            mine = groups[did, th]
            for j in mine[asked["hot"][mine] > 0].tolist():
                for hashes, pos, n in _windows_of(view, int(asked["pos"][j]), int(asked["n"][j]), (length, shared)):
                    w = {"hash": hashes, "did": np.full(len(n), did), "th": np.full(len(n), th), "pos": pos, "n": n, "wide": np.full(len(n), asked["wide"][j])}
                    yield from WINDOWS.split(w, (hashes % U64(n_keys)).astype(np.int32), WINDOW, n_keys.width)
            cool = mine[asked["hot"][mine] == 0]
            for home in np.unique(asked["home"][cool]).tolist():
                pick = cool[asked["home"][cool] == home]
                head = REQUESTS.dump({k: v[pick] for k, v in asked.items()})
                body = b"".join(text[p : p + n] for p, n in zip(asked["pos"][pick].tolist(), asked["n"][pick].tolist()))
                yield home, BYTES, len(head).to_bytes(8, "little") + head + body

    def work(table, ready):
        return batches_of(rows_of(table, ready))

    return with_documents(docs, asked, n_docs, prepare, work, ROUTED)


def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def _reach_elsewhere(gaps: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """For occurrences in the order of their left sides: the longest left extension shared with one of another document.

    gaps[i] is what occurrences i and i + 1 share. Other documents are nearest at the ends of a run of one document.
    """
    n = len(documents)
    best = np.full(n, -1)
    edge = np.flatnonzero(np.concatenate(([True], documents[1:] != documents[:-1])))
    for s, e in zip(edge.tolist(), [*edge[1:].tolist(), n]):
        if s:
            best[s:e] = np.minimum.accumulate(gaps[s - 1 : e - 1])
        if e < n:
            best[s:e] = np.maximum(best[s:e], np.minimum.accumulate(gaps[s:e][::-1])[::-1])
    return best


def maximal_repeats(contexts: list[bytes], anchors: list[int], length: int = LENGTH, documents: np.ndarray | None = None, shared: int = SHARED, heavy: np.ndarray | None = None):
    """Yield (right, members, left, other): members (indices) repeat with right bytes from the anchor on and left[i] before it.

    Contexts that share the anchor's gram are sorted by the suffix at the anchor. The stack scan closes each interval
    of suffixes with a common prefix of `right` bytes once all its occurrences are known; its members are ordered by
    what stands before the anchor, and left[i] is the longest left extension that member i shares with another one.
    Only members with left + right >= length are given, and only where a shorter prefix lets them reach further left.
    With documents, repeats of `shared` bytes and more between different documents are given likewise, with other = 1.
    A heavy leaf stands for several occurrences of its whole context: it is an interval of its own, the first to close
    above it, with all that stands before and after the anchor. It is given with other = 2.
    """
    m = len(contexts)
    tails, heads = [c[a:] for c, a in zip(contexts, anchors)], [c[:a][::-1] for c, a in zip(contexts, anchors)]
    suffixes = sorted(range(m), key=tails.__getitem__)
    before = np.array(sorted(range(m), key=heads.__getitem__))
    rank = np.empty(m, dtype=np.int64)
    rank[before] = np.arange(m)
    common = np.array([0] + [common_prefix(heads[before[i - 1]], heads[before[i]]) for i in range(1, m)])
    holder = documents[before] if documents is not None else None
    reach = np.full((2, m), -1)
    stack: list[tuple[int, list[np.ndarray]]] = []

    def close(right: int, parts: list[np.ndarray]):
        members = np.sort(np.concatenate(parts))
        gaps = np.minimum.reduceat(common[: members[-1] + 1], members[:-1] + 1)
        lefts = [(np.maximum(np.append(gaps, 0), np.concatenate(([0], gaps))), length)]
        if holder is not None:
            lefts.append((_reach_elsewhere(gaps, holder[members]), shared))
        out = []
        for other, (left, least) in enumerate(lefts):
            good = (left >= 0) & (left + right >= least) & (left > reach[other, members])
            reach[other, members[good]] = left[good]
            if good.any():
                out.append((right, before[members[good]], left[good], other))
        return members, out

    for i in range(1, m + 1):
        if heavy is not None and heavy[suffixes[i - 1]]:
            leaf = suffixes[i - 1]
            yield len(tails[leaf]), np.array([leaf]), np.array([len(heads[leaf])]), 2
        prefix = common_prefix(tails[suffixes[i - 1]], tails[suffixes[i]]) if i < m else 0
        parts = [rank[suffixes[i - 1] : suffixes[i - 1] + 1]]
        while stack and stack[-1][0] > prefix:
            right, held = stack.pop()
            members, found = close(right, held + parts)
            yield from found
            parts = [members]
        if i == m:
            break
        if stack and stack[-1][0] == prefix:
            stack[-1][1].extend(parts)
        else:
            stack.append((prefix, parts))


def compare(routed: DataFrame, n_keys: Buckets, n_docs: Buckets, length: int, shared: int) -> DataFrame:
    """Spans from the interval trees of the fetched contexts, and from the counted windows of hot anchors."""

    def work(got):
        heads, texts = [], []
        for blob in got.get(BYTES, []):
            size = int.from_bytes(blob[:8], "little")
            heads.append(blob[8 : 8 + size])
            n = REQUESTS.load([heads[-1]])["n"].astype(np.int64)
            ends = 8 + size + np.cumsum(n)
            texts += [blob[e - k : e] for e, k in zip(ends.tolist(), n.tolist())]
        c = REQUESTS.load(heads)
        spans = []
        held = HELDS.load(got.get(HELD, []))
        h_order, h_first = _groups(held["key"], held["digest"])
        leaf_of = {(k, d): i for i, (k, d) in enumerate(zip(held["key"][h_order][h_first].tolist(), held["digest"][h_order][h_first].tolist()))}
        h_end = np.append(h_first[1:], len(h_order))
        number = np.array([leaf_of.get(x, -1) for x in zip(c["key"].tolist(), c["digest"].tolist())], dtype=np.int64)

        def occurrences(leaves: np.ndarray, right: np.ndarray, left: np.ndarray):
            """Spans of all occurrences of heavy leaves, from what the tree says of each leaf."""
            at = h_order[ranges(h_first[leaves], h_end[leaves] - h_first[leaves])]
            many = h_end[leaves] - h_first[leaves]
            start = held["pos"][at].astype(np.int64) + held["a"][at] - np.repeat(left, many)
            spans.append((held["did"][at], held["th"][at], start, np.repeat(left + right, many), held["other"][at].astype(np.int64)))

        # A context that met no other one is a tree of one leaf: its interval is all of it.
        lone = np.setdiff1d(np.arange(len(h_first)), number)
        if len(lone):
            one = h_order[h_first[lone]]
            occurrences(lone, held["n"][one].astype(np.int64) - held["a"][one], held["a"][one].astype(np.int64))
        order, first = _groups(c["key"])
        anchors, wide = c["a"].tolist(), c["wide"] > 0
        # A settled context is held by several documents, so it is another document to every occurrence.
        documents = np.where(wide, np.arange(len(wide), dtype=U64), _document(c["did"], c["th"]))
        for s, e in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
            group = order[s:e]
            place, settled = c["pos"][group].astype(np.int64) + c["a"][group], wide[group]
            done = set()
            for right, members, left, other in maximal_repeats([texts[i] for i in group], [anchors[i] for i in group], length, documents[group], shared, number[group] >= 0):
                if other == 2:
                    leaf = int(number[group][members[0]])
                    if leaf not in done:  # the same context may have been asked for more than once
                        done.add(leaf)
                        occurrences(np.array([leaf]), np.array([right]), left)
                    continue
                open_ones = ~settled[members]
                members, left = members[open_ones], left[open_ones]
                spans.append((c["did"][group][members], c["th"][group][members], place[members] - left, left + right, np.full(len(left), other)))
        if spans:
            columns = dict(zip(SPANS.fields, (np.concatenate(x) for x in zip(*spans))))
            yield from SPANS.split(columns, document_bucket(columns["did"], columns["th"], n_docs), SPAN, n_docs.width)
        yield from _window_spans(got, length, n_docs)

    return by_bucket(routed, n_keys, work)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long"


def repeated_bytes_removed(docs: DataFrame, hot: int = HOT, length: int = LENGTH, shared: int = SHARED, share: int = SHARE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared for every row.

    n_shared counts the bytes covered by strings of `shared` bytes that a document of another id or text holds as well.
    Null is the empty text. Repeated rows are further occurrences, so a repeated row of 400 bytes or more goes whole,
    but shares nothing with itself. Null ids are kept; an empty table gives no rows; extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    n_keys, n_docs = buckets(docs, 2), buckets(docs)
    rows = keyed(docs, n_docs)
    found = find_contexts(rows, n_keys, n_docs, length, shared, hot_anchors(rows, length, shared, hot, share))
    met = materialize(meet_on_anchors(found, n_keys, n_docs, hot, length), "anchors")
    asked = fetch(rows.drop("doc_id").where("text is not null"), met.where(f"kind = {REQUEST}"), n_keys, n_docs, length, shared)
    spans = met.where(f"kind = {SPAN}").union(compare(met.where(f"kind = {HELD}").union(asked), n_keys, n_docs, length, shared))

    def prepare(got):
        s = SPANS.load(got.get(SPAN, []))
        return s, by_document(s["did"], s["th"])

    def work(table, ready):
        s, groups = ready
        out = []
        for doc, did, th, text in zip(*(table[c].to_pylist() for c in ("doc_id", "did", "th", "text"))):
            data = (text or "").encode()
            mine = groups.get((did, th))
            if mine is None:
                out.append((doc, len(data), 0, 0, hashlib.sha256(data).hexdigest(), 0))
                continue
            start, n = s["pos"][mine].astype(np.int64), s["n"][mine]
            pick, other = n >= length, s["other"][mine] > 0
            gone = cover(len(data), start[pick], start[pick] + n[pick])
            kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
            n_shared = int(cover(len(data), start[other], start[other] + n[other]).sum())
            out.append((doc, len(data), len(data) - len(kept), len(runs_of(gone)[0]), hashlib.sha256(kept).hexdigest(), n_shared))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in RESULT.split(", ")])

    return with_documents(rows, spans, n_docs, prepare, work, RESULT)
