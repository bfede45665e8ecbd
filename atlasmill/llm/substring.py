"""Substring dedup by seed and extend over words.

Seeds are the winnowed anchors of the text: the minimizers of each 13-word window's 5-word grams, so two equal windows
have the same seed at the same place. The windows that share one seed occurrence make a context of 13 to 21 words.

1. Each task finds its contexts. Of contexts that repeat within the task only those of the smallest document travel.
2. Documents are joined on seeds: a context that a smaller document has whole is removed; where a seed's contexts
   differ, the words around the seed are fetched to the seed's bucket.
3. There matches are extended both ways: for each split of the length, the occurrences that agree on that many words
   to the left of the seed and on the rest to its right are found together, and the smallest document among them.
4. Splits that follow each other are one maximal repeat; these are cut out of the texts.

A seed with more than HOT different contexts is not brought together: its windows meet one by one by their hash. Most
such seeds are known beforehand from one text of SHARE, so their contexts never travel to one place.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasmill.llm.arrays import byte_parts, cover, gram_hashes, minimizers, mix64, odd_numbers, runs_of, word_hashes, words_of
from atlasmill.llm.routing import Buckets, Pack, ROUTED, among, batches_of, buckets, by_bucket, by_document, document_bucket, hot_keys, keyed, ranges, with_documents
from atlasmill.llm.tables import apart, small_batches, together
from atlasmill.session import materialize

LENGTH = 13
SEED_WORDS = 5
HOT, SHARE = 16_384, 64
#: Contexts a task gathers before it sends them.
FLUSH = 1_000_000
CONTEXT, SPAN, REQUEST, WINDOW, AROUND = 0, 1, 2, 3, 4
CONTEXTS = Pack(key="<u4", digest="<u8", did="<i8", th="<i8", pos="<u4", n="<u2", a="<u2")
SPANS = Pack(did="<i8", th="<i8", pos="<u4", n="<u2")
REQUESTS = Pack(did="<i8", th="<i8", pos="<u4", n="<u2", a="<u2", key="<u4", home="<u4", hot="u1")
WINDOWS = Pack(hash="<u8", did="<i8", th="<i8", pos="<u4")


def seed_contexts(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED_WORDS) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Contexts of the rows of a buffer: row, full seed hash, digest, first window (word number in its row), number of windows, words before the seed; and the hashes of all windows, with the first one's number (lo)."""
    starts, ends, rows = words_of(buf, offsets)
    words = word_hashes(buf, starts, ends)
    grams, windows = gram_hashes(words, seed, 21), gram_hashes(words, length, 22)
    if not len(windows):
        empty = np.zeros(0, dtype=np.int64)
        return {"row": empty, "seed": empty.astype(np.uint64), "digest": empty.astype(np.uint64), "pos": empty, "n": empty, "a": empty, "lo": empty}, windows
    at = np.flatnonzero(rows[: len(windows)] == rows[length - 1 :])
    anchor = minimizers(grams, length - seed + 1)[at]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))) if len(at) else np.zeros(0, dtype=np.int64)
    last = np.append(first[1:], len(at)) - 1
    lo, hi, a = at[first], at[last], anchor[first]
    c = odd_numbers(4, 23)
    digest = mix64(windows[lo] * c[0] + windows[hi] * c[1] + (hi - lo).astype(np.uint64) * c[2] + (a - lo).astype(np.uint64) * c[3])
    base = np.searchsorted(rows, np.arange(len(offsets)))
    return {"row": rows[lo], "seed": grams[a], "digest": digest, "pos": lo - base[rows[lo]], "n": hi - lo + 1, "a": a - lo, "lo": lo}, windows


def smallest(group: tuple[np.ndarray, ...], did: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order by group then did, and the smallest did of each element's group in that order."""
    order = np.lexsort((did, *group[::-1]))
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for g in group:
        s = g[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    return order, did[order][first][np.cumsum(new) - 1] if len(order) else did[:0]


def _spans(columns: dict[str, np.ndarray], pick: np.ndarray, n_docs: Buckets) -> list:
    part = {k: columns[k][pick] for k in SPANS.fields}
    return SPANS.split(part, document_bucket(part["did"], part["th"], n_docs), SPAN, n_docs.width)


def _send(found: list[dict[str, np.ndarray]], hot: list[dict[str, np.ndarray]], n_keys: Buckets, n_docs: Buckets) -> list:
    """Routed rows of one task's contexts, and of its hot seeds' windows: those a smaller document of the task has are spans already."""
    all_of = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
    order, low = smallest((all_of["digest"],), all_of["did"])
    again = all_of["did"][order] > low
    go = np.sort(order[~again])
    rows = _spans(all_of, order[again], n_docs)
    part = {k: v[go] for k, v in all_of.items()}
    part["key"] = (part["seed"] >> np.uint64(32)).astype(np.uint32)
    out = CONTEXTS.split(part, (part["seed"] % np.uint64(n_keys)).astype(np.int32), CONTEXT, n_keys.width)
    if hot:
        windows = {k: np.concatenate([h[k] for h in hot]) for k in hot[0]}
        order, low = smallest((windows["hash"],), windows["did"])
        again = windows["did"][order] > low
        rows += _spans(windows | {"n": np.ones(len(order), dtype=np.int64)}, order[again], n_docs)
        part = {k: v[order[~again]] for k, v in windows.items()}
        out += WINDOWS.split(part, (part["hash"] % np.uint64(n_keys)).astype(np.int32), WINDOW, n_keys.width)
    # Spans ride along to some key bucket, from where they are passed on.
    return [(b % n_keys, SPAN, b.to_bytes(4, "little", signed=True) + data) for b, _, data in rows] + out


def find_contexts(rows: DataFrame, n_keys: Buckets, n_docs: Buckets, length: int, hot_seeds: np.ndarray) -> DataFrame:
    listed = rows.sparkSession.sparkContext.broadcast(hot_seeds)

    def run(batches):
        found, hot, size = [], [], 0
        for batch in batches:
            did, th = batch.column("did").to_numpy(), batch.column("th").to_numpy()
            for at, buf, offsets in byte_parts(batch.column("text"), 1 << 20):
                got, windows = seed_contexts(buf, offsets, length)
                row, lo = got.pop("row") + at, got.pop("lo")
                got |= {"did": did[row], "th": th[row]}
                is_hot = among(got["seed"], listed.value)
                if is_hot.any():
                    n = got["n"][is_hot]
                    w = {"hash": windows[ranges(lo[is_hot], n)], "pos": ranges(got["pos"][is_hot], n)} | {k: np.repeat(got[k][is_hot], n) for k in ("did", "th")}
                    hot.append(w)
                    size += len(w["hash"])
                    got = {k: v[~is_hot] for k, v in got.items()}
                found.append(got)
                size += len(got["did"])
                if size >= FLUSH:
                    yield from batches_of(_send(found, hot, n_keys, n_docs))
                    found, hot, size = [], [], 0
        if size:
            yield from batches_of(_send(found, hot, n_keys, n_docs))

    return rows.select("did", "th", "text").mapInArrow(run, ROUTED)


def hot_seeds(rows: DataFrame, length: int, hot: int, share: int) -> np.ndarray:
    def contexts(column):
        for _, buf, offsets in byte_parts(column, 1 << 20):
            got, _ = seed_contexts(buf, offsets, length)
            yield got["seed"], got["digest"]

    return hot_keys(rows, contexts, hot, share)


def _forward(blobs: list[bytes]) -> list:
    return [(int.from_bytes(b[:4], "little", signed=True), SPAN, b[4:]) for b in blobs]


def _window_spans(got: dict[int, list[bytes]], n_docs: Buckets) -> list:
    """Spans of the windows of hot seeds that a smaller document has."""
    w = WINDOWS.load(got.get(WINDOW, []))
    order, low = smallest((w["hash"],), w["did"])
    w["n"] = np.ones(len(order), dtype=np.uint16)
    return _spans(w, order[w["did"][order] > low], n_docs)


def meet_on_seeds(routed: DataFrame, n_keys: Buckets, n_docs: Buckets, hot: int) -> DataFrame:
    def work(got):
        rows = _forward(got.get(SPAN, [])) + _window_spans(got, n_docs)
        c = CONTEXTS.load(got.get(CONTEXT, []))
        if not len(c["did"]):
            return rows
        order, low = smallest((c["key"], c["digest"]), c["did"])
        did, key, digest = c["did"][order], c["key"][order], c["digest"][order]
        rows += _spans(c, order[did > low], n_docs)
        one = np.ones(len(key), dtype=bool)
        one[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        kinds = np.add.reduceat(one.astype(np.int64), first)
        least, most = np.minimum.reduceat(did, first), np.maximum.reduceat(did, first)
        mixed = np.repeat((kinds > 1) & (least < most), size)
        pick = mixed & (did == low)
        part = {k: c[k][order[pick]] for k in ("did", "th", "pos", "n", "a", "key")}
        part |= {"home": part["key"] % np.uint32(n_keys), "hot": np.repeat(kinds > hot, size)[pick]}
        return rows + REQUESTS.split(part, document_bucket(part["did"], part["th"], n_docs), REQUEST, n_docs.width)

    return by_bucket(routed, n_keys, work)


def fetch_around(docs: DataFrame, asked: DataFrame, n_keys: Buckets, n_docs: Buckets, length: int) -> DataFrame:
    """Hashes of the words of the asked contexts, sent to their seed's bucket; of hot seeds the hashes of their windows."""

    def prepare(got):
        asked = REQUESTS.load(got.get(REQUEST, []))
        return asked, by_document(asked["did"], asked["th"]), set()

    def rows_of(table, ready):
        asked, groups, seen = ready
        chosen = {}
        for i, key in enumerate(zip(table["did"].to_pylist(), table["th"].to_pylist())):
            if key in groups and key not in seen:
                chosen[key] = i
        seen.update(chosen)
        if not chosen:
            return
        names, texts = list(chosen), table["text"].cast(pa.binary()).take(pa.array(list(chosen.values())))
        for at, buf, offsets in byte_parts(texts, 1 << 20):
            starts, ends, rows = words_of(buf, offsets)
            words = word_hashes(buf, starts, ends)
            base = np.searchsorted(rows, np.arange(len(offsets)))
            mine = [groups[names[at + r]] for r in range(len(offsets) - 1)]
            pick, row = np.concatenate(mine), np.repeat(np.arange(len(mine)), [len(m) for m in mine])
            first, n, is_hot = base[row] + asked["pos"][pick], asked["n"][pick].astype(np.int64), asked["hot"][pick] > 0
            cool = pick[~is_hot]
            for home, some in _by(asked["home"][cool]):
                size = n[~is_hot][some] + length - 1
                yield home, AROUND, _with_body(REQUESTS, {k: v[cool[some]] for k, v in asked.items()}, words[ranges(first[~is_hot][some], size)])
            if is_hot.any():
                windows, at_window = gram_hashes(words, length, 22), ranges(first[is_hot], n[is_hot])
                again = np.repeat(pick[is_hot], n[is_hot])
                columns = {"hash": windows[at_window], "did": asked["did"][again], "th": asked["th"][again], "pos": at_window - np.repeat(base[row[is_hot]], n[is_hot])}
                yield from WINDOWS.split(columns, (columns["hash"] % np.uint64(n_keys)).astype(np.int32), WINDOW, n_keys.width)

    def work(table, ready):
        return batches_of(rows_of(table, ready))

    return with_documents(docs, asked, n_docs, prepare, work, ROUTED)


def _by(values: np.ndarray):
    """(value, where it stands) for each different value."""
    order = np.argsort(values, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], values[order][1:] != values[order][:-1]))) if len(order) else []
    for s, e in zip(edges, [*edges[1:], len(order)]):
        yield int(values[order[s]]), order[s:e]


def _with_body(pack: Pack, columns: dict[str, np.ndarray], body: np.ndarray) -> bytes:
    head = pack.dump(columns)
    return len(head).to_bytes(8, "little") + head + body.tobytes()


def extend(c: dict[str, np.ndarray], words: np.ndarray, length: int, seed: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurrence, first word, windows) of the maximal repeats that each occurrence shares with a smaller document.

    c holds the occurrences' key, did, pos, n and a; words are the word hashes of their contexts, one after another.
    Occurrences of a seed that agree on `left` words before it and on length - seed - left words after it hold one window.
    """
    size = c["n"].astype(np.int64) + length - 1
    start = np.cumsum(size) - size
    at, more = start + c["a"], length - seed
    before, after = c["a"].astype(np.int64), size - c["a"] - seed
    by = odd_numbers(2 * more + 2, 24)
    lefts, rights = [np.zeros(len(size), dtype=np.uint64)], [np.zeros(len(size), dtype=np.uint64)]
    for j in range(1, more + 1):
        lefts.append(lefts[-1] + np.where(before >= j, words[np.maximum(at - j, 0)] * by[j], 0))
        rights.append(rights[-1] + np.where(after >= j, words[np.minimum(at + seed + j - 1, len(words) - 1)] * by[more + j], 0))
    hit = np.zeros((len(size), more + 3), dtype=bool)
    for left in range(more + 1):
        here = np.flatnonzero((before >= left) & (after >= more - left))
        order, low = smallest((c["key"][here], mix64(lefts[left][here]), mix64(rights[more - left][here])), c["did"][here])
        hit[here[order], left + 1] = c["did"][here][order] > low
    step = np.diff(hit.view(np.int8), axis=1)
    row, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    # Splits first .. last - 1 match: the repeat starts last - 1 words before the seed.
    return row, c["pos"][row].astype(np.int64) + c["a"][row] - (last - 1), last - first


def meet_around(routed: DataFrame, n_keys: Buckets, n_docs: Buckets, length: int) -> DataFrame:
    """Spans from the extended seeds, and from the windows of hot seeds."""

    def work(got):
        heads, bodies = [], []
        for blob in got.get(AROUND, []):
            size = int.from_bytes(blob[:8], "little")
            heads.append(blob[8 : 8 + size])
            bodies.append(np.frombuffer(blob, dtype=np.uint64, offset=8 + size))
        if heads:
            c = REQUESTS.load(heads)
            row, pos, n = extend(c, np.concatenate(bodies), length)
            part = {"did": c["did"][row], "th": c["th"][row], "pos": pos, "n": n}
            yield from _spans(part, slice(None), n_docs)
        yield from _window_spans(got, n_docs)

    return by_bucket(routed, n_keys, work)


def removed_words(docs: DataFrame, length: int, hot: int = HOT, share: int = SHARE, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, int]:
    """keyed() documents, the routed spans of windows that a smaller document has, and the number of document buckets."""
    small_batches(docs.sparkSession)
    n_keys, n_docs = buckets(docs, 2), buckets(docs)
    rows = keyed(docs, n_docs, *more)
    found = find_contexts(rows, n_keys, n_docs, length, hot_seeds(rows, length, hot, share))
    met = materialize(meet_on_seeds(found, n_keys, n_docs, hot), "seeds")
    around = fetch_around(rows.select("bucket", "did", "th", "text").where("text is not null"), met.where(f"kind = {REQUEST}"), n_keys, n_docs, length)
    return rows, met.where(f"kind = {SPAN}").union(meet_around(around, n_keys, n_docs, length)), n_docs


def _spans_by_document(got: dict[int, list[bytes]]):
    spans = SPANS.load(got.get(SPAN, []))
    return spans, by_document(spans["did"], spans["th"])


def _masks(table: pa.RecordBatch, ready, length: int):
    """(row, words, removed mask or None) of every document of a batch."""
    spans, groups = ready
    for i, (did, th, text) in enumerate(zip(table["did"].to_pylist(), table["th"].to_pylist(), table["text"].cast(pa.binary()).to_pylist())):
        words = (text or b"").split()
        mine = groups.get((did, th))
        gone = None if mine is None else cover(len(words), spans["pos"][mine].astype(np.int64), spans["pos"][mine].astype(np.int64) + spans["n"][mine] + (length - 1))
        yield i, words, gone


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def substring_dedup(docs: DataFrame, length: int = LENGTH, hot: int = HOT, share: int = SHARE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row.

    Null texts have no words. A null id counts as larger than any other; rows with one id never remove each
    other's words. Repeated rows give repeated rows; an empty table gives none; extra columns are ignored.
    """
    rows, spans, n = removed_words(docs, length, hot, share)

    def work(table, ready):
        out = []
        ids = table["doc_id"].to_pylist()
        for i, words, gone in _masks(table, ready, length):
            kept = words if gone is None else compress(words, ~gone)
            out.append((ids[i], len(words), 0 if gone is None else int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_documents(rows, spans, n, _spans_by_document, work, RESULT)


def cut_repeats(docs: DataFrame, length: int = 50, least_words: int = 5, hot: int = HOT, share: int = SHARE) -> DataFrame:
    """The documents, without passages of at least `length` words that a document with a smaller id has, in their own columns.

    n_chars, if there, is counted again where a text changed. The rest of a text stays as it was, white space
    included. Documents left with fewer than least_words words, but not before, go. Edge cases as in substring_dedup.
    """
    names = docs.columns
    rows, spans, n = removed_words(apart(docs), length, hot, share, ("rest",))

    def work(table, ready):
        texts, keep, changed = table["text"].to_pylist(), np.ones(len(table), dtype=bool), {}
        for i, words, gone in _masks(table, ready, length):
            if gone is None:
                continue
            if (~gone).sum() < least_words <= len(words):
                keep[i] = False
                continue
            data = texts[i].encode()
            starts, _, _ = words_of(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
            kept, at = [], 0
            for a, b in zip(*runs_of(gone)):
                kept.append(data[at : starts[a]])
                at = starts[b] if b < len(starts) else len(data)
            kept.append(data[at:])
            changed[i] = texts[i] = b"".join(kept).decode("utf-8", "replace")
        columns = together(names, pa.array(texts, type=pa.string()), table["rest"])
        if changed and "n_chars" in columns:
            counts = columns["n_chars"].to_pylist()
            for i, text in changed.items():
                counts[i] = len(text)
            columns["n_chars"] = pa.array(counts, type=columns["n_chars"].type)
        yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names).filter(pa.array(keep))

    return with_documents(rows, spans, n, _spans_by_document, work, docs.schema)
