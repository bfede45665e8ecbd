"""Benchmark decontamination: rare n-gram seeds join texts to test items, then Smith-Waterman alignment scores the copies.

A copy can lose only so much of its item's own score before it is below the threshold. An inserted word costs 1 and
breaks one pair of neighbouring words, a changed or missing one costs 4 or 5 and breaks two, so of any set of places of
the item with that many pairs and `need` more, each copy holds at least `need`, within as many words as a copy can
span. The rarest places make that set; items too short for it use single words likewise. Which grams are rare decides
on the work, not on the result: no alignment at or over the threshold is missed. Rarity is counted over the whole
benchmark, not in the corpus: a passage that leaked often is frequent there.

1. Items are cut to seeds; a filter of bounded size over them goes to all tasks.
2. Tasks send the places of grams that pass the filter; these are joined with the seeds.
3. Where `need` seeds of an item meet, the text is aligned with the whole item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlasmill.llm.arrays import LOWER, U64, byte_parts, gram_hashes, word_hashes, words_of
from atlasmill.llm.routing import Buckets, ROUTED, batches_of, buckets, document_bucket, keyed, with_documents
from atlasmill.llm.tables import apart, small_batches, together
from atlasmill.session import materialize

LEAST = 0.8
#: Bits of the filter over the seeds, in pages: what is sent to every executor, however large the benchmark is.
FILTER_BITS, PAGE_BITS = 26, 16
MATCH, MISMATCH, GAP = 4, -1, 1
#: Lower case, and ASCII punctuation as spaces: words compare by their letters and digits.
PLAIN = LOWER.copy()
PLAIN[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 0x20


def plain_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a buffer's rows, and the first word of each row."""
    starts, ends, rows = words_of(PLAIN[buf], offsets)
    return word_hashes(PLAIN[buf], starts, ends), np.searchsorted(rows, np.arange(len(offsets)))


def pairs_of(words: np.ndarray) -> np.ndarray:
    return gram_hashes(words, 2, 51)


def spare(m: int, least: float) -> int:
    """What an alignment with an item of m words may lose of the item's own score and still be a copy."""
    return MATCH * m - int(least * MATCH * m)


def seed_plan(m: int, least: float) -> tuple[int, int, int, int]:
    """For an item of m words: words of a seed, how many seeds are taken, how many of them a copy holds and within how many words."""
    lost, span = spare(m, least), m + spare(m, least) // GAP
    if m - 1 > lost:
        need = max(1, (m - 1 - lost) * 3 // 4)
        return 2, lost + need, need, span
    lost //= MATCH
    need = max(1, min(m // 4, m - lost))
    return 1, lost + need, need, span


def windows(places: np.ndarray, need: int, span: int) -> list[tuple[int, int]]:
    """Disjoint pieces of words that all copies with seeds at these sorted places lie in; they may reach over a text's ends."""
    first, last = places[: len(places) - need + 1], places[need - 1 :]
    near = last - first < span
    out: list[list[int]] = []
    for low, high in zip((last[near] + 1 - span).tolist(), (first[near] + span).tolist()):
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(low, high) for low, high in out]


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, and where it ends in each (exclusive).

    A row is computed at once: the gap running along the row is a running maximum of score plus distance.
    """
    steps = np.arange(len(text) + 1) * GAP
    row, best = np.zeros(len(text) + 1, dtype=np.int64), (0, 0, 0)
    for i, word in enumerate(item):
        new = np.zeros_like(row)
        new[1:] = row[:-1] + np.where(text == word, MATCH, MISMATCH)
        new = np.maximum(np.maximum(new, row - GAP), 0)
        row = np.maximum.accumulate(new + steps) - steps
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
    return best


def align(item: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[float, int, int]:
    """Similarity (score over the item's own score) and the aligned words of words[low:high]."""
    text = words[low:high]
    score, i, j = smith_waterman(item, text)
    if not score:
        return 0.0, low, low
    _, _, back = smith_waterman(item[:i][::-1], text[:j][::-1])
    return score / (MATCH * len(item)), low + j - back, low + j


def best_copy(item: np.ndarray, words: np.ndarray, low: int, high: int, least: float) -> tuple[float, int, int]:
    """The best alignment of an item within words[low:high], where that can be a copy."""
    m, text, known = len(item), words[low:high], np.sort(item)
    if (known[np.minimum(np.searchsorted(known, text), m - 1)] == text).sum() < m - spare(m, least) // MATCH:
        return 0.0, low, low
    for s in (low + np.flatnonzero(text[: len(text) - m + 1] == item[0])).tolist() if len(text) >= m else ():
        if (words[s : s + m] == item).all():
            return 1.0, s, s + m
    return align(item, words, low, high)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item (a number of its own for each row), item_id, m, words: the items that have words."""

    def cut(batches):
        for batch in batches:
            for at, buf, offsets in byte_parts(batch.column(1)):
                words, base = plain_words(buf, offsets)
                rows = [words[a:b] for a, b in zip(base[:-1], base[1:])]
                columns = [batch.column(0).slice(at, len(rows)), pa.array([len(r) for r in rows], type=pa.int32()), pa.array([r.tobytes() for r in rows], type=pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "m", "words"])

    items = benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(cut, "item_id long, m int, words binary").where("m > 0")
    return materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")


def rare_seeds(items: DataFrame, least: float) -> DataFrame:
    """gram, item, need, span: each item's rarest grams, as many as seed_plan says."""

    def cut(batches):
        for batch in batches:
            for item, m, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                size, take, need, span = seed_plan(m, least)
                words = np.frombuffer(data, dtype=U64)
                grams = (pairs_of(words) if size == 2 else words).view(np.int64)
                columns = [pa.array(grams), pa.array(np.arange(len(grams), dtype=np.int32))] + [pa.array(np.full(len(grams), x, dtype=np.int64)) for x in (item, take, need, span)]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "place", "item", "take", "need", "span"])

    grams = items.select("item", "m", "words").mapInArrow(cut, "gram long, place int, item long, take long, need long, span long")
    counted = grams.join(grams.groupBy("gram").agg(F.count("*").alias("n")), "gram")
    rarest = Window.partitionBy("item").orderBy("n", "gram", "place")
    chosen = counted.withColumn("rank", F.row_number().over(rarest)).where("rank <= take")
    return materialize(chosen.select("gram", "item", "need", "span").distinct(), "seeds")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bitmap over the leading bits of the seeds, gathered in pages of bits; other bits only cost work."""
    slot = F.shiftrightunsigned("gram", 64 - FILTER_BITS)
    bits = seeds.select(F.shiftright(slot, PAGE_BITS).cast("int").alias("page"), slot.bitwiseAND((1 << PAGE_BITS) - 1).cast("int").alias("bit")).distinct()

    def pack(table: pa.Table) -> pa.Table:
        page = np.zeros(1 << PAGE_BITS, dtype=np.uint8)
        page[table["bit"].to_numpy()] = 1
        return pa.table({"page": table["page"][:1], "bits": pa.array([np.packbits(page, bitorder="little").tobytes()], type=pa.binary())})

    out = np.zeros((1 << (FILTER_BITS - PAGE_BITS), (1 << PAGE_BITS) // 8), dtype=np.uint8)
    for row in bits.groupBy("page").applyInArrow(pack, "page int, bits binary").collect():
        out[row["page"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out.ravel()


def seed_hits(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """gram, did, th, places: where texts hold grams that pass the filter over the seeds, one row for each gram of a document.

    A common word, as items of few words have them for seeds, so makes a row a document, not one for each time it is there.
    """
    held = rows.sparkSession.sparkContext.broadcast(seed_filter(seeds))

    def scan(batches):
        bits = held.value
        for batch in batches:
            did, th = batch.column(0), batch.column(1)
            for at, buf, offsets in byte_parts(batch.column(2), 1 << 20):
                words, base = plain_words(buf, offsets)
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(base))
                pairs = pairs_of(words)
                for grams in (words, pairs):
                    slot = grams >> U64(64 - FILTER_BITS)
                    hit = np.flatnonzero((bits[(slot >> U64(3)).astype(np.int64)] >> (slot & U64(7)).astype(np.uint8)) & 1)
                    if grams is pairs:
                        hit = hit[row[hit] == row[hit + 1]]
                    if len(hit):
                        order = np.lexsort((hit, grams[hit], row[hit]))
                        hit = hit[order]
                        gram, doc = grams[hit].view(np.int64), row[hit]
                        edge = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1]))))
                        places = pa.ListArray.from_arrays(pa.array(np.append(edge, len(hit)), type=pa.int32()), pa.array((hit - base[doc]).astype(np.int32)))
                        which = pa.array(doc[edge] + at)
                        yield pa.RecordBatch.from_arrays([pa.array(gram[edge]), did.take(which), th.take(which), places], names=["gram", "did", "th", "places"])

    return rows.where("text is not null").select("did", "th", "text").mapInArrow(scan, "gram long, did long, th long, places array<int>")


ASK = 0


def candidates(rows: DataFrame, items: DataFrame, least: float, n_docs: Buckets) -> DataFrame:
    """Routed rows to the documents where enough seeds of an item meet: the item's words and the windows to align it in."""
    seeds = rare_seeds(items, least)
    met = seed_hits(rows, seeds).join(seeds, "gram").groupBy("did", "th", "item").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"), F.first("need").alias("need"), F.first("span").alias("span"))

    def rows_of(batch):
        for did, th, item_id, words, places, need, span in zip(*(batch.column(c).to_pylist() for c in ("did", "th", "item_id", "words", "places", "need", "span"))):
            if found := windows(np.array(places, dtype=np.int64), need, span):
                low, high = zip(*found)
                head = np.array([did, th, item_id is not None, item_id or 0, len(low), *low, *high], dtype=np.int64)
                yield int(document_bucket(head[:1], head[1:2], n_docs)[0]), ASK, head.tobytes() + words

    def pack(batches):
        for batch in batches:
            yield from batches_of(rows_of(batch))

    # The items join before Python sees the rows: one worker a task, not two.
    found = met.where("size(places) >= need").join(items, "item")
    return found.select("did", "th", "item_id", "words", "places", "need", "span").mapInArrow(pack, ROUTED)


def _asked(got: dict[int, list[bytes]]) -> dict[tuple[int, int], list]:
    """For each document (did, th): item_id, words and windows of the items to align."""
    out: dict[tuple[int, int], list] = {}
    for blob in got.get(ASK, []):
        n = int(np.frombuffer(blob, dtype=np.int64, count=5)[4])
        head = np.frombuffer(blob, dtype=np.int64, count=5 + 2 * n).tolist()
        words = np.frombuffer(blob, dtype=U64, offset=8 * (5 + 2 * n))
        out.setdefault((head[0], head[1]), []).append((head[3] if head[2] else None, words, list(zip(head[5 : 5 + n], head[5 + n :]))))
    return out


def _copies(table: pa.RecordBatch, asked: dict[tuple[int, int], list], least: float):
    """(row, item_id, similarity, first word, end) of the copies in a batch of documents."""
    keys = list(zip(table["did"].to_pylist(), table["th"].to_pylist()))
    rows = [i for i, key in enumerate(keys) if key in asked]
    for at, buf, offsets in byte_parts(table["text"].take(pa.array(rows, type=pa.int64())), 1 << 20):
        every, base = plain_words(buf, offsets)
        for r in range(len(offsets) - 1):
            words = every[base[r] : base[r + 1]]
            for item_id, item, places in asked[keys[rows[at + r]]]:
                best = max((best_copy(item, words, max(0, low), min(len(words), high), least) for low, high in places), key=lambda c: c[0])
                if best[0] >= least:
                    yield rows[at + r], item_id, *best


FOUND = "doc_id long, item_id long, similarity double, start_word long, end_word long"


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """One row for each document and item it holds a copy of: doc_id, item_id, similarity, start_word, end_word.

    A copy is an alignment with at least `least` of the item's own score; the best one of a document is given, in
    words (letters and digits between punctuation and white space). Null and wordless texts on either side match
    nothing. Repeated documents give repeated rows; repeated items count as items of their own; no documents or no
    items, no rows. Null ids stay null; extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    n = buckets(docs)
    rows = keyed(docs, n)

    def work(table, asked):
        if found := list(_copies(table, asked, least)):
            row, item, *rest = zip(*found)
            columns = [table["doc_id"].take(pa.array(row, type=pa.int64())), pa.array(item, type=pa.int64())]
            columns += [pa.array(c, type=t) for c, t in zip(rest, (pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])

    return with_documents(rows, candidates(rows, benchmark_items(benchmark), least, n), n, _asked, work, FOUND)


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents that hold no copy of a benchmark item, in their own columns.

    Null and wordless texts stay, repeated rows stay or go together; without items all documents stay, an empty table
    gives no rows.
    """
    small_batches(docs.sparkSession)
    n, names = buckets(docs), docs.columns
    rows = keyed(apart(docs), n, "rest")

    def work(table, asked):
        keep = np.ones(table.num_rows, dtype=bool)
        keep[[c[0] for c in _copies(table, asked, least)]] = False
        yield pa.RecordBatch.from_arrays(list(together(names, table["text"], table["rest"]).values()), names=names).filter(pa.array(keep))

    return with_documents(rows, candidates(rows, benchmark_items(benchmark), least, n), n, _asked, work, docs.schema)
