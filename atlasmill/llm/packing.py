"""Pattern packing: tokenize, fit few-document length patterns to the length histogram, pack the rest best-fit.

The only thing that reaches the driver is the histogram of piece lengths (at most ``capacity`` rows); the only
thing sent to the executors is the recipe, whose size depends on the number of patterns and lengths, not on the
number of documents.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlasmill.llm.tables import small_batches
from atlasmill.session import materialize

CAPACITY = 4096
#: Times that patterns are enumerated and fitted again to what earlier ones have left.
ROUNDS = 6
END_ID = 1
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Entries of a worker's word cache before it is emptied; it only saves time.
CACHE_WORDS = 400_000
#: Latin-1 letters, then ASCII punctuation without the apostrophe: the two parts are separate pre-tokens.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


#: Normalizer and pre-tokenizer of the files whose words can be encoded one by one (fixed values).
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def byte_symbols() -> dict[int, str]:
    """The printable character a byte-level vocabulary writes for each byte: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordTokenizer:
    """Token ids of whole texts, as little-endian 32-bit bytes, from cached ids of their words.

    The tokenizer never joins characters across white space, so a text's ids are those of its words in order.
    A word of Latin letters is one pre-token and goes to the tokenizer's model at once; other words, and texts
    that may hold a special token's string, go through the whole tokenizer. That holds for tokenizers that lower-case,
    split at white space and letter runs, and write bytes as symbols; with any other file whole texts are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.by_words = all(json.dumps(said.get(k), sort_keys=True) == json.dumps(v, sort_keys=True) for k, v in WORD_RULES.items())
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.symbols = byte_symbols()
        self.words = Learned(self._word)
        self.stems: dict[str, bytes] = {"": b""}

    def _whole(self, text: str) -> bytes:
        return b"".join([self.packed[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _stem(self, stem: str) -> bytes:
        text = stem if stem.isascii() else "".join([self.symbols[b] for b in stem.encode()])
        return b"".join([self.packed[t.id] for t in self.tokenizer.model.tokenize(text)])

    def _word(self, word: bytes) -> bytes:
        text, stems = word.decode("utf-8", "replace"), self.stems
        parts = PLAIN.fullmatch(text)
        if parts is None:
            return self._whole(text)
        stem, tail = parts[1].lower(), parts[2]
        if stem not in stems:
            stems[stem] = self._stem(stem)
        if tail not in stems:
            stems[tail] = self._whole(tail)
        return stems[stem] + stems[tail]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text."""
        if not self.by_words:
            return [self._whole(text.decode("utf-8", "replace")) for text in texts]
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if len(self.stems) > CACHE_WORDS:
            self.stems.clear()
            self.stems[""] = b""
        lookup = self.words.__getitem__
        out = [b"".join(map(lookup, text.split())) for text in texts]
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = self._whole(text.decode("utf-8", "replace"))
        return out


class Learned(dict):
    """A dictionary that learns what it lacks."""

    def __init__(self, learn: Callable[[bytes], bytes]):
        super().__init__()
        self.learn = learn

    def __missing__(self, key: bytes) -> bytes:
        value = self[key] = self.learn(key)
        return value


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Cut every document's ids (its tokens, then END_ID) into pieces of at most capacity ids.

    A null or empty text has the one id END_ID. Repeated rows give repeated pieces.
    """
    small_batches(docs.sparkSession)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches):
        encoder = WordTokenizer(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            rows = []
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size < 1 << 20):
                    size += len(texts[stop])
                    stop += 1
                for doc, data in zip(ids[at:stop], encoder.encode(texts[at:stop])):
                    data += end
                    for piece, start in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[start : start + 4 * capacity]
                        rows.append((doc, piece, start // 4, len(part) // 4, zlib.crc32(part)))
                at = stop
            if rows:
                columns = [pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def enumerate_patterns(lengths: np.ndarray, capacity: int, per_length: int = 12, most: int = 6) -> np.ndarray:
    """Patterns of 2 to most lengths that fill a sequence exactly, as many as a walk over the present lengths finds.

    Each starts from one present length, takes others from a fixed pseudo-random walk over the present lengths
    and ends with the largest present length that still fits. Rows are padded with -1; values index lengths.
    """
    n = len(lengths)
    found = [np.zeros((0, most), dtype=int)]
    walk = np.random.default_rng(5)
    for docs in range(2, most + 1):
        for _ in range(per_length if docs > 2 else 1):
            pattern = np.full((n, most), -1)
            pattern[:, 0] = np.arange(n)
            room = capacity - lengths
            for j in range(1, docs):
                fit = np.searchsorted(lengths, room, side="right") - 1
                last = j == docs - 1
                pick = fit if last else np.floor(walk.random(n) * (np.searchsorted(lengths, room // 2, side="right"))).astype(int)
                ok = (fit >= 0) & (pick >= 0) & (pick <= fit)
                pattern[:, j] = np.where(ok, pick, -1)
                room = room - np.where(ok, lengths[np.clip(pick, 0, n - 1)], 0)
            full = (room == 0) & ((pattern >= 0).sum(axis=1) == docs)
            found.append(np.sort(pattern[full], axis=1)[:, ::-1])
    return np.unique(np.concatenate(found), axis=0)


def nonnegative_fit(patterns: np.ndarray, target: np.ndarray, weights: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Repeat counts x >= 0 that bring |W (A x - target)|^2 down, by exact steps along the steepest coordinate.

    A has a column for each pattern with the number of times it uses each length. A step sets one count to its optimum
    with the others held, never below zero, so few counts are nonzero; steps end where none moves a count by `least`.
    """
    n, m = len(patterns), len(target)
    rows, cols = np.nonzero(patterns >= 0)
    entry, times = np.unique(rows * m + patterns[rows, cols], return_counts=True)
    row, length, w2 = entry // m, entry % m, weights**2
    start = np.searchsorted(row, np.arange(n + 1))
    by_length = np.argsort(length, kind="stable")
    users = np.searchsorted(length[by_length], np.arange(m + 1))
    norm = np.bincount(row, weights=w2[length] * times**2, minlength=n)
    slope = np.bincount(row, weights=w2[length] * times * target[length], minlength=n)
    x, gain = np.zeros(n), np.maximum(slope, 0) / np.sqrt(norm)
    for _ in range(8 * m):
        j = int(gain.argmax())
        step = max(slope[j] / norm[j], -x[j])
        if abs(step) < least:
            break
        x[j] += step
        touched = []
        for e in range(start[j], start[j + 1]):
            at = by_length[users[length[e]] : users[length[e] + 1]]
            slope[row[at]] -= step * w2[length[e]] * times[e] * times[at]
            touched.append(row[at])
        t = np.concatenate(touched)
        gain[t] = np.where(x[t] > 0, np.abs(slope[t]), np.maximum(slope[t], 0)) / np.sqrt(norm[t])
    return x


Slots = tuple[tuple[int, int], ...]


def fitted(histogram: dict[int, int], capacity: int, rounds: int) -> list[tuple[list[tuple[int, Slots]], dict[int, int]]]:
    """After each round: [(repeats, ((length, copies), ...)), ...] of full sequences by fitted patterns, and the pieces left over."""
    left, done = {k: n for k, n in histogram.items() if n > 0}, []
    states = [(done, left)]
    for _ in range(rounds):
        lengths = np.array(sorted(k for k, n in left.items() if n and k < capacity), dtype=np.int64)
        patterns = enumerate_patterns(lengths, capacity) if len(lengths) else []
        if not len(patterns):
            break
        count, done = np.array([left[int(k)] for k in lengths], dtype=np.int64), list(done)
        repeats, before = nonnegative_fit(patterns, count.astype(float), lengths / capacity), len(done)
        for i in np.argsort(-repeats, kind="stable"):
            if repeats[i] < 0.5:
                break
            used, times = np.unique(patterns[i][patterns[i] >= 0], return_counts=True)
            repeat = int(min(round(repeats[i]), (count[used] // times).min()))
            if repeat > 0:
                count[used] -= repeat * times
                done.append((repeat, tuple((int(lengths[u]), int(k)) for u, k in zip(used, times))))
        if len(done) == before:
            break
        left = left | dict(zip(lengths.tolist(), count.tolist()))
        states.append((done, left))
    return states


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, Slots]]:
    """Pieces, longest first, into the fullest sequence with room, counted by length rather than one by one."""
    groups: dict[int, list[list]] = {}
    rooms: list[int] = []
    done: list[tuple[int, Slots]] = []

    def put(room: int, count: int, slots: Slots) -> None:
        if room == 0:
            done.append((count, slots))
            return
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append([count, slots])

    for length in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        n = histogram[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                count, slots = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, count, slots = capacity, n, ()
            copies = min(room // length, n)
            take = min(count, n // copies)
            if take < count and slots:
                put(room, count - take, slots)
            n -= take * copies
            put(room - length * copies, take, (*slots, (length, copies)))
    return done + [(c, s) for room in rooms for c, s in groups[room]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[int, Slots]]:
    """[(repeats, ((length, copies), ...)), ...] that uses every piece of the histogram exactly once.

    Patterns get their rounded non-negative least squares counts as long as pieces are left; the residual pieces are
    packed best fit. Where the residual does not come out in the fewest sequences that its ids need, fewer rounds of
    patterns are tried, which leave more pieces to fill gaps with; the plan with the fewest sequences is taken.
    """
    need, best = -(-sum(k * n for k, n in histogram.items()) // capacity), None
    for done, left in reversed(fitted(histogram, capacity, rounds)):
        found = done + best_fit(left, capacity)
        if best is None or sum(n for n, _ in found) < sum(n for n, _ in best):
            best = found
        if sum(n for n, _ in best) <= need:
            break
    return best


def recipe(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: where runs of its pieces start (by rank), the run's first sequence and its offset there."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for repeat, slots in patterns:
        offset = 0
        for length, copies in slots:
            for _ in range(copies):
                runs.setdefault(length, []).append((repeat, base, offset))
                offset += length
        base += repeat
    out = {}
    for length, rows in runs.items():
        repeat, first, offset = (np.array(c, dtype=np.int64) for c in zip(*rows))
        out[length] = (np.concatenate(([0], np.cumsum(repeat)[:-1])), first, offset)
    return out


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into sequences of at most capacity ids; one row per piece.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Pieces of equal length are exchangeable,
    so a piece's place follows from its rank within its length. Ranks are counted in salted sub-groups whose
    sizes are summed first: a length that a third of all pieces share is not ordered in one task.
    Empty input gives no rows; extra columns are ignored; null ids are kept.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer, capacity), "pieces")
    sizes = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = int(min(4096, max(16, sum(sizes.values()) // 100_000)))
    table = spark.sparkContext.broadcast(recipe(plan(sizes, capacity)))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.row_number().over(order) - 1)

    def place(batches):
        runs = table.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for value in np.unique(length):
                starts, first, at = runs[int(value)]
                rows = np.flatnonzero(length == value)
                run = np.searchsorted(starts, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = first[run] + rank[rows] - starts[run], at[run]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")
