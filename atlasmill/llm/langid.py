"""Language identification by a byte convolutional network, trained in numpy and applied to windows of whole texts.

A text is cut into windows of 256 bytes. Filters of widths 2, 3 and 4 over one-hot bytes, rectified and max-pooled
over the window, feed a softmax over the learned languages. A text's probabilities are the means over its windows,
weighted by the bytes they hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasmill.llm.tables import apart, bounded_sample, small_batches, together

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: The training sample: documents of each language, and windows of each of them.
SAMPLE_DOCS = 500
SAMPLE_WINDOWS = 4
STEPS = 1200
BATCH = 96


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text as rows of bytes, the last one zero-filled; an empty text has none."""
    count = -(-len(data) // WINDOW)
    return np.frombuffer(data + b"\0" * (count * WINDOW - len(data)), dtype=np.uint8).reshape(count, WINDOW)


class ByteNet:
    """Parameters: for each width one (width, 256, FILTERS) filter bank with biases; the softmax layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {f"w{k}": rng.normal(0, 0.1, (k, 256, FILTERS)).astype(np.float32) for k in WIDTHS}
        self.p |= {f"b{k}": np.zeros(FILTERS, dtype=np.float32) for k in WIDTHS}
        self.p |= {"v": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32), "c": np.zeros(len(languages), dtype=np.float32)}

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Training form: pooled values and where in the window each maximum stands."""
        values, places = [], []
        for k in WIDTHS:
            w, n = self.p[f"w{k}"], WINDOW - k + 1
            out = w[0][x[:, :n]]
            for j in range(1, k):
                out += w[j][x[:, j : j + n]]
            at = out.argmax(axis=1)
            values.append(np.take_along_axis(out, at[:, None, :], axis=1)[:, 0] + self.p[f"b{k}"])
            places.append(at)
        return np.concatenate(values, axis=1), places

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy and its gradients."""
        raw, places = self._pooled(x)
        h = np.maximum(raw, 0)
        logits = h @ self.p["v"] + self.p["c"]
        prob = softmax(logits)
        rows = np.arange(len(y))
        loss = float(-np.log(np.maximum(prob[rows, y], 1e-12)).mean())
        prob[rows, y] -= 1
        prob /= len(y)
        grad = {"v": h.T @ prob, "c": prob.sum(axis=0)}
        back = (prob @ self.p["v"].T) * (raw > 0)
        for i, k in enumerate(WIDTHS):
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            g = np.zeros_like(self.p[f"w{k}"])
            filters = np.broadcast_to(np.arange(FILTERS), part.shape)
            for j in range(k):
                np.add.at(g[j], (x[rows[:, None], places[i] + j], filters), part)
            grad[f"w{k}"], grad[f"b{k}"] = g, part.sum(axis=0)
        return loss, grad

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 0.01, seed: int = 3) -> None:
        """Adam over random batches; every language is drawn equally often; a third of the windows are cut short."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(y == i) for i in range(len(self.languages))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(g, BATCH // len(groups) + 1) for g in groups])
            part = x[pick].copy()
            short = np.flatnonzero(rng.random(len(pick)) < 0.33)
            for i, n in zip(short, rng.integers(12, WINDOW, len(short))):
                part[i, n:] = 0
            _, grad = self.gradients(part, y[pick])
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.001 * (g * g - s[k])
                self.p[k] -= rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def compile(self):
        """Filters as tables over byte pairs, so that a position costs two lookups instead of nine."""
        first, second = np.divmod(np.arange(65536), 256)
        w2, w3, w4 = (self.p[f"w{k}"] for k in WIDTHS)
        self.pairs = np.concatenate([w2[0][first] + w2[1][second], w3[0][first] + w3[1][second], w4[0][first] + w4[1][second], w4[2][first] + w4[3][second]], axis=1)
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of windows; needs compile()."""
        n = FILTERS
        got = self.pairs[x[:, :-1].astype(np.int32) * 256 + x[:, 1:]]
        two = got[:, :, :n].max(axis=1)
        three = (got[:, :-1, n : 2 * n] + self.p["w3"][2][x[:, 2:]]).max(axis=1)
        four = (got[:, :-2, 2 * n : 3 * n] + got[:, 2:, 3 * n :]).max(axis=1)
        raw = np.concatenate([two + self.p["b2"], three + self.p["b3"], four + self.p["b4"]], axis=1)
        return softmax(np.maximum(raw, 0) @ self.p["v"] + self.p["c"])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def held_out(doc_id="doc_id"):
    """True for the documents whose crc32(doc_id as text) mod 4 is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame) -> ByteNet | None:
    """Fit the network on windows of at most SAMPLE_DOCS labelled documents of each language that are not held out.

    The sample is the documents with the smallest hashes of id and text of each language, repeated rows once; only
    their windows reach the driver. A null id counts as not held out. None where no row is labelled.
    """
    small_batches(docs.sparkSession)
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & ~held_out())
    texts = bounded_sample(usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text"), "lang", ["doc_id", "text"], SAMPLE_DOCS)

    def cut(batches):
        for batch in batches:
            langs, out = [], []
            for doc, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = text.encode()
                every = windows_of(data)
                rng = np.random.default_rng(abs(hash(doc)) if doc is not None else 0)
                for i in sorted(rng.choice(len(every), min(SAMPLE_WINDOWS, len(every)), replace=False)):
                    langs.append(lang)
                    out.append(every[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, type=pa.string()), pa.array(out, type=pa.binary())], names=["lang", "bytes"])

    rows = sorted((r["lang"], bytes(r["bytes"])) for r in texts.select("doc_id", "lang", "text").mapInArrow(cut, "lang string, bytes binary").collect())
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    net = ByteNet(languages)
    net.fit(np.frombuffer(b"".join(r[1] for r in rows), dtype=np.uint8).reshape(-1, WINDOW), np.array([languages.index(r[0]) for r in rows]))
    return net


def classify(net: ByteNet | None, texts: list[bytes | None], letters: list[bool]) -> tuple[list[str], list[float]]:
    """Language and score of each text; 'und' and 0 where it has no letter, or nothing was learned."""
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    rows = [i for i in range(len(texts)) if letters[i] and net is not None]
    at = 0
    while at < len(rows):
        group, size = [], 0
        while at < len(rows) and size < 1 << 16:
            group.append(rows[at])
            size += len(texts[rows[at]])
            at += 1
        sizes = np.array([len(texts[i]) for i in group])
        counts = -(-sizes // WINDOW)
        x = np.concatenate([windows_of(texts[i]) for i in group])
        prob = np.concatenate([net.probabilities(x[k : k + 256]) for k in range(0, len(x), 256)])
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        weight = np.full(len(x), WINDOW, dtype=np.float64)
        weight[first + counts - 1] = sizes - (counts - 1) * WINDOW
        mean = np.add.reduceat(prob * weight[:, None], first) / sizes[:, None]
        best = mean.argmax(axis=1)
        for i, b, s in zip(group, best, mean[np.arange(len(best)), best]):
            names[i], scores[i] = net.languages[b], min(1.0, float(s))
    return names, scores


LETTERS = r"coalesce(text rlike '\\p{L}', false)"


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, from text alone.

    A null text or one without a letter is 'und' with score 0, as is every text if no row is labelled. Extra columns
    are ignored, repeated rows stay, an empty table gives no rows.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(train(docs))

    def run(batches):
        net = held.value.compile() if held.value is not None else None
        for batch in batches:
            names, scores = classify(net, batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text", F.expr(LETTERS).alias("letters"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def of_known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents with a predicted language whose score is at least `least`, in their own columns.

    Null texts, texts without a letter and all texts where no row is labelled go; repeated rows stay or go together;
    an empty table gives no rows; other columns are carried along.
    """
    held, columns = docs.sparkSession.sparkContext.broadcast(train(docs)), docs.columns

    def run(batches):
        net = held.value.compile() if held.value is not None else None
        for batch in batches:
            names, scores = classify(net, batch.column(0).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist())
            keep = pa.array([n != "und" and s >= least for n, s in zip(names, scores)], type=pa.bool_())
            whole = together(columns, batch.column(0), batch.column(1))
            yield pa.RecordBatch.from_arrays(list(whole.values()), names=columns).filter(keep)

    return apart(docs).select("text", "rest", F.expr(LETTERS)).mapInArrow(run, docs.schema)
