"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

A logistic model on word and shape features gives each document's evidence. Hosts and the paths below them get
posteriors by grouped aggregation: a host is shrunk towards the global rate, a path towards its host, by as much as
the spread between hosts warrants (method of moments). A document's posterior odds are its own odds times what its
path, without the document itself, adds over the global rate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasmill.llm.arrays import LOWER, byte_parts, word_hashes, words_of
from atlasmill.llm.tables import bounded_sample, small_batches
from atlasmill.session import materialize

SLOTS = 1 << 15
#: Labelled documents of each class that the model is fitted on.
SAMPLE = 2500
EPOCHS = 40
#: Groups up to which their table is broadcast; beyond, it is a shuffled join.
BROADCAST_GROUPS = 20_000
SHAPE = 9
KINDS = np.zeros((256, 5), dtype=np.float32)
KINDS[65:91, 0] = 1
KINDS[48:58, 1] = 1
KINDS[[ord(c) for c in "!?"], 2] = 1
KINDS[[ord(c) for c in "#$%&*|{}[]<>=+~^_\\/@"], 3] = 1
KINDS[10, 4] = 1


def features(column: pa.Array):
    """Yield (first row, slots, row starts, shape): hashed words of each row, and its shape features."""
    for at, buf, offsets in byte_parts(column, 1 << 20):
        n = len(offsets) - 1
        starts, ends, rows = words_of(buf, offsets)
        words = word_hashes(LOWER[buf], starts, ends)
        edge = np.searchsorted(rows, np.arange(n + 1))
        count, size = np.maximum(np.diff(edge), 1), np.maximum(np.diff(offsets), 1)
        shape = np.zeros((n, SHAPE), dtype=np.float32)
        for j in range(KINDS.shape[1]):
            total = np.concatenate(([0], np.cumsum(KINDS[:, j][buf], dtype=np.float64)))
            shape[:, j] = (total[offsets[1:]] - total[offsets[:-1]]) / size
        again = np.zeros(len(words) + 1)
        again[2:] = np.cumsum((words[1:] == words[:-1]) & (rows[1:] == rows[:-1]))[: max(0, len(words) - 1)] if len(words) > 1 else 0
        shape[:, 5] = (again[edge[1:]] - again[np.minimum(edge[:-1] + 1, edge[1:])]) / count
        order = np.lexsort((words, rows))
        kinds = np.ones(len(words), dtype=np.float64)
        kinds[1:] = (words[order][1:] != words[order][:-1]) | (rows[order][1:] != rows[order][:-1])
        total = np.concatenate(([0], np.cumsum(kinds)))
        shape[:, 6] = (total[edge[1:]] - total[edge[:-1]]) / count
        shape[:, 7] = np.log1p(np.diff(edge)) / 10
        shape[:, 8] = np.minimum(size / count, 40) / 40
        yield at, (words % np.uint64(SLOTS)).astype(np.int32), edge, np.sqrt(shape)


class Model:
    """Logistic weights of word slots and shape features."""

    def __init__(self):
        self.words, self.shape, self.bias = np.zeros(SLOTS), np.zeros(SHAPE), 0.0

    def logits(self, slots: np.ndarray, edge: np.ndarray, shape: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(self.words[slots])))
        return (total[edge[1:]] - total[edge[:-1]]) / np.sqrt(np.maximum(np.diff(edge), 1)) + shape @ self.shape + self.bias

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, prior: float, epochs: int = EPOCHS) -> None:
        """Adam on the logistic loss with a small L2 penalty; classes weighted alike, then the bias moved to the prior rate."""
        rng = np.random.default_rng(1)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        params = {"w": self.words, "s": self.shape, "b": np.zeros(1)}
        m, v, step = {k: np.zeros_like(p) for k, p in params.items()}, {k: np.zeros_like(p) for k, p in params.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for part in np.array_split(order, max(1, len(docs) // 256)):
                sizes = np.array([len(docs[i][0]) for i in part])
                slots = np.concatenate([docs[i][0] for i in part])
                edge, shape = np.concatenate(([0], np.cumsum(sizes))), np.stack([docs[i][1] for i in part])
                self.bias = float(params["b"][0])
                error = (1 / (1 + np.exp(-np.clip(self.logits(slots, edge, shape), -30, 30))) - y[part]) * weight[part] / len(part)
                scale = np.repeat(error / np.sqrt(np.maximum(sizes, 1)), sizes)
                grad = {"w": np.bincount(slots, weights=scale, minlength=SLOTS) + 1e-5 * params["w"], "s": shape.T @ error, "b": np.array([error.sum()])}
                step += 1
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    params[k] -= (0.02 if k == "w" else 0.05) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.bias = float(params["b"][0]) + float(np.log(prior / (1 - prior)))


def fit_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Model, float]:
    """The model and the rate of good documents among the labelled ones. Good: quality 1 and not toxic; null labels are skipped.

    The sample is the labelled documents with the smallest hashed ids of each class, of repeated ids the text with the
    smallest hash; only their features reach the driver.
    """
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    marked = labels.where("quality is not null and doc_id is not null").select("doc_id", good.alias("good")).groupBy("doc_id").agg(F.min("good").alias("good"))
    chosen = bounded_sample(marked, "good", ["doc_id"], sample)
    row = marked.agg(F.avg("good").alias("rate")).first()
    rate = min(max(row["rate"] if row["rate"] is not None else 0.5, 0.01), 0.99)

    def gather(batches):
        for batch in batches:
            slots, shapes = [], []
            for _, words, edge, shape in features(batch.column(1)):
                slots += [words[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]
                shapes += [s.astype(np.float32).tobytes() for s in shape]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots, type=pa.binary()), pa.array(shapes, type=pa.binary())], names=["good", "slots", "shape"])

    held = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = held.groupBy("doc_id", "good").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("good", "t.text")
    rows = sorted((r["good"], bytes(r["slots"]), bytes(r["shape"])) for r in texts.mapInArrow(gather, "good int, slots binary, shape binary").collect())
    model = Model()
    if len({r[0] for r in rows}) == 2:
        model.fit([(np.frombuffer(s, dtype=np.int32), np.frombuffer(f, dtype=np.float32).astype(float)) for _, s, f in rows], np.array([r[0] for r in rows]), rate)
    else:
        model.bias = float(np.log(rate / (1 - rate)))
    return model, rate


def document_scores(docs: DataFrame, model: Model, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, logit, p of every document; a null text is an empty one."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            logit = np.zeros(batch.num_rows)
            for at, slots, edge, shape in features(batch.column(3)):
                logit[at : at + len(edge) - 1] = np.clip(held.value.logits(slots, edge, shape), -30, 30)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(logit), pa.array(1 / (1 + np.exp(-logit)))], names=["doc_id", "host", "path", "logit", "p"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), "text")
    return rows.mapInArrow(score, "doc_id long, host string, path string, logit double, p double")


def _strength(mean: Column) -> Column:
    """Pseudo-count of the prior from the spread of group means around `mean`, beyond what sampling explains."""
    rate = F.sum("s") / F.sum("n")
    spread = F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2) / F.sum("n")
    noise = F.sum(F.col("v")) / F.sum("n") / (F.sum("n") / F.count("*"))
    return F.greatest(F.lit(1.0), F.least(F.lit(1e4), rate * (1 - rate) / F.greatest(spread - noise, F.lit(1e-6)) - 1))


def quality_posteriors(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep_from: float = 0.5) -> DataFrame:
    """doc_id, host, path, classifier, host_posterior, path_posterior, posterior, keep for every document.

    Null hosts and paths are the empty string. Repeated rows count as documents of their own; an empty table gives
    no rows; without labels of both classes the classifier is flat and everything rests on the prior.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # The prior is the mean over all documents: the labelled ones need not be like the rest.
    model, _ = fit_model(docs, labels)
    scored = materialize(document_scores(docs, model, F.col(host), F.col(path)), "scored")
    # Documents to paths with map-side combine; hosts from the paths, so a host with a third of all documents is a few rows.
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * (1 - F.col("p"))).alias("v"))
    paths = materialize(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("v").alias("v"))
    top = hosts.agg(F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.5)).alias("rate")).first()["rate"]
    rate = min(max(top, 1e-6), 1 - 1e-6)
    strong = hosts.agg(_strength(F.lit(rate)).alias("k")).first()["k"] or 1.0
    hosts = hosts.select("host", ((F.col("s") + strong * rate) / (F.col("n") + strong)).alias("host_posterior"))
    below = paths.join(hosts, "host")
    strong_path = below.agg(_strength(F.col("host_posterior")).alias("k")).first()["k"] or 1.0
    below = below.select("host", "path", "n", "s", "host_posterior")
    if below.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        below = F.broadcast(below)
    out = scored.join(below, ["host", "path"])
    others = (F.col("s") - F.col("p") + strong_path * F.col("host_posterior")) / (F.col("n") - 1 + strong_path)
    others = F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6))
    out = out.withColumn("path_posterior", others)
    odds = F.col("logit") + F.log(F.col("path_posterior") / (1 - F.col("path_posterior"))) - F.lit(float(np.log(rate / (1 - rate))))
    posterior = 1 / (1 + F.exp(-odds))
    return out.select("doc_id", "host", "path", F.col("p").alias("classifier"), "host_posterior", "path_posterior", posterior.alias("posterior"), (posterior >= keep_from).alias("keep"))
