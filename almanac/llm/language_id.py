"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy."""

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import hash_fraction, missing, utf8, values

UNKNOWN = "und"
LONGEST = 24  # bytes of one sequence; longer runs without white space are cut
TRAIN_DOCS = 400  # labelled documents of each language that training looks at, about
TRAIN_WORDS = 60  # sequences of each of them, evenly spread over the whole text
KEPT = 300_000  # sequences whose labels a task remembers
PREDICTION = "struct<lang:string,score:double>"
_ARROW_PREDICTION = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def sequences(text: str | None) -> list[bytes]:
    """What the network reads: runs without white space, A-Z lower-cased, cut every ``LONGEST`` bytes."""
    words = utf8(text).lower().split()
    if any(len(w) > LONGEST for w in words):
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def _padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    block = np.zeros((len(words), int(lengths.max())), np.uint8)
    block[np.arange(block.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return block, lengths


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two gated recurrent layers, one per direction, and one label distribution for every byte."""

    def __init__(self, labels: list[str], hidden: int = 16, seed: int = 7):
        self.labels, self.hidden = labels, hidden
        rng = np.random.default_rng(seed)
        h, f = hidden, np.float32
        self.w = {}
        for d in ("f", "b"):
            self.w[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(f)
            self.w[f"h{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(f)
            self.w[f"c{d}"] = np.zeros(3 * h, f)
        self.w["o"] = rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, len(labels))).astype(f)
        self.w["p"] = np.zeros(len(labels), f)

    def _run(self, d: str, block: np.ndarray, lengths: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction at every position; past its end a sequence keeps the zero state it starts with."""
        n, steps, h = len(block), block.shape[1], self.hidden
        x, u, c = self.w[f"x{d}"], self.w[f"h{d}"], self.w[f"c{d}"]
        state, out = np.zeros((n, h), np.float32), np.zeros((steps, n, h), np.float32)
        for t in range(steps) if d == "f" else reversed(range(steps)):
            a = x[block[:, t]] + c
            b = state @ u
            gate = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
            z, r = gate[:, :h], gate[:, h:]
            new = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
            live = (t < lengths)[:, None]
            after = np.where(live, new + z * (state - new), state)
            if keep is not None:
                keep.append((t, state, z, r, new, b[:, 2 * h :], live))
            state = out[t] = after
        return out

    def probabilities(self, block: np.ndarray, lengths: np.ndarray, keep: dict | None = None):
        """(steps, sequences, labels): the label distribution of every byte."""
        runs = {d: [] for d in "fb"} if keep is not None else {"f": None, "b": None}
        states = np.concatenate([self._run(d, block, lengths, runs[d]) for d in "fb"], axis=2)
        logits = states @ self.w["o"] + self.w["p"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        if keep is not None:
            keep.update(runs=runs, states=states)
        return p

    def gradients(self, block: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time of the mean cross-entropy over all bytes."""
        keep: dict = {}
        p = self.probabilities(block, lengths, keep)
        live = np.arange(block.shape[1])[:, None] < lengths
        p[:, np.arange(len(block)), target] -= 1
        p *= (live / live.sum())[:, :, None]
        h, states = self.hidden, keep["states"]
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["o"] = np.tensordot(states, p, ([0, 1], [0, 1]))
        g["p"] = p.sum(axis=(0, 1))
        back = p @ self.w["o"].T
        for d, part in (("f", back[:, :, :h]), ("b", back[:, :, h:])):
            u, ds = self.w[f"h{d}"], np.zeros((len(block), h), np.float32)
            for t, before, z, r, new, inner, on in reversed(keep["runs"][d]):
                ds = ds + part[t]
                live_ds = np.where(on, ds, 0)
                dnew = live_ds * (1 - z) * (1 - new * new)
                dz = live_ds * (before - new) * z * (1 - z)
                dr = dnew * inner * r * (1 - r)
                da = np.concatenate([dz, dr, dnew], axis=1)
                db = np.concatenate([dz, dr, dnew * r], axis=1)
                g[f"h{d}"] += before.T @ db
                g[f"c{d}"] += da.sum(axis=0)
                np.add.at(g[f"x{d}"], block[:, t], da)
                ds = np.where(on, live_ds * z, ds) + db @ u.T
        return g

    def fit(self, words: list[bytes], target: np.ndarray, epochs: int = 4, batch: int = 512, rate: float = 0.01):
        """Adam over batches of sequences of similar length, in an order that the seed fixes."""
        rng = np.random.default_rng(11)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        step, n_batches = 0, -(-len(words) // batch)
        for epoch in range(epochs):
            order = rng.permutation(len(words))
            order = order[np.argsort(lengths[order], kind="stable")]
            for k in rng.permutation(n_batches):
                rows = order[k * batch : (k + 1) * batch]
                block, n = _padded([words[i] for i in rows])
                step += 1
                pace = rate * (1 - 0.8 * (epoch / epochs))
                for name, grad in self.gradients(block, n, target[rows]).items():
                    first[name] += 0.1 * (grad - first[name])
                    second[name] += 0.002 * (grad * grad - second[name])
                    m, v = first[name] / (1 - 0.9**step), second[name] / (1 - 0.998**step)
                    self.w[name] -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, words: list[bytes], batch: int = 2048) -> np.ndarray:
        """For each sequence the sum of its bytes' label probabilities."""
        out = np.empty((len(words), len(self.labels)), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            block, lengths = _padded([words[i] for i in rows])
            p = self.probabilities(block, lengths)
            out[rows] = (p * (np.arange(block.shape[1])[:, None] < lengths)[:, :, None]).sum(axis=0)
        return out


class Predictor:
    """Predicts texts a few at a time, and remembers the labels of up to ``KEPT`` sequences."""

    def __init__(self, network: Network):
        self.network, self.row = network, {}
        self.sums = np.zeros((0, len(network.labels)), np.float32)

    def predict(self, texts: list[str | None]) -> list[dict]:
        split = [sequences(t) if t is not None and any(map(str.isalpha, t)) else None for t in texts]
        row = self.row
        new = list(dict.fromkeys(w for s in split if s for w in s if w not in row))
        if len(row) + len(new) > KEPT:  # what came first is what comes often
            row = self.row = dict(islice(row.items(), KEPT // 2))
            self.sums = self.sums[: len(row)]
            new = list(dict.fromkeys(w for s in split if s for w in s if w not in row))
        if new:
            row.update(zip(new, range(len(row), len(row) + len(new)), strict=True))
            self.sums = np.concatenate([self.sums, self.network.pooled(new)])
        out = []
        for s in split:
            if s is None:
                out.append({"lang": UNKNOWN, "score": 0.0})
                continue
            total = self.sums[list(map(row.__getitem__, s))].sum(axis=0, dtype=np.float64)
            best = int(total.argmax())
            out.append({"lang": self.network.labels[best], "score": min(1.0, float(total[best] / total.sum()))})
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", docs_per_lang: int = TRAIN_DOCS) -> Network | None:
    """A network from the labelled documents that aren't held out; None if there is no such document.

    ``docs_per_lang`` bounds the sample (about; documents are chosen by a hash of their id), ``TRAIN_WORDS`` the
    sequences of each, taken at even distances over the whole text. Rows without id, text or language don't teach.
    """
    docs = missing(docs, "lang", "string").where("doc_id is not null and text is not null and lang is not null")
    known = docs.where(~held_out(F.col("doc_id"))).select("doc_id", F.col(text_col).alias("text"), "lang")
    counts = dict(known.groupBy("lang").count().collect())  # one row for each language
    if not counts:
        return None
    chosen = F.lit(False)
    for lang, there in sorted(counts.items()):
        chosen = chosen | ((F.col("lang") == lang) & hash_fraction(F.col("doc_id"), docs_per_lang, there, 3))

    @F.arrow_udf("array<binary>")
    def spread(texts: pa.Array) -> pa.Array:
        rows = [sequences(t) for t in values(texts)]
        return pa.array([s[:: max(1, -(-len(s) // TRAIN_WORDS))] for s in rows], pa.list_(pa.binary()))

    sample = known.where(chosen).select("doc_id", "lang", spread("text").alias("words")).collect()
    pairs = sorted((bytes(w), r["lang"]) for r in sample for w in r["words"])
    labels = sorted({lang for _, lang in pairs})
    if not labels:
        return None
    number = {lang: i for i, lang in enumerate(labels)}
    target = np.fromiter((number[lang] for _, lang in pairs), np.int64, len(pairs))
    return Network(labels).fit([w for w, _ in pairs], target)


def predict(text: Column, docs: DataFrame, network: Network | None) -> Column:
    """Language and score of each text, as a struct; see ``identify``."""
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(network))

    @F.arrow_udf(PREDICTION)
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = cloudpickle.loads(shared.value)
        predictor = Predictor(model) if model else None
        for texts in batches:
            rows = []
            for i in range(0, len(texts), 200):
                some = texts.slice(i, 200).to_pylist()
                rows += predictor.predict(some) if predictor else [{"lang": UNKNOWN, "score": 0.0}] * len(some)
            yield pa.array(rows, _ARROW_PREDICTION)

    return predicted(text)


def identify(docs: DataFrame, network: Network | None = None, text_col: str = "text") -> DataFrame:
    """Add ``held_out``, ``lang_pred`` and ``score``; trains on ``docs`` itself where no network is given.

    Every byte of a text gets a label distribution from the states of both directions; the document's is their mean,
    and ``score`` the share of the best language. Sequences start and end at white space, so equal words get equal
    labels and are computed once.

    Null texts and texts without a letter are ``und`` with score 0; so is everything if nothing can be learned. Rows
    without id are not held out. Repeated rows get equal results; columns with a name of the result are replaced.
    """
    network = network or train(docs, text_col)
    found = docs.withColumn("_found", predict(F.col(text_col), docs, network))
    return found.withColumns({
        "held_out": held_out(F.col("doc_id")), "lang_pred": F.col("_found.lang"), "score": F.col("_found.score"),
    }).drop("_found")


def keep_languages(docs: DataFrame, languages: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """Rows in one of ``languages`` (any learned one if None) with at least that score, with their own columns."""
    found = docs.withColumn("_found", predict(F.col("text"), docs, train(docs)))
    kept = F.col("_found.lang").isin(languages) if languages else F.col("_found.lang") != UNKNOWN
    return found.where(kept & (F.col("_found.score") >= least)).select(*docs.columns)
