"""Quality: ordinal cumulative-link regression over hashed text, fitted on graded ratings."""

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import hash_fraction, utf8, values

BITS = 18
TRAIN_ROWS = 12_000  # rated documents that training looks at, about
GRADES = 3  # 0 toxic, 1 poor, 2 good
GOOD_KEPT = 0.98  # of held-out good documents the cut keeps at least so many
KEPT = 300_000
EDGES = b".,;:!?\"'()"
GOOD = f"struct<expected_grade:double,{','.join(f'p_at_least_{k}:double' for k in range(1, GRADES))}>"
_ARROW_GOOD = pa.struct([("expected_grade", pa.float64()), *((f"p_at_least_{k}", pa.float64()) for k in range(1, GRADES))])


class Hasher:
    """Hashed features of a text: its words, and its shape as the steps that it reaches."""

    def __init__(self, bits: int = BITS):
        self.mask, self.place = (1 << bits) - 1, {}

    def _at(self, word: bytes) -> int:
        n = self.place.get(word)
        if n is None:
            if len(self.place) >= KEPT:
                self.place.clear()
            n = self.place[word] = zlib.crc32(word) & self.mask
        return n

    def features(self, text: str | None) -> np.ndarray:
        """Places of the features. A word counts once, however often and in however long a text it stands."""
        raw = utf8(text)
        words = [w.strip(EDGES) or w for w in raw.lower().split()]
        if not words:
            return np.empty(0, np.int32)
        at = set(map(self._at, words))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        symbols = codes[33:48].sum() + codes[58:65].sum() + codes[91:97].sum() + codes[123:127].sum()
        shape = {
            b"words": int(np.log2(len(words))),
            b"varied": int(20 * len(at) / len(words)),
            b"long": min(40, int(2 * len(raw) / len(words))),
            b"symbols": int(40 * symbols / len(raw)),
            b"digits": int(20 * codes[48:58].sum() / len(raw)),
            b"capitals": int(20 * codes[65:91].sum() / len(raw)),
            b"lines": int(20 * len(set(lines)) / len(lines)),
        }
        extra = [zlib.crc32(b"\x00%s %d" % (k, i)) & self.mask for k, v in shape.items() for i in range(v + 1)]
        return np.array(sorted(at.union(extra)), np.int32)


class Ordinal:
    """P(grade >= k) = sigmoid(w x - t_k), one weight vector for all grades, t_1 < t_2 < ..."""

    def __init__(self, bits: int = BITS, grades: int = GRADES):
        self.w, self.bits = np.zeros(1 << bits), bits
        self.thresholds = np.linspace(-1.0, 1.0, grades - 1) if grades > 2 else np.zeros(grades - 1)
        self.cut = 0.5  # of the last tail, for a document to be selected

    def fit(
        self, rows: list[np.ndarray], grade: np.ndarray, weight: np.ndarray | None = None,
        rounds: int = 150, penalty: float = 1e-3, least: int = 5,
    ):
        """Adam on the mean log-likelihood, rows by ``weight``. Thresholds are a first one and the logs of the steps, so
        they stay ordered.

        Features in fewer than ``least`` rows teach nothing about other texts: their weight stays 0.
        """
        weight = np.full(len(rows), 1 / len(rows)) if weight is None else weight / weight.sum()
        used, at, seen = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        common = seen >= least
        of, at, used = of[common[at]], (np.cumsum(common) - 1)[at[common[at]]], used[common]
        free = np.concatenate([self.thresholds[:1], np.log(np.diff(self.thresholds)), np.zeros(len(used))])
        k, first, second = len(self.thresholds), np.zeros_like(free), np.zeros_like(free)
        for step in range(1, rounds + 1):
            t = free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:k]))))
            s = np.bincount(of, free[k:][at], len(rows))
            tail = 1 / (1 + np.exp(t - s[:, None]))
            padded = np.hstack([np.ones((len(rows), 1)), tail, np.zeros((len(rows), 1))])
            slope = np.hstack([np.zeros((len(rows), 1)), tail * (1 - tail), np.zeros((len(rows), 1))])
            i = np.arange(len(rows))
            p = np.maximum(padded[i, grade] - padded[i, grade + 1], 1e-12)
            ds = -(slope[i, grade] - slope[i, grade + 1]) / p * weight
            dt = np.zeros(k + 2)
            np.add.at(dt, grade, slope[i, grade] / p * weight)
            np.add.at(dt, grade + 1, -slope[i, grade + 1] / p * weight)
            dt = dt[1 : k + 1]
            steps = [dt[j + 1 :].sum() * np.exp(free[j + 1]) for j in range(k - 1)]
            grad = np.concatenate([[dt.sum()], steps, np.bincount(at, ds[of], len(used))])
            grad[k:] += penalty * free[k:]
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            free -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-10)
        self.thresholds = free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:k]))))
        self.w[used] = free[k:]
        return self

    def tails(self, row: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds - self.w[row].sum(), -700, 700)))


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 poor, 2 good. Rows with a null are left out; of several ratings the lowest holds."""
    rated = labels.select("doc_id", "quality", "toxic").dropna()
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    return rated.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def quotas(there: dict[int, int], rows: int) -> dict[int, int]:
    """How many rows of each grade to take: equal numbers, and what a grade doesn't have goes to the others."""
    out: dict[int, int] = {}
    for i, (g, n) in enumerate(sorted(there.items(), key=lambda x: (x[1], x[0]))):
        out[g] = min(n, (rows - sum(out.values())) // (len(there) - i))
    return out


def cut_of(tail: np.ndarray, grade: np.ndarray) -> float:
    """The cut for held-out tails: of those that keep ``GOOD_KEPT`` of the good documents, the one with the greatest sum of
    the share of good ones kept and the shares of the other grades removed."""
    good = np.sort(tail[grade == GRADES - 1])
    others = [np.sort(tail[grade == g]) for g in range(GRADES - 1) if (grade == g).any()]
    if not len(good) or not others:
        return 0.5
    allowed = good[: int((1 - GOOD_KEPT) * len(good)) + 1]
    total = 1 - np.searchsorted(good, allowed) / len(good)
    for t in others:
        total += np.searchsorted(t, allowed) / len(t)
    return float(allowed[np.argmax(total)])


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Ordinal | None:
    """Fit on about ``train_rows`` rated documents, chosen by a hash of their id; None if none has words.

    Grades are sampled apart (see ``quotas``), so rare ones teach with all their rows; weights give them their share of
    the ratings back. The cut is set on the tails that models of two thirds of the rows give the other third.
    """
    rated = grades(labels)
    there = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}
    if not there:
        return None
    taken = quotas(there, train_rows)
    share = {g: hash_fraction(F.col("doc_id"), taken[g], n, 5) for g, n in there.items()}
    of_grade = F.coalesce(*(F.when(F.col("grade") == g, c) for g, c in share.items()))
    chosen = rated.where(of_grade)

    @F.arrow_udf("array<int>")
    def hashed(texts: pa.Array) -> pa.Array:
        hasher = Hasher()
        return pa.array([hasher.features(t) for t in values(texts)], pa.list_(pa.int32()))

    # the ratings have one row for each id, so each document is met once and only texts that may be of the sample travel
    widest = functools.reduce(lambda a, b: a | b, share.values())
    texts = docs.select("doc_id", F.col(text_col).alias("text")).where(widest)
    sample = texts.join(chosen, "doc_id").select("doc_id", "grade", hashed("text").alias("x")).toArrow()
    rows = [r.values.to_numpy() for r in sample.column("x")]
    order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: (sample["doc_id"][i].as_py(), rows[i].tobytes()))
    if not order:
        return None
    rows, grade = [rows[i] for i in order], sample["grade"].to_numpy()[order]
    ids = [sample["doc_id"][i].as_py() for i in order]
    weight = np.array([there[g] / max(1, taken[g]) for g in range(GRADES) if g in there])[np.searchsorted(sorted(there), grade)]
    model = Ordinal().fit(rows, grade, weight)
    third, tail = np.array([zlib.crc32(str(i).encode()) % 3 for i in ids]), np.zeros(len(ids))
    for k in range(3):
        own = np.flatnonzero(third != k)
        if not len(own):
            return model
        part = Ordinal().fit([rows[i] for i in own], grade[own], weight[own])
        for i in np.flatnonzero(third == k):
            tail[i] = part.tails(rows[i])[-1]
    model.cut = cut_of(tail, grade)
    return model


def score(docs: DataFrame, model: Ordinal | None, text_col: str = "text") -> DataFrame:
    """Add ``quality``: the expected grade, and for every grade the probability of reaching it.

    Null texts and texts without words have grade 0 and probabilities 0; without a model, everything has. Repeated
    rows get equal results; a column ``quality`` is replaced. The whole text counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    @F.arrow_udf(GOOD)
    def graded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted, hasher = cloudpickle.loads(shared.value), Hasher()
        nothing = dict.fromkeys((f.name for f in _ARROW_GOOD), 0.0)
        for texts in batches:
            rows = []
            for t in values(texts):
                x = hasher.features(t)
                if fitted is None or not len(x):
                    rows.append(nothing)
                    continue
                p = fitted.tails(x).tolist()
                rows.append({"expected_grade": sum(p)} | {f"p_at_least_{k}": v for k, v in enumerate(p, 1)})
            yield pa.array(rows, _ARROW_GOOD)

    return docs.withColumn("quality", graded(F.col(text_col)))


def selected(least: float = 0.5):
    """True where the text reaches the best grade with a probability of ``least``, such as the cut of a model."""
    return F.col(f"quality.p_at_least_{GRADES - 1}") >= least


def keep_good(docs: DataFrame, labels: DataFrame, least: float | None = None) -> DataFrame:
    """The rows selected by the model that ``labels`` teaches, by its own cut if none is given, with their own columns."""
    model = train(docs, labels)
    if least is None:
        least = model.cut if model else 0.5
    scored = score(docs.withColumn("_own", F.struct(*docs.columns)), model)
    return scored.where(selected(least)).select("_own.*")
