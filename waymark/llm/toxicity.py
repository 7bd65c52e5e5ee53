"""
Toxicity by a factorization machine over hashed terms.

A document is the set of its terms, hashed into ``BUCKETS``: its lower-cased words and their beginnings of three to
six letters. A term's value is its share of the document's words to the power ``POWER``, so long texts, which hold
nearly every word, weigh no more than short ones. The score is the logistic of a bias, a weight per term and the inner
products of the factors of every two terms, so that two terms may say together what neither says alone. No term is
left out for being rare; decay and shares of small size keep its weight small.

It is fitted on a bounded sample of the labelled rows: up to half of ``sample`` rows of either label, those of the
smallest hash of their id, whose terms take at most ``most_bytes``. Every fifth of them is held back from the machine
and fits slope and place of the logistic, which are then moved to the labels' share among all labelled rows. Every
document is scored from its whole text.

Null and empty texts count as empty and get the bias alone; null labels are not learned from; of repeated labels the
largest counts, of texts of one id that of the smallest terms is learned from; repeated documents are scored alike.
Without any label the score is 0; with one label only it is that label.
"""

from __future__ import annotations

import re
import tempfile
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from waymark.llm.common import fold_of, stored, texts

BUCKETS = 1 << 20
FACTORS = 4
BEGINNINGS = (3, 4, 5, 6)
POWER = 0.7
SCALE = 4.0
TERM = np.dtype([("bucket", "<i4"), ("value", "<f4")])
WORD = re.compile(r"\w+")
MEMO = 200_000


class Spellings:
    """Buckets of a word and of its beginnings, -1 where the word is no longer than that: many words of one stem are one term."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.rows, self.table = {}, np.empty((1024, 1 + len(BEGINNINGS)), np.int64)

    def row(self, word: str) -> int:
        at = self.rows.get(word)
        if at is None:
            at = self.rows[word] = len(self.rows)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            forms = [word, *(word[:n] + "*" if len(word) > n else None for n in BEGINNINGS)]
            self.table[at] = [-1 if f is None else zlib.crc32(f.encode("utf-8", "replace")) % BUCKETS for f in forms]
        return at


def terms(text: str, memo: Spellings) -> np.ndarray:
    """Buckets, ascending, and values of a text's terms."""
    if len(memo.rows) > MEMO:
        memo.clear()
    counts = Counter(WORD.findall(text.lower()))
    times = np.fromiter(counts.values(), np.float64, len(counts))
    rows = np.fromiter(map(memo.row, counts), np.int64, len(counts))
    hashes = memo.table[rows]
    known = hashes >= 0
    buckets, of = np.unique(hashes[known], return_inverse=True)
    found = np.empty(len(buckets), TERM)
    found["bucket"] = buckets
    shares = np.bincount(of, np.broadcast_to(times[:, None], known.shape)[known], minlength=len(buckets)) / max(times.sum(), 1)
    found["value"] = SCALE * shares**POWER
    return found


def _hashed(batches):
    memo = Spellings()
    for batch in batches:
        found = [terms(t, memo).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], ["doc_id", "toxic", "terms"])


def sample_terms(docs: DataFrame, labels: DataFrame, sample: int = 12_000, folds: int = 5, most_bytes: int = 256 << 20):
    """
    Terms and labels of at most ``sample`` labelled rows outside the held-out fold, and the share of label 1
    among all labelled rows there. The rows are in the order of the hash of their id, whatever the plan.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id is not null and toxic is not null").filter(fold_of("doc_id", folds) != 0)
        .groupBy("doc_id").agg(F.when(F.max("toxic") > 0, 1).otherwise(0).alias("toxic"))
    )
    place = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [known.filter(F.col("toxic") == y).orderBy(*place).limit(sample // 2) for y in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))
    rows = texts(docs).join(chosen, "doc_id").select("doc_id", "toxic", "text").mapInArrow(_hashed, "doc_id long, toxic int, terms binary")
    # one row per id first: an id may stand in any number of rows
    rows = stored(rows.groupBy("doc_id").agg(F.min(F.struct("terms", "toxic")).alias("one")).select("doc_id", "one.*"), "sample")
    sizes = rows.select("doc_id", F.octet_length("terms").alias("n")).orderBy(*place).collect()
    total = np.cumsum([r.n for r in sizes])
    fits = int(np.searchsorted(total, most_bytes, "right"))
    if fits < len(sizes):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(r.doc_id,) for r in sizes[:fits]], "doc_id long")), "doc_id", "left_semi")
    share = known.agg(F.avg("toxic")).first()[0]
    return on_disk((r.terms, r.toxic) for r in rows.orderBy(*place).toLocalIterator()), share


def on_disk(rows) -> list:
    """Rows (bytes of terms, label) as (terms, label); the terms lie in a mapped file without a name that goes when they do."""
    labels, ends = [], [0]
    with tempfile.TemporaryFile() as file:
        for found, label in rows:
            file.write(found)
            labels.append(label)
            ends.append(ends[-1] + len(found) // TERM.itemsize)
        file.flush()
        # a file without bytes cannot be mapped
        flat = np.asarray(np.memmap(file, TERM, "r")) if ends[-1] else np.empty(0, TERM)
    return [(flat[a:b], y) for a, b, y in zip(ends, ends[1:], labels)]


class Machine:
    """Weights of the buckets seen; ``buckets`` is sorted, so terms are found by bisection."""

    def __init__(self, buckets, bias, weights, factors, slope=1.0, place=0.0):
        self.buckets, self.bias, self.weights, self.factors, self.slope, self.place = buckets, bias, weights, factors, slope, place

    def places(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.buckets):
            return np.empty(0, np.int64), np.empty(0)
        at = np.minimum(np.searchsorted(self.buckets, found["bucket"]), len(self.buckets) - 1)
        seen = self.buckets[at] == found["bucket"]
        return at[seen], found["value"][seen].astype(np.float64)

    def raw(self, places: tuple[np.ndarray, np.ndarray]) -> float:
        """Logit of the score: bias, weights and, for every two terms, the product of their values and factors."""
        at, value = places
        parts = self.factors[at] * value[:, None]
        pairs = 0.5 * float((parts.sum(0) ** 2).sum() - (parts * parts).sum())
        return self.slope * (float(self.bias) + float((self.weights[at] * value).sum()) + pairs) + self.place


def _logit(share: float) -> float:
    return float(np.log(share / (1 - share)))


def _descend(machine: Machine, rows, epochs: int, rate: float, decay: float, seed: int) -> None:
    """AdaGrad on the logistic loss."""
    random, n = np.random.default_rng(seed), len(machine.buckets)
    labels = np.array([y for _, y in rows], np.float64)
    weights, factors, bias = np.zeros(n), random.normal(0, 0.05, (n, FACTORS)), _logit(labels.mean())
    grad_w, grad_v = np.full(n, 1e-2), np.full((n, FACTORS), 1e-2)
    # every bucket of the rows is the machine's; the places of 64 rows are looked up when they are needed
    place = np.zeros(BUCKETS, np.int32)
    place[machine.buckets] = np.arange(n, dtype=np.int32)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for begin in range(0, len(order), 64):
            chosen = [i for i in order[begin : begin + 64] if len(rows[i][0])]
            if not chosen:
                continue
            sizes = np.array([len(rows[i][0]) for i in chosen])
            found = np.concatenate([rows[i][0] for i in chosen])
            flat, value = place[found["bucket"]], found["value"].astype(np.float64)
            of, edges = np.repeat(np.arange(len(chosen)), sizes), np.r_[0, sizes.cumsum()[:-1]]
            parts = factors[flat] * value[:, None]
            sums = np.add.reduceat(parts, edges)
            pairs = 0.5 * ((sums**2).sum(1) - np.add.reduceat((parts * parts).sum(1), edges))
            raw = bias + np.add.reduceat(weights[flat] * value, edges) + pairs
            error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]
            touched, inverse = np.unique(flat, return_inverse=True)
            pull = error[of] * value
            gw = np.bincount(inverse, pull) / len(chosen) + decay * weights[touched]
            step = pull[:, None] * (sums[of] - parts)
            gv = np.stack([np.bincount(inverse, step[:, f]) for f in range(FACTORS)], 1) / len(chosen) + decay * factors[touched]
            grad_w[touched] += gw * gw
            grad_v[touched] += gv * gv
            weights[touched] -= rate * gw / np.sqrt(grad_w[touched])
            factors[touched] -= rate * gv / np.sqrt(grad_v[touched])
            bias -= rate * 0.1 * error.mean()
    machine.bias, machine.weights, machine.factors = bias, weights.astype(np.float32), factors.astype(np.float32)


def _calibrate(machine: Machine, held) -> None:
    """Slope and place of the logistic by Newton steps over rows the machine has not seen; targets are drawn in by one row of either label."""
    raw, labels = np.array([machine.raw(machine.places(t)) for t, _ in held]), np.array([y for _, y in held])
    ones = labels.sum()
    middle, width = raw.mean(), raw.std()
    if not 0 < ones < len(labels) or width == 0:
        return
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    basis = np.stack([(raw - middle) / width, np.ones(len(raw))], 1)
    found = np.array([0.0, _logit(target.mean())])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(basis @ found, -30, 30)))
        bend = (basis * (p * (1 - p))[:, None]).T @ basis + 1e-6 * np.eye(2)
        found = found - np.linalg.solve(bend, basis.T @ (p - target))
    if np.isfinite(found).all() and found[0] > 0:
        machine.slope, machine.place = found[0] / width, found[1] - found[0] * middle / width


def fit(rows, share: float | None = None, epochs: int = 8, rate: float = 0.3, decay: float = 1e-4, seed: int = 7, hold: int = 5) -> Machine:
    """A machine of ``rows`` (terms, label); ``share``: that of label 1 where the scores will be used, if not theirs."""
    labels = np.array([y for _, y in rows], np.float64)
    if not len(rows) or labels.min() == labels.max():
        prior = float(labels.mean()) if len(rows) else 0.0
        return Machine(np.empty(0, np.int32), 30.0 if prior == 1 else -30.0, np.empty(0), np.empty((0, FACTORS)))
    held, learned = rows[::hold], [r for i, r in enumerate(rows) if i % hold]
    if len({y for _, y in learned}) < 2 or len({y for _, y in held}) < 2:
        held, learned = [], rows
    seen = np.zeros(BUCKETS, bool)
    for t, _ in learned:
        seen[t["bucket"]] = True
    machine = Machine(np.flatnonzero(seen).astype(np.int32), 0.0, None, None)
    _descend(machine, learned, epochs, rate, decay, seed)
    if held:
        _calibrate(machine, held)
    if share is not None and 0 < share < 1:
        machine.place += _logit(share) - _logit(labels.mean())
    return machine


def _score(batches, machine, names):
    memo, model = Spellings(), machine.value
    for batch in batches:
        raw = np.array([model.raw(model.places(terms(t or "", memo))) for t in batch.column("text").to_pylist()], np.float64)
        score = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        kept = [batch.column(n) for n in names[:-1]]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(score, pa.float64())], names)


def score_texts(rows: DataFrame, machine: Machine, keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``rows``, of any kind, and the score of ``text`` as ``name``, which must not be among them."""
    shared = rows.sparkSession.sparkContext.broadcast(machine)
    schema = StructType([*(rows.schema[c] for c in keep), StructField(name, DoubleType())])
    read = keep if "text" in keep else [*keep, "text"]
    return rows.select(*[F.col(f"`{c}`") for c in read]).mapInArrow(partial(_score, machine=shared, names=[*keep, name]), schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 12_000, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    machine = fit(*sample_terms(docs, labels, sample, folds))
    scored = score_texts(texts(docs), machine, ["doc_id"])
    return scored.select("doc_id", (fold_of("doc_id", folds) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
