"""
Language-model scores from a lattice of subwords.

The pieces of an existing vocabulary weigh all segmentations of a text: its probability is the sum over every way to
spell it, times that of the end. Pieces mark word starts and none crosses one, so the sum factors by word; a forward
recursion in log space gives each distinct word's marginal once. Weights start from the vocabulary's own scores (ranks,
read as 1 / (rank + 10)) and are re-estimated on the distinct training words. A word seen in training has one more arc
that spans it, of its count less ``DISCOUNT``; what the discounts free is the mass of words spelled in pieces. Over
all texts the probabilities add up to one.

Word counts cover all training texts and grow with them. Words of at most 64 characters that make up over 1/HOT_SHARE of
all tokens, fewer than HOT_SHARE, are resolved inside the task that reads the document; the others are counted per document and joined.

Null and empty texts have the end alone. Repeated rows are scored each and all learned from. Without training text every
count is zero.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import fold_of, stored, texts

FILE = "piece_bpe_32k.model"
HOT_SHARE = 250_000
DISCOUNT = 0.75
MARK = "▁"
LN10 = math.log(10)


@lru_cache(maxsize=2)
def pieces(file: str):
    """(piece, starting weight) of every usable piece: single bytes are 1-byte entries, marks stand only in front."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(file))
    found = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            found[bytes([int(piece[3:-1], 16)])] = 1 / (model.get_piece_size() + 10)
        elif not (model.is_control(i) or model.is_unknown(i)) and MARK not in piece[1:]:
            found[piece] = 1 / (10 - model.get_score(i))
    return found


class Lattice:
    def __init__(self, weights: dict):
        total = math.log(sum(weights.values()))
        self.logs = {p: math.log(w) - total for p, w in weights.items()}
        self.longest = max(len(p) for p in weights)

    def arcs(self, word: str):
        """For every place the arcs that end there: (from, log weight, pieces)."""
        logs, spelled, out = self.logs, MARK + word, []
        for stop in range(1, len(spelled) + 1):
            here = [(i, lp, piece) for i in range(max(0, stop - self.longest), stop) if (lp := logs.get(piece := spelled[i:stop])) is not None]
            if spelled[stop - 1] not in logs:
                raw = [bytes([b]) for b in spelled[stop - 1].encode("utf-8")]
                here.append((stop - 1, sum(logs[b] for b in raw), raw))
            out.append(here)
        return out

    @staticmethod
    def forward(arcs) -> list[float]:
        alpha = [0.0]
        for here in arcs:
            terms = [alpha[i] + lp for i, lp, _ in here]
            top = max(terms)
            alpha.append(top + math.log(sum([math.exp(t - top) for t in terms])) if len(terms) > 1 else top)
        return alpha

    def log_marginal(self, word: str, whole: float = 0.0, spelled: float = 1.0) -> float:
        """Of the word's probability: an arc of weight ``whole`` over all of it, and ``spelled`` shared by its spellings."""
        by_pieces = math.log(spelled) + self.forward(self.arcs(word))[-1]
        return by_pieces if whole <= 0 else float(np.logaddexp(math.log(whole), by_pieces))

    def expect(self, word: str, count: float, into: Counter) -> None:
        """Adds the expected number of times each piece is used."""
        arcs = self.arcs(word)
        alpha = self.forward(arcs)
        beta, whole = [-math.inf] * len(arcs) + [0.0], alpha[-1]
        for stop in range(len(arcs), 0, -1):
            b = beta[stop]
            for i, lp, piece in arcs[stop - 1]:
                via = lp + b
                high, low = (via, beta[i]) if via > beta[i] else (beta[i], via)
                beta[i] = high + math.log1p(math.exp(low - high))
                share = count * math.exp(alpha[i] + via - whole)
                for each in piece if isinstance(piece, list) else (piece,):
                    into[each] += share


class Grid:
    """The recursion of a lattice over many words of one length at a time; words of over ``MOST`` characters go one by one."""

    MOST = 64
    CELLS = 2_000_000
    FACTOR = 0x9E3779B97F4A7C15

    def __init__(self, lattice: Lattice):
        self.lattice = lattice
        self.names = [p for p in lattice.logs if isinstance(p, str)]
        keys = np.array([self._key(p) for p in self.names], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        self.logs = np.array([lattice.logs[p] for p in self.names])
        self.sizes = np.array([len(p) for p in self.names])
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[keys >> np.uint64(44)] = True

    def _key(self, piece: str) -> int:
        key = 0
        for ch in piece:
            key = (key * self.FACTOR + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
        return key

    def groups(self, words: list[str]):
        """(places in ``words``, code points by word) of words of one length, spelled with the mark."""
        by_length: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            by_length.setdefault(len(word), []).append(at)
        for length, places in by_length.items():
            size = length + 1
            step = max(1, self.CELLS // (size * min(size, self.lattice.longest)))
            for begin in range(0, len(places), step) if length <= self.MOST else ():
                chosen = places[begin : begin + step]
                codes = np.frombuffer("".join([MARK + words[i] for i in chosen]).encode("utf-32-le"), "<u4")
                yield chosen, codes.reshape(len(chosen), size).T

    def arcs(self, codes: np.ndarray):
        """Log weight of the piece of k + 1 characters from place i, as [k, i, word]; per k the pieces found; single characters spelled in bytes."""
        size, n = codes.shape
        most = min(size, self.lattice.longest)
        weight = np.full((most, size, n), -np.inf)
        found, key = [], np.zeros((size, n), np.uint64)
        factor = np.uint64(self.FACTOR)
        for k in range(most):
            key = key[: size - k] * factor + (codes[k:].astype(np.uint64) + np.uint64(1))
            flat = key.ravel()
            at = np.flatnonzero(self.maybe[flat >> np.uint64(44)])
            spot = np.minimum(np.searchsorted(self.keys, flat[at]), len(self.keys) - 1)
            ids = self.ids[spot]
            hit = (self.keys[spot] == flat[at]) & (self.sizes[ids] == k + 1)
            at, ids = at[hit], ids[hit]
            weight[k, : size - k].ravel()[at] = self.logs[ids]
            found.append((at, ids))
        lone = np.ones(size * n, bool)
        lone[found[0][0]] = False
        lone = np.flatnonzero(lone)
        kinds, which = np.unique(codes.reshape(-1)[lone], return_inverse=True)
        raw = [[bytes([b]) for b in chr(c).encode("utf-8")] for c in kinds]
        weight[0].ravel()[lone] = np.array([sum(self.lattice.logs[b] for b in bs) for bs in raw])[which] if len(lone) else []
        return weight, found, (lone, which, raw)

    @staticmethod
    def _sum(terms: np.ndarray) -> np.ndarray:
        top = terms.max(0)
        return top + np.log(np.exp(terms - top).sum(0))

    def forward(self, weight: np.ndarray) -> np.ndarray:
        most, size, n = weight.shape
        alpha = np.zeros((size + 1, n))
        for stop in range(1, size + 1):
            k = np.arange(min(stop, most))
            alpha[stop] = self._sum(alpha[stop - 1 - k] + weight[k, stop - 1 - k])
        return alpha

    def log_marginals(self, words: list[str]) -> np.ndarray:
        """Log of the summed probability of the spellings of each word."""
        out = np.array([self.lattice.forward(self.lattice.arcs(w))[-1] if len(w) > self.MOST else 0.0 for w in words], np.float64)
        for places, codes in self.groups(words):
            out[places] = self.forward(self.arcs(codes)[0])[-1]
        return out

    def expect(self, words: list[str]) -> Counter:
        """Expected number of times each piece is used, each word once."""
        into: Counter = Counter()
        for word in words:
            if len(word) > self.MOST:
                self.lattice.expect(word, 1.0, into)
        uses = np.zeros(len(self.names))
        for _, codes in self.groups(words):
            weight, found, (lone, which, raw) = self.arcs(codes)
            most, size, n = weight.shape
            alpha, beta = self.forward(weight), np.zeros((size + 1, n))
            for begin in range(size - 1, -1, -1):
                k = np.arange(min(size - begin, most))
                beta[begin] = self._sum(beta[begin + 1 + k] + weight[k, begin])
            for k, (at, ids) in enumerate(found):
                share = np.exp(alpha[: size - k] + weight[k, : size - k] + beta[k + 1 :] - alpha[-1]).ravel()
                uses += np.bincount(ids, share[at], len(uses))
                if k == 0 and raw:
                    for each, times in zip(raw, np.bincount(which, share[lone], len(raw))):
                        for byte in each:
                            into[byte] += float(times)
        into.update({self.names[i]: float(uses[i]) for i in np.flatnonzero(uses)})
        return into


def split(texts: pa.Array):
    """A-Z lowered, words between the six white-space bytes: (place of the text of each word, its code, the distinct words)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    parents, flat = pc.list_parent_indices(lists), lists.flatten()
    real = pc.not_equal(flat, "")
    coded = flat.filter(real).dictionary_encode()
    return parents.filter(real).to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _counts(batches):
    for batch in batches:
        parents, codes, words = split(batch.column("text"))
        train = batch.column("train").to_numpy()
        n, c = np.bincount(codes, minlength=len(words)), np.bincount(codes, train[parents], len(words))
        yield pa.RecordBatch.from_arrays([words, pa.array(n.astype(np.int64)), pa.array(c.astype(np.int64))], ["word", "n", "c"])


def _expected(batches, model):
    into: Counter = Counter()
    grid = Grid(model.value)
    for batch in batches:
        into.update(grid.expect(batch.column("word").to_pylist()))
    names = [p.hex() if isinstance(p, bytes) else "=" + p for p in into]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(into.values()), pa.float64())], ["piece", "n"])


def fit(words: DataFrame, file: str = FILE, rounds: int = 2, smooth: float = 0.01) -> Lattice:
    """Weights after ``rounds`` of expectation over the distinct training words; one number per piece comes back each round."""
    start = pieces(file)
    model = Lattice(start)
    context = words.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(model)
        rows = words.filter("c > 0").select("word").mapInArrow(partial(_expected, model=shared), "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        found = {r.piece[1:] if r.piece.startswith("=") else bytes.fromhex(r.piece): r.n for r in rows}
        model = Lattice({p: found.get(p, 0.0) + smooth for p in start})
    return model


def _marginals(batches, model, total, spelled):
    grid = Grid(model.value)
    for batch in batches:
        logs = math.log(spelled / total) + grid.log_marginals(batch.column("word").to_pylist())
        whole = (batch.column("c").to_numpy() - DISCOUNT) / total
        seen = whole > 0
        logs[seen] = np.logaddexp(np.log(whole[seen]), logs[seen])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs / LN10, pa.float64())], [*batch.schema.names, "lp"])


def _resolved(batches, hot):
    """One row per document with what its frequent words add, and a row for each other word of it."""
    table = hot.value
    frequent, counts, marginals = table["word"].combine_chunks(), table["c"].to_numpy(), table["lp"].to_numpy()
    part, number = TaskContext.get().partitionId() << 40, 0
    names = ["row", "doc_id", "train", "words", "known", "logs", "lp", "word", "n"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.int64()]
    for batch in batches:
        docs = batch.num_rows
        parents, codes, words = split(batch.column("text"))
        rows = np.arange(docs) + part + number
        number += docs
        at = pc.index_in(words, value_set=frequent).fill_null(-1).to_numpy().astype(np.int64)[codes]
        warm = at >= 0
        where, at = parents[warm], at[warm]
        known = np.bincount(where, counts[at] > 0, docs).astype(np.int64)
        sums = [np.bincount(where, by, docs) for by in (np.log10(counts[at] + 1), marginals[at])]
        facts = [rows, batch.column("doc_id"), batch.column("train"), np.bincount(parents, minlength=docs), known, *sums, [None] * docs, [None] * docs]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(facts, kinds)], names)
        pairs, times = np.unique(parents[~warm] * max(len(words), 1) + codes[~warm], return_counts=True)
        whose, which = np.divmod(pairs, max(len(words), 1))
        nothing = [pa.nulls(len(pairs), k) for k in kinds[1:7]]
        yield pa.RecordBatch.from_arrays([pa.array(rows[whose], kinds[0]), *nothing, words.take(pa.array(which)).cast(kinds[7]), pa.array(times, kinds[8])], names)


def score(docs: DataFrame, file: str = FILE, folds: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    context = docs.sparkSession.sparkContext
    rows = texts(docs).select("doc_id", "text", (fold_of("doc_id", folds) != fold).cast("int").alias("train"))
    words = rows.select("text", "train").mapInArrow(_counts, "word string, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    # Spread by number: the recursion costs far more than its bytes say.
    words = stored(words.repartition(2 * context.defaultParallelism, "word"), "words")
    train_docs = rows.agg(F.coalesce(F.sum("train"), F.lit(0))).first()[0]
    tokens, train, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, distinct = train + train_docs, kinds + (train_docs > 0)
    # One more of each keeps spellings and ends possible without any training text.
    mass, spelled, end = total + 2, DISCOUNT * kinds + 1, train_docs + 1
    model = context.broadcast(fit(words, file))
    marginal = stored(words.mapInArrow(partial(_marginals, model=model, total=mass, spelled=spelled), "word string, n long, c long, lp double"), "marginals")
    frequent = (F.col("n") > tokens / HOT_SHARE) & (F.length("word") <= Grid.MOST)
    hot = marginal.filter(frequent).select("word", "c", "lp").toArrow()
    schema = "row long, doc_id long, train int, words long, known long, logs double, lp double, word string, n long"
    found = stored(rows.mapInArrow(partial(_resolved, hot=context.broadcast(hot)), schema), "resolved")
    rare = found.filter("word is not null").select("row", "word", F.col("n").alias("tf"))
    facts = marginal.filter(~frequent).select("word", "c", F.col("lp").alias("word_lp"))
    sums = rare.join(facts, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("more_logs"),
        F.sum(F.col("tf") * F.col("word_lp")).alias("more_lp"),
    )
    whole = found.filter("word is null").join(sums, "row", "left")

    def both(a, b):
        return F.col(a) + F.coalesce(F.col(b), F.lit(0))

    length = F.col("words") + 1
    return whole.select(
        "doc_id", (F.col("train") == 0).alias("held_out"), length.alias("n_tokens"), (both("known", "more_known") + int(train_docs > 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (both("logs", "more_logs") + math.log10(train_docs + 1) - length * math.log10(total + distinct + 1)).alias("base_score"),
        (both("lp", "more_lp") + math.log10(end / mass)).alias("score"),
    )
