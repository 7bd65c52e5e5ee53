"""
SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. The perfect [23, 12, 7] Golay code decodes any
23-bit word to one codeword; the indices reached from a segment by at most one flipped bit (six at most) are its
keys, and segments that differ in two bits share one of them. Of four errors over three segments, either one segment
has none, and then another has at most two: it is found under (that segment exactly, a shared key of the other). Or
no segment is free of errors, and then two have exactly one each: found under the own indices of one side and the
keys of the other. So no link within four bits is missed, and every candidate is verified in full.

Only distinct fingerprints are keyed. A first pass counts keys by slot; slots above ``CELL`` and many times the
mean are cut into cells of bounded size, every two of which meet, so a hot group is spread. A bucket yields a spanning
forest of its links, never all its pairs. Components come from star contraction over stored edges.

Null and empty texts have fingerprint zero. Repeated rows are copies; a component's id is its smallest doc_id,
null only if all its ids are. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import lookup, stored, texts

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEGMENTS = ((42, 22), (21, 21), (0, 21))
GENERATOR = 0xC75
ERRORS = 4
SLOTS = 1 << 20
CELL = 8192
SMALL = 48


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Bit i is set if over half of the shingles' hashes have it; zero without words."""
    tokens = WORD.findall(text.lower())
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = (sizes + 1).cumsum() - sizes - 1
    n = max(1, len(tokens) - words + 1)
    ends = (starts + sizes)[min(words, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends.tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for begin in range(0, n, 65536):
        part = hashes[begin : begin + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _prints(batches):
    for batch in batches:
        found = [fingerprint(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        signed = pa.array(np.array(found, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), signed], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fp``, the 64 bits as a signed long."""
    return texts(docs).mapInArrow(_prints, "doc_id long, fp long")


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def _golay():
    """Remainders of the upper twelve bits, and the error of at most three bits behind every remainder."""
    upper = np.array([_remainder(i << 11) for i in range(1 << 12)], np.int64)
    single = [_remainder(1 << i) for i in range(23)]
    error = np.zeros(1 << 11, np.int64)
    for i in range(23):
        error[single[i]] = 1 << i
        for j in range(i):
            error[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                error[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return upper, error


UPPER, ERROR = _golay()


def decode(words: np.ndarray) -> np.ndarray:
    """Index of the codeword within three bits of each 23-bit word."""
    return (words ^ ERROR[UPPER[words >> 11] ^ (words & 0x7FF)]) >> 11


def near_indices(words: np.ndarray, width: int) -> np.ndarray:
    """Indices reached by at most one flipped bit, six columns; places left over are -1."""
    flips = np.array([0, *(1 << i for i in range(width))], np.int64)
    found = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return -np.sort(-found, axis=1)[:, :6]


def keys(prints: np.ndarray):
    """(key, fingerprint, side) of every bucket entry; side 0 meets all, 1 meets 2."""
    bits = prints.view(np.uint64)
    parts = [((bits >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    near = [near_indices(p, w) for p, (_, w) in zip(parts, SEGMENTS)]
    own = [decode(p) for p in parts]
    out_key, out_print, out_side = [], [], []

    def put(key, ok, prints, side):
        out_key.append(key[ok])
        out_print.append(prints[ok])
        out_side.append(np.full(int(ok.sum()), side, np.int8))

    for i in range(3):
        for j in range(3):
            if i != j:
                key = ((3 * i + j) << 40 | parts[i] << 12)[:, None] | near[j]
                put(key, near[j] >= 0, np.broadcast_to(prints[:, None], key.shape), 0)
            if i < j:
                tag = (16 + 3 * i + j) << 40
                put(tag | own[i] << 12 | own[j], np.ones(len(prints), bool), prints, 1)
                key = tag | near[i][:, :, None] << 12 | near[j][:, None, :]
                ok = (near[i][:, :, None] >= 0) & (near[j][:, None, :] >= 0)
                put(key, ok, np.broadcast_to(prints[:, None, None], key.shape), 2)
    return np.concatenate(out_key), np.concatenate(out_print), np.concatenate(out_side)


def _mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slot(key: np.ndarray) -> np.ndarray:
    return (_mix(key) >> np.uint64(44)).astype(np.int64)


def _chunks(batch):
    prints = batch.column("fp").to_numpy()
    return (np.ascontiguousarray(prints[i : i + 2048]) for i in range(0, len(prints), 2048))


def _loads(batches):
    load = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for prints in _chunks(batch):
            load += np.bincount(_slot(keys(prints)[0]), minlength=SLOTS)
    for begin in range(0, SLOTS, 4096):
        part = load[begin : begin + 4096]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([begin // 4096], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary())], ["part", "load"])


def _loaded(batches, limit):
    """Sums of sorted parts; slots above ``limit``."""
    current, total = None, None

    def done():
        at = np.flatnonzero(total > limit)
        return pa.RecordBatch.from_arrays([pa.array(at + current * 4096), pa.array(total[at])], ["slot", "load"])

    for batch in batches:
        for part, load in zip(*(c.to_pylist() for c in batch.columns)):
            if part != current:
                if current is not None:
                    yield done()
                current, total = part, np.zeros(4096, np.int64)
            total += np.frombuffer(load, "<i8")
    if current is not None:
        yield done()


def _keyed(batches, hot):
    slots, cells = hot.value
    for batch in batches:
        for prints in _chunks(batch):
            key, fp, side = keys(prints)
            key = key.view(np.uint64)
            if len(slots):
                slot = _slot(key)
                at = np.minimum(np.searchsorted(slots, slot), len(slots) - 1)
                is_hot = slots[at] == slot
                n = cells[at[is_hot]]
                own = (_mix(fp[is_hot]) % n.astype(np.uint64)).astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                other = np.arange(len(row)) - np.repeat(n.cumsum() - n, n)
                low, high = np.minimum(own[row], other), np.maximum(own[row], other)
                cell = _mix(key[is_hot][row] ^ _mix((low << 32 | high) + 1))
                key, fp, side = np.r_[key[~is_hot], cell], np.r_[fp[~is_hot], fp[is_hot][row]], np.r_[side[~is_hot], side[is_hot][row]]
            columns = [pa.array(np.ascontiguousarray(key).view(np.int64)), pa.array(fp), pa.array(side)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "fp", "side"])


class Forest:
    """Keeps a link only if it joins two parts; starts anew when it holds ``room`` nodes."""

    def __init__(self, room: int = 500_000):
        self.up, self.room = {}, room

    def root(self, a):
        up = self.up
        while (b := up.setdefault(a, a)) != a:
            up[a] = up[b]
            a = b
        return a

    def joins(self, a, b) -> bool:
        if len(self.up) > self.room:
            self.up.clear()
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def _near(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= ERRORS


def _spanning(prints: np.ndarray):
    """A spanning forest of the links among distinct fingerprints: each is compared with those not yet reached."""
    rest = np.unique(prints)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            a = queue.pop()
            hit = _near(rest, a)
            if hit.any():
                for b in rest[hit]:
                    yield int(a), int(b)
                queue.extend(rest[hit])
                rest = rest[~hit]


def _links(batches):
    forest, carried = Forest(), None

    def judge(key, fp, side):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        found = []
        for begin, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            found += [p for p in _spanning(fp[begin : begin + size]) if forest.joins(*p)]
        small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
        key, fp, side = key[small], fp[small], side[small]
        for shift in range(1, SMALL):
            at = np.flatnonzero(key[shift:] == key[:-shift])
            if not len(at):
                break
            a, b = fp[at], fp[at + shift]
            ok = _near(a, b) & (a != b) & ((side[at] == 0) | (side[at] != side[at + shift]))
            found += [p for p in zip(a[ok].tolist(), b[ok].tolist()) if forest.joins(*p)]
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        now = [c.to_numpy() for c in batch.columns]
        if carried is not None:
            now = [np.concatenate([x, y]) for x, y in zip(carried, now)]
        if not len(now[0]):
            continue
        last = np.searchsorted(now[0], now[0][-1], "left")
        carried = [x[last:] for x in now]
        if last:
            yield judge(*(x[:last] for x in now))
    if carried is not None:
        yield judge(*carried)


def links(prints: DataFrame) -> DataFrame:
    """
    a, b: fingerprints within four bits, enough of them to connect all that are linked.

    ``prints`` holds distinct ``fp`` and is read twice.
    """
    context = prints.sparkSession.sparkContext
    total = prints.count() * 120
    # Fewer than SLOTS / 64 slots can hold 64 times the mean: that bounds what is sent to all.
    limit = max(CELL, 64 * total // SLOTS)
    loads = prints.mapInArrow(_loads, "part int, load binary").repartition(F.col("part")).sortWithinPartitions("part")
    hot = sorted((r.slot, r.load) for r in loads.mapInArrow(partial(_loaded, limit=limit), "slot long, load long").collect())
    slots, load = np.array(hot, np.int64).reshape(-1, 2).T
    shared = context.broadcast((slots, -(-load // CELL)))
    keyed = prints.mapInArrow(partial(_keyed, hot=shared), "key long, fp long, side byte")
    return keyed.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_links, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, by large-star and small-star rounds on stored edges."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")

    def signature(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())

    before = signature(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(
            F.col("e.v").alias("u"), F.col("e.m").alias("v")
        )
        edges = stored(small.filter("u <> v").distinct(), "edges")
        after = signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    prints = stored(fingerprints(docs), "prints")
    firsts = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "firsts")
    roots = components(stored(links(firsts.select("fp")), "links"))
    linked = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("n_root"))
    classes = lookup(linked.select("fp", "root", "n"), stored(least, "roots"), "root", "n_root").select("fp", "component_id", "n")
    found = lookup(prints, stored(classes, "classes"), "fp", "n")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
