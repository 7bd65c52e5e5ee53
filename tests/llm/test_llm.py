"""The llm operators against brute force, and on nulls, empty and repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from waymark.llm import bpe, exact_dedup, lattice, lengths, lines, packing, queries, simhash, tokens, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, keep_id string, word string, row string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z", "w") for i, t in rows], DOCS)


LONG = "word and more words \n" * 3000
ROWS = [
    (1, None), (2, ""), (3, "same text here, a line\nother line of it"), (4, "same text here, a line\nother line of it"), (4, "same text here, a line\nother line of it"),
    (5, LONG), (6, "  SAME text here, a line \nköln ünïcode 😀 'S don't 12345 <|startoftext|>x<|endoftext|> y"), (None, "same text here, a line"), (8, "\n\n \t\n"), (9, "a"), (10, "x" * 5000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def library(file):
    return tokens._library(file)


def test_exact_duplicates(docs, none):
    got = sorted((tuple(r) for r in exact_dedup.exact_duplicates(docs, 3).collect()), key=repr)
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    want = []
    for i, t in ROWS:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_runs_over_task_edges(spark):
    rows = documents(spark, [(i, "hot" if i % 3 else f"t{i}") for i in range(3000)])
    got = exact_dedup.exact_duplicates(rows, 16).filter("group_size > 1").collect()
    assert len(got) == 2000 and {(r.keep_id, r.group_size) for r in got} == {(2999, 2000)}


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    texts = documents(spark, [(i, ("you fool group" if i % 2 else "you fine group") + f" {i}") for i in range(400)])
    got = toxicity.toxicity(texts, labels).collect()
    assert all(r.predicted == r.doc_id % 2 and 0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def terms_of(*buckets):
    return np.array([(b, 1.0) for b in buckets], toxicity.TERM)


def test_pairs_say_what_terms_do_not():
    sets = [terms_of(a, 2 + b) for a in (0, 1) for b in (0, 1)]
    rows = [(t, int(t["bucket"][0] == t["bucket"][1] - 2)) for t in sets] * 100
    machine = toxicity.fit(rows, epochs=60)
    assert all((machine.raw(machine.places(t)) > 0) == bool(y) for t, y in rows[:4])


def test_machine_sums_all_pairs():
    random = np.random.default_rng(1)
    n = 12
    machine = toxicity.Machine(np.arange(0, 3 * n, 3, dtype=np.int32), 0.3, random.normal(size=n), random.normal(size=(n, toxicity.FACTORS)), 1.7, -0.2)
    for size in (0, 1, 5, 20):
        found = np.array([(b, random.random()) for b in sorted(random.choice(3 * n, size, False))], toxicity.TERM)
        known = [(int(b) // 3, float(x)) for b, x in found if b % 3 == 0]
        want = machine.bias + sum(machine.weights[i] * x for i, x in known)
        for (i, x), (j, y) in itertools.combinations(known, 2):
            want += x * y * sum(machine.factors[i][k] * machine.factors[j][k] for k in range(toxicity.FACTORS))
        assert machine.raw(machine.places(found)) == pytest.approx(1.7 * want - 0.2)


def test_terms_are_words_and_beginnings():
    memo = toxicity.Spellings()
    found = toxicity.terms("Abcde abc ABC x", memo)
    shares = Counter()
    for form, n in {"abcde": 1, "abc*": 1, "abcd*": 1, "abc": 2, "x": 1}.items():
        shares[zlib.crc32(form.encode()) % toxicity.BUCKETS] += n / 4
    assert {int(b): pytest.approx(float(v), rel=1e-6) for b, v in found} == {b: toxicity.SCALE * v**toxicity.POWER for b, v in shares.items()}
    assert len(toxicity.terms("", memo)) == 0 and len(toxicity.terms("a " * 100_000, memo)) == 1


def test_toxicity_sample(spark):
    """Bounded in rows and bytes, in the order of the hash; one text per id; the largest label counts."""
    docs = documents(spark, [(i, f"text {i}") for i in range(300)] + [(7, "another")] * 50)
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(300)] + [(10, 0), (3, None)], "doc_id long, toxic int")
    whole, share = toxicity.sample_terms(docs, labels)
    again, _ = toxicity.sample_terms(docs.repartition(7), labels.repartition(3))
    learned = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
    assert len(whole) == len(learned) and share == pytest.approx(np.mean([i % 10 == 0 for i in learned]))
    assert [(t.tobytes(), y) for t, y in whole] == [(t.tobytes(), y) for t, y in again]
    few, _ = toxicity.sample_terms(docs, labels, sample=20)
    assert len(few) == 20 and sum(y for _, y in few) == 10
    small, _ = toxicity.sample_terms(docs, labels, most_bytes=400)
    assert 0 < len(small) and sum(t.nbytes for t, _ in small) <= 400 < sum(t.nbytes for t, _ in whole[: len(small) + 1])
    assert [t.tobytes() for t, _ in small] == [t.tobytes() for t, _ in whole[: len(small)]]


def test_toxicity_fits_in_little_memory():
    """Fitting takes less than the sample's own bytes; before, it held places and values of all rows, twice those bytes."""
    draw, rows = np.random.default_rng(4), []
    for i in range(6000):
        found = np.empty(400, toxicity.TERM)
        found["bucket"], found["value"] = np.sort(draw.choice(5000, 400, False)), 0.5
        rows.append((found, i % 2))
    tracemalloc.start()
    machine = toxicity.fit(rows, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(machine.buckets) == 5000 and peak < sum(t.nbytes for t, _ in rows)


def test_toxicity_sample_lies_in_a_file():
    kept = [terms_of(1, 2), terms_of(), terms_of(7)]
    tracemalloc.start()
    rows = toxicity.on_disk((t.tobytes(), i) for i, t in enumerate([*kept, *(terms_of(*range(1000)) for _ in range(500))]))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1 << 20 < sum(t.nbytes for t, _ in rows)
    assert [(t.tolist(), y) for t, y in rows[:3]] == [(t.tolist(), i) for i, t in enumerate(kept)] and len(rows) == 503
    assert [len(t) for t, _ in toxicity.on_disk([(b"", 1)])] == [0] and toxicity.on_disk([]) == []


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    rows = documents(spark, [(i, ("you fool group" if i % 2 else "you fine group") + f" {i}") for i in range(400)] + [(900, None), (901, ""), (902, "you fool group " * 30_000), (None, "you fine group"), (3, "you fool group 3")])
    got = {}
    for r in toxicity.toxicity(rows, labels).collect():
        got.setdefault(r.doc_id, []).append((r.score, r.predicted))
    assert got[900] == got[901] and got[902][0][1] == 1 and got[None][0][1] == 0
    assert len(got[3]) == 2 and got[3][0] == got[3][1] and sum(map(len, got.values())) == 405


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    facts = queries.table(spark, sf, "labels").join(queries.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    got = queries.op1_toxicity(spark, sf).join(facts, "doc_id").filter("held_out").collect()
    caught = defaultdict(list)
    for r in got:
        if r.toxic:
            caught[r.lang].append(r.predicted)
    recall = {lang: np.mean(x) for lang, x in caught.items()}
    print(recall, {lang: len(x) for lang, x in caught.items()})
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.97
    # Spanish has six such rows held out (4 caught when this was written): too few for a bound of its own
    assert np.mean(sum(caught.values(), [])) >= 0.85 and min(r for lang, r in recall.items() if len(caught[lang]) >= 15) >= 0.75
    assert np.mean([r.predicted for r in got if not r.toxic]) <= 0.01


def test_warc(spark):
    big = "<p>" + "z" * 200
    rows = [(1, "u", None), (2, "u", big), (3, None, big), (3, None, big), (None, "v", big), (5, "u\r\nX: y", "small"), (6, "u", "small"), (7, "w", "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in warc.archive(pages).collect()), key=repr)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and h == big and i != 2
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want, key=repr)
    assert warc.archive(pages.limit(0)).count() == 0


def test_archives_have_a_dictionary(spark, sf_dir, tmp_path):
    pages = queries.table(spark, sf_dir, "pages")
    archives = warc.write_archives(warc.decide(pages), str(tmp_path), sample_bytes=200_000)
    for row in archives.collect():
        with open(row.path, "rb") as stream:
            assert int.from_bytes(stream.read(4), "little") == warc.MAGIC
    back = warc.read_archives(archives, str(tmp_path), payloads=True)
    full = {r.page_id: bytes(r.payload).decode() for r in back.collect() if r.record_type == "response"}
    source = {r.page_id: r.html or "" for r in pages.collect()}
    assert full and all(source[k] == v for k, v in full.items())


def test_archives_are_read_by_as_many_tasks(spark, sf_dir, tmp_path):
    records = warc.decide(queries.table(spark, sf_dir, "pages"))
    archives = warc.write_archives(records, str(tmp_path), sample_bytes=20_000, archive_bytes=5_000)
    back = warc.read_archives(archives, str(tmp_path))
    assert back.rdd.getNumPartitions() == archives.count() > 1
    assert back.count() == records.count()


def test_lattice(docs, none):
    got = lattice.score(docs).collect()
    assert len(got) == len(ROWS) and lattice.score(none).count() == 0
    counts, ends = Counter(), 0
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in ROWS]
    words = [(t or "").encode().lower().split() for _, t in ROWS]
    for w, h in zip(words, held):
        if not h:
            counts.update(w)
            ends += 1
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    base = sorted((h, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, total, round(sum(np.log10((c + 1) / (total + kinds + 1)) for c in [ends, *map(counts.get, w, itertools.repeat(0))]), 6)) for h, w in zip(held, words))
    assert sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == base
    assert all(r.score < 0 for r in got)


def test_marginal_sums_all_segmentations():
    model = lattice.Lattice(lattice.pieces(lattice.FILE))
    spelled = lattice.MARK + "there"
    total = 0.0
    for cuts in itertools.product((0, 1), repeat=len(spelled) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(spelled)]
        parts = [spelled[a:b] for a, b in zip(at, at[1:])]
        if all(p in model.logs for p in parts):
            total += np.exp(sum(model.logs[p] for p in parts))
    assert np.isclose(model.log_marginal("there"), np.log(total))


def test_words_together_as_one_by_one():
    model = lattice.Lattice(lattice.pieces(lattice.FILE))
    words = ["there", "über", "日本語", "x" * 70, "a", "\U0001f600ok", "é\u0301", "internationalisation", "their", "a"]
    grid, uses = lattice.Grid(model), Counter()
    for word in words:
        model.expect(word, 1.0, uses)
    together = grid.expect(words)
    assert np.allclose(grid.log_marginals(words), [model.log_marginal(w) for w in words])
    assert all(np.isclose(uses[k], together[k], atol=1e-9) for k in {*uses, *together})
    assert len(grid.log_marginals([])) == 0 and not grid.expect([])


def brute_top(rows, k=20):
    cells = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in cells if i % 20 == 0}:
        best = sorted((-int(np.dot(a, b)), i) for i, b in cells if i != q and len(b) == len(a))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k(spark):
    random = np.random.default_rng(3)
    rows = [(i, [float(x) for x in random.normal(0, 0.3, 8)] if i % 4 else [0.5] * 8) for i in range(300)]
    rows += [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [1.0] * 3), (None, [1.0] * 8), (7, [0.5] * 8), (420, [2.0, float("inf")]), (440, [])]
    vectors = spark.createDataFrame([(i, v, "c", "r") for i, v in rows], "vec_id long, embedding array<float>, column string, row string")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for sizes in ({}, {"rows": 70, "queries": 5}):
        assert sorted(tuple(r) for r in topk.top_k(vectors, **sizes).collect()) == brute_top(exact)
    assert topk.top_k(vectors.limit(0)).count() == 0


def test_bpe(spark, docs, none, sf_dir):
    tool = library(bpe.FILE)
    for rows in (docs, queries.table(spark, sf_dir, "documents")):
        source = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows.select("doc_id", "text").collect())
        got = sorted((r.doc_id is None, r.doc_id or 0, r.ids, r.decoded) for r in bpe.encode(rows).collect())
        found = Counter((i, tuple(ids), text) for _, i, ids, text in got)
        assert found == Counter((i, tuple(e), tool.decode(e, skip_special_tokens=False)) for _, i, t in source for e in [tool.encode(t, add_special_tokens=False).ids])
    assert bpe.digests(none).count() == 0


@pytest.mark.parametrize("text", ["ΣΑΣ σας", "İstanbul ǅ", "é ä", "a\x1cb\x85c d", "x" * 700 + "lolol" * 99, "日本語テスト", "we're THEY'LL 's", "́abc"])
def test_encoders_on_hard_texts(text):
    encoder, tool = bpe.Encoder(), library(bpe.FILE)
    assert np.frombuffer(encoder.encode(text)[0], "<u4").tolist() == tool.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.ByteEncoder(packing.FILE).ids(text), "<u4").tolist() == library(packing.FILE).encode(text, add_special_tokens=False).ids


def test_byte_encoder(spark, sf_dir):
    encoder, tool = tokens.ByteEncoder(packing.FILE), library(packing.FILE)
    for (text,) in [(t or "",) for _, t in ROWS] + queries.table(spark, sf_dir, "documents").select("text").collect():
        assert np.frombuffer(encoder.ids(text or ""), "<u4").tolist() == tool.encode(text or "", add_special_tokens=False).ids


def test_golay_keys_find_every_link():
    random = np.random.default_rng(1)
    words = random.integers(0, 1 << 23, 2000)
    index = simhash.decode(words)
    assert len(np.unique(simhash.decode(np.arange(1 << 23)))) == 4096 and index.max() < 4096
    for _ in range(300):
        a = random.integers(0, 1 << 63, 1, dtype=np.int64)
        b = a.copy()
        for bit in random.choice(64, 4, replace=False):
            b ^= np.uint64(1 << int(bit)).astype(np.int64)
        ka, kb = (set(zip(k.tolist(), s.tolist())) for k, _, s in (simhash.keys(a), simhash.keys(b)))
        assert any((k, s and 3 - s) in kb for k, s in ka)


def brute_components(prints):
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            up[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def brute_print(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if grams else 0


def test_near_duplicates(spark, docs, none, sf_dir, monkeypatch):
    table = queries.table(spark, sf_dir, "documents")
    for rows in (docs, table):
        source = [(r.doc_id, r.text or "") for r in rows.select("doc_id", "text").collect()]
        prints = [brute_print(t) for _, t in source]
        roots = brute_components(prints)
        least = {r: min((i for (i, _), x in zip(source, roots) if x == r and i is not None), default=None) for r in set(roots)}
        want = sorted(((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(source, prints, roots)), key=repr)
        assert sorted((tuple(r) for r in simhash.near_duplicates(rows).collect()), key=repr) == want
    assert simhash.near_duplicates(none).count() == 0


def test_spread_groups_keep_their_links():
    """Fingerprints in a hot slot are cut into cells; every two cells meet."""
    import pyarrow as pa

    random = np.random.default_rng(5)
    centre = int(random.integers(0, 1 << 62))
    prints = np.unique(np.array([centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in random.integers(0, 62, (300, 2))], np.int64))
    batch = pa.RecordBatch.from_arrays([pa.array(prints)], ["fp"])
    key = simhash.keys(prints)[0]
    slots = np.unique(simhash._slot(key))

    class Shared:
        value = (slots, np.full(len(slots), 3, np.int64))

    rows = [[c.to_numpy() for c in b.columns] for b in simhash._keyed([batch], Shared)]
    keyed = [np.concatenate(c) for c in zip(*rows)]
    order = np.argsort(keyed[0], kind="stable")
    sorted_batch = pa.RecordBatch.from_arrays([pa.array(c[order]) for c in keyed], ["key", "fp", "side"])
    found = [p for b in simhash._links([sorted_batch]) for p in zip(*(c.to_pylist() for c in b.columns))]
    up = {int(p): int(p) for p in prints}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in found:
        assert (np.uint64(a) ^ np.uint64(b)).item().bit_count() <= 4
        up[root(a)] = root(b)
    assert len({root(int(p)) for p in prints}) == len(set(brute_components([int(p) for p in prints])))


def test_packing(docs, none):
    tool = library(packing.FILE)
    got = packing.pack(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    want = []
    for i, t in ROWS:
        ids = tool.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(want, key=repr)
    assert packing.pack(none).count() == 0


def test_plan_is_best_fit():
    random = np.random.default_rng(2)
    for _ in range(30):
        sizes = random.integers(1, 101, 200).tolist()
        rooms = []
        for s in sorted(sizes, reverse=True):
            fit = [r for r in rooms if r >= s]
            if fit:
                rooms[rooms.index(min(fit))] -= s
            else:
                rooms.append(100 - s)
        runs = packing.plan(dict(Counter(sizes)), 100)
        assert max(first + n for parts in runs.values() for n, first, _ in parts) == len(rooms)
        assert {k: sum(n for n, _, _ in parts) for k, parts in runs.items()} == dict(Counter(sizes))


def test_lines(docs, none):
    holders = defaultdict(set)
    ids = [lines.NO_ID if i is None else i for i, _ in ROWS]
    for i, (_, t) in zip(ids, ROWS):
        for x in (t or "").split("\n"):
            holders[lines.key_of(x.encode())].add(i)
    want = []
    for i, (doc, t) in zip(ids, ROWS):
        every = (t or "").split("\n")
        keys = [lines.key_of(x.encode()) for x in every]
        left = [x for x, k in zip(every, keys) if len(k.decode()) < 10 or min(holders[k]) == i]
        want.append((doc, len(every), len(every) - len(left), "\n".join(left)))
    for sizes in ({}, {"bits_per_line": 1}):
        assert sorted((tuple(r) for r in lines.drop_repeated_lines(docs, **sizes).collect()), key=repr) == sorted(want, key=repr)
    assert lines.drop_repeated_lines(none).count() == 0


def test_lengths(docs, none):
    tool = library(lengths.FILE)
    sizes = [len(tool.encode(t or "", add_special_tokens=False).ids) for _, t in ROWS]
    for r in lengths.limits(lengths.histogram(docs)).collect():
        assert r.docs_within == sum(s <= r.length for s in sizes) and r.tokens_within == sum(s for s in sizes if s <= r.length)
        assert r.kept_tokens == sum(min(s, r.length) for s in sizes) and r.docs_over + r.docs_within == len(sizes)
    assert lengths.limits(lengths.histogram(none)).count() == 0


def test_pipeline(spark, sf_dir):
    large = "/root/testdata/sf0.1"
    docs = queries.table(spark, large, "documents")
    clean = corpus_pipeline.drop_toxic(spark, docs, large)
    assert clean.columns == docs.columns
    kept = clean.select("doc_id").distinct()
    gone = queries.table(spark, large, "labels").join(kept, "doc_id", "left_anti")
    assert gone.filter("toxic = 0").count() <= 35 < 380 < gone.filter("toxic = 1").count()
    docs = queries.table(spark, sf_dir, "documents")
    cut = corpus_pipeline.drop_lines(spark, docs, sf_dir)
    texts = {r.doc_id: r.text for r in lines.drop_repeated_lines(docs).collect()}
    assert cut.columns == docs.columns and all((r.text or "") == texts[r.doc_id] and r.n_chars == len(r.text) for r in cut.collect())
    single = corpus_pipeline.one_of_near_copies(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in simhash.near_duplicates(docs).collect()})
    last = corpus_pipeline.run(spark, sf_dir)
    assert last.agg({"length": "max"}).first()[0] <= 1024


def test_pipeline_stages_on_odd_rows(spark, docs, none, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
        assert stage(spark, docs, sf_dir).count() > 0


def test_pipeline_stages_keep_clashing_columns(spark, sf_dir):
    """Columns named as the stages' own are carried through with their values."""
    names = ["score", "score_", "Drop", "_id", "_no_id", "_hash", "_kept_text", "hash", "first"]
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:3]:
        plain = sorted(map(repr, stage(spark, docs, sf_dir).collect()))
        wide = docs
        for n in names:
            wide = wide.withColumn(n, docs["doc_id"] * 10 + len(n))
        got = stage(spark, wide, sf_dir)
        assert got.columns == wide.columns
        assert all(r[n] == r.doc_id * 10 + len(n) for r in got.collect() for n in names)
        assert sorted(map(repr, got.select(*docs.columns).collect())) == plain
