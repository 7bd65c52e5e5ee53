"""Token files by exact round trips and single reads; the filter audit by walking every order."""

import io
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from tests.check import compare, duck
from waymark.llm import matrix, queries, token_files, tokens
from waymark.session import fresh_path

DOCS = "doc_id long, text string, lang string, tag string, words string, shard string, place string, failed string, part string, path string, _hash string"
LONG = "Many words go in, some twice; " * 4000
ROWS = [
    (7, "hello there"), (1, None), (2, ""), (3, "A b C # d"), (4, "A b C # d"), (4, "A b C # d"), (5, LONG), (None, "hello there"), (None, None),
    (9, "tab\tand\x0bnew\x1cline é 😀 <|endoftext|>"), (10, "x" * 5000), (-3, " ".join(f"w{i}" for i in range(150))),
]
LANGS = ["en", None, "", "de"]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, LANGS[k % 4], *"abcdefgh") for k, (i, t) in enumerate(rows)], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def encoded(text):
    return [*tokens._library(token_files.FILE).encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("ids", [[], [0], [255, 256], [50256, 3, 65536, 2**32 - 1], np.random.default_rng(1).integers(0, 70_000, 5_000).tolist(), [300] * 1024, [1] * 513])
def test_levels(ids):
    ids = np.array(ids, np.uint32)
    assert (token_files.from_levels(token_files.to_levels(ids)) == ids).all()
    opened = token_files.TokenFile(io.BytesIO(token_files.serialise([4, None], [len(ids), 0], ids)))
    assert [opened.token(i) for i in range(len(ids))] == ids.tolist() and (opened.ids() == ids).all()
    assert opened.documents()[0] == [4, None] and opened.documents()[1].tolist() == [0, len(ids), len(ids)]
    for outside in (-1, len(ids)):
        with pytest.raises(IndexError):
            opened.token(outside)


@pytest.mark.parametrize("sizes", [{}, {"part_bytes": 1000, "file_tokens": 50}])
def test_round_trip(spark, docs, none, sizes):
    folder = fresh_path(spark, "token-test")
    files = token_files.write(docs, folder, **sizes)
    got = token_files.read(files, folder, with_ids=True).orderBy("start").collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=repr) == sorted(((i, encoded(t)) for i, t in ROWS), key=repr)
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is None, i))
    start = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        start += r.n_tokens
    whole = [x for r in got for x in r.ids]
    wanted = [0, 1, 5, 5, 17, start - 1, start, -1, None, *range(100, 160)]
    found = token_files.tokens_at(files, spark.createDataFrame([(p, "x") for p in wanted], "position long, path string"), folder, stretch=64).collect()
    assert sorted((r.position, r.token) for r in found) == sorted((p, whole[p]) for p in {p for p in wanted if p is not None and 0 <= p < start})
    assert token_files.round_trip(none).count() == 0


def test_token_query(spark, sf_dir):
    got = sorted(queries.op11_token_files(spark, sf_dir).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, d in zip(got, sorted(queries.table(spark, sf_dir, "documents").collect(), key=lambda r: r.doc_id), strict=True):
        ids = encoded(d.text)
        assert tuple(r) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def walked(rows, marks):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = []
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        flags = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i]
        fails.append((part or "", {f for f, x in zip("ABCDE", flags) if x}, marks.get(i, (0, 0))))
    out, shapley = {}, Counter()
    for part in {p for p, _, _ in fails}:
        mine = [x for x in fails if x[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step + 1] = [
                    len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine), sum(x[2][0] for x in gone), sum(x[2][1] for x in gone)
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("most", [3 << 19, 40])
def test_audit(spark, docs, none, most):
    labels = spark.createDataFrame([(3, 1, 0, "x"), (3, 0, 1, "x"), (4, None, 1, "x"), (5, 1, None, "x"), (None, 1, 1, "x"), (99, 1, 1, "x")], "doc_id long, quality int, toxic int, part string")
    got = {tuple(r[:3]): tuple(r[3:]) for r in matrix.audit(docs, labels, most).collect()}
    # A null id has no label.
    want = walked([(i, t, LANGS[k % 4]) for k, (i, t) in enumerate(ROWS)], {3: (1, 1), 4: (0, 1), 5: (1, 0)})
    assert got == want
    assert matrix.audit(none, labels, most).count() == 0


def test_matrix(spark, docs, none):
    shards, dictionary = matrix.document_terms(docs, docs["doc_id"], 40)
    names = {r.word_id: bytes(r.word).decode() for r in dictionary.collect()}
    assert dictionary.count() == len(names) == len(set(names.values()))
    rows = []
    for s in shards.collect():
        indptr, indices, data = (np.frombuffer(x, k) for x, k in ((s.indptr, "<i8"), (s.indices, "<i8"), (s.data, "<i4")))
        rows += [(tag, {names[w]: n for w, n in zip(indices[a:b].tolist(), data[a:b].tolist())}) for tag, a, b in zip(s.tags, indptr, indptr[1:])]
    want = [(i, dict(Counter(re.findall(r"[^\x20\x09-\x0D]+", t or "")))) for i, t in ROWS]
    assert sorted(rows, key=lambda r: repr((r[0], sorted(r[1].items())))) == sorted(want, key=lambda r: repr((r[0], sorted(r[1].items()))))
    shards, dictionary = matrix.document_terms(none, none["doc_id"])
    assert shards.count() == dictionary.count() == 0


def test_audit_query(spark, sf_dir):
    assert compare(queries.op12_filter_audit(spark, sf_dir), duck(sf_dir), queries.ORACLES["op12_filter_audit"]) is None


def test_entries_of_a_shard_are_sorted_a_few_documents_at_a_time(monkeypatch):
    import numpy as np

    from waymark.llm import matrix

    draw = np.random.default_rng(5)
    sizes = np.r_[0, draw.integers(0, 9, 40), 0, 50, 0]
    codes = draw.integers(0, 7, sizes.sum()).astype(np.int32)
    held, unique = [], np.unique
    monkeypatch.setattr(matrix, "ENTRY_WORDS", 10)
    monkeypatch.setattr(np, "unique", lambda x, **kw: held.append(len(x)) or unique(x, **kw))
    indptr, (indices, data) = matrix._entries(codes, sizes, 7)
    assert max(held) == 50 and sorted(held)[-2] <= 10
    at = np.r_[0, np.cumsum(sizes)]
    for i in range(len(sizes)):
        words, counts = unique(codes[at[i] : at[i + 1]], return_counts=True)
        row = slice(indptr[i], indptr[i + 1])
        assert indices[row].tolist() == words.tolist() and data[row].tolist() == counts.tolist()


def test_lines_are_dropped_a_few_rows_at_a_time():
    import pyarrow as pa

    from waymark.llm import lines

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": ["one line of text\nx"] * 1000, "drop": [["one line of text"]] * 1000})
    out = list(lines._kept([batch], 10))
    assert max(b.num_rows for b in out) <= lines.ROWS and sum(b.num_rows for b in out) == 1000
    assert {t for b in out for t in b.column("text").to_pylist()} == {"x"}


def test_words_travel_packed_and_are_numbered_by_bucket(spark, monkeypatch):
    import pyarrow as pa

    from waymark.operators import terms

    monkeypatch.setattr(matrix, "BUCKET_WORDS", 7)
    words = [f"w{i}" * (i % 3 + 1) for i in range(60)] + ["é", "\x00", "x" * 1000]
    docs = spark.createDataFrame([(i, " ".join(words[i:] + words[:5])) for i in range(0, 60, 6)], "doc_id long, text string").repartition(5)
    shards, dictionary = matrix.document_terms(docs, docs["doc_id"], 2000)
    ids = {bytes(r.word).decode(): r.word_id for r in dictionary.collect()}
    assert set(ids) == set(words) and len(set(ids.values())) == len(words)
    for s in shards.collect():
        indptr, indices = np.frombuffer(s.indptr, "<i8"), np.frombuffer(s.indices, "<i8")
        for tag, a, b in zip(s.tags, indptr, indptr[1:]):
            assert set(indices[a:b].tolist()) == {ids[w] for w in words[tag:] + words[:5]}
    assert "Window" not in shards._jdf.queryExecution().executedPlan().toString()
    data, lengths = terms.packed(pa.array([b"ab", b"c", b"ab"], pa.binary()).slice(1))
    hashes = terms.word_hashes(np.frombuffer(data, "u1"), np.frombuffer(lengths, "<i4"))
    alone = terms.word_hashes(np.frombuffer(b"ab", "u1"), np.array([2], "<i4"))
    assert data == b"cab" and hashes[1] == alone[0] != hashes[0]
