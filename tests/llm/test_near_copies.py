"""Near copies: planted ones by exact similarity, the pipeline's stage by op7, rows that share an id or have none."""

import random

import corpus_pipeline
from waymark.llm import minhash, simhash

DOCS = "doc_id long, text string"


def similarity(a, b):
    a, b = (set(minhash.shingles(t.encode()).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def planted(pairs):
    """Texts and a copy of each with one to five in a hundred words changed: (id, text), (id + 1, copy), similarity."""
    draw = random.Random(7)
    for n in range(pairs):
        text = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(60, 600))]
        copy = list(text)
        for at in draw.sample(range(len(text)), max(1, len(text) * (1 + n % 5) // 100)):
            copy[at] = f"new{draw.randrange(5000)}"
        text, copy = " ".join(text), " ".join(copy)
        yield (2 * n, text), (2 * n + 1, copy), similarity(text, copy)


def kept(spark, rows):
    return corpus_pipeline.one_of_near_copies(spark, spark.createDataFrame(rows, DOCS), None).collect()


def test_copies_at_similarity_080_are_one(spark):
    pairs = list(planted(150))
    ids = {r.doc_id for r in minhash.survivors(spark.createDataFrame([r for a, b, _ in pairs for r in (a, b)], DOCS)).collect()}
    assert {a[0] for a, _, _ in pairs} <= ids
    assert {b[0] for _, b, s in pairs if s < 0.8} == {i for i in ids if i % 2}
    assert sum(0.8 <= s < 0.9 for _, _, s in pairs) > 20 and sum(s < 0.8 for _, _, s in pairs) > 20


def test_spread_components_keep_their_links(spark, monkeypatch):
    """A chain of copies, each near to the next alone, is one group though cut into cells."""
    monkeypatch.setattr(minhash, "CELL_NODES", 4)
    draw = random.Random(3)
    text, rows = [f"w{i}" for i in range(200)], []
    for n in range(40):
        rows.append((n, " ".join(text)))
        text[draw.randrange(200)] = f"new{n}"
    assert similarity(rows[0][1], rows[-1][1]) < 0.8
    assert [r.doc_id for r in minhash.survivors(spark.createDataFrame(rows, DOCS)).collect()] == [0]


def test_one_row_per_component_not_per_id(spark):
    texts = [" ".join(f"{name}{i}" for i in range(30)) for name in "abcde"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (None, texts[4]), (9, texts[4])]
    got = sorted(((r.doc_id, r.text) for r in kept(spark, rows)), key=repr)
    assert got == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4])], key=repr)


def test_the_stage_keeps_one_row_of_each_group_of_op7(spark):
    """Texts whose fingerprints differ in 1 to 4 bits are one, whatever their similarity, as are chains of them."""
    rows = [r for a, b, _ in planted(60) for r in (a, b)]
    prints = {i: simhash.fingerprint(t.encode()) for i, t in rows}
    root = {i: i for i in prints}
    for _ in root:
        for a in root:
            for b in root:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    assert 60 < len(set(root.values())) < 120
    assert sorted(r.doc_id for r in kept(spark, rows)) == sorted(set(root.values()))
