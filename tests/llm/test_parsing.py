import hashlib
import random

from docs_of import docs, edge_rows
from gridpulse.llm import parsing


def text_of(rng, n):
    return "".join(rng.choices("abcdefgh é", k=n))


def test_equal_substrings_share_phrases_at_any_offset():
    rng = random.Random(1)
    core = text_of(rng, 4000).encode()
    own = parsing.fingerprints([core])[0]
    for n in (1, 2, 3, 50):
        moved = parsing.fingerprints([text_of(rng, n).encode() + core])[0]
        assert parsing.likeness(own, moved) > 0.8
    halves = [text_of(rng, 2000) + core.decode()[:2000], text_of(rng, 4000)]
    half, other = (parsing.likeness(own, f) for f in parsing.fingerprints([h.encode() for h in halves]))
    assert 0.15 < half < 0.6 and other < 0.1


def test_texts_of_a_batch_don_t_meet():
    rng = random.Random(2)
    texts = [text_of(rng, n).encode() for n in (0, 1, 2, 5, 40, 300, 3000, 30_000)] + [b"", b"aaaa" * 500, b"ab" * 500]
    assert parsing.fingerprints(texts) == [parsing.fingerprints([t])[0] for t in texts]


def test_labels_of_neighbours_differ():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    label, most = x, None
    for most in (127, 13, 7, 5):
        before = np.concatenate([label[:1] ^ label.dtype.type(1), label[:-1]])
        label = parsing._toss(label, before)
        assert (label[1:] != label[:-1]).all() and label.max() <= most


def brute(rows):
    rows = sorted(((r[0] is not None, r[0] or 0, r[1] or ""), r[0]) for r in rows)
    out = []
    for i, ((_, _, text), doc_id) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][0][2]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, new, nxt = (parsing.fingerprints([t.encode()])[0] for t in (text, edited, after))
        out.append(
            (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, new, parsing.likeness(own, new), parsing.likeness(own, nxt))
        )
    return out


def test_beside_next_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(parsing, "RANGE_BYTES", 3000)
    rng = random.Random(4)
    rows = edge_rows(text_of(rng, 90_000)) + [(i, text_of(rng, rng.choice([3, 80, 900]))) for i in range(100, 160)]
    key = lambda r: tuple((x is None, x) for x in r)
    for n in (1, 5):
        got = [tuple(r) for r in parsing.beside_next(docs(spark, rows).repartition(n)).collect()]
        assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_small_tables(spark):
    assert parsing.beside_next(docs(spark, [])).count() == 0
    for rows in ([(1, "only one")], [(None, "no id")], [(None, "a"), (None, "b")], [(3, None)]):
        assert sorted(map(tuple, parsing.beside_next(docs(spark, rows)).collect()), key=str) == sorted(brute(rows), key=str)
    assert parsing.fingerprinted(docs(spark, [(1, None), (2, "")])).select("fingerprint").distinct().count() == 1
