import gc
import random
import re
import time
import weakref

import numpy as np
import pytest

from gridpulse.llm import decontam
from docs_of import docs, edge_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BENCH = "item_id long, text string, key string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item_id, t in items:
        x = words(t)
        n = min(10, len(x))
        windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                found.add(item_id)
                hit |= set(range(i, i + n))
    return len(w), len(hit), found


def test_suffix_array_sorts_to_the_depth():
    rng = np.random.default_rng(2)
    for depth in (1, 4, 10):
        rank = rng.integers(0, 3, 400)
        got = [tuple(rank[i : i + depth]) for i in decontam.suffix_array(rank, depth)]
        assert got == sorted(got)


@pytest.mark.parametrize("block_chars", [1 << 22, 60])
def test_matches_equal_brute_force(spark, block_chars):
    rng = random.Random(5)
    vocabulary = ["Ab", "cd", "été", "x1", "zz"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([2, 9, 10, 14])))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "..."), (53, "rare"), (None, "has no id"), (7, items[3][1])]
    rows = edge_rows("filler " * 50_000 + items[0][1])
    for i in range(100, 130):
        text = " , ".join(rng.choices(vocabulary, k=40)) + " RARE! " * (i % 2) + " -- ".join(words(items[i % 12][1]))
        rows.append((i, text))
    rows.append((200, "it HAS no id"))
    bench = spark.createDataFrame([(*x, "x") for x in items], BENCH)
    got = decontam.matches(docs(spark, rows), bench, block_chars=block_chars)
    got = got.withColumn("n_hit", decontam.words_hit()).collect()
    assert len(got) == len(rows)
    want = {r[0]: brute(r[1], items) for r in rows}
    for r in got:
        n, hit, found = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], {m["item_id"] for m in r["matches"]}) == (n, hit, found)
    kept = decontam.without_matches(docs(spark, rows), bench, block_chars=block_chars).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept) == sorted((r[0] is None, r[0]) for r in rows if not want[r[0]][1])
    assert kept[0].asDict().keys() == docs(spark, rows[:1]).first().asDict().keys()


def test_blocks_are_not_held_together_on_the_driver(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"word{i} and more", "x") for i in range(8)], BENCH)
    made, most, real = [], [], decontam.make_block

    def counted(*args):
        gc.collect()
        most.append(sum(r() is not None for r in made))
        block = real(*args)
        made.append(weakref.ref(block))
        return block

    monkeypatch.setattr(decontam, "make_block", counted)
    got = decontam.matches(docs(spark, [(1, "word5 and more")]), bench, block_chars=1).first()["matches"]
    assert [m["item_id"] for m in got] == [5] and len(made) == 8 and max(most) <= 3


def test_longest_match_and_place(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, "start " + passage + " end", "x")], BENCH)
    got = decontam.matches(docs(spark, [(1, "a b " + passage + " c")]), bench).first()["matches"]
    assert [tuple(m) for m in got] == [(1, 2, 1, 30)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], BENCH)
    got = decontam.matches(docs(spark, edge_rows("long " * 10)), none).collect()
    assert len(got) == 9 and not any(r["matches"] for r in got)
    assert decontam.matches(docs(spark, []), none).count() == 0
    assert decontam.without_matches(docs(spark, edge_rows("x")), none).count() == 9


def longest_matches(text, items):
    """For each place of a window, the longest match that begins there; those that aren't the rest of the one before."""
    w, rows = words(text), [words(t) for _, t in items]
    best = []
    for p in range(len(w)):
        n = 0
        for x in rows:
            for q in range(len(x)):
                k = 0
                while p + k < len(w) and q + k < len(x) and w[p + k] == x[q + k]:
                    k += 1
                n = max(n, k)
        best.append(n if n >= 10 else 0)
    return {(p, n) for p, n in enumerate(best) if n and (p == 0 or best[p - 1] == 0 or n >= best[p - 1])}


def test_longest_matches_equal_brute_force():
    rng = random.Random(8)
    for trial in range(12):
        vocabulary = ["a", "b"] if trial % 2 else ["a", "b", "c", "d"]
        items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([12, 20, 40])))) for i in range(5)]
        texts = []
        for _ in range(4):
            parts = []
            for _ in range(4):
                t = words(rng.choice(items)[1])
                a = rng.randrange(len(t))
                parts += [*t[a : a + rng.randint(1, 30)], *rng.choices([*vocabulary, "x"], k=rng.randint(0, 3))]
            texts.append(" ".join(parts))
        block = decontam.make_block([i for i, _ in items], [t.encode() for _, t in items])
        _, found = decontam.search([t.encode() for t in texts], block)
        for text, matches in zip(texts, found, strict=True):
            w = words(text)
            for i, p, q, n in matches:
                assert w[p : p + n] == words(items[i][1])[q : q + n]
            want = longest_matches(text, items)
            assert want <= {(p, n) for _, p, _, n in matches}
            assert {i for i, *_ in matches} == brute(text, items)[2]
            assert len(matches) <= len(want) + len(items)


def test_one_word_very_often_against_long_items():
    items = [(i, "word " * 1000) for i in range(3)]
    block = decontam.make_block([i for i, _ in items], [t.encode() for _, t in items])
    began = time.process_time()
    count, found = decontam.search([b"word " * 200_000], block)
    assert time.process_time() - began < 6 and count[0] == 200_000
    assert {m[0] for m in found[0]} == {0, 1, 2} and max(m[3] for m in found[0]) == 1000


def test_a_passage_of_all_items_costs_its_items_once():
    passage = " ".join(f"p{i}" for i in range(200))
    items = [(i, f"{passage} own{i} text{i}") for i in range(500)]
    block = decontam.make_block([i for i, _ in items], [t.encode() for _, t in items])
    _, found = decontam.search([passage.encode()] * 20, block)
    assert all({m[0] for m in f} == set(range(500)) and len(f) <= 501 for f in found)


def test_words_of_equal_hashes_are_told_apart(monkeypatch):
    passage = " ".join(f"w{i}" for i in range(12))
    other = passage.replace("w5", "q5")
    real = decontam.Words.hashes
    # the hash of q5 is that of w5
    monkeypatch.setattr(decontam.Words, "hashes", lambda self: np.array([int.from_bytes(self.join(i, i + 1).replace(b"q", b"w"), "big") for i in range(len(self.start))], dtype=np.uint64))
    block = decontam.make_block([1], [passage.encode()])
    _, found = decontam.search([passage.encode(), other.encode(), (other + " " + passage).encode()], block)
    assert [[m[1:] for m in f] for f in found] == [[(0, 0, 12)], [], [(12, 0, 12)]] and real
