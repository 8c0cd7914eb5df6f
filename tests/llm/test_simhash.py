import random
import re

import numpy as np
import xxhash

from gridpulse.llm import simhash
from gridpulse.llm.components import connected_components
from docs_of import docs, edge_rows


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(ids, fps, distance=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprints_equal_brute_force():
    rng = random.Random(3)
    texts = ["", " \x0b", "One", "one  TWO", "a b c", "w" * 50 + " x " + "é" * 40 + " y"]
    texts += [" ".join(rng.choices(["Ab", "été", "xyz", "q" * 33, "\x00-"], k=rng.randint(1, 700))) for _ in range(40)]
    got = simhash.fingerprints([t.encode() for t in texts])
    assert [int(x) for x in got] == [brute_fp(t) for t in texts]


def test_ball_links_lose_none(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(25):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (0, 1, 2, 3, 3, 3, 4, 5)}
    fps = sorted(fps)
    for distance in (1, 2, 3):
        nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
        links = simhash.ball_links(nodes, distance)
        assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= distance for a, b in links.collect())
        roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
        got = [roots.get(simhash._signed(f), simhash._signed(f)) for f in fps]
        want = brute_groups(list(range(len(fps))), fps, distance)
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_every_single_bit_is_linked_at_distance_one(spark):
    fp = random.Random(7).getrandbits(64)
    for bit in (*range(0, 63, 9), 20, 21, 41, 42, 62, 63):
        links = simhash.ball_links(spark.createDataFrame([(simhash._signed(f),) for f in (fp, fp ^ 1 << bit)], "fp long"), 1)
        assert links.count() == 1, bit


def test_one_large_group_of_near_fingerprints():
    rng = np.random.default_rng(5)
    fps = np.unique(np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)))
    pairs = simhash._spanning(fps, 2)
    assert sum(len(b) for _, b in pairs) == len(fps) - 1


def test_near_duplicates_edges(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choices([f"w{i}" for i in range(400)], k=300)) for _ in range(4)]
    rows = edge_rows("long words " * 40_000)
    rows += [(20 + i, b) for i, b in enumerate(base)] + [(40 + i, b + " extra") for i, b in enumerate(base)] + [(None, base[0])]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = [brute_fp(r[1]) for r in rows]
    want = brute_groups([r[0] for r in rows], fps)
    expected = sorted(((r[0] is None, r[0] or 0), f, c) for r, f, c in zip(rows, fps, want, strict=True))
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == expected
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
