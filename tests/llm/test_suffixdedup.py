import random
from collections import Counter

import numpy as np
import pytest

from docs_of import docs, edge_rows
from gridpulse.llm import suffixdedup


def brute(texts, length):
    """For each text its maximal removed runs."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(suffixdedup.runs_of(gone))
    return out


def test_difference_cover_sorts_suffixes():
    rng = np.random.default_rng(1)
    for n in [*range(0, 30), 200, 1001, 3002]:
        for k in (1, 2, 4, 60):
            s = rng.integers(1, k + 1, n)
            assert suffixdedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def rows(rng):
    alphabet = "abcdefghijk é\n"
    some = lambda n: "".join(rng.choices(alphabet, k=n))
    shared, other = some(500), some(230)
    out = [(100 + i, some(rng.randint(0, 400)) + shared[rng.randint(0, 250) :] + some(rng.randint(0, 300))) for i in range(30)]
    out += [(200 + i, some(100) + other + some(50) + other) for i in range(2)] + [(300 + i, shared) for i in range(4)]
    return out + [(400, "x" * 900), (401, "ab" * 300), (402, some(199)), (403, some(199)), (404, some(200)), (405, shared[:199])]


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 500])
def test_removal_equals_brute_force(spark, bucket_bytes):
    rng = random.Random(2)
    every = edge_rows(("very long " * 30 + "".join(rng.choices("abcdef", k=500))) * 3) + rows(rng)
    got = suffixdedup.without_repeats(docs(spark, every).repartition(3), 200, bucket_bytes).collect()
    key = lambda x: (x[0] is None, x[0] or 0)
    assert [r["doc_id"] for r in sorted(got, key=key)] == [r[0] for r in sorted(every, key=key)]
    for r, (row, spans) in zip(sorted(got, key=key), sorted(zip(every, brute([t for _, t in every], 200), strict=True), key=lambda x: key(x[0])), strict=True):
        data = (row[1] or "").encode()
        assert [tuple(x) for x in r["removed"]] == spans and r["n_bytes"] == len(data), row[0]
        edges = [0, *(x for s in spans for x in s), len(data)]
        assert bytes(r["kept"]) == b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def test_large_buckets_go_through_the_difference_cover(spark, monkeypatch):
    """A line in very many different surroundings, periodic texts, windows that agree at both ends."""
    rng = random.Random(7)
    some = lambda n: "".join(rng.choices("abcdefgh", k=n))
    line, head, tail = some(150), some(90), some(90)
    every = [(i, some(rng.randint(20, 120)) + line + some(rng.randint(20, 120))) for i in range(40)]
    every += [(100 + i, head + some(20) + tail) for i in range(30)] + [(200, "y" * 700), (201, "y" * 450), (202, "xyz" * 200), (203, "xyz" * 150)]
    every += [(300, every[0][1]), (301, every[45][1] + some(40))]
    rounds, sorted_bytes = [], []
    cut, settle = suffixdedup.fine_segments, suffixdedup.sorted_buckets
    monkeypatch.setattr(suffixdedup, "fine_segments", lambda *a: rounds.append(a[-1]) or cut(*a))

    def counted(classes, length):
        sorted_bytes.append(classes.selectExpr("coalesce(sum(octet_length(body)), 0)").first()[0])
        return settle(classes, length)

    monkeypatch.setattr(suffixdedup, "sorted_buckets", counted)
    got = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in suffixdedup.without_repeats(docs(spark, every), 200, 400).collect()}
    assert got == dict(zip([r[0] for r in every], brute([t for _, t in every], 200), strict=True))
    assert rounds[:2] == [0, 1] and len(rounds) <= 3 and sum(sorted_bytes) > 0


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "PIECE_BYTES", 700)
    rng = random.Random(3)
    every = rows(rng) + [(500, "".join(rng.choices("abc", k=5000))), (501, None)]
    got = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in suffixdedup.without_repeats(docs(spark, every)).collect()}
    assert got == dict(zip([r[0] for r in every], brute([t for _, t in every], 200), strict=True))


def test_a_full_filter_costs_no_result(spark):
    rng = random.Random(4)
    every = rows(rng)
    keyed = suffixdedup.keyed(docs(spark, every))
    full = np.full(1 << 15, 255, dtype=np.uint8)
    want = suffixdedup.segments(keyed, suffixdedup.repeated_filter(suffixdedup.anchor_counts(keyed, 200), 1 << 18), 200)
    assert suffixdedup.segments(keyed, full, 200).count() > want.count() > 0


def test_empty_tables(spark):
    assert suffixdedup.without_repeats(docs(spark, [])).count() == 0
    assert suffixdedup.without_repeats(docs(spark, [(1, None), (2, "")])).count() == 2
