"""The audit against plain Python over all documents, terms and pairs."""

import random
import re
from collections import Counter, defaultdict

import pytest

from docs_of import SCHEMA, docs, edge_rows
from gridpulse.llm import divergence


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(rows, min_docs, top):
    """rows of (lang, source, text)."""
    counts, docs_of, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", c) for a, b, c in rows):
        sources[lang].add(source)
        counts[lang, source].update(terms(text))
        docs_of[lang].update(set(terms(text)))
    out = []
    for lang, names in sources.items():
        kept = [t for t, n in docs_of[lang].items() if n >= min_docs]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in names}
        q = shares(sum((counts[lang, s] for s in names), Counter()))
        for s in names:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in names if o != s]
            over = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", over, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:limit])]
    return sorted(out)


def frame(spark, rows):
    """Documents of (lang, source, text)."""
    return spark.createDataFrame([(i, t, lang, s, None, *["x"] * 10) for i, (lang, s, t) in enumerate(rows)], SCHEMA)


def audited(frame, **limits):
    return sorted(map(tuple, divergence.audit(frame, **limits).collect()))


def corpus(seed, n=400, sources=6):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("x", "é", "Q", "ß")]
    rows = []
    for _ in range(n):
        source = rng.choice([None, "", *(f"s{i}" for i in range(sources))])
        mine = words if source != "s1" else words[:7]
        rows.append((rng.choice(["en", "fr", None]), source, " ".join(rng.choices(mine, weights=range(len(mine), 0, -1), k=rng.randint(0, 60)))))
    return rows + [rows[3]] * 50 + [("en", "s2", rows[5][2])] * 9 + [("en", s, "shared text of all") for s in ("s0", "s1", "s2")] * 4


@pytest.mark.parametrize("entries, kept", [(50_000, 200_000), (10, 20)])
def test_audit_equals_brute_force(spark, monkeypatch, entries, kept):
    monkeypatch.setattr(divergence, "GROUP_ENTRIES", entries)
    monkeypatch.setattr(divergence, "COUNTS_KEPT", kept)
    rows = corpus(1)
    assert audited(frame(spark, rows), min_docs=30, top_terms=50) == brute(rows, 30, 50)
    assert audited(frame(spark, rows), min_docs=3, top_terms=4) == brute(rows, 3, 4)


def test_collapse_keeps_each_text_once(spark):
    rows = corpus(2)
    got = divergence.collapsed(frame(spark, rows)).collect()
    want = Counter((a or "", c, b or "") for a, b, c in rows)
    assert Counter({(r["lang"], r["text"], s["source"]): s["n"] for r in got for s in r["sources"]}) == want
    assert len(got) == len({k[:2] for k in want})


def test_languages_without_kept_terms_and_single_sources(spark):
    rows = [("en", "a", "one two"), ("en", "b", None), ("en", "c", "1 2 3"), ("de", "only", "wort " * 5), ("it", "a", "")]
    got = audited(frame(spark, rows), min_docs=30)
    assert got == brute(rows, 30, 50) and all(r[4] == 0 for r in got) and len(got) == 6
    assert audited(frame(spark, rows), min_docs=1) == brute(rows, 1, 50)
    assert audited(frame(spark, [])) == []


def test_edge_rows(spark):
    rows = edge_rows("Very LONG text, " * 100_000)
    plain = [("en", "a", r[1]) for r in rows]
    assert audited(docs(spark, rows), min_docs=1) == brute(plain, 1, 50)
    both = [(r[0], r[1], "b" if i % 2 else "a") for i, r in enumerate(rows)]
    assert audited(docs(spark, both), min_docs=2) == brute([("en", r[2], r[1]) for r in both], 2, 50)


def test_ties_rank_by_item_in_utf8(spark):
    rows = [("en", s, t) for s, t in (("a", "zz éé ｚ 😀"), ("b", "other words"), ("ｂ", "other words"), ("😀", "other words"))]
    got = audited(frame(spark, rows), min_docs=1)
    assert got == brute(rows, 1, 50)


def test_counts_beyond_32_bits():
    sums, over = divergence._compared(["a", "b"], [10**15, 5], 1, 10**15 + 5, [("t", 10**15 + 5, [{"source": "a", "count": 10**15}])], True)
    share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5)
    assert sums[0, 1] == sums[1, 0] == abs(share(10**15, 10**15) - share(0, 5))
    assert over == [] or over[0][2] == share(10**15, 10**15) - share(10**15 + 5, 10**15 + 5)
