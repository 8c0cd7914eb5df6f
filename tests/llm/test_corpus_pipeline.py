"""The pipeline, stage by stage against plain Python, and the registered oracles, on the smallest tables."""

import hashlib
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from docs_of import docs, edge_rows
from gridpulse.llm import pii
from gridpulse.llm.queries import ORACLE_SQL, PII_KEY, QUERIES
from test_decontam import brute as brute_matches
from test_mixing import check
from test_simhash import brute_fp, brute_groups

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(spark, name, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)[name](spark, frame, SF)
    assert name == "mixing" or got.columns == COLUMNS
    return got.collect()


@pytest.fixture(scope="module")
def table(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS).collect()]


def test_stages_equal_brute_force(spark, table):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = table + [(9000, None, None, None, None), (9001, "", "en", "src0", 0), table[5]]
    kept = stage(spark, "toxicity", rows)
    assert {r["doc_id"] for r in kept} >= {9000, 9001}

    got = stage(spark, "simhash near-dedup", rows)
    groups = brute_groups([r[0] for r in rows], [brute_fp(r[1]) for r in rows])
    assert sorted(r["doc_id"] for r in got) == sorted(set(groups))

    got = stage(spark, "benchmark decontamination", rows)
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows if not brute_matches(r[1], items)[1])

    got = stage(spark, "pii", rows)
    f = pii.Feistel(PII_KEY)
    assert sorted((r["doc_id"], r["text"] or "") for r in got) == sorted((r[0], pii.replace(r[1] or "", f)[0]) for r in rows)

    got = stage(spark, "mixing", rows)
    check([(r[0], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows], got)


def test_documents_without_an_id_are_deduplicated_too(spark):
    long = [" ".join(f"{c}{i}" for i in range(300)) for c in "abc"]
    texts = [(None, long[0]), (None, long[0]), (None, long[1]), (7, long[1]), (None, long[2]), (None, long[2] + " end"), (None, None), (None, "")]
    got = stage(spark, "simhash near-dedup", [(i, t, "en", "a", None) for i, t in texts])
    groups = {(r["doc_id"], (r["text"] or "")[:2]) for r in got}
    assert len(got) == len(groups) == 4 and groups == {(None, "a0"), (7, "b0"), (None, "c0"), (None, "")}


def test_near_duplicates_are_rows_not_ids(spark):
    """Against brute force over rows: ids with several texts, repeated rows, null ids, null and empty texts."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(300)) for x in "abc")
    rows = [(5, a), (5, b), (3, b), (3, b + " end"), (8, c), (8, c), (8, c + " end"), (None, c), (None, "alone in the table"), (None, "alone in the table")]
    rows += [(1, None), (1, ""), (None, None), (2, " ")]
    got = stage(spark, "simhash near-dedup", [(i, t, "en", "a", None) for i, t in rows])
    fps = [brute_fp(t) for _, t in rows]
    groups = brute_groups(list(range(len(rows))), fps)
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, hashlib.sha256((r[1] or "").encode()).hexdigest())
    want = {min((r for r, g in zip(rows, groups, strict=True) if g == k), key=order) for k in groups}
    assert len(got) == len(want) == 5 and {(r["doc_id"], r["text"]) for r in got} == want


def test_run_and_registration(spark, table):
    out = entry.queries()["pipeline"](spark, SF).collect()
    assert 0 < len(out) <= len(table) and {r["doc_id"] for r in out} <= {r[0] for r in table}
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] and QUERIES.keys() <= entry.queries().keys()


def test_stages_on_edge_rows(spark):
    frame = docs(spark, edge_rows("very long text " * 20_000))
    for name, run in corpus_pipeline.STAGES:
        # the three texts without words are one group, and the repeated row is one document
        assert run(spark, frame, SF).count() == (6 if name == "simhash near-dedup" else 9), name
        assert run(spark, frame.limit(0), SF).count() == 0, name


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)
