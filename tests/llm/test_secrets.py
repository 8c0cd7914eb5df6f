import builtins
import random
import re
import sys

from docs_of import docs, edge_rows
from gridpulse.llm import secrets

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def brute_base(text):
    """The patterns as the contract states them, one by one."""
    out = []
    assign = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for kind, pattern, keep in (
        ("assign", assign, lambda m: len(m[2]) >= 6), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, re.ASCII) if keep(m)]
    return sorted(out, key=lambda x: (x[0], secrets.KINDS.index(x[1])))


def models(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choices(ALPHABET, k=40)), 1) for _ in range(300)]
    rows += [(name, 0) for name in (*dir(builtins), *sys.stdlib_module_names)] + [(None, 1), ("", 0)]
    return secrets.fit(spark.createDataFrame(rows, "value string, random int"))


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    parts = ["password", "PassWD", "api_key", "apikey", "ſecret", "token", "=", ": ", '"', "'", " ", "abc123", "AKIA", "ABCDEFGH0123456789", "0123456789abcdef" * 2, "é", "x" * 30, "\n"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert [(s, k, e) for s, k, e, _ in secrets.base_spans(text)] == brute_base(text)


def test_models_part_random_strings_from_identifiers(spark):
    m = models(spark)
    rng = random.Random(3)
    random_ones = ["".join(rng.choices(ALPHABET, k=24)) for _ in range(200)]
    ordinary = ["parse_header_configuration", "document_reader_window", "html_server_value_reader", "StreamReaderError"]
    assert sum(m.score(x) > secrets.MARGIN for x in random_ones) >= 196
    assert not any(m.score(x) > secrets.MARGIN for x in ordinary) and m.score("") == 0.0


def test_camel_case_identifiers_are_ordinary(spark):
    """The training words and identifiers of before, beside the new ones."""
    rng = random.Random(1)
    names = ["getUserName", "parse_header", "document", "window", "configuration", "value2", "http_server", "reader", "Bibliothek"]
    rows = [("".join(rng.choices(ALPHABET, k=40)), 1) for _ in range(300)]
    old = [("".join(rng.choices(names, k=2)), 0) for _ in range(300)]
    new = [(name, 0) for name in (*dir(builtins), *sys.stdlib_module_names)]
    m = secrets.fit(spark.createDataFrame(rows + old + new, "value string, random int"))
    ordinary = ["parse_header_configuration", "documentReaderWindowName", "httpServerValueReader", "httpServerValueReader2"]
    assert [x for x in ordinary if m.score(x) > secrets.MARGIN] == []
    assert all(secrets.all_spans(f"see {x} there", m) == [] for x in ordinary)


def test_scan_edges(spark):
    secret = "Zk9fQ2xV7bTn4RwY8sLd3Hg1"
    rows = edge_rows("long words " * 40_000 + secret) + [(30, f"é token = {secret} and {secret}")]
    got = secrets.scan(docs(spark, rows), models(spark)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in got}
    assert by[5] == [("markov", 440_000, 440_000 + len(secret))]
    assert by[30] == [("assign", 2, 10 + len(secret)), ("markov", 15 + len(secret), 15 + 2 * len(secret))]
    assert all(by[i] == [] for i in (None, 1, 2, 3, 4, 6, 7))
    assert secrets.scan(docs(spark, []), models(spark)).count() == 0


def test_letters_alone_are_scored_and_lines_of_signs_are_not(spark):
    rng = random.Random(4)
    keys = ["".join(rng.choices(ALPHABET[:52], k=24)) for _ in range(100)]
    ordinary = ["internationalization", "document_reader_window", "-" * 40, "=" * 16, "Chapter" + "-" * 30, "_" * 16 + "/" * 16]
    m = models(spark)
    got = secrets.scan(docs(spark, [(i, f"see {k} there") for i, k in enumerate(keys)]), m).collect()
    assert sum([tuple(s) for s in r["spans"]] == [("markov", 4, 28)] for r in got) >= 95
    assert all(secrets.all_spans(f"see {x} there", m) == [] for x in ordinary)


def test_models_without_samples_are_uniform(spark):
    m = secrets.fit(secrets.labelled_samples(docs(spark, [])))
    assert m.score("anything") == 0.0


def test_labelled_samples(spark):
    got = secrets.labelled_samples(docs(spark, [(1, "plain words token=abcdef99 tail"), (2, None)])).collect()
    assert sorted(map(tuple, got)) == [("abcdef99", 1), ("plain", 0), ("tail", 0), ("words", 0)]
