"""Operators against plain Python that shares no code with them: Markov scores, pseudonyms, fingerprints, pair sums."""

import datetime as dt
import hashlib
import math
import random
import re
import time
from itertools import combinations, groupby

import numpy as np
import pytest

from docs_of import docs
from gridpulse.llm import parsing, pii, secrets, toxicity

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def mix(h):
    h = ((h ^ h >> 33) * 0xC4CEB9FE1A85EC53) & MASK
    return h ^ h >> 29


# --- Markov models ----------------------------------------------------------------

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."


def markov_scores(samples, values, smoothing=0.5):
    """Mean log-likelihood ratio of a character for each value, counted step by step."""
    n = len(ALPHABET) + 2
    kind = lambda c: ALPHABET.find(c) + 1 if c in ALPHABET else n - 1
    step = [[[0] * n for _ in range(n)] for _ in range(2)]
    for value, label in samples:
        before = 0
        for c in value:
            step[label][before][kind(c)] += 1
            before = kind(c)

    def log(label, a, b):
        rows = step[label]
        single = [sum(r[k] for r in rows) + smoothing for k in range(n)]
        share = single[b] / sum(single)
        return math.log((rows[a][b] + smoothing * n * share) / (sum(rows[a]) + smoothing * n))

    out = []
    for value in values:
        path = [0, *map(kind, value)]
        out.append(sum(log(1, a, b) - log(0, a, b) for a, b in zip(path, path[1:], strict=False)) / len(value))
    return out


def markov_spans(text, base, score):
    """Runs of token characters outside all pattern matches, 16 or more, that score above the margin."""
    free = [c in set(ALPHABET) - {"."} and c.isascii() for c in text]
    token = [bool(f) for f in free]
    out, i = [], 0
    while i < len(text):
        if not token[i]:
            i += 1
            continue
        j = i
        while j < len(text) and token[j]:
            j += 1
        if j - i >= 16:
            inside = [not any(s <= k < e for s, _, e in base) for k in range(i, j)]
            k = i
            for is_free, run in groupby(inside):
                size = len(list(run))
                value = text[k : k + size]
                if is_free and size >= 16 and any(c.isalnum() for c in value) and score(re.sub(r"([+/_=-])\1+", r"\1", value)) > 0.5:
                    out.append((k, "markov", k + size))
                k += size
        i = j
    return out


def test_markov_scores_and_spans(spark):
    rng = random.Random(1)
    samples = [("".join(rng.choices(ALPHABET[:62], k=30)), 1) for _ in range(20)] + [(w, 0) for w in ("reader", "writer_of", "value2", "héllo.x", "configuration")]
    models = secrets.fit(spark.createDataFrame(samples, "value string, random int"))
    values = ["a", "reader", "Zk9fQ2xV7bTn4RwY", "é.x=", "configuration_reader", "+" * 5]
    assert np.allclose([models.score(v) for v in values], markov_scores(samples, values), atol=1e-12)
    score = {}
    parts = ["Zk9fQ2xV7bTn4RwY8sLd3Hg1", "configuration_reader_writer", "token=abcdef99", "AKIA" + "B7" * 9, "0a" * 14, " ", "é", "-----", "x", "\n", "Qw3"]
    for _ in range(200):
        text = "".join(rng.choices(parts, k=rng.randint(1, 9)))
        got = secrets.all_spans(text, models)
        base = [s for s in got if s[1] != "markov"]
        plain = lambda v: score.setdefault(v, markov_scores(samples, [v])[0])
        assert [s for s in got if s[1] == "markov"] == markov_spans(text, base, plain), text


def test_a_long_file_of_keys_takes_linear_time():
    models = secrets.Models(np.zeros(secrets.N_SYMBOLS**2))
    times = []
    for n in (5_000, 20_000):
        text = "token=abcdef99 Zk9fQ2xV7bTn4RwY8sLd " * n
        began = time.process_time()
        assert len(secrets.all_spans(text, models)) == n
        times.append(time.process_time() - began)
    assert times[1] < 10 * times[0] + 0.5


# --- pseudonyms -------------------------------------------------------------------


def feistel(key, x, n, tweak, valid=lambda y: True):
    secret = hashlib.blake2b(key, digest_size=32).digest()
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    while True:
        left, right = divmod(x, 1 << half)
        for i in range(8):
            h = hashlib.blake2b(f"{tweak}:{n}:{i}:{right}".encode(), key=secret, digest_size=32).digest()
            left, right = right, left ^ (int.from_bytes(h, "big") % (1 << half))
        x = left * (1 << half) + right
        if x < n and valid(x):
            return x


def digits_of(s):
    return "".join(c for c in s if c.isdigit())


def put(shape, digits):
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in shape)


def number(key, digits, tweak, valid=lambda s: True):
    return str(feistel(key, int(digits), 10 ** len(digits), tweak, lambda y: valid(f"{y:0{len(digits)}d}"))).zfill(len(digits))


def luhn_ok(d):
    odd = sum(int(c) for c in d[::-1][::2])
    return (odd + sum(sum(map(int, str(2 * int(c)))) for c in d[::-1][1::2])) % 10 == 0


def plain_pseudonym(key, kind, v):
    d = digits_of(v)
    if kind == "card":
        head = number(key, d[:-1], "card")
        return put(v, head + next(c for c in "0123456789" if luhn_ok(head + c)))
    if kind == "iban":
        compact = v.replace(" ", "")
        body = put(compact[4:], number(key, digits_of(compact[4:]), "iban"))
        value = lambda s: int("".join(str(int(c, 36)) for c in s))
        check = next(f"{k:02d}" for k in range(2, 99) if value(body + compact[:2] + f"{k:02d}") % 97 == 1)
        left = iter(compact[:2] + check + body)
        return "".join(c if c == " " else next(left) for c in v)
    if kind == "ssn":
        fits = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
        return put(v, number(key, d, "ssn", fits))
    if kind == "date":
        form = "%Y-%m-%d" if v[4] == "-" else "%d.%m.%Y"
        first = dt.date(1900, 1, 1)
        days = (dt.datetime.strptime(v, form).date() - first).days
        return (first + dt.timedelta(feistel(key, days, (dt.date(2100, 1, 1) - first).days, "date"))).strftime(form)
    if kind == "ipv4":
        sizes = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
        x, n = 0, 1
        for p in v.split("."):
            x, n = x * sizes[len(p)][1] + int(p) - sizes[len(p)][0], n * sizes[len(p)][1]
        y, out = feistel(key, x, n, "ipv4:" + ",".join(str(len(p)) for p in v.split("."))), []
        for p in reversed(v.split(".")):
            y, r = divmod(y, sizes[len(p)][1])
            out.insert(0, str(r + sizes[len(p)][0]))
        return ".".join(out)
    if kind == "phone":
        country = {"+": 2}.get(v[0], 0) if v.startswith("+49") else 1 if v[0] == "+" else 0
        return put(v, d[:country] + number(key, d[country:], "phone"))
    local, domain = v.split("@")
    radix = [26 if c.isalpha() else 10 for c in local if c.isalnum()]
    x = 0
    for c, r in zip((c for c in local if c.isalnum()), radix, strict=True):
        x = x * r + (ord(c.lower()) - 97 if r == 26 else int(c))
    y, new = feistel(key, x, math.prod(radix), "email:" + ",".join(map(str, radix))), []
    for r in reversed(radix):
        y, k = divmod(y, r)
        new.insert(0, chr(97 + k) if r == 26 else str(k))
    left = iter(new)
    out = [(next(left) if c.isalnum() else c, c) for c in local]
    return "".join(a.upper() if c.isupper() else a for a, c in out) + "@" + domain


VALID = {
    "email": ["jo.doe+7@mail.example.com", "A9@x.org"],
    "iban": ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"],
    "card": ["4111 1111 1111 1111", "4111111111111111", "3782-822463-10005"],
    "ssn": ["123-45-6789"],
    "phone": ["+49 30 1234567", "+1 (017) 555-7713", "(212) 555-0100"],
    "ipv4": ["97.51.17.173", "8.8.8.8"],
    "date": ["2024-02-29", "29.02.2024"],
}
OTHERS = ["4111111111111112", "2024-02-30", "256.1.1.1", "000-12-3456", "DE88370400440532013000", "words", "a@b", "12", "é", "v1.2.3.4.5", "x-1"]


def test_pseudonyms_equal_plain_python(spark):
    rng = random.Random(5)
    key, kinds = b"some key", list(VALID)
    rows, want = [], []
    for i in range(60):
        old, new, n = [], [], 0
        for _ in range(rng.randint(0, 12)):
            if rng.random() < 0.6:
                kind = rng.choice(kinds)
                v = rng.choice(VALID[kind])
                old.append(v)
                new.append(plain_pseudonym(key, kind, v))
                n += 1
            else:
                old.append(rng.choice(OTHERS))
                new.append(old[-1])
        rows.append((i, " , ".join(old)))
        want.append((i, " , ".join(new), n))
    got = pii.pseudonymised(docs(spark, rows), key, counts="n_replaced").select("doc_id", "text", "n_replaced").collect()
    assert sorted(map(tuple, got)) == want


def test_many_addresses_and_numbers_take_linear_time():
    f = pii.Feistel(b"k")
    times = []
    for n in (1_000, 4_000):
        text = "jo@example.com 8.8.8.8 % " * n + "%" * n
        began = time.process_time()
        assert len(pii.replace(text, f)[1]) == 2 * n
        times.append(time.process_time() - began)
    assert times[1] < 10 * times[0] + 0.5


# --- fingerprints -----------------------------------------------------------------


def plain_fingerprint(data):
    """Level by level over Python lists of (symbol, run length)."""
    byte = lambda b: mix(b + 1)

    def next_level(symbols, level, bytes_):
        runs = [(s, len(list(g))) for s, g in groupby(symbols)]
        label = [s for s, _ in runs]
        for _ in range(3 if bytes_ else 4):
            before = [label[0] ^ 1, *label[:-1]]
            low = [((a ^ b) & -(a ^ b)).bit_length() - 1 for a, b in zip(label, before, strict=True)]
            label = [2 * k + (a >> k & 1) for a, k in zip(label, low, strict=True)]
        begin = [0] + [i for i in range(1, len(label) - 1) if label[i - 1] < label[i] > label[i + 1]]
        names = []
        for a, b in zip(begin, [*begin[1:], len(runs)], strict=True):
            h = 0
            for k, (s, n) in enumerate(runs[a:b]):
                h += ((byte(s) if bytes_ else mix(s)) + (n - 1) * 0xD6E8FEB86659FD93) * pow(BASE, k, 1 << 64)
            names.append(mix((h + level * BASE + b - a) & MASK))
        return names

    if not data:
        return "0:"
    levels = [list(data)]
    while True:
        level = len(levels) - 1
        names = next_level(levels[-1], level + 1, level == 0)
        if level > 0 and (len(names) < 32 or level == 16):
            break
        levels.append(names)
    parts = []
    for k, keep in zip(range(level, -1, -1), (32, 32, 8), strict=False):
        held = sorted({(byte(x) if k == 0 else x) >> 32 for x in levels[k]})[:keep]
        parts.append("".join(f"{x:08x}" for x in held))
    return f"{level}:{'|'.join(parts)}"


def plain_likeness(a, b):
    if a == b:
        return 1.0
    sides = []
    for f in (a, b):
        level, names = f.split(":")
        sides.append({int(level) - i: (set(re.findall("." * 8, p)), (32, 32, 8)[i]) for i, p in enumerate(names.split("|")) if p})
    both = total = 0
    for level in sorted(set(sides[0]) & set(sides[1]), reverse=True):
        if total < 8:
            (x, m), (y, n) = sides[0][level], sides[1][level]
            least = sorted(x | y)[: min(m, n)]
            both, total = both + len([k for k in least if k in x & y]), total + len(least)
    return both / total if total else 0.0


def test_fingerprints_equal_plain_python():
    rng = random.Random(6)
    texts = [b"", b"a", b"aaaa", b"ab" * 300, "é😀".encode() * 40]
    texts += [bytes(rng.choices(b"abcdefgh \n", k=rng.choice([3, 60, 700, 5000]))) for _ in range(25)]
    texts += [texts[-1][:3000] + texts[-2][:1000], bytes(rng.choices(range(256), k=4000))]
    got = parsing.fingerprints(texts)
    assert got == [plain_fingerprint(t) for t in texts]
    for a, b in combinations(got, 2):
        assert parsing.likeness(a, b) == plain_likeness(a, b)


# --- factorization machine ----------------------------------------------------------


def plain_terms(text):
    """Hashed words and stems of a text."""
    found = set()
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", text.lower()):
        for part in {w, *(w[:n] for n in (4, 5, 6) if len(w) > n)}:
            h = sum((b + 1) * pow(BASE, k, 1 << 64) for k, b in enumerate(part)) & MASK
            found.add(mix(h ^ (len(part) * 0xFF51AFD7ED558CCD & MASK)) % (1 << 22))
    return found


def plain_score(model, text):
    """Bias, weights, and the inner product of every pair."""
    row = {int(t): i for i, t in enumerate(model.kept)}
    at = sorted(row[t] for t in plain_terms(text) if t in row)
    margin = model.bias + sum(float(model.linear[i]) for i in at)
    margin += sum(float(np.dot(model.factors[i].astype(float), model.factors[j].astype(float))) for i, j in combinations(at, 2))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices([*(f"word{j}" for j in range(40)), "Ünï", "insulting", "people"], k=rng.randint(0, 40)))) for i in range(300)]
    toxic = lambda t: int("insulting" in t and "people" in t)
    labels = spark.createDataFrame([(i, toxic(t)) for i, t in rows], "doc_id long, toxic int")
    return rows, toxicity.fit(docs(spark, rows), labels)


def test_scores_equal_the_sum_over_pairs(spark, fitted):
    rows, model = fitted
    rows = [*rows[:80], (900, None), (901, ""), (902, "word1 unknown terms only here"), (903, "word1 " * 5000)]
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs(spark, rows), model).collect()}
    for i, t in rows:
        assert math.isclose(got[i], plain_score(model, (t or "").encode()), rel_tol=1e-4, abs_tol=1e-6), i


def test_the_stage_keeps_exactly_what_scores_below(spark, fitted):
    rows, model = fitted
    kept = toxicity.without_toxic(docs(spark, rows), model, threshold=0.5).collect()
    want = [i for i, t in rows if plain_score(model, t.encode()) < 0.5]
    assert sorted(r["doc_id"] for r in kept) == want and 0 < len(want) < len(rows)
