"""Secret scan: fixed patterns, and two character Markov models.

One model is trained from labelled samples of random strings, one from ordinary
identifiers; a long token that no pattern covers is a secret if the first
explains its characters better by a margin of log-likelihood a character.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import shared, sliced, text_or_empty

KINDS = ("assign", "access", "hex", "markov")
# patterns (fixed values); each match of the last two is a whole run, so a run is tried once
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: a sign repeated is scored once: rules and padding tell nothing
SIGNS = re.compile(r"([+/_=-])\1+")
IDENTIFIER = re.compile(r"[^\W_]{4,}")
ASSIGN_MIN, ACCESS_MIN = 6, 20

#: symbols of the models: letters, digits, signs; all others are one; the first is the start
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
N_SYMBOLS = len(SYMBOLS) + 2
#: a noncharacter; a value that holds one is read as two
BREAK = "\U0010ffff"
MARGIN = 0.5


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value) of the pattern matches, by start and then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_MIN:
                found.append((m.start(), "assign", m.end(), m[2]))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= ACCESS_MIN:
                found.append((m.start(), "access", m.end(), m[0]))
    for m in HEX.finditer(text):
        found.append((m.start(), "hex", m.end(), m[0]))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def symbols(value: str) -> np.ndarray:
    codes = np.frombuffer(value.encode("utf-32-le"), dtype="<u4")
    return _SYMBOL[np.minimum(codes, 128)]


_SYMBOL = np.full(129, N_SYMBOLS - 1, dtype=np.int64)
for _i, _c in enumerate(SYMBOLS):
    _SYMBOL[ord(_c)] = _i + 1


def transitions(value: str) -> np.ndarray:
    """Each step of the value, from the start symbol on, as one number."""
    s = symbols(value)
    return np.concatenate([[0], s[:-1]]) * N_SYMBOLS + s


def steps_of(values: list[str | None]) -> np.ndarray:
    """How often each step occurs in the values, taken as one row of symbols that the start symbol parts."""
    codes = np.frombuffer(BREAK.join(v or "" for v in values).encode("utf-32-le"), dtype="<u4")
    s = np.where(codes == ord(BREAK), 0, _SYMBOL[np.minimum(codes, 128)])
    if not len(s):
        return np.zeros(N_SYMBOLS * N_SYMBOLS, dtype=np.int64)
    before = np.concatenate([[0], s[:-1]])
    return np.bincount((before * N_SYMBOLS + s)[s > 0], minlength=N_SYMBOLS * N_SYMBOLS)


@dataclass
class Models:
    """Log-likelihood ratio, random against ordinary, of every step."""

    ratio: np.ndarray

    def score(self, value: str) -> float:
        """Mean log-likelihood ratio of a character; 0 for an empty value."""
        return float(self.ratio[transitions(value)].mean()) if value else 0.0


def fit(samples: DataFrame, smoothing: float = 0.5) -> Models:
    """Trains both models from samples(value, random 0/1).

    Steps are counted in the tasks and summed by Spark; what comes back is at
    most one row for each label and pair of symbols. A label without samples
    leaves its model uniform. Null and empty values have no steps.
    """

    def count(batches):
        sums = np.zeros((2, N_SYMBOLS * N_SYMBOLS), dtype=np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy()
            for of in (0, 1):
                sums[of] += steps_of(batch.column(0).filter(pa.array(label == of)).to_pylist())
        label, step = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label, pa.int32()), pa.array(step, pa.int32()), pa.array(sums[label, step])], names=["label", "step", "n"]
        )

    rows = samples.where("random in (0, 1)").select("value", F.col("random").cast("int"))
    counts = np.zeros((2, N_SYMBOLS, N_SYMBOLS))
    for r in rows.mapInArrow(count, "label int, step int, n long").groupBy("label", "step").agg(F.sum("n").alias("n")).collect():
        counts[r["label"], r["step"] // N_SYMBOLS, r["step"] % N_SYMBOLS] += r["n"]
    return from_counts(counts, smoothing)


def from_counts(counts: np.ndarray, smoothing: float = 0.5) -> Models:
    """Models of counted steps (label, before, symbol); rare steps lean on how common the symbol is."""
    single = counts.sum(axis=1, keepdims=True) + smoothing
    single /= single.sum(axis=2, keepdims=True)
    mass = smoothing * N_SYMBOLS
    logs = np.log((counts + mass * single) / (counts.sum(axis=2, keepdims=True) + mass))
    return Models((logs[1] - logs[0]).ravel())


def labelled_samples(docs: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """(value, random) from docs(doc_id, text): values of pattern matches against ordinary words.

    Of ``max_rows`` documents, by the smallest hashes of their ids, the rest is not read.
    """
    ids = docs.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    rows = docs.where(F.xxhash64("doc_id") <= F.lit(ids)) if ids is not None else docs.where("false")

    def run(batches):
        for batch in sliced(batches):
            value, label = [], []
            for text in batch.column("text").to_pylist():
                at = 0
                spans = base_spans(text)
                for start, _, end, secret in spans:
                    value.append(secret)
                    label.append(1)
                for start, _, end, _ in [*spans, (len(text), "", len(text), "")]:
                    for word in IDENTIFIER.findall(text, at, max(at, start)):
                        value.append(word)
                        label.append(0)
                    at = max(at, end)
            yield pa.RecordBatch.from_arrays([pa.array(value, pa.string()), pa.array(label, pa.int32())], names=["value", "random"])

    return rows.select(text_or_empty().alias("text")).mapInArrow(run, "value string, random int")


def all_spans(text: str, models: Models, margin: float = MARGIN) -> list[tuple[int, str, int]]:
    """(start, kind, end) of pattern matches and of further random tokens, by start and then kind.

    Characters that a pattern covers are not scored again: a token is cut there.
    Of a token of 16 characters or more the models alone decide, whether it holds
    digits or not; one of signs only is a rule or a line, not a string.
    """
    base = base_spans(text)
    out = [(s, k, e) for s, k, e, _ in base]
    covered: list[list[int]] = []
    for s, e in sorted((s, e) for s, _, e, _ in base):
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    at = 0  # tokens and covered ranges ascend: one sweep over both
    for m in TOKEN.finditer(text):
        a, end = m.span()
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        k = at
        while a < end:
            s, e = covered[k] if k < len(covered) and covered[k][0] < end else (end, end)
            k += 1
            if s - a >= 16:
                value = text[a:s]
                if any(c.isalnum() for c in value) and models.score(SIGNS.sub(r"\1", value)) > margin:
                    out.append((a, "markov", s))
            a = max(a, e)
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def scan(docs: DataFrame, models: Models, margin: float = MARGIN) -> DataFrame:
    """(doc_id, spans) of every row; spans: array of (kind, start, end), in code points, end exclusive.

    Null and empty texts have no spans; repeated rows keep a row each. Other
    columns are not read.
    """
    held = shared(docs.sparkSession, models)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>"
    fields = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        models = held()
        for batch in sliced(batches):
            rows = [
                [{"kind": k, "start": s, "end": e} for s, k, e in all_spans(t, models, margin)] for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, fields)], names=["doc_id", "spans"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)
