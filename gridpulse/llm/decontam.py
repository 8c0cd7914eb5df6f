"""Benchmark decontamination with suffix arrays of the training text.

The documents are cut into shards of whole texts. Each shard builds a suffix
array over its words; the suffixes of the benchmark are binary-searched in it,
those that begin with the same window as one, which gives the interval of all
places where the window occurs verbatim. Places side by side join to the longest
verbatim matches, found once more by sorting the windows' names. Words count as
equal only if their bytes are. The work and the results grow with the places and the
items, not with their product, so common passages cost no more than rare ones.
The benchmark is read in blocks of a bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import ALNUM, Words, as_bytes, shared, sliced, text_or_empty

WINDOW = 10
SHARD_BYTES = 1 << 20
BLOCK_CHARS = 4 << 20
MATCHES = "array<struct<item_id:{id},doc_word:int,item_word:int,words:int>>"


@dataclass
class Block:
    """Items of the benchmark: ids and words; each word's rank, its item and the window length there; the classes of equal windows."""

    ids: list
    words: Words
    vocabulary: np.ndarray
    word_of: np.ndarray  # for each rank, a word of that rank
    rank: np.ndarray
    item: np.ndarray
    need: np.ndarray
    start: np.ndarray  # the suffixes that a window starts
    window_class: np.ndarray  # the class of each
    first: np.ndarray  # for each class, its first suffix
    member: np.ndarray  # for each class and item, the first suffix; by class
    bounds: np.ndarray  # where each class's members begin
    item_set: np.ndarray  # for each class the least class with the same items

    def members(self, c: int) -> np.ndarray:
        return self.member[self.bounds[c] : self.bounds[c + 1]]


def make_block(ids: list, texts: list[bytes], window: int = WINDOW) -> Block:
    w = Words(texts, ALNUM)
    vocabulary, word_of, rank = np.unique(w.hashes(), return_index=True, return_inverse=True)
    item = w.texts_of()
    need = np.minimum(w.count, window)[item]
    left = w.first[item] + w.count[item] - np.arange(len(item))
    need = np.where(left >= need, need, 0)
    rank = rank.astype(np.int64) + 1
    start = np.flatnonzero(need)
    window_class, classes = np.zeros(len(start), dtype=np.int64), 0
    for size in np.unique(need[start]).tolist():
        of = np.flatnonzero(need[start] == size)
        rows = np.ascontiguousarray(rank[start[of, None] + np.arange(size)])
        _, name = np.unique(rows.view(np.dtype((np.void, rows.itemsize * size))).ravel(), return_inverse=True)
        window_class[of] = name + classes
        classes += int(name.max()) + 1
    order = np.lexsort((start, item[start], window_class))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(window_class[order]) != 0) | (np.diff(item[start][order]) != 0)
    member, of_class = start[order[new]], window_class[order[new]]
    bounds = np.searchsorted(of_class, np.arange(classes + 1))
    sets: dict[bytes, int] = {}
    item_set = np.fromiter((sets.setdefault(item[member[a:b]].tobytes(), c) for c, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))), dtype=np.int64, count=classes)
    return Block(ids, w, vocabulary, word_of, rank, item, need, start, window_class, member[bounds[:-1]], member, bounds, item_set)


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, max_chars: int = BLOCK_CHARS):
    """The items in blocks of about ``max_chars`` characters of text, one at a time on the driver."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", text_or_empty().alias("text")).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1].encode())
        size += len(row[1])
        if size >= max_chars:
            yield make_block(ids, texts, window)
            ids, texts, size = [], [], 0
    if ids:
        yield make_block(ids, texts, window)


def suffix_array(rank: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the next ``depth`` ranks or more (ends of the array sort first).

    Several ranks are packed into one key and named by their order; the names are
    packed in turn, so the sorted depth multiplies with each round.
    """
    done, name = 1, rank
    while True:
        base = int(name.max()) + 2 if len(name) else 2
        pack = max(2, int(62 / np.log2(base)))
        pack = min(pack, max(2, -(-depth // done)))
        key = np.zeros(len(name), dtype=np.int64)
        for k in range(pack):
            shifted = np.zeros(len(name), dtype=np.int64)
            if k * done < len(name):
                shifted[: len(name) - k * done] = name[k * done :] + 1
            key = key * base + shifted
        order = np.argsort(key, kind="stable")
        done *= pack
        if done >= depth:
            return order
        ranked = key[order]
        new = np.empty(len(key), dtype=np.int64)
        new[order] = np.cumsum(np.concatenate([[0], np.diff(ranked) != 0])) if len(key) else 0
        name = new


def _narrow(sa: np.ndarray, rank: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: int, want: np.ndarray):
    """The part of each range lo..hi of the suffix array whose word number d is the wanted one."""
    n, out = len(rank), []
    for right in (False, True):
        a, b = lo.copy(), hi.copy()
        while True:
            open_ = a < b
            if not open_.any():
                break
            mid = (a + b) >> 1
            at = sa[np.minimum(mid, len(sa) - 1)] + d
            value = np.where(at < n, rank[np.minimum(at, n - 1)], -1)
            less = (value <= want) if right else (value < want)
            a = np.where(open_ & less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        out.append(a)
    return out


def _places(ranks: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(class, place) of every window of the block that occurs in the shard, by place."""
    sa = suffix_array(ranks, int(block.need.max(initial=1)))
    q = block.first
    need = block.need[q]
    lo, hi = np.zeros(len(q), dtype=np.int64), np.full(len(q), len(sa), dtype=np.int64)
    d = 0
    while True:
        on = np.flatnonzero((need > d) & (lo < hi))
        if not len(on):
            break
        lo[on], hi[on] = _narrow(sa, ranks, lo[on], hi[on], d, block.rank[q[on] + d])
        d += 1
    hits = np.maximum(hi - lo, 0)
    # a place has one class of each window length at most
    place = sa[np.repeat(lo, hits) + np.arange(int(hits.sum())) - np.repeat(np.cumsum(hits) - hits, hits)]
    found = np.repeat(np.arange(len(q)), hits)
    order = np.lexsort((found, place))
    return found[order], place[order]


def _longest(doc: list[np.ndarray], item: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each position of the doc rows (joined), the length of its longest match in an item row, and where (joined).

    Rows are names of windows. Positions are sorted by prefixes of 1, 2, 4 ... names;
    the longest match of a position is with the item position next to it in that
    order, before or after, and its length is read off the same prefixes.
    """
    rows = [*doc, *item]
    ends = -1 - np.arange(len(rows))  # a name of its own after each row: no match goes on
    symbols = np.concatenate([x for row, end in zip(rows, ends, strict=True) for x in (row, [end])])
    is_row = np.concatenate([np.arange(len(row) + 1) < len(row) for row in rows])
    n, n_doc = len(symbols), sum(len(r) + 1 for r in doc)
    names = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]
    step, longest = 1, max(map(len, item))
    while step <= longest:
        held = names[-1]
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = held[step:] + 1
        names.append(np.unique(held * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
        step *= 2
    order = np.argsort(names[-1], kind="stable")
    in_item = (order >= n_doc) & is_row[order]
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(in_item, at, -1))
    after = np.minimum.accumulate(np.where(in_item, at, n)[::-1])[::-1]
    spot = np.empty(n, dtype=np.int64)
    spot[order] = at
    mine = np.flatnonzero(is_row[:n_doc])
    best, where = np.zeros(len(mine), dtype=np.int64), np.full(len(mine), n_doc, dtype=np.int64)
    for side in (before, after):
        near = side[spot[mine]]
        known = (near >= 0) & (near < n)
        other = order[np.where(known, near, 0)]
        length = np.zeros(len(mine), dtype=np.int64)
        for k in reversed(range(len(names))):
            a, b = np.minimum(mine + length, n - 1), np.minimum(other + length, n - 1)
            length += np.where(known & (names[k][a] == names[k][b]), 1 << k, 0)
        better = length > best
        best[better], where[better] = length[better], other[better]
    item_at = np.cumsum(is_row) - 1  # positions without the names between rows
    return best, item_at[where] - len(mine)


def _runs(at: np.ndarray, joins: np.ndarray) -> list[slice]:
    """Slices of consecutive positions; joins[i]: position i may follow the one before."""
    cut = np.flatnonzero((np.diff(at) != 1) | ~joins[1:]) + 1
    return [slice(a, b) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True)]


def search(texts: list[bytes], block: Block) -> tuple[np.ndarray, list[list[tuple]]]:
    """Words of each text, and its longest verbatim matches (item row, doc word, item word, words).

    A match is listed where it is not the rest of the one a word before, with one
    item that holds it; an item that no such match names has an entry for its
    first window. So every word of a window is in an entry, and every item has one.
    """
    w = Words(texts, ALNUM)
    found: list[list[tuple]] = [[] for _ in texts]
    if not len(w.start) or not len(block.start):
        return w.count, found
    h = w.hashes()
    at = np.minimum(np.searchsorted(block.vocabulary, h), len(block.vocabulary) - 1)
    rank = np.where(block.vocabulary[at] == h, at + 1, 0)  # 0: a word that no item has
    slot = np.arange(len(h)) + w.texts_of()  # a 0 between texts, so no match crosses them
    word_at = np.zeros(len(h) + len(texts), dtype=np.int64)
    word_at[slot] = np.arange(len(h))
    while True:
        ranks = np.zeros(len(word_at), dtype=np.int64)
        ranks[slot] = rank
        name, place = _places(ranks, block)
        if not len(place):
            return w.count, found
        edge = np.bincount(place, minlength=len(ranks) + 1) - np.bincount(place + block.need[block.first[name]], minlength=len(ranks) + 1)
        covered = word_at[np.flatnonzero(np.cumsum(edge)[:-1] > 0)]
        wrong = [x for x in covered.tolist() if w.join(x, x + 1) != block.words.join(i := int(block.word_of[rank[x] - 1]), i + 1)]
        if not wrong:
            break
        rank[wrong] = 0  # another word of an equal hash
    text_of = w.texts_of()
    need = block.need[block.first[name]]
    top = int(block.need.max())
    full = np.flatnonzero(need == top)

    def entry(p: int, q: int, words: int) -> tuple[int, tuple]:
        x, i = int(word_at[p]), int(block.item[q])
        doc = int(text_of[x])
        return doc, (i, x - int(w.first[doc]), q - int(block.words.first[i]), words)

    entries = []
    if len(full):
        hit = np.zeros(len(block.first), dtype=bool)
        hit[name[full]] = True
        q = np.flatnonzero(hit[block.window_class])
        starts, names = block.start[q], block.window_class[q]
        places, doc_names = place[full], name[full]
        item_rows = _runs(starts, np.concatenate([[True], block.item[starts[1:]] == block.item[starts[:-1]]]))
        doc_rows = _runs(places, np.ones(len(places), dtype=bool))
        length, where = _longest([doc_names[r] for r in doc_rows], [names[r] for r in item_rows])
        begins = np.zeros(len(places), dtype=bool)
        begins[[r.start for r in doc_rows]] = True
        begins[1:] |= length[1:] >= length[:-1]
        for p, j, n in zip(places[begins].tolist(), starts[where[begins]].tolist(), length[begins].tolist(), strict=True):
            entries.append(entry(p, j, n + top - 1))
    for p, c, n in zip(place[need < top].tolist(), name[need < top].tolist(), need[need < top].tolist(), strict=True):
        entries.append(entry(p, int(block.first[c]), n))
    seen: list[set[int]] = [set() for _ in texts]
    for doc, match in entries:
        found[doc].append(match)
        seen[doc].add(match[0])
    doc_of = text_of[word_at[place]]
    _, once = np.unique(doc_of * len(block.item_set) + block.item_set[name], return_index=True)
    for k in once.tolist():  # the other items, from each set of items once a text
        doc = int(doc_of[k])
        for j in block.members(int(name[k])).tolist():
            if int(block.item[j]) not in seen[doc]:
                seen[doc].add(int(block.item[j]))
                found[doc].append(entry(int(place[k]), j, int(need[k]))[1])
    return w.count, found


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _matches_of(docs: DataFrame, block: Block, id_type: str) -> DataFrame:
    """docs(doc_id, key, text) -> (doc_id, key, n_words, matches) for one block."""
    held = shared(docs.sparkSession, block)
    kind = MATCHES.format(id=id_type)
    schema = f"doc_id {_type(docs, 'doc_id')}, key string, n_words long, matches {kind}"

    def run(batches):
        b = held()
        arrow_id = pa.string() if id_type == "string" else pa.int32() if id_type == "int" else pa.int64()
        fields = pa.list_(
            pa.struct([("item_id", arrow_id), ("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())])
        )
        for batch in sliced(batches, max_bytes=SHARD_BYTES):
            count, found = search(as_bytes(batch.column("text")), b)
            rows = [
                [{"item_id": b.ids[i], "doc_word": p, "item_word": q, "words": n} for i, p, q, n in sorted(ms)] for ms in found
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(count, pa.int64()), pa.array(rows, fields)],
                names=["doc_id", "key", "n_words", "matches"],
            )

    return docs.mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_words, matches) of every row: the longest verbatim matches of ``window`` words or more.

    A match is (item_id, doc_word, item_word, words), in words from 0, listed as
    ``search`` says; an item of fewer words than a window is found whole. Null and empty texts have no words,
    items without words no windows, and an empty benchmark no matches. Repeated
    documents and items each keep theirs. Other columns are not read. One block
    of the benchmark is the usual case; the matches of several are joined on
    (id, SHA-256 of the text).
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    id_type = _type(benchmark, "item_id")
    parts = []
    blocks = benchmark_blocks(benchmark, window, block_chars)
    first = next(blocks, None) or make_block([], [], window)
    second = next(blocks, None)
    if second is None:
        return _matches_of(rows.withColumn("key", F.lit("")), first, id_type).drop("key")
    keyed = rows.withColumn("key", F.sha2("text", 256))
    for block in chain((first, second), blocks):
        parts.append(_matches_of(keyed, block, id_type).dropDuplicates(["doc_id", "key"]))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    both = both.groupBy("doc_id", "key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"))
    both = both.withColumnsRenamed({"doc_id": "of", "key": "of_key"})
    ids = keyed.select("doc_id", "key")
    return ids.join(both, ids["doc_id"].eqNullSafe(both["of"]) & (ids["key"] == both["of_key"])).select("doc_id", "n_words", "matches")


def words_hit(column: str = "matches"):
    """Number of words inside at least one match."""
    spans = F.array_sort(F.transform(column, lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["words"]).alias("b"))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        spans,
        zero,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["b"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n"),
        ),
        lambda acc: acc["n"].cast("long"),
    )


def without_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all columns, that no window of the benchmark occurs in. No shuffle."""
    for block in benchmark_blocks(benchmark, window, block_chars):
        held = shared(docs.sparkSession, block)

        def run(batches, held=held):
            block = held()
            for batch in sliced(batches, max_bytes=SHARD_BYTES):
                _, found = search(as_bytes(batch.column("text")), block)
                kept = batch.filter(pa.array([not ms for ms in found]))
                if kept.num_rows:
                    yield kept

        docs = docs.mapInArrow(run, docs.schema)
    return docs
