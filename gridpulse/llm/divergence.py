"""Source divergence audit by duplicate-text collapse.

Identical texts of a language are one text with a multiplicity for each source.
Each is tokenised once; its term counts and document frequencies are added
weighted by the multiplicities. Pairs of sources are then compared over the terms
they have: a pair's terms that neither has, or only one, follow from sums over
the sources alone, and only terms that both have are met pair by pair.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm.common import as_bytes, sliced, written

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: (source, term) counts that a task adds up before it hands them on
COUNTS_KEPT = 500_000
ROWS_A_BATCH = 20_000
#: (source, term) entries that one comparison group holds
GROUP_ENTRIES = 50_000

# `[^\x00-\x40\x5B-\x60\x7B-\x7F]+` of UTF-8 bytes: each byte of a character beyond ASCII is in the class
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, text, sources): each text of a language once, with (source, n) of its copies.

    The copies are counted by the text's SHA-256, source by source, so that a text
    of very many copies is one row a task before any shuffle; the text itself is
    shuffled once.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    rows = docs.select(*named).select("lang", "source", "text", F.unhex(F.sha2("text", 256)).alias("h"))
    each = rows.groupBy("lang", "h", "source").agg(F.count("*").alias("n"))
    copies = each.groupBy("lang", "h").agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    texts = rows.groupBy("lang", "h").agg(F.first("text").alias("text"))
    return texts.join(copies, ["lang", "h"]).select("lang", "text", "sources")


def _grouped(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by the keys (the last one first), and where its groups of equal keys start."""
    order = np.lexsort(keys)
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([np.diff(k[order]) != 0 for k in keys], axis=0)
    return order, np.flatnonzero(new)


def _lists(starts: np.ndarray, size: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, size).astype(np.int32)), values)


PARTIAL = "lang string, term string, docs long, sources array<string>, counts array<long>"


def term_counts(texts: DataFrame) -> DataFrame:
    """collapsed texts -> (lang, term, docs, sources, counts), some rows a term: each task's weighted occurrences.

    ``docs`` is the part's weighted document frequency, counts[i] the occurrences in sources[i].
    """

    def flush(counts, docs):
        groups = list(counts.items())
        sizes = [len(c) for _, c in groups]
        langs = pa.array([lang for (lang, _), _ in groups], pa.string()).dictionary_encode()
        lang = np.repeat(langs.indices.to_numpy(), sizes)
        source = np.repeat(np.arange(len(groups)), sizes)
        names = pa.array([name for (_, name), _ in groups], pa.string())
        term = pa.array([t for _, c in groups for t in c], pa.binary()).dictionary_encode()
        count = np.fromiter((n for _, c in groups for n in c.values()), dtype=np.int64, count=sum(sizes))
        code = term.indices.to_numpy()
        order, first = _grouped([code, lang])
        terms = term.dictionary.take(pa.array(code[order][first]))
        of = langs.dictionary.take(pa.array(lang[order][first]))
        seen = [docs[x][t] for x, t in zip(of.to_pylist(), terms.to_pylist(), strict=True)]
        columns = [of, terms.cast(pa.string()), pa.array(seen, pa.int64())]
        columns += [_lists(first, len(order), names.take(pa.array(source[order]))), _lists(first, len(order), pa.array(count[order]))]
        counts.clear()
        docs.clear()
        for a in range(0, len(first), ROWS_A_BATCH):
            yield pa.RecordBatch.from_arrays([c.slice(a, ROWS_A_BATCH) for c in columns], names=["lang", "term", "docs", "sources", "counts"])

    def run(batches):
        counts: dict[tuple[str, str], Counter] = {}
        docs: dict[str, Counter] = {}
        size = 0
        for batch in sliced(batches):
            langs, sources = batch.column("lang").to_pylist(), batch.column("sources").to_pylist()
            for lang, copies, text in zip(langs, sources, as_bytes(batch.column("text")), strict=True):
                found = TERM.findall(text.lower())  # of bytes: only A-Z
                if not found:
                    continue
                own = Counter(found)
                seen = docs.setdefault(lang, Counter())
                many = sum(copy["n"] for copy in copies)
                if many == 1:
                    seen.update(own.keys())
                else:
                    seen.update(dict.fromkeys(own, many))
                for copy in copies:
                    total = counts.setdefault((lang, copy["source"]), Counter())
                    size -= len(total)
                    total.update(found if copy["n"] == 1 else {t: copy["n"] * c for t, c in own.items()})
                    size += len(total)
                if size > COUNTS_KEPT:
                    yield from flush(counts, docs)
                    size = 0
        if counts:
            yield from flush(counts, docs)

    return texts.mapInArrow(run, PARTIAL)


def kept_terms(partial: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, lang_count, counts of (source, count)) of the terms in ``min_docs`` documents or more.

    A term's rows lie side by side in one task, which adds them up as they stream
    by: at any time it holds one batch and the sums of the last term so far.
    """
    entry = pa.struct([("source", pa.string()), ("count", pa.int64())])

    def run(batches):
        carried = None

        def merged(rows: pa.Table, last: bool):
            """One row a term, and the last term's apart, as more of it may follow."""
            lang, term = (rows.column(c).combine_chunks() for c in ("lang", "term"))
            new = np.ones(len(rows), dtype=bool)
            for c in (lang, term):
                new[1:] &= pa.compute.equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            new[1:] = ~new[1:]
            first = np.flatnonzero(new)
            docs = np.add.reduceat(rows.column("docs").to_numpy(), first)
            sources, counts = (rows.column(c).combine_chunks() for c in ("sources", "counts"))
            group = np.repeat(np.cumsum(new) - 1, sources.value_lengths().to_numpy(zero_copy_only=False))
            names = sources.flatten().dictionary_encode()
            order, begin = _grouped([names.indices.to_numpy(), group])
            total = np.add.reduceat(counts.flatten().to_numpy()[order], begin)
            name = names.dictionary.take(pa.array(names.indices.to_numpy()[order][begin]))
            starts = np.flatnonzero(np.diff(group[order][begin], prepend=-1))
            out = pa.Table.from_arrays(
                [lang.take(pa.array(first)), term.take(pa.array(first)), pa.array(docs), _lists(starts, len(begin), name), _lists(starts, len(begin), pa.array(total))],
                names=["lang", "term", "docs", "sources", "counts"],
            )
            return (out, None) if last else (out.slice(0, len(out) - 1), out.slice(len(out) - 1))

        def result(rows: pa.Table):
            rows = rows.filter(pa.compute.greater_equal(rows.column("docs"), min_docs)).combine_chunks()
            if len(rows):
                sources, counts = (rows.column(c).combine_chunks() for c in ("sources", "counts"))
                starts = np.cumsum([0, *sources.value_lengths().to_numpy(zero_copy_only=False)])[:-1]
                values = counts.flatten().to_numpy()
                pairs = pa.StructArray.from_arrays([sources.flatten(), pa.array(values)], fields=list(entry))
                columns = [rows.column("lang"), rows.column("term"), pa.array(np.add.reduceat(values, starts)), _lists(starts, len(values), pairs)]
                yield from pa.Table.from_arrays(columns, names=["lang", "term", "lang_count", "counts"]).to_batches(ROWS_A_BATCH)

        plain = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch]).cast(plain)
                done, carried = merged(rows if carried is None else pa.concat_tables([carried, rows]), last=False)
                yield from result(done)
        if carried is not None:
            yield from result(merged(carried, last=True)[0])

    rows = partial.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return rows.mapInArrow(run, "lang string, term string, lang_count long, counts array<struct<source:string,count:long>>")


def _share(count, total: int, terms: int) -> int:
    return 1 + SCALE * (int(count) + SMOOTHING) // (total + SMOOTHING * terms)


def _compared(sources: list[str], totals: list[int], n_terms: int, lang_total: int, entries, first: bool):
    """What the terms of one group add to each pair of sources, and the terms each source has more of than its language.

    entries: (term, lang count, [(source, count)]). ``first``: the group that also adds the terms of neither.
    """
    s, at = len(sources), {name: i for i, name in enumerate(sources)}
    rest = [_share(0, n, n_terms) if n_terms else 0 for n in totals]
    base = np.array(rest, dtype=np.int64)
    apart = np.abs(base[:, None] - base[None, :])  # what a term of neither adds
    sums = apart * (n_terms if first else 0)
    own: list[list[int]] = [[] for _ in sources]
    both_a, both_b, both_v = [], [], []
    over = []
    for term, lang_count, counts in entries:
        q = _share(lang_count, lang_total, n_terms)
        which = np.array([at[c["source"]] for c in counts])
        p = np.array([_share(c["count"], totals[i], n_terms) for c, i in zip(counts, which, strict=True)], dtype=np.int64)
        for i, x in zip(which.tolist(), p.tolist(), strict=True):
            own[i].append(x)
            if x > q:
                over.append((i, term, x - q))
        # instead of what the two would add one by one, less the term of neither counted twice
        one = np.abs(p[:, None] - base[which][None, :])
        fix = np.abs(p[:, None] - p[None, :]) - one - one.T + apart[np.ix_(which, which)]
        both_a.append(np.repeat(which, len(which)))
        both_b.append(np.tile(which, len(which)))
        both_v.append(fix.ravel())
        if sum(map(len, both_v)) > 1_000_000:
            np.add.at(sums, (np.concatenate(both_a), np.concatenate(both_b)), np.concatenate(both_v))
            both_a, both_b, both_v = [], [], []
    if both_v:
        np.add.at(sums, (np.concatenate(both_a), np.concatenate(both_b)), np.concatenate(both_v))
    for i, values in enumerate(own):  # a term of i alone adds |p - the other's rest| instead of what neither's adds
        v = np.sort(np.array(values, dtype=np.int64))
        below = np.searchsorted(v, base)
        total = np.concatenate([[0], np.cumsum(v)])
        alone = base * below - total[below] + (total[-1] - total[below]) - base * (len(v) - below) - len(v) * apart[i]
        alone[i] = 0
        sums[i] += alone
        sums[:, i] += alone
    return sums, over


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) of docs(text, lang, source).

    Part ``pair``: the other sources of the language by the summed difference of
    their shares of each kept term, the farthest first. Part ``term``: the kept
    terms that the source has and has more of than its language, at most
    ``top_terms``. A language keeps the terms in at least ``min_docs`` of its
    documents; its documents without terms count as sources all the same. Shares
    are integers in parts of 10 ** 9. Null text, lang and source are empty ones,
    repeated rows are documents each, other columns are not read, ties rank by item
    in UTF-8, a language of one source has no pairs, an empty table gives an empty
    one. Counts are exact up to 2 ** 63.
    """
    kept, _ = written(kept_terms(term_counts(collapsed(docs)), min_docs), "divergence-terms")
    totals = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source"))
    totals = totals.agg(F.sum("c.count").alias("total"))
    sized = kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_count").alias("lang_total"), F.sum(F.size("counts")).alias("entries"))
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    named = occurring.join(totals, ["lang", "source"], "left").groupBy("lang")
    named = named.agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("sources"))
    # a group holds as many entries as it gives pairs, or more
    wide = F.greatest(F.lit(GROUP_ENTRIES), F.size("sources") * F.size("sources"))
    langs = named.join(sized, "lang", "left").select(
        "lang", "sources", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
        (F.lit(1) + F.coalesce("entries", F.lit(0)) / wide).cast("int").alias("groups"),
    )
    langs, path = written(langs, "divergence-languages")
    dealt = kept.join(langs.sparkSession.read.parquet(path).select("lang", "groups"), "lang")
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("term"), F.col("groups")).cast("int"))
    copied = langs.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        lang = right.to_pylist()[0]
        names = [x["source"] for x in lang["sources"]]
        entries = zip(*(left.column(c).to_pylist() for c in ("term", "lang_count", "counts")), strict=True)
        sums, over = _compared(names, [x["total"] for x in lang["sources"]], lang["n_terms"], lang["lang_total"], entries, lang["group"] == 0)
        # a term is in one group, so the first of each source are among the first of its groups
        over.sort(key=lambda x: (x[0], -x[2], x[1].encode()))
        at = [0, *(i + 1 for i in range(len(over) - 1) if over[i][0] != over[i + 1][0])]
        over = [x for a, b in zip(at, [*at[1:], len(over)], strict=True) for x in over[a : min(b, a + top_terms)]]
        a, b = np.nonzero(~np.eye(len(names), dtype=bool))
        out = {
            "source": [names[i] for i in a] + [names[i] for i, *_ in over],
            "part": ["pair"] * len(a) + ["term"] * len(over),
            "item": [names[i] for i in b] + [term for _, term, _ in over],
            "value": sums[a, b].tolist() + [v for *_, v in over],
        }
        n = len(out["part"])
        fields = [pa.array([lang["lang"]] * n, pa.string()), *(pa.array(out[c], pa.string()) for c in ("source", "part", "item")), pa.array(out["value"], pa.int64())]
        return pa.Table.from_arrays(fields, names=["lang", *out])

    met = dealt.groupBy("lang", "group").cogroup(copied.groupBy("lang", "group"))
    found = met.applyInArrow(compare, "lang string, source string, part string, item string, value long")
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top_terms))
