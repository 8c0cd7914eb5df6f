"""The registered queries of this package: one opN_<name> for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.llm import decontam, divergence, merkle, mixing, parsing, pieces, pii, secrets, simhash, suffixdedup, toxicity, urlfilter, warc
from gridpulse.llm.common import table

#: url rules of op8, as (action, host, path)
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: key of the pseudonyms in the registered queries; a deployment passes its own
PII_KEY = b"registered-queries"
#: second 0 of the captures of op1: 2020-01-01
FIRST_CAPTURE = 1_577_836_800


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no capture time; their ids stand for the seconds."""
    pages = table(spark, sf_dir, "pages").withColumn("captured", F.lit(FIRST_CAPTURE) + F.coalesce("page_id", F.lit(0)))
    index = warc.capture_index(pages, min_bytes=1000)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_suffix_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    items = F.array_distinct(F.transform(F.filter("matches", lambda m: m["item_id"].isNotNull()), lambda m: m["item_id"].cast("string")))
    found = found.select("doc_id", "n_words", decontam.words_hit("matches").alias("n_hit"), items.alias("items"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.word_count("text").alias("size"))
    return mixing.mix(sized, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0).select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = secrets.fit(secrets.labelled_samples(docs, max_rows=20_000))
    kinds = F.array(*[F.lit(k) for k in secrets.KINDS])

    def listed(keep):
        spans = F.array_sort(
            F.transform(
                F.filter("spans", keep),
                lambda s: F.struct(s["start"].alias("a"), F.array_position(kinds, s["kind"]).alias("k"), s["end"].alias("b"), s["kind"].alias("kind")),
            )
        )
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return secrets.scan(docs, models).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(listed(lambda s: s["kind"] != "markov"), 256).alias("base_sha256"),
        listed(lambda s: F.lit(True)).alias("spans"),
    )


def op6_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, PII_KEY, counts="n_replaced")


def op7_consistent_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.beside_next(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled urls are those that a rule decides."""
    pages = table(spark, sf_dir, "pages")
    known = urlfilter.judge(pages, URL_RULES, "allow").where("rule is not null")
    model = urlfilter.fit(known.withColumn("blocked", (F.col("verdict") == "block").cast("int")), max_rows=20_000)
    return urlfilter.judge(pages, URL_RULES, model)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learns only from ids outside fold 0 of 5."""
    return toxicity.fit(docs, labels.where(toxicity.crc_fold(F.col("doc_id")) != 0), max_rows=20_000)


def op9_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.crc_fold(F.col("doc_id")) == 0, F.lit(False))
    return toxicity.scored(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixdedup.without_repeats(table(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    return kept.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=30, top_terms=50)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``agrees``: the library gave the same ids and the same decoded text."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    return pieces.encoded(table(spark, sf_dir, "documents"), model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "agrees",
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering takes the line ends out of the texts whose id has an even crc32."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = merkle.leaf_digest(text=F.replace("text", F.lit("\n"), F.lit("")))
    manifest = merkle.build(table(spark, sf_dir, "documents"), tampered=F.when(even & F.contains("text", F.lit("\n")), cut))
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    proven = merkle.proofs(manifest).select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    )
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_index, op2_suffix_decontam, op3_simhash_ball, op4_pivotal_mix, op5_markov_secrets, op6_feistel_pii,
        op7_consistent_parsing, op8_url_filter, op9_factorization_toxicity, op10_suffix_dedup, op11_source_divergence,
        op12_sentencepiece, op13_merkle_manifest,
    )
}

_OP2_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS words
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
place AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, n FROM place JOIN win USING (n, words)),
cover AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, strlen(coalesce(html, '')) AS n FROM pages),
k AS (SELECT b, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY b)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.b) AS payload_digest,
       CASE WHEN keep > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep > page_id THEN keep END AS refers_to
FROM p LEFT JOIN k ON p.b = k.b
"""

_OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs
  FROM (SELECT id, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
sized AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
total AS (SELECT lang, source, sum(n) AS total FROM c JOIN kept USING (lang, term) GROUP BY ALL),
share AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
         1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 5) // (coalesce(total, 0) + 5 * v) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (lang_n + 5) // (lang_total + 5 * v) AS q
  FROM g JOIN kept USING (lang) JOIN sized USING (lang) LEFT JOIN total USING (lang, source) LEFT JOIN c USING (lang, source, term)),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM share WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
QUALIFY part = 'pair' OR rank <= 50
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen(CAST({0} AS VARCHAR)), ':', {0}) END"


def _leaf_sql(text: str) -> str:
    return "sha256(concat(" + ", ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + "))"


def _tree_sql(name: str, nodes: str) -> str:
    """The levels of the trees over nodes(tree, pos, h), and the siblings of each node."""
    run = "PARTITION BY tree, lvl, pos // 3 ORDER BY pos ROWS BETWEEN"
    return f"""{name} AS (
  SELECT tree, 0 AS lvl, pos, h, count(*) OVER (PARTITION BY tree) AS n FROM {nodes}
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM {name} WHERE n > 1 GROUP BY tree, lvl, pos // 3),
{name}_siblings AS (
  SELECT tree, lvl, pos, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name} WHERE n > 1),
{name}_walk AS (
  SELECT id, tree, 0 AS lvl, pos, proof, h FROM {nodes}_start
  UNION ALL
  SELECT id, tree, lvl + 1, pos // 3, concat(proof, l, r), sha256(concat(l, h, r))
  FROM {name}_walk JOIN {name}_siblings USING (tree, lvl, pos)),
{name}_end AS (SELECT id, arg_max(proof, lvl) AS proof, arg_max(h, lvl) AS h FROM {name}_walk GROUP BY id)"""


# crc32 bit by bit: DuckDB has no function for it
_CRC_SQL = """xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""

_OP13_SQL = f"""
WITH RECURSIVE given AS (
  SELECT *, {_leaf_sql("text")} AS leaf, {_leaf_sql("replace(text, chr(10), '')")} AS cut, {_CRC_SQL} % 2 = 0 AS even FROM documents),
leaves AS (
  SELECT doc_id, leaf, CASE WHEN even THEN cut ELSE leaf END AS tampered, leaf AS h,
         CASE WHEN source IS NULL THEN '0' ELSE concat('1', source) END AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         row_number() OVER (ORDER BY source, doc_id, leaf) AS id FROM given),
leaves_start AS (SELECT id, tree, pos, '' AS proof, tampered AS h FROM leaves),
{_tree_sql("below", "leaves")},
subroots AS (SELECT '' AS tree, tree AS member, row_number() OVER (ORDER BY tree) - 1 AS pos, h FROM below WHERE n = 1),
subroots_start AS (
  SELECT id, '' AS tree, s.pos, e.proof, e.h FROM below_end e JOIN leaves USING (id) JOIN subroots s ON s.member = leaves.tree),
{_tree_sql("top", "subroots")}
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
FROM leaves JOIN top_end e USING (id) JOIN subroots s ON s.member = leaves.tree, (SELECT h FROM top WHERE n = 1) t
"""

ORACLE_SQL: dict[str, str] = {
    "op1_warc_index": _OP1_SQL,
    "op2_suffix_decontam": _OP2_SQL,
    "op11_source_divergence": _OP11_SQL,
    "op13_merkle_manifest": _OP13_SQL,
}
