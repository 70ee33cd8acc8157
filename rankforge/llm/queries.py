"""Queries of the numbered operators: thin calls with production parameters
over the whole tables.  ``QUERIES`` and ``ORACLES`` are merged into the driver
contract by ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, exact_dedup, hilbert, language, licenses, near_dedup, pages, pii, secrets, token_counts, tries
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


BYTE_BPE = "byte_bpe_50k.json"


@query("op1_latent_decontamination")
def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that give benchmark items away, with the evidence."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("mark")


@query("op2_hilbert_shards")
def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents along a Hilbert curve over (language, source, length), 40 shards."""
    plan = hilbert.shard_plan(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"], "doc_id", 40)
    return plan.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "curve")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def span_digest(found: DataFrame, kinds: tuple[str, ...], spans: str = "spans") -> DataFrame:
    """Counts of the base kinds, digest of the base spans, all spans."""
    base = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id", *[F.size(F.filter(spans, _of_kind(k))).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col(spans)).alias("spans"))


@query("op3_markov_secrets")
def op3_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = secrets.fit(docs)
    return span_digest(docs.select("doc_id", secrets.find(F.col("text"), model).alias("spans")), ("assign", "access", "hex"))


@query("op4_bootstrapped_pii")
def op4_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(pii.find(table(spark, sf_dir, "documents")), ("email", "ip", "card", "phone"))


@query("op6_license_inheritance")
def op6_license_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents.  The table has no paths; a document's
    folder is its source and its hundred, its name its id.  No name says
    LICENSE there, so short texts that are a quarter licence line count."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.col("source"), F.expr("doc_id div 1000"), F.expr("doc_id div 100"),
                       F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.resolve(docs.select("doc_id", "text", path.alias("path")), mostly=0.25)


@query("op5_language_spans")
def op5_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(~language.held_out("doc_id")))
    return (docs.select("doc_id", language.held_out("doc_id").alias("held_out"),
                        language.label(F.col("text"), model).alias("l"))
            .select("doc_id", "held_out", "l.lang_pred", "l.score", F.size("l.spans").cast("long").alias("n_spans")))


@query("op7_bpe_codec")
def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids again, digest both."""
    path = public_tokenizers.path(BYTE_BPE)
    coded = table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip(F.col("text"), path).alias("c"))
    return coded.select(
        "doc_id", F.size("c.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("c.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("c.back", 256).alias("decoded_sha256"))


#: White-space folding, smallest row of equal texts, in DuckDB.
EXACT_ORACLE = r"""
WITH folded AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM folded"""


@query("op8_chunk_recipes", EXACT_ORACLE)
def op8_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("mark")


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), 1024)


@query("op10_probminhash")
def op10_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_dedup.near_groups(table(spark, sf_dir, "documents")).drop("mark")


#: Counts, cuts and absorption in DuckDB; words of a piece by position.
COLLOCATION_ORACLE = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
listed AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM piece),
size AS (SELECT lang, sum(len(ws)) AS n FROM listed GROUP BY lang),
gram AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i : i + k - 1])) AS g
         FROM listed, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
freq AS (SELECT lang, k, g, count(*) AS a FROM gram GROUP BY ALL HAVING count(*) >= 30),
held AS (SELECT lang, s, max(a) AS a FROM (
           SELECT lang, a, unnest(list_filter([g[1:2], g[2:3], CASE WHEN k > 3 THEN g[3:4] END, CASE WHEN k > 3 THEN g[1:3] END,
                                               CASE WHEN k > 3 THEN g[2:4] END], lambda x: x IS NOT NULL)) AS s FROM freq WHERE k > 2) GROUP BY ALL),
kept AS (SELECT f.* FROM freq f LEFT JOIN held h ON f.lang = h.lang AND f.g = h.s WHERE f.k > 1 AND (h.a IS NULL OR 100 * h.a < 80 * f.a)),
cut AS (SELECT c.lang, c.g, c.a, c.cut, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
        FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept) c
        JOIN freq l ON l.lang = c.lang AND l.g = c.g[1:c.cut] JOIN freq r ON r.lang = c.lang AND r.g = c.g[c.cut + 1:c.k]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
named AS (SELECT *, array_to_string(g, ' ') AS phrase FROM best),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM named)
SELECT p.lang, p.rank::BIGINT AS rank, p.phrase, p.a::BIGINT AS a, p.l::BIGINT AS l, p.r::BIGINT AS r, s.n::BIGINT AS n, p.score::BIGINT AS score
FROM placed p JOIN size s ON s.lang = p.lang WHERE p.rank <= 2000"""


@query("op11_toivonen_collocations", COLLOCATION_ORACLE)
def op11_toivonen_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, top=2000)


#: Rebuilt conversations as text prefixes; CRC-32 (reflected, 0xEDB88320) of the decimal id bit by bit.
TRIE_ORACLE = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c FROM t),
crc AS (SELECT c, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
          lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)),
                                   lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END))) % 6 AS h FROM ids),
turns AS (SELECT crc.c, t.p AS o, t.role, t.text FROM crc JOIN t ON t.c = crc.c - crc.c % 100 AND t.p <= h
          UNION ALL SELECT crc.c, 1000000 + t.p, t.role, t.text FROM crc JOIN t ON t.c = crc.c AND t.p > h),
numbered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY o) AS d FROM turns),
path AS (SELECT c, d, length(text) AS size, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY d) AS k FROM numbered
         UNION ALL SELECT c, 0, 0, [] FROM ids),
full_size AS (SELECT c, max(d) AS d FROM path GROUP BY c),
node AS (SELECT p.k, p.d, min(p.c) AS conv_id, count(*) AS n_convs, max(size) AS size,
                coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (p.d = f.d), '') AS ends
         FROM path p JOIN full_size f USING (c) GROUP BY p.k, p.d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
below AS (SELECT a.k, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((b.n_convs - 1) * b.size) AS saved
          FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM node) b LEFT JOIN kids ON kids.k = b.k
          JOIN node a ON a.d = b.up AND a.k = b.k[1:b.up] GROUP BY a.k)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
       below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM node n JOIN below ON below.k = n.k LEFT JOIN kids ON kids.k = n.k LEFT JOIN node u ON n.d > 0 AND u.d = n.d - 1 AND u.k = n.k[1:n.d - 1]"""


@query("op12_contracted_trie", TRIE_ORACLE)
def op12_contracted_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the conversations rebuilt with the head of their hundred's first one."""
    c = F.col("c")
    head = F.crc32(c.cast("string").cast("binary")) % 6
    return tries.conversation_trie(table(spark, sf_dir, "conversations"), base=c - c % 100, head=head).drop("k1", "k2")


@query("op13_nearest_url_text")
def op13_nearest_url_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = pages.main_text(table(spark, sf_dir, "pages"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))
