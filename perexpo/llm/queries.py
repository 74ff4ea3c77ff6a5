"""Registered queries of this package and their SQL: the operators over whole tables."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perexpo.llm import bpe, embeddings, language, merkle, mixing, neighbours, quality, repeats, secrets, simhash, toxicity, wavelet, whitening
from perexpo.llm.common import documents, id_crc
from perexpo.sources.tables import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
RANK_FILE = "byte_bpe_50k.tiktoken"
TOKENIZER_FILE = "byte_bpe_50k.json"


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_byte_bpe(spark, d):
    ranks = bpe.read_ranks(public_tokenizers.path(RANK_FILE))
    pieces = bpe.pieces_of(ranks)
    encoded = bpe.encode(documents(spark, d).select("doc_id", "text"), ranks, public_tokenizers.PATTERN)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids and decoded bytes of a batch as digests, in one step."""
        for batch in batches:
            offsets = batch["ids"].offsets.to_numpy()
            flat = batch["ids"].values.to_numpy(zero_copy_only=False).astype("<u4")
            own = [hashlib.sha256(flat[i:j].tobytes()).hexdigest() for i, j in zip(offsets, offsets[1:], strict=False)]
            decoded = [hashlib.sha256(b).hexdigest() for b in bpe.joined(batch["ids"], pieces)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"],
                    "n_tokens": pa.array(np.diff(offsets).astype(np.int64)),
                    "ids_sha256": pa.array(own, pa.string()),
                    "decoded_sha256": pa.array(decoded, pa.string()),
                }
            )

    return encoded.select("doc_id", "ids").mapInArrow(
        digests, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


@register
def op2_repeats(spark, d):
    found = repeats.repeated_passages(documents(spark, d))
    return found.withColumn("n_words", F.col("end_word") - F.col("start_word"))


@register
def op3_quality(spark, d):
    docs = documents(spark, d)
    held_out = id_crc("doc_id", 3) == 1
    model = quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet").where(~held_out))
    scored = quality.score(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register
def op4_neighbours(spark, d):
    table = spark.read.parquet(f"{d}/embeddings.parquet")
    return neighbours.search(table, F.col("vec_id") % 20 == 0)


@register
def op5_secrets(spark, d):
    found = secrets.scan(documents(spark, d).select("doc_id", "text"))

    def number(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind, *_ in secrets.BASE],
        F.sha2(secrets.as_text(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        secrets.as_text(F.col("spans")).alias("spans"),
    )


@register
def op6_embeddings(spark, d):
    found = embeddings.near_duplicates(spark.read.parquet(f"{d}/embeddings.parquet"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@register
def op7_mixing(spark, d):
    found = mixing.mix(documents(spark, d))
    return found.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("bigint").alias("taken")
    )


@register
def op8_language(spark, d):
    docs = documents(spark, d).select("doc_id", "text", "lang")
    held_out = id_crc("doc_id", 4) == 2
    profiles = language.fit(docs.where(~held_out))
    return language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), profiles).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


@register
def op9_wavelet(spark, d):
    path = scratch_path(spark, "llm-shards")
    with open(public_tokenizers.path(TOKENIZER_FILE), encoding="utf-8") as file:
        wavelet.write_shards(documents(spark, d), path, file.read())

    def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch["ids"].offsets.to_numpy()
            flat = batch["ids"].values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(offsets, offsets[1:], strict=False)]
            n = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["start"], n, pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    # In the task that reads a shard, so that the ids do not go through the JVM.
    columns = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return wavelet.read_documents(wavelet.read_shards(spark, path), checksum, columns)


@register
def op10_simhash(spark, d):
    found = simhash.near_duplicates(documents(spark, d))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@register
def op11_whitening(spark, d):
    table = spark.read.parquet(f"{d}/embeddings.parquet")
    model = whitening.fit(table)
    rows = whitening.transform(table, model)
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value"))
    n, error, shares = (model.n, model.identity_error, model.eigenvalues / model.trace) if model else (0, 0.0, [])
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        F.col("value").alias("whitened"),
        F.element_at(F.array(*[F.lit(float(x)) for x in shares]).cast("array<double>"), F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


@register
def op12_toxicity(spark, d):
    docs = documents(spark, d)
    held_out = id_crc("doc_id", 5) == 0
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet").where(~held_out))
    scored = toxicity.score(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register
def op13_merkle(spark, d):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = merkle.document_leaves(documents(spark, d), tampered)
    found = merkle.manifest(leaves, "source", ["doc_id"])
    used = F.coalesce("other_leaf", "leaf")
    checked = found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle.fold(used, F.col("path")).alias("folded_root"),
    )
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of the digits of doc_id, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
           lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8],
             lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END),
           4294967295::BIGINT))"""

#: Grams are numbers of up to three code points of 21 bits; what is no letter counts as a space.
ORACLE_SQL["op8_language"] = f"""
WITH docs AS (
  SELECT *, row_number() OVER () AS r, COALESCE({_CRC} % 4 = 2, FALSE) AS held_out FROM documents
), chars AS (
  SELECT r, unnest(c) AS ch, generate_subscripts(c, 1) AS i
  FROM (SELECT r, string_split(' ' || lower(text) || '  ', '') AS c FROM docs WHERE text IS NOT NULL)
), points AS (
  SELECT r, i, regexp_matches(ch, '\\p{{L}}') AS letter, CASE WHEN letter THEN unicode(ch) ELSE 32 END::BIGINT AS p FROM chars
), runs AS (
  SELECT r, letter, p, lead(letter) OVER w AS letter2, lead(p) OVER w AS p2, lead(p, 2) OVER w AS p3
  FROM points WINDOW w AS (PARTITION BY r ORDER BY i)
), grams AS (
  SELECT r, g, count(*) AS n FROM (
    SELECT r, p AS g FROM runs WHERE p3 IS NOT NULL AND letter
    UNION ALL SELECT r, p * 2097152 + p2 FROM runs WHERE p3 IS NOT NULL AND (letter OR letter2)
    UNION ALL SELECT r, (p * 2097152 + p2) * 2097152 + p3 FROM runs WHERE p3 IS NOT NULL AND letter2
  ) GROUP BY r, g
), profiles AS (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) - 1 AS rank
  FROM grams JOIN docs USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g QUALIFY rank < 300
), own AS (
  SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY n DESC, g) - 1 AS place FROM grams QUALIFY place < 300
), away AS (
  SELECT r, l.lang, sum(COALESCE(abs(p.rank - o.place), 300))::DOUBLE / (300 * count(*)) AS far
  FROM own o CROSS JOIN (SELECT DISTINCT lang FROM profiles) l LEFT JOIN profiles p ON p.lang = l.lang AND p.g = o.g
  GROUP BY r, l.lang
), ranked AS (
  SELECT r, lang, far, row_number() OVER w AS k, COALESCE(lead(far) OVER w, 1e0) AS second
  FROM away WINDOW w AS (PARTITION BY r ORDER BY far, lang)
)
SELECT doc_id, held_out, COALESCE(b.lang, 'und') AS lang_pred,
       CASE WHEN b.lang IS NULL THEN 0e0 WHEN far + second > 0 THEN second / (far + second) ELSE 0.5e0 END AS score
FROM docs LEFT JOIN (SELECT * FROM ranked WHERE k = 1) b USING (r)
"""

#: All pairs of one label, and what can be reached over their links.
ORACLE_SQL["op6_embeddings"] = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a
  JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT a AS node, b AS other FROM links
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
), lowest AS (
  SELECT node, min(other) AS other FROM reach GROUP BY node
), counts AS (
  SELECT a AS node, count(DISTINCT b) AS n FROM links GROUP BY a
)
SELECT vec_id, COALESCE(n, 0)::BIGINT AS n_links, least(vec_id, COALESCE(other, vec_id)) AS component_id,
       vec_id <= COALESCE(other, vec_id) AS kept
FROM embeddings LEFT JOIN counts c ON c.node = vec_id LEFT JOIN lowest o ON o.node = vec_id
"""

#: Documents are taken by running sums over the hash line, which the operator finds without sorting.
ORACLE_SQL["op7_mixing"] = """
WITH sized AS (
  SELECT doc_id, source,
         COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS place
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 2e0 * source_size AS cap,
         [3e0, 1e0, 2e0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight
  FROM sums
), levels AS (
  SELECT *, (1.5e0 * sum(source_size) OVER () - COALESCE(sum(cap) OVER (
               ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
            / sum(weight) OVER (
               ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM levels
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 1 END AS times FROM targets
), places AS (
  SELECT s.source, s.place, p.target - p.times * p.source_size AS budget, sum(s.size) AS n
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source GROUP BY ALL
), running AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY place) AS upto FROM places
), edges AS (
  SELECT source, min(place) AS edge FROM running WHERE upto - budget > budget - (upto - n) GROUP BY source
)
SELECT s.doc_id, s.size, p.source_size, p.target,
       (s.size * least(p.times + CASE WHEN e.edge IS NULL OR s.place < e.edge THEN 1 ELSE 0 END, 2))::BIGINT AS taken
FROM sized s
JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
LEFT JOIN edges e ON s.source IS NOT DISTINCT FROM e.source
"""

#: Both trees level by level; a leaf's proof by its place at every level, folded one step at a time.
ORACLE_SQL["op13_merkle"] = f"""
WITH RECURSIVE parts AS (
  SELECT *, COALESCE(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-')
         || COALESCE(strlen(source) || ':' || source, '-')
         || COALESCE(strlen(lang) || ':' || lang, '-')
         || COALESCE(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
         -- crc32 of the id's digits, bit by bit.
         {_CRC} % 5 = 0 AS tampered
  FROM documents
), hashed AS (
  SELECT doc_id, source, sha256(head || COALESCE(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN tampered THEN sha256(head || COALESCE(strlen(text) || ':'
           || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other
  FROM parts
), leaves AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS row_id,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY source) AS n
  FROM hashed
), nodes AS (
  SELECT source, 0 AS level, place, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, level + 1, place // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY place))
  FROM nodes WHERE n > 1 GROUP BY source, level, n, place // 16
), subroots AS (
  SELECT source, level, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), crown AS (
  SELECT 0 AS level, place, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY place))
  FROM crown WHERE n > 1 GROUP BY level, n, place // 16
), steps AS (
  SELECT source, level, place, COALESCE(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         COALESCE(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY source, level, place // 16 ORDER BY place)
), crown_steps AS (
  SELECT level, place, COALESCE(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         COALESCE(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM crown WHERE n > 1 WINDOW w AS (PARTITION BY level, place // 16 ORDER BY place)
), proofs AS (
  SELECT row_id, s.level AS k, s.l, s.r FROM leaves JOIN steps s
    ON s.source IS NOT DISTINCT FROM leaves.source AND s.place = leaves.place // (16 ** s.level)::BIGINT
  UNION ALL
  SELECT row_id, t.level + c.level, c.l, c.r FROM leaves JOIN subroots t ON t.source IS NOT DISTINCT FROM leaves.source
    JOIN crown_steps c ON c.place = t.place // (16 ** c.level)::BIGINT
), folds AS (
  SELECT row_id, 0 AS k, COALESCE(other, leaf) AS digest FROM leaves
  UNION ALL
  SELECT f.row_id, f.k + 1, sha256(p.l || f.digest || p.r) FROM folds f JOIN proofs p ON p.row_id = f.row_id AND p.k = f.k
), proof_digests AS (
  SELECT row_id, sha256(string_agg(l || r, '' ORDER BY k)) AS proof FROM proofs GROUP BY row_id
), ends AS (
  SELECT row_id, max_by(digest, k) AS folded_root FROM folds GROUP BY row_id
)
SELECT doc_id, leaf, subroot, root, COALESCE(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves
JOIN subroots t ON t.source IS NOT DISTINCT FROM leaves.source
CROSS JOIN (SELECT digest AS root FROM crown WHERE n = 1)
JOIN ends USING (row_id)
LEFT JOIN proof_digests USING (row_id)
"""
