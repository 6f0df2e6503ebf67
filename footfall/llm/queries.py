"""Registered queries of the operators, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from footfall.llm import (
    bpe,
    exact_dedup,
    fill_middle,
    html_extract,
    matrices,
    merkle,
    near_dup,
    neighbours,
    packing,
    quality,
    suffix_dedup,
    toxicity,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Path rules of the url filter, given with the task.
RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]


def op1_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """Pages judged by rules and host reputation. A labelled page is one whose id has a
    row in labels; it is good when its quality is 1 and it is not toxic, in every row of it."""
    pages = _table(spark, folder, "pages")
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    labels = _table(spark, folder, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.min(good).alias("good"))
    host, _ = url_filter.url_parts(F.col("url"))
    hosts = pages.select("page_id", host.alias("host"))
    reputation = url_filter.host_reputation(hosts.join(labels, "page_id"), hosts=hosts)
    return url_filter.judge_urls(pages, reputation, RULES)


def _posterior_sql(level: int, good: str, n: str, strength: str) -> str:
    """Mean and variance of a level, from those of the one above."""
    room = f"m{level - 1} * (1 - m{level - 1})"
    size = f"greatest({room} / (v{level - 1} + {room} / ({strength} + 1)) - 1, 0.5)"
    return (
        f"({good} + {size} * m{level - 1}) / ({n} + {size}) AS m{level}, "
        f"m{level} * (1 - m{level}) / ({n} + {size} + 1) AS v{level}"
    )


def _strength_sql(units: str, p: str) -> str:
    return (
        f"SELECT greatest(2.0, least(1000.0, coalesce(sum(n * {p} * (1 - {p}) * (n - 1)) / "
        f"greatest(sum((g - n * {p}) ** 2 - n * {p} * (1 - {p})), 1e-9) - 1, 1000.0))) AS s FROM {units} WHERE n > 1"
    )


SQL_PARTS = {
    "{top}": "(g0 - g + 1) / (n0 - n + 2) AS m0, m0 * (1 - m0) / (n0 - n + 3) AS v0",
    "{post_1}": _posterior_sql(1, "(g1 - g)", "(n1 - n)", "s"),
    "{post_2}": _posterior_sql(2, "(g2 - g)", "(n2 - n)", "t"),
    "{post_3}": _posterior_sql(3, "g", "n", "r"),
    "{strength_1}": _strength_sql("u1", "m0"),
    "{strength_2}": _strength_sql("u2", "m1"),
    "{strength_3}": _strength_sql("u3", "m2"),
}
ORACLE_1 = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
hosts AS (
  SELECT DISTINCT host, split_part(host, '.', -1) AS suffix,
         CASE WHEN length(host) - length(replace(host, '.', '')) > 1
              THEN split_part(host, '.', -2) || '.' || split_part(host, '.', -1) ELSE host END AS domain FROM parts),
judged AS (
  SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels
  WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
l3 AS (SELECT suffix, domain, host, count(*) AS n3, sum(good) AS g3 FROM parts JOIN judged USING (page_id) JOIN hosts USING (host) GROUP BY ALL),
l2 AS (SELECT suffix, domain, sum(n3) AS n2, sum(g3) AS g2 FROM l3 GROUP BY ALL),
l1 AS (SELECT suffix, sum(n3) AS n1, sum(g3) AS g1 FROM l3 GROUP BY ALL),
l0 AS (SELECT coalesce(sum(n3), 0) AS n0, coalesce(sum(g3), 0) AS g0 FROM l3),
u1 AS (SELECT n1 AS n, g1 AS g, {top} FROM l1, l0),
s1 AS ({strength_1}),
u2 AS (SELECT *, {post_1} FROM (
  SELECT n2 AS n, g2 AS g, n0, g0, s, {top}, n1, g1 FROM l2 JOIN l1 USING (suffix), l0, s1)),
s2 AS ({strength_2}),
u3 AS (SELECT *, {post_2} FROM (SELECT *, {post_1} FROM (
  SELECT n3 AS n, g3 AS g, n0, g0, s1.s AS s, s2.s AS t, {top}, n1, g1, n2, g2
  FROM l3 JOIN l1 USING (suffix) JOIN l2 USING (suffix, domain), l0, s1, s2))),
s3 AS ({strength_3}),
low AS (SELECT host, low FROM (SELECT host, m3 - 1.645 * sqrt(v3) AS low FROM (SELECT *, {post_3} FROM (SELECT *, {post_2} FROM (SELECT *, {post_1} FROM (
  SELECT host, coalesce(n3, 0) AS n, coalesce(g3, 0) AS g, n0, g0, s1.s AS s, s2.s AS t, s3.s AS r, {top},
         coalesce(n1, 0) AS n1, coalesce(g1, 0) AS g1, coalesce(n2, 0) AS n2, coalesce(g2, 0) AS g2
  FROM hosts LEFT JOIN l3 USING (suffix, domain, host) LEFT JOIN l1 USING (suffix) LEFT JOIN l2 USING (suffix, domain), l0, s1, s2, s3
  WHERE n0 > 0)))))),
rules(action, rule, h, b) AS (VALUES ('block', 'net/', 'net', '/'),
  ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'),
  ('allow', 'org/fr/', 'org', '/fr/')),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, b) GROUP BY 1)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN coalesce(low, 1.0) >= 0.6 THEN 'allow' ELSE 'block' END) AS verdict
FROM parts LEFT JOIN fits USING (page_id) LEFT JOIN low USING (host)
"""
for _name, _sql in SQL_PARTS.items():
    ORACLE_1 = ORACLE_1.replace(_name, _sql)


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip_digests(_table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


def held_out(doc_id: str = "doc_id") -> Column:
    """The third of the ids whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document scored."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    lexicon = toxicity.learn(docs, labels.where(~held_out()))
    scores = toxicity.score(docs, lexicon, threshold=0.7)
    return scores.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents cut into sequences of 4096 tokens, id 2 after each."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(_table(spark, folder, "documents"), path, size=4096, end_id=2)


def op5_token_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as rows of 4096 tokens, best fit decreasing, id 2 after each."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return matrices.pack_matrices(_table(spark, folder, "documents"), path, size=4096, end_id=2)


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document judged; trusted documents are those labelled with quality 1."""
    docs = _table(spark, folder, "documents")
    return quality.fit_and_judge(docs, _table(spark, folder, "labels")).drop("mean_ratio")


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The article of every page, by a model fitted on pages of the same table."""
    pages = _table(spark, folder, "pages")
    return html_extract.extract(pages, html_extract.learn(pages))


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents linked at a similarity of 0.85 of three-word shingles."""
    return near_dup.near_duplicates(_table(spark, folder, "documents"), shingle=3, percent=85, width=3)


def op9_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without passages of 50 bytes that an earlier one has."""
    rows = suffix_dedup.remove_repeats(_table(spark, folder, "documents"), match=50)
    return rows.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal texts; the largest id stays."""
    return exact_dedup.exact_groups(_table(spark, folder, "documents"), keep="largest")


ORACLE_10 = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""



def op11_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest other vectors of every vector whose id is divisible by 100."""
    return neighbours.nearest(_table(spark, folder, "embeddings"), F.col("id") % 100 == 0, k=10)


def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document stored as frames, rearranged, and rebuilt from what came out."""
    store = fill_middle.frame_store(_table(spark, folder, "documents"))
    return fill_middle.digests(store, seed=42, rate=50, spm_rate=80)


ORACLE_12 = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(body, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         len(u) AS n, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS r1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS r2,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS r3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS r4
  FROM units),
cut AS (
  SELECT doc_id, body, n,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR r3 >= 50
              THEN 'plain' WHEN r4 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(r1, r2)], '') AS p,
         array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') AS m,
         array_to_string(u[greatest(r1, r2) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM cut
"""


def op13_merkle_proofs(spark: SparkSession, folder: str) -> DataFrame:
    """The proof of every document, a third of them checked with their text in lower case."""
    docs = _table(spark, folder, "documents")
    return merkle.manifest(docs, F.crc32(docs["doc_id"].cast("string")) % 3 == 0)


def _merkle_sql(levels: int) -> str:
    """Trees of at most 8^levels leaves a language; one part of the query for each level.

    DuckDB has no CRC-32; the table of its 256 words and the digits' steps are computed here.
    """
    framed = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    body = lambda text: "sha256(" + " || ".join(framed.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        words.append(value)
    table = "[" + ", ".join(map(str, words)) + "]::BIGINT[]"
    # The first element of the list is what the reduction starts with.
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, "
        "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
        "lambda a, c: xor(a >> 8, words[1 + (xor(a, c) & 255)])))"
    )
    parts = [
        f"crc AS (SELECT {table} AS words)",
        f"""leaf AS (SELECT doc_id, {body('text')} AS digest, CASE WHEN {crc} % 3 = 0 THEN {body(lower)} END AS other,
            dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM documents, crc)""",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaf)",
    ]
    up = """{1} AS (SELECT g, CASE WHEN n > 1 THEN i // 8 ELSE i END AS i, (any_value(n) + 7) // 8 AS n, any_value(n) > 1 AS real,
            list(digest ORDER BY i) AS kids, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY i)) ELSE any_value(digest) END AS digest
            FROM {0} GROUP BY g, CASE WHEN n > 1 THEN i // 8 ELSE i END)"""
    parts += [up.format(f"a{k}", f"a{k + 1}") for k in range(levels)]
    parts += [
        f"sub AS (SELECT g, digest AS subroot FROM a{levels})",
        "b0 AS (SELECT 0 AS g, g AS i, subroot AS digest, count(*) OVER () AS n FROM sub)",
        *[up.format(f"b{k}", f"b{k + 1}") for k in range(levels)],
        "p0 AS (SELECT doc_id, digest AS leaf, g, i, coalesce(other, digest) AS node, '' AS path FROM a0)",
    ]
    climb = """{1} AS (SELECT doc_id, leaf, p.g, r.i, CASE WHEN real THEN
            sha256(array_to_string(kids[1:p.i % 8], '') || node || array_to_string(kids[p.i % 8 + 2:], '')) ELSE node END AS node,
            CASE WHEN real THEN path || array_to_string(kids[1:p.i % 8], '') || array_to_string(kids[p.i % 8 + 2:], '') ELSE path END AS path{3}
            FROM {0} p JOIN {2} r ON r.g = p.g AND r.i = CASE WHEN real THEN p.i // 8 ELSE p.i END)"""
    parts += [climb.format(f"p{k}", f"p{k + 1}", f"a{k + 1}", "") for k in range(levels)]
    parts.append(f"q0 AS (SELECT doc_id, leaf, 0 AS g, p.g AS i, node, path, subroot FROM p{levels} p JOIN sub USING (g))")
    parts += [climb.format(f"q{k}", f"q{k + 1}", f"b{k + 1}", ", subroot") for k in range(levels)]
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, digest AS root, sha256(path) AS proof_sha256, node AS folded_root, node = digest AS verified
FROM q{levels} JOIN (SELECT digest FROM b{levels}) ON true
"""
    )


ORACLE_13 = _merkle_sql(8)

QUERIES: dict[str, Query] = {
    "pipeline": corpus_pipeline.run,
    "op1_url_reputation": op1_url_reputation,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_token_matrices": op5_token_matrices,
    "op6_quality": op6_quality,
    "op7_main_text": op7_main_text,
    "op8_near_dedup": op8_near_dedup,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_nearest_vectors": op11_nearest_vectors,
    "op12_fill_middle": op12_fill_middle,
    "op13_merkle_proofs": op13_merkle_proofs,
}

ORACLES: dict[str, str] = {
    "op1_url_reputation": ORACLE_1,
    "op10_exact_dedup": ORACLE_10,
    "op12_fill_middle": ORACLE_12,
    "op13_merkle_proofs": ORACLE_13,
}
