"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, fingerprints, licenses, lm_score, merkle, near_dup, oracles, packing, pii, quality, resample, url_filter, warc
from .common import cut, remove, shared_path, table
from .text import LOWER, UPPER

#: The tokenizer's file for packing; a path of another file can be set in the session.
TOKENIZER_CONF, TOKENIZER = "impactloom.tokenizer", "word_bpe_49k.json"


def tokenizer_path(spark: SparkSession) -> str:
    known = spark.conf.get(TOKENIZER_CONF, None)
    if known:
        return known
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    each = F.filter(F.split("spans", ","), lambda x: x != "")
    secrets = F.size(F.filter(each, lambda x: F.startswith(x, F.lit("secret:")))).cast("long").alias("n_secret")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", F.size(each).cast("long").alias("n_spans"), secrets)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return lm_score.score(table(spark, sf_dir, "documents"), good)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    found = cut(warc.digest_of(warc.read_archive(spark, path)))
    remove(spark, path)
    return found


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(spark))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents"), keep="largest")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = merkle.leaf_of([F.translate("text", UPPER, LOWER) if f == "text" else F.col(f) for f in fields])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, changed)
    found = merkle.manifest(docs, fields, carry={"tampered": tampered})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root")
    told = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), folded)
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least=20, seed=7)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_near_duplicates,
        op2_license_scan,
        op3_url_filter,
        op4_pii,
        op5_quality,
        op6_decontaminate,
        op7_lm_score,
        op8_warc,
        op9_packing,
        op10_exact_dedup,
        op11_merkle,
        op12_resample,
        op13_fingerprints,
    )
    return {f.__name__: f for f in named}


_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _shingled(source: str, key: str, k: int) -> str:
    """(key, g): the distinct shingles of a table's texts, as word lists."""
    return f"""
SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i : i + {k} - 1], ' '))
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
FROM (SELECT {key}, {_WORDS.format(_NORM)} AS w FROM {source})"""


_OP1 = f"""
WITH RECURSIVE s AS ({_shingled('documents', 'doc_id', 3)}),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
c AS (SELECT u, least(u, min(v)) AS component_id FROM r GROUP BY u)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN c ON c.u = d.doc_id"""

_OP6 = f"""
WITH d AS ({_shingled('documents', 'doc_id', 5)}), i AS ({_shingled('benchmark', 'item_id', 5)}),
n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN i USING (g) GROUP BY ALL)
SELECT doc_id, item_id, shared, item_shingles FROM m JOIN n USING (item_id) WHERE shared * 100 >= item_shingles * 80"""

_B32 = " || ".join(
    f"substr('{warc.ALPHABET}', ((('0x' || substr(h, {5 * g + 1}, 5))::INT >> {shift}) & 31) + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0)
)
_OP8 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM m"""

_OP10 = f"""
WITH n AS (SELECT doc_id, {_NORM} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_duplicates": _OP1,
        "op2_license_scan": licenses.scan_sql(),
        "op6_decontaminate": _OP6,
        "op8_warc": _OP8,
        "op10_exact_dedup": _OP10,
        "op11_merkle": oracles.merkle_sql(),
        "op12_resample": oracles.resample_sql(),
    }
