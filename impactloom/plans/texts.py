"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..functions.vector import cosine, text_vector
from ..registry import query
from .joins import over
from .views import oracle, view

_TOKENS = "list_distinct(list_filter(string_split(lower(regexp_replace(regexp_replace({}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 2))"
_SAID = "SELECT item_id, concat('cancelOrder ', text) AS text FROM benchmark"


@query("fn_tokens", oracle(f"SELECT item_id, list_sort(list_distinct(list_concat({_TOKENS.format('text')}, ['cancel', 'cancellation', 'cancelled', 'order', 'ordering']))) AS tokens FROM s", ("s", _SAID)))
def fn_tokens(spark, sf):
    return over(spark, sf, _SAID, "benchmark").select("item_id", F.sort_array(x.tokens(F.col("text"), x.SYNONYMS)).alias("tokens"))


_SYMBOLIC = "SELECT item_id, concat('see OrderService, cancel_order, OrderService and ', split_part(text, ' ', 2), '_x') AS text FROM benchmark"


@query("fn_symbols", oracle("SELECT item_id, list_sort(list_distinct(regexp_extract_all(text, '\\b([a-zA-Z][a-z]+(?:[A-Z][a-z]+)+|[a-z]+(?:_[a-z]+)+)\\b', 1))) AS symbols FROM s", ("s", _SYMBOLIC)))
def fn_symbols(spark, sf):
    return over(spark, sf, _SYMBOLIC, "benchmark").select("item_id", F.sort_array(x.symbols(F.col("text"))).alias("symbols"))


@query("fn_normal", oracle("SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[_-]', ' ', 'g'), '[^a-z0-9_ \\t\\n\\r]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS normal FROM benchmark"))
def fn_normal(spark, sf):
    return view(spark, sf, "benchmark").select("item_id", x.normal_text(F.col("text")).alias("normal"))


_BLANKS = "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN concat('  ', chr(10), chr(9)) ELSE concat(chr(10), ' ', chr(10), text, '  ', chr(13), chr(10), 'x ', chr(10)) END AS text FROM documents"


@query("fn_contenthash", oracle("SELECT doc_id, CASE WHEN b <> '' THEN sha256(b) END AS content_hash FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g') || chr(10), '[ \\t]+\\n', chr(10), 'g'), '^\\n+', ''), '\\n+$', '') AS b FROM t) y", ("t", _BLANKS)))
def fn_contenthash(spark, sf):
    return over(spark, sf, _BLANKS, "documents").select("doc_id", x.content_hash(F.col("text")).alias("content_hash"))


_PATHS = "SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('src/./a/../b', page_id) WHEN 1 THEN '../x' WHEN 2 THEN '/abs' WHEN 3 THEN concat('a//b/', page_id, '/') ELSE 'a/b/../../c' END AS path FROM pages"


@query("fn_path", oracle("SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('src/b', page_id) WHEN 3 THEN concat('a/b/', page_id) WHEN 4 THEN 'c' END AS path FROM p", ("p", _PATHS)))
def fn_path(spark, sf):
    return over(spark, sf, _PATHS, "pages").select("page_id", x.canonical_path(F.col("path")).alias("path"))


@query("fn_identity", oracle("SELECT artifact_id, concat('class:', replace(file_path, '/', '%2F'), '#', artifact_id, '%20(x)~!') AS identity FROM v_artifact"))
def fn_identity(spark, sf):
    return view(spark, sf, "v_artifact").select("artifact_id", x.artifact_identity(F.lit("class"), F.col("file_path"), F.concat("artifact_id", F.lit(" (x)~!"))).alias("identity"))


_SECRETS = "SELECT doc_id, concat('api_key = \"', doc_id, '\" ok ', doc_id) AS text FROM documents"


@query("fn_redact", oracle("SELECT doc_id, concat('api_key=[REDACTED] ok ', doc_id) AS text FROM s", ("s", _SECRETS)))
def fn_redact(spark, sf):
    return over(spark, sf, _SECRETS, "documents").select("doc_id", x.redacted(F.col("text")).alias("text"))


_STEPS = "SELECT conv_id, turn, concat('Given: a user ', conv_id, chr(10), 'when it runs', chr(10), 'THEN: ', turn) AS text FROM conversations"


@query("fn_gherkin", oracle("SELECT conv_id, turn, concat('a user ', conv_id) AS given, 'it runs' AS \"when\", turn::VARCHAR AS \"then\" FROM s", ("s", _STEPS)))
def fn_gherkin(spark, sf):
    return over(spark, sf, _STEPS, "conversations").select("conv_id", "turn", x.gherkin(F.col("text")).alias("g")).select("conv_id", "turn", "g.*")


@query("fn_segment", oracle("SELECT page_id, regexp_replace(string_split(concat(url, '.git'), '/')[-1], '\\.git$', '') AS name FROM pages"))
def fn_segment(spark, sf):
    return view(spark, sf, "pages").select("page_id", x.last_segment(F.concat("url", F.lit(".git"))).alias("name"))


@query("fn_tokencount", oracle("SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens FROM documents"))
def fn_tokencount(spark, sf):
    return view(spark, sf, "documents").select("doc_id", x.token_estimate(F.col("text")).alias("tokens"))


@query("fn_cosine", oracle("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"))
def fn_cosine(spark, sf):
    e = view(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("fn_textvector", oracle("SELECT item_id, round(v[2] / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) AS second, 64 AS n FROM (SELECT item_id, list_transform(range(1, 65), lambda i: CASE WHEN i <= length(text) THEN unicode(text[i]) / 1000 ELSE 0 END) AS v FROM benchmark) y"))
def fn_textvector(spark, sf):
    v = view(spark, sf, "benchmark").select("item_id", text_vector(F.col("text"), 64).alias("v"))
    return v.select("item_id", F.round(F.get("v", F.lit(1)), 6).alias("second"), F.size("v").alias("n"))


@query("fn_histogram", oracle("SELECT source, list_sort(list(concat(lang, '=', n))) AS langs FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) y GROUP BY source"))
def fn_histogram(spark, sf):
    """A map of counts, told as sorted entries."""
    counts = view(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m"))
    return maps.select("source", F.sort_array(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))).alias("langs"))


@query("fn_json", oracle("SELECT event_id, (props ->> '$.k')::INT AS k, props ->> '$.none' AS none FROM events"))
def fn_json(spark, sf):
    return view(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.none").alias("none"))


_LISTED = """SELECT event_id, concat('[{"code":"SCAN_NOTE","n":', user_id, '}', CASE WHEN event_id % 3 > 0 THEN concat(',{"code":"REUSE_PLAN","n":', event_id % 50, '}') ELSE '' END, CASE WHEN event_id % 5 = 0 THEN ',{"code":"REUSE_PLAN","n":-1}' ELSE '' END, CASE WHEN event_id % 11 = 0 THEN '' ELSE ']' END) AS diagnostics FROM events"""


@query("fn_json_find", oracle("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 > 0 THEN event_id % 50 WHEN event_id % 5 = 0 THEN -1 END::INT AS n FROM d", ("d", _LISTED)))
def fn_json_find(spark, sf):
    """The first diagnostic of a code in a JSON array; null if there is none or the text is no JSON."""
    known = F.from_json("diagnostics", "array<struct<code:string,n:int>>")
    first = F.get(F.filter(known, lambda x: x["code"] == "REUSE_PLAN"), F.lit(0))
    return over(spark, sf, _LISTED.replace("{", "{{").replace("}", "}}"), "events").select("event_id", first["n"].alias("n"))
