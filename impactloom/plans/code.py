"""Source scanners over nested spans, on files written around the driver's texts.

Every document is a TypeScript file and every page a spec: its whole text stands in a comment, and how many classes, methods,
parameters, suites and cases follow depends on the row.  The SQL states what a reader finds in such a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import spans, specs
from ..registry import query
from .views import oracle, view

_BREAKS = "(length(t) - length(replace(t, chr(10), '')))"
_TEXT = "replace(replace(coalesce({}, ''), '*/', '* /'), '/*', '/ *')"
_DOCS = f"SELECT doc_id, {_TEXT.format('text')} AS t, doc_id % 4 AS k, CASE doc_id % 3 WHEN 0 THEN 'Controller' WHEN 1 THEN 'Injectable' ELSE 'Module' END AS deco, concat('src/d', CAST(doc_id AS VARCHAR(20)), CASE WHEN doc_id % 5 = 0 THEN '.entity.ts' ELSE '.ts' END) AS path FROM documents"

_METHOD = r"""
  @Get("m{j}/:id")
  @Roles('admin', "x)")
  async m{j}(@Param('id') id: string{more}): Promise<{ ok: boolean }> {
    // if (never) {}
    if (id === "if (x) {" && /[)/]\)/.test(id)) { throw new E{j}(`no ${id} ${`}`}`) }
    switch (id) { case '{j}': return { ok: true }; default: break; }
    try { await this.x.find(id) } catch (e) { return { ok: false } }
  }
  private h{j}() { if (1) {} }
"""
_METHOD_LINES = 10
_HEAD = r"""import { Controller } from '@nestjs/common'
const fake = "@Controller() class Fake { no() {} }"
@{deco}({ path: "p", at: '{' })
@UseGuards(Guard)
export class C{id}<T extends { a: string }> {
  private cache = new Map<string, { a: number }>()
  constructor(private readonly x: X = { y: 1 }) { super() }
"""


def typescript(spark, sf) -> DataFrame:
    """(path, content): a file for every document."""
    d = view(spark, sf, "documents").selectExpr("doc_id", f"{_TEXT.format('text')} AS t").where("doc_id IS NOT NULL")
    known = d.selectExpr("*", "CAST(doc_id % 4 AS INT) AS k", "CASE doc_id % 3 WHEN 0 THEN 'Controller' WHEN 1 THEN 'Injectable' ELSE 'Module' END AS deco", "concat('src/d', doc_id, CASE WHEN doc_id % 5 = 0 THEN '.entity.ts' ELSE '.ts' END) AS path")
    head = F.replace(F.replace(F.lit(_HEAD), F.lit("{deco}"), F.col("deco")), F.lit("{id}"), F.col("doc_id").cast("string"))

    def method(j):
        more = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda x: x < j), lambda x: F.concat(F.lit(", a"), x.cast("string"), F.lit("?: Map<string, { n: number }>"))), "")
        return F.replace(F.replace(F.lit(_METHOD), F.lit("{j}"), j.cast("string")), F.lit("{more}"), more)

    body = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda j: j < F.col("k")), method), "")
    return known.select("path", F.concat(F.lit("/* "), "t", F.lit(" */\n"), head, body, F.lit("}\n")).alias("content"))


_LINE = f"{_BREAKS} + 2"
_FOUND = f"""SELECT path, CASE deco WHEN 'Controller' THEN 'API_ROUTE' ELSE 'SERVICE_METHOD' END AS type, concat('C', doc_id, '.m', j) AS symbol,
 ({_LINE} + 7 + j * {_METHOD_LINES} + 1)::BIGINT AS start_line, ({_LINE} + 7 + j * {_METHOD_LINES} + 8)::BIGINT AS end_line, (j + 1)::INT AS n_params, 'Promise<{{ ok: boolean }}>' AS return_type,
 CASE deco WHEN 'Controller' THEN 'GET' END AS verb, CASE deco WHEN 'Controller' THEN concat('m', j, '/:id') END AS route, 3 AS n_conditions, 2 AS n_handlers
FROM d, generate_series(0, 2) g(j) WHERE doc_id % 5 <> 0 AND deco <> 'Module' AND j < k
UNION ALL SELECT path, 'SERVICE_METHOD', concat('C', doc_id, '.h', j), ({_LINE} + 7 + j * {_METHOD_LINES} + 9)::BIGINT, ({_LINE} + 7 + j * {_METHOD_LINES} + 9)::BIGINT, 0, NULL, NULL, NULL, 1, 0
FROM d, generate_series(0, 2) g(j) WHERE doc_id % 5 <> 0 AND deco = 'Injectable' AND j < k
UNION ALL SELECT path, 'ENTITY', concat('C', doc_id), ({_LINE} + 2)::BIGINT, ({_LINE} + 7 + k * {_METHOD_LINES})::BIGINT, NULL, NULL, NULL, NULL, NULL, NULL FROM d WHERE doc_id % 5 = 0"""


@query("src_ts_artifacts", oracle(_FOUND, ("d", f"{_DOCS} WHERE doc_id IS NOT NULL")))
def src_ts_artifacts(spark, sf):
    """Entities, routes and service methods with their lines, parameters, conditions and handlers."""
    found = spans.artifacts(typescript(spark, sf))
    return found.select("path", "type", "symbol", "start_line", "end_line", *[F.size(c).alias(n) for c, n in (("parameters", "n_params"), ("conditions", "n_conditions"), ("handlers", "n_handlers"))], "return_type", "verb", "route").withColumns({n: F.when(F.col("type") != "ENTITY", F.col(n)) for n in ("n_params", "n_conditions", "n_handlers")})


_PARTS = """SELECT path, concat('C', doc_id, '.m', j) AS symbol, kind, text FROM d, generate_series(0, 2) g(j),
 (VALUES ('IF', 'id === "if (x) {" && /[)/]\\)/.test(id)'), ('SWITCH_CASE', 'case ''{j}'': return { ok: true };'), ('SWITCH_DEFAULT', 'default: break;'), ('THROW', 'throw new E{j}(`no ${id} ${`}`}`)'), ('CATCH', 'catch (e) { return { ok: false } }'), ('PARAMETER', '@Param(''id'') id: string'), ('RETURNS', 'Promise<{ ok: boolean }>')) v(kind, raw), LATERAL (SELECT replace(raw, '{j}', j::VARCHAR) AS text) x WHERE doc_id % 5 <> 0 AND deco = 'Controller' AND j < k
UNION ALL SELECT path, concat('C', doc_id, '.m', j), 'PARAMETER', concat('a', x, '?: Map<string, { n: number }>') FROM d, generate_series(0, 2) g(j), generate_series(0, 2) h(x) WHERE doc_id % 5 <> 0 AND deco = 'Controller' AND j < k AND x < j"""


@query("src_ts_evidence", oracle(_PARTS, ("d", f"{_DOCS} WHERE doc_id IS NOT NULL")))
def src_ts_evidence(spark, sf):
    """The texts of routes' parameters, returned types, conditions and exception handlers."""
    found = spans.artifacts(typescript(spark, sf)).where("type = 'API_ROUTE'")
    p = F.transform("parameters", lambda x: F.struct(F.lit("PARAMETER").alias("kind"), x["source_text"].alias("text")))
    b = F.transform(F.concat("conditions", "handlers"), lambda x: F.struct(x["kind"].alias("kind"), x["source_text"].alias("text")))
    r = F.array(F.struct(F.lit("RETURNS").alias("kind"), F.col("return_type").alias("text")))
    return found.select("path", "symbol", F.explode(F.concat(p, b, r)).alias("x")).select("path", "symbol", "x.kind", "x.text")


_SPEC = r"""import { S } from './s'
describe("suite {s}", () => {
  const s = new S({})
  beforeEach(() => { db.clear(); const seed = { at: 1 } })
  describe{skip}('inner (', function () {
    it(`says {url}`, async () => {
      const n = { of: "it('no', () => {})" }
      const r = await s.run(n);
      expect(r.total).toEqual({ n: ")" })
      [1].forEach(x => { s.lost(x) })
    })
{more}  })
  if (slow) { it('unread', () => {}) }
})
"""
_SPEC_CASE = r"""    test.only("k{j}", () => { expect(() => s.fail({j})).toThrow("no ) {j}"); expect(log).toHaveBeenCalledTimes({j}) })
"""
_PAGES = f"SELECT page_id, {_TEXT.format('html')} AS t, page_id % 3 AS k, coalesce(url, '') AS url, concat('test/p', CAST(page_id AS VARCHAR(20)), '.spec.ts') AS path, page_id % 5 = 0 AS skipped, concat('suite ', CAST(page_id % 7 AS VARCHAR(20))) AS suite FROM pages WHERE page_id IS NOT NULL"


def jest(spark, sf) -> DataFrame:
    """(path, content): a spec for every page."""
    p = view(spark, sf, "pages").where("page_id IS NOT NULL").selectExpr("page_id", f"{_TEXT.format('html')} AS t", "CAST(page_id % 3 AS INT) AS k", "coalesce(url, '') AS url", "concat('test/p', page_id, '.spec.ts') AS path")
    more = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda j: j < F.col("k")), lambda j: F.replace(F.lit(_SPEC_CASE), F.lit("{j}"), j.cast("string"))), "")
    content = F.replace(F.replace(F.lit(_SPEC), F.lit("{s}"), (F.col("page_id") % 7).cast("string")), F.lit("{skip}"), F.when(F.col("page_id") % 5 == 0, ".skip").otherwise(""))
    content = F.replace(F.replace(content, F.lit("{url}"), F.col("url")), F.lit("{more}"), more)
    return p.select("path", F.concat(F.lit("/* "), "t", F.lit(" */\n"), content).alias("content"))


_CASES = f"""SELECT path, concat(suite, ' > inner (') AS suites, concat('says ', url) AS title, CASE WHEN skipped THEN 'SKIP' ELSE 'NORMAL' END AS modifier, 'NORMAL' AS declared, ({_BREAKS} + 7)::BIGINT AS start_line FROM p
UNION ALL SELECT path, concat(suite, ' > inner ('), concat('k', j), CASE WHEN skipped THEN 'SKIP' ELSE 'ONLY' END, 'ONLY', ({_BREAKS} + 13 + j)::BIGINT FROM p, generate_series(0, 1) g(j) WHERE j < k"""


@query("src_jest_cases", oracle(_CASES, ("p", _PAGES)))
def src_jest_cases(spark, sf):
    """Test cases with the path of their suites and the modifiers that they take from them."""
    found, _ = specs.cases(spans.tokens(jest(spark, sf)))
    return found.select("path", F.array_join("suites", " > ").alias("suites"), "title", "modifier", "declared", "start_line")


_STATED = [
    ("SETUP_HOOK", None, "beforeEach(() => { db.clear(); const seed = { at: 1 } })", None),
    ("INPUT", None, "seed = { at: 1 }", None),
]
_OWN = [
    ("INPUT", None, 'n = { of: "it(\'no\', () => {})" }', None),
    ("ACTION", None, "s.run(n)", None),
    ("ASSERTION", "STATE", 'expect(r.total).toEqual({ n: ")" })', "r.total"),
    ("EXPECTED_OUTCOME", "STATE", '{ n: ")" }', None),
]
_THROWN = [
    ("ASSERTION", "EXCEPTION", 'expect(() => s.fail({j})).toThrow("no ) {j}")', "() => s.fail({j})"),
    ("ACTION", None, "s.fail({j})", None),
    ("EXPECTED_OUTCOME", "EXCEPTION", '"no ) {j}"', None),
    ("ASSERTION", "CALL_COUNT", "expect(log).toHaveBeenCalledTimes({j})", "log"),
    ("EXPECTED_OUTCOME", "CALL_COUNT", "{j}", None),
]


def _rows(claims: list[tuple]) -> str:
    quoted = ["(" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in c) + ")" for c in claims]
    return f"(VALUES {', '.join(quoted)}) v(kind, assertion_kind, source_text, subject)"


_CLAIMS = f"""SELECT path, concat('says ', url) AS title, kind, assertion_kind, source_text, subject FROM p, {_rows(_STATED + _OWN)} WHERE NOT skipped
UNION ALL SELECT path, concat('k', j), kind, assertion_kind, replace(source_text, '{{j}}', j::VARCHAR), replace(subject, '{{j}}', j::VARCHAR) FROM p, generate_series(0, 1) g(j), {_rows(_STATED + _THROWN)} WHERE NOT skipped AND j < k"""


@query("src_jest_claims", oracle(_CLAIMS, ("p", _PAGES)))
def src_jest_claims(spark, sf):
    """What cases state: set-up, inputs, actions, assertions and outcomes, also inside callbacks that are to throw."""
    found, _ = specs.claims(jest(spark, sf))
    return found.select("path", "title", "kind", "assertion_kind", "source_text", "subject")


_UNREAD = """SELECT path, 'JEST_UNSUPPORTED_DECLARATION' AS code, 1 AS n FROM p
UNION ALL SELECT path, 'ASSERTION_INVOCATION_UNRESOLVED', 2 * k FROM p WHERE NOT skipped AND k > 0
UNION ALL SELECT path, 'NESTED_CALLBACK_NOT_ANALYZED', 1 FROM p WHERE NOT skipped"""


@query("src_jest_gaps", oracle(_UNREAD, ("p", _PAGES)))
def src_jest_gaps(spark, sf):
    """What could not be read, counted for each file and reason."""
    return specs.claims(jest(spark, sf))[1].groupBy("path", "code").agg(F.sum("n").alias("n"))
