"""Queries over scans of source files.  Source text is made from rows, since the driver tables hold none."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources import extract as x
from ..sources import runs, spans, specs
from ..sources import scan as s
from .joins import over
from .views import oracle, view

_URLS = "SELECT page_id, CASE page_id % 9 WHEN 0 THEN concat('https://github.com/org/r', page_id) WHEN 1 THEN concat('https://github.com/org/r', page_id, '/') WHEN 2 THEN 'git@github.com:o/r.git' WHEN 3 THEN 'https://u:p@github.com/o/r' WHEN 4 THEN 'https://github.com/o/r?x=1' WHEN 5 THEN 'https://github.com/o' WHEN 6 THEN 'https://github.com/o/r!' WHEN 7 THEN '' ELSE url END AS url FROM pages"


@query(
    "src_url",
    oracle(
        """SELECT page_id, CASE WHEN url = '' THEN 'EMPTY' WHEN url NOT LIKE 'https://%' THEN 'PROTOCOL' WHEN contains(h, '@') THEN 'CREDENTIALS' WHEN lower(h) <> 'github.com' THEN 'HOST' WHEN contains(r, '?') OR contains(r, '#') THEN 'QUERY' WHEN len(p) <> 2 THEN 'PATH'
 WHEN len(list_filter(p, lambda y: NOT regexp_matches(y, '^[A-Za-z0-9_.-]+$'))) > 0 THEN 'CHARACTERS' END AS error FROM (SELECT *, regexp_extract(r, '^[^/?#]*') AS h, list_filter(string_split(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '/'), lambda y: y <> '') AS p FROM (SELECT *, regexp_replace(url, '^https://', '') AS r FROM u) a) b""",
        ("u", _URLS),
    ),
)
def src_url(spark, sf):
    return over(spark, sf, _URLS, "pages").select("page_id", s.public_url_error(F.col("url")).alias("error"))


_FILES = """SELECT doc_id, source AS repository, concat(CASE doc_id % 13 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'src/booking/' WHEN 2 THEN 'src/payment/' WHEN 3 THEN 'controllers/' WHEN 4 THEN 'services/' WHEN 5 THEN 'src/shared/' WHEN 6 THEN 'a/dist/' ELSE 'lib/' END,
 CASE doc_id % 17 WHEN 0 THEN 'go.mod' WHEN 1 THEN 'reservation.ts' WHEN 2 THEN 'wallet.ts' WHEN 3 THEN 'x.png' WHEN 4 THEN 'a.generated.ts' WHEN 5 THEN 'yarn.lock' WHEN 6 THEN 'package-lock.json' WHEN 7 THEN 'pnpm-lock.yaml' WHEN 8 THEN 'b.gen.ts' ELSE concat('f', doc_id, '.ts') END) AS path, n_chars * 40 AS size, doc_id % 19 = 0 AS binary FROM documents"""
_IGNORED = ", ".join(f"'{d}'" for d in s.IGNORED_FOLDERS)
_ENDS = " OR ".join(f"path LIKE '%{e}'" for e in s.IGNORED_ENDINGS)
_REASONS = f"""SELECT doc_id, repository, path, size, coalesce(r, CASE WHEN count(*) FILTER (r IS NULL) OVER w > 20 OR sum(size) FILTER (r IS NULL) OVER w > 2000000 THEN 'REPO_LIMIT_EXCEEDED' END) AS reason FROM
(SELECT *, CASE WHEN len(list_intersect(string_split(path, '/')[:-2], [{_IGNORED}])) > 0 THEN 'IGNORED_DIRECTORY' WHEN {_ENDS} THEN 'UNSUPPORTED_EXTENSION' WHEN string_split(path, '/')[-1] IN ('package-lock.json', 'yarn.lock', 'pnpm-lock.yaml') THEN 'VENDOR_FILE' WHEN contains(path, '.generated.') OR contains(path, '.gen.') THEN 'GENERATED_FILE' WHEN size > 1048576 THEN 'FILE_TOO_LARGE' WHEN "binary" THEN 'BINARY_FILE' END AS r FROM f) y WINDOW w AS (PARTITION BY repository ORDER BY path, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def files(spark, sf):
    return over(spark, sf, _FILES, "documents")


def _enumerated(spark, sf):
    f = files(spark, sf)
    rows = f.withColumn("reason", s.skip_reason(F.col("path"), F.col("size"), F.col("binary")))
    fine = s.within_limits(rows.where("reason is null"), ["repository"], ["path", "doc_id"], "size", 20, 2_000_000)
    return rows.where("reason is not null").unionByName(fine.withColumn("reason", F.when(~F.col("kept"), "REPO_LIMIT_EXCEEDED")).drop("kept"))


_F = ("f", _FILES.replace(" AS binary ", ' AS "binary" '))


@query("src_enum", oracle("SELECT doc_id, reason FROM e", _F, ("e", _REASONS)))
def src_enum(spark, sf):
    return _enumerated(spark, sf).select("doc_id", "reason")


_COUNTED = _REASONS.replace("coalesce(r, CASE", "r AS own, coalesce(r, CASE").replace(
    "AS reason FROM", "AS reason, count(*) FILTER (r IS NULL) OVER w AS n, coalesce(sum(size) FILTER (r IS NULL) OVER w, 0) AS b, count(*) FILTER (r IS NULL AND regexp_matches(lower(path), '[.]tsx?$')) OVER w AS t FROM"
)
_STOPS = "SELECT *, CASE WHEN own IS NULL THEN CASE WHEN n > 40 THEN 'FILE_LIMIT_EXCEEDED' WHEN b > 2500000 THEN 'REPO_SIZE_LIMIT_EXCEEDED' WHEN t > 18 THEN 'TS_FILE_LIMIT_EXCEEDED' END END AS stop FROM e"


@query(
    "src_enum_limits",
    oracle(
        """SELECT repository, count(stop) = 0 AS complete, arg_min(stop, (path, doc_id)) FILTER (stop IS NOT NULL) AS stopped_by, arg_min(path, (path, doc_id)) FILTER (stop IS NOT NULL) AS path,
 coalesce(max(n) FILTER (ok), 0) AS n_read, coalesce(max(b) FILTER (ok), 0)::BIGINT AS bytes_read, coalesce(max(t) FILTER (ok), 0) AS typescript_read FROM (SELECT *, own IS NULL AND stop IS NULL AS ok FROM x) y GROUP BY repository""",
        _F,
        ("e", _COUNTED),
        ("x", _STOPS),
    ),
)
def src_enum_limits(spark, sf):
    """Where the enumeration of each repository stops, by three limits counted in one pass."""
    return s.stops(s.enumerated(files(spark, sf), 40, 2_500_000, 18, ("path", "doc_id")), ("path", "doc_id"))


@query("agg_skip", oracle("SELECT repository, reason, count(*) AS n, list_sort(list_distinct(list(path)))[1:100] AS samples FROM e WHERE reason IS NOT NULL GROUP BY repository, reason", _F, ("e", _REASONS)))
def agg_skip(spark, sf):
    return s.skip_summary(_enumerated(spark, sf))


_BYTES = "SELECT event_id, CASE user_id % 3 WHEN 0 THEN concat('ab', chr(0 + 1), chr(2), chr(3), 'x') WHEN 1 THEN concat('plain text', chr(7)) ELSE props END AS content FROM events"


@query("src_binary", oracle("SELECT event_id, length(regexp_replace(content, '[^\\x01-\\x08\\x0B\\x0E-\\x1F]', '', 'g')) > 0.3 * octet_length(encode(content)) AS is_binary FROM b", ("b", _BYTES)))
def src_binary(spark, sf):
    return over(spark, sf, _BYTES, "events").select("event_id", s.is_binary(F.encode("content", "UTF-8")).alias("is_binary"))


@query("src_framework", oracle("SELECT repository, coalesce(list_sort(list_distinct(list(l) FILTER (l IS NOT NULL))), []) AS languages, count(DISTINCT l) = 1 AS supported FROM (SELECT repository, CASE string_split(path, '/')[-1] WHEN 'go.mod' THEN 'GO' WHEN 'package.json' THEN 'TYPESCRIPT' END AS l FROM f) y GROUP BY repository", _F))
def src_framework(spark, sf):
    return s.frameworks(files(spark, sf))


_TERMS = ", ".join(f"('{d}', '{t}')" for d, ts in s.DOMAIN_TERMS.items() for t in ts)


@query(
    "src_profile",
    oracle(
        f"""SELECT repository, CASE WHEN n >= 2 AND n > coalesce(nx, 0) THEN domain ELSE 'UNKNOWN' END AS domain, round(CASE WHEN n IS NULL THEN 0.2 WHEN n >= 2 AND n > coalesce(nx, 0) THEN least(0.9, 0.5 + n * 0.1) ELSE 0.35 END, 6)::DOUBLE AS confidence
FROM (SELECT DISTINCT repository FROM f) r LEFT JOIN (SELECT *, lead(n) OVER w AS nx, row_number() OVER w AS k FROM (SELECT repository, domain, count(DISTINCT term) AS n FROM f JOIN (VALUES {_TERMS}) t(domain, term) ON contains(lower(path), term) GROUP BY repository, domain) a WINDOW w AS (PARTITION BY repository ORDER BY n DESC, domain)) b USING (repository) WHERE k IS NULL OR k = 1""",
        _F,
    ),
)
def src_profile(spark, sf):
    d = s.domains(files(spark, sf).select("repository", "path"))
    return d.select("repository", "domain", F.round("confidence", 6).alias("confidence"))


@query("src_arch", oracle("SELECT repository, CASE WHEN count(DISTINCT string_split(lower(path), '/')[2]) FILTER (path LIKE 'src/%' AND string_split(lower(path), '/')[2] NOT IN ('common', 'shared', 'config', 'types')) >= 2 THEN 'MODULAR_MONOLITH' WHEN max((path LIKE 'controllers/%')::INT) + max((path LIKE 'services/%')::INT) >= 2 THEN 'LAYERED' ELSE 'UNKNOWN' END AS style FROM f GROUP BY repository", _F))
def src_arch(spark, sf):
    return s.architectures(files(spark, sf))


#: Per language, source texts with what a reader finds in them: routes (verb, path, handler), and what is no route, by code and
#: number.  A page gets the text of its remainder by three; @N@ is its number.  The answers are stated, not derived.
_TEXT = {
    "python": [
        ('@router.get("/items/@N@")\nasync def get_@N@(x):\n  pass\n@app.post(f"/x")\ndef other():\n  pass', [("GET", "/items/@N@", "get_@N@")], {"PY_DYNAMIC_ROUTE_UNSUPPORTED": 1}),
        ("@app.post('/orders/@N@', status_code=201)\nasync def create(order):\n  pass\n\n@app.delete(\"/orders/{id}\")\ndef drop(id):\n  pass\n", [("POST", "/orders/@N@", "create"), ("DELETE", "/orders/{id}", "drop")], {}),
        ("r = APIRouter(prefix='/v@N@')\n@r.get('/a')\ndef a(u=Depends(who)): ...\n@app.get(\"/b\" + x)\ndef b(): ...\n@app.head(\n  '/c@N@',\n)\ndef c(): ...\n@app.put(PATH)\ndef d(): ...\ndef helper(router):\n  return router.get('/x')\n", [("HEAD", "/c@N@", "c")], {"PY_ROUTER_PREFIX_UNSUPPORTED": 2, "PY_DEPENDENCY_INJECTION_BOUNDARY": 1, "PY_DYNAMIC_ROUTE_UNSUPPORTED": 2}),
    ],
    "go": [
        ('r.GET("/items/@N@", handler@N@)\nhttp.HandleFunc("/h", serve)\nr.POST(dynamic, x)', [("GET", "/items/@N@", "handler@N@"), ("UNKNOWN", "/h", "serve")], {"GO_HTTP_METHOD_NOT_EXTRACTED": 1, "GO_ROUTE_CONSTANT_RESOLUTION_UNSUPPORTED": 1}),
        ('e.DELETE( "/orders/:id", api.Remove )\nmux.HandleFunc("/health/@N@", api.health)', [("UNKNOWN", "/health/@N@", "apihealth")], {"GO_DYNAMIC_ROUTE_UNSUPPORTED": 1, "GO_HTTP_METHOD_NOT_EXTRACTED": 1}),
        ('v := r.Group("/v1")\nv.Use(log)\nv.HEAD(`/a@N@`, ping)\nv.PUT("/b", auth, put)\nv.PATCH("/c", func(c *gin.Context) {})\nfunc main() { fmt.Println("GET /x") }', [("HEAD", "/a@N@", "ping")], {"GO_ROUTE_GROUP_UNSUPPORTED": 1, "GO_MIDDLEWARE_CHAIN_UNSUPPORTED": 2, "GO_INLINE_HANDLER_UNSTABLE_IDENTITY_UNSUPPORTED": 1}),
    ],
    "java": [
        ('@GetMapping("/items/@N@")\n  public Item find@N@(Long id) {}\n@RequestMapping(value = X)\n public Item x() {}', [("GET", "/items/@N@", "find@N@")], {"SPRING_HTTP_METHOD_UNKNOWN": 1}),
        ('@PostMapping("/orders")\n  public ResponseEntity<Order> add@N@(Order o) {}\n@DeleteMapping("/orders/{id}")\n  public void drop(Long id) {}', [("POST", "/orders", "add@N@"), ("DELETE", "/orders/{id}", "drop")], {}),
        (
            '@RestController\n@RequestMapping("/api/@N@")\npublic class Orders {\n  @GetMapping(path = "/a")\n  @Cached\n  public ResponseEntity<Map<String, List<Item>>> a@N@(@PathVariable("x") String x) {}\n  @RequestMapping(value = "b", method = RequestMethod.PUT)\n  public void b() {}\n  @PatchMapping\n  public void c() {}\n  @GetMapping("/d" + X)\n  public void d() {}\n  @PostMapping({"/e", "/f"})\n  public void e() {}\n  @ApiMapping("/g")\n  public void g() {}\n}',
            [("GET", "/api/@N@/a", "a@N@"), ("PUT", "/api/@N@/b", "b"), ("PATCH", "/api/@N@", "c")],
            {"SPRING_DYNAMIC_ROUTE_UNSUPPORTED": 1, "SPRING_MULTI_ROUTE_MAPPING_UNSUPPORTED": 1, "SPRING_COMPOSED_MAPPING_UNSUPPORTED": 1},
        ),
    ],
    "csharp": [
        ('[HttpPost("items/@N@")]\npublic async Task Add@N@(int x) {}\napp.MapGet("/m", Handle);app.MapGroup("/g")', [("POST", "items/@N@", "Add@N@"), ("GET", "/m", "Handle")], {"CS_MINIMAL_API_GROUP_UNSUPPORTED": 1}),
        ('[HttpDelete("orders/{id}")]\npublic IActionResult Drop(int id) {}\napp.MapPut("/o/@N@", Put@N@);', [("DELETE", "orders/{id}", "Drop"), ("PUT", "/o/@N@", "Put@N@")], {}),
        (
            '[Route("api/[controller]")]\nclass Orders {\n[HttpGet]\n[Authorize(Roles = "x")]\npublic async Task<ActionResult<List<Item>>> All@N@([FromServices] Db db) {}\n[HttpPatch(Routes.One)]\npublic void One() {}\n}\napp.MapPost("/n@N@", (Item i) => 1);\napp.MapDelete(path, Gone);',
            [("GET", "/", "All@N@"), ("POST", "/n@N@", "anonymous")],
            {"CS_ROUTE_TOKEN_UNSUPPORTED": 1, "CS_DI_BOUNDARY": 1, "CS_DYNAMIC_ROUTE_UNSUPPORTED": 2},
        ),
    ],
    "php": [
        ("Route::get('/items/@N@', [ItemController::class, 'show@N@']);Route::resource('x')", [("GET", "/items/@N@", "ItemController@show@N@")], {"PHP_RESOURCE_ROUTE_UNSUPPORTED": 1}),
        ("Route::post( '/orders', [OrderController::class, 'store']);\nRoute::delete('/orders/@N@', [OrderController::class, 'destroy']);", [("POST", "/orders", "OrderController@store"), ("DELETE", "/orders/@N@", "OrderController@destroy")], {}),
        (
            "Route::get(\"/a@N@\", 'App\\Http\\ItemController@index');\nRoute::put('/b', function () { return 1; });\nRoute::patch('/c', Invoked::class);\nRoute::get('/d' . $x, [X::class, 'y']);\nRoute::post($path, [X::class, 'y']);\nRoute::group(['prefix' => 'z'], fn() => 1)->middleware('auth');\n$app->get('/q', 'r');\nfunction get($path) { return route($path); }",
            [("GET", "/a@N@", "ItemController@index"), ("PUT", "/b", "closure@closure")],
            {"PHP_CONTROLLER_RESOLUTION_BOUNDARY": 2, "PHP_DYNAMIC_ROUTE_UNSUPPORTED": 2, "PHP_ROUTE_GROUP_UNSUPPORTED": 1, "PHP_MIDDLEWARE_BOUNDARY": 1, "PHP_UNKNOWN_ROUTER_PATTERN": 1},
        ),
    ],
    "ruby": [
        ("get '/items/@N@', to: 'items#show@N@'\nresources :x", [("GET", "/items/@N@", "items#show@N@")], {"RB_RESOURCE_ROUTE_UNSUPPORTED": 1}),
        ("  post '/orders', to: 'orders#create'\n  delete '/orders/@N@', to: 'orders#drop'\n", [("POST", "/orders", "orders#create"), ("DELETE", "/orders/@N@", "orders#drop")], {}),
        (
            "namespace :admin do\n  get \"/a@N@\", to: \"c#d\"\n  put '/b' => 'b#e'\nend\nscope '/s' do\nend\nmount Sidekiq::Web => '/jobs'\npatch \"/x/#{y}\", to: 'x#y'\ndelete path, to: 'x#z'\nputs 'get'",
            [("GET", "/a@N@", "c#d"), ("PUT", "/b", "b#e")],
            {"RB_NAMESPACE_ROUTE_UNSUPPORTED": 1, "RB_CONTROLLER_RESOLUTION_BOUNDARY": 1, "RB_SCOPE_ROUTE_UNSUPPORTED": 1, "RB_MOUNTED_ENGINE_UNSUPPORTED": 1, "RB_DYNAMIC_ROUTE_UNSUPPORTED": 2},
        ),
    ],
    "typescript": [
        ("@Controller('items')\nexport class Items@N@ {\n@Get(':id')\n  async find@N@(id) {}\n}\n@All()", [("GET", ":id", "find@N@")], 1),
        ("@Controller('orders')\nexport class Items@N@ {\n@Post()\n  create(dto) {}\n@Delete(':id')\n  async drop(id) {}\n}", [("POST", "", "create"), ("DELETE", ":id", "drop")], 0),
        ("@Injectable()\nexport class Items@N@ {\n  get(id) {}\n}", [], 0),
    ],
    "jest": [
        ("describe('s', () => { it('a@N@', () => { expect(run()).toBe(1); }); it.skip('b', () => { expect(fn).toHaveBeenCalledTimes(2) }); test('twice', () => { expect(x).resolves.toFoo(1) }); test('twice', () => {}) })", [("a@N@", "NORMAL"), ("b", "SKIP")], 0),
        ("it('c', () => { expect(order.total).toEqual(sum(1, add(2, 3))); expect(() => pay(0)).toThrow('no'); expect(view).toMatchSnapshot(); })", [("c", "NORMAL")], 0),
        ("test.only('e@N@', () => { expect(list[0]).toBe(); expect(fn).not.toHaveBeenCalled(); expect(fn).toHaveBeenNthCalledWith(1, 'x'); expect(user).toHaveProperty('name'); expect(p).rejects.toThrowError() })", [("e@N@", "ONLY")], 0),
    ],
}
#: Of the texts for jest: (text, place, subject, matcher, arguments, kind, unresolved).
_CLAIMED = [
    (0, 1, "run()", "toBe", "1", "RETURN_VALUE", None),
    (0, 2, "fn", "toHaveBeenCalledTimes", "2", "CALL_COUNT", None),
    (0, 3, "x", "toFoo", "1", None, "ASSERTION_SEMANTICS_UNRESOLVED"),
    (1, 1, "order.total", "toEqual", "sum(1, add(2, 3))", "STATE", None),
    (1, 2, "() => pay(0)", "toThrow", "'no'", "EXCEPTION", None),
    (1, 3, "view", "toMatchSnapshot", "", None, "SNAPSHOT_EXPECTATION_UNRESOLVED"),
    (2, 1, "list[0]", "toBe", "", "STATE", "OUTCOME_NOT_EXPLICIT"),
    (2, 2, "fn", "toHaveBeenCalled", "", "CALL_COUNT", None),
    (2, 3, "fn", "toHaveBeenNthCalledWith", "1, 'x'", "INVOCATION_ARGUMENTS", None),
    (2, 4, "user", "toHaveProperty", "'name'", "STATE", None),
    (2, 5, "p", "toThrowError", "", "EXCEPTION", None),
]
_PAGES = "SELECT page_id, page_id % 3 AS m, concat('p/', page_id) AS path FROM pages"


def source_files(spark, sf, language):
    texts = F.array(*[F.lit(text) for text, _, _ in _TEXT[language]])
    content = F.replace(F.get(texts, (F.col("page_id") % 3).cast("int")), F.lit("@N@"), F.col("page_id").cast("string"))
    return view(spark, sf, "pages").select("page_id", F.concat(F.lit("p/"), "page_id").alias("path"), content.alias("content"))


def _quoted(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _values(rows: list[tuple], columns: str) -> str:
    """Stated answers as SQL."""
    return f"(VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)}) v({columns})"


def _numbered(column: str) -> str:
    return f"replace({column}, '@N@', page_id::VARCHAR) AS {column}"


def _routes(language: str) -> str:
    rows = [(i, *r) for i, (_, found, _) in enumerate(_TEXT[language]) for r in found]
    return f"SELECT path, verb, {_numbered('route')}, {_numbered('handler')} FROM s JOIN {_values(rows, 'm, verb, route, handler')} USING (m)"


def _add(name: str, language: str) -> None:
    gaps = [(i, code, n) for i, (_, _, codes) in enumerate(_TEXT[language]) for code, n in codes.items()]
    missing = f"SELECT path, code, n::VARCHAR, NULL FROM s JOIN {_values(gaps, 'm, code, n')} USING (m)"

    @query(name, oracle(f"{_routes(language)} UNION ALL {missing}", ("s", _PAGES)))
    def run(spark, sf):
        f = source_files(spark, sf, language)
        missed = x.unsupported(f, language).select("path", F.col("code").alias("verb"), F.col("n").cast("string").alias("route"), F.lit(None).cast("string").alias("handler"))
        return x.routes(f, language).unionByName(missed)


for _name, _language in (("src_py", "python"), ("src_go", "go"), ("src_java", "java"), ("src_cs", "csharp"), ("src_php", "php"), ("src_rb", "ruby")):
    _add(_name, _language)


@query("src_ts", oracle(f"SELECT path, decorator, concat('Items', page_id) AS class_name, verb, route, handler FROM (SELECT path, page_id, CASE m WHEN 2 THEN 'Injectable' ELSE 'Controller' END AS decorator FROM s) c LEFT JOIN (SELECT path, verb, route, handler FROM ({_routes('typescript')}) y) r USING (path)", ("s", _PAGES)))
def src_ts(spark, sf):
    """Decorated classes with their routes, if there are any."""
    return spans.decorated(source_files(spark, sf, "typescript"))


#: The scanner of a page's file; the last language has none.
_LANGUAGES = [*x.ROUTES, "cobol"]
_DISPATCHED = " UNION ALL ".join(f"SELECT path, '{name}' AS language, verb, route, handler FROM ({_routes(name)}) y{i} WHERE split_part(path, '/', 2)::BIGINT % {len(_LANGUAGES)} = {i}" for i, name in enumerate(x.ROUTES))


@query("src_registry", oracle(_DISPATCHED, ("s", _PAGES)))
def src_registry(spark, sf):
    """Files of all languages in one table, each read by the scanner of its language."""
    texts = F.array(*[F.array(*[F.lit(t) for t, _, _ in _TEXT.get(name, _TEXT["python"])]) for name in _LANGUAGES])
    n = (F.col("page_id") % len(_LANGUAGES)).cast("int")
    content = F.replace(F.get(F.get(texts, n), (F.col("page_id") % 3).cast("int")), F.lit("@N@"), F.col("page_id").cast("string"))
    language = F.get(F.array(*[F.lit(name) for name in _LANGUAGES]), n)
    return x.dispatched(view(spark, sf, "pages").select(F.concat(F.lit("p/"), "page_id").alias("path"), language.alias("language"), content.alias("content")))


@query("src_jest", oracle(f"SELECT path, {_numbered('title')}, modifier FROM s JOIN {_values([(i, *r) for i, (_, found, _) in enumerate(_TEXT['jest']) for r in found], 'm, title, modifier')} USING (m)", ("s", _PAGES)))
def src_jest(spark, sf):
    return specs.cases(spans.tokens(source_files(spark, sf, "jest")))[0].select("path", "title", "modifier")


_CLAIMS = f"SELECT path, subject, matcher, arguments, kind, unresolved, place::INT AS place FROM s JOIN {_values(_CLAIMED, 'm, place, subject, matcher, arguments, kind, unresolved')} USING (m)"


#: Specs with all that a case can state, and what they state: (title, kind, kind of assertion, text, subject, the call that it is about, its assertion).
#: A page gets the spec of its remainder by three; skipped cases and those of one identity state nothing.
_BEHAVED = [
    (
        "import { build } from './b'\nconst repo = { find: jest.fn() }\ndescribe('s', () => {\n  const service = new Service(repo)\n  beforeEach(() => { repo.find.mockResolvedValue(@N@); const seed = { at: 1 } })\n  it('adds @N@', async () => {\n    const input = { qty: @N@ }\n    const result = await service.add(input)\n    expect(result).toEqual({ ok: @N@ })\n    expect(repo.find).toHaveBeenNthCalledWith(1, 'x')\n    expect(order.total).toBe(@N@)\n  })\n  afterAll(() => { close() })\n})",
        [
            ("adds @N@", "SETUP_HOOK", None, "beforeEach(() => { repo.find.mockResolvedValue(@N@); const seed = { at: 1 } })", None, None, None),
            ("adds @N@", "TEARDOWN_HOOK", None, "afterAll(() => { close() })", None, None, None),
            ("adds @N@", "MOCK", None, "repo.find.mockResolvedValue(@N@)", None, None, None),
            ("adds @N@", "INPUT", None, "seed = { at: 1 }", None, None, None),
            ("adds @N@", "INPUT", None, "input = { qty: @N@ }", None, None, None),
            ("adds @N@", "ACTION", None, "service.add(input)", None, None, None),
            ("adds @N@", "ASSERTION", "RETURN_VALUE", "expect(result).toEqual({ ok: @N@ })", "result", "service.add(input)", None),
            ("adds @N@", "EXPECTED_OUTCOME", "RETURN_VALUE", "{ ok: @N@ }", None, None, "expect(result).toEqual({ ok: @N@ })"),
            ("adds @N@", "ASSERTION", "INVOCATION_ARGUMENTS", "expect(repo.find).toHaveBeenNthCalledWith(1, 'x')", "repo.find", None, None),
            ("adds @N@", "EXPECTED_OUTCOME", "CALL_COUNT", "1", None, None, "expect(repo.find).toHaveBeenNthCalledWith(1, 'x')"),
            ("adds @N@", "EXPECTED_OUTCOME", "INVOCATION_ARGUMENTS", "'x'", None, None, "expect(repo.find).toHaveBeenNthCalledWith(1, 'x')"),
            ("adds @N@", "ASSERTION", "STATE", "expect(order.total).toBe(@N@)", "order.total", None, None),
            ("adds @N@", "EXPECTED_OUTCOME", "STATE", "@N@", None, None, "expect(order.total).toBe(@N@)"),
        ],
    ),
    (
        "jest.mock('./m')\nit.each([[1, 2], [3, @N@]])('row %i', (a, b) => { expect(add(a, b)).toBeDefined() })\ntest.only('fails', () => { expect(() => pay(@N@)).toThrow('no'); expect(view).toMatchSnapshot() })\ntest.skip('skipped', () => { run() })",
        [
            ("row %i", "INPUT", None, "[[1, 2], [3, @N@]]", None, None, None),
            ("row %i", "ACTION", None, "add(a, b)", None, None, None),
            ("row %i", "ASSERTION", "RETURN_VALUE", "expect(add(a, b)).toBeDefined()", "add(a, b)", "add(a, b)", None),
            ("fails", "ACTION", None, "pay(@N@)", None, None, None),
            ("fails", "ASSERTION", "EXCEPTION", "expect(() => pay(@N@)).toThrow('no')", "() => pay(@N@)", None, None),
            ("fails", "EXPECTED_OUTCOME", "EXCEPTION", "'no'", None, None, "expect(() => pay(@N@)).toThrow('no')"),
            ("fails", "ASSERTION", None, "expect(view).toMatchSnapshot()", "view", None, None),
        ],
    ),
    (
        "test('b@N@', () => { const n = 1; jest.spyOn(db, 'q').mockReturnValue(n); db.load(n); expect(db.q).toHaveBeenCalledTimes(2) })\ntest('twice', () => { run() }); test('twice', () => { run() })",
        [
            ("b@N@", "INPUT", None, "n = 1", None, None, None),
            ("b@N@", "MOCK", None, "jest.spyOn(db, 'q')", None, None, None),
            ("b@N@", "MOCK", None, "jest.spyOn(db, 'q').mockReturnValue(n)", None, None, None),
            ("b@N@", "ACTION", None, "db.load(n)", None, None, None),
            ("b@N@", "ASSERTION", "CALL_COUNT", "expect(db.q).toHaveBeenCalledTimes(2)", "db.q", None, None),
            ("b@N@", "EXPECTED_OUTCOME", "CALL_COUNT", "2", None, None, "expect(db.q).toHaveBeenCalledTimes(2)"),
        ],
    ),
]
_SPECS = _values([(i, text) for i, (text, _) in enumerate(_BEHAVED)], "m, content")
_STATED = _values([(i, *r) for i, (_, found) in enumerate(_BEHAVED) for r in found], "m, title, kind, assertion_kind, source_text, subject, call, assertion")
_BEHAVIOUR = f"""SELECT path, title, kind, assertion_kind, source_text, subject, strpos(content, call) - 1 AS invocation_start, strpos(content, assertion) - 1 AS assertion_start FROM
 (SELECT concat(path, '.spec.ts') AS path, {', '.join(_numbered(c) for c in ("content", "title", "source_text", "subject", "call", "assertion"))}, kind, assertion_kind FROM s JOIN {_SPECS} USING (m) JOIN {_STATED.replace(') v(', ') w(')} USING (m)) x"""


@query("src_jest_behav", oracle(_BEHAVIOUR, ("s", _PAGES)))
def src_jest_behav(spark, sf):
    """All that cases state: hooks, inputs, mocks, actions, assertions with the calls that they are about, and outcomes with their assertions."""
    p = source_files(spark, sf, "jest").select("page_id", F.concat("path", F.lit(".spec.ts")).alias("path"))
    texts = F.array(*[F.lit(text) for text, _ in _BEHAVED])
    found, _ = specs.claims(p.select("path", F.replace(F.get(texts, (F.col("page_id") % 3).cast("int")), F.lit("@N@"), F.col("page_id").cast("string")).alias("content")))
    return found.select("path", "title", "kind", "assertion_kind", "source_text", "subject", "invocation_start", "assertion_start")


@query("src_assert", oracle(f"SELECT kind, unresolved, count(*) AS n FROM ({_CLAIMS}) c GROUP BY kind, unresolved", ("s", _PAGES)))
def src_assert(spark, sf):
    return specs.assertions(source_files(spark, sf, "jest")).groupBy("kind", "unresolved").agg(F.count(F.lit(1)).alias("n"))


@query("src_rel", oracle("SELECT artifact_id, artifact_key, file_path FROM v_artifact WHERE snapshot_id = (SELECT min(source) FROM documents) AND artifact_type = 'ENTITY'"))
def src_rel(spark, sf):
    """A table read with a filter and a few columns, which reach the scan."""
    least = view(spark, sf, "documents").agg(F.min("source").alias("snapshot_id"))
    return view(spark, sf, "v_artifact").where("artifact_type = 'ENTITY'").join(F.broadcast(least), "snapshot_id").select("artifact_id", "artifact_key", "file_path")


@query("src_runtime", oracle("SELECT CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'PASSED' WHEN 'view' THEN 'PASSED' ELSE 'UNKNOWN' END AS outcome, (props ->> '$.k')::INT % 7 AS line, count(*) AS n, min(value) AS least FROM events GROUP BY ALL"))
def src_runtime(spark, sf):
    """A report's results as typed rows: JSON fields by an explicit schema, outcomes by a lookup."""
    from ..functions.lookup import lookup

    e = view(spark, sf, "events").withColumn("x", F.from_json("props", "k INT"))
    outcome = lookup(F.col("event_type"), {"error": "FAILED", "click": "PASSED", "view": "PASSED"}, "UNKNOWN")
    return e.groupBy(outcome.alias("outcome"), (F.col("x.k") % 7).alias("line")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"))


#: A report for each document: its text gives path and commit, its number what the cases hold.  DuckDB reads only ``_RUNS``.
_RUNS = """SELECT doc_id, concat('run.', doc_id) AS run_id, concat('src/', md5(coalesce(text, '')), '.spec.ts') AS path, concat(md5(coalesce(text, '')), '0a1b2c3d') AS commit_sha,
 CASE WHEN doc_id % 10 = 0 THEN concat('0a1b2c3d', md5(coalesce(text, ''))) ELSE concat(md5(coalesce(text, '')), '0a1b2c3d') END AS static_commit, coalesce(n_chars, 0) AS took FROM documents"""
_CASE = """concat('{"status":', CASE doc_id % 6 WHEN 0 THEN '"passed"' WHEN 1 THEN '"failed"' WHEN 2 THEN '"pending"' WHEN 3 THEN '"todo"' WHEN 4 THEN '"odd"' ELSE '7' END, ',"location":{"line":', doc_id % 50 + 1, ',"column":5},"startAt":', 1000 + doc_id, ',"duration":', took, '}')"""
_REPORT = f"""CASE WHEN doc_id % 11 = 0 THEN '{{"testResults":[' WHEN doc_id % 13 = 0 THEN '{{"testResults":[]}}' ELSE
 concat('{{"testResults":[{{"testFilePath":"/w/', path, '","testResults":[', {_CASE}, ',{{"status":"passed","startAt":5,"duration":-1}},',
 CASE doc_id % 4 WHEN 0 THEN '{{"wouldRun":true}}' WHEN 1 THEN '"text"' ELSE '{{"status":"passed","location":{{"line":999,"column":1}},"startAt":1,"duration":2}}' END, ']}},',
 CASE doc_id % 3 WHEN 0 THEN '{{"testFilePath":"/elsewhere/x.ts","testResults":[{{}}]}}' WHEN 1 THEN '{{"testFilePath":"/w/b.ts","testExecError":{{"m":1}}}}' ELSE '17' END, ']}}') END"""
_STATIC = "SELECT concat('case', doc_id) AS stable_id, path, doc_id % 50 + 1 AS line FROM r WHERE doc_id % 7 <> 0 UNION ALL SELECT concat('twin', doc_id), path, doc_id % 50 + 1 FROM r WHERE doc_id % 5 = 0"
_OBSERVED = """SELECT run_id, path, line, col, outcome, started, duration, CASE WHEN line IS NULL THEN 'SOURCE_LOCATION_MISSING' WHEN NOT same THEN 'STATIC_SNAPSHOT_MISMATCH' WHEN n > 1 THEN 'STATIC_CASE_AMBIGUOUS' WHEN n IS NULL THEN 'STATIC_CASE_UNMATCHED' END AS why, CASE WHEN line IS NOT NULL AND same AND n = 1 THEN least_id END AS test_case FROM
(SELECT run_id, path, doc_id % 50 + 1 AS line, 5 AS col, ['PASSED', 'FAILED', 'PENDING', 'TODO', 'UNKNOWN', 'UNKNOWN'][doc_id % 6 + 1] AS outcome, 1000 + doc_id AS started, took AS duration, doc_id % 10 <> 0 AS same FROM g
 UNION ALL SELECT run_id, path, NULL, NULL, 'PASSED', 5, NULL, doc_id % 10 <> 0 FROM g UNION ALL SELECT run_id, path, 999, 1, 'PASSED', 1, 2, doc_id % 10 <> 0 FROM g WHERE doc_id % 4 > 1) o LEFT JOIN (SELECT path, line, count(*) AS n, min(stable_id) AS least_id FROM k GROUP BY path, line) i USING (path, line)"""
_CORRELATED = "CASE why WHEN 'STATIC_SNAPSHOT_MISMATCH' THEN 'SNAPSHOT_MISMATCH' WHEN 'STATIC_CASE_AMBIGUOUS' THEN 'AMBIGUOUS' ELSE CASE WHEN why IS NULL THEN 'MATCHED' ELSE 'UNMATCHED' END END"
_SEEDED = f"""SELECT *, {_CORRELATED} AS correlation, sha256(concat_ws('|', run_id, path, coalesce(line::VARCHAR, '-'), coalesce(col::VARCHAR, '-'), coalesce(concat(started, '.000'), '-'), CASE WHEN duration IS NULL THEN '-' ELSE concat(duration, '.000') END, outcome, coalesce(test_case, '-'), {_CORRELATED})) AS seed FROM o"""
_TOLD = """SELECT run_id, code, count(*) AS n FROM (SELECT run_id, why AS code FROM o WHERE why IS NOT NULL UNION ALL SELECT run_id, 'UNSUPPORTED_RESULT_STATUS' FROM o WHERE outcome = 'UNKNOWN' UNION ALL SELECT run_id, 'INCOMPLETE_CASE_TIMING' FROM o WHERE duration IS NULL
 UNION ALL SELECT run_id, CASE doc_id % 4 WHEN 0 THEN 'COLLECTION_ONLY_RESULT' ELSE 'MALFORMED_CASE_RESULT' END FROM g WHERE doc_id % 4 < 2 UNION ALL SELECT run_id, CASE doc_id % 3 WHEN 0 THEN 'SOURCE_PATH_OUTSIDE_REPOSITORY' ELSE 'MALFORMED_SUITE_RESULT' END FROM g
 UNION ALL SELECT run_id, 'SUITE_RUNTIME_ERROR' FROM g WHERE doc_id % 3 = 1 UNION ALL SELECT run_id, CASE WHEN doc_id % 11 = 0 THEN 'REPORT_UNREADABLE' ELSE 'NO_TEST_CASE_RESULTS' END FROM r WHERE doc_id % 11 = 0 OR doc_id % 13 = 0) d GROUP BY run_id, code"""
_READ = [("r", _RUNS), ("g", "SELECT * FROM r WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0"), ("k", _STATIC), ("o", _OBSERVED), ("z", _SEEDED), ("d", _TOLD)]


def _imported(spark, sf):
    r = over(spark, sf, _RUNS, "documents")
    reports = r.select("run_id", F.expr(_REPORT).alias("report"), F.lit("/w").alias("root"), "commit_sha", "static_commit")
    return reports, *runs.imported(reports, spark.sql(_STATIC.replace("FROM r", "FROM {r}"), r=r))


@query("src_runtime_cases", oracle("SELECT run_id, path, line::BIGINT AS line, col::BIGINT AS place, outcome, correlation, test_case, started::DOUBLE AS started, (started + duration)::DOUBLE AS ended, seed FROM z", *_READ))
def src_runtime_cases(spark, sf):
    """Observations of reports with whole, odd and broken parts."""
    return _imported(spark, sf)[1].select("run_id", "path", "line", F.col("column").alias("place"), "outcome", "correlation", "test_case", "started", "ended", "seed")


@query("src_runtime_codes", oracle("SELECT run_id, code, n FROM d", *_READ))
def src_runtime_codes(spark, sf):
    """How often each thing kept a part of a report from being read or told."""
    return _imported(spark, sf)[2]


@query(
    "src_runtime_trace",
    oracle(
        """SELECT run_id, CASE WHEN c IS NULL THEN 'COMPLETE' ELSE 'PARTIAL' END AS status, coalesce(n, 0) AS observations, coalesce(c, '') AS diagnostics, sha256(concat(coalesce(s, ''), ';', coalesce(c, ''))) AS digest FROM r
 LEFT JOIN (SELECT run_id, count(*) AS n, array_to_string(list_sort(list(concat(seed, ':1'))), ',') AS s FROM z GROUP BY run_id) a USING (run_id) LEFT JOIN (SELECT run_id, array_to_string(list_sort(list(concat(code, ':', n))), ',') AS c FROM d GROUP BY run_id) b USING (run_id)""",
        *_READ,
    ),
)
def src_runtime_trace(spark, sf):
    """One row a report: whether all was read, counts and digest."""
    return runs.traces(*_imported(spark, sf))


@query("src_fixture", oracle("SELECT 'documents' AS relation, count(*) AS n, count(DISTINCT source) AS groups FROM documents UNION ALL SELECT 'pages', count(*), count(DISTINCT split_part(url, '/', 3)) FROM pages"))
def src_fixture(spark, sf):
    """The loaded tables with their sizes."""
    d = view(spark, sf, "documents").agg(F.lit("documents").alias("relation"), F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("groups"))
    host = F.split_part("url", F.lit("/"), F.lit(3))
    return d.unionByName(view(spark, sf, "pages").agg(F.lit("pages").alias("relation"), F.count(F.lit(1)).alias("n"), F.countDistinct(host).alias("groups")))
