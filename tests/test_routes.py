"""Route readers on texts of their own: what is a route, what is named instead, and what is neither."""

import pytest

from impactloom.sources import extract

CASES = [
    ("python", "@app.get('/a', tags=[x('(')])\n\n  async def  a (): ...", [("GET", "/a", "a")], {}),
    ("python", '@app.get("/a")\nclass B: ...', [], {"PY_HANDLER_NOT_FOUND": 1}),
    ("python", '@app.get("/a" "b", x=1)\ndef c(): ...\nx = Flask (1)', [("GET", "/a", "c")], {"PY_UNKNOWN_ROUTER_PATTERN": 1}),
    ("go", 'r.GET(fmt.Sprintf("/x/%d", n), h)\ne := echo.New()', [], {"GO_ROUTE_CONSTANT_RESOLUTION_UNSUPPORTED": 1, "GO_UNKNOWN_ROUTER_PATTERN": 1}),
    ("go", 'mux.HandleFunc("/x/{id}", h)\nhttp.HandleFunc("/y", func(w W, r *R) {})', [], {"GO_DYNAMIC_ROUTE_UNSUPPORTED": 1, "GO_INLINE_HANDLER_UNSTABLE_IDENTITY_UNSUPPORTED": 1}),
    ("java", '@RequestMapping(path="v/")\n@RestController\nclass A { @DeleteMapping(value="/{id}")\npublic <T> List<T> drop() {} }', [("DELETE", "/v/{id}", "drop")], {}),
    ("java", '@RequestMapping(value = "/a", produces = "x")\npublic void a() {}\n@PutMapping("/b")\nvoid hidden() {}', [], {"SPRING_REQUEST_MAPPING_FORM_UNSUPPORTED": 1, "SPRING_HANDLER_NOT_FOUND": 1}),
    ("csharp", "[HttpGet('a', Name = \"x\")]\npublic Item A() {}\n[HttpPost(\"b\")]\n", [("GET", "a", "A")], {"CS_HANDLER_NOT_FOUND": 1}),
    ("php", "Route :: DELETE\nRoute::delete(\"/a,b\", [X\\Y::class, 'z']);", [("DELETE", "/a,b", "Y@z")], {}),
    ("php", 'Route::get("/a/$id", [X::class, "y"]);', [], {"PHP_DYNAMIC_ROUTE_UNSUPPORTED": 1}),
    ("ruby", "get '/a', as: :b\n\tpost \"/c\",\n  to: 'c#d'", [("POST", "/c", "c#d")], {"RB_HANDLER_NOT_FOUND": 1}),
]


def _files(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "path int, content string").selectExpr("cast(path AS string) AS path", "content")


@pytest.mark.parametrize("language", sorted({c[0] for c in CASES}))
def test_each_place_is_a_route_or_named(spark, language):
    cases = [c for c in CASES if c[0] == language]
    files = _files(spark, [c[1] for c in cases])
    want = {(str(i), *r) for i, c in enumerate(cases) for r in c[2]}
    assert {tuple(r) for r in extract.routes(files, language).collect()} == want
    gaps = {(str(i), code, n) for i, c in enumerate(cases) for code, n in c[3].items()}
    assert {tuple(r) for r in extract.unsupported(files, language).collect()} == gaps


@pytest.mark.parametrize("language", sorted(extract.ROUTES))
def test_null_empty_and_long_texts(spark, language):
    files = _files(spark, [None, "", "(" * 50_000, "@get." * 50_000, "x" * 500_000, "@app.get(" + "'a'," * 2_000 + "@GetMapping(" * 3_000])
    assert extract.routes(files, language).collect() == []
    assert {r["path"] for r in extract.unsupported(files, language).collect()} <= {"5"}


def test_dispatch_reads_once(spark):
    """One scan of the files for all languages, and the routes of each language's own reader."""
    files = spark.createDataFrame([(str(i), c[0], c[1]) for i, c in enumerate(CASES)], "path string, language string, content string")
    got = {tuple(r) for r in extract.dispatched(files).collect()}
    assert got == {(str(i), c[0], *r) for i, c in enumerate(CASES) for r in c[2]}
    plan = extract.dispatched(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ExistingRDD") == 1
