"""Artifacts, routes and tests in source text, by patterns.

A reader of routes is a list of forms: a pattern that also takes in what cannot be resolved, and the decisions on its groups.
So each place that looks like a route is either a route or has a code that says why not.  Files and matches stay rows,
nothing but expressions runs per file, and a file is read by the forms of its language only.  Null texts hold nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import first_match

VERBS = "get|post|put|patch|delete"
_NAMED = "Get|Post|Put|Patch|Delete"
Rules = Callable[[Column], list[tuple[Column, str]]]


@dataclass(frozen=True)
class Form:
    """One way to write a route; ``groups`` are places in the pattern, the rest are expressions of them.

    ``gaps``: the first that holds says why there is no route.  ``notes``: the first that holds is told beside the route.
    """

    pattern: str
    groups: dict[str, int]
    route: Callable[[Column], Column] = lambda x: x["route"]
    handler: Callable[[Column], Column] = lambda x: x["handler"]
    verb: Callable[[Column], Column] = lambda x: F.upper(x["verb"])
    gaps: Rules = field(default=lambda _: [])
    notes: Rules = field(default=lambda _: [])


def _literal(args: Column) -> Column:
    """The text of a leading string in single or double quotes, "" if there is none."""
    return F.regexp_extract(args, r"^\s*([\"'])(.*?)\1", 2)


def _quote(args: Column) -> Column:
    return F.regexp_extract(args, r"^\s*([A-Za-z]?[\"'])", 1)


def _unquoted(args: Column) -> Column:
    return F.regexp_replace(F.trim(args), r"^[\"`]|[\"`]$", "")


def _joined(base: Column, path: Column) -> Column:
    """Two parts of a path with one slash before each."""
    parts = F.filter(F.transform(F.array(base, path), lambda p: F.regexp_replace(p, "^/+|/+$", "")), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def _any(x: Column, *marks: str) -> Column:
    held = F.lit(False)
    for m in marks:
        held = held | F.contains(x, F.lit(m))
    return held


def _go_literal(x: Column) -> tuple[Column, str]:
    return ~F.trim(x["route"]).rlike("^[\"`]"), "GO_ROUTE_CONSTANT_RESOLUTION_UNSUPPORTED"


def _go_inline(x: Column) -> tuple[Column, str]:
    return F.trim(x["handler"]).startswith("func"), "GO_INLINE_HANDLER_UNSTABLE_IDENTITY_UNSUPPORTED"


def _go_symbol(x: Column) -> Column:
    return F.regexp_replace(x["handler"], r"\W", "")


def _php_handler(x: Column) -> Column:
    listed, legacy = r"\[\s*(?:\w*\\)*(\w+)(?:::\s*class)?\s*,\s*[\"'](\w+)[\"']\s*\]", r"[\"'](?:\w*\\)*(\w+)@(\w+)[\"']"
    named = [(x["handler"].rlike(p), F.concat(F.regexp_extract(x["handler"], p, 1), F.lit("@"), F.regexp_extract(x["handler"], p, 2))) for p in (listed, legacy)]
    return first_match([*named, (x["handler"].rlike(r"function\s*\("), F.lit("closure@closure"))])


_PLAIN, _STRING = r"[^()\"']*+", r"(?:\"[^\"\n]*+\"|'[^'\n]*+')"
_JAVA_FORMS = r"@(\w*Mapping)\b(?:\s*\(([^)]*)\))?+(?=(?:\s*@\w+(?:\([^)]*\))?)*\s*(?:public\s+[^(){};=]*?(\w+)\s*\()?)(?!(?:\s*@\w+(?:\([^)]*\))?)*\s*(?:public\s+|abstract\s+|final\s+)*class\b)"
_JAVA_PATH = r"(?:\b(?:path|value)\s*=\s*|^\s*)\{?\s*\"([^\"]*)\""
# The codes of the diagnostics, here and below.
ROUTES: dict[str, list[Form]] = {
    "python": [
        Form(
            rf"@(\w+)\.({VERBS}|options|head)\s*\(({_PLAIN}(?:(?:{_STRING}|\({_PLAIN}(?:{_STRING}{_PLAIN})*+\)){_PLAIN})*+)\)(?=(?:\s*(?:async\s+)?def\s+(\w+)\s*\()?)",
            {"owner": 1, "verb": 2, "route": 3, "handler": 4},
            route=lambda x: _literal(x["route"]),
            gaps=lambda x: [
                ((x["owner"] != "app") & F.col("content").rlike(r"\bAPIRouter\s*\([^)]*prefix\s*="), "PY_ROUTER_PREFIX_UNSUPPORTED"),
                (~_quote(x["route"]).rlike("^[\"']") | _any(F.get(F.split(x["route"], ","), F.lit(0)), "+"), "PY_DYNAMIC_ROUTE_UNSUPPORTED"),
                (x["handler"] == "", "PY_HANDLER_NOT_FOUND"),
            ],
        )
    ],
    "go": [
        Form(
            r"\b\w+\.(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD|ANY)\s*\(\s*([^,\n]+),\s*([^)]+)\)",
            {"verb": 1, "route": 2, "handler": 3},
            route=lambda x: _unquoted(x["route"]),
            handler=_go_symbol,
            gaps=lambda x: [_go_literal(x), (_any(x["route"], ":", "*"), "GO_DYNAMIC_ROUTE_UNSUPPORTED"), (_any(x["handler"], ","), "GO_MIDDLEWARE_CHAIN_UNSUPPORTED"), _go_inline(x)],
        ),
        Form(
            r"\b(?:http|mux)\.HandleFunc\s*\(\s*([^,\n]+),\s*([^)]+)\)",
            {"verb": 0, "route": 1, "handler": 2},
            route=lambda x: _unquoted(x["route"]),
            handler=_go_symbol,
            verb=lambda _: F.lit("UNKNOWN"),
            gaps=lambda x: [_go_literal(x), _go_inline(x), (_any(x["route"], ":", "*", "{"), "GO_DYNAMIC_ROUTE_UNSUPPORTED")],
            notes=lambda _: [(F.lit(True), "GO_HTTP_METHOD_NOT_EXTRACTED")],
        ),
    ],
    "java": [
        Form(
            _JAVA_FORMS,
            {"verb": 1, "route": 2, "handler": 3},
            # The path of the class stands before its body.
            route=lambda x: _joined(F.regexp_extract("content", r"@RequestMapping\s*\(\s*(?:(?:value|path)\s*=\s*)?\"([^\"]*)\"[^{};]*?\bclass\b", 1), F.regexp_extract(x["route"], _JAVA_PATH, 1)),
            verb=lambda x: F.when(x["verb"] == "RequestMapping", F.regexp_extract(x["route"], r"RequestMethod\.([A-Z]+)", 1)).otherwise(F.upper(F.regexp_replace(x["verb"], "Mapping$", ""))),
            gaps=lambda x: [
                (~x["verb"].rlike(rf"^(?:{_NAMED}|Request)Mapping$"), "SPRING_COMPOSED_MAPPING_UNSUPPORTED"),
                (_any(x["route"], "+"), "SPRING_DYNAMIC_ROUTE_UNSUPPORTED"),
                (x["route"].rlike(r"\{[^}\"]*\"[^}]*,"), "SPRING_MULTI_ROUTE_MAPPING_UNSUPPORTED"),
                ((x["verb"] == "RequestMapping") & x["route"].rlike(r"\b(?:params|headers|consumes|produces|name)\s*="), "SPRING_REQUEST_MAPPING_FORM_UNSUPPORTED"),
                ((x["verb"] == "RequestMapping") & ~_any(x["route"], "RequestMethod."), "SPRING_HTTP_METHOD_UNKNOWN"),
                (x["handler"] == "", "SPRING_HANDLER_NOT_FOUND"),
            ],
        )
    ],
    "csharp": [
        Form(
            rf"\[Http({_NAMED})\s*(?:\(\s*([^\n]*?)\s*\))?\](?=(?:\s*\[[^\]\n]*\])*(?:\s*[A-Za-z][\w<>\[\],?. ]*?\s(\w+)\s*\()?)",
            {"verb": 1, "route": 2, "handler": 3},
            route=lambda x: F.when(x["route"] == "", "/").otherwise(_literal(x["route"])),
            gaps=lambda x: [((x["route"] != "") & ~_quote(x["route"]).rlike("^[\"']"), "CS_DYNAMIC_ROUTE_UNSUPPORTED"), (x["handler"] == "", "CS_HANDLER_NOT_FOUND")],
        ),
        Form(
            rf"\bapp\s*\.\s*Map({_NAMED})\s*\(\s*([^,)]*)(?:,\s*([A-Za-z_]\w*))?",
            {"verb": 1, "route": 2, "handler": 3},
            route=lambda x: _literal(x["route"]),
            handler=lambda x: F.when(x["handler"] == "", "anonymous").otherwise(x["handler"]),
            gaps=lambda x: [(~_quote(x["route"]).rlike("^[\"']"), "CS_DYNAMIC_ROUTE_UNSUPPORTED")],
        ),
    ],
    "php": [
        Form(
            rf"Route\s*::\s*({VERBS})\s*\(\s*(\"[^\"\n]*\"[^,\n]*|'[^'\n]*'[^,\n]*|[^,\n'\"]+),\s*([^)]*)\)",
            {"verb": 1, "route": 2, "handler": 3},
            route=lambda x: _literal(x["route"]),
            handler=_php_handler,
            gaps=lambda x: [
                (~_quote(x["route"]).rlike("^[\"']") | _any(x["route"], "$") | x["route"].rlike("[\"']\\s*\\."), "PHP_DYNAMIC_ROUTE_UNSUPPORTED"),
                (_php_handler(x).isNull(), "PHP_CONTROLLER_RESOLUTION_BOUNDARY"),
            ],
            notes=lambda x: [(x["handler"].rlike(r"^[\"'][\w\\]+@\w+"), "PHP_CONTROLLER_RESOLUTION_BOUNDARY")],
        )
    ],
    "ruby": [
        Form(
            rf"(?m)^[ \t]*({VERBS})[ \t]+(\"[^\"\n]*\"|'[^'\n]*'|[A-Za-z_]\w*)[ \t]*(,\s*to:|=>|,)\s*(?:[\"']([^#'\"\n]+#[^#'\"\n]+)[\"'])?",
            {"verb": 1, "route": 2, "arrow": 3, "handler": 4},
            route=lambda x: _literal(x["route"]),
            gaps=lambda x: [
                (~x["route"].rlike("^[\"']") | (x["route"].startswith('"') & _any(x["route"], "#{")), "RB_DYNAMIC_ROUTE_UNSUPPORTED"),
                (x["handler"] == "", "RB_HANDLER_NOT_FOUND"),
            ],
            notes=lambda x: [(x["arrow"] == "=>", "RB_CONTROLLER_RESOLUTION_BOUNDARY")],
        )
    ],
    "typescript": [Form(rf"@({_NAMED})\('?([^')]*)'?\)\s*(?:async )?(\w+)\(", {"verb": 1, "route": 2, "handler": 3})],
}
#: Constructs that a reader sees and does not follow, with the pattern that counts them.
MARKS: dict[str, dict[str, str]] = {
    "python": {
        "PY_UNKNOWN_ROUTER_PATTERN": r"\bFlask\s*\(|\bdjango\.",
        "PY_DEPENDENCY_INJECTION_BOUNDARY": r"\bDepends\s*\(",
        "PY_ROUTER_PREFIX_UNSUPPORTED": r"\bAPIRouter\s*\([^)]*prefix\s*=",
    },
    "go": {"GO_ROUTE_GROUP_UNSUPPORTED": r"\.Group\s*\(", "GO_MIDDLEWARE_CHAIN_UNSUPPORTED": r"\.Use\s*\(", "GO_UNKNOWN_ROUTER_PATTERN": r"\b(?:echo|fiber|chi)\.New\("},
    "java": {},
    "csharp": {
        "CS_ROUTE_TOKEN_UNSUPPORTED": r"\[Route\s*\(\s*[\"'][^\"']*\[(?i:controller|action)\]",
        "CS_DI_BOUNDARY": r"\[FromServices\]|\bIServiceProvider\s+\w",
        "CS_MINIMAL_API_GROUP_UNSUPPORTED": r"\.MapGroup\s*\(",
        "CS_UNKNOWN_ROUTER_PATTERN": r"\[(?:WebGet|WebInvoke|OperationContract)\b",
    },
    "php": {
        "PHP_RESOURCE_ROUTE_UNSUPPORTED": r"Route\s*::\s*(?:resource|apiResource)\s*\(",
        "PHP_ROUTE_GROUP_UNSUPPORTED": r"Route\s*::\s*group\s*\(",
        "PHP_MIDDLEWARE_BOUNDARY": r"->middleware\s*\(",
        "PHP_UNKNOWN_ROUTER_PATTERN": rf"\$(?:router|app)->(?:{VERBS})\s*\(",
    },
    "ruby": {
        "RB_RESOURCE_ROUTE_UNSUPPORTED": r"\bresources?\s+[:'\"]\w",
        "RB_NAMESPACE_ROUTE_UNSUPPORTED": r"\bnamespace\s+[:'\"]\w+['\"]?\s+do\b",
        "RB_SCOPE_ROUTE_UNSUPPORTED": r"\bscope\b[^\n]*\bdo\b",
        "RB_MOUNTED_ENGINE_UNSUPPORTED": r"\bmount\s+[A-Z]",
        "RB_UNKNOWN_ROUTER_PATTERN": r"<\s*Sinatra::Base",
    },
    "typescript": {"TS_ALL_ROUTE_UNSUPPORTED": r"@All\("},
}


def _each(content: str, pattern: str, groups: dict[str, int]) -> Column:
    """An array of structs, one per match; group 0 gives null.  Each group's matches are looked up once for a text."""
    lists = [F.regexp_extract_all(content, F.lit(pattern), F.lit(g)) for g in [0, *groups.values()]]
    nothing = F.lit(None).cast("string")

    def one(x: Column, i: Column) -> Column:
        return F.struct(*[(x.getField(str(k)) if g else nothing).alias(name) for k, (name, g) in enumerate(groups.items(), 1)], (i + 1).alias("place"))

    return F.transform(F.arrays_zip(*lists), one)


def _found(language: str) -> Column:
    """All places of a language's forms: an array of (verb, route, handler, code, note)."""

    def told(form: Form) -> Column:
        def one(x: Column) -> Column:
            nothing = F.lit(None).cast("string")
            gaps, notes = form.gaps(x), form.notes(x)
            code = first_match(gaps) if gaps else nothing
            note = F.when(code.isNull(), first_match(notes)) if notes else nothing
            return F.struct(form.verb(x).alias("verb"), form.route(x).alias("route"), form.handler(x).alias("handler"), code.alias("code"), note.alias("note"))

        return F.transform(_each("content", form.pattern, form.groups), one)

    return F.concat(*[told(form) for form in ROUTES[language]])


def routes(files: DataFrame, language: str) -> DataFrame:
    """(path, verb, route, handler) of the files' routes; a verb that the text does not tell is UNKNOWN."""
    each = files.select("path", F.explode(_found(language)).alias("x")).where("x.code is null")
    return each.select("path", "x.verb", "x.route", "x.handler")


def dispatched(files: DataFrame) -> DataFrame:
    """(path, language, verb, route, handler): each file is read once, by the forms of its language; other languages have none."""
    found = first_match([(F.col("language") == name, _found(name)) for name in ROUTES])
    each = files.select("path", "language", F.explode(found).alias("x")).where("x.code is null")
    return each.select("path", "language", "x.verb", "x.route", "x.handler")


def unsupported(files: DataFrame, language: str) -> DataFrame:
    """(path, code, n): how often a file has what looks like a route but is none, or a construct that is not followed."""
    told = F.transform(_found(language), lambda x: F.struct(x["code"].alias("code"), x["note"].alias("note")))
    codes = F.filter(F.flatten(F.transform(told, lambda x: F.array(x["code"], x["note"]))), lambda c: c.isNotNull())
    marks = [F.array_repeat(F.lit(code), F.regexp_count("content", F.lit(pattern))) for code, pattern in MARKS[language].items()]
    each = files.select("path", F.explode(F.concat(codes, *marks)).alias("code"))
    return each.groupBy("path", "code").agg(F.count(F.lit(1)).alias("n"))


_CLASS_START = r"(?=@(?:Controller|Injectable|Entity|Module)\()"
_METHOD_START = r"(?m)(?=^  (?:async )?\w+\([^)\n]*\)[^{;\n]*\{)"
_TEST_START = r"(?=\b(?:it|test)(?:\.\w+)?\(')"


def _code_classes(files: DataFrame) -> DataFrame:
    """(path, decorator, class, body) of decorated classes; a body goes to the next decorator of a class."""
    parts = files.select("path", F.explode(F.split("content", _CLASS_START)).alias("body"))
    named = parts.select("path", F.regexp_extract("body", r"^@(\w+)\(", 1).alias("decorator"), F.regexp_extract("body", r"^@\w+\([^\n]*\)\s*export class (\w+)", 1).alias("class"), "body")
    return named.where("class <> ''")


def _methods(classes: DataFrame) -> DataFrame:
    parts = classes.select("path", "class", F.explode(F.split("body", _METHOD_START)).alias("code"))
    found = parts.withColumn("method", F.regexp_extract("code", r"^  (?:async )?(\w+)\([^)\n]*\)[^{;\n]*\{", 1))
    return found.where("method <> '' AND method <> 'constructor'")


def code_edges(files: DataFrame) -> DataFrame:
    """(source, target, type, reason) of source files: CALLS, USES and TESTS edges, and calls that lead nowhere with their reason.

    Sources and targets are named class#method, test cases path#title.  Receivers of calls are fields that a constructor
    declares and, in tests, constants that hold a new object; a repository of an entity uses the entity.  What the patterns
    cannot see (calls across functions, aliases) is no edge.  All look-ups are joins, so nothing is gathered.
    """
    classes = _code_classes(files)
    declared = classes.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("decorator") == "Entity").alias("entity")).withColumnRenamed("class", "type")
    methods = _methods(classes)
    known = methods.select(F.col("class").alias("type"), "method").distinct().withColumn("known", F.lit(True))
    field = _each("body", r"(@InjectRepository\(\w+\) )?(?:(?:private|public|protected|readonly) )+(\w+): (?:Repository<)?(\w+)", {"stored": 1, "receiver": 2, "type": 3})
    fields = classes.select("class", F.explode(field).alias("x")).select("class", "x.receiver", "x.type", (F.col("x.stored") != "").alias("stored"))

    call = _each("code", r"\bthis\.(\w+)\.(\w+)\(", {"receiver": 1, "method": 2})
    source = F.concat_ws("#", "class", "method").alias("source")
    calls = methods.select(source, "class", F.explode(call).alias("x")).select("source", "class", "x.receiver", F.col("x.method").alias("method"))
    sent = calls.join(fields, ["class", "receiver"], "left").select("source", "receiver", "type", "method", F.coalesce("stored", F.lit(False)).alias("stored"), F.lit("CALLS").alias("kind"))

    tested = files.where(~F.col("content").rlike(r"export class "))
    held = tested.select("path", F.explode(_each("content", r"const (\w+) = new (\w+)\(", {"receiver": 1, "type": 2})).alias("x")).select("path", "x.receiver", "x.type")
    cases = tested.select("path", F.explode(F.split("content", _TEST_START)).alias("code")).withColumn("title", F.regexp_extract("code", r"^(?:it|test)(?:\.only)?\('([^']*)'", 1)).where("title <> ''")
    cases = cases.withColumn("source", F.concat_ws("#", "path", "title"))
    inner = F.filter(_each("code", r"(?<![\w.])(\w+)\.(\w+)\(", {"receiver": 1, "method": 2}), lambda x: ~x["receiver"].isin("expect", "jest", "it", "test"))
    cases = cases.withColumn("calls", inner)
    none = cases.where(F.size("calls") == 0).select("source", F.lit(None).cast("string").alias("target"), F.lit("TESTS").alias("type"), F.lit("NO_SUPPORTED_DIRECT_REFERENCE").alias("reason"))
    run = cases.select("path", "source", F.explode("calls").alias("x")).select("path", "source", "x.receiver", F.col("x.method").alias("method"))
    run = run.join(held, ["path", "receiver"], "left").select("source", "receiver", "type", "method", F.lit(False).alias("stored"), F.lit("TESTS").alias("kind"))

    found = sent.unionByName(run).distinct().join(declared, "type", "left").join(known, ["type", "method"], "left")
    uses = F.col("stored") & F.coalesce("entity", F.lit(False))
    reason = first_match(
        [
            (F.col("type").isNull() | F.col("n").isNull(), "UNRESOLVED_RECEIVER"),
            (F.col("n") > 1, "AMBIGUOUS_SYMBOL"),
            (~uses & F.col("known").isNull(), "METHOD_ARTIFACT_NOT_EXTRACTED"),
        ]
    )
    wanted = F.concat_ws(".", "receiver", "method")
    target = F.when(F.col("reason").isNotNull(), wanted).when(uses, F.col("type")).otherwise(F.concat_ws("#", "type", "method"))
    linked = found.withColumn("reason", reason).select("source", target.alias("target"), F.when(uses, "USES").otherwise(F.col("kind")).alias("type"), "reason")

    entities = declared.where("entity AND n = 1").select(F.col("type").alias("target"))
    named = methods.select(source, F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"\b([A-Z]\w*)\b"), F.lit(1)))).alias("target"))
    by_name = named.join(entities, "target", "left_semi").select("source", "target", F.lit("USES").alias("type"), F.lit(None).cast("string").alias("reason"))
    return linked.unionByName(by_name).unionByName(none).distinct()
