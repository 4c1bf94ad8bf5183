"""Jest specs as nested spans: suites, test cases, and what a case states about behaviour.

Suites are followed from the top of a file down, a join for each level of nesting.  Functions are numbered where they begin;
the innermost function of a token is the last one that began at its depth, so what a case, a hook or a throwing callback does
itself is a join on that number, and what nested callbacks do is told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import redacted
from ..operators.rounds import cut
from .spans import KEYWORDS, SHUTS, _at, by_path, spelled, texts, tokens

APIS = ["describe", "it", "test"]
HOOKS = {"beforeEach": "SETUP_HOOK", "beforeAll": "SETUP_HOOK", "afterEach": "TEARDOWN_HOOK", "afterAll": "TEARDOWN_HOOK"}
# Jest's own names by what they do.
MOCK_ROOTS = ["fn", "mock", "doMock", "dontMock", "unmock", "setMock", "spyOn", "replaceProperty", "clearAllMocks", "resetAllMocks", "restoreAllMocks", "requireActual", "requireMock"]
MOCK_SETTINGS = ["mockClear", "mockReset", "mockRestore", "mockImplementation", "mockImplementationOnce", "mockReturnThis", "mockReturnValue", "mockReturnValueOnce", "mockResolvedValue", "mockResolvedValueOnce", "mockRejectedValue", "mockRejectedValueOnce", "mockName"]
ASYMMETRIC = ["any", "anything", "arrayContaining", "objectContaining", "stringContaining", "stringMatching"]
RETURNS = ["toBe", "toEqual", "toStrictEqual", "toMatchObject", "toContain", "toContainEqual", "toBeCloseTo", "toBeGreaterThan", "toBeGreaterThanOrEqual", "toBeLessThan", "toBeLessThanOrEqual", "toBeInstanceOf", "toBeDefined", "toBeUndefined", "toBeNull", "toBeTruthy", "toBeFalsy", "toBeNaN", "toHaveLength", "toMatch"]
COUNTS = ["toHaveBeenCalled", "toHaveBeenCalledOnce", "toHaveBeenCalledTimes", "toHaveReturned", "toHaveReturnedTimes"]
INVOCATIONS = ["toHaveBeenCalledWith", "toHaveBeenLastCalledWith"]
EXCEPTIONS = ["toThrow", "toThrowError"]
SNAPSHOTS = ["toMatchSnapshot", "toMatchInlineSnapshot"]
BUILT_IN = ["Array", "BigInt", "Boolean", "Buffer", "Date", "JSON", "Map", "Math", "Number", "Object", "Promise", "RegExp", "Set", "String", "URL", "URLSearchParams", "WeakMap", "WeakSet", "isFinite", "isNaN", "parseFloat", "parseInt", "structuredClone"]
#: Suites within suites, claims of a case, and characters of a claim; the feature's own bounds, which are reported when reached.
MOST_SUITES, MOST_CLAIMS, MOST_TEXT = 20, 100, 2000
_CONTROL = ["if", "for", "while", "switch", "catch", "with", "await"]
_LAMBDA = r"^(async )?(\( \)|[\w$]+)( : [^=]*?)? => |^(async )?function( \*)?( [\w$]+)? \( \)"


def with_functions(toks: DataFrame) -> DataFrame:
    """Tokens with ``fn``, the number of the innermost function that holds them (null: none), ``enter``, whether one begins here,
    and ``next_enter``, the next place where one begins.  A function begins at its brace, or at its arrow if it has none."""
    block = (F.col("t") == "{") & ((F.col("prev") == "=>") | ((F.col("prev") == ")") & ~F.get("before", F.lit(2)).isin(_CONTROL)))
    lean = (F.col("t") == "=>") & F.coalesce(F.col("next") != "{", F.lit(False))
    sib = Window.partitionBy("path", "up").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, -1)
    stops = F.col("t").isin(",", ";") | F.col("fresh")
    marked = toks.withColumn("enter", F.coalesce(block | lean, F.lit(False)))
    held = marked.where(F.col("enter") | stops).withColumn("lean_stop", F.min(F.when(stops, F.col("i"))).over(sib))
    closes = toks.where("close IS NOT NULL").select("path", F.col("i").alias("up"), F.col("close").alias("shut"))
    begun = held.where("enter").join(closes, ["path", "up"], "left")
    after_last = F.lit(1 << 30)
    leave = begun.select("path", F.when(F.col("t") == "{", F.col("close")).otherwise(F.coalesce("lean_stop", "shut", after_last)).alias("i")).groupBy("path", "i").agg(F.count(F.lit(1)).alias("leaves"))
    along = Window.partitionBy("path").orderBy("i")
    found = marked.join(leave, ["path", "i"], "left")
    found = found.withColumn("depth", F.sum(F.col("enter").cast("int") - F.coalesce("leaves", F.lit(0))).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = found.withColumn("fn", F.when(F.col("depth") > 0, F.last(F.when(F.col("enter"), F.col("i")), ignorenulls=True).over(Window.partitionBy("path", "depth").orderBy("i"))))
    return found.withColumn("next_enter", F.min(F.when(F.col("enter"), F.col("i"))).over(Window.partitionBy("path").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, -1))).drop("leaves", "depth")


def _callbacks(toks: DataFrame, calls: DataFrame) -> DataFrame:
    """``calls`` (path, args, ...) with their first argument (first_kind, first_t, alone) and the function behind it or first: enter, lambda, asynchronous."""
    # Of what stands inside a bracket the first and the commas are asked for.
    inside = toks.where("prev IS NULL OR t = ','").select("path", F.col("up").alias("args"), "i", "kind", "t", "next", "next_i", "behind", "arrow", "block")
    first = inside.groupBy("path", "args").agg(F.min_by(F.struct("kind", "t", "next", "behind", "arrow", "block"), "i").alias("first"), F.min_by(F.struct("behind", "arrow", "block"), F.when(F.col("t") == ",", F.col("i"))).alias("comma"), F.sum((F.col("t") == ",").cast("int")).alias("commas"))
    return calls.join(first, ["path", "args"], "left")


def _begin(of: Column, toks: DataFrame, calls: DataFrame, name: str) -> DataFrame:
    """Where the function that ``of`` (arrow, block) speaks of begins: at the brace behind the arrow, the arrow, or the brace."""
    rows = calls.withColumn("__arrow", of["arrow"]).withColumn("__block", of["block"]).join(_at(toks, "__arrow", ["=>"], arrow_next="next", arrow_next_i="next_i"), ["path", "__arrow"], "left")
    use_arrow = F.col("__arrow").isNotNull() & (F.col("__block").isNull() | (F.col("__arrow") < F.col("__block")))
    return rows.withColumn(name, F.when(use_arrow, F.when(F.col("arrow_next") == "{", F.col("arrow_next_i")).otherwise(F.col("__arrow"))).otherwise(F.col("__block"))).drop("__arrow", "__block", "arrow_next", "arrow_next_i")


def declarations(toks: DataFrame) -> DataFrame:
    """(path, i, up, fresh, api, modifier, parameterized, supported, title, enter, has_block, asynchronous, table, args, start, end, line, last, ...)."""
    chain = r"^((?:\. [\w$]+ )*)(S )?\( \)( \( \))?(?: |$)"
    d = toks.where(F.col("t").isin(APIS) & (F.col("kind") == "name") & ~F.coalesce(F.col("prev").isin(".", "?."), F.lit(False)) & F.col("behind").rlike(chain))
    d = d.select("path", "i", "up", "fresh", "start", "line", F.col("t").alias("api"), F.col("paren").alias("table"), F.split(F.trim(F.regexp_replace(F.regexp_extract("behind", chain, 1), r"\. ", "")), " ").alias("names"), (F.regexp_extract("behind", chain, 2) != "").alias("tagged"), (F.regexp_extract("behind", chain, 3) != "").alias("twice"))
    d = d.withColumn("names", F.filter("names", lambda n: n != ""))
    d = d.join(_at(toks, "table", ["("], table_close="close", table_next="next_i"), ["path", "table"]).join(_at(toks, "table_close", SHUTS, second="next_i"), ["path", "table_close"])
    only_list = toks.where("t = '[' AND prev IS NULL").select("path", F.col("up").alias("table"), F.col("close").alias("list_close")).join(toks.where("next IS NULL").select("path", F.col("i").alias("list_close")), ["path", "list_close"]).select("path", "table", F.lit(True).alias("is_list"))
    d = d.join(only_list, ["path", "table"], "left")
    each = F.col("twice") & (F.element_at(F.col("names"), F.lit(-1)) == "each") & F.coalesce("is_list", F.lit(False))
    d = d.withColumn("parameterized", F.coalesce(F.when(F.size("names") > 0, each), F.lit(False)))
    d = d.withColumn("names", F.when(F.col("parameterized"), F.slice("names", F.lit(1), F.size("names") - 1)).otherwise(F.col("names")))
    d = d.withColumn("args", F.when(F.col("twice"), F.col("second")).otherwise(F.col("table")))
    modifier = F.when(F.size("names") == 0, "NORMAL").when((F.size("names") == 1) & F.get("names", F.lit(0)).isin("skip", "only", "todo"), F.upper(F.get("names", F.lit(0))))
    d = d.withColumn("modifier", modifier)
    fine = F.col("modifier").isNotNull() & ~F.col("tagged") & ~(F.col("twice") & ~F.col("parameterized")) & ~((F.col("api") == "describe") & ((F.col("modifier") == "TODO") | F.col("parameterized"))) & ~(F.col("parameterized") & (F.col("modifier") == "TODO"))
    d = _callbacks(toks, d.withColumn("supported", fine))
    literal = F.col("first.kind").isin("string", "template") & (F.coalesce(F.col("first.next"), F.lit(",")) == ",") & ~((F.col("first.kind") == "template") & F.col("first.t").contains("${"))
    title = F.when(literal, spelled(F.col("first.t")))
    d = d.withColumn("title", F.when((F.trim(title) != "") & (F.length(title) <= 1000), title))
    lam = F.coalesce(F.col("comma.behind").rlike(_LAMBDA), F.lit(False))
    d = _begin(F.col("comma"), toks, d.withColumns({"lambda": lam, "asynchronous": F.coalesce(F.col("comma.behind").startswith("async "), F.lit(False)), "more": F.coalesce("commas", F.lit(0)) > 0}), "enter")
    d = d.withColumn("enter", F.when(F.col("lambda"), F.col("enter"))).join(_at(toks, "enter", ["{", "=>"], enter_t="t", enter_close="close"), ["path", "enter"], "left")
    ends = toks.where("t = '('").select("path", F.col("i").alias("args"), F.col("close").alias("args_close")).join(_at(toks, "args_close", SHUTS, end="end", last="last"), ["path", "args_close"])
    d = d.join(ends, ["path", "args"])
    return d.select("path", "i", "up", "fresh", "api", "modifier", "parameterized", "supported", "title", "enter", (F.col("enter_t") == "{").alias("has_block"), "asynchronous", "more", "table", "table_close", "args", "args_close", "start", "end", "line", "last")


def _hooks(toks: DataFrame) -> DataFrame:
    """(path, up, i, kind, enter, start, end, supported): hooks that are statements of their block."""
    h = toks.where(F.col("t").isin(list(HOOKS)) & (F.col("next") == "(") & F.col("fresh")).select("path", "up", "i", F.col("t").alias("name"), F.col("next_i").alias("args"), "start")
    h = _callbacks(toks, h).join(toks.where("t = '('").select("path", F.col("i").alias("args"), F.col("close").alias("shut")), ["path", "args"]).join(_at(toks, "shut", SHUTS, end="end"), ["path", "shut"])
    sent = F.concat_ws(" ", F.when(F.col("first.t").isin("(", "["), F.concat(F.col("first.t"), F.lit(" "), F.col("first.behind"))).otherwise(F.concat_ws(" ", F.col("first.t"), F.col("first.behind"))))
    h = _begin(F.col("first"), toks, h.withColumn("supported", F.coalesce(sent.rlike(_LAMBDA) & (F.coalesce("commas", F.lit(0)) <= 1), F.lit(False))), "enter")
    kind = F.create_map(*[F.lit(x) for pair in HOOKS.items() for x in pair])
    return h.select("path", "up", "i", kind[F.col("name")].alias("kind"), F.when(F.col("supported"), F.col("enter")).alias("enter"), "start", "end", "supported")


def _effective(outer: Column, own: Column) -> Column:
    skip = (outer == "SKIP") | (own == "SKIP")
    return F.when(skip, "SKIP").when(own == "TODO", "TODO").when((outer == "ONLY") | (own == "ONLY"), "ONLY").otherwise("NORMAL")


def cases(toks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases (path, i, suites, blocks, title, modifier, declared, parameterized, identity, enter, ...) and diagnostics (path, code, n).

    ``suites`` are the titles of the enclosing suites, ``blocks`` where those begin.  A case takes SKIP, TODO and ONLY from its suites.
    Cases of one identity (suites and title) are all left out.  A declaration that is no statement of a suite or whose title,
    modifier or callback cannot be read is counted as unsupported, with those inside it.
    """
    every = cut(declarations(toks))
    front = toks.select("path").distinct().select("path", F.lit(-1).alias("up"), F.array().cast("array<string>").alias("suites"), F.array().cast("array<int>").alias("blocks"), F.lit("NORMAL").alias("outer"))
    found = None
    for level in range(MOST_SUITES + 1):
        here = cut(every.where("fresh AND supported AND title IS NOT NULL").join(front, ["path", "up"]).withColumn("effective", _effective(F.col("outer"), F.col("modifier"))))
        tested = here.where("api <> 'describe'")
        found = tested if found is None else found.unionByName(tested)
        deeper = here.where("api = 'describe' AND has_block AND NOT asynchronous")
        front = deeper.select("path", F.col("enter").alias("up"), F.concat("suites", F.array("title")).alias("suites"), F.concat("blocks", F.array(F.col("enter").cast("int"))).alias("blocks"), F.col("effective").alias("outer"))
        if level == MOST_SUITES or front.isEmpty():
            break
    read = found.where((F.col("modifier") == "TODO") & ~F.col("more") | (F.col("modifier") != "TODO") & F.col("enter").isNotNull())
    # A case that declares others inside is none.  Cases do not lie within one another otherwise: the last that began decides.
    spans = read.select("path", "i", F.struct(F.col("i").alias("of"), "args_close").alias("begun"))
    inner = every.select("path", "i").join(spans, ["path", "i"], "left").withColumn("now", F.last("begun", ignorenulls=True).over(Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)))
    holding = inner.where("i < now.args_close").select("path", F.col("now.of").alias("i")).distinct()
    read = cut(read.join(holding, ["path", "i"], "left_anti"))
    said = F.when(F.col("parameterized"), F.to_json(F.struct(F.col("suites").alias("s"), F.col("title").alias("t"), F.lit("PARAMETERIZED").alias("p")))).otherwise(F.to_json(F.struct(F.col("suites").alias("s"), F.col("title").alias("t"))))
    read = read.withColumn("identity", F.sha2(said.cast("binary"), 256))
    once = read.groupBy("path", "identity").agg(F.count(F.lit(1)).alias("n"))
    twice = once.where("n > 1")
    kept = read.join(once.where("n = 1").drop("n"), ["path", "identity"])
    suites = every.where("api = 'describe' AND supported AND title IS NOT NULL AND has_block AND NOT asynchronous AND fresh").select("path", F.col("enter").alias("up"), "i")
    reached = read.select("path", "i").unionByName(suites.join(read.select("path", F.explode("blocks").alias("up")).distinct(), ["path", "up"], "left_semi").select("path", "i"))
    empty = suites.join(every.select("path", "up").distinct(), ["path", "up"], "left_anti").select("path", "i")
    missed = every.join(reached.unionByName(empty), ["path", "i"], "left_anti").groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path", F.lit("JEST_UNSUPPORTED_DECLARATION").alias("code"), "n")
    repeated = twice.groupBy("path").agg(F.sum("n").alias("n")).select("path", F.lit("JEST_DUPLICATE_TEST_IDENTITY").alias("code"), "n")
    out = ["path", "i", "suites", "blocks", "title", F.col("effective").alias("modifier"), F.col("modifier").alias("declared"), "parameterized", "identity", "enter", "table", "table_close", "start", "end", F.col("line").alias("start_line"), F.col("last").alias("end_line")]
    return kept.select(*out), missed.unionByName(repeated)


def calls(toks: DataFrame) -> DataFrame:
    """(path, i, close, up, fn, chain, root, name, from_i, start, end, line, has_callback, goes_on): calls with the names that lead to them.

    ``chain`` has the callee's tokens with the insides of brackets left out, as in ``expect ( ) . not . toBe``.
    """
    member = ((F.col("kind") == "name") & ~F.col("t").isin(KEYWORDS)) | F.col("kind").isin("string", "template", "number", "regex") | F.col("t").isin(".", "?.", "!", "(", ")", "[", "]")
    stmt = Window.partitionBy("path", "up", "seg").orderBy("i")
    starts = toks.withColumn("member", member).withColumn("part", F.sum((~member).cast("int")).over(stmt.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sib_t = F.when(F.col("kind").isin("string", "template"), "S").otherwise(F.col("t"))
    run = Window.partitionBy("path", "up", "seg", "part", "member").orderBy("i")
    linked = starts.withColumns({"chain": F.concat_ws(" ", F.collect_list(sib_t).over(run.rowsBetween(Window.unboundedPreceding, -1))), "from_i": F.first("i").over(run), "chain_start": F.first("start").over(run), "chain_line": F.first("line").over(run), "head": F.first("prev").over(run)})
    shut = toks.where(F.col("t").isin(SHUTS)).select("path", F.col("i").alias("close"), "end", F.col("next").alias("then"), "behind")
    found = linked.where("t = '(' AND chain <> '' AND close IS NOT NULL").drop("behind", "end").join(shut, ["path", "close"])
    defines = F.coalesce(F.col("then").isin("=>", "{"), F.lit(False)) | F.coalesce(F.col("head") == "function", F.lit(False))
    made = (F.col("head") == "new") & ~F.col("chain").contains("(")
    found = found.where(~defines & ~F.coalesce(made, F.lit(False)))
    goes_on = F.coalesce(F.col("behind").rlike(r"^(\.|\?\.) [\w$#]+ \("), F.lit(False))
    return found.select("path", "i", "close", "up", "fn", "chain", F.split("chain", " ")[0].alias("root"), F.when(F.col("chain").rlike(r"(\.|\?\.) [\w$#]+$"), F.regexp_extract("chain", r"([\w$#]+)$", 1)).alias("name"), "from_i", F.col("chain_start").alias("start"), "end", F.col("chain_line").alias("line"), F.coalesce(F.col("next_enter") < F.col("close"), F.lit(False)).alias("has_callback"), goes_on.alias("goes_on"), F.coalesce("head", F.lit("")).alias("head"))


def variables(toks: DataFrame) -> DataFrame:
    """(path, name, i, fn, init, init_t, init_behind, type_behind, start, end, plain): variables declared one by one with what they begin with.

    ``plain``: the value holds no call, new, await or yield.
    """
    v = toks.where("prev IN ('const', 'let', 'var') AND kind = 'name'").select("path", "i", "up", "seg", "fn", F.col("t").alias("name"), "start", "behind")
    rest = toks.select("path", "up", "seg", F.col("i").alias("j"), F.col("t").alias("jt"), F.col("end").alias("j_end"), F.col("next_i").alias("j_next"))
    inner = v.join(rest, ["path", "up", "seg"]).where("j >= i AND jt <> ';'")
    told = inner.groupBy("path", "i").agg(F.max("j_end").alias("end"), F.max("j").alias("last_i"), F.min_by("j_next", F.when(F.col("jt") == "=", F.col("j"))).alias("init"))
    busy = F.col("t").isin("new", "await", "yield") | ((F.col("t") == "(") & (F.coalesce(F.col("prev"), F.lit("")).rlike(r"^[\p{L}_$#)\]]")))
    total = toks.select("path", F.col("i").alias("at"), F.sum(busy.cast("int")).over(Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("busy"))
    v = v.join(told, ["path", "i"]).join(_at(toks, "init", init_t="t", init_behind="behind"), ["path", "init"], "left")
    v = v.join(total.select("path", F.col("at").alias("i"), F.col("busy").alias("busy0")), ["path", "i"]).join(total.select("path", F.col("at").alias("last_i"), F.col("busy").alias("busy1")), ["path", "last_i"])
    return v.select("path", "name", "i", "fn", "init", "init_t", "init_behind", F.col("behind").alias("type_behind"), "start", "end", (F.col("init").isNotNull() & (F.col("busy0") == F.col("busy1"))).alias("plain"))


def imported(toks: DataFrame) -> DataFrame:
    """(path, name, how): names that a file imports, named or by default or as a namespace."""
    line = toks.where("t = 'import' AND up = -1").select("path", "seg", F.col("i").alias("import_i"))
    top = toks.where("up = -1").join(line, ["path", "seg"]).where("i > import_i AND kind = 'name' AND t NOT IN ('from', 'type', 'as')")
    outer = top.where("prev IN ('import', 'type', 'as', ',')").select("path", F.col("t").alias("name"), F.when(F.col("prev") == "as", "namespace").otherwise("default").alias("how"))
    braces = toks.where("t = '{' AND up = -1").join(line, ["path", "seg"]).select("path", F.col("i").alias("up"))
    inner = toks.join(braces, ["path", "up"]).where("kind = 'name' AND t NOT IN ('as', 'type') AND (next IS NULL OR next = ',')").select("path", F.col("t").alias("name"), F.lit("named").alias("how"))
    return outer.unionByName(inner)


def _arguments(toks: DataFrame, owners: DataFrame) -> DataFrame:
    """(path, i, place, start, end): the arguments of calls (path, i), from 1."""
    inside = toks.join(owners.select("path", F.col("i").alias("up")).distinct(), ["path", "up"])
    w = Window.partitionBy("path", "up").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = inside.withColumn("place", F.coalesce(F.sum((F.col("t") == ",").cast("int")).over(w), F.lit(0)) + 1).where("t <> ','")
    return placed.groupBy("path", F.col("up").alias("i"), "place").agg(F.min("start").alias("start"), F.max("end").alias("end"))


#: Assertions: expect, whatever lies between, and a matcher.
_OF_EXPECT = r"chain RLIKE r'^expect \( \)( (\.|\?\.) [\w$]+)+$'"


def _part_of() -> Column:
    """Whether a subject is a property or an element of something."""
    element = (F.col("e.t") == "]") & F.coalesce(F.col("e.prev2").rlike(r"^[\p{L}_$)\]]"), F.lit(False))
    return F.coalesce(((F.col("e.kind") == "name") & F.col("e.prev").isin(".", "?.")) | element, F.lit(False))


def _matcher_kind(matcher: Column, part: Column) -> Column:
    return (
        F.when(matcher.isin(COUNTS), "CALL_COUNT")
        .when(matcher.isin("toHaveBeenNthCalledWith", *INVOCATIONS), "INVOCATION_ARGUMENTS")
        .when(matcher.isin(EXCEPTIONS), "EXCEPTION")
        .when((matcher == "toHaveProperty") | (matcher.isin(RETURNS) & part), "STATE")
        .when(matcher.isin(RETURNS), "RETURN_VALUE")
    )


def _asserted(toks: DataFrame, c: DataFrame) -> DataFrame:
    """Calls of matchers with the ``expect`` that they belong to and its subject: first and last token, start and end."""
    expects = c.where("chain = 'expect'").select("path", "from_i", F.col("i").alias("expect_i"), F.col("close").alias("expect_close"))
    held = c.where(_OF_EXPECT).join(expects, ["path", "from_i"])
    last = F.struct("t", "prev", "kind", F.get("before", F.lit(1)).alias("prev2"))
    firsts = toks.where("prev IS NULL OR next IS NULL").groupBy("path", F.col("up").alias("expect_i")).agg(F.min_by(F.struct("i", "t", "kind", "behind", "arrow", "block"), "i").alias("s"), F.max_by(last, "i").alias("e"), F.min("start").alias("subject_start"), F.max("end").alias("subject_end"))
    return held.join(firsts, ["path", "expect_i"], "left")


def _vague(name: Column, kind: Column, silent: Column) -> Column:
    """Why an assertion says too little; null if it does not."""
    explicit = name.isin("toHaveProperty", "toHaveBeenNthCalledWith", *RETURNS)
    return F.when(name.isin(SNAPSHOTS), "SNAPSHOT_EXPECTATION_UNRESOLVED").when(kind.isNull(), "ASSERTION_SEMANTICS_UNRESOLVED").when(silent & explicit, "OUTCOME_NOT_EXPLICIT")


def assertions(files: DataFrame) -> DataFrame:
    """(path, subject, matcher, arguments, kind, unresolved, place): all assertions of files, numbered in their file.

    A returned value is state if the subject is a property or an element of something.
    """
    toks = by_path(with_functions(tokens(files)))
    held = _asserted(toks, calls(toks))
    said = toks.where("prev IS NULL OR next IS NULL").groupBy("path", F.col("up").alias("i")).agg(F.min("start").alias("said_start"), F.max("end").alias("said_end"))
    read = texts(held.join(said, ["path", "i"], "left"), files, ("subject", "subject_start", "subject_end"), ("arguments", "said_start", "said_end"))
    kind = _matcher_kind(F.col("name"), _part_of())
    place = F.row_number().over(Window.partitionBy("path").orderBy("start", "i"))
    told = read.select("path", F.coalesce("subject", F.lit("")).alias("subject"), F.col("name").alias("matcher"), F.coalesce("arguments", F.lit("")).alias("arguments"), kind.alias("kind"), place.alias("place"))
    return told.withColumn("unresolved", _vague(F.col("matcher"), F.col("kind"), F.col("arguments") == ""))


def claims(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What cases state, and what could not be read: claims (path, identity, title, kind, assertion_kind, source_text, line, start,
    end, invocation_start, assertion_start, subject) and diagnostics (path, code, n).

    Kinds are SETUP_HOOK, TEARDOWN_HOOK, INPUT, MOCK, ACTION, ASSERTION and EXPECTED_OUTCOME.  A case has the claims of its own
    function, of callbacks that its throwing assertions run, and of the hooks of its suites, but for their actions.  Assertions
    name the call that they are about, outcomes their assertion.  Skipped and open cases have none.
    """
    toks = by_path(with_functions(tokens(files.where(F.col("path").rlike(r"\.(spec|test)\.ts")))))
    found, diagnostics = cases(toks)
    found = cut(found)
    live = found.where("modifier NOT IN ('SKIP', 'TODO')")
    c, v, im = by_path(calls(toks)), by_path(variables(toks)), imported(toks)
    hooks = cut(_hooks(toks))

    # Which functions a case speaks for, and whether it acts in them.
    own = live.select("path", "identity", F.col("enter").alias("fn"), F.lit(True).alias("acts"))
    scopes = live.select("path", "identity", F.explode(F.concat(F.array(F.lit(-1)), "blocks")).alias("up"))
    hooked = scopes.join(hooks, ["path", "up"])
    by_hook = hooked.where("supported").select("path", "identity", F.col("enter").alias("fn"), F.lit(False).alias("acts"))

    asserted = by_path(_asserted(toks, c))
    thrown = asserted.where(F.col("name").isin(EXCEPTIONS))
    opening = F.concat_ws(" ", F.col("s.t"), F.col("s.behind"))
    inline = _begin(F.col("s"), toks, thrown.where(opening.rlike(_LAMBDA) & ~opening.startswith("async ")), "begin").select("path", "fn", "begin")
    named = thrown.where("s.kind = 'name' AND s.behind = ''").select("path", "fn", F.col("s.t").alias("name"))
    const = v.where(F.concat_ws(" ", "init_t", "init_behind").rlike(_LAMBDA) & (F.col("init_t") != "async")).join(_at(toks, "init", arrow="arrow", block="block"), ["path", "init"])
    const = _begin(F.struct("arrow", "block"), toks, const, "begin").select("path", "fn", "name", "begin")
    run = cut(inline.unionByName(named.join(const, ["path", "fn", "name"]).select("path", "fn", "begin")).distinct())
    by_throw = own.join(run, ["path", "fn"]).select("path", "identity", F.col("begin").alias("fn"), "acts")
    of = cut(own.unionByName(by_hook).unionByName(by_throw).distinct())

    # Mocks: of jest itself, of what jest made, and of variables that hold such.
    made = r"^jest (\.|\?\.) (fn|spyOn|mocked)\b"
    v_said = F.concat_ws(" ", "init_t", "init_behind")
    mocked = v.where(v_said.rlike(made)).select("path", F.col("name").alias("root"), F.lit("").alias("part"))
    typed = v.where(F.col("type_behind").rlike(r"^: jest \. Mocked\b") | F.col("type_behind").rlike(r"^: Mocked <")).select("path", F.col("name").alias("root"), F.lit("*").alias("part"))
    objects = v.where("init_t = '{'").select("path", F.col("name").alias("root"), F.col("init").alias("up"))
    parts = toks.where("kind = 'name' AND next = ':'").join(objects, ["path", "up"]).where(F.col("behind").rlike(r"^: jest \. (fn|spyOn|mocked)\b")).select("path", "root", F.col("t").alias("part"))
    mocks = mocked.unionByName(typed).unionByName(parts).distinct()
    part = F.regexp_extract("chain", r"^[\w$]+ (?:\.|\?\.) ([\w$]+) (?:\.|\?\.) ", 1)
    settings = c.where(F.col("name").isin(MOCK_SETTINGS)).withColumn("part", part)
    known = settings.join(mocks.withColumnRenamed("part", "known_part"), ["path", "root"], "left").groupBy("path", "i").agg(F.max(F.col("chain").rlike(made) | (F.col("known_part") == F.col("part")) | ((F.col("known_part") == "*") & (F.col("part") != ""))).alias("verified"))

    # Inside a mock's settings or an expected value nothing is an action.
    setting_spans = settings.select("path", F.col("i").alias("b"), F.col("close").alias("b_close")).unionByName(asserted.select("path", F.col("i").alias("b"), F.col("close").alias("b_close")))
    near = c.select("path", "i").unionByName(setting_spans.select("path", F.col("b").alias("i"))).distinct().join(setting_spans.withColumnRenamed("b", "i"), ["path", "i"], "left")
    reach = F.max("b_close").over(Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    sheltered = near.withColumn("reach", reach).select("path", "i", F.coalesce(F.col("i") < F.col("reach"), F.lit(False)).alias("sheltered"))

    sorted_out = c.join(known, ["path", "i"], "left").join(sheltered, ["path", "i"], "left")
    outer = c.select("path", F.col("i").alias("up"), F.col("chain").alias("outer"), F.col("root").alias("outer_root"))
    sorted_out = sorted_out.join(outer, ["path", "up"], "left")
    roots = v.groupBy("path", F.col("name").alias("root")).agg(F.max(F.col("init_t") == "new").alias("built"), F.max(F.col("init_t").rlike("^[\"'`0-9]")).alias("primitive"), F.max(F.concat_ws(" ", "init_t", "init_behind").rlike(r"^(await )?[\w$.]+( \. [\w$]+)* \( \)")).alias("called"))
    sources = im.groupBy("path", F.col("name").alias("root")).agg(F.min("how").alias("how"))
    sorted_out = sorted_out.join(roots, ["path", "root"], "left").join(sources, ["path", "root"], "left").join(sources.select("path", F.col("root").alias("outer_root"), F.col("how").alias("outer_how")), ["path", "outer_root"], "left")
    no = F.lit(False)
    chain = F.col("chain")
    asym = chain.rlike(rf"^expect( \. not)? \. ({'|'.join(ASYMMETRIC)})$")
    helper = F.col("root").isin(BUILT_IN) & chain.rlike(r"^[\w$]+( (\.|\?\.) [\w$]+)?$") & F.col("how").isNull()
    built = F.coalesce("built", no) & chain.rlike(r"^[\w$]+ (\.|\?\.) [\w$]+$")
    nested = F.col("outer").isNotNull() & (F.col("outer") != "expect") & (F.col("outer_how").isNotNull() | ~chain.contains(" ")) & ~built
    kind = (
        F.when(asym | helper, "NONE")
        .when(chain.rlike(r"^expect \( \)( (\.|\?\.) [\w$]+)* \[ \]$"), "DYNAMIC_MATCHER_NOT_ANALYZED")
        .when(F.expr(_OF_EXPECT), "ASSERTION")
        .when(chain == "expect", "NONE")
        .when(chain.rlike(rf"^jest \. ({'|'.join(MOCK_ROOTS)})$"), "MOCK")
        .when(F.col("name").isin(MOCK_SETTINGS), F.when(F.coalesce("verified", no), "MOCK").otherwise("MOCK_IDENTITY_UNRESOLVED"))
        .when(F.coalesce("sheltered", no) | F.col("has_callback") | F.col("root").isin(*APIS, *HOOKS), "NONE")
        .when(F.col("goes_on") | F.coalesce("primitive", no) | (F.col("root") == "S") | nested, "NONE")
        .when(built, "ACTION")
        .when(F.col("how").isNotNull(), F.when((F.col("how") == "named") & chain.rlike(r"^[\w$]+ (\.|\?\.) [\w$]+$") & (F.col("outer") == "expect"), "ACTION").otherwise("ACTION_RECEIVER_UNRESOLVED"))
        .when(~chain.contains(" ") & (F.col("head") == "="), "ACTION_RECEIVER_UNRESOLVED")
        .otherwise("ACTION")
    )
    judged = cut(sorted_out.withColumn("kind", kind).select("path", "i", "fn", "start", "end", "line", "kind", "name"))
    mine = judged.join(of, ["path", "fn"])
    none = F.lit(None)
    blank = {"assertion_kind": none.cast("string"), "invocation_start": none.cast("long"), "assertion_start": none.cast("long"), "subject_start": none.cast("long"), "subject_end": none.cast("long")}
    columns = ["path", "identity", "kind", "assertion_kind", "start", "end", "line", "invocation_start", "assertion_start", "subject_start", "subject_end", "step"]
    plain = mine.where(F.col("kind").isin("MOCK") | ((F.col("kind") == "ACTION") & F.col("acts"))).withColumns(blank).withColumn("step", F.lit(2)).select(*columns)

    # The call that an assertion is about: its subject, or the only value given to the name that is its subject.
    inner = c.select("path", F.col("from_i").alias("at"), F.col("start").alias("call_start"), F.col("i").alias("call_i"))
    longest = inner.groupBy("path", "at").agg(F.max_by("call_start", "call_i").alias("call_start"))
    single = v.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("init_t") == "await", F.col("init") + 1).otherwise(F.col("init"))).alias("init")).where("n = 1")
    about = asserted.withColumn("at", F.when(F.col("s.t") == "await", F.col("s.i") + 1).otherwise(F.col("s.i")))
    about = about.withColumn("sn", F.col("s.t")).join(longest, ["path", "at"], "left").join(single.select("path", F.col("name").alias("sn"), F.col("init").alias("init_i")), ["path", "sn"], "left")
    about = about.join(longest.select("path", F.col("at").alias("init_i"), F.col("call_start").alias("init_start")), ["path", "init_i"], "left")
    about = about.withColumns({"assertion_kind": _matcher_kind(F.col("name"), _part_of()), "invocation_start": F.coalesce("call_start", "init_start")})
    about = cut(about.select("path", "i", "fn", "name", "start", "end", "line", "assertion_kind", "invocation_start", "subject_start", "subject_end"))
    stated = about.join(of, ["path", "fn"])
    facts = stated.withColumns({"kind": F.lit("ASSERTION"), "assertion_start": none.cast("long"), "step": F.lit(2)}).select(*columns)
    args = _arguments(toks, about).join(about.select("path", "i", "name", "assertion_kind", "line", F.col("start").alias("assertion_start")), ["path", "i"])
    whole = about.join(args.select("path", "i").distinct(), ["path", "i"], "left_anti").where(F.col("assertion_kind").isin("CALL_COUNT", "INVOCATION_ARGUMENTS", "EXCEPTION") & (F.col("name") != "toHaveBeenNthCalledWith"))
    outcomes = args.where("assertion_kind IS NOT NULL").withColumn("assertion_kind", F.when((F.col("name") == "toHaveBeenNthCalledWith") & (F.col("place") == 1), "CALL_COUNT").otherwise(F.col("assertion_kind"))).select("path", "i", "assertion_kind", "start", "end", "line", "assertion_start")
    outcomes = outcomes.unionByName(whole.select("path", "i", "assertion_kind", "start", "end", "line", F.col("start").alias("assertion_start")))
    expected = outcomes.join(stated.select("path", "i", "identity"), ["path", "i"]).withColumns({"kind": F.lit("EXPECTED_OUTCOME"), "step": F.lit(2), "invocation_start": none.cast("long"), "subject_start": none.cast("long"), "subject_end": none.cast("long")}).select(*columns)

    at_line = toks.where("kind = 'name'").select("path", "start", "line")
    inputs = v.where("plain").join(of, ["path", "fn"]).join(at_line, ["path", "start"]).withColumns({**blank, "kind": F.lit("INPUT"), "step": F.lit(3)}).select(*columns)
    tables = live.where("parameterized").join(toks.select("path", F.col("up").alias("table"), F.col("start").alias("t0"), F.col("end").alias("t1"), "line"), ["path", "table"]).groupBy("path", "identity").agg(F.min("t0").alias("start"), F.max("t1").alias("end"), F.min("line").alias("line")).withColumns({**blank, "kind": F.lit("INPUT"), "step": F.lit(1)}).select(*columns)
    of_hooks = hooked.where("supported").select("path", "identity", "kind", "start", "end").join(at_line, ["path", "start"]).withColumns({**blank, "step": F.lit(0)}).select(*columns)

    every = plain.unionByName(facts).unionByName(expected).unionByName(inputs).unionByName(tables).unionByName(of_hooks)
    read = texts(every, files, ("source_text", "start", "end"), ("subject", "subject_start", "subject_end"))
    fits = F.length(F.trim("source_text")).between(1, MOST_TEXT) & (F.length("source_text") <= MOST_TEXT)
    read = read.withColumn("fits", fits)
    w = Window.partitionBy("path", "identity").orderBy("step", "start", "end", "kind", "assertion_kind")
    counted = cut(read.withColumn("n", F.sum(F.col("fits").cast("int")).over(w)))
    kept = counted.where(F.col("fits") & (F.col("n") <= MOST_CLAIMS))
    out = kept.join(found.select("path", "identity", "title"), ["path", "identity"]).select("path", "identity", "title", "kind", "assertion_kind", redacted(F.col("source_text")).alias("source_text"), "line", "start", "end", "invocation_start", "assertion_start", redacted(F.col("subject")).alias("subject"))

    # What was left out, by reason.
    gaps = [
        diagnostics,
        counted.where("NOT fits").groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path", F.lit("SOURCE_TEXT_LIMIT_EXCEEDED").alias("code"), "n"),
        counted.where(F.col("fits") & (F.col("n") > MOST_CLAIMS)).groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path", F.lit("CLAIM_LIMIT_EXCEEDED").alias("code"), "n"),
        hooks.where("NOT supported").groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path", F.lit("UNSUPPORTED_SETUP_HOOK").alias("code"), "n"),
    ]
    lost = mine.where(F.col("kind").isin("DYNAMIC_MATCHER_NOT_ANALYZED", "MOCK_IDENTITY_UNRESOLVED") | ((F.col("kind") == "ACTION_RECEIVER_UNRESOLVED") & F.col("acts"))).select("path", F.col("kind").alias("code"))
    with_args = args.select("path", "i").distinct().withColumn("has", F.lit(True))
    silent = stated.join(with_args, ["path", "i"], "left").withColumn("code", _vague(F.col("name"), F.col("assertion_kind"), F.col("has").isNull())).where("code IS NOT NULL").select("path", "code")
    adrift = stated.where("invocation_start IS NULL AND subject_start IS NOT NULL").select("path", F.lit("ASSERTION_INVOCATION_UNRESOLVED").alias("code"))
    begun = toks.where("enter").select("path", F.col("i").alias("begin"))
    outside = Window.partitionBy("path").orderBy("i")
    parent = toks.withColumn("around", F.lag("fn").over(outside)).where("enter").select("path", F.col("i").alias("begin"), F.col("around").alias("fn"))
    nested_fn = parent.join(begun, ["path", "begin"]).join(of, ["path", "fn"]).join(run.select("path", "begin").distinct(), ["path", "begin"], "left_anti").select("path", F.lit("NESTED_CALLBACK_NOT_ANALYZED").alias("code"))
    more = lost.unionByName(silent).unionByName(adrift).unionByName(nested_fn).groupBy("path", "code").agg(F.count(F.lit(1)).alias("n"))
    for g in gaps:
        more = more.unionByName(g)
    return out, more
