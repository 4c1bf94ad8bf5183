"""Source text as nested spans: tokens are rows, brackets pair by depth, structure is joins over them.

Files are dealt by path once, so many to a task that its tokens do not grow with the number of files.  One pattern cuts a text into tokens (strings in three quotes, templates with what they hold,
comments, regular expressions, names, marks), so nothing in a string or a comment is taken for code.  Running sums give
places, lines and depth; brackets of one depth pair in turn; what stands between a pair has the opening bracket as ``up``.
Statements of a bracket are numbered: they end with a semicolon, a closing brace, or a line's end where none can go on.

Memory is bounded by the longest file, of which the tokens are sorted by Spark.  What cannot be read is told by ``broken``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..operators.rounds import stored
from ..session import dealt_session


def _template(depth: int) -> str:
    """A template literal, with templates in its holes up to ``depth`` deep."""
    hole = r"[^{}`]" if depth == 0 else rf"[^{{}}`]|{_template(depth - 1)}|\{{[^{{}}]*+\}}"
    return rf"`[^`\\$]*+(?:(?:\\[\s\S]|\$\{{(?:{hole})*+\}}|\$)[^`\\$]*+)*+`"


#: A token (the first group) and the blanks behind it; every character is in one match.
TOKEN = "|".join(
    [
        r"//[^\n]*+",
        r"/\*(?:[^*]|\*(?!/))*+\*/",
        _template(2),
        r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"',
        r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'",
        r"(?=/)(?<=[(,=:\[!&|?{};]\s{0,9})/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+",
        r"#?[\p{L}_$][\p{L}\p{N}_$]*+",
        r"\p{N}[\p{L}\p{N}_.]*+",
        r"=>|\.\.\.|\?\.|&&|\|\||\?\?|[!=]==?",
        r"[\s\S]",
    ]
).replace("(?:[^*]|\\*(?!/))*+", "[^*]*+(?:\\*(?!/)[^*]*+)*+")
TOKEN = rf"({TOKEN})\s*+"

#: Words that stand before a member or a declaration and do not end it.
MODIFIERS = ["public", "private", "protected", "static", "async", "readonly", "override", "abstract", "declare", "export", "default", "get", "set"]
#: Words that are no names of values or calls.
KEYWORDS = ["if", "for", "while", "switch", "catch", "return", "throw", "await", "new", "typeof", "function", "class", "const", "let", "var", "case", "else", "do", "of", "in", "yield", "delete", "void", "instanceof", "import", "export", "default", "extends", "as", "satisfies", "try", "finally"]
#: Brackets, and what the ``close`` of one is, also of one that another kind of bracket shuts.
OPENS, SHUTS = ["(", "[", "{"], [")", "]", "}"]
_COLUMNS = ["path", "i", "kind", "t", "start", "end", "line", "last", "up", "close", "seg", "before", "prev", "prev_i", "next", "next_i", "deco", "fresh", "brace", "paren", "stop", "arrow", "block", "behind"]


#: Files and characters of a task: the tokens of so many are about 100 MB.
FILES_A_TASK, CHARACTERS_A_TASK = 1_000, 4_000_000


def parts(files: DataFrame) -> int:
    """How many parts the number and length of files ask for."""
    n = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("characters")).first()
    return 1 + n["files"] // FILES_A_TASK + n["characters"] // CHARACTERS_A_TASK


def dealt(files: DataFrame, n: int | None = None) -> DataFrame:
    """Files by path, in ``n`` parts or as many as they ask for; a part is not joined with others."""
    return files.repartition(n or parts(files), "path")


def by_path(rows: DataFrame, session: SparkSession | None = None) -> DataFrame:
    """``rows``, written, and dealt by path where they are read: joins and windows within files then deal them no more."""
    return stored(rows, session).repartition("path")


def _first(is_it: Column) -> Column:
    """The place of the next sibling that ``is_it``, this token included.

    Siblings are read from the last on: a running value costs each token once, a frame to the end would cost all that follow.
    """
    backwards = Window.partitionBy("path", "up").orderBy(F.col("i").desc())
    return F.min(F.when(is_it, F.col("i"))).over(backwards.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def lexed(files: DataFrame, n: int | None = None) -> DataFrame:
    """(path, i, kind, t, start, end, line, last): the tokens of files (path, content) but for comments, in order.

    Places are characters from 0, ``end`` exclusive; ``line`` and ``last`` count from 1.
    """
    # The blanks behind a token are no part of it; what is left out below may end with some of its own.
    each = dealt(files, n).select("path", F.posexplode(F.regexp_extract_all("content", F.lit(TOKEN), F.lit(0))).alias("i", "whole")).withColumn("t", F.rtrim("whole", F.lit(" \t\n\x0b\f\r")))

    def lines(c: str) -> Column:
        return F.length(c) - F.length(F.replace(F.col(c), F.lit("\n"), F.lit("")))

    head = F.substring("t", 1, 1)
    kind = (
        F.when(F.col("t").rlike(r"^(//|/\*)"), "comment")
        .when(head.isin("'", '"'), F.when(F.length("t") > 1, "string").otherwise("broken"))
        .when(head == "`", F.when(F.length("t") > 1, "template").otherwise("broken"))
        .when(F.col("t").rlike(r"^[\p{L}_$#]") & (F.col("t") != "#"), "name")
        .when(F.col("t").rlike(r"^\p{N}"), "number")
        .when((head == "/") & (F.length("t") > 1), "regex")
        .when(F.trim("t") == "", "blank")
        .otherwise("mark")
    )
    # Comments and blanks are left out, but for their lengths: they need not be sorted.
    told = each.select("path", "i", kind.alias("kind"), "t", F.length("whole").alias("__length"), lines("whole").alias("__lines"), F.length("t").alias("__own"), lines("t").alias("__last"))
    kept = ~F.col("kind").isin("comment", "blank") & F.col("t").rlike(r"\S")
    w = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = told.withColumn("t", F.when(kept, F.col("t"))).withColumns({"start": F.coalesce(F.sum("__length").over(w), F.lit(0)), "line": F.coalesce(F.sum("__lines").over(w), F.lit(0)) + 1})
    return placed.where("t IS NOT NULL").select("path", "i", "kind", "t", "start", (F.col("start") + F.col("__own")).alias("end"), "line", (F.col("line") + F.col("__last")).alias("last"))


def _nested(lx: DataFrame, *of_bracket: str) -> DataFrame:
    """Tokens with ``level`` and ``up``, the bracket that holds them (-1: none); ``of_bracket`` are columns that they take from it."""
    t = F.col("t")
    opens, shuts = t.isin(OPENS), t.isin(SHUTS)
    along = Window.partitionBy("path").orderBy("i")
    depth = F.sum(F.when(opens, 1).when(shuts, -1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lx = lx.withColumn("depth", depth - F.when(opens, 1).otherwise(0))
    # A bracket is a token of its level and the head of the one inside.
    as_token = F.struct(F.col("depth").alias("level"), F.lit(False).alias("head"))
    heads = F.when(opens, F.array(as_token, F.struct((F.col("depth") + 1).alias("level"), F.lit(True).alias("head")))).otherwise(F.array(as_token))
    both = lx.withColumn("x", F.explode(heads)).select("*", "x.level", "x.head").drop("x")
    level = Window.partitionBy("path", "level").orderBy("i")
    of = {"up": F.coalesce(F.last(F.when(F.col("head"), F.col("i")), ignorenulls=True).over(level), F.lit(-1))}
    of |= {c: F.last(F.when(F.col("head"), F.col(c)), ignorenulls=True).over(level) for c in of_bracket}
    return both.withColumns(of).where("NOT head").drop("head", "depth")


def _of_body() -> Column:
    """Whether a token opens a body, and not a type, an object or a pattern."""
    return (F.col("t") == "{") & ~F.coalesce(F.col("prev"), F.lit("")).isin("<", ":", ",", "|", "&", "=", "=>", "?", "...", "(", "extends", "keyof", "is")


def _stated(found: DataFrame, sib: WindowSpec) -> DataFrame:
    """Tokens with the number ``seg`` of their statement, whether it ``ends`` with them, and whether they are its first, ``fresh``."""
    t = F.col("t")
    goes_on = t.isin(MODIFIERS + KEYWORDS) | F.col("deco")
    line_end = (F.col("next_line") > F.col("last")) & (F.col("kind").isin("name", "string", "number", "template", "regex") | t.isin(")", "]")) & ((F.col("next_kind") == "name") | (F.col("next") == "@")) & ~goes_on & ~F.col("next").isin("extends", "implements", "of", "in", "as", "instanceof", "satisfies")
    ends = (t == ";") | ((t == "}") & ~F.coalesce(F.col("next").isin(")", ",", ".", "?.", ";", "(", "[", "from", "=", "&&", "||", "??", "?", ":", "===", "!==", "else", "catch", "finally", "while", "as", "satisfies", "{", ">", "|", "&"), F.lit(False))) | line_end
    found = found.withColumn("ends", ends)
    found = found.withColumns({"seg": F.coalesce(F.sum(F.col("ends").cast("int")).over(sib.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "fresh": F.coalesce(F.lag("ends").over(sib), F.lit(True))})
    return found


def tokens(files: DataFrame) -> DataFrame:
    """Tokens with their place in the tree of brackets; written, since a query reads them several times.

    They are read by a session whose shuffles have as many parts as the files ask for, and a part per core at least: equal
    texts leave small files, by which many rows would be put together in a task or broadcast.

    ``up`` is the enclosing bracket (-1: none), ``close`` the end of the bracket that a token opens, ``seg`` the statement
    within ``up``.  Of siblings: ``prev`` and ``next`` with their places, ``before`` (the three before, nearest first), ``behind`` (the
    nine behind, strings as S), and the next brace of a body, parenthesis, semicolon, arrow and block.
    """
    t = F.col("t")
    opens = t.isin(OPENS)
    n = parts(files)
    inner = _nested(lexed(files, n)).drop("level")

    sib = Window.partitionBy("path", "up").orderBy("i")
    sib_t = F.when(F.col("kind").isin("string", "template"), "S").otherwise(t)
    found = inner.withColumns(
        {
            "close": F.when(opens, F.lead("i").over(sib)),
            "prev": F.lag("t").over(sib),
            "prev_i": F.lag("i").over(sib),
            "next": F.lead("t").over(sib),
            "next_i": F.lead("i").over(sib),
            "next_line": F.lead("line").over(sib),
            "next_kind": F.lead("kind").over(sib),
            "before": F.array(*[F.coalesce(F.lag("t", k).over(sib), F.lit("")) for k in (1, 2, 3)]),
            "behind": F.concat_ws(" ", F.collect_list(sib_t).over(sib.rowsBetween(1, 9))),
        }
    )
    found = _stated(found.withColumn("deco", (F.get("before", F.lit(0)) == "@") | ((t == ")") & (F.get("before", F.lit(2)) == "@"))), sib)
    before = F.coalesce(F.col("prev"), F.lit(""))
    found = found.withColumns(
        {
            "brace": _first(_of_body()),
            "paren": _first(t == "("),
            "stop": _first(t == ";"),
            "arrow": _first(t == "=>"),
            "block": _first((t == "{") & before.isin("=>", ")")),
        }
    )
    spark = files.sparkSession
    return by_path(found.select(*_COLUMNS), dealt_session(spark, max(n, spark.sparkContext.defaultParallelism)))


def broken(toks: DataFrame) -> DataFrame:
    """(path, code, n): what the tokens of a file show to be unreadable: open quotes, brackets without their partners."""
    shut = F.create_map(F.lit("("), F.lit(")"), F.lit("["), F.lit("]"), F.lit("{"), F.lit("}"))
    closes = toks.where("t IN (')', ']', '}')").select("path", F.col("i").alias("close"), F.col("t").alias("by"))
    opened = toks.where("t IN ('(', '[', '{')").select("path", "i", "t", "close")
    pairs = opened.join(closes, ["path", "close"], "full").where(F.col("t").isNull() | F.col("by").isNull() | (F.get(F.array(shut[F.col("t")]), F.lit(0)) != F.col("by")))
    bad = toks.where("kind = 'broken'").select("path", F.lit("UNTERMINATED_TEXT").alias("code")).unionByName(pairs.select("path", F.lit("UNBALANCED_BRACKET").alias("code")))
    return bad.groupBy("path", "code").agg(F.count(F.lit(1)).alias("n"))


def spelled(literal: Column) -> Column:
    """What a string or template literal says."""
    inner = F.substr(literal, F.lit(2), F.length(literal) - 2)
    plain = F.replace(F.replace(inner, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
    return F.regexp_replace(plain, r"\\([\s\S])", "$1")


def texts(rows: DataFrame, files: DataFrame, *spans: tuple[str, str, str]) -> DataFrame:
    """``rows`` with the text of each span (name, start, end) of their files."""
    cut_out = {name: F.expr(f"substring(content, CAST({start} AS INT) + 1, CAST({end} - {start} AS INT))") for name, start, end in spans}
    return rows.join(files.select("path", "content"), "path").withColumns(cut_out).drop("content")


def _at(toks: DataFrame, on: str, of: list[str] | None = None, **columns: str) -> DataFrame:
    """A look-up of tokens by place: ``on`` is the name of the place, ``columns`` are the wanted ones by new names.

    ``of`` are the tokens that can stand there, so that others are not shuffled.
    """
    return (toks.where(F.col("t").isin(of)) if of else toks).select("path", F.col("i").alias(on), *[F.col(c).alias(n) for n, c in columns.items()])


# ---- classes ---------------------------------------------------------------------------------------------------------

VERBS = ["Get", "Post", "Put", "Patch", "Delete", "Head", "Options", "All"]


def _around(files: DataFrame, n: int | None) -> DataFrame:
    """Tokens that may declare or state something, or tell where such ends, with what stands around them; read in windows, without a join.

    ``paren`` is told of opening parentheses, ``body`` of braces of a body, ``at`` of decorators (name, arg), ``named`` of what may be a method's name, ``head`` is a
    class' name; ``begun`` is where their statement began.  Tokens in parentheses behind a name are ``called``: they may be parameters.
    """
    t, is_name = F.col("t"), F.col("kind") == "name"
    along = Window.partitionBy("path").orderBy("i")
    paren = t == "("
    lx = lexed(files, n).withColumns({f"f_{c}": F.lead(c).over(along) for c in ("i", "kind", "t", "start", "line")} | {"f_second": F.lead("i", 2).over(along), "b_end": F.lag("end").over(along), "b_t": F.lag("t").over(along), "b_kind": F.lag("kind").over(along), "b_deco": F.lag("t", 2).over(along)})
    # An opening parenthesis knows the token inside it, a closing bracket where the last inside ends.
    inside = F.struct(*[F.col(f"f_{c}").alias(c) for c in ("i", "kind", "t", "start", "line", "second")])
    called = F.when(t.isin(OPENS), paren & ((F.col("b_t") == ">") | ((F.col("b_kind") == "name") & ~F.col("b_t").isin(KEYWORDS) & ~F.col("b_deco").eqNullSafe("@"))))
    lx = lx.select("path", "i", "kind", "t", "start", "end", "line", "last", F.when(paren, inside).alias("inside"), F.when(t.isin(SHUTS), F.col("b_end")).alias("inner_end"), called.alias("called"))
    sib = Window.partitionBy("path", "level", "up").orderBy("i")
    lags = {f"p{k}": F.lag("t", k).over(sib) for k in (1, 2, 3)} | {"prev_end": F.lag("end").over(sib)}
    leads = {f"n{k}_{c}": F.lead(c, k).over(sib) for k, cs in ((1, ("i", "end", "last", "inside", "inner_end")), (2, ("i", "t", "inside", "inner_end")), (3, ("i", "start"))) for c in cs}
    found = _nested(lx, "called").withColumns(lags | leads | {"next": F.lead("t").over(sib), "next_line": F.lead("line").over(sib), "next_kind": F.lead("kind").over(sib)})
    deco = F.coalesce(F.col("p1") == "@", F.lit(False)) | F.coalesce((t == ")") & (F.col("p3") == "@"), F.lit(False))
    found = _stated(found.withColumns({"deco": deco, "prev": F.col("p1")}), sib)
    found = found.withColumn("begun", F.last(F.when(F.col("fresh"), F.struct("start", "line")), ignorenulls=True).over(sib.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    # By cheap tests: what none of the following can be true of is dropped before they are made.
    no = F.lit(False)
    found = found.where(F.coalesce("called", no) | t.isin("(", "{", ";", "@", "private", "protected", "class", "if", "case", "default", "catch", "throw") | F.coalesce(F.col("next").isin("(", "<"), no) | F.coalesce("ends", no) | F.col("n1_i").isNull())
    head = (t == "class") & is_name & (F.col("up") == -1) & ~F.coalesce(F.col("prev").isin(".", "=", "return", "(", "=>"), no) & F.col("next").rlike(r"^[\p{L}_$]") & ~F.col("next").isin("extends", "implements")
    # A parenthesis that ends before a name in the same statement is a decorator's.
    starts = F.col("fresh") | F.coalesce(F.col("prev").isin(*[m for m in MODIFIERS if m not in ("get", "set")], "*", ")"), no) | F.coalesce(F.col("p2") == "@", no)
    named = is_name & F.coalesce(F.col("next").isin("(", "<"), no) & starts & ~t.isin("constructor", *KEYWORDS)
    # Of the brackets behind a decorator's name: the first token, and how many there are, none, one or more.
    many = F.when(F.col("n2_inside.i").eqNullSafe(F.col("n3_i")), 0).when(F.col("n2_inside.second").eqNullSafe(F.col("n3_i")), 1).otherwise(2)
    arg = F.when(F.col("n2_t") == "(", F.struct("n2_inside.kind", "n2_inside.t", many.alias("n")))
    word = is_name & ~F.coalesce(F.col("prev").isin(".", "?."), no)
    a_label = (t == "case") | ((t == "default") & (F.col("next") == ":"))

    def span(kind, start, end, line) -> Column:
        return F.struct(kind.alias("kind"), F.col(start).alias("start"), end.cast("long").alias("end"), F.col(line).alias("line"))

    # if: what stands in its parentheses.  The ends of others are seen to later.
    branch = (
        F.when(word & (t == "if") & (F.col("next") == "(") & (F.col("n1_inside.i") < F.col("n2_i")), span(F.lit("IF"), "n1_inside.start", F.col("n2_inner_end"), "n1_inside.line"))
        .when(word & a_label, span(F.when(t == "case", "SWITCH_CASE").otherwise("SWITCH_DEFAULT"), "start", F.lit(None), "line"))
        .when(word & (t == "catch") & F.col("next").isin("(", "{"), span(F.lit("CATCH"), "start", F.lit(None), "line"))
        .when(word & (t == "throw"), span(F.lit("THROW"), "start", F.lit(None), "line"))
    )
    told = {
        "body": F.when(_of_body(), F.struct("i", F.col("n1_i").alias("close"), F.col("n1_end").alias("end"), F.col("n1_last").alias("last"), "prev_end")),
        "paren": F.when(paren, F.struct("i", F.col("n1_i").alias("close"), F.when(F.col("n2_t") == ":", F.col("n3_start")).alias("type_start"))),
        "at": F.when((t == "@") & F.col("n1_i").isNotNull(), F.struct(F.col("next").alias("name"), arg.alias("arg"))),
        "head": F.when(head, F.col("next")),
        "named": F.when(named, no),
        "scope": F.when(t.isin("private", "protected"), t),
        "branch": branch,
        "switch_end": F.when((t == "{") & (F.col("p1") == ")") & (F.col("p3") == "switch"), F.col("n1_inner_end")),
        "stop": F.when(t == ";", F.col("i")),
        "stmt_end": F.when(F.col("ends") | F.col("n1_i").isNull(), F.col("end")),
    }
    rows = found.select("path", "up", "seg", "i", "kind", "t", "start", "end", "deco", F.when(F.col("called"), no).alias("called"), F.when(branch.isNotNull(), F.col("prev_end")).alias("prev_end"), F.when(head | named, F.col("begun")).alias("begun"), *[c.alias(name) for name, c in told.items()])
    return rows


def declared(files: DataFrame, n: int | None = None) -> DataFrame:
    """Tokens that declare or state something: ``cls`` at the class that a file declares at its top, ``method`` at the name of a method of one.

    Both have (i, name, body, body_close, begin, end, first, last, decorators), a method also (paren, type_start, type_end, scope), and
    ``owner`` is its class (i, name, body, controller, service, entity).  ``branch`` (kind, start, end, line) is a condition or an exception handler, ``switch_end`` the
    end of what a switch's brace holds, and other tokens may be parameters.  A method has a body; constructors, accessors and signatures are none.
    """
    a = _around(files, n)
    # Siblings are read from the last on, so the last that was read is the next.
    back = Window.partitionBy("path", "up").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a = a.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in ("body", "stop", "stmt_end")})
    paren = F.when(F.col("paren").isNotNull() & F.col("body.close").isNotNull() & (F.col("stop").isNull() | (F.col("stop") > F.col("body.i"))), F.struct("paren", "body"))
    # The next parenthesis decides, also if it leads to no body.
    a = a.withColumn("sig", F.last(F.when(F.col("paren").isNotNull(), F.struct(paren.alias("x"))), ignorenulls=True).over(back)).withColumns({"paren": F.col("sig.x.paren"), "p_body": F.col("sig.x.body")})
    named, is_head = F.col("named").isNotNull() & F.col("paren.close").isNotNull(), F.col("head").isNotNull() & F.col("body.close").isNotNull()
    end = F.when(F.col("branch.kind") == "CATCH", F.when(F.col("body.close").isNotNull(), F.col("body.end"))).when(F.col("branch.kind") == "THROW", F.col("stmt_end")).otherwise(F.col("branch.end"))
    branch = F.when(F.col("branch").isNotNull() & ((F.col("branch.kind") != "CATCH") | end.isNotNull()), F.struct("branch.kind", "branch.start", end.alias("end"), "branch.line"))
    a = a.select("path", "up", "seg", "i", "kind", "t", "start", "end", "deco", "called", "prev_end", "begun", "head", "at", "scope", branch.alias("branch"), "switch_end", F.when(named, F.struct("paren", F.col("p_body").alias("body"))).alias("sig"), F.when(is_head, F.col("body")).alias("body"))
    a = a.where("called IS NOT NULL OR at IS NOT NULL OR scope IS NOT NULL OR branch IS NOT NULL OR switch_end IS NOT NULL OR sig IS NOT NULL OR body IS NOT NULL")

    # Of their statement so far.
    so_far = Window.partitionBy("path", "up", "seg").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a = a.withColumns({"decorators": F.collect_list("at").over(so_far), "scope": F.max("scope").over(so_far)})

    def declares(name: str, body: str, *more) -> Column:
        return F.struct("i", F.col(name).alias("name"), F.col(f"{body}.i").alias("body"), F.col(f"{body}.close").alias("body_close"), F.col("begun.start").alias("begin"), F.col(f"{body}.end").alias("end"), F.col("begun.line").alias("first"), F.col(f"{body}.last").alias("last"), "decorators", *more)

    cls = F.when(F.col("body").isNotNull(), declares("head", "body"))
    method = F.when(F.col("sig").isNotNull(), declares("t", "sig.body", F.col("sig.paren.i").alias("paren"), "sig.paren.type_start", F.col("sig.body.prev_end").alias("type_end"), "scope"))
    a = a.select("path", "up", "i", "kind", "t", "start", "end", "deco", "called", "prev_end", "branch", "switch_end", cls.alias("cls"), method.alias("method")).where("called IS NOT NULL OR branch IS NOT NULL OR switch_end IS NOT NULL OR cls IS NOT NULL OR method IS NOT NULL")

    def marked(*names: str) -> Column:
        return F.exists("cls.decorators", lambda d: d["name"].isin(*names))

    of_class = F.when(F.col("cls").isNotNull(), F.struct("i", "cls.name", "cls.body", marked("Controller").alias("controller"), marked("Injectable", "Catch").alias("service"), (marked("Entity") | F.col("path").contains(".entity.ts")).alias("entity")))
    along = Window.partitionBy("path").orderBy("i")
    held = a.withColumn("owner", F.last(of_class, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    held = held.withColumn("method", F.when(F.col("up") == F.col("owner.body"), F.col("method")))
    # Of names before one body, the first is the method.
    seen = F.last("method.body", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    return held.withColumn("method", F.when(~seen.eqNullSafe(F.col("method.body")), F.col("method")))


def _route(decorators: Column) -> tuple[Column, Column]:
    """The verb and the route of the first decorator that names them; the route is null where it is no single literal."""
    by = F.get(F.filter(decorators, lambda d: d["name"].isin(VERBS)), F.lit(0))
    arg = by["arg"]
    plain = (arg["n"] == 1) & ((arg["kind"] == "string") | ((arg["kind"] == "template") & ~arg["t"].contains("${")))
    return F.upper(by["name"]), F.when(arg.isNull() | (arg["n"] == 0), F.when(by.isNotNull(), "")).when(plain, spelled(arg["t"]))


def decorated(files: DataFrame) -> DataFrame:
    """(path, decorator, class_name, verb, route, handler): classes with each of their decorators, and their methods that a verb decorates."""
    verb, route = _route(F.col("method.decorators"))
    rows = declared(files).where("cls IS NOT NULL OR method IS NOT NULL").select("path", "owner", "cls", F.when(verb.isNotNull(), F.struct(verb.alias("verb"), route.alias("route"), F.col("method.name").alias("handler"))).alias("r"))
    one = rows.groupBy("path", F.col("owner.i").alias("i")).agg(F.first("owner.name").alias("class_name"), F.first("cls.decorators", ignorenulls=True).alias("decorators"), F.collect_list("r").alias("routes"))
    each = one.select("path", "class_name", F.explode("decorators").alias("d"), "routes").select("path", F.col("d.name").alias("decorator"), "class_name", F.explode_outer("routes").alias("r"))
    return each.select("path", "decorator", "class_name", "r.verb", "r.route", "r.handler")


def _part(name: str) -> Column:
    return F.col(f"part.{name}")


def artifacts(files: DataFrame, most: int = 20) -> DataFrame:
    """(path, type, symbol, signature, start_line, end_line, parameters, return_type, verb, route, conditions, handlers, excerpt_sha256).

    Entities are classes; methods of controllers (not private or protected) are routes, those of injectables and exception
    filters are service methods.  ``signature`` is the SHA-256 of the parameters' [rest, optional, type] as JSON.  Specs have none.
    Of parameters, conditions and exception handlers the first ``most`` are told.

    A file's tokens stay in the part that it was dealt to: an artifact is gathered from the rows of its parameters and branches there, and
    texts are cut out last, once a file.
    """
    code = files.where(~F.col("path").rlike(r"\.(spec|test)\.ts"))
    n = parts(code)
    d = declared(code, n)
    stands, controller = F.col("owner.entity"), F.col("owner.controller")
    wanted = ~stands & F.when(controller, F.col("method.scope").isNull()).otherwise(F.col("owner.service"))
    along = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("own", F.when(F.col("method").isNotNull() & wanted, F.col("method")))
    d = d.withColumn("of", F.last(F.when(F.col("own").isNotNull(), F.struct("own.i", "own.paren", "own.body", "own.body_close")), ignorenulls=True).over(along))
    inside = F.col("i").between(F.col("of.body"), F.col("of.body_close"))
    role = (
        F.when(F.col("cls").isNotNull(), F.when(stands, "ENTITY"))
        .when(F.col("own").isNotNull(), "METHOD")
        .when(F.col("up") == F.col("of.paren"), "PARAMETER")
        .when(inside & (F.col("switch_end").isNotNull() | F.col("branch.kind").startswith("SWITCH")), "LABEL")
        .when(inside & F.col("branch").isNotNull(), "BRANCH")
    )
    d = d.withColumn("role", role).where("role IS NOT NULL")
    verb, route = _route(F.col("own.decorators"))
    only = F.col("own").isNotNull() & controller
    symbol = F.concat_ws(".", "owner.name", "own.name")
    row = F.struct(
        F.when(F.col("role") == "ENTITY", "ENTITY").when(controller, "API_ROUTE").otherwise("SERVICE_METHOD").alias("type"), symbol.alias("symbol"), F.coalesce("own.first", "cls.first").alias("first"), F.coalesce("own.last", "cls.last").alias("last"),
        F.coalesce("own.begin", "cls.begin").alias("begin"), F.coalesce("own.end", "cls.end").alias("end"), "own.type_start", "own.type_end", F.when(only, verb).alias("verb"), F.when(only, route).alias("route"),
    )
    d = d.select("path", "role", F.when(F.col("role") == "ENTITY", F.col("i")).otherwise(F.col("of.i")).alias("of"), F.when(F.col("role") == "LABEL", F.when(F.col("switch_end").isNotNull(), F.col("i")).otherwise(F.col("up"))).otherwise(0).alias("key"), "i", "kind", "t", "start", "end", "deco", "prev_end", "branch", "switch_end", F.when(F.col("role").isin("ENTITY", "METHOD"), row).alias("row"))

    # Labels of a switch stand behind its brace; of parameters, commas within angles part none.
    group = Window.partitionBy("path", "of", "role", "key").orderBy("i")
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    is_part = F.col("role") == "PARAMETER"
    angle = F.coalesce(F.sum(F.when(~is_part, 0).when(F.col("t") == "<", 1).when(F.col("t") == ">", -1).otherwise(0)).over(before), F.lit(0))
    d = d.withColumns({"angle": angle, "until": F.lead("prev_end").over(group), "held": F.first("switch_end").over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    flat = is_part & (F.col("angle") <= 0)
    comma = flat & (F.col("t") == ",")
    place = F.when(is_part, F.coalesce(F.sum(comma.cast("int")).over(before), F.lit(0))).otherwise(F.col("i"))
    # What was seen of a parameter so far: a colon before this token, a colon or an equals sign up to it.
    upto = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def last(mark: str, frame: WindowSpec) -> Column:
        return F.coalesce(F.last(F.when(flat & (F.col("t") == mark), F.col("i")), ignorenulls=True).over(frame), F.lit(-1))

    d = d.withColumns({"place": place, "comma": last(",", upto), "colon": last(":", upto), "colon_before": last(":", before), "equal": last("=", upto)})
    d = d.where(~comma & ((F.col("role") != "LABEL") | (F.col("branch").isNotNull() & F.col("held").isNotNull())))
    colon, colon_before, equal = [F.col(c) > F.col("comma") for c in ("colon", "colon_before", "equal")]
    i, t = F.col("i"), F.col("t")
    named = is_part & (F.col("kind") == "name") & ~F.col("deco") & ~colon & ~equal & ~t.isin("readonly", "public", "private", "protected", "override")
    typed = is_part & colon_before & ~equal
    rest = t == "..."
    each = d.groupBy("path", "of", "role", "key", "place").agg(
        F.struct(
            F.max_by(F.when(named, t), F.when(named, i)).alias("name"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.min(F.when(~colon & t.isin("{", "["), F.col("start"))).alias("from"),
            F.max(F.when(~colon & t.isin("}", "]"), F.col("end"))).alias("to"),
            F.min(F.when(typed, F.col("start"))).alias("type_start"),
            F.max(F.when(typed, F.col("end"))).alias("type_end"),
            F.max(rest).alias("rest"),
            F.max(rest | ((t == "?") & ~colon) | equal).alias("optional"),
        ).alias("part"),
        F.first("row").alias("row"),
        F.first(F.struct("branch.kind", "branch.start", F.coalesce("branch.end", "until", "held").alias("end"), "branch.line")).alias("branch"),
    )
    sort = F.struct("place", *[_part(c) for c in ("name", "start", "end", "from", "to", "type_start", "type_end", "rest", "optional")])
    found = each.groupBy("path", "of").agg(
        F.first("row", ignorenulls=True).alias("row"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "PARAMETER", sort))).alias("p"),
        F.sort_array(F.collect_list(F.when(F.col("role").isin("LABEL", "BRANCH"), F.struct("branch.start", "branch.kind", "branch.end", "branch.line")))).alias("b"),
    )
    whole = found.join(dealt(code, n).select("path", "content").hint("merge"), "path")

    def cut_out(x, start: str, end: str) -> Column:
        return F.substr(F.col("content"), (x[start] + 1).cast("int"), (x[end] - x[start]).cast("int"))

    def parameter(x) -> Column:
        return F.struct(F.coalesce(x["name"], cut_out(x, "from", "to")).alias("name"), F.coalesce(cut_out(x, "type_start", "type_end"), F.lit("UNDECLARED")).alias("type_text"), cut_out(x, "start", "end").alias("source_text"))

    def shape(x) -> Column:
        as_json = F.to_json(F.struct(F.coalesce(cut_out(x, "type_start", "type_end"), F.lit("")).alias("t")))
        return F.concat(F.lit("["), x["rest"].cast("string"), F.lit(","), x["optional"].cast("string"), F.lit(","), F.regexp_extract(as_json, r"^\{\"t\":([\s\S]*)\}$", 1), F.lit("]"))

    def branches(keep) -> Column:
        return F.transform(F.slice(F.filter("b", keep), 1, most), lambda x: F.struct(x["kind"].alias("kind"), cut_out(x, "start", "end").alias("source_text"), x["line"].alias("line")))

    caught = ["CATCH", "THROW"]
    signature = F.sha2(F.concat(F.lit("["), F.concat_ws(",", F.transform("p", shape)), F.lit("]")).cast("binary"), 256)
    of_method = {
        "signature": signature,
        "parameters": F.transform(F.slice("p", 1, most), parameter),
        "return_type": cut_out(F.col("row"), "type_start", "type_end"),
        "verb": F.col("row.verb"),
        "route": F.col("row.route"),
        "conditions": branches(lambda x: ~x["kind"].isin(caught)),
        "handlers": branches(lambda x: x["kind"].isin(caught)),
    }
    excerpt = F.sha2(cut_out(F.col("row"), "begin", "end").cast("binary"), 256).alias("excerpt_sha256")
    return whole.select("path", "row.type", "row.symbol", F.col("row.first").alias("start_line"), F.col("row.last").alias("end_line"), *[F.when(F.col("row.type") != "ENTITY", c).alias(name) for name, c in of_method.items()], excerpt)
