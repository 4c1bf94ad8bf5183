"""Documents with nulls in any column, empty and very long texts, repeated rows and clashing names."""

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards boil twelve quiet herbs near an old stone mill"
ROWS = [
    (1, PROSE, "en", "a"),
    (2, PROSE.upper(), None, "a"),
    (3, PROSE + " today", "en", None),
    (3, PROSE + " today", "en", None),
    (4, "", "en", "b"),
    (5, None, None, None),
    (None, PROSE, "en", "b"),
    (None, None, None, None),
    (6, LONG, "en", "b"),
    (7, " \t\n ", "en", "b"),
    (8, "Ünïcödé ÄÖ bob@x.org 😀", "de", "c"),
    (9, PROSE.upper(), "en", "c"),
]
#: Names that operators use inside.
EXTRA = ["id", "key", "n", "kept", "set_id", "regs", "score", "label", "component_id", "text_hash", "doc", "item", "level", "value", "host", "path", "digest", "part", "stats", "target", "row", "__id", "__key", "__hash", "__text_hash", "__row", "__x"]


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", *[f"'{c}' AS {c}" for c in EXTRA])


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", *[f"'{c}' AS {c}" for c in EXTRA])


def labels(spark, rows=((1, 1, 0), (2, 0, 0), (3, None, None), (None, 1, 0), (9, 0, 1), (9, 0, 1), (77, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
