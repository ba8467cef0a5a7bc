"""Documents with nulls, empty and very long texts, repeated rows, ties, and columns whose names the operators use themselves."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, id string, part string, n_words string, `odd.name` string"
LONG = "lange Wörter und kurze " * 9000


def rows():
    made = [(1, None), (2, ""), (3, "   \n\t"), (4, "one two three"), (5, "one two three"), (6, LONG), (6, LONG), (7, "déjà vu — 東京 'quoted' <|endoftext|> done"), (None, "no id at all here"), (None, None)]
    return [(i, t, None, "s", None, "x", "y", "z", "w", "v") for i, t in made]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
