"""Small tables with the odd cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

ODD = [
    (1, "One line.\nAnother line here for all sites to see.\nLast words of it.", "en", "a", 10), (2, "One line.\nAnother line here for all sites to see.\nLast words of it.", "en", "b", 10),
    (3, None, "en", "a", 0), (4, "", "en", "c", 0), (None, "a text without an id, of some words", "en", None, 5), (5, " \n\t ", None, "d", 3), (6, "word", "en", "a", 4),
    (7, "x" * 5000 + " " + "long words " * 3000, "en", "b", 1), (8, "Ünïcode ñandú – “quoted” 日本語 🙂 text", "fr", "c", 1), (9, "same", "en", "a", 4), (9, "same", "en", "a", 4), (9, "other", "en", "a", 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, or give to what they return.
CLASH = (
    "size", "token", "sig", "n", "comp", "bucket", "_r", "_k", "h", "g", "line", "site", "keeper", "length", "shard", "key", "w", "a", "b", "u", "v", "id", "x", "y", "mark", "m", "chosen",
    "_score", "score", "quality_score", "_gone", "gone", "_key", "_mine", "_gkey", "_n_removed", "_n_lines", "n_lines", "n_removed", "_kept", "_left", "_lines", "_removed", "_id", "_y", "_t", "_n",
    "_i", "_w", "_own", "_ghost", "_next", "_e", "_x", "_s", "_u", "_units", "_v", "_h", "_at", "_token", "_rule", "_best", "_chunk", "_before", "_rank", "item", "item_id", "passage", "near", "node", "root", "rep",
)


def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    for c in CLASH:
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit("x"))
    return df


def empty(spark):
    return odd(spark).limit(0)
