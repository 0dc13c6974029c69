"""Rows that no operator may stumble over: nulls, empty and very long texts, ties, repeats, clashing columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves, or add.
CLASHING = ["h", "g", "root", "code", "sketch", "id", "node", "copy", "shard", "shard_id", "n_lines", "n_dropped", "tokens", "bin", "take", "k", "a", "b", "value", "count", "x", "w", "d0", "doc", "s", "e", "__ql_id", "__QL_H", "__ql_1", "__ql_d0", "__ql_t", "__ql_spans", "__ql_0", "column_0"]

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu".split()


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "ing", "er", "ly"]) for _ in range(n))


def messy():
    base = prose(1, 120)
    rows = [
        (1, base, "en", "web"), (2, base, "en", "web"), (3, base.replace("alpha", "omega", 1) + " end", "en", "books"),
        (4, None, "en", "web"), (5, "", "en", "web"), (6, "   \n\t ", None, None), (None, prose(2, 80), None, "web"), (None, prose(2, 80), None, "web"),
        (7, prose(3, 60_000), "en", "web"), (8, "x" * 50_000, "zz", "web"), (9, prose(4, 70), "en", None), (9, prose(4, 70), "en", None), (9, prose(5, 70), "fr", "web"),
        (10, "one", "en", "web"), (11, "日本語 テキスト 🙂", "ja", "web"), (12, "\n\n\n", "en", "web"), (None, None, None, None), (-5, prose(6, 40), "en", "a'b\"c"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def frame(spark, rows=None, clash=False):
    df = spark.createDataFrame(messy() if rows is None else rows, DOCS)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(CLASHING)])
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
