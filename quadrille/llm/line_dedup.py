"""Line dedup: lines that many documents share are dropped, and the rest put together again in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, guarded, hash128, without

#: A line in at least so many documents is boilerplate.
MIN_DOCS = 10


def normalised(line: Column) -> Column:
    """Lower case; runs of blanks, tabs, returns, form feeds, vertical tabs and no-break spaces as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"[ \t\r\f\x0B\xA0]+", " "))


def line_keys(text: Column) -> Column:
    """128-bit keys of the normalised lines, by position."""
    return F.transform(F.split(text, "\n"), lambda x: F.struct(*[h.alias(n) for h, n in zip(hash128(normalised(x)), "ab")]))


def shared_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n_docs) of each line key that at least min_docs distinct documents have.

    Lines count once per document. A row with a null id is a document of its own. Only hashes are shuffled, and counts are
    combined before the shuffle. Where ids repeat, (line, id) pairs are made distinct first; the
    check for that reads the id column alone."""
    blank = [h.alias(n) for h, n in zip(hash128(F.lit("")), "ab")]
    lines = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(line_keys(F.col(text_col)))).alias("k"))
    lines = lines.select("id", "k.a", "k.b").where(~((F.col("a") == blank[0]) & (F.col("b") == blank[1])))
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null")
    if not ids.groupBy("id").count().where("count > 1").isEmpty():
        lines = lines.where("id is not null").distinct().unionByName(lines.where("id is null"))
    return lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)


@guarded
def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, with lines in min_docs or more documents dropped from text, and
    n_lines and n_dropped added (columns of these names in docs are replaced).

    A line is what stands between line feeds; lines match if they are equal in lower case with white
    space runs collapsed. Blank lines are kept and never counted. A null text stays null with 0 lines; an
    empty text stays empty. Rows with a repeated id count as one document and each keep their row; rows
    with a null id count as a document each. Texts whose lines all go become ''.

    The lines that go are looked up by key and gathered per row key, so that only rows which have one
    are joined; texts are shuffled once, and hot lines only as small keys that adaptive execution can split."""
    spark = docs.sparkSession
    hot = Table(shared_lines(docs, min_docs, id_col, text_col), "hot_lines")
    docs = without(docs, "n_lines", "n_dropped")
    text = F.col(text_col)
    # hot keys per distinct text: a text is its own key, as rows with a null or repeated id must be told apart
    key = [F.xxhash64(text).alias("__ql_t"), F.xxhash64(F.lit(7), text).alias("__ql_u")]
    pairs = docs.select(*key, F.explode(F.array_distinct(line_keys(text))).alias("k")).select("__ql_t", "__ql_u", "k.a", "k.b")
    small = hot.bytes() * 4 <= 8 << 20
    drops = pairs.join(F.broadcast(hot.df) if small else hot.df, ["a", "b"], "left_semi")
    drops = drops.groupBy("__ql_t", "__ql_u").agg(F.collect_set(F.struct("a", "b")).alias("__ql_hot"))
    out = docs.withColumns({"__ql_t": key[0], "__ql_u": key[1]}).join(drops, ["__ql_t", "__ql_u"], "left")
    lines = F.split(text, "\n")
    kept = F.filter(
        F.arrays_zip(lines.alias("line"), line_keys(text).alias("k")),
        lambda x: ~F.array_contains(F.col("__ql_hot"), x["k"]),
    )
    dropped_text = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_kept = F.when(F.col("__ql_hot").isNull(), n_lines).otherwise(F.size(kept)).cast("long")
    cols = [
        (F.when(F.col("__ql_hot").isNull(), text).otherwise(dropped_text).alias(c) if c == text_col else F.col(f"`{c}`"))
        for c in docs.columns
    ]
    return out.select(*cols, n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"))
