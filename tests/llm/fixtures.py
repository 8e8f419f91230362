"""Small tables for the operators' tests, and plain versions of the shared definitions."""
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"

#: Columns of `documents`, and more whose names clash with the operators' own.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, row string, size long, kept string"


def prose(seed: int, n: int) -> str:
    import random
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ta", "ri", "mo", "su", "len", "ka", "bor", "wi"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows, copies and near copies."""
    long, near = prose(1, 4000), prose(2, 120)
    texts = [(1, "alpha beta gamma"), (2, "alpha beta gamma"), (3, None), (4, ""), (5, " \t\n"), (6, long), (7, long),
             (8, near), (9, near + " tail"), (None, near), (None, "alpha beta gamma"), (None, None), (10, "alpha"), (11, "ALPHA"),
             (12, "a\nb\na\n\n"), (12, "a\nb\na\n\n"), (13, prose(3, 80)), (13, prose(4, 80)), (14, prose(5, 60)), (14, prose(5, 60))]
    return [(i, t, "en", None if k % 7 == 3 else f"s{k % 3}", None, k, f"k{k}", "r", None, "x") for k, (i, t) in enumerate(texts)]


def documents(spark, rows=None):
    return spark.createDataFrame(edge_rows() if rows is None else rows, EXTRA)


def simple(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs],
                                 "doc_id long, text string, lang string, source string, n_chars long")


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, host string, rule string")


def labels(spark, rows):
    return spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.LongType()),
                                                     T.StructField("toxic", T.LongType()), T.StructField("text", T.StringType())]))


def corpus():
    """(doc_id, text) of the smallest documents table."""
    import duckdb
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
