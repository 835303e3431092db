"""Rows with everything an operator has to survive, and plain re-statements of the contracts."""
import os

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

LONG = "wort " * 30_000 + "x" * 200_000
#: doc_id, text, lang, source, n_chars, block, comp: nulls, empty and long texts, repeated rows, equal ids, names that operators use.
ODD = [
    (1, "The same text twice, word for word and line for line.", "en", "a", 1, 7, "x"),
    (1, "The same text twice, word for word and line for line.", "en", "a", 1, 7, "x"),
    (1, "Another text of the same number.", "en", None, 1, 7, "x"),
    (2, "The same text twice, word for word and line for line.", None, "b", 1, None, None),
    (3, None, "fr", "b", None, 7, "x"),
    (4, "", "fr", "c", 0, 7, "x"),
    (5, " \t\n\x0b\x0c\r ", None, None, 7, 7, "x"),
    (6, LONG, "de", "c", 350_000, 7, "x"),
    (7, "1234 !!! 99", None, "d", 11, 7, "x"),
    (None, "Text ohne Nummer, aber mit Worten.", "de", "d", 1, 7, "x"),
    (8, "é́ 日本語 🙂 \x1c\x85 z", None, "é", 12, 7, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, comp string"


CLASHING = "lang_pred score copies col size target taken row_a row_b __id __row n_shingles component_id signature node comp_ spans kept piece".split()


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(1) for c in CLASHING})


def none(spark):
    return odd(spark).limit(0)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(docs):
    """(doc_id, text) of all rows by doc_id, null texts empty."""
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def have_tables():
    return os.path.exists(SF)
