"""A small table of documents with everything that can go wrong in it."""

from pyspark.sql import functions as F

LONG = "x" * 120_000 + " " + "word " * 30_000
TEXTS = [
    (1, "alpha beta gamma delta\nalpha beta gamma delta"), (1, "alpha beta gamma delta\nalpha beta gamma delta"), (2, None), (3, ""), (4, " \t\n\x0b \r\n"), (5, LONG), (None, "alpha beta gamma delta"), (None, None),
    (6, "<|endoftext|> é日本 \x1c \u0085 b"), (7, "1 2 3 !!"), (8, "One"), (-9, "One"), (10, "\n\n\n"),
]
#: Names that the operators use themselves.
CLASHES = ["_raw", "_keys", "kept", "keys", "n_words", "set_id", "score", "lang_pred", "rejected", "n_dropped", "ids", "piece", "length", "_n", "h1", "sig", "text_"]


def documents(spark):
    rows = [(i, t, "en" if k % 2 else None, "s", len(t or "")) for k, (i, t) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def none(df):
    return df.where("false")
