"""Small documents with the hard cases, and the same with foreign columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHING = ("node", "comp", "bucket", "n", "ids", "score", "kept", "label", "part", "turn", "length", "spans", "weight",
            "target", "key1", "set", "a", "b", "was", "start", "tie")


def hard_documents():
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
    texts = [None, "", "   \t\n", "one", "one two three four five", "Straße  naïve　字 😀", "a ▁ b  c", "x<|endoftext|>y",
             "password = hunter2hunter2 and token: abcdefghij", long, "same text again " * 3, "same text again " * 3]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, "no id at all here", None, None, None), (None, "no id at all here", None, None, None)]


def frame(spark, rows, extra=False, schema=SCHEMA):
    made = spark.createDataFrame(rows, schema)
    return made.withColumns({c: F.lit("clash") for c in CLASHING if c not in made.columns}) if extra else made
