"""A small table with every awkward row, and columns that clash with names the operators use."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 997} of{i}" for i in range(30_000))
CLEAN = ("The river ran past the old mill and under the bridge. Boats came up from the coast in "
         "spring, and people walked along the bank to watch them. Nobody knew how long the mill had "
         "stood there, but it had survived two floods and a fire, and its wheel still turned "
         "whenever the water was high enough to reach it in the morning.")

ROWS = [
    (None, None, None, None), (None, "text without id", "en", "s"), (1, None, "en", "s"),
    (2, "", "en", None), (3, "   \n\t ", "de", "s"), (4, "one", "en", "s"), (5, LONG, "en", "s"),
    (6, CLEAN, "en", "s"), (6, CLEAN, "en", "s"), (7, CLEAN, "en", "t"), (7, "other text", "en", "t"),
    (8, "a\x00b \U0001f600 ▁   é password=abcdef123", "fr", "t"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = ("spans candidate mask score predicted part block fp bucket unit tokens key template "
            "value place word n start version op seq a b node root least component_id").split()


def documents(spark, rows=ROWS):
    out = spark.createDataFrame(rows, SCHEMA)
    return out.withColumns({c: F.lit("x") for c in CLASHING})


def ids(rows):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in rows)


LARGE = [(None, "a text without an id"), *[(2**60 + 1 + i, f"text number {i} of several, all of them apart "
                                            f"x{i * 7919} y{i * 104729} z{i}") for i in range(40)]]


def large_ids(spark):
    """Ids that no float holds, beside a NULL, in one partition."""
    return spark.createDataFrame(LARGE, "doc_id long, text string").withColumns(
        {"source": F.lit("s"), "lang": F.lit("en"), "n_chars": F.length("text")}).coalesce(1)
