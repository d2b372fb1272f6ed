import pytest

#: Rows for edge cases: nulls, empty and very long texts, ties and repeated rows.
TEXTS = [
    (1, "The cat sat on the mat and looked at the moon all night long"),
    (2, "the cat sat on the mat and looked at the moon all night LONG"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "one two"),
    (7, "One TWO"),
    (8, "word " * 20000),
    (8, "word " * 20000),
    (None, "The cat sat on the mat and looked at the moon all night long"),
    (None, None),
    (9, "x" * 50000),
    (10, "Grüße 𝔘nicode ﬁ é é   日本語 <|endoftext|> ▁ \x1c'll o'clock 3.14!! ...,"),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="session")
def edge(spark):
    """Edge-case documents with extra columns whose names the operators use themselves."""
    names = ("id", "n", "t", "label", "node", "score", "rank", "host", "component", "component_id", "log_odds", "octavo_id", "spans")
    df = spark.createDataFrame(TEXTS, SCHEMA).repartition(3)
    from pyspark.sql import functions as F

    for name in names:
        df = df.withColumn(name, F.lit(name))
    return df.withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit("en"))


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
