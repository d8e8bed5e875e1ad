"""A small table with everything that may stand in a column."""

LONG = " ".join(f"w{i % 997}" for i in range(30_000))
PROSE = " ".join(f"alpha{i} beta{i}" for i in range(40))


def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns named like the operators' own."""
    rows = [
        (1, None, "en", "s1", 0), (2, "", "en", "s1", 0), (3, " \n\t ", "en", "s1", 4), (4, LONG, "en", "s1", len(LONG)),
        (5, PROSE, "en", None, 0), (5, PROSE, "en", None, 0), (6, PROSE + " ", "de", "s2", 0), (6, PROSE.replace(" ", "\n"), "de", "s2", 0),
        (None, PROSE, None, "s2", None), (None, None, None, None, None), (7, "one two", "en", "s3", 7), (8, "two one", "en", "s3", 7),
        (9, PROSE.replace("alpha7 ", "gamma "), "en", "s3", 0), (10, "é" * 60 + " ß", "de", "S3", 0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for c in ("KEPT", "measures", "key", "size", "mix_times", "dedup_key", "sid", "content", "shard", "bin"):
        df = df.selectExpr("*", f"'x' AS {c}")
    return df


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
