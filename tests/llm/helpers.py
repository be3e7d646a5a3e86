"""Documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again until the night falls on the hill."),
    (2, None),
    (3, ""),
    (None, "A text without an id."),
    (4, "  \n\t "),
    (5, "word " * 30_000),
    (5, "word " * 30_000),
    (6, "héllo wörld ça va 中文 😀 — dash"),
    (7, "The quick brown fox jumps over the lazy dog again and again until the night falls on the hill."),
    (8, "x" * 100_000),
    (-9, "Licensed under the Apache License, Version 2.0.\nmail a.b@example.com or +1 (212) 555-0147, 10.0.0.1"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, kept boolean, words string, label int, row string, block int"


def documents(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, f"src{(i or 0) % 3}", len(t or ""), 0.5, 1, True, "w", 1, "r", 2) for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=((1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (5, 0, 0), (6, 1, 0), (7, 1, 0), (7, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def table_dir(tmp_path, spark, **tables):
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
