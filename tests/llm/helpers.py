"""Small tables for the operators' tests."""

import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=DOCS):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def docs(spark, texts, langs=None):
    """Documents of (id, text) pairs."""
    return frame(spark, [{"doc_id": i, "text": t, "lang": langs and langs.get(i), "source": "s", "n_chars": len(t or "")} for i, t in texts])


def save(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def real(name):
    """Rows of a real table, by DuckDB."""
    import duckdb

    return duckdb.connect().sql(f"select * from '{SF}/{name}.parquet'").df()


#: Cases that every operator has to stand: null, empty and long texts, null ids, repeated rows.
ODD = [(None, "one two three four five six"), (1, None), (2, ""), (3, " \t\n "), (4, "x " * 30_000), (5, "A b c d e f g"), (5, "A b c d e f g"), (5, "other text"), (None, None), (6, "!!! ... 123"), (7, "日本語 texte 𝒜 é")]
