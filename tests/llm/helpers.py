"""Small tables with the odd rows that every operator has to take."""

ODD_TEXTS = [None, "", " \n\t ", "one", "a b c", "!!! ??? ###", "x" * 5000, "word " * 3000, "İstanbul ß Σς ́ é \U0001F600 中文 text", "tab\tnew\nline\r\n end"]


def documents(spark, texts, extra=False, ids=None):
    """A documents table; ``extra`` adds columns whose names operators use inside."""
    rows = [(i if ids is None else ids[i], t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    if extra:
        rows = [(*r, "k", 1.0, 7, "n", "b") for r in rows]
        schema += ", key string, score double, node bigint, n string, bands string"
    return spark.createDataFrame(rows, schema)


def write_tables(spark, folder, **tables):
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
