"""Small document tables with every awkward case, for the operators' tests."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, slot long, word string"
AWKWARD = [None, "", " \n\t ", "one", "one two three", "x" * 5000, "word " * 30_000, "é ü 　 漢字 \x85 end", "same text here again and again", "same text here again and again", "\r\n a\tb \x0b c"]


def documents(spark, texts=None, repeat=True):
    texts = AWKWARD if texts is None else texts
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", None if t is None else len(t), 7, 7, "w") for i, t in enumerate(texts)]
    if repeat and texts:
        rows += [rows[-1], (None, "no id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
