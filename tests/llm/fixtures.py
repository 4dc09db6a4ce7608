"""Small documents with the cases that every operator has to take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, id string"


def documents(spark, texts, sources=None):
    """Rows of documents with two more columns whose names operators use themselves."""
    rows = [(k, t, "en", sources[k] if sources else f"src{k % 3}", None, "x", "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [
    None, "", " ", "a  b\t\tc", "it's 'tis we'll\n\n x", "  lead", "trail \n", "a" * 3000, "ab" * 400 + " é漢字" * 50, "x y 　 z", "\0a b",
    "<|endoftext|> hi", "123456 7 8\r\nq", "!!!???" * 40, "​ zero", "I'M don't 'S", "one", "one", "The same line again.\n" * 30, "The same line again.\n" * 30,
]
