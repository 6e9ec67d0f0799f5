import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names operators might use inside."""

    def build(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        frame = spark.createDataFrame(full, DOCUMENTS)
        if extra:
            for name in ("k1", "k2", "fp", "size", "n", "words", "line", "spans", "family", "shard", "toxicity", "_text"):
                frame = frame.selectExpr("*", f"'x' AS `{name}`")
        return frame

    return build
