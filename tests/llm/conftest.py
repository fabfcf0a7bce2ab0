import pytest

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, node string, label string",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "pages": "page_id bigint, url string, html string, digest string, member string",
}


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables, some columns of which have names that operators use within, and returns their folder."""

    def make(**tables):
        for name, rows in tables.items():
            schema = SCHEMAS[name]
            width = schema.count(",") + 1
            rows = [(*r, *[None] * (width - len(r))) for r in rows]
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
