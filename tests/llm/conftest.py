import pytest


@pytest.fixture(scope="session")
def docs(spark):
    def make(*rows):
        """rows: texts, or (doc_id, text, lang)."""
        full = [(*r, "s", len(r[1] or "")) if isinstance(r, tuple) else (k, r, "en", "s", len(r or "")) for k, r in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
