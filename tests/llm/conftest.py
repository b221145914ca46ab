import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    """The smallest tables, by name."""
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
