import pytest


@pytest.fixture(scope="session")
def tokenizer():
    return "/opt/tokenizers/byte_bpe_50k.json"
