import random

import pytest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, print long, spans string, rid long, items string, score double"


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None, 7, "x", 3, "y", 0.5)


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return lambda name: str(public_tokenizers.path(name))


@pytest.fixture(scope="session")
def odd_texts():
    """Texts with odd spaces, special strings, combining characters, long words and nothing."""
    rnd = random.Random(1)
    signs = [*"ab é's ll\n\t 12!,.\x1c\xa0　ñ你é́Σ \r\n  ", "<|endoftext|>", "<|startoftext|>", "  ", "\n\n ", "▁", " \n"]
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) for _ in range(300)] + ["", " ", "  ", "a ", " a", "a  ", "x" * 3000, "ab12" * 1000, "Hello, world. It's 2024!"]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """Nulls in every column, repeated rows, a very long text, and columns whose names the operators use."""
    rows = [row(i, t) for i, t in enumerate(odd_texts)]
    rows += [row(None, "no id"), row(9000, None), row(9001, "null tags", None, None), row(1, odd_texts[1]), row(9002, "word and word. " * 20_000)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
