import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, sig string"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def prose(rng, n, alphabet=("ba", "de", "fi", "go", "lu", "ma", "ne", "po", "ri", "su")):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, very short and long texts, ties, repeated rows, copies,
    and extra columns whose names clash with those of results."""
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    shared = prose(rng, 60)
    texts = [
        None, "", "   \n\t", "one", "one two three", "ONE two  three", base, base, base.upper(), " ".join(near),
        prose(rng, 40) + " " + shared + " " + prose(rng, 30), prose(rng, 25) + "\n" + shared + "\n" + prose(rng, 30),
        "x" * 1000, "ab " * 400, prose(rng, 20_000), "été Übermaß ñandú 漢字 \U0001f600 " * 30, "%%% ### !!!", "12345 67890", "<|endoftext|> a <|endoftext|>",
    ]
    rows = [(i, t, "en" if i % 2 else None, None, None if t is None else len(t), "clash", None) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base, None, None, None, None, None), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.rows = rows
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    from lakewright.llm.common import prepare, table

    prepare(spark)
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="session")
def tokenizer_json():
    from lakewright.llm.queries import tokenizer_path

    return tokenizer_path()
