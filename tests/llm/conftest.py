import pytest

#: Null, empty and very long texts, ties and repeated rows, null sources and languages; extra columns whose names operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, n long, size long, p double, bucket long, kept boolean, slot long, start long, shard long, h long"


def rows():
    base = "the quick brown fox jumps over the lazy dog and runs far away from here "
    texts = [
        None, "", "   \n\t ", "one", "One two", base * 2, base * 2, base.upper() * 2, base * 2 + "again", base * 3000, "mail me: a.b@c.example.org or +1 (613) 555-3280 now", "card 4111 1111 1111 1111, ip 10.0.0.255 and 1.2.3.400",
        "é ß 你好 \U0001f600 x́  y", "\x1c\x85 odd 's 't <|endoftext|> don't", "x" * 50_000, "a b c d e f g h " * 100, "line\nline\nline two\nline two\n",
    ]
    out = [(i, t, None if i % 5 == 0 else ("en" if i % 2 else "fr"), None if i % 4 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    out += [(5, texts[5], "en", "s1"), (40, texts[5], "en", None), (41, "quite another text with words of its own " * 3, "fr", "s1"), (None, "no id here", "en", "s1")]
    return [(*r, len(r[1] or ""), 1, 2, 3, 0.5, 4, False, 5, 6, 7, 8) for r in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
