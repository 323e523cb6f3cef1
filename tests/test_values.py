import pytest

from plumbline.functions import values as V


@pytest.mark.parametrize("words,number", [("five", 5), ("twenty one", 21), ("two hundred and five", 205), ("three thousand four hundred", 3400), ("banana", None), ("hundred", 100)])
def test_number_words(words, number):
    assert V.number_of_words(words) == number


@pytest.mark.parametrize(
    "text,want",
    [
        ("It costs $1,200.50 a year", [("money", "1200.5")]),
        ("about 5k users", [("number", "5000")]),
        ("within 30 days of 2024-05-01", [("duration", "30"), ("date", "2024-05-01")]),
        ("grew by 12.5% since 1999", [("percentage", "12.5"), ("year", "1999")]),
        ("ten percent of version 2.1.3", [("percentage", "10"), ("version", "version 2.1.3")]),
        ("on March 3, 2020", [("date", "march 3, 2020")]),
        ("3 widgets", [("quantity", "3")]),
        ("", []),
        (None, []),
    ],
)
def test_mentions(text, want):
    got = V.mentions(text)
    assert [(m.kind, m.value) for m in got] == want
    assert all(text[m.start : m.end] == m.raw for m in got)


def test_alignment():
    at = V.mentions
    assert V.align(at("takes 30 days"), at("a period of 30 days")) == {"matches": 1, "conflicts": 0, "missing": 0}
    assert V.align(at("takes 30 days"), at("a period of 60 days")) == {"matches": 0, "conflicts": 1, "missing": 0}
    assert V.align(at("costs $5"), at("nothing")) == {"matches": 0, "conflicts": 0, "missing": 1}


def test_spark(spark):
    df = spark.createDataFrame([(1, "30 days"), (2, None), (3, "")], "id long, text string")
    assert [(r.id, r.kind) for r in V.value_mentions(df, key="id").collect()] == [(1, "duration")]
