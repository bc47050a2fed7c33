"""Personal numbers in less common forms."""

import re

import pytest

from vaksetu.llm import pseudonyms


def luhn(s):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(re.sub("[^0-9]", "", s))))) % 10


@pytest.fixture(scope="module")
def run(spark):
    def go(*texts):
        d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return [(r.text, [tuple(f) for f in r.found]) for r in sorted(pseudonyms.pseudonymise(d).collect(), key=lambda r: r.doc_id)]

    return go


def test_screen_covers_the_patterns(run):
    a, b = run("the resolver is 8.8.8.8 or 1.1.1.1", "in 2024 the resolver is 8.8.8.8 or 1.1.1.1")
    assert [k for k, _ in a[1]] == ["ip", "ip"] and a[1] == b[1] and "8.8.8.8" not in a[0]
    assert b[0] == "in 2024 " + a[0]


def test_numbers_in_other_groups(run):
    cards = ["3782 822463 10005", "3782-822463-10005", "3056 930902 5904", "41 1111 11111 11111", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"]
    phones = ["+12125551234", "+1 2125551234", "+1(212)5551234", "+1212-555-1234"]
    for was, (text, found) in zip(cards + phones, run(*(f"see {x}, please" for x in cards + phones)), strict=True):
        kind = "card" if was in cards else "phone"
        assert [k for k, _ in found] == [kind] and was not in text
        assert re.sub(r"\d", "0", found[0][1]) == re.sub(r"\d", "0", was)
        assert luhn(found[0][1]) == 0 if kind == "card" else re.search(r"^\+1 ?\(?[2-9]\d\d\)?[ -]?[2-9]", found[0][1])


def test_chains_swallow_nothing(run):
    texts = ["ref 12345 2024-01-05", "212-555-1234 212-555-9876", "5 3782 822463 10005", "7 4111 1111 1111 1111 123", "12345 123456 10.0.0.1", "3782 822463 10006"]
    got = [[k for k, _ in found] for _, found in run(*texts)]
    assert got == [["date"], ["phone", "phone"], ["card"], ["card"], ["ip"], []]


def test_codes_that_start_with_0_or_1(run):
    was = ["+1 (017) 555-7713", "+1 (117) 055-7713", "+1 (456) 155-2186"]
    got = run(*was)
    for x, (text, found) in zip(was, got, strict=True):
        assert [k for k, _ in found] == ["phone"] and text != x and re.sub(r"\d", "0", text) == re.sub(r"\d", "0", x)
        assert [text[i] > "1" for i in (4, 9)] == [x[i] > "1" for i in (4, 9)]
    assert run("(017) 555-7713")[0] == ("(017) 555-7713", [])
