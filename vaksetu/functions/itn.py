"""Inverse text normalisation of spoken Hinglish: times, then numbers, then units.

A text is split at white space; each token has a *body* (without closing punctuation) and a *key* (the body in lower case, without quotes and
brackets around it), and rules look at keys. Three scanners run one after the other; a recognised time becomes one token, which later scanners pass over.

The grammar has look-ahead over up to six tokens and Python's notion of digits (Devanagari ones included), so it runs as an Arrow function. Null stays null.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Spoken cardinals. Nuktas are decomposed, as in the corpora's texts.
CARDINALS = {
    0: "zero shunya sifar शून्य",
    1: "one ek एक",
    2: "two do दो",
    3: "three teen tin तीन",
    4: "four char chaar चार",
    5: "five panch paanch पांच पाँच",
    6: "six che chhe chah chhah छह छे",
    7: "seven sat saat सात",
    8: "eight ath aath आठ",
    9: "nine nau no नौ",
    10: "ten das dus दस",
    11: "eleven gyarah gyara ग्यारह",
    12: "twelve barah bara बारह",
    13: "thirteen terah तेरह",
    14: "fourteen chaudah चौदह",
    15: "fifteen pandrah pandra पंद्रह",
    16: "sixteen solah सोलह",
    17: "seventeen satrah सत्रह",
    18: "eighteen atharah अठारह",
    19: "nineteen unnis उन्नीस",
    20: "twenty bees bis बीस",
    21: "ikkis इक्कीस",
    22: "baees bais बाईस",
    23: "teies teis तेईस",
    24: "chaubis चौबीस",
    25: "pachees pachchis पच्चीस twentyfive",
    30: "tees tis तीस thirty",
    35: "paintees पैंतीस thirtyfive",
    40: "chalees chalis चालीस forty",
    50: "pachaas pachas पचास fifty",
    60: "saath साठ sixty",
    70: "sattar सत्तर seventy",
    75: "pachhattar पचहत्तर seventyfive",
    80: "assi अस्सी eighty",
    90: "nabbe नब्बे ninety",
}
#: Scales.
SCALES = {
    100: "hundred sau सौ",
    1_000: "thousand hazaar hazar हज़ार हजार",
    100_000: "lakh lac लाख",
    1_000_000: "million",
    10_000_000: "crore karod करोड़",
}
#: Minutes that a word before the hour adds.
OFFSETS = {30: "saade sade साढ़े", 15: "sawa sava सवा", -15: "paune पौने"}
#: Parts of the day.
DAY_PARTS = {"am": "subah सुबह", "pm": "dopahar दोपहर shaam sham शाम raat रात"}
#: Single words.
OCLOCK = set("baje bajay baja बजे बजकर".split())
PAST = set("bajkar बजकर".split())
MINUTE = set("minute minat min मिनट".split())
PERCENT = set("percent pratishat प्रतिशत फ़ीसदी fisadi".split())
CURRENCY = set("rupaye rupees rupya rs रुपये रुपए".split())
#: Months with their short forms.
MONTHS = {
    "January": "jan",
    "February": "feb",
    "March": "mar",
    "April": "apr",
    "May": "",
    "June": "jun",
    "July": "jul",
    "August": "aug",
    "September": "sep sept",
    "October": "oct",
    "November": "nov",
    "December": "dec",
}
CLOSING = ",.!?;:।"


def _by_word(table: dict) -> dict:
    return {w: value for value, words in table.items() for w in words.split()}


_CARDINAL, _SCALE, _OFFSET, _PART = map(_by_word, (CARDINALS, SCALES, OFFSETS, DAY_PARTS))
_MONTH = _by_word(MONTHS) | {m.lower(): m for m in MONTHS}


class Token:
    __slots__ = ("body", "close", "key", "raw")

    def __init__(self, raw: str):
        self.raw = raw
        self.body = raw.rstrip(CLOSING)
        self.close = raw[len(self.body) :]
        self.key = self.body.lower().strip("\"'()")

    def number(self) -> int | None:
        if self.key.isdecimal():
            return int(self.key)
        return _CARDINAL.get(self.key)

    def spoken(self) -> int | None:
        """Value of a number word; digits are none."""
        return _SCALE.get(self.key, None if self.key.isdigit() else _CARDINAL.get(self.key))


class _Cursor:
    """A place in the tokens from which optional words are taken."""

    def __init__(self, row: list[Token], at: int):
        self.row, self.at = row, at

    def key(self) -> str:
        return self.row[self.at].key if self.at < len(self.row) else ""

    def take(self, words) -> str | None:
        key = self.key()
        if key and key in words:
            self.at += 1
            return key
        return None

    def number(self, low: int, high: int) -> int | None:
        got = self.row[self.at].number() if self.at < len(self.row) else None
        if got is None or not low <= got <= high:
            return None
        self.at += 1
        return got


def _clock(hour: int, minute: int, part: str | None, word: bool) -> str:
    shown = str(hour % 24 if hour > 12 else hour) + (f":{minute:02d}" if minute else "")
    return shown + (f" {part}" if part else "") + (" baje" if word else "")


def time_at(row: list[Token], at: int, word: bool) -> tuple[str, int] | None:
    """A spoken time that begins here, as (text, place behind it)."""
    c = _Cursor(row, at)
    part = _PART.get(c.take(_PART) or "")
    offset = _OFFSET.get(c.take(_OFFSET) or "")
    hour = c.number(1, 24)
    if hour is None:
        return None
    minute = 0
    if c.take(PAST):
        if offset is not None:
            return None
        got = c.number(0, 59)
        if got is None:
            return None
        minute = got
        c.take(MINUTE)
    elif c.take(OCLOCK) is None and offset is None:
        return None  # a number alone is no time
    elif offset is not None:
        minute = offset % 60
        if offset < 0:
            hour = hour - 1 or 12
    tail = _PART.get(c.take(_PART) or "")
    return _clock(hour, minute, part or tail, word), c.at


def fold_number(values: list[int]) -> int:
    """Words below 100 add up; a scale multiplies what has gathered since the last scale (or one)."""
    done = gathered = 0
    for v in values:
        if v < 100:
            gathered += v
        else:
            done, gathered = done + (gathered or 1) * v, 0
    return done + gathered


def number_at(row: list[Token], at: int) -> tuple[str, int] | None:
    values = []
    while at + len(values) < len(row) and (v := row[at + len(values)].spoken()) is not None:
        values.append(v)
    return (str(fold_number(values)), at + len(values)) if values else None


def unit_at(row: list[Token], at: int) -> tuple[str, int] | None:
    body = row[at].body
    if at + 1 == len(row) or not body.isdigit():
        return None
    key = row[at + 1].key
    if key in PERCENT:
        return f"{body}%", at + 2
    if key in CURRENCY:
        return f"₹{body}", at + 2
    if key in _MONTH:
        return f"{body} {_MONTH[key]}", at + 2
    return None


def _scan(words: list[str], rule: Callable) -> list[str]:
    row, out, at = [Token(w) for w in words], [], 0
    while at < len(row):
        found = rule(row, at)
        if found:
            text, at = found
            out.append(text + row[at - 1].close)
        else:
            out.append(row[at].raw)
            at += 1
    return out


def write_out(text: str, keep_baje: bool = True) -> str:
    """One text; blank ones unchanged."""
    words = text.split()
    if not words:
        return text
    words = _scan(words, lambda row, at: time_at(row, at, keep_baje))
    return " ".join(_scan(_scan(words, number_at), unit_at))


def inverse_normalise(text: Column, keep_baje: bool = True) -> Column:
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: write_out(t, keep_baje), na_action="ignore")

    return run(text)
