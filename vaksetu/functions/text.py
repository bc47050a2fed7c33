"""Text columns: normalisation, tokens, edit distances, code-mixing.

Normalisation is NFKC, case folding, punctuation to spaces (Devanagari block kept) and single spaces. Spark has neither NFKC nor case folding, but for
texts of ASCII, plain Latin-1 letters and Devanagari without nuktas they amount to ``lower`` and ß to ss; such texts stay in the JVM, and only the rest is
handed to an Arrow function (others reach it as nulls).
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

#: Texts for which the JVM's own functions give NFKC and case folding exactly.
_PLAIN = r"^[\t-\r -~¡-§©«-®°±¶·»¿-ÿऀ-ऻऽ-ॗॠ-ॿ]*$"
_PUNCTUATION = r"[^\p{L}\p{N}_\sऀ-ॿ]"
DEVANAGARI = r"[ऀ-ॿ]"

#: English words that mark code-mixing in romanised text.
ENGLISH_MARKERS = """
meeting call slack email message reminder office project client deadline update
report file folder link photo video download upload login password account
order delivery payment invoice discount offer cancel confirm book ticket
doctor appointment medicine test result school class exam homework
today tomorrow yesterday morning evening night weekend monday tuesday wednesday
thursday friday saturday sunday minute hour week month year
please thanks sorry okay ok yes no maybe done pending urgent important
add remove edit delete send share save open close start stop check
laptop phone charger battery wifi internet app screen camera
""".split()


@F.pandas_udf(StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def fold(text: Column) -> Column:
    """NFKC and case folding for plain texts (see the module), null as empty."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))


def with_folded(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds folded copies (new name: old name) of text columns, exact for any text."""
    new = {}
    for name, old in columns.items():
        t = F.coalesce(F.col(old), F.lit(""))
        plain = t.rlike(_PLAIN)
        new[name] = F.when(plain, fold(t)).otherwise(_fold(F.when(~plain, t)))
    return df.withColumns(new)


def normalise(text: Column, strip_punctuation: bool = True, folded: bool = False) -> Column:
    """``folded``: the text is a column of :func:`with_folded`; otherwise :func:`fold` is applied, which is exact for plain texts."""
    t = text if folded else fold(text)
    if strip_punctuation:
        t = F.regexp_replace(t, "(?U)" + _PUNCTUATION, " ")
    # what Python takes for white space beyond the Unicode property
    t = F.regexp_replace(t, "(?U)[\\s\\x1c-\\x1f]+", " ")
    return F.trim(t)


def tokens(normalised: Column) -> Column:
    return F.filter(F.split(normalised, " "), lambda t: t != "")


#: Distinct tokens of a pair that have letters of their own (U+4E00 to U+9FFF).
_LETTERS = 20_992


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


#: Tables of distances with more cells than this are computed by :func:`distance_of`; smaller ones, those of utterances, by the JVM.
MOST_CELLS = 1 << 12


def embedded(a, b) -> int | None:
    """The distance of ``a`` to ``b`` if ``b`` is ``a`` with items left out and others replaced by items that ``a`` lacks; else null. Takes one pass.

    No alignment matches more than those of ``b`` that ``a`` has, so at least len(a) less their number of edits are needed. So many suffice if ``b`` fits into ``a``, an item that
    ``a`` lacks in the place of any one; putting each as early as possible finds a fit if there is one.
    """
    if len(b) > len(a):
        return None
    known, at, foreign, find = set(a), 0, 0, a.index
    try:
        for x in b:
            if x in known:
                at = find(x, at) + 1
            else:
                at += 1
                foreign += 1
    except ValueError:
        return None
    return None if at > len(a) else len(a) - len(b) + foreign


def embedded_text(a: str, b: str) -> int | None:
    """:func:`embedded` of strings, by stretches that are equal."""
    if len(b) > len(a):
        return None
    foreign = "".join(set(b) - set(a))
    stretches = re.finditer(f"([{re.escape(foreign)}]+)|[^{re.escape(foreign)}]+", b) if foreign else [re.match("(?s)().*", b)]
    at = total = 0
    for m in stretches:
        if m.group(1):
            at += m.end() - m.start()
            total += m.end() - m.start()
            continue
        i, end = m.span()
        while i < end:
            n, same = min(32, end - i), 0
            while n:  # how much is equal from here: twice as much each time, then halves
                if a.startswith(b[i + same : i + same + n], at + same):
                    same += n
                    n = min(2 * n, end - i - same)
                else:
                    n //= 2
                    while n:
                        if a.startswith(b[i + same : i + same + n], at + same):
                            same += n
                        n //= 2
            i, at = i + same, at + same
            if i < end:
                at = a.find(b[i], at)
                if at < 0:
                    return None
    return None if at > len(a) else len(a) - len(b) + total


def distance_of(a, b) -> int:
    """Unit-cost edit distance of two lists or strings, exact: by :func:`embedded` if one fits into the other, as most hypotheses do, else by bits."""
    fit = embedded_text if isinstance(a, str) else embedded
    d = fit(a, b) if len(a) >= len(b) else fit(b, a)
    return distance_in_bits(a, b) if d is None else d


def distance_in_bits(a, b) -> int:
    """Unit-cost edit distance of two sequences, exact: a column of the table is two bit vectors, which are whole numbers of any length here (Myers 1999, Hyyro 2003).

    A step costs one pass over the bits of the longer sequence, so two of n items take n * n / 30 digit steps and memory in proportion to n for each distinct item of the shorter.
    """
    short, long = sorted((a, b), key=len)
    m = len(long)
    if not len(short):
        return m
    wanted, places = set(short), {}
    for i, x in enumerate(long):
        if x in wanted:
            places.setdefault(x, []).append(i)
    at = {}
    for x, where in places.items():
        bits = np.zeros(m, np.uint8)
        bits[where] = 1
        at[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    every, last = (1 << m) - 1, m - 1
    up, down, score = every, 0, m  # vertical steps of +1 and of -1
    for x in short:
        same = at.get(x, 0)
        diagonal = (((same & up) + up) ^ up) | same
        plus = down | (every ^ ((diagonal | up) & every))
        minus = up & diagonal
        score += (plus >> last) - (minus >> last)
        plus = (plus << 1 | 1) & every
        side = same | down
        up = (minus << 1) & every | (every ^ (side | plus))
        down = plus & side
    return score


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance_of(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def _distances_of_words(a: pd.Series, b: pd.Series) -> pd.Series:
    split = lambda t: [w for w in t.split(" ") if w]
    return pd.Series([None if x is None or y is None else distance_of(split(x), split(y)) for x, y in zip(a, b, strict=True)], dtype="Int64")


_far = F.pandas_udf(_distances, LongType())
_far_words = F.pandas_udf(_distances_of_words, LongType())


def _distance(a: Column, b: Column, size, near, far) -> Column:
    """``near`` of both in the JVM if their table is small, as it is for utterances; the others leave for Python, where these are nulls."""
    large = size(a).cast("long") * size(b) > MOST_CELLS
    return F.coalesce(F.when(~large, near(a, b)), far(F.when(large, a), F.when(large, b)))


def _words(normalised: Column) -> Column:
    """How many tokens; there are single spaces between them."""
    return F.when(normalised == "", 0).otherwise(1 + F.char_length(normalised) - F.char_length(F.replace(normalised, F.lit(" "), F.lit(""))))


def edit_distance(a: Column, b: Column) -> Column:
    """Unit-cost edit distance of two arrays: each distinct item becomes one character and the JVM's levenshtein does the rest."""

    def of(p: Column) -> Column:
        code = lambda items: F.decode(F.unhex(F.array_join(F.transform(items, lambda t: F.hex(F.array_position(p.known, t) + 0x4DFF)), "")), "UTF-16BE")
        return F.when(F.size(p.known) <= _LETTERS, F.levenshtein(code(p.a), code(p.b))).otherwise(_edit_distance_rows(p.a, p.b)).cast("long")

    return let(F.struct(a.alias("a"), b.alias("b"), F.array_distinct(F.concat(a, b)).alias("known")), of)


def _edit_distance_rows(a: Column, b: Column) -> Column:
    """The same by two rows of the table, for pairs with more distinct items than there are letters."""
    first = F.transform(F.sequence(F.lit(0), F.size(a)), lambda x: x.cast("int"))

    def row(prev: Column, h: Column) -> Column:
        start = F.array(F.get(prev, 0) + 1)
        return F.aggregate(
            F.transform(a, lambda r, i: F.struct(r.alias("r"), i.alias("i"))),
            start,
            lambda cur, x: F.concat(cur, F.array(F.least(F.get(prev, x["i"] + 1) + 1, F.element_at(cur, -1) + 1, F.get(prev, x["i"]) + (x["r"] != h).cast("int")))),
        )

    return F.element_at(F.aggregate(b, first, row), -1)


def word_errors(reference: Column, hypothesis: Column, punctuated: bool = False, folded: bool = False, normalised: bool = False) -> Column:
    """struct(errors, length) over words. ``normalised``: both are columns made by :func:`normalise`."""
    ref, hyp = (reference, hypothesis) if normalised else (normalise(x, not punctuated, folded) for x in (reference, hypothesis))
    near = lambda a, b: let(F.struct(a.alias("a"), b.alias("b")), lambda p: edit_distance(tokens(p.a), tokens(p.b)))
    return F.struct(_distance(ref, hyp, _words, near, _far_words).alias("errors"), _words(ref).cast("long").alias("length"))


def char_errors(reference: Column, hypothesis: Column, folded: bool = False, normalised: bool = False) -> Column:
    """struct(errors, length) over characters without spaces. ``normalised``: both are columns made by :func:`normalise`, without spaces."""
    ref, hyp = (reference, hypothesis) if normalised else (F.replace(normalise(x, True, folded), F.lit(" "), F.lit("")) for x in (reference, hypothesis))
    return F.struct(_distance(ref, hyp, F.char_length, lambda a, b: F.levenshtein(a, b).cast("long"), _far).alias("errors"), F.char_length(ref).cast("long").alias("length"))


def code_mix_density(text: Column, markers: list[str] | None = None, folded: Column | None = None) -> Column:
    """Share of English tokens: those without Devanagari if the raw text has any, else those among the marker words; 0 without tokens."""
    words = tokens(normalise(text) if folded is None else normalise(folded, folded=True))
    known = F.array(*[F.lit(m.casefold()) for m in dict.fromkeys(markers or ENGLISH_MARKERS)])
    mixed = F.coalesce(text, F.lit("")).rlike(DEVANAGARI)

    def of(p: Column) -> Column:
        english = F.when(p.mixed, F.size(F.filter(p.words, lambda t: ~t.rlike(DEVANAGARI)))).otherwise(F.size(F.filter(p.words, lambda t: F.array_contains(known, t))))
        return F.when(F.size(p.words) > 0, english / F.size(p.words)).otherwise(0.0)

    return let(F.struct(words.alias("words"), mixed.alias("mixed")), of)


def code_mix_bucket(density: Column) -> Column:
    return let(density, lambda d: F.when(d < 0.15, "hindi_dominant").when(d < 0.40, "balanced").otherwise("dense"))


def present_in(surface: Column, normalised: Column, folded: bool = False) -> Column:
    """Whether a surface stands in a hypothesis that is normalised with its punctuation; an empty one never does."""
    needle = normalise(surface, False, folded)
    return (needle != "") & F.contains(normalised, needle)


def present(surface: Column, hypothesis: Column, folded: bool = False) -> Column:
    return present_in(surface, normalise(hypothesis, False, folded), folded)
