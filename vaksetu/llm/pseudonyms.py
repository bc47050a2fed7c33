"""Format-preserving pseudonyms by keyed Feistel networks, in SQL functions only.

Numbers and dates of these kinds are found, validated, and permuted within their own format, so a value always gives the same
pseudonym under a key (documents stay linked), two values never give the same one, and the result is a valid value of its kind:

* ``card``: 13 to 19 digits, grouped by single spaces or hyphens or not, with a right Luhn digit (of a card in groups of four, what follows its fourth group is not seen as part of it); the first digit stays, the last is the new Luhn digit;
* ``phone``: North American numbers with valid area and exchange codes, or any after +1, and other numbers with +, whose last seven digits are permuted;
* ``ip``: four octets;
* ``ssn``: US numbers of a valid area, group and serial;
* ``date``: real days of 1900 to 2099, as 2024-02-29, 29/02/2024, 02/29/2024 (if no day.month date) or 29.02.2024;
* ``email``: letters and digits of the local part; the domain stays;
* ``secret``: the value (8 characters or more, letters, digits and ``_+/.-`` between them) after password, token, secret or API key and = or :, and AKIA access keys; letters and digits of it, and hexadecimal ones stay so.

IPv6 addresses and other kinds of numbers are not looked for. A slash date that reads month first keeps doing so: its day stays within 13 to 28, or is kept
if it is the 29th or later, so that no other date gets the same pseudonym.

A network works on the positions of a value, even ones against odd ones: each of ``ROUNDS`` rounds adds to every position of one half,
modulo the number of symbols there, an amount drawn by SHA-256 from the key, the kind and the other half. That is a permutation for any mix of symbol counts,
so no walking in circles is needed. What does not validate stays as it is.

Null text stays null and has no findings; rows are mapped one by one, so repeated rows give repeated results. Whatever other columns there are is kept. Text
may be of any length; only the stretches between findings and the findings are held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: For tests and demonstrations; production passes a secret of its own.
DEFAULT_KEY = "set-a-secret-key"

#: Patterns of candidates by kind (Java syntax), in the order in which they are tried.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}(?![A-Za-z0-9])",
    "secret": r"(?:[Pp]assword|PASSWORD|[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9][A-Za-z0-9_+/.-]{6,}[A-Za-z0-9](?![A-Za-z0-9])|AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "ip": r"(?:\d{1,3}\.){3}\d{1,3}(?![0-9A-Za-z]|\.\d)",
    "date": r"(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![0-9A-Za-z])",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![0-9A-Za-z])",
    "card": r"\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}(?![0-9A-Za-z])|\d{4}[ -]\d{6}[ -]\d{4,5}(?![0-9A-Za-z])|\d{13,19}(?![0-9A-Za-z])",
    "phone": r"\+1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}(?![0-9A-Za-z])|(?:1[ .-])?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?![0-9A-Za-z])|\+[2-9]\d{0,2}(?:[ .-]?\d{1,4}){2,6}(?![0-9A-Za-z])",
}
KINDS = list(PATTERNS)
_START = r"(?<![A-Za-z0-9.@+_-])"
#: Cards in any other groups: a chain of digits to its end, unless something else begins at one of its later groups, which would be swallowed.
_GROUPS = r"\d(?:[ -]?\d){12,18}"
_CHAIN = r"(?!(?:\d+[ -])*\d+ (?:" + "|".join(f"(?:{PATTERNS[k]})" for k in ("date", "ssn", "card", "phone")) + "))" + _GROUPS + r"(?![ -]?\d|[A-Za-z]|\.\d)"
_ANY = _START + "(?:" + "|".join(f"(?:{p})" for p in [*PATTERNS.values(), _CHAIN]) + ")"

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def feistel(values: Column, radices: Column, key: Column | str, kind: str) -> Column:
    """values (array<bigint>, each from 0 to its radix - 1) permuted under the key."""
    key = F.lit(key) if isinstance(key, str) else key

    def one_round(state: Column, r: Column) -> Column:
        side = r % 2
        other = F.array_join(F.transform(F.filter(state, lambda _, i: i % 2 != side), lambda x: x.cast("string")), ",")
        seed = F.concat_ws("|", key, F.lit(kind), r.cast("string"), F.size(state).cast("string"), other)
        # a digest has eight amounts of eight hexadecimal digits, so it serves the half of sixteen positions
        draws = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(state), 4)), lambda n: F.sha2(F.concat_ws("|", seed, n.cast("string")).cast("binary"), 256))
        amount = lambda d, i: F.conv(F.substring(F.get(d, F.shiftright(i, 4)), 8 * F.shiftright(i % 16, 1) + 1, F.lit(8)), 16, 10).cast("bigint")
        return F.get(F.transform(F.array(draws), lambda d: F.transform(state, lambda x, i: F.when(i % 2 == side, (x + amount(d, i)) % F.get(radices, i)).otherwise(x))), 0)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values.cast("array<bigint>"), one_round)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _digits(s: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(s, "[^0-9]", "")), lambda c: c.cast("bigint"))


def _put_digits(s: Column, digits: Column) -> Column:
    """s with its digits replaced in order."""
    before = lambda i: F.length(F.regexp_replace(s.substr(F.lit(1), i), "[^0-9]", ""))
    return F.array_join(F.transform(_chars(s), lambda c, i: F.when(c.rlike("^[0-9]$"), F.get(digits, before(i)).cast("string")).otherwise(c)), "")


def _letters(s: Column, key, kind: str) -> Column:
    """Letters stay letters of their case and digits stay digits; other characters stay."""
    code = F.ascii
    of = lambda c, d, lo, up, no: F.when(c.rlike("^[0-9]$"), d).when(c.rlike("^[a-z]$"), lo).when(c.rlike("^[A-Z]$"), up).otherwise(no)
    values = F.transform(_chars(s), lambda c: of(c, code(c) - 48, code(c) - 97, code(c) - 65, F.lit(0)).cast("bigint"))
    radices = F.transform(_chars(s), lambda c: of(c, F.lit(10), F.lit(26), F.lit(26), F.lit(1)).cast("bigint"))
    moved = feistel(values, radices, key, kind)
    pick = lambda letters, x: F.lit(letters).substr((x + 1).cast("int"), F.lit(1))
    back = F.zip_with(_chars(s), moved, lambda c, x: of(c, x.cast("string"), pick(_LOWER, x), pick(_UPPER, x), c))
    return F.array_join(back, "")


_HEX = "^[0-9a-f]+$"


def _hexadecimal(s: Column, key, kind: str) -> Column:
    values = F.transform(_chars(s), lambda c: F.conv(c, 16, 10).cast("bigint"))
    moved = feistel(values, F.transform(values, lambda _: F.lit(16).cast("bigint")), key, kind)
    return F.array_join(F.transform(moved, lambda x: F.lower(F.conv(x.cast("string"), 10, 16))), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits of which the last is the check digit."""
    n = F.size(digits)
    weigh = lambda x, i: F.when((n - i) % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
    return F.aggregate(F.transform(digits, weigh), F.lit(0).cast("bigint"), lambda a, x: a + x)


def card_valid(s: Column) -> Column:
    d = _digits(s)
    return F.size(d).between(13, 19) & (_luhn_sum(d) % 10 == 0)


def _card(s: Column, key) -> Column:
    d = _digits(s)
    n = F.size(d)
    middle = feistel(F.slice(d, F.lit(2), n - 2), F.array_repeat(F.lit(10).cast("bigint"), n - 2), key, "card")
    head = F.concat(F.slice(d, 1, 1), middle)
    check = (10 - _luhn_sum(F.concat(head, F.array(F.lit(0).cast("bigint")))) % 10) % 10
    return _put_digits(s, F.concat(head, F.array(check)))


def _ip(s: Column, key) -> Column:
    values = F.transform(F.split(s, r"\."), lambda x: x.cast("bigint"))
    return F.array_join(F.transform(feistel(values, F.array_repeat(F.lit(256).cast("bigint"), 4), key, "ip"), lambda x: x.cast("string")), ".")


def ip_valid(s: Column) -> Column:
    return F.forall(F.split(s, r"\."), lambda x: (x.cast("int") < 256) & ((x == "0") | ~x.startswith("0")))


def ssn_valid(s: Column) -> Column:
    return s.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")


def _ssn(s: Column, key) -> Column:
    p = F.transform(F.split(s, "-"), lambda x: x.cast("bigint"))
    area = F.get(p, 0) - F.when(F.get(p, 0) > 666, 2).otherwise(1)
    sizes = F.array(*[F.lit(x).cast("bigint") for x in (898, 99, 9999)])
    q = feistel(F.array(area, F.get(p, 1) - 1, F.get(p, 2) - 1), sizes, key, "ssn")
    new = F.get(q, 0) + 1
    return F.concat_ws("-", F.lpad((new + F.when(new > 665, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((F.get(q, 1) + 1).cast("string"), 2, "0"), F.lpad((F.get(q, 2) + 1).cast("string"), 4, "0"))


#: Date formats by pattern; a slash date is day first if that is a real day.
_FORMATS = [(r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}/", "dd/MM/yyyy"), (r"^\d{2}/", "MM/dd/yyyy")]
_DAYS = 73049  # from 1900-01-01 to 2099-12-31: 17 * 4297


def _in_range(d: Column) -> Column:
    return d.between(F.lit("1900-01-01").cast("date"), F.lit("2099-12-31").cast("date"))


def _date_as(s: Column, pattern: str, fmt: str) -> Column:
    parts = {"y": F.regexp_extract(s, r"(\d{4})", 1)}
    two = F.split(F.regexp_replace(F.regexp_replace(s, r"\d{4}", ""), r"^[-./]|[-./]$", ""), r"[-./]")
    parts["d"], parts["m"] = (F.get(two, 0), F.get(two, 1)) if fmt.startswith("dd") else (F.get(two, 1), F.get(two, 0))
    return F.when(s.rlike(pattern), F.concat_ws("-", parts["y"], parts["m"], parts["d"]).try_cast("date"))


def date_valid(s: Column) -> Column:
    return F.coalesce(_in_range(F.coalesce(*[_date_as(s, p, f) for p, f in _FORMATS])), F.lit(False))


def _month_first(s: Column, key) -> Column:
    """A month-first date (day 13 or later) as another one: no day-first date and no other day of 29 or later takes its place."""
    long = lambda *xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    at = lambda p, n: s.substr(p, n).cast("bigint")
    m, d, y = at(1, 2), at(4, 2), at(7, 4) - 1900
    put = lambda m, d, y: F.concat_ws("/", F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"), (y + 1900).cast("string"))

    def among(months: list[int], kind: str) -> Column:
        place = (F.array_position(F.array(*[F.lit(x) for x in months]), m.cast("int")) - 1).cast("bigint")
        q = feistel(F.array(place, y), long(len(months), 200), key, kind)
        return F.get(F.transform(F.array(q), lambda q: put(F.get(F.array(*[F.lit(x) for x in months]), F.get(q, 0).cast("int")), d, F.get(q, 1))), 0)

    common = feistel(F.array(m - 1, d - 13, y), long(12, 16, 200), key, "date-md")
    leap = F.floor((y - 4) / 4).cast("bigint")  # 29 February of 1904 to 2096: 7 * 7 years
    leaped = feistel(F.array(F.floor(leap / 7).cast("bigint"), leap % 7), long(7, 7), key, "date-md-leap")
    return (
        F.when(d <= 28, F.get(F.transform(F.array(common), lambda q: put(F.get(q, 0) + 1, F.get(q, 1) + 13, F.get(q, 2))), 0))
        .when((d == 29) & (m == 2), F.get(F.transform(F.array(leaped), lambda q: put(m, d, (F.get(q, 0) * 7 + F.get(q, 1)) * 4 + 4)), 0))
        .when(d == 31, among([1, 3, 5, 7, 8, 10, 12], "date-md-31"))
        .otherwise(among([1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12], "date-md-29"))
    )


def _date(s: Column, key) -> Column:
    out = _month_first(s, key)
    origin = F.lit("1900-01-01").cast("date")
    for p, f in reversed(_FORMATS[:-1]):
        day = _date_as(s, p, f)
        n = F.datediff(day, origin).cast("bigint")
        q = feistel(F.array((n / 4297).cast("bigint"), n % 4297), F.array(F.lit(17).cast("bigint"), F.lit(4297).cast("bigint")), key, "date")
        new = F.date_add(origin, (F.get(q, 0) * 4297 + F.get(q, 1)).cast("int"))
        out = F.when(day.isNotNull(), F.date_format(new, f)).otherwise(out)
    return out


def _phone(s: Column, key) -> Column:
    d = _digits(s)
    n = F.size(d)
    american = ~s.rlike(r"^\+[2-9]")
    keep = F.when(american, n - 10).otherwise(n - 7)
    tail = F.slice(d, keep + 1, n)
    # area and exchange codes start with 2 to 9; after +1, those that start with 0 or 1 keep doing so
    code = lambda i: american & i.isin(0, 3)
    low = lambda x, i: F.when(code(i) & (x > 1), 2).otherwise(0).cast("bigint")
    size = lambda x, i: F.when(code(i), F.when(x > 1, 8).otherwise(2)).otherwise(10).cast("bigint")
    moved = feistel(F.transform(tail, lambda x, i: x - low(x, i)), F.transform(tail, size), key, "phone")
    return _put_digits(s, F.concat(F.slice(d, F.lit(1), keep), F.zip_with(moved, F.transform(tail, low), lambda x, y: x + y)))


def phone_valid(s: Column) -> Column:
    n = F.size(_digits(s))
    return F.when(s.rlike(r"^\+[2-9]"), n.between(9, 15)).otherwise(n.between(10, 11))


def _secret(s: Column, key) -> Column:
    mark = r"^(AKIA|[A-Za-z_-]+\s*[=:]\s*[\"']?)"
    head, value = F.regexp_extract(s, mark, 1), F.regexp_replace(s, mark, "")
    # another value that becomes hexadecimal is permuted again until it is not, so that the two sets stay apart (each step is enough with a probability of 0.77 or more)
    again = lambda v, _: F.when(v.rlike(_HEX), _letters(v, key, "secret")).otherwise(v)
    other = F.aggregate(F.sequence(F.lit(1), F.lit(64)), _letters(value, key, "secret"), again)
    return F.concat(head, F.when(value.rlike(_HEX), _hexadecimal(value, key, "secret")).otherwise(other))


def _email(s: Column, key) -> Column:
    return F.concat(_letters(F.substring_index(s, "@", 1), key, "email"), F.lit("@"), F.substring_index(s, "@", -1))


_VALID = {"ip": ip_valid, "date": date_valid, "ssn": ssn_valid, "card": card_valid, "phone": phone_valid}
_MOVE = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def kind_of(s: Column) -> Column:
    """The kind of a match, or null if it does not validate as any."""
    out = F.lit(None).cast("string")
    for k in reversed(KINDS):
        ok = s.rlike(f"^(?:{PATTERNS[k]}{'|' + _GROUPS if k == 'card' else ''})$")
        out = F.when(ok & _VALID[k](s) if k in _VALID else ok, F.lit(k)).otherwise(out)
    return out


def pseudonym(s: Column, kind: Column, key: str = DEFAULT_KEY) -> Column:
    out = s
    for k in reversed(KINDS):
        out = F.when(kind == k, _MOVE[k](s, key)).otherwise(out)
    return out


#: What every match of the patterns has: two digits (single ones with a mark between), @, AKIA or the beginning of a value. Texts without it have no match.
SCREEN = r"[0-9][ .-]?[0-9]|@|AKIA|[=:]\s{0,3}[\"']?[A-Za-z0-9][A-Za-z0-9_+/.-]{6}"


def pseudonymise(docs: DataFrame, key: str = DEFAULT_KEY, column: str = "text", found: str = "found") -> DataFrame:
    """``docs`` with ``column`` pseudonymised and a new (or replaced) column ``found``: array of (kind, value as it now stands)."""
    t = F.col(f"`{column}`")
    own = "__pseudonym_" + "_".join(sorted(docs.columns))[:40]  # clashes with no column
    hits = F.transform(F.regexp_extract_all(t, F.lit(_ANY), F.lit(0)), lambda m: F.struct(m.alias("was"), kind_of(m).alias("kind")))
    rows = docs.withColumn(own, F.when(t.rlike(SCREEN), hits))
    new = F.transform(F.col(own), lambda h: F.struct(h.kind.alias("kind"), pseudonym(h.was, h.kind, key).alias("value")))
    rows = rows.withColumn(own, new)
    pieces = F.split(t, _ANY, -1)
    joined = F.array_join(F.transform(F.arrays_zip(pieces.alias("a"), F.col(own).alias("b")), lambda z: F.concat(z["a"], F.coalesce(z["b"]["value"], F.lit("")))), "")
    text = F.when(F.size(own) > 0, joined).otherwise(t)
    kept = F.coalesce(F.filter(F.col(own), lambda h: h.kind.isNotNull()), F.array().cast("array<struct<kind:string,value:string>>"))
    names = [c for c in docs.columns if c != found]
    return rows.select(*[text.alias(c) if c == column else F.col(f"`{c}`") for c in names], kept.alias(found))
