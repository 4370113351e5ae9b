"""Format-preserving pseudonyms for personal data, by keyed Feistel networks.

One pattern finds e-mail addresses, IBANs (also in groups of four), IPv4 and IPv6
addresses, dates in numbers and with English months, social security numbers,
payment card numbers and phone numbers.  Each match is validated (Luhn,
mod 97, octets, calendar, number ranges); what fails stays as it is.  A valid
value is permuted within its format by a Feistel network whose round function is
SHA-2 under a key, so the map is one-to-one, equal values get equal pseudonyms in
all documents, and a pseudonym is valid where its kind has a check.

    card, iban   all characters but the check digits, then new check digits
    phone        all digits behind the country code
    ipv4, ipv6   the 32 bits; the digits and the letters, each among themselves
    date         the days of 1800-2199; month-first dates that are no day-first ones, among themselves
    ssn          the valid numbers
    email        letters and digits of the local part, by script; the domain stays

All of it is DataFrame functions: no Python on the executors.  Texts are split
at the matches, the matches are mapped, and the parts are joined again.

Defined results: a null text stays null; an empty or clean text is unchanged;
repeated rows are separate rows; an empty table gives an empty result; other
columns are kept, and ``n_chars`` is counted anew if the table has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
MONTHS = "January February March April May June July August September October November December".split()
_MONTH = f"(?:{'|'.join(MONTHS)}|{'|'.join(m[:3] for m in MONTHS)})"
# The international calling codes of one and two digits; all others have three.
_COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Patterns by kind, in order of preference at one place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: (?=[A-Z]{0,3}[0-9])[A-Z0-9]{4}| [A-Z]{4}(?= [0-9])){2,7}(?: [A-Z0-9]?[0-9]{1,2}[A-Z0-9]?)?)(?![0-9A-Za-z])",
    "ipv6": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![0-9A-Za-z:])",
    "ipv4": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z])(?!\.[0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:(?:18|19|20|21)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./](?:[0-9]{2})[./](?:18|19|20|21)[0-9]{2})(?![0-9A-Za-z])",
    "written": rf"(?<![0-9A-Za-z])(?:[0-9]{{1,2}} {_MONTH} (?:18|19|20|21)[0-9]{{2}}|{_MONTH} [0-9]{{1,2}}, (?:18|19|20|21)[0-9]{{2}})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}-[0-9]{6}-[0-9]{5}|[0-9]{4} [0-9]{6} [0-9]{5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}|(?<=\+[0-9]{1,3}[ .-]?)[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){2,3})(?![0-9A-Za-z])|(?<![0-9A-Za-z.+-])(?:[2-9][0-9]{2}-[0-9]{3}-[0-9]{4}|[2-9][0-9]{2}\.[0-9]{3}\.[0-9]{4})(?![0-9A-Za-z-])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_FIRST_DAY = "1800-01-01"  # 400 years have 146,097 = 189 * 773 days


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _keyed(key: str, tweak: str, round_: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), round_.cast("string"), half).cast("binary"), 512)


def _number(hexes: Column, digits: int = 14) -> Column:
    return F.conv(F.substring(hexes, 1, digits), 16, 10).cast("long")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


#: Classes that a character stays in: ASCII, then letters of other scripts (code points).
ASCII = ((97, 122), (65, 90), (48, 57))
HEX = ((97, 102), (65, 70), (48, 57))
LETTERS = (
    (0xDF, 0xF6), (0xF8, 0xFF), (0xC0, 0xD6), (0xD8, 0xDE), (0x100, 0x17F), (0x3B1, 0x3C9), (0x391, 0x3A1), (0x3A3, 0x3A9), (0x430, 0x44F), (0x410, 0x42F), (0x450, 0x45F), (0x400, 0x40F),
    (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
)


def _moved(c: Column, by: Column, classes: tuple) -> Column:
    """The character ``by`` places on, within its class; other characters stay."""
    code, out = F.ascii(c), c
    for first, last in classes:
        new = F.pmod(code - first + by, F.lit(last - first + 1)) + first
        shown = F.char(new) if last < 128 else F.decode(F.unhex(F.lpad(F.hex(new), 4, "0")), "UTF-16BE")
        out = F.when(code.between(first, last), shown).otherwise(out)
    return out


def permute_text(value: Column, key: str, tweak: str, classes: tuple = ASCII) -> Column:
    """Feistel network over the characters: each half is moved along within its classes by a keyed hash of the other."""
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), cut).alias("a"), F.substr(value, cut + 1).alias("b"))

    def round_(halves: Column, r: Column) -> Column:
        # 64 bytes; characters beyond the 64th take them again, as the class sizes do not align with that
        keyed = _keyed(key, tweak, r, halves["b"])
        moved = F.transform(_chars(halves["a"]), lambda c, i: _moved(c, F.conv(F.substr(keyed, 2 * F.pmod(i, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int"), classes))
        return F.struct(halves["b"].alias("a"), F.array_join(moved, "").alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda h: F.concat(h["a"], h["b"]))


def permute_pair(left: Column, right: Column, sizes: tuple[int, int], key: str, tweak: str) -> Column:
    """Feistel network over pairs of numbers below ``sizes``; a struct of a and b."""
    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))

    def round_(p: Column, r: Column) -> Column:
        a = F.pmod(p["a"] + F.pmod(_number(_keyed(key, tweak + "a", r, p["b"].cast("string"))), F.lit(sizes[0])), F.lit(sizes[0]))
        b = F.pmod(p["b"] + F.pmod(_number(_keyed(key, tweak + "b", r, a.cast("string"))), F.lit(sizes[1])), F.lit(sizes[1]))
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, round_)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _into_format(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order by ``digits``."""

    def fill(new: Column) -> Column:
        before = lambda i: F.length(_digits(F.substr(value, F.lit(1), i)))
        return F.array_join(F.transform(_chars(value), lambda c, i: F.when(c.between("0", "9"), F.substr(new, before(i) + 1, F.lit(1))).otherwise(c)), "")

    return _let(digits, fill)


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled (the last one not)."""
    n = F.length(digits)

    def weighed(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(_chars(digits), weighed), F.lit(0), lambda s, d: s + d)


def _card(value: Column, key: str) -> Column:
    digits = _digits(value)

    def checked(body: Column) -> Column:
        check = F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
        return F.concat(body, check.cast("string"))

    made = _let(permute_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card"), checked)
    valid = F.pmod(luhn_sum(digits), F.lit(10)) == 0
    return F.when(valid, _into_format(value, made)).otherwise(value)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of the text with letters written as 10 to 35."""

    def step(r: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.pmod(F.when(digit, r * 10 + F.ascii(c) - 48).otherwise(r * 100 + F.ascii(c) - 55), F.lit(97)).cast("int")

    return F.aggregate(_chars(text), F.lit(0), step)


def _iban(value: Column, key: str) -> Column:
    plain = F.replace(value, F.lit(" "))
    country, body = F.substring(plain, 1, 2), F.substr(plain, F.lit(5))
    valid = F.length(plain).between(15, 34) & (_mod97(F.concat(body, country, F.substring(plain, 3, 2))) == 1)

    def checked(made: Column) -> Column:
        return F.concat(country, F.lpad((98 - _mod97(F.concat(made, country, F.lit("00")))).cast("string"), 2, "0"), made)

    def spaced(made: Column) -> Column:
        before = lambda i: F.length(F.replace(F.substr(value, F.lit(1), i), F.lit(" ")))
        return F.array_join(F.transform(_chars(value), lambda c, i: F.when(c == " ", c).otherwise(F.substr(made, before(i) + 1, F.lit(1)))), "")

    new = _let(permute_text(body, key, "iban"), checked)
    return F.when(valid, F.when(value.contains(" "), _let(new, spaced)).otherwise(new)).otherwise(value)


def _phone(value: Column, key: str) -> Column:
    apart = F.regexp_extract(value, r"^(\+[0-9]{1,3}(?=[ .(-]))?", 0)
    country = F.when(apart != "", apart).otherwise(F.regexp_extract(value, _COUNTRY, 0))
    rest = F.substr(value, F.length(country) + 1)
    digits = _digits(rest)
    return F.when(F.length(digits).between(7, 14), F.concat(country, _into_format(rest, permute_text(digits, key, "phone")))).otherwise(value)


def _ipv6(value: Column, key: str) -> Column:
    groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
    return F.when((groups == 8) | (value.contains("::") & (groups < 8)), permute_text(value, key, "ipv6", HEX)).otherwise(value)


def _ipv4(value: Column, key: str) -> Column:
    o = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    made = permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), key, "ipv4")
    out = _let(made, lambda p: F.concat_ws(".", *(x.cast("string") for x in (F.floor(p["a"] / 256), F.pmod(p["a"], F.lit(256)), F.floor(p["b"] / 256), F.pmod(p["b"], F.lit(256))))))
    return F.when(F.forall(o, lambda x: x <= 255), out).otherwise(value)


def _moved_day(date: Column, key: str) -> Column:
    """Another day of 1800-2199, as text."""
    day = F.date_diff(date, F.lit(_FIRST_DAY).cast("date"))
    made = permute_pair(F.floor(day / 773), F.pmod(day, F.lit(773)), (189, 773), key, "date")
    return _let(made, lambda p: F.date_add(F.lit(_FIRST_DAY).cast("date"), (p["a"] * 773 + p["b"]).cast("int")).cast("string"))


def _month_first(value: Column, key: str) -> Column:
    """mm/dd/yyyy with a day that is no month: years and months are moved, days from 13 to 28 with them; later days stay."""
    month, day, year = (value.substr(a, n).cast("int") for a, n in ((1, 2), (4, 2), (7, 4)))
    sep, out = value.substr(3, 1), value
    for low, high, months in ((13, 28, range(1, 13)), (29, 29, [m for m in range(1, 13) if m != 2]), (30, 30, [m for m in range(1, 13) if m != 2]), (31, 31, (1, 3, 5, 7, 8, 10, 12))):
        days, held = high - low + 1, F.array(*map(F.lit, months))
        made = permute_pair(year - 1800, (F.array_position(held, month).cast("int") - 1) * days + day - low, (400, len(months) * days), key, f"month{low}")
        shown = lambda p: F.concat(
            F.lpad(F.element_at(held, F.floor(p["b"] / days).cast("int") + 1).cast("string"), 2, "0"), sep, F.lpad((F.pmod(p["b"], F.lit(days)) + low).cast("string"), 2, "0"), sep, (p["a"] + 1800).cast("string"))
        out = F.when(day.between(low, high) & F.array_contains(held, month), _let(made, shown)).otherwise(out)
    leaps = F.array(*(F.lit(y) for y in range(1800, 2200) if y % 4 == 0 and (y % 100 or y % 400 == 0)))
    other = _let(permute_pair(F.array_position(leaps, year) - 1, F.lit(0), (97, 1), key, "leap"), lambda p: F.concat(value.substr(1, 6), F.element_at(leaps, p["a"].cast("int") + 1).cast("string")))
    return F.when((month == 2) & (day == 29) & F.array_contains(leaps, year), other).otherwise(out)


def _date(value: Column, key: str) -> Column:
    iso = value.substr(5, 1) == "-"
    plain = F.when(iso, value).otherwise(F.concat_ws("-", value.substr(7, 4), value.substr(4, 2), value.substr(1, 2)))
    date = F.try_to_date(plain, "yyyy-MM-dd")
    sep = value.substr(3, 1)
    shown = _let(_moved_day(date, key), lambda d: F.when(iso, d).otherwise(F.concat(d.substr(9, 2), sep, d.substr(6, 2), sep, d.substr(1, 4))))
    same = iso | (value.substr(6, 1) == sep)
    return F.when(date.isNotNull() & same, shown).when(date.isNull() & same & ~iso, _month_first(value, key)).otherwise(value)


def _written(value: Column, key: str) -> Column:
    name, day = F.regexp_extract(value, "[A-Za-z]+", 0), F.regexp_extract(value, r"(?<![0-9])[0-9]{1,2}(?![0-9])", 0)
    months = F.array(*(F.lit(m[:3]) for m in MONTHS))
    month = F.array_position(months, F.substring(name, 1, 3)).cast("string")
    date = F.try_to_date(F.concat_ws("-", value.substr(F.length(value) - 3, F.lit(4)), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")

    def shown(d: Column) -> Column:
        full = F.element_at(F.array(*map(F.lit, MONTHS)), d.substr(6, 2).cast("int"))
        new = F.when(F.length(name) > 3, full).when(name == "May", full).otherwise(F.substring(full, 1, 3))
        number = F.when(day.startswith("0"), d.substr(9, 2)).otherwise(d.substr(9, 2).cast("int").cast("string"))
        return F.when(value.rlike("^[0-9]"), F.concat_ws(" ", number, new, d.substr(1, 4))).otherwise(F.concat(new, F.lit(" "), number, F.lit(", "), d.substr(1, 4)))

    return F.when(date.isNotNull(), _let(_moved_day(date, key), shown)).otherwise(value)


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (value.substr(a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    made = permute_pair(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, (898, 99 * 9999), key, "ssn")

    def shown(p: Column) -> Column:
        a = F.when(p["a"] >= 665, p["a"] + 2).otherwise(p["a"] + 1)
        return F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in ((a, 3), (F.floor(p["b"] / 9999) + 1, 2), (F.pmod(p["b"], F.lit(9999)) + 1, 4))))

    return F.when(valid, _let(made, shown)).otherwise(value)


def _email(value: Column, key: str) -> Column:
    local = F.substring_index(value, "@", 1)
    return F.concat(permute_text(local, key, "email", ASCII + LETTERS), F.substr(value, F.length(local) + 1))


_BY_KIND = {"email": _email, "iban": _iban, "ipv6": _ipv6, "ipv4": _ipv4, "date": _date, "written": _written, "ssn": _ssn, "card": _card, "phone": _phone}


def kind_of(match: Column) -> Column:
    out = F.lit("phone")
    # the last that fits counts
    for kind, test in (("card", r"^[0-9]{4}[0-9 -]{9,15}$"), ("ssn", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), ("date", r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})$"), ("ipv4", r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), ("iban", "^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$"), ("ipv6", ":.*:"), ("written", "^(?:[0-9]{1,2} [A-Z][a-z]|[A-Z][a-z]{2,} [0-9])"), ("email", "@")):
        out = F.when(match.rlike(test), kind).otherwise(out)
    return out


def pseudonym(match: Column, key: str) -> Column:
    kind = kind_of(match)
    out = match
    for name, f in _BY_KIND.items():
        out = F.when(kind == name, f(match, key)).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, *, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the personal data in ``text_col`` replaced; ``count_col``: a column for the number of values replaced."""
    text = F.col(text_col)
    some = text.rlike("[0-9][0-9.]|@")  # every pattern needs one of these; most texts hold neither
    pattern = F.lit(ANY)
    out = docs.withColumn("__u_found", F.when(some, F.regexp_extract_all(text, pattern, F.lit(0))))
    out = out.withColumn("__u_made", F.transform("__u_found", lambda m: pseudonym(m, key)))
    out = out.withColumn("__u_parts", F.when(F.size("__u_found") > 0, F.split(text, ANY, -1)))
    # the text before the first match, then each pseudonym with the text behind it
    rest = F.slice("__u_parts", F.lit(2), F.size("__u_made"))
    joined = F.concat(F.col("__u_parts")[0], F.array_join(F.zip_with("__u_made", rest, lambda m, p: F.concat(m, p)), ""))
    if count_col:
        out = out.withColumn(count_col, F.coalesce(F.size(F.filter(F.zip_with("__u_found", "__u_made", lambda a, b: a != b), lambda x: x)), F.lit(0)).cast("long"))
    out = out.withColumn(text_col, F.when(F.size("__u_found") > 0, joined).otherwise(text)).drop("__u_found", "__u_made", "__u_parts")
    return out.withColumn("n_chars", F.length(text_col).cast("long")) if "n_chars" in docs.columns and text_col == "text" else out


#: A real run takes its key from a secret store; pseudonyms are only as private as the key.
DEMO_KEY = "pseudonym-key-1"


def op3_pii(spark, sf_dir: str) -> DataFrame:
    from undula.llm.common import read

    return pseudonymize(read(spark, sf_dir, "documents"), key=DEMO_KEY, count_col="n_replaced").select("doc_id", "text", "n_replaced")
