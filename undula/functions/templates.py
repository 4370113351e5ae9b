"""Message templates as column expressions: ``{name}``, ``{x:+.1f}``, ``{n:.0f}``, ``{sr:g}``; ``{{`` and ``}}`` are braces.

Numbers are rounded half to even in their shortest decimal form, and have a decimal comma in the languages that use one.  A template
that is broken, names a field that there is not, or asks for a format that is not known stays as it is.  A null field
gives a null message.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMA = ("de",)
_FIELD = re.compile(r"\{\{|\}\}|\{(\w+)(?::([^{}]*))?\}|[{}]")
_FIXED = re.compile(r"(\+?)\.(\d+)f")


def fixed(x: Column, digits: int, *, sign: bool = False) -> Column:
    """A number with so many decimals; with ``sign``, a plus before those that are not negative."""
    rounded = F.bround(x.cast("double"), digits)
    text = F.format_string(f"%.{digits}f", F.abs(rounded))
    return F.when(x.isNotNull(), F.concat(F.when(x < 0, "-").otherwise("+" if sign else ""), text))


def general(x: Column) -> Column:
    """A number in at most six significant digits, without zeros at the end; in powers of ten below 0.0001 and from a million on."""
    x = x.cast("double")
    size = F.abs(x)
    place = lambda v: F.floor(F.log10(v) + 1e-12)
    power = lambda k: F.pow(F.lit(10.0), k)
    # Six digits can round up to the next power of ten.
    six = lambda v: F.bround(v / power(place(v)), 5)
    exponent = place(size) + F.when(six(size) >= 10, 1).otherwise(0)
    mantissa = F.when(six(size) >= 10, six(size) / 10).otherwise(six(size))
    trimmed = lambda text: F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    small = trimmed(F.format_string("%.9f", mantissa * power(exponent)))
    large = F.concat(trimmed(F.format_string("%.5f", mantissa)), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    text = F.when(size == 0, "0").when((exponent < -4) | (exponent >= 6), large).otherwise(small)
    return F.when(x.isNotNull(), F.concat(F.when(x < 0, "-").otherwise(""), text))


def compiled(template: str, fields: set[str], *, lang: str = "en") -> Column:
    """The message that ``template`` makes of the columns ``fields``."""
    comma = (lambda c: F.replace(c, F.lit("."), F.lit(","))) if lang in COMMA else (lambda c: c)
    parts, at = [], 0
    for m in _FIELD.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        name, form = m[1], m[2] or ""
        as_fixed = _FIXED.fullmatch(form)
        if m[0] in ("{{", "}}"):
            parts.append(F.lit(m[0][0]))
        elif name not in fields or not (as_fixed or form in ("", "g")):
            return F.lit(template)
        elif as_fixed:
            parts.append(comma(fixed(F.col(name), int(as_fixed[2]), sign=bool(as_fixed[1]))))
        else:
            parts.append(comma(general(F.col(name))) if form == "g" else F.col(name).cast("string"))
    return F.concat(*parts, F.lit(template[at:]))


def rendered(rows: DataFrame, catalogue: DataFrame, *, key: str = "key", lang: str = "lang", fallback: str = "de", name: str = "text", most: int = 5000) -> DataFrame:
    """``rows`` with the message of their key in their language, else in ``fallback``, else the key itself.

    The catalogue (lang, key, template) holds messages as people write them, so it has a bounded size, which is checked.
    """
    texts = catalogue.select("lang", "key", "template").limit(most + 1).collect()
    if len(texts) > most:
        raise ValueError(f"a catalogue of more than {most} messages")
    held = {(r["lang"], r["key"]): r["template"] for r in texts}
    fields, codes = set(rows.columns), sorted({code for code, _ in held})
    by_key = {k: [code for code in codes if (code, k) in held] for k in sorted({k for _, k in held})}

    def message(k: str, found: list[str]) -> Column:
        other = compiled(held[fallback, k], fields, lang=fallback) if fallback in found else F.lit(k)
        own = [(code, compiled(held[code, k], fields, lang=code)) for code in found if code != fallback]
        # A language without this message takes the fallback's text.
        return reduce(lambda rest, one: F.when(F.col(lang) == one[0], one[1]).otherwise(rest), own, other)

    out = reduce(lambda rest, one: F.when(F.col(key) == one[0], message(*one)).otherwise(rest), by_key.items(), F.col(key))
    return rows.withColumn(name, out)
