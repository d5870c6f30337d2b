"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

A keyed Feistel network permutes the values of a format: each character of a class (digit, a-z, A-Z) is shifted, within
its class, by a stream derived from the key, the round and the other half; everything else stays.  Equal values map
to equal pseudonyms in every document, different ones to different ones.

Kinds: payment cards (13 to 19 digits, Luhn; the first digit stays and the check digit is made anew), IBANs (mod 97
likewise; country stays), phone numbers (the country code stays and is read from the digits, so a number is linked
however it is spaced; ten-digit numbers of country code 1 keep whether area and exchange begin with 2 to 9, and are
linked with or without the code), US social security numbers (a permutation of the valid ones), IPv4 addresses (each
address is permuted as 32 bits), e-mail addresses (local part; domain of at most 127 labels stays) and dates (ISO, dd.mm.yyyy, mm/dd/yyyy: the day
number is permuted over 73,216 days from 1900-01-01).  A span that fails its check is searched for the values within it:
from each start the longest span of any kind that passes is taken, and the search resumes after it (IBANs of a known country must then have its
length).  What passes at no end stays as it is.

The key is the caller's; what the plan holds is a digest of it, which is as secret as the key.  A pseudonym depends on
key, kind and value alone.

Texts without a digit or ``@`` are never searched further.  Edge cases: null text stays null with no findings;
overlapping values: the leftmost, longest kind first; repeated rows give the same pseudonyms; empty tables give none.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}\.){1,126}[A-Za-z]{2,24}"  # bounded: Java repeats a group by recursion
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
CARD = r"(?<![0-9A-Za-z.\-])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z])"
IPV4 = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
ISO = r"(?<![0-9A-Za-z\-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z\-])"
DMY = r"(?<![0-9A-Za-z.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9A-Za-z])"
MDY = r"(?<![0-9A-Za-z/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9A-Za-z/])"
SSN = r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,5}(?:[ .\-]?[0-9]{2,5}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![0-9A-Za-z])"
ANY = "|".join((EMAIL, IBAN, CARD, IPV4, ISO, DMY, MDY, SSN, PHONE))
_KINDS = (("email", EMAIL), ("iban", IBAN), ("card", CARD), ("ipv4", IPV4), ("iso", ISO), ("dmy", DMY), ("mdy", MDY), ("ssn", SSN), ("phone", PHONE))
_IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC"}
ROUNDS = 8
_DAYS_HIGH, _DAYS_LOW = 256, 286  # 73,216 days


def _stream(key: str, kind: str, round_: Column, other: Column, own_length: Column) -> Column:
    """Hex digits that drive one round: 4 for each character."""
    blocks = F.sequence(F.lit(0), F.floor((own_length - 1) / 16).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), own_length.cast("string"), b.cast("string"), other), 256)), "")


def _shift(half: Column, stream: Column) -> Column:
    """Each character shifted within its class by four digits of the stream."""
    def one(c: Column, i: Column) -> Column:
        by = F.conv(stream.substr(i * 4 + 1, F.lit(4)), 16, 10).cast("int")
        base = F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65)
        radix = F.when(c.between("0", "9"), 10).otherwise(26)
        return F.when(base.isNull(), c).otherwise(F.call_function("char", (base + (F.ascii(c) - base + by) % radix).cast("long")))

    return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), one), "")


def permute(value: Column, key: str, kind: str) -> Column:
    """Feistel permutation of the strings with this one's classes of characters."""
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(value.substr(F.lit(1), cut).alias("l"), value.substr(cut + 1, F.length(value) - cut).alias("r"))

    def round_(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, _shift(s["l"], _stream(key, kind, i, s["r"], F.length(s["l"])))).otherwise(s["l"])
        right = F.when(i % 2 == 1, _shift(s["r"], _stream(key, kind, i, s["l"], F.length(s["r"])))).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_, lambda s: F.concat(s["l"], s["r"]))


def permute_number(value: Column, high: int | Column, low: int, key: str, kind: str) -> Column:
    """Feistel permutation of 0 .. high * low - 1."""
    start = F.struct(F.floor(value / low).cast("long").alias("h"), (value % low).cast("long").alias("l"))

    def round_(s: Column, i: Column) -> Column:
        word = lambda other, tag: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind + tag), i.cast("string"), other.cast("string")), 256), 1, 12), 16, 10).cast("long")
        return F.struct(F.when(i % 2 == 0, (s["h"] + word(s["l"], "h")) % high).otherwise(s["h"]).alias("h"), F.when(i % 2 == 1, (s["l"] + word(s["h"], "l")) % low).otherwise(s["l"]).alias("l"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_, lambda s: s["h"] * low + s["l"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum; a number with its check digit is valid if it is divisible by 10."""
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def mod97(iban: Column) -> Column:
    """The IBAN's remainder; 1 if it is valid."""
    turned = F.concat(iban.substr(F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _lay(template: Column, characters: Column, pattern: str) -> Column:
    """``characters``, one by one, in the places of ``template`` that are of the class ``pattern``."""
    step = lambda s, c: F.when(c.rlike(pattern), F.struct(F.concat(s["out"], characters.substr(s["n"] + 1, F.lit(1))).alias("out"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["n"].alias("n")))
    return F.aggregate(F.filter(F.split(template, ""), lambda c: c != ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step, lambda s: s["out"])


def _card(v: Column, key: str) -> Column:
    d = _digits(v)
    body = F.concat(F.substring(d, 1, 1), permute(d.substr(F.lit(2), F.length(d) - 2), key, "card"))
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return F.when(luhn_sum(d) % 10 == 0, _lay(v, F.concat(body, check.cast("string")), "[0-9]"))


def _iban(v: Column, key: str) -> Column:
    bare = F.replace(v, F.lit(" "), F.lit(""))
    body = permute(bare.substr(F.lit(5), F.length(bare)), key, "iban")
    check = F.lpad((98 - mod97(F.concat(F.substring(bare, 1, 2), F.lit("00"), body))).cast("string"), 2, "0")
    return F.when((mod97(bare) == 1) & F.length(bare).between(15, 34), _lay(v, F.concat(F.substring(bare, 1, 2), check, body), "[0-9A-Z]"))


def _ten(d: Column, key: str) -> Column:
    """Ten digits of country code 1: a permutation of those whose area and exchange begin alike (0 and 1, or 2 to 9)."""
    at = lambda k, n=1: F.substring(d, k, n).cast("long")
    size = lambda c: F.when(c >= 2, 8).otherwise(2)
    least = lambda c: F.when(c >= 2, 2).otherwise(0)
    area, exchange = at(1), at(4)
    wide = size(exchange) * 100
    high = ((area - least(area)) * 100 + at(2, 2)) * wide + (exchange - least(exchange)) * 100 + at(5, 2)
    n = permute_number(high * 10_000 + at(7, 4), size(area) * 100 * wide, 10_000, key, "phone1")
    top, low = F.floor(n / 10_000), n % 10_000
    left, right = F.floor(top / wide), top % wide
    pad = lambda x, w: F.lpad(x.cast("string"), w, "0")
    return F.concat(pad(left + least(area) * 100, 3), pad(right + least(exchange) * 100, 3), pad(low, 4))


def _phone(v: Column, key: str) -> Column:
    d = _digits(v)
    plus = F.startswith(v, F.lit("+"))
    code = F.when(~plus, 0).when(d.rlike("^[17]"), 1).when(d.rlike("^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), 2).otherwise(3)
    rest = d.substr(code + 1, F.length(d))
    own = F.when((F.length(rest) == 10) & (~plus | (F.substring(d, 1, 1) == "1")), _ten(rest, key)).otherwise(permute(rest, key, "phone"))
    return F.when(F.length(d).between(8, 15), _lay(v, F.concat(d.substr(F.lit(1), code), own), "[0-9]"))


def _ssn(v: Column, key: str) -> Column:
    """A permutation of the valid numbers: area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    at = lambda k, n: F.substring(v, k, n).cast("long")
    area = at(1, 3) - 1 - (at(1, 3) > 666).cast("long")
    n = permute_number((area * 99 + at(5, 2) - 1) * 9999 + at(8, 4) - 1, 898 * 99, 9999, key, "ssn")
    high, low = F.floor(n / 9999), n % 9999 + 1
    first = F.floor(high / 99) + 1
    pad = lambda x, w: F.lpad(x.cast("string"), w, "0")
    out = F.concat_ws("-", pad(first + (first >= 666).cast("long"), 3), pad(high % 99 + 1, 2), pad(low, 4))
    return F.when(~v.rlike(r"^(?:000|666|9)|-00-|-0000$"), out)


def _ipv4(v: Column, key: str) -> Column:
    parts = F.split(v, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.cast("long"))
    n = permute_number(number, 65536, 65536, key, "ipv4")
    out = F.concat_ws(".", *[(F.floor(n / (256**k)) % 256).cast("string") for k in (3, 2, 1, 0)])
    return F.when(F.forall(parts, lambda p: p.cast("int") <= 255), out)


def _date(v: Column, fmt: str, key: str) -> Column:
    day = F.to_date(F.call_function("try_to_timestamp", v, F.lit(fmt)))
    first = F.lit("1900-01-01").cast("date")
    number = F.datediff(day, first).cast("long")
    inside = day.isNotNull() & number.between(0, _DAYS_HIGH * _DAYS_LOW - 1) & (F.date_format(day, fmt) == v)
    return F.when(inside, F.date_format(F.date_add(first, permute_number(number, _DAYS_HIGH, _DAYS_LOW, key, "date").cast("int")), fmt))


def _pseudonyms(v: Column, key: str) -> dict[str, Column]:
    """The value's pseudonym as each kind; null if it fails its check."""
    at = F.instr(v, "@")
    return {
        "email": F.concat(permute(v.substr(F.lit(1), at - 1), key, "email"), v.substr(at, F.length(v))),
        "iban": _iban(v, key), "card": _card(v, key), "ipv4": _ipv4(v, key), "iso": _date(v, "yyyy-MM-dd", key), "dmy": _date(v, "dd.MM.yyyy", key), "mdy": _date(v, "MM/dd/yyyy", key),
        "ssn": _ssn(v, key), "phone": _phone(v, key),
    }


def pseudonym(v: Column, kind: Column, key: str) -> Column:
    """The value's pseudonym; null if it fails its check."""
    out = F.lit(None).cast("string")
    for name, value in reversed(_pseudonyms(v, key).items()):
        out = F.when(kind == name, value).otherwise(out)
    return out


def kind_of(v: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(_KINDS):
        out = F.when(v.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def _within(v: Column, key: str) -> Column:
    """struct(out, found) of a span that fails its check: its text with the pseudonyms of the values in it, and these."""
    w = F.concat(F.lit("\n"), v, F.lit("\n\n"))  # the character before and two after, for the patterns' bounds
    n = F.length(v)

    def of_country(bare: Column) -> Column:
        country = F.substring(bare, 1, 2)
        want = F.coalesce(*[F.when(country.isin(names.split()), F.lit(k)) for k, names in _IBAN_LENGTHS.items()])
        return F.coalesce(want == F.length(bare), F.lit(True))

    def passed(i: Column, length: Column) -> Column:
        value, around = v.substr(i, length), w.substr(i, length + 3)
        kinds, of = [], _pseudonyms(value, key)
        for name, pattern in _KINDS:
            fits = around.rlike(f"(?s)^.(?:{pattern}).{{2}}$")
            if name == "iban":
                fits &= of_country(F.replace(value, F.lit(" "), F.lit("")))
            kinds.append(F.struct(i.alias("at"), length.alias("length"), F.lit(name).alias("kind"), F.when(fits, of[name]).alias("pseudonym")))
        return F.get(F.filter(F.array(*kinds), lambda x: x["pseudonym"].isNotNull()), F.lit(0))

    def longest(i: Column) -> Column:
        ends = F.filter(F.sequence(n - i + 1, F.lit(1), F.lit(-1)), lambda k: w.substr(i + k, F.lit(2)).rlike("^[0-9A-Za-z][^0-9A-Za-z]"))
        return F.get(F.filter(F.transform(ends, lambda k: passed(i, k)), lambda x: x.isNotNull()), F.lit(0))

    starts = F.filter(F.sequence(F.lit(1), n), lambda i: w.substr(i, F.lit(2)).rlike("^[^0-9A-Za-z][0-9A-Za-z+(]"))
    spans = F.filter(F.transform(starts, longest), lambda x: x.isNotNull())
    none = F.array().cast("array<struct<kind:string,pseudonym:string>>")
    begin = F.struct(F.lit(1).alias("next"), F.lit("").alias("out"), none.alias("found"))

    def take(s: Column, x: Column) -> Column:
        found = F.concat(s["found"], F.array(F.struct(x["kind"].alias("kind"), x["pseudonym"].alias("pseudonym"))))
        taken = F.struct((x["at"] + x["length"]).alias("next"), F.concat(s["out"], v.substr(s["next"], x["at"] - s["next"]), x["pseudonym"]).alias("out"), found.alias("found"))
        return F.when(x["at"] < s["next"], s).otherwise(taken)

    return F.aggregate(spans, begin, take, lambda s: F.struct(F.concat(s["out"], v.substr(s["next"], n)).alias("out"), s["found"].alias("found")))


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in the text, and ``findings``: array of struct(kind, pseudonym); a column of this name is replaced.

    The rare texts that hold a candidate take the way through arrays; each distinct value is permuted where it stands.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    key = hashlib.sha256(f"pseudonyms|{key}".encode()).hexdigest()
    text = F.col(text_col)
    suspect = text.rlike("[0-9]") | F.contains(text, F.lit("@"))
    values = F.when(F.coalesce(suspect, F.lit(False)), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    found = docs.withColumn("__v", values)
    some = F.size("__v") > 0
    changed = F.transform("__v", lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))
    found = found.withColumn("__k", F.when(some, changed))
    found = found.withColumn("__p", F.transform("__k", lambda x: F.struct(x["kind"].alias("kind"), pseudonym(x["value"], x["kind"], key).alias("pseudonym"), x["value"].alias("value"))))
    whole = lambda p: F.struct(p["pseudonym"].alias("out"), F.array(F.struct(p["kind"].alias("kind"), p["pseudonym"].alias("pseudonym"))).alias("found"))
    found = found.withColumn("__q", F.transform("__p", lambda p: F.when(p["pseudonym"].isNotNull(), whole(p)).otherwise(_within(p["value"], key))))
    between = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(between, "__q", lambda b, q: F.concat(b, F.coalesce(q["out"], F.lit("")))), "")
    findings = F.flatten(F.transform("__q", lambda q: q["found"]))
    return found.withColumn("findings", F.coalesce(findings, F.array().cast("array<struct<kind:string,pseudonym:string>>"))).withColumn(text_col, F.when(F.size("findings") > 0, joined).otherwise(text)).drop("__v", "__k", "__p", "__q")
