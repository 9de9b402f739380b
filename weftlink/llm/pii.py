"""Pseudonyms for personal numbers, dates, addresses and secrets that keep their format. DataFrame functions only.

A value is read as a number below N, the count of values of its format, and taken through a keyed permutation of
these: a Feistel network S over two halves, a shift, and S backwards. It has no fixed point, so every value changes,
and as it hangs on the key alone, equal values stay equal across documents. Check digits are computed anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The session's setting that holds the key, and the key where it is unset, as in tests: whoever knows the key can undo pseudonyms.
KEY_SETTING, KEY = "spark.weftlink.pii.key", "weftlink pseudonyms"
ROUNDS = 8
_FIRST_DAY, _DAYS = "1900-01-01", (250, 292)  # 73,000 days, up to 2099-11-12
_LETTERS, _DIGITS26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"
#: All repetitions of groups are bounded: the matcher recurs for each, and a local part has 64 characters, a domain 127 parts of 63 at most.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}+\.){1,126}[A-Za-z]{2,63}"
SECRET = r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\p{N}])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\p{L}\p{N}])"
#: North American numbers first: what follows them is not taken for more of them.
PHONE = "|".join(
    (
        r"(?<![\p{L}\p{N}+])\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}])",
        r"(?<![\p{L}\p{N}+])\+[2-9][0-9]{0,2}[ -]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ -][0-9]{2,4}){2,4}(?!\.?[\p{L}\p{N}])",
        r"(?<![\p{L}\p{N}(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![\p{L}\p{N}])",
        r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\p{L}\p{N}-])",
    )
)
IP = r"(?<![\p{L}\p{N}.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[\p{L}\p{N}])"
SOCIAL = r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"
DATE = r"(?<![\p{L}\p{N}/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\p{L}\p{N}/-])"
CARD = r"(?<![\p{L}\p{N}])(?:[0-9]{13,19}|(?:[0-9]{4} ){3}[0-9]{4}|(?:[0-9]{4}-){3}[0-9]{4}|[0-9]{4} [0-9]{6} [0-9]{5})(?![\p{L}\p{N}])"
KINDS = {"email": EMAIL, "secret": SECRET, "iban": IBAN, "phone": PHONE, "ip": IP, "social": SOCIAL, "date": DATE, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())


def _round(key: str, tweak: Column, i: Column, half: Column, modulus: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def _feistel(x: Column, a: Column, b: Column, key: str, tweak: Column, forward: bool) -> Column:
    """The network over pairs (left below a, right below b); a number is left * b + right."""
    sign = 1 if forward else -1
    start = F.struct(_div(x, b).alias("l"), F.pmod(x, b).alias("r"))

    def step(acc: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, F.pmod(acc["l"] + sign * _round(key, tweak, i, acc["r"], a), a)).otherwise(acc["l"])
        right = F.when(i % 2 == 1, F.pmod(acc["r"] + sign * _round(key, tweak, i, acc["l"], b), b)).otherwise(acc["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    order = range(ROUNDS) if forward else reversed(range(ROUNDS))
    return F.aggregate(F.array(*[F.lit(i) for i in order]), start, step, lambda acc: acc["l"] * b + acc["r"])


def _div(x: Column, b: Column) -> Column:
    """Whole quotient of numbers from 0 up, without the rounding of a division of doubles."""
    return F.call_function("div", x, b)


def permute(x: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """The number that x (below a * b) becomes: never x itself, where a * b is above 1."""
    n = a * b
    shift = F.lit(1).cast("long") + F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, F.lit("shift")), 256), 1, 15), 16, 10).cast("long"), n - 1)
    return _feistel(F.pmod(_feistel(x, a, b, key, tweak, True) + shift, n), a, b, key, tweak, False)


def _power(base: int, n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(0), n), F.lit(1).cast("long"), lambda acc, i: F.when(i > 0, acc * base).otherwise(acc))


def _string(s: Column, base: int, key: str, tweak: Column) -> Column:
    """Digits of `base` (10, 16 or 26, small letters), permuted among the strings of their length; up to 18, 14 or 12."""
    n = F.length(s)
    half = F.floor(n / 2).cast("int")
    to = permute(F.conv(s, base, 10).cast("long"), _power(base, n - half), _power(base, half), key, tweak)
    return F.lpad(F.lower(F.conv(to.cast("string"), 10, base)), n, "0")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _filled(form: Column, digits: Column) -> Column:
    """form with its digits replaced by digits, in order."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(acc["o"], F.when(digit, F.substr(digits, acc["k"], F.lit(1))).otherwise(c)).alias("o"), (acc["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(F.split(form, ""), start, step, lambda acc: acc["o"])


def _luhn(digits: Column, doubled: int) -> Column:
    """The Luhn sum of digits; every second from the right counts double, the last one if doubled is 0."""

    def term(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when(i % 2 == doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), term), F.lit(0), lambda acc, d: acc + d)


def is_card(m: Column) -> Column:
    return _luhn(_digits(m), 1) % 10 == 0


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = _string(F.substr(d, F.lit(1), F.length(d) - 1), 10, key, F.lit("card"))
    return _filled(m, F.concat(body, ((10 - _luhn(body, 0) % 10) % 10).cast("string")))


def _mod97(s: Column) -> Column:
    """The remainder of s, with letters as 10 to 35, by 97."""
    return F.aggregate(F.split(s, ""), F.lit(0), lambda acc, c: F.when(c.rlike("^[0-9]$"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97)


def is_iban(m: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    return F.length(plain).between(15, 34) & (_mod97(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))) == 1)


def _iban(m: Column, key: str) -> Column:
    """The account number's digits permuted, in pieces of up to 15 of them, each under those before it."""
    plain = F.regexp_replace(m, " ", "")
    account, country = F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(2))
    new = _filled(account, F.array_join(_pieces(_digits(account), ".{1,15}", lambda s, before: _string(s, 10, key, F.concat(F.lit("iban"), country, before))), ""))
    check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    whole = F.concat(country, check, new)
    # back into the written form with its blanks
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        blank = c == " "
        return F.struct(F.concat(acc["o"], F.when(blank, c).otherwise(F.substr(whole, acc["k"], F.lit(1)))).alias("o"), (acc["k"] + 1 - blank.cast("int")).alias("k"))

    return F.aggregate(F.split(m, ""), start, step, lambda acc: acc["o"])


def _pieces(s: Column, pattern: str, change) -> Column:
    """The pieces of s that pattern splits it into, changed by change(piece, all of s before it)."""
    found = F.regexp_extract_all(s, F.lit(f"({pattern})"))
    return F.transform(found, lambda p, i: change(p, F.array_join(F.slice(found, F.lit(1), i), "")))


def _letters(s: Column, key: str, tweak: Column) -> Column:
    return F.translate(_string(F.translate(s, _LETTERS, _DIGITS26), 26, key, tweak), _DIGITS26, _LETTERS)


def _email(m: Column, key: str) -> Column:
    """The local part's letters a to z and digits, in pieces of one kind, each under the pieces before it; the domain stays."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)

    def change(p: Column, before: Column) -> Column:
        tweak = F.concat(F.lit("email"), F.lower(before), F.lit("@"), F.lower(domain))
        return F.when(p.rlike("^[0-9]"), _string(p, 10, key, tweak)).when(p.rlike("^[a-z]"), _letters(p, key, tweak)).when(p.rlike("^[A-Z]"), F.upper(_letters(F.lower(p), key, tweak))).otherwise(p)

    return F.concat(F.array_join(_pieces(local, "[0-9]{1,17}|[a-z]{1,12}|[A-Z]{1,12}|[^0-9a-zA-Z]+", change), ""), F.lit("@"), domain)


def _secret(m: Column, key: str) -> Column:
    low = F.lower(m)
    new = F.array_join(_pieces(low, ".{1,12}", lambda p, before: _string(p, 16, key, F.concat(F.lit("secret"), before))), "")
    return F.when(m == low, new).otherwise(F.upper(new))


def is_ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)


def _ip(m: Column, key: str) -> Column:
    value = F.aggregate(F.split(m, r"\."), F.lit(0).cast("long"), lambda acc, o: acc * 256 + o.cast("long"))
    half = F.lit(1 << 16).cast("long")
    new = permute(value, half, half, key, F.lit("ip"))
    return F.concat_ws(".", *[F.shiftright(new, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def _day(m: Column) -> Column:
    """Days since the first day, null for what is no date."""
    d, form = F.regexp_replace(m, r"[/.]", "-"), F.substr(m, F.lit(5), F.lit(1)) == "-"
    iso = F.when(form, d).otherwise(F.concat_ws("-", F.substr(d, F.lit(7), F.lit(4)), F.substr(d, F.lit(4), F.lit(2)), F.substr(d, F.lit(1), F.lit(2))))
    return F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit(_FIRST_DAY).cast("date"))


def is_date(m: Column) -> Column:
    return F.coalesce(_day(m).between(0, _DAYS[0] * _DAYS[1] - 1), F.lit(False))


def _date(m: Column, key: str) -> Column:
    new = F.date_add(F.lit(_FIRST_DAY).cast("date"), permute(_day(m).cast("long"), F.lit(_DAYS[0]).cast("long"), F.lit(_DAYS[1]).cast("long"), key, F.lit("date")).cast("int"))
    return F.when(m.contains("-"), F.date_format(new, "yyyy-MM-dd")).when(m.contains("/"), F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy"))


def is_social(m: Column) -> Column:
    return ~m.rlike("^(000|666|9)|-00-|-0000$")


def _number(m: Column, key: str, kind: str) -> Column:
    return _filled(m, _string(_digits(m), 10, key, F.lit(kind)))


def kind_of(m: Column) -> Column:
    """The kind of a match of ANY, null where it is not valid."""
    whole = {k: m.rlike(f"^(?:{p})$") for k, p in KINDS.items()}
    valid = {"iban": is_iban(m), "ip": is_ip(m), "social": is_social(m), "date": is_date(m), "card": is_card(m), "phone": F.length(_digits(m)).between(7, 15)}
    out = F.when(whole["email"], F.lit("email"))
    for kind in list(KINDS)[1:]:
        out = out.when(whole[kind], F.when(valid[kind], F.lit(kind)) if kind in valid else F.lit(kind))
    return out


def _pseudonym(kind: Column, m: Column, key: str) -> Column:
    return (
        F.when(kind == "email", _email(m, key)).when(kind == "secret", _secret(m, key)).when(kind == "iban", _iban(m, key)).when(kind == "ip", _ip(m, key))
        .when(kind == "date", _date(m, key)).when(kind == "card", _card(m, key)).when(kind == "phone", _number(m, key, "phone")).when(kind == "social", _number(m, key, "social")).otherwise(m)
    )


def _has(kind: str):
    return lambda x: x["kind"] == kind


def pseudonymize(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs (text, ...) with its validated values replaced, and n_values, their number, and n_<kind> for each kind.

    key: of the permutations; by default the session's KEY_SETTING, and KEY where that is unset. Dates are valid if
    they exist from 1900-01-01 to 2099-11-12, cards by their Luhn digit, account numbers by their remainder, IP
    addresses by their bytes, social numbers by their ranges; phone numbers, mail addresses and hexadecimal secrets of
    32 to 64 digits by their form. All other text stays as it is, invalid numbers included. Null and empty texts stay,
    with 0 values; texts of any length are read whole. Rows are independent, so repeated rows stay equal; columns with
    the added names are replaced; an empty table gives no rows.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    added = ["n_values", *[f"n_{k}" for k in KINDS]]
    before = docs.drop(*added)
    some = F.col("text").rlike("[0-9@]")
    found = before.withColumn("_m", F.when(some, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    found = found.withColumn("_m", F.transform("_m", lambda m: F.struct(kind_of(m).alias("kind"), m.alias("m"))))
    found = found.withColumn("_new", F.when(F.size("_m") > 0, F.transform("_m", lambda x: _pseudonym(x["kind"], x["m"], key))))
    between = F.split("text", ANY, -1)
    text = F.array_join(F.flatten(F.zip_with(between, F.col("_new"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    out = found.withColumn("text", F.when(F.size("_m") > 0, text).otherwise(F.col("text")))
    counts = {f"n_{k}": F.when(F.col("_m").isNull(), 0).otherwise(F.size(F.filter("_m", _has(k)))) for k in KINDS}
    out = out.withColumns(counts).withColumn("n_values", reduce(lambda a, b: a + b, [F.col(c) for c in counts]))
    return out.select(*before.columns, *added)
