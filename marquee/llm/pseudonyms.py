"""Pseudonyms of personal numbers and dates that keep their format, by a keyed Feistel permutation.

Payment cards (checked by Luhn), IBANs (checked by their own check digits), social security numbers (checked by their
blocked ranges), telephone numbers (7 to 15 digits behind a plus sign, or in groups) and numeric dates (checked by the
calendar) are found in a text. The digits and letters, or the number of the day, of a found value are permuted within its
kind and length; of an IBAN, digits stay digits and letters letters behind the country code; separators, grouping and check digits stay right. The permutation depends only on kind, length and key, so
equal values get equal pseudonyms in all documents, and different values different ones.

Everything is built-in functions: a text is split at what the pattern finds, and the pieces are joined with the
pseudonyms. Rounds fold over a pair of halves, each round adding a keyed hash of one half to the other.

Defined results: a null text stays null and has no values. Values that fail their check stay as they are. Dates
outside 1900 to 2099 stay. Of a date like 03/04/2024 the month comes first if it can; dates with dots begin with the day. Repeated rows are treated alike; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Days from 1900-01-01 to 2099-12-31: their number is the product of these two.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)
#: Areas and groups, and serials, of social security numbers: 001 to 899 without 666, 01 to 99, 0001 to 9999.
AREAS, GROUPS, SERIALS = 898, 99, 9999

CARD = r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5}"
#: Countries by the length of their IBANs.
IBANS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
         22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
         25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
         29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _of_length(n: int, countries: str) -> str:
    whole, rest = divmod(n - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{whole}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


#: Of countries that are not listed, those with digits only.
IBAN = "|".join(rf"{_of_length(n, c)}(?![\w-])" for n, c in IBANS.items()) + r"|[A-Z]{2}\d{2} ?(?:\d{4} ?){2,7}\d{1,4}"
SSN = r"\d{3}-\d{2}-\d{4}"
DATE = "|".join([*[rf"\d{{4}}{x}\d{{2}}{x}\d{{2}}" for x in ("-", "/", r"\.")], *[rf"\d{{2}}{x}\d{{2}}{x}\d{{4}}" for x in ("-", "/", r"\.")]])
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}"
FOUND = rf"(?<![\w.+-])(?:{IBAN}|{SSN}|{DATE}|{CARD}|{PHONE})(?![\w-])"


def _hash(key: str, kind: Column, round_: Column, half: Column) -> Column:
    """A number of 52 bits from a keyed hash."""
    text = F.concat_ws("|", F.lit(key), kind, round_.cast("string"), half.cast("string"))
    return F.conv(F.left(F.sha2(text, 256), F.lit(13)), 16, 10).cast("bigint")


def _permuted(key: str, kind: Column, left: Column, right: Column, of_left: Column, of_right: Column) -> Column:
    """Feistel rounds on (left, right) in Z_of_left x Z_of_right: in turn, each half is shifted by a hash of the other."""
    def step(state: Column, i: Column) -> Column:
        a, b = state["a"], state["b"]
        even = i % 2 == 0
        return F.struct(
            F.when(even, a).otherwise(F.pmod(a + _hash(key, kind, i, b), of_left)).alias("a"),
            F.when(even, F.pmod(b + _hash(key, kind, i, a), of_right)).otherwise(b).alias("b"))

    start = F.struct(left.cast("bigint").alias("a"), right.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _chars_permuted(key: str, kind: Column, chars: Column, radix: int = 10, zero: int = 48) -> Column:
    """A string of up to 30 digits, or of up to 26 letters with radix 26 from `A`, as another one of the same length."""
    n = F.length(chars)
    half = F.floor(n / 2).cast("int")

    def number(text: Column) -> Column:
        return F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), lambda v, c: F.when(c == "", v).otherwise(v * radix + F.ascii(c) - zero))

    def many(length: Column) -> Column:
        return F.aggregate(F.array_repeat(F.lit(radix), length), F.lit(1).cast("bigint"), lambda v, r: v * r)

    def text(value: Column, length: Column) -> Column:
        start = F.struct(value.alias("v"), F.lit("").alias("t"))
        return F.aggregate(F.array_repeat(F.lit(radix), length), start, lambda s, r: F.struct(
            F.call_function("div", s["v"], r).alias("v"),
            F.concat(F.char((s["v"] % r + zero).cast("bigint")), s["t"]).alias("t")), lambda s: s["t"])

    state = _permuted(key, F.concat_ws(":", kind, n), number(F.substring(chars, F.lit(1), half)), number(F.substring(chars, half + 1, n)),
                      many(half), many(n - half))
    return F.aggregate(F.array(state), F.lit(""), lambda _, s: F.concat(text(s["a"], half), text(s["b"], n - half)))


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of the digits, the last one undoubled."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _rest97(chars: Column) -> Column:
    """A string of digits and capitals, A being 10, of any length modulo 97."""
    return F.aggregate(F.split(chars, ""), F.lit(0), lambda r, c: F.when(c == "", r).when(c >= "A", (r * 100 + F.ascii(c) - 55) % 97)
                       .otherwise((r * 10 + F.ascii(c) - 48) % 97))


def _refilled(pattern: Column, chars: Column, places: str = r"^\d$") -> Column:
    """The pattern with its digits, or what else `places` tells, replaced from the left by other characters."""
    def put(state: Column, c: Column) -> Column:
        here = c.rlike(places)
        return F.struct(
            F.concat(state["text"], F.when(here, F.substring(chars, state["at"], F.lit(1))).otherwise(c)).alias("text"),
            (state["at"] + here.cast("int")).alias("at"))

    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))
    return F.aggregate(F.split(pattern, ""), start, put, lambda s: s["text"])


def _account(value: Column, key: str) -> Column:
    """The part of an IBAN behind its check digits, with digits and letters permuted each among themselves."""
    body = F.substring(F.replace(value, F.lit(" "), F.lit("")), F.lit(5), F.lit(40))
    digits, letters = F.regexp_replace(body, r"\D", ""), F.regexp_replace(body, r"\d", "")
    kind = F.concat(F.lit("iban"), F.left(value, F.lit(2)), F.regexp_replace(F.regexp_replace(body, r"\d", "0"), "[A-Z]", "A"))
    of_letters = F.concat_ws(":", kind, digits)
    moved = F.concat(_chars_permuted(key, of_letters, F.left(letters, F.lit(26)), 26, 65),
                     _chars_permuted(key, F.concat(of_letters, F.lit("+")), F.substring(letters, F.lit(27), F.lit(14)), 26, 65))
    return F.when(letters == "", _chars_permuted(key, kind, digits)).otherwise(
        _refilled(_refilled(body, _chars_permuted(key, kind, digits)), moved, "^[A-Z]$"))


def _date_order(value: Column) -> Column:
    """ymd, dmy or mdy."""
    month_first = F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 1, 2), F.substring(value, 4, 2))
    return (F.when(value.rlike(r"^\d{4}"), "ymd").when(value.contains("."), "dmy")
            .when(F.try_to_date(month_first, "yyyy-MM-dd").isNotNull(), "mdy").otherwise("dmy"))


def _date(value: Column) -> Column:
    """The day that a numeric date names; null if there is none."""
    order, year = _date_order(value), F.substring(value, 7, 4)
    first, second = F.substring(value, 1, 2), F.substring(value, 4, 2)
    iso = (F.when(order == "ymd", F.translate(value, "/.", "--")).when(order == "mdy", F.concat_ws("-", year, first, second))
           .otherwise(F.concat_ws("-", year, second, first)))
    return F.try_to_date(iso, "yyyy-MM-dd")


def _date_moved(value: Column, key: str) -> Column:
    """Another date in the same form. Equal days give equal days, whatever their forms: the day is permuted, then written.

    Between slashes or hyphens, a day up to 12 in front would be read as a month, so such a day is written behind its month.
    """
    order = _date_order(value)
    day = F.datediff(_date(value), F.lit(FIRST_DAY).cast("date"))
    state = _permuted(key, F.lit("date"), day % DAYS[0], F.floor(day / DAYS[0]), F.lit(DAYS[0]), F.lit(DAYS[1]))
    new = F.aggregate(F.array(state), F.lit(FIRST_DAY).cast("date"),
                      lambda _, s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["b"] * DAYS[0] + s["a"]).cast("int")))
    order = F.when((order == "dmy") & ~value.contains(".") & (F.dayofmonth(new) <= 12), "mdy").otherwise(order)
    y, m, d = (F.date_format(new, x) for x in ("yyyy", "MM", "dd"))
    mark = F.when(value.rlike(r"^\d{4}"), F.substring(value, 5, 1)).otherwise(F.substring(value, 3, 1))
    return (F.when(order == "ymd", F.concat(y, mark, m, mark, d)).when(order == "mdy", F.concat(m, mark, d, mark, y))
            .otherwise(F.concat(d, mark, m, mark, y)))


def _ssn_moved(digits: Column, key: str) -> Column:
    """Another social security number, from all that are not blocked."""
    area, group, serial = (F.substring(digits, F.lit(i), F.lit(n)).cast("bigint") for i, n in ((1, 3), (4, 2), (6, 4)))
    left = (area - 1 - (area > 666).cast("int")) * GROUPS + group - 1
    moved = _permuted(key, F.lit("ssn"), left, serial - 1, F.lit(AREAS * GROUPS), F.lit(SERIALS))

    def written(s: Column) -> Column:
        at = F.floor(s["a"] / GROUPS)
        return F.concat_ws("-", F.lpad((at + 1 + (at >= 665).cast("int")).cast("string"), F.lit(3), F.lit("0")),
                           F.lpad((s["a"] % GROUPS + 1).cast("string"), F.lit(2), F.lit("0")),
                           F.lpad((s["b"] + 1).cast("string"), F.lit(4), F.lit("0")))

    return F.aggregate(F.array(moved), F.lit(""), lambda _, s: written(s))


def kind_of(value: Column) -> Column:
    """card, iban, ssn, date or phone; null for a value that fails its check."""
    digits = F.regexp_replace(value, r"\D", "")
    n = F.length(digits)
    date = _date(value)
    plain_iban = F.replace(value, F.lit(" "), F.lit(""))
    whole = F.rlike(value, F.lit(rf"^(?:{DATE})$"))
    return (F.when(whole, F.when(date.between(F.lit(FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date")), "date"))
            .when(value.rlike(rf"^(?:{SSN})$"), F.when(~value.rlike(r"^(000|666|9)") & ~value.rlike(r"-00-|-0000$"), "ssn"))
            .when(value.rlike(r"^[A-Z]{2}"), F.when(
                _rest97(F.concat(F.substring(plain_iban, F.lit(5), F.lit(40)), F.left(plain_iban, F.lit(4)))) == 1, "iban"))
            .when(value.rlike(rf"^(?:{CARD})$") & n.between(13, 19) & (_luhn_sum(digits) % 10 == 0), "card")
            .when(value.rlike(rf"^(?:{PHONE})$") & n.between(7, 15), "phone"))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a value that passes its check; others as they are."""
    kind, digits = kind_of(value), F.regexp_replace(value, r"\D", "")
    n = F.length(digits)
    body = _chars_permuted(key, F.lit("card"), F.substring(digits, F.lit(1), n - 1))
    card = F.aggregate(F.array(body), F.lit(""), lambda _, x: F.concat(
        x, F.pmod(10 - _luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))
    iban = F.aggregate(F.array(_account(value, key)), F.lit(""), lambda _, x: F.concat(
        F.left(value, F.lit(2)), F.lpad((98 - _rest97(F.concat(x, F.left(value, F.lit(2)), F.lit("00")))).cast("string"), F.lit(2), F.lit("0")), x))
    return (F.when(kind == "date", _date_moved(value, key))
            .when(kind == "ssn", _ssn_moved(digits, key))
            .when(kind == "card", _refilled(value, card))
            .when(kind == "iban", _refilled(value, iban, "^[A-Z0-9]$"))
            .when(kind == "phone", _refilled(value, _chars_permuted(key, F.lit("phone"), digits)))
            .otherwise(value))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text with pseudonyms, and `values`: kind, value and pseudonym of all that was found and checked."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.select("id", "text", F.regexp_extract_all("text", F.lit(FOUND), F.lit(0)).alias("found"))
    mapped = found.withColumn("made", F.transform("found", lambda v: F.struct(
        kind_of(v).alias("kind"), v.alias("value"), pseudonym(v, key).alias("pseudonym"))))
    joined = F.when(F.size("made") == 0, text).otherwise(F.array_join(F.zip_with(
        F.split(text, FOUND, -1), F.col("made"), lambda gap, m: F.concat(gap, F.coalesce(m["pseudonym"], F.lit("")))), ""))
    return mapped.select(F.col("id").alias(id_col), joined.alias("text"),
                         F.filter("made", lambda m: m["kind"].isNotNull()).alias("values"))
