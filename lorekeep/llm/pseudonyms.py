"""Format-preserving pseudonyms for personal data (DataFrame functions only).

One pattern finds e-mail addresses, by their shape, and runs of digits and separators. Inside a run every place where a
value may begin is tried, and what is found is validated: calendar dates by the calendar, IPv4 addresses by their range,
phone numbers by their digit count, payment cards by their check digit. Values of a telling shape go first, so that no
phone number or card runs into its neighbour; then, in what they leave, looser ones (see ``PASSES``). A valid value is
permuted by a keyed Feistel network inside its own format: a value is split into two halves, and in each round one
half is shifted, modulo its own size, by a keyed SHA-256 of the other. That is a permutation of the format's values,
so equal values get equal pseudonyms in every document, and different values different ones.

- Cards, phone numbers, addresses: separators stay where they are, and one number in several spellings is one value. A
  card's check digit is computed anew, so a card stays a valid card. A phone number after a ``+`` keeps its country code; one
  without a ``+`` has none, and isn't linked with its international form.
- Dates: of any year from 0000 to 9999. Those of ERA stay in it, so that usual dates stay usual, all others stay outside.
  ``dd/MM/yyyy`` counts before ``MM/dd/yyyy``; a date that is one only in the second order (its day is above 12) becomes
  another such, by permuting until one comes up (in WALK steps: fewer than one in 10**24 take more, and keep what came up last).
- E-mail addresses: in lower case, each letter becomes a letter and each digit a digit, over name and domain together; the
  rest stays, and ``.invalid`` is appended, so that no pseudonym is anyone's address.

A text is split at the matches and joined again with their replacements, all in the JVM; nothing is shuffled.

Defined results: a null text stays null, with no values; a text without valid values is returned as it is; candidates that
fail validation stay; equal values in repeated rows get equal pseudonyms; an empty table gives an empty table; the
input's columns pass through, and helper columns carry the prefix ``__p_``, which input columns may not use.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = "__p_"
ROUNDS = 8

#: What may be a value: each kind's pattern, in the order in which they are tried at a place.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d./-]*\d)"
IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)"
CARD = r"\d(?:[ -]?\d){12,18}(?!\d)"
#: Phone numbers in their national groups, and cards in one piece or as they are printed.
GROUPED = r"\+\d{1,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)"
PRINTED = r"\d{13,19}(?!\d)|\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?!\d)|3\d{3}[ -]?\d{6}[ -]?\d{4,5}(?!\d)"
#: A number with so many further groups; a card of so many digits in groups of three or more.
PHONES = tuple(PHONE.split("|")[0].replace("{1,4}(?!", f"{{{k}}}(?!") for k in (4, 3, 2, 1))
CARDS = tuple(rf"\d(?:(?:[ -](?=\d{{3}})(?<=\d{{3}}[ -]))?\d){{{n - 1}}}(?!\d)" for n in range(19, 12, -1))
#: (kind, patterns in order) of each pass over what the passes before left of a run. The last takes cards as they come,
#: from left to right, in groups of any size: in a list of short numbers, one of ten spans has a right check digit by chance.
PASSES = (
    (("date", rf"(?<![\d./+-]){DATE}"), ("ip", rf"(?<![\d.]){IP}"), ("phone", rf"(?<![\d+])(?:{GROUPED})"), ("card", rf"(?<![\d+])(?:{PRINTED})")),
    (*(("phone", rf"(?<![\d+]){x}") for x in PHONES), *(("card", rf"(?<!\d){x}") for x in CARDS)),
    (("card", rf"(?<!\d){CARD}"),),
)
#: Characters of a value and around it that a pattern may look at.
WINDOW = 80
#: A run of digits and separators, which doesn't end inside an address; an address may not begin inside a longer word.
RUN = rf"[./()+-]*\d(?:[\d ./()+-]{{6,}}(?<=\d))(?![A-Za-z0-9._%+-]{{0,63}}{EMAIL[EMAIL.index('@'):]})"
CANDIDATE = rf"(?<![A-Za-z0-9._%+-]){EMAIL}|{RUN}"
#: Every candidate has one of these: a cheap test before the pattern.
HINT = r"[@]|\d[\d ./()-]{5}"

#: Days from 0000-01-01 to 1970-01-01, and to 9999-12-31.
EPOCH, LAST_DAY = 719_528, 3_652_424
#: 1900-01-01 to 2099-12-31 as days since 0000-01-01: the first, and how many (17 * 4297). All others: 16 * 223,711.
ERA, ERA_DAYS = 693_961, 73_049
ERA_SIDES, OTHER_SIDES = (17, 4297), (16, 223_711)
#: Steps in which a date looks for one of its order.
WALK = 64
#: The country codes of one and of two digits; all others have three.
COUNTRY_ONE = "^[17]"
COUNTRY_TWO = "^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digest(key: str, parts: list[Column]) -> Column:
    """The first 60 bits of SHA-256 over the key and the parts, as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), *(p.cast("string") for p in parts)), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the pairs (left, right) with left < a and right < b, as a struct of ``l`` and ``r``.

    Even rounds shift the left half by a digest of the right, odd rounds the right half by one of the left; each can be
    undone, so all of them together can.
    """
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        shift = _digest(key, [tweak, i, F.when(even, acc["r"]).otherwise(acc["l"])])
        return F.struct(
            F.when(even, F.pmod(acc["l"] + F.pmod(shift, a), a)).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + F.pmod(shift, b), b)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    kind = F.concat(F.lit(tweak), F.lit("/"), n.cast("string"))
    out = feistel(F.substr(digits, F.lit(1), u).cast("long"), F.substr(digits, u + 1, v).cast("long"), power(u), power(v), key, kind)
    return _let(out, lambda x: F.concat(F.lpad(x["l"].cast("string"), u, "0"), F.lpad(x["r"].cast("string"), v, "0")))


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The check sum; ``doubled``: whether the last digit's distance from the end counts as 0 (every second one is
    doubled from the next on) or 1 (from this one on)."""
    n = F.length(digits)
    at = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substr(digits, i, F.lit(1)).cast("int").alias("d"), ((n - i + doubled) % 2 == 1).alias("twice")))
    values = F.transform(at, lambda x: F.when(x["twice"], F.when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2)).otherwise(x["d"]))
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def _refill(shape: Column, digits: Column, places: str = "^[0-9]$") -> Column:
    """``digits`` put in place of the digits (or other ``places``) of ``shape``, one by one."""
    chars = F.split(shape, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda acc, c: F.when(
        c.rlike(places), F.struct(F.concat(acc["out"], F.substr(digits, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))
    ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at")))
    return F.aggregate(chars, start, step)["out"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def is_card(value: Column) -> Column:
    return _let(_digits(value), lambda d: F.length(d).between(13, 19) & ~d.rlike(r"^(\d)\1*$") & (luhn_sum(d, 0) % 10 == 0))


def card(value: Column, key: str) -> Column:
    """All digits but the check digit are permuted; that one follows."""
    body = _let(_digits(value), lambda d: _let(F.substr(d, F.lit(1), F.length(d) - 1), lambda x: permute_digits(x, key, "card")))
    return _refill(value, _let(body, lambda x: F.concat(x, ((10 - luhn_sum(x, 1) % 10) % 10).cast("string"))))


#: Date formats by the pattern that tells them: Spark's names for their parts.
FORMATS = ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{4}/", "yyyy/MM/dd"), (r"^\d{2}/", "dd/MM/yyyy"), (r"^\d{2}\.", "dd.MM.yyyy"))
SLASH, MONTH_FIRST = FORMATS[2][0], "MM/dd/yyyy"


def _day(value: Column) -> Column:
    """Days since 0000-01-01; null if it is no date of the calendar. A date with slashes may be written in either order."""
    tried = (*FORMATS, (SLASH, MONTH_FIRST))
    parsed = F.coalesce(*(F.when(value.rlike(test), F.try_to_timestamp(value, F.lit(f))) for test, f in tried))
    return F.unix_date(F.to_date(parsed)) + EPOCH


def _moved(day: Column, key: str) -> Column:
    """The day's pseudonym."""
    era = day.between(ERA, ERA + ERA_DAYS - 1)
    pick = lambda a, b: F.when(era, F.lit(a)).otherwise(F.lit(b))
    a, b = (pick(*sides) for sides in zip(ERA_SIDES, OTHER_SIDES, strict=True))
    place = F.when(era, day - ERA).otherwise(F.when(day < ERA, day).otherwise(day - ERA_DAYS))
    out = _let(place, lambda x: feistel(F.floor(x / b), x % b, a, b, key, pick("date/era", "date")))
    placed = _let(out, lambda x: (x["l"] * b + x["r"]).cast("int"))
    return _let(placed, lambda x: F.when(era, x + ERA).otherwise(F.when(x < ERA, x).otherwise(x + ERA_DAYS)))


def _calendar(day: Column) -> Column:
    return F.date_from_unix_date(day - EPOCH)


def date(value: Column, key: str) -> Column:
    month_first = value.rlike(SLASH) & F.try_to_timestamp(value, F.lit(FORMATS[2][1])).isNull()
    start = F.struct(_day(value).cast("int").alias("day"), F.lit(False).alias("done"))

    def step(acc: Column, _: Column) -> Column:
        new = _let(_moved(acc["day"], key), lambda day: F.struct(day.alias("day"), (F.dayofmonth(_calendar(day)) > 12).alias("done")))
        return F.when(acc["done"], acc).otherwise(new)

    steps = F.sequence(F.lit(1), F.when(month_first, F.lit(WALK)).otherwise(F.lit(1)))
    form = F.when(month_first, F.lit(MONTH_FIRST)).otherwise(F.coalesce(*(F.when(value.rlike(test), F.lit(f)) for test, f in FORMATS)))
    return F.call_function("date_format", _calendar(F.aggregate(steps, start, step)["day"]), form)


def is_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda x: x.cast("int") < 256)  # three digits at most, by the pattern


def ip(value: Column, key: str) -> Column:
    side = F.lit(65536)
    pair = lambda o, k: F.get(o, k).cast("int") * 256 + F.get(o, k + 1).cast("int")
    out = _let(F.split(value, r"\."), lambda o: feistel(pair(o, 0), pair(o, 2), side, side, key, F.lit("ip")))
    part = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    return _let(out, lambda x: F.concat_ws(".", part(x["l"]), part(x["r"])))


def is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(8, 15)


def phone(value: Column, key: str) -> Column:
    """The country code after a ``+`` stays, however it is spaced; the other digits are permuted."""
    code = lambda d: F.when(~value.startswith("+"), 0).when(d.rlike(COUNTRY_ONE), 1).when(d.rlike(COUNTRY_TWO), 2).otherwise(3)
    parts = lambda d: _let(code(d), lambda k: F.struct(F.substr(d, F.lit(1), k).alias("code"), F.substr(d, k + 1, F.length(d)).alias("rest")))
    return _refill(value, _let(_let(_digits(value), parts), lambda x: F.concat(x["code"], permute_digits(x["rest"], key, "phone"))))


#: Letters and digits of an address, one by one, and the hex digits of a hash that shift one of them.
SIGN, SIGN_HEX = "^[a-z0-9]$", 4


def _shift(half: Column, other: Column, key: str, turn: Column) -> Column:
    """Each sign of ``half`` shifted, within its own kind, by a keyed stream over ``other``."""
    said = F.array_join(F.transform(other, lambda x: x["v"].cast("string")), ",")
    block = lambda b: F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), turn.cast("string"), b.cast("string"), said), 256)
    stream = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.size(half) * SIGN_HEX / 64).cast("int")), block), "")
    by = lambda s, k: F.conv(F.substr(s, k * SIGN_HEX + 1, F.lit(SIGN_HEX)), 16, 10).cast("int")
    return _let(stream, lambda s: F.transform(half, lambda x, k: F.struct(((x["v"] + by(s, k)) % x["n"]).alias("v"), x["n"].alias("n"))))


def email(value: Column, key: str) -> Column:
    """Letters and digits of the address in lower case, permuted by their kinds."""
    low = F.lower(value)
    signs = F.filter(F.split(low, ""), lambda c: c.rlike(SIGN))
    digit = lambda c: c < "a"
    coded = F.transform(signs, lambda c: F.struct((F.ascii(c) - F.when(digit(c), 48).otherwise(97)).alias("v"), F.when(digit(c), 10).otherwise(26).alias("n")))
    half = lambda x: F.floor(F.size(x) / 2).cast("int")
    start = _let(coded, lambda x: F.struct(F.slice(x, F.lit(1), half(x)).alias("l"), F.slice(x, half(x) + 1, F.size(x)).alias("r")))

    def turn(acc: Column, i: Column) -> Column:
        even = F.struct(_shift(acc["l"], acc["r"], key, i).alias("l"), acc["r"].alias("r"))
        return F.when(i % 2 == 0, even).otherwise(F.struct(acc["l"].alias("l"), _shift(acc["r"], acc["l"], key, i).alias("r")))

    both = lambda out: F.transform(F.concat(out["l"], out["r"]), lambda x: F.chr(x["v"] + F.when(x["n"] == 10, 48).otherwise(97)))
    written = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda out: F.array_join(both(out), ""))
    return F.concat(_refill(low, written, SIGN), F.lit(".invalid"))


#: (kind, validation, pseudonym)
KINDS = (
    ("email", lambda v: F.lit(True), email),
    ("date", lambda v: _day(v).isNotNull(), date),
    ("ip", is_ip, ip),
    ("phone", is_phone, phone),
    ("card", is_card, card),
)


def _valid(kind: Column, value: Column, of: set[str]) -> Column:
    """Whether the value is one of its kind, which is one ``of`` these."""
    return reduce(lambda otherwise, k: F.when(kind == k[0], k[1](value)).otherwise(otherwise), [k for k in KINDS if k[0] in of], F.lit(False))


def _part(kind: Column, value: Column) -> Column:
    return F.struct(kind.cast("string").alias("kind"), value.alias("value"))


def _split(text: Column, options: tuple[tuple[str, str], ...], last: bool) -> Column:
    """Parts of ``text``, in order: values found with a kind, what is between them without.

    At each place the first valid option counts. In the last pass an invalid one takes its place too, as part of no kind.
    """
    # Both are found by one scan: the text cut before each place, and what a pattern may see there, one character before included.
    seen = F.concat(F.lit("\n"), text)
    chunks = F.split(seen, r"(?=[+(]|(?<!\d)\d)", -1)
    windows = F.regexp_extract_all(seen, F.lit(rf"(?=([\s\S](?:[+(]|(?<!\d)\d)[\s\S]{{0,{WINDOW}}}))"), 1)
    tried = lambda w: F.array(*(_part(F.lit(kind), F.regexp_extract(w, rf"^[\s\S]({pattern})", 1)) for kind, pattern in options))
    of = {kind for kind, _ in options}
    if last:
        taken = lambda x: F.when(x["value"] != "", _part(F.when(_valid(x["kind"], x["value"], of), x["kind"]), x["value"]))
        first = lambda w: F.get(F.transform(tried(w), taken), F.lit(0))
    else:
        first = lambda w: F.get(F.filter(tried(w), lambda x: (x["value"] != "") & _valid(x["kind"], x["value"], of)), F.lit(0))
    places = F.zip_with(F.slice(chunks, F.lit(2), F.size(windows)), F.transform(windows, first), lambda c, x: F.struct(c.alias("chunk"), x.alias("part")))
    none = F.lit(None).cast("string")
    start = F.struct(
        F.lit(0).alias("skip"), F.substr(F.get(chunks, F.lit(0)), F.lit(2)).alias("open"), F.array().cast("array<struct<kind:string,value:string>>").alias("parts")
    )

    def take(acc: Column, x: Column) -> Column:
        """``skip``: characters of the last value yet to come; ``open``: what follows it."""
        n = F.length(x["chunk"])
        left = lambda length: F.greatest(length - n, F.lit(0)).alias("skip")
        inside = F.struct(left(acc["skip"]), F.substr(x["chunk"], acc["skip"] + 1).alias("open"), acc["parts"].alias("parts"))
        size = F.length(x["part"]["value"])
        value = F.struct(left(size), F.substr(x["chunk"], size + 1).alias("open"), F.concat(acc["parts"], F.array(_part(none, acc["open"]), x["part"])).alias("parts"))
        other = F.struct(F.lit(0).alias("skip"), F.concat(acc["open"], x["chunk"]).alias("open"), acc["parts"].alias("parts"))
        return F.when(acc["skip"] > 0, inside).when(x["part"].isNotNull(), value).otherwise(other)

    rest = lambda acc: F.concat(acc["parts"], F.array(_part(none, acc["open"])))
    return F.aggregate(places, start, take, rest)


def _unless_found(again: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(x["kind"].isNotNull(), F.array(x)).otherwise(again(x["value"]))


def _parts(candidate: Column) -> Column:
    """The parts of a candidate: (kind or null, value), which make it up in order."""
    parts = F.array(_part(F.lit(None), candidate))
    for k, options in enumerate(PASSES):
        again = partial(_split, options=options, last=k == len(PASSES) - 1)
        parts = F.flatten(F.transform(parts, _unless_found(again)))
    return F.when(candidate.contains("@"), F.array(_part(F.lit("email"), candidate))).otherwise(parts)


def _pseudonym(kind: Column, value: Column, key: str) -> Column:
    return reduce(lambda otherwise, k: F.when(kind == k[0], k[2](value, key)).otherwise(otherwise), KINDS, value)


def pseudonymise(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The input's columns, with ``text_col`` rewritten, and ``__p_kinds``: the kinds of the values replaced, in order."""
    text = F.col(f"`{text_col}`").cast("string")
    hit = text.rlike(HINT)
    df = df.withColumn(P + "values", F.when(hit, F.regexp_extract_all(text, F.lit(CANDIDATE), 0)))
    df = df.withColumn(P + "values", F.when(F.size(P + "values") > 0, F.transform(P + "values", _parts)))
    some = F.exists(P + "values", lambda parts: F.exists(parts, lambda x: x["kind"].isNotNull()))
    df = df.withColumn(P + "new", F.when(some, F.transform(P + "values", lambda parts: F.array_join(F.transform(parts, lambda x: _pseudonym(x["kind"], x["value"], key)), ""))))
    # One piece more than matches: the first has nothing before it.
    df = df.withColumn(P + "pieces", F.when(F.col(P + "new").isNotNull(), F.split(text, CANDIDATE, -1)))
    joined = F.array_join(F.transform(P + "pieces", lambda s, i: F.concat(F.when(i == 0, "").otherwise(F.get(P + "new", i - 1)), s)), "")
    kinds = F.transform(F.filter(F.flatten(P + "values"), lambda x: x["kind"].isNotNull()), lambda x: x["kind"])
    df = df.withColumn(P + "kinds", F.coalesce(kinds, F.array().cast("array<string>")))
    df = df.withColumn(text_col, F.coalesce(F.when(F.col(P + "new").isNotNull(), joined), F.col(f"`{text_col}`")))
    return df.drop(P + "values", P + "new", P + "pieces")
