import datetime
import hashlib
import itertools
import re

from pyspark.sql import functions as F

from lorekeep.llm import pseudonyms as P
from lorekeep.llm import registry, runtime

KEY = "k"


def digest(*parts):
    return int(hashlib.sha256(":".join(map(str, (KEY, *parts))).encode()).hexdigest()[:15], 16)


def feistel(left, right, a, b, tweak):
    for i in range(P.ROUNDS):
        if i % 2 == 0:
            left = (left + digest(tweak, i, right)) % a
        else:
            right = (right + digest(tweak, i, left)) % b
    return left, right


def digits(d, kind):
    u = len(d) // 2
    left, right = feistel(int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u), f"{kind}/{len(d)}")
    return f"{left:0{u}d}{right:0{len(d) - u}d}"


FIRST = datetime.date(1900, 1, 1)


def day(d):
    """The pseudonym of a date of 1900 to 2099."""
    left, right = feistel(*divmod((d - FIRST).days, 4297), 17, 4297, "date/era")
    return FIRST + datetime.timedelta(left * 4297 + right)


def address(value):
    """Each letter for a letter, each digit for a digit, in halves."""
    signs = [(ord(c) - (48 if c.isdigit() else 97), 10 if c.isdigit() else 26) for c in value.lower() if c.isalnum()]
    halves = [signs[: len(signs) // 2], signs[len(signs) // 2 :]]
    for i in range(P.ROUNDS):
        own, other = halves[i % 2], ",".join(str(v) for v, _ in halves[1 - i % 2])
        stream = "".join(hashlib.sha256(f"{KEY}:email:{i}:{b}:{other}".encode()).hexdigest() for b in range(len(own) // 16 + 1))
        halves[i % 2] = [((v + int(stream[4 * k : 4 * k + 4], 16)) % n, n) for k, (v, n) in enumerate(own)]
    new = iter(chr(v + (48 if n == 10 else 97)) for v, n in halves[0] + halves[1])
    return "".join(next(new) if c.isalnum() else c for c in value) + ".invalid"


def luhn(d):
    return sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def run(spark, texts, key=KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in P.pseudonymise(df, key).orderBy("doc_id").collect()]


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    got = {r[0]: r[1] for r in df.select("d", P.permute_digits(F.col("d"), KEY, "t")).collect()}
    assert sorted(got.values()) == sorted(got) and got["007"] != "007"
    assert all(v == digits(d, "t") for d, v in got.items())


def test_kinds(spark):
    texts = ["card 4111 1111-11111111.", "on 2024-02-29, or 29.02.2024", "ip 10.20.30.255!", "call +1 (988) 555-2485 now", "A.b@Mail.example.com", "4111111111111112 2023-02-29 300.1.1.1 1.2.3.4.5", None, "", "none here"]
    rows = run(spark, texts)
    assert [r["__p_kinds"] for r in rows] == [["card"], ["date", "date"], ["ip"], ["phone"], ["email"], [], [], [], []]
    out = [r["text"] for r in rows]
    assert out[5:] == texts[5:]
    card = re.fullmatch(r"card (\d{4} \d{4}-\d{8})\.", out[0])[1].replace(" ", "").replace("-", "")
    assert luhn(card) and card[:-1] == digits("411111111111111", "card")
    a, b = re.fullmatch(r"on (\S+), or (\S+)", out[1]).groups()
    assert datetime.date.fromisoformat(a) == datetime.datetime.strptime(b, "%d.%m.%Y").date() != datetime.date(2024, 2, 29)
    assert datetime.date.fromisoformat(a) == day(datetime.date(2024, 2, 29))
    left, right = feistel(10 * 256 + 20, 30 * 256 + 255, 65536, 65536, "ip")
    assert out[2] == f"ip {left // 256}.{left % 256}.{right // 256}.{right % 256}!"
    d = digits("9885552485", "phone")
    assert out[3] == f"call +1 ({d[:3]}) {d[3:6]}-{d[6:]} now"
    assert out[4] == address("A.b@Mail.example.com") and re.fullmatch(r"[a-z]\.[a-z]@[a-z]{4}\.[a-z]{7}\.[a-z]{3}\.invalid", out[4])


def test_linked(spark):
    """Equal values are equal everywhere, in whatever format; other keys give other pseudonyms."""
    texts = ["x a@b.example y 4111111111111111", "4111-1111-1111-1111 A@B.example", "a@b.exampleX 5555555555554444"]
    one, two, three = (r["text"] for r in run(spark, texts))
    assert re.sub("[^0-9]", "", two.split()[0]) == one.split()[-1] and one.split()[1] == two.split()[1]
    assert three.split()[1] != one.split()[-1] and run(spark, texts[:1], "other")[0]["text"] != one


def test_edges(spark):
    long = "word " * 50_000 + "4111111111111111 " + "a@b.example " * 200
    df = spark.createDataFrame([(None, long, 1), (1, long, 1), (1, long, 1)], "doc_id long, text string, kinds int")
    rows = P.pseudonymise(df, KEY).collect()
    assert len({r["text"] for r in rows}) == 1 and all(len(r["__p_kinds"]) == 201 and r["kinds"] == 1 for r in rows)
    assert P.pseudonymise(df.limit(0), KEY).count() == 0


VALUES = re.compile(r"[\w.]+@[\w.]+\w|(?<!\d)\d{16}(?!\d)|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![.\d])|\+\d \(\d{3}\) \d{3}-\d{4}")


def valid(v):
    if re.fullmatch(r"\d{16}", v):
        return luhn(v) and len(set(v)) > 1
    return not re.fullmatch(r"[\d.]+", v) or all(int(x) < 256 for x in v.split("."))


def replaced(before, after):
    """Holds new texts against old ones, value by value: no valid one survives, equal ones have equal pseudonyms and others different ones,
    and all else is as it was. Returns the pseudonyms, how many values were valid, and how many weren't."""
    links, n, invalid = {}, 0, 0
    assert set(before) == set(after)
    for doc, text in after.items():
        old, new = VALUES.findall(before[doc]), VALUES.findall(text)
        assert len(old) == len(new) and VALUES.split(before[doc]) == VALUES.split(text)
        for a, b in zip(old, new, strict=True):
            if valid(a):
                assert a != b and valid(b) and links.setdefault(a, b) == b
                n += 1
            else:
                assert a == b
                invalid += 1
    assert len(set(links.values())) == len(links)
    return links, n, invalid


def test_whole_table(spark):
    """No e-mail, valid card, valid address or phone number of the table survives, and all else does, invalid ones included."""
    sf = "/root/testdata/sf0.01"
    before = {r[0]: r[1] for r in runtime.table(spark, sf, "documents").select("doc_id", "text").collect()}
    rows = registry.op2_feistel_pseudonyms(spark, sf).collect()
    assert all(len(r["kinds"]) == sum(map(valid, VALUES.findall(before[r["doc_id"]]))) for r in rows)
    links, n, invalid = replaced(before, {r["doc_id"]: r["text"] for r in rows})
    assert n > 40 and invalid > 3
    assert not any(a in r for a, r in itertools.product(list(links)[:20], links.values()))


def test_adjacent_values(spark):
    """A value next to another one, or to another number, is found and linked as if it stood by itself."""
    phone, ip, card = "+1 (826) 555-4081", "190.137.223.204", "4111111111111111"
    printed, abroad = "4111 1111 1111 1111", "+44 20 7946 0958"
    alone = {v: r["text"] for v, r in zip((phone, ip, card, printed, abroad), run(spark, [phone, ip, card, printed, abroad]), strict=True)}
    assert all(a != b for a, b in alone.items())
    cases = [
        (phone, " ", ip), (phone, " 1234"), (ip, " ", phone), (phone, " ", phone), (phone, " ", card), (phone, " 2023-02-30"), (abroad, " ", ip), (abroad, " ", printed),
        (card, " 123"), ("12 ", card), ("12 ", card, " 123"), ("1234 ", printed), (printed, " 1234"), (printed, " ", printed), ("7-", card), (card, "-7"), ("+", card), ("1. ", phone),
    ]
    rows = run(spark, ["x " + "".join(c) + " y" for c in cases])
    assert [r["text"] for r in rows] == ["x " + "".join(alone.get(x, x) for x in c) + " y" for c in cases]
    assert [len(r["__p_kinds"]) for r in rows] == [sum(x in alone for x in c) for c in cases]


def test_runs(spark):
    """Long runs of digits neither fail nor take a card's place; an address that begins with digits stays whole."""
    numbers = "100 " * 20_000
    rows = run(spark, [numbers + "4111111111111111", "555 123456 123john@mail.example 7", "4111111111111111@home", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"])
    assert rows[0]["text"].startswith(numbers) and not rows[0]["text"].endswith("4111111111111111")
    assert [r["__p_kinds"][-1] for r in rows] == ["card", "email", "card", "card"] and "john" not in rows[1]["text"]


def test_dates(spark):
    """Both orders with slashes, and every year; the order stays, and no two dates become one."""
    texts = ["31/12/1990 12/31/1990 1990-12-31 1990/12/31 31.12.1990", "03/04/1990 04/03/1990", "1890-01-01 2100-05-05 0001-01-01 9999-12-31 0000-02-29", "31/31/1990 13/13/2000 0000-02-30"]
    rows = run(spark, texts)
    assert [len(r["__p_kinds"]) for r in rows] == [5, 2, 5, 0] and rows[3]["text"] == texts[3]
    a, b, c, d, e = rows[0]["text"].split()
    want = day(datetime.date(1990, 12, 31))
    assert (a, c, d, e) == (want.strftime("%d/%m/%Y"), want.isoformat(), want.strftime("%Y/%m/%d"), want.strftime("%d.%m.%Y"))
    while want.day <= 12:
        want = day(want)
    assert b == want.strftime("%m/%d/%Y")
    assert rows[1]["text"] == " ".join(day(datetime.date(1990, m, d)).strftime("%d/%m/%Y") for d, m in ((3, 4), (4, 3)))
    old, new = texts[2].split(), rows[2]["text"].split()
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\d", x) and not "1900" <= x[:4] <= "2099" for x in new) and len({*old, *new}) == 10
    us = [datetime.date(1990, m, d).strftime("%m/%d/%Y") for m in range(1, 13) for d in range(13, 29)]
    out = run(spark, [" ".join(us)])[0]["text"].split()
    assert len(set(out)) == len(us) and all(int(x[3:5]) > 12 for x in out)


def test_days_are_permuted(spark):
    """Every day of the era becomes another day of it, and each is one's; so do those around it."""
    df = spark.range(P.ERA - 50_000, P.ERA + P.ERA_DAYS + 50_000, numPartitions=4).select(F.col("id").cast("int").alias("d"))
    got = dict(df.select("d", P._moved(F.col("d"), KEY)).collect())
    inside = lambda x: P.ERA <= x < P.ERA + P.ERA_DAYS
    assert sorted(v for d, v in got.items() if inside(d)) == [d for d in sorted(got) if inside(d)]
    others = [v for d, v in got.items() if not inside(d)]
    assert len(set(others)) == 100_000 and not any(map(inside, others)) and 0 <= min(others) and max(others) <= P.LAST_DAY


def test_phones_across_spellings(spark):
    same = ["+1 (234) 567-8901", "+12345678901", "+1 234 567 8901", "+1-234-567-8901", "+1.234.567.8901"]
    out = [re.sub(r"\D", "", r["text"]) for r in run(spark, same)]
    assert set(out) == {"1" + digits("2345678901", "phone")}
    for code, number in (("44", "2079460958"), ("49", "3012345678"), ("353", "12345678"), ("7", "4951234567")):
        one, two = (re.sub(r"\D", "", r["text"]) for r in run(spark, [f"+{code} {number[:2]} {number[2:6]} {number[6:]}", f"+{code}{number}"]))
        assert one == two == code + digits(number, "phone")


def test_addresses(spark):
    """Addresses of one shape have as many pseudonyms as there are addresses; long ones need more than one hash a round."""
    many = [f"{a}{b}@{c}.io" for a in "abcdef" for b in range(10) for c in "xyz"] + ["x" * 60 + "@" + "y" * 60 + "." + "z9" * 20 + ".museum", "Jane_Doe+99@a-b.co.uk"]
    got = [r["text"] for r in run(spark, many)]
    assert got == [address(x) for x in many] and len(set(got)) == len(many)
