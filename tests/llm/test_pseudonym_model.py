"""The native pseudonyms against a plain model of the same rules, value by value."""

import datetime as dt
import hashlib
import random
import re

from pyspark.sql import functions as F

from minutes.llm import pii

KEY = "k"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def move(text, other, i, kind):
    tweak = "|".join([KEY, kind, str(i), str(len(text)), other])
    stream = sha(tweak) + sha(tweak + "|")
    out = ""
    for at, c in enumerate(text):
        byte = int(stream[at % 64 * 2 : at % 64 * 2 + 2], 16)
        for first, last in ("09", "az", "AZ", "!("):
            if first <= c <= last:
                n = ord(last) - ord(first) + 1
                c = chr(ord(first) + (ord(c) - ord(first) + byte) % n)
                break
        out += c
    return out


def permute(text, kind):
    a, b = text[: len(text) // 2], text[len(text) // 2 :]
    for i in range(8):
        a, b = (move(a, b, i, kind), b) if i % 2 == 0 else (a, move(b, a, i, kind))
    return a + b


def permute_number(n, low, high, kind):
    a, b = divmod(n, high)
    for i in range(8):
        f = lambda half: int(sha("|".join([KEY, kind, str(i), str(half)]))[:12], 16)  # noqa: B023, E731
        a, b = ((a + f(b)) % low, b) if i % 2 == 0 else (a, (b + f(a)) % high)
    return a * high + b


def refill(layout, new, found="[0-9]"):
    left = iter(new)
    return re.sub(found, lambda m: next(left), layout)


def luhn(number):
    return sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(number))) % 10


def rest(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def day_of(text):
    for form in ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y"):
        try:
            day = dt.datetime.strptime(text, form).date()
            return (day if 1700 <= day.year <= 2099 else None), form
        except ValueError:
            pass
    return None, form


# of two digits: all that begin no code of three
CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


def pseudonym(match):
    text = match[0]
    kind = next(k for k, p in pii.KINDS.items() if re.fullmatch(p, text))
    digits = re.sub("[^0-9]", "", text)
    if kind == "mail":
        name, at, host = text.partition("@")
        return permute(name, kind) + at + host
    if kind == "secret":
        mark = re.match("(?:AKIA|(?i:[a-z_]+)\\s?[=:]\\s?[\"']?)", text)[0]
        return mark + permute(text[len(mark) :], kind)
    if kind == "account":
        plain = text.replace(" ", "")
        if rest(plain) != 1:
            return text
        body = permute(plain[4:], kind)
        return refill(text, plain[:2] + f"{98 - rest(plain[:2] + '00' + body):02d}" + body, "[A-Z0-9]")
    if kind == "phone":
        if not 8 <= len(digits) <= 15:
            return text
        country = next(digits[:n] for n in (1, 2, 3) if n == 3 or digits[:n] in CODES) if text[0] == "+" else ""
        local = digits[len(country) :]
        narrow = str.maketrans("23456789", "!\"#$%&'(")
        if len(local) == 10:
            local = local[0].translate(narrow) + local[1:3] + local[3].translate(narrow) + local[4:]
        return refill(text, country + permute(local, kind).translate(str.maketrans("!\"#$%&'(", "23456789")))
    if kind == "address":
        octets = [int(o) for o in text.split(".")]
        if max(octets) > 255:
            return text
        n = permute_number(int.from_bytes(bytes(octets)), 1 << 16, 1 << 16, kind)
        return ".".join(map(str, n.to_bytes(4)))
    if kind == "date":
        day, form = day_of(text)
        first = dt.date(1700, 1, 1)
        if day is None:
            return text
        move = lambda d: first + dt.timedelta(permute_number((d - first).days, 189, 773, kind))
        day = move(day)
        while form == "%m/%d/%Y" and day.day <= 12:
            day = move(day)
        return day.strftime(form)
    if kind == "social":
        return text if re.search("^(?:000|666|9)|-00-|-0000$", text) else refill(text, permute(digits, kind))
    if luhn(digits):
        return text
    core = digits[0] + permute(digits[1:-1], kind)
    return refill(text, core + str((10 - luhn(core + "0")) % 10))


def model(text):
    return text and re.sub(pii.CANDIDATE, pseudonym, text)


def made_up(rng):
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    card = number(15)
    card += next(d for d in "0123456789" if luhn(card + d) == 0)
    iban = "DE00" + number(18)
    return [
        card, "-".join(card[i : i + 4] for i in range(0, 16, 4)), number(16), f"+{rng.randint(1, 99)} {number(2)} {number(4)} {number(4)}", f"+1 ({number(3)}) {number(3)}-{number(4)}", f"+{rng.randint(1, 999)}{number(10)}", f"{rng.randint(1, 12):02d}/{rng.randint(13, 31):02d}/{rng.randint(1700, 2099)}",
        ".".join(str(rng.randint(0, 270)) for _ in range(4)), f"{rng.randint(1690, 2110)}-{rng.randint(1, 13):02d}-{rng.randint(1, 31):02d}", f"{rng.randint(1, 31):02d}/{rng.randint(1, 12):02d}/{rng.randint(1700, 2099)}",
        f"{number(3)}-{number(2)}-{number(4)}", f"{rng.choice(['a', 'Bo_b.9', 'x' * 64])}@m{number(1)}.example.org", "AKIA" + "".join(rng.choices("ABC234", k=16)), f"token = '{number(20)}ab'", f"DE{98 - rest(iban):02d}{iban[4:]}", iban, f"{rng.choice('23')}12-555-{number(4)}",
    ]


def test_against_the_model(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(60):
        parts = made_up(rng)
        rng.shuffle(parts)
        texts.append(rng.choice([" ", ", ", "\n", " und é "]).join(parts[:8]))
    texts += [None, "", "4.0. v3 a@b", "x" * 5000 + " 1.2.3.4"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in pii.pseudonymise(rows, KEY).collect()}
    assert got == {i: model(t) for i, t in enumerate(texts)}


def test_documents_against_the_model(spark):
    from compare import DATA

    if DATA.exists():
        docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
        got = {r.doc_id: r.text for r in pii.pseudonymise(docs, KEY).select("doc_id", F.col("text")).collect()}
        assert got == {r.doc_id: model(r.text) for r in docs.collect()}
