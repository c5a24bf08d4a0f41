"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Texts are split at candidates; each candidate is validated, and a valid one is permuted within its format by a keyed
Feistel network: card numbers keep their first digit, length, separators and a right check digit; phone numbers keep
country code, layout and the leading digits' range; addresses stay four octets; dates stay dates of the same 400-year
cycle; account numbers get right check digits again; mail names and secrets keep the class of every character. The
value of a secret is all up to white space or a quote, less punctuation that closes a sentence or bracket; its letters
a-z and digits are permuted, whatever its length, and all else in it stays. The
same value under the same key and kind gives the same pseudonym in every document, whatever its separators, and
different values never share one. The country code of a phone number behind a + is told by its digits, since separators
may be missing; digits in brackets count like any others.

A date with slashes has the day first. One that is none so read, but is with the month first (its day is over 12), keeps
that order: it is permuted until its day is over 12 again, so it is not linked to the same day in another layout.

A run of digit groups that is no card number as a whole is searched for card numbers from group to group, so that an
expiry date, a check value or an ordinal beside one does not hide it. Such a part is unbroken or laid out as 4-4-4-4,
4-4-4-4-3, 4-6-5 or 4-6-4, and begins with an issuer's digits that go with its length; of parts that overlap, the leftmost,
then the longest is taken. If over three groups for each card found are left over, or more than one of four
digits in all, the run is a table of numbers and stays as it is. A run with spaces that is one card as a whole needs the same layout and issuer; one with dashes, the layout.

Candidates that fail validation (a number without a right check digit, a 31st of February, an octet of 300) are left
as they are. Everything else in a text is kept byte for byte.

Defined cases: a null text stays null with no replacement; an empty text stays empty; a text of any length is treated
whole; repeated rows are treated alike; an empty table gives no rows; ids, null or not, and all other columns pass through
untouched. The columns added by ``pseudonymise`` replace any of their name; it uses __found, __judged and __made itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

ROUNDS = 8
#: Kinds with the pattern of their candidates, in order of preference where candidates overlap.
KINDS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?i:(?<![a-z])(?:password|passwd|token|secret|api_key)\s?[=:]\s?[\"']?)(?=[^\s\"']*[A-Za-z0-9])(?:[^\s\"']{7,}[^\s\"'.,;:)\]}>]|[^\s\"']{8,})",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9A-Za-z+])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9A-Za-z+-])[2-9][0-9]{2}-[2-9][0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "address": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z])(?!\.[0-9])",
    "date": r"(?<![0-9A-Za-z/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z/-])",
    "social": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
#: An unbroken number, a run of groups with dashes, or one with spaces too, which ends before a candidate of another kind.
KINDS["card"] = (
    r"(?<![0-9A-Za-z+.-])(?:[0-9]{13,19}(?![0-9A-Za-z])|(?=(?:-?[0-9]){13})[0-9]{1,19}+(?:-[0-9]{1,19}+(?![0-9A-Za-z]))++"
    r"|(?=(?:[ -]?[0-9]){13})[0-9]{1,19}+(?:(?:-| (?!(?:" + "|".join(KINDS[k] for k in ("phone", "address", "date", "social")) + r")))[0-9]{1,19}+(?![0-9A-Za-z]))++)"
)
CANDIDATE = "|".join(f"(?:{p})" for p in KINDS.values())
# The layouts of cards, and the first digits of issuers with the lengths they give out.
LAYOUT = "^[ -]?(?:[0-9]+|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
ISSUER = "^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:2[2-7]|5[1-5])[0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11}|(?:35|36|5[06-9]|6[0-9]|8[12])[0-9]{14,17}|9792[0-9]{12})$"
#: Groups that may stand beside each card of a run, and groups of four digits and more beside all of them.
BESIDE, LONG_BESIDE = 3, 1
#: First and last day of the dates treated: 146,097 = 189 x 773 days, one full cycle of the calendar.
FIRST, LAST, LOW, HIGH = "1700-01-01", "2099-12-31", 189, 773
#: Permutations of a date with the month first until its day is over 12: each misses with a chance of 0.4.
WALK = 40
# Country codes of one and two digits; all others have three.
COUNTRY = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Digits 2 to 9 while they are permuted among themselves: eight characters in a row that no candidate has.
NARROW = "!\"#$%&'("


def _number(key: str, kind: str, i: Column, half: Column) -> Column:
    """A keyed number below 2^48 for a round and the other half."""
    hashed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(hashed, 1, 12), 16, 10).cast("long")


def _shift(text: Column, other: Column, i: Column, key: str, kind: str) -> Column:
    """Each character of ``text`` moved within its class by a byte of the hash of ``other``."""
    tweak = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), F.length(text).cast("string"), other)
    hashed = F.concat(F.sha2(tweak, 256), F.sha2(F.concat(tweak, F.lit("|")), 256))

    def move(char: Column, at: Column, bytes_: Column) -> Column:
        code = F.ascii(char)
        byte = F.conv(F.substring(bytes_, (at % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        turn = lambda first, n: F.char(F.lit(first) + (code - first + byte) % n)
        out = F.when(code.between(48, 57), turn(48, 10)).when(code.between(97, 122), turn(97, 26)).when(code.between(65, 90), turn(65, 26))
        # no quote may come into a secret
        return (out if kind == "secret" else out.when(code.between(33, 40), turn(33, 8))).otherwise(char)

    return let(hashed, lambda h: F.array_join(F.transform(F.split(text, ""), lambda c, i: move(c, i, h)), ""))


def feistel_text(text: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings with the same class of character at each place."""

    def halves(t: Column) -> Column:
        half = F.floor(F.length(t) / 2).cast("int")
        return F.struct(F.substring(t, F.lit(1), half).alias("a"), F.substring(t, half + 1, F.length(t)).alias("b"))

    def step(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(_shift(s["a"], s["b"], i, key, kind).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), _shift(s["b"], s["a"], i, key, kind).alias("b"))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), let(text, halves), step, lambda s: F.concat(s["a"], s["b"]))


def feistel_number(number: Column, low: int, high: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. low * high - 1: two digits of a mixed base, moved in turn by a hash of the other."""
    start = F.struct(F.floor(number / high).cast("long").alias("a"), (number % high).cast("long").alias("b"))

    def step(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(((s["a"] + _number(key, kind, i, s["b"])) % low).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), ((s["b"] + _number(key, kind, i, s["a"])) % high).alias("b"))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["a"] * high + s["b"])


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def put_back(layout: Column, found: str, new: Column) -> Column:
    """``layout`` with its characters of class ``found`` replaced in order by those of ``new``."""
    put = lambda take: F.transform(F.split(layout, found, -1), lambda part, i: F.concat(part, F.coalesce(F.get(take, i), F.lit(""))))
    return F.array_join(let(F.split(new, ""), put), "")


def luhn_sum(number: Column) -> Column:
    """The sum of a number's digits with every second, from the last but one, doubled and cast out."""

    def add(total: Column, x: Column) -> Column:
        return total + x

    parts = F.transform(
        F.split(F.reverse(number), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(parts, F.lit(0), add)


def iban_rest(account: Column) -> Column:
    """The account, its first four characters behind, letters as 10 to 35, modulo 97."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), add)


def as_date(text: Column) -> Column:
    """A date of any layout: with slashes the day first, else the month first."""
    day = lambda t: F.try_to_timestamp(t, F.lit("yyyy-MM-dd")).cast("date")
    a, b, year = F.substring(text, 1, 2), F.substring(text, 4, 2), F.substring(text, 7, 4)
    return F.when(F.substring(text, 5, 1) == "-", day(text)).otherwise(F.coalesce(day(F.concat_ws("-", year, b, a)), day(F.concat_ws("-", year, a, b))))


def month_first(text: Column) -> Column:
    return (F.substring(text, 3, 1) == "/") & (F.substring(text, 4, 2).cast("int") > 12)


def day_at(n: Column) -> Column:
    return F.date_add(F.lit(FIRST).cast("date"), n.cast("int"))


def other_day(text: Column, key: str) -> Column:
    """The permuted day, in the layout of the text."""
    move = lambda n: feistel_number(n, LOW, HIGH, key, "date")
    far = lambda n: F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), n, lambda m, i: F.when((i > 0) & (F.dayofmonth(day_at(m)) > 12), m).otherwise(move(m)))
    number = F.datediff(as_date(text), F.lit(FIRST).cast("date")).cast("long")
    moved = let(number, lambda n: F.when(month_first(text), far(n)).otherwise(move(n)))
    show = lambda n, layout: F.date_format(day_at(n), layout)
    iso = F.substring(text, 5, 1) == "-"
    return let(moved, lambda n: F.when(month_first(text), show(n, "MM/dd/yyyy")).when(iso, show(n, "yyyy-MM-dd")).otherwise(show(n, "dd/MM/yyyy")))


def kind_of(text: Column) -> Column:
    """The kind of a candidate that holds against its rule; null for one that does not."""
    octets = F.forall(F.split(text, r"\."), lambda o: o.cast("int") < 256)
    luhn = F.length(digits(text)).between(13, 19) & (luhn_sum(digits(text)) % 10 == 0)
    card = F.when(text.contains(" "), fits(text)).otherwise(text.rlike(LAYOUT) & luhn)
    social = ~text.rlike("^(?:000|666|9)|-00-|-0000$")
    valid = {
        "mail": F.lit(True), "secret": F.lit(True), "account": iban_rest(F.replace(text, F.lit(" "), F.lit(""))) == 1, "phone": F.length(digits(text)).between(8, 15), "address": octets,
        "date": as_date(text).between(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date")), "social": social, "card": card,
    }
    out = F.when(F.lit(False), F.lit(""))
    for kind, pattern in KINDS.items():
        out = out.when(text.rlike(f"^(?:{pattern})$"), F.when(valid[kind], F.lit(kind)))
    return out


def fits(text: Column) -> Column:
    """Whether digit groups, with the separator before them or not, are a card number by layout, issuer and check digit."""
    return text.rlike(LAYOUT) & digits(text).rlike(ISSUER) & (luhn_sum(digits(text)) % 10 == 0)


def cards_within(text: Column) -> Column:
    """A run of digit groups in pieces (old, kind): card numbers, and what stands between them."""
    piece = lambda old, kind: F.struct(old.alias("old"), F.lit(kind).cast("string").alias("kind"))

    def pieces(groups: Column) -> Column:
        n = F.size(groups)
        # a group has the separator before it
        part = lambda s, e: F.array_join(F.slice(groups, s + 1, e - s + 1), "")
        spans = lambda s: F.transform(F.filter(F.array(*map(F.lit, (4, 3, 2, 0))), lambda d: s + d < n), lambda d: F.struct(s.alias("s"), (s + d).alias("e"), part(s, s + d).alias("old")))
        first = lambda s: F.get(groups, s).rlike("^[ -]?(?:[0-9]{4}|[0-9]{13,19})$")
        starts = F.filter(F.sequence(F.lit(0), n - 1), first)
        cards = F.flatten(F.transform(starts, lambda s: F.filter(spans(s), lambda r: fits(r["old"]))))

        def taken(found: Column) -> Column:
            state = F.struct(F.lit(-1).alias("last"), F.slice(found, 1, 0).alias("held"))
            add = lambda x, r: F.when(r["s"] > x["last"], F.struct(r["e"].alias("last"), F.concat(x["held"], F.array(r)).alias("held"))).otherwise(x)
            return F.aggregate(found, state, add, lambda x: x["held"])

        def lay(held: Column) -> Column:
            before = lambda i: F.coalesce(F.get(held, i - 1)["e"], F.lit(-1))
            laid = F.flatten(F.transform(held, lambda r, i: F.array(piece(part(before(i) + 1, r["s"] - 1), None), piece(r["old"], "card"))))
            sized = lambda c: F.size(F.filter(c, lambda g: g.rlike("[0-9]{4}")))
            within, long = (F.aggregate(held, F.lit(0), lambda x, r: x + f(F.slice(groups, r["s"] + 1, r["e"] - r["s"] + 1))) for f in (F.size, sized))  # noqa: B023
            all_of = F.concat(laid, F.array(piece(part(before(F.size(held)) + 1, n - 1), None)))
            return F.when((n - within <= BESIDE * F.size(held)) & (sized(groups) - long <= LONG_BESIDE), all_of).otherwise(F.array(piece(text, None)))

        return let(let(cards, taken), lay)

    return let(F.regexp_extract_all(text, F.lit("[ -]?[0-9]+"), F.lit(0)), pieces)


def judge(text: Column) -> Column:
    """A candidate in pieces (old, kind)."""
    whole = lambda kind: F.array(F.struct(text.alias("old"), kind.alias("kind")))
    run = text.rlike("^(?=(?:[ -]?[0-9]){13})[0-9]++(?:[ -][0-9]++)++$")
    return let(kind_of(text), lambda kind: F.when(kind.isNull() & run, cards_within(text)).otherwise(whole(kind)))


def pseudonym(text: Column, kind: Column, key: str) -> Column:
    """The permuted candidate."""
    number = digits(text)
    # cards: all but the first and the check digit, which is worked out anew
    core = F.concat(F.substring(number, 1, 1), feistel_text(F.substring(number, F.lit(2), F.length(number) - 2), key, "card"))
    card = let(core, lambda c: F.concat(c, ((10 - luhn_sum(F.concat(c, F.lit("0"))) % 10) % 10).cast("string")))
    # phones: the country code stays; a leading 2-9 of the area and of the exchange stays in that range
    country = F.when(F.substring(text, 1, 1) == "+", F.regexp_extract(number, COUNTRY, 0)).otherwise("")
    local = F.substring(number, F.length(country) + 1, F.length(number))
    narrow = lambda c: F.translate(c, "23456789", NARROW)

    def ranged(n: Column) -> Column:
        ten = F.concat(narrow(F.substring(n, 1, 1)), F.substring(n, 2, 2), narrow(F.substring(n, 4, 1)), F.substring(n, F.lit(5), F.length(n)))
        return F.when(F.length(n) == 10, ten).otherwise(n)

    moved = F.translate(feistel_text(let(local, ranged), key, "phone"), NARROW, "23456789")
    phone = put_back(text, "[0-9]", F.concat(country, moved))
    # addresses: a number of 32 bits
    octets = F.split(text, r"\.")
    packed = F.aggregate(octets, F.lit(0).cast("long"), lambda n, o: n * 256 + o.cast("long"))
    spread = feistel_number(packed, 1 << 16, 1 << 16, key, "address")
    address = let(spread, lambda n: F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0))))
    # accounts: country and layout stay, check digits are worked out anew
    plain = F.replace(text, F.lit(" "), F.lit(""))
    body = feistel_text(F.substring(plain, F.lit(5), F.length(plain)), key, "account")
    check = lambda b: 98 - iban_rest(F.concat(F.substring(text, 1, 2), F.lit("00"), b))
    account = let(body, lambda b: F.concat(F.substring(text, 1, 2), F.lpad(check(b).cast("string"), 2, "0"), b))
    # mail: the name before the @; secrets: the value behind the mark
    name = F.substring_index(text, "@", 1)
    mail = F.concat(feistel_text(name, key, "mail"), F.substring(text, F.length(name) + 1, F.length(text)))
    mark = F.regexp_extract(text, r"^(?:AKIA|(?i:[a-z_]+)\s?[=:]\s?[\"']?)", 0)
    secret = F.concat(mark, feistel_text(F.substring(text, F.length(mark) + 1, F.length(text)), key, "secret"))
    social = put_back(text, "[0-9]", feistel_text(number, key, "social"))
    made = {"mail": mail, "secret": secret, "account": put_back(text, "[A-Z0-9]", account), "phone": phone, "address": address, "date": other_day(text, key), "social": social, "card": put_back(text, "[0-9]", card)}
    out = F.when(F.lit(False), F.lit(""))
    for k, c in made.items():
        out = out.when(kind == k, c)
    return F.coalesce(out, text)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with personal data in its text replaced; with ``counts`` also n_replaced and kinds (kind -> number)."""
    text = F.col(text_col)
    found = F.when(text.rlike("[0-9@=:]") & text.rlike(CANDIDATE), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    judged = F.transform("__found", judge)
    new = lambda x: F.struct(x["kind"].alias("kind"), F.when(x["kind"].isNull(), x["old"]).otherwise(pseudonym(x["old"], x["kind"], key)).alias("new"))
    made = F.transform("__judged", lambda m: F.transform(m, new))
    pieces = F.transform(F.split(text, F.lit(CANDIDATE), F.lit(-1)), lambda p, i: F.concat(p, F.coalesce(F.array_join(F.get(F.col("__made"), i)["new"], ""), F.lit(""))))
    out = docs.withColumn("__found", found).withColumn("__judged", judged).withColumn("__made", made)
    out = out.withColumn(text_col, F.when(F.col("__found").isNull(), text).otherwise(F.array_join(pieces, "")))
    if counts:
        kinds = F.coalesce(F.filter(F.transform(F.flatten("__made"), lambda x: x["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
        out = out.withColumn("n_replaced", F.size(kinds).cast("long"))
        out = out.withColumns({f"n_{k}": (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long") for k in KINDS})
    return out.drop("__found", "__judged", "__made")
