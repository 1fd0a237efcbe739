"""Format-preserving pseudonyms for personal numbers, dates and addresses, in DataFrame functions only.

Each validated value is permuted by a keyed Feistel network over the valid values of its own format:
a card number becomes a card number that passes its checksum, a date a date, and so on.  Equal values
get equal pseudonyms in all documents, different values different ones, so links between documents
remain.  Without the key the permutation can't be undone.

| kind | valid if | what is permuted |
| --- | --- | --- |
| card | 13 to 19 digits from 3 to 6 on, Luhn; the longest such run of whole digit groups | all digits but the first; the last is the checksum |
| iban | ISO 13616 checksum, in one piece or in groups of four | account digits and letters; check digits anew |
| phone | ten digits as in North America, with +1, (area) or valid codes; + with another country code, 8 to 15 digits in groups divided by a blank or hyphen | area, exchange and line, valid codes stay valid; all digits after the country code |
| ssn | no 000, 666, 9xx area; no 00 group; no 0000 serial | all three parts |
| ip | four octets up to 255 | the address |
| date | a day of 1900 to 2099, as yyyy-MM-dd, dd.MM.yyyy, MM/dd/yyyy, or dd/MM/yyyy with dd over 12 | the day, alike in all spellings; days up to the 12th stay among such days, so that no spelling becomes ambiguous |
| email | name, @, domain | letters and digits of the name, each within its class |
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Rounds after which a permutation that left the valid values has come back with all but 1e-18 certainty.
WALK = 84
KINDS = ["email", "ip", "iban", "card", "phone", "ssn", "date"]

_OCTET = r"(?:0|[1-9][0-9]{0,2})"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}+[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "date": r"(?<![0-9/.-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:(?:\+?1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-]?[0-9]{4}|\+1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}|(?:1[ .-])?[2-9][0-9]{2}[ .-][2-9][0-9]{2}[ .-]?[0-9]{4}|\+(?:7|[2-9][0-9])(?:[ -]?[0-9]){6,13})(?![0-9])",
    "card": r"(?<![0-9-])[3-6](?:[ -]?[0-9]){12,18}(?![0-9])",
}
#: An IBAN in groups of four, the last of up to four.
GROUPED_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?![A-Za-z0-9])"
#: Country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGIT_CODES = "20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: Kinds whose places the pattern alone tells; cards and grouped IBANs end where their checksum says, see :func:`_pattern`.
FIXED = ("email", "ip", "iban", "date", "ssn", "phone")


def _digest(key: str, *parts) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def permute_number(x: Column, a, b, key: str, tweak: Column) -> Column:
    """A keyed permutation of 0 .. a*b-1: two parts below a and b take turns in being moved by a hash of the other."""

    a, b = (v if isinstance(v, Column) else F.lit(v).cast("long") for v in (a, b))

    def turn(s: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0, F.struct(F.pmod(s["l"] + _number(_digest(key, tweak, i, s["r"])), a).alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + _number(_digest(key, tweak, i, s["l"])), b).alias("r")))

    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])


def walk(x: Column, step: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """Repeats a permutation until its result is valid, which makes it one of the valid values."""

    start = F.struct(x.alias("x"), F.lit(False).alias("done"))

    def turn(s: Column, _: Column) -> Column:
        moved = F.transform(F.array(step(s["x"])), lambda y: F.struct(y.alias("x"), valid(y).alias("done")))
        return F.when(s["done"], s).otherwise(moved[0])

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, turn, lambda s: s["x"])


def permute_text(s: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of texts that keeps each character's class: digit, small or capital letter, or itself."""

    def moved(text: Column, other: Column, i: Column) -> Column:
        def one(c: Column, k: Column, h: Column) -> Column:
            by = F.conv(F.substr(h, 1 + F.pmod(k, F.lit(16)) * 4, F.lit(4)), 16, 10).cast("int")
            code = F.ascii(c)
            shift = lambda low, size: F.char(F.pmod(code - low + by, F.lit(size)) + low)
            return F.when(c.between("0", "9"), shift(48, 10)).when(c.between("a", "z"), shift(97, 26)).when(c.between("A", "Z"), shift(65, 26)).otherwise(c)

        # the digest stands in an array of one, so that it is worked out once per turn
        shifted = F.transform(F.array(_digest(key, tweak, i, other)), lambda h: F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, k: one(c, k, h)), ""))
        return shifted[0]

    def turn(p: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(moved(p["l"], p["r"], i).alias("l"), p["r"].alias("r"))).otherwise(F.struct(p["l"].alias("l"), moved(p["r"], p["l"], i).alias("r")))

    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.length(s) - half).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda p: F.concat(p["l"], p["r"]))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def refill(m: Column, new: Column) -> Column:
    """m with its digits replaced by new ones, in order."""

    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("at"))

    def turn(s: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), F.struct(F.concat(s["s"], F.substr(new, s["at"], F.lit(1))).alias("s"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["s"], c).alias("s"), s["at"].alias("at")))

    return F.aggregate(F.filter(F.split(m, ""), lambda c: c != ""), start, turn, lambda s: s["s"])


def luhn_sum(d: Column, doubled_from_right: int) -> Column:
    """Luhn sum of digits, doubling every second one; 0 doubles the last, 1 the one before it."""

    places = F.filter(F.split(F.reverse(d), ""), lambda c: c != "")

    def value(c: Column, i: Column) -> Column:
        twice = 2 * c.cast("int")
        return F.when(i % 2 == doubled_from_right, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))

    return F.aggregate(F.transform(places, value), F.lit(0), lambda s, v: s + v)


def mod97(s: Column) -> Column:
    """Letters as 10 to 35 and digits, read as one number, modulo 97."""

    def turn(r: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), turn)


def _part(d: Column, start: int, size: int) -> Column:
    return F.substring(d, start, size).cast("long")


def _as_date(m: Column) -> Column:
    iso = F.try_to_date(m, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(m, "yyyy-MM-dd")
    parsed = lambda pattern: F.try_to_timestamp(m, F.lit(pattern)).cast("date")
    return F.when(m.contains("-"), iso).when(m.contains("."), parsed("dd.MM.yyyy")).otherwise(F.coalesce(parsed("MM/dd/yyyy"), parsed("dd/MM/yyyy")))


def _iban_passes(m: Column) -> Column:
    c = F.replace(m, F.lit(" "), F.lit(""))
    return (F.length(c) <= 34) & (mod97(F.concat(F.substring(c, 5, 30), F.substring(c, 1, 4))) == 1)


def kind_of(m: Column) -> Column:
    """The kind whose checks a found text passes; null if none."""

    d = digits(m)
    whole = lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")
    octets = F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)
    ssn = ~F.substring(d, 1, 3).isin("000", "666") & ~d.startswith("9") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(whole("ip"), F.when(octets, "ip"))
        .when(whole("iban") | m.rlike(f"^(?:{GROUPED_IBAN})$"), F.when(_iban_passes(m), "iban"))
        .when(whole("date"), F.when(_as_date(m).isNotNull(), "date"))
        .when(whole("ssn"), F.when(ssn, "ssn"))
        .when(whole("card") & (luhn_sum(d, 1) % 10 == 0), F.lit("card"))
        .when(whole("phone"), F.lit("phone"))
    )


DAYS, DAY_A, DAY_B = 73049, 271, 270


def pseudonym(kind: Column, m: Column, key: str) -> Column:
    """The pseudonym of a validated text."""

    d = digits(m)
    name, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    email = F.concat(permute_text(name, key, F.concat(F.lit("email|"), domain)), F.lit("@"), domain)

    octet = lambda k: F.split(m, r"\.")[k].cast("long")
    address = permute_number(octet(0) * 16777216 + octet(1) * 65536 + octet(2) * 256 + octet(3), 65536, 65536, key, F.lit("ip"))
    ip = F.transform(F.array(address), lambda x: F.concat_ws(".", *[F.pmod(F.shiftright(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]))[0]

    c = F.replace(m, F.lit(" "), F.lit(""))
    account = F.transform(F.array(permute_text(F.substring(c, 5, 30), key, F.concat(F.lit("iban|"), F.substring(c, 1, 2)))), lambda x: F.concat(F.substring(c, 1, 2), F.lpad((98 - mod97(F.concat(x, F.substring(c, 1, 2), F.lit("00")))).cast("string"), 2, "0"), x))[0]
    account = F.when(m.contains(" "), F.regexp_replace(account, "(.{4})(?=.)", "$1 ")).otherwise(account)

    middle = F.length(d) - 2
    low = F.floor(middle / 2).cast("int")
    inner = permute_number(F.substr(d, F.lit(2), middle).cast("long"), F.pow(F.lit(10.0), low).cast("long"), F.pow(F.lit(10.0), middle - low).cast("long"), key, F.concat(F.lit("card|"), F.length(d).cast("string"), F.lit("|"), F.substring(d, 1, 1)))
    body = F.concat(F.substring(d, 1, 1), F.lpad(inner.cast("string"), middle, F.lit("0")))
    card = F.transform(F.array(body), lambda x: refill(m, F.concat(x, F.pmod(10 - luhn_sum(x, 0) % 10, F.lit(10)).cast("string"))))[0]

    # three classes, each with a domain of its own: a number with valid codes keeps valid codes
    ten = F.substr(d, F.length(d) - 9, F.lit(10))
    plan = F.when(_part(ten, 1, 3) < 200, 0).when(_part(ten, 4, 3) < 200, 1).otherwise(2)
    size = F.when(plan == 0, 10_000_000).when(plan == 1, 2_000_000).otherwise(8_000_000).cast("long")
    areas, base = F.when(plan == 0, 200).otherwise(800).cast("long"), F.when(plan == 0, 0).otherwise(200)
    exchange = F.when(plan == 2, 200).otherwise(0)
    line = permute_number((_part(ten, 1, 3) - base) * size + (_part(ten, 4, 3) - exchange) * 10_000 + _part(ten, 7, 4), areas, size, key, F.concat(F.lit("phone|"), plan.cast("string")))
    phone = F.transform(F.array(line), lambda x: refill(m, F.concat(
        F.substr(d, F.lit(1), F.length(d) - 10), F.lpad((F.floor(x / size) + base).cast("string"), 3, "0"),
        F.lpad((F.floor(F.pmod(x, size) / 10_000) + exchange).cast("string"), 3, "0"), F.lpad(F.pmod(x, F.lit(10_000)).cast("string"), 4, "0"))))[0]

    code = F.when(d.startswith("7"), 1).when(d.rlike(f"^(?:{TWO_DIGIT_CODES})"), 2).otherwise(3)
    rest = F.length(d) - code
    half = F.floor(rest / 2).cast("int")
    abroad = permute_number(
        F.substr(d, code + 1, rest).cast("long"), F.pow(F.lit(10.0), half).cast("long"), F.pow(F.lit(10.0), rest - half).cast("long"),
        key, F.concat_ws("|", F.lit("phone"), F.substr(d, F.lit(1), code), rest.cast("string")),
    )
    abroad = refill(m, F.concat(F.substr(d, F.lit(1), code), F.lpad(abroad.cast("string"), rest, F.lit("0"))))
    phone = F.when(m.rlike(r"^\+[2-9]"), abroad).otherwise(phone)

    area = _part(d, 1, 3)
    person = permute_number((area - 1 - (area > 666).cast("long")) * 989_901 + (_part(d, 4, 2) - 1) * 9_999 + _part(d, 6, 4) - 1, 898, 989_901, key, F.lit("ssn"))

    def spelled(x: Column) -> Column:
        rank = F.floor(x / 989_901) + 1
        rest = F.pmod(x, F.lit(989_901))
        return refill(m, F.concat(F.lpad((rank + (rank >= 666).cast("long")).cast("string"), 3, "0"), F.lpad((F.floor(rest / 9_999) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(rest, F.lit(9_999)) + 1).cast("string"), 4, "0")))

    ssn = F.transform(F.array(person), spelled)[0]

    first = F.lit("1900-01-01").cast("date")
    day_of = lambda x: F.date_add(first, x.cast("int"))
    late = m.contains("/") & (F.substring(m, 1, 2).cast("int") > 12)

    def moved(t: Column) -> Column:
        same_class = lambda x: (F.dayofmonth(day_of(x)) > 12) == (F.dayofmonth(t) > 12)
        return day_of(walk(F.datediff(t, first).cast("long"), lambda x: permute_number(x, DAY_A, DAY_B, key, F.lit("date")), lambda x: (x < DAYS) & same_class(x)))

    def written(t: Column) -> Column:
        form = lambda pattern: F.date_format(t, pattern)
        return F.when(m.contains("-"), form("yyyy-MM-dd")).when(m.contains("."), form("dd.MM.yyyy")).when(late, form("dd/MM/yyyy")).otherwise(form("MM/dd/yyyy"))

    date = F.transform(F.transform(F.array(_as_date(m)), moved), written)[0]

    out = F.when(kind == "email", email)
    for name_, value in (("ip", ip), ("iban", account), ("card", card), ("phone", phone), ("ssn", ssn), ("date", date)):
        out = out.when(kind == name_, value)
    return out.otherwise(m)


def _longest(text: Column, span: str, heads: list[str], passes: Callable[[Column], Column]) -> Column:
    """The values in text that pass: at each place where a span begins, the first of its heads, longest first, that does."""

    spans = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({span}))"), F.lit(1)))
    first = lambda s: F.get(F.filter(F.array(*[F.regexp_extract(s, f"^{h}", 0) for h in heads]), lambda h: (h != "") & passes(h)), F.lit(0))
    return F.array_distinct(F.filter(F.transform(spans, first), lambda v: v.isNotNull()))


def _pattern(text: Column) -> Column:
    """The pattern of all places in a text, with its own cards and grouped IBANs spelled out.

    What follows a card or an IBAN after a blank, such as an expiry date, is text of its own.
    """

    cards = _longest(text, PATTERNS["card"], [rf"(?:[0-9][ -]?){{{n - 1}}}[0-9](?![0-9])" for n in range(19, 12, -1)], lambda v: luhn_sum(digits(v), 1) % 10 == 0)
    groups = [rf"[A-Z]{{2}}[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{k}}}{tail}(?![A-Za-z0-9])" for k in range(7, 1, -1) for tail in (" [A-Z0-9]{1,3}", "")]
    ibans = _longest(text, GROUPED_IBAN, groups, lambda v: (F.length(v) > 17) & _iban_passes(v))

    def spelled(values: Column, before: str, after: str) -> Column:
        longest = F.reverse(F.array_sort(F.transform(values, lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))))
        return F.when(F.size(values) > 0, F.concat(F.lit(before), F.array_join(longest["v"], "|"), F.lit(after)))

    fixed = "|".join(f"(?:{PATTERNS[k]})" for k in FIXED)
    # a null is left out; grouped IBANs go first, as their digits can look like a card or a phone number
    return F.concat_ws(
        "|", F.when(text.rlike(GROUPED_IBAN), spelled(ibans, "(?:(?<![A-Za-z0-9])(?:", ")(?![A-Za-z0-9]))")), F.lit(fixed),
        F.when(text.rlike(PATTERNS["card"]), spelled(cards, "(?:(?<![0-9-])(?:", ")(?![0-9]))")),
    )


def _found(text: Column, pattern: Column) -> Column:
    """(kind, value) of every place that looks like a personal value, in order; kind is null if it fails its checks."""

    places = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, pattern, F.lit(0)))
    return F.transform(places, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("value")))


def _replaced(text: Column, pattern: Column, found: Column, key: str) -> Column:
    gaps = F.split(text, pattern, -1)
    new = F.transform(found, lambda f: pseudonym(f["kind"], f["value"], key))
    joined = F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), "")
    return F.when(F.exists(found, lambda f: f["kind"].isNotNull()), joined).otherwise(text)


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, and the number of values replaced, of each kind and in all.

    A null text stays null, an empty one empty; both count nothing.  Values that fail their checks stay
    as they are.  Rows are treated one by one, repeated or not; further columns are not read.  One
    narrow pass without Python and without a shuffle.
    """

    rows = docs.select(F.col("doc_id"), F.col("text").alias("before"), _pattern(F.col("text")).alias("pattern"))
    rows = rows.select("doc_id", "before", "pattern", _found(F.col("before"), F.col("pattern")).alias("found"))
    count = lambda k: F.coalesce(F.size(F.filter("found", lambda f: f["kind"] == k)), F.lit(0)).alias(f"n_{k}")
    rows = rows.select("doc_id", _replaced(F.col("before"), F.col("pattern"), F.col("found"), key).alias("text"), *[count(k) for k in KINDS])
    return rows.withColumn("n_values", sum((F.col(f"n_{k}") for k in KINDS[1:]), F.col(f"n_{KINDS[0]}")))


def pseudonymize_text(docs: DataFrame, key: str) -> DataFrame:
    """The documents with pseudonyms in ``text``; ``n_chars``, if there, follows.  All other columns stay."""

    # each stands in an array of one, so that it is worked out once per row
    place = F.transform(F.array(_pattern(F.col("text"))), lambda p: F.struct(p.alias("pattern"), _found(F.col("text"), p).alias("found")))
    new = docs.withColumn("text", F.transform(place, lambda s: _replaced(F.col("text"), s["pattern"], s["found"], key))[0])
    return new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else new
