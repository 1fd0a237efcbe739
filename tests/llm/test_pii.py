import datetime
import re

import pytest
from odd import documents, odd_documents, with_clashes
from pyspark.sql import functions as F

from tollway.llm import pii, queries

KEY = "k1"


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


def card(body):
    return next(body + str(k) for k in range(10) if luhn(body + str(k)))


def iban(country, account):
    value = lambda s: int("".join(str(int(c, 36)) for c in s))
    return f"{country}{98 - value(account + country + '00') % 97:02d}{account}"


def run(spark, texts, key=KEY):
    rows = {r.doc_id: r for r in pii.pseudonymize(documents(spark, texts), key).collect()}
    return [rows[i] for i in range(len(texts))]


def test_each_kind_keeps_its_format(spark):
    values = {
        "card": [card("401288888888188"), "4012-8888-8888-1881", card("37828224631000")], "ip": ["42.144.35.254", "8.8.8.8"], "phone": ["+1 (988) 555-2485", "212-555-0175", "(415) 555-0100", "+49 30 1234567", "+442071838750", "+7 495-123-45-67", "+358 40 1234567"],
        "ssn": ["123-45-6789", "667-01-0001", "899-99-9999", "001-01-0001"], "date": ["1987-03-31", "2000-02-29", "31.12.1999", "02/28/2015", "28/02/2015", "1900-01-01", "2099-12-31"],
        "email": ["Jane.Doe_77@mail8.example.com", "x@y.org"], "iban": [iban("DE", "500105175407324931"), iban("GB", "WEST12345698765432")],
    }
    texts = [f"see {v}, thanks" for vs in values.values() for v in vs]
    kinds = [k for k, vs in values.items() for _ in vs]
    for r, text, kind in zip(run(spark, texts), texts, kinds):
        assert r[f"n_{kind}"] == 1 and r.n_values == 1, text
        old, new = text[4:-8], r.text[4:-8]
        assert r.text.startswith("see ") and r.text.endswith(", thanks") and (new != old or len(old) < 8)
        if kind != "ip":
            assert re.sub(r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", old))) == re.sub(r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", new)))
        if kind == "card":
            assert luhn(new) and new[0] == old[0]
        if kind == "ip":
            assert len(new.split(".")) == 4 and all(0 <= int(x) <= 255 for x in new.split("."))
        if kind == "iban":
            assert new == iban(new[:2], new[4:])
        if kind == "ssn":
            assert new[:3] not in ("000", "666") and new[0] != "9" and new[4:6] != "00" and new[7:] != "0000"
        if kind == "date":
            form = "%Y-%m-%d" if "-" in old else "%d.%m.%Y" if "." in old else "%d/%m/%Y" if int(old[:2]) > 12 else "%m/%d/%Y"
            assert 1900 <= datetime.datetime.strptime(new, form).year <= 2099
            assert "/" not in old or (int(old[:2]) > 12) == (int(new[:2]) > 12)


def test_cards_before_other_digits(spark):
    number = "4111111111111111"
    heads = [number, "4111 1111 1111 1111", "4111-1111-1111-1111"]
    tails = [" 12/27", " 123", " 12", " 1", " 12/27 123", " 9 99 5 1234"]
    texts = [f"card {h}{t} end" for h in heads for t in tails]
    new = run(spark, [number])[0].text
    for r, text in zip(run(spark, texts), texts):
        head = next(h for h in heads if h in text)
        tail = text[5 + len(head) :]
        assert r.n_card == 1 and r.text.endswith(tail) and re.sub("[ -]", "", r.text[5 : -len(tail)]) == new, text
    after, phone, ssn, two = run(spark, [f"qty 3 {number}", f"{number} 415 555 0100", f"{number} 123-45-6789", f"{number} 123 {number}"])
    assert after.text == f"qty 3 {new}" and two.text == f"{new} 123 {new}"
    assert phone.n_card == phone.n_phone == 1 and ssn.n_card == ssn.n_ssn == 1
    assert phone.text.startswith(new) and "555 0100" not in phone.text and "123-45-6789" not in ssn.text
    changed = pii.pseudonymize_text(documents(spark, [f"{number} 12/27"]), KEY).first()
    assert changed.text == f"{new} 12/27"


def test_grouped_ibans(spark):
    ibans = ["DE89370400440532013000", "GB29NWBK60161331926819", "AT611904300234573201", "NO9386011117947"]
    tails = ["", ", thanks", " BANK", " 12", " 1234 5678"]
    whole = {i: r.text for i, r in zip(ibans, run(spark, ibans))}
    grouped = lambda s: " ".join(s[k : k + 4] for k in range(0, len(s), 4))
    texts = [(i, t) for i in ibans for t in tails]
    for r, (i, t) in zip(run(spark, [f"to {grouped(i)}{t}" for i, t in texts]), texts):
        assert whole[i] != i and r.n_iban == r.n_values == 1 and r.text == f"to {grouped(whole[i])}{t}"
    bad = run(spark, ["to DE88 3704 0044 0532 0130 00"])[0]
    assert bad.n_values == 0 and bad.text == "to DE88 3704 0044 0532 0130 00"


def test_equal_values_stay_linked_and_keys_matter(spark):
    texts = ["a 4012888888881881 b", "4012888888881881 and 4012888888881881"]
    one, two = run(spark, texts)
    found = set(re.findall(r"\d{16}", one.text + " " + two.text))
    assert len(found) == 1 and two.n_card == 2 and found != {"4012888888881881"}
    assert run(spark, texts, "k2")[0].text != one.text


def test_a_day_is_linked_in_all_spellings(spark):
    days = [datetime.date(1900, 1, 1), datetime.date(2000, 2, 29), datetime.date(2020, 5, 3), datetime.date(2021, 11, 25), datetime.date(2099, 12, 31)]
    for day in days:
        forms = ["%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", *(["%d/%m/%Y"] if day.day > 12 else [])]
        out = [r.text for r in run(spark, [day.strftime(f) for f in forms])]
        moved = {datetime.datetime.strptime(t, f).date() for t, f in zip(out, forms)}
        assert len(moved) == 1 and moved != {day}
        assert (moved.pop().day > 12) == (day.day > 12)


def test_days_are_permuted_one_to_one(spark):
    day = F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int"))
    docs = spark.range(0, pii.DAYS, 1, 8).select(F.col("id").alias("doc_id"), day.cast("string").alias("text"))
    days = pii.pseudonymize(docs, KEY).where("n_date = 1").agg(F.count_distinct(F.col("text").cast("date")), F.min("text"), F.max("text")).first()
    assert tuple(days) == (pii.DAYS, "1900-01-01", "2099-12-31")


def test_phone_numbers_of_other_countries(spark):
    texts = ["ring +49 30 1234567.", "+49-30-1234567", "+27.1828182845 and +3.14159265", "+49 30 12", "+4930123456789012345"]
    a, b, *others = run(spark, texts)
    assert a.n_phone == b.n_phone == 1 and a.text != texts[0]
    digits = [re.sub(r"\D", "", r.text) for r in (a, b)]
    assert digits[0] == digits[1] and digits[0].startswith("49") and len(digits[0]) == 11
    assert [(r.text, r.n_phone) for r in others] == [(t, 0) for t in texts[2:]]


def test_permutations_are_one_to_one(spark):
    numbers = spark.range(0, 5000).select("id", pii.permute_number(F.col("id"), 50, 100, KEY, F.lit("t")).alias("y"))
    assert sorted(r.y for r in numbers.collect()) == list(range(5000))
    days = [f"{d:%Y-%m-%d}" for d in (datetime.date(1999, 1, 1) + datetime.timedelta(k) for k in range(400))]
    out = [r.text for r in run(spark, days)]
    assert len(set(out)) == 400
    texts = spark.range(0, 1000).select(pii.permute_text(F.lpad(F.col("id").cast("string"), 3, "0"), KEY, F.lit("t")).alias("y"))
    assert len({r.y for r in texts.collect()}) == 1000


@pytest.mark.parametrize("text", [
    "4012888888881882 fails its checksum", "256.1.1.1 and 1.2.3", "000-12-3456 666-12-3456 900-12-3456 123-00-4567", "2001-02-29 31.04.2000 13/13/2013", "DE00500105175407324931", "a@b", "version 2.0 of 1999", "", "plain",
])
def test_invalid_values_stay(spark, text):
    row = run(spark, [text])[0]
    assert row.text == text and row.n_values == 0


def test_whole_table(spark, sf_dir):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    after = queries.QUERIES["op1_feistel_pseudonyms"](spark, sf_dir)
    assert not re.search("Python|Pandas|Arrow", after._jdf.queryExecution().toString())
    rows = after.collect()
    assert len(rows) == len(before)
    email, ip, long = r"[\w.]+@[\w.]+\.com", r"\b\d+\.\d+\.\d+\.\d+\b", r"\b\d{16}\b"
    replaced = 0
    for r in rows:
        old = before[r.doc_id]
        for pattern in (email, ip, r"\(\d{3}\) \d{3}-\d{4}"):
            a, b = re.findall(pattern, old), re.findall(pattern, r.text)
            assert len(a) == len(b) and not any(x == y for x, y in zip(a, b))
            replaced += len(a)
        for x, y in zip(re.findall(long, old), re.findall(long, r.text)):
            assert luhn(x) == luhn(y) and (not luhn(x) or x != y)
            replaced += luhn(x)
        words = lambda t: re.sub(r"\S*[\d@]\S*", "", t)
        assert words(old) == words(r.text)
    assert sum(r.n_values for r in rows) == replaced > 0


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = pii.pseudonymize(with_clashes(docs), KEY).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert pii.pseudonymize(docs.limit(0), KEY).count() == 0
    clash = with_clashes(docs)
    assert pii.pseudonymize_text(clash, KEY).columns == clash.columns
    changed = pii.pseudonymize_text(documents(spark, ["from 9.9.9.9"]), KEY).first()
    assert changed.n_chars == len(changed.text) and changed.text != "from 9.9.9.9"
