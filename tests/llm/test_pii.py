from __future__ import annotations

import re

import pytest

from evenhand.llm import pii


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def iban(text):
    x = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


ROWS = [
    (1, "Mail Jo.Doe9@Mail.example.com or JO.DOE9@MAIL.EXAMPLE.COM, call +1 (743) 555-3824 or 743-555-3824."),
    (2, "Mr. John Smith met Mrs. Ann Smith. Mr. Smith and Dr. Ann Lee. Госпожа Анна Иванова."),
    (3, "card 4337166598464399 and 4337-1665-9846-4399, not 4337166598464398"),
    (4, "ip 70.123.182.155, not 1.2.3.4.5, ssn 123-45-6789, iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432"),
    (5, None),
    (6, ""),
    (7, "a clean text, version 4.0, of 1234 words"),
    (None, "Mr. Smith"),
    (1, "the key again: jo.doe9@mail.example.com"),
    (7, "a clean text, version 4.0, of 1234 words"),
]


@pytest.fixture(scope="module")
def got(spark):
    docs = spark.createDataFrame([(*r, "k", 1) for r in ROWS], "doc_id long, text string, kind string, at int")
    out = pii.replaced(docs)
    assert out.columns == [*docs.columns, "n_entities"]
    return [tuple(r) for r in out.collect()]


def text(got, key, start=""):
    return next(r[1] for r in got if r[0] == key and (r[1] or "").startswith(start))


def test_rows_stay(got):
    assert len(got) == len(ROWS)
    assert sorted(r[4] for r in got) == [0, 0, 0, 0, 1, 1, 2, 4, 4, 5]
    assert [r[1] for r in got if r[0] == 7] == [ROWS[6][1]] * 2
    assert text(got, 6) == "" and next(r for r in got if r[0] == 5)[1] is None


def test_mentions_agree(got):
    mails = re.findall(r"\S+@\S+\w", text(got, 1, "Mail"))
    assert mails[0] == mails[1].lower() and mails[1].isupper() and mails[0] in text(got, 1, "the key again")
    phones = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or (\S+)\.$", text(got, 1, "Mail"))
    assert "-".join(phones.groups()[:3]) == phones[4] != "743-555-3824"
    names = re.match(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+)\. Mr\. (\w+) and Dr\. (\w+) (\w+)\. Госпожа ([а-яА-Я]+) ([а-яА-Я]+)\.$", text(got, 2))
    assert names[2] == names[4] == names[5] and names[7] != names[2]
    assert text(got, None) == f"Mr. {names[2]}"
    men, women = pii.ENDINGS["latin", "first_m"], pii.ENDINGS["latin", "first_f"]
    assert names[1].endswith(tuple(men)) and names[3].endswith(tuple(women))


def test_formats_stay_valid(got):
    cards = re.match(r"card (\d{16}) and (\d{4}-\d{4}-\d{4}-\d{4}), not 4337166598464398$", text(got, 3))
    assert cards[1] == cards[2].replace("-", "") and luhn(cards[1]) and cards[1] != "4337166598464399"
    whole = re.match(r"ip (\S+), not 1\.2\.3\.4\.5, ssn (\d{3}-\d\d-\d{4}), iban (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) and (GB\w{20})$", text(got, 4))
    assert whole and iban(whole[3]) and iban(whole[4]) and "70.123" not in whole[1] and whole[2] != "123-45-6789"


def test_surrogates_are_distinct_and_no_real_entity(spark, monkeypatch):
    # a small space: nine of a hundred forms collide at first
    monkeypatch.setattr(pii, "surrogate", lambda kind, norm, attempt, secret: (pii.F.pmod(pii.F.xxhash64(norm, attempt), pii.F.lit(100))).cast("string"))
    entities = spark.createDataFrame([("t", str(k)) for k in range(40)], "type string, norm string")
    made = [r["surrogate"] for r in pii.surrogates(entities, "s").collect()]
    assert len(made) == 40 == len(set(made)) and not set(made) & {str(k) for k in range(40)}


def test_empty(spark):
    assert pii.replaced(spark.createDataFrame([], "doc_id long, text string")).count() == 0
