import datetime
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grainframe.llm import pii

from .cases import documents, frame, with_clashes

KEY = b"a key of the tests"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(n):
    f = pii.Feistel(b"k")
    assert sorted(f.permute(x, n, b"t") for x in range(n)) == list(range(n))


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**14 - 1))
def test_cards_stay_cards(number):
    body = "4" + str(number).zfill(14)
    card = body + pii.luhn_digit(body)
    new = pii.Pseudonyms(KEY).of("card", card)
    if len(set(card)) > 1:
        assert new != card and len(new) == 16 and new[0] == "4" and luhn(new)


def test_values_keep_their_form_and_their_links():
    names = pii.Pseudonyms(KEY)
    text = "Mail anna.b@example.org, born 1984-02-29, card 4111 1111 1111 1111, ip 10.0.0.1, ssn 123-45-6789, iban GB82 WEST 1234 5698 7654 32, call +1 555-234-9876, api_key = \"abcdEFGH12345678\"."
    new, counts = names.apply(text)
    assert counts == {"email": 1, "date": 1, "card": 1, "ipv4": 1, "ssn": 1, "iban": 1, "phone": 1, "secret": 1}
    for value in ("anna.b", "1984-02-29", "4111 1111 1111 1111", "10.0.0.1", "123-45-6789", "GB82 WEST", "555-234-9876", "abcdEFGH12345678"):
        assert value not in new
    assert len(new) == len(text) + len(names.of("ipv4", "10.0.0.1")) - len("10.0.0.1")
    datetime.date.fromisoformat(new.split("born ")[1][:10])
    again, _ = pii.Pseudonyms(KEY).apply("x 1984-02-29 y 4111 1111 1111 1111")
    assert again.split()[1] == new.split("born ")[1][:10] and " ".join(again.split()[3:]) in new
    assert names.apply("1999-02-30, 4111 1111 1111 1112, 300.1.1.1") == ("1999-02-30, 4111 1111 1111 1112, 300.1.1.1", {})


@pytest.mark.parametrize("n", [2, 3, 10, 97, 1000])
def test_moves_are_permutations_that_move_every_value(n):
    f = pii.Feistel(b"k")
    moved = [f.move(x, n, b"t") for x in range(n)]
    assert sorted(moved) == list(range(n)) and all(x != y for x, y in enumerate(moved))
    assert all(f.restore(f.permute(x, n, b"t"), n, b"t") == x for x in range(n))


def test_distinct_values_stay_distinct():
    """All dates of the range, all numbers of three digits, all words of two letters, and blocks of addresses and numbers."""
    names = pii.Pseudonyms(pii.TEST_KEY.encode())
    n = pii.DATE_TO - pii.DATE_FROM + 1
    assert len({names.feistel.move(x, n, b"date") for x in range(n)}) == n
    days = ["1904-03-22", "2041-01-17", "1900-01-01", "2099-12-31"]
    assert len({names._of("date", d) for d in days}) == 4 and all(names._of("date", d) != d for d in days)
    assert len({names.digits(f"{x:03d}", b"t") for x in range(1000)}) == 1000
    assert all(names.digits(f"{x:03d}", b"t") != f"{x:03d}" for x in range(1000))
    words = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    assert len({names.letters(w, b"t") for w in words}) == len(words) and all(names.letters(w, b"t") != w for w in words)
    ips = [f"10.0.{i}.{j}" for i in range(8) for j in range(256)]
    assert len({names._of("ipv4", x) for x in ips}) == len(ips) and all(names._of("ipv4", x) != x for x in ips)
    ssns = [f"123-{g:02d}-{s:04d}" for g in range(1, 40) for s in range(1, 40)]
    assert len({names._of("ssn", x) for x in ssns}) == len(ssns) and all(names._of("ssn", x) != x for x in ssns)


def test_values_of_any_length_leave_nothing_in_clear():
    names = pii.Pseudonyms(KEY)
    local, label = "a1" * 400, "my_" * 200 + "secret_" + "key_" * 100
    new, counts = names.apply(f"to {local}@example.org, {label} = abcdefgh12345678")
    assert counts == {"email": 1, "secret": 1} and local[:50] not in new and local[-50:] not in new and "abcdefgh" not in new
    assert names.apply("..@example.org @x.y a@b")[1] == {}
    assert names.apply("token" * 20000 + "@" + "a" * 20000)[1] == {}


def test_awkward_rows(spark):
    docs = with_clashes(frame(spark), "pii_counts")
    found = pii.pseudonymise(docs, KEY).collect()
    assert len(found) == docs.count()
    assert {r["doc_id"]: (r["text"], r["pii_counts"]) for r in found if r["doc_id"] in (1, 2)} == {1: (None, {}), 2: ("", {})}
    assert pii.pseudonymise(docs.limit(0), KEY).count() == 0
    assert pii.pseudonymise(docs, KEY, counts=None).columns == docs.columns


def brute(text):
    """Values by plain patterns of the tables' own forms, each replaced by looking its pseudonym up."""
    names = pii.Pseudonyms(pii.TEST_KEY.encode())
    if text is None:
        return None
    for kind, form in (("email", r"[a-z0-9.]+@[a-z0-9-]+\.[a-z.]*[a-z]"), ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"), ("ipv4", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"), ("card", r"\b(?:\d{16}|\d{4} \d{4} \d{4} \d{4})\b"), ("iban", r"\b[A-Z]{2}\d{2}(?: \d{4}){5}\b"), ("phone", r"\+\d \(\d{3}\) \d{3}-\d{4}")):
        text = re.sub(form, lambda m: names._of(kind, m[0]) or m[0], text)
    return re.sub(r"(?<=token = \")[0-9a-f]{40}", lambda m: names.letters(m[0], b"secret"), text)


def test_query_equals_plain_replacement(spark, small_dir):
    found = {r["doc_id"]: r for r in pii.op6(spark, small_dir).collect()}
    docs = dict(documents(spark, small_dir))
    assert found.keys() == docs.keys()
    plain = {i: pii.Pseudonyms(pii.TEST_KEY.encode()).apply(t) if t is not None else (None, {}) for i, t in docs.items()}
    for i, (text, counts) in plain.items():
        assert found[i]["text"] == text
        assert {k: found[i][f"n_{k}"] for k in pii.FORMS if found[i][f"n_{k}"]} == counts
    other = [i for i, t in docs.items() if t and not plain[i][1].get("date") and brute(t) != found[i]["text"]]
    assert not other, [(docs[i][:300], found[i]["text"][:300]) for i in other[:2]]
    assert sum(brute(t) != t for t in docs.values()) > 3


def test_secrets_are_taken_whole():
    names = pii.Pseudonyms(KEY)
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    aws = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY=="
    long_one = "".join(f"{i:x}Kq" for i in range(2500))
    for text, value in (
        (f'token = "{jwt}"', jwt), (f"Authorization token: Bearer {jwt}\nmore", jwt), (f"aws_secret_access_key = {aws} end", aws), (f"secret_key: {aws}", aws),
        (f"API_KEY_PROD='{long_one[:300]}'", long_one[:300]), (f'{{"token": "{long_one}"}}', long_one), ("db_password = hunter2, next", "hunter2"),
        ("password: 'my dog\\'s name 7' x", "my dog\\'s name 7"), ('{\\"passwd\\": \\"s3cr3t\\"}', "s3cr3t"), ("client_secret=abc123def", "abc123def"),
    ):
        new, counts = names.apply(text)
        at = text.index(value)
        assert counts == {"secret": 1} and len(new) == len(text), text
        assert new[:at] == text[:at] and new[at + len(value) + 1 :] == text[at + len(value) + 1 :], (text, new)
        moved = [(a, b) for a, b in zip(value, new[at : at + len(value)]) if a.isalnum()]
        assert all(b.isdigit() if a.isdigit() else b.islower() if a.islower() else b.isupper() for a, b in moved)
        step = 64  # no part stays in clear
        assert all(sum(a == b for a, b in moved[i : i + step]) < max(4, len(moved[i : i + step]) // 3) for i in range(0, len(moved), step)), (text, new)
    for text in ("the secret: nothing", "token = None", 'token: ""', "a password is needed", "keys: one two"):
        assert names.apply(text) == (text, {})
    new, _ = names.apply(f'token = "Bearer {jwt}" and "more" text')
    assert jwt.split(".")[1] not in new and new.startswith('token = "Bearer ') and new.endswith('" and "more" text')
    a, b = (names.of("secret", f"token={long_one}{end}") for end in "xy")
    assert a != b


def test_values_next_to_other_digits_are_found():
    names = pii.Pseudonyms(KEY)
    card, phone, iban = "4111 1111 1111 1111", "+1 (487) 555-7209", "ES91 2100 0418 4502 0005 1332"
    uk = "+44 20 7946 0958"
    for text, values in (
        (f"{card} 12 items", {"card": card}), ("4111111111111111 123", {"card": "4111111111111111"}), (f"{card} 05/27", {"card": card}), (f"5 {card}", {"card": card}),
        (f"3782 822463 10005 {card} 99", {"card": "3782 822463 10005"}), (f"{phone} {card}", {"phone": phone, "card": card}), (f"{phone} 1200", {"phone": phone}), (f"{uk} {card}", {"phone": uk, "card": card}),
        (f"{uk} 1200", {"phone": uk}), (f"{iban} BIC", {"iban": iban}), (f"AB12 {iban} BICX SWIF", {"iban": iban}), (f"{iban}", {"iban": iban}), ("9999 9999 9999 9995 77", {"card": "9999 9999 9999 9995"}),
    ):
        new, counts = names.apply(text)
        assert set(values) <= set(counts), (text, counts)
        for kind, value in values.items():
            assert names.of(kind, value) in new and value not in new, (text, new)
    one, other = (names.apply(x)[0] for x in (f"{phone} 1200", f"{phone}"))
    assert one == f"{other} 1200"
    assert names.apply("+4915112345678")[1] == {"phone": 1}


def test_prose_stays_as_it_is():
    names = pii.Pseudonyms(KEY)
    for text in ("passwords: several people", "user tokens: 12345678 items", "secretary: Johnathan12345", "Secretaries = Anna12345678", "password: several people know it", "The token: Something else entirely", "tokenizer = WordPiece12345678", "secrecy: abcdefgh12345678"):
        assert names.apply(text) == (text, {}), text
    for text in ("password: hunter2 and more", "accessToken = abcdEFGH1234", "secretKey: abcdEFGH1234", "DB_PASSWORD: correcthorse", "token2 = abcdEFGH1234", "userpassword='several people'", "API-KEY: abcdefgh12345678 x", "secret=abcdefghijklmnopqrst is it"):
        assert names.apply(text)[1] == {"secret": 1}, text


def test_dates_written_month_first():
    names = pii.Pseudonyms(KEY)
    new, counts = names.apply("on 12/31/1999, 31/12/1999 and 13/13/1999")
    assert counts == {"date": 2}
    first, second = new.split()[1].rstrip(","), new.split()[2]
    month, day, year = map(int, first.split("/"))
    assert day > 12 and datetime.date(year, month, day) and first != "12/31/1999"
    assert second == names.of("date", "31/12/1999") and new.endswith("13/13/1999")
    every = {names._of("date", f"{m:02d}/{d:02d}/2024") for m in range(1, 13) for d in range(13, 29)}
    assert len(every) == 12 * 16 and all(int(x.split("/")[1]) > 12 for x in every)


def test_a_key_is_asked_for(spark):
    with pytest.raises(ValueError):
        pii.key_of(spark)
    assert pii.key_of(spark, "given") == b"given"
    spark.conf.set(pii.KEY_SETTING, "own")
    try:
        assert pii.key_of(spark, "given") == b"own"
    finally:
        spark.conf.unset(pii.KEY_SETTING)
