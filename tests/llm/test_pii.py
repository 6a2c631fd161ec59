import datetime
import random
import re

import pyarrow.parquet as pq
import pytest

from storyloom.llm import pii

SF = "/root/testdata/sf0.01"


def luhn(digits):
    return sum(d - 9 * (d > 9) for d in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


def card(rng, n=16):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(body + c for c in "0123456789" if luhn(body + c))


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def iban(rng, country="DE", n=18):
    body = "".join(rng.choice("0123456789") for _ in range(n))
    return f"{country}{98 - mod97(country + '00' + body):02d}{body}"


def shape(text):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", text)))


@pytest.fixture(scope="module")
def pseudonym(spark):
    def of(values):
        rows = spark.createDataFrame([(i, f"start {v} end") for i, v in enumerate(values)], "doc_id long, text string")
        found = {r.doc_id: r for r in pii.pseudonymize(rows, "key").collect()}
        return [found[i].text[6:-4] for i in range(len(values))], [found[i] for i in range(len(values))]

    return of


def test_formats_and_check_digits(pseudonym):
    rng = random.Random(5)
    cards = [card(rng, n) for n in (13, 14, 15, 16, 19) for _ in range(40)]
    cards += ["-".join(c[i : i + 4] for i in range(0, 16, 4)) for c in cards if len(c) == 16][:20]
    ibans = [iban(rng) for _ in range(30)] + [iban(rng, "GB", 14)]
    ibans.append(" ".join(ibans[0][i : i + 4] for i in range(0, len(ibans[0]), 4)))
    phones = [f"+1 ({rng.randint(0, 999):03d}) 555-{rng.randint(0, 9999):04d}" for _ in range(40)] + ["+49 30 1234 5678", "(212) 555-0199", "212-555-0199"]
    mails = ["leaupa.90@mail2.example.com", "A.B+c@x-y.example.org", "x@y.co", "leaupa.91@mail2.example.com"]
    new, rows = pseudonym(cards + ibans + phones + mails)
    old = cards + ibans + phones + mails
    for before, after, row in zip(old, new, rows, strict=True):
        assert before != after and row.n_pii == 1, (before, after)
        if "@" not in before:
            assert shape(before) == shape(after)
    for after in new[: len(cards)]:
        assert luhn(re.sub("[ -]", "", after))
    for after in new[len(cards) : len(cards) + len(ibans)]:
        assert mod97(after.replace(" ", "")) == 1
    assert new[len(cards) + len(ibans) - 1].replace(" ", "") == new[len(cards)]
    assert [len(m) for m in new[-4:]] == [len(m) for m in mails] and new[-4].endswith(".com") and new[-4] != new[-1]
    assert len({re.sub("[ -]", "", x) for x in new[: len(cards)]}) == len({re.sub("[ -]", "", x) for x in cards})


def test_values_followed_by_numbers_and_capitals(pseudonym):
    """What follows a card or an IBAN does not hide it, stays as it is and is searched itself."""
    grouped = "AT61 1904 3002 3457 3201"
    cards = [f"{c}{t}" for c in ("4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111") for t in (" 12/27", " 25 items", " 123", " 7", " 12345")]
    ibans = [f"{grouped} {t}" for t in ("EUR", "USD 100", "BIC", "ABCD", "2024 EUR")]
    new, rows = pseudonym(cards + ibans)
    for before, after, row in zip(cards + ibans, new, rows, strict=True):
        n = len(grouped) if before.startswith("AT") else 19 if before[4] in " -" else 16
        assert before[:n] != after[:n] and before[n:] == after[n:] and row.n_pii == 1, (before, after)
        value = re.sub("[ -]", "", after[:n])
        assert mod97(value) == 1 if before.startswith("AT") else luhn(value)
    two, rows = pseudonym([f"{grouped} 4111 1111 1111 1111 12", "4111 1111 1111 1111 12/05/2027", "4111 1111 1111 1111 12@example.com"])
    assert [r.n_pii for r in rows] == [2, 2, 2] and two[0].endswith(" 12")


def test_ranges_are_permuted(pseudonym):
    """Every fourth address of a block, all dates of some years and social security numbers: distinct, valid, in range."""
    ips = [f"10.{a}.{b}.7" for a in range(0, 256, 4) for b in range(0, 256, 32)]
    days = [datetime.date(1990, 1, 1) + datetime.timedelta(d) for d in range(0, 900)]
    dates = [d.isoformat() for d in days] + [d.strftime("%d.%m.%Y") for d in days[:40]] + [d.strftime("%m/%d/%Y") for d in days if d.day > 12][:30]
    ssns = [f"{a:03d}-{b:02d}-{c:04d}" for a in (1, 665, 667, 899) for b in (1, 99) for c in (1, 77, 9999)]
    new, rows = pseudonym(ips + dates + ssns)
    assert all(r.n_pii == 1 for r in rows) and len(set(new)) == len(ips) + len(dates) + len(ssns)
    assert all(all(0 <= int(o) <= 255 for o in x.split(".")) for x in new[: len(ips)])
    moved = [datetime.date.fromisoformat(x) for x in new[len(ips) : len(ips) + len(days)]]
    assert all(1901 <= d.year <= 2096 for d in moved)
    dotted = new[len(ips) + len(days) : len(ips) + len(days) + 40]
    assert dotted == [d.strftime("%d.%m.%Y") for d in moved[:40]]
    for x in new[-len(ssns) :]:
        a, b, c = map(int, x.split("-"))
        assert 1 <= a <= 899 and a != 666 and 1 <= b <= 99 and 1 <= c <= 9999


def test_invalid_values_stay(pseudonym):
    values = [
        "4111111111111112", "12345678901234567890123", "256.1.1.1", "1.2.3", "000-12-3456", "666-12-3456", "123-00-4567", "2023-02-30", "1850-01-01", "31.02.2020", "DE00123456781234567890", "0000000000000000",
        "a@b", "2390409500", "12345", "x4111111111111111", "1.2.3.4.5", "word", "12-34", "CC BY-NC 4.0", 'token = "ae93e105146691ae697923a219be4df655c4f1c7"',
    ]
    new, rows = pseudonym(values)
    assert new == values and all(r.n_pii == 0 for r in rows)


def test_whole_table(spark):
    """Equal values are linked over all documents, no valid value is left, and all other text is unchanged."""
    frame = pii.pseudonymize(spark.read.parquet(f"{SF}/documents.parquet"), "key")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    pattern = r"(?<![\w.])(?:[\w.]+@[\w.]*\w|\+\d \(\d{3}\) \d{3}-\d{4}|\d+\.\d+\.\d+\.\d+|\d{16})(?!\w)"
    link, back, n = {}, {}, 0
    for r in frame.collect():
        old = texts[r.doc_id]
        assert re.split(pattern, old) == re.split(pattern, r.text)
        for a, b in zip(re.findall(pattern, old), re.findall(pattern, r.text), strict=True):
            if re.fullmatch(r"\d{16}", a) and not luhn(a):
                assert a == b
                continue
            n += 1
            assert a != b and link.setdefault(a, b) == b and back.setdefault(b, a) == a
    assert n > 50


def test_keys_and_odd_documents(spark, odd_docs, no_docs):
    rows = spark.createDataFrame([(1, "4111111111111111")], "doc_id long, text string")
    one, two = (pii.pseudonymize(rows, k).first().text for k in ("key one", "it's"))
    assert one != two and one == pii.pseudonymize(rows, "key one").first().text
    got = {r.doc_id: r for r in pii.pseudonymize(odd_docs, "key").collect()}
    assert got[2].text is None and got[2].n_pii == 0 and got[3].text == "" and got[5].n_pii == 0
    assert pii.pseudonymize(odd_docs, "key").count() == odd_docs.count()
    assert pii.pseudonymize(no_docs, "key").collect() == []


def test_letters_of_all_alphabets(pseudonym):
    """Mail addresses keep the alphabet and the case of each letter; none is lost, left as it was throughout or broken."""
    import unicodedata

    names = ["łukasz", "müller", "ƅukasz", "ŀuis", "οδυσσεύς", "дмитрий", "北京市民", "김철수", "أحمد", "éric.çelik", "straße", "ÿves", "ñandú"]
    mails = [f"{n}@firma.pl" for n in names]
    new, rows = pseudonym(mails + [m.upper().replace("@FIRMA.PL", "@firma.pl") for m in mails[:2]])
    assert all(r.n_email == 1 for r in rows)
    for before, after in zip(mails, new, strict=False):
        assert before != after and len(before) == len(after) and re.fullmatch(pii.FORMS["email"].replace("++", "+").replace(r"\p{L}", r"\w").replace(r"\p{N}", ""), after), after
        for a, b in zip(before, after, strict=True):
            assert unicodedata.category(a) == unicodedata.category(b) and (a.isascii() == b.isascii())
    assert len(set(new[: len(mails)])) == len(mails)
    # Addresses are one whatever their case; letters of no known alphabet stay in their place.
    assert new[-2:] == new[:2]
    assert pseudonym(["ꙁa@b.org"])[0][0][0] == "ꙁ" and pseudonym(["𐐨a@b.org"])[0][0][0] == "𐐨"


def test_equal_numbers_in_other_forms_are_linked(pseudonym):
    forms = ["+4915112345678", "+49 151 12345678", "+49-151-1234-5678", "+49 1511 234 5678"]
    new, rows = pseudonym(forms + ["+420123456789", "+420 123 456 789", "+12125550199", "+1 (212) 555-0199", "+7 495 123 4567", "+351912345678"])
    digits = [re.sub("[^0-9]", "", x) for x in new]
    assert all(r.n_phone == 1 for r in rows)
    assert len(set(digits[:4])) == 1 and digits[0].startswith("49") and digits[0] != "4915112345678"
    assert digits[4] == digits[5] and digits[4].startswith("420") and digits[6] == digits[7] and digits[6][0] == "1"
    assert digits[8][0] == "7" and digits[9].startswith("351")
    cards, rows = pseudonym(["3056 930902 5904", "30569309025904", "3056-930902-5904"])
    assert all(r.n_card == 1 for r in rows) and cards[0] != "3056 930902 5904" and cards[0][4] == cards[0][11] == " "
    assert len({re.sub("[ -]", "", c) for c in cards}) == 1 and luhn(cards[1])
    ibans, rows = pseudonym(["DE89370400440532013000", "de89370400440532013000", "de89 3704 0044 0532 0130 00", "de12 3456 words that follow"])
    assert [r.n_iban for r in rows] == [1, 1, 1, 0] and ibans[1] == ibans[0].lower() and ibans[2].replace(" ", "") == ibans[1]


def plain_feistel(text, key, tweak):
    """The network over characters, by the definition."""
    import hashlib

    def shift(mine, other, r):
        seed = f"{key}|{tweak}|{r}|{len(a)}|{len(b)}|{','.join(map(str, other))}"
        h, out = hashlib.sha512(seed.encode()).hexdigest(), []
        for i, c in enumerate(mine):
            k = int(h[i % 32 * 4 : i % 32 * 4 + 4], 16)
            for low, size, step in pii.ALPHABETS:
                if low <= c <= low + (size - 1) * step and (c - low) % step == 0:
                    c = low + ((c - low) // step + k) % size * step
                    break
            out.append(c)
        return out

    codes = [ord(c) for c in text]
    a, b = codes[: len(codes) // 2], codes[len(codes) // 2 :]
    for r in range(pii.ROUNDS):
        a, b = (shift(a, b, r), b) if r % 2 == 0 else (a, shift(b, a, r))
    return "".join(map(chr, a + b))


def plain_pair(a, b, sizes, key, tweak):
    import hashlib

    for r in range(pii.ROUNDS):
        value = int(hashlib.sha256(f"{key}|{tweak}|{r}|{b if r % 2 == 0 else a}".encode()).hexdigest()[:12], 16)
        a, b = ((a + value) % sizes[0], b) if r % 2 == 0 else (a, (b + value) % sizes[1])
    return a, b


def test_equals_a_plain_network(pseudonym):
    rng = random.Random(2)
    cards = [card(rng) for _ in range(10)]
    mails = [f"{''.join(rng.choice('abcxyzéж0') for _ in range(rng.randint(1, 40)))}@d{i}.example.org" for i in range(20)]
    phones = [f"+44{rng.randint(10**9, 10**10 - 1)}" for _ in range(5)]
    ips = [".".join(str(rng.randint(0, 255)) for _ in range(4)) for _ in range(10)]
    want = []
    for c in cards:
        head = plain_feistel(c[:-1], "key", "card")
        want.append(next(head + d for d in "0123456789" if luhn(head + d)))
    want += [plain_feistel(m[:-4], "key", "email") + ".org" for m in mails]
    want += ["+44" + plain_feistel(p[3:], "key", "phone") for p in phones]
    for ip in ips:
        o = list(map(int, ip.split(".")))
        a, b = plain_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), "key", "ip")
        want.append(f"{a // 256}.{a % 256}.{b // 256}.{b % 256}")
    assert pseudonym(cards + mails + phones + ips)[0] == want
