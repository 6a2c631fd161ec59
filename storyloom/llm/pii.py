"""Format-preserving Feistel pseudonyms for personal data, in SQL expressions only.

Mail addresses, phone numbers, payment cards, IBANs, IPv4 addresses, social security numbers and dates are found
by one pattern and validated (Luhn, mod 97, ranges, calendar). A valid value is permuted within its format by a
keyed ten-round Feistel network, so equal values have equal pseudonyms in all documents and different values of
a format different ones; check digits are made anew. Strings are permuted character by character (a digit stays
a digit, a letter a letter of its alphabet and case), numbers of a known range as pairs (a, b) with a in [0, A), b in [0, B)
where A * B is exactly the size of the range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "iban", "phone", "card", "ssn", "ip", "date")
ROUNDS = 10

#: Runs of letters or digits that are permuted among themselves: first code point, how many, and their distance.
#: Latin Extended-A has capitals and small letters in turn. What is in no run stays as it is.
ALPHABETS = [
    (0x30, 10, 1), (0x61, 26, 1), (0x41, 26, 1), (0xDF, 24, 1), (0xF8, 8, 1), (0xC0, 23, 1), (0xD8, 7, 1),
    (0x101, 28, 2), (0x100, 28, 2), (0x13A, 8, 2), (0x139, 8, 2), (0x14B, 23, 2), (0x14A, 23, 2), (0x17A, 3, 2), (0x179, 3, 2),
    (0x3B1, 25, 1), (0x391, 17, 1), (0x3A3, 7, 1), (0x3AC, 4, 1), (0x3CC, 3, 1), (0x430, 48, 1), (0x400, 48, 1),
    (0x5D0, 27, 1), (0x620, 43, 1), (0x904, 54, 1), (0xE01, 48, 1), (0x3041, 86, 1), (0x30A1, 90, 1), (0x4E00, 20992, 1), (0xAC00, 11172, 1),
]
#: Calling codes of one and two digits; all others have three.
CALLING_CODE = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: The whole match decides the kind; ``PATTERN`` finds candidates, first alternative first.
FORMS = {
    "email": r"[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}+",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}",
    "ip": rf"(?:{_OCTET}\.){{3}}{_OCTET}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "date": r"[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4}",
    "card": r"[0-9]{4}(?:[ -]?[0-9]{4}){2,3}(?:[ -]?[0-9]{1,3})?|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{4,5}",
}

#: Countries by the length of their IBAN; other countries take the longest run of groups, in capitals only.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """An IBAN of its country's length first, so that groups which follow it are left to the text."""
    ends = lambda n, case: rf"(?: ?[{case}0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[{case}0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])"
    fixed = "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}{ends(n, 'A-Z')}" for n, names in IBAN_LENGTHS.items())
    small = "|".join(f"(?:{names.lower().replace(' ', '|')})[0-9]{{2}}{ends(n, 'a-z')}" for n, names in IBAN_LENGTHS.items())
    return f"(?:{fixed}|(?=[a-z]{{2}}[0-9]{{2}})(?:{small})|{FORMS['iban'].split('|')[0]})"


def _pattern() -> str:
    groups = FORMS["date"].replace(r"\1", r"\k<s>").replace(r"\2", r"\k<t>").replace("([-/.])", "(?<s>[-/.])", 1).replace("([-/.])", "(?<t>[-/.])", 1)
    mail = rf"(?<![\p{{L}}\p{{N}}._%+-]){FORMS['email']}"
    iban = rf"(?<![A-Za-z0-9]){_iban_pattern()}(?![A-Za-z0-9])"
    # The last digits of a card are not taken from a date or a mail address that follows it.
    card = FORMS["card"].replace("(?:[ -]?[0-9]{1,3})?", r"(?:[0-9]{1,3}|[ -][0-9]{1,3}(?!/[0-9]|[\p{L}\p{N}._%+-]*@))?")
    numbers = "|".join([FORMS["phone"], FORMS["ip"], FORMS["ssn"], groups, card])
    return rf"{mail}|{iban}|(?<![\p{{L}}0-9_+.-])(?:{numbers})(?![\p{{L}}0-9_]|[.-][0-9])"


PATTERN = _pattern()


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _permuted_text(text: str, key: str, tweak: str) -> str:
    """A character-wise Feistel network over the string ``text``."""
    stream = f"sha2(concat({key}, '|{tweak}|', r, '|', size(acc.a), '|', size(acc.b), '|', array_join({{}}, ',')), 512)"
    moved = " ".join(
        f"when c between {low} and {low + (size - 1) * step}" + (f" and (c - {low}) % {step} = 0" if step > 1 else "")
        + f" then {low} + ((c - {low}) div {step} + {{k}}) % {size} * {step}" for low, size, step in ALPHABETS
    )
    shift = "transform({}, (c, i) -> cast(case " + moved + " else c end as int))"
    number = "cast(conv(substr(h, (i % 32) * 4 + 1, 4), 16, 10) as int)"
    half = lambda mine, other: _let("h", stream.format(other), shift.format(mine, k=number))
    codes = f"transform(split({text}, ''), c -> ascii(c))"
    start = "named_struct('a', slice(w, 1, size(w) div 2), 'b', slice(w, size(w) div 2 + 1, size(w)))"
    step = f"if(r % 2 = 0, named_struct('a', {half('acc.a', 'acc.b')}, 'b', acc.b), named_struct('a', acc.a, 'b', {half('acc.b', 'acc.a')}))"
    run = f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (acc, r) -> {step}, acc -> {_characters('concat(acc.a, acc.b)')})"
    return _let("w", codes, run)


def _characters(codes: str) -> str:
    """The string of an array of code points."""
    return f"decode(unhex(array_join(transform({codes}, c -> lpad(hex(c), 8, '0')), '')), 'UTF-32')"


def _permuted_pair(a: str, b: str, size_a: int, size_b: int, key: str, tweak: str) -> str:
    """A numeric Feistel network over [0, size_a) x [0, size_b): a struct of ``a`` and ``b``."""
    value = lambda x: f"cast(conv(substr(sha2(concat({key}, '|{tweak}|', r, '|', {x}), 256), 1, 12), 16, 10) as bigint)"
    step = (
        f"if(r % 2 = 0, named_struct('a', pmod(acc.a + {value('acc.b')}, {size_a}L), 'b', acc.b), "
        f"named_struct('a', acc.a, 'b', pmod(acc.b + {value('acc.a')}, {size_b}L)))"
    )
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (acc, r) -> {step})"


def _filled(form: str, value: str) -> str:
    """``form`` with its letters and digits replaced, one by one, by the characters of ``value``."""
    step = "if(c rlike '[0-9A-Za-z]', named_struct('o', concat(acc.o, substr(v, acc.k, 1)), 'k', acc.k + 1), named_struct('o', concat(acc.o, c), 'k', acc.k))"
    return _let("v", value, f"aggregate(split({form}, ''), named_struct('o', '', 'k', 1), (acc, c) -> {step}, acc -> acc.o)")


def _luhn(digits: str, shift: int) -> str:
    """Luhn sum; ``shift`` 0 for a number with its check digit, 1 for one without."""
    digit = f"cast(substr({digits}, length({digits}) - i, 1) as int)"
    doubled = f"(2 * {digit} - if({digit} > 4, 9, 0))"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + if((i + {shift}) % 2 = 1, {doubled}, {digit}))"


def _mod97(iban: str) -> str:
    """Remainder of the IBAN's number (first four characters moved to the end)."""
    turned = f"concat(substr({iban}, 5), substr({iban}, 1, 4))"
    return f"aggregate(split({turned}, ''), 0L, (s, c) -> if(c rlike '[0-9]', (s * 10 + cast(c as int)) % 97, (s * 100 + ascii(c) - 55) % 97))"


#: 1901-01-01 to 2096-12-31: 71,589 days, 147 x 487.
_DAYS = (147, 487)
#: Areas 1-899 without 666, groups 1-99; serials 1-9999.
_AREAS_GROUPS, _SERIALS = 898 * 99, 9999


def _date(x: str, key: str) -> str:
    """The pseudonym of a date of one of the orders y-m-d, d-m-y and (where only that is valid) m-d-y; null if it is none."""
    parts = f"split({x}, '[-/.]')"
    sep = f"regexp_extract({x}, '[-/.]', 0)"
    day = lambda y, m, d: f"try_cast(concat(p[{y}], '-', lpad(p[{m}], 2, '0'), '-', lpad(p[{d}], 2, '0')) as date)"
    order = f"case when length(p[0]) = 4 then named_struct('o', 'ymd', 'v', {day(0, 1, 2)}) when {day(2, 1, 0)} is not null then named_struct('o', 'dmy', 'v', {day(2, 1, 0)}) else named_struct('o', 'mdy', 'v', {day(2, 0, 1)}) end"
    number = "datediff(f.v, date'1901-01-01')"
    moved = _permuted_pair(f"({number} div {_DAYS[1]})", f"({number} % {_DAYS[1]})", *_DAYS, key, "date")
    field = lambda pattern: f"if(length({x}) = 10, date_format(n, '{pattern}{pattern}'), date_format(n, '{pattern}'))"
    shown = f"case f.o when 'ymd' then concat_ws(q, date_format(n, 'yyyy'), {field('M')}, {field('d')}) when 'dmy' then concat_ws(q, {field('d')}, {field('M')}, date_format(n, 'yyyy')) else concat_ws(q, {field('M')}, {field('d')}, date_format(n, 'yyyy')) end"
    new = _let("z", moved, f"date_add(date'1901-01-01', cast(z.a * {_DAYS[1]} + z.b as int))")
    body = f"if(f.v between date'1901-01-01' and date'2096-12-31', {_let('n', new, _let('q', sep, shown))}, null)"
    return _let("p", parts, _let("f", order, body))


def _ssn(x: str, key: str) -> str:
    area, group, serial = (f"cast(split({x}, '-')[{i}] as int)" for i in range(3))
    rank = f"({area} - if({area} > 666, 2, 1)) * 99 + {group} - 1"
    moved = _permuted_pair(rank, f"{serial} - 1", _AREAS_GROUPS, _SERIALS, key, "ssn")
    new_area = "z.a div 99 + if(z.a div 99 >= 665, 2, 1)"
    shown = f"concat(lpad({new_area}, 3, '0'), '-', lpad(z.a % 99 + 1, 2, '0'), '-', lpad(z.b + 1, 4, '0'))"
    return f"if({area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0, {_let('z', moved, shown)}, null)"


def _ip(x: str, key: str) -> str:
    octet = lambda i: f"cast(split({x}, '[.]')[{i}] as int)"
    moved = _permuted_pair(f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", 65536, 65536, key, "ip")
    return _let("z", moved, "concat_ws('.', z.a div 256, z.a % 256, z.b div 256, z.b % 256)")


def _card(x: str, key: str) -> str:
    """Where the whole is no valid card, its first 16 digits may be one that a number follows."""
    head = f"regexp_extract({x}, '^([0-9]{{4}}(?:[ -]?[0-9]{{4}}){{3}})[ -][0-9]{{1,3}}$', 1)"
    return f"coalesce({_whole_card(x, key)}, {_let('e', head, f'concat({_whole_card("e", key)}, substr({x}, length(e) + 1))')})"


def _whole_card(x: str, key: str) -> str:
    new = _let("u", _permuted_text("substr(d, 1, length(d) - 1)", key, "card"), f"concat(u, (10 - {_luhn('u', 1)} % 10) % 10)")
    body = f"if(length(d) between 13 and 19 and {_luhn('d', 0)} % 10 = 0 and d rlike '[1-9]', {_filled(x, new)}, null)"
    return _let("d", f"regexp_replace({x}, '[^0-9]', '')", body)


def _phone(x: str, key: str) -> str:
    """The digits after the calling code, which a number with a plus sign begins with, however it is separated."""
    code = f"if({x} like '+%', regexp_extract(d, '^({CALLING_CODE})', 1), '')"
    new = f"concat({code}, {_permuted_text(f'substr(d, length({code}) + 1)', key, 'phone')})"
    return _let("d", f"regexp_replace({x}, '[^0-9]', '')", f"if(length(d) between 8 and 15, {_filled(x, new)}, null)")


def _iban(x: str, key: str) -> str:
    body = _permuted_text("substr(d, 5)", key, "iban")
    check = _mod97("concat(substr(d, 1, 2), '00', u)")
    new = _let("u", body, f"concat(substr(d, 1, 2), lpad(98 - {check}, 2, '0'), u)")
    # Small and capital letters are one number; the pseudonym keeps the case.
    cased = _let("m", new, f"if({x} = lower({x}), lower(m), m)")
    return _let("d", f"upper(replace({x}, ' ', ''))", f"if(length(d) between 15 and 34 and {_mod97('d')} = 1, {_filled(x, cased)}, null)")


def _email(x: str, key: str) -> str:
    """The address without its last label, in lower case, as one string."""
    last = f"substring_index({x}, '.', -1)"
    head = f"lower(substr({x}, 1, length({x}) - length({last}) - 1))"
    return f"concat({_permuted_text(head, key, 'email')}, '.', {last})"


_MAKERS = {"email": _email, "iban": _iban, "phone": _phone, "ip": _ip, "ssn": _ssn, "date": _date, "card": _card}


def _value(x: str, key: str) -> str:
    """Struct (kind, new) of one match; null where its value is not valid."""
    cases = " ".join(f"when {x} rlike {_quote('^(?:' + FORMS[k] + ')$')} then named_struct('kind', '{k}', 'new', {make(x, key)})" for k, make in _MAKERS.items())
    return f"case {cases} end"


def pseudonymize(docs: DataFrame, key: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The ``keep`` columns, ``text`` with pseudonyms, ``n_<kind>`` for each kind, and ``n_pii``, for every row.

    ``key`` is the secret: the same key gives the same pseudonyms in every run. Values that fail validation stay
    as they are (a number without a valid check digit is not a card). A null text stays null with counts 0, an
    empty one empty. Dates outside 1901-2096 stay. Repeated rows give repeated results; other columns are not read.
    """
    keep = ["doc_id"] if keep is None else keep
    secret = _quote(key)
    texts = docs.select(*keep, F.col(text).alias("__text"))
    pattern = F.lit(PATTERN)
    none = F.array().cast("array<string>")
    # Each step is a projection of its own, as Spark does not copy a costly expression that is used twice.
    found = texts.withColumn("__found", F.when(F.col("__text").rlike("[0-9@]"), F.regexp_extract_all("__text", pattern, F.lit(0))).otherwise(none))
    found = found.withColumn("__values", F.expr(f"transform(__found, x -> {_value('x', secret)})"))
    rest = F.split("__text", PATTERN, -1)
    shown = F.expr("zip_with(__found, __values, (x, v) -> coalesce(v.new, x))")
    joined = F.array_join(F.zip_with(rest, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    new = F.when(F.expr("exists(__values, v -> v.new is not null)"), joined).otherwise(F.col("__text"))
    counts = [F.expr(f"coalesce(cast(size(filter(__values, v -> v.kind = '{k}' and v.new is not null)) as bigint), 0L)").alias(f"n_{k}") for k in KINDS]
    total = F.expr("coalesce(cast(size(filter(__values, v -> v.new is not null)) as bigint), 0L)").alias("n_pii")
    return found.select(*keep, new.alias("text"), *counts, total)
