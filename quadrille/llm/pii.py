"""Keyed format-preserving pseudonyms, in SQL expressions only.

One pattern finds candidates; each is validated (Luhn, mod 97, octets, calendar,
numbering plans) and then permuted by an eight-round Feistel network inside its
own format: a card stays a card with a right check digit, a date stays a date.
The permutation depends on the key and the kind alone, so equal values give
equal pseudonyms in every document and different values never meet.  Mail
names and credentials are permuted character by character within their
classes (digit, lower, upper) in blocks of 128; names that differ only in case
stay linked and keep their capitals in place.

The key has no default: whoever has it can undo the pseudonyms.

Defined results: candidates that fail validation and all other text stay byte
for byte; a null or empty text stays as it is; rows that repeat give equal
rows; an empty table gives an empty result; other columns pass through, and a
column with the name of the count is replaced; the text of a long document is
processed whole, and so is a value of any length.  Two-digit years are not
dates here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import fresh

ROUNDS = 8
#: Characters that one permutation of letters covers.
BLOCK = 128

MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,63}(?![A-Za-z0-9-])"
IPV4 = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"
PHONE = r"(?<![\w+(])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
DATE = r"(?<![\w/.-])(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\w/-]|\.\d)"
CARD = r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])"
#: Countries by the length of their IBAN: grouped by spaces, only the length tells where it ends.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "DZ|IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV",
    29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_SPACED = "|".join(rf"(?:{c})\d{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
IBAN = rf"(?<!\w)(?:[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}|{_SPACED})(?!\w)"
CLOUD_KEY = r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)"
#: The value may go on after dots (JWT); a dot at its end is not part of it.
SECRET = r"(?<!\w)(?i:password|passwd|token|secret|api_key)\s{0,3}[=:]\s{0,3}\"?(?=[A-Za-z0-9_/+-]{8})[A-Za-z0-9_/+.-]{8,}(?<![.])\"?"
PATTERN = "|".join(f"(?:{p})" for p in (MAIL, CLOUD_KEY, SECRET, IBAN, DATE, SSN, PHONE, IPV4))
#: Digits with spaces and hyphens between, searched for cards in what the other patterns leave.
RUN = r"(?<![\w.+-])\d[\d -]{11,}\d(?![\w-])"
#: Groups of a card with neighbours: four digits or more each, one kind of separator, the last of any length.
GROUPS = r"^\d{4,}(?:([ -])(?:\d{4,}\1)*\d+)?$"


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _full(x: str, pattern: str) -> str:
    return f"({x} rlike {_q('^(?:' + pattern + ')$')})"


def _noise(key: str, kind: str, round_: str, x: str) -> str:
    """A number below 2^60 from the key, the kind, the round and a value."""
    return f"cast(conv(substr(sha2(concat_ws('|', {_q(key)}, {_q(kind)}, {round_}, {x}), 256), 1, 15), 16, 10) as bigint)"


def _feistel(key: str, kind: str, left: str, right: str, a: int, b: int, then: str) -> str:
    """Permute the pairs of [0, a) x [0, b); then: an expression over s.l and s.r."""
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> "
        f"if(i % 2 = 0, named_struct('l', pmod(s.l + {_noise(key, kind, 'i', 's.r')}, {a}L), 'r', s.r), "
        f"named_struct('l', s.l, 'r', pmod(s.r + {_noise(key, kind, 'i', 's.l')}, {b}L))), s -> {then})"
    )


def _letters(key: str, kind: str, value: str, classes: str) -> str:
    """Permute a string of up to 128 characters within the class (d, n, l, u, other: fixed) of each."""

    def half(mine: str, other: str, kinds: str) -> str:
        byte = f"cast(conv(substr(sha2(concat_ws('|', {_q(key)}, {_q(kind)}, i, {other}), 512), 2 * j - 1, 2), 16, 10) as int)"
        code, cls = f"ascii(substr({mine}, j, 1))", f"substr({kinds}, j, 1)"
        return (
            f"array_join(transform(sequence(1, length({mine})), j -> case {cls} when 'd' then chr(48 + pmod({code} - 48 + {byte}, 10)) "
            f"when 'n' then chr(50 + pmod({code} - 50 + {byte}, 8)) when 'l' then chr(97 + pmod({code} - 97 + {byte}, 26)) "
            f"when 'u' then chr(65 + pmod({code} - 65 + {byte}, 26)) else substr({mine}, j, 1) end), '')"
        )

    mid = f"cast(ceil(length({value}) / 2) as int)"
    return (
        f"if(length({value}) < 2, {value}, aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', substr({value}, 1, {mid}), 'r', substr({value}, {mid} + 1)), (s, i) -> "
        f"if(i % 2 = 0, named_struct('l', {half('s.l', 's.r', f'substr({classes}, 1, {mid})')}, 'r', s.r), "
        f"named_struct('l', s.l, 'r', {half('s.r', 's.l', f'substr({classes}, {mid} + 1)')})), s -> concat(s.l, s.r)))"
    )


def _classes(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '[a-z]', 'l'), '[A-Z]', 'u'), '[0-9]', 'd')"


def _luhn(digits: str) -> str:
    """The sum whose last digit is 0 for a right check digit."""
    d = f"cast(substr({digits}, length({digits}) - k, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (t, k) -> t + if(k % 2 = 0, {d}, if({d} > 4, 2 * {d} - 9, 2 * {d})))"


def _respaced(shape: str, digits: str) -> str:
    """Digits put in place of the digits of shape."""
    return f"aggregate(sequence(1, length({shape})), named_struct('t', '', 'k', 1), (s, p) -> if(substr({shape}, p, 1) rlike '[0-9]', named_struct('t', concat(s.t, substr({digits}, s.k, 1)), 'k', s.k + 1), named_struct('t', concat(s.t, substr({shape}, p, 1)), 'k', s.k)), s -> s.t)"


def _bind(value: str, name: str, body: str) -> str:
    """Give an expression a name in body, so it is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _mod97(iban: str) -> str:
    turned = f"concat(substr({iban}, 5), substr({iban}, 1, 4))"
    return f"aggregate(split({turned}, ''), 0, (t, c) -> if(c = '', t, if(c rlike '[0-9]', (t * 10 + cast(c as int)) % 97, (t * 100 + ascii(c) - 55) % 97)))"


def _ip(key: str, m: str) -> str:
    octet = lambda i: f"cast(split({m}, '[.]')[{i}] as int)"
    then = "concat_ws('.', s.l div 256, s.l % 256, s.r div 256, s.r % 256)"
    valid = " and ".join(f"{octet(i)} < 256" for i in range(4))
    return f"if({valid}, {_feistel(key, 'ip', f'{octet(0)} * 256 + {octet(1)}', f'{octet(2)} * 256 + {octet(3)}', 65536, 65536, then)}, {m})"


def _ssn(key: str, m: str) -> str:
    area, group, serial = (f"cast(split({m}, '-')[{i}] as int)" for i in range(3))
    rank = f"({area} - 1 - if({area} > 666, 1, 0)) * 99 + {group} - 1"
    back = "(s.l div 99 + 1 + if(s.l div 99 + 1 >= 666, 1, 0))"
    then = f"concat_ws('-', lpad({back}, 3, '0'), lpad(s.l % 99 + 1, 2, '0'), lpad(s.r + 1, 4, '0'))"
    return f"if({area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0, {_feistel(key, 'ssn', rank, f'{serial} - 1', 898 * 99, 9999, then)}, {m})"


#: Days of 1900-01-01 to 2099-12-31, and two factors of their number.
DAYS, DAYS_A, DAYS_B = 73049, 17, 4297


def _day(key: str, n: str) -> str:
    """Permute day numbers, which are exactly the pairs of [0, DAYS_A) x [0, DAYS_B)."""
    return _feistel(key, "date", f"{n} div {DAYS_B}", f"{n} % {DAYS_B}", DAYS_A, DAYS_B, f"s.l * {DAYS_B} + s.r")


def _date(key: str, m: str) -> str:
    sep = f"regexp_extract({m}, '[^0-9]', 0)"
    bit = lambda i: f"split({m}, '[^0-9]')[{i}]"
    first = f"length({bit(0)}) = 4"
    us = f"({sep} = '/' and not {first} and cast({bit(0)} as int) <= 12)"
    year, month, day = f"if({first}, {bit(0)}, {bit(2)})", f"if({first} or not {us}, {bit(1)}, {bit(0)})", f"if({first}, {bit(2)}, if({us}, {bit(1)}, {bit(0)}))"
    value = f"try_make_timestamp(cast({year} as int), cast({month} as int), cast({day} as int), 0, 0, cast(0 as decimal(16, 6)))"
    number = f"datediff(cast({value} as date), date'1900-01-01')"
    day_ = _bind(f"date_add(date'1900-01-01', cast({_day(key, 'n')} as int))", "d", f"concat_ws({sep}, if({first}, lpad(year(d), 4, '0'), if({us}, lpad(month(d), 2, '0'), lpad(day(d), 2, '0'))), if({first} or not {us}, lpad(month(d), 2, '0'), lpad(day(d), 2, '0')), if({first}, lpad(day(d), 2, '0'), lpad(year(d), 4, '0')))")
    return _bind(number, "n", f"if(n between 0 and {DAYS - 1}, {day_}, {m})")


def _phone(key: str, m: str) -> str:
    digits = f"right(regexp_replace({m}, '[^0-9]', ''), 10)"
    plan = f"if(p rlike '^[2-9]..[2-9]', 'nddndddddd', 'dddddddddd')"  # noqa: F541
    local = _letters(key, "phone", "p", plan)
    place = f"if({m} like '+1%', concat('+1', {_respaced(f'substr({m}, 3)', 'o')}), {_respaced(m, 'o')})"
    return _bind(digits, "p", f"if(p rlike '^[2-9]..[2-9]' or {m} like '+1%', {_bind(local, 'o', place)}, {m})")


def _card(key: str, m: str) -> str:
    body = _letters(key, "card", "substr(c, 2, length(c) - 2)", "repeat('d', length(c) - 2)")
    check = f"concat(b, pmod(10 - ({_luhn('concat(b, 0)')}) % 10, 10))"
    out = _bind(f"concat(substr(c, 1, 1), {body})", "b", _bind(check, "o", _respaced(m, "o")))
    return _bind(f"regexp_replace({m}, '[^0-9]', '')", "c", f"if(length(c) between 13 and 19, if(({_luhn('c')}) % 10 = 0 and c rlike '[1-9]', {out}, {m}), {m})")


def _cards(key: str, run: str) -> str:
    """A run with its cards replaced, their digits as letters (K to T the first of a card, a to j the others).

    Unbroken numbers come first, then readings in groups from the longest on, then the longest reading in
    any groups.  Letters are never read again, so readings that overlap a card fall away."""
    digits = lambda x: f"regexp_replace({x}, '[^0-9]', '')"
    readings = ", ".join(f"regexp_extract_all({run}, {_q(rf'(?<!\d)(?=((?:\d[ -]?){{{n - 1}}}\d)(?!\d))')}, 1)" for n in range(19, 12, -1))
    shaped = f"filter(flatten(array({readings})), x -> x rlike {_q(GROUPS)})"
    valid = f"filter(concat(filter(s, x -> not x rlike '[ -]'), filter(s, x -> x rlike '[ -]'), regexp_extract_all({run}, {_q(CARD)}, 0)), x -> {_bind(digits('x'), 'y', f'({_luhn("y")}) % 10 = 0')})"
    masked = _bind(_card(key, "x"), "o", "concat(translate(substr(o, 1, 1), '0123456789', 'KLMNOPQRST'), translate(substr(o, 2), '0123456789', 'abcdefghij'))")
    return _bind(shaped, "s", f"aggregate({valid}, {run}, (t, x) -> if(instr(t, x) > 0, regexp_replace(t, concat('(?<![0-9])', x, '(?![0-9])'), {masked}), t))")


def _iban(key: str, m: str) -> str:
    body = _letters(key, "iban", f"substr({m}, 5)", _classes(f"substr({m}, 5)"))
    sealed = _bind(body, "b", f"concat(substr({m}, 1, 2), lpad(98 - {_mod97(f'concat(substr({m}, 1, 2), 0, 0, b)')}, 2, '0'), b)")
    return f"if({_mod97(m)} = 1, {sealed}, {m})"


def _spaced_iban(key: str, m: str) -> str:
    return _bind(f"replace({m}, ' ', '')", "z", _bind(_iban(key, "z"), "o", "regexp_replace(o, '(.{4})(?=.)', '$1 ')"))


def _blocks(key: str, kind: str, value: str) -> str:
    """_letters() over blocks of a value of any length."""
    block = _bind(f"substr({value}, {BLOCK} * k + 1, {BLOCK})", "b", _letters(key, kind, "b", _classes("b")))
    return f"array_join(transform(sequence(0, cast((length({value}) - 1) div {BLOCK} as int)), k -> {block}), '')"


def _mail(key: str, m: str) -> str:
    # The name in lower case is permuted; capitals come back where they were.
    capitals = "array_join(transform(sequence(1, length(n)), j -> if(substr(n, j, 1) rlike '[A-Z]', upper(substr(o, j, 1)), substr(o, j, 1))), '')"
    name = _bind("lower(n)", "u", _bind(_blocks(key, "mail", "u"), "o", f"if(n = u, o, {capitals})"))
    return _bind(f"substring_index({m}, '@', 1)", "n", f"concat({name}, '@', substring_index({m}, '@', -1))")


def _secret(key: str, m: str) -> str:
    head = f"regexp_extract({m}, '^[A-Za-z_]+\\\\s*[=:]\\\\s*\"?', 0)"
    quote = f"if({m} like '%\"', '\"', '')"
    value = f"substr({m}, length(h) + 1, length({m}) - length(h) - length({quote}))"
    return _bind(head, "h", _bind(value, "v", f"concat(h, {_blocks(key, 'secret', 'v')}, {quote})"))


def pseudonym(m: str, key: str) -> str:
    """SQL for the pseudonym of one candidate m."""
    cloud = f"concat(substr({m}, 1, 4), {_letters(key, 'cloud', f'substr({m}, 5)', _classes(f'substr({m}, 5)'))})"
    # Patterns without their look-around: the candidate stands alone here.
    return (
        f"case when {_full(m, '[^@]+@.*')} then {_mail(key, m)} when {_full(m, '(?:AKIA|ASIA)[A-Z0-9]{16}')} then {cloud} "
        f"when {_full(m, '(?s)[A-Za-z_]+[ ]*.*[=:].*')} then {_secret(key, m)} when {_full(m, '[A-Z]{2}[0-9]{2}[A-Z0-9]+')} then {_iban(key, m)} "
        f"when {_full(m, '[A-Z]{2}[0-9]{2} .*')} then {_spaced_iban(key, m)} "
        f"when {_full(m, '[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}')} then {_date(key, m)} "
        f"when {_full(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')} then {_ssn(key, m)} when {_full(m, '([0-9]{1,3}[.]){3}[0-9]{1,3}')} then {_ip(key, m)} "
        f"when {_full(m, PHONE)} then {_phone(key, m)} else {m} end"
    )


def apply(docs: DataFrame, key: str, name: str = "n_pseudonyms") -> DataFrame:
    """docs with text pseudonymised and the number of pseudonyms added or replaced under `name`."""
    if not key:
        raise ValueError("pseudonyms need a key")
    base = [c for c in docs.columns if c != name]
    p, r = _q(f"({PATTERN})"), _q(RUN)
    mark, parts, new = fresh(docs, "__mark"), fresh(docs, "__parts"), fresh(docs, "__new")
    # The pattern runs once: candidates are set between marks that the text cannot hold, as they come from a digest of it.
    marked = docs.select(*base).withColumn(mark, F.expr("concat(chr(1), substr(sha2(text, 256), 1, 24), chr(1))"))
    marked = marked.withColumn(parts, F.expr(f"if(text is null, null, split(regexp_replace(text, {p}, concat(`{mark}`, '$1', `{mark}`)), `{mark}`, -1))"))
    # Odd places hold candidates, even ones what lies between; there the cards are looked for.
    run = _bind(_cards(key, "m"), "t", "named_struct('p', translate(t, 'KLMNOPQRSTabcdefghij', '01234567890123456789'), 'n', length(t) - length(translate(t, 'KLMNOPQRST', '')))")
    runs = f"transform(regexp_extract_all(a, {r}, 0), m -> {run})"
    piece = f"if(a rlike {r}, {_bind(runs, 'c', f"named_struct('p', array_join(zip_with(split(a, {r}, -1), c, (u, v) -> concat(u, coalesce(v.p, ''))), ''), 'n', aggregate(c, 0, (k, v) -> k + v.n))")}, named_struct('p', a, 'n', 0))"
    own = _bind(pseudonym("a", key), "o", "named_struct('p', o, 'n', if(a <> o, 1, 0))")
    out = marked.withColumn(new, F.expr(f"if(size(`{parts}`) > 1 or text rlike {r}, transform(`{parts}`, (a, i) -> if(i % 2 = 1, {own}, {piece})), null)"))
    text = F.expr(f"if(`{new}` is null, text, array_join(transform(`{new}`, x -> x.p), ''))")
    count = F.expr(f"coalesce(aggregate(`{new}`, 0, (k, x) -> k + x.n), 0)")
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in base], count.cast("int").alias(name))
