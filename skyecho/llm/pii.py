"""Format-preserving pseudonyms for personal data, in SQL expressions only.

Candidates are found by one pattern, validated (Luhn's check for card numbers,
octets, calendar dates and so on) and replaced within their format: the digits
of a number, the four octets of an address, the rank of a social security number
among the valid ones or that of a date among those of its width go through a
keyed Feistel network over exactly that domain, so the map is one to one,
pseudonyms are as valid as what they replace, equal values have equal pseudonyms
in every document, and the holder of the key can invert it. Mail addresses and secrets, which have no small domain, get keyed
digests. Everything else of a text stays as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyecho.llm.common import clashing

#: The forms looked for, in order of precedence.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
MAIL = r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,8}(?<=\.[A-Za-z]{2,24})"
WORDS = r"(?i:token|secret|password|passwd|api[_-]?key)"
#: An equals sign separates a value from its word and may end it, but doesn't begin it.
SECRET = rf"(?<![A-Za-z0-9_/+-])(?=[A-Za-z0-9_/+-][A-Za-z0-9_/+=-]{{15}})(?<={WORDS}[^\p{{L}}0-9\n]{{1,8}})[A-Za-z0-9_/+=-]++"
ADDRESS = rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
PHONE = r"(?<![0-9A-Za-z+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
SOCIAL = r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])"
#: A T and a time may follow a date.
DATE = (
    r"(?<![0-9A-Za-z.\/-])(?:(?:19|20)[0-9]{2}(?:-[01][0-9]-[0-3][0-9]|\/[01]?[0-9]\/[0-3]?[0-9])|(?:[0-3]?[0-9]\.[01]?[0-9]\.|[0-3]?[0-9]\/[0-3]?[0-9]\/|[0-3]?[0-9]-[0-3]?[0-9]-)(?:19|20)[0-9]{2})"
    r"(?![0-9A-SU-Za-su-z\/-]|[Tt](?![0-9]{2}))"
)
FORMS = {"mail": MAIL, "secret": SECRET, "address": ADDRESS, "card": CARD, "phone": PHONE, "social": SOCIAL, "date": DATE}
#: Its only group is the secret: that may look like any other form.
PATTERN = "|".join(f"({p})" if name == "secret" else p for name, p in FORMS.items())
#: Years of dates from 1900 to 2099; social security numbers have areas 1 to 899 but 666, groups 1 to 99 and serials 1 to 9999.
YEARS, AREAS, GROUPS, SERIALS = 200, 898, 99, 9999
ROUNDS = 10
#: Steps within which a permuted day of the 13th to the 31st of a month is one that the month has; each is with odds of 0.9.
WALK = 64


def _feistel(a: str, b: str, u: str, v: str, salt: str, key: str) -> str:
    """SQL for the struct (a, b) after a keyed permutation of 0 .. u-1 by 0 .. v-1: each round
    adds a keyed digest of one part to the other, modulo that one's size."""
    digest = lambda i, x: f"cast(conv(substring(sha2(concat_ws('|', '{key}', {salt}, {i}, {x}), 256), 1, 15), 16, 10) as bigint)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, i) -> "
        f"if(i % 2 = 1, named_struct('a', (s.a + {digest('i', 's.b')}) % cast({u} as bigint), 'b', s.b), named_struct('a', s.a, 'b', (s.b + {digest('i', 's.a')}) % cast({v} as bigint))))"
    )


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(d: str, salt: str, key: str) -> str:
    """SQL for the pseudonym of a string of 2 to 19 digits, as long as it."""
    left, right = f"cast(length({d}) div 2 as int)", f"cast(length({d}) - length({d}) div 2 as int)"
    size = lambda n: f"cast(rpad('1', {n} + 1, '0') as bigint)"
    out = _feistel(f"substring({d}, 1, {left})", f"substring({d}, {left} + 1)", size(left), size(right), f"concat({salt}, length({d}))", key)
    return _let("f", out, f"concat(lpad(cast(f.a as string), {left}, '0'), lpad(cast(f.b as string), {right}, '0'))")


def _luhn(d: str, first: int) -> str:
    """SQL for Luhn's sum of the digits; doubled are those at even places from the right, counted from ``first``."""
    return f"aggregate(sequence(1, length({d})), cast(0 as bigint), (t, p) -> t + {_let('y', f'cast(substring({d}, length({d}) + 1 - p, 1) as int) * if((p + {first}) % 2 = 0, 2, 1)', 'y div 10 + y % 10')})"


def _refilled(m: str, d: str) -> str:
    """SQL for the string ``m`` with its digits replaced by those of ``d``."""
    return f"array_join(transform(sequence(1, length({m})), p -> if(substring({m}, p, 1) rlike '[0-9]', substring({d}, length(regexp_replace(substring({m}, 1, p), '[^0-9]', '')), 1), substring({m}, p, 1))), '')"


def _date(m: str, key: str) -> str:
    """SQL for the pseudonym of a date written year first, d.M.yyyy, M/d/yyyy or d-M-yyyy, null if it isn't one.

    With a slash the month comes first, with a dash the day, unless only the other order is a date. So that the
    pseudonym is read in the same order and is as wide, months up to the 9th and later ones keep apart, and so do days up
    to the 9th, the 12th and the 31st. Within years, such months and such days, ranks are permuted.
    """
    part = lambda i: f"element_at(split({m}, '[-./]'), {i})"
    sign = f"regexp_extract({m}, '[-./]', 0)"
    day = lambda y, mo, d: f"try_to_date(concat_ws('-', {part(y)}, lpad({part(mo)}, 2, '0'), lpad({part(d)}, 2, '0')), 'yyyy-MM-dd')"
    order = f"if(length({part(1)}) = 4, 'ymd', if({sign} = '.', 'dmy', if({sign} = '/', if({day(3, 1, 2)} is null, 'dmy', 'mdy'), if({day(3, 2, 1)} is null, 'mdy', 'dmy'))))"
    found = f"case o when 'ymd' then {day(1, 2, 3)} when 'dmy' then {day(3, 2, 1)} else {day(3, 1, 2)} end"
    kind = "named_struct('m0', if(month(n) <= 9, 1, 10), 'm', if(month(n) <= 9, 9, 3), 'd0', if(day(n) <= 9, 1, if(day(n) <= 12, 10, 13)), 'd', if(day(n) <= 9, 9, if(day(n) <= 12, 3, 19)))"
    step = lambda a, b: _feistel(a, b, str(YEARS), "k.m * k.d", "concat('date', k.m, k.d)", key)
    # On from rank to rank until the month has the day: that is again one to one.
    there = "k.d0 + w.b % k.d <= day(last_day(make_date(cast(1900 + w.a as int), cast(k.m0 + w.b div k.d as int), 1)))"
    moved = f"aggregate(sequence(1, {WALK}), {step('year(n) - 1900', '(month(n) - k.m0) * k.d + day(n) - k.d0')}, (w, j) -> if({there}, w, {step('w.a', 'w.b')}))"
    wide = lambda x, value: f"lpad(cast({value} as string), length(element_at(split({m}, '[-./]'), {x})), '0')"
    shown = f"concat_ws({sign}, transform(sequence(1, 3), x -> case substring(o, x, 1) when 'y' then cast(1900 + v.a as string) when 'm' then {wide('x', 'k.m0 + v.b div k.d')} else {wide('x', 'k.d0 + v.b % k.d')} end))"
    return _let("o", order, _let("n", found, f"if(n is null, null, {_let('k', kind, _let('v', moved, shown))})"))


def _social(m: str, key: str) -> str:
    """SQL for the pseudonym of a valid social security number, another valid one."""
    n = lambda at, size: f"cast(substring({m}, {at}, {size}) as bigint)"
    moved = _feistel(f"{n(1, 3)} - if({n(1, 3)} > 666, 2, 1)", f"({n(5, 2)} - 1) * {SERIALS} + {n(8, 4)} - 1", str(AREAS), str(GROUPS * SERIALS), "'social'", key)
    shown = f"concat_ws('-', lpad(cast(f.a + if(f.a + 1 >= 666, 2, 1) as string), 3, '0'), lpad(cast(f.b div {SERIALS} + 1 as string), 2, '0'), lpad(cast(f.b % {SERIALS} + 1 as string), 4, '0'))"
    return _let("f", moved, shown)


def _pseudonym(m: str, key: str, secret_found: str) -> str:
    """SQL for what replaces the found string ``m``: itself if it isn't valid. ``secret_found`` tells whether it matched as a secret."""
    d = f"regexp_replace({m}, '[^0-9]', '')"
    hexed = f"substring(sha2(concat('{key}|secret|', {m}), 512), 1, least(128, length({m})))"
    secret = f"rpad(if({m} = upper({m}), upper({hexed}), {hexed}), length({m}), '0')"
    mail = f"concat('user-', substring(sha2(concat('{key}|mail|', lower({m})), 256), 1, 16), '@example.invalid')"
    octet = lambda i: f"cast(element_at(split({m}, '[.]'), {i}) as int)"
    moved = _feistel(f"{octet(1)} * 256 + {octet(2)}", f"{octet(3)} * 256 + {octet(4)}", "65536", "65536", "'address'", key)
    address = _let("f", moved, "concat_ws('.', cast(f.a div 256 as string), cast(f.a % 256 as string), cast(f.b div 256 as string), cast(f.b % 256 as string))")
    body = _digits("substring(d, 1, length(d) - 1)", "'card'", key)
    card = _let("d", d, f"if({_luhn('d', 0)} % 10 <> 0, {m}, {_let('e', _let('c', body, 'concat(c, cast((10 - ' + _luhn('c', 1) + ' % 10) % 10 as string))'), _refilled(m, 'e'))})")
    number = lambda salt: _let("d", d, _let("e", f"concat(substring(d, 1, length(d) - least(10, length(d))), {_digits('substring(d, 1 + length(d) - least(10, length(d)))', salt, key)})", _refilled(m, "e")))
    # Secrets are known by their group; the other forms tell themselves apart by their signs.
    return (
        f"case when {secret_found} then {secret} when instr({m}, '@') > 0 then {mail} "
        f"when {m} rlike '^{_sql(OCTET)}([.]{_sql(OCTET)}){{3}}$' then {address} "
        f"when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then {_social(m, key)} "
        f"when {m} rlike '^([0-9]{{4}}[/-][0-9]{{1,2}}[/-][0-9]{{1,2}}|[0-9]{{1,2}}([./-])[0-9]{{1,2}}[./-][0-9]{{4}})$' then coalesce({_date(m, key)}, {m}) "
        f"when {m} rlike '^[+(]' or {m} rlike '^[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}$' then {number(chr(39) + 'phone' + chr(39))} "
        f"when {m} rlike '^[0-9]([0-9 -]){{11,21}}[0-9]$' and length({d}) between 13 and 19 then {card} "
        f"else {m} end"
    )


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def apply(df: DataFrame, key: str, text: str = "text", out: str | None = None, count: str | None = "n_pii") -> DataFrame:
    """``df`` with ``text`` (or a new column ``out``) pseudonymised and, unless None, ``count``:
    how many values were replaced. Null texts stay null (0 replaced), empty ones empty.

    Replaced are mail addresses, values behind words such as token or password
    (16 characters or more), IPv4 addresses, card numbers that pass Luhn's check,
    telephone and social security numbers, and calendar dates of 1900 to 2099
    (yyyy-MM-dd, yyyy/MM/dd, d.M.yyyy, M/d/yyyy and d/M/yyyy, d-M-yyyy and M-d-yyyy).
    Values of one kind stay linked over all documents, however they are spaced; who holds the ``key`` can invert them, so
    it comes from the caller and has no default. A narrow map: no shuffle, no Python; repeated rows change alike. Columns
    named as ``count`` or a new ``out``, or with names that begin with __pii, are an error.
    """
    clashing(df, *([count] if count else []), *([out] if out and out != text else []), prefix="__pii")
    if not key or not key.isalnum():
        raise ValueError("the key must be letters and digits")
    out = out or text
    t = f"`{text}`"
    replaced = f"zip_with(__pii_found, __pii_secret, (m, s) -> {_pseudonym('m', key, 's')})"
    # Only texts with a digit, an @ or a secret's word can hold a candidate.
    some = df.withColumn("__pii_found", F.when(F.col(text).rlike(f"[0-9@]|{WORDS}"), F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))))
    secrets = F.transform(F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(1)), lambda x: x != "")
    none = F.transform("__pii_found", lambda _: F.lit(False))
    some = some.withColumn("__pii_secret", F.when((F.size("__pii_found") > 0) & F.col(text).rlike(WORDS), secrets).when(F.size("__pii_found") > 0, none))
    some = some.withColumn("__pii_new", F.when(F.size("__pii_found") > 0, F.expr(replaced)))
    joined = "array_join(flatten(zip_with(__pii_between, __pii_new, (x, y) -> array(x, coalesce(y, '')))), '')"
    some = some.withColumn("__pii_between", F.when(F.col("__pii_new").isNotNull(), F.split(F.col(text), PATTERN, -1)))
    some = some.withColumn(out, F.when(F.col("__pii_new").isNotNull(), F.expr(joined)).otherwise(F.expr(t)))
    if count:
        some = some.withColumn(count, F.coalesce(F.expr("size(filter(zip_with(__pii_found, __pii_new, (x, y) -> x <> y), z -> z))"), F.lit(0)))
    return some.drop("__pii_found", "__pii_secret", "__pii_new", "__pii_between")
