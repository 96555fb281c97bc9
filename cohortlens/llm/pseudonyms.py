"""Format-preserving Feistel pseudonyms for private values in texts.

Values are found by pattern and validated (card numbers by their check digit, social security
numbers and addresses by their ranges, dates by the calendar). Each is replaced by a keyed
permutation of its own format: a Feistel network whose round function is SHA-256 under the
key, the kind, the round and the other half. So a pseudonym is a valid value of the same
form, equal values get equal pseudonyms in all documents (they stay linked), different values
get different ones, and the holder of the key can invert it.

=========  ===================================================  =============================
kind       found                                                permuted
=========  ===================================================  =============================
email      name@host.tld                                        letters and digits of the name
secret     40 or 32 hex digits, password=hex, AKIA + 16         the digits or characters
date       yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, mm/dd/yyyy       days of a 400-year cycle
ip         four octets up to 255                                32 bits
ssn        ddd-dd-dddd in the issued ranges                     the issued ranges
phone      ten digits with (area) or hyphens, country code      the ten digits
card       13 to 19 digits, together or in groups, valid        all but the check digit,
                                                                which is computed again
=========  ===================================================  =============================

Everything is a SQL expression on the row: nothing is shuffled, texts without a digit or an @
are passed on untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import columns

ROUNDS = 8
DEFAULT_KEY = "set a secret key of your own"
# Kind and pattern, tried in this order at every place.
KINDS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}"),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{40}|[0-9a-f]{32}|AKIA[A-Z0-9]{16}|password=[0-9a-f]{8,})(?![A-Za-z0-9])"),
    ("date", r"(?<![0-9.,/-])(?:[12][0-9]{3}-[0-9]{2}-[0-9]{2}|[12][0-9]{3}/[0-9]{2}/[0-9]{2}|"
             r"[0-9]{2}[.][0-9]{2}[.][12][0-9]{3}|[0-9]{2}/[0-9]{2}/[12][0-9]{3})(?![0-9/-]|[.,][0-9])"),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}[.]){3}[0-9]{1,3}(?![0-9]|[.][0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![0-9+])(?:[+][0-9]{1,3}[ .-]?)?(?:[(][0-9]{3}[)] ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|-[0-9])"),
    ("card", r"(?<![0-9.,-])(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})"
             r"(?![0-9-]|[.,][0-9])"),
)
ANY = "|".join(f"(?:{p})" for _, p in KINDS)
DAYS = 146097  # of a 400-year cycle: 189 x 773


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(a: str, b: str, size_a: str, size_b: str, tweak: str, key: str) -> str:
    """SQL: the pair (a, b), a < size_a and b < size_b, keyed-permuted; a struct<a, b>."""
    def add(half: str, other: str, size: str) -> str:
        word = f"concat_ws('|', {_quote(key)}, {tweak}, r, acc.{other})"
        return f"pmod(acc.{half} + pmod(cast(conv(substr(sha2({word}, 256), 1, 15), 16, 10) as bigint), {size}), {size})"
    return f"""aggregate(sequence(0, {ROUNDS - 1}),
      named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)),
      (acc, r) -> if(r % 2 = 0, named_struct('a', {add('a', 'b', size_a)}, 'b', acc.b),
                                named_struct('a', acc.a, 'b', {add('b', 'a', size_b)})))"""


def _digits(s: str, radix: int, tweak: str, key: str) -> str:
    """SQL: the string of radix-``radix`` digits ``s`` permuted among those of its length, in blocks
    of up to ``2 * half`` digits (a block's position is part of its tweak)."""
    half = 9 if radix == 10 else 10
    block = f"substr({s}, k * {2 * half} + 1, {2 * half})"
    left, right = "substr(p, 1, length(p) div 2)", "substr(p, length(p) div 2 + 1)"
    number = lambda x: f"cast(conv(concat('0', {x}), {radix}, 10) as bigint)"
    size = lambda x: f"cast(round(power({radix}BD, length({x}))) as bigint)"
    text = lambda v, n: f"lpad(lower(conv({v}, 10, {radix})), {n}, '0')"
    pair = _feistel(number(left), number(right), size(left), size(right),
                    f"concat({tweak}, k, '/', length(p))", key)
    return f"""array_join(transform(sequence(0, (length({s}) - 1) div {2 * half}), k -> element_at(transform(
      array({block}), p -> element_at(transform(array({pair}),
        x -> concat(if(length(p) > 1, {text('x.a', 'length(p) div 2')}, ''),
                    {text('x.b', 'length(p) - length(p) div 2')})), 1)), 1)), '')"""


def _refill(shape: str, chars: str, kind: str) -> str:
    """SQL: ``shape`` with its characters of the class replaced, in order, by those of ``chars``."""
    return (f"array_join(zip_with(split({shape}, '{kind}', -1), split(concat({chars}, ' '), ''), "
            f"(piece, c) -> concat(piece, if(c = ' ', '', c))), '')")


def _luhn(s: str) -> str:
    """SQL: the check sum (modulo 10) of a digit string whose last digit counts once."""
    return f"""pmod(aggregate(sequence(1, length({s})), 0, (t, i) -> t + element_at(
      transform(array(cast(substr({s}, -i, 1) as int) * (2 - i % 2)), d -> d - if(d > 9, 9, 0)), 1)), 10)"""


def _date(v: str) -> str:
    """SQL: a date string of any accepted form as a date, null if there is no such day."""
    return f"""try_cast(case
      when {v} rlike '^[0-9]{{4}}' then concat_ws('-', substr({v}, 1, 4), substr({v}, 6, 2), substr({v}, 9, 2))
      when contains({v}, '.') then concat_ws('-', substr({v}, 7, 4), substr({v}, 4, 2), substr({v}, 1, 2))
      else concat_ws('-', substr({v}, 7, 4), substr({v}, 1, 2), substr({v}, 4, 2)) end as date)"""


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def pseudonym_sql(v: str, kind: str, key: str) -> str:
    """SQL for the pseudonym of a value string of a kind; null if it is not valid."""
    if kind == "email":
        name = f"lower(substring_index({v}, '@', 1))"
        plain = f"regexp_replace({name}, '[^a-z0-9]', '')"
        made = _let(_digits(plain, 36, "'email'", key), "c", _refill(f"regexp_replace({name}, '[a-z0-9]', '#')", "c", "#"))
        return f"concat({made}, substr({v}, instr({v}, '@')))"
    if kind == "secret":
        head = f"if({v} like 'AKIA%', 'AKIA', if({v} like 'password=%', 'password=', ''))"
        rest = f"substr({v}, length({head}) + 1)"
        return (f"concat({head}, if({v} like 'AKIA%', upper({_digits(f'lower({rest})', 36, repr('key'), key)}), "
                f"{_digits(rest, 16, repr('hex'), key)}))")
    if kind == "date":
        index = "datediff(d, date'1800-01-01')"
        pair = _feistel(f"pmod({index}, {DAYS}) div 773", f"pmod({index}, {DAYS}) % 773", "189", "773", "'date'", key)
        new = f"date_add(date'1800-01-01', cast({index} - pmod({index}, {DAYS}) + x.a * 773 + x.b as int))"
        said = f"""case when {v} rlike '^[0-9]{{4}}-' then date_format(n, 'yyyy-MM-dd')
                        when {v} rlike '^[0-9]{{4}}/' then date_format(n, 'yyyy/MM/dd')
                        when contains({v}, '.') then date_format(n, 'dd.MM.yyyy')
                        else date_format(n, 'MM/dd/yyyy') end"""
        return _let(_date(v), "d", f"if(d is null, cast(null as string), {_let(pair, 'x', _let(new, 'n', said))})")
    if kind == "ip":
        octets = f"transform(split({v}, '[.]'), o -> cast(o as int))"
        pair = _feistel("o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536", "'ip'", key)
        said = "concat_ws('.', x.a div 256, x.a % 256, x.b div 256, x.b % 256)"
        return _let(octets, "o", f"if(array_max(o) > 255, cast(null as string), {_let(pair, 'x', said)})")
    if kind == "ssn":
        area, group, serial = (f"cast(substr({v}, {i}, {n}) as int)" for i, n in ((1, 3), (5, 2), (8, 4)))
        index = f"({area} - if({area} > 666, 2, 1))"
        pair = _feistel(index, f"({group} - 1) * 9999 + {serial} - 1", "898", "989901", "'ssn'", key)
        said = ("concat_ws('-', lpad(x.a + if(x.a >= 665, 2, 1), 3, '0'), lpad(x.b div 9999 + 1, 2, '0'), "
                "lpad(x.b % 9999 + 1, 4, '0'))")
        valid = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
        return f"if({valid}, {_let(pair, 'x', said)}, cast(null as string))"
    if kind == "phone":
        tail = f"regexp_extract({v}, '[(]?[0-9]{{3}}[)]?[ .-]?[0-9]{{3}}[ .-][0-9]{{4}}$', 0)"
        digits = f"regexp_replace({tail}, '[^0-9]', '')"
        made = _let(_digits(digits, 10, "'phone'", key), "c", _refill(f"regexp_replace({tail}, '[0-9]', '#')", "c", "#"))
        return f"concat(substr({v}, 1, length({v}) - length({tail})), {made})"
    digits = f"regexp_replace({v}, '[^0-9]', '')"
    payload = _digits("substr(g, 1, length(g) - 1)", 10, "'card'", key)
    whole = f"concat(c, pmod(10 - {_luhn('concat(c, 0)')}, 10))"
    said = _let(payload, "c", _let(whole, "w", _refill(f"regexp_replace({v}, '[0-9]', '#')", "w", "#")))
    return _let(digits, "g", f"if({_luhn('g')} = 0, {said}, cast(null as string))")


def replace_private(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """One row per input row: ``doc_id, text, n_values, kinds``.

    ``text`` has every valid private value replaced by its pseudonym; ``n_values`` counts the
    replaced places and ``kinds`` lists their kinds, distinct and sorted. Null stays null and
    empty stays empty, with no values; values that fail validation stay as they are; repeated
    rows are replaced alike; an empty table gives an empty result; extra columns are ignored.
    """
    found = f"regexp_extract_all(text, {_quote(ANY)}, 0)"
    between = f"split(text, {_quote(ANY)}, -1)"
    kind = "case " + " ".join(f"when v rlike {_quote('^(?:' + p + ')$')} then '{k}'" for k, p in KINDS) + " end"
    new = "case kind " + " ".join(f"when '{k}' then {pseudonym_sql('v', k, key)}" for k, _ in KINDS) + " end"
    rows = columns(docs, doc_id="long", text="string").withColumn("values", F.expr(
        f"case when text rlike '[0-9@]' then {found} else cast(array() as array<string>) end"))
    rows = rows.withColumn("made", F.expr(
        f"transform(values, v -> {_let(kind, 'kind', f'named_struct({chr(39)}kind{chr(39)}, kind, {chr(39)}new{chr(39)}, {new})')})"))
    text = F.expr(f"""case when coalesce(size(values), 0) = 0 then text else array_join(zip_with(
        {between}, zip_with(values, made, (v, m) -> coalesce(m.new, v)), (piece, m) -> concat(piece, coalesce(m, ''))), '') end""")
    done = F.expr("filter(coalesce(made, array()), m -> m.new is not null)")
    return rows.withColumn("done", done).select(
        "doc_id", text.alias("text"), F.size("done").cast("long").alias("n_values"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("done", lambda m: m["kind"]))), ",").alias("kinds"))
