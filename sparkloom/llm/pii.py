"""Format-preserving Feistel pseudonyms for personal data (operator 10), native.

Found and validated in the text:

card   13 to 19 digits, or card groups with blanks or hyphens, that pass the Luhn check
ssn    ddd-dd-dddd outside the ranges that are never issued
date   yyyy-mm-dd, yyyy/mm/dd or dd.mm.yyyy, a day of 1900 to 2099
phone  +1 and ten digits in the usual layouts
ip     four octets of 0 to 255
mail   an address with a dotted domain (its local part is replaced)

What fails its check stays as it is, and so does an address whose local part has
no ASCII letter or digit.  Every value is permuted by an alternating Feistel
network keyed with ``key`` and its kind.  Cards and phones are permuted as their
digits alone and put back into the layout that was found, so one number has the
same pseudonym digits in all documents and layouts; the check digit is made
anew.  Dates stay days of the same range in their layout.  In local parts digits
stay digits, letters letters and separators in place, and the case of the letters is that of
the original, so an address is linked whatever its case.  Octets lose leading
zeros.  Different values of a format never share a pseudonym, and
``depseudonymize`` undoes them with the same key.  Digits and local parts use
rounds of character shifts between the halves of the value; dates, IPs and ssns
use two mixed-radix halves whose product is exactly the number of valid values,
so no cycle walking is needed.

Only DataFrame and SQL functions are used; the work is a narrow projection, and
texts without a digit or @ are passed through.  A null text stays null with
counts 0, an empty one empty.  Rows are judged each by itself, so repeated
rows, null ids and ties need no care; an empty table gives an empty result;
other columns are kept and may have any name.  Texts of any length are searched
whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: The patterns by kind, in order of preference where several could start.
KINDS = {
    "mail": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "date": r"(?<!\d)(?:\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d\.\d\d\.\d{4})(?!\d)",
    "phone": r"(?<!\d)\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5}|\d{13,19})(?!\d)",
}
PATTERN = "|".join(KINDS.values())
#: 1900-01-01 to 2099-12-31 has 17 * 4297 days.
FIRST_DAY, DATE_RADIX = "DATE'1900-01-01'", (17, 4297)


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with name standing for value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _shift(x: str, k: str, sign: str) -> str:
    """SQL: every digit and lower-case letter of x moved within its class by the bytes of the hex string k."""
    by = f"cast(conv(substr({k}, (j - 1) * 2 % 62 + 1, 2), 16, 10) as int)"
    c = f"substr({x}, j, 1)"
    moved = (
        f"CASE WHEN {c} BETWEEN '0' AND '9' THEN chr(48 + pmod(ascii({c}) - 48 {sign} {by}, 10)) "
        f"WHEN {c} BETWEEN 'a' AND 'z' THEN chr(97 + pmod(ascii({c}) - 97 {sign} {by}, 26)) ELSE {c} END"
    )
    return f"IF(length({x}) = 0, '', array_join(transform(sequence(1, length({x})), j -> {moved}), ''))"


def _rounds(back: bool) -> tuple[str, str]:
    return (f"sequence({ROUNDS}, 1, -1)", "-") if back else (f"sequence(1, {ROUNDS})", "+")


def _feistel_text(v: str, kind: str, key: str, back: bool) -> str:
    """SQL: the string v permuted, characters within their classes."""
    rounds, sign = _rounds(back)
    name = lambda half: f"sha2(concat({_quoted(key + '|' + kind + '|')}, r, '|', {half}), 256)"
    left = f"struct({_let(name('s.b'), 'k', _shift('s.a', 'k', sign))} AS a, s.b AS b)"
    right = f"struct(s.a AS a, {_let(name('s.a'), 'k', _shift('s.b', 'k', sign))} AS b)"
    start = f"struct(substr({v}, 1, cast(length({v}) div 2 as int)) AS a, substr({v}, cast(length({v}) div 2 as int) + 1) AS b)"
    return f"aggregate({rounds}, {start}, (s, r) -> IF(r % 2 = 1, {left}, {right}), s -> concat(s.a, s.b))"


def _feistel_pair(a: str, b: str, radix: tuple[int, int], kind: str, key: str, back: bool, finish: str) -> str:
    """SQL: the pair (a, b) of numbers below radix permuted; ``finish`` makes the result from s.a and s.b."""
    rounds, sign = _rounds(back)
    number = lambda half: f"cast(conv(substr(sha2(concat({_quoted(key + '|' + kind + '|')}, r, '|', {half}), 256), 1, 12), 16, 10) as bigint)"
    start = f"struct(cast({a} as bigint) AS a, cast({b} as bigint) AS b)"
    left = f"struct(pmod(s.a {sign} {number('s.b')}, {radix[0]}) AS a, s.b AS b)"
    right = f"struct(s.a AS a, pmod(s.b {sign} {number('s.a')}, {radix[1]}) AS b)"
    return f"aggregate({rounds}, {start}, (s, r) -> IF(r % 2 = 1, {left}, {right}), s -> {finish})"


def _laid_out(m: str, p: str) -> str:
    """SQL: m with its digits replaced by those of p in order."""
    nth = f"length(regexp_replace(substr({m}, 1, j), '[^0-9]', ''))"
    return f"array_join(transform(sequence(1, length({m})), j -> IF(substr({m}, j, 1) BETWEEN '0' AND '9', substr({p}, {nth}, 1), substr({m}, j, 1))), '')"


def _cased(m: str, p: str) -> str:
    """SQL: the letters of p in the case of those of m."""
    c = f"substr({m}, j, 1)"
    return f"array_join(transform(sequence(1, length({m})), j -> CASE WHEN {c} BETWEEN 'A' AND 'Z' THEN upper(substr({p}, j, 1)) ELSE substr({p}, j, 1) END), '')"


def _luhn(d: str, offset: int) -> str:
    """SQL: the Luhn sum of the digits d; offset 1 for a payload whose check digit is missing."""
    digit = f"cast(substr({d}, length({d}) - i, 1) as int)"
    return (
        f"aggregate(sequence(0, length({d}) - 1), 0, (t, i) -> t + IF((i + {offset}) % 2 = 1, "
        f"{digit} * 2 - IF({digit} > 4, 9, 0), {digit}))"
    )


def _pseudonym(m: str, key: str, back: bool) -> str:
    """SQL: struct(kind, value) for the match m; kind is null where it fails its check."""

    def is_(kind: str) -> str:
        return f"regexp_like({m}, {_quoted('^(?:' + KINDS[kind] + ')$')})"

    def found(kind: str, value: str) -> str:
        return f"struct('{kind}' AS kind, {value} AS value)"

    digits = f"regexp_replace({m}, '[^0-9]', '')"
    card = _let(
        f"left({digits}, length({digits}) - 1)",
        "d0",
        _let(_feistel_text("d0", "card", key, back), "p0", _let(f"concat(p0, (10 - {_luhn('p0', 1)} % 10) % 10)", "p", _laid_out(m, "p"))),
    )
    # A-Z alone is lower-cased: other letters have no case here.
    low = f"translate(substring_index({m}, '@', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    local = _let(low, "v", _let(_feistel_text("v", "mail", key, back), "p", _cased(m.join(["substring_index(", ", '@', 1)"]), "p")))
    mail = f"concat({local}, substr({m}, instr({m}, '@')))"
    phone = f"concat('+1', {_let(f'regexp_replace(substr({m}, 3), {chr(39)}[^0-9]{chr(39)}, {chr(39)}{chr(39)})', 'd', _let(_feistel_text('d', 'phone', key, back), 'p', _laid_out(f'substr({m}, 3)', 'p')))})"
    part = lambda i: f"cast(split({m}, '\\\\.')[{i}] as int)"
    ip = _feistel_pair(
        f"{part(0)} * 256 + {part(1)}", f"{part(2)} * 256 + {part(3)}", (65536, 65536), "ip", key, back,
        "concat_ws('.', s.a div 256, s.a % 256, s.b div 256, s.b % 256)",
    )
    ssn = _feistel_pair(
        f"cast(substr({m}, 5, 2) as int) - 1", f"cast(substr({m}, 8, 4) as int) - 1", (99, 9999), "ssn", key, back,
        f"concat(substr({m}, 1, 4), lpad(s.a + 1, 2, '0'), '-', lpad(s.b + 1, 4, '0'))",
    )
    iso = (
        f"CASE WHEN substr({m}, 3, 1) = '.' THEN concat(substr({m}, 7, 4), '-', substr({m}, 4, 2), '-', substr({m}, 1, 2)) "
        f"ELSE replace({m}, '/', '-') END"
    )
    layout = f"CASE WHEN substr({m}, 3, 1) = '.' THEN 'dd.MM.yyyy' WHEN instr({m}, '/') > 0 THEN 'yyyy/MM/dd' ELSE 'yyyy-MM-dd' END"
    date = _let(
        f"datediff(try_cast({iso} as date), {FIRST_DAY})",
        "n",
        _feistel_pair(f"n div {DATE_RADIX[1]}", f"n % {DATE_RADIX[1]}", DATE_RADIX, "date", key, back,
                      f"date_format(date_add({FIRST_DAY}, cast(s.a * {DATE_RADIX[1]} + s.b as int)), {layout})"),
    )
    return (
        f"CASE WHEN {is_('mail')} THEN IF(regexp_like(substring_index({m}, '@', 1), '[A-Za-z0-9]'), {found('mail', mail)}, NULL) "
        f"WHEN {is_('ip')} THEN IF(greatest({part(0)}, {part(1)}, {part(2)}, {part(3)}) < 256, {found('ip', ip)}, NULL) "
        f"WHEN {is_('date')} THEN IF(year(try_cast({iso} as date)) BETWEEN 1900 AND 2099, {found('date', date)}, NULL) "
        f"WHEN {is_('phone')} THEN {found('phone', phone)} "
        f"WHEN {is_('ssn')} THEN IF(substr({m}, 1, 3) NOT IN ('000', '666') AND substr({m}, 1, 1) < '9' "
        f"AND substr({m}, 5, 2) > '00' AND substr({m}, 8, 4) > '0000', {found('ssn', ssn)}, NULL) "
        f"WHEN {is_('card')} THEN {_let(digits, 'd', f'IF({_luhn(chr(100), 0)} % 10 = 0, {found(chr(99) + chr(97) + chr(114) + chr(100), card)}, NULL)')} END"
    )


def _replaced(docs: DataFrame, key: str, text: str, out: str, counts: str, back: bool) -> DataFrame:
    pattern = _quoted(PATTERN)
    # The rows go through as one column, so that no name of theirs can clash.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"), docs[text].cast("string").alias("t"))
    found = F.expr(f"CASE WHEN regexp_like(t, '[0-9@]') THEN transform(regexp_extract_all(t, {pattern}, 0), m -> {_pseudonym('m', key, back)}) END")
    rows = rows.select("d", "t", F.explode(F.array(F.struct(found.alias("found")))).alias("s"))
    raw = f"regexp_extract_all(t, {pattern}, 0)"
    gaps = f"split(t, {pattern}, -1)"
    joined = (
        f"concat(array_join(zip_with(slice({gaps}, 1, size({gaps}) - 1), zip_with({raw}, s.found, (a, x) -> coalesce(x.value, a)), "
        f"(g, v) -> concat(g, v)), ''), element_at({gaps}, -1))"
    )
    new: Column = F.expr(f"CASE WHEN exists(s.found, x -> x.kind IS NOT NULL) THEN {joined} ELSE t END")
    kinds = F.expr(f"map_from_arrays(array({', '.join(_quoted(k) for k in KINDS)}), array({', '.join(f'size(filter(coalesce(s.found, array()), x -> x.kind = {_quoted(k)}))' for k in KINDS)}))")
    kept = [F.col("d")[c].alias(c) for c in docs.columns if c not in (out, counts)]
    return rows.select(*kept, new.alias(out), kinds.alias(counts))


def pseudonymize(docs: DataFrame, key: str, text: str = "text", out: str = "text", counts: str = "n_pii") -> DataFrame:
    """``docs`` with personal data of column ``text`` replaced in ``out`` and a map kind -> number in ``counts``."""
    return _replaced(docs, key, text, out, counts, False)


def depseudonymize(docs: DataFrame, key: str, text: str = "text", out: str = "text", counts: str = "n_pii") -> DataFrame:
    """``docs`` with the pseudonyms of ``pseudonymize`` under the same key turned back."""
    return _replaced(docs, key, text, out, counts, True)


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pseudonymize(docs, key="demo-key")
    return out.select("doc_id", "text", *[F.col("n_pii")[k].cast("long").alias(f"n_{k}") for k in KINDS])


QUERIES = {"op10_pii_pseudonyms": op10_pii_pseudonyms}
ORACLES: dict[str, str] = {}
