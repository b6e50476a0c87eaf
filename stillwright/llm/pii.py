"""Format-preserving Feistel pseudonyms, in DataFrame functions only.

Numbers and dates that validate (check digits, octets, calendar) are permuted within their own
format by a keyed Feistel network, so equal values stay equal and different ones different across
all documents, without a table of values. What is no number (the local part of a mail address, a
long hexadecimal secret) becomes a keyed digest. What does not validate stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwright.llm.common import bound

ROUNDS = 10
#: Days that dates are permuted among: FIRST_DAY and the MOD_A * MOD_B - 1 days after it (to 2099-11-13), and
#: blocks of as many days before and after these, each for itself, as far as all their years have four digits.
FIRST_DAY, MOD_A, MOD_B = "1900-01-01", 250, 292
FIRST_BLOCK, LAST_BLOCK = -9, 39
#: Hexadecimal digits of the digest that a mail address becomes.
MAIL_DIGITS = 24
#: What each kind looks like. Java regular expressions, none of which backtracks beyond a value.
MAIL = r"[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}+"
ADDRESS = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![.]?\d)"
DATE = r"\d{4}-\d{2}-\d{2}(?!\d)|\d{2}[/.]\d{2}[/.]\d{4}(?!\d)"
LOCAL = r"(?:\(\d{3}\)[ -]?\d{3}-\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![.-]?\d)"
PHONE = r"\+1[ -]?\(\d{3}\)[ -]?\d{3}-\d{4}(?!\d)|\+1[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)"
SOCIAL = r"\d{3}-\d{2}-\d{4}(?![-\d])"
CARD = r"\d(?:[ -]?\d){12,18}(?!\d)"
#: Groups of digits that one or more cards and short numbers beside them can make up; what has a shape of its own ends them.
GROUPS = rf"(?=\d(?:[ -]?\d){{12}})\d++(?:[ -](?!{ADDRESS}|{DATE}|{SOCIAL}|{LOCAL})\d++)*+"
#: How cards are usually written: lengths of their groups, the likeliest first; unbroken ones have 13 to 19 digits.
SHAPES = ("4-4-4-4", "4-6-5", "4-4-4-4-3", "4-6-4", "4-4-5", "6-13")
SECRET = r"(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
ANY = rf"(?<![\p{{L}}\p{{N}}._%+-])(?:{MAIL})|(?<![\d.])(?:{ADDRESS}|{DATE}|{SOCIAL})|{PHONE}|(?<!\d)(?:1[ .-]?)?(?=\(){LOCAL}|(?<![\p{{L}}\p{{N}}+._-])(?:1[ .-])?{LOCAL}|(?<![\d.]){GROUPS}|(?<![0-9A-Za-z]){SECRET}"


def _prf(key: str, tweak: Column, *parts: Column) -> Column:
    """A keyed pseudorandom number below 2**60."""
    text = F.concat_ws("|", F.lit(key), tweak, *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, mod_a: Column, mod_b: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the pairs a < mod_a, b < mod_b, as struct(a, b)."""

    def turn(acc: Column, i: Column) -> Column:
        mod = F.when(i % 2 == 0, mod_a).otherwise(mod_b)
        return F.struct(acc["b"].alias("a"), F.pmod(acc["a"] + _prf(key, tweak, i, acc["b"]) % mod, mod).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 18 digits as another one of the same length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    tweak = F.concat(F.lit(kind + "/"), n.cast("string"))
    new = feistel(F.substr(digits, F.lit(1), u).cast("long"), F.substr(digits, u + 1, n - u).cast("long"), power(u), power(n - u), key, tweak)
    return bound(new, lambda x: F.concat(F.lpad(x["a"].cast("string"), u, F.lit("0")), F.lpad(x["b"].cast("string"), n - u, F.lit("0"))))


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn rule, the last digit not doubled."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return acc + F.when((n - i) % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def refilled(value: Column, digits: Column) -> Column:
    """value with its digits replaced, in order, by those given; all else stays in place."""

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(acc["s"], F.when(is_digit, F.substr(digits, acc["k"], F.lit(1))).otherwise(c)).alias("s"), (acc["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), step)["s"]


def _card(value: Column, key: str) -> Column:
    def new(digits: Column) -> Column:
        body = permuted_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
        return bound(body, lambda b: F.concat(b, F.pmod(-_luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))

    return bound(_only_digits(value), lambda d: F.when(_valid_card(d), refilled(value, new(d))).otherwise(value))


def _valid_card(digits: Column) -> Column:
    return (_luhn(digits) % 10 == 0) & (F.regexp_replace(digits, "0", "") != "")


def _cards(value: Column, key: str) -> Column:
    """Groups of digits with all cards among them replaced: first those that validate in a usual shape,
    so that a short number beside a card is no part of it, then the longest runs of what is left. Each new
    card stands between < and >, which no kind of value has."""

    def length(groups: Column, i: Column) -> Column:
        """Groups that a card from group i on has, as a letter; A for none."""
        sizes = F.concat(F.array_join(F.transform(F.slice(groups, i + 1, 5), lambda g: F.length(g).cast("string")), "-"), F.lit("-"))
        digits = lambda n: F.array_join(F.slice(groups, i + 1, n), "")
        one = F.get(groups, i)
        used = F.when(F.length(one).between(13, 19) & _valid_card(one), "B")
        for shape in SHAPES:
            n = shape.count("-") + 1
            used = used.when(sizes.startswith(shape + "-") & _valid_card(digits(n)), "ABCDEF"[n])
        return used.otherwise("A")

    def marked(groups: Column) -> Column:
        # a letter before each group, then one pass from the left that takes a card's groups together: in time by length
        separators = F.regexp_extract_all(value, F.lit("[ -]"), F.lit(0))
        lettered = bound(separators, lambda s: F.array_join(F.transform(groups, lambda g, i: F.concat(length(groups, i), g, F.coalesce(F.get(s, i), F.lit("")))), ""))
        cards = "|".join(rf"{c}\d++" + rf"(?:[ -][A-F]\d++){{{n}}}" * (n > 0) for n, c in enumerate("BCDEF"))
        return F.regexp_replace(F.regexp_replace(lettered, f"({cards})", "<$1>"), "[A-F]", "")

    def renamed(text: Column) -> Column:
        each = rf"<[^>]*>|(?<!\d){CARD}"
        new = F.transform(F.regexp_extract_all(text, F.lit(each), F.lit(0)), lambda v: bound(F.regexp_replace(v, "[<>]", ""), lambda old: bound(_card(old, key), lambda new: F.when(old == new, old).otherwise(F.concat(F.lit("<"), new, F.lit(">"))))))
        return F.array_join(F.zip_with(F.split(text, each, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return bound(bound(F.split(value, "[ -]"), marked), renamed)


def _plain(value: Column, key: str, kind: str, skip: int = 0) -> Column:
    """All digits but the first `skip` permuted."""
    return bound(_only_digits(value), lambda d: refilled(value, F.concat(F.substr(d, F.lit(1), F.lit(skip)), permuted_digits(F.substr(d, F.lit(skip + 1), F.length(d) - skip), key, kind))))


def _social(value: Column, key: str) -> Column:
    """Areas 1 to 899 but 666, groups from 1, serials from 1: permuted among the numbers that can be issued."""
    part = lambda a, n: F.substr(value, F.lit(a), F.lit(n)).cast("int")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    place = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1

    def new(x: Column) -> Column:
        i = F.floor(x["a"] / 99).cast("int")
        return F.format_string("%03d-%02d-%04d", i + F.when(i >= 665, 2).otherwise(1), (x["a"] % 99 + 1).cast("int"), (x["b"] + 1).cast("int"))

    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, bound(feistel(place, serial - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("social")), new)).otherwise(value)


def _address(value: Column, key: str) -> Column:
    def new(o: Column) -> Column:
        x = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
        return bound(x, lambda y: F.concat_ws(".", *[z.cast("string") for z in ((y["a"] / 256).cast("int"), (y["a"] % 256).cast("int"), (y["b"] / 256).cast("int"), (y["b"] % 256).cast("int"))]))

    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    return bound(octets, lambda o: F.when(F.forall(o, lambda x: x < 256), new(o)).otherwise(value))


def _date(value: Column, key: str) -> Column:
    """yyyy-mm-dd; mm/dd/yyyy, or dd/mm/yyyy where only that exists; dd.mm.yyyy."""
    part = lambda a, n: F.substr(value, F.lit(a), F.lit(n))
    iso = lambda y, m, d: F.concat_ws("-", y, m, d)
    sep = F.substr(value, F.lit(3), F.lit(1))
    first, second = iso(part(7, 4), part(1, 2), part(4, 2)), iso(part(7, 4), part(4, 2), part(1, 2))
    is_iso, month_first = value.contains("-"), (sep == "/") & first.try_cast("date").isNotNull()
    day = F.when(is_iso, value.try_cast("date")).when(month_first, first.try_cast("date")).otherwise(second.try_cast("date"))

    def new(k: Column) -> Column:
        block = F.floor(k / (MOD_A * MOD_B)).cast("int")
        tweak = F.when(block == 0, "date").otherwise(F.concat(F.lit("date/"), block.cast("string")))
        inside = k - block * (MOD_A * MOD_B)
        moved = feistel(F.floor(inside / MOD_B), inside % MOD_B, F.lit(MOD_A), F.lit(MOD_B), key, tweak)
        date = bound(moved, lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), (block * (MOD_A * MOD_B) + x["a"] * MOD_B + x["b"]).cast("int")))
        date = bound(date, lambda x: F.when(is_iso, F.date_format(x, "yyyy-MM-dd")).when(sep == ".", F.date_format(x, "dd.MM.yyyy")).when(month_first, F.date_format(x, "MM/dd/yyyy")).otherwise(F.date_format(x, "dd/MM/yyyy")))
        return F.when(block.between(FIRST_BLOCK, LAST_BLOCK), date).otherwise(value)

    return F.when(day.isNotNull(), bound(F.datediff(day, F.lit(FIRST_DAY).cast("date")), new)).otherwise(value)


def _mail(value: Column, key: str) -> Column:
    digest = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(value)).cast("binary"), 256), 1, MAIL_DIGITS)
    return F.concat(F.lit("u"), digest, F.regexp_extract(value, "@.*$", 0))


def _secret(value: Column, key: str) -> Column:
    """A keyed digest of as many hexadecimal digits, in the same case."""
    lower = F.lower(value)
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("hex"), lower).cast("binary"), 256)
    new = F.substr(digest, F.lit(1), F.length(value))
    return F.when(value == lower, new).otherwise(F.upper(new))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a value that ANY has found; cards in it stand between < and >."""
    full = lambda p: value.rlike(rf"^(?:{p})$")
    return (
        F.when(value.contains("@"), _mail(value, key))
        .when(full(ADDRESS), _address(value, key))
        .when(full(DATE), _date(value, key))
        .when(value.startswith("+") | full(rf"1[ .-]?{LOCAL}"), _plain(value, key, "phone", 1))
        .when(full(LOCAL), _plain(value, key, "phone"))
        .when(full(SOCIAL), _social(value, key))
        .when(full(GROUPS), _cards(value, key))
        .otherwise(_secret(value, key))
    )


def pseudonymised(text: Column, key: str) -> tuple[Column, Column]:
    """The text with pseudonyms, and how many values changed."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    named = F.transform(found, lambda v: F.struct(v.alias("old"), pseudonym(v, key).alias("new")))

    def woven(pairs: Column) -> Column:
        parts = F.zip_with(F.split(text, ANY, -1), F.transform(pairs, lambda p: F.regexp_replace(p["new"], "[<>]", "")), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        changed = F.aggregate(pairs, F.lit(0), lambda n, p: n + F.when(p["old"] != p["new"], F.greatest(F.size(F.split(p["new"], "<")) - 1, F.lit(1))).otherwise(0))
        return F.struct(F.array_join(parts, "").alias("text"), changed.alias("n"))

    # texts without a digit or an at sign hold none of the kinds and are not searched
    out = F.when(text.rlike("[0-9@]"), bound(named, woven)).otherwise(F.struct(text.alias("text"), F.lit(0).alias("n")))
    return out["text"], out["n"]


def pseudonymise(docs: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_replaced and the columns to keep of every row: one map, no shuffle and no Python.

    Null text is empty; texts of any length are one pass of a regular expression. Equal values get equal
    pseudonyms in whatever document, different ones different (mail addresses and secrets by digests of 96
    bits and more); repeated rows stay equal. A value that its permutation maps to itself stays and is not
    counted. Dates before 0101-03-13 and after 9894-09-08 stay as they are. Ids, null ones too, pass through. An
    empty table gives an empty result. Other columns are not read. The key is a literal of the plan, so
    plans and event logs show it: pass one that is derived for this corpus.
    """
    text, n = pseudonymised(F.col("text"), key)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *[docs[c] for c in keep])
    return rows.select("doc_id", F.struct(text.alias("text"), n.alias("n")).alias("r"), *keep).select("doc_id", "r.text", F.col("r.n").cast("long").alias("n_replaced"), *keep)
