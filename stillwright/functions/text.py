"""Text expressions: markup, names, titles, templates."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vietnamese letters by the letter they fold to, composed forms.
FOLDS = {
    "a": "àáảãạăằắẳẵặâầấẩẫậäåā", "e": "èéẻẽẹêềếểễệëē", "i": "ìíỉĩịïîī", "o": "òóỏõọôồốổỗộơờớởỡợöōø", "u": "ùúủũụưừứửữựüûū",
    "y": "ỳýỷỹỵÿ", "d": "đ", "c": "ç", "n": "ñ",
}


def trimmed(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def without_markup(x: Column) -> Column:
    return F.regexp_replace(x, r"<[^>]*>|\{[^}]*\}", "")


def lines(x: Column) -> Column:
    """Lines at any of the line ends that text files use."""
    return F.split(F.regexp_replace(x, "\r\n", "\n"), "[\n\r\u000b\u000c\u0085  ]")


def unaccented(x: Column) -> Column:
    lower = "".join(FOLDS.values())
    plain = "".join(k * len(v) for k, v in FOLDS.items())
    pairs = [(a, b) for a, b in zip(lower + lower.upper(), plain + plain.upper(), strict=True) if a != "ø" and a != "Ø"]
    folded = F.translate(x, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return F.regexp_replace(folded, r"\p{Mn}", "")


def folded_name(x: Column) -> Column:
    """Accents dropped, each word's first letter raised and the rest kept, letters and digits only, joined."""
    words = F.transform(F.split(unaccented(x), r"[^\p{L}\p{N}]+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.array_join(words, "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]*)$", 1))


def unescaped(x: Column) -> Column:
    """The character references that page titles use; the ampersand last."""
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(ref), F.lit(char))
    return x


def page_title(html: Column) -> Column:
    """The text of <title>, unescaped and trimmed; null without one."""
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(trimmed(unescaped(found)), F.lit(""))


def without_suffix(name: Column, tail: str) -> Column:
    return F.when(name.endswith(tail), F.substr(name, F.lit(1), F.length(name) - len(tail))).otherwise(name)


def shared_id(link: Column) -> Column:
    """The id of a shared link: /file/d/<id> or ?id=<id>."""
    a, b = F.regexp_extract(link, r"/file/d/([A-Za-z0-9_-]+)", 1), F.regexp_extract(link, r"[?&]id=([A-Za-z0-9_-]+)", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


#: What begins an entry of a list, what counts stand behind it, and which lines are no titles.
ENTRY, COUNT = r"^\s*(?:\d+[.)]|[-*•👉])\s*", r"\s*[(\[]\s*\d+\s*[)\]]\s*$"
NOISE = r"(?iu)^\s*(?:\[[^\]]*\]\s*$|```|#{1,6}\s|(?:CHỌN|Vì sao|Rủi ro|Á quân)\s*:)"


def clean_title(line: Column) -> Column:
    """Without numbering, bullets and a trailing count in parentheses or brackets."""
    return trimmed(F.regexp_replace(F.regexp_replace(line, ENTRY, ""), COUNT, ""))


def is_noise(line: Column) -> Column:
    """Whether a line is a bracket, heading, code fence or verdict."""
    return line.rlike(NOISE)


def composed(x: Column) -> Column:
    """Letters and their accents as one character where there is one (NFC)."""

    @F.pandas_udf("string")
    def nfc(x: pd.Series) -> pd.Series:
        return x.map(lambda s: s if s.isascii() else unicodedata.normalize("NFC", s), na_action="ignore")

    return nfc(x)


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))


def length_class(x: Column) -> Column:
    n = F.length(x)
    return F.when(n > 100, "too_long").when(n > 70, "cut").when(n > 60, "long").otherwise("ok")


def preview(x: Column, most: int = 50) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)


def filled(template: Column, values: list[tuple[str, Column]]) -> Column:
    """Placeholders replaced one after the other: a later one inside an inserted text is replaced as well."""
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), kv[1]), values, template)


def role_file_name(name: Column) -> Column:
    """struct(role, number, label) of '<role>_<number>[_<label>].<ext>'; null role if the parts don't fit."""
    parts = F.split(stem(name), "_", 3)
    number = F.get(parts, F.lit(1)).try_cast("int")
    fits = number.isNotNull() & ((F.size(parts) == 3) | (F.get(parts, F.lit(0)) == "group"))
    return F.struct(F.when(fits, parts[0]).alias("role"), F.when(fits, number).alias("number"), F.when(fits, F.get(parts, F.lit(2))).alias("label"))


#: Shape of a title, characters and words, and of its first clause; turns, consequences, and a phrase that is banned.
TITLE_CHARS, TITLE_WORDS, CLAUSE_CHARS = (91, 100), (21, 25), (30, 45)
TURN, CONSEQUENCE, BANNED = r"(?iu)^[^,]*,\s*(?:Nào Ngờ|Ai Ngờ|Không Ngờ)", r"(?iu)Khiến", r"(?iu)Và Cái Kết"


def title_faults(x: Column) -> Column:
    """What a title lacks of its shape: length, words, commas, clause, turn, consequence, banned."""
    clause = F.length(trimmed(F.split(x, ",")[0]))
    checks = {
        "length": F.length(x).between(*TITLE_CHARS), "words": word_count(x).between(*TITLE_WORDS), "commas": F.regexp_count(x, F.lit(",")) == 1, "clause": clause.between(*CLAUSE_CHARS),
        "turn": x.rlike(TURN), "consequence": x.rlike(CONSEQUENCE), "banned": ~x.rlike(BANNED),
    }
    return F.array_compact(F.array(*[F.when(~ok, name) for name, ok in checks.items()]))


#: How reference images are listed, by the role that their file name begins with.
LISTED = {"chinh": " — NHÂN VẬT CHÍNH ", "phu": " — nhân vật phụ ", "vat": " — con vật / vật thể trung tâm "}
NAMED, FOREMOST = ", tên trong phim: ", "  **<- cả phim xoay quanh người này, bắt buộc có trong khung**"
KEEP, TOGETHER = ". Giữ đúng loài, màu, cỡ như trong ảnh", " — ảnh chung, chỉ để tham khảo cách họ đứng cạnh nhau và tỉ lệ to nhỏ giữa các nhân vật"


def listed_image(file: Column) -> Column:
    """The line of a list of reference images for a file <role>_<number>_<name>_..., null for other names; a
    name is said only where there is one, and the first main role is marked."""
    base = F.regexp_extract(file, r"([^/\\]*)$", 1)
    parts = F.split(base, "_")
    role, number, name = (F.get(parts, F.lit(i)) for i in range(3))
    begin = F.concat(F.lit("- `"), base, F.lit("`"))
    line = None
    for kind, what in LISTED.items():
        tail = F.lit(KEEP) if kind == "vat" else F.when((F.lit(kind) == "chinh") & (number == "1"), FOREMOST).otherwise("")
        told = F.when(name != "", F.concat(F.lit(": " if kind == "vat" else NAMED), name)).otherwise("")
        text = F.concat(begin, F.lit(what), number, told, tail)
        fits = (role == kind) & (F.size(parts) >= 3)
        line = F.when(fits, text) if line is None else line.when(fits, text)
    return F.when(base.startswith("canh_chung_"), F.concat(begin, F.lit(TOGETHER))).otherwise(line)


def is_folder_link(link: Column) -> Column:
    return link.contains("/folders/") | link.contains("folderview")


def first_available(preferred: list[str], available: Column) -> Column:
    """The first of a list of preferences that is in an array; null if none is."""
    return F.get(F.filter(F.array(*[F.lit(x) for x in preferred]), lambda x: F.array_contains(available, x)), F.lit(0))
