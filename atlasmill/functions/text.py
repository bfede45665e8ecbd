"""Text functions as Column expressions; Python only where Spark has no expression (full entities, NFC, residual LCS)."""

from __future__ import annotations

import html
import re
import unicodedata
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Turkish capitals and their small letters; small letters and their ASCII forms.
TR_UPPER, TR_LOWER = "İIŞĞÜÖÇ", "iışğüöç"
FOLD_FROM, FOLD_TO = "ışğüöçâîû", "isguocaiu"
# Whole English names and single terms with their Turkish forms, in order of replacement.
PROPER_NAMES = {
    "ephesus": "Efes", "pergamon": "Bergama", "pergamum": "Bergama", "smyrna": "İzmir (Smyrna)", "izmir": "İzmir",
    "kadifekale": "Kadifekale", "asclepion": "Asklepion", "celsus library": "Celsus Kütüphanesi",
    "house of the virgin mary": "Meryem Ana Evi", "temple of artemis": "Artemis Tapınağı",
    "agora of smyrna": "Smyrna Agorası", "konak square": "Konak Meydanı",
}
TERMS = {
    "ancient city": "Antik Kenti", "ancient theatre": "Antik Tiyatrosu", "ancient theater": "Antik Tiyatrosu",
    "archaeological site": "Arkeolojik Alanı", "archaeological museum": "Arkeoloji Müzesi", "museum": "Müzesi",
    "mosque": "Camii", "castle": "Kalesi", "fortress": "Kalesi", "tower": "Kulesi", "bath": "Hamamı", "baths": "Hamamı",
    "library": "Kütüphanesi", "fountain": "Çeşmesi", "aqueduct": "Su Kemeri", "church": "Kilisesi",
    "basilica": "Bazilikası", "synagogue": "Sinagogu", "ruins": "Ören Yeri", "agora": "Agorası",
    "necropolis": "Nekropolü", "theatre": "Tiyatrosu", "theater": "Tiyatrosu",
}


def squeeze(text: Column) -> Column:
    """Runs of white space to one blank, trimmed; an empty result is null."""
    return F.nullif(F.trim(F.regexp_replace(text, "(?U)\\s+", " ")), F.lit(""))


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    def one(x):
        return None if x is None else unicodedata.normalize("NFC", html.unescape(x))

    return text.map(one)


CLOSED = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(T.StringType())
def _unescape_closed(text: pd.Series) -> pd.Series:
    def letter(found):
        entity = found.group()
        return html.unescape(entity) if entity[1] == "#" else html5.get(entity[1:], entity)

    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", CLOSED.sub(letter, x)))


def normalize_text(text: Column, closed: bool = False) -> Column:
    """HTML entities resolved, NFC, white space squeezed. Only rows with '&' or non-ASCII text reach Python.

    closed resolves those entities only that end with a semicolon; without it '&amp' and '&copyright' are resolved as browsers do.
    """
    hard = text.rlike("[&]|[^\\x00-\\x7F]")
    unescape = _unescape_closed if closed else _unescape
    return squeeze(F.when(hard, unescape(F.when(hard, text))).otherwise(text))


def tr_casefold(text: Column) -> Column:
    """Lower case by Turkish rules: dotted and dotless i stay apart."""
    return F.lower(F.translate(text, TR_UPPER, TR_LOWER))


def ascii_fold(text: Column) -> Column:
    """Turkish lower case with its special letters as ASCII."""
    return F.translate(tr_casefold(text), FOLD_FROM[:6], FOLD_TO[:6])


def match_key(text: Column) -> Column:
    """Form in which names are compared: casefolded, punctuation as blanks, squeezed. The text must be unescaped already."""
    return F.coalesce(squeeze(F.regexp_replace(tr_casefold(text), "(?U)[^\\w\\s]", " ")), F.lit(""))


def normalize_for_match(text: Column, closed: bool = False) -> Column:
    return match_key(normalize_text(text, closed))


def _plain_letters() -> tuple[str, str]:
    """Small Latin letters with marks and the letters below the marks, by decomposition; then the combining marks, which go."""
    found = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFKD", chr(code)).lower()[:1]
        if base.isascii() and base.isalpha():
            found[chr(code).lower()] = base
    found = {k: v for k, v in found.items() if len(k) == 1}
    return "".join(found) + "".join(map(chr, range(0x300, 0x370))), "".join(found.values())


# Letters that are spelled with one Latin letter, and those that need several.
ONE_FROM = "ıøđłħŧαβγδεζηικλμνξοπρσςτυωάέήίόύώϊϋабвгдезийклмнопрстуфыэіґاأإآبتدرزسضفقكلمنهويىةپگ"
ONE_TO = "iodlhtabgdezeiklmnxoprsstuoaeeiouoiuabvgdeziiklmnoprstufyeigaaaabtdrzsdfqklmnhwyahpg"
SEVERAL = {
    "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "θ": "th", "φ": "ph", "χ": "kh", "ψ": "ps", "ж": "zh", "х": "kh", "ц": "ts",
    "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "ё": "io", "ї": "yi", "є": "ye", "ъ": "", "ь": "", "ث": "th", "ج": "j",
    "ح": "h", "خ": "kh", "ذ": "dh", "ش": "sh", "ص": "s", "ط": "t", "ظ": "z", "ع": "", "غ": "gh", "ء": "", "ئ": "y", "ؤ": "w", "چ": "ch", "ژ": "zh",
}
MARKED, UNMARKED = _plain_letters()


def transliterate(text: Column) -> Column:
    """Small letters of Latin with marks, Greek, Cyrillic and Arabic in ASCII; other characters stay. Rows that are ASCII already are passed by."""
    spelled = F.translate(F.translate(text, ONE_FROM, ONE_TO), MARKED, UNMARKED)
    for letter, latin in SEVERAL.items():
        spelled = F.replace(spelled, F.lit(letter), F.lit(latin))
    return F.when(text.rlike("[^\\x00-\\x7F]"), spelled).otherwise(text)


def slugify(text: Column, most: int = 154) -> Column:
    """ASCII letters and digits joined by single hyphens; letters of other scripts are spelled."""
    plain = transliterate(ascii_fold(text))
    return F.regexp_replace(F.left(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most)), "-+$", "")


def shorten(text: Column, most: int = 2000) -> Column:
    """At most `most` characters; longer texts end with three dots."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def clipped(text: Column, most: int) -> Column:
    """At most `most` characters; an empty text is null."""
    return F.nullif(F.left(text, F.lit(most)), F.lit(""))


def email_domain(email: Column) -> Column:
    """What follows the first '@', null without one."""
    return F.when(F.contains(email, F.lit("@")), F.regexp_extract(email, "(?s)^[^@]*@(.*)$", 1))


def client_key(user: Column, forwarded: Column, address: Column) -> Column:
    """Who sent a request: the user, else the first hop that a proxy names, else the peer's address."""
    hop = F.trim(F.substring_index(F.nullif(forwarded, F.lit("")), ",", 1))
    return F.coalesce(F.concat(F.lit("u:"), F.nullif(user, F.lit(""))), F.concat(F.lit("ip:"), F.coalesce(hop, address, F.lit("unknown"))))


def to_turkish(text: Column) -> Column:
    """Whole names by dictionary; else terms replaced one after another where the original holds them."""
    low = F.lower(F.trim(text))
    names = F.create_map(*[F.lit(x) for pair in PROPER_NAMES.items() for x in pair])
    out = text
    for term, turkish in TERMS.items():
        # A pattern that never matches where the original lacks the term: each step refers to the last one once.
        pattern = F.when(F.contains(low, F.lit(term)), F.lit(f"(?i){term}")).otherwise(F.lit("(?!)"))
        out = F.regexp_replace(out, pattern, F.lit(turkish))
    return F.when(text.isNull() | (low == ""), text).otherwise(F.coalesce(F.element_at(names, low), out))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    place: dict[str, int] = {}
    for i, ch in enumerate(a):
        place[ch] = place.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & place.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def token_ratio(a: str, b: str) -> float:
    """Similarity 0 to 100 of two normalised texts by their token sets.

    100 where one set holds the other. Otherwise the best of three comparisons between the common tokens and the
    common tokens followed by either rest; as the common part is a prefix of both, only the two rests need a
    longest common subsequence.
    """
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, ra, rb = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not ra or not rb):
        return 100.0
    # The blank between the common part and a rest belongs to the shared prefix.
    lead = len(both) + 1 if both else 0
    la, lb = lead + len(ra), lead + len(rb)
    best = 200.0 * (lead + _lcs(ra, rb)) / (la + lb)
    return max(best, 200.0 * len(both) / (len(both) + min(la, lb))) if both else best


@F.pandas_udf(T.DoubleType())
def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def tokens(text: Column) -> Column:
    """Sorted distinct tokens between blanks."""
    return F.array_sort(F.array_distinct(F.split(F.trim(text), " +")))


def token_set_ratio(a: Column, b: Column) -> Column:
    """token_ratio() of two columns; 0 where either has no token. Only pairs of which none holds the other go to Python."""
    x, y = tokens(a), tokens(b)
    inside = (F.size(F.array_intersect(x, y)) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))
    empty = F.coalesce(F.trim(a), F.lit("")).eqNullSafe("") | F.coalesce(F.trim(b), F.lit("")).eqNullSafe("")
    ask = ~inside & ~empty
    return F.when(empty, 0.0).when(inside, 100.0).otherwise(_ratios(F.when(ask, a), F.when(ask, b)))


def strip_fence(text: Column) -> Column:
    """The JSON inside a fenced code block, or the text itself."""
    return F.trim(F.regexp_replace(F.trim(text), "(?s)^```(?:json)?\\s*|\\s*```$", ""))


def register(spark) -> None:
    """Make the Python-backed helpers callable from SQL."""
    spark.udf.register("unescape_nfc", _unescape)
    spark.udf.register("token_ratio", _ratios)
