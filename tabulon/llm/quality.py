"""Line-first quality rules, in DataFrame functions only.

Each line is judged by its own punctuation, by marks of navigation and by phrases of boilerplate; failing lines go. A document is
rejected if too much of its text went with them, or if the base rules (too few words, too many repeated word windows) hold.
All of it is a projection: no shuffle, no Python. Word windows are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
MAX_LOST_PERCENT = 50
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
ENDINGS = "[.!?:;…\"'”’»)\\]][\\x20\\x09-\\x0D]*$"
NAVIGATION = "(?:[|›»•·>][^|›»•·>]*){3}"
#: Phrases of notices in four languages, in lower case.
BOILERPLATE = (
    "accept cookies",
    "use cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "all rights reserved",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "skip to content",
    "back to top",
    "read more",
    "share this",
    "log in",
    "sign in",
    "tous droits réservés",
    "politique de confidentialité",
    "mentions légales",
    "accepter les cookies",
    "lire la suite",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "cookies akzeptieren",
    "nach oben",
    "todos los derechos reservados",
    "política de privacidad",
    "aviso legal",
    "aceptar cookies",
    "leer más",
)


def _bind(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def _without_blanks(text: Column) -> Column:
    for c in " \n\t\r\x0b\x0c":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def word_chars(text: Column) -> Column:
    return F.char_length(_without_blanks(text)).cast("long")


def count_symbols(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.octet_length(_without_blanks(x)) > 0)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows that come twice or more in the array."""

    def covered(hashes: Column) -> Column:
        def of(pairs: Column) -> Column:
            again = F.filter(pairs, lambda e, k: F.coalesce(e["h"] == F.get(pairs, k - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(pairs, k + 1)["h"], F.lit(False)))
            places = F.sort_array(F.transform(again, lambda e: e["k"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
            return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"].cast("long"))

        pairs = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_bind(pairs, of))

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda k: F.xxhash64(*(F.get(w, k + j) for j in range(window))))
        return F.when(F.size(w) < window, F.lit(0).cast("long")).otherwise(_bind(hashes, covered))

    return _bind(words, windows)


def line_fails(line: Column) -> Column:
    """No closing punctuation, three separators of navigation, symbols or exclamation marks at many words, or a phrase of boilerplate."""
    n = F.size(words_of(line))

    def phrase(low: Column) -> Column:
        out = F.contains(low, F.lit(BOILERPLATE[0]))
        for p in BOILERPLATE[1:]:
            out = out | F.contains(low, F.lit(p))
        return out

    many = _bind(n, lambda k: (5 * count_symbols(line) > k) | (2 * F.char_length(F.regexp_replace(line, "[^!]+", "")) > k))
    return ~F.rlike(line, F.lit(ENDINGS)) | F.rlike(line, F.lit(NAVIGATION)) | _bind(F.lower(line), phrase) | many


def clean_lines(df: DataFrame, text_col: str = "text", max_lost_percent: int = MAX_LOST_PERCENT, with_text: bool = True) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, kept and (with_text) clean_text.

    lost_chars counts the word characters of failing lines; kept is false for base_failed, or where over max_lost_percent of the
    document's word characters are lost. clean_text is the text without failing lines (lines without words stay).
    Null, empty or blank text: all counts 0, base_failed, not kept; clean_text is empty. Rows that repeat, null ids and extra columns pass
    through; a new column whose name is taken gets underscores in front. An empty table gives an empty one.
    """
    cols = df.columns
    t = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    names = {}
    for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept", "clean_text"):
        names[n] = fresh([*cols, *names.values()], n)
    # each line is judged once
    judged = F.transform(F.split(t, "\n", -1), lambda x: _bind(word_chars(x), lambda n: F.struct(x.alias("line"), n.alias("n"), ((n > 0) & line_fails(x)).alias("bad"))))

    def cleaned(lines: Column) -> Column:
        lost = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.when(x["bad"], x["n"]).otherwise(0)).alias("lost")
        return F.struct(lost, *([F.array_join(F.transform(F.filter(lines, lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("text")] if with_text else []))

    # the array of words is used twice, in one bound expression
    both = _bind(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    out = df.select(
        *(df[f"`{c}`"] for c in cols),
        both.alias(pair := fresh([*cols, *names.values()], "pair")),
        word_chars(t).alias(names["word_chars"]),
        count_symbols(t).alias(names["n_symbols"]),
        _bind(worded_lines(t), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias(names["n_dup_lines"]),
        _bind(judged, cleaned).alias(left := fresh([*cols, *names.values(), pair], "left")),
    )
    out = out.withColumns({names["lost_chars"]: quoted(left)["lost"], **({names["clean_text"]: quoted(left)["text"]} if with_text else {})})
    n, r = quoted(pair)["n"], quoted(pair)["r"]
    failed = (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)
    fine = 100 * quoted(names["lost_chars"]) <= max_lost_percent * quoted(names["word_chars"])
    last = [names[k] for k in ("word_chars", "n_symbols", "n_dup_lines", "lost_chars", *(["clean_text"] if with_text else []))]
    return out.select(*(out[f"`{c}`"] for c in cols), n.alias(names["n_words"]), r.alias(names["n_repeat_words"]), *map(quoted, last), failed.alias(names["base_failed"]), (~failed & fine).alias(names["kept"]))
