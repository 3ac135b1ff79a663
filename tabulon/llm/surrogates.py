"""Replacement of personal data by keyed surrogates, in DataFrame functions only.

Entities are found by patterns. Each gets a surrogate that depends on a secret key, its type and its normal form alone, so one
person or address is the same surrogate everywhere, and keeps its format: lengths, punctuation, digits, letter case, script, a
title's gender, a valid check digit. A name is two entities: the family name alone, which stays the same for all who bear it, and the
given names of a bearer, which differ from those of the family's others of that gender. Two entities never share a surrogate, and none is an entity of the
corpus: the distinct entities are aggregated, those that collide get a further round of the hash, and the few that needed one are joined back to their rows. A
format that has fewer values than the corpus has entities grows longer after ROUNDS rounds.

A bearer with a neutral title (Dr) who has another title elsewhere, of one gender only, is the same person. Full names without a title are replaced where the
same text has them with one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, quoted

EMAIL = r"[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.vV])(?<![Vv]ersion )(?<![Vv]er\. )(?:{OCTET}\.){{3}}{OCTET}(?![\d]|\.\d)"
TOKEN = r"(?<![0-9A-Za-z])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)[0-9a-f]{32,64}(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
CARD = r"(?<![\d])(?:\d[ \-]?){12,18}\d(?![\d])"
PHONE = r"(?<![\p{N}\p{L}])\+?\d{0,3}[ .\-]?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<![\p{N}\p{L}])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\p{N}\p{L}.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?!\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
#: Titles by gender and language.
MEN = ("Mr", "Herr", "Monsieur", "Sr", "Señor", "г-н", "господин", "κ", "κύριος")
WOMEN = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Sra", "Señora", "г-жа", "госпожа", "κα", "κυρία")
NEUTRAL = ("Dr", "Prof", "Professor")
NAME = r"(?<![\p{L}])(?:" + "|".join(sorted((*MEN, *WOMEN, *NEUTRAL), key=len, reverse=True)) + r")\.? (?:\p{Lu}[\p{Ll}\p{M}'’\-]+ ){0,2}\p{Lu}[\p{Ll}\p{M}'’\-]+(?:\p{Lu}\p{Ll}+)?"
KINDS = (("email", EMAIL), ("token", TOKEN), ("ip", IP), ("ssn", SSN), ("phone", PHONE), ("iban", IBAN), ("card", CARD), ("name", NAME))
ANY = "|".join(f"(?:{p})" for _, p in KINDS)
#: Given names by script and gender, and syllables of family names by script.
GIVEN = {
    ("latin", "m"): "Adrian Bruno Carl Daniel Emil Felix Gabriel Hugo Ivan Julian Leon Martin Nils Oscar Paul Robert Simon Thomas Victor Walter",
    ("latin", "f"): "Alice Bianca Clara Diana Elena Flora Greta Helena Irene Julia Laura Maria Nora Olivia Paula Rosa Sofia Teresa Vera Wilma",
    ("cyrillic", "m"): "Алексей Борис Виктор Григорий Дмитрий Егор Иван Кирилл Максим Николай",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Ксения Лариса Мария Ольга",
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Θωμάς Ιωάννης Κώστας Λουκάς Μιχάλης Νίκος Πέτρος",
    ("greek", "f"): "Άννα Βασιλική Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Σοφία",
}
SYLLABLES = {"latin": "ba co del fen gar hol jor kam lin mor nes pal quin rav sol tar ul ven wil zan", "cyrillic": "ба вол гор дан жар кол лен мир нов пет рам сер тим фед хар чер", "greek": "βα γορ δαν ζακ θεο καλ λαμ μιχ νικ παπ ρεν σαρ τασ φωτ χρυ"}
#: Country codes of telephone numbers; all others have three digits.
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
MAX_EXCEPTIONS = 50_000
ROUNDS = 16  # after them surrogates are longer than what they stand for
POOL_ROUNDS = 8  # after them a made-up middle name stands behind the given name, as the lists are short
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Letters by script, with the pattern of the script; letters of any other script are taken for Latin.
SCRIPTS = (
    (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"),
    (r"\p{IsArabic}", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    (r"\p{IsHan}", "".join(map(chr, range(0x4E00, 0x4E80)))),
    (r"\p{IsHiragana}", "".join(map(chr, range(0x3042, 0x3082, 2)))),
    (r"\p{IsKatakana}", "".join(map(chr, range(0x30A2, 0x30E2, 2)))),
    (r"\p{IsHangul}", "".join(map(chr, range(0xAC00, 0xAC00 + 28 * 60, 28)))),
    (r"\p{IsDevanagari}", "".join(map(chr, range(0x0915, 0x0930)))),
)


def _bind(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def kind_of(match: Column) -> Column:
    """The first type whose pattern is the whole of it."""
    out = F.when(F.rlike(match, F.lit(rf"^(?:{KINDS[0][1]})$")), KINDS[0][0])
    for kind, pattern in KINDS[1:]:
        out = out.when(F.rlike(match, F.lit(rf"^(?:{pattern})$")), kind)
    return out.otherwise("card")


def _hex(key: str, kind: str, value: Column, salt: Column) -> Column:
    return F.concat(*(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), F.lit(str(part)), salt.cast("string"), value), 256) for part in range(2)))


def _number(hexes: Column, at: Column | int, width: int = 2) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(hexes, at, F.lit(width)), 16, 10).cast("int")


def _shape(text: Column, hexes: Column, hexadecimal: bool = False) -> Column:
    """Each digit for a digit, each letter for one of its script and case, any other character as it is."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def pick(letters: str, n: Column) -> Column:
        return F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))

    def one(c: Column, k: Column) -> Column:
        n = _number(hexes, (k * 2) % 126 + 1)
        if hexadecimal:
            return F.when(F.rlike(c, F.lit("[0-9]")), (n % 10).cast("string")).when(F.rlike(c, F.lit("[a-f]")), pick("abcdef", n)).otherwise(c)
        letter = F.when(F.rlike(c, F.lit("[a-zA-Z]")), pick(LETTERS, n))
        for script, letters in SCRIPTS:
            letter = letter.when(F.rlike(c, F.lit(script)), pick(letters, n))
        letter = letter.otherwise(pick(LETTERS, n))
        return F.when(F.rlike(c, F.lit("[0-9]")), (n % 10).cast("string")).when(F.rlike(c, F.lit(r"\p{Lu}")), F.upper(letter)).when(F.rlike(c, F.lit(r"\p{L}")), letter).otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _mod97(text: Column) -> Column:
    """The number that digits and Latin letters (A is 10) write, modulo 97."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    value = F.transform(chars, lambda c: F.conv(F.lower(c), 36, 10).cast("int"))
    return F.aggregate(value, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)


def _spaced(match: Column, plain: Column, kept: str) -> Column:
    """The characters of plain, one for each of match that the class kept has; all other characters of match stay in place."""
    chars = F.filter(F.split(match, ""), lambda c: c != "")
    at = F.transform(chars, lambda c, i: F.char_length(F.regexp_replace(F.substring(match, F.lit(1), i + 1), f"[^{kept}]", "")))
    return F.array_join(F.zip_with(chars, at, lambda c, k: F.when(F.rlike(c, F.lit(f"[{kept}]")), F.substring(plain, k, F.lit(1))).otherwise(c)), "")


def _iban(match: Column, key: str, salt: Column) -> Column:
    """The country stays; the check digits are right if they were."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    country = F.substring(plain, 1, 2)

    def made(h: Column) -> Column:
        def checked(rest: Column) -> Column:
            # the country's letters and two zeros behind the account
            right = F.lpad((98 - _mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0")
            valid = _mod97(F.concat(F.substring(plain, F.lit(5), F.lit(60)), F.substring(plain, 1, 4))) == 1
            return F.concat(country, F.when(valid, right).otherwise(_shape(F.substring(plain, 3, 2), h)), rest)

        return _bind(_shape(F.substring(plain, F.lit(5), F.lit(60)), F.substring(h, F.lit(5), F.lit(124))), checked)

    return _bind(_bind(_hex(key, "iban", plain, salt), made), lambda new: _spaced(match, new, "0-9A-Z"))


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""
    turned = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(turned, lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))), F.lit(0), lambda a, x: a + x) % 10


def script_of(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.rlike(text, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")


TITLE = r"^(\S+ )"


def gender_of(match: Column) -> Column:
    bare = F.regexp_replace(F.regexp_extract(match, TITLE, 1), r"[. ]", "")
    return F.when(bare.isin(*MEN), "m").when(bare.isin(*WOMEN), "f").otherwise("n")


def _name(match: Column, key: str, salt: Column, given_salt: Column, known: Column | None = None) -> Column:
    """Title as it is, given names of its gender (known: of one whose title doesn't tell) and script, and a family name that depends on the family name alone."""
    title = F.regexp_extract(match, TITLE, 1)
    rest = F.split(F.substring(match, F.char_length(title) + 1, F.lit(1000)), " ")
    gender = gender_of(match) if known is None else F.coalesce(known, gender_of(match))
    script = script_of(match)
    names = F.create_map(*(x for (sc, g), told in GIVEN.items() for x in (F.lit(f"{sc} {g}"), F.array(*map(F.lit, told.split())))))
    syllables = F.create_map(*(x for sc, told in SYLLABLES.items() for x in (F.lit(sc), F.array(*map(F.lit, told.split())))))

    def given(word: Column) -> Column:
        def of(h: Column) -> Column:
            own = F.when(gender == "n", F.when(_number(h, 1) % 2 == 0, "m").otherwise("f")).otherwise(gender)
            return _bind(F.element_at(names, F.concat_ws(" ", script, own)), lambda n: F.get(n, _number(h, 3, 6) % F.size(n)))

        return _bind(_hex(key, "given", word, given_salt), of)

    def made_up(kind: str, word: Column, salt: Column) -> Column:
        def of(h: Column) -> Column:
            return _bind(F.element_at(syllables, script), lambda y: F.initcap(F.concat(*(F.get(y, _number(h, k * 4 + 1, 4) % F.size(y)) for k in range(5)))))

        return _bind(_hex(key, kind, word, salt), of)

    last = F.element_at(rest, -1)
    firsts = F.slice(rest, 1, F.size(rest) - 1)
    middle = F.when(given_salt >= POOL_ROUNDS, F.array(made_up("middle", F.array_join(firsts, " "), given_salt))).otherwise(F.array().cast("array<string>"))
    family = F.concat(made_up("family", last, salt), F.when(salt >= ROUNDS, F.lower(made_up("longer", last, salt))).otherwise(""))
    return F.concat(title, F.array_join(F.concat(F.transform(firsts, given), middle, F.array(family)), " "))


def entity_of(match: Column, kind: Column) -> Column:
    """The normal form: what stays the same when an entity is written otherwise. Of a name, the family name; of its given names, the gender and all words."""
    digits = F.regexp_replace(match, r"[^0-9]", "")
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "iban", F.replace(match, F.lit(" "), F.lit("")))
        .when(kind == "name", F.element_at(F.split(match, " "), -1))
        .when(kind == "given", F.concat_ws(" ", gender_of(match), F.regexp_replace(match, TITLE, "")))
        .when(kind.isin("email", "token"), F.lower(match))
        .otherwise(match)
    )


def parts_of(match: Column, kind: Column) -> Column:
    """The entities (kind, entity) of a match: two of a name with given names, else one."""
    given = F.when((kind == "name") & (F.size(F.split(match, " ")) > 2), F.struct(F.lit("given").alias("kind"), entity_of(match, F.lit("given")).alias("entity")))
    return F.filter(F.array(F.struct(kind.alias("kind"), entity_of(match, kind).alias("entity")), given), lambda x: x.isNotNull())


def surrogate(match: Column, kind: Column, key: str, salt: Column) -> Column:
    """The replacement of one match; salt is the round of the hash, 0 but after collisions."""

    def digits_by_entity(k: str, hexadecimal: bool = False) -> Column:
        # separators stay in place; the digits come from the digits alone
        plain = F.regexp_replace(match, r"[^0-9]", "")
        new = _bind(_hex(key, k, plain, salt), lambda h: _shape(plain, h))
        if k == "card":
            body = F.substring(new, F.lit(1), F.char_length(plain) - 1)
            check = ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string")
            new = F.when(_luhn(plain) == 0, F.concat(body, check)).otherwise(new)
        elif k == "phone":
            country = F.regexp_extract(match, COUNTRY, 1)
            new = F.concat(country, F.substring(new, F.char_length(country) + 1, F.lit(30)))
        return _bind(new, lambda d: _spaced(match, d, "0-9"))

    local = F.lower(F.substring_index(match, "@", 1))
    domain = F.lower(F.substring_index(match, "@", -1))
    host = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1)
    # digits behind, once the format's own values are used up
    more = F.when(salt >= ROUNDS, F.concat(F.lit("-"), F.lpad(_bind(_hex(key, "longer", match, salt), lambda h: F.conv(F.substring(h, F.lit(1), F.lit(9)), 16, 10)), 11, "0"))).otherwise("")
    email = F.concat(_bind(_hex(key, "local", F.lower(match), salt), lambda h: _shape(local, h)), more, F.lit("@"), _bind(_hex(key, "domain", domain, F.lit(0)), lambda h: _shape(host, h)), F.lit("."), F.substring_index(domain, ".", -1))
    octets = _bind(_hex(key, "ip", match, salt), lambda h: F.concat_ws(".", F.lit("10"), *((_number(h, 3 * k + 1, 3) % 256).cast("string") for k in range(3))))
    return (
        F.when(kind == "email", email)
        .when(kind == "token", _bind(_hex(key, "token", F.lower(match), salt), lambda h: _shape(match, h, True)))
        .when(kind == "ip", F.concat(octets, more))
        .when(kind.isin("name", "given"), _name(match, key, F.when(kind == "name", salt).otherwise(0), F.when(kind == "given", salt).otherwise(0)))
        .when(kind == "iban", _iban(match, key, salt))
        .when(kind == "phone", F.concat(digits_by_entity("phone"), more))
        .when(kind == "ssn", F.concat(digits_by_entity("ssn"), more))
        .otherwise(F.concat(digits_by_entity("card"), more))
    )


def entities(df: DataFrame, text_col: str) -> DataFrame:
    """Distinct (kind, entity, sample): sample is one way in which the corpus writes it."""
    found = df.select(F.explode(F.regexp_extract_all(F.coalesce(quoted(text_col).cast("string"), F.lit("")), F.lit(ANY), 0)).alias("match")).groupBy("match").agg(F.count("*").alias("n"))
    found = found.withColumn("kind", kind_of(F.col("match")))
    found = found.select(F.inline(parts_of(F.col("match"), F.col("kind"))), "match", "n")
    return found.groupBy("kind", "entity").agg(F.min("match").alias("sample"), F.sum("n").alias("n"))


def resolve(found: DataFrame, key: str, rounds: int = ROUNDS + 8) -> DataFrame:
    """(kind, entity, salt, gender) of the entities whose surrogate of round 0 is another one's, or is itself an entity: the first round that is free; and of bearers
    with a neutral title who have one other gender elsewhere: that gender, with its round. ValueError if longer surrogates collide too, which random hashes don't."""
    every = cut(found.select("kind", "entity", "sample"))
    given = every.filter("kind = 'given'").select("entity", F.substring("entity", 1, 1).alias("g"), F.expr("substring(entity, 3)").alias("words"))
    sides = given.filter("g <> 'n'").groupBy("words").agg(F.min("g").alias("gender"), F.count("*").alias("sides")).filter("sides = 1")
    same = cut(given.filter("g = 'n'").join(sides, "words").select(F.lit("given").alias("kind"), "entity", "gender", "words"))
    all_ = cut(every.join(same, ["kind", "entity"], "left_anti"))

    def made(rows: DataFrame, salt: Column) -> DataFrame:
        s = _bind(surrogate(F.col("sample"), F.col("kind"), key, salt), lambda x: entity_of(x, F.col("kind")))
        return rows.withColumn("salt", salt).withColumn("made", s)

    real = every.select("kind", F.col("entity").alias("made"))
    done = cut(made(all_, F.lit(0)))
    for salt in range(1, rounds + 1):
        # of those with the same surrogate the smallest entity keeps it, unless it is a real one
        low = done.groupBy("kind", "made").agg(F.count("*").alias("c"), F.min(F.struct("salt", "entity")).alias("first")).filter("c > 1")
        twice = done.join(low, ["kind", "made"]).filter(F.struct("salt", "entity") != F.col("first")).select("kind", "entity")
        taken = done.join(real, ["kind", "made"], "left_semi").select("kind", "entity")
        again = cut(twice.unionByName(taken).distinct())
        if not again.count():
            salted = done.filter("salt > 0").select("kind", "entity", "salt", F.lit(None).cast("string").alias("gender"))
            partner = same.withColumn("partner", F.concat_ws(" ", "gender", "words")).join(done.filter("kind = 'given'").select(F.col("entity").alias("partner"), "salt"), "partner")
            return salted.unionByName(partner.select("kind", "entity", "salt", "gender"))
        new = made(all_.join(again, ["kind", "entity"], "left_semi"), F.lit(salt))
        done = cut(done.join(again, ["kind", "entity"], "left_anti").unionByName(new))
    raise ValueError("surrogates still collide")


def replace_personal_data(df: DataFrame, key: str, text_col: str = "text", id_col: str = "doc_id", max_exceptions: int = MAX_EXCEPTIONS) -> DataFrame:
    """df with every entity of text_col replaced, and n_entities, entity_kinds (of each, in order).

    n_entities counts what the patterns find; full names without a title that are replaced beside a titled one aren't counted.
    Null text stays null, with no entities; empty text stays empty. Rows that repeat, null ids and extra columns pass through; a new
    column whose name is taken gets underscores in front. An empty table gives an empty one.
    """
    cols = df.columns
    names = [fresh(cols, "n_entities"), fresh(cols, "entity_kinds")]
    special = cut(resolve(entities(df, text_col), key))
    n = special.count()
    text = quoted(text_col).cast("string")
    marks, salts, own = (fresh([*cols, *names], x) for x in ("matches", "salts", "own_row"))
    rows = df.select(*(df[f"`{c}`"] for c in cols), F.coalesce(F.regexp_extract_all(text, F.lit(ANY), 0), F.array().cast("array<string>")).alias(marks))
    if not n:
        rows = rows.withColumn(salts, F.create_map().cast("map<string,struct<salt:int,gender:string>>"))
    else:
        label = F.concat_ws("\x1f", "kind", "entity")
        if n <= max_exceptions:
            one = special.agg(F.map_from_entries(F.collect_list(F.struct(label, F.struct("salt", "gender")))).alias(salts))
            rows = rows.join(F.broadcast(one), F.lit(True), "left")
        else:
            # the rows concerned meet their exceptions by what tells rows apart: the text itself
            digest = F.sha2(text, 256)
            mine = rows.select(digest.alias(own), F.explode(F.array_distinct(quoted(marks))).alias("match")).withColumn("kind", kind_of(F.col("match")))
            mine = mine.select(own, F.inline(parts_of(F.col("match"), F.col("kind")))).distinct().join(special, ["kind", "entity"]).groupBy(own).agg(F.map_from_entries(F.collect_list(F.struct(label, F.struct("salt", "gender")))).alias(salts))
            rows = rows.join(mine, digest == quoted(own), "left").drop(own)

    def replaced(m: Column) -> Column:
        def of(kind: Column) -> Column:
            def told(k: Column) -> Column:
                return F.try_element_at(quoted(salts), F.concat_ws("\x1f", k, entity_of(m, k)))

            def salt(k: Column) -> Column:
                return F.coalesce(told(k)["salt"], F.lit(0))

            new = F.when(kind == "name", _name(m, key, salt(kind), salt(F.lit("given")), told(F.lit("given"))["gender"])).otherwise(surrogate(m, kind, key, salt(kind)))
            return F.struct(kind.alias("kind"), new.alias("text"), m.alias("match"))

        return _bind(kind_of(m), of)

    made = fresh([*cols, *names, marks, salts], "made")
    rows = rows.withColumn(made, F.transform(quoted(marks), replaced))
    # full names that this text has with a title, and what stands for them
    full = F.filter(quoted(made), lambda x: (x["kind"] == "name") & (F.size(F.split(x["match"], " ")) > 2))
    bare = F.array_distinct(F.transform(full, lambda x: F.struct(F.regexp_replace(x["match"], TITLE, "").alias("name"), F.regexp_replace(x["text"], TITLE, "").alias("new"))))

    def untitled(gap: Column) -> Column:
        return F.aggregate(bare, gap, lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}])\Q"), x["name"], F.lit(r"\E(?![\p{L}])")), x["new"]))

    gaps = F.transform(F.split(text, ANY, -1), untitled)
    joined = F.when(F.size(quoted(marks)) == 0, text).otherwise(F.array_join(F.zip_with(gaps, quoted(made), lambda g, s: F.concat(g, F.coalesce(s["text"], F.lit("")))), ""))
    return rows.select(*(joined.alias(c) if c == text_col else rows[f"`{c}`"] for c in cols), F.size(quoted(marks)).cast("long").alias(names[0]), F.transform(quoted(made), lambda s: s["kind"]).alias(names[1]))
