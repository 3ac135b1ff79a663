import re

from pyspark.sql import functions as F

from tabulon.llm import surrogates
from tabulon.llm.surrogates import replace_personal_data, resolve

ROWS = [
    (1, "Mail Anna.Berg7@mail3.example.com or anna.berg7@MAIL3.example.com; also bob@mail3.example.com."),
    (2, "Call +1 (377) 555-0271, +1 (377)-555-0271 or 212-555-0199. Card 4111 1111 1111 1111, 4111111111111111 and 2390409500648960!!"),
    (3, 'IP 152.143.123.131, token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" SSN 123-45-6789 IBAN DE89 3704 0044 0532 0130 00'),
    (4, "Mrs. Anna Berg met Mr Berg and Dr. Tom Smith; г-жа Анна Иванова, κ Νίκος Παππάς. Herr Berg left."),
    (5, None),
    (6, ""),
    (7, "Nothing here: 12345 and 1.2.3, version 4.5.6.7.8, 2024-01-15."),
    (None, "x bob@mail3.example.com y"),
]


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x) // 10 + (2 * x) % 10 for k, x in enumerate(map(int, reversed(d)))) % 10


def run(spark, rows=ROWS, **how):
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, n_entities string").repartition(2)
    out = replace_personal_data(df, "secret", **how)
    assert out.columns == ["doc_id", "text", "n_entities", "_n_entities", "entity_kinds"]
    return {r.doc_id: r for r in out.collect()}


def test_formats_and_coreference(spark):
    got = run(spark)
    text = {k: r.text for k, r in got.items()}
    for _, t in ROWS[:4]:
        for found in re.findall(r"[\w.]+@[\w.]+\w|\d[\d ().\-]{8,}\d|24be\w+|Berg|Smith|Иванова|Παππάς", t):
            assert all(found.lower() not in (x or "").lower() for x in text.values()), found
    a, b, c = re.findall(r"[\w.]+@[\w.]+[a-z]", text[1])
    assert a == b and a != c and a.split("@")[1] == c.split("@")[1] and re.fullmatch(r"[a-z]{4}\.[a-z]{4}\d@[a-z]{4}\d\.[a-z]{7}\.com", a)
    assert text[None].split()[1] == c
    p = re.findall(r"\+1 \(\d{3}\)[ -]\d{3}-\d{4}", text[2])
    assert len(p) == 2 and re.sub(r"\D", "", p[0]) == re.sub(r"\D", "", p[1]) and re.search(r"or \d{3}-\d{3}-\d{4}\.", text[2])
    spaced, plain = re.search(r"Card (\d{4} \d{4} \d{4} \d{4}), (\d{16})", text[2]).groups()
    assert spaced.replace(" ", "") == plain and luhn(plain) == 0 and text[2].endswith("!!")
    assert re.search(r'IP 10\.\d+\.\d+\.\d+, token = "[0-9a-f]{40}" SSN \d{3}-\d{2}-\d{4} IBAN DE\d\d( \d{4}){4} \d\d$', text[3])
    names = re.search(r"^Mrs\. (\w+) (\w+) met Mr (\w+) and Dr\. \w+ (\w+); г-жа (\w+) ([А-Яа-я]+), κ ([Α-Ωα-ωάέήίόύώ]+) ([Α-Ωα-ω]+)\. Herr (\w+) left\.$", text[4])
    assert names and names[2] == names[3] == names[9] != names[4]
    assert names[1] in surrogates.GIVEN["latin", "f"] and names[5] in surrogates.GIVEN["cyrillic", "f"] and names[7] in surrogates.GIVEN["greek", "m"]
    assert (text[5], text[6], text[7]) == (None, "", ROWS[6][1])
    assert got[2]["_n_entities"] == 6 and got[2].entity_kinds[:2] == ["phone", "phone"] and got[7].entity_kinds == []


def test_collisions_are_resolved(spark, monkeypatch):
    # addresses of one letter: 26 surrogates, all of which are entities or taken
    rows = [(k, f"to {c}1@mail.example.com!") for k, c in enumerate("abcdefgh")]
    plain = run(spark, rows)
    assert len({r.text for r in plain.values()}) == 8
    found = surrogates.entities(spark.createDataFrame(rows, "doc_id long, text string"), "text")
    real = surrogates.surrogate

    def narrow(match, kind, key, salt):
        return F.concat(F.lit("n"), (salt + F.pmod(F.xxhash64(match), F.lit(3))).cast("string"), F.lit("@x.com"))

    monkeypatch.setattr(surrogates, "surrogate", narrow)
    special = resolve(found, "k")
    assert special.count() >= 5
    for limit in (50_000, 0):
        got = run(spark, rows, max_exceptions=limit)
        assert len({r.text for r in got.values()}) == 8 and all(re.fullmatch(r"to n\d+@x\.com!", r.text) for r in got.values())
    monkeypatch.setattr(surrogates, "surrogate", real)


def test_bearers_of_a_family_name_stay_apart(spark):
    """Sixty given names of one family, more than the list has: all differ, the family name is the same, and each stays the same everywhere."""
    given = [a + b for a in ("Jo", "Ka", "Le", "Mi", "Su", "Ta") for b in ("bel", "din", "fur", "gan", "hol", "jit", "kor", "lam", "nov", "pel")]
    rows = [(k, f"then Mr. {g} Stone came; Mr {g} Stone and Mr Stone left") for k, g in enumerate(given)]
    for limit in (50_000, 0):
        got = [re.fullmatch(r"then Mr\. (.+) (\w+) came; Mr (.+) (\w+) and Mr (\w+) left", r.text).groups() for r in run(spark, rows, max_exceptions=limit).values()]
        assert len({g[0] for g in got}) == len(given) and len({x for g in got for x in (g[1], g[3], g[4])}) == 1
        assert all(g[0] == g[2] and g[0].split()[0] in surrogates.GIVEN["latin", "m"] for g in got)


def test_empty(spark):
    assert run(spark, ROWS[:0]) == {}


def mod97(iban):
    x = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def test_scripts_checks_and_countries(spark):
    rows = [
        (1, "иван@почта.рф and νίκος@ελλάδα.gr"),
        (2, "DE89370400440532013000 GB29 NWBK 6016 1331 9268 19 DE12370400440532013000"),
        (3, "+49 30 123 4567, +358 40 123 4567"),
        (4, "version 10.2.3.4 and v1.2.3.4 stay, 300.1.2.3 too; 10.2.3.4 goes"),
    ]
    t = {k: r.text for k, r in run(spark, rows).items()}
    assert re.fullmatch(r"[а-я]{4}@[а-я]{5}\.рф and [α-ωά-ώ]{5}@[α-ω]{6}\.gr", t[1]) and "почта" not in t[1]
    one, two, wrong = re.fullmatch(r"(DE\d{20}) (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) (DE\d{20})", t[2]).groups()
    assert mod97(one) == mod97(two) == 1 and "370400440532013000" not in t[2] and one[4:] != wrong[4:]
    assert re.fullmatch(r"\+49 \d\d \d{3} \d{4}, \+358 \d\d \d{3} \d{4}", t[3]) and "123 4567" not in t[3]
    assert re.fullmatch(r"version 10\.2\.3\.4 and v1\.2\.3\.4 stay, 300\.1\.2\.3 too; 10\.\d+\.\d+\.\d+ goes", t[4]) and not t[4].endswith("10.2.3.4 goes")


def test_one_person_whatever_the_title(spark):
    rows = [(1, "Dr Anna Weber came. Anna Weber sang; Anna Webers Lied, Annabel Weber."), (2, "Frau Anna Weber left."), (3, "Dr Kim Lee, Herr Kim Lee, Frau Kim Lee.")]
    t = {k: r.text for k, r in run(spark, rows).items()}
    name = re.fullmatch(r"Frau (\w+ \w+) left\.", t[2])[1]
    assert t[1] == f"Dr {name} came. {name} sang; Anna Webers Lied, Annabel Weber." and name.split()[0] in surrogates.GIVEN["latin", "f"]
    man, woman = re.search(r"Herr (\w+) \w+, Frau (\w+) \w+\.", t[3]).groups()
    assert man in surrogates.GIVEN["latin", "m"] and woman in surrogates.GIVEN["latin", "f"]


def test_formats_that_run_out_grow(spark):
    """More addresses of one digit and letter than there are; all stay distinct, and the job ends."""
    rows = [(k, f"mail {c}@x.example.com now") for k, c in enumerate("abcdefghijklmnopqrstuvwxyz")]
    t = {k: r.text for k, r in run(spark, rows).items()}
    made = [re.fullmatch(r"mail (\S+)@\S+ now", x)[1] for x in t.values()]
    assert len(set(made)) == 26 and all(len(x) == 1 or re.fullmatch(r"\w-\d{11}", x) for x in made)


def test_against_a_plain_form(spark):
    """Emails of a random corpus, one by one in plain Python: equal texts get equal ones, others others, all else stays."""
    import random

    rng = random.Random(6)
    mails = [f"{rng.choice('abc')}{k}.{rng.choice('xyz')}@d{k % 4}.example.org" for k in range(30)]
    rows = [(k, "".join(f"word{j} {rng.choice(mails)}, " for j in range(rng.randint(0, 5)))) for k in range(60)]
    got, seen = run(spark, rows), {}
    for k, text in rows:
        old, new = re.split(r"(\S+@\S+\w)", text), re.split(r"(\S+@\S+\w)", got[k].text)
        assert old[::2] == new[::2] and len(old) == len(new) and got[k]["_n_entities"] == len(old) // 2
        for a, b in zip(old[1::2], new[1::2], strict=True):
            assert seen.setdefault(a, b) == b and [re.sub("[a-z]", "a", re.sub(r"\d", "1", x.split("@")[0])) for x in (a, b)][0] == re.sub("[a-z]", "a", re.sub(r"\d", "1", b.split("@")[0]))
    assert len(set(seen.values())) == len(seen) and not set(seen) & set(seen.values())
