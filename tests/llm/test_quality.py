import re

from tabulon.llm.quality import BOILERPLATE, clean_lines


def brute(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + j for k, w in enumerate(wins) if wins.count(w) > 1 for j in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)

    def chars(x):
        return len(re.sub(r"[\x20\x09-\x0D]", "", x))

    def fails(x):
        n = len(x.split())
        return (
            not re.search("[.!?:;…\"'”’»)\\]][\\x20\\x09-\\x0D]*$", x)
            or bool(re.search("(?:[|›»•·>][^|›»•·>]*){3}", x))
            or 5 * len(re.findall(r"[#*$%&|<>]", x)) > n
            or 2 * x.count("!") > n
            or any(p in x.lower() for p in BOILERPLATE)
        )

    lost = sum(chars(x) for x in lines if fails(x))
    dup = len(lines) - len(set(lines))
    clean = "\n".join(x for x in t.split("\n") if not re.search(r"[^\x20\x09-\x0D]", x) or not fails(x))
    return (len(words), chars(t), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed, not failed and 100 * lost <= 50 * chars(t), clean)


TEXTS = [
    None,
    "",
    " \t\n",
    "One two three four five six seven eight nine ten eleven.",
    "a b c d e a b c d e f g h i j k l m n o p q r s t u v w x y z1 z2 z3.",
    "Home | About | News | Contact | More\nThis is a proper line of the text, with words enough to stay here.\nThis is a proper line of the text, with words enough to stay here.",
    "word### next$$$ third%%% more&&& else*** some### other$$$ one%%% two&&& three*** end.",
    "We use cookies on this site.\nBut the article goes on for quite a while, so that it is kept as a whole, é ü.\n\nEnd\n",
    "THIS!! IS!! ALL!! SHOUTING!! AND!! IT!! GOES!! ON!! FOR!! EVER!! AND!! EVER!!",
    "x " * 3000,
    " ".join(f"w{k}" for k in range(4000)) + ".",
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(TEXTS)], "doc_id long, text string, kept string").repartition(2)
    out = clean_lines(df)
    assert out.columns[:3] == ["doc_id", "text", "kept"] and "_kept" in out.columns
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r["_kept"], r.clean_text) for r in out.collect()}
    assert got == {k: brute(t) for k, t in enumerate(TEXTS)}
    assert clean_lines(df.limit(0)).count() == 0


def test_no_shuffle_and_no_python(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = clean_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
