"""Text functions on the rows that matter, against Python restatements."""

import math
import re
import unicodedata

import pytest
from linkweave.functions import fuzzy
from linkweave.functions import text as X
from pyspark.sql import functions as F

TEXTS = [None, "", "--- !!!", "Café Élan SARL", "CAFE ELAN", "आदित्य प्रोडक्ट्स", "straße", "Acme Private Limited", "Smith&Co", "NEW NEW YORK", "O’Neil ª", "A", "12 Rue d'Été 75001", "१२३ Road", "00 Main", "한국 회사", "a\t b\n  c", "Ａcme", "co CO Co."]


def values(spark, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").repartition(2)
    return [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def py_norm(t, mark=""):
    return re.sub(r"\s+", " ", re.sub(r"[!-/:-@\[-`{-~]", mark, (t or "").upper())).strip()


def py_fold(t):
    return None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))


def test_norms(spark):
    assert values(spark, X.norm) == [py_norm(t) for t in TEXTS]
    assert values(spark, X.norm_space) == [py_norm(t, " ") for t in TEXTS]
    assert values(spark, X.norm_ascii) == [re.sub(r" +", " ", re.sub(r"[^A-Za-z0-9 ]", " ", t or "")).upper().strip() for t in TEXTS]
    assert values(spark, lambda c: X.norm(X.norm(c))) == values(spark, X.norm)


def test_fold(spark):
    assert values(spark, X.fold) == [py_fold(t) for t in TEXTS]


def test_fold_of_every_code_point(spark):
    points = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["a" + "".join(points[i : i + 200]) + "é" for i in range(0, len(points), 200)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.fold(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [py_fold(t) for t in texts]


def test_suffixes(spark):
    got = dict(zip(TEXTS, values(spark, lambda c: X.strip_suffix(X.norm(c)))))
    assert got["Acme Private Limited"] == "ACME" and got["Café Élan SARL"] == "CAFÉ ÉLAN" and got["Smith&Co"] == "SMITHCO" and got["co CO Co."] == ""
    short = dict(zip(TEXTS, values(spark, lambda c: X.strip_suffix_short(X.norm_space(c)))))
    assert short["Café Élan SARL"] == "CAFÉ ÉLAN SARL" and short["Smith&Co"] == "SMITH"


def test_tokens(spark):
    assert dict(zip(TEXTS, values(spark, lambda c: X.numbers(c, 2))))["१२३ Road"] == ["१२३"]
    words = dict(zip(TEXTS, values(spark, X.words)))
    assert words["Café Élan SARL"] == ["Café", "Élan", "SARL"] and words[None] == [] and len(words["आदित्य प्रोडक्ट्स"]) == 2
    assert dict(zip(TEXTS, values(spark, X.split_words)))["NEW NEW YORK"] == ["NEW", "YORK"]


def test_scripts(spark):
    def cls(t):
        rest = [c for c in t or "" if ord(c) > 127]
        return 0 if not rest else 1 if all(unicodedata.name(c, "").startswith("LATIN") for c in rest) else 2

    assert values(spark, X.script_class) == [cls(t) for t in TEXTS]
    got = dict(zip(TEXTS, values(spark, X.script)))
    assert got["आदित्य प्रोडक्ट्स"] == "Deva" and got["한국 회사"] == "Kore" and got["A"] == "Latn" and got[""] == got[None] == "None"
    assert [bool(x) for x in values(spark, X.is_indic)] == [any(0x900 <= ord(c) <= 0xD7F for c in t or "") for t in TEXTS]


def test_grams_and_sets(spark):
    got = values(spark, lambda c: X.grams(c, 2))
    assert [set(g) for g in got] == [{(t or "")[i : i + 2] for i in range(len(t or "") - 1)} for t in TEXTS]
    row = spark.createDataFrame([(["a", "b"], ["b"], [])], "a array<string>, b array<string>, e array<string>")
    a, b, e = F.col("a"), F.col("b"), F.col("e")
    assert tuple(row.select(X.jaccard(a, b), X.containment(a, b), X.contained(a, b), X.jaccard(e, e), X.containment(a, e), X.contained(e, a)).first()) == (0.5, 1.0, 0.5, 0.0, 0.0, 0.0)


def test_log_number_similarity(spark):
    rows = [("00 Main", "00 Main", math.nan), ("12 x", "12 y", 1.0), ("5 x", "55", 0.0), (None, "12", 0.0), ("00", "10", 0.0)]
    df = spark.createDataFrame([r[:2] for r in rows], "a string, b string")
    got = [r[0] for r in df.select(X.log_number_similarity(F.col("a"), F.col("b"))).collect()]
    assert all(g == w or (math.isnan(g) and math.isnan(w)) for g, (*_, w) in zip(got, rows))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_ratios():
    pairs = [("", ""), ("a", ""), ("kitten", "sitting"), ("abcde", "edcba"), ("NEW YORK MARINERS", "NEW YORK METS"), ("x" * 70, "x" * 65 + "y"), ("éa", "ea")]
    for a, b in pairs:
        want = 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0
        assert fuzzy.ratio(a, b) == fuzzy.ratio(b, a) == pytest.approx(want)
    assert fuzzy.partial_ratio("YANKEES", "NEW YORK YANKEES") == 1.0
    assert fuzzy.partial_ratio("", "a") == 0.0 and fuzzy.partial_ratio("", "") == 1.0
    for a, b in [("abcd", "xxabydzz"), ("hello", "yellow mellow"), ("abc", "cab")]:
        short, long = sorted((a, b), key=len)
        every = [long[max(0, i) : i + len(short)] for i in range(1 - len(short), len(long))]
        both = every + ([a[max(0, i) : i + len(b)] for i in range(1 - len(b), len(a))] if len(a) == len(b) else [])
        assert fuzzy.partial_ratio(a, b) == pytest.approx(max(max(fuzzy.ratio(short, w) for w in every), max((fuzzy.ratio(long, w) for w in both[len(every) :]), default=0)))
    assert fuzzy.token_sort_ratio("fuzzy wuzzy was", "was wuzzy fuzzy") == 1.0
    assert fuzzy.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1.0 and fuzzy.token_set_ratio("", "a") == 0.0
    assert fuzzy.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4) and fuzzy.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.8133, abs=1e-4)
    assert fuzzy.jaro_winkler("", "") == 1.0 and fuzzy.jaro_winkler("a", "") == 0.0 and fuzzy.jaro_winkler("ab", "cd") == 0.0
