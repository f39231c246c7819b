import pytest

from rasm.llm import skeleton as sk

YEH, FARSI, MAKSURA, KAF, KEHEH, BEH = "ي", "ی", "ى", "ك", "ک", "ب"

ALIKE = [
    ("a b", "a\u00a0b"), ("ab", "a\u200bb"), ("ab", "\ufeffab\u200f"), ("abc", "\uff41\uff42\uff43"), ("(1)", "\uff08\uff11\uff09"), ("\u1e25", "h\u0323"), ("cop", "\u0441\u043e\u0440"),
    (YEH + BEH, FARSI + BEH), (BEH + KAF + BEH, BEH + KEHEH + BEH), (MAKSURA, FARSI), (BEH, "\ufe8f"), ("\u0644\u0627", "\ufefb"), ("\u0628\u064e\u0651", "\u0628\u0651\u064e"), ("\u0622", "\u0627\u0653"), ("\u0661", "\u06f1"),
]
DIFFERENT = [("a b", "a  b"), ("a", "A"), (YEH, FARSI), (YEH, MAKSURA), (KAF, KEHEH), ("\u0627", "\u0623"), (BEH, BEH + "\u064e"), (BEH, BEH + "\u0640"), ("\u0664", "\u06f4"), ("h", "\u1e25"), ("\u0647", "\u0629"), ("ab", "a-b"), ("1", "\u0661")]


@pytest.mark.parametrize("a, b", ALIKE)
def test_alike(a, b):
    assert a != b and sk.skeleton(a) == sk.skeleton(b)
    assert sk.skeleton(sk.skeleton(b)) == sk.skeleton(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different(a, b):
    assert sk.skeleton(a) != sk.skeleton(b)


def test_found_and_groups(spark):
    df = spark.createDataFrame([(1, "a b", "a\u00a0b", 1), (2, "a", "a", 1), (3, None, "a", 1), (4, "", "\u200b", 1), (5, "a", "b", 1), (1, "a b", "a\u00a0b", 1), (6, "x" * 99_999, "x" * 99_998 + "\u0445", 1)], "id int, a string, b string, skeleton int")
    assert sorted(r["id"] for r in sk.look_alike(df, "a", "b").collect()) == [1, 1, 6]
    g = {r["skeleton"]: r for r in sk.groups(df.select("b", "skeleton"), "b").collect()}
    assert (g["a b"]["variants"], g["a b"]["records"], g["a"]["records"]) == (1, 2, 2)
    assert sk.groups(df.select("b").limit(0), "b").count() == 0
    assert sk.look_alike(df.limit(0), "a", "b").count() == 0


def test_letters_of_other_alphabets_and_planes():
    assert sk.skeleton("𝐀𝖻ⅽ ꓮᎪⲞ") == "Abc AAO"
    assert sk.skeleton("ا𞸁") == "اب"
    assert len({sk.skeleton(x) for x in ("ي", "ى", "ئ", "ا", "أ", "I", "l", "1")}) == 8
