import pytest

from rasm.llm import residue as r

HEAD = "\\documentclass{article}\n\\title{A sparse graph}\n\\author{B. Arno}\n\\begin{document}\n\\maketitle\n"
CASES = [
    "{{abstract}}", "\\title{<<AUTHOR_NAME>>}", "We show it. [[keywords]] Then more.", "\\title{{% journal %}}", "\\author{<%= paper_title %>}", "10.xxxx/xxxxx.yyyy", "Date: dd/mm/yyyy",
    "Lorem ipsum sed sit enim culpa.", "qwer asdf asdf fdsa jkl", "xxx XXXX xx xxxx", "text text text text text text text text text.", "404 Not Found", '{"error": {"code": 504, "message": "Gateway Timeout", "trace": "1"}}',
    "Here be text one day. Here be text one day. Here be text one day.", "All of these many words differ and none of them comes again. " + "Here be text one day. " * 3, "<div class=\"err\"><h2>Forbidden</h2>Please try again.</div>",
]
NONE = [
    "% {{abstract}}", "\\begin{comment}\n{{abstract}}\n\\end{comment}", "\\iffalse\n[[title]]\n\\fi", "\\begin{verbatim}\n[[doi]]\n\\end{verbatim}", "A slot is written as \\verb|{{title}}| here.", "The reply ``Not Found'' came.", "It answered with \\texttt{503 Service Unavailable} then.",
    "In our crawl 22 percent ended in a 500 Internal Server Error response.", "\\newcommand{\\x}{{\\mathcal u}}", "$\\left(x\\right)^{{5}}$", "\\input{tex/none}", "Our probe needs 404 steps.", "Filler such as ``ipsum nostrud irure veniam'' is common.", "\\end{document}\n{{abstract}}", "", "   ",
    "``" + "Lorem ipsum dolor sit amet. " * 40 + "''",
]


def found(spark, docs, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string, paper_key string, id string")
    return sorted(x["doc_id"] for x in r.found(df, "doc_id", "text", "paper_key", **how).collect())


def article(i, body, title=None, author="B. Arno"):
    head = HEAD.replace("A sparse graph", title or f"A sparse graph {chr(97 + i % 26)}q").replace("B. Arno", author)
    return (i, head + body + "\n", f"p{i}", "x")


@pytest.mark.parametrize("body", CASES)
def test_alone(body):
    assert r.Units(HEAD + body + "\n").hit


@pytest.mark.parametrize("body", NONE)
def test_none(body):
    assert not r.Units(HEAD + body + "\n").hit


def test_slots_that_keep_a_name(spark):
    docs = [article(i, f"Kindly state the {n} at this point.") for i, n in enumerate(("abstract", "funding", "journal"))]
    docs += [article(3, "So. Kindly state the doi at this point. And more words."), article(4, "Kindly state the aim at this point."), article(5, "", title="Kindly state the keywords at this point.")]
    docs += [(90, None, "p", "x"), (91, "", "p", "x"), (None, "{{abstract}}", "p", "x"), (92, "{{abstract}}", None, "x"), (92, "{{abstract}}", None, "x")]
    assert found(spark, docs) == [0, 1, 2, 3, 5, 92]
    assert found(spark, docs, fixed=False) == [0, 1, 2, 3, 5]
    assert found(spark, docs[:1]) == [] and found(spark, []) == []


def test_a_frame_of_any_length_and_hits_that_count(spark):
    words = " ".join(f"word{chr(97 + i % 26)}" for i in range(60))
    docs = [article(i, f"{words} the {n} here {words}\n{extra}") for i, (n, extra) in enumerate((("abstract", "Lorem ipsum dolor sit amet."), ("funding", "{{title}}"), ("journal", "")))]
    assert found(spark, docs) == [0, 1, 2] and found(spark, docs[:2] + [article(7, "x")], fixed=False) == []


def test_slots_that_keep_a_default(spark):
    docs = [article(0, "x", title="My great paper"), article(1, "x", author="My great paper"), article(2, "Some text. My great paper We show more."), article(3, "\\section{Section heading}"), article(4, "\\section{Section heading}"), article(5, "\\section{Section heading}")]
    docs += [article(i, "\\section{Related work}", author="C. Ono and D. Eko") for i in range(6, 12)]
    assert found(spark, docs) == [0, 1, 2, 3, 4, 5]


def test_whole_pages_that_repeat(spark):
    page = lambda i, t: (i, t, f"p{i}", "x")
    say = "Nothing is served at hour {}. Come again."
    docs = [page(0, say.format(4)), page(1, say.format(17)), article(2, "We show it. Come again. And more."), article(3, "A word. Nothing is served at hour 9.")]
    # a sentence of articles that also stands on two pages is none
    docs += [page(4, "Trees were felled twice."), page(5, "Trees were felled twice.")] + [article(i, "Trees were felled twice. Then more.") for i in range(6, 30)]
    assert found(spark, docs, fixed=False) == [0, 1, 2, 3]
    # versions of one paper are one
    assert found(spark, [(i, say.format(i), "same", "x") for i in range(5)]) == []


def test_the_document_ends_where_its_end_is_printed():
    for body in ("% \\end{document}\n{{abstract}}", "\\begin{verbatim}\n\\end{document}\n\\end{verbatim}\n{{abstract}}"):
        assert r.Units(HEAD + body + "\n").hit
    assert not r.Units(HEAD + "Text.\n\\end{document}\n{{abstract}}\n").hit


def test_the_gate_of_fillers_loses_none():
    import random

    rnd = random.Random(3)
    assert r.Units(HEAD + "Blah, blah, blah.\n").hit
    line = "one two three four five six seven eight nine ten eleven twelve end end end end."
    assert r.Units(HEAD + line + "\n").hit
    for _ in range(20000):
        line = "".join(rnd.choice(["blah", "asdf", "xx", "XXX", "ipsum", "Sit", "a", "b", "c d", "7", "¤", "a_b"]) + rnd.choice([" ", " ", ", ", ". ", "-", "1 ", "_"]) for _ in range(rnd.randint(1, 24)))
        assert not (r.latin(line) or r.repeated(line)) or r._suspect(line), line
