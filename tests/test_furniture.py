import random
from html.parser import HTMLParser

import pytest

from tallyloom.functions import extract as X


class Plain(HTMLParser):
    """Text outside furniture, by a stack of depths, each furniture tag as a blank."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.inside, self.depth, self.out, self.raw = None, 0, [], None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.raw = tag
        elif tag in ("nav", "footer", "header") and (not self.depth or tag == self.inside):
            self.inside, self.depth = tag, self.depth + 1
        elif not self.depth and tag not in ("nav", "footer", "header"):
            self.out.append(f"<{tag}>")

    def handle_startendtag(self, tag, attrs):
        if not self.depth and tag in ("nav", "footer", "header"):
            self.out.append(" ")
        elif tag not in ("nav", "footer", "header"):
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.raw = None
        elif tag in ("nav", "footer", "header"):
            if not self.depth:
                self.out.append(" ")
            elif tag == self.inside:
                self.depth -= 1
                if not self.depth:
                    self.out.append(" ")
        elif not self.depth:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.depth and not self.raw:
            self.out.append(data)


def plain(html):
    parser = Plain()
    parser.feed(html)
    parser.close()
    return "".join(parser.out)


CASES = {
    "<nav>a<nav>b</nav><p>still in</p></nav><p>out</p>": " <p>out</p>",
    "x<header><footer>y</header>z": "x z",
    "a</nav>b<NAV >c</nav >d": "a b d",
    "<p>one</p><nav><p>never closed": "<p>one</p>",
    "<!-- <nav> --><p>in</p><!-- open": "<p>in</p>",
    "<script>if (a < b) '</p><nav>'</script><p>k</p>": "<p>k</p>",
    "<style>nav { }</style><navigation>n</navigation><nav-bar>m</nav-bar>": "<navigation>n</navigation><nav-bar>m</nav-bar>",
    "a<nav/>b<nav class='x'>c<nav/>d</nav>e": "a b e",
    "<script><!-- </script>text": "text",
    "": "",
}


def test_nested_unclosed_and_commented(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "i int, x string")
    got = {r.i: r.t for r in rows.select("i", X.without_furniture(rows.x).alias("t")).collect()}
    assert [got[i] for i in range(len(CASES))] == list(CASES.values())
    none = spark.createDataFrame([(None,)], "x string")
    assert none.select(X.html_paragraphs(none.x)).first()[0] is None


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_parser(spark, seed):
    rng = random.Random(seed)
    bits = ["<nav>", "</nav>", "<header>", "</header>", "<footer id=f>", "</footer>", "<p>", "</p>", "word", " two ", "<!-- c <nav> -->", "<script>x</script>", "<style>y</style>", "<div>", "</div>", "<nav/>"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, x string")
    got = {r.i: r.t for r in rows.select("i", X.without_furniture(rows.x).alias("t")).collect()}
    assert [got[i] for i in range(len(pages))] == [plain(p) for p in pages]


def test_paragraphs_behind_an_inner_element(spark):
    page = "<body><nav><nav>menu</nav><p>hidden</p></nav><p>shown <b>bold</b>&amp;</p><footer><p>foot</p></footer><p>last"
    rows = spark.createDataFrame([(page,)], "x string")
    assert rows.select(X.html_paragraphs(rows.x)).first()[0] == "shown bold& last"


def test_sections_with_odd_letters_and_blank_lines(spark):
    texts = ["\n \nfirst\n\nCertiﬁcations held\nx\n", "work  experience\n\n a \n\t\nsKills\n", "SKILLS", "a\x01b\nEducation\r\nc\r\n\r\n", "professional\nsummary: y\nz", "no header Skills here\nt"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    both = rows.select("i", X.sections(rows.x).alias("a"), X.bound(X._parts_by_line(rows.x), X._together).alias("b")).collect()
    assert len(both) == len(texts) and all(r.a == r.b for r in both)
    assert {r.i: r.a["certifications"] for r in both}[0] == "x\n" and {r.i: r.a["education"] for r in both}[3] == "c\r\n"
