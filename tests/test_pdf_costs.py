from tallyloom import catalog
from tallyloom.sources import pdf


def test_lines_are_split_once(spark, tiny):
    plan = catalog.queries()["pdf_pages"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_two_byte_codes_and_tokens():
    font = pdf.Font(pdf.Document(b""), {"Subtype": "Type0"})
    font.ranges.append((b"\x00\x20", b"\xff\xfd", b"\x00\x20"))
    font.map[b"\x00A"] = "AB"
    text = "xA😀é"
    slow = "".join(font._of(c) if c not in font.map else font.map[c] for c in (text.encode("utf-16-be", "surrogatepass")[i : i + 2] for i in range(0, 10, 2)))
    assert font("xAé".encode("utf-16-be")) == "xABé" and len(font.wide) == 3
    assert font(text.encode("utf-16-be", "surrogatepass")) == slow
    assert pdf._values(b"12 +3 -4.5 /N R inf <41 42> [1 0 R (a)]") == [12, 3, -4.5, "N", b"R", float("inf"), b"AB", [pdf.Ref(1), b"a"]]
