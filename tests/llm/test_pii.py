import re

from hypothesis import given, settings
from hypothesis import strategies as st

from docgrid.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", re.ASCII)
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", re.ASCII)
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+", re.ASCII)
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]", re.ASCII)


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15],
    }


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="0123456789 .-+@()aZ_%é\n:/", max_size=60))
def test_base_kinds_equal_the_expressions(text):
    found = pii.find(text)
    assert {k: found[k] for k in pii.BASE} == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "10.0.0.255", "1.2.3.4.5.6.7.8", "256.1.1.1", "a.b@c.d.e", "a@b@c.de", "x@y", "@", " ", ".", "0", "é", "@a.b", "\n"]), max_size=12))
def test_base_kinds_on_likely_pieces(parts):
    text = "".join(parts)
    found = pii.find(text)
    assert {k: found[k] for k in pii.BASE} == brute(text)


def test_further_kinds():
    text = "see ftp://bob:secret@host.example/x account no. 12345678 and IBAN GB82 WEST 1234 5698 7654 32; ssn 123-45-6789"
    found = pii.find(text)
    assert [text[a:b] for a, b in found["url"]] == ["ftp://bob:secret@host.example"]
    assert [text[a:b] for a, b in found["account"]][0] == "12345678"
    assert "123-45-6789" in [text[a:b] for a, b in found["account"]]
    clean = pii.find("an account of 1999 and the accountant's 12 apples")
    assert not any(clean.values())


def test_table(spark):
    rows = [(1, "mail a@b.co", "x"), (2, None, "x"), (3, "", None), (3, "", None), (None, "+1 (017) 555-7713 " + "é" * 300_000 + " 1.2.3.4", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {(r.id, r.spans) for r in pii.find_personal_data(docs, with_text=True).collect()}
    assert out == {(1, "email:5:11"), (2, ""), (3, ""), (None, "ip:300019:300026,phone:0:17")}
    assert pii.find_personal_data(docs, with_text=True).where("id = 1").first().redacted == "mail [EMAIL]"
    assert pii.find_personal_data(docs.limit(0)).count() == 0
