import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from catamatch.llm import pii
from catamatch.llm.queries import op2_personal_data
from llm.cases import clashing, documents, rows

SF = "/root/testdata/sf0.001"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = 0
        for i, c in enumerate(d[::-1]):
            v = int(c) * (1 + i % 2)
            total += v - 9 * (v > 9)
        return 12 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    out = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items())
           for m in re.finditer(p, text) if good(k, m[0])]
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a.@+-19 25(4)é\n0:/3", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert [s for s in pii.find(text) if s[1] < 4] == brute(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.1", "300.1.2.3.4", "+1 (988) 555-2485",
                                 "a.b+c@d-e.f.g", "x@y", "@", "+", ".", "1", " ", "é", "account 123456789", "iban",
                                 "https://a.b/c?d=e", "GB82 WEST 1234 5698 7654 32", "@z.de"]), max_size=12))
def test_base_spans_of_pasted_parts(parts):
    text = "".join(parts)
    assert [s for s in pii.find(text) if s[1] < 4] == brute(text)


def test_added_kinds():
    text = "see (https://a.example/x?y=1). IBAN: GB82 WEST 1234 5698 7654 32, account no. 12-345-678 iban GB00 WEST 1234 5698 7654 32"
    found = {pii.KINDS[k]: text[a:b] for a, k, b in pii.find(text) if k > 3}
    assert found == {"url": "https://a.example/x?y=1", "iban": "GB82 WEST 1234 5698 7654 32", "account": "12-345-678"}
    assert pii.mask("mail é a@b.cd now") == "mail é [EMAIL] now"


def test_long_texts_take_linear_time():
    for text in ("1" * 300_000, "1." * 200_000, "a@" * 200_000, "+1 " * 100_000, "1 " * 200_000, "://" * 100_000,
                 "iban " * 50_000, "account 1" * 40_000):
        pii.find(text)


def test_table(spark):
    docs = documents(spark, [None, "", "a@b.cd é a@b.cd", "a@b.cd é a@b.cd", "x"], ids=[1, 2, 3, 3, None])
    got = rows(pii.personal_data(clashing(docs)), "doc_id", "n_email", "base")
    assert got == sorted([(1, 0, ""), (2, 0, ""), (3, 2, "email:0:6,email:9:15"), (3, 2, "email:0:6,email:9:15"), (None, 0, "")], key=repr)
    assert pii.personal_data(docs.limit(0)).collect() == []
    assert rows(pii.masked(docs), "text")[0] == ("",)


def test_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op2_personal_data(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        base = brute(docs[r["doc_id"]])
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == i for s in base) for i in range(4)]
        assert set(said.split(",")) - {""} <= set(r["spans"].split(","))
