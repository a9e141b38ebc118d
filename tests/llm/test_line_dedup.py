from hypothesis import given, settings
from hypothesis import strategies as st

from catamatch.llm import line_dedup as op
from llm.cases import clashing, documents, rows

LONG = ["This line is long enough", "another line, long enough", "é" * 20, "é" * 19, "short"]


def brute(texts, ids, least=3):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)
        return k if len(k) >= 20 else None

    held = {}
    for i, t in zip(ids, texts):
        for k in {key(x) for x in (t or "").split("\n")} - {None}:
            held.setdefault(k, []).append(i)
    out = []
    for i, t in zip(ids, texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), [])) >= least and max(held[key(x)]) != i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    texts = [None, "", "\n", LONG[0], LONG[0].upper() + "\nx", "  " + LONG[0] + "\r\n" + LONG[0], "\n".join(LONG), "\n".join(LONG[::-1]),
             LONG[2], LONG[3], LONG[3], LONG[3], "\n".join([LONG[1]] * 500 + [LONG[2]])]
    ids = list(range(len(texts)))
    docs = documents(spark, texts, ids=ids)
    for hot in (1, 3, 1000):
        got = op.without_lines(clashing(docs), op.repeated_lines(clashing(docs), shard=2, hot=hot))
        assert rows(got, "doc_id", "text", "n_lines", "n_dropped") == brute(texts, ids)
    assert got.columns[:5] == docs.columns and "digest" in got.columns


def test_any_number_of_documents(spark):
    # 300 documents share a line, 299 another one
    texts = [f"{LONG[0]} {i}\n{LONG[0]}" + ("" if i == 7 else f"\n {LONG[1].upper()}") for i in range(300)]
    docs = documents(spark, texts)
    for least in (2, 3, 256, 300, 301, 1000):
        for hot in (100, 1000):
            got = op.line_dedup(docs, least_docs=least, hot=hot)
            assert rows(got, "doc_id", "text", "n_lines", "n_dropped") == brute(texts, list(range(300)), least)


def test_cases(spark):
    docs = documents(spark, [LONG[0]] * 4, ids=[None, None, 3, 3])
    assert rows(op.line_dedup(docs), "doc_id", "text") == sorted(
        [(None, ""), (None, ""), (3, LONG[0]), (3, LONG[0])], key=repr)
    assert op.line_dedup(docs.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAé \t\x0b\x85", max_size=30))
def test_keys(line):
    stripped = line.strip(" \t\n\x0b\x0c\r")
    assert (op.line_hash(line.encode()) is None) == (len(stripped) < 20)
