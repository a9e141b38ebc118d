import hashlib
import itertools
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from catamatch.llm import conversation_repair as op
from catamatch.llm import queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def faults_of(rows):
    """(initial or None, fault) of rows after the damage, in order."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(BLANKS)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def cheapest(marked):
    """(cost, audit) by a plain program over suffixes: no runs, no matrices."""
    n = len(marked)

    @lru_cache(maxsize=None)
    def best(i, made, inserts):
        """Cheapest (cost, edits) for the rest after initials ``made`` (shortened to what matters)."""
        ways = []
        if i == n and made in ("", "a"):
            ways.append((0, ""))
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[made]
        if inserts < 3:
            for c in follow.replace("s", ""):
                cost, rest = best(i, c, inserts + 1)
                ways.append((cost + 5, "I" + rest))
        if i < n:
            initial, fault = marked[i]
            cost, rest = best(i + 1, made, 0)
            ways.append((cost + 2, "D" + rest))
            if fault not in ("blank", "duplicate"):
                late = 5 * (fault == "truncated")
                for c in follow:
                    cost, rest = best(i + 1, c, 0)
                    if c == initial:
                        ways.append((cost + late, "K" + rest))
                    if c != "s":
                        ways.append((cost + late + 1, "R" + rest))
        return min(ways, default=(10 ** 6, ""))

    return best(0, "", 0)


def applied(rows, audit):
    out, i, made = [], 0, ""
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        need = {"": "user", "s": "user", "u": "assistant", "a": "user"}[made]
        text = "" if edit == "I" else rows[i][2]
        role = rows[i][1] if edit == "K" else need
        i += edit != "I"
        out.append(f"{role}:{text}")
        made = role[0]
    assert i == len(rows)
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out))
    return "\n".join(out)


def brute(table, kinds=None):
    per = {}
    for conv, turn, role, text in table:
        rows = per.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20 if kinds is None else kinds
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, rows in per.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        marked = faults_of(rows)
        turns = [r[0] for r in rows if r[0] is not None]
        pairs = list(zip(marked, marked[1:]))
        cost, audit = cheapest(tuple(marked))
        fault = lambda f: sum(m[1] == f for m in marked)  # noqa: E731, B023
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, fault("blank"), fault("duplicate"),
                    fault("truncated"), sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in pairs), cost, audit,
                    applied(rows, audit)))
    return sorted(out, key=repr)


def results(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def conversations(seed, n):
    r = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(r.randrange(9)):
            role = r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "s", None])
            out.append((r.choice([conv, conv, conv, None, 0]) if conv % 5 == 0 else conv, r.choice([turn, turn, turn + 3, None]), role,
                        r.choice(["Hi.", "Hi.", "Yes!", "no end", "", " \x0b", "Why? ", "a" * 2000 + ".", None, "é?\n"])))
    return out


@pytest.mark.parametrize("bits", [1, 2, 16])
def test_against_brute_force(spark, bits):
    table = conversations(7, 40)
    docs = spark.createDataFrame(table, SCHEMA)
    for c in ("c", "place", "pos", "at", "first", "n", "audit", "cost", "kind"):
        docs = docs.withColumn(c, docs["role"])
    assert results(op.repair(docs, bits=bits)) == brute(table)


def test_all_short_rows_of_symbols():
    symbols = [("s", ""), ("u", ""), ("a", ""), ("t", ""), ("u", "truncated"), ("a", "truncated"), ("u", "blank")]
    number = {"s": 0, "u": 2, "a": 4, "t": 6}
    for n in range(5):
        for rows in itertools.product(symbols, repeat=n):
            code = bytes(8 if f == "blank" else number[i] + (f == "truncated") for i, f in rows)
            cost = int((op.matrix(code) + [op._FINISH]).min(axis=1)[0]) if n else 0
            assert (cost, op.unroll(code, 0, op._FINISH, True)[0] if n else "") == cheapest(rows), rows


def test_long_runs_and_split_fragments():
    r = random.Random(3)
    for _ in range(60):
        rows = [s for _ in range(r.randrange(1, 9)) for s in [r.choice([("s", ""), ("u", ""), ("a", ""), ("u", "truncated"), ("a", "blank")])] * r.choice([1, 2, 3, 17])]
        number = {"s": 0, "u": 2, "a": 4}
        code = bytes(8 if f == "blank" else number[i] + (f == "truncated") for i, f in rows)
        want = cheapest(tuple(rows))
        at = r.randrange(1, len(code) + 1)
        first, second = code[:at], code[at:]
        after = (op._times(op.matrix(second), op.np.array(op._FINISH)[:, None])[:, 0] if second else op.np.array(op._FINISH))
        audit, state = op.unroll(first, 0, tuple(after.tolist()), not second)
        if second:
            audit += op.unroll(second, state, op._FINISH, True)[0]
        assert audit == want[1] and int((op.matrix(first) + after[None, :]).min(axis=1)[0]) == want[0]


def test_one_long_conversation(spark):
    sys.setrecursionlimit(20_000)
    r = random.Random(5)
    table = [(1, t, r.choice(["user", "assistant"]), r.choice([f"text {t}.", "again.", f"open {t}"])) for t in range(700)]
    docs = spark.createDataFrame(table, SCHEMA)
    assert results(op.repair(docs.repartition(5), bits=5)) == brute(table)


def test_cases(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    docs = spark.createDataFrame([(lost, 0, "user", "gone."), (None, None, None, None)], SCHEMA)
    empty = hashlib.sha256(b"").hexdigest()
    got = {r["conv_id"]: r for r in op.repair(docs).collect()}
    assert tuple(got[lost])[1:] == (0, 0, 0, 0, 0, 0, "", "") and set(got) == {lost, None}
    assert op.repair(docs.limit(0)).collect() == []
    assert hashlib.sha256(got[lost]["text"].encode()).hexdigest() == empty


def test_query(spark, tmp_path):
    table = conversations(11, 60)
    spark.createDataFrame(table, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op12_conversation_repair(spark, str(tmp_path))
    assert results(got) == sorted([(*b[:-1], hashlib.sha256(b[-1].encode()).hexdigest()) for b in brute(table)], key=repr)
