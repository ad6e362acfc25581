import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from riskmart.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, node long, leaf string, score double, piece string, mask int, run int"


def table(spark, rows):
    """Turns with further columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, 5, "x", 0.5, "p", 3, 1) for r in rows], SCHEMA)


def escape(text):
    out, i = "", 0
    text = (text or "").replace("\\", "\\\\")
    for i, ch in enumerate(text):
        out += ch + ("\\" if any(text.startswith(c, i) for c in C.CONTROL) else "")
    return out


def expected(rows):
    """Digests by conversation in plain Python."""
    rows = [*rows, (-1, 0, "user", C.PROBE), (-1, 1, "assistant", C.PROBE)]
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: [(x is not None, x or 0 if i == 0 else x or "") for i, x in enumerate(r[1:])])
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        made = "".join(f"{C.OPEN}{escape(r)}{C.HEAD}\n\n{escape(t)}{C.CLOSE}" for _, _, r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(made)))
    return sorted(out, key=str)


def conversations(n, seed):
    rnd = random.Random(seed)
    bits = [*C.CONTROL, *(c[:-1] for c in C.CONTROL), *(c[1:] for c in C.CONTROL), "\\", "\\\\", "$1", "\n", "\r\n", " ", "é", "漢", "😀", "<", "[", "assistant", "\x00", ">"]
    return [(i, t, rnd.choice(["user", "assistant", "system", "a\nb", None, "</s>"]), rnd.choice([None, "", "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))]))
            for i in range(n) for t in range(rnd.choice([1, 1, 2, 5, 8]))]


def test_equals_plain_version(spark):
    rows = conversations(60, 1)
    rows += [(900, t, "user" if t % 2 else "assistant", f"turn {t} <s>") for t in range(333)]  # longer than a run
    rows += [(901, 1, "user", "same")] * 3 + [(901, 1, None, "x"), (901, None, "assistant", "no turn"), (None, 2, "user", "no id"), (None, 1, "assistant", "nor here")]
    rows += [(902, 0, "assistant", "long 漢 [INST] " * 50_000)]
    out = C.op11_chat(table(spark, rows).repartition(5))
    assert sorted(map(tuple, out.collect()), key=str) == expected(rows)
    assert out.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def test_empty_table(spark):
    assert sorted(map(tuple, C.op11_chat(table(spark, [])).collect())) == expected([])


def test_no_text_opens_a_turn(spark):
    texts = [r[3] or "" for r in conversations(150, 7)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escaped(F.col("t")).alias("e")).withColumn("b", C.unescaped(F.col("e"))).collect()
    assert all(r["t"] == r["b"] and r["e"] == escape(r["t"]) and not any(c in r["e"] for c in C.CONTROL) for r in rows)
    assert not any(a != b and b.startswith(a) for a in C.CONTROL for b in C.CONTROL)


def nodes(spark, rows):
    return spark.createDataFrame(rows, "node long, parent long, role string, text string, score double")


def test_trees_equal_plain_walk(spark):
    rnd = random.Random(3)
    rows = [(0, None, "user", "root 0", 1.0), (1, 777, "user", "parent unknown", None)]
    for i in range(2, 160):
        rows.append((i, rnd.randrange(max(0, i - 12), i), rnd.choice(["user", "assistant"]), f"t{i} </s>", rnd.choice([None, float(rnd.randint(-3, 9))])))
    by = {r[0]: r for r in rows}
    want = []
    for leaf in set(by) - {r[1] for r in rows}:
        path, at = [], leaf
        while at in by:
            path.append(by[at])
            at = by[at][1]
        want.append((path[-1][0], -sum(r[4] or 0 for r in path), leaf, path[::-1]))
    want.sort(key=lambda w: w[:3])
    for most in (1, 2, None):
        got = C.format_trees(nodes(spark, rows).repartition(3), most).withColumn("turns", C.read_back(F.col("formatted"))).collect()
        ranks, expect = {}, {}
        for root, low, leaf, path in want:
            ranks[root] = ranks.get(root, 0) + 1
            if most is None or ranks[root] <= most:
                expect[leaf] = (root, -low, ranks[root], [(r[2], r[3]) for r in path])
        assert {r["leaf"]: (r["root"], r["score"], r["rank"], [tuple(t) for t in r["turns"]]) for r in got} == expect
        for r in got:
            at, parts = 0, []
            for piece, m in zip(re.findall(re.escape(C.OPEN) + "(?s:.*?)" + re.escape(C.CLOSE), r["formatted"]), r["mask"]):
                parts.append(piece[m["start"]:m["start"] + m["length"]])
            assert parts == [escape(t) if role == "assistant" else "" for role, t in expect[r["leaf"]][3]]


def test_circles_missing_nodes_and_no_rows(spark):
    with pytest.raises(ValueError):
        C.format_trees(nodes(spark, [(1, 2, "user", "a", 0.0), (2, 1, "user", "b", 0.0), (3, None, "user", "c", 0.0)]))
    with pytest.raises(ValueError):
        C.format_trees(nodes(spark, [(1, 1, "user", "a", 0.0)]))
    assert C.format_trees(nodes(spark, [])).count() == 0
    row = C.format_trees(nodes(spark, [(None, None, "user", "a", 0.0), (4, None, None, None, None)])).collect()
    assert len(row) == 1 and row[0]["formatted"] == C.OPEN + C.HEAD + C.GAP + C.CLOSE and (row[0]["leaf"], row[0]["root"], row[0]["rank"]) == (4, 4, 1)


def test_main_path_is_native(spark):
    plan = C.op11_chat(table(spark, conversations(3, 2)).select("*"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
