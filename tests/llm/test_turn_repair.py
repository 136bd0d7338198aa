import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import types as T

from graphloom.llm import queries, turn_repair

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
WHITE = "\x20\t\n\v\f\r"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def fates(data):
    out = defaultdict(list)
    for conv, turn, role, text in data:
        rows = out[conv]
        c, t, role, text = (" " if x is None else str(x) for x in (conv, turn, role, text))
        fate = zlib.crc32(f"{c}:{t}".encode()) % 20
        if fate == 0:
            continue
        text = {1: "", 2: "".join(x for x in text if x not in ".!?")}.get(fate, text)
        rows += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return {c: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, rows in out.items()}


def cheapest(rows, faults):
    """Least (cost, audit) by search over (row, place) with whole strings."""
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, i, place, kept = heapq.heappop(todo)
        if i == len(rows) and place in ("", "a"):
            return cost, audit, kept
        if (i, place) in done:
            continue
        done.add((i, place))
        for initial, name in (("u", "user"), ("a", "assistant")):
            if initial in NEXT[place]:
                heapq.heappush(todo, (cost + 2, audit + "I", i, initial, (*kept, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(todo, (cost + 3, audit + "D", i + 1, place, kept))
            if faults[i] in ("", "truncated"):
                extra = faults[i] == "truncated"
                if role[:1] in NEXT[place]:
                    heapq.heappush(todo, (cost + extra, audit + "K", i + 1, role[:1], (*kept, f"{role}:{text}")))
                for initial, name in (("u", "user"), ("a", "assistant")):
                    if initial in NEXT[place]:
                        heapq.heappush(todo, (cost + 2 + extra, audit + "R", i + 1, initial, (*kept, f"{name}:{text}")))


def brute(data):
    out = []
    for conv, rows in fates(data).items():
        seen, faults = set(), []
        for _, role, text in rows:
            body = text.strip(WHITE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        n = Counter(faults)
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, kept = cheapest(rows, faults)
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n=150):
    rng = random.Random(seed)
    data = []
    for conv in range(n):
        length = rng.choice((1, 1, 2, 3, 4, 6, 9, 14))
        for turn in range(length):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None, "Uncle", "assist"))
            if rng.random() < 0.6:
                role = ("user", "assistant")[turn % 2]
            text = rng.choice(("Yes.", "No", "Why?  \n", " \t", "", None, f"word {turn}!", f"é {rng.randrange(5)}", "a.b\x1c", "x.\x85"))
            data.append((conv, turn * rng.choice((1, 1, 1, 2)), role, text))
    data += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (n, None, "user", "A."), (n, None, None, None), (n + 1, -3, "user", "B."), (n + 1, 5, "user", "B.")]
    data += data[:20]
    rng.shuffle(data)
    return data


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(4)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_search(spark, tmp_path):
    data = conversations(1)
    table(spark, data).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_turn_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = brute(data)
    assert found(got) == want
    assert {a for r in want for a in r[7]} == set("DIKR") and any(r[7] == "" for r in want)


def test_small_batches_spills_and_clashing_columns(spark, monkeypatch):
    data = conversations(2, 40) + [(7, 1000 + i, ("user", "assistant", "user")[i % 3], f"t{i}" + "." * (i % 2)) for i in range(4_000)]
    df = table(spark, data)
    for name in ("phase", "place", "kind", "fault", "conv", "same", "at", "copy", "fate"):
        df = df.selectExpr("*", f"'x' AS {name}")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = found(turn_repair.repair_report(turn_repair.damaged(df)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(data)


def test_spilled_backpointers(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(turn_repair, "HELD_BYTES", 100)
    monkeypatch.setattr(turn_repair, "READ_BYTES", 64)
    rng = random.Random(4)
    rows = [(i, rng.choice(("user", "assistant", "system")), f"m{i}.") for i in range(1_000)]
    frame = pd.DataFrame({"conv": "c1", "role": [r[1] for r in rows], "text": [r[2] for r in rows], "initial": [r[1][0] for r in rows], "kind": "", "fault": 0, "has_turn": True, "turn": [r[0] for r in rows]})
    back, forth = frame.iloc[::-1].assign(phase=1), frame.assign(phase=2)
    whole = pd.concat([back, forth])
    (got,) = pd.concat(turn_repair._repair(False)(whole.iloc[i : i + 33] for i in range(0, len(whole), 33))).itertuples(index=False)
    cost, audit, kept = cheapest(rows, [""] * len(rows))
    assert (got.cost, got.audit, got.repaired_sha256) == (cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def test_turns_are_the_report_s(spark):
    data = conversations(3)
    damaged = turn_repair.damaged(table(spark, data))
    steps = defaultdict(list)
    for r in turn_repair.repaired_turns(damaged).collect():
        steps[r.conv_id].append(r)
    for r in turn_repair.repair_report(damaged).collect():
        own = sorted(steps[r.conv_id], key=lambda s: s.step)
        assert "".join(s.edit for s in own) == r.audit
        text = "\n".join(f"{s.role}:{s.text}" for s in own if s.edit != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == r.repaired_sha256


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair_report(turn_repair.damaged(none)).count() == 0
    assert turn_repair.repaired_turns(none).count() == 0
