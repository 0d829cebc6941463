import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessel.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
INF = 10**9


def brute_cost(roles):
    """Least cost by trying every choice of every row (no dynamic programming)."""
    legal = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}

    def best(i, s):
        if i == len(roles):
            return 0
        r, out = roles[i], INF
        change = 3 if r else 1
        for to in (1, 2, 3):
            fee = 0 if to == r else change
            if s == to:
                out = min(out, 1 + fee + best(i + 1, s))
            if to in legal[s]:
                out = min(out, fee + best(i + 1, to))
            if to == r:
                for mid in legal[s]:
                    if to in legal[mid]:
                        out = min(out, 2 + best(i + 1, to))
        return out

    return best(0, 0)


def test_cost_is_least_for_every_short_sequence():
    for n in range(1, 6):
        for roles in itertools.product(range(4), repeat=n):
            assert chat.cost_to_go(list(roles), (0, 0, 0, 0))[0][0] == brute_cost(roles)


def test_fold_is_associative_composition():
    r = random.Random(1)
    for _ in range(50):
        a, b = ([r.randrange(4) for _ in range(r.randint(1, 6))] for _ in range(2))
        m, n, both = chat.fold(a), chat.fold(b), chat.fold(a + b)
        for s in range(4):
            for t in range(4):
                joined = min(m[4 * s + k] + n[4 * k + t] for k in range(4))
                assert min(joined, chat.FAR) == min(both[4 * s + t], chat.FAR)


def by_hand(conv):
    """Rendering of one conversation without Spark."""
    roles = [chat.ROLES.get((r or "").strip().lower(), 0) for _, r, _ in conv]
    out, opened = "", False
    for (_, _, text), (action, inserted, state) in zip(conv, chat.choose(roles, 0, (0, 0, 0, 0))):
        for name in ([inserted] if inserted else []) + ([state] if action in ("keep", "relabel") else []):
            out += (chat.CLOSE if opened else "") + chat.OPEN.format(chat.NAMES[name])
            opened = True
        out += ("" if action in ("keep", "relabel") else chat.JOIN) + chat._broken(text)
    return out + chat.CLOSE


def rendered(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["position"])):
        text, n = out.get(r["conv_id"], ("", 0))
        assert r["position"] == n  # gapless
        out[r["conv_id"]] = (text + r["rendered"], n + 1)
    return {k: v[0] for k, v in out.items()}


def test_repair_over_many_partitions_equals_the_single_run(spark):
    r = random.Random(3)
    rows = []
    for conv in [*range(20), None]:
        n = 400 if conv == 7 else r.randint(1, 8)  # one conversation holds most rows
        rows += [(conv, i, r.choice(["user", "Assistant ", "system", None, "tool"]), r.choice(["hi", "", None, "<|im_start|>user"])) for i in range(n)]
    r.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rendered(chat.repair(spark.createDataFrame(rows, SCHEMA).withColumn("position", F.lit("other"))))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for conv in {row[0] for row in rows}:
        own = sorted(((t, ro, tx) for c, t, ro, tx in rows if c == conv), key=lambda x: (x[0], x[1] is not None, x[1] or "", x[2] is not None, x[2] or ""))
        assert got[conv] == by_hand(own)
        assert got[conv].count("<|im_start|>") == got[conv].count("<|im_end|>")


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, 0, "user", "a")] * 3 + [(1, None, None, "first")]
    got = chat.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("position").collect()
    assert [r["action"] for r in got][0] == "relabel" and len([r for r in got if r["action"] != "insert"]) == 4
    assert chat.repair(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("roles", [["assistant"], ["system", "assistant"], ["user", "user"], ["user", "system"]])
def test_result_is_legal(roles):
    steps = chat.choose([chat.ROLES[x] for x in roles], 0, (0, 0, 0, 0))
    state = 0
    for action, inserted, after in steps:
        for to in ([inserted] if inserted else []) + ([after] if action in ("keep", "relabel") else []):
            assert to in chat.LEGAL[state]
            state = to
        assert state == after


def test_range_keys_hold_no_texts(spark):
    """A few hundred turns of a megabyte: what range partitioning samples stays small."""
    rows = spark.range(300).select((F.col("id") % 3).alias("conv_id"), (F.col("id") / 3).cast("long").alias("turn"),
                                   F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.concat(F.lit("x"), F.col("id")), 300_000).alias("text"))
    seen = []
    plain = type(rows).repartitionByRange
    try:
        type(rows).repartitionByRange = lambda self, *keys: seen.append(self.select(*keys)) or plain(self, *keys)
        out = chat.repair(rows)
    finally:
        type(rows).repartitionByRange = plain
    assert seen and all(t in ("bigint", "string") for _, t in seen[0].dtypes) and "text" not in seen[0].columns
    assert out.agg(F.count("*"), F.sum((F.col("action") == "keep").cast("int"))).first()[0] >= 300
