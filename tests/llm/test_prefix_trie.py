import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from meshwork.llm import oracles, prefix_trie

SF = "/root/testdata/sf0.01"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(sequences):
    """The trie by a dictionary of prefixes; ``sequences`` is {conv_id: [(role, text)]}."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, convs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(convs) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(sequences[c]) == len(p)))
        above = min(members[p[:-1]]) if p else None
        out.append((min(convs), len(p), above, len(convs), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def plain_rebuilt(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    taken = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: taken[c]] + own[c][taken[c] :] for c in own}


def found(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=lambda r: r[:2])


def steps(spark, sequences):
    rows = [(c, [(r, t) for r, t in turns]) for c, turns in sequences.items()]
    df = spark.createDataFrame(rows, "conv_id long, turns array<struct<role:string,text:string>>")
    named = F.transform("turns", lambda t: F.struct(prefix_trie.turn_name(t["role"], t["text"]).alias("name"), F.octet_length(t["text"]).cast("long").alias("size")))
    return df.select("conv_id", named.alias("steps"))


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    theirs = sorted(con.execute(f"select {', '.join(NAMES)} from ({oracles.TRIE})").fetchall(), key=lambda r: r[:2])
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    ours = found(prefix_trie.op13_prefix_trie(spark, SF))
    assert ours == plain(plain_rebuilt(rows))
    assert ours == theirs


@pytest.mark.parametrize("ranges", [1, 4, 23])
def test_ranges_share_paths(spark, ranges):
    rng = random.Random(ranges)
    turn = lambda n: [("user" if k % 2 else "assistant", f"é{rng.randrange(2)}") for k in range(n)]
    common = turn(90)
    sequences = {}
    for c in rng.sample(range(1000), 300):
        kind = rng.randrange(6)
        sequences[c] = [turn(rng.randrange(9)), common[: rng.randrange(91)], common[:66] + turn(rng.randrange(7)), [], common, turn(3)][kind]
    # one conversation has a third of all members
    sequences |= {c: common[:5] for c in range(1000, 1150)}
    assert found(prefix_trie.prefix_trie(steps(spark, sequences), ranges)) == plain(sequences)


def test_ids_of_a_common_conversation_meet_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    sequences = {c: [("user", "hello")] for c in range(500)} | {c: [("user", "hello"), ("assistant", "hi")] for c in range(-20, 0)}
    assert found(prefix_trie.prefix_trie(steps(spark, sequences), 3)) == plain(sequences)


def test_odd_rows(spark):
    rows = [(c, t, random.Random(c * 31 + t).choice(["user", None, ""]), random.Random(c + t).choice([None, "", "a", "b"])) for c in range(0, 40) for t in range(c % 7)]
    rows += [(10, None, "user", "first"), (None, 0, "user", "lost"), (3, 50, "user", "x" * 1_000_000), (8, 2**40, "a:b", "c"), (9, 2**40, "a", ":bc"), (-7, 0, "user", "below")]
    random.Random(1).shuffle(rows)
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema).repartition(5).withColumn("steps", F.lit(1)).withColumn("key", F.lit("x"))
    # Python's remainder of negative ids differs
    wanted = plain_rebuilt([r for r in rows if r[0] != -7])
    wanted[-7] = [("user", "below")][zlib.crc32(b"-7") % 9 :]
    assert found(prefix_trie.prefix_trie(prefix_trie.rebuilt(df))) == plain(wanted)
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame([], schema))).count() == 0


def test_repeated_rows_are_turns_of_their_own(spark):
    df = spark.createDataFrame([(5, 0, "user", "x")] * 3, "conv_id long, turn long, role string, text string")
    assert max(r.depth for r in prefix_trie.prefix_trie(prefix_trie.sequences(df)).collect()) == 3
