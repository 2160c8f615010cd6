import hashlib
import random
import zlib

import pytest

from spectrail.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """The contract, read plainly."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        new = (*own.get(c - c % 100, [])[:h], *turns[h:])
        for d in range(len(new) + 1):
            members.setdefault(new[:d], []).append(c)
        ends.setdefault(new, []).append(c)
    leaves, kept, kids = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for v in members:
        if v:
            kids[v[:-1]] += 1
    for v, m in members.items():
        for d in range(len(v) + 1):
            leaves[v[:d]] += kids[v] == 0
            kept[v[:d]] += (len(m) - 1) * len(v[-1][1]) if v else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(v), min(members[v[:-1]]) if v else None, len(m), kids[v], leaves[v], kept[v], sha(ends.get(v, []))) for v, m in members.items())


def made(seed, convs=60, copies=12):
    """Few different turns, so many prefixes are shared; a hot conversation, a hot first turn, long ones and short ones."""
    rng, rows = random.Random(seed), []
    long = [("user", f"t{rng.randrange(3)}") for _ in range(23)]
    for c in sorted({*rng.sample(range(400), convs), 0, 100, 300}):
        kind = rng.randrange(5)
        turns = long[: rng.randrange(24)] + [("user", "end")] * rng.randrange(2) if kind == 0 else [(rng.choice(["user", "assistant", None]), rng.choice(["", "aé", "bbb", None])) for _ in range(rng.randrange(1, 9))]
        rows += [(c, i if i else None, *t) for i, t in enumerate(turns)]
    for c in range(500, 500 + copies):
        rows += [(c, i, *t) for i, t in enumerate(long)]
    rows.append((None, 1, "user", "nobody's"))
    rng.shuffle(rows)
    return rows


def nodes(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=lambda r: r[:2])


@pytest.mark.parametrize(("seed", "segment", "rows"), [(1, 64, 1000), (2, 64, 5), (3, 3, 1000), (4, 4, 7), (5, 1, 3)])
def test_equals_brute_force_for_any_segment_and_shard(spark, seed, segment, rows):
    table = made(seed)
    found = trie.prefix_trie(spark.createDataFrame(table, SCHEMA).repartition(3), segment, rows)
    assert nodes(found) == brute(table)


def test_odd_rows(spark):
    text = "ø" * 200_000
    table = [(7, None, None, None), (7, 1, "user", text), (-5, 0, "user", text), (8, 1, "a", ""), (8, 1, "a", "")]
    df = spark.createDataFrame([(*r, 1, "x") for r in table], SCHEMA + ", N_CONVS int, part string")
    found = trie.prefix_trie(df)
    assert nodes(found) == brute(table)
    assert found.dtypes[0] == ("conv_id", "bigint")
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_pieces_of_a_conversation_over_several_tasks(spark):
    table = [(1, t // 3, "user", f"x{t}") for t in range(50)] + [(2, 0, "user", "same")] * 30
    pieces = trie.ordered_turns(spark.createDataFrame(table, SCHEMA), 10).collect()
    assert max(len(r["turns"]) for r in pieces) <= 20
    for c, n in ((1, 50), (2, 30)):
        own = sorted((r["place"], len(r["turns"])) for r in pieces if r["conv_id"] == c)
        assert [p for p, _ in own] == [sum(m for _, m in own[:i]) for i in range(len(own))] and sum(m for _, m in own) == n


def test_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert nodes(trie.op11_trie(spark, "/root/testdata/sf0.01")) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
