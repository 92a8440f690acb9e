"""Trie of conversations against dictionaries of tuples, parentheses against a stack, SQL, odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tools.check_oracles import compare, duck

import __spark_entry__ as entry
from pagewise.llm import trie

SF = "/root/testdata/sf0.01"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, group=20, share=4):
    """Contract rows of (conv_id, turn, role, text) without ties in turn."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % share
        built[c] = tuple(own.get(c - c % group, [])[:h] + turns[h:])
    members, children, ends = {}, {}, {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
            if d:
                children.setdefault(path[:d - 1], set()).add(path[:d])
        ends.setdefault(path, []).append(c)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, convs in members.items():
        gain = (len(convs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += gain
    return sorted((min(members[n]), len(n), min(members[n[:-1]]) if n else -1, len(members[n]), len(children.get(n, ())),
                   leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest())
                  for n in members)


def listed(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*COLUMNS).collect())


def made(n, seed, turns=12, words=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        length = rng.choice([0, 1, 2, 3, 5, turns])
        path = ["same", "start"][:rng.randint(0, 2)] + [rng.choice("ab") * rng.randint(1, words) for _ in range(length)]
        rows += [(c, t if t else None, rng.choice(["u", "u", "u", None]), " x ".join(x)) for t, x in enumerate(path)]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("block_turns", "shard_places"), [(512, 1 << 18), (512, 12), (3, 1 << 18), (2, 10), (1, 40)])
def test_nodes_against_dictionaries(spark, block_turns, shard_places):
    rows = made(90, block_turns + shard_places)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = listed(trie.savings(df, block_turns=block_turns, shard_places=shard_places))
    assert got == plain(rows)


def test_parentheses_against_a_stack():
    rng = random.Random(1)
    for block in (1, 2, 8, 64):
        for size in (1, 2, 7, 300, 2000):
            bits, depth, opens = [], 0, 0
            while opens < size or depth:
                up = opens < size and (depth == 0 or rng.random() < 0.6)
                bits.append(1 if up else -1)
                depth, opens = depth + bits[-1], opens + up
            stack, want = [], {}
            for i, bit in enumerate(bits):
                if bit == 1:
                    stack.append(i)
                else:
                    want[stack.pop()] = i
            at = np.array(sorted(want))
            got = trie.find_close(np.cumsum(bits), at, block)
            assert got.tolist() == [want[i] for i in at.tolist()]


def test_odd_rows(spark):
    long = [(7, t, "u", f"w{t}") for t in range(40)] + [(8, t, "u", f"w{t}") for t in range(40)] + [(8, 40, "u", None)]
    rows = [(1, None, None, None), (1, 0, "", "one  two\x0bthree"), (2, 5, "u", "x" * 200_000), (None, 0, "u", "lost"),
            (20, 1, "u", "base"), (21, 1, "u", "own"), (23, 1, "u", "own"), (-3, 0, "u", "below"), (9, 2, "u", "퟿ é")]
    odd = spark.createDataFrame([(*r, "k") for r in rows + long], SCHEMA + ", depth string")
    want = plain([r for r in rows + long if r[0] is None or r[0] >= 0] + [])
    got = listed(trie.savings(odd.where("conv_id IS NULL OR conv_id >= 0"), block_turns=16, shard_places=25))
    assert got == want
    assert trie.savings(odd.limit(0)).count() == 0
    # repeated rows are turns of their own, and the result does not depend on the layout
    twice = odd.unionByName(odd.where("conv_id IN (1, 20)"))
    a, b = listed(trie.savings(twice)), listed(trie.savings(twice.repartition(7), block_turns=4, shard_places=9))
    # conversation 0, whose turns 8 would start with, is absent: the first turns of its 41 go
    assert a == b and max(r[1] for r in a) == 41 - zlib.crc32(b"8") % 4
    # all conversations turnless: only the root
    none = spark.createDataFrame([(c, 0, "u", "x") for c in range(1, 40) if c % 20 and zlib.crc32(str(c).encode()) % 4], SCHEMA)
    root = listed(trie.savings(none))
    assert len(root) == 1 and root[0][1:6] == (0, -1, none.count(), 0, 1)


def test_one_hot_conversation_and_many_copies(spark):
    rows = [(0, t, "u", f"turn {t % 7} {t}") for t in range(600)]
    rows += [(c, t, "u", f"copy {t}") for c in range(100, 400) for t in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert listed(trie.savings(df, share=1, block_turns=64, shard_places=100)) == plain(rows, share=1)


def test_table_against_sql(spark):
    got = entry.queries()["op12_trie"](spark, SF)
    assert got.columns == COLUMNS
    want = duck(SF).execute(entry.oracle_sql()["op12_trie"]).df()
    ok, msg = compare("op12", got.toPandas(), want)
    assert ok, msg
    convs = spark.read.parquet(f"{SF}/conversations.parquet")
    assert listed(got) == plain([tuple(r) for r in convs.select("conv_id", "turn", "role", "text").collect()])
