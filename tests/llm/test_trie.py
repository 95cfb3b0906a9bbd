"""The prefix trie against one built node by node in plain Python; running sums against a loop."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docweave.llm import trie
from docweave.llm.common import written
from docweave.llm.running import running

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, place string, h1 string, depth string, chain string"


def turns_of(rows: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    out: dict[int, list] = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    key = lambda t: (t[0], t[1], t[2].encode(), hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest())
    return {c: [t[2:] for t in sorted(ts, key=key)] for c, ts in out.items()}


def rebuilt(convs: dict[int, list]) -> dict[int, list]:
    base = lambda c: c - (c % 20 if c >= 0 else -(-c % 20))
    h = lambda c: zlib.crc32(str(c).encode()) % 4
    return {c: convs.get(base(c), [])[: h(c)] + ts[h(c) :] for c, ts in convs.items()}


def brute(convs: dict[int, list]) -> list[tuple]:
    members: dict[tuple, list[int]] = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids: dict[tuple, list] = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        own = (len(members[node]) - 1) * len(re.findall(r"[^ \x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = own + sum(saved[k] for k in kids[node])
    out = []
    for node, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(node))))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], CONVERSATIONS)


def some() -> list[tuple]:
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a  b", "", None, "c d", "日本 語\t e"])) for c in range(-45, 90) for t in range(rng.randrange(1, 6)) if c % 17]
    rows += [(7, None, "user", "first"), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (7, 0, "user", "other"), (None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(100 + c, t, "user", "same") for c in range(40) for t in range(4)]  # one group of copies
    rows += [(13, 50 + t, "user", f"word{t} " * 3) for t in range(300)]  # a long one
    rows += [(31, 9, "user", "very long " * 50_000)]
    return rows


def test_report(spark):
    rows = some()
    got = sorted((tuple(r) for r in trie.trie_report(frame(spark, rows)).collect()), key=repr)
    assert got == brute(rebuilt(turns_of(rows)))


def test_as_given(spark):
    """A comb, where each conversation leaves the one before it a turn later, and a chain of prefixes."""
    rows = [(c, t, "u", "on" if t < c else f"off {c}") for c in range(60) for t in range(c + 1)] + [(200 + c, t, "v", "step") for c in range(30) for t in range(c)]
    df = frame(spark, rows)
    got = trie.prefix_trie(df)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(turns_of(rows))
    last = {(r.conv_id, r.depth): (r.role, r.text) for r in trie.with_turns(got, df).collect()}
    convs = turns_of(rows)
    assert all(turn == (convs[c][d - 1] if d else (None, None)) for (c, d), turn in last.items())


def test_empty(spark):
    assert trie.trie_report(frame(spark, [])).collect() == []
    assert trie.trie_report(frame(spark, [(None, 1, "a", "b")])).collect() == []


@pytest.mark.parametrize("bits", [None, 10])
def test_running_cuts_a_key_into_ranges(spark, bits):
    rng = random.Random(1)
    rows = [(7 if k % 3 else k % 40, k, rng.randrange(1 << 9)) for k in range(6000)]
    df, _ = written(spark.createDataFrame(rows, "k bigint, o bigint, x bigint").repartition(5), "in")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out, path = running(df, "k", [F.desc("o")], ["x"], bits=bits)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(path).where("k = 7").select("range_no").distinct().count() > 1
    sums: dict = defaultdict(lambda: [0, 0])
    want = []
    for k, o, x in sorted(rows, key=lambda r: (r[0], -r[1])):
        sums[k][0] += 1
        sums[k][1] += x
        want.append((k, o, x, sums[k][0], sums[k][1] % (1 << bits) if bits else sums[k][1]))
    assert sorted(map(tuple, out.collect())) == sorted(want)
