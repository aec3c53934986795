"""Prefix tries, Merkle manifests and line dedup against plain Python, with nulls, ties, repeated rows, long texts and clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollspark.llm.line_dedup import LineRuns, dedup_lines, line_digest, line_hashes
from rollspark.llm.merkle import merkle_manifest
from rollspark.llm.perfect_hash import SlotTable
from rollspark.llm.prefix_trie import prefix_trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hub string, g string, node string, rank int, item string, doc long, batch int"
EXTRA = ("x", "y", "z", 1, "i", 5, 6)
CONVS = "conv_id long, turn long, role string, text string, c long, d long, d1 long, level int, shard int"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def crc(x):
    return zlib.crc32(("" if x is None else str(x)).encode())


def got(df):
    return Counter(tuple(r) for r in df.collect())


# --- 11: prefix trie ---


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        a, b = rng.integers(-(2**63), 2**63, (2, n), dtype=np.int64)
        a[: n // 2] = 7  # halves alone do not tell them apart
        table = SlotTable(a, b)
        assert sorted(table.slots(a, b).tolist()) == list(range(n))
        assert (table.slots(a, b + 1) == -1).all()
    with pytest.raises(ValueError):
        SlotTable(np.array([1, 1]), np.array([2, 2]))


def brute_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, own in turns.items():
        h = crc(c) % 4
        built[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = Counter(), Counter()
    for p, ms in members.items():
        own = (len(ms) - 1) * (len(p[-1][1].encode().split()) if p else 0)
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += own
    return Counter(
        (ms[0], len(p), members[p[:-1]][0] if p else None, len(ms), len(kids[p]), leaves[p], saved[p], sha(",".join(str(c) for c in ms if len(built[c]) == len(p))))
        for p, ms in members.items()
    )


def conversations():
    rng = np.random.default_rng(4)
    rows = []
    for c in range(400):
        hot = c % 3 == 0  # a third starts alike
        for t in range(int(rng.integers(1, 6))):
            text = "hello there you" if hot and t < 2 else " ".join(rng.choice(["a", "bb", "c\td", "\x0bé", ""], int(rng.integers(0, 5))))
            rows.append((c if c % 7 else c * 1000, t, ["user", "assistant", None][t % 2 if t else 0], text if t % 5 else text or None))
    rows += [(5000, t, "user", f"long {t} x") for t in range(300)] + [(5001, t, "user", f"long {t} x") for t in range(290)]
    rows += [(6000 + k, t, "user", "copy of one") for k in range(60) for t in range(3)]
    rows += [(7001, None, None, None), (7001, None, None, None), (7002, 3, "", ""), (7003, None, "user", "first"), (7003, -1, "user", "second"), (None, 1, "user", "nobody's")]
    return rows


@pytest.mark.parametrize("given", [{}, {"subtree": 16, "factor": 3, "least_shards": 1000}, {"subtree": 40, "least_shards": 1000, "broadcast_rows": 0, "chunk": 7}])
def test_prefix_trie(spark, given):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], CONVS)
    assert got(prefix_trie(df, **given)) == brute_trie(rows)


def test_prefix_trie_without_rows_and_one_turn(spark):
    assert prefix_trie(spark.createDataFrame([], CONVS)).count() == 0
    one = [(3, 0, "user", "hi"), (21, 1, None, "a b")]
    assert got(prefix_trie(spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in one], CONVS))) == brute_trie(one)


# --- 12: Merkle manifest ---


def brute_manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(doc_id, text, lang, source, n_chars):
        return sha("".join(map(field, (doc_id, source, lang, n_chars, text))))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def flanks(levels, i):
        for level in levels[:-1]:
            start = i // 8 * 8
            yield "".join(level[start:i]), "".join(level[i + 1 : start + 8])
            i //= 8

    by = defaultdict(list)
    for r in rows:
        bad = r[1] and crc(r[0]) % 3 == 0 and r[1].encode().lower().decode()
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), leaf(r[0], bad, *r[2:]) if bad else leaf(*r)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([y[2] for y in sorted(by[x])]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = Counter()
    for k, x in enumerate(langs):
        for i, (some, doc_id, own, found) in enumerate(sorted(by[x])):
            path = [*flanks(trees[x], i), *flanks(top, k)]
            for left, right in path:
                found = sha(left + found + right)
            out[(doc_id if some else None, own, trees[x][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), found, found == top[-1][0])] += 1
    return out


def records(n):
    rows = [(i, ["Some Text", None, "", "lower only", "É" * 50][i % 5], "en" if i % 3 == 0 else ["fr", "", None, "zz", "é"][i % 5], [None, "", "a:1"][i % 3], i if i % 4 else None) for i in range(n)]
    return rows + [(f * 10, f"Doc {f}", f"l{f:02d}", "s", 1) for f in range(20)] if n else rows


@pytest.mark.parametrize("n", [1, 8, 700, 5000])
def test_manifest(spark, n):
    rows = records(n)
    if n == 700:  # a third alike, keys that are null, a long text
        rows += [(7, "Same Row", "en", "s", 3)] * 350 + [(None, "A", "en", None, None), (None, None, None, None, None), (9, "Word " * 50_000, "en", "s", 1)]
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)
    assert got(merkle_manifest(df)) == brute_manifest(rows)


def test_manifest_of_nothing_and_other_changes(spark):
    assert merkle_manifest(spark.createDataFrame([], DOCS)).count() == 0
    one = [(4, "Abc", "en", "s", 3)]
    df = spark.createDataFrame([(*r, *EXTRA) for r in one], DOCS)
    r = merkle_manifest(df).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == sha("")
    df = spark.createDataFrame([(*r, *EXTRA) for r in records(40)], DOCS)
    assert merkle_manifest(df, tampered=F.col("text")).where("not verified").count() == 0
    assert merkle_manifest(df, tampered=F.concat("text", F.lit("!"))).where("verified").count() == sum(r[1] is None for r in records(40))


# --- 13: line dedup ---


def brute_lines(rows, chars=20, docs=3):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)
        return k if len(k) >= chars else None

    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if key(x) is not None:
                held[key(x)].add(i)
    last = {k: max(x for x in ids if x is not None) for k, ids in held.items() if len(ids) >= docs}
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if last.get(key(x), i) == i]
        out[(i, len(lines), len(lines) - len(left), sha("\n".join(left)))] += 1
    return out


def lines():
    rng = np.random.default_rng(8)
    pool = [f"This is the shared line number {i}" for i in range(30)] + ["short", "", "   ", "é" * 19, "é" * 20, "\x85" + "nbsp is no blank here \xa0", "x" * 20, " \t" + "X" * 20 + "\r", "漢" * 25]
    rows = [(int(i), "\n".join(str(x) for x in rng.choice(pool, int(rng.integers(1, 9)))) + f"\nonly in the document {i} and no other") for i in rng.permutation(300)]
    rows += [(1000 + i, "A Footer That A Third Of All Documents Hold") for i in range(150)]
    rows += [(5, rows[0][1])] * 3 + [(None, "This is the shared line number 3"), (None, None), (2000, None), (2001, ""), (2002, "\n\n"), (2003, "z" * 100_000 + "\n" + "This is the shared line number 4  \n" * 500)]
    rows += [(3000, "held by this one document twice"), (3000, "held by this one document twice"), (3001, "held by this one document twice")]
    return rows


@pytest.mark.parametrize("given", [{}, {"broadcast_lines": 0}, {"batches": 13, "fanout": 2}, {"batches": 1}])
def test_line_dedup(spark, given):
    rows = lines()
    df = spark.createDataFrame([(i, t, None, None, None, *EXTRA) for i, t in rows], DOCS)
    assert got(line_digest(dedup_lines(df, **given))) == brute_lines(rows)


def test_line_dedup_of_nothing(spark):
    assert dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_are_compacted_and_know_what_is_new(spark):
    runs = LineRuns(spark, fanout=3)
    df = spark.createDataFrame([(100 - b, f"a line that all of the batches hold\nand one more of batch {b} alone") for b in range(10)], "doc long, text string")
    for b in range(10):
        run = runs.add(line_hashes(df.where(F.col("doc") == 100 - b)))
        assert run.where("owner is not null").count() == (2 if b == 0 else 1)
        assert all(len(level) < 3 for level in runs.levels)
    assert len(runs.levels) == 3
    assert sorted(tuple(r) for r in runs.merged().select("docs", "owner").collect()) == [(1, 91 + b) for b in range(10)] + [(10, 100)]
