"""Near-duplicates, line dedup and their edge cases against brute force."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from logsieve.llm import components, linededup, near

DOC = "doc_id long, text string, source string, n_shingles long, places string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", 7, "x") for i, t in rows], DOC)


def groups(rows, n, percent):
    """component of each id, by comparing every pair."""
    sets, root = {}, {i: i for i, _ in rows}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=1, chain=True):
    """Texts with exact copies, light edits, chains of edits and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    shared = [word() for _ in range(30)]
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([1, 2, 3, 40, 60]))]
        if rng.random() < 0.4:
            base += shared
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else "\t".join(copy))
            base = copy if chain else base
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(near, "LEAF", 8)
    monkeypatch.setattr(near, "CHUNK", 400)


def test_near_equals_brute_force(spark):
    rows = [*corpus(), (900, None), (901, ""), (902, " \n\t "), (903, None)]
    got = {r.doc_id: r for r in near.near_duplicates(table(spark, rows), 3, 85).collect()}
    want = groups(rows, 3, 85)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_in_small_nodes_and_chunks(spark, small):
    """Branched nodes, clumps of several chunks, and parts that only a member links."""
    rows = corpus(seed=2)
    got = near.near_duplicates(table(spark, rows), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups(rows, 3, 85)


def test_one_large_group(spark, small):
    rng = random.Random(3)
    base = [f"w{rng.randrange(1000)}" for _ in range(60)]
    rows = []
    for i in range(60):
        copy = list(base)
        copy[i] = "other"
        rows.append((i, " ".join(copy)))
    got = near.near_duplicates(table(spark, rows), 3, 85).collect()
    assert {r.component_id for r in got} == {0}


@pytest.mark.parametrize("leaf", [1000, 3])
def test_planted_pairs_at_the_threshold_are_found(spark, monkeypatch, leaf):
    """Pairs that share 40 of 50 words; with small leaves most nodes branch."""
    monkeypatch.setattr(near, "LEAF", leaf)
    rows = []
    for k in range(300):
        w = [f"p{k}w{j}" for j in range(50)]
        rows += [(2 * k, " ".join(w[:45])), (2 * k + 1, " ".join([*w[:40], *w[45:]]))]
    got = {r.doc_id: r.component_id for r in near.near_duplicates(table(spark, rows), 1, 80).collect()}
    found = sum(got[2 * k + 1] == 2 * k for k in range(300))
    assert found >= 298 and all(got[i] in (i, i - 1) for i in got)


def test_links_at_the_exact_threshold():
    import numpy as np

    a, b, c = np.arange(100, dtype=np.uint64), np.arange(15, 100, dtype=np.uint64), np.arange(16, 100, dtype=np.uint64)
    assert near._linked([a, b], 85) == [(0, 1)]
    assert near._linked([a, c], 85) == []


def test_keep_one_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (1, text), (1, text), (None, text), (None, None), (4, None), (5, "")]
    got = near.keep_one(table(spark, rows))
    assert got.columns == ["doc_id", "text", "source", "n_shingles", "places"]
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == sorted([(1, text), (-1, text), (-1, ""), (4, ""), (5, "")])
    flagged = near.near_duplicates(table(spark, rows)).collect()
    assert all(r.component_id is None and r.kept for r in flagged if r.doc_id is None)


def test_near_empty_table(spark):
    assert near.near_duplicates(table(spark, [])).count() == 0
    assert near.keep_one(table(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = components.components(edges.unionByName(spark.createDataFrame([(901, 900), (902, 900)], "a long, b long")))
    roots = {r.node: r.root for r in got.collect()}
    assert roots == {i: 0 for i in range(1, 300)} | {901: 900, 902: 900}


LONG = " ".join(f"p{i}" for i in range(60))


def brute_lines(rows):
    seen = collections.defaultdict(set)
    key = lambda i, t: (-1 if i is None else i, t or "")
    for i, t in rows:
        for place, (c, n, w) in enumerate(linededup.chunks(t or "")):
            if linededup.eligible(n, w):
                seen[c].add((*key(i, t), place))
    gone = collections.defaultdict(set)
    for places in seen.values():
        for i, t, place in sorted(places)[1:]:
            gone[i, t].add(place)
    return [
        (i, "\n".join(c for k, (c, _, _) in enumerate(linededup.chunks(t)) if k not in gone[key(i, t)]) if gone[key(i, t)] else t)
        for i, t in rows
    ]


def line_rows():
    rng = random.Random(5)
    block = [f"shared line {k} of the block" for k in range(8)]
    rows = []
    for i in range(40):
        lines = [f"own {i} {k} {rng.random()}" for k in range(rng.randrange(1, 8))]
        at = rng.randrange(len(lines) + 1)
        if i % 3 == 0:
            lines[at:at] = block
        if i % 4 == 0:
            lines.insert(at, LONG)
        rows.append((i, "\n".join(lines)))
    return [*rows, (100, None), (101, ""), (102, "\n\n\n\n"), (103, "\n\n\n\n"), (104, LONG), (104, LONG), (None, LONG)]


def test_line_dedup_equals_brute_force(spark):
    rows = line_rows()
    got = linededup.dedup(table(spark, rows))
    assert got.columns == ["doc_id", "text", "source", "n_shingles", "n_lines", "removed_lines", "removed_chunks"]
    want = brute_lines(rows)
    as_key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=as_key) == sorted(want, key=as_key)
    holders = [t for _, t in want if t and LONG in t]
    assert holders == [LONG]  # only the document without an id, which comes first, still has it


def brute_runs(rows):
    """Lines left of each text, by looking at every run of lines of every text."""
    first, gone = {}, collections.defaultdict(set)
    for i, t in sorted(rows):
        lines = t.split("\n")
        for a in range(len(lines)):
            for z in range(a + 1, len(lines) + 1):
                run, n = lines[a:z], len(" ".join(lines[a:z]).split())
                edges = (run[:2], run[-2:])
                if n and (z - a > 1 or n >= 50) and all(len(e) < 2 or any(x.split() for x in e) for e in edges):
                    if first.setdefault(tuple(run), (i, a)) != (i, a):
                        gone[i].update(range(a, z))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_line_dedup_equals_brute_force_on_all_runs(spark):
    """Passages of 2 to 6 lines of 27 words between other lines, and few lines in any order with blank ones."""
    rng = random.Random(8)
    passages = [["\n".join(f"passage{k} " + " ".join(f"x{rng.randrange(900)}" for _ in range(26)) for _ in range(n))] for k, n in enumerate([2, 2, 3, 4, 5, 6])]
    rows = []
    for i in range(60):
        own = lambda: [f"own {rng.random()}" for _ in range(rng.randrange(4))]
        few = [rng.choice(["a", "b c", "d", "", "", " ", LONG]) for _ in range(rng.randrange(9))]
        rows.append((i, "\n".join([*own(), *rng.choice(passages), *own(), *few])))
    got = {r.doc_id: r for r in linededup.dedup(table(spark, rows)).collect()}
    assert {i: r.text for i, r in got.items()} == brute_runs(rows)
    assert sum("passage0 " in r.text for r in got.values()) == 1


def test_boundaries_do_not_shift():
    body = [f"line {k}" for k in range(30)]
    a = {c for c, _, _ in linededup.chunks("\n".join(body))}
    b = {c for c, _, _ in linededup.chunks("\n".join(["new", "lines", "in front", *body]))}
    assert len(a - b) <= 2
    assert "\n".join(c for c, _, _ in linededup.chunks("x\n\ny\n")) == "x\n\ny\n"


def test_chunk_boundaries_follow_the_lines():
    """Lines in front or in the middle move the boundaries next to them only."""
    rng = random.Random(9)
    for _ in range(20):
        body = [f"line {rng.random()}" for _ in range(200)]
        at = rng.randrange(200)
        longer = [*[f"new {rng.random()}" for _ in range(rng.randrange(1, 5))], *body[:at], "put in", *body[at:]]
        a, b = ({c for c, _, _ in linededup.sections("\n".join(x))} for x in (body, longer))
        assert len(a - b) <= 4 and 30 < len(a) < 80
        ends = linededup.boundaries(body)
        assert ends == sorted(set(ends)) and ends[-1] == 200


def test_most_of_a_repeated_passage_goes_as_chunks(spark):
    rng = random.Random(10)
    passage = [f"a passage of many lines, here number {k}" for k in range(60)]
    rows = [(i, "\n".join([f"own {rng.random()}", *passage, f"own {rng.random()}"])) for i in range(5)]
    docs = table(spark, rows).selectExpr("doc_id", "text", "xxhash64(text) as text_hash")
    seen = linededup.occurrences(docs)
    whole = linededup.repeats(docs, seen.where("kind = 0"), linededup.CHUNK).collect()
    lines = sum(z - a for r in whole for _, a, z in [linededup.sections(rows[r.doc_id][1])[r.place]])
    assert {r.doc_id for r in whole} == {1, 2, 3, 4} and lines > 4 * 40
    left = {r.doc_id: r.text for r in linededup.dedup(table(spark, rows)).collect()}
    assert left == {i: t if i == 0 else "\n".join([t.split("\n")[0], t.split("\n")[-1]]) for i, t in rows} == brute_runs(rows)


def test_columns_named_like_helpers_stay(spark):
    rows = line_rows()
    names = ["_d", "_h", "_p", "text_hash", "rest", "kind", "place", "inside", "hash", "chunk", "_one"]
    df = table(spark, rows).select("doc_id", "text", *[F.concat(F.lit(n), F.coalesce("doc_id", F.lit(-1)).cast("string")).alias(n) for n in names])
    got = linededup.dedup(df)
    assert got.columns == [*df.columns, "n_lines", "removed_lines", "removed_chunks"]
    plain = sorted((r.doc_id or -1, r.text or "") for r in linededup.dedup(table(spark, rows)).collect())
    found = got.collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in found) == plain
    assert all(r[n] == f"{n}{-1 if r.doc_id is None else r.doc_id}" for r in found for n in names)


def test_chunks_with_one_hash_are_compared_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(linededup, "_hash", lambda chunk: 1)
    other = LONG.replace("p1 ", "q1 ")
    rows = [(1, LONG), (2, other), (3, LONG), (4, LONG + " more")]
    got = {r.doc_id: r.text for r in linededup.dedup(table(spark, rows)).collect()}
    assert got == {1: LONG, 2: other, 3: "", 4: LONG + " more"}


def test_line_dedup_empty_table(spark):
    assert linededup.dedup(table(spark, [])).count() == 0
