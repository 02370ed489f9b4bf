"""Conversation prefix trie, token counts and embedding whitening against plain code."""

import collections
import hashlib
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logsieve.llm import prefixtrie, tokencount, whitening

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CHAT = "conv_id long, turn long, role string, text string"


def plain_words(text):
    return len(text.encode().split())


def brute_trie(rows):
    chats = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            chats[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()[:16], text or ""))
    for turns in chats.values():
        turns.sort()
    rebuilt = {}
    for c, turns in chats.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = chats.get(c - c % 20, [])
        rebuilt[c] = [(t[2], t[4]) for t in [*base[:h], *turns[h:]]]
    members = collections.defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * (plain_words(k[-1][1]) if k else 0)
    return sorted(
        (
            m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k],
            hashlib.sha256(",".join(str(c) for c in m if len(rebuilt[c]) == len(k)).encode()).hexdigest(),
        )
        for k, m in members.items()
    )


def chats(seed, n=400, most=9, vocabulary=3):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randrange(0, most)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "", None, "c", "d\x0be f"][:vocabulary + 1])))
    rng.shuffle(rows)
    return rows


def by_trie(spark, rows):
    df = spark.createDataFrame([(*r, 7) for r in rows], CHAT + ", depth long")
    return sorted((tuple(r) for r in prefixtrie.trie(df).collect()), key=lambda r: (r[0], r[1], r[2] is not None, r))


@pytest.fixture
def small_ranges(monkeypatch):
    for name, value in (("SEGMENT", 3), ("RANGE", 40), ("NUMBERED", 100), ("STRETCH", 2)):
        monkeypatch.setattr(prefixtrie, name, value)


def test_trie_equals_brute_force(spark):
    rows = chats(1)
    rows += [(5000, None, "user", "first"), (5000, None, "user", "also first"), (5000, 0, "x", "then"), (None, 1, "user", "nobody's")]
    rows += [(5001, t, "user", "a b") for t in range(100)] + rows[:3]
    assert by_trie(spark, rows) == brute_trie(rows)


def test_trie_of_many_ranges(spark, small_ranges):
    rows = chats(2, n=200) + [(4000 + c, t, "user", f"same {t}") for c in range(90) for t in range(4)]  # a third are copies
    rows += [(9000, t, "user", "long") for t in range(60)] + [(9100, t, "user", "long") for t in range(50)]
    assert by_trie(spark, rows) == brute_trie(rows)


def test_trie_of_turnless_and_of_no_conversations(spark):
    # ids whose own turns are all replaced by those of a conversation that isn't there
    empty = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:3]
    rows = [(c, 0, "user", "gone") for c in empty]
    assert by_trie(spark, rows) == brute_trie(rows) and brute_trie(rows)[0][:2] == (empty[0], 0)
    assert by_trie(spark, []) == []
    assert by_trie(spark, [(None, 1, "user", "x")]) == []


def test_range_minima_and_extents():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 64, 100):
        v = rng.integers(0, 5, n)
        v[0] = -1
        table = prefixtrie.Minima(v)
        at = np.repeat(np.arange(n), 5)
        least = np.tile(np.arange(5), n)
        right, left = table.right(at, least), table.left(at, least)
        for i, e, r, z in zip(at, least, right, left):
            assert r == next((k - 1 for k in range(i + 1, n) if v[k] < e), n - 1)
            assert z == next(k for k in range(i, -1, -1) if k == 0 or v[k] < e)
            assert table.least(np.array([z]), np.array([r]))[0] == v[z : r + 1].min()


def texts():
    rng = random.Random(3)
    odd = ["", " ", "\n\n \t x", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "it's we'll I'VE", "x" * 5000, "é日本語 ß😀‍", "՘֋ a", "a\x00b", " " * 500 + "x", "12 345 ½", "�"]
    some = ["".join(rng.choice("ab cdé\n1.!'s語 ") for _ in range(rng.randrange(0, 200))) for _ in range(100)]
    return [None, *odd, *some, "word " * 20000, "x!" * 70000]


def test_token_counts_equal_the_library(spark, monkeypatch):
    library = Tokenizer.from_file(TOKENIZER)
    rows = [(i, t, 5) for i, t in enumerate(texts())]
    rows += [(3, rows[3][1], 5), (None, "no id", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    want = sorted(
        (-1 if i is None else i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, _ in rows
    )
    for frequent, held in ((1 << 16, 2_000_000), (4, 50)):  # the second: nearly all by the join, in many blocks
        monkeypatch.setattr(tokencount, "FREQUENT", frequent)
        monkeypatch.setattr(tokencount, "HELD", held)
        got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in tokencount.count_tokens(df, TOKENIZER).collect())
        assert got == want
    monkeypatch.setattr(tokencount, "key_of", lambda c: F.pmod(F.xxhash64(c), F.lit(40)))  # many pre-tokens share a key
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in tokencount.count_tokens(df, TOKENIZER).collect()) == want
    empty = tokencount.count_tokens(df.where("false"), TOKENIZER)
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_the_cut_knows_every_character_it_is_trusted_with():
    with open(TOKENIZER, encoding="utf-8") as f:
        cutter = tokencount.Cutter(f.read())
    known = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    known = [c for c in known if not regex.match(r"\p{Cn}", c)]
    for probe in ("a{}b", "1{}2", "!{}?", " {}"):
        text = "\n".join(probe.format(c) for c in known)
        assert cutter._by_library(text) == tokencount._CUT.findall(text)


def test_eigenpairs_to_double_precision():
    rng = np.random.default_rng(1)
    for dim, wanted, rank in ((40, 6, 40), (90, 16, 90), (30, 16, 5), (5, 16, 5)):
        x = rng.standard_normal((4 * dim, rank)) @ rng.standard_normal((rank, dim)) if rank < dim else rng.standard_normal((4 * dim, dim))
        x[:, :2] *= 2
        a = x.T @ x / len(x)
        values, u, size = whitening.leading(lambda v, a=a: a @ v, dim, wanted)
        want = np.linalg.eigvalsh(a)[::-1][: len(values)]
        assert len(values) == min(wanted, dim) and np.abs(values - want).max() < 1e-13 * want[0]
        assert np.linalg.norm(a @ u - u * values, axis=0).max() < 1e-12 * want[0] and size.max() < 1e-12 * want[0]
        assert np.abs(u.T @ u - np.eye(len(values))).max() < 1e-13


def test_minres_solves_symmetric_indefinite_systems():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((20, 20))
    a, rhs = a + a.T, rng.standard_normal((20, 3))
    x = whitening.minres(lambda v: a @ v, rhs, steps=200, enough=1e-13)
    assert np.abs(x - np.linalg.solve(a, rhs)).max() < 1e-8


def test_whitening_equals_a_dense_solution(spark):
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((300, 8)) * np.arange(1, 9)).astype(np.float32).tolist()
    bad = [None, [None] * 8, [float("nan")] + [0.0] * 7, [float("inf")] + [0.0] * 7, [1.0], [], [1e30] * 8]
    rows = [(i, v, "x") for i, v in enumerate([*x, *bad, x[0], x[0]])] + [(None, x[1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string")
    got = whitening.whiten(df, wanted=5).collect()
    full = [(i, np.floor(64 * np.array(v)).astype(int) + 1_000_000) for i, v, _ in rows if v in x]
    fit = np.unique([v for _, v in full], axis=0)
    n, s = len(fit), fit.sum(0)
    values, u = np.linalg.eigh(np.cov((fit - s / n).T, bias=True))
    values, u = values[::-1], u[:, ::-1]
    assert len(got) == 5 * len(full) == 5 * 303 and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-12
    of = {}
    for r in got:
        of.setdefault((r.vec_id, r.component), r)
    sign = {}
    for i, v in full:
        for k in range(5):
            r = of[i, k + 1]
            want = (v - s / n) @ u[:, k] / np.sqrt(values[k])
            sign.setdefault(k, np.sign(want) * np.sign(r.whitened))
            assert r.whitened * sign[k] == pytest.approx(want, abs=1e-9)
            assert r.deviation == int(((n * v - s) ** 2).sum()) and r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9)


def test_whitening_without_vectors_or_variance(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert out.collect() == [] and out.columns[0] == "vec_id"
    # two different vectors: one component
    out = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [2.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9)) for r in out) == [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0)]
