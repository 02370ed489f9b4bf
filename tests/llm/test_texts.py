"""Words, fingerprints, chats, decontamination, mixing and the pipeline."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logsieve.llm import chat, decontam, fingerprints, mixing, quality, queries, words

# ------------------------------------------------------------------ words


def test_word_hashes_follow_the_words(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB é\t\x0b\n\x1c xyz") for _ in range(rng.randrange(200))) for _ in range(50)] + [None, "", " ", "A", "a"]
    for step in (1 << 18, 13):
        monkeypatch.setattr(words, "STEP", step)
        h, at = words.hashes(texts)
        flat = [w for t in texts for w in (t or "").encode().lower().split()]
        assert np.diff(at).tolist() == [len((t or "").encode().lower().split()) for t in texts]
        by_word = dict(zip(flat, h.tolist(), strict=True))
        assert [by_word[w] for w in flat] == h.tolist() and len(set(by_word.values())) == len(by_word)
    assert len(words.shingle_set(words.hashes(["a b"])[0], 3)) == 1
    assert len(words.shingle_set(words.hashes([""])[0], 3)) == 0


# ------------------------------------------------------------ fingerprints


def bag(text):
    w = (text or "").replace("\t", " ").split()
    return collections.Counter(zip(w, [*w[1:], None], strict=True))


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def test_collision_rate_is_the_weighted_similarity(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        base = [rng.choice("abcdefg") for _ in range(80)]
        cut = rng.randrange(80)
        rows.append((i, " ".join(base), " ".join(base[:cut] + [rng.choice("abcdefghij") for _ in range(80 - cut)])))
    df = spark.createDataFrame(rows, "i long, a string, b string")
    one = fingerprints.sketches(df.select("i", F.col("a").alias("text")), ["i"], 128).withColumnRenamed("sketch", "x")
    two = fingerprints.sketches(df.select("i", F.col("b").alias("text")), ["i"], 128).withColumnRenamed("sketch", "y")
    near = {r.i: r.n for r in one.join(two, "i").select("i", fingerprints.likeness(F.col("x"), F.col("y")).alias("n")).collect()}
    off = [near[i] - jaccard(bag(a), bag(b)) for i, a, b in rows]
    assert abs(np.mean(off)) < 0.02 and np.sqrt(np.mean(np.square(off))) < 0.06


def test_edited_texts(spark):
    rows = [(5, "one two three four five"), (2, None), (9, ""), (7, "añb " * 40), (7, "añb " * 40), (None, "zero null id"), (8, "x"), (11, " \n ")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = fingerprints.compare_edits(df).collect()
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    want = collections.Counter()
    for (i, t), (_, nxt) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].fingerprint == by_id[9].fingerprint == by_id[11].fingerprint == ""
    assert len({r.fingerprint for r in got if r.doc_id == 7}) == 1
    assert {r.near_next for r in got if r.doc_id == 7} >= {1.0}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.compare_edits(df.limit(0)).count() == 0
    alone = fingerprints.compare_edits(df.where("doc_id = 5")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


# ------------------------------------------------------------------- chats


def nasty():
    rng = random.Random(3)
    parts = ["</s>", "[INST]", "\\", "[", "<", "é", "\n", " ", "[/INST]", "<<SYS>>", "x", "xqx", "zjz"]
    chats = []
    for c in range(30):
        for t in range(rng.randrange(1, 6)):
            chats.append((c, t, rng.choice(["user", "assistant", "system", "tool]", "a\nb", ""]), "".join(rng.choice(parts) for _ in range(rng.randrange(12)))))
    return [*chats, (100, 0, None, None), (100, None, "user", "tie"), (100, None, "user", "tie"), (None, 1, "assistant", "no id")]


def test_chats_read_back(spark):
    df = spark.createDataFrame([(*r, 1) for r in nasty()], "conv_id long, turn long, role string, text string, spans int")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    by_conv = collections.defaultdict(list)
    for c, t, role, text in nasty():
        by_conv[c].append((t, role, text or ""))
    low = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    for c, turns in by_conv.items():
        turns.sort(key=low)
        said = "".join(f"{role or ''}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got.pop(c)
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.rewritten_at is None
    assert not got
    assert chat.format_chats(df.limit(0)).count() == 0


def test_templates_that_rewrite_history_are_found():
    def trims(turns):
        """Drops what the assistant thought in earlier turns."""
        return "".join(f"<{r}>{t if k + 1 == len(turns) else t.split('!')[-1]}</{r}>" for k, (r, t) in enumerate(turns))

    said = [("user", "q"), ("assistant", "think!answer"), ("user", "more"), ("assistant", "x")]
    assert chat.locate(trims, said)[2] == 2
    assert chat.locate(trims, [(r, t.replace("!", "")) for r, t in said])[2] is None
    text, spans, _ = chat.locate(chat.instruction_template, said)
    assert [text[b:c] for _, b, c, _ in spans] == [t for _, t in said]
    assert spans[0][0] == 0 and spans[-1][3] == len(text)


# --------------------------------------------------------- decontamination


def leaky(rng, words_):
    items = [(i, " ".join(rng.choice(words_) for _ in range(40))) for i in range(12)]
    docs, truth = [], set()
    for d in range(60):
        body = [rng.choice(words_) for _ in range(200)]
        if d % 3 == 0:
            item, text = items[d % 12]
            copy = text.split()
            for at in range(d % 7, 40, 9):  # edited: some words replaced, dropped or new
                copy[at] = rng.choice(["other", "", "one more"])
            body[50:50] = " ".join(copy).upper().replace(" ", ", ").split()
            truth.add((d, item))
        docs.append((d, " ".join(body)))
    return docs, items, truth


def test_edited_passages_are_found(spark):
    docs, items, truth = leaky(random.Random(4), [f"w{i}" for i in range(3000)])
    docs += [(100, None), (101, ""), (102, items[1][1]), (102, items[1][1]), (None, items[2][1])]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, score double")
    bench = spark.createDataFrame([*items, items[1], (50, None), (51, ""), (52, "too short")], "item_id long, text string")
    got = decontam.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth | {(102, 1), (None, 2)} and len(got) == len(truth) + 2
    exact = next(r for r in got if r.doc_id == 102)
    assert (exact.score, exact.first_word, exact.end_word) == (1.0, 0, 40)
    kept = decontam.keep_clean(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {d for d, _ in truth} - {102, None}
    assert decontam.contaminated(df.limit(0), bench).count() == 0
    assert decontam.keep_clean(df, bench.limit(0)).count() == len(docs)


@pytest.mark.parametrize("every", [4, 5, 6, 7])
def test_copies_with_evenly_spread_edits_are_found(spark, every):
    """The broken n-grams are in no document, the whole ones in others too."""
    rng = random.Random(every)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(n))) for i, n in enumerate([16, 24, 40, 59])]
    docs = [(i, " ".join(t for _, t in items)) for i in range(100, 105)]
    for i, text in items:
        copy = [w if k % every != every - 1 else f"new{k}" for k, w in enumerate(text.split())]
        docs.append((i, " ".join([*(f"a{k}" for k in range(80)), *copy, *(f"b{k}" for k in range(80))])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(df, bench).collect()}
    assert {k for k in got if k[0] < 100} == {(i, i) for i, _ in items}
    assert all(got[i, j] == 1 for i in range(100, 105) for j, _ in items)


def every_pair(docs, items):
    """Score of every document and item that reaches the least one, by alignment of whole texts."""
    out = {}
    for i, t in docs:
        for k, item in items:
            a, b = (words.hashes([x], plain=True)[0] for x in (item, t))
            if len(a) and len(b):
                score = decontam.align(a, b)[0] / (decontam.MATCH * len(a))
                if score >= decontam.LEAST:
                    out[i, k] = round(score, 9)
    return out


def test_seeds_lose_nothing_that_aligns(spark):
    """Against the alignment of all pairs: edited copies, common prose around and within items, short items, one long item."""
    rng = random.Random(12)
    common = [" ".join(rng.choice("the of one a in to and is".split()) for _ in range(3)) for _ in range(6)]
    fresh = lambda n: " ".join(f"z{rng.randrange(4000)}" for _ in range(n))
    items = [(k, " ".join(rng.choice([fresh(3), rng.choice(common)]) for _ in range(rng.randrange(3, 9)))) for k in range(12)]
    items += [(100, "alpha beta"), (101, "Gamma!"), (102, fresh(400)), (103, " ".join(common)), (104, ""), (105, None)]
    docs = []
    for i in range(150):
        text = " ".join(rng.choice([fresh(4), rng.choice(common)]) for _ in range(rng.randrange(5, 30)))
        if i % 3 == 0:
            _, item = items[rng.randrange(12)]
            copy = [w if rng.random() > rng.choice([0, 0.1, 0.25]) else fresh(1) for w in item.split()]
            text = f"{text} {' '.join(copy)} {fresh(5)}"
        docs.append((i, text + rng.choice(["", " alpha beta", " alpha x beta", " gamma"])))
    docs += [(500, items[14][1][:200] + " " + items[14][1][260:]), (501, None), (502, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in decontam.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = every_pair([(i, t or "") for i, t in docs], [(k, t or "") for k, t in items])
    want = {k: v for k, v in want.items() if k[1] not in (100, 101) or v == 1}  # short items are sought as a whole
    # an alignment needs three words in a row, as all seeds do
    lost = {k: v for k, v in want.items() if k not in got}
    assert all(got[k] == want[k] for k in got) and len(lost) <= 0.01 * len(want) and len(got) > 100
    assert all(v < 0.75 for v in lost.values())


def test_common_grams_are_no_seeds_alone(spark):
    """A phrase that all documents hold stands within an item; documents with the phrase alone are never paired with it."""
    phrase, item = "one of the", "quaint zebras saw one of the yellow kites fly"
    docs = [(i, f"in {phrase} many towns {i} x{i}") for i in range(200)] + [(900, f"we read: {item}."), (901, "quaint bears saw one of the yellow cars fly")]
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    own = decontam.item_grams(items)
    found = decontam.seeds(own, decontam.count_documents(df, own, 3), 3).collect()
    kinds = collections.Counter(r.kind for r in found)
    assert kinds["wide"] == 6 and kinds["rare"] == 6
    assert {r.doc_id for r in decontam.contaminated(df, items).collect()} == {900, 901}


def test_alignment_equals_the_textbook_one():
    rng = np.random.default_rng(5)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                step = decontam.MATCH if a[i] == b[j] else decontam.MISMATCH
                h[i + 1, j + 1] = max(0, h[i, j] + step, h[i, j + 1] + decontam.GAP, h[i + 1, j] + decontam.GAP)
        best, end = decontam.align(a, b)
        assert best == h.max() and (best == 0 or best in h[:, end])


# ------------------------------------------------------------------ mixing


def fill(sizes, cycle=(5, 2, 1), share=1.5, most=2.0):
    """Targets by the same rule, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    total, target, left = share * sum(sizes.values()), {}, set(names)
    while left:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if most * sizes[s] < level * weight[s]}
        if not over:
            return target | {s: level * weight[s] for s in left}
        target |= {s: most * sizes[s] for s in over}
        left -= over
    return target


def test_mix_near_targets(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(0, 60) if i % 17 else None, rng.choice(["a", "b", "B", "é", None, "z"] + ["hot"] * 6)) for i in range(1500)]
    rows += [(3, "x y z", "a")] * 3
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, target long")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken, targets = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert r.size == len((r.text or "").split()) and r.taken in (0, r.size, 2 * r.size)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
    want = fill(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s]) and abs(taken[s] - targets[s]) <= 30
    again = {(r.doc_id, r.text, r.source, r.taken) for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.text, r.source, r.taken) for r in got}
    copies = mixing.repeated(mixing.mix(df))
    assert copies.count() == sum(r.epochs for r in got)
    assert mixing.mix(df.limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(df.where("text is null")).collect())


def test_mix_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    cols = "doc_id, size, source_size, target, taken"
    want = con.execute(f"select {cols} from ({queries.ORACLE['op9_mixing_sources']}) order by doc_id").fetchall()
    got = [tuple(r) for r in queries.QUERIES["op9_mixing_sources"](spark, sf_dir).select(*cols.split(", ")).orderBy("doc_id").collect()]
    assert got == want


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.collect()
    ids = {r.doc_id for r in rows}
    assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) > 50
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(t in r.text for r in rows for t in items)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    junk = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(ids & junk) <= max(1, len(junk) // 4)
    assert all(r.n_chars == len(r.text) for r in rows)
    epochs = collections.Counter(r.doc_id for r in rows)
    assert all(epochs[r.doc_id] == r.epochs for r in rows)


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = [(1, "good words here", "en", "a", 15), (None, None, None, None, None), (2, "", "en", None, 0), (3, "x " * 30000, "en", "a", 60000), (1, "good words here", "en", "a", 15)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, str(tmp_path))
            assert got.columns[:5] == docs.columns if name != "mixing" else set(docs.columns) <= set(got.columns)
            assert got.count() <= 2 * len(rows)


HELPERS = (
    "rest end c0 _id _hash _d _h _p _one _rest _s _key _bucket _more before whole cut left weight s places text_hash kept_id kept_hash hash at kind place inside "
    "is_target toxic good n_grams log_weight score kept n_lines removed_lines removed_chunks n_shingles class component_id region gram words item_id row"
).split()


def test_stages_keep_columns_named_like_helpers(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some item of the benchmark that nobody has")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, f"words of document {i}\nand a line\nshared by all", "en", "a", 1) for i in range(5)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(n), F.coalesce("doc_id", F.lit(-1)).cast("string")).alias(n) for n in HELPERS])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        found = got.collect()
        assert got.columns[: len(docs.columns)] == docs.columns and found, name
        assert all(r[n] == f"{n}{-1 if r.doc_id is None else r.doc_id}" for r in found for n in HELPERS), name


def test_quality_counts_every_text(spark):
    df = spark.createDataFrame([("a b", True), ("b c d", False), (None, False), ("", True)], "text string, is_target boolean")
    rows = quality.count_slots(df, 1 << 18).collect()
    assert sum(r.n_raw for r in rows) == 3 + 5 and sum(r.n_target for r in rows) == 3
