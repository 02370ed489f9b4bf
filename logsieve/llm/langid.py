"""Language identification in two steps: family first, then one-versus-one machines within it.

Features are hashed character 1- to 4-grams of the lower-cased whole text, as square roots of their
shares. Linear support vector machines tell the families apart (each against the rest); within
the chosen family one machine for each pair of its languages votes. Languages that the family
table does not name are families of their own.

Training rows are a bounded sample: up to ``per_language`` labelled texts of each language, by hash.
Each machine is one group of a grouped map over that sample. Texts that are null or have no letter
are ``und`` with score 0. Without training rows everything is ``und``. Repeated rows get the same
answer. The score is the mean of the family's and the language's squashed margins, 0 to 1.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsieve.llm.words import U64, mix
from logsieve.sources import store

DIM = 1 << 13
PER_LANGUAGE = 600
#: Which languages are close relatives.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def family(lang: str) -> str:
    return FAMILY_OF.get(lang, lang)


#: Characters taken by one numpy step; pieces of a text overlap, so no n-gram is lost.
STEP = 1 << 17


def features(text: str | None, dim: int = DIM) -> np.ndarray:
    """Square roots of the n-grams' shares in hash buckets; zeros without text."""
    n = np.zeros(dim, np.float64)
    chars = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(chars), STEP):
        c = chars[max(0, at - 3) : at + STEP].astype(U64)
        new = min(at, 3)
        h = np.zeros(len(c), U64)
        for k in range(4):
            # the h of a place covers the k characters before it
            h = np.concatenate([np.zeros(1, U64), h[:-1]]) * U64(0x100000001B3) + c + U64(1)
            got = (mix(h + U64(k)) % U64(dim))[max(new, k if at == 0 else 0) :]
            n += np.bincount(got.astype(np.int64), minlength=dim)
    total = n.sum()
    return np.sqrt(n / total).astype(np.float32) if total else n.astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, epochs: int = 30, c: float = 10.0, seed: int = 0) -> np.ndarray:
    """Weights and, last, the bias of a linear machine with hinge loss, by dual coordinate descent; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    a, w, norm, rng = np.zeros(len(x)), np.zeros(x.shape[1]), (x * x).sum(1), np.random.default_rng(seed)
    share = np.where(y > 0, (y < 0).sum(), (y > 0).sum()) / max(1, len(y)) * 2 * c
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (w @ x[i]) - 1
            new = min(max(a[i] - g / norm[i], 0.0), share[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return w


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 0) -> DataFrame:
    """text and lang of up to per_language rows of each language of docs (doc_id, text, lang)."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("lang", "doc_id")
    ids = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language).select("lang", "doc_id").distinct()
    # per_language rows of each language: the broadcast has a fixed bound
    return docs.join(F.broadcast(ids), ["lang", "doc_id"]).select("lang", "text")


def fit(rows: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """Machines by name: ``family:x`` (x against the rest) and ``pair:a:b`` (a against b)."""
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    families = sorted({family(x) for x in langs})
    tasks = []
    if len(families) > 1:
        tasks += [(f"family:{f}", x, 1 if family(x) == f else -1) for f in families for x in langs]
    for i, a in enumerate(langs):
        for b in langs[i + 1 :]:
            if family(a) == family(b):
                tasks += [(f"pair:{a}:{b}", a, 1), (f"pair:{a}:{b}", b, -1)]
    if not tasks:
        return {}
    plan = rows.sparkSession.createDataFrame(tasks, "machine string, lang string, y int")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "text"])
        x = np.stack([features(t, dim) for t in pdf["text"]])
        w = fit_svm(x, pdf["y"].to_numpy(np.float64))
        return pd.DataFrame({"machine": [pdf["machine"].iloc[0]], "w": [w.tolist()]})

    parted = rows.join(F.broadcast(plan), "lang")
    found = parted.groupBy("machine").applyInPandas(train, "machine string, w array<double>").collect()
    return {r["machine"]: np.array(r["w"]) for r in found}


def predict(docs: DataFrame, machines: dict[str, np.ndarray], langs: list[str], dim: int = DIM) -> DataFrame:
    """docs with lang_pred and score; reads text only."""
    families = sorted({family(x) for x in langs})
    names = sorted(machines)
    w = np.stack([machines[n] for n in names]) if names else np.zeros((0, dim + 1))
    shared = docs.sparkSession.sparkContext.broadcast(w.astype(np.float32))
    squash = lambda m: 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))

    def answer(text: str) -> tuple[str, float]:
        m = dict(zip(names, (shared.value[:, :-1] @ features(text, dim) + shared.value[:, -1]).tolist(), strict=True))
        best, sure = families[0], 1.0
        if len(families) > 1:
            best = max(families, key=lambda f: m[f"family:{f}"])
            sure = float(squash(m[f"family:{best}"]))
        own = [x for x in langs if family(x) == best]
        if len(own) == 1:
            return own[0], sure
        votes = {x: [0, 0.0] for x in own}
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                d = m[f"pair:{a}:{b}"]
                votes[a if d > 0 else b][0] += 1
                votes[a][1] += d
                votes[b][1] -= d
        lang = max(own, key=lambda x: (votes[x], x))
        return lang, (sure + float(squash(votes[lang][1] / (len(own) - 1)))) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [answer(t) if ok and langs else ("und", 0.0) for t, ok in zip(b.column("text").to_pylist(), b.column("_letter").to_pylist(), strict=True)]
            kept = [i for i, n in enumerate(b.schema.names) if n not in ("text", "_letter")]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in kept), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.float64())],
                names=[*(b.schema.names[i] for i in kept), "lang_pred", "score"],
            )

    docs = docs.drop("lang_pred", "score", "_letter")
    marked = docs.withColumn("_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    own = [f"`{n}` {t}" for n, t in docs.dtypes if n != "text"]
    return marked.mapInArrow(run, ", ".join([*own, "lang_pred string", "score double"]))


def identify(docs: DataFrame, training: DataFrame, per_language: int = PER_LANGUAGE, dim: int = DIM) -> DataFrame:
    """docs (text, ...) without its text, with lang_pred and score, learnt from training (doc_id, text, lang)."""
    rows = store.materialize(sample(training, per_language), "lang-sample")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    return predict(docs, fit(rows, dim), langs, dim)
