"""The corpus pipeline against a brute-force version of its stages on planted documents."""

import re

import numpy as np
import pytest

import corpus_pipeline
from crossgrid.session import scratch_path

WORDS = [f"w{k}" for k in range(200)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def tables(spark):
    """Rows (doc_id, text, toxic label) and a folder with the three tables."""
    rng = np.random.default_rng(20)
    bench = [(k, " ".join(rng.choice(WORDS, 30))) for k in range(5)]
    texts = [" ".join(rng.choice(WORDS, 60)) for _ in range(240)]
    toxic = [False] * 240
    for k in range(0, 120, 3):
        words = texts[k].split()
        words[5], words[30], words[50] = "vile", "scum", "trash"
        texts[k], toxic[k] = " ".join(words), True
    texts += [texts[k] for k in (121, 122, 122, 3)]  # exact copies
    for k in (130, 131, 132):  # near copies: one word of sixty
        words = texts[k].split()
        words[-1] = "other"
        texts.append(" ".join(words))
    texts += [f"{texts[140]} {bench[0][1]}", f"{texts[141]} " + " ".join(bench[1][1].split()[3:18]).upper(), " ".join(bench[2][1].split()[:12])]
    texts += [None, "", "É 🙂  two  spaces\n"]
    toxic += [None] * (len(texts) - 240)
    order = rng.permutation(len(texts))
    rows = [(int(i), t, y) for i, t, y in zip(order, texts, toxic, strict=True)]
    path = scratch_path(spark, "pipeline-tables")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(y)) for i, _, y in rows if y is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, bench, path


def expected(rows, bench):
    left = {i: t for i, t, _ in rows if "vile" not in (t or "").split()}
    last = {}
    for i in sorted(left):
        last[left[i] or ""] = i
    left = {i: left[i] for i in last.values()}
    sets, comp = {i: shingles(t) for i, t in left.items()}, {i: i for i in left}
    for _ in left:
        changed = False
        for a in left:
            for b in left:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
        if not changed:
            break
    left = {i: t for i, t in left.items() if comp[i] == i}
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    windows = {tuple(w[k : k + 13]) for _, t in bench for w in [words(t)] for k in range(max(1, len(w) - 12))}
    out = {}
    for i, t in left.items():
        w = words(t)
        hit = {p for win in windows for k in range(len(w) - len(win) + 1) if tuple(w[k : k + len(win)]) == win for p in range(k, k + len(win))}
        if not (hit and 20 * len(hit) >= len(w)):
            out[i] = t
    return out


def test_pipeline_is_the_brute_force_one(spark, tables):
    rows, bench, path = tables
    got = corpus_pipeline.run(spark, path).collect()
    want = expected(rows, bench)
    assert {r.doc_id: r.decoded for r in got} == {i: t or "" for i, t in want.items()}
    assert len(got) == len(want) and all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in got)


def test_stages_keep_the_columns(spark, tables):
    _, _, path = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), path).columns == docs.columns
        assert stage(spark, empty, path).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, path).count() == 0
