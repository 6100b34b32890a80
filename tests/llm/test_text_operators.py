"""Operators of crossgrid.llm against brute force, round trips and the cases that their docstrings define."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crossgrid.llm import components, decontaminate, exact_dedup, html_wrapper, lm, near_dedup, packing, pieces, pii, queries, substring_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, _row long"
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    """Documents with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, None, "s", 1, None, None, None) for i, t in rows], DOCS)


WORDS = [f"w{k}" for k in range(40)]


def random_texts(seed, n, words=60):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, words)) for _ in range(n)]


EDGES = [(1, None), (2, ""), (3, " \t\n"), (None, "a b"), (4, "a b"), (4, "a b"), (5, "É é 🙂 ▁ x"), (6, "word " * 30000), (7, "x" * 50000), (8, "\x00\x0b")]


# -- exact dedup ------------------------------------------------------------------------------------------------------

def test_exact_dedup_edges(spark):
    got = exact_dedup.exact_dedup(docs_of(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    by_text = defaultdict(list)
    for r in got:
        by_text[r.text_sha256].append(r)
    sizes = Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t in EDGES)
    assert {k: len(v) for k, v in by_text.items()} == dict(sizes)
    for k, rows in by_text.items():
        ids = [r.doc_id for r in rows if r.doc_id is not None]
        assert sum(r.kept for r in rows) == 1
        assert all(r.group_size == sizes[k] and r.keep_id == (max(ids) if ids else None) for r in rows)


@pytest.mark.parametrize("words", [1, 64, 1 << 20])
def test_filter_size_never_changes_the_result(spark, words):
    texts = random_texts(1, 40, 3) * 2 + random_texts(2, 30)
    got = exact_dedup.exact_dedup(docs_of(spark, list(enumerate(texts))), filter_words=words).collect()
    last = {t: i for i, t in enumerate(texts)}
    assert {r.doc_id: (r.keep_id, r.kept) for r in got} == {i: (last[t], last[t] == i) for i, t in enumerate(texts)}


def test_drop_exact_copies(spark):
    docs = docs_of(spark, EDGES)
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(
        str(x) for x in [(2, ""), (3, " \t\n"), (4, "a b"), (5, "É é 🙂 ▁ x"), (6, "word " * 30000), (7, "x" * 50000), (8, "\x00\x0b")])
    assert exact_dedup.drop_exact_copies(docs.limit(0)).count() == 0


# -- language model -----------------------------------------------------------------------------------------------------

@pytest.mark.parametrize(("n", "universe"), [(1, 1), (5, 10), (1000, 10**6), (500, 500), (700, 20), (300, 1 << 50)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n))
    coded = lm.EliasFano(values, universe, lm.Mapped())
    assert (coded.get(np.arange(n)) == values).all()
    ask = np.concatenate([values, rng.integers(0, universe, 100)])
    places = np.searchsorted(values, ask)
    want = np.where((places < n) & (values[np.minimum(places, n - 1)] == ask), places, -1)
    assert (coded.find(ask, np.zeros(len(ask), int), np.full(len(ask), n)) == want).all()


def model_scores(rows, train, prior=lm.PRIOR):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = [[*(t or "").encode().translate(lower).split(), b""] for _, t in rows]
    c, pairs = Counter(), Counter()
    for ws, learn in zip(tokens, train, strict=True):
        if learn:
            c.update(ws)
            pairs.update(zip([b"", *ws[:-1]], ws, strict=True))
    n, v = sum(c.values()), len(c)
    p1 = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    out = []
    for ws in tokens:
        score = sum(math.log10((pairs[h, w] + prior * p1(w)) / (c[h] + prior) if c[h] else p1(w)) for h, w in zip([b"", *ws[:-1]], ws, strict=True))
        out.append((len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10(p1(w)) for w in ws), score))
    return out


@pytest.mark.parametrize(("block", "shard"), [(50, 100), (10**6, 10**6)])
def test_language_model_is_the_brute_force_one(spark, block, shard):
    rows = [(i, t) for i, t in enumerate(random_texts(3, 30, 20) + ["A a A", "unseen Word", "", None])]
    train = [zlib.crc32(str(i).encode()) % 10 != 0 and i < 31 for i, _ in rows]
    out = lm.score_texts(docs_of(spark, rows), train="crc32(cast(doc_id as string)) % 10 <> 0 and doc_id < 31", block_tokens=block, shard_tokens=shard)
    got = {r.doc_id: r for r in out.collect()}
    for (i, _), learn, want in zip(rows, train, model_scores(rows, train), strict=True):
        r = got[i]
        assert (r.trained, r.n_tokens, r.n_known, r.train_tokens) == (learn, *want[:3])
        assert r.base_score == pytest.approx(want[3], abs=1e-9)
        assert r.score == pytest.approx(want[4], abs=2e-4 * want[0])


def test_language_model_probabilities_add_up():
    """p(.|h) sums to 1 over the training words and the unknown one."""
    n, v, c = 50, 3, np.array([20, 20, 10, 0])
    p1 = lm.unigram(c, n, v)
    assert p1.sum() == pytest.approx(1)
    assert ((np.array([3, 1, 0, 0]) + lm.PRIOR * p1) / (4 + lm.PRIOR)).sum() == pytest.approx(1)


def test_language_model_edges(spark):
    got = lm.score_texts(docs_of(spark, EDGES), train="doc_id < 0").collect()
    assert len(got) == len(EDGES) and all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in got)
    assert lm.score_texts(docs_of(spark, [])).count() == 0


# -- pieces ---------------------------------------------------------------------------------------------------------------

VOCABULARY = pieces.Vocabulary(
    ["<unk>", "<s>", *[f"<0x{b:02X}>" for b in range(256)], "▁", "a", "b", "▁a", "ab", "▁ab", "abab", "é", "▁▁", "\n"],
    [0, 0, *[0] * 256, -5, -4, -4, -3.5, -6, -5.5, -9, -4, -7, -4], ["unknown", "control", *["byte"] * 256, *["normal"] * 10])


def best_pieces(text):
    """Every division of a text, by memo over its places."""
    v = VOCABULARY
    score = {p: (v.scores[k], k) for k, p in enumerate(["<unk>", "<s>", *[None] * 256, "▁", "a", "b", "▁a", "ab", "▁ab", "abab", "é", "▁▁", "\n"]) if k > 257}
    text = "▁" + text.replace(" ", "▁")
    best = {0: 0.0}
    for end in range(1, len(text) + 1):
        options = [best[s] + score[text[s:end]][0] for s in range(max(0, end - 5), end) if text[s:end] in score]
        if text[end - 1] not in score:
            options.append(best[end - 1] + v.unknown)
        best[end] = max(options)
    return best[len(text)]


@pytest.mark.parametrize("text", ["a", "ab", "abab ab a", "  a   b", "é\nü", "ab" * 40, "q", "aé ab q", " ", "ababab ba " * 9])
def test_viterbi_finds_the_best_division(text):
    coder = pieces.Encoder(VOCABULARY)
    ids, cut = coder.encode([text, text])
    ids = ids[: cut[1]].tolist()
    surface = "".join(VOCABULARY.surface[i].decode() if i > 257 else f"[{i - 2}]" for i in ids)
    unknown = sum(c not in "▁ab é\n" for c in text)
    assert sum(VOCABULARY.scores[i] for i in ids) + unknown * VOCABULARY.unknown == pytest.approx(best_pieces(text)), surface
    assert coder.decode(ids) == text


def test_pieces_agree_with_one_by_one_search_and_round_trip(spark):
    v = pieces.Vocabulary.load(queries.tokenizer_path("piece_bpe_32k.model"))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    units = sorted({u for t in texts for u in pieces.Encoder.units(t)})[:3000]
    raw = [(u if u[0] == pieces.MARK else pieces.MARK + u).encode() for u in units]
    assert [x.tolist() for x in v.solve(raw)] == [v.solve_one(u) for u in raw]


def test_encode_decode_edges(spark):
    out = pieces.encode_decode(docs_of(spark, EDGES), queries.tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(out) == len(EDGES)
    for r in out:
        assert r.n_pieces == len(r.piece_ids)
        assert r.round_trip == ("▁" not in (r.text or ""))
    assert pieces.encode_decode(docs_of(spark, []), queries.tokenizer_path("piece_bpe_32k.model")).count() == 0


# -- decontamination ------------------------------------------------------------------------------------------------------

def test_contamination_is_the_brute_force_one(spark):
    bench = [(7, "Alpha, beta GAMMA delta"), (8, " ".join(WORDS[:20])), (9, None), (10, "..."), (None, "one two"), (7, "Alpha, beta GAMMA delta")]
    texts = ["x alpha-beta gamma DELTA y", "alpha beta gamma", " ".join(WORDS[2:18]), "one  two " * 3, "", None, "zone two", "é" + " ".join(WORDS[:13]) + " é"] + random_texts(4, 5)
    table = spark.createDataFrame(bench, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in bench:
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add("null" if i is None else str(i))
    for block in (1, 1 << 17):
        got = {r.doc_id: r for r in decontaminate.contamination(docs_of(spark, list(enumerate(texts))), table, block_bytes=block).collect()}
        for i, t in enumerate(texts):
            w = re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
            hit, items = set(), set()
            for win, own in windows.items():
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        items |= own
            r = got[i]
            assert (r.n_words, r.n_hit, r.item_ids) == (len(w), len(hit), sorted(items))
            assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
            inside = " ".join(t[s.start : s.end] for s in r.hit_spans) if t else ""
            assert len(re.findall("[0-9A-Za-z\x80-\U0010ffff]+", inside)) == len(hit)


def test_contamination_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.contamination(docs_of(spark, EDGES), none, carry=True)
    assert out.count() == len(EDGES) and out.filter("contaminated").count() == 0
    assert decontaminate.contamination(docs_of(spark, []), none).count() == 0


# -- substring dedup --------------------------------------------------------------------------------------------------------

def removed(rows):
    first = {}
    cut = [(t or "").encode().split() for _, t in rows]
    key = [2**63 if i is None else i for i, _ in rows]
    for k, w in zip(key, cut, strict=True):
        for j in range(len(w) - 12):
            win = tuple(w[j : j + 13])
            first[win] = min(first.get(win, 2**64), k)
    out = []
    for k, w in zip(key, cut, strict=True):
        gone = set()
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < k:
                gone |= set(range(j, j + 13))
        out.append((len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return out


@pytest.mark.parametrize(("block", "shard"), [(100, 300), (1 << 22, 1 << 22)])
def test_substring_dedup_is_the_brute_force_one(spark, block, shard):
    base = random_texts(5, 12, 50)
    rng = np.random.default_rng(6)
    texts = list(base)
    for _ in range(30):  # passages of several lengths, overlapping and broken ones
        a, b = (base[k].split() for k in rng.integers(0, 12, 2))
        s, n = int(rng.integers(0, 40)), int(rng.integers(5, 40))
        texts.append(" ".join(a[s : s + n] + b[: int(rng.integers(0, 30))]))
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)] + [(5, base[0]), (None, base[1]), (None, base[1]), (99, None), (98, ""), (97, "same " * 300)]
    out = substring_dedup.substring_dedup(docs_of(spark, rows), block_bytes=block, shard_bytes=shard).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in out)
    want = sorted((i is None, i or 0, *x) for (i, _), x in zip(rows, removed(rows), strict=True))
    assert got == want
    assert substring_dedup.substring_dedup(docs_of(spark, [])).count() == 0


def test_parse_factors_follow_their_source():
    block = np.arange(1, 41, dtype=np.uint64)
    words = np.concatenate([block, block[5:30], np.array([99], dtype=np.uint64), block[20:40]])
    starts, ends = np.array([0, 40, 65]), np.array([40, 65, 86])
    factor, least = substring_dedup.parse(words, starts, ends, np.array([1, 2, 3]))
    assert set(factor[40:53]) == {factor[40]} and set(least[40:53].tolist()) == {1}
    assert set(least[66:74].tolist()) == {1} and len(set(factor[66:74].tolist())) == 1 and least[65] == 3


# -- packing ------------------------------------------------------------------------------------------------------------------

def test_best_fit_decreasing_against_a_plain_search():
    rng = np.random.default_rng(7)
    for capacity in (1, 7, 64, 100):
        sizes = rng.integers(1, capacity + 1, 200).tolist()
        rooms, rows = [], []
        for k in sorted(range(200), key=lambda k: (-sizes[k], k)):
            fit = [r for r in rooms if r >= sizes[k]]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - sizes[k])
            else:
                rooms.append(capacity - sizes[k])
        rows = packing.best_fit_decreasing(sizes, capacity)
        assert sorted(k for r in rows for k in r) == list(range(200))
        assert sorted(capacity - sum(sizes[k] for k in r) for r in rows) == sorted(rooms)


@pytest.mark.parametrize(("capacity", "batch"), [(16, 50), (2048, 10**6)])
def test_packed_rows_give_the_texts_back(spark, capacity, batch):
    import public_tokenizers

    vocabulary = open(queries.tokenizer_path("byte_bpe_50k.tiktoken")).read()
    rows = [(i, t) for i, t in enumerate(random_texts(8, 20) + ["", None, "  two  spaces\n\n x", "word " * 3000, "it's 12 3-4"])]
    out = packing.pack_documents(docs_of(spark, rows), vocabulary, public_tokenizers.PATTERN, capacity=capacity, batch_tokens=batch).collect()
    coder = packing.Tokens(vocabulary, public_tokenizers.PATTERN)
    segments = defaultdict(dict)
    for r in out:
        ids = np.frombuffer(r.input_ids, dtype="<i4")
        place = np.frombuffer(r.position_ids, dtype="<u2")
        assert len(ids) == r.n_tokens == r.cu_seqlens[-1] <= capacity and len(place) == len(ids)
        for doc, at, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            segments[doc][at] = ids[a:b].tolist()
            assert place[a:b].tolist() == list(range(b - a))
    for i, t in rows:
        joined = [x for at in sorted(segments[i]) for x in segments[i][at]]
        assert joined == [*coder.encoding.encode_ordinary(t or ""), coder.end]
    assert packing.pack_documents(docs_of(spark, []), vocabulary, public_tokenizers.PATTERN).count() == 0


# -- toxicity -------------------------------------------------------------------------------------------------------------------

def test_toxicity_learns_planted_words(spark):
    texts = random_texts(9, 300, 30)
    toxic = [k % 4 == 0 for k in range(300)]
    rows = [(k, t.replace("w3 ", "vile ") + " vile" if bad else t) for k, (t, bad) in enumerate(zip(texts, toxic, strict=True))]
    labels = spark.createDataFrame([(k, None, int(b)) for k, b in enumerate(toxic)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, [*rows, (1000, None), (1001, ""), (1002, "w1 " * 40000)])
    model = toxicity.train(docs, queries.training_rows(labels))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(model[0]) < 2000 and len(got) == 303
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((got[k] >= 0.5) == toxic[k] for k in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001] < 0.5


def test_ftrl_against_its_formula():
    model, w = toxicity.Ftrl(bits=3, alpha=0.2, l1=0.1), np.zeros(9)
    z, n = np.zeros(9), np.zeros(9)
    rng = np.random.default_rng(10)
    for _ in range(50):
        at = np.append(np.flatnonzero(rng.random(8) < 0.4), 8)
        y = int(rng.random() < 0.5)
        model.learn(at, y)
        for i in at:
            w[i] = 0 if abs(z[i]) <= 0.1 else -(z[i] - math.copysign(0.1, z[i])) / ((1 + math.sqrt(n[i])) / 0.2 + 0.1)
        g = 1 / (1 + math.exp(-w[at].sum())) - y
        for i in at:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.2 * w[i]
            n[i] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = docs_of(spark, EDGES)
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == len(EDGES) and {r.score for r in out} == {0.5}


# -- pages ------------------------------------------------------------------------------------------------------------------------

def page(k, body="", menu="Home"):
    return (f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header>Site</header>"
            f"<nav><ul><li><a href=/>{menu}</a></li></ul></nav><div class=\"ad box\">Buy {k}</div>"
            f"<article><h1>Title&nbsp;{k}</h1><p>First <b>text</b> of\n {k}.<p>Second &amp; last.{body}</article><!-- x --><aside>Side {k}</aside>"
            f"<div id='comments'><p>Nice {k}</p></div><form><input><p>Name {k}</p></form><footer>&copy; {k}</footer></body></html>")


def test_pages(spark):
    rows = [(k, f"http://H.example/{k}", page(k, menu=f"M{k}")) for k in range(6)]
    rows += [(10, "http://plain.example/a", "<div id=top>Same header</div><div class=c><p>Own text one</p><p>More one</p></div><div>Same end</div>"),
             (11, "http://plain.example/b", "<div id=top>Same header</div><div class=c><p>Own text two</p><p>More two</p></div><div>Same end</div>"),
             (12, None, None), (13, "", ""), (14, "x", "plain &lt;words&gt;"), (14, "x", "plain &lt;words&gt;"), (15, "http://H.example/z", "<p>a<script>never ended"), (None, "http://h.example", "<p>" + "long " * 30000)]
    pages = spark.createDataFrame([(*r, None, "x") for r in rows], "page_id long, url string, html string, text string, _host string")
    got = {(r.page_id, r.url): r for r in html_wrapper.extract(pages).collect()}
    assert html_wrapper.extract(pages).count() == len(rows)
    for k in range(6):
        assert got[k, f"http://H.example/{k}"].text == f"Title {k}\n\nFirst text of {k}.\n\nSecond & last."
    assert got[10, "http://plain.example/a"].text == "Own text one\n\nMore one"
    assert got[11, "http://plain.example/b"].text == "Own text two\n\nMore two"
    assert got[12, None].text == got[13, ""].text == "" and got[14, "x"].text in ("plain <words>", "")
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_wrapper.extract(pages.limit(0)).count() == 0


def test_constancy_decides_inside_articles_too(spark):
    def unnamed(k):
        return f"<main><div class=x1><ul><li>Start</li><li>Maps</li></ul></div><article><h1>T {k}</h1><p>Own {k}</p><p>Licence</p><div class=x2><div>Buy now</div></div></article></main>"

    rows = [(k, "http://a.example/", unnamed(k)) for k in range(40)]
    rows += [(100 + k, "http://b.example/", f"<div class='no-sidebar page'><article><h1>T {k}</h1><p>Own {k}</p></article></div><footer>F {k}</footer>") for k in range(4)]
    rows += [(200 + k, f"http://c{k}.example/", unnamed(k)) for k in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_wrapper.extract(pages).collect()}
    assert all(got[k] == f"T {k}\n\nOwn {k}\n\nLicence" for k in range(40))
    assert all(got[100 + k] == f"T {k}\n\nOwn {k}" for k in range(4))
    assert all(got[200 + k].startswith("Start\n\nMaps") and got[200 + k].endswith("Buy now") for k in range(2))  # one page proves nothing


def test_a_copied_article_is_not_template():
    page = "<article><h1>T</h1><div><p>Body</p></div></article><div>{}</div>"
    assert html_wrapper.main_text(page.format("ad 1"), [html_wrapper.parse(page.format(f"ad {k}")) for k in (2, 3)]) == "T\n\nBody"


def test_tree_matching_is_the_largest_ordered_one():
    a, b = (html_wrapper.parse(f"<div>{''.join(f'<p>{x}</p>' for x in s)}</div>") for s in ("abcde", "xbdey"))
    pairs = [(x.text, y.text) for x, y in html_wrapper.match_trees(a, b) if x.tag == "#"]
    assert len(html_wrapper.match_trees(a, b)) >= 10 and pairs


def test_html_alignment_does_not_depend_on_length():
    """Long lists get the same partners as short ones, and a block put in early does not make the rest of a long page new."""
    rng = np.random.default_rng(4)
    for _ in range(150):
        p, q = ([html_wrapper.Node("#", "#", False, str(rng.integers(5))) if rng.random() < 0.6 else html_wrapper.Node(t := str(rng.choice(["p", "div"])), t, False)
                 for _ in range(rng.integers(0, 45))] for _ in range(2))
        assert html_wrapper._aligned_wide(p, q) == html_wrapper._aligned(p, q)
    for n in (300, 900):
        rows = [f"<p>row {k}</p>" for k in range(n)]
        pages = [f"<div>{''.join(rows)}</div>", f"<div><p>new {n}</p>{''.join(rows)}</div>"]
        assert html_wrapper.main_text(pages[1], [html_wrapper.parse(pages[0])]) == f"new {n}"


# -- near-dedup ---------------------------------------------------------------------------------------------------------------------

def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_components(rows, size):
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low.setdefault(root(k), []).append(i)
    return [min((i for i in low[root(k)] if i is not None), default=None) for k in range(len(rows))]


def test_near_dedup_is_the_brute_force_one(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 3)
    rng = np.random.default_rng(11)
    vocabulary = [f"v{k}" for k in range(4000)]
    texts = []
    for _ in range(12):
        words = rng.choice(vocabulary, 120).tolist()
        for _ in range(int(rng.integers(1, 9))):  # a chain: each near the one before, the ends far apart
            texts.append(" ".join(words))
            words = list(words)
            for k in rng.integers(0, len(words), 3):
                words[k] = str(rng.choice(vocabulary))
    texts += ["a b", "A  b", "a", "", None, "a b c d", "a b c d e", texts[0]]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    got = {r.doc_id: r for r in near_dedup.near_dedup(docs_of(spark, rows), shingle=4).collect()}
    for (i, t), low in zip(rows, near_components(rows, 4), strict=True):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(shingles(t, 4)), low, low == i)


def test_near_dedup_edges(spark):
    out = near_dedup.near_dedup(docs_of(spark, EDGES)).collect()
    assert len(out) == len(EDGES)
    kept = [r for r in out if r.kept]
    assert len([r for r in out if r.n_shingles == 1]) >= 3 and len(kept) < len(EDGES)
    dropped = near_dedup.drop_near_copies(docs_of(spark, EDGES))
    assert dropped.count() == len(kept) and dropped.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert near_dedup.near_dedup(docs_of(spark, [])).count() == 0


def test_every_pair_within_the_distance_shares_a_bucket():
    rng = np.random.default_rng(12)
    a = rng.integers(0, 1 << 16, (200, near_dedup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(near_dedup.SYMBOLS, near_dedup.DISTANCE, replace=False)] ^= 1
    assert all(set(x) & set(y) for x, y in zip(near_dedup.bucket_keys(a).tolist(), near_dedup.bucket_keys(b).tolist(), strict=True))


def test_a_close_pair_is_compared_in_one_bucket_only():
    rng = np.random.default_rng(14)
    base = rng.integers(0, 1 << 16, near_dedup.SYMBOLS).astype(np.uint16)
    sigs = np.tile(base, (30, 1))
    for row in sigs:  # near each other, so that a pair shares many buckets
        row[rng.choice(near_dedup.SYMBOLS, 14, replace=False)] ^= rng.integers(1, 1 << 16, 14).astype(np.uint16)
    keys = near_dedup.bucket_keys(sigs)
    met = []
    for key in np.unique(keys).tolist():
        rows = [int(r) for r in np.flatnonzero((keys.view(np.int64) == key).any(axis=1))]
        group = pa.table({"_key": [key] * 2 * len(rows), "_role": [0] * len(rows) + [1] * len(rows), "_sig": [sigs[r].tobytes() for r in rows * 2]})
        for x, ok in near_dedup._close_pairs(group, np.array(rows * 2)):
            met += [(rows[x], rows[y - len(rows)]) for y in ok.tolist()]
    assert sorted(met) == [(a, b) for a in range(30) for b in range(30) if a != b and (sigs[a] != sigs[b]).sum() <= near_dedup.DISTANCE]


def test_sets_counted_together_are_the_similar_ones(monkeypatch):
    rng = np.random.default_rng(15)
    pool = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, int(n), replace=False)) for n in rng.integers(1, 61, 60)] + [np.sort(pool), np.sort(pool)[:48], np.sort(pool)[:47]]
    every = np.arange(len(sets))
    want = [[y for y in every if near_dedup.similar(sets[x], sets[y], 80)] for x in every]
    assert 48 in map(len, (sets[y] for y in want[60])) and 47 not in map(len, (sets[y] for y in want[60]))
    for most in (near_dedup.NUMBERED, 0):
        monkeypatch.setattr(near_dedup, "NUMBERED", most)
        among = near_dedup.similar_among(sets, 80)
        assert [among(x, every).tolist() for x in every] == want
        assert among(0, every[:0]).tolist() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7), (101, 100)], "a long, b long")
    got = {r.node: r.comp for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


# -- personal data --------------------------------------------------------------------------------------------------------------------

PII_TEXTS = [
    "mail a.b+c@x-y.co.uk, or a@b.c_d@e.f@g.h end", "x@y x@.z @ a@b.c.", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 1.2.3 and 007.08.9.255 9.9.9.9", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "pay 378282246310005 378282246310005 5 now", "+1 (555) 010-9999. +12 +1234567890123456 +49.30.1234567-", "é🙂 x@y.zz 🙂 1.1.1.1", "9" * 5000, "1 " * 5000, "a@" * 3000, "a." * 3000 + "@b.c",
    None, "", "++1234567890 5", "12.34.56.78x@y.z", "4 1" * 3000,
]


def base_of(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_base_spans_are_those_of_the_patterns(spark):
    rows = list(enumerate(PII_TEXTS))
    got = {r.doc_id: [(s["start"], s["rank"], s["end"]) for s in r.spans] for r in pii.personal_data(docs_of(spark, rows)).collect()}
    assert got == {i: base_of(t or "") for i, t in rows}


def test_revealing_words_are_those_of_the_counts(spark):
    rows = [(k, f"Agent Zorro-{k % 2} lives at x@y.zz in the town, the " + " ".join(WORDS[k % 5 :])) for k in range(6)]
    rows += [(10 + k, f"the town and the rest of it {WORDS[k % 40]}") for k in range(60)] + [(200, "write to x@y.zz"), (201, "the x@y.zz")]
    n, value = len(rows), "x@y.zz"
    texts = {i: t.lower() for i, t in rows}
    word = re.compile("[0-9a-z]+")
    df = Counter(w for t in texts.values() for w in set(word.findall(t)))
    holds = [i for i, t in texts.items() if value in t]
    want, near = defaultdict(list), defaultdict(list)
    for i in holds:
        a = texts[i].index(value)
        for m in word.finditer(texts[i]):
            if (m.end() <= a and m.start() >= a - pii.CONTEXT) or (m.start() >= a + len(value) and m.end() <= a + len(value) + pii.CONTEXT):
                near[i].append((m[0], m.start(), m.end()))
    co = Counter(w for i in holds for w in {x for x, _, _ in near[i]})
    for i in holds:
        for w, a, b in near[i]:
            if co[w] >= pii.SUPPORT and (p := math.log2(n * co[w] / (df[w] * len(holds)))) > 0 and p >= pii.DISCLOSURE * math.log2(n / len(holds)):
                want[i].append((a, b))
    assert any(want.values())
    out = pii.personal_data(docs_of(spark, rows)).collect()
    assert {r.doc_id: [(s["start"], s["end"]) for s in r.spans if s["rank"] == 4] for r in out if r.doc_id in want} == want
    assert all(r.doc_id in want or all(s["rank"] < 4 for s in r.spans) for r in out)
    joined = docs_of(spark, rows).join(pii.personal_data(docs_of(spark, rows)), "doc_id").filter("doc_id = 200")
    assert joined.select(pii.sanitise(F.col("text"), F.col("spans")).alias("t")).first().t == "write to [EMAIL]"


_TERM = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_entities(text):
    out = set()
    for s, rank, e in base_of(text):
        v = text[s:e]
        digits = re.sub("[^0-9]", "", v)
        form = "@" + v.split("@")[-1].translate(_TERM) if rank == 0 else ".".join(v.split(".")[:3]) if rank == 1 else digits[:6] if rank == 2 else digits[:4]
        out |= {("v", rank, v), ("f", rank, form), ("k", rank)}
    return out


def plain_revealing(rows):
    """Shrunk PMI of every pair, values over distinct texts and words over rows; the spans of every row."""
    texts = {i: t or "" for i, t in rows}
    word = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
    words = {i: [(m[0].translate(_TERM), m.start(), m.end()) for m in word.finditer(t)] for i, t in texts.items()}
    free = {i: [w for w in ws if not any(w[1] < e and s < w[2] for s, _, e in base_of(texts[i]))] for i, ws in words.items()}
    once = {t: i for i, t in texts.items()}
    df, df_entity, co = Counter(w for ws in words.values() for w in {x[0] for x in ws}), Counter(), Counter()
    for t, i in once.items():
        found = plain_entities(t)
        df_entity.update(found)
        co.update((v, w) for v in found for w in {x[0] for x in free[i]})
    telling = set()
    for (v, w), c in co.items():
        m = min(df[w], df_entity[v])
        p = math.log2(len(texts) * c / (df[w] * df_entity[v])) * c / (c + 1) * m / (m + 1)
        if p > 0 and p >= pii.DISCLOSURE * math.log2(len(texts) / df_entity[v]):
            telling.add(w)
    return telling, {i: sorted([*base_of(texts[i]), *((a, 4, b) for w, a, b in ws if w in telling)]) for i, ws in free.items()}


def found_spans(spark, folder, rows):
    docs_of(spark, rows).write.parquet(f"{folder}/documents.parquet")
    kinds = {k: j for j, k in enumerate((*pii.KINDS, "term"))}
    out = queries.QUERIES["op10_personal_data"](spark, str(folder)).collect()
    return {r.doc_id: [(int(a), kinds[k], int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)] for r in out}


def test_revealing_words_are_marked_in_every_text(spark, tmp_path):
    far = " ".join(f"plain{k}" for k in range(20))
    rows = [(k, f"mail x{k % 7}@y.zz or 10.0.0.{k % 5} {far} Zorro{k % 7} É{k % 5} {WORDS[k % 40]} nr{k}") for k in range(35)] + [(40, "Zorro3 alone, zorro3 again"), (41, None), (42, "zorro9")]
    rows += [(50 + k, f"{far} {WORDS[k % 40]} {WORDS[(k * 7) % 40]} {k}") for k in range(120)] + [(200, "Quux " + "many " * 700 + "solo@rare.org"), (201, "the Quux." + " many" * 300 + " quux")]
    rows += [(300 + k, "Quux met solo@rare.org") for k in range(9)]  # copies count once
    telling, want = plain_revealing(rows)
    assert "zorro3" in telling and "quux" not in telling and want[40]
    assert found_spans(spark, tmp_path, rows) == want


def test_quasi_identifiers_are_found_and_rare_words_left(spark, tmp_path):
    """Names that go with one address or one network are marked; words that happen to stand once or twice beside a value are not."""
    rng = np.random.default_rng(4)
    common = [f"c{k}" for k in range(300)]
    rows, planted, innocent = [], set(), set()
    for k in range(12):
        name, value = f"Nym{k}", f"u{k}@dom{k}.org" if k % 2 else f"81.{k}.7.{k + 3}"
        planted.add(name.lower())
        for j in range(4):
            odd = [f"odd{k}x{j}y{n}" for n in range(5)]
            innocent |= set(odd)
            rows.append((len(rows), " ".join([*rng.choice(common, 12), name, *odd, value, *rng.choice(common, 8)])))
    for _ in range(500):
        odd = [f"free{len(rows)}x{n}" for n in range(3)]
        innocent |= set(odd)
        rows.append((len(rows), " ".join([*rng.choice(common, 20), *odd])))
    telling, want = plain_revealing(rows)
    got = found_spans(spark, tmp_path, rows)
    assert got == want
    marked = {dict(rows)[i][a:b].lower() for i, spans in got.items() for a, kind, b in spans if kind == 4}
    assert len(marked & planted) >= 0.9 * len(planted)
    assert len(innocent - marked) >= 0.95 * len(innocent) and len(set(common) - marked) >= 0.95 * len(common)


def test_least_counts_lose_no_pair():
    for d in (0.1, 0.3, 0.5, 0.7, 0.9):
        co, df = pii.least_counts(d)
        assert all(c / (c + 1) * m / (m + 1) < d for m in range(1, 400) for c in range(1, min(co, m + 1)))
        assert all(c / (c + 1) * m / (m + 1) < d for m in range(1, df) for c in range(1, m + 1))


def test_personal_data_everywhere_edges(spark):
    assert pii.personal_data_everywhere(docs_of(spark, EDGES)).count() == len(EDGES)
    assert pii.personal_data_everywhere(docs_of(spark, [])).count() == 0


def test_personal_data_edges(spark):
    assert pii.personal_data(docs_of(spark, EDGES)).count() == len(EDGES)
    assert pii.personal_data(docs_of(spark, [])).count() == 0


def test_no_operator_imports_swallow_errors():
    import pathlib

    for path in pathlib.Path(queries.__file__).parent.glob("*.py"):
        if path.name != "queries.py":
            assert "except ImportError" not in path.read_text()


def test_kept_words_have_the_places_of_all(spark):
    """Only words that are asked for are placed, at the places that they have among all words."""
    texts = ["", "a b a", " ".join(f"w{k % 7}é," for k in range(100)), "B\U0001f600 a--b\na", "- -"]
    df = spark.createDataFrame([(t, ["a", "w3é"]) for t in texts], "t string, terms array<string>")
    got = df.select(pii._all_words(F.col("t")).alias("x"), pii._all_words(F.col("t"), lambda v: F.array_contains("terms", v)).alias("y")).collect()
    assert all([w for w in r.x if w.value in ("a", "w3é")] == r.y for r in got) and sum(len(r.y) for r in got) == 18
