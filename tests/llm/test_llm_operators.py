"""The operators against brute force, on small tables that hold nulls, empty and long texts, ties and repeated rows."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from solvens.llm import exact_dedup, html_extract, lsh_forest, packing, quality, queries, sentencepiece_bpe, suffix_dedup, topk, toxicity, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}x{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, odd texts."""
    rng = random.Random(4)
    base = [words(rng, rng.randint(1, 300)) for _ in range(40)]
    passage = words(rng, 90)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, t.replace(" ", "  ")) for i, t in enumerate(base[:6])]
    out += [(200 + i, base[1] if i % 2 else base[2]) for i in range(8)]
    for i in range(12):
        near = base[3 + i % 4].split()
        near[rng.randrange(len(near))] = f"edit{i}"
        out.append((300 + i, " ".join(near).upper() if i % 3 == 0 else " ".join(near)))
    out += [(400 + i, words(rng, 20) + " " + passage + " " + words(rng, 20)) for i in range(6)]
    out += [(500, None), (501, ""), (502, " \n "), (503, "one two"), (504, "One\ttwo"), (505, "ab " * 4000), (506, "é" * 900), (507, words(rng, 30_000, 9000))]
    out += [out[5], out[5], (None, base[7]), (None, None)]
    rng.shuffle(out)
    return out


def test_html_pieces():
    page = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
    <main><article><header><h1>Head &amp; line</h1></header><p>First   paragraph, with <b>bold</b> and
    <a href="x">a link</a>.<p>Second &eacute;&#233;&#x2014;one<br>more.</p><ul><li>Item, one.<li>Item two.</ul><div class="ad">Buy!</div><p>End.</p></article>
    <section class="comments"><p>Nice, long, wordy, punctuated, comment! Really; truly: so.</p></section></main>
    <aside>Side</aside><form><input value="x"><p>Sign up</p></form><!-- <p>hidden</p> --><footer>&copy; me</footer>"""
    assert html_extract.extract(page).split("\n") == [
        "Head & line",
        "First paragraph, with bold and a link.",
        "Second éé—one more.",
        "Item, one.",
        "Item two.",
        "End.",
    ]
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<nav>x</nav>") == ""
    assert html_extract.extract("<p>a<p>b") == "a\nb"
    assert html_extract.extract("<" * 2000) != "x" and html_extract.extract('<p class="x>' + "a" * 5000) is not None


def test_html_by_article(spark, data_dir):
    got = {r.page_id: r for r in queries.op1_html(spark, data_dir).collect()}
    pages = spark.read.parquet(f"{data_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", p.html or "", re.S)
        pieces = re.split(r"</?(?:p|h1)>", article[1]) if article else []
        plain = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in pieces)
        expected = "\n".join(x for x in plain if x)
        assert (got[p.page_id].text, got[p.page_id].n_chars) == (expected, len(expected))


def test_html_without_names(spark, data_dir):
    """Without telling tags and classes the ratios alone find the same text, but on pages whose article is hardly longer than what surrounds it."""
    tags = re.compile(r"<(/?)(?:article|main|nav|footer|aside|header|section)\b[^>]*>")
    names = re.compile(r"""(<\w+)\s+(?:class|id|role)=(?:"[^"]*"|'[^']*')""")
    pages = [r.html for r in spark.read.parquet(f"{data_dir}/pages.parquet").collect() if r.html]
    wanted = [html_extract.extract(x) for x in pages]
    found = [html_extract.extract(names.sub(r"\1", tags.sub(r"<\1div>", x))) for x in pages]
    long = [(a, b) for a, b in zip(wanted, found, strict=True) if len(a) >= 300]
    assert long and all(a == b for a, b in long)
    page = "<div><div><a href='/'>Home</a></div><div>Buy this, now.</div><div><h2>Head</h2><div><p>One, two, three.</p><p>Four; five.</p></div></div><div>(c) me.</div></div>"
    assert html_extract.extract(page) == "Head\nOne, two, three.\nFour; five."


def test_html_deep_nesting():
    depth = 20_000
    assert html_extract.extract("<div>" * depth + "<p>Text.</p>" + "</div>" * depth) == "Text."


def test_html_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "old"), (1, "<p>x</p>", None)], "page_id long, html string, TEXT string")
    out = html_extract.extract_pages(pages)
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in out.collect()) == [(1, "", 0), (1, "x", 1)]
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def brute_near(rows):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(lower))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and None not in (i, j) and 100 * len(a & b) >= 75 * len(a | b) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted(((i if i is not None else -1), len(s), find(i) if i is not None else -1) for i, s in sets)


def test_near_groups(spark, rows, monkeypatch):
    for region in (lsh_forest.REGION, 2):
        monkeypatch.setattr(lsh_forest, "REGION", region)
        got = lsh_forest.near_groups(documents(spark, rows)).collect()
        assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)
        none = lambda x: -1 if x is None else x
        assert sorted((none(r.doc_id), r.n_shingles, none(r.component_id)) for r in got) == brute_near(rows)
    assert lsh_forest.near_groups(documents(spark, [])).count() == 0


def test_near_pairs_of_one_template(spark):
    """Texts of one template, alike by .70, with pairs at 146 / 194 among them: none is lost, however large the region."""
    form = [f"form{k}" for k in range(144)]
    rows = [(i, " ".join(form + [f"own{i // 2 if i < 120 and k < 6 else i}x{k}" for k in range(30)])) for i in range(600)]
    order = list(range(600))
    random.Random(4).shuffle(order)
    rows = [(order[i], text) for i, text in rows]
    expected = {a: min(a, b) for i in range(0, 120, 2) for a, b in [(order[i], order[i + 1]), (order[i + 1], order[i])]}
    got = lsh_forest.near_groups(documents(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: expected.get(i, i) for i in order}


def test_encoder_equals_library(spark, data_dir):
    import sentencepiece

    path = queries.tokenizer_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    texts = [r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    texts += ["".join(rng.choice("aabbc  ▁éü😀\n\t́Ωthern<>/&0x-_") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += ["", " ", "a" * 3000, "ab" * 1500, " " * 700, "\n" * 50, "aaaaab" * 300, "<s></s><0x0A>"]
    got = list(sentencepiece_bpe.encode_each(path, texts))
    assert got == library.encode(texts)
    own = sentencepiece_bpe.encoder(path)
    assert [own.decode(x) for x in got] == [library.decode(x) for x in got]
    df = spark.createDataFrame([(1, None, 5), (1, "a b", 6), (1, "a b", 6)], "doc_id long, text string, n_tokens int")
    out = sorted((r.n_tokens, r.ids_sha256) for r in sentencepiece_bpe.token_digests(df, path).collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert out[0] == (0, empty) and out[1] == out[2] and out[1][0] == len(library.encode("a b"))


def rate(y, p):
    """Area under the curve, ties counted half."""
    y, p = np.array(y), np.array(p)
    above = (p[y == 1][:, None] > p[y == 0][None, :]).mean()
    return above + (p[y == 1][:, None] == p[y == 0][None, :]).mean() / 2


@pytest.mark.parametrize(("name", "label", "modulus", "rest", "least"), [("op5_quality", "quality", 4, 2, 0.97), ("op10_toxicity", "toxic", 5, 0, 0.8)])
def test_held_out(spark, name, label, modulus, rest, least):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, folder).collect()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    limit = 0.7 if label == "quality" else 0.5
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= limit)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
    held = [(labels[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in labels]
    assert rate(*zip(*held, strict=True)) > least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_odd_rows(spark, module):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, "a b c", "x"), (2, "a b c", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(2, 1, None), (2, 0, 1), (3, None, 5), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        out = module.score(docs, given).collect()
        assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert module.score(docs.limit(0), labels).count() == 0


def test_filters_agree_with_gradient():
    """One step of the network follows the numerical gradient."""
    net = quality.Network(3)
    text = np.frombuffer(b"some bytes, more bytes | and others" * 20, np.uint8)
    grads = [np.zeros_like(p) for p in net.parameters()]
    net.gradient(text, 1.0, grads)

    def loss():
        return float(np.log1p(np.exp(-net.margin(text))))

    for p, g in zip(net.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        assert (up - loss()) / 2e-2 == pytest.approx(g[at], rel=0.1, abs=1e-4)
        p[at] = old


def test_exact_groups(spark, rows, monkeypatch):
    texts = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    size = Counter(t for _, t in texts)
    least = {}
    for i, t in texts:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    expected = sorted((str(i), str(least.get(t)), size[t], i == least.get(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)
    for run_rows in (50_000, 3):
        df = documents(spark, rows).repartition(5)
        marks = exact_dedup.fingerprints(df, "doc_id", "text")
        merged = exact_dedup.merge_all(marks, run_rows=run_rows)
        assert merged.count() == len(size)
        assert sorted((r.keep_id, r["size"]) for r in merged.where("keep_id is not null").collect()) == sorted((least[t], size[t]) for t in size if t in least)
    got = [(str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(df).collect()]
    assert sorted(got) == expected
    kept = exact_dedup.deduplicate(df).collect()
    assert Counter(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept) == Counter(size.keys())
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0


def test_merge_checks_copies():
    with pytest.raises(ValueError):
        list(exact_dedup.merge_runs([[(b"x", 1, 1, 5, 7)], [(b"x", 2, 1, 5, 8)]]))
    assert list(exact_dedup.merge_runs([[(b"x", None, 1, 5, 7)], [(b"x", 2, 3, 5, 7)]])) == [(b"x", 2, 4, 5, 7)]


@pytest.mark.parametrize("k", [1, 5, 100])
def test_top_k(spark, k, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 7]) for i in range(60)]
    vectors += [(60 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(20)]
    vectors += [(90, None), (91, [1.0, None, 0.0, 0.0]), (92, [float("nan"), 0.0, 0.0, 0.0]), (93, [float("inf"), 0.0, 0.0, 0.0]), (94, [1.0]), (95, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4)
    good = [(i, np.floor(256 * np.pad(np.array(v), (0, 4 - len(v)))).astype(int)) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for i, q in good:
        if i % 5 == 0:
            best = sorted((-int(q @ c), j) for j, c in good if j != i)[:k]
            expected += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    got = topk.top_k(df, k, is_query=F.col("vec_id") % 5 == 0).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)
    assert topk.top_k(df.limit(0), k).count() == 0


def test_top_k_of_neighbouring_bins(spark):
    """66,048 values each way: 2 * 66,048 + 1 is no power of the number of bins, and the two best scores are one apart."""
    longest = next((a, b, c, d) for a in range(256, 0, -1) for b in range(30) for c in range(30) for d in range(30) if a * a + b * b + c * c + d * d == 66_047)
    cells = {0: (8, 1, 0, 0), 1: (145, 2, 0, 0), 2: (145, 1, 0, 0), 3: tuple(-x for x in longest), 4: (1, 1, 0, 0)}
    df = spark.createDataFrame([(i, [x / 256 for x in c]) for i, c in cells.items()], "vec_id long, embedding array<double>")
    got = topk.top_k(df, 2, is_query=F.col("vec_id") == 0).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 1162), (0, 2, 2, 1161)]


def brute_spans(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        starts = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), starts, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 1])
def test_repeats(spark, rows, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    if group == 1:  # executors' modules keep their own value: the flag travels with the rows
        few = [r for r in rows if r[0] != 507][:60]
    else:
        few = rows
    got = suffix_dedup.cut_repeats(documents(spark, few)).collect()
    expected = brute_spans([(t or "").encode() for _, t in few], suffix_dedup.LENGTH)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((str(i), *e) for (i, _), e in zip(few, expected, strict=True))
    whole = [r for r in got if r.text.isascii()]
    assert len(whole) > 50 and all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in whole)
    assert suffix_dedup.cut_repeats(documents(spark, [])).count() == 0


def brute_words(texts, length):
    """What is left of each text without the runs of ``length`` words that occur again."""
    split = [list(re.finditer(rb"[^\x20\x09-\x0D]+", t)) for t in texts]
    run = lambda w, k: tuple(m.group() for m in w[k : k + length])
    seen = Counter(run(w, k) for w in split for k in range(len(w) - length + 1))
    out = []
    for t, w in zip(texts, split, strict=True):
        keep = np.ones(len(t), bool)
        for k in range(len(w) - length + 1):
            if seen[run(w, k)] > 1:
                keep[w[k].start() : w[k + length - 1].end()] = False
        out.append(bytes(np.frombuffer(t, np.uint8)[keep]))
    return out


def test_passages_of_more_than_50_words(spark, rows, monkeypatch):
    rng = random.Random(9)
    short = [" ".join("abcdefgh"[rng.randrange(8)] * rng.randint(1, 5) for _ in range(n)) for n in (50, 51, 60)]
    assert max(map(len, short)) < suffix_dedup.LENGTH
    docs = [r for r in rows if r[0] is not None and r[0] != 507]
    docs += [(600 + 10 * k + i, f"{words(rng, 9)} {p} {words(rng, 9)}") for k, p in enumerate(short) for i in range(2)]
    docs += [(700, short[1].replace(" ", "\n")), (701, " ".join(short[2].split()[4:56]) + " end"), (702, words(rng, 60) + " ä " + short[2])]
    docs = list({i: (i, t) for i, t in docs}.values())
    expected = brute_words([(t or "").encode() for _, t in docs], 51)
    for group in (suffix_dedup.GROUP, 1):
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
        got = suffix_dedup.without_repeats(documents(spark, docs), units=(suffix_dedup.PASSAGES,)).collect()
        assert {r.doc_id: (r.text or "").encode() for r in got} == {i: e for (i, _), e in zip(docs, expected, strict=True)}
    by_id = {i: e.decode() for (i, _), e in zip(docs, expected, strict=True)}
    assert short[0] in by_id[600] and short[1] not in by_id[610] and by_id[700] == ""
    staged = {r.doc_id: r.text for r in corpus_pipeline.cut_repeated_passages(spark, documents(spark, docs), "").collect()}
    assert short[0] in staged[600] and staged[610].split() == by_id[610].split() and staged[700] == ""


def test_op8_text_without_short_passages(spark, rows, tmp_path):
    """Passages of more than 50 words, but of less than 400 bytes, go from the text; the contract's columns count 400 bytes only."""
    rng = random.Random(19)
    short = [" ".join("abcdefgh"[rng.randrange(8)] * rng.randint(1, 5) for _ in range(n)) for n in (50, 51, 60)]
    docs = list({i: (i, t) for i, t in rows if i is not None and i != 507}.values())
    docs += [(600 + 10 * k + i, f"{words(rng, 9)} {p} {words(rng, 9)}") for k, p in enumerate(short) for i in range(2)]
    documents(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_suffix_dedup(spark, str(tmp_path)).collect()}
    texts = [(t or "").encode() for _, t in docs]
    for (i, t), text, passages, expected in zip(docs, texts, brute_words(texts, 51), brute_spans(texts, suffix_dedup.LENGTH), strict=True):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected
        if not r.n_removed and text.isascii():
            assert r.text.encode() == passages
    assert len(got) == len(docs) and short[0] in got[600].text
    assert all(got[i].n_removed == 0 and len(got[i].text.split()) == 18 for i in (610, 611, 620, 621))


def test_windows_counted_one_by_one(spark, rows):
    """The way for grams of very many contexts finds what the sort finds."""
    texts = [(t or "").encode() for _, t in rows if t and len(t) > 400 and len(t) < 5000]
    contexts = {}
    for t in texts:
        data = np.frombuffer(t, np.uint8)
        for _, gram, ahead, digest, context in suffix_dedup._contexts(data, suffix_dedup.anchors(data)[1]):
            n = contexts.get((gram, digest), (0,))[0]
            contexts[gram, digest] = (n + 1, ahead, context)
    data = [(g, d, n, a, bytes(c), True) for (g, d), (n, a, c) in contexts.items()]
    counted = {(r.gram, bytes(r.digest)): (r.to_left, r.to_right) for r in suffix_dedup._count_windows(spark.createDataFrame(data, suffix_dedup.CONTEXTS)).collect()}
    cells = np.zeros((len(data), suffix_dedup.WIDTH), np.uint8)
    for i, (_, _, _, a, c, _) in enumerate(data):
        cells[i, suffix_dedup.ANCHOR - a : suffix_dedup.ANCHOR - a + len(c)] = np.frombuffer(c, np.uint8)
    ahead = np.array([d[3] for d in data])
    behind = np.array([len(d[4]) for d in data]) - ahead
    left, right = suffix_dedup.repeats(cells, ahead, behind, np.array([d[0] for d in data]))
    sorted_ = {}
    for (g, d, n, a, c, _), x, y in zip(data, left.tolist(), right.tolist(), strict=True):
        x, y = (a, len(c) - a) if n > 1 else (x, y)
        if y:
            sorted_[g, d] = (x, y)
    assert counted == sorted_ and counted


def test_sort_and_collisions(monkeypatch):
    rng = np.random.default_rng(3)
    cells = rng.integers(97, 99, (300, 12)).astype(np.uint8)
    sizes = rng.integers(0, 13, 300)
    segment = np.sort(rng.integers(0, 9, 300))
    key = [(s, cells[i, :n].tobytes()) for i, (s, n) in enumerate(zip(segment, sizes, strict=True))]
    order, _ = suffix_dedup.Rows(cells, sizes).sorted_rows(segment)
    assert [key[i] for i in order] == sorted(key)
    rows = suffix_dedup.Rows(cells, sizes)
    rows.sums[:] = 0  # every hash collides
    order, _ = rows.sorted_rows(segment)
    assert [key[i] for i in order] == sorted(key)


def test_cut_keeps_characters(spark):
    shared = "ä" * 500
    out = suffix_dedup.without_repeats(spark.createDataFrame([(1, shared + "x", 9, 1), (2, "y" + shared, 9, 2), (3, None, 9, 3)], "doc_id long, text string, n_chars int, _u int"))
    assert out.columns == ["doc_id", "text", "n_chars", "_u"]
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect()) == [(1, "x", 1), (2, "y", 1), (3, None, 9)]


def test_url_rules(spark, data_dir):
    urls = [None, "no scheme", "http://a.NET/x?y", "https://example.net/en/1", "https://example.net/en", "http://xexample.com/de/", "http://m.example.com/de/1#a", "http://b.org/fr/", "http://net", "http://a.net?q=/", "x://net/://b", ""]
    pages = spark.createDataFrame([(i, u, "r", 1) for i, u in enumerate(urls)], "page_id long, url string, RULE string, _host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.filter_urls(pages, queries.RULES).select("page_id", "host", "path", "rule", "verdict").collect()}
    assert got[0] == got[1] == got[11] == ("", "", None, "allow")
    assert got[2] == ("a.net", "/x", "net/", "block")
    assert got[3][2:] == ("example.net/en/", "allow") and got[4][2:] == ("net/", "block")
    assert got[5][2:] == (None, "allow") and got[6][2:] == ("example.com/de/", "block") and got[7][2:] == ("org/fr/", "allow")
    assert got[8] == ("net", "", None, "allow") and got[9] == ("a.net", "", None, "allow") and got[10] == ("net", "/://b", "net/", "block")
    assert url_rules.filter_urls(pages.limit(0), queries.RULES).count() == 0


def test_packing(spark, rows):
    df = documents(spark, rows)
    lengths = (64, 128, 256)
    got = packing.pack(df, lengths=lengths, shard_tokens=5000).collect()
    count = {}
    for i, t in rows:
        w = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        count[i, w + 1 if w else 0] = count.get((i, w + 1 if w else 0), 0) + 1
    placed = Counter()
    bins = {}
    for r in got:
        placed[r.doc_id] += r.n_tokens
        bins.setdefault((r.shard, r.bin), []).append(r)
        assert r.start == r.piece * 256
    expected = Counter()
    for (i, n), k in count.items():
        expected[i] += n * k
    assert placed == expected
    for own in bins.values():
        used = sum(r.n_tokens for r in own)
        assert all(r.bin_used == used for r in own) and used <= own[0].bin_size
        assert own[0].bin_size == min(s for s in lengths if s >= used)
        assert sorted(r.place for r in own) == list(range(len(own)))
    assert packing.pack(documents(spark, [])).count() == 0
    waste = 1 - sum(expected.values()) / sum(own[0].bin_size for own in bins.values())
    assert waste < 0.1


def test_packing_is_best_fit():
    rng = random.Random(5)
    pieces = [(rng.randint(0, 100), i) for i in range(500)]
    free, expected = [], []
    for p in sorted(pieces, reverse=True):
        room = [(f, b) for f, b in free if f >= p[0]]
        if room:
            f, b = min(room)
            free.remove((f, b))
            expected[b].append(p)
        else:
            f, b = 100, len(expected)
            expected.append([p])
        if f > p[0]:
            free.append((f - p[0], b))
    assert [own for _, own in packing.pack_pieces(pieces, (100,))] == expected


def test_pipeline(spark, rows, tmp_path):
    rng = random.Random(8)
    toxic = [(1000 + i, words(rng, 40) + " idiot moron " + words(rng, 5)) for i in range(60)]
    clean = [(2000 + i, words(rng, 45)) for i in range(60)]
    docs = [r for r in rows if r[0] is not None] + toxic + clean
    documents(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 1) for i, _ in toxic[:50]] + [(i, 1, 0) for i, _ in clean[:50]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        step = stage(spark, step, str(tmp_path))
        assert step.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        step.write.parquet(str(tmp_path / f"step{k}"))
        step = spark.read.parquet(str(tmp_path / f"step{k}"))
        ids.append({r.doc_id for r in step.select("doc_id").collect()})
    assert not ids[0] & {i for i, _ in toxic} and ids[0] >= {i for i, _ in clean} | {i for i, _ in docs if i < 1000}
    left = [(i, t) for i, t in docs if i in ids[0]]
    normal = {}
    for i, t in left:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        normal[key] = min(i, normal.get(key, i))
    assert ids[1] == set(normal.values())
    third = {i: t for i, t in left if i in ids[1]}
    assert ids[2] == {c for i, _, c in brute_near(list(third.items())) if i == c} and ids[3] == ids[2]
    texts = [(third[i] or "").encode() for i in sorted(ids[3])]
    got = {r.doc_id: r.text for r in step.collect()}
    for i, (_, _, _, sha) in zip(sorted(ids[3]), brute_spans(texts, suffix_dedup.LENGTH), strict=True):
        if i != 506:
            assert hashlib.sha256((got[i] or "").encode()).hexdigest() == sha
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == ids[3]


def test_sentencepiece_long_words():
    """Words without spaces: ids as the library's, in about linear time."""
    import time

    import sentencepiece

    path = queries.tokenizer_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(41)
    letters = "".join(rng.choice("etaoinshrdluaeiou") for _ in range(80_000))
    prose = "".join(rng.choice(["the", "ing", "ation", "er", "in", "on", "re"]) for _ in range(20_000))
    coded = "".join(rng.choice("ABCdefGHIjkl0123456789+/") for _ in range(60_000))
    han = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(20_000))
    own = sentencepiece_bpe.encoder(path)
    own.encode_words(["warm"])
    for text in (letters, prose, coded, han, "a" * 50_000, "ab " * 3_000 + letters[:3_000] + "\U0001f600" * 3_000, " " * 5_000 + "x"):
        began = time.time()
        assert next(iter(sentencepiece_bpe.encode_each(path, [text]))) == library.encode(text)
        assert time.time() - began < 8


def test_packing_spreads_rows_without_ids_or_text(spark):
    """Rows without an id, with one id and without tokens fall into all shards, not into one."""
    for rows in ([(None, "a b c")] * 600, [(7, "a b c")] * 600, [(i, "") for i in range(600)]):
        sizes = packing.pack(documents(spark, rows), shard_rows=100).groupBy("shard").count().collect()
        assert sum(r["count"] for r in sizes) == 600 and len(sizes) == 6 and max(r["count"] for r in sizes) < 200
