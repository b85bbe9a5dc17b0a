"""Operators over whole tables, against brute force, and defined results for odd tables."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import decontaminate, html_extract, langid, license_scan, near_dedup, pii, quality, sentencepiece_codec, token_count, token_output
from lodestrata.llm.common import shared_dir, table
from lodestrata.llm.queries import ORACLES, QUERIES

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")

# ------------------------------------------------------------------ near duplicates


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def got_components(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_of_documents(spark, sf_dir, k, percent):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got_components(near_dedup.near_duplicates(docs, near_dedup.Params(k, percent))) == brute_components(rows, k, percent)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_sql(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = c.execute(ORACLES[name])
    names, got = [d[0] for d in found.description], QUERIES[name](spark, sf_dir)
    assert set(names) == set(got.columns) and sorted(found.fetchall(), key=str) == sorted(map(tuple, got.select(names).collect()), key=str)


def test_partners_of_a_head_are_dealt_to_small_groups(spark):
    """A head of 27 small buckets, of a hot one, and of one with long texts: no group is large, and no pair is lost or doubled."""
    small = [(band, 1, 1000 * band + i, 100, 0, 40) for band in range(27) for i in range(1, 40)]
    again = [(band, 2, 1000 + i, 100, 0, 40) for band in range(27) for i in range(1, 40)]  # partners met in other buckets too
    hot = [(0, 3, 500_000 + i, 50, 1, 5000) for i in range(5000)]
    long = [(0, 4, 600_000 + i, 60_000, 2, 60) for i in range(60)]
    rows = small + again + hot + long
    buckets = near_dedup.salted(spark.createDataFrame(rows, "band int, key long, rep long, n_shingles long, head long, size long"), "rep")
    found = near_dedup._dealt(buckets).collect()
    assert sorted((r["a"], r["b"]) for r in found) == sorted({(rep, head) for _, _, rep, _, head, _ in rows})
    weight, texts, shingled = {(rep, head): n for _, _, rep, n, head, _ in rows}, {}, {}
    for r in found:
        texts[r["b"], r["g"]] = texts.get((r["b"], r["g"]), 0) + 1
        shingled[r["b"], r["g"]] = shingled.get((r["b"], r["g"]), 0) + weight[r["a"], r["b"]]
    assert max(texts.values()) <= near_dedup.GROUP and max(shingled.values()) <= near_dedup.BLOCK_SHINGLES
    assert len([1 for b, _ in texts if b == 0]) <= 2 * 27 * 39 / near_dedup.GROUP + 1


def test_near_duplicates_in_a_dense_group(spark):
    """Copies with many or few edits of one text: chains, near misses, and exact copies."""
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 500)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rnd.choice([0, 1, 2, 4, 6, 9])):
            words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 10**6)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, rows[i % 3][1]) for i in range(30)] + [(1, "short one"), (2, "Short  ONE"), (3, ""), (4, None), (5, " ")]
    got = got_components(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_dedup.Params(3, 85)))
    assert got == brute_components(rows, 3, 85) and len({c for _, c in got.values()}) > 10


def test_block_forest_joins_what_brute_force_joins():
    rnd, p = random.Random(3), near_dedup.Params(3, 85)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(60):
        words = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 5])):
            words[rnd.randrange(len(words))] = f"x{rnd.random()}"
        texts.append(" ".join(words))
    cache = near_dedup.word_cache()
    sets = [near_dedup.shingle_set(t, 3, cache) for t in texts]
    sig = np.stack([near_dedup.signature(s, p.factors) for s in sets])
    right = np.array([i % 2 == 0 for i in range(60)])
    links = near_dedup.join_block(np.arange(60), right, sig, texts, 0, p)
    there = near_dedup.involved(np.arange(60), right, sig, 0, p)
    assert there[[x for link in links for x in link]].all() and not near_dedup.involved(np.zeros(60), right, sig, 0, p).any()
    assert all(near_dedup.reaches(sets[a], sets[b], 85) and not right[a] and right[b] for a, b in links) and len(links) < 60
    label = list(range(60))
    for a, b in links:
        label = [label[a] if x == label[b] else x for x in label]
    for a in range(60):
        for b in range(60):
            if not right[a] and right[b] and near_dedup.reaches(sets[a], sets[b], 85):
                assert label[a] == label[b]


def test_bayesian_bounds():
    p = near_dedup.Params(3, 85)
    assert p.least[-1][0] == p.size and (1 - 0.85**p.rows) ** p.bands <= p.miss
    import math

    for n, m in p.least:  # dropping below m means a posterior under the bound
        tail = lambda x, n=n: sum(math.comb(n + 1, i) * 0.85**i * 0.15 ** (n + 1 - i) for i in range(x + 1))
        assert tail(m) >= p.miss and (m == 0 or tail(m - 1) < p.miss)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(25)]
    got = dict(near_dedup.components(spark.createDataFrame(edges, "u long, v long"), shared_dir(spark), "t").collect())
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: c for x, c in label.items() if x != c}


# ------------------------------------------------------------------ decontamination


def test_edit_search():
    rnd = random.Random(2)
    for _ in range(400):
        p, t = ([rnd.randint(0, 3) for _ in range(rnd.randint(1, n))] for n in (9, 20))
        row = [0] * (len(t) + 1)
        for x in p:
            new = [row[0] + 1]
            for j, y in enumerate(t, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        assert decontaminate.edit_search(p, t) == (min(row), row.index(min(row)))


def test_leaks_are_found_and_clean_texts_left(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 6)))
    items = [(i, [word() for _ in range(rnd.randint(12, 60))]) for i in range(60)]
    rows, expected, far = [], {}, set()
    for i in range(300):
        item, words = rnd.choice(items)
        cut, edits = list(words), rnd.choice([0, 0, 1, 2, decontaminate.allowed(len(words)), len(words)])
        for _ in range(edits):
            at = rnd.randrange(len(cut))
            kind = rnd.choice("sid")
            cut[at : at + (kind != "i")] = [word()] if kind != "d" else []
        best, _ = decontaminate.edit_search(words, cut)
        text = " ".join([word() for _ in range(rnd.randint(0, 200))] + [rnd.choice([w, w.upper(), w + ","]) for w in cut] + [word() for _ in range(rnd.randint(0, 200))])
        rows.append((i, text))
        if best <= decontaminate.allowed(len(words)):
            expected[i] = item
        else:
            far.add(i)
    rows += [(1000 + i, " ".join(word() for _ in range(300))) for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(frame, bench).collect()}
    recall = sum((i, item) in found for i, item in expected.items()) / len(expected)
    assert recall >= 0.97 and all(i < 1000 for i, _ in found)
    by = dict(rows)
    for (i, item), r in found.items():
        own = dict(items)[item]
        best = decontaminate.edit_search(own, [w.decode() for w in decontaminate.words_of(by[i])])[0]
        assert r["edits"] == best <= decontaminate.allowed(len(own))
    clean = {r["doc_id"] for r in decontaminate.decontaminate(frame, bench).collect()}
    assert clean == set(by) - {i for i, _ in found}


@pytest.mark.parametrize("n", [8, 12, 20, 30, 45, 60, 100, 200, 400])
def test_recall_at_the_edits_allowed(n):
    """Items of one length, each in a text with as many edits as are allowed, among random words."""
    rnd = random.Random(n)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    items = [[word() for _ in range(n)] for _ in range(80)]
    cache = near_dedup.word_cache()
    index = decontaminate.Items(list(range(80)), [decontaminate.hashes([w.encode() for w in item], cache) for item in items])
    found = 0
    for i, item in enumerate(items):
        cut = list(item)
        for _ in range(decontaminate.allowed(n)):
            at, kind = rnd.randrange(len(cut)), rnd.choice("sid")
            cut[at : at + (kind != "i")] = [word()] if kind != "d" else []
        text = " ".join([word() for _ in range(rnd.randint(0, 50))] + cut + [word() for _ in range(rnd.randint(0, 50))])
        found += i in [x[0] for x in index.search(text, cache)]
    assert found >= 0.97 * len(items)


def test_short_items_and_unspaced_scripts():
    cache, items = near_dedup.word_cache(), ["hello", "two words", "exactly three words", "one two three four five", "今日は天気がいいですね散歩に行きましょう", "สวัสดี"]
    index = decontaminate.Items(list(range(6)), [decontaminate.hashes(decontaminate.words_of(x), cache) for x in items])
    hits = lambda t: [x[0] for x in index.search(t, cache)]
    assert hits("say Hello, world") == [0] and hits("two or words") == [] and hits("just two words") == [1] and hits("hello") == [0] and hits("two") == []
    assert hits("Exactly three  words!") == [2] and hits("exactly four words") == [] and hits("x one two three four five y") == [3] and hits("one two three four six") == []
    assert hits("ok。今日は天気がいいですね、散歩に行きましょう。") == [4] and hits("今日は天気が悪いですね散歩に行きましょう") == [4] and hits("明日") == [] and hits("สวัสดีครับ") == [5]
    assert hits("") == [] and decontaminate.Items([], []).search("some words here", cache) == []


def test_item_blocks_give_the_same(spark, sf_dir, monkeypatch):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    whole = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 500)
    blocks = [sum(map(len, words)) for _, words in decontaminate.item_blocks(bench, "item_id", "text")]
    assert len(blocks) > 2 and max(blocks) < 600 and all(n >= 500 for n in blocks[:-1])
    assert sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect())) == whole
    # every item that stands in a text word by word is found
    words = {r["item_id"]: b" ".join(decontaminate.words_of(r["text"])) for r in bench.collect()}
    for r in docs.collect():
        joined = b" ".join(decontaminate.words_of(r["text"]))
        assert {i for i, w in words.items() if w in joined} <= {i for d, i, *_ in whole if d == r["doc_id"]}


# ------------------------------------------------------------------ html


def text_of(page):
    return html_extract.main_text(html_extract.blocks(page), None)


def test_end_tags_stop_at_blocks_and_formulas_stay():
    assert text_of("<body><span><article><p>one</p></span><p>two</p></article><p>menu</p>") == "one\n\ntwo"
    assert text_of("<body><article><p>energy <math><mi>E</mi>=m</math> is <object data=x>fallback</object></p></article>") == "energy E=m is fallback"
    assert text_of('<body><article><span class="ad"><div>x</span> y</div></span><p>z</p></article>') == "z"
    assert text_of("<body><article><a href=x><div>one</a> two</div><p>three <b>four</p><p>five</b> six</p></article>") == "one two\n\nthree four\n\nfive six"
    assert text_of("<body><article><table><tr><td>a</span></td><td>b</td></tr></table></article>") == "a b"


def test_html_cases():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body class="with-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>no</p> --><div class="ad">buy</div>
    <article><h1>The &amp; title</h1><p>First&nbsp;one <b>bold</b> &lt;3<br>next  line<p>Second<p class="share">Share</p>
    <aside>side</aside><ul><li>item 1<li>item 2</ul><form><p>mail</p></form><table><tr><td>a<td>b</table><div id="comments"><p>me too</p></div>&copy; end &#233;&#x4e2d;</article>
    <div class="cookie-notice"><p>cookies</p></div><footer>foot</footer></body></html>"""
    assert text_of(page).split("\n\n") == ["The & title", "First one bold <3 next line", "Second", "item 1", "item 2", "a b", "© end é中"]
    assert text_of("just text") == "just text" and text_of("") == "" and text_of("<p>a < b</p><p>c") == "a < b\n\nc"
    assert text_of("<div><p>x</p><div class='comment-list'>y</div></div><p>z") == "x\n\nz"
    assert text_of("<main><p>in</p></main><p>out</p>") == "in" and text_of("<p>a</p></div></p><script>x") == "a"
    assert text_of("<article class='comment'>c</article><article><p>real</article>") == "real"
    assert text_of('<p title="a > b">t</p><a href="x" hidden>h</a>') == "t"
    for junk in ("<" * 50_000, "<a " * 20_000, "<div>" * 20_000 + "x", "<p>" * 20_000, '<a "' * 3_000, "</p>" * 20_000):
        text_of(junk)


def test_wrappers_of_an_article_and_longer_class_names_stay():
    assert text_of("<div class='layout with-sidebar'><p>out</p><article>in</article></div>") == "in"
    assert text_of("<form><p>out</p><article><p>in</p><form>mail</form></article></form>") == "in"
    assert text_of("<div id='sidebar'><div class='header'><main>in</main></div></div>") == "in"
    assert text_of("<article>a<p class='share-price'>12 EUR<p class='share-buttons'>tweet</article>") == "a\n\n12 EUR"
    assert text_of("<article>a</article><div class='comments'><article>me too</article></div>") == "a"
    assert text_of("<div><p>a</div><div class='comments'><article>me too</article></div>") == "a"
    assert text_of("<aside><article>teaser</article></aside><p>text") == "text" and text_of("<div class='ad' hidden><article>x</article></div><p>y") == "y"
    assert text_of("<div class='sidebar'>x</div><p>y") == "y" and text_of("<div class='ad ad-300x250 top'>x</div><p>y") == "y"


def test_left_out_end_tags_and_nested_articles():
    assert text_of("<html><head><title>t</title><meta x><body><p>kept<p>all") == "kept\n\nall" and text_of("<head><style>p{}</style><p>first<p>second") == "first\n\nsecond"
    assert text_of("<p>a<form action='/s'><input><p>b</p><div>c</div>") == "a\n\nb\n\nc" and text_of("<p>a<form>q</form><p>b<form><p>c") == "a\n\nb\n\nc"
    assert text_of("<article><p>story</p><section><article><p>a comment</p></article><article>another</article></section><p>end</p></article>") == "story\n\nend"
    assert text_of("<article><div><article><p>inner only</p></article></div></article>") == "inner only"
    for junk in ("<form>" * 20_000 + "x", "<article>" * 5_000 + "x", "<head>" * 20_000 + "<p>x"):
        assert text_of(junk) == "x"


def test_notices_inside_articles_go_and_shared_passages_stay(spark, monkeypatch):
    notice, passage, teaser = "please sign up for our letter that comes each week", "a passage that is quoted in the articles of several pages", "the lead of story seven is shown beside all other stories"
    rows = []
    for i in range(12):
        inside = f"<p>{notice}</p>" * (i < 5) + f"<p>{passage}</p>" * (i % 2) + (f"<p>{teaser}</p>" if i == 7 else "")
        rows.append((i, "http://n.example.com/", f"<nav><p>{teaser}</p></nav><article><p>story {i}</p>{inside}</article>" + f"<div class='ad'><p>{notice}</p></div>" * (i > 7)))
    rows.append((20, "http://n.example.com/only", f"<article><p>{notice}</p></article>"))
    rows += [(30 + i, "http://other.example.com/", f"<article><p>story {i}</p><p>{notice}</p></article>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = lambda: {r["page_id"]: r["text"].split("\n\n") for r in html_extract.extract_main_text(pages).collect()}
    one = texts()
    for i in range(12):
        assert one[i] == [f"story {i}"] + [passage] * (i % 2) + [teaser] * (i == 7)
    assert one[20] == [notice] and one[30] == ["story 0", notice]
    for pages_of_a_shard in (2, 3):
        monkeypatch.setattr(html_extract, "SHARD_PAGES", pages_of_a_shard)
        assert texts() == one


def test_long_pages_make_shards(spark, monkeypatch):
    menu = "all our shops sell fresh bread every single day of the week"
    rows = [(i, "http://x.example.com/", f"<p>{menu}</p><p>page {i} " + f"w{i} " * 2000 + "</p>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = lambda: {r["page_id"]: r["text"] for r in html_extract.extract_main_text(pages).collect()}
    one = texts()
    monkeypatch.setattr(html_extract, "SHARD_BYTES", 20_000)
    assert texts() == one and all(menu not in t and t.startswith(f"{i} w{i}") for i, t in one.items())


def test_suffix_array_cover():
    rnd = random.Random(4)
    for _ in range(40):
        boiler = [f"b{i}" for i in range(12)]
        streams = [[f"u{rnd.random()}" for _ in range(rnd.randint(0, 9))] + (boiler if rnd.random() < 0.7 else boiler[:6]) + [f"v{rnd.random()}"] for _ in range(8)]
        streams += [streams[0]] * 3
        covers = html_extract.repeated_cover(streams, 8, 3)
        where = {}
        for i, s in enumerate(streams):
            for k in range(len(s) - 7):
                where.setdefault(tuple(s[k : k + 8]), set()).add(tuple(s))
        for s, c in zip(streams, covers):
            expected = [any(k <= j < k + 8 and len(where[tuple(s[k : k + 8])]) >= 3 for k in range(max(0, j - 7), min(j, len(s) - 8) + 1)) for j in range(len(s))]
            assert c.tolist() == expected
    order, rank = html_extract.suffix_ranks(np.array([2, 1, 2, 1, 2, 0]), 8)
    assert order.tolist() == sorted(range(6), key=lambda i: [2, 1, 2, 1, 2, 0][i:]) and rank[order].tolist() == list(range(6))


def test_boilerplate_of_a_host_goes_and_unique_runs_stay(spark, monkeypatch):
    menu = "all our shops sell fresh bread every single day of the week"
    rows = [(i, "http://Shop.example.com:80/x" if i < 8 else None, f"<div><p>{menu} story {i} tells of number {i} alone</p><p>own block {i}</p></div>") for i in range(9)]
    rows.append((9, "http://shop.example.com/y", None))
    monkeypatch.setattr(html_extract, "SHARD_PAGES", 100)
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "3 tells of number 3 alone\n\nown block 3" and got[8].startswith(menu) and got[9] == ""
    monkeypatch.setattr(html_extract, "SHARD_PAGES", 2)  # a host over its shards, joined rather than broadcast
    monkeypatch.setattr(html_extract, "BROADCAST_HOSTS", 0)
    assert html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).count() == 10


def test_notices_around_different_articles_are_boilerplate(spark):
    notice = "this site is run by the friends of the old town library"
    rows = [(i, "http://a.example.com/", f"<div>{notice}</div><article><p>story {i}</p></article>") for i in range(5)]
    rows.append((5, "http://a.example.com/", f"<div>{notice}</div><p>no article here</p>"))
    rows += [(10 + i, "http://b.example.com/", f"<div>{notice}</div><article><p>one story</p></article>") for i in range(5)]  # equal pages
    rows.append((15, "http://b.example.com/", f"<div>{notice}</div><p>no article here</p>"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[5] == "no article here" and got[15] == f"{notice}\n\nno article here" and got[0] == "story 0" and got[10] == "one story"


@pytest.mark.parametrize("broadcast", [0, 100])
def test_shards_of_a_host_give_what_one_array_gives(spark, monkeypatch, broadcast):
    rnd = random.Random(9)
    notices = [" ".join(f"n{k}w{j}" for j in range(9 + k)) for k in range(12)]
    rows = []
    for i in range(160):  # notice k stands on about k pages, of the host's many shards
        own = [f"<p>{n}</p>" for k, n in enumerate(notices) if rnd.random() < k / 160] + [f"<p>page {i} tells of u{i} alone</p>"]
        rnd.shuffle(own)
        body = "".join(own)
        rows.append((i, f"http://{'big' if i < 150 else 'small'}.example.com/{i}", f"<div>{body}</div>" + (f"<article>story {i}</article>" if i % 3 == 0 else "")))
    rows += [(200 + i, "http://big.example.com/copy", "<p>these words stand on many copies of one page only</p>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = lambda: {r["page_id"]: r["text"] for r in html_extract.extract_main_text(pages).collect()}
    monkeypatch.setattr(html_extract, "SHARD_PAGES", 1000)
    one = texts()
    monkeypatch.setattr(html_extract, "SHARD_PAGES", 10)
    monkeypatch.setattr(html_extract, "BROADCAST_HOSTS", broadcast)
    monkeypatch.setattr(html_extract, "BROADCAST_RUNS", broadcast)
    assert texts() == one and one[200].startswith("these words")
    left = {n for n in notices if any(n in t for t in one.values())}
    assert 0 < len(left) < len(notices)


def test_array_judges_pages_without_an_article(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("html", F.regexp_replace("html", "</?article[^>]*>", ""))
    got = {r["page_id"]: r["text"].split() for r in html_extract.extract_main_text(pages).collect()}
    found, where = {}, {}
    for r in pages.collect():
        bs = html_extract.blocks(r["html"])
        host = re.match("https?://([^/:]*)", r["url"]).group(1)
        found[r["page_id"]] = host, [(t, links) for _, text, links in bs for t in text.split()]
        assert bs and all(z == html_extract.OTHER for z, _, _ in bs)
        words = [t for t, _ in found[r["page_id"]][1]]
        for k in range(len(words) - 7):
            where.setdefault((host, *words[k : k + 8]), set()).add(tuple(bs))
    removed = 0
    for i, (host, words) in found.items():
        covered = {k + d for k in range(len(words) - 7) if len(where[(host, *[t for t, _ in words[k : k + 8]])]) >= 3 for d in range(8)}
        assert got[i] == [t for k, (t, links) in enumerate(words) if k not in covered and not links]
        removed += len(covered)
    assert removed < 0.05 * sum(len(w) for _, w in found.values())


def test_pages_keep_their_articles(spark, sf_dir):
    import html

    pages = table(spark, sf_dir, "pages")
    got = {r["page_id"]: r for r in html_extract.extract_main_text(pages).collect()}
    for r in pages.collect():
        inner = r["html"].split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        expected = "\n\n".join(b for b in blocks if b)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (expected, len(expected))


# ------------------------------------------------------------------ odd tables

EXTRA = "kept boolean, score double, id long, n_tokens long, spans string, lang_pred string, u long, rep long, key string, a long, __text string, host string"


@pytest.fixture(scope="module")
def odd(spark):
    long = "wort " * 60_000
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (None, "some text here", "en", "s", 14), (4, "same text twice over", "en", "s", 20), (4, "same text twice over", "en", "s", 20), (4, "another text, same id", None, "s", 5), (5, long, "de", "s", len(long)), (6, " \n\t", "fr", "s", 3), (7, "mail a@b.co, 10.0.0.1", "en", None, 21), (8, "x" * 100_000, "de", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for f in EXTRA.split(", "):
        name, kind = f.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def each_operator(spark, docs, labels):
    model = langid.train(langid.learning_rows(docs))
    yield "pii", pii.pii_digest(docs)
    yield "redact", pii.redact_pii(docs)
    yield "codec", sentencepiece_codec.codec_digest(docs, PIECES)
    yield "decode", sentencepiece_codec.decode_pieces(sentencepiece_codec.encode_pieces(docs, PIECES), PIECES)
    yield "quality", quality.quality_rules(docs, quality.quality_model(docs, labels))
    yield "license", license_scan.license_scan(docs)
    yield "near", near_dedup.near_duplicates(docs)
    yield "count", token_count.count_tokens(docs, PIECES)
    yield "langid", langid.identify(docs.withColumn("held_out", langid.held_out()), model, ["doc_id", "held_out"])
    yield "spans", langid.language_spans(docs, model)
    yield "tokens", token_output.encode_and_read(docs, WORDS)
    yield "html", html_extract.extract_main_text(docs.withColumnsRenamed({"doc_id": "page_id", "source": "url", "text": "html"}))


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, 0, None), (None, 1, 0), (1, None, 1)], "doc_id long, quality int, toxic int")
    got = {}
    for name, df in each_operator(spark, odd, labels):
        got[name] = df.collect()
        assert len(got[name]) == 10, name
    near = {(r["doc_id"], r["n_shingles"]): r for r in got["near"]}
    assert near[1, 0]["kept"] and near[None, 1]["component_id"] is None and near[None, 1]["kept"] and near[4, 1]["component_id"] == 4
    assert {r["lang_pred"] for r in got["langid"] if r["doc_id"] in (1, 2, 6)} == {"und"}
    tokens = sorted(got["tokens"], key=lambda r: r["start"])
    assert [r["start"] for r in tokens] == np.cumsum([0] + [r["n_tokens"] for r in tokens])[:-1].tolist() and tokens[0]["doc_id"] is None
    assert sorted(r["n_tokens"] for r in tokens)[:3] == [1, 1, 1]
    redacted = {r["doc_id"]: r for r in got["redact"]}
    assert redacted[7]["text"] == "mail [EMAIL], [IP]" and redacted[7]["n_chars"] == 18 and redacted[1]["text"] is None and got["redact"][0].asDict().keys() == set(odd.columns)
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "some text here"), (3, "same text twice over and more"), (4, "wort " * 12)], "item_id long, text string")
    found = lambda least: sorted((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.find_leaks(odd, bench, min_words=least).collect())
    assert found(1) == [(5, 4)] and found(13) == []


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, df in each_operator(spark, none, labels):
        assert df.collect() == [] and df.columns, name
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(odd, bench).count() == 0 and decontaminate.decontaminate(odd, bench).count() == 10 and decontaminate.find_leaks(none, bench).count() == 0


# ------------------------------------------------------------------ the pipeline


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    bench = table(spark, sf_dir, "benchmark")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "benchmark_decontamination", "personal_data", "sentencepiece"]
    before, stages = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf_dir)
        assert name == "sentencepiece" or after.columns == docs.columns
        after = spark.createDataFrame(after.collect(), after.schema)
        stages[name] = (before.collect(), after.collect())
        before = after
    ids = lambda rows: {r["doc_id"] for r in rows}
    a, b = stages["language_id"]
    assert ids(b) == {r["doc_id"] for r in a if re.search(r"[^\W\d_]", r["text"])}
    a, b = stages["near_duplicates"]
    assert ids(b) == {i for i, (_, c) in brute_components([(r["doc_id"], r["text"]) for r in a], 5, 80).items() if i == c}
    a, b = stages["benchmark_decontamination"]
    items = [b" ".join(decontaminate.words_of(r["text"])) for r in bench.collect()]
    assert ids(b) == {r["doc_id"] for r in a if not any(x in b" ".join(decontaminate.words_of(r["text"])) for x in items)}
    a, b = stages["personal_data"]
    assert ids(a) == ids(b) and all(not pii.find_spans(r["text"]) and len(r["text"]) == r["n_chars"] for r in b)
    a, b = stages["sentencepiece"]
    assert {r["doc_id"]: r["text"] for r in a} == {r["doc_id"]: r["decoded"] for r in b}
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, b))


def test_pipeline_on_odd_and_empty_documents(spark, odd, sf_dir):
    for source, expected in ((odd, [None, 4, 4, 5, 7, 8]), (odd.limit(0), [])):
        docs = source
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, sf_dir)
            assert i == 4 or docs.columns == odd.columns
            if i == 0 and expected:  # rows without a letter go
                assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 4, 4, 4, 5, 7, 8]
        rows = docs.collect()
        assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["doc_id"] or 0)] == expected
        if expected:  # of two equal rows one stayed, personal data is gone, texts are whole
            assert {r["decoded"] for r in rows if r["doc_id"] == 4} == {"same text twice over", "another text, same id"}
            assert [r["decoded"] for r in rows if r["doc_id"] == 7] == ["mail [EMAIL], [IP]"] and [len(r["decoded"]) for r in rows if r["doc_id"] == 5] == [300_000]


def test_every_operator_is_registered():
    assert [m.group(1) for n in QUERIES if (m := re.match(r"op(\d+)_", n))] == [str(i) for i in range(1, 11)] and ORACLES.keys() <= QUERIES.keys()


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        Session.sparkContext.master = master
        with pytest.raises(ValueError):
            shared_dir(Session)
    for master in ("local", "local[4]", "local[*]"):
        Session.sparkContext.master = master
        assert shared_dir(Session).startswith("file:///")
