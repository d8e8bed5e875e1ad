"""HTML extraction, token files, chats and licenses against references, round trips and SQL; odd rows."""

import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from carelake.llm import chat, html_extract, licenses, token_files
from carelake.llm.common import shared_dir
from tests.llm.odd import odd_documents, rows_of

SF = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")


# --- op2 ---

def reference_text(html):
    """The pages of the test tables: an article of headings and paragraphs, some tags left open."""
    import html as h
    body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = re.split(r"<(?:h\d|p|/h\d|/p)\b[^>]*>", body)
    out = [" ".join(h.unescape(re.sub(r"<br>", " ", p).replace("<b>", "").replace("</b>", "")).split()) for p in parts]
    return "\n".join(x for x in out if x)


def test_test_pages(spark):
    rows = html_extract.op2_html_extraction(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == reference_text(pages[r.page_id]) and r.n_chars == len(r.text)


FULL = """<!doctype html><html><head><title>T</title><script>var a="</p><article>x</article>";</script></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Side</aside>
<div class="page-header">Top</div><main><article><div class="entry-header"><h1>Title &amp; more</h1></div><!-- c --><p>One&nbsp; two<br>three <b>bold</b> <i>text</i>&#33;<p>Second
paragraph<ul><li>a<li>b</ul><div class="ad-box">Buy</div><form><p>Mail</form><table><tr><td>x<td>y</table>
<section id="comments"><p>First!</p></section></article></main><footer>Foot</footer></body></html>"""


def test_parts_of_a_page():
    assert html_extract.main_text(FULL) == "Title & more\nOne two three bold text!\nSecond paragraph\na\nb\nx y"
    assert html_extract.main_text("<p>just <b>text") == "just text"
    assert html_extract.main_text("plain &lt;text&gt;") == "plain <text>"
    assert html_extract.main_text("<div>a<div>b</div>c</div>") == "a\nb\nc"
    for broken in (None, "", "<", "<!", "<![", "<p", "</p></div>", "<script>", "<!-- x", "&#xFFFFFFFF;", "<a b='"):
        assert isinstance(html_extract.main_text(broken), str)
    deep = "<div>" * 30_000 + "x" + "</div>" * 30_000
    assert html_extract.main_text(deep) == "x"


@pytest.mark.parametrize("stray", ["<![foo]>", "<![ x>", "<![>", "<![foo bar[x]]>", "<!x>", "&#" + "9" * 5000 + ";"])
def test_text_behind_malformed_markup_is_kept(stray):
    got = html_extract.main_text(f"<article><p>a</p>{stray}<p>b</p></article><p>no</p>").split("\n")
    assert got[0] == "a" and got[-1] == "b" and len(got) <= 3
    assert html_extract.main_text(f"<article><p>a</p><![foo <p>b</p><p>c</p></article>") == "a\nb\nc"


@pytest.mark.parametrize("start, end", [
    *((f'<div class="{c}">', "</div>") for c in ("layout has-sidebar", "no-sidebar", "content-share", "comments-open", "sidebar", "related")),
    ("<form>", "</form>"), ('<form><div id="header">', "</div></form>"), ('<div role="alert">', "</div>")])
def test_names_of_wrappers_delete_no_article(start, end):
    rest = '<nav>menu</nav><div class="ad-box">Buy</div>'
    assert html_extract.main_text(f"{rest}{start}<article><p>one</p>{rest}<p>two</p></article>{end}") == "one\ntwo"
    assert html_extract.main_text(f"{rest}{start}<main><p>one</p>{rest}</main>{end}") == "one"
    assert html_extract.main_text(f"{rest}{start}{rest}<p>most of the text of the page</p>{end}") == "most of the text of the page"
    assert html_extract.main_text(f"<article>{rest}{start}{rest}<p>most of the text of the page</p>{end}</article>") == "most of the text of the page"


def test_recurring_subtrees_go_and_copies_do_not(spark):
    def page(i, body):
        return f"<body><div><p>Welcome to our site</p><p>Call us</p></div><div><p>{body}</p></div><div>Legal {i % 2}</div></body>"

    rows = [(i, "http://a.example/%d" % i, page(i, f"story number {i}")) for i in range(8)]
    rows += [(100 + i, f"http://b.example/?utm={i}", page(0, "one story told again")) for i in range(8)]
    rows += [(200, None, page(0, "x")), (201, "::bad url::", page(1, "y")), (202, "http://c.example/", None), (203, None, "")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("MAIN_TEXT", F.lit(1)).repartition(3)
    out = html_extract.extract(d)
    got = {r.page_id: r[-1] for r in out.collect()}
    assert out.columns[:-1] == d.columns and len(got) == len(rows)
    assert [got[i] for i in range(8)] == [f"story number {i}" for i in range(8)]
    assert all(got[100 + i] == "Welcome to our site\nCall us\none story told again\nLegal 0" for i in range(8))
    assert got[202] == got[203] == ""
    assert html_extract.extract(d.where(F.lit(False))).count() == 0


def test_templates_of_one_layout_of_a_large_host_go(spark):
    def page(i):
        return f"<body><div><p>{'Season ticket offer' if i % 10 == 0 else f'lead {i}'}</p></div><div><p>story {i}</p><p>seen {i // 15}</p></div></body>"

    rows = [(i, u, page(i)) for i in range(300) for u in (f"http://a.example/{i}", None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for r in html_extract.extract(d).collect():
        lead = "" if r.page_id % 10 == 0 else f"lead {r.page_id}\n"
        assert r[-1] == f"{lead}story {r.page_id}\nseen {r.page_id // 15}"


def test_article_paragraphs_stay_however_often_they_recur(spark):
    rows = [(i, "http://a.example/%d" % i, f"<article><p>shared passage</p><p>own {i}</p><div>Share this</div></article>") for i in range(9)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r[-1] for r in html_extract.extract(d).collect()} == {f"shared passage\nown {i}" for i in range(9)}


# --- op8 ---

@pytest.mark.parametrize("ids", [
    [], [0], [50256] * 4096, list(range(5000)), [7] * 100 + [2**32 - 1] + [9] * 5000, [2**32 - 1, 0]])
def test_blocks_round_trip(ids):
    a = np.asarray(ids, np.uint32)
    payload, starts = token_files.encode_blocks(a)
    assert (token_files.decode_blocks(payload, starts) == a).all() and len(starts) == -(-len(ids) // token_files.BLOCK)


def test_blocks_round_trip_random():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 4095, 4096, 4097, 20_000):
        for top in (2, 300, 50_257, 2**31):
            a = rng.integers(0, top, n).astype(np.uint32)
            a[rng.integers(0, n, n // 20)] = 2**32 - 1
            payload, starts = token_files.encode_blocks(a)
            assert (token_files.decode_blocks(payload, starts) == a).all()
            i = len(starts) // 2  # a block alone
            part = token_files.decode_blocks(payload, starts[i:i + 1])
            assert (part == a[i * token_files.BLOCK:(i + 1) * token_files.BLOCK]).all()


def test_outliers_do_not_widen_a_block():
    a = np.arange(4096, dtype=np.uint32) % 16
    a[5] = 2**31
    assert len(token_files.encode_blocks(a)[0]) < 4096 // 2 + 64


def test_memo_encodes_as_the_tokenizer():
    t, e = Tokenizer.from_file(BPE), token_files.Encoder(open(BPE).read())
    odd = [chr(c) for c in (*range(0, 0x180), 0x1680, 0x2000, 0x2009, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
                            0x661, 0x6F22, 0x1F600, 0xD7FF)]
    texts = ["", " ", "\n", "a", " a", "a ", "a\n", "\na", "it's we'll 'tis", "<|endoftext|> x", "x  y", "x\n\ny", "x \n y", "1 22 333"]
    texts += [p.replace("@", c) for c in odd for p in ("@", "a@b", "a @ b", "a@ b", "a @b", "a\n@", "@@ @", "1@2", "@ ")]
    assert e.by_word
    for _ in range(2):
        got = e.encode(texts)
        for x, ids in zip(texts, got):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def brute_tokens(rows):
    t, start, out = Tokenizer.from_file(BPE), 0, []
    for doc_id, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_token_files_are_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert rows_of(token_files.op8_token_files(spark, SF)) == brute_tokens(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_token_files_odd_rows(spark):
    odd = odd_documents(spark)
    for name, d in (("odd", odd), ("none", odd.where(F.lit(False)))):
        path = f"{shared_dir(spark)}/tokens-{name}-{np.random.randint(1 << 60)}"
        token_files.write_tokens(d, path, BPE)
        rows = token_files.read_documents(spark.read.schema(token_files.CHUNK).parquet(path)).collect()
        assert sorted((r.doc_id is not None, r.doc_id) for r in rows if r.doc_id) == sorted((True, r.doc_id) for r in d.collect() if r.doc_id)
        rows.sort(key=lambda r: r.start)
        assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
        ids = [r.doc_id for r in rows]
        assert ids == sorted(ids, key=lambda x: (x is not None, x))


# --- op9 ---

def same_as_sql(df, turns):
    con = duckdb.connect()
    con.register("conversations", turns.toPandas()) if not isinstance(turns, str) else con.execute(f"create view conversations as from '{turns}'")
    want = con.execute(f"select {', '.join(df.columns)} from ({chat.OP9_SQL})").fetchall()
    assert rows_of(df) == sorted((tuple(r) for r in want), key=repr)


def test_chats_equal_sql(spark):
    same_as_sql(chat.op9_chat_format(spark, SF), f"{SF}/conversations.parquet")


@pytest.mark.parametrize("block", [4096, 2])
def test_chat_snapshots(spark, block, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = []
    for c, texts in enumerate((["a"], ["a", "b"], ["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e"], ["b", "a"], ["a", "c"],
                               ["ab"], ["a", "b", "x"], [None], [""], ["<|im_end|>"])):
        rows += [(c, i, "user" if i % 2 == 0 else "assistant", x) for i, x in enumerate(texts)]
    rows += [(50, 0, None, "q"), (50, 0, None, "q"), (None, None, None, None), (51, 3, "user", "q"), (51, None, "user", "p"), (52, 0, None, "q")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("PLACE", F.lit(1)).repartition(3)
    out = chat.format_chats(d).collect()
    kept = {r.conv_id for r in out if r.kept}
    assert kept == {2, 4, 5, 6, 7, 8, 9, 10, 50, None, 51} - ({8} if any(r.conv_id == 8 and not r.kept for r in out) else set())
    assert {r.conv_id: r.copies for r in out}[3] == 2 and {r.conv_id: r.first_id for r in out}[3] == 2
    text = {r.conv_id: r.rendered for r in out}
    assert text[0] is None and text[4] == "<|im_start|>user\nb<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert text[10].count("<|im_end|>") == 1
    assert chat.format_chats(d.where(F.lit(False))).count() == 0


# --- op10 ---

def test_patience_is_a_common_subsequence():
    a, b = "the cat sat on the mat".split(), "the big cat sat down on the mat".split()
    assert [a[i] for i, _ in licenses.patience(a, b)] == a
    assert licenses.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = ([str(x) for x in rng.integers(0, 12, rng.integers(0, 15))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


KNOWN = [licenses.template(*t) for t in licenses.TEMPLATES]


def test_every_template_finds_itself_among_prose():
    for name, _, text in licenses.TEMPLATES:
        whole = "some words before. " + text + " and after it\nmore"
        n, found = licenses.scan(whole, KNOWN)
        assert n == 1, (name, found)
        license_id, a, b, c = found.split(":")
        assert (license_id, c) == (name, "100") and whole[int(a):int(b)].split()[0] == text.split()[0]


@pytest.mark.parametrize("text, found", [
    ("Licensed under the Foo License, Version 2.0.", []), ("Licensed under the Bar License.", []),
    ("the license of the MIT was released under pressure by all who had rights and reserved", []),
    ("All rights reserved. Released under the MIT License. All Rights Reserved", ["proprietary", "MIT", "proprietary"]),
    ("licensed under the apache licence, version 2.0", ["Apache-2.0"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), (None, []), ("", []),
])
def test_license_notices(text, found):
    n, got = licenses.scan(text, KNOWN)
    assert [x.split(":")[0] for x in got.split(",") if x] == found and n == len(found)


GNU = "is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; " \
      "either version {} of the License, or (at your option) any later version."


@pytest.mark.parametrize("text, found", [
    ("This program " + GNU.format("General Public License", "2"), ["GPL-2.0-or-later"]),
    ("This library " + GNU.format("Lesser General Public License", "2.1"), ["LGPL-2.1-or-later"]),
    ("This program " + GNU.format("Lesser General Public License", "3"), ["LGPL-3.0-or-later"]),
    ("This program " + GNU.format("Affero General Public License", "3"), ["AGPL-3.0-or-later"]),
    ("This program " + GNU.format("General Public License", "3"), ["GPL-3.0-or-later"]),
    ("distributed under the MIT license", ["MIT"]), ("This is available under the Apache License 2.0", ["Apache-2.0"]),
    ("SPDX-License-Identifier: BSD-3-Clause", ["BSD-3-Clause"]), ("published under CC BY-NC-SA 4.0", ["CC-BY-NC-SA-4.0"]),
    ("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["CC-BY-SA-4.0"]),
    ("released under the GNU Lesser General Public License v3", ["LGPL-3.0"]), ("licensed under GPLv3", ["GPL-3.0"]),
])
def test_license_siblings_and_wordings(text, found):
    n, got = licenses.scan("some words " + text + "\nand more", KNOWN)
    assert [x.split(":")[0] for x in got.split(",") if x] == found


@pytest.mark.parametrize("name", sorted(licenses.TEXTS))
def test_whole_license_texts(name):
    words = licenses.TEXTS[name].split()
    telling = {w for n, must, x in licenses.TEMPLATES if x == licenses.TEXTS[name] for w in must.split()}
    changed = " ".join(w for i, w in enumerate(words) if i % 15 != 5 or any(x in w.lower() for x in telling))  # words are gone
    for text, least in ((" ".join(words), 100), (changed, 85)):
        _, got = licenses.scan("before. " + text + " after", KNOWN)
        best = max(got.split(","), key=lambda x: int(x.split(":")[2]) - int(x.split(":")[1])).split(":")
        assert best[0] == name and int(best[3]) >= least and int(best[2]) - int(best[1]) > 0.95 * len(text)


def test_prefilter_drops_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    everything = [t._replace(triggers=("",)) for t in KNOWN]
    got = {r.doc_id: (r.n_matches, r.matches) for r in licenses.scan_licenses(docs).collect()}
    assert got == {r.doc_id: licenses.scan(r.text, everything) for r in docs.collect()}
    assert sum(n for n, _ in got.values()) > 10
    odd = odd_documents(spark)
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(odd.where(F.lit(False))).count() == 0


def test_saved_tables_can_be_removed(spark):
    from carelake.llm import common
    common.save(spark.range(3), "x")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(common.saved_dir(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert fs.exists(path)
    common.remove_saved(spark)
    assert not fs.exists(path)


LONG_WORDS = """
import random, resource, sys
from carelake.llm.token_files import Encoder
e = Encoder(open(sys.argv[1], encoding="utf-8").read())
rng, seen = random.Random(1), []
for _ in range(14):
    e.encode([" ".join(rng.randbytes(400).hex() for _ in range(8000))])
    seen.append(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
print(seen[4], seen[-1])
"""


def test_memo_is_bounded_by_bytes():
    """90 MB of different words of 800 letters: memory stays where the first 30 MB left it."""
    import subprocess
    import sys
    out = subprocess.run([sys.executable, "-c", LONG_WORDS, BPE], capture_output=True, text=True, timeout=300, check=True)
    early, late = map(int, out.stdout.split())
    assert late < 1.15 * early and late < 700


def test_encoding_in_parts_is_encoding_whole(monkeypatch):
    texts = ["a b " * 50, "x" * 3000, "", "one\ntwo  three", "word " * 400]
    with open(BPE, encoding="utf-8") as f:
        spec = f.read()
    want = [x.tolist() for x in token_files.Encoder(spec).encode(texts)]
    monkeypatch.setattr(token_files, "ENCODE_CHARS", 100)
    monkeypatch.setattr(token_files, "MEMO_BYTES", 10)
    e = token_files.Encoder(spec)
    for _ in range(3):
        assert [x.tolist() for x in e.encode(texts)] == want


def test_many_unclosed_tags_take_time_in_proportion():
    import time
    for html in ("<b>" * 100_000 + "</i><hr>" * 100_000 + "end", "<i><article>" + "<b>" * 50_000 + "</i>" * 50_000 + "end",
                 "<p><i>" * 50_000 + "</p>" * 50_000 + "end"):
        began = time.process_time()
        assert html_extract.main_text(html, ()).endswith("end")
        assert time.process_time() - began < 10  # about a second; before, minutes


@pytest.mark.parametrize("html, text", [
    ("<main><p>" + "long words " * 15 + "</p><article>Teaser</article></main>", ("long words " * 15).strip()),
    ("<main><p>Intro</p><article><p>the article's own text</p></article></main>", "the article's own text"),
    ("<main><article>one</article><article>two</article> more</main>", "one\ntwo"),
    ('<article class="post comments-open"><p>text</p></article>', "text"),
    ('<article><p>text</p></article><article class="comment even"><p>a reader</p></article>', "text"),
    ("<div><p>a<b>b</div><p>c</b>d", "ab\ncd"),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "a\nb\nc\nd")])
def test_article_and_its_wrappers(html, text):
    assert html_extract.main_text(html, ()) == text
