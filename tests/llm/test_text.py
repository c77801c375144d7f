import hashlib
import random
import re
import time
import zlib
from collections import Counter
from math import log2

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siteloom.llm import bpe, common, language_id, packing, page_text, queries, secrets

PATTERN = public_tokenizers.PATTERN


# Byte-level BPE


def test_bpe_equals_whole_text_encoding(spark, docs, sf_dir):
    odd = [
        (1, "x" * 700 + " tail  of words \n" * 20),  # no boundary in an overlap
        (2, (" " * 90 + "a") * 9),
        (3, "don't I'LL  2024 漢字 é😀 " * 30),
        (3, "don't I'LL  2024 漢字 é😀 " * 30),
    ]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = rows.unionByName(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    encode = bpe.encoding(queries.RANKS, PATTERN).encode_ordinary
    want = Counter((x.doc_id, tuple(encode(x.text or ""))) for x in rows.collect())
    found = bpe.encode(rows, queries.RANKS, PATTERN, chunk=150, overlap=40)
    assert Counter((x.doc_id, tuple(x.ids)) for x in found.collect()) == want
    texts = Counter((x.doc_id, (x.text or "").encode()) for x in rows.collect())
    back = bpe.decode(found, queries.RANKS)
    assert Counter((x.doc_id, bytes(x.bytes)) for x in back.collect()) == texts


def test_bpe_empty_table(no_docs):
    assert bpe.encode(no_docs, queries.RANKS, PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(no_docs, queries.RANKS, PATTERN, chunk=10, overlap=11)


def test_boundaries_are_not_after_white_space():
    text = "ab  c\nd e don't 2024 漢字 é😀 x  "
    found = bpe.boundaries(text, PATTERN)
    assert found and not [p for p in found if text[p - 1].isspace()]


# Packing


def test_cuts_cover_and_fit():
    for n in [*range(1, 5000, 7), 2047, 2048, 2049, 4096]:
        cuts = packing.harmonic_cuts(n)
        assert sum(cuts) == n and max(cuts) <= 2048
        for x in cuts:
            place = 2048 // (2048 // x)
            assert place - x <= place / 32


def _packed(docs):
    rows = queries.pack_documents(docs).collect()
    bins = {}
    for x in sorted(rows, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == bins.get(x.sequence_id, 0)
        bins[x.sequence_id] = x.offset + x.length
    assert all(x <= 2048 for x in bins.values())
    return rows, bins


def test_packing_equals_the_tokenizer(spark, sf_dir, docs):
    own = spark.createDataFrame([(5000, "special <|endoftext|> text")], "doc_id long, text string")
    rows = common.read_table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(own)
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    packed, bins = _packed(rows)
    want = {}
    for x in rows.collect():
        want[x.doc_id] = np.array([*tokenizer.encode(x.text or "", add_special_tokens=False).ids, 1], "<u4")
    seen = Counter()
    for x in packed:
        ids = want[x.doc_id]
        assert x.doc_tokens == len(ids) and x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length])
        seen[x.doc_id] += x.length
    assert seen == {i: len(x) for i, x in want.items()}
    assert sum(bins.values()) > 0.97 * 2048 * len(bins)


def test_packing_odd_rows(docs, no_docs):
    rows, _ = _packed(docs)
    assert Counter(x.doc_id for x in rows if x.start == 0) == Counter(x.doc_id for x in docs.collect())
    assert [x.doc_tokens for x in rows if x.doc_id in (3, 4)] == [1, 1]
    assert queries.pack_documents(no_docs).count() == 0


def test_pieces_hold_their_ids(docs):
    for x in packing.token_pieces(docs, queries.TOKENIZER, queries.RANKS, PATTERN).collect():
        assert len(x.ids) == x.length and zlib.crc32(np.array(x.ids, "<u4")) == x.ids_crc32


# Language


def test_held_out_accuracy(spark, sf_dir):
    rows = queries.op8_language(spark, sf_dir).collect()
    truth = {x.doc_id: x.lang for x in common.read_table(spark, sf_dir, "documents").collect()}
    assert len(rows) == len(truth)
    held = [x for x in rows if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1 for x in rows)
    assert sum(x.lang_pred == truth[x.doc_id] for x in held) >= 0.98 * len(held)


def test_language_odd_rows(spark, sf_dir, docs, no_docs):
    model = language_id.fit(common.read_table(spark, sf_dir, "documents"))
    rows = {x.doc_id: x for x in language_id.identify(docs, model).collect()}
    assert {rows[i].lang_pred for i in (3, 4, 5, 8)} == {"und"} and all(rows[i].rejected for i in (3, 4, 5, 8))
    assert rows[1].lang_pred in model.languages
    assert language_id.identify(no_docs, model).count() == 0
    nothing = language_id.fit(no_docs)
    assert {x.lang_pred for x in language_id.identify(docs, nothing).collect()} == {"und"}


def test_rejection_and_normalisation(spark, sf_dir):
    model = language_id.fit(common.read_table(spark, sf_dir, "documents"))
    names, scores, rejected = model.predict(["漢字かな交じり文" * 50, "the of and that with this for " * 20])
    assert rejected[0] and names[1] == "en" and not rejected[1]
    whole = language_id.letters("Ab  1c!")
    assert "".join(map(chr, whole)) == " ab c "
    # Long texts are scored in parts, to the same sum.
    text = language_id.letters("the of and that " * 400)
    want = model.cross_entropies([text])
    before = language_id.SEGMENT
    language_id.SEGMENT = 1000
    try:
        assert np.allclose(model.cross_entropies([text]), want, rtol=1e-5)
    finally:
        language_id.SEGMENT = before


def test_probabilities_sum_to_one(spark, sf_dir):
    model = language_id.fit(common.read_table(spark, sf_dir, "documents"))
    letters = sorted({chr(c) for c in range(97, 123)} | set("éèêçñóíáúüäößàù "))
    # Over characters of any kind the sum is one at most; these are nearly all of them.
    for context in ("the", "ent"):
        codes = [np.array(list(map(ord, context + x)), np.uint32) for x in letters]
        total = sum(np.exp(model._sums([c], 3)[0]) for c in codes)
        assert (total < 1.001).all() and (total > 0.9).any()


def _brute_kneser_ney(streams, order, alphabet):
    """log p of each gram seen, by dictionaries: interpolated Kneser-Ney with continuation counts below the order."""
    counts = [Counter() for _ in range(order + 1)]
    for s in streams:
        for n in range(1, order + 1):
            for i in range(n == 1, len(s) - n + 1):
                counts[n][s[i : i + n]] += 1
    for n in range(1, order):
        before = {g: {w[0] for w in counts[n + 1] if w[1:] == g} for g in counts[n]}
        counts[n] = Counter({g: len(before[g]) or 1 for g in counts[n]})
    found = {}

    def p(gram):
        if not gram:
            return 1 / alphabet
        n = len(gram)
        ones, twos = sum(c == 1 for c in counts[n].values()), sum(c == 2 for c in counts[n].values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        same = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        if not total:
            return p(gram[1:])
        return max(same.get(gram, 0) - d, 0) / total + d * len(same) / total * p(gram[1:])

    for n in range(1, order + 1):
        for gram in counts[n]:
            found[gram] = np.log(p(gram))
    return found


def test_model_equals_brute_force_kneser_ney(spark):
    rows = [(1, "abracadabra abra", "a"), (2, "cadabra bar", "a"), (3, "lorem ipsum dolor", "b"), (4, "ipso lore", "b"), (5, "zed", "once")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), order=3, max_chars=10_000)
    assert model.languages == ["a", "b", "once"]
    # The language of one row is never held back; of the others, some rows may be.
    streams = [language_id.letters("zed").tobytes().decode("utf-32-le")]
    entries = sum((g.hashes.tolist() for g in model.grams[:1]), [])
    want = _brute_kneser_ney(streams, 3, len(entries) + 1)
    for gram, logp in want.items():
        n = len(gram)
        row = language_id._find(model.grams[n - 1].hashes, language_id.gram_hashes(np.array(list(map(ord, gram)), np.uint32), n)[n - 1])
        assert row[0] >= 0 and model._values(n, row)[0][0, 2] == pytest.approx(logp, abs=1e-5)
    # Filled tables give the same.
    text = [language_id.letters("abra lorem zed quux")]
    before = model.cross_entropies(text)
    model.fill()
    assert np.allclose(model.cross_entropies(text), before, atol=1e-6)


def test_every_language_is_learned(spark):
    rows = [(i, f"word{chr(97 + i % 26)} some text here {i}", "many") for i in range(60)] + [(1000 + i, f"only row {chr(97 + i)}", f"l{i:02d}") for i in range(20)]
    rows += [(None, "no key here", "nokey")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert model.languages == sorted({x[2] for x in rows})
    small = language_id.fit(df, max_entries=700)
    assert small.languages == model.languages and sum(len(g.lang) for g in small.grams) < sum(len(g.lang) for g in model.grams)


def test_identify_replaces_columns_of_its_own_names(spark, sf_dir):
    model = language_id.fit(common.read_table(spark, sf_dir, "documents"))
    df = spark.createDataFrame([(1, "the and of that with", "x", 5)], "doc_id long, text string, score string, lang_pred int")
    got = language_id.identify(df, model, keep=tuple(df.columns))
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "rejected"] and got.first().lang_pred == "en"


# Secrets


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _spans(text):
    base = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    added = []
    for kind in secrets.CLASSES:
        for m in re.finditer(kind.candidate, text):
            value, spans = m[0], []
            if not all(re.search(x, value) for x in kind.needs) or any(re.search(x, value) for x in secrets.ALLOW):
                continue
            for i in range(len(value) - 19):
                counts = Counter(value[i : i + 20]).values()
                if log2(20) - sum(c * log2(c) for c in counts) / 20 >= kind.threshold - 1e-9:
                    if spans and spans[-1][1] >= i:
                        spans[-1][1] = i + 20
                    else:
                        spans.append([i, i + 20])
            for a, b in spans:
                if any(re.search(x, value[a:b]) for x in secrets.PLACEHOLDERS):
                    continue
                a, b = a + m.start(), b + m.start()
                if not any(x[0] <= a and x[3] >= b for x in base):
                    added.append((a, secrets.KINDS.index(kind.kind), kind.kind, b))
    return sorted(base), sorted(base + added)


def _joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def test_secrets_equal_brute_force(spark, docs, sf_dir):
    odd = [
        "secret=token: abcdefghi",
        "A1b2C3d4E5f6G7h8I9j0KlMnOpQrStUv aaaaaaaaaaaaaaaaaaaaaaaaaaB1cD2eF3gH4iJ5kL6mN7oP8qR9",
        "00ff11EE22dd33CC44bb55AA x e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
        "\U0001f600 API_KEY: 'ZyXwVu9876543210' é " * 3,
        # A placeholder hides its own window, not the rest of the candidate.
        "your_app/prod/key=" + "a" * 30 + "qW3eR5tY7uI9oP1aS2dF4gH6jK8lZ0xCvB " + "exampleQ1w2E3r4T5y6U7i8",
        " ".join(f"{i:032x}" for i in range(7_000, 7_300)) + " tail",
        "".join("aB3" * 9 + "q0W9e8R7t6Y5u4I3o2P1" for _ in range(300)),
    ]
    rows = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame(list(enumerate(odd, 100)), "doc_id long, text string")
    )
    rows = rows.unionByName(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = secrets.find_secrets(rows).select(
        "text", secrets.spans_text("base_spans").alias("base"), secrets.spans_text("spans").alias("whole")
    )
    for x in found.collect():
        base, whole = _spans(x.text or "")
        assert (x.base, x.whole) == (_joined(base), _joined(whole))


def test_redaction(spark, docs, no_docs):
    rows = {x.doc_id: x.text for x in secrets.redact(docs).collect()}
    assert rows[9].count("[SECRET]") == 3 and rows[9].endswith(" 😀") and rows[3] is None
    assert secrets.redact(docs).columns == docs.columns
    assert secrets.redact(no_docs).count() == 0


def test_redaction_keeps_columns_of_any_name(spark):
    rows = [("a 😀 " + "0123456789abcdef" * 2 + " b", "t", [1], "r", 2)]
    df = spark.createDataFrame(rows, "text string, _text string, spans array<int>, `row` string, base_spans int")
    got = secrets.redact(df)
    assert got.columns == df.columns and got.collect()[0] == ("a 😀 [SECRET] b", "t", [1], "r", 2)
    odd = spark.createDataFrame([("0123456789abcdef" * 2,)], "`a.b` string")
    assert secrets.redact(odd, text="a.b").collect()[0][0] == "[SECRET]"


def test_many_secrets_in_one_text(spark):
    keys = [f"{i:032x}" for i in range(50_000)]
    df = spark.createDataFrame([(1, "é".join(keys))], "doc_id long, text string")
    found = secrets.find_secrets(df).select(secrets.F.size("spans").alias("n")).first().n
    assert found == 50_000
    assert secrets.redact(df).first().text == "é".join(["[SECRET]"] * 50_000)


def test_op10_digest(spark, sf_dir):
    texts = {x.doc_id: x.text for x in common.read_table(spark, sf_dir, "documents").collect()}
    for x in queries.op10_secret_spans(spark, sf_dir).collect():
        base, whole = _spans(texts[x.doc_id] or "")
        assert x.base_sha256 == hashlib.sha256(_joined(base).encode()).hexdigest() and x.spans == _joined(whole)


# Page text


def test_common_lines_are_longest():
    random.seed(2)

    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(400):
        a, b = ([random.randrange(4) for _ in range(random.randrange(14))] for _ in "ab")
        for bits in (1 << 20, 3):
            pairs = page_text.common_lines(a, b, bits)
            assert len(pairs) == length(a, b) and all(a[i] == b[j] for i, j in pairs)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>Title &amp; more</h1></header><p>One <b>bold</b>
 text<br>next<p>Two&nbsp;&copy; a < b<ul><li>x<li>y</ul><div class='ad'>buy</div><script>if (a</p>b) {}</script>
<form><label>mail</label></form><section id="comments"><p>nice!</p></section><!-- <p>no</p> --></article>
<aside>side</aside></main><footer>foot</footer>"""


def test_marked_articles_are_kept_whole():
    lines = page_text.page_lines(PAGE)
    want = ["Title & more", "One bold text next", "Two © a < b", "x", "y"]
    assert page_text.main_lines(lines, set(range(99))) == want


def test_differencing_decides_where_nothing_is_marked(spark):
    def page(body):
        return f"<body><div>Site name</div><div>Menu</div>{body}<div>Imprint</div></body>"

    rows = [
        (1, "http://H/a/1", page("<p>first</p><p>text</p>")),
        (2, "https://h/a/2?x=1", page("<p>second</p>")),
        (3, "http://h/a/2", page("<p>second</p>")),  # a copy of its pair
        (4, "http://other/", page("<p>alone</p>")),
        (5, None, None),
        (6, "http://h/b", ""),
        (1, "http://H/a/1", page("<p>first</p><p>text</p>")),
    ]
    pages = spark.createDataFrame([(*x, "k", 3) for x in rows], "page_id int, url string, html string, key string, lines int")
    found = page_text.extract_texts(pages.repartition(3))
    texts = {x.page_id: x.text for x in found.collect()}
    assert texts[1] == "first\ntext" and texts[5] == texts[6] == ""
    assert texts[4] == "Site name\nMenu\nalone\nImprint"
    assert found.count() == 7
    assert page_text.extract_texts(pages.limit(0)).count() == 0


@pytest.mark.parametrize("html", [
    "<a " * 330_000, "<span>" * 80_000 + "</b>" * 120_000, '<a href="x>' * 90_000, "<a href='x" * 90_000, '<a ">"' * 150_000, "<" * 900_000, "<!--" * 250_000,
    "&#" + "9" * 900_000 + ";", "<a<" * 300_000, "</a " * 250_000, "<div>" * 150_000, "<p>x" * 150_000, "<b '\">" * 150_000, "<a " + "x=" * 400_000 + ">",
])
def test_broken_pages_take_linear_time(html):
    began = time.process_time()
    page_text.page_lines(html)
    assert time.process_time() - began < 5


def test_shared_lines_go_beside_an_article(spark):
    def page(own, article):
        return f"<body><div>Site</div><main><div>Join us</div><div>{own}</div><article><p>{article}</p><p>shared words</p></article></main></body>"

    rows = [(1, "http://h/1", page("one", "text one")), (2, "http://h/2", page("two", "text two")), (3, "http://g/1", "<body><p>" + "deep" + "<div>" * 5000 + "x")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    texts = {x.page_id: x.text for x in page_text.extract_texts(pages).collect()}
    assert texts == {1: "one\ntext one\nshared words", 2: "two\ntext two\nshared words", 3: "deep\nx"}


def test_op1_takes_every_article(spark, sf_dir):
    pages = {x.page_id: x.html for x in common.read_table(spark, sf_dir, "pages").collect()}
    rows = queries.op1_page_text(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for x in rows:
        body = re.search("<article>(.*)</article>", pages[x.page_id], re.S)[1]
        blocks = [
            " ".join(page_text.html_lib.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split())
            for b in re.split("</?(?:p|h1)>", body)
        ]
        assert x.text == "\n".join(b for b in blocks if b) and x.n_chars == len(x.text)
