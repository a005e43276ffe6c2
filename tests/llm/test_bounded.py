"""Operators of a text each: against a plain version, with odd texts."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, html, langid, pii, queries, tokencount, warc, words

ODD = [None, "", " ", "\n\n", "a", "é🎯漢字", "word " * 20_000, "x" * 70_000, "don't  stop\t now <|endoftext|> ok", "0" * 3000, "\0\x1c\x85 a"]


def odd_docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "clash", 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], (None, "null id", None, None, None)], "doc_id long, text string, lang string, _id string, n_tokens long")


def test_ids_are_the_librarys(spark):
    enc = bpe.encoding()
    got = {(r.doc_id, r.n): r for r in bpe.decode(bpe.encode(odd_docs(spark), leaf=64).withColumn("kept", F.col("ids")), "ids").withColumn("n", F.monotonically_increasing_id()).collect()}
    assert len(got) == len(ODD) + 2
    for r in got.values():
        text = "null id" if r.doc_id is None else ODD[r.doc_id] or ""
        assert np.frombuffer(r.kept, "<u4").tolist() == enc.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode() and r.n_tokens == len(r.kept) // 4


def test_workers_forget_what_other_stages_remember(monkeypatch):
    def run(batches):
        yield from batches

    monkeypatch.setattr(run, "__module__", bpe.__name__)
    bpe.encoding()
    langid._seen[b"model"] = [np.zeros(1, np.uint64), np.zeros((1, 2))]
    assert list(words.lean(run)([])) == []
    assert not langid._seen and bpe.encoding.cache_info().currsize == 1
    monkeypatch.setattr(run, "__module__", langid.__name__)
    list(words.lean(run)([]))
    assert bpe.encoding.cache_info().currsize == 0


@pytest.mark.parametrize("leaf", [2, 3, 9, 40])
def test_halves_join_wherever_they_are_cut(leaf):
    r, enc = random.Random(leaf), bpe.encoding()
    parts = [" ", "  ", "\n", "a", "B", "é", "12", "'s", " ", "\x1c", "漢", "!?", "word", " the"]
    for _ in range(150):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 120)))
        assert bpe.encode_text(t, enc, leaf).tolist() == enc.encode_ordinary(t)


def test_counts_are_the_librarys(spark):
    count = tokencount.counter()
    got = {r.doc_id: r for r in tokencount.token_counts(odd_docs(spark), chunk=2000, overlap=8).collect()}
    for i, t in enumerate(ODD):
        n = len(count.tokenizer.encode(t or "", add_special_tokens=False))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512)


def test_chunks_splice_anywhere():
    r, count = random.Random(1), tokencount.counter(None, 40, 4)
    parts = [" ", "  ", "\n", "a", "B", "é", "12", "'s", "<|endoftext|>", "　", "漢", "!?", "word", " the"]
    for _ in range(200):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 150)))
        n = count.whole(t)
        assert count.huge(t) == n and count.stretches([t]) == [n]


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_are_the_patterns():
    r = random.Random(1)
    parts = [*"ab@.+-0123459 ()%_@@..é", "4111111111111111", "1.2.3.4", "a.b@c.de"]
    for _ in range(8000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == plain_spans(t)


def private_texts(n=400):
    """Texts with personal data behind words that tell of it, and numbers behind words that don't."""
    r = random.Random(21)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    made = [
        lambda: f"call +{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: f"mail {word()}@{word()}.com",
        lambda: f"host {r.randint(1, 255)}.{r.randint(100, 255)}.{r.randint(100, 255)}.{r.randint(1, 255)}",
        lambda: f"order {digits(3)}-{digits(3)}-{digits(4)}",
        lambda: f"order {digits(8)}",
        lambda: f"invoice {digits(3)} {digits(4)} {digits(2)}",
        lambda: f"tag @{word()} for {word()}@{word()}",
    ]
    return [" ".join(f"{word()} {r.choice(made)()} {word()}." for _ in range(r.randint(1, 4))) for _ in range(n)]


def test_the_field_adds_what_repeats_or_stands_alike(spark):
    model = pii.fit(pii._counts(private_texts()))
    docs = [
        (1, "Call +1 (743) 555-3824 or 743-555-3824. Mail joe.x@a.com, joe.x@a now, order 555 3824 99"),
        (2, "order 743-555-3824"),
        (3, "please call 44 (743) 555-3824 now"),  # neither repeated nor of the pattern: shape and word before it tell
        (4, "invoice 743 5553 82 and order 12345678"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(pii.find(df, model=model)).collect()}
    spans = {1: ["email:45:56", "email:58:65", "phone:5:22", "phone:26:38"], 2: [], 3: ["phone:12:29"], 4: []}
    assert {k: r.spans.split(",") if r.spans else [] for k, r in got.items()} == spans
    assert got[1].base_sha256 == hashlib.sha256(b"email:45:56,phone:5:22").hexdigest()
    assert (got[1].n_email, got[1].n_phone, got[2].n_phone) == (2, 2, 0)
    # Without the skip potential the repeated number is no more than the same number elsewhere.
    alone = pii.all_spans(docs[0][1], pii.base_spans(docs[0][1]), model | {"skip": 0.0})
    assert ("phone", 26, 38) not in alone
    assert pii.find(odd_docs(spark)).count() == len(ODD) + 2
    assert pii.find(df.limit(0)).count() == 0


def test_the_query_counts_what_the_patterns_find(spark, tmp_path):
    """Also where the field adds spans: those are in spans only."""
    docs = [*enumerate(private_texts()), (900, "Call +1 (743) 555-3824 or 743-555-3824. Mail joe.x@a.com, joe.x@a now"), (901, "please call 44 (743) 555-3824 now"), (902, None), (903, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op3_pii(spark, str(tmp_path)).collect()}
    added = 0
    for i, t in docs:
        base, r = plain_spans(t or ""), got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(spans)
        added += len(spans) - len(base)
    assert added > 0


def test_weights_tell_held_out_mentions():
    """Damaged mentions of held-out texts get their label, other numbers none."""
    texts = private_texts(600)
    model, right, n = pii.fit(pii._counts(texts[:300])), 0, 0
    for t in texts[300:]:
        for kind, s, e in pii.base_spans(t):
            broken = pii.damaged(kind, t[s:e])
            u = t[:s] + broken + t[e:]
            found = [x for x in pii.mentions(u, pii.base_spans(u)) if x[0] == s and x[2] < 0]
            if found:
                n += 1
                right += (kind, s, s + len(broken)) in pii.all_spans(u, pii.base_spans(u), model)
        base = pii.base_spans(t)
        assert not [x for x in pii.all_spans(t, base, model) if x not in base and t[: x[1]].endswith(("order ", "invoice "))]
    assert n > 100 and right >= 0.9 * n


def test_message_passing_is_exact_on_a_tree():
    rng = np.random.default_rng(0)
    model = {"unary": rng.normal(size=(pii._SHAPE + pii.CUES + 1, 5)), "chain": rng.normal(size=(5, 5)) * 0.3, "first": rng.normal(size=5), "last": rng.normal(size=5), "skip": 3.0}
    f = (False, False, 2, 0, False, True, False, 3)
    nodes = [(0, 1, -1, f, "#1"), (2, 3, 4, f, "#2"), (4, 5, -1, f, "#3")]
    got = pii.infer(nodes, model, 60)
    unary = np.array([pii._featured(f) for _ in nodes]) @ model["unary"]
    unary[0] += model["first"]
    unary[2] += model["last"]
    joint = np.array([[unary[0, a] + unary[2, c] + model["chain"][a, 4] + model["chain"][4, c] for c in range(5)] for a in range(5)])
    p = np.exp(joint - joint.max())
    p /= p.sum()
    assert np.allclose(got[0], p.sum(axis=1), atol=1e-6) and np.allclose(got[2], p.sum(axis=0), atol=1e-6)


def test_language_of_held_out_texts(spark):
    r = random.Random(3)
    stems = {"en": ["the", "tion", "ing", "and", "wh"], "fr": ["eau", "que", "é", "les", "oi"]}
    rows = [(i, " ".join("".join(r.choice(stems[lang]) for _ in range(r.randint(1, 3))) for _ in range(30)), lang) for i in range(120) for lang in [r.choice(["en", "fr"])]]
    rows += [(900, None, "en"), (901, "123 ... !!", "en"), (902, "", None), (903, "the and", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.language_id(docs).collect()}
    held = [x for x in got.values() if x.held_out and x.doc_id < 900]
    assert held and sum(x.lang_pred == rows[x.doc_id][2] for x in held) >= 0.98 * len(held)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"] and got[900].score == 0
    assert all(0 <= x.score <= 1 for x in got.values())
    assert langid.language_id(docs.limit(0)).count() == 0 and {x.lang_pred for x in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    """Words of up to 300 bytes in three scripts, together, against a sum over segmentations in exact fractions."""
    from fractions import Fraction

    keys = langid.pieces()
    rng = np.random.default_rng(0)
    p = rng.random((len(keys) + 1, 2)) / 1000
    p[-1] = 0
    number = {int(k): i for i, k in enumerate(keys)}
    words = ["schule", "a", "donaudampfschifffahrtsgesellschaft", "достопримечательностями", "自然言語処理は計算機科学の一分野である", "x" * 300, "donaudampfschifffahrtsgesellschafts"]

    def total(word, lang):
        sums = [Fraction(1)]
        for j in range(1, len(word) + 1):
            found = ((n, number.get(int.from_bytes(word[j - n : j], "little"))) for n in range(1, min(8, j) + 1))
            sums.append(sum((sums[j - n] * Fraction(p[k, lang]) for n, k in found if k is not None), Fraction(0)))
        return sums[-1]

    raw = [w.encode() for w in words]
    buf = np.frombuffer(b" ".join(raw) + bytes(16), np.uint8)
    starts = np.cumsum([0, *[len(w) + 1 for w in raw[:-1]]])
    got = langid.score_words(buf, starts, starts + [len(w) for w in raw], keys, p)
    for w, row in zip(raw, got, strict=True):
        for lang in (0, 1):
            x = total(b" " + w, lang)
            assert np.isclose(row[lang], math.log(x.numerator) - math.log(x.denominator))


def test_words_are_letters_of_any_script(spark):
    assert langid.letters(pa.array(["ABC—«déjà»\u00a0x", "1 Q", "漢字。かな"])).to_pylist() == ["abc déjà x", "1 q", "漢字 かな"]
    r = random.Random(2)
    scripts = {"ja": "自然言語処理は計算機科学の", "ru": "достопримечательн", "en": "abcdefgh"}
    rows = [(i, "".join(r.choice(scripts[lang]) for _ in range(60)) + "。" * (i % 3), lang, "clash", "clash") for i in range(240) for lang in [r.choice(sorted(scripts))]]
    docs = spark.createDataFrame([*rows, (999, "自然" * 20_000, None, None, None), (1000, "abc " * 30_000, None, None, None)], "doc_id long, text string, lang string, word string, _text string")
    got = {x.doc_id: x for x in langid.language_id(docs).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in rows) and (got[999].lang_pred, got[1000].lang_pred) == ("ja", "en")


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (a != b)))
        row = now
    return min(row)


def test_edit_distance():
    r = random.Random(0)
    for _ in range(200):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(lo, 50))) for lo in (1, 0))
        assert decontam.myers(a, b)[0] == plain_distance(a, b)


def test_leaks_are_found_within_the_budget(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7)))
    items = [" ".join(word() for _ in range(r.randint(8, 30))) for _ in range(20)]
    docs = []
    for i in range(120):
        body = " ".join(word() for _ in range(40))
        if i % 2:
            leak = list(items[i % 20])
            for _ in range(r.randint(0, len(leak) // 16 + 2)):
                at = r.randrange(len(leak))
                r.choice([lambda: leak.__setitem__(at, "q"), lambda: leak.insert(at, "z"), lambda: leak.pop(at)])()
            body += "\n" + "".join(leak).upper() + "  " + body
        docs.append((i, body))
    docs += [(500, None), (501, "")]
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, "  ")], "item_id long, text string")
    for block in (2_000_000, 500):
        got = {(x.doc_id, x.item_id): x.distance for x in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, block=block).collect()}
        want = {}
        for i, t in docs:
            for k, item in enumerate(items):
                d = plain_distance(decontam.normalise(item), decontam.normalise(t)) if t else 99
                if d <= len(item) // 16:
                    want[i, k] = d
        assert got == want
    assert decontam.contaminated(bench.select(F.col("item_id").alias("doc_id"), "text"), bench.limit(0)).count() == 0


def test_extraction(spark):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div>'
        "<article><h1>The &amp; head</h1><p><b>First\n  words of it.<br><p>Second   &eacute; and a longer stretch of words in a paragraph.</p>"
        '<div class="comments"><p>great read</p></div></article><aside class="sidebar"><h3>More</h3><ul><li><a href="/c">other</a></li></ul></aside><form class="search"><p>Find</p></form><footer>&copy; us &middot; all</footer></body></html>'
    )
    docs = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p>unclosed <b>text that goes on for a while and on, as long as any paragraph would"), (5, "u", "<!-- never closed <p>x"), (6, "u", "<div>" * 3000 + "deep" + "</p>" * 10)], "page_id long, url string, html string")
    got = {x.page_id: x for x in html.extract(docs).collect()}
    assert got[1].text == "The & head\nFirst words of it.\nSecond é and a longer stretch of words in a paragraph."
    assert [got[i].text for i in (2, 3, 5)] == ["", "", ""] and got[1].n_chars == len(got[1].text)
    assert got[4].text.startswith("unclosed text") and len(got) == 6


def test_articles_of_any_length_and_depth():
    """Whole articles, short and long, plain and in divs, with and without a heading, in few and in many elements."""
    words = ("lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam " * 40).split()
    run = lambda n, at: " ".join(words[at : at + n])
    menu = "<nav><ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(6)) + "</ul></nav>"
    footer = "<footer><p>Copyright 2020 All rights reserved</p></footer>"
    for head in (0, 1):
        for count, size in ((1, 8), (1, 13), (2, 13), (3, 40), (10, 13), (20, 40)):
            for form in ("<p>%s</p>", "<div>%s</div>", "<div><p>%s</p></div>", '<p class="q">%s</p>', '<div class="x1">%s</div>'):
                for depth in (0, 1, 40, 600):
                    for kind, around in (("article", 1), ('div class="content"', 1), ("article", 0)):
                        blocks = [run(size, 7 * i + 1) for i in range(count)]
                        inner = f"<h1>{run(4, 3)}</h1>" * head + "".join(form % b for b in blocks)
                        page = f"<html><head><title>t</title></head><body>{menu * around}<{kind}>{'<div>' * depth}{inner}{'</div>' * depth}</{kind.split()[0]}>{footer * around}</body></html>"
                        assert html.extract_text(page, html.trained()) == "\n".join([run(4, 3)] * head + blocks)
    mixed = [run(4, 3), run(20, 1), *[run(3, i) for i in (9, 13, 17, 21)], run(25, 30)]
    tags = ["h1", "p", "div", "div", "div", "div", "p"]
    for hint in ("", ' class="z"'):
        page = "<body><article>" + "".join(f"<{t}{hint}>{x}</{t}>" for t, x in zip(tags, mixed, strict=True)) + "</article></body>"
        assert html.extract_text(page, html.trained()) == "\n".join(mixed)


def test_end_tags_at_any_depth():
    """The end of a menu is found behind a thousand elements that were never closed."""
    page = "<body><nav>" + "<span>" * 1000 + "menu</nav><article><h1>Head line here</h1><p>" + "word " * 60 + "</p></article></body>"
    assert html.extract_text(page, html.trained()) == "Head line here\n" + ("word " * 60).strip()
    nodes, _ = html.parse("<table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul>")
    assert [n.tag for n in nodes if n.parent >= 0 and nodes[n.parent].tag == "tr"] == ["td", "td", "td"] and sum(n.tag == "li" and nodes[n.parent].tag == "ul" for n in nodes) == 2


def test_what_is_not_shown():
    page = '<article><h1>Head</h1><p class="overflow-hidden">a paragraph of some length that is shown to the reader</p><p hidden>never one</p><p style="color:red; display: none">never two</p><p>another paragraph of some length, shown as well</p></article>'
    assert html.extract_text(page, html.trained()).split("\n") == ["Head", "a paragraph of some length that is shown to the reader", "another paragraph of some length, shown as well"]


def test_marginals_are_exact_on_a_small_tree():
    import itertools
    import math

    nodes, parts = html.parse("<div><p>some text</p><ul><li>x</li></ul></div>")
    html._measure(nodes, parts)
    unary = {f: random.Random(f).uniform(-1, 1) for n in nodes for f in html.features(n)}
    tie = [[0.4, -0.2, 0.1, 0.6], [0.7, -0.5, -0.3, 0.2]]
    u = [sum(unary[f] for f in html.features(n)) for n in nodes]
    total, on = 0.0, [0.0] * len(nodes)
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        w = math.exp(sum(x * y for x, y in zip(u, labels, strict=True)) + sum(tie[html._kind(n)][2 * labels[n.parent] + labels[i]] for i, n in enumerate(nodes) if i))
        total += w
        on = [a + w * y for a, y in zip(on, labels, strict=True)]
    assert html.propagate(nodes, unary, tie) == pytest.approx([x / total for x in on])


def test_derivatives_refer_to_their_response(spark):
    pages = spark.createDataFrame([(1, "http://a/b", "<title>A  b</title><p>x &amp; y</p><script>no</script><p>z"), (2, None, None)], "page_id long, url string, html string")
    responses = warc.responses(pages)
    got = warc.serialise(warc.derive(responses)).collect()
    assert len(got) == 4
    own = {r.page_id: r for r in responses.collect()}
    for r in got:
        source = own[r.page_id]
        assert (r.refers_to, r.source_headers, r.source_digest) == (source.record_id, source.http_headers, source.payload_digest)
        (headers, block), = warc.split_records(bytes(r.record))
        assert block.decode() == r.block and headers["warc-refers-to"] == f"<{r.refers_to}>" and headers["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
    text = {r.page_id: r.block for r in got if r.record_type == "conversion"}
    assert text == {1: "A b\nx & y\nz", 2: ""}
    by = {(r.page_id, r.record_type): r for r in got}
    assert by[1, "metadata"].concurrent_to == by[1, "conversion"].record_id
    assert "title: A b\r\nlinks: 0" in by[1, "metadata"].block
    assert warc.derive(responses.limit(0)).count() == 0


def test_warc_files_are_read(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Target-URI: http://a\r\nWARC-Payload-Digest: sha1:Q\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record + record.replace(b"response", b"request"))
    got = warc.derive(warc.parse(spark.read.format("binaryFile").load(str(tmp_path / "a.warc")))).collect()
    assert {(r.refers_to, r.source_digest) for r in got} == {("urn:x", "sha1:Q")} and "hi" in [r.block for r in got]
