"""Corpus operators against brute force, and on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("belated.llm")
from belated.llm import fingerprint, html, kernels, language, minhash, packing, quality, sentencepiece, suffix, toxicity, warc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, c string"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None, 7, 8, "x") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


AWKWARD = [None, "", " \n ", "one", "one", "é" * 900, prose(1, 3000), prose(2, 40) + ".\n" + prose(3, 40) + "."]


def test_minhash_groups(spark):
    r, base, texts = random.Random(4), prose(5, 200), []
    for k in range(60):
        w = base.split()
        for _ in range(r.choice([0, 1, 3, 6, 12])):
            w[r.randrange(len(w))] = f"x{k}"
        texts.append(" ".join(w))
    texts += [*AWKWARD, *(prose(100 + k, 60) for k in range(30)), "a b c d e f " * 30, "a b c d e f " * 33]
    sets = [collections.Counter(zip(*(w[k:] for k in range(5)), strict=False)) if len(w := (t or "").lower().split()) >= 5 else collections.Counter([tuple(w)] if w else []) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = sum((sets[a] & sets[b]).values())
            if both and 9 * both >= 4 * (sum(sets[a].values()) + sum(sets[b].values())):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {x["doc_id"]: x["group_id"] for x in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == {k: find(k) for k in range(len(texts))}


def test_bag_minhash_is_unbiased():
    r = np.random.default_rng(1)
    h = kernels.mix(r.integers(1, 1 << 60, 40).astype(np.uint64))
    a, b = r.integers(0, 9, 40), r.integers(0, 9, 40)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    sig = minhash.bag_minhash(np.concatenate((h[a > 0], h[b > 0])), np.concatenate((a[a > 0], b[b > 0])), np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), 2, 20000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.02)


def test_minhash_empty(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def _removed(texts, m):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[p : p + m] for b in raw for p in range(len(b) - m + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - m + 1):
            if count[b[p : p + m]] > 1:
                gone[p : p + m] = b"\1" * m
        runs = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [512, 3])
def test_suffix_dedup(spark, crowd, monkeypatch):
    p, q = prose(8, 120), prose(9, 90)
    texts = [*AWKWARD, p, prose(10, 30) + p + prose(11, 30), p[50:], q + q, "z" * 1000, prose(12, 50) + q[:450], *(prose(20 + k, 20) + p[k : 500 + k] + prose(40 + k, 20) for k in range(6))]
    monkeypatch.setattr(suffix.repeated_spans, "__defaults__", (400, 100, crowd))
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix.deduplicate(docs(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == _removed(texts, 400)


@pytest.mark.parametrize("crowd", [512, 3])
def test_repeats_of_51_words_go(spark, crowd, monkeypatch):
    p, q = prose(8, 51), prose(9, 50)
    texts = [*AWKWARD, "a " * 51 + p, *(prose(60 + k, 20 + k) + "\n" + p.replace(" ", "\n" if k == 1 else " ") + "\n" + prose(80 + k, 30) for k in range(4)), *(prose(90 + k, 30) + " " + q + " x" + prose(95 + k, 30) for k in range(4)), *(" ".join(prose(8, 120).split()[k : 70 + 3 * k]) for k in range(8)), "a " * 60]
    assert len(p.encode()) < 400
    monkeypatch.setattr(suffix.repeated_spans, "__defaults__", (400, 100, crowd))
    got = {r["doc_id"]: r["text"] for r in suffix.remove_repeats(spark, docs(spark, texts), "").collect()}
    split = [(t or "").split() for t in texts]
    count = collections.Counter(tuple(w[i : i + 51]) for w in split for i in range(len(w) - 50))
    for k, w in enumerate(split):
        gone = {j for i in range(len(w) - 50) if count[tuple(w[i : i + 51])] > 1 for j in range(i, i + 51)}
        assert (got[k] or "").split() == [x for j, x in enumerate(w) if j not in gone]
    assert got[0] is None and all(got[k] == texts[k] for k in range(1, 6)) and sum(q in (t or "") for t in got.values()) == 4


def test_crowded_anchors_are_dealt_by_longer_ones(spark, monkeypatch):
    """A line of 300 bytes and a passage of 500 that many texts share, near copies,
    and runs of one byte."""
    r, line, passage, base = random.Random(1), prose(1, 70)[:300], prose(2, 150)[:500], prose(3, 300)
    texts = [prose(100 + k, 60) + line + prose(200 + k, 60) for k in range(14)] + [prose(300 + k, 20) + passage + prose(400 + k, 40) for k in range(14)]
    for k in range(14):
        w = base.split()
        for _ in range(4):
            w[r.randrange(len(w))] = f"x{k}"
        texts.append(" ".join(w))
    texts += ["z" * 700, "z" * 450 + "y"]
    monkeypatch.setattr(suffix.repeated_spans, "__defaults__", (400, 100, 4))
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix.deduplicate(docs(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == _removed(texts, 400)


def test_suffix_rows_that_repeat_ids(spark):
    p, x, y = prose(8, 120), prose(9, 100), prose(10, 100)
    texts, ids = [p + x, y + p, prose(11, 300), p + x, None, "", p], [1, 2, 1, 1, None, None, None]
    got = sorted(tuple(r)[1:5] for r in suffix.deduplicate(docs(spark, texts, ids)).collect())
    assert got == sorted(_removed(texts, 400))


def test_suffix_marks_passages_of_51_words(spark):
    p, q = prose(8, 51), prose(9, 50)
    texts = ["u " + p + " v", prose(1, 30) + "\n" + p.replace(" ", "\n"), "w " + q + " v", "t " + q + " z", prose(5, 200), None]
    assert len(p.encode()) < 400
    got = {r["doc_id"]: (r["cut"], r["repeats_passage"]) for r in suffix.deduplicate(docs(spark, texts)).collect()}
    assert [got[k] for k in range(6)] == [(False, True)] * 2 + [(False, False)] * 4
    assert suffix.deduplicate(docs(spark, [])).count() == 0


def test_maximal_repeats():
    data = b"xabcdeyabcdezbcde"
    got = {(n, tuple(sorted(p.tolist()))) for n, p in suffix.maximal_repeats(np.frombuffer(data, np.uint8), np.array([len(data)]), 3)}
    assert got == {(5, (1, 7)), (4, (2, 8, 13))}


def test_quality_counts(spark):
    texts = [*AWKWARD, "a b c d e f\na b c d e f\n\n \n#$ x|y", "w " * 500, prose(3, 400)]
    got = {r["doc_id"]: r for r in quality.quality(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        w = (t or "").split()
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        full = [x for x in (t or "").split("\n") if x.strip()]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(full) - len(set(full)), len(cover))
        assert tuple(got[k])[1:6] == want
        assert got[k]["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
    assert got[len(texts) - 1]["kept"] and not got[len(texts) - 2]["kept"]


@pytest.mark.parametrize("clean, tail, letters", [(4096, 4090, 4090), (1536, 1000, 1500), (700, 600, 1100)])
def test_quality_judges_every_chunk(clean, tail, letters):
    import zstandard

    r, c = random.Random(5), zstandard.ZstdCompressor(level=quality.LEVEL)
    words = [prose(k, 1) + "lmnopqrstuvwxyz"[k % 15] for k in range(900)]
    text = " ".join(r.choice(words) for _ in range(3000)).encode()
    noise = bytes(r.randrange(33, 127) for _ in range(tail))
    for n in (100, 512, 513, 1100, clean, clean + tail):
        assert quality.passes(text[:n], c)
    for odd in (noise, b"z" * letters):
        assert not quality.passes(text[:clean] + odd, c) and not quality.passes(odd + text[:clean], c)


def test_main_text():
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy</div><article><header><h1>Head &amp; tail</h1></header><p>One <b>two</b>\n three<p>Be.<div class=comments><p>me too</div></article><aside>side</aside><footer>&copy; x</footer>"
    assert html.main_text(page) == "Head & tail\nOne two three\nBe."
    assert html.main_text("<div id=menu>x</div><p>Plain text here &lt;ok&gt;</p>") == "Plain text here <ok>"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p> </p>") == ""


MENU = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li><li><a href='/c'>All the sports of the week</a></li></ul>"
JUNK = ["<nav>" + MENU + "</nav>", "<div class='top-menu'>Menu <b>x</b></div>", "<div class=ad><div>Buy</div> now</div>", "<aside>About the writer</aside>", "<form action=/s><input name=q><label>Find</label></form>", "<script>var x = '<p>no</p>';</script>", "<div id=cookie-notice>We use cookies</div>", "<section class=comments><article class=comment><p>First!</p></article></section>", "<footer><p>(c) us</p></footer>", "<!-- <p>old</p> -->", "<p class=advert>Deal of the day"]


def _article(r, k):
    """Blocks as html, and their text."""
    blocks, text = ["<h1>Title &amp; %d</h1>" % k], [f"Title & {k}"]
    for j in range(r.randint(1, 7)):
        body = prose(1000 * k + j, r.randint(8, 60))
        kind = r.randrange(5)
        if kind == 0:
            blocks.append("<ul>" + "".join(f"<li><a href=/{n}>part {n} of {j}</a></li>" for n in range(7)) + "</ul>")
            text += [f"part {n} of {j}" for n in range(7)]
        else:
            blocks.append(("<p>{}</p>", "<blockquote>\n {}</blockquote>", "<p title='a > b'>{}", "<div><p>{}</p></div>")[kind - 1].format(body.replace(" ", "\n ", 1)))
            text.append(body)
    blocks.append("<p>A short <em>end</em>.</p>")
    return blocks, [*text, "A short end."]


@pytest.mark.parametrize("layout", ["article", "main", "soup"])
def test_main_text_of_templates(layout):
    r = random.Random(layout)
    for k in range(60):
        blocks, want = _article(r, k)
        if layout == "soup":  # nothing names the text: lines decide
            blocks[1:1], want[1:1] = ["<p>" + prose(k, 40) + "</p>"], [prose(k, 40)]
            page = "<div>" + MENU + "</div><div>" + "".join(blocks) + "</div><div>" + MENU + "</div><div>Copyright</div>"
        else:
            for _ in range(r.randint(0, 2)):
                blocks.insert(r.randint(1, len(blocks) - 1), r.choice(JUNK[:-1]))
            page = "".join(r.choice(JUNK) for _ in range(3)) + f"<{layout} class='with-sidebar'>" + "".join(blocks) + f"</{layout}>" + "".join(r.choice(JUNK) for _ in range(3))
            if k % 3 == 0:
                page = "<div class='page-header wrapper'>" + page + "</div>"
            if k % 5 == 0:
                page = "<form action=/x>" + page
        page = "<html><head><title>T</title><style>p{}</style></head><body class=has-sidebar>" + page + "</body></html>"
        assert html.main_text(page) == "\n".join(want), page


def test_lines_decide_without_names(monkeypatch):
    """With a surge that no line reaches alone, and with one that all do."""
    page = "<div><p>tiny</p></div>" + MENU * 2 + "<div><p>" + "long text " * 20 + "</p></div>"
    assert html.main_text(page) == ("long text " * 20).strip()
    assert html.main_text(page, surge=1) == "tiny\n" + ("long text " * 20).strip()
    assert html.stretches([0, 5, 0, 0, 0, 90, 0, 9, 0, 0, 0, 3]) == [(3, 8)]


def test_pages_take_linear_time():
    import time

    for x in ('<a href="', "<div class=\"a\" title='x>", "<p class=ad>", "<script>", "<", "<div class=ad>", "<!--", "<nav>", '<a b="c>'):
        begin = time.process_time()
        html.main_text(x * 30_000)
        assert time.process_time() - begin < 10


def test_pages_awkward_rows(spark):
    rows = [(1, None, None, 5), (2, "u", "", 5), (None, None, "<p>x", 5), (2, "u", "<p>" + "y " * 50_000, 5), (2, "u", "<p>" + "y " * 50_000, 5)]
    got = sorted((tuple(r) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()), key=repr)
    long_ = ("y " * 50_000).strip()
    assert got == sorted([(1, None, "", 0), (2, "u", "", 0), (None, None, "x", 1), *[(2, "u", long_, len(long_))] * 2], key=repr)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_packing(spark):
    texts = [*AWKWARD, "a b's, don't 12 | x\x1cy z <|endoftext|> ÀÉ", *(prose(k, 30 + 7 * k) for k in range(60))]
    out = packing.pack_documents(docs(spark, texts)).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    by = collections.defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    for k, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        parts = [ids[i : i + 4096] for i in range(0, len(ids), 4096)]
        got = sorted(by[k], key=lambda r: r["piece"])
        assert [(r["start"], r["length"], r["ids_crc32"]) for r in got] == [(4096 * n, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for n, x in enumerate(parts)]
    at = collections.defaultdict(list)
    for r in out:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in at.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and places[0][0] == 0 and sum(n for _, n in places) <= 4096


def test_plan_fills_exactly():
    counts = {4000: 3, 96: 2, 50: 1, 46: 1, 2000: 4, 1000: 2, 1096: 2}
    used = collections.Counter()
    plan = packing.plan(counts)
    for need, n in plan:
        used.update({v: k * n for v, k in collections.Counter(need).items()})
    assert used == counts and sum(n for _, n in plan) == 6


def test_fingerprints(spark):
    texts = [*AWKWARD, "\n".join(prose(k, 8) + "." for k in range(300)), "\n".join(prose(k, 8) + "." for k in range(295))]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs(spark, texts)).collect()}
    n = len(texts)
    for k in range(n):
        t, nxt = texts[k] or "", texts[k - 1 if k else n - 1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[k]["near_edited"] <= 1
    assert got[3]["fingerprint"] == got[4]["fingerprint"] and got[0]["fingerprint"] == got[1]["fingerprint"]
    assert got[n - 1]["near_next"] == pytest.approx(295 / 300)


def test_likeness_is_exact(spark):
    r = random.Random(6)
    pool = [prose(k, 6) + "." for k in range(400)]
    texts = [*AWKWARD, *("\n".join(r.sample(pool, r.randint(1, 350))) for _ in range(24))]
    sets = [{p for p in re.split(r"\n+|(?<=[.!?])\s+", t or "") if p.strip(" ")} for t in texts]
    for k, row in enumerate(sorted(fingerprint.fingerprints(docs(spark, texts)).collect())):
        t, nxt = texts[k] or "", texts[k - 1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        e = {p for p in re.split(r"\n+|(?<=[.!?])\s+", edited) if p.strip(" ")}
        for name, other in (("near_edited", e), ("near_next", sets[k - 1])):
            both = sets[k] | other
            assert row[name] == pytest.approx(len(sets[k] & other) / len(both) if both else 1.0), (k, name)


def test_sub_tables_peel_again(spark):
    r = random.Random(7)
    rows = []
    for n in (1, 2, 9, 16, 30, 200):
        for _ in range(6):
            both = [f"b{r.random()}" for _ in range(r.randint(0, 9))]
            mine = [f"d{r.random()}" for _ in range(n)]
            cut = r.randint(0, n)
            rows.append((len(rows), n, both + mine[:cut], both + mine[cut:]))
    df = spark.createDataFrame(rows, "row long, n int, p array<string>, q array<string>")
    o, e = (fingerprint.F.transform(c, lambda p: fingerprint.digests(p)[0]) for c in "pq")
    F = fingerprint.F
    failed = df.select("row", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("sub"), F.concat(o, e).alias("ds"))
    got = {x["row"]: x["d"] for x in fingerprint._again(failed).collect()}
    assert got == {x[0]: x[1] for x in rows}


def test_warc_round_trip(spark, tmp_path):
    big, other = "<p>" + "x" * 1500, "<p>" + "é" * 600
    rows = [(1, "http://www.a.com/x?y#z", big), (2, "http://a.com/", big), (3, None, None), (4, "bad:[//", other), (5, "http://b.org/é", "small"), (6, "http://b.org/", "small"), (None, "http://a.com/", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives, index = str(tmp_path / "w"), str(tmp_path / "i")
    top = warc.CaptureIndex(warc.write_index(warc.write_archives(pages, archives), index), index, archives)
    got = {r["page_id"]: tuple(r)[2:] for r in warc.read_back(pages, top).collect()}
    assert got[1] == (1503, hashlib.sha1(big.encode()).hexdigest(), "revisit", 2) and got[2][2:] == ("response", None)
    assert got[3][0] == 0 and got[5][2] == got[6][2] == "response" and got[4][0] == 1203
    found = top.lookup("http://A.com/")
    assert len(found) == 2 and {len(p) for _, p in found} == {1503}


def test_warc_lookups_over_many_blocks(spark, tmp_path, monkeypatch):
    """Blocks of two lines, one URL that a third of the pages have, repeated and null
    ids, extra columns with clashing names: every row comes back once."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    rows = [(k % 50 if k % 7 else None, "http://hot.org/" if k % 3 else f"http://h{k % 9}.com/{k % 5}", "x" * (k % 4 * 600), "f", 1) for k in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string, size long")
    archives, index = str(tmp_path / "w"), str(tmp_path / "i")
    top = warc.CaptureIndex(warc.write_index(warc.write_archives(pages, archives), index), index, archives)
    assert len(top.rows) > 1 and sum(r[5] for r in top.rows) >= 60
    got = [tuple(r)[:4] for r in warc.read_back(pages, top).collect()]
    want = [(i, u, len(h), hashlib.sha1(h.encode()).hexdigest()) for i, u, h, *_ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(top.lookup("http://hot.org/")) == sum(r[1] == "http://hot.org/" for r in rows) and not top.lookup("http://none.org/")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_sentencepiece_against_brute_force():
    pieces, byte_ids, plain = sentencepiece.load(sentencepiece.default_model())
    u = sentencepiece.Unigram(pieces, byte_ids, plain)
    cache = u.encoder()
    texts = ["Hello  world\n x", "日本語 😀 ok\t", "", " ", "a" * 700, prose(1, 30), "naïve café"]
    data, offsets = kernels.utf8(pa.array(texts))
    ids, begin = u.encode(cache, data, offsets)
    for k, text in enumerate(texts):
        own = ids[begin[k] : begin[k + 1]]
        assert u.decode(own) == text
        x = "▁" + text.replace(" ", "▁") if text else ""
        best, score = [0.0] + [-1e18] * len(x), {p: s for p, (_, s) in pieces.items()}
        for a in range(len(x)):
            for e in range(a + 1, min(len(x), a + 30) + 1):
                if (s := score.get(x[a:e].encode())) is not None:
                    best[e] = max(best[e], best[a] + s)
            if x[a].encode() not in score:
                best[a + 1] = max(best[a + 1], best[a] + u.floor)
        got, fallback, by_id = 0.0, b"", {i: s for i, s in pieces.values()}
        for i in own.tolist():
            if i in by_id:
                got += by_id[i]
            else:
                fallback += bytes([byte_ids.index(i)])
        assert got + u.floor * len(fallback.decode()) == pytest.approx(best[len(x)], abs=1e-3)


def test_language_held_out():
    r = random.Random(2)
    words = {"en": "the and with thing", "de": "der und mit nicht schön", "fr": "le et avec été", "es": "el y con niño"}
    rows = [(" ".join(r.choice(v.split()) for _ in range(20)), k) for k, v in words.items() for _ in range(30)]
    model = language.LanguageModel(rows)
    assert [len(f) for f in model.families] == [2, 2]
    lang, score = model.predict(pa.array([t for t, _ in rows] + [None, "", "12 !?"]))
    assert lang.tolist() == [x for _, x in rows] + ["und"] * 3 and score[-1] == 0 and (score <= 1).all()
    assert language.LanguageModel([]).predict(pa.array(["x"]))[0].tolist() == ["und"]


def test_toxicity_held_out():
    r = random.Random(3)
    texts = [prose(k, r.randint(5, 120)) for k in range(300)]
    y = np.array([k % 2 for k in range(300)])
    for k in range(1, 300, 2):
        w = texts[k].split()
        w.insert(r.randrange(len(w)), "nastyword" + r.choice(["s", "ed", "", "ish"]))
        texts[k] = " ".join(w)
    net = toxicity.Network()
    net.fit(texts[:200], y[:200])
    score = net.score(pa.array(texts[200:] + [None, ""]))
    assert (((score[:100] >= 0.7).astype(int)) == y[200:]).mean() > 0.95
    assert score[100] == score[101] and 0 <= score.min() and score.max() <= 1


def test_toxicity_gradients():
    net = toxicity.Network(3)
    index = np.array([[0, 1, 2, -1], [3, -1, -1, -1]])
    vec = np.random.default_rng(0).standard_normal((5, toxicity.INPUTS)).astype(np.float32)
    logit, saved = net.forward(index, vec, keep=True)
    g, d_vec = net.backward(index, vec, saved, np.ones(2, np.float32))
    for name in ("att", "out", "wf", "ub", "cb"):
        at = tuple(0 for _ in net.p[name].shape)
        for eps in (1e-2,):
            net.p[name][at] += eps
            up = net.forward(index, vec).sum()
            net.p[name][at] -= 2 * eps
            down = net.forward(index, vec).sum()
            net.p[name][at] += eps
            assert (up - down) / (2 * eps) == pytest.approx(g[name][at], abs=2e-2, rel=5e-2)


def test_minhash_repeated_ids_and_short_blocks(spark):
    a, b = prose(1, 80), prose(2, 80)
    got = minhash.near_duplicates(docs(spark, [a, b, a, None, a, b], [1, 1, 2, 3, None, 1])).collect()
    assert sum(r["doc_id"] == 1 for r in got) == 3 and len({tuple(r) for r in got if r["doc_id"] == 1}) == 1
    text, other = prose(3, 9), prose(4, 4000)
    alone, beside = (next(iter(minhash._signatures(28, 5, 5)(pa.RecordBatch.from_arrays([pa.array(range(len(t))), pa.array(t)], ["id", "text"])))) for t in ([text], [text, other]))
    assert alone.column(4)[0] == beside.column(4)[0]


def test_minhash_leaves_texts_where_they_are(spark):
    """Of documents that share a bucket with none no text is shuffled, however small a
    table must be to be broadcast."""
    texts = [prose(1000 + k, 3000) for k in range(200)]
    texts.append(texts[0] + " x")
    sc, threshold = spark.sparkContext, "spark.sql.autoBroadcastJoinThreshold"

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(k) for k in range(stages.size()))}

    before, usual = written(), spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        got = {x["doc_id"]: x["group_id"] for x in minhash.near_duplicates(docs(spark, texts)).collect()}
    finally:
        spark.conf.set(threshold, usual)
    assert got == {**{k: k for k in range(200)}, 200: 0}
    assert sum(n for key, n in written().items() if key not in before) < sum(map(len, texts)) / 4


def test_bitmaps_lose_no_id(spark, monkeypatch):
    rows = spark.range(0, 3000).selectExpr("id", "cast(id as string) c")
    ids = spark.range(0, 3000, 7)
    for words in (1, 4, minhash.WORDS):
        monkeypatch.setattr(minhash, "WORDS", words)
        got = minhash._likely(rows.unionByName(rows), ids)
        assert got.columns == rows.columns
        assert got.join(ids, "id").count() == 2 * ids.count()
    assert got.count() < 2 * ids.count() + 20


def test_minhash_pairs_blocks_of_a_bucket(spark, monkeypatch):
    """A family whose members are alike, most of them just under the limit."""
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 4)
    r, base = random.Random(9), prose(5, 120).split()
    texts = []
    for k in range(40):
        w = list(base)
        for j in r.sample(range(120), 2 + k % 2):
            w[j] = f"x{k}"
        texts.append(" ".join(w))
    shingles = [set(zip(*(t.split()[j:] for j in range(5)), strict=False)) for t in texts]
    root = list(range(40))
    for a in range(40):
        for b in range(a):
            if 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if z in (x, y) else z for z in root]
    got = {x["doc_id"]: x["group_id"] for x in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[k] for k in range(40)] == root


def test_each_band_rejects(spark):
    """Texts that pass the base rules: repetitive as a whole, incompressible as a
    whole, with one incompressible chunk, with half of the chunks repetitive; and a
    clean one.  Null, empty, repeated and very long rows."""
    r = random.Random(8)
    words = [prose(k, 1) + "lmnopqrstuvwxyz"[k % 15] + prose(k + 5000, 1) for k in range(3000)]
    clean = " ".join(r.choice(words) for _ in range(600))
    # each word many times on end, so that no five-word window comes back
    stutter = " ".join(" ".join([w] * 5) for w in words[:40])
    slow = " ".join(" ".join([words[k] + "q" * 9 + words[k + 1]] * 5) for k in range(100, 160, 2))
    noise = " ".join("".join(chr(r.randrange(33, 127)) for _ in range(6)) for _ in range(400))
    texts = [clean, stutter, noise, clean + " " + noise[:700], clean[:2000] + " " + slow, None, "", clean, " ".join(r.choice(words) for _ in range(60_000))]
    got = sorted((tuple(x) for x in quality.quality(docs(spark, texts)).collect()), key=lambda x: x[0])
    assert [x[6] for x in got] == [False] * 5 + [True] * 2 + [False] * 2
    assert [x[7] for x in got] == [True, False, False, False, False, False, False, True, True]
    assert quality.quality(docs(spark, [])).count() == 0
