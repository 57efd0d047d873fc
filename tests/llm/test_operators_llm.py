"""The training-data operators against brute force, on small tables with every odd case."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimflow.llm import components, exact_dedup, html, jaccard, language, mixing, packing, quality, suffix_dedup, topk, warc
from claimflow.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id long, rank int, key string"
LOWER = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)
WORDS = re.compile(mixing.WORD)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Texts with copies in other case, near copies, shared passages, repeats in themselves, and oddities."""
    rng = random.Random(5)
    base, passage = prose(rng, 300), prose(rng, 90)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(40)]
    texts += [base, base.upper(), base, base + " end", "start " + base]
    for k in range(12):
        words = base.split()
        for _ in range(k):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 30) for _ in range(6)]
    texts += [passage + "\n" + passage, "a" * 1000, "ab" * 450, None, "", " \n\t", "one", "ONE", "one two three four",
              "x y " * 300, "naïve \x85\xa0 z", "DIE!! CHAU!!" * 40]
    out = [(i, t, ("de" if i % 4 == 0 else "en") if i % 9 else None, f"s{i % 5}" if i % 7 else None, 0, i, 1, "k")
           for i, t in enumerate(texts)]
    return out + [out[3], out[41], (None, "no id at all here", "en", "s1", 0, 0, 1, "k")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_cuckoo_filter_inserts_deletes_and_resizes():
    index = exact_dedup.DigestIndex(4)
    keys = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)]
    for k in keys:
        index.add(k, 1, 1, 1)
    assert index.resizes > 0 and all(index.find(k) for k in keys)
    assert all(index.remove(k) for k in keys[:1500]) and not index.remove(keys[0])
    assert not any(index.find(k) for k in keys[:1500]) and all(index.find(k) for k in keys[1500:])


def test_exact_dedup(docs, rows, none):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    want = collections.Counter()
    for r in rows:
        ids = groups[(r[1] or "").translate(LOWER)]
        top = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256((r[1] or "").translate(LOWER).encode()).hexdigest()
        want[(r[0], top, len(ids), r[0] == top, digest)] += 1
    assert collections.Counter(map(tuple, exact_dedup.dedup(docs).collect())) == want
    assert exact_dedup.keep_one(docs).count() == len(groups)
    assert exact_dedup.keep_one(docs).columns == docs.columns
    assert exact_dedup.dedup(none).count() == exact_dedup.keep_one(none).count() == 0


def test_index_inserts_and_deletes(spark, docs):
    keyed = docs.select("doc_id", exact_dedup.digest_hex("text").alias("hex"))
    entries = exact_dedup.rows_for_index(keyed, "doc_id", "hex")
    index = exact_dedup.build_index(entries)
    twice = exact_dedup.insert_into(index, entries)
    assert twice.agg(F.sum("rows")).first()[0] == 2 * docs.count() and twice.count() == index.count()
    gone = index.limit(7).select("digest").unionByName(spark.createDataFrame([(b"unknown",)], "digest binary"))
    assert exact_dedup.delete_from(index, gone).count() == index.count() - 7


def brute_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()
        out.append((len(d), int(gone.sum()), spans, kept))
    return out


@pytest.mark.parametrize("length,gram,group", [(400, 232, 50_000), (60, 24, 2)])
def test_suffix_dedup(docs, rows, none, length, gram, group):
    want = collections.Counter((r[0], *b) for r, b in zip(rows, brute_removal([r[1] for r in rows], length), strict=True))
    got = suffix_dedup.remove_repeats(docs, length=length, gram=gram, group=group).drop("removed")
    assert collections.Counter(map(tuple, got.collect())) == want
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_very_long_text_is_cut_without_effect(monkeypatch):
    rng = random.Random(1)
    text = prose(rng, 800).encode()
    text = np.frombuffer(text + text[500:1500], np.uint8)
    whole = suffix_dedup.units_of(text, np.array([0, len(text)]), 100, 40)
    covered = set()
    for lo in range(0, len(text), 700):
        part = text[lo : lo + 700 + 99]
        u = suffix_dedup.units_of(part, np.array([0, len(part)]), 100, 40)
        if u:
            covered |= {(int(a) + lo, int(g), d) for a, g, x, y in zip(u["at"], u["gram"], u["lo"], u["hi"], strict=True)
                        for d in range(x, y + 1)}
    assert covered == {(int(a), int(g), d) for a, g, x, y in
                       zip(whole["at"], whole["gram"], whole["lo"], whole["hi"], strict=True) for d in range(x, y + 1)}


def test_deep_shallow_order():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    strings += [b"a" * 40 + bytes([rng.randrange(256)]) * rng.randint(0, 50) for _ in range(200)]
    order = suffix_dedup.deep_shallow_sort(strings, shallow=16)
    assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))


def brute_classes(rows):
    sets = collections.defaultdict(list)
    for r in rows:
        w = WORDS.findall((r[1] or "").translate(LOWER))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        sets[r[0]].append(s)
    ids = [i for i in sets if i is not None]
    label = {i: i for i in ids}
    changed = True
    pairs = [(a, b) for a in ids for b in ids if a < b and any(
        s and t and 100 * len(s & t) >= 80 * len(s | t) for s in sets[a] for t in sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return collections.Counter((r[0], len(s), label.get(r[0])) for r in rows
                               for s in [next(iter(sets[r[0]]))])


@pytest.mark.parametrize("held", [2, jaccard.HELD])
def test_jaccard_classes(docs, rows, none, monkeypatch, held):
    monkeypatch.setattr(jaccard, "PARTNERS", 2)
    monkeypatch.setattr(jaccard, "HELD", held)  # shingles dealt to several tasks
    got = jaccard.classes(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert collections.Counter(map(tuple, got)) == brute_classes(rows)
    assert jaccard.classes(none).count() == 0
    assert jaccard.keep_one(none).columns == none.columns


@pytest.mark.parametrize("one_task", [0, components.ONE_TASK])
def test_components_of_a_long_chain(spark, one_task):
    links = spark.range(500).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    links = links.unionByName(spark.createDataFrame([(1000, 1001), (7, 7)], "u long, v long"))
    got = dict(components.components(links.repartition(16), one_task).collect())
    assert got == {**{i: 0 for i in range(501)}, 1000: 1000, 1001: 1000}
    assert components.components(links.limit(0), one_task).count() == 0


def test_histograms_bound_the_overlap():
    rng = np.random.default_rng(5)
    for n in (1, 40, 3000):
        both = rng.integers(0, 1 << 63, n).astype(np.uint64)
        one, two = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, n // 4).astype(np.uint64)])) for _ in "ab")
        x, y = (np.frombuffer(jaccard.histogram(s), np.uint8).astype(int) for s in (one, two))
        assert x.sum() == len(one) and np.minimum(x, y).sum() >= len(np.intersect1d(one, two))
    assert jaccard.histogram(np.arange(256, dtype=np.uint64) * np.uint64(jaccard.BUCKETS)) is None


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vecs = [(i, [float(x) for x in rng.normal(size=24)]) for i in range(200)]
    vecs += [(200 + i, vecs[5][1]) for i in range(30)] + [vecs[40], (300, None), (301, []), (302, [None] * 24), (303, [1.0, 2.0])]
    vecs += [(304, [float("nan")] * 24), (305, [float("inf")] * 24), (None, vecs[0][1]), (320, vecs[1][1]), (306, [1e9] * 24)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in vecs
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = collections.Counter()
    for q, v in good:
        if q % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
            for k, (s, i) in enumerate(found[:20]):
                want[(q, k + 1, i, -s)] += 1
    got = topk.top_k(df, F.col("vec_id") % 20 == 0)
    assert collections.Counter(map(tuple, got.collect())) == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold_at_every_level():
    rng = np.random.default_rng(4)
    a, b = rng.integers(-50, 50, (40, 30)).astype(float), rng.integers(-50, 50, (60, 30)).astype(float)
    for segments in (1, 4, 16, 64):
        bound = topk.segment_features(a, segments) @ topk.segment_features(b, segments).T
        assert (bound + 1e-6 >= a @ b.T).all()


def test_mixing(docs, rows, none):
    sizes = [(r[0], len(WORDS.findall(r[1] or "")), r[3]) for r in rows]
    order = sorted({s for _, _, s in sizes}, key=lambda s: (s is None, s or ""))
    total = [sum(z for _, z, t in sizes if t == s) for s in order]
    target = dict(zip(order, mixing.targets(total), strict=True))
    got = mixing.mix(docs, block=4).collect()
    again = mixing.mix(docs.repartition(3), block=4).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((i, z) for i, z, _ in sizes)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sum(target.values()) == pytest.approx(1.5 * sum(total))
    for s, t in target.items():
        ids = collections.Counter((r["doc_id"], r["size"]) for r in got if r["target"] == pytest.approx(t))
        assert ids
    assert sum(r["taken"] for r in got) == pytest.approx(1.5 * sum(total), rel=0.01)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    out = mixing.mixed_documents(docs, block=16)
    assert out.columns == docs.columns
    words = sum(len(WORDS.findall(r["text"])) for r in out.collect())
    assert words == pytest.approx(1.5 * sum(total), rel=0.03)


def test_targets_stop_at_the_limit():
    assert mixing.targets([10, 100, 100]) == pytest.approx([20, 295 * 2 / 3, 295 / 3])
    assert mixing.targets([0, 5]) == [0, 7.5] and mixing.targets([]) == []


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    out = mixing.permuted(np.arange(n), n, 12345)
    assert sorted(out) == list(range(n)) and (n < 17 or list(out) != list(range(n)))


def test_warc_round_trip(spark):
    long = "é" * 600
    pages = [(1, "http://a.b/ü x", long), (5, None, long), (3, "u", long), (2, "u", "short"), (9, "u", "short"), (4, "u", None),
             (6, "u", ""), (5, None, long), (None, "u", "x" * 2000), (8, "u", "y\r\n\r\nWARC/1.1" * 50_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = warc.archive(df).collect()
    want = collections.Counter()
    for i, _, h in pages:
        data = (h or "").encode()
        revisit = h == long and i != 5
        want[(i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None)] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                               for r in got) == want
    assert {r["page_id"]: bytes(r["payload"]) for r in got if r["record_type"] == "response"}[8] == pages[-1][2].encode()
    assert warc.archive(df.limit(0)).count() == 0


def test_seek_table_reads_single_frames(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 100)
    writer = warc.BundleWriter(str(tmp_path / "one.warc.zst"))
    places = [writer.add(bytes([65 + i]) * 60) for i in range(5)]
    writer.close()
    reader = warc.BundleReader(str(tmp_path / "one.warc.zst"))
    assert [reader.frame(f)[o : o + 60] for f, o in places] == [bytes([65 + i]) * 60 for i in range(5)]
    assert len(reader.frames) == 5


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, left in enumerate(bins) if left >= n]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_runs_are_best_fit_decreasing():
    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.randint(1, 60)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        left = collections.defaultdict(lambda c=capacity: c)
        for n, _, pieces, first, offset in packing.best_fit_runs(collections.Counter(lengths), capacity):
            for b in range(first, first + pieces):
                assert capacity - left[b] == offset
                left[b] -= n
        assert sorted(left.values()) == plain_best_fit(lengths, capacity)


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter()
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]
        start, size, piece = 0, len(ids) % 64 or 64, 0
        while start < len(ids):
            want[(r[0], piece, start, size, zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes()))] += 1
            start, size, piece = start + size, 64, piece + 1
    got = packing.pack_documents(docs, tokenizer_path(), capacity=64).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    held = collections.defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *(n for _, n in parts)])[:-1]) and sum(n for _, n in parts) <= 64
    assert len(held) == len(plain_best_fit([r["length"] for r in got], 64))
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


def test_ids_are_the_tokenizers():
    rng = random.Random(8)
    signs = "ab  \n\t'sé漢😀1²_.,\x85\xa0​%<|endoftext|>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["a" * 3000, " " * 3000 + "x", "x" + "\n" * 900]
    e = packing.encoder(tokenizer_path())
    assert e.fast is not None
    assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in e.slow.encode_batch(texts, add_special_tokens=False)]


def labelled(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        words = [prose(rng, 1) for _ in range(40)]
        rows.append((i, " ".join(words).capitalize() if good else " | ".join(words), "en", "s", 0))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), \
        spark.createDataFrame([*labels, (3, None), (None, 1), (4, 7)], "doc_id long, quality int")


def test_quality(spark, docs, none):
    df, labels = labelled(spark)
    got = quality.quality_scores(df, labels).join(labels.where("quality < 2"), "doc_id").where("held_out").collect()
    assert got and np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    odd = quality.quality_scores(docs, labels.limit(0)).collect()
    assert len(odd) == docs.count() and all(r["score"] == 0.5 and r["predicted"] == 1 for r in odd)
    assert quality.quality_scores(none, labels).count() == 0
    assert quality.accepted(df, labels).columns == df.columns


def test_language(spark, docs, none):
    rng = random.Random(10)
    parts = {"aa": ["the", "ing", "er", "on"], "bb": ["ção", "os", "ão", "qu"], "cc": ["ß", "sch", "ei", "un"]}
    rows = [(i, " ".join("".join(rng.choices(parts[k], k=3)) for _ in range(12)), k)
            for i, k in enumerate(rng.choices(list(parts), k=300))]
    rows += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", None)]
    got = {r["doc_id"]: r for r in language.predicted(
        spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(got[i]["lang_pred"], k) for i, _, k in rows[:300] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and np.mean([a == b for a, b in held]) > 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language.predicted(docs).collect()} <= {"de", "en", "und"}
    assert language.predicted(none).count() == 0


def test_long_text_is_hashed_in_parts(monkeypatch):
    text = prose(random.Random(11), 500)
    whole, _ = language.presence([text])
    monkeypatch.setattr(language, "CHARS", 100)
    assert (language.presence([text])[0] == whole).all()


PAGE = ('<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>x";</script></head><body><nav><ul><li>Home</ul></nav>'
        '<div class="box-17">Buy now</div><article><h1>Head&amp;line</h1><p><b>One  two<br>three<p>Four &lt;five&gt;'
        '<div class="share">Share</div><form>f</form><aside>s</aside><ul><li>a<li>b</ul></article>'
        '<section id="comments">c</section><footer>&copy; x')


def test_main_text():
    root = html.parse(PAGE)
    assert html.main_text(*html.main_elements(root)) == "Head&line\nOne two\nthree\nFour <five>\na\nb"
    bare = html.parse("text <b>of</b> a page<p>next<!-- no --><div class='ad'>ad</div><div>last</div>")
    assert html.main_text(*html.main_elements(bare)) == "text of a page\nnext\nlast"


def test_templates_go_and_copies_stay(spark):
    body = '<div class="x9">Our shop sells things</div><div><p>Story {} here</p></div><div class="x9">Tail</div>'
    pages = [(i, "http://h.example/a", body.format(i)) for i in range(6)]
    pages += [(10 + i, "http://copies.example/b", "<div>Same</div><p>text</p>") for i in range(8)]
    pages += [(20, "http://one.example", body.format(20)), (21, None, None), (22, "", ""), (23, "u", "<nav>x</nav>"), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("templates", F.lit("t"))
    got = html.extract(df).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert all(text[i] == f"Story {i} here" for i in range(6))
    assert all(text[10 + i] == "Same\ntext" for i in range(8))  # copies are no template
    assert text[20] == "Our shop sells things\nStory 20 here\nTail"
    assert text[21] == text[22] == text[23] == ""
    assert html.extract(df.limit(0)).count() == 0


def test_content_is_no_template_by_count(spark):
    body = "<div class=content><p>The same long story on all of these pages.<p>It goes on.</div>"
    box = "<ul><li>Salt</ul><table><tr><td>Flour</table>"
    pages = [("http://copies.example", f"<h1>Title {i}</h1><span>May {i}</span>{body}") for i in range(6)]
    pages += [("http://big.example", f"<h1>Soup {i}</h1><p>Cook {i}</p>{box if i < 5 else ''}") for i in range(40)]
    pages += [("http://in.example", f"<article><p>Cake {i}</p>{box}</article>") for i in range(6)]
    pages += [("http://main.example", f"<main><p>Pie {i}</p>{box}</main>") for i in range(6)]
    pages += [("http://boxes.example", f"<div><p>Buy</p></div><p>News {i}</p>{box}") for i in range(6)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    text = [r["text"] for r in html.extract(df).orderBy("page_id").collect()]
    assert text[:6] == [f"Title {i}\nMay {i}\nThe same long story on all of these pages.\nIt goes on." for i in range(6)]
    assert text[6:11] == [f"Soup {i}\nCook {i}\nSalt\nFlour" for i in range(5)]
    assert text[46:58] == [f"{k} {i}\nSalt\nFlour" for k in ("Cake", "Pie") for i in range(6)]
    assert text[58:] == [f"News {i}" for i in range(6)]  # template still goes


@pytest.mark.parametrize("tag", ["div", "font", "span", "blockquote"])
def test_deep_pages(tag):
    page = f"<p>top</p>{f'<{tag}>' * 10_000}<b>deep</b>"
    for text in (page, f"<article>{page}", f"<main>{page}"):
        root = html.parse(text)
        got = html.main_text(*html.main_elements(root), {"none"}, html.subtree_hashes(root))
        assert got == "top\ndeep"


def test_deep_page_keeps_the_rest(spark):
    pages = [(0, "http://h.example", "<div>" * 10_000 + "deep"), (1, "http://h.example", "<p>flat")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert [r["text"] for r in html.extract(df).orderBy("page_id").collect()] == ["deep", "flat"]


def test_article_keeps_what_names_only_resemble():
    page = ("<article><section id=related-work><p>Work</section><div class=legal-opinion>Opinion</div><math><mi>x</mi></math>"
            "<label>Name</label><div class='box related'>r</div><ul class=share-buttons><li>s</ul></article>")
    root = html.parse(page)
    assert html.main_text(*html.main_elements(root)) == "Work\nOpinion\nxName"


def test_added_tokens_have_their_own_ids(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|><|endoftext|> y", "a<|endoftext|", "a" * 600 + "<|endoftext|>"]
    e = packing.Encoder(tokenizer_path())
    ids = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[0] == [64, 50256, 65]
    assert e.encode(texts) == [np.array(x, "<u4").tobytes() for x in ids]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids_crc32"] for r in packing.token_pieces(df, tokenizer_path()).collect()}
    assert got == {i: zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for i, x in enumerate(ids)}


def test_jaccard_gives_no_partial_number_of_links(docs):
    assert jaccard.classes(docs).columns == ["doc_id", "n_shingles", "component_id"]


def test_every_language_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(language, "ROWS_PER_LANGUAGE", 1)
    df = spark.createDataFrame([(i, f"text {i} of {i}", f"l{i}") for i in range(210)], "doc_id long, text string, lang string")
    assert len(language.train(df, F.lit(True)).languages) == 210


def test_jaccard_attaches_a_large_group_with_few_pairs(spark, monkeypatch):
    """Near copies of one text: the pairs compared stay near their number, and all are one class."""
    import random

    rng, met = random.Random(11), []
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = []
    for i in range(600):
        own = list(words)
        for at in rng.sample(range(400), 3):
            own[at] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(own)))
    plain = jaccard.verified

    def counted(rows, pairs, hists):
        met.append(pairs.select("a", "b").distinct().count())
        return plain(rows, pairs, hists)

    monkeypatch.setattr(jaccard, "verified", counted)
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}
    assert sum(met) < 4 * len(rows)


def test_sieve_holds_every_id(spark):
    ids = spark.range(0, 40000, 7).repartition(9)
    bits = jaccard.sieve(ids)
    asked = spark.range(0, 40000).select(F.col("id").alias("_id"))
    kept = {r[0] for r in jaccard.sifted(asked, bits).collect()}
    assert set(range(0, 40000, 7)) <= kept and len(kept) < 6500
