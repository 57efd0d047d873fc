"""Vector codes, fill-in-the-middle and line deduplication against brute force on odd cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from claimflow.llm import fill_middle, line_dedup, queries, vector_codes

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
DOCS = "doc_id long, text string, position int, n long, _text string, hash binary, output string"


def documents(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, 2, "x", b"y", "z") for i, t in rows], DOCS).repartition(5)


# -- vector codes ------------------------------------------------------------------------------------


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """One distance at a time, in Python integers."""
    kept = [(i, [int(np.floor(1024.0 * x)) for x in v], lab) for i, v, lab in rows
            if v and all(x is not None and np.isfinite(x) for x in v)]
    d = len(min((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1]))[1])
    kept = [r for r in kept if len(r[1]) == d]
    cuts = [k * d // parts for k in range(parts + 1)]
    firsts = {}
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])):
        firsts.setdefault(i, v)
    books = [[v[a:b] for _, v in sorted(firsts.items())[:entries]] for a, b in zip(cuts, cuts[1:])]

    def assigned(v):
        out = []
        for p, book in enumerate(books):
            w = v[cuts[p] : cuts[p + 1]]
            out.append(min((sum((x - y) ** 2 for x, y in zip(w, e)), k) for k, e in enumerate(book)))
        return out

    for _ in range(rounds):
        held = [collections.defaultdict(list) for _ in books]
        for _, v, _ in kept:
            for p, (_, k) in enumerate(assigned(v)):
                held[p][k].append(v[cuts[p] : cuts[p + 1]])
        books = [[[sum(c) // len(held[p][k]) for c in zip(*held[p][k])] if held[p][k] else e
                  for k, e in enumerate(book)] for p, book in enumerate(books)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [(i, lab, assigned(v)) for i, v, lab in kept]
    by_label = collections.Counter()
    for _, lab, a in coded:
        by_label[lab] += sum(x for x, _ in a)
    return sorted(((i, "".join(f"{k:02x}" for _, k in a), sum(x for x, _ in a), by_label[lab], digest) for i, lab, a in coded), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, [0], "c") for i, v, lab in rows],
                                 "vec_id long, embedding array<double>, label int, id long, v array<int>, code string").repartition(4)


def test_vector_codes_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice((-1, 0, 0.5, 1)) * rng.random() for _ in range(10)], rng.choice((None, 1, 2))) for i in range(60)]
    rows += [(100 + i, rows[i % 3][1], 3) for i in range(20)]  # equal vectors: ties between entries
    rows += [rows[4], rows[4], (5, [0.0] * 10, 7), (None, [0.25] * 10, None), (80, None, 1), (81, [], 1), (82, [None] + [1.0] * 9, 1),
             (83, [float("nan")] * 10, 1), (84, [float("inf")] * 10, 1), (85, [1.0] * 4, 1), (86, [120000.0] * 10, 1), (87, [-130000.0] * 10, 2)]
    for entries in (256, 16):
        got = vector_codes.vector_codes(vectors(spark, rows), entries=entries).collect()
        assert sorted(map(tuple, got), key=str) == plain_codes(rows, entries=entries)


def test_vector_codes_of_nothing_and_of_too_much(spark):
    assert vector_codes.vector_codes(vectors(spark, [])).count() == 0
    assert vector_codes.vector_codes(vectors(spark, [(1, None, 1), (2, [float("nan")], 1)])).count() == 0
    with pytest.raises(Exception, match="too large"):
        vector_codes.vector_codes(vectors(spark, [(1, [200000.0] * 4, 1)])).count()


def test_label_errors_of_many_labels_by_the_salted_join(spark, monkeypatch):
    rows = [(i, [float(i % 7), 1.0 * i, 0.0, 2.0], i % 40 if i % 3 else None) for i in range(200)]
    want = sorted(map(tuple, vector_codes.vector_codes(vectors(spark, rows)).collect()), key=str)
    join = vector_codes.lookup_join
    monkeypatch.setattr(vector_codes, "lookup_join", lambda *a: join(*a, rows=0))
    assert sorted(map(tuple, vector_codes.vector_codes(vectors(spark, rows)).collect()), key=str) == want == plain_codes(rows)


@pytest.mark.parametrize("scale", [3, 2000, 1 << 24])
def test_tree_search_is_exact(scale):
    rng = np.random.default_rng(scale)
    for dim in (1, 5, 16):
        book = rng.integers(-scale, scale, (256, dim))
        book[100:120] = book[7]  # equal entries, and with a small scale many equal distances
        queries_ = np.concatenate([rng.integers(-scale, scale, (500, dim)), book])
        tree = vector_codes.Gnat(book)
        index, best = tree.nearest(queries_)
        squares = ((queries_[:, None, :] - book[None]) ** 2).sum(2)
        assert (best == squares.min(1)).all() and (index == squares.argmin(1)).all()


def test_tree_skips_most_entries_of_clustered_codebooks():
    rng = np.random.default_rng(5)
    centres = rng.integers(-100_000, 100_000, (24, 16))
    draw = lambda n: centres[rng.integers(0, 24, n)] + rng.integers(-300, 300, (n, 16))
    tree = vector_codes.Gnat(draw(256))
    asked = draw(4000)
    index, best = tree.nearest(asked)
    assert tree.measured < 0.25 * 4000 * 256
    squares = vector_codes.squared_distances(asked, tree.entries)
    assert (index == squares.argmin(1)).all() and (best == squares.min(1)).all()


# -- fill in the middle ------------------------------------------------------------------------------


def plain_middle(i, text, rate=100, spm=50, marks=("<P>", "<S>", "<M>"), seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return i, len(units), "plain", text, None, None, text
    if h[3] % 100 < spm:
        return i, len(units), "spm", marks[1] + s + marks[0] + p + marks[2] + m, len(p), len(m), text
    return i, len(units), "psm", marks[0] + p + marks[1] + s + marks[2] + m, len(p), len(m), text


MIDDLES = [(1, "a\nb\nc"), (2, None), (3, ""), (4, "x <S> y"), (5, "\n\n\n"), (6, "line\n" * 300_000), (7, "ü😀\nß\n" * 10 + "😀"),
           (None, "a\nb\n"), (9, "one"), (10, "<S\n<P\n<M\n<\n" * 5), (11, "$1\\\n$2\n" * 7), (12, "\r\n\x85 " * 9),
           (9, "one"), (13, "x" * 500_000)] + [(i, f"q{i}\nrr\n" * (i % 5) + "z") for i in range(20, 60)]


@pytest.mark.parametrize("args", [{}, {"rate": 60, "spm": 0}, {"rate": 0}, {"spm": 100, "seed": 9, "marks": ("[$1]", "\\E(s)", "{m}")}])
def test_fill_in_middle_equals_slices(spark, args):
    marks = fill_middle.Markers(*args.get("marks", ("<P>", "<S>", "<M>")))
    made = fill_middle.fill_in_middle(documents(spark, MIDDLES), seed=args.get("seed", 7), rate=args.get("rate", 100),
                                      spm_rate=args.get("spm", 50), markers=marks)
    back = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), marks))
    assert sorted(map(tuple, back.collect()), key=str) == sorted((plain_middle(i, t, **args) for i, t in MIDDLES), key=str)


def test_fill_in_middle_of_nothing(spark):
    assert fill_middle.fill_in_middle(documents(spark, [])).count() == 0


# -- line deduplication --------------------------------------------------------------------------------


def plain_lines(docs, least=20, documents_=3):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    rank = lambda i: -1 if i is None else i
    held = collections.defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(rank(i))
    out = []
    for i, t in docs:
        every = (t or "").split("\n")
        stay = [x for x in every if len(held[key(x)]) < documents_ or rank(i) == max(held[key(x)])]
        out.append((i, len(every), len(every) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(3)
    pool = [f"line number {k} with some length Äß" if k % 3 else f"  Another LINE of length {k} \t" for k in range(60)]
    pool += ["short", "", "   ", "exactly twenty chars", "nineteen characters", "ÄÖÜ äöü ÀÉ twenty chars long",
             "äöü äöü ÀÉ twenty chars long", "\x0b\x0c exactly TWENTY chars\r", "\xa0exactly twenty chars"]
    text = lambda: "\n".join(rng.choice(pool) + (str(rng.random()) if rng.random() < 0.3 else "") for _ in range(rng.randint(0, 15)))
    docs = [(i, text()) for i in range(80)]
    docs += [(90, None), (91, ""), (92, "\n\n"), (None, docs[0][1]), (None, pool[0] + "\n" + pool[1]), docs[5], docs[5],
             (7, "\n".join(pool)), (93, "hot line that is found everywhere\n" * 3)]
    return docs + [(200 + i, f"HOT line that is found everywhere\nx\nhot line that is found everywhere {i}\nhot line that is found everywhere")
                   for i in range(600)]


@pytest.mark.parametrize("hot_keys", [1024, 1])
@pytest.mark.parametrize("least,held", [(20, 3), (1, 2)])
def test_line_dedup_equals_brute_force(spark, monkeypatch, hot_keys, least, held):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", hot_keys)
    rows = line_rows()
    docs = documents(spark, rows)
    kept = line_dedup.without_lines(docs, line_dedup.keep_bitmaps(docs, least, held))
    assert sorted(map(tuple, kept.collect()), key=str) == plain_lines(rows, least, held)


def test_hot_lines_take_either_way_to_the_same_rows(spark):
    docs = documents(spark, line_rows())
    keyed = docs.select(F.col("doc_id").alias("id"), F.lit(1).alias("twin"), F.posexplode(line_dedup.lines(F.col("text"))).alias("position", "line"))
    rows = keyed.select("id", "twin", "position", F.sha2("line", 256).cast("binary").alias("hash"))
    one, two = (sorted(map(tuple, f(rows, 3).collect()), key=str) for f in (line_dedup._streamed, line_dedup._aggregated))
    assert one == two and one
    short = rows.withColumn("short", F.xxhash64("hash"))
    assert 0 < line_dedup._hot(short).count() <= line_dedup.HOT_KEYS


def test_bitmaps_are_short_and_long_texts_decode_in_linear_time(spark):
    text = "\n".join(f"keep {i}" if i % 2 else f"repeated line number {i}" for i in range(100_000))
    block = "\n".join(f"a block of repeated lines {i}" for i in range(50_000))
    docs = documents(spark, [(1, text), (2, text), (3, text), (4, block), (5, block), (6, block)])
    maps = line_dedup.keep_bitmaps(docs)
    assert {r["id"]: r["n_dropped"] for r in maps.collect()} == {1: 50_000, 2: 50_000, 4: 50_000, 5: 50_000}
    assert {r["id"]: r["run_ends"] for r in maps.where("id IN (4, 5)").collect()} == {4: [0, 50_000], 5: [0, 50_000]}
    kept = {r[0]: r[1] for r in line_dedup.without_lines(docs, maps).select("doc_id", F.length("kept_text")).collect()}
    assert kept[4] == kept[5] == 0 and kept[3] == len(text) and kept[6] == len(block)
    assert kept[1] == len("\n".join(x for x in text.split("\n") if x.startswith("keep")))


def test_line_dedup_of_nothing(spark):
    docs = documents(spark, [])
    assert line_dedup.without_lines(docs, line_dedup.keep_bitmaps(docs)).count() == 0


# -- queries -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_fill_in_middle", "op13_line_dedup"])
def test_queries_equal_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) == ""
