"""The text operators against brute force, exact round trips and known cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from skarn.llm import common, decontaminate, html_text, jaccard_join, lang_id, licenses, line_dedup, pieces, quality, token_file, twice, winnow
from skarn.llm.word_cache import WordCache

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
BPE, SP = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
LOWER = {i: i + 32 for i in range(65, 91)}
WS = " \t\n\x0b\x0c\r"

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sa", "ti", "vo") for b in ("ran", "del", "pos", "tik", "mon", "ver")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Odd cases, repeated lines, copies and near copies; extra columns clash
    with names the operators use."""
    rng = random.Random(5)
    shared = [prose(rng, 12) for _ in range(5)]
    base = prose(rng, 120)
    texts = ["", None, " ", "\n\n", "one", "A b c", "  Lead and trail \t", "é ü 日本語 ▁ x", "<|endoftext|> it's 12  34", "x" * 3000, prose(rng, 30_000)]
    for k in range(40):
        lines = [prose(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 5))]
        if k % 2:
            lines.insert(rng.randint(0, len(lines)), rng.choice(shared) + ("  " if k % 3 else ""))
        if k % 4 == 1:
            lines.append(shared[0].upper())
        texts.append("\n".join(lines))
    for k in range(12):  # near copies, and exact copies of them
        words = base.split()
        for _ in range(k % 5):
            words[rng.randrange(len(words))] = f"edit{k}"
        texts += [" ".join(words)] * (1 + k % 2)
    rows = [(k * 7 % 1000, t, None if k % 9 == 0 else "en", "s", k, float(k)) for k, t in enumerate(texts)]
    rows.append((None, "no id here at all " * 3, "en", "s", 0, 0.0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, score double")


@pytest.fixture(scope="module")
def docs(corpus):
    return [(r.doc_id, r.text) for r in corpus.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int, score double")


def lines_expected(docs):
    key = lambda x: x.strip(WS).translate(LOWER)
    held = collections.defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(-1 if i is None else i)
    out = {}
    for i, t in docs:
        own = (t or "").split("\n")
        stay = [x for x in own if len(held.get(key(x), ())) < 3 or max(held[key(x)]) == (-1 if i is None else i)]
        out[i] = (len(own), len(own) - len(stay), "\n".join(stay))
    return out


def test_line_dedup(corpus, docs, empty):
    want = lines_expected(docs)
    got = line_dedup.dedup_lines(corpus).collect()
    assert len(got) == len(docs) and any(r.n_dropped for r in got)
    for r in got:
        assert (r.n_lines, r.n_dropped, r.kept_text) == want[r.doc_id]
        assert r.kept_sha256 == hashlib.sha256(want[r.doc_id][2].encode()).hexdigest()
    assert line_dedup.dedup_lines(empty).count() == 0
    out = line_dedup.rewrite_documents(corpus)
    assert out.columns == corpus.columns
    assert {(r.doc_id, r.text) for r in out.collect()} == {(i, w[2]) for i, w in want.items()}


def test_line_filter_has_no_false_negatives(corpus, docs):
    bits = 1 << 20
    filt = twice.collected(line_dedup.twice_filter(corpus, bits, 20), bits)
    counts = collections.Counter(k for _, t in docs for k in line_dedup.keys_of(t, 20))
    pos = line_dedup.probes([k for k, n in counts.items() if n > 1], bits)
    assert twice.has(filt, pos).all()


def test_filter_grows_with_the_lines(spark, monkeypatch):
    """With the lines dealt to shards of the filter, of which hot ones are copied,
    the result is the same, and the share of lines suspected by chance stays small."""
    rng = random.Random(21)
    shared = [prose(rng, 9) for _ in range(30)]
    docs = [(k if k % 50 else None, "\n".join([*(prose(rng, 8) for _ in range(40)), rng.choice(shared)])) for k in range(900)]
    docs.append((3, None))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    here = sorted(map(str, line_dedup.dedup_lines(df).collect()))
    monkeypatch.setattr(line_dedup, "HELD_BITS", 0)
    monkeypatch.setattr(twice, "QUESTIONS", 5000)
    monkeypatch.setattr(line_dedup, "MIN_BITS", 1 << 16)
    assert sorted(map(str, line_dedup.dedup_lines(df).collect())) == here
    texts = df.selectExpr(f"coalesce(doc_id, {line_dedup.NO_ID}) doc_id", "text")
    held = {k for _, t in docs for k in line_dedup.keys_of(t, 20)}
    found = {bytes(r.line) for r in line_dedup.suspected(texts, line_dedup.filter_bits(len(held)), 20).collect()}
    once = held - {k.encode() for k in shared}
    assert {k.encode() for k in shared} <= found and len(found & once) / len(once) < 0.06


def test_line_dedup_ids_beside_null(spark):
    big, line = 1 << 53, "a line that is long enough"
    rows = [(big + 1, line), (None, line), (big + 3, line), (big + 5, line), (None, "x\n" + line)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id or 0, r.n_dropped) for r in got) == [(0, 1), (0, 1), (big + 1, 1), (big + 3, 1), (big + 5, 0)]


def test_repeated_ids_count_once(spark):
    line = "a line that is long enough"
    df = spark.createDataFrame([(1, line), (1, line), (2, line)], "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup.dedup_lines(df).collect()} == {0}
    df = df.union(spark.createDataFrame([(3, line.upper() + " ")], "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()) == [(1, 1), (1, 1), (2, 1), (3, 0)]


def test_main_text():
    field = html_text.default_field()
    page = (
        "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>News</a></li></ul></nav>"
        "<div class='cookie-notice'>We use cookies.</div><article><h1>A &amp; B</h1><p><b>First  part of it, with words enough to count.<br><p>Second paragraph of the article, which goes on for a while.</p>"
        "<div class='ad'>Buy now</div><p>Third &copy; one, again long enough to be prose.</p></article><section class='comments'><p>Great post, thanks a lot!</p></section><footer>Imprint</footer></body></html>"
    )
    assert html_text.main_text(page, field) == "A & B\nFirst part of it, with words enough to count.\nSecond paragraph of the article, which goes on for a while.\nThird © one, again long enough to be prose."
    assert html_text.main_text(None, field) == html_text.main_text("", field) == ""
    for odd in ("<", "<p", "<!-- open", "<script>x", "</p></div>", "<p a='<b'>x", "a < b", "<div>" * 500 + "x"):
        assert isinstance(html_text.main_text(odd, field), str)


def test_field_on_unseen_layouts():
    field = html_text.default_field()
    wrong = total = 0
    for page, labels in html_text.labelled_pages(80, seed=77):
        blocks = html_text.blocks_of(page)
        for b, y in zip(blocks, field.decode(blocks)):
            wrong += labels[b.text] != y
            total += 1
    assert wrong / total < 0.03


def test_extract_pages(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Some words, said at length and with a point.</p></article>"), (2, None, None)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.n_chars) for r in html_text.extract(df).collect()) == [(1, 44), (2, 0)]


def test_license_scan(spark, corpus):
    from skarn.llm.license_texts import KNOWN

    mit = next(t for i, t in KNOWN if i == "MIT")
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " , ")), (2, "prose here\nLicenced under the Apache Licence, version 2.0!\nAll rights reserved."), (3, mit + " more"), (4, None), (5, "")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].whole_license == "MIT"
    assert (got[2].whole_license, got[2].n_notices, got[2].licenses) == (None, 1, "Apache-2.0")
    assert [got[k].licenses for k in (3, 4, 5)] == ["", "", ""]
    assert licenses.scan(corpus).where("n_notices > 0").count() == 0


def test_simple8b_round_trip():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(0, 300))
        ids = rng.integers(0, 2 ** int(rng.integers(1, 33)), n, dtype=np.uint64).astype(np.uint32)
        words, _ = token_file.pack(ids)
        assert (token_file.unpack(words) == ids).all()
    docs = [rng.integers(0, 60000, int(k)).astype(np.uint32) for k in (0, 1, 5, 0, 900, 3)]
    block = token_file.write_block(docs)
    for a, b in zip(docs, token_file.read_block(block)):
        assert (a == b).all()
    assert (token_file.read_document(block, 4) == docs[4]).all()
    assert len(token_file.pack(np.ones(60, np.uint32))[0]) == 1
    with pytest.raises(ValueError):
        token_file.open_block(b"XXXX" + block[4:])


def test_cached_encoder_is_the_library(docs):
    enc = token_file.CachedEncoder(BPE, keep=300)
    enc.cache.most = 40
    tok = tokenizers.Tokenizer.from_file(BPE)
    tok.encode_special_tokens = True
    parts = ["a", "word", "Ünï", "é", "don't", "'s", "x'll", "!", "..", "%%%", "12", " ", " ", " ", "  ", "\n", "\n", "\n\n", "\n\n\n", "\t", "\r\n", "\u3000", "\xa0"]
    parts += ["\x1c", "\x85", "日本", "🎉", "<|endoftext|>", "_", "ª", "µ", "×", "\u0301", "ǅ", "A", "\u200b", "\u2003", "\x00", "\x7f"]
    rng = random.Random(12)
    texts = [t or "" for _, t in docs] + ["", " ", "a  b", "a\n b", "a b ", "tab\t x", "　x y"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(6000)]
    for k in range(0, len(texts), 700):
        some = texts[k : k + 700]
        for text, ids in zip(some, enc(some)):
            assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids
    assert enc([]) == [] and [len(x) for x in enc(["", ""])] == [0, 0]


def test_token_file_ids_beside_null(spark):
    big = 1 << 53
    rows = [(None, "b c"), (big + 3, "x"), (None, "a"), (big + 1, "y z"), (7, ""), (7, ""), (7, None)]
    path = common.new_path(spark, "t")
    token_file.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, BPE, partitions=1)
    got = token_file.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 7, 7, 7, big + 1, big + 3]
    assert [r.n_tokens for r in got] == [2, 3, 1, 1, 1, 3, 2]


def test_token_file(spark, corpus, docs, empty):
    path = common.new_path(spark, "t")
    token_file.write_tokens(corpus, path, BPE, block_ids=200, partitions=3)
    got = {r.doc_id: r for r in token_file.read_tokens(spark, path).collect()}
    tok = tokenizers.Tokenizer.from_file(BPE)
    tok.encode_special_tokens = True
    at = 0
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    path = common.new_path(spark, "t")
    token_file.write_tokens(empty, path, BPE)
    assert token_file.read_tokens(spark, path).count() == 0


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(1, "If Anna has 12 apples and buys 5 kg of pears then how many 12 things does the shop of Anna hold"), (2, prose(rng, 25)), (3, "short one here"), (4, None), (5, ""), (6, "12 13 14 15 16")]
    docs = [
        (10, prose(rng, 40) + " " + items[1][1] + " " + prose(rng, 10)),
        (11, "Intro text. If Berta has 77 apples and buys 9 kg of pears then how many 77 things does the shop of Berta hold, they asked"),
        (12, "Intro text. If Berta has 77 apples and buys 9 kg of pears then how many 31 things does the shop of Carla hold, they asked"),
        (13, prose(rng, 60)), (14, "this is a short one here now"), (15, None), (16, ""), (None, items[1][1]), (17, "Short, one: here!"),
        (18, "12 13 14 15 16"), (None, prose(rng, 30)), (10, prose(rng, 30)), (10, prose(rng, 40) + items[1][1]), (19, prose(rng, 9000) + " " + items[1][1]),
    ]
    d = spark.createDataFrame([(*r, "clash", k) for k, r in enumerate(docs)], "doc_id long, text string, item_id string, matched int")
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    got = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect())
    assert got == {(10, 2): 2, (11, 1): 1, (17, 3): 1, (None, 2): 1, (19, 2): 1}
    by = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(d, b).collect()}
    assert by[10, 2].verbatim and not by[11, 1].verbatim and by[11, 1].n_slots == by[11, 1].n_consistent > 0
    kept = decontaminate.drop_leaks(d, b)
    assert kept.columns == d.columns and sorted(r.matched for r in kept.collect()) == [2, 3, 4, 5, 6, 9, 10, 11]
    assert decontaminate.leaks(d, b.limit(0)).count() == decontaminate.leaks(d.limit(0), b).count() == 0
    assert decontaminate.drop_leaks(d.limit(0), b).count() == 0 and decontaminate.drop_leaks(d, b.limit(0)).count() == len(docs)


def leaks_brute(doc, item):
    """matched, windows, n_slots, n_consistent of token lists, or None."""
    k = min(decontaminate.K, len(item))
    mark = lambda w: w[0] if w < "\x04" else w
    plain = [w for w in item if w >= "\x04"]
    a, b = list(map(mark, item)), list(map(mark, doc))
    wins = [i for i in range(len(item) - k + 1) if any(w >= "\x04" for w in item[i : i + k])]
    if not wins or not doc:
        return None
    bands = collections.defaultdict(set)
    for i in wins:
        for p in range(len(doc) - k + 1):
            if b[p : p + k] == a[i : i + k]:
                for band in ((p - i) // decontaminate.DRIFT, (p - i) // decontaminate.DRIFT - 1):
                    bands[band].add((i, p - i))
    if not bands:
        return None
    band = min(bands, key=lambda x: (-len({i for i, _ in bands[x]}), x))
    matched = len({i for i, _ in bands[band]})
    if matched < decontaminate.COVERAGE * len(wins) or len(plain) < decontaminate.LEAST and not (len(doc) == len(item) and matched == len(wins)):
        return None
    slots = {}
    for i, shift in sorted(bands[band], key=lambda x: x[1]):
        for at in range(i, i + k):
            if item[at] < "\x04":
                slots.setdefault(at, doc[at + shift])
    values = collections.defaultdict(set)
    for at, v in slots.items():
        values[item[at]].add(v)
    good = sum(len(v) == 1 for v in values.values())
    return (matched, len(wins), len(values), good) if good >= decontaminate.CONSISTENT * len(values) else None


def test_decontamination_by_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(29)
    words = ["the", "sum", "of", "is", "and", "Anna", "Bob", "12", "7", "30 km", "5%", "has", "kept"]
    texts = lambda n, lo, hi: [(k, " ".join(rng.choice(words) for _ in range(rng.randint(lo, hi)))) for k in range(n)]
    items = texts(30, 1, 30)
    docs = texts(60, 0, 40)
    for k in range(60, 110):  # items with words put in, taken out and changed
        own = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(own) + 1)
            own[at : at + rng.randint(0, 1)] = rng.choice([[], ["new"], ["99"], ["Carl"]])
        docs.append((k, " ".join(["before"] * rng.randint(0, 9) + own + own * rng.randint(0, 1))))
    docs.append((200, "sum of " + " ".join(map(str, range(3000)))))
    items.append((100, "Say what the sum is and what it is of " + " ".join(map(str, range(200)))))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    cut = lambda df, key: {r[0]: r[1] for r in df.select(key, decontaminate.tokens(F.col("text"))).collect()}
    dt, it = cut(d, "doc_id"), cut(b, "item_id")
    want = {(x, y): got for x in dt for y in it if (got := leaks_brute(dt[x], it[y]))}
    got = {(r.doc_id, r.item_id): (r.matched, r.windows, r.n_slots, r.n_consistent) for r in decontaminate.leaks(d, b).collect()}
    assert got == want and len(want) > 15


def winnow_brute(text):
    words = [w for w in re.split(winnow.WS, (text or "").lower().strip(winnow.WS_CHARS)) if w]
    grams = [tuple(words[i : i + winnow.K]) for i in range(max(1, len(words) - winnow.K + 1))] if words else []
    return words, grams


def test_winnowing(spark, corpus, docs):
    from pyspark.sql import functions as F

    fp = winnow.with_fingerprint(corpus.select("doc_id", "text"), "text", "fp").select("doc_id", "text", "fp", winnow.positions(F.col("fp")).alias("pos"))
    value = {}
    for r in fp.collect():
        words, grams = winnow_brute(r.text)
        n = len(grams)
        assert (len(r.fp) == 0) == (n == 0)
        for entry, p in zip(r.fp, r.pos):  # one hash a k-gram, everywhere
            assert value.setdefault(grams[p], entry >> winnow.POSITION_BITS) == entry >> winnow.POSITION_BITS
        chosen = set(r.pos)
        for s in range(max(0, n - winnow.WINDOW) + 1 if n else 0):
            assert chosen & set(range(s, min(n, s + winnow.WINDOW)))  # the guarantee
    ordered = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    got = {r.doc_id: r for r in winnow.compare(corpus).collect()}
    for k, (i, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].n_chars == len(t) and 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if edited == t:
            assert got[i].fingerprint == got[i].edited_fingerprint and got[i].near_edited == 1


def winnow_chosen(grams, value):
    """Places that winnowing keeps, by its definition."""
    n, w = len(grams), winnow.WINDOW
    if n < winnow.SHORT:
        return [p for p in range(n)]
    kept = set()
    for s in range(n - w + 1):
        least = min(value[grams[p]] for p in range(s, s + w))
        kept.add(max(p for p in range(s, s + w) if value[grams[p]] == least))
    return sorted(kept)


def test_winnowing_by_brute_force(spark):
    """Minimum, rightmost of ties (few words make many equal k-grams), likeness."""
    from pyspark.sql import functions as F

    rng = random.Random(14)
    texts = [" ".join(rng.choice("ab" if k % 2 else "abcd") for _ in range(rng.randint(0, 120))) for k in range(120)] + ["a " * 90, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = winnow.with_fingerprint(df, "text", "fp").select("doc_id", "fp", winnow.positions(F.col("fp")).alias("pos")).collect()
    value, every = {}, {}
    whole = winnow.with_fingerprint(spark.createDataFrame([(k, " ".join(g)) for k, g in enumerate({g for t in texts for g in winnow_brute(t)[1]})], "k long, text string"), "text", "fp")
    for r in whole.collect():
        value[tuple(r.text.split(" "))] = r.fp[0] >> winnow.POSITION_BITS
    for r in got:
        grams = winnow_brute(texts[r.doc_id])[1]
        assert sorted(r.pos) == winnow_chosen(grams, value)
        every[r.doc_id] = {value[grams[p]] for p in r.pos}
    ordered = sorted(range(len(texts)), reverse=True)
    for r in winnow.compare(df).collect():
        a, b = every[r.doc_id], every[ordered[(ordered.index(r.doc_id) + 1) % len(ordered)]]
        assert r.near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_neighbours_across_buckets(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(winnow, "BUCKET_ROWS", 4)
    rng = random.Random(4)
    spread = rng.sample(range(10_000), 60)
    clustered = [k if k < 80 else 10**12 + k * 10**9 for k in range(100)]
    hot = [5] * 70 + [None] * 50 + spread[:30] + [-(1 << 62), (1 << 63) - 1]
    for ids in (spread, clustered, hot, [7], [None], [3, 3, None, None]):
        df = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
        placed = winnow.with_bucket(df)
        rows = sorted(placed.select("o", "hash", "text", "doc_id", "q", "s", "h").collect())
        assert [tuple(r)[4:] for r in rows] == sorted(tuple(r)[4:] for r in rows)  # buckets grow with the order
        if len(ids) > 50:
            assert max(collections.Counter(tuple(r)[4:] for r in rows).values()) <= 6 * winnow.BUCKET_ROWS
        got = {r.text: r.next_text for r in winnow.with_next(df, lambda x: x, ["text"]).collect()}
        order = [r.text for r in rows]
        assert got == {t: order[(k + 1) % len(order)] for k, t in enumerate(order)}
        assert [r.doc_id for r in rows] == sorted(ids, key=lambda i: (i is None, -(i or 0)))
    same = spark.createDataFrame([(1, "x")] * 20 + [(None, "y")] * 20, "doc_id long, text string")
    got = collections.Counter((r.text, r.next_text) for r in winnow.with_next(same, lambda x: x, ["text"]).collect())
    assert got == {("x", "x"): 19, ("x", "y"): 1, ("y", "y"): 19, ("y", "x"): 1}
    assert winnow.compare(same.limit(0)).count() == 0


def test_language_id(spark, empty):
    rng = random.Random(2)
    makers = {"en": ["the", "thing", "with", "other", "would"], "de": ["der", "nicht", "schön", "über", "auch"], "fr": ["être", "élève", "que", "dans", "façon"]}
    rows = [(k, " ".join(rng.choice(makers[lang]) for _ in range(40)), lang) for k, lang in enumerate(rng.choice(list(makers)) for _ in range(240))]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !!", "de"), (902, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lang_id.predict(df, lang_id.fit(df)).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert lang_id.predict(df, lang_id.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_pieces(docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    plain, varied = pieces.Encoder(SP, dropout=0.0), pieces.Encoder(SP)
    texts = [t or "" for _, t in docs] + ["The quick brown fox  jumps", " lead", "日本語 🎉"]
    ids = list(range(len(texts)))
    names = plain.model.bytes
    for t, a, b in zip(texts, plain(texts, ids), varied(texts, ids)):
        if t and "▁" not in t:
            assert a.tolist() == sp.encode(t)
        assert pieces.decode(a, names) == pieces.decode(b, names) == t
    assert [x.tolist() for x in varied(texts, ids)] == [x.tolist() for x in pieces.Encoder(SP)(texts, ids)]
    seen = {tuple(x.tolist()) for x in varied(["informational representation of dependencies"] * 40, list(range(40)))}
    assert 1 < len(seen) <= varied.variants
    units = [" " + w for w in dict.fromkeys(" ".join(texts).split()) if len(w) < pieces.LONG - 1]
    assert varied.units(units, 2) == [varied.agenda(u, pieces._unit_key(u, 2, varied.seed)) for u in units]


def test_pieces_query(spark, corpus):
    got = pieces.round_trip(corpus, SP).collect()
    assert len(got) == corpus.count() and all(r.lossless for r in got)
    chained = pieces.with_decoded(pieces.with_pieces(corpus.select("doc_id", "text"), SP), SP).select("doc_id", "decoded.sha256").collect()
    assert sorted((r.doc_id or -1, r.sha256) for r in chained) == sorted((r.doc_id or -1, r.decoded_sha256) for r in got)


def shingle_set(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def test_shingles_count_exactly():
    rng = random.Random(3)
    parts = ["he", "or", "the", "r", "é", "HE", "o"]
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    texts += ["heor orhe hreo roeh eohr", "a" * 500 + " b c d e f", "a" * 499 + "b b c d e f", "\t", "x\x0by z"]
    sets = [shingle_set(t) for t in texts]
    tokens = list(jaccard_join.shingles(texts))
    assert [len(t) for t in tokens] == [len(s) for s in sets]
    value = {}
    for s in set().union(*sets):
        value[s] = next(jaccard_join.shingles([" ".join(s)]))[0]
    assert len(set(value.values())) == len(value)
    assert all({value[x] for x in s} == set(t.tolist()) for s, t in zip(sets, tokens))


def brute_components(docs):
    ids = [(1 << 62) if i is None else i for i, _ in docs]
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                parent[find(a)] = find(b)
    low = {}
    for k in range(len(docs)):
        low[find(k)] = min(low.get(find(k), 1 << 63), ids[k])
    return sorted((docs[k][0] or -1, len(sets[k]), low[find(k)] if low[find(k)] < 1 << 62 else None) for k in range(len(docs)))


def rows_of(df):
    return sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in df.collect())


def test_jaccard_join(spark, corpus, docs, empty):
    got = rows_of(jaccard_join.join(corpus))
    assert got == brute_components(docs)
    assert jaccard_join.join(empty).count() == 0
    kept = {r.doc_id or -1 for r in jaccard_join.keep_one(corpus).collect()}
    assert kept == {i for i, _, c in got if i == -1 or i == c}


def test_jaccard_join_repeated_rows_and_ids(spark):
    rng = random.Random(31)
    base = [prose(rng, 80).split() for _ in range(4)]
    docs = []
    for k in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"w{k}"
        docs += [(k % 23, " ".join(words))] * rng.randint(1, 3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(jaccard_join.join(df)) == brute_components(docs)


@pytest.mark.parametrize("copies", [False, True])
def test_jaccard_join_with_a_dealt_filter(spark, corpus, docs, monkeypatch, copies):
    monkeypatch.setattr(jaccard_join, "HELD_BITS", 0)
    if copies:
        monkeypatch.setattr(twice, "QUESTIONS", 3000)
    assert rows_of(jaccard_join.join(corpus)) == brute_components(docs)
    assert jaccard_join.join(corpus.limit(0)).count() == 0


def test_dealt_and_held_filters_index_alike(spark, corpus):
    """The dealt filter lets the same keys through, and few that occur once."""
    docs = corpus.selectExpr("coalesce(doc_id, 0) doc_id", "xxhash64(text) text_hash", "text")
    held, dealt = (f(docs, 1 << 20)[2] for f in (jaccard_join._index_here, jaccard_join._index_dealt))
    rows = [{(r.rep, r.n, r.range, r.key) for r in x.collect()} for x in (held, dealt)]
    assert rows[0] == rows[1] and rows[0]


def test_keep_one_decides_by_row(spark):
    rng = random.Random(33)
    w, o, x = (prose(rng, 40) for _ in range(3))
    rows = [(1, w), (5, w), (5, o), (7, x), (7, x), (7, None), (7, None), (None, x + " end"), (None, "alone"), (None, "alone"), (8, ""), (8, "")]
    df = spark.createDataFrame([(*r, k, "n") for k, r in enumerate(rows)], "doc_id long, text string, n int, node string")
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id or 0, r.text or "") for r in kept.collect()), key=str)
    assert got == sorted([(1, w), (5, o), (7, x), (7, ""), (7, ""), (0, "alone"), (8, ""), (8, "")], key=str)
    assert jaccard_join.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_family(spark, seed):
    """A family of copies near the threshold, and a passage that all share."""
    rng = random.Random(seed)
    base, passage = prose(rng, 150).split(), prose(rng, 40)
    docs = []
    for k in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = rng.choice([f"own{k}", "common", "other"])
        docs.append((k, " ".join(words[: rng.choice([150, 150, 120, 130])])))
    docs += [(100 + k, passage + " " + prose(rng, rng.randint(1, 60))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(jaccard_join.join(df)) == brute_components(docs)


def test_linking_sets_share_more_than_the_spare_tokens():
    """At the threshold, over all ranges of size and their edges, with the common
    tokens the most frequent ones."""
    rng = np.random.default_rng(17)
    edges = [65, 86, 87, 258, 259, 344, 345, 1032, 1376, 1377]
    for n in [1, 2, 3, 4, 5, 20, *edges, *rng.integers(1, 1500, 40).tolist()]:
        for m in {n, (3 * n + 3) // 4, int(rng.integers((3 * n + 3) // 4, n + 1))}:
            both = -(-75 * (n + m) // 175)
            if both > m:
                continue
            pool = np.unique(rng.integers(1, 1 << 63, 2 * (n + m) + 50, dtype=np.uint64))
            rng.shuffle(pool)
            x, y = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : n + m - both]]))
            put = [{c: set(k.tolist()) for c, k in ((r, a), (r + 1, b)) if len(k)} for r, a, b in map(jaccard_join.forward, (x, y))]
            met = put[0].keys() & put[1].keys()
            assert met
            assert any(len(put[0][c] & put[1][c]) > (jaccard_join.spare(c) if c else 0) for c in met)


def test_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.comp for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_quality(spark, empty):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(300):
        good = rng.random() < 0.7
        text = prose(rng, 60) if good else " ".join([rng.choice(WORDS)] * 60) if rng.random() < 0.5 else " ".join(w + "$$$" for w in prose(rng, 40).split())
        rows.append((k, text))
        labels.append((k, int(good), 0))
    df = spark.createDataFrame([*rows, (900, ""), (901, None)], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.scores(df, lab).collect()}
    held = [(got[k].predicted, y) for k, y, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[900].score == got[901].score
    assert {r.score for r in quality.scores(df, lab.limit(0)).collect()} == {0.5}
    assert quality.scores(empty, lab).count() == 0


def test_trees_split_what_can_be_split():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < 0)).astype(float)
    model = quality.train(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def test_word_cache():
    made = []

    def make(words):
        made.extend(words)
        return [np.frombuffer(w, np.uint8).astype("<u4").tobytes() for w in words]

    c = WordCache(6, recent=2)
    for words in (["a", "bcd", "a"], ["a", "c"], ["", "bcd", "d"], ["c", "e", "f"], ["a", "bb", "e", "gg", "hh"], ["a", "c", "bcd", "bcd"]):
        words = [w.encode() for w in words if w]
        raw = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum([0, *map(len, words)])[:-1]
        ids, n = c.resolve(raw, first, make)
        assert ids.tolist() == raw.tolist() and n.tolist() == list(map(len, words))
        assert len(c.main.one) <= 6 and len(c.recent.one) <= 2
    assert made.count(b"a") <= 2 and made.count(b"bcd") <= 2
    assert (c._plain(raw, first, make)[0] == raw).all()


def test_pieces_drawn_anew_for_each_occurrence():
    pytest.importorskip("sentencepiece")
    enc, word = pieces.Encoder(SP), "informational"
    unit = enc.units([" " + word] * 400, np.arange(400))
    assert len(set(unit)) > 8  # over documents a word is not bound to a few ways
    text = " ".join([word] * 400)
    one, other = enc([text, text], [1, 2])
    cuts = {tuple(b) for b in "|".join(enc.model.bytes[i].decode() for i in one).split("| ")}
    assert len(cuts) > 8 and one.tolist() != other.tolist()
    alone = enc([text], [1])[0]
    assert alone.tolist() == one.tolist()  # whatever else is encoded with it
    again = "a  " + text
    assert pieces.decode(enc([again], [1])[0], enc.model.bytes) == again


def test_license_texts_and_runs(spark):
    import textwrap
    from pathlib import Path

    from skarn.llm import license_texts

    files = sorted((Path(license_texts.__file__).parent / "license_files").glob("*.txt"))
    notice = "\n".join(f"# {x}".rstrip() for p in license_texts._APACHE_NOTICE.split("\n\n") for x in [*textwrap.wrap(p, 70), ""])
    short = "Before it, prose.\n\nReleased under the MIT\nLicense.\n\nAfter it, prose."
    mit = next(t for i, t in license_texts.KNOWN if i == "MIT")
    rows = [*enumerate(f.read_text() for f in files), (100, "# Copyright 2020 A\n#\n" + notice + "\n\nimport os\n"), (101, short), (102, "Prose.\n\nMIT License\n\n" + mit + "\n\nProse."), (103, "Prose.\n\nReleased under the MIT License.\n\nProse.")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].whole_license for k in range(len(files))] == [f.stem for f in files] and len(files) == 10
    assert [(got[k].whole_license, got[k].n_notices, got[k].licenses) for k in (100, 101, 102, 103)] == [(None, 1, x) for x in ("Apache-2.0", "MIT", "MIT", "MIT")]


def test_short_near_copies_are_alike(spark):
    from pyspark.sql import functions as F

    rows = []
    for n in (8, 12, 16, 19, 24, 30, 36, 60):
        words = [f"w{n}x{k}" for k in range(n)]
        keep = n - n // 3
        rows.append((n, " ".join(words), " ".join([*words[:keep], *(f"new{n}x{k}" for k in range(n // 3))])))
    df = spark.createDataFrame(rows, "n long, a string, b string")
    df = winnow.with_fingerprint(winnow.with_fingerprint(df, "a", "fa"), "b", "fb")
    got = df.select("n", winnow.likeness(winnow.hashes(F.col("fa")), winnow.hashes(F.col("fb"))).alias("near"), F.size("fa").alias("kept")).collect()
    assert all(r.near > 0.2 for r in got)
    assert all(r.kept == r.n - winnow.K + 1 for r in got if r.n - winnow.K + 1 < winnow.SHORT)


def test_pages_with_optional_end_tags():
    text = lambda page: [b.text for b in html_text.blocks_of(page)]
    assert text("<html><head><title>T</title><style>p {}</style><body><p>All of it.</p>") == ["All of it."]
    assert text("<head><meta charset=x><title>T</title><p>No body tag.</p>") == ["No body tag."]
    assert text("<head><title>T</title></head><body><p>Closed.</p>") == ["Closed."]
    for tag in ("select", "button", "svg", "object", "iframe", "math", "canvas", "template"):
        assert text(f"<p>Before.</p><{tag}><p>The rest.</p>")[-1] == "The rest.", tag
    assert text("<button>A<p>Between.</p><button>B</button><p>After.</p>") == ["A", "Between.", "After."]
    for tag in ("script", "style", "textarea", "title"):
        assert text(f"<p>Before.</p><{tag}>x<p>y</p>") == ["Before."]


def test_long_class_lists_count_whole():
    page = '<div class="flex flex-col gap-4 px-6 py-8 bg-white shadow-md rounded-lg mt-10 border-t cookie-banner"><p>Some words.</p></div>'
    assert {"c:cookie", "c:banner", "c:flex", "c:border"} <= html_text.blocks_of(page)[0].around


def test_viterbi_and_likelihood_by_brute_force():
    import itertools

    def score(field, blocks, labels):
        total, before = field.start[labels[0]], None
        for k, (b, y) in enumerate(zip(blocks, labels)):
            total += sum(field.weights[field.index[f], y] for f in html_text.features(b, before) if f in field.index)
            total += field.trans[labels[k - 1], y] if k else 0
            before = b
        return total

    pages = [(html_text.blocks_of(p), labels) for p, labels in html_text.labelled_pages(60, seed=5)]
    short = [(b, [labels[x.text] for x in b]) for b, labels in pages if 1 <= len(b) <= 9]
    field = html_text.train(short, rounds=1500, rate=0.03)
    rng = np.random.default_rng(2)
    noisy = html_text.Field(field.index, rng.normal(0, 1, field.weights.shape), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2))
    for f in (field, noisy):
        for blocks, _ in short:
            best = max(itertools.product((0, 1), repeat=len(blocks)), key=lambda y: score(f, blocks, y))  # noqa: B023
            assert f.decode(blocks) == list(best)
    assert field.decode([]) == []

    def loss(f):
        out = 0.01 * ((f.weights**2).sum() + (f.trans**2).sum()) / len(short)
        for blocks, labels in short:
            every = [score(f, blocks, y) for y in itertools.product((0, 1), repeat=len(blocks))]
            out += (np.logaddexp.reduce(every) - score(f, blocks, labels)) / len(short)
        return out

    least = loss(field)
    for _ in range(6):  # no step from the maximum of the likelihood makes it larger
        step = [rng.normal(0, 0.05, p.shape) for p in (field.weights, field.trans, field.start)]
        assert loss(html_text.Field(field.index, field.weights + step[0], field.trans + step[1], field.start + step[2])) > least


def test_layouts_without_telling_names():
    field = html_text.default_field()
    right = total = 0
    for page, labels in html_text.labelled_pages(80, seed=91, unnamed=1.0):
        blocks = html_text.blocks_of(page)
        right += sum(labels[b.text] == y for b, y in zip(blocks, field.decode(blocks)))
        total += len(blocks)
    assert right / total > 0.85


def test_visible_text_stays_and_the_scanner_is_linear():
    import time

    field = html_text.default_field()
    assert html_text.main_text("Just plain text with no markup.", field) == "Just plain text with no markup."
    page = "<article><p>The formula <math><mi>E</mi>=<mi>m</mi></math> holds <svg><text>here</text></svg> in <object>all</object> cases <canvas>we saw</canvas>.</p></article>"
    assert html_text.main_text(page, field) == "The formula E=m holds here in all cases we saw."
    began = time.perf_counter()
    assert html_text.blocks_of("<a" * 300_000)[0].text == "<a" * 300_000
    html_text.blocks_of("<a" * 300_000 + ">")
    html_text.blocks_of("<p>words</p>" * 30_000 + "<div" * 30_000)
    assert time.perf_counter() - began < 10


def test_extract_odd_tables(spark):
    page = "<article><p>" + "Some words, said at length and with a point. " * 20_000 + "</p></article>"
    rows = [(1, "u", page, "t", 3), (1, "u", page, "t", 3), (None, None, None, None, None), (2, "", "", "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r.page_id or 0, r.n_chars, len(r.text)) for r in html_text.extract(df).collect())
    assert got == [(0, 0, 0), (1, 899_999, 899_999), (1, 899_999, 899_999), (2, 0, 0)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_convolution_by_brute_force():
    rng = np.random.default_rng(8)
    texts = ["some words " * 60, "é", "x" * 256, "ab", "the quick brown fox"]
    langs = ["de", "en", "fr"]
    cut = [lang_id.windows_of(t) for t in texts]
    net = lang_id.train(np.concatenate([w for w, _ in cut]), rng.integers(0, 3, sum(len(w) for w, _ in cut)), langs)
    conv = net.conv.reshape(lang_id.WIDEST, lang_id.EMBED, len(lang_id.WIDTHS), lang_id.FILTERS)
    for text, (windows, weight) in zip(texts, cut):
        assert b"".join(w.tobytes() for w in windows)[: len(text.encode())] == text.encode() and weight.sum() == len(text.encode())
        total = np.zeros(3)
        for window, own in zip(windows, weight):
            hidden = []
            for k, width in enumerate(lang_id.WIDTHS):
                for f in range(lang_id.FILTERS):
                    sums = [sum(net.embed[window[p + j]] @ conv[j, :, k, f] for j in range(width)) for p in range(lang_id.WINDOW - lang_id.WIDEST + 1)]
                    hidden.append(max(0.0, max(sums) + net.bias[k * lang_id.FILTERS + f]))
            z = np.array(hidden) @ net.dense + net.out
            total += own * (z - np.logaddexp.reduce(z))
        p = np.exp(total / weight.sum())
        p /= p.sum()
        (lang,), (score,) = net.predict([text])
        assert lang == langs[int(p.argmax())] and score == pytest.approx(p.max(), abs=1e-3)


def test_language_id_repeated_ids_and_long_texts(spark):
    rows = [(3, "the thing " * 30_000, "en"), (3, "the thing " * 30_000, "en"), (None, "der nicht " * 50, "de"), (6, "der nicht schön " * 50, "de")] * 3
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    net = lang_id.fit(df, max_windows=50)
    got = lang_id.predict(df, net).collect()
    assert len(got) == 12 and got[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"}
    assert net.langs == sorted({lang for i, _, lang in rows if i is not None and zlib.crc32(str(i).encode()) % 3 != 1})
    assert not any(r.held_out for r in got if r.doc_id is None)


def test_trees_by_brute_force():
    """The first split is the best of all, and the flat arrays score as walks down
    the trees do."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (80, 3)).astype(float)
    y = ((x[:, 1] > 6) ^ (rng.random(80) < 0.1)).astype(float)
    model = quality.train(x, y, trees=8, depth=3)
    p = y.mean()
    g, h = p - y, np.full(80, p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    best = max((gain(x[:, j] <= c) + gain(x[:, j] > c), j, c) for j in range(3) for c in set(x[:, j]) if min(h[x[:, j] <= c].sum(), h[x[:, j] > c].sum()) >= 2.0)
    j, c = model.feature[0][0], model.threshold[0][0]
    assert gain(x[:, j] <= c) + gain(x[:, j] > c) == pytest.approx(best[0])
    for row, score in zip(x, model.score(x)):
        total = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (1 if row[feature[node]] <= threshold[node] else 2)
            total += leaf[node - len(feature)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_odd_tables(spark):
    rows = [(7, "good words here " * 9), (7, "good words here " * 9), (None, "x"), (8, "%%% " * 200_000), (9, None)] * 2
    df = spark.createDataFrame([(*r, 1, 0.1, "c") for r in rows], "doc_id long, text string, quality int, score double, y string")
    lab = spark.createDataFrame([(7, 1, "a"), (7, 0, "b"), (8, 0, "c"), (8, 0, "c"), (None, 1, "d")], "doc_id long, quality int, text string")
    got = quality.scores(df, lab).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert len({(r.doc_id, r.score) for r in got}) == 4
    kept = quality.keep_good(df, lab)
    assert kept.columns == df.columns


def test_pieces_long_and_repeated(spark):
    text = "x" * 4000 + " " + "wordy " * 20_000
    df = spark.createDataFrame([(1, text, "p"), (1, text, "p"), (None, "", "q"), (2, None, None)], "doc_id long, text string, pieces string")
    got = pieces.round_trip(df, SP).collect()
    assert len(got) == 4 and all(r.lossless for r in got) and len({r.ids_crc32 for r in got if r.doc_id == 1}) == 1
    assert [r.n_pieces for r in got if r.doc_id != 1] == [0, 0]
    assert pieces.round_trip(df.limit(0), SP).count() == 0


def test_licenses_wrapped_at_any_width(spark):
    import textwrap

    from skarn.llm import license_texts

    texts = {"MIT": license_texts._MIT, "ISC": license_texts._ISC, "BSD-2-Clause": license_texts._BSD_HEAD + license_texts._BSD_TAIL, "Zlib": license_texts._ZLIB, "Unlicense": license_texts._UNLICENSE}
    texts |= {"BSD-3-Clause": license_texts._BSD_HEAD + license_texts._BSD_THIRD + license_texts._BSD_TAIL}
    rows, want = [], {}
    for name, text in texts.items():
        for width in range(60, 101):
            body = "\n\n".join(textwrap.fill(p, width, break_on_hyphens=False) for p in text.split("\n\n"))
            want[len(rows)] = name
            rows.append((len(rows), f"Copyright (c) 2024 A. Person\nAll rights reserved.\n\n{body}\n"))
    got = {r.doc_id: r.whole_license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_license_scan_odd_tables(spark):
    """Against a plain canonical form written anew."""
    from skarn.llm.license_texts import KNOWN

    def plain(text):
        lines = [x for x in text.lower().split("\n") if not re.match(r"\W*(copyright.*(\(c\)|©|[12]\d\d\d|\[yyyy\]|<year>)|copyright by |\(c\).*[12]\d\d\d|all rights reserved)|[^\w(]*©", x)]
        out = "\n".join(lines)
        for a, b in licenses.SPELLINGS:
            out = out.replace(a, b)
        return "".join(c if c.isalnum() else " " for c in out).split()

    known = {}
    for name, text in KNOWN:
        known.setdefault(tuple(plain(text)), name)
    rng = random.Random(3)
    short = [t for _, t in KNOWN if len(t) < 400]
    texts = ["\n".join(rng.choice([rng.choice(short).replace("\n", " "), prose(rng, 6), "", "  Copyright 2001 by X"]) for _ in range(rng.randint(0, 6))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(500, None), (501, ""), (502, "Released under the MIT License. " * 40_000), (None, "Released under the MIT License."), (503, texts[0]), (503, texts[0])]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "doc_id long, text string, license_id string, n_notices int")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, t in rows[:150]:
        lines = [known[tuple(plain(x))] for x in (t or "").split("\n") if tuple(plain(x)) in known]
        assert got[i].n_notices >= len(lines) and set(lines) <= set(got[i].licenses.split(","))
        assert got[i].whole_license == known.get(tuple(plain(t)))
    assert [(got[i].n_notices, got[i].licenses) for i in (500, 501, 502)] == [(0, "")] * 3
    assert got[None].whole_license == "MIT" and got[503].n_notices == 2 * got[0].n_notices
    assert licenses.scan(df.limit(0)).count() == 0
