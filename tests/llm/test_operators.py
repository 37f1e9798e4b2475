"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from tessera.llm import chat, decontaminate, lines, neighbours, pages, quality, simhash, suffixes, tokens
from tessera.llm.bpe import Bpe, Encoder, read_ranks

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20000))
BASE = "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf that lives in the deep dark wood"


def docs(spark, rows, extra=""):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOC)


def rows():
    return [(1, BASE), (2, BASE), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, "One two"), (None, BASE + " indeed"), (8, "é ß 株式 <|endoftext|> x"), (2, BASE)]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_fingerprint(t):
    w = words(t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_golay_keys_meet_all_within_radius():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    for x, y in zip(a, b, strict=True):
        left, right = simhash.keys(np.array([x]), False)[0], simhash.keys(np.array([y]), True)[0]
        assert set(left.tolist()) & set(right.tolist())


def test_simhash_components(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"t{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary, 60)) for _ in range(12)]
    data = rows() + [(100 + k, t.replace(t.split()[5], "new")) for k, t in enumerate(base)] + [(200 + k, t) for k, t in enumerate(base)]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, data)).collect()}
    prints = [(i, brute_fingerprint(t)) for i, t in data]
    group = list(range(len(prints)))
    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 3:
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    least = {g: min((i for (i, _), h in zip(prints, group, strict=True) if h == g and i is not None), default=None) for g in group}
    assert got == {(i, f"{f:016x}", least[g]) for (i, f), g in zip(prints, group, strict=True)}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_keep_one(spark):
    kept = simhash.keep_one(docs(spark, [(3, BASE), (1, BASE), (2, "other words entirely here and more of them"), (4, None), (5, "")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_components_of_a_long_chain(spark):
    from tessera.llm.common import Scratch

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges, Scratch(spark, "test")).collect()}
    assert {got.get(i, i) for i in range(61)} == {0} and got[101] == 100


def test_decontamination(spark):
    item = " ".join(f"item{i}" for i in range(30))
    near = item.replace("item29", "other")
    far = item.replace("item15", "other")
    data = [(1, f"before {item.upper()}, after"), (2, f"x y {near} z"), (3, far), (4, None), (5, ""), (6, BASE), (7, LONG + " " + item), (1, f"before {item.upper()}, after"), (None, item)]
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "only three words"), (14, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in decontaminate.leaks(docs(spark, data), items).collect()}
    assert {k for k in got if k[1] == 10} == {(1, 10), (2, 10), (7, 10), (None, 10)} and all(got[a, 14] == got[a, 10] for a, b in got if b == 10)
    assert got[1, 10] == 1 and got[2, 10] == round(25 / 27, 6)
    assert sorted(r.doc_id for r in decontaminate.clean(docs(spark, data), items).collect()) == [3, 4, 5, 6]
    assert decontaminate.leaks(docs(spark, []), items).count() == 0 and decontaminate.leaks(docs(spark, data), items.limit(0)).count() == 0


@pytest.fixture(scope="module")
def bpe(spark):
    return Bpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


ODD = ["  two  spaces \n lines \n\n", "don't can't I'LL", "a" * 700, "ab" * 400, "\x1c\x85\xa0 　x", "tail   ", "   ", " }", "日本語テキスト", "1234567 89 0", "=" * 600, "\r\n\t mixed \t"]


def test_bpe(spark, bpe):
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    data = rows() + [(50 + i, t) for i, t in enumerate(ODD)]
    df = bpe.encode(docs(spark, data).withColumnRenamed("lang", "ids"))
    out = df.withColumn("back", bpe.decode(df.ids)).collect()
    assert df.columns == ["doc_id", "text", "source", "n_chars", "ids"]
    for r in out:
        assert r.ids == known.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()
    assert bpe.encode(docs(spark, [])).count() == 0


def test_bpe_forgets():
    import tessera.llm.bpe as module

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    e, kept = Encoder(ranks, public_tokenizers.PATTERN), module.KEPT
    try:
        module.KEPT = 5
        for t in [*ODD, BASE]:
            ids, ends = e.encode([t])
            assert e.decode(ids, ends)[0].tobytes() == t.encode()
    finally:
        module.KEPT = kept


def test_token_counts(spark, bpe):
    data = rows() + [(60 + i, "x " * i) for i in range(40)]
    sizes = [len(r.ids) for r in bpe.encode(docs(spark, data)).collect()]
    limits = tokens.by_limit(tokens.histogram(docs(spark, data), bpe))
    for r in limits.collect():
        c = r.context_limit
        assert r.asDict() == {"context_limit": c, "n_docs": sizes.count(c), "docs_within": sum(s <= c for s in sizes), "tokens_within": sum(s for s in sizes if s <= c), "docs_from": sum(s >= c for s in sizes), "tokens_from": sum(s for s in sizes if s >= c), "tokens_kept": sum(min(s, c) for s in sizes)}
    ordered = sorted(sizes)
    assert {r.q: r.n_tokens for r in tokens.quantiles(limits, [0.5, 1.0]).collect()} == {0.5: ordered[-(-len(ordered) // 2) - 1], 1.0: ordered[-1]}
    assert tokens.totals_at(limits, 7).first().tokens_kept == sum(min(s, 7) for s in sizes)
    assert tokens.by_limit(tokens.histogram(docs(spark, []), bpe)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 16))
    x[100:140] = x[5]
    x[200:240] = x[7] + 0.01 * rng.standard_normal((40, 16))
    data = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] * 16), (None, [1.0] * 16), (404, [1.0, 2.0]), (405, [float("inf")] * 16), (0, x[0].astype(np.float32).tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, df.filter("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    y = x.astype(np.float32).astype(float)
    assert set(got) == {i for i in range(0, 300, 20)}
    found = []
    for q, hits in got.items():
        score = {i: float((y[i] * y[q]).sum()) for i in range(300) if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert [h[0] for h in hits] == list(range(1, 21)) and all(abs(score[h[1]] - h[2]) < 1e-12 for h in hits)
        found.append(len(set(best) & {h[1] for h in hits}) / 20)
    assert np.mean(found) >= 0.9
    assert [h[1] for h in got[100]] == [5, *range(101, 120)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_that_tie(spark):
    # 200 vectors of one product with the query; ids against the order of the rows
    rng = np.random.default_rng(9)
    rows = [(1000, [1.0] + [0.0] * 7)] + [(1 + (k * 77) % 200, [0.5, *rng.integers(-40, 40, 7).astype(float).tolist()]) for k in range(200)] + [(500 + k, [0.25, *rng.integers(-9, 9, 7).astype(float).tolist()]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.filter("vec_id = 1000"), 20).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(k, k, 0.5) for k in range(1, 21)]


def test_close_neighbours_end_the_ascent():
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((200, 64))
    x = np.repeat(centres, 40, axis=0) + 0.1 * rng.standard_normal((8000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    queries = x[::160]
    seen, found = [], []
    for q, (rows, n) in zip(queries, neighbours.Forest(x).search(queries, 20), strict=True):
        best = np.argsort(-(x @ q), kind="stable")[:20]
        seen.append(n / len(x))
        found.append(len(set(best.tolist()) & set(rows.tolist())) / 20)
    assert np.mean(seen) < 0.15 and np.mean(found) >= 0.9


def test_pages(spark):
    html = '<html><head><title>T</title><style>p{}</style><script>"</p>"</script></head><body><div class="cookie-notice">We use cookies</div><header><a href="/">Site</a></header><nav><ul><li><a>Home</a></li></ul></nav><article><h1>Caf&eacute; &amp;  title</h1><p>One <b>bold</b>\n text<p>Two<br>three<form><input>Your name</form><div class="ad">Buy</div></article><section class="comments"><p>Nice text, I liked to read all of it very much indeed</p></section><aside>More</aside><footer>&copy; us</footer></body></html>'
    df = spark.createDataFrame([(1, "u", html, "a"), (2, "u", None, "b"), (3, None, "", "c"), (4, "u", "<article><p>cut off <a hre", "d"), (5, "u", "<p class='x>never closed", "e"), (1, "u", html, "a")], "page_id long, url string, html string, main_text string")
    got = {r.page_id: r.main_text for r in pages.extract(df).collect()}
    assert got[1] == "Café & title One bold text Two three" and got[2] == got[3] == got[5] == "" and got[4] == "cut off"
    assert pages.extract(df.limit(0)).count() == 0


def test_chat(spark):
    odd = "~0 ~ <|end|> |> <s> </s>[INST] ok [/INST] <|start|>assistant<|text|>"
    said = [(1, 0, "user", "hi"), (1, 1, "assistant", odd), (1, 2, "assistant", "more"), (1, 3, "user", None), (2, 0, "assistant", ""), (3, 1, None, "é\n"), (3, 0, "system", odd), (3, 0, "system", odd), (None, None, "user", "x")]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df)
    for r in out.select("*", chat.turns_of(out.formatted).alias("turns"), chat.learnt_texts(out.formatted, out.loss_spans).alias("learnt")).collect():
        mine = sorted(((t if t is not None else -1, role or "", x or "") for c, t, role, x in said if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [(role, x) for _, role, x in mine]
        assert r.learnt == [x for _, role, x in mine if role == "assistant"]
        assert r.formatted.count("<|start|>") == sum(k == 0 or m[1] != mine[k - 1][1] for k, m in enumerate(mine))
    assert chat.format_chats(df.limit(0)).count() == 0


def test_suffixes(spark):
    rng = np.random.default_rng(2)
    text = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    shared, edge = text(450), text(199)
    data = [(1, text(300) + shared + text(100)), (2, shared + text(50)), (3, text(20) + shared[100:] + "é"), (4, edge + "1"), (5, edge + "2"), (6, "=" * 900), (7, None), (8, ""), (9, text(150)), (10, shared[:320]), (10, shared[:320]), (None, "é" * 150), (11, text(600) * 2), (12, "x" + edge + "1")]
    count = Counter(b[i : i + 200] for _, t in data for b in [(t or "").encode()] for i in range(len(b) - 199))
    want = []
    for i, t in data:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        want.append((str(i), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest(), int(gone.sum()), spans))
    got = suffixes.remove(docs(spark, data).withColumnRenamed("source", "kept")).collect()
    assert sorted((str(r.doc_id), hashlib.sha256(bytes(r.kept)).hexdigest(), sum(s.length for s in r.removed_spans), len(r.removed_spans)) for r in got) == sorted(want)
    assert suffixes.remove(docs(spark, [])).count() == 0


def test_suffix_parts(monkeypatch):
    monkeypatch.setattr(suffixes, "PART", 300)
    text = bytes(np.random.default_rng(4).integers(97, 123, 2000, dtype=np.uint8))
    starts = sorted(i + s for s, _, (_, first, last, *_) in suffixes._of_text(text) for a, b in zip(first, last, strict=True) for i in range(a, b + 1))
    assert starts == list(range(len(text) - suffixes.MIN_BYTES + 1))


def brute_lines(data, cut, min_words):
    """(id, text, spans) of each row, by comparing the units themselves."""
    cuts = lambda t: [u for u in re.split(f"(?<=\x01)", re.sub(f"({cut})", "\\1\x01", t)) if u not in ("", "\x01")]
    norm = lambda u: re.sub(r"[ \t\n\r\f]+", " ", u.replace("\x01", "").lower()).strip(" ")
    rank = lambda i, t: (i is None, i if i is not None else xxhash.xxh64_intdigest(t.encode(), 42) - (xxhash.xxh64_intdigest(t.encode(), 42) >> 63 << 64))
    first = {}
    for i, t in data:
        for u in cuts(t or ""):
            first[norm(u)] = min(first.get(norm(u), rank(i, t)), rank(i, t))
    out = []
    for i, t in data:
        seen, at, runs, run, size = set(), 0, [], [], 0
        for u in [*cuts(t or ""), None]:
            n = None if u is None else norm(u)
            if u is not None and (n == "" or n in seen or first[n] != rank(i, t)):
                run.append((at, at + len(u.replace("\x01", ""))))
                size += max(n.count(" ") + 1, -(-len(n) // lines.WORD_CHARS)) if n else 0
            else:
                if run and size >= min_words:
                    runs.append((run[0][0], run[-1][1] - run[0][0]))
                run, size = [], 0
            if u is not None:
                at += len(u.replace("\x01", ""))
                seen |= {n}
        gone = {k for a, n in runs for k in range(a, a + n)}
        out.append((i, None if t is None else "".join(c for k, c in enumerate(t) if k not in gone), runs))
    return sorted(out, key=str)


@pytest.mark.parametrize(("cut", "min_words"), [(lines.CLAUSE, 30), (lines.CLAUSE, 1), (lines.LINE, 1), (lines.LINE, 5), (lines.PARAGRAPH, 1)])
def test_lines(spark, cut, min_words):
    rng = np.random.default_rng(8)
    said = lambda n: " ".join(f"v{k}" + ("", "", "", ",", ".", "\n", " :", ".\n")[k % 8] for k in rng.integers(0, 5000, n))
    passage, common = said(70), "all rights reserved. see the license for what, if anything, it allows.\n"
    # the passage begins and ends inside lines, and once in other letters and white space
    data = [(9, f"{said(40)} of {passage} and {said(30)}"), (4, f"{said(10)} that {passage} so {said(50)}"), (7, f"{said(10)}\n{passage.upper().replace(', ', ',  ')}"), (1, common + said(20)), (2, said(20) + common), (3, common * 9)]
    data += [(5, None), (6, ""), (8, " \n\n "), (None, passage), (None, passage), (None, f"x {passage}"), (4, "another text of one id. " + passage), (9, data[0][1]), (10, "文" * 300 + "。" + "字" * 20 + "。"), (11, "前。" + "文" * 300 + "。後"), (12, f"{LONG}. {passage}")]
    df = docs(spark, data).withColumnRenamed("lang", "repeat_id").withColumnRenamed("source", "d").withColumnRenamed("n_chars", "removed_spans")
    out = lines.dedup(df, cut=cut, min_words=min_words)
    assert out.columns == ["doc_id", "text", "repeat_id", "d", "removed_spans"]
    got = sorted(((r.doc_id, r.text, [tuple(s) for s in r.removed_spans]) for r in out.collect()), key=str)
    assert got == brute_lines(data, cut, min_words)
    assert lines.dedup(docs(spark, []), cut=cut).count() == 0
    if cut == lines.CLAUSE and min_words == 30:
        lost = {i: sum(n for _, n in s) for i, _, s in got if i in (1, 2, 4, 9)}
        assert lost[1] == lost[2] == lost[4] == 0 and lost[9] > 0.7 * len(passage)
        assert next(t for i, t, _ in got if i == 11) == "前。後"


def test_quality(spark):
    good = [(i, f"{BASE} number {i} of it. " * 3) for i in range(60)]
    bad = [(100 + i, " | ".join(["BUY!!", "NOW!!", f"x{i}"] * 20)) for i in range(60)]
    df = docs(spark, good + bad + [(300, None), (301, ""), (302, LONG)])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:40]] + [(i, 0, 0) for i, _ in bad[:40]] + [(300, None, 0), (None, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    weights = quality.model(df, labels)
    got = {r.doc_id: r.s for r in df.select("doc_id", quality.scored(df, weights).alias("s")).collect()}
    assert min(got[i] for i, _ in good) > 0.6 > 0.3 > max(got[i] for i, _ in bad[40:]) and got[300] == got[301]
    assert (quality.model(df, labels.limit(0)) == 0).all() and all(0 <= s <= 1 for s in got.values())
