"""Each operator against a plain computation on small rows: nulls, empty and long texts, ties, repeats, odd columns."""

from __future__ import annotations

import collections
import hashlib
import json
import math
import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from plancarta.llm import chat, components, embeddings, html, langid, lines, mixing, packing, quality, simhash, substring

RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(1, 6))) for _ in range(60)]


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS) for _ in range(n))


SHARED = prose(40)
TEXTS = [
    (1, prose(30)),
    (2, f"{prose(10)} {SHARED} {prose(5)}"),
    (3, f"{SHARED}\n{prose(30)}"),
    (4, None),
    (5, ""),
    (6, " \t\n\x0b\x0c\r "),
    (7, SHARED),
    (7, SHARED),
    (8, f"{SHARED} {SHARED}"),
    (9, "É ü ß x y \x1cz"),
    (10, prose(3000)),
    (None, SHARED),
    (11, "\n".join([SHARED, prose(12), prose(12), "a b", "a b"])),
    (12, SHARED.upper()),
]
SPACE = " \t\n\x0b\x0c\r"


def words(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACE:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] * bool(word)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 4}" if i != 5 else None, -1, "x") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, seed long, key string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_substring_dedup(docs, none):
    first = {}
    for i, t in sorted((x for x in TEXTS if x[0] is not None), key=lambda x: x[0]):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = []
    for i, t in TEXTS:
        w = words(t)
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone |= {*range(k, k + 13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = [tuple(r) for r in substring.substring_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[2] for x in want) > 100
    assert substring.substring_dedup(none).count() == 0


@pytest.mark.parametrize(("size", "first"), [(13, 2), (24, 3), (5, 7), (1, 1)])
def test_substring_levels(spark, size, first):
    assert (substring.levels(13), substring.levels(50), substring.levels(24, 3), substring.levels(1, 1)) == ([7, 13], [7, 14, 28, 50], [3, 6, 12, 24], [1])
    base = [RNG.choice(WORDS) for _ in range(60)]
    rows = []
    for i in range(25):
        a = RNG.randrange(40)
        rows.append((i, " ".join([prose(RNG.randint(0, 12)), *base[a : a + RNG.randint(3, 60)], prose(5)])))
    starts = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            starts.setdefault(tuple(w[k : k + size]), i)
    want = {}
    for i, t in rows:
        w = words(t)
        want[i] = len({j for k in range(len(w) - size + 1) if starts[tuple(w[k : k + size])] < i for j in range(k, k + size)})
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.n_removed for r in substring.substring_dedup(df, size, False, first).collect()} == want


def test_language_id_against_plain_sums(spark):
    chars = {"one": "abcdefg", "two": "efghijk", "three": "acegik"}
    rows = []
    for i in range(90):
        lang = RNG.choice([*chars])
        rows.append((i, " ".join("".join(RNG.choice(chars[lang]) for _ in range(RNG.randint(1, 6))).title() + RNG.choice(["", ",", "1x"]) for _ in range(12)), lang))
    rows += [(i, prose(8), None) for i in range(90, 100)] + [(100, prose(30_000), None)]
    learned = [(t, lang) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 3 != 1]
    counts = collections.defaultdict(collections.Counter)
    for t, lang in learned:
        counts[lang].update(w for token in t.split() for w in langid.words_of(token))
    langs = sorted(counts)
    tables = []
    for n in range(6):
        table = {x: collections.Counter() for x in langs}
        for x in langs:
            for w, c in counts[x].items():
                for g in langid.ngrams(w, n) if n else [w]:
                    table[x][g] += c
        tables.append(({g for x in langs for g in table[x]}, table))
    known = {x: sum(lang == x for _, lang in learned) for x in langs}

    def log(n, g, x):
        seen, table = tables[n]
        return math.log((table[x][g] + 0.1) / (sum(table[x].values()) + 0.1 * (len(seen) + 1)))

    def sums(text):
        out = {x: math.log(known[x] / len(learned)) for x in langs}
        for token in text.split():
            for w in langid.words_of(token):
                for n in [0, 5, 4, 3, 2, 1]:
                    found = [g for g in (langid.ngrams(w, n) if n else [w]) if g in tables[n][0]]
                    if found:
                        for x in langs:
                            out[x] += sum(log(n, g, x) for g in found) / len(found)
                        break
        return out

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("held_out", "n", "word", "score", "lang_pred"):
        df = df.withColumn(name, F.lit("x"))
    by = {r.doc_id: r for r in langid.language_id(df).collect()}
    for i, t, _ in rows:
        s = sums(t)
        best = max(langs, key=lambda x: s[x])
        assert by[i].lang_pred == best and math.isclose(by[i].score, 1 / sum(math.exp(s[x] - s[best]) for x in langs), rel_tol=1e-6, abs_tol=1e-9), i


def test_language_id(spark, none):
    def text(chars, n):
        return " ".join("".join(RNG.choice(chars) for _ in range(RNG.randint(2, 5))) for _ in range(n))

    rows = [(i, text("abcde" if i % 2 else "vwxyz", 20), "one" if i % 2 else "two") for i in range(200)]
    rows += [(900, None, "one"), (901, "12 34 %%", "one"), (902, "", None), (None, text("abcde", 9), "one")]
    out = langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i, t, lang in rows[:200]:
        assert by[i].lang_pred == lang and 0.5 < by[i].score <= 1
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert [by[i].lang_pred for i in (900, 901, 902, None)] == ["und"] * 3 + ["one"]
    assert by[None].held_out is False
    assert langid.language_id(none).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.language_id(unlabelled).first().lang_pred == "und"


def test_language_backoff():
    model = langid.Model(["a", "b"], [0.0, 0.0], [("a", "hello", 5), ("b", "world", 5)])
    whole, part = model.rows("hello"), model.rows("hellish")
    assert whole == [model.at[0]["hello"]]
    assert {*part} <= {*model.at[5].values()} and model.rows("qqq") == []
    assert langid.Scorer(model).texts([b"hellish", b"worldly"]) [0][0] == "a"


def gone_lines(texts, t=0.8):
    seen, out = [], collections.defaultdict(set)
    for i, text in sorted((x for x in texts if x[0] is not None), key=lambda x: x[0]):
        for j, line in enumerate((text or "").split("\n")):
            w = frozenset(words(line))
            if w:
                if any((a, b) < (i, j) and len(w & x) >= t * len(w | x) - 1e-9 for a, b, x in seen):
                    out[i].add(j)
                seen.append((i, j, w))
    return out


def test_line_dedup(spark, docs, none):
    base = [[RNG.choice(WORDS) for _ in range(RNG.randint(4, 30))] for _ in range(12)]
    more = []
    for i in range(60):
        text = []
        for _ in range(RNG.randint(1, 5)):
            line = list(RNG.choice(base))
            for _ in range(RNG.choice([0, 0, 1, 2, 3])):
                line[RNG.randrange(len(line))] = RNG.choice(WORDS) + "q"
            text.append(" ".join(line))
        more.append((100 + i, "\n".join(text)))
    for rows in (TEXTS, more, [*TEXTS, *more]):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        want = gone_lines(rows)
        got = {r.doc_id: {*r.gone} for r in lines.repeated_lines(df).collect()}
        assert got == want
    out = lines.line_dedup(docs).collect()
    assert len(out) == len(TEXTS)
    assert all(r.text.count("\n") <= r.n_lines - r.n_removed for r in out if r.text)
    assert lines.line_dedup(none).count() == 0


def test_line_dedup_in_any_order_of_rows(spark):
    line = [f"w{i}" for i in range(20)]
    a, b = " ".join(line), " ".join([*line[:-1], "other"])
    for rows in ([(10, a), (5, a), (7, b)], [(10, a), (5, a), (3, b)], [(k, RNG.choice([a, b]) + f"\n{prose(9)}") for k in range(40, 0, -1)]):
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        assert {r.doc_id: {*r.gone} for r in lines.repeated_lines(df).collect()} == gone_lines(rows)


def test_line_dedup_of_short_lines(spark):
    rows = [(1, "All rights reserved.\n\none"), (2, "x\nreserved. All rights\none"), (3, "a b c d"), (4, "a b c d e"), (5, "c b a"), (6, "a b c"), (7, "la la la la la la"), (8, "la\n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: {*r.gone} for r in lines.repeated_lines(df).collect()} == {2: {1, 2}, 4: {0}, 6: {0}, 8: {0}}


def test_line_dedup_beyond_named_partners(spark, monkeypatch):
    monkeypatch.setattr(lines, "NAMED", 2)
    monkeypatch.setattr(lines, "TRIES", 1)
    monkeypatch.setattr(lines, "LEADERS", 3)
    monkeypatch.setattr(lines, "HELD", 20)
    monkeypatch.setattr(lines, "BLOCK", 50)
    base = [[RNG.choice(WORDS) for _ in range(RNG.randint(8, 14))] for _ in range(3)]
    rows = []
    for i in range(120):
        line = list(RNG.choice(base))
        for _ in range(RNG.choice([1, 1, 2, 3])):
            line[RNG.randrange(len(line))] = RNG.choice(WORDS)
        rows.append((i, " ".join(line)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: {*r.gone} for r in lines.repeated_lines(df).collect()} == gone_lines(rows)


def test_line_dedup_with_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "a b c d\nx", 5, "u"), (1, "a b c d\nx", 5, "u"), (2, "x\ny", None, "v"), (2, "z", 1, "w"), (None, "x", 2, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines long, _gone string")
    for name in ("gone", "row", "id", "kept", "there", "lines", "n_removed", "block"):
        df = df.withColumn(name, df["_gone"])
    out = lines.without(df, lines.repeated_lines(df))
    assert out.columns == df.columns
    # rows that share an id are one document: where a line goes, it goes in each of them
    assert sorted(r.text for r in out.collect()) == ["", "a b c d\nx", "a b c d\nx", "x", "y"]


def test_words_of_bytes():
    from plancarta.llm import common

    texts = ["", None, " a\n", "a", "longer-than-eight b", "\tx\x0by\x0cz\r", "\n\n", "é😀 a\u2003b", "w" * 100, "w" * 100 + " "]
    seen = {}
    for most in (1, 20, 1000):
        got = [[] for _ in texts]
        for row, data, ends in common.texts_of(pa.array(texts), most):
            begin, end = common.word_places(data, ends)
            for b, e, h in zip(begin, end, common.places_hashes(data, begin, end), strict=True):
                w = bytes(data[b:e])
                assert seen.setdefault(w, h) == h
                got[row + np.searchsorted(ends, b, "right") - 1].append(w)
        assert got == [(t or "").encode().split() for t in texts]
    assert len({*seen.values()}) == len(seen)


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "\\e\\b\\l", "<s>", "[ROLE] x [/ROLE]", "", None, "a\n\nb", "\x00 é😀", "< /s>", "[/INST", "[INST] "]
    rows = [(c, t, role, odd[(c * 5 + t) % len(odd)]) for c in range(12) for t, role in enumerate(["user", "assistant", "system", "us\\er<s>", None, "assistant"])]
    rows += [(50, 1, "user", "same"), (50, 1, "user", "same"), (None, 0, "user", "x"), (51, None, "assistant", "first"), (51, 0, "user", "next")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.chat_format(chat.conversations_as_records(df))
    got = {r.conv_id: r for r in chat.digest(done).collect()}
    by = collections.defaultdict(list)
    for c, t, role, x in rows:
        by[c].append((t is not None, t or 0, role or "", x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        want = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[c][1:5]) == want
    assert chat.digest(chat.chat_format(chat.conversations_as_records(df.where("false")))).count() == 0


def test_chat_layouts(spark):
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant", "n": 1}]}, "q", "a"),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": "z"}, "q", "a"),
        ({"prompt": "q", "response": "a"}, "q", "a"),
        ({"prompt": "q", "completion": "a", "meta": {"prompt": {"x": 1}}}, "q", "a"),
        ({"instruction": "q", "input": "i", "output": "a"}, "q\n\ni", "a"),
        ({"instruction": "q", "input": "", "output": "a"}, "q", "a"),
        ({"question": "q", "answer": "a"}, "q", "a"),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)] + [(90, None), (91, "{"), (92, '{"odd": 1}'), (93, '{"messages": []}'), (94, '{"messages": [{"role": "user", "content": "q"}, 5]}'), (95, '{"messages": null}'), (96, '{"messages": 5}'), (97, '{"messages": [{"role": "user", "content": "q"}, null]}')], "id long, payload string")
    got = {r.id: r for r in chat.chat_format(df).collect()}
    for i, (_, q, a) in enumerate(records):
        assert [(t.role, t.text) for t in got[i].turns] == [("user", q), ("assistant", a)]
        s = got[i].loss_spans[0]
        assert got[i].formatted[s.start : s.end] == a
    assert [got[i].turns for i in (90, 91, 92, 94, 96, 97)] == [None] * 6 and got[93].formatted == got[95].formatted == ""
    assert got[4].fingerprint == got[5].fingerprint != got[0].fingerprint


PAGES = [
    ("<article><h1>T &amp; t</h1><p>one<br>two<p>three &copy 4</article><footer>no</footer>", "T & t\n\none two\n\nthree © 4"),
    ("<body><nav>menu</nav><main><div class='ad'>x</div><p>body <b>bo</b>ld</p><ul><li>i<li>j</ul></main></body>", "body bold\n\ni\n\nj"),
    ("<article><p>a</p><script>var t='</p>';</script><style>p{}</style><!-- c --><section class='comments'><p>no</p></section><form><p>no</p></form><p>b</article>", "a\n\nb"),
    ("<body class='has-sidebar'><header>no</header><p>only\n\n text</p><div role=navigation>no</div></body>", "only text"),
    ("<article><header><h1>Head</h1></header><aside>no</aside><p>x &lt;b&gt; &#233; &#x41;</p></article>", "Head\n\nx <b> é A"),
    ("plain text", "plain text"),
    ("<article class='post related-posts-enabled'><p>hi</p></article>", "hi"),
    ("<article><p>costs <span class='share-price'>5</span> now</p><div class='share-buttons'>no</div><div class='menu-card-prices'>dish</div></article>", "costs 5 now\n\ndish"),
    ("<main><h1>Title</h1><article><p>text of it</p></article><nav>no</nav></main>", "Title\n\ntext of it"),
    ("<nav>no</nav><main role=main><p>a</p></main><article hidden>no</article>", "a"),
    (None, ""),
    ("", ""),
    ("<p>un<closed <p title='>'>z", "unz"),  # as HTML reads it: one tag, with attributes <p and title
]


def test_html(spark):
    df = spark.createDataFrame([(i, f"http://h{i}/x", h, "x") for i, (h, _) in enumerate(PAGES)] + [(1, "http://h1/x", PAGES[1][0], "y"), (None, None, PAGES[0][0], "z")], "page_id long, url string, html string, text string")
    got = collections.defaultdict(list)
    for r in html.extract(df).collect():
        got[r.page_id].append((r.text, r.n_chars))
    for i, (_, want) in enumerate(PAGES):
        assert got[i] == [(want, len(want))] * (2 if i == 1 else 1), i
    assert len(got[None]) == 1
    assert html.extract(df.where("false")).count() == 0


def test_html_host_boilerplate(spark):
    notice = "this notice stands on every page of the host and says nothing new at all"
    pages = [(i, f"http://{'a' if i < 6 else 'b'}/p{i}", f"<div>lead{i} {notice} tail{i}</div><p>own words {i} {' '.join(f'w{i}x{k}' for k in range(12))}</p><div>Home of the host, one two three four</div>") for i in range(7)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for shard in (10, html.SHARD):
        got = {r.page_id: r.text for r in html.extract(df, shard=shard).collect()}
        for i in range(6):
            assert got[i] == f"lead{i} tail{i}\n\nown words {i} " + " ".join(f"w{i}x{k}" for k in range(12))
        assert notice in got[6]


def test_html_host_boilerplate_in_articles(spark):
    notice = "write to us and get every new text of this house by post"
    own = lambda i: f"own{i} " + " ".join(f"w{i}x{k}" for k in range(30))
    shared = "a passage of some ten words that two plain paragraphs share here"
    pages = [(i, "http://a/p", f"<body><article><h1>H</h1><div class='x9-foo'><p>{notice}</p></div><p>{own(i)}</p><p>{shared}</p><div class='x9-foo'><p>alone {i} here</p></div></article><footer>f</footer></body>") for i in range(4)]
    pages.append((9, "http://other/p", pages[0][2]))
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert got[i] == f"H\n\n{own(i)}\n\n{shared}\n\nalone {i} here"
    assert notice in got[9]


def test_html_of_deep_pages():
    import time

    page = "<article>" + "<i>" * 20_000 + "x" + "</b>" * 20_000 + "".join(f"<div><p>{k}" for k in range(3000)) + "<li>" * 3000
    began = time.time()
    found = html.blocks(page)
    assert [x for _, _, x in found][:2] == ["x", "0"] and len(found) == 3001 and time.time() - began < 10


def test_html_shared_short_blocks_stay(spark):
    pages = [(i, "http://a/p", f"<h2>Introduction</h2><p>own{i} {' '.join(f'w{i}x{k}' for k in range(12))}</p><div>{'the same long notice on every page of it'}</div>") for i in range(3)]
    got = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Introduction\n\nown{i} " + " ".join(f"w{i}x{k}" for k in range(12)) for i in range(3)}


def test_suffix_array_cover():
    for _ in range(30):
        n, size = RNG.randint(1, 60), RNG.randint(2, 7)
        tokens, page = np.array([RNG.randint(0, 2) for _ in range(n)]), np.sort(np.array([RNG.randint(0, 3) for _ in range(n)]))
        cut = np.flatnonzero(np.diff(page)) + 1
        tokens = np.insert(tokens, cut, 100 + np.arange(len(cut)))
        page = np.insert(page, cut, -1)
        want = np.zeros(len(tokens), bool)
        for i in range(len(tokens) - size + 1):
            for j in range(len(tokens) - size + 1):
                if page[i] != page[j] and page[i] >= 0 and (page[i : i + size] == page[i]).all() and (tokens[i : i + size] == tokens[j : j + size]).all():
                    want[i : i + size] = True
        assert (html.repeated(tokens, page, size) == want).all()


def targets(sizes, share=1.5, most=2):
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    out, live = {}, {*sizes}
    while live:
        level = (share * sum(sizes.values()) - sum(out.values())) / sum(weight[s] for s in live)
        full = {s for s in live if level * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in live}
        out |= {s: most * sizes[s] for s in full}
        live -= full
    return out


def test_mixing(spark, docs, none):
    rng = random.Random(11)  # whole copies of a text that is most of its source can't come near every target
    rows = [(i, f"s{i % 7}" if i % 7 else None, " ".join(["w"] * min(20_000, int(rng.paretovariate(0.8) * 20))) if i % 9 else None) for i in range(900)]
    df = spark.createDataFrame([(i, s, t) for i, s, t in rows] + [(0, None, "a b c")] * 2, "doc_id long, source string, text string").repartition(3)
    got = mixing.mix(mixing.sizes(df)).collect()
    assert len(got) == 902
    total, taken = collections.Counter(), collections.Counter()
    for r in got:
        total[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies
    want = targets(total)
    for r in got:
        assert r.source_size == total[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * t + 25
    again = mixing.mix(mixing.sizes(df.repartition(5))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(mixing.sizes(docs)).count() == len(TEXTS)
    assert mixing.mix(mixing.sizes(none)).count() == 0
    copies = collections.Counter(r.doc_id for r in mixing.mixed_documents(df).collect())
    assert copies == +collections.Counter({i: sum(r.copies for r in got if r.doc_id == i) for i in {r.doc_id for r in got}})


def grouped(ids, linked):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in ids}


def test_embeddings(spark):
    base = np.random.default_rng(3).normal(size=(40, 12))
    vectors = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base[:20] + 0.05, base[:20] * 3, base[:5], base[:20] + np.random.default_rng(4).normal(size=(20, 12)) * 0.35]))]
    odd = [(500, None), (501, []), (502, [0.0] * 12), (503, [float("nan")] + [1.0] * 11), (504, [float("inf")] + [1.0] * 11), (505, [None] + [1.0] * 11), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (None, base[0].tolist())]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors + odd], "vec_id long, embedding array<double>, label int, rep string").repartition(4)
    u = embeddings.unit(np.array([v for _, v in vectors]))
    linked = [(a, b) for a in range(len(u)) for b in range(a) if u[a] @ u[b] >= 0.9] + [(506, 507)]
    group = grouped([i for i, _ in vectors] + [506, 507], linked)
    n = collections.Counter(i for pair in linked for i in pair)
    for block in (7, embeddings.BLOCK):
        got = {r.vec_id: r for r in embeddings.embedding_groups(df, block=block).collect()}
        assert len(got) == len(vectors) + len(odd)
        for i in [*range(len(vectors)), 506, 507]:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (n[i], group[i], group[i] == i), i
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(500, 506))
    assert embeddings.embedding_groups(df.where("false")).count() == 0


def test_quality_counts(docs, none):
    got = collections.defaultdict(list)
    for r in quality.quality_rules(docs).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(TEXTS)
    for i, t in TEXTS:
        w, r = words(t), got[i][0]
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeat = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        full = [x for x in (t or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(full) - len({*full}), len(repeat))
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(w) < 10 or 100 * len(repeat) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.quality_rules(none).count() == 0


def model_of(df, order):
    return quality.held_model(quality.train(df, order).mapInArrow(quality._hashed, quality._ENTRY_SQL), order)


def unknown(model):
    at, hit = model.find(model.hashes("x", np.zeros((1, 0), np.uint32)))
    return float(model.logs[at[0]]) if hit[0] else quality.UNKNOWN


def test_quality_model_sums_to_one(spark):
    texts = [" ".join("".join(RNG.choice("aabc") for _ in range(RNG.randint(1, 5))) for _ in range(80)) for _ in range(6)]
    df = spark.createDataFrame([(t, "x") for t in texts], "text string, lang string")
    for order in (1, 2, 3, 5):
        model = model_of(df, order)
        for context in ("", "a", "ab", "cab"):
            # the chance of each next sign after a context is the ratio of two beginnings
            p = [math.exp(model.words("x", [f"{context}{c}".encode()])[0] - end(model, f"{context}{c}")) / math.exp(start(model, context)) for c in "abc"]
            p.append(math.exp(end(model, context)))
            unseen = math.exp(unknown(model)) if order == 1 else 0
            assert 0.97 < sum(p) + unseen <= 1 + 1e-6


def end(model, word):
    """Log chance that a word ends where it ends."""
    codes = quality.START + word
    return tail(model, codes + quality.END)


def start(model, word):
    return sum(tail(model, (quality.START + word)[: k + 1]) for k in range(1, len(word) + 1))


def tail(model, signs):
    """Log chance of the last sign after the others, by plain recursion over the stored n-grams."""
    if len(signs) > model.order:
        signs = signs[-model.order :]
    codes = np.array([[ord(c) for c in signs]], np.uint32)
    at, hit = model.find(model.hashes("x", codes))
    if hit[0]:
        return float(model.logs[at[0]])
    if len(signs) == 1:
        return unknown(model)
    at, hit = model.find(model.hashes("x", codes[:, :-1]))
    return (float(model.weights[at[0]]) if hit[0] else 0.0) + tail(model, signs[1:])


def test_quality_word_scores(spark):
    texts = [prose(50) for _ in range(4)]
    model = model_of(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string"), 3)
    for word in [*WORDS[:20], "zzz", "a", "éa"]:
        signs = quality.START + word + quality.END
        want = sum(tail(model, signs[: k + 1]) for k in range(1, len(signs)))
        assert math.isclose(model.words("x", [word.encode()])[0], want, rel_tol=1e-4, abs_tol=1e-4)


def test_quality_bands_and_verdicts(spark):
    rows = [(i, prose(RNG.randint(12, 60)), RNG.choice(["x", "y", None])) for i in range(60)]
    rows += [(100 + i, " ".join(w[::-1] + "##" * (i % 4) for w in prose(20).split()), "x") for i in range(12)] + [(200, "", "x"), (201, None, "x"), (202, "short one", "y"), (203, "q " * 30, "x"), (203, "q " * 30, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = quality.judge(df, [], 3, 2.0, 0.05)
    got = sorted(tuple(r) for r in found.select("doc_id", "kept", F.round("perplexity", 4), "base_failed").collect())
    joined = quality.judge(df, [], 3, 2.0, 0.05, held=0)
    assert sorted(tuple(r) for r in joined.select("doc_id", "kept", F.round("perplexity", 4), "base_failed").collect()) == got
    hashed = quality.train(df, 3).mapInArrow(quality._hashed, quality._ENTRY_SQL)
    model = quality.held_model(hashed, 3)
    means = []
    for i, text, lang in rows:
        w = words(text)
        n = sum(sum(unicodedata.category(c)[0] in "LM" for c in x) + 1 for x in w)
        means.append(round(sum(model.words(lang or "", [x.encode() for x in w])) / n, 6) if n else None)

    def middle(values):
        return sorted(values)[(len(values) - 1) // 2]

    want = []
    for (i, text, lang), m in zip(rows, means, strict=True):
        bins = [int(math.floor(abs(x) * 1000 + 0.5)) * (1 if x > 0 else -1) for x, r in zip(means, rows, strict=True) if x is not None and r[2] == lang]
        ok = False
        if m is not None:
            mid = middle(bins)
            side = max(2.0 * middle([abs(b - mid) for b in bins]), 50) / 1000
            ok = mid / 1000 - side <= m <= mid / 1000 + side
        w = words(text)
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeat = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
        want.append((i, ok and not failed, None if m is None else round(math.exp(-m), 4), failed))
    assert [(a, b, d) for a, b, _, d in got] == sorted((a, b, d) for a, b, _, d in want)
    assert all(x[2] is None if y[2] is None else math.isclose(x[2], y[2], rel_tol=1e-3) for x, y in zip(got, sorted(want, key=str), strict=False) if x[0] == y[0])
    assert {b for _, b, _, _ in got} == {True, False}


def test_quality_bands_reject(spark):
    rows = [(i, prose(60), "en") for i in range(80)] + [(900, " ".join(w + "###%%%" for w in prose(60).split()), "en"), (901, " ".join("%$#" for _ in range(40)) + " " + prose(8), "en")]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(kept[i] for i in range(80)) >= 70 and not kept[900] and not kept[901]


def test_packing_ids_of_odd_letters(spark):
    from tokenizers import Tokenizer

    tokenizer, ids = Tokenizer.from_file(packing.TOKENIZER), packing.Ids(packing.TOKENIZER)
    rng = random.Random(5)
    signs = ["\u0130", "\u03a3", "\u03c2", "a", "I", "'s", "'", ",", "=", "\u0338", "\u0301", "\u00df", "1", "\u0661", "\u200d", "\U0001f600", "\u01c5", "\ufb01", "\u1e9e", ".", "\u2126", "x"]
    for text in ["\u0130,", "a\u0130.. \u0130\u0130!", *("".join(rng.choice([*signs, " "]) for _ in range(rng.randint(1, 12))) for _ in range(4000))]:
        assert np.frombuffer(ids(text.encode(), b""), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packing_spreads_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a")] * 300, "doc_id long, text string")
    rows = packing.pack(df, size=16, shard=20).collect()
    assert len(rows) == 300 and len({r.sequence_id >> 32 for r in rows}) > 5


def test_stages_bear_clashing_columns(spark):
    rows = [(i, prose(30), "s", "en") for i in range(8)] + [(None, prose(30), None, None), (1, prose(30), "s", "en"), (1, prose(30), "s", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for name in ("_id", "_c", "_m", "id", "c", "m", "row", "_gone", "gone", "c0", "n_words", "kept", "fp", "component_id"):
        df = df.withColumn(name, F.lit(1))
    for out in (mixing.mixed_documents(df), simhash.one_of_each(df, 5, 3, 0.8), quality.kept_documents(df)):
        assert out.columns == df.columns
        out.collect()
    mixed = mixing.mix(mixing.sizes(df)).agg(F.sum("copies")).first()[0]
    assert mixing.mixed_documents(df).count() == mixed


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    for size in (16, packing.SIZE):
        got = collections.defaultdict(list)
        rows = packing.pack(docs, size=size).collect()
        for r in rows:
            got[r.doc_id].append(r)
        for i, t in TEXTS:
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END]
            times = 2 if i == 7 else 1
            pieces = sorted(got[i], key=lambda r: r.start)
            assert [r.start for r in pieces] == [s for s in range(0, len(ids), size) for _ in range(times)]
            for r in pieces:
                assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
            assert sum(r.length for r in pieces) == times * len(ids)
        windows = collections.defaultdict(list)
        for r in rows:
            windows[r.sequence_id].append((r.offset, r.length))
        for w in windows.values():
            w.sort()
            assert [o for o, _ in w] == [sum(n for _, n in w[:k]) for k in range(len(w))] and sum(n for _, n in w) <= size
    assert packing.pack(none).count() == 0


def test_packing_ids_of_odd_texts():
    from tokenizers import Tokenizer

    tokenizer, ids = Tokenizer.from_file(packing.TOKENIZER), packing.Ids(packing.TOKENIZER)
    for t in ["don't WE'LL 's.", "<|endoftext|> a<|startoftext|>", "ΑΣ ΑΣ. İx ǅ ß.", "a\x1cb\x85c d　e", "é ́x", "12.5 1,000 x###%%% ...", "\x00﻿", "日本語。テスト", "Ça, ÉTÉ; foo--bar", "x" * 3000, "'", "a' b'. '.", "²³ ½a."]:
        want = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert ids(t.encode(), np.array([2], "<u4").tobytes()) == want, t


def test_sum_of_squares_rule():
    for _ in range(20):
        size = RNG.randint(5, 12)
        items = [RNG.randint(1, size) for _ in range(80)]
        count = collections.Counter()
        for n, (window, offset) in zip(items, zip(*packing.place(items, size), strict=True), strict=True):
            def cost(h, n=n):
                c = count.copy()
                c[h] -= h > 0
                c[h + n] += h + n < size
                return sum(v * v for v in c.values())

            best = min(cost(h) for h in range(size - n + 1) if h == 0 or count[h] > 0)
            assert cost(offset) == best and (offset == 0 or count[offset] > 0)
            count[offset] -= offset > 0
            count[offset + n] += offset + n < size


def plain_fingerprint(text, n):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + n]), seed=42) for k in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize(("n", "radius"), [(3, 2), (5, 3)])
def test_simhash(docs, none, n, radius):
    got = simhash.simhash_groups(docs, n, radius).collect()
    prints = [(i, plain_fingerprint(t, n)) for i, t in TEXTS]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{f:016x}") for i, f in prints)
    group = grouped({f for _, f in prints}, [(a, b) for _, a in prints for _, b in prints if (a ^ b).bit_count() <= radius])
    low = collections.defaultdict(list)
    for i, f in prints:
        if i is not None:
            low[group[f]].append(i)
    for r in got:
        assert r.component_id == min(low[group[int(r.fingerprint, 16)]])
    assert simhash.simhash_groups(none, n, radius).count() == 0


def test_simhash_hot_shards(spark):
    prints = set()
    seeds = [RNG.getrandbits(64) for _ in range(4)]
    while len(prints) < 900:
        x = RNG.choice(seeds)
        for _ in range(RNG.randint(0, 8)):
            x ^= 1 << RNG.randrange(64)
        prints.add(x)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    got = {r.v % (1 << 64): r.root for r in components.components(simhash.links(df, 2, 40)).collect()}
    want = grouped(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2])
    pairs = {(want[x], got.get(x, x)) for x in prints}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_tree_finds_all_within():
    values = [RNG.getrandbits(12) for _ in range(200)]
    tree = simhash.Tree()
    for v in values:
        tree.add(v)
    for x in values[:40]:
        assert sorted(tree.within(x, 2)) == [i for i, v in enumerate(values) if (v ^ x).bit_count() <= 2]


def test_components(spark):
    for _ in range(3):
        n = 60
        edges = [(RNG.randrange(n), RNG.randrange(n)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)] + [(5, 5)]
        want = grouped({v for e in edges for v in e}, edges)
        got = {r.v: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {v: r for v, r in want.items() if any(v in e for e in edges if e[0] != e[1])}
