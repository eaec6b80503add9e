"""Operators over pages and conversations, the trie, and the pipeline."""

import numpy as np
import pytest

from logweave.llm import htmltext, langid, quotes
from logweave.llm.trie import EliasFano, Trie, quantised, restored

ARTICLE = "".join(f"<p>Paragraph {i} of the article, with some words; and more of them.</p>" for i in range(6))
PAGES = {
    "plain": (f"<html><body><nav><a href=/>Home</a></nav><article><h1>A title</h1>{ARTICLE}<p>Yes.</p></article><footer>&copy; x</footer></body></html>",
              ["A title", *(f"Paragraph {i} of the article, with some words; and more of them." for i in range(6)), "Yes."]),
    "divs": ("<body><div id=header>Site name</div><div class='main-menu'><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div>"
             f"<div class=content><h2>Head &amp; shoulders</h2>{ARTICLE}<p>Tail<br>end &lt;3</div>"
             "<div class='comments'><p>A reader says a lot of things, again and again, in a long comment.</p></div>"
             "<aside>Side text.</aside><div class='cookie-notice'>We use cookies, you know.</div><form>Mail: <input></form></body>",
             ["Head & shoulders", *(f"Paragraph {i} of the article, with some words; and more of them." for i in range(6)), "Tail end <3"]),
    "scripts": (f"<script>var a = '<p>no</p>';</script><style>p {{}}</style><!-- <p>no</p> --><article>{ARTICLE}<div class=ad>Buy this, now!</div></article>",
                [f"Paragraph {i} of the article, with some words; and more of them." for i in range(6)]),
    "cut off": (f"<html><body><article><h1>T</h1>{ARTICLE}<p>Cut here &am", ["T", *(
        f"Paragraph {i} of the article, with some words; and more of them." for i in range(6)), "Cut here &am"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, want = PAGES[name]
    assert htmltext.main_text(page) == "\n".join(want)


LONG = ["Words of a paragraph, one of some length; and then more, and more. " * 6 for _ in range(6)]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in LONG)
TEXTS = [x.strip() for x in LONG]
ITEMS = [f"item {i} without any mark" for i in range(8)]
NAV = "<nav><a href=/>Home</a></nav><div><ul><li><a href=1>One page</a><li><a href=2>Two pages</a></ul></div>"


@pytest.mark.parametrize("box", ["<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>", "<main><article>{}</article></main>"])
@pytest.mark.parametrize("part", ["<ul>{}</ul>:<li>{}</li>", "<table>{}</table>:<tr><td>{}</td></tr>", "<dl>{}</dl>:<dd>{}</dd>", "{}:<pre>{}</pre>",
                                  "{}:<figure><figcaption>{}</figcaption></figure>", "<div><ol>{}</ol></div>:<li>{}</li>"])
def test_lists_and_tables_stay_whole(box, part):
    whole, item = part.split(":")
    page = f"<body>{NAV}" + box.format(f"<h1>Head</h1>{PARAGRAPHS}" + whole.format("".join(map(item.format, ITEMS))) + PARAGRAPHS) + "</body>"
    assert htmltext.main_text(page).split("\n") == ["Head", *TEXTS, *ITEMS, *TEXTS]


@pytest.mark.parametrize("box", ["<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>", "<main><div>{}</div></main>"])
@pytest.mark.parametrize("inner", ["<section>{}</section>", "<div>{}</div>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>",
                                   "<section><h2>Sub</h2>{}</section>", "<table><tr><td>{}</td></tr></table>"])
def test_text_beside_a_section_stays(box, inner):
    page = f"<body>{NAV}" + box.format("<h1>Head</h1><p>The lead, in short.</p>" + inner.format(PARAGRAPHS) + "<p>The end, at last.</p>") + "</body>"
    want = ["Head", "The lead, in short.", *["Sub"] * ("Sub" in inner), *TEXTS, "The end, at last."]
    assert htmltext.main_text(page).split("\n") == want


@pytest.mark.parametrize("tag", ["li", "pre", "blockquote"])
def test_one_long_part_is_no_container(tag):
    page = f"<article><h1>Head</h1><p>The lead, in short.</p><{tag}>{' '.join(LONG)}</{tag}><p>The end, at last.</p></article>"
    assert htmltext.main_text(page).split("\n") == ["Head", "The lead, in short.", " ".join(" ".join(LONG).split()), "The end, at last."]


BODY = f"<h1>Head</h1>{PARAGRAPHS}"
CARD = "<a href=/x><h3>Another story</h3><p>{}</p></a>"
TEASER = "<article><h3><a href=/x>Another story</a></h3><p>It is told here, in short; and there, at length.</p></article>"


@pytest.mark.parametrize("page, want", {
    "hidden inline": (f"<article>{BODY}<span hidden><div>Not seen, not said.</div>nor this</span><p>The end, at last.</p></article>", ["Head", *TEXTS, "The end, at last."]),
    "advert link": (f"<article>{BODY}<a class='advert' href=x><div>Buy it, now!</div></a><p>The end, at last.</p></article>", ["Head", *TEXTS, "The end, at last."]),
    "cards": (f"<main>{BODY}{CARD.format(LONG[0])}{CARD.format(LONG[1])}</main>", ["Head", *TEXTS]),
    "teasers in main": (f"<main><article>{BODY}</article>{TEASER}{TEASER}</main>", ["Head", *TEXTS]),
    "teasers first": (f"<main>{TEASER}<div><article>{BODY}</article></div>{TEASER}</main>", ["Head", *TEXTS]),
    "cue words of the text": (f"<article>{BODY}<p class='share-price'>The price rose.</p><section id='related-work'><h2>Work</h2><p>Others did, too.</p></section>"
                              "<p class='comment'>A remark, by the author.</p></article>",
                              ["Head", *TEXTS, "The price rose.", "Work", "Others did, too.", "A remark, by the author."]),
    "article's header": (f"<article><div class='header'><h1>Head</h1></div>{PARAGRAPHS}</article>", ["Head", *TEXTS]),
    "references": (f"<article>{BODY}<h2>References</h2><ol><li><a href=1>A first book</a><li><a href=2>A second book</a></ol></article>",
                   ["Head", *TEXTS, "References", "A first book", "A second book"]),
    "related links": (f"<article>{BODY}<h2>Related stories</h2><ul><li><a href=1>A first one</a><li><a href=2>A second one</a></ul></article>", ["Head", *TEXTS]),
    "comments as articles": (f"<article>{BODY}<section><h2>Comments</h2><article><p>{LONG[0]}</p></article><article><p>I say no, and no.</p></article></section></article>",
                             ["Head", *TEXTS]),
    "comments as paragraphs": (f"<article>{BODY}<section><h3>12 comments</h3><p>{LONG[2]}</p></section><p>The end, at last.</p></article>",
                               ["Head", *TEXTS, "The end, at last."]),
    "comments beside": (f"<main>{BODY}</main><section><h2>Comments (3)</h2><div><p>{LONG[0]}</p></div></section>", ["Head", *TEXTS]),
    "parts by class": (f"<div class='mainMenu'><p>{LONG[0]}</p></div><article>{BODY}<div class='social-share'>Tell them, all.</div><p class='ad'>Buy, now!</p>"
                       f"<ol class='commentlist'><li>{LONG[1]}</li></ol></article><div id=cookie-notice>{LONG[2]}</div>", ["Head", *TEXTS]),
    "old anchors": (f"<a name=top><article>{BODY}</article>", ["Head", *TEXTS]),
    "two of a kind": (f"<main><article>{BODY}</article><article>{BODY}</article></main>", ["Head", *TEXTS] * 2),
}.values())
def test_parts_of_an_article_and_others(page, want):
    assert htmltext.main_text(f"<body>{NAV}{page}</body>").split("\n") == want


def test_scores_equal_the_formula():
    rng = np.random.default_rng(3)
    for _ in range(30):
        paths = [("html", "body", *rng.choice(["div", "p", "li", "section"], rng.integers(0, 3))) for _ in range(rng.integers(1, 5))]
        found = [htmltext.Block(paths[rng.integers(len(paths))], "x, y. z " * rng.integers(1, 30), int(rng.integers(0, 40))) for _ in range(rng.integers(1, 25))]

        def ratio(path):
            own = [b for b in found if b.path == path]
            n, chars = len(own), sum(len(b.text) for b in own)
            marks = sum(b.text.count(",") + b.text.count(".") for b in own)
            links = sum(min(b.linked, len(b.text)) for b in own)
            return chars / n * (1 + marks / n) * (1 - links / chars) ** 2

        for i, got in enumerate(htmltext.scores(found)):
            near = [(np.exp(-0.5 * (i - j) ** 2), ratio(b.path)) for j, b in enumerate(found) if abs(i - j) <= 3]
            smooth = sum(w * r for w, r in near) / sum(w for w, _ in near)
            assert np.isclose(got, max(smooth, ratio(found[i].path)))


def test_a_very_long_page():
    many = "".join(f"<p>Paragraph {i}, of a very long page; it goes on.</p>" for i in range(60000))
    out = htmltext.main_text(f"<nav><a href=1>x</a></nav><article><h1>Head</h1>{many}</article>").split("\n")
    assert len(out) == 60001 and out[-1] == "Paragraph 59999, of a very long page; it goes on."
    assert htmltext.main_text("<div>" * 30000 + "deep, deep down." + "</div>" * 30000) == "deep, deep down."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<html><body></body></html>", "<script>", "</p></div>", "<!--", "<p title='"])
def test_main_text_of_nothing(page):
    assert htmltext.main_text(page) in ("", "<")


def test_extracted(spark):
    rows = [(i, "u", p, 1) for i, (p, _) in enumerate(PAGES.values())] + [(None, None, None, 2), (7, "u", "", 3), (7, "u", "", 3)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = htmltext.extracted(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page.page_id: r.text for r in got if r.page.page_id is not None and r.page.page_id < 4} == {
        i: "\n".join(w) for i, (_, w) in enumerate(PAGES.values())}
    assert htmltext.extracted(df.limit(0)).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for top in (10, 10 ** 6, 1 << 63):
        for n in (0, 1, 5, 3000):
            values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
            level, end = EliasFano.read(np.frombuffer(EliasFano.of(values).to_bytes(), np.uint8), 0)
            assert (level.all() == values).all() and (level.get(np.arange(n)) == values).all()
            asked = rng.integers(0, top, 50, dtype=np.uint64)
            assert (level.successor(asked) == np.searchsorted(values, asked)).all()
    dense = EliasFano.of(np.arange(10_000, dtype=np.uint64) * 100)
    assert len(dense.to_bytes()) < 10_000 * 2


def test_trie_in_a_mapped_file(tmp_path):
    rng = np.random.default_rng(2)
    words = rng.integers(1, 1 << 64, 300, dtype=np.uint64)
    pairs = sorted({(int(rng.integers(100)), int(rng.integers(300))) for _ in range(2000)})
    c, w = (words[np.array(x)] for x in zip(*pairs))
    value = rng.random(len(pairs)) + 1e-6
    contexts, weight = words[:120], rng.random(120)
    (tmp_path / "trie").write_bytes(Trie.of(c, w, value, contexts, weight).to_bytes())
    trie = Trie.at(np.memmap(tmp_path / "trie", dtype=np.uint8, mode="r"))
    codes, weights = trie.find(c, w)
    assert (codes == quantised(value)).all() and np.allclose(restored(codes), value, rtol=3e-4)
    assert (weights == quantised(weight)[[int(np.flatnonzero(contexts == x)[0]) for x in c]]).all()
    have = set(zip(c.tolist(), w.tolist()))
    a, b = rng.choice(words, 3000), rng.choice(words, 3000)
    assert ((trie.find(a, b)[0] > 0) == np.array([(x, y) in have for x, y in zip(a.tolist(), b.tolist())])).all()
    assert (trie.find(a, rng.integers(1, 1 << 64, 3000, dtype=np.uint64))[0] == 0).all()


def messages(spark):
    rows = [
        (1, 0, "u", "First point here.\nSecond point there."), (1, 1, "a", "> First point here.\nI agree with it."),
        (1, 2, "u", "On Monday, Ann wrote:\n> second   POINT there.\n\nNo, not that."),
        (1, 3, "a", ">> First point here.\n> I agree with it.\nNeither do I."), (1, 4, "u", "> nobody said this\nA new thread."),
        (2, 0, "u", None), (2, 1, "u", ""), (2, 1, "u", ""), (2, 2, "a", "> \n>\nBlank quotes."), (None, 0, "u", "lone"), (3, None, "u", "> lone\nx"),
    ]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_quotes(spark):
    got = quotes.threaded(messages(spark), by_turn=False).select("message.*", "own_text", "n_quoted_lines", "parent_turn", "root_turn", "depth").collect()
    assert len(got) == 11
    at = {(r.conv_id, r.turn): r for r in got}
    assert [at[1, t].parent_turn for t in range(5)] == [None, 0, 0, 1, None]
    assert [at[1, t].root_turn for t in range(5)] == [0, 0, 0, 0, 4] and [at[1, t].depth for t in range(5)] == [0, 1, 1, 2, 0]
    assert [at[1, t].own_text for t in range(1, 5)] == ["I agree with it.", "No, not that.", "Neither do I.", "A new thread."]
    assert at[1, 3].n_quoted_lines == 2 and at[2, 0].own_text == "" and at[3, None].own_text == "x"
    by_turn = {(r.conv_id, r.turn): r for r in quotes.threaded(messages(spark)).select("message.*", "parent_turn", "root_turn", "depth").collect()}
    assert [by_turn[1, t].parent_turn for t in range(5)] == [None, 0, 0, 1, 3] and by_turn[1, 4].depth == 3 and by_turn[1, 4].root_turn == 0
    assert quotes.threaded(messages(spark).limit(0)).count() == 0


def quoted_by_hand(rows, by_turn):
    """Parents of messages (conversation, turn, text), by listing all runs of words of all messages."""
    import re

    def passages(text):
        out = []
        for line in re.split(r"\r\n?|\n", text or ""):
            marks = re.match(r"\s*((?:>\s?)+)", line)
            depth = marks.group(1).count(">") if marks else 0
            plain = " ".join((line[marks.end():] if marks else line).split()).lower()
            if not out or out[-1][0] != depth:
                out.append((depth, []))
            out[-1][1].append(plain)
        return out

    def runs(text):
        w = text.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({("all", text)} if text else set())

    said, parents = {}, {}
    for c, t, text in rows:
        if t is not None:
            for d, lines in passages(text):
                if d == 0:
                    new = runs(" ".join(x for x in lines if x)) | {("all", x) for x in lines if x and len(x.split()) < 5}
                    for h in new:
                        said.setdefault((c, h), set()).add(t)
    turns = sorted({(c, t) for c, t, _ in rows if t is not None}, key=repr)
    for c, t, text in rows:
        if t is None:
            continue
        best = []
        for d, lines in passages(text):
            asked = runs(" ".join(x for x in lines if x))
            if d and asked:
                at = [max((o for o in said.get((c, h), ()) if o < t), default=None) for h in asked]
                count = {o: at.count(o) for o in at if o is not None}
                if 2 * sum(count.values()) >= len(asked):
                    best.append((-d, max((n, o) for o, n in count.items())[1]))
        last = max((o for x, o in turns if x == c and o < t), default=None) if by_turn else None
        parents[c, t] = max(best)[1] if best else last
    return parents


@pytest.mark.parametrize("by_turn", [False, True])
def test_quotes_wrapped_partial_repeated_and_gaps(spark, by_turn):
    import random
    import textwrap

    rng = random.Random(11)
    rows = []
    for c in [*range(25), None]:
        own = {}
        for t in sorted(rng.sample(range(40), 9)):  # with gaps
            text = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rng.choice((2, 4, 9, 30))))
            if rng.random() < 0.2:
                text = "Thanks a lot!"  # said again and again
            parts = []
            if own and rng.random() < 0.7:
                o = own[rng.choice(list(own))].split()
                a = rng.randrange(len(o))
                quote = o[a:a + rng.choice((3, 8, 40))]
                if rng.random() < 0.3:
                    quote[rng.randrange(len(quote))] = "changed"
                mark = rng.choice(("> ", ">", ">> ", "> > "))
                parts += ["On Monday, X wrote:"] * (rng.random() < 0.3) + [mark + x.upper() for x in textwrap.wrap(" ".join(quote), rng.choice((15, 40, 200)))]
            own[t] = text
            parts += textwrap.wrap(text, rng.choice((12, 50)))
            rows.append((c, t, "\n".join(parts)))
    rows += [(3, None, "> Thanks a lot!"), (4, 50, None), (4, 60, ""), (4, 70, "> \n>\n"), (5, 50, "> never said by anyone here, at all"), (6, 99, rows[0][2])]
    df = spark.createDataFrame([(c, t, "u", x, 1) for c, t, x in rows], "conv_id bigint, turn bigint, role string, text string, depth int").repartition(4)
    got = quotes.threaded(df, by_turn=by_turn).select("message.conv_id", "message.turn", "parent_turn").collect()
    want = quoted_by_hand(rows, by_turn)
    assert len(got) == len(rows)
    assert {(r.conv_id, r.turn): r.parent_turn for r in got if r.turn is not None} == want
    assert sum(p is not None for p in want.values()) > 40


def test_gaps_in_the_turns_do_not_break_a_thread(spark):
    df = spark.createDataFrame([(1, t, "u", f"text {t}") for t in (None, 1, 5, 6, 40)], "conv_id bigint, turn bigint, role string, text string")
    got = {r.turn: (r.parent_turn, r.root_turn, r.depth) for r in quotes.threaded(df).select("message.turn", "parent_turn", "root_turn", "depth").collect()}
    assert got == {None: (None, None, 0), 1: (None, 1, 0), 5: (1, 1, 1), 6: (5, 1, 2), 40: (6, 1, 3)}


def test_a_line_that_all_say_and_quote(spark):
    """300 messages of one conversation say and quote one line: the lookup has a row for each quote, not for each pair."""
    rows = [(1, i, "u", "> the line that all of us say\nthe line that all of us say") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.turn: r.parent_turn for r in quotes.threaded(df, by_turn=False).select("message.turn", "parent_turn").collect()}
    assert got == {i: i - 1 if i else None for i in range(300)}


def test_very_long_messages(spark):
    long = " ".join(f"word{i}" for i in range(60000))
    rows = [(1, 0, "u", long), (1, 1, "u", "nothing"), (1, 2, "u", "> " + " ".join(long.split()[20000:50000]) + "\nyes")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.turn: (r.parent_turn, r.own_text) for r in quotes.threaded(df).select("message.turn", "parent_turn", "own_text").collect()}
    assert got[2] == (0, "yes") and got[0] == (None, long)


def test_long_thread(spark):
    rows = [(9, i, "u", f"line {i}" + (f"\n> line {i - 1}" if i else "")) for i in range(70)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = quotes.threaded(df, by_turn=False).select("message.turn", "parent_turn", "root_turn", "depth").collect()
    assert sorted(map(tuple, got)) == sorted((i, i - 1 if i else None, 0, i) for i in range(70))


def test_language(spark):
    rng = np.random.default_rng(4)
    stock = {"en": ["the", "and", "with", "house", "through", "which"], "de": ["der", "und", "mit", "haus", "durch", "welche"]}
    say = lambda l, n: " ".join(rng.choice(stock[l], n))
    docs = spark.createDataFrame([(i, say(l, 40), l) for i in range(20) for l in stock] + [(99, None, "en"), (98, "x", None)],
                                 "doc_id bigint, text string, lang string")
    page = lambda l, said, n: f"<html{f' lang={said}' if said else ''}><body><article><p>{say(l, n)}.</p></article></body></html>"
    rows = [(i, f"https://www.{l}{i % 3}.example.{'org' if l == 'en' else 'net'}/x", page(l, l if i % 4 else None, 30)) for i in range(20) for l in stock]
    rows = [(n, u, h) for n, (_, u, h) in enumerate(rows)]
    rows += [(100, "https://www.de1.example.net/y", page("de", "de", 0)), (101, "https://www.en1.example.org/", None), (102, None, page("de", "en", 40)),
             (103, "odd", page("en", "xx", 30))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page.page_id: r for r in langid.identified(df, docs).collect()}
    assert len(got) == len(rows) and all(got[n].lang == ("en", "de")[n % 2] for n in range(40))
    assert (got[100].lang, got[101].lang, got[102].lang, got[103].lang) == ("de", "en", "de", "en")
    assert all(0.5 <= r.probability <= 1 for r in got.values())
    assert langid.identified(df.limit(0), docs).count() == 0
    assert {r.lang for r in langid.identified(df, docs.limit(0)).collect()} == {None}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(500)]
    say = lambda n: " ".join(rng.choice(words, n))
    texts = [say(60) for _ in range(40)]
    item = say(25)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[0], "en", "s1", 0), (101, texts[1].replace(texts[1].split()[3], "new", 1), "en", "s1", 0), (102, say(20) + " " + item, "en", "s2", 0),
             (103, "too short", "en", "s0", 0), (104, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        left.append({r.doc_id for r in out.collect()})
        docs = out
    every = {r[0] for r in rows}
    assert left == [every - {103, 104}, every - {103, 104, 100, 101}, every - {100, 101, 102, 103, 104}]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    kept = got.collect()
    assert {r.doc_id for r in kept} <= left[-1] and max(r.shard for r in kept) == 15
    assert spark.read.parquet(f"{tmp_path}/documents.parquet").count() == len(rows)
