import json
import os
import re
import time
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import chat, page_text
from millrace.llm.shared import written
from tests.llm.test_similar import plain_classes

ODD = ["", "\\", "\\\\", "###", "\\###", "#####", "</turn>", "</turn></turn>\n", "\\h\\t\\n", "### user:\nhi</turn>\n", "a\nb", "\\\\h", "é\\", ":\n", "#" * 7 + "\\" * 5 + "</turn"]


def test_turns_round_trip(spark):
    turns = [{"role": r, "text": t} for r in ("user", "assistant", "od\\d\n###r:\n") for t in ODD]
    df = spark.createDataFrame([(1, turns), (2, []), (3, [{"role": "assistant", "text": None}])], f"id long, turns {chat.TURNS}")
    out = chat.format_turns(df).select("id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    rows = {r.id: r for r in out.collect()}
    assert [(t.role, t.text) for t in rows[1].back] == [(t["role"], t["text"]) for t in turns]
    assert rows[1].loss == "".join(ODD)
    assert rows[1].formatted.count("</turn>") == len(turns) and rows[1].formatted.count("###") == len(turns)
    assert (rows[2].formatted, rows[2].back, rows[2].loss) == ("", [], "")
    assert [(t.role, t.text) for t in rows[3].back] == [("assistant", "")]


def test_layouts_are_told_by_their_paths(spark):
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None, "x": 1}], "id": 7}, "messages", [("user", "q"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "sharegpt", [("user", "q"), ("assistant", "a")]),
        ({"instruction": "do", "output": "done", "extra": {"a": 1}}, "instruction", [("user", "do"), ("assistant", "done")]),
        ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\nthis"), ("assistant", "done")]),
        ({"instruction": "do", "input": "", "output": None, "system": None}, "instruction", [("user", "do"), ("assistant", "")]),
        ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"system": "s", "prompt": "p", "response": "c"}, "prompt_response", [("system", "s"), ("user", "p"), ("assistant", "c")]),
        ({"question": "p", "answer": "c"}, "question_answer", [("user", "p"), ("assistant", "c")]),
        ({"something": "else"}, None, None),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)] + [(100, "not json"), (101, None)]
    got = {r.i: r for r in chat.turns_of_json(spark.createDataFrame(rows, "i int, raw string"), "raw").collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert got[i].layout == layout
        assert (None if got[i].turns is None else [(t.role, t.text) for t in got[i].turns]) == turns
    assert got[100].turns is None and got[101].layout_fingerprint is None
    assert len({got[i].layout_fingerprint for i in range(9)}) == 8  # an empty input is no input


def test_layouts_with_nulls_in_the_first_turn(spark):
    a = {"role": "assistant", "content": "a"}
    records = [
        ({"messages": [{"role": "user", "content": None}, a]}, "messages", [("user", ""), ("assistant", "a")]),
        ({"messages": [{"role": "user"}, a]}, "messages", [("user", ""), ("assistant", "a")]),
        ({"messages": [{"content": "q"}, a]}, "messages", [("", "q"), ("assistant", "a")]),
        ({"messages": [None, a]}, "messages", [("", ""), ("assistant", "a")]),
        ({"conversations": [{"from": None, "value": None}, {"from": "gpt", "value": "a"}]}, "sharegpt", [("", ""), ("assistant", "a")]),
        ({"messages": [{"x": 1}]}, None, None),
        ({"messages": []}, "messages", []),
        ({"messages": [a], "prompt": "p", "output": "o"}, "messages", [("assistant", "a")]),
        ({"messages": None, "prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"messages": "text", "question": "p", "answer": None}, "question_answer", [("user", "p"), ("assistant", "")]),
        ({"turns": [{"role": "human", "text": "q"}]}, "turn_rows", [("human", "q")]),
        ({"messages": [{"role": "human", "content": "q" * 100_000}]}, "messages", [("user", "q" * 100_000)]),
        ({"prompt": "p", "completion": "c", "answer": "a"}, None, None),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)]
    got = {r.i: r for r in chat.turns_of_json(spark.createDataFrame(rows, "i int, raw string"), "raw").collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert got[i].layout == layout
        assert (None if got[i].turns is None else [(t.role, t.text) for t in got[i].turns]) == turns


def test_turn_rows(spark):
    rows = [(1, 1, "assistant", "b", "x"), (1, 0, "gpt", None, "x"), (None, 0, None, "t", "x"), (None, 0, None, "t", "x"), (1, 1, "assistant", "b", "x"), (1, None, "user", "ü" * 300_000, "x"), (2, 1, "b", "2", "x"), (2, 1, "a", "3", "x"), (2, 1, "a", "1", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    got = sorted(((r.conv_id or 0, [(t.role, t.text) for t in r.turns], r.layout) for r in chat.turns_of_rows(df).collect()), key=str)
    assert got == [
        (0, [("", "t")], "turn_rows"), (0, [("", "t")], "turn_rows"),
        (1, [("user", "ü" * 300_000), ("gpt", ""), ("assistant", "b"), ("assistant", "b")], "turn_rows"),
        (2, [("a", "1"), ("a", "3"), ("b", "2")], "turn_rows"),
    ]
    assert chat.format_turns(chat.turns_of_rows(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.turns_of_rows(df.drop("turn"))


def test_turn_rows_of_another_layout(spark):
    df = spark.createDataFrame([("c", 2, "gpt", "a"), ("c", 1, "human", "q")], "id string, at int, from string, value string")
    (r,) = chat.turns_of_rows(df, by="id", order="at", array="conversations").collect()
    assert (r.conv_id, r.layout, [(t.role, t.text) for t in r.turns]) == ("c", "sharegpt", [("user", "q"), ("assistant", "a")])


def test_the_query_takes_its_mapping_by_fingerprint(spark, monkeypatch):
    monkeypatch.setattr(chat, "LAYOUTS", {k: v for k, v in chat.LAYOUTS.items() if k != "turn_rows"} | {"other": {"turns[].who": "role", "turns[].role": "x", "turns[].text": "text"}})
    rows = spark.createDataFrame([(1, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    (r,) = chat.turns_of_rows(rows).collect()
    assert r.layout is None and r.turns is None


def plain_article(html):
    found = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)
    parts = re.split(r"</?(?:p|h1)>", found[1]) if found else []
    blocks = [" ".join(unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in parts]
    return "\n".join(b for b in blocks if b)


def test_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    html = {r.page_id: r.html for r in df.collect()}
    got = page_text.extract(df).collect()
    assert len(got) == len(html)
    for r in got:
        assert r.text == plain_article(html[r.page_id]) and r.n_chars == len(r.text)


PAGE = """<html><head><title>t</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body class="home">
<header>Site name</header><div id="nav-menu"><a href=/>Home</a></div><div class="cookie-notice">We use cookies, dear reader.</div>
<main><h1>Title &amp; more</h1><p>First paragraph, with <b>bold</b> and <a href="x > y">a link</a>,&nbsp;and more words.
<p>Second one:<br>a new line, and then some more text.</p><ul><li>an item<li>another</ul><form><input><label>Mail</label></form>
<!-- <p>comment, not text.</p> --></main><aside>Related things, and others.</aside>
<section class="comments"><p>Reader's comment, long and full of marks, commas, and stops.</p></section><footer>&copy; 2020</footer></body></html>"""


def test_page_parts():
    assert page_text.main_text(PAGE).split("\n") == ["Title & more", "First paragraph, with bold and a link, and more words.", "Second one: a new line, and then some more text.", "an item", "another"]
    plain = "<body><div class=menu>a b c</div><div><p>Some text, with marks.</p><p>And more of it, indeed.</p></div><div class='footer'>x</div></body>"
    assert page_text.main_text(plain) == "Some text, with marks.\nAnd more of it, indeed."
    assert [page_text.main_text(x) for x in ("", None, "<p>", "<div><", "<nav>menu</nav>", "<p>cut off <b")] == ["", "", "", "<", "", "cut off"]


def test_content_in_several_containers():
    page = "<body><h1>Top</h1><div id=a><h2>One</h2><p>Some text, with marks.</p></div><div id=b><h2>Two</h2><p>And a good deal more of it, indeed, with marks.</p></div></body>"
    assert page_text.main_text(page).split("\n") == ["Top", "One", "Some text, with marks.", "Two", "And a good deal more of it, indeed, with marks."]
    outer = "<body><div class=post><h1>Title</h1><div class=body><p>Some text, with marks.</p></div><div class=more><p>And more of it, indeed.</p></div></div></body>"
    assert page_text.main_text(outer).split("\n") == ["Title", "Some text, with marks.", "And more of it, indeed."]
    title = "<body><div class=post><h1>Title</h1><div class=body><p>Some text, with marks.</p></div></div></body>"
    assert page_text.main_text(title).split("\n") == ["Title", "Some text, with marks."]
    two = "<body><article id=a><p>Some text, with marks.</p></article><article id=b><p>And more of it, indeed.</p></article></body>"
    assert page_text.main_text(two).split("\n") == ["Some text, with marks.", "And more of it, indeed."]


P = "<p>Some text, with marks.</p>"
Q = "<p>And a good deal more of it, indeed, with marks; and so on.</p>"
BOTH = ["Some text, with marks.", "And a good deal more of it, indeed, with marks; and so on."]
LAYOUTS = {
    "<body><main class='content no-sidebar'>{P}{Q}</main></body>": BOTH,
    "<body><div class='wrap with-nav has-sidebar'>{P}{Q}</div><div class=sidebar>{P}</div></body>": BOTH,
    "<body><div class=widget-area>{P}{Q}{Q}</div><div>x</div></body>": [*BOTH, BOTH[1]],
    "<body><article><section id=related-work>{P}</section><h2 id=search-results>Found, at last</h2>{Q}</article></body>": [BOTH[0], "Found, at last", BOTH[1]],
    "<body><article data-id=menu data-role='nav'>{P}{Q}</article></body>": BOTH,
    "<body><article>{P}<figure><img src=x><figcaption>What it shows</figcaption></figure><math><mi>x</mi></math>{Q}</article></body>": [BOTH[0], "What it shows", "x", BOTH[1]],
    "<body><article>{P}{Q}</article><ol class=commentlist><li>{Q}{Q}{Q}{Q}{Q}{Q}</li></ol></body>": BOTH,
    "<body><div>{P}{Q}</div><section id=comments>{Q}{Q}{Q}{Q}{Q}{Q}</section></body>": BOTH,
    "<body><article>{P}{Q}<article class='comment'>{Q}{Q}{Q}</article></article></body>": BOTH,
    "<body><header><h1>Site</h1></header><article><header><h1>Title</h1><p>By one, on a day.</p></header>{P}{Q}</article></body>": ["Title", *BOTH],
    "<body><div><a href=1>Home</a> <a href=2>News</a></div><div>{P}<ul><li>one</li><li>two</li></ul>{Q}</div><div>Imprint</div></body>": [BOTH[0], "one", "two", BOTH[1]],
    "<body><table><tr><td><a href=1>Home</a></td><td>{P}{Q}</td></tr></table></body>": BOTH,
    "<body><section id=intro><h2>One</h2>{P}</section><div>a break</div><section id=methods><h2>Two</h2>{Q}</section></body>": ["One", BOTH[0], "a break", "Two", BOTH[1]],
    "<body><form action=/><article>{P}{Q}</article></form></body>": BOTH,
    "<body><form id=aspnetForm><div class=menu><a href=1>Home</a></div><div>{P}{Q}</div><label>Name</label><input><button>Send</button></form></body>": BOTH,
    "<body><article>{P}{Q}<form><p>Leave your mail, and we write.</p><input></form></article></body>": BOTH,
    "<body><article>{P}<p class='search-term'>A term, as one may search for it, and more.</p><div class='share-of-market'>{Q}</div></article></body>": [BOTH[0], "A term, as one may search for it, and more.", BOTH[1]],
    "<body><article>{P}{Q}<div class='share-icons'>Tweet</div><div class='share-us-now'>Tell others</div></article></body>": BOTH,
    "<body><article>{P}{Q}</article><div id='user-comments'>{Q}{Q}{Q}{Q}{Q}</div></body>": BOTH,
    "<body><div>{P}{Q}<ins class='adsbygoogle'>Buy this, now, or never.</ins></div></body>": BOTH,
    "<body><article>{Q}{Q}{Q}{P}</article><article><h3><a href=1>Other</a></h3><p>Read on, now.</p></article></body>": [BOTH[1]] * 3 + [BOTH[0]],
    "<body><main><h1>Title</h1><article>{Q}{Q}{Q}{P}</article><article><p>Read on, now.</p></article></main></body>": ["Title"] + [BOTH[1]] * 3 + [BOTH[0]],
    "<body><article><p>Some text, <button>Copy</button>with marks.</p>{Q}<svg><text>x</text></svg></article></body>": BOTH,
    "<body><article><ul><li><a href=1>Back</a></li></ul><h2>Part</h2>{P}<ul><li>one</li></ul>{Q}<ul><li><a href=2>More like this</a></li><li><a href=3>And this</a></li></ul></article></body>": ["Part", BOTH[0], "one", BOTH[1]],
    "<body><section id=comments-on-the-budget>{P}{Q}</section></body>": BOTH,
    "<body><div id=cookie-banner>{P}</div><div class='ad-slot'>{P}</div><div class=newsletterBox>{P}</div><div>{P}{Q}{Q}</div></body>": [*BOTH, BOTH[1]],
}


@pytest.mark.parametrize("page", LAYOUTS)
def test_layouts_of_pages(page):
    assert page_text.main_text(page.replace("{P}", P).replace("{Q}", Q)).split("\n") == LAYOUTS[page]


@pytest.mark.parametrize("unit", ["<div>text, ", "<b>text, ", "<p><b>", "<a href=x>", "</p></b>", "<li><b>x", "<div class=ad>x", "<h1>x"])
def test_time_grows_with_the_length(unit):
    began = time.process_time()
    page_text.main_text(unit * 8000)
    assert time.process_time() - began < 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</div>", "<div class=ad>", "<", ">", '"', "<!--", "-->", "<script>", "text, ", "&amp;", "<a href='"])).map("".join))
def test_any_page(html):
    page_text.main_text(html)


def test_odd_page_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, "t"), (2, "v", "x" * 300_000, "t")], "page_id long, url string, html string, text string")
    got = page_text.extract(df).collect()
    assert sorted(r.n_chars for r in got) == sorted([0, 300_000, *[len(page_text.main_text(PAGE))] * 2])
    assert page_text.extract(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), name)
        assert docs.columns == columns
        got = docs.collect()
        assert all(rows[r.doc_id] == r for r in got) and len({r.doc_id for r in got}) == len(got)
        before, rows = rows, {r.doc_id: r for r in got}
        gone = [r for i, r in before.items() if i not in rows]
        if name == "language":
            assert len(gone) < 0.01 * len(before)
        if name == "exact_dedup":
            assert sorted(rows) == sorted({r.text: i for i, r in sorted(before.items())}.values())
        if name == "near_dedup":
            want = plain_classes([(i, r.text) for i, r in before.items()])
            kept = {i for i in want if want[i] == i}
            assert kept <= set(rows) and len(rows) - len(kept) <= 0.01 * (len(before) - len(kept))
        if name == "mixing":
            labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            good = [i for i in before if i in labels and labels[i].quality == 1 and labels[i].toxic == 0]
            assert sum(i in rows for i in good) / len(good) > 0.98
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == set(rows)
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def test_pipeline_of_odd_rows(spark, tmp_path):
    rows = [(1, "the cat sat on the mat", "en", "s", 1), (1, "the cat sat on the mat", "en", "s", 1), (2, None, None, None, None), (3, "der hund und die katze", "de", "s", 1), (None, "the dog sat on the cat", "en", "s", 1)]
    for name, own in (("some", rows), ("none", [])):
        spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)] if own else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
        before = set(os.listdir(shared))
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        left = {x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - before}
        assert left == {"mixing", "pieces"}, left  # the tables of earlier stages are gone
        assert {r.doc_id for r in got} <= {1, 3, None} and bool(got) == bool(own)  # rates below one leave some out


def test_stages_judge_rows_one_by_one(spark, tmp_path):
    """Repeated and null ids, ties, long texts and further columns with the names that the stages use themselves."""
    base = [f"word{i} of this text" for i in range(40)]
    near = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in (0, 39)]
    texts = [(1, " ".join(base)), (5, near[0]), (5, "the unique text of a row that shares its id with another one, and so it stays"), (None, near[1]), (None, "a text without an id that is like no other one"), (2, "twice the same text here"), (2, "twice the same text here"), (3, "Twice the same text here"), (4, "long " * 60_000 + "end"), (6, None), (7, ""), (8, "½ 12")]
    names = "accepted score row rate copies text_hash kept digest h _row sequence_id offset length _text_hash _keep_digest chance".split()
    rows = [(i, t, "en", "s", len(t or ""), *(f"{n}{k}" for n in names)) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    own = {str(tuple(r)) for r in docs.collect()}
    want = {"language": texts[:9], "exact_dedup": [*texts[:5], *texts[6:9]], "near_dedup": [texts[0], texts[2], texts[4], texts[5], texts[8]]}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        got = docs.collect()
        assert all(str(tuple(r)) in own for r in got) and sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, want[name])), name
    kept = written(corpus_pipeline.mixing_stage(spark, docs, str(tmp_path)), "mixing")
    assert kept.columns == docs.columns and {str(tuple(r)) for r in kept.collect()} <= own
    packed = corpus_pipeline.packing_stage(spark, docs, str(tmp_path))
    assert sorted({str(r.doc_id) for r in packed.collect()}) == sorted({str(i) for i, _ in want["near_dedup"]})
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
