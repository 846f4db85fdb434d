"""Sentence pieces, chat linking, page text and toxicity: libraries, brute force, odd rows."""

import collections
import json
import random

import numpy as np
import pytest
from conftest import SF_CHECK, SF_SMALL
from pyspark.sql import functions as F
from sparkprep.llm import chat, html_text, queries, toxicity
from sparkprep.llm import sentence_pieces as sp
from test_sets import ODD, SCHEMA

TRICKY = ["", " ", "  two  spaces ", "line\n\nends\r\n", "tab\tand\x00nul", "日本語 テキスト 😀", "▁mark ▁▁", "a" * 300, "é combining é", "x y z", "</s><s><unk><0x41>"]


@pytest.fixture(scope="module")
def model():
    return sp.read_model()


def test_pieces_equal_the_library(spark, model):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    wfst = sp.Transducer(model)
    texts = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect() if r.text] + [t for t in TRICKY if "▁" not in t]
    for text, want in zip(texts, lib.encode(texts), strict=True):
        ids = np.frombuffer(wfst.encode(text), np.int32).tolist()
        assert ids == want and wfst.decode(ids) == text


def test_round_trip_of_any_text(model):
    wfst = sp.Transducer(model)
    rnd = random.Random(4)
    alphabet = "abe \n\t.,▁é中😀́\x00'"
    for text in TRICKY + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(400)]:
        assert wfst.decode(np.frombuffer(wfst.encode(text), np.int32).tolist()) == text


def test_shortest_paths_by_brute_force(model):
    """All segmentations of short texts: the BPE path is the only one of finite
    weight, the unigram path the lightest."""
    wfst = sp.Transducer(model)

    def paths(s):
        if not s:
            yield []
        for n in range(1, len(s) + 1):
            if s[:n] in wfst.ids or n == 1:
                for rest in paths(s[n:]):
                    yield [s[:n], *rest]

    rnd = random.Random(8)
    for _ in range(60):
        s = "".join(rnd.choice(" theionracs中") for _ in range(rnd.randint(1, 8)))
        every = list(paths(s))
        finite = [p for p in every if all(wfst._stays((a, b)) for a, b in zip(["", *p], p, strict=False))]
        assert finite == [wfst._ordered(s)] == [wfst._merged(s)]
        weight = lambda p: -sum(wfst.score.get(a, wfst.unknown) for a in p)
        assert weight(wfst._lightest(s)) == min(map(weight, every))


def test_kept_tables_stay_bounded():
    kept = sp.Kept(lambda x: x * 2, 10)
    assert [kept[x % 37] for x in range(500)] == [x % 37 * 2 for x in range(500)]
    assert len(kept) <= 10 and len(kept.last) <= 10


def test_pieces_of_odd_rows(spark, model):
    docs = spark.createDataFrame([(*r, "k", "s", "x", "w", "h") for r in ODD], SCHEMA).withColumn("n_pieces", F.lit("clash"))
    out = sp.encoded(docs, model)
    assert out.count() == len(ODD) and out.filter("NOT round_trip").count() == 0
    assert out.filter("text IS NULL OR text = ''").select("n_pieces").collect() == [(0,), (0,)]
    assert sp.encoded(docs.limit(0), model).count() == 0
    assert queries.op7(spark, SF_SMALL).filter("NOT round_trip OR n_pieces != size(piece_ids)").count() == 0


MESSAGES = "conv_id long, turn long, role string, text string"


def linked(spark, rows, **options):
    out = chat.linked(spark.createDataFrame(rows, MESSAGES), **options).collect()
    return sorted(out, key=lambda r: (-1 if r.conv_id is None else r.conv_id, r.position))


def call(i, name="f", arguments=None, after=()):
    return "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": arguments or {}, "after": list(after)}) + "</tool_call>"


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def test_calls_results_and_order(spark):
    rows = [
        (1, 0, "user", "go"), (1, 1, "tool", result("b", {"z": 1.0, "a": "é"})),  # the result stands before its call
        (1, 2, "assistant", "I call " + call("a", arguments={"n": 3}, after=["c"]) + call("b")), (1, 3, "tool", result("a", [1, 2])),
        (1, 4, "assistant", call("c")), (1, 5, "tool", result("zz", None)), (1, 6, "assistant", call("b")),
    ]
    out = linked(spark, rows, turns_are_calls=False, schemas={"f": {"required": ["n"], "properties": {"n": {"type": "integer", "maximum": 2}}}})
    assert [r.position for r in out] == list(range(len(out)))
    at = {(r.kind, r.call_id, r.turn): r.position for r in out}
    assert at["call", "b", 2] < at["result", "b", 1] and at["call", "c", 4] < at["call", "a", 2] < at["result", "a", 3]
    status = {(r.kind, r.call_id, r.turn): r.status for r in out}
    assert status["call", "a", 2] == "answered" and status["call", "c", 4] == "unanswered" and status["call", "b", 6] == "duplicate"
    assert status["result", "zz", 5] == "orphan" and status["result", "b", 1] == "linked"
    assert {r.call_id: list(r.errors) for r in out if r.kind == "call" and r.turn == 2} == {"a": ["$.n: over the maximum"], "b": ["$: no n"]}
    line = next(r.json for r in out if r.kind == "result" and r.call_id == "b")
    assert line == '{"content":{"a":"é","z":1},"kind":"result","role":"tool","status":"linked","tool_call_id":"b"}'


def test_circles_and_long_chains(spark):
    rows = [(1, t, "assistant", call(f"x{t}", after=[f"x{t + 1}"] if t < 30 else [])) for t in range(31)]  # each waits for the next turn
    rows += [(2, 0, "assistant", call("p", after=["q"]) + call("q", after=["p"])), (2, 1, "assistant", call("r", after=["p", "none"]))]
    out = linked(spark, rows, turns_are_calls=False)
    order = [r.call_id for r in out if r.conv_id == 1 and r.kind == "call"]
    assert order == [f"x{t}" for t in range(30, -1, -1)]
    assert {r.call_id for r in out if r.status == "cyclic"} >= {"p", "q"}


def test_circles_over_turns(spark, monkeypatch):
    waits = {1: {"p": "q", "q": "p", "r": "p", "s": "r", "o": "", "z": "z"},  # r and s stand behind the circle
             2: {"a": "bo", "b": "a", "m": "b", "c": "md", "d": "e", "e": "c", "o": "", "f": "e"},  # o before, m between two circles, f behind
             None: {"u": "v", "v": "w", "w": "u", "x": "wy", "y": "x"}, 4: {"i": "", "j": "i", "k": "j"}}
    circles = {1: "pq", 2: "abcde", None: "uvwxy", 4: ""}
    rows = [(c, t, "assistant", call(i, after=list(after))) for c, ws in waits.items() for t, (i, after) in enumerate(ws.items())]
    rows += [(1, 9, "tool", result("p", 1)), (1, 0, "tool", result("s", 1))]
    rows += [(5, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(200)]
    rounds, reliable = [], chat.reliable
    monkeypatch.setattr(chat, "reliable", lambda df: rounds.append(1) or reliable(df))
    out = linked(spark, rows)
    assert len(rounds) < 100  # however many events have edges
    for c, ws in waits.items():
        order = [r for r in out if r.conv_id == c and r.kind == "call"]
        assert {r.call_id for r in order if r.status == "cyclic"} == set(circles[c])
        at = {r.call_id: r.position for r in order}
        assert all(at[b] < at[i] for i, after in ws.items() if i not in circles[c] for b in after if b != i)
        own = [r.call_id for r in order if r.call_id in circles[c]]
        assert own == [i for i in ws if i in circles[c]]  # in their own turns' order
    results = {r.call_id: (r.status, r.position) for r in out if r.conv_id == 1 and r.kind == "result" and r.call_id in "ps"}
    assert {i: s for i, (s, _) in results.items()} == {"p": "linked", "s": "linked"}
    assert results["s"][1] > next(r.position for r in out if r.call_id == "s" and r.kind == "call")


def test_circles_by_brute_force(spark):
    rnd = random.Random(11)
    edges = list({(rnd.randrange(60), rnd.randrange(60)) for _ in range(75)})
    reach = {i: {b for e, b in edges if e == i} for i in range(60)}
    for _ in range(60):
        reach = {i: r | {y for x in r for y in reach[x]} for i, r in reach.items()}
    edges = [(e, b) for e, b in edges if e != b]
    inside = {i for i, _ in edges if any(b in reach[i] and i in reach[b] for b in range(60) if b != i)}
    got = chat._circles(spark.createDataFrame(edges, "event long, before long")).collect()
    assert sorted(r.event for r in got) == sorted(inside) and inside


def test_one_long_conversation(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(2000)] + [(t, 0, "user", "x") for t in range(20, 40)]
    random.Random(2).shuffle(rows)
    out = [r for r in linked(spark, rows) if r.conv_id == 7]
    assert [r.turn for r in out] == list(range(2000)) and [r.position for r in out] == list(range(2000))
    assert {r.status for r in out} == {"answered", "linked"}


def test_odd_messages(spark):
    rows = [(None, 0, "user", "no conversation"), (1, None, "user", "no turn"), (1, 0, None, None), (1, 1, "tool", "{not json"), (1, 1, "tool", "{not json"),
            (1, 2, "assistant", "<tool_call>[1]</tool_call>"), (1, 3, "user", ""), (1, 3, "user", ""), (2, 0, "user", "x" * 200_000)]
    out = linked(spark, rows)
    assert len(out) == len(rows)
    by = collections.Counter((r.kind, r.status) for r in out)
    assert by["call", "duplicate"] == 1 and by["result", "orphan"] == 1
    assert [r.valid for r in out if r.kind == "call" and r.turn == 3] == [False, False]
    assert all(json.loads(r.json) is not None for r in out)
    assert chat.linked(spark.createDataFrame([], MESSAGES)).count() == 0


DEEP = "[" * 3000 + "]" * 3000


@pytest.mark.parametrize("raw", ['{"id": "a", "name": "f", "arguments": {"x": 1e400}}', '{"id": "a", "name": "f", "arguments": {"x": "\\ud800"}}',
                                 '{"id": "\\ud800", "name": "f"}', '{"id": "a", "name": "f", "arguments": {"x": %s}}' % DEEP,
                                 '{"id": "a", "name": "f", "arguments": {"x": NaN}}', '{"id": "a", "name": "f", "arguments": {"x": %s}}' % ("9" * 5000)])
def test_json_that_cannot_be_kept_stays_a_message(spark, raw):
    rows = [(1, 0, "assistant", f"<tool_call>{raw}</tool_call>"), (1, 1, "tool", raw.replace('"id"', '"tool_call_id"')), (2, 0, "user", "fine")]
    out = linked(spark, rows)
    assert sorted(r.kind for r in out if r.turn == 1) == ["message"] and [r.kind for r in out if r.conv_id == 1 and r.turn == 0] == ["result"]
    assert json.loads(next(r.json for r in out if r.turn == 1))["content"] == raw.replace('"id"', '"tool_call_id"')


@pytest.mark.parametrize("value, schema, n", [
    (1, {"enum": [True]}, 1), (True, {"enum": [1]}, 1), ([1], {"const": [True]}, 1), (1, {"enum": [1.0]}, 0), ({"a": [0]}, {"const": {"a": [False]}}, 1),
    ({"a": [0, None]}, {"const": {"a": [0.0, None]}}, 0), (None, {"enum": [0, "", False]}, 1), (10 ** 400, {"type": "integer"}, 0), (10 ** 400, {"maximum": 5}, 1), ("1", {"const": 1}, 1),
])
def test_schemas_compare_values_as_json_with_types(value, schema, n):
    assert len(chat.schema_errors(value, schema)) == n


def test_every_turn_is_there_once(spark):
    given = spark.read.parquet(f"{SF_CHECK}/conversations.parquet").collect()
    out = queries.op8(spark, SF_CHECK).collect()
    assert collections.Counter((r.conv_id, r.turn, r.role) for r in out) == collections.Counter((r.conv_id, r.turn, r.role) for r in given)
    turns = {(r.conv_id, r.turn): r for r in given}
    for r in out:
        body = json.loads(r.json)
        assert (body["arguments"]["prompt"] if r.kind == "call" else body["content"]) == turns[r.conv_id, r.turn].text
        answered = turns.get((r.conv_id, r.turn + 1)) is not None and turns[r.conv_id, r.turn + 1].role == "assistant"
        if r.kind == "call":
            assert r.status == ("answered" if answered else "unanswered")
        elif r.kind == "result":
            before = turns.get((r.conv_id, r.turn - 1))
            assert r.status == ("linked" if before is not None and before.role == "user" else "orphan")


@pytest.mark.parametrize("value, schema, n", [
    ({"a": 1}, {"type": "object", "required": ["a"]}, 0), ({}, {"type": "object", "required": ["a"]}, 1), ([], {"type": "object"}, 1),
    ({"a": True}, {"properties": {"a": {"type": "integer"}}}, 1), ({"a": 2.0}, {"properties": {"a": {"type": "integer"}}}, 0),
    ({"a": "x"}, {"properties": {"a": {"enum": ["y"]}}}, 1), ({"a": ["x", 1]}, {"properties": {"a": {"items": {"type": "string"}}}}, 1),
    ({"b": 1}, {"additionalProperties": False}, 1), ("abc", {"type": ["string", "null"], "maxLength": 2, "pattern": "^b"}, 2), (None, {"type": ["string", "null"]}, 0),
])
def test_schemas(value, schema, n):
    assert len(chat.schema_errors(value, schema)) == n


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<div class="layout with-sidebar"><aside><h3>Popular</h3><a href=3>x y z</a></aside>
%s<h1>The title</h1><p>First paragraph &amp; more of the <b>main</b> text,\n  quite long.<p>Second&nbsp;paragraph with a <a href=x>link</a> and words &#233; &unknown; &copy
<ul><li>an item of some words<li>another item</ul><script>var s = "<p>no</p>";</script><blockquote>A quote to end it all, at last.</blockquote>%s
<div id="comments"><p>A reader says a lot of words about all this and then some more words.</p></div></div>
<form><label>Name</label><input></form><footer>&copy; Site</footer></body></html>"""
MAIN = ("The title\nFirst paragraph & more of the main text, quite long.\nSecond paragraph with a link and words é &unknown; ©\n"
        "an item of some words\nanother item\nA quote to end it all, at last.")


@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>"), ("<div>", "</div>")])
def test_main_text(around):
    assert html_text.main_text(PAGE % around) == MAIN


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<body></body>", ""), ("<p>cut <b", "cut"), ("<p>a &am", "a &am"),
    ("<p>x<script>y", "x"), ("<p>one<!-- <p>two</p> --> three</p>", "one three"), ("<p>a<script>1</script>b</p>", "ab"), ("a < b > c", "a < b > c"),
    ("<div title='a > b'>t</div>", "t"), ("<p>" + "word " * 50_000, ("word " * 50_000).strip()), ("<div>" * 3000 + "deep", "deep"),
])
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("attrs, pruned", [
    ('title="A hidden valley"', False), ('data-hidden="false"', False), ("data-hidden", False), ('data-id="reply-3"', False), ("alt='id=comments'", False),
    ('data-role="search"', False), ('title="x style=display:none"', False), ('aria-hidden="false"', False), ("data-x=a/hidden", False), ('class="text" class="comments"', False),
    ("hidden", True), ('HIDDEN=""', True), ('title="a b" hidden', True), ('aria-hidden="true"', True), ("id = 'comments'", True), ("class=comments", True),
    ('style="color: red; display: none"', True), ("role=search", True), ('x="1"hidden', True), ("itemprop=comment", True),
])
def test_attributes_by_exact_name(attrs, pruned):
    page = f"<body><p>{'The main text of the page goes on. ' * 9}</p><div {attrs}>Some more words of it.</div></body>"
    assert ("Some more" not in html_text.main_text(page)) == pruned
    link = f'<p>{"Words of a text. " * 9}<a href="/wiki/Hidden_Markov_model" title="hidden">A model</a> by name.</p>'
    assert html_text.main_text(link) == "Words of a text. " * 9 + "A model by name."


LOREM = "The main text of the page goes on for some words. " * 6


@pytest.mark.parametrize("around", ["<article>%s</article>", "<main>%s</main>", "<div class=entry>%s</div>"])
@pytest.mark.parametrize("block, kept", [
    ('<h2 id="related-work">X1</h2>', True), ('<h2 id="search">X1</h2>', True), ('<h3 class="comments">X1</h3>', True), ('<p class="legal-note">X1 and more.</p>', True),
    ('<div class="post-header"><h1>X1</h1></div>', True), ('<div class="overflow-hidden"><p>X1 %s</p></div>' % LOREM, True), ('<p id="copyright">X1 is a right.</p>', True),
    ('<div class="side-by-side"><p>X1 %s</p></div>' % LOREM, True), ('<section id="discussion"><h2>X1</h2><p>%s</p></section>' % LOREM, True),
    ('<div class="section" id="related-work"><h2>X1</h2><p>%s</p></div>' % LOREM, True), ('<div id="ad-hoc-networks"><p>X1 %s</p></div>' % LOREM, True),
    ('<p>A <span class="comment" id="reply">X1</span> in code.</p>', True), ('<div id="search"><h2>X1</h2><p>%s</p></div>' % LOREM, True),
    ('<div class="ad">X1 is on sale.</div>', False), ('<div class="inline-ad-2">X1 is on sale.</div>', False), ('<p class="advertisement">X1</p>', False),
    ('<div id="comments"><p>X1 says a reader.</p></div>', False), ('<div class="post-comments"><p>X1 says a reader.</p></div>', False),
    ('<div class="share-buttons"><a href=1>X1</a></div>', False), ('<ul class="relatedPosts"><li><a href=1>X1</a></ul>', False), ('<div id="related-posts">X1</div>', False),
])
def test_names_of_blocks(around, block, kept):
    body = f"<h1>Title</h1><p>{LOREM}</p>{block}<p>{LOREM}</p>"
    text = html_text.main_text(f"<body><nav><a href=1>One</a></nav>{around % body}<div class='site-footer'>Site</div></body>")
    assert ("X1" in text) == kept and text.count(LOREM.strip()) == 2 + (LOREM in block) and "Site" not in text


@pytest.mark.parametrize("inner", ['class="legal-notice"', 'class="notice"', 'class="widget"', 'id="discussion"', 'class="header"', 'class="hidden"'])
def test_only_plain_kinds_are_pruned_in_an_article(inner):
    page = f"<body><article><p>{LOREM}</p><div {inner}><p>X1 {LOREM}</p></div></article></body>"
    assert "X1" in html_text.main_text(page)


def test_page_rows(spark):
    rows = [(1, "u", PAGE % ("<article>", "</article>"), "c"), (1, "u", None, None), (None, None, "<p>x", "c")]
    out = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.text, r.n_chars) for r in out) == sorted([(MAIN, len(MAIN)), ("", 0), ("x", 1)])
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_articles_of_the_pages(spark):
    """The pages' articles, cut out and stripped by pattern."""
    import html
    import re
    for r in queries.op10(spark, SF_CHECK).join(spark.read.parquet(f"{SF_CHECK}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = (re.sub(r"<[^>]*(>|\Z)", " ", b) for b in re.split(r"</?(?:p|h1)>|<(?:p|h1|/p|/h1)?\Z", body))
        assert r.text == "\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)


def test_held_out_toxicity(spark):
    out = queries.op4(spark, SF_CHECK).join(spark.read.parquet(f"{SF_CHECK}/labels.parquet"), "doc_id", "left").collect()
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").count()
    assert len(out) == docs and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.toxic is not None]
    assert sum(r.predicted == r.toxic for r in held) >= 0.93 * len(held)
    clean, bad = (np.mean([r.score for r in held if r.toxic == y]) for y in (0, 1))
    assert clean < 0.1 < bad


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.createDataFrame([(i, "you idiot and moron " * (i % 2) + "plain words of text " * 5) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    out = {r.doc_id: r.score for r in toxicity.fit(docs, labels).score(docs, ["doc_id"]).collect()}
    assert all((out[i] >= 0.5) == (i % 2 == 1) for i in out)


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "k", "s", "x", "w", "h") for r in ODD], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.fit(docs, none).score(docs, ["doc_id"]).collect()] == [0.0] * len(ODD)
    one = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None), (6, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.fit(docs, one).score(docs, ["doc_id"]).collect()} == {1.0}
    import pyarrow as pa
    texts = [r[1] for r in ODD] + ["You 1d1ot! m-o-r-o-n?"]
    x = toxicity.features(pa.RecordBatch.from_pydict({"text": texts, "capitals": [0] * len(texts)}), toxicity.Lexicon())
    assert np.isfinite(x).all() and not x[0].any() and x[-1][toxicity.FEATURES.index("plain_again")] > 0


def features_by_rows(text):
    """The features straight from their definitions, word by word."""
    import re
    import regex
    wide = {chr(c): chr(c - 0xFF01 + 0x21) for c in range(0xFF01, 0xFF5F)}
    text = regex.sub(r"[^\p{L}\p{M}\x00-\x7F]", " ", "".join(wide.get(c, c) for c in text or ""))
    words = [w.lower() for w in regex.findall(r"[A-Za-z\x80-\U0010FFFF]+", text)]
    n = max(len(words), 1)
    bad = [w in toxicity.INSULTS for w in words]
    near = sum(b and any(words[j] in toxicity.SECOND_PERSON for j in range(max(0, k - 3), min(len(words), k + 4))) for k, b in enumerate(bad))
    disguised = again = 0
    for run in regex.findall(r"[A-Za-z\x80-\U0010FFFF0-9@$!|*.\-_]+", text):
        core = run.rstrip("!|*.-_")
        inner = core.lstrip("!|*.-_")
        core = ("!" if core[:-len(inner) or None].endswith("!") and inner != core else "") + inner
        if re.search(r"[0-9@$!|*.\-_]", core) and regex.search(r"[A-Za-z\x80-\U0010FFFF]", core):
            disguised += 1
            again += core.lower().translate(toxicity._PLAIN) in toxicity.INSULTS
    letters = len(regex.findall(r"[A-Za-z\x80-\U0010FFFF]", text))
    return [sum(bad) / n, 0.0, np.log1p(sum(bad) + again), near / n, len(regex.findall(r"\p{Lu}", text)) / max(letters, 1), sum(text.count(c) for c in "!?") / n,
            sum(text.count(c) for c in "#*$%&|<>@^~") / n, disguised / n, again / n, np.log1p(len(words))]


@pytest.mark.parametrize("text", [
    None, "", "You \u201cidiot\u201d \u2014 what an idiot\u2026 you\u00a0idiot", "\uff49\uff44\uff49\uff4f\uff54 you", "st00pid id10t 1diot $tupid !diot f*** m-o-r-o-n", "\u00c9T\u00c9 \u00dcBER \u00e9t\u00e9 imb\u00e9cile",
    "self-made e.g. 3d 2nd covid19 end. really!! --", "\u4f60\u597d idiot\uff01 \U0001f600moron\U0001f600"])
def test_toxicity_features_by_definition(spark, text):
    row = toxicity.with_features(spark.createDataFrame([(1, text)], "doc_id long, text string"), toxicity.Lexicon(), ["doc_id"]).first()
    assert [row[f] for f in toxicity.FEATURES] == pytest.approx(features_by_rows(text))


def test_disguised_insults_count(spark):
    rows = [(i, w) for i, w in enumerate(["st00pid", "id10t", "1diot", "$tupid", "!diot", "\u201cidiot\u201d", "idiot\u2014", "idiot\u2026", "you\u00a0idiot", "\uff49\uff44\uff49\uff4f\uff54"])]
    out = toxicity.with_features(spark.createDataFrame(rows, "doc_id long, text string"), toxicity.Lexicon(), ["doc_id"]).collect()
    assert {r.doc_id for r in out if r.insults + r.plain_again > 0} >= {2, 3, 4, 5, 6, 7, 8, 9}
