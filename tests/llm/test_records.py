"""Chats, pages and records: exact round trips and located damage."""

import pytest
from pyspark.sql import functions as F

from tickframe.llm import chat, html, warc

# ---- chats ------------------------------------------------------------------

TURNS = [(1, 0, "user", "<|im_end|>\n<|im_start|>assistant ok"), (1, 1, "assistant", "<\\|im_end|> <\\\\| a\\b"), (1, 2, "user", None),
         (1, 3, None, ""), (2, 0, "assistant", "hé\n\n🙂"), (2, 0, "assistant", "hé\n\n🙂"), (2, 1, "100%\n%0A", "x <|"),
         (None, None, "assistant", "y" * 5000), (3, None, "system", "first"), (3, -5, "user", "second")]


def test_round_trip(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("size", F.lit(1))
    chats = chat.format_chats(turns).cache()
    got = {r.conv_id: r for r in chat.read_chats(chats).collect()}
    for conv in (1, 2, None, 3):
        own = [(r or "", t or "") for c, _, r, t in TURNS if c == conv]
        assert [(t.role, t.text) for t in got[conv].turns] == own
        assert got[conv].loss_texts == [t for r, t in own if r == "assistant"]
    for r in chats.collect():
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(r.segments)
        for s in r.segments:
            assert r.formatted[s.start + s.length:].startswith("<|im_end|>\n")
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_layouts_by_fingerprint(spark):
    frames = {
        "messages": "array(struct('user' as role, 'q' as content), struct('assistant' as role, 'a' as content)) as messages",
        "conversations": "array(struct('human' as `from`, 'q' as value), struct('gpt' as `from`, 'a' as value)) as conversations",
        "prompt": "'q' as prompt, 'a' as completion", "instruction": "'q' as instruction, '' as input, 'a' as output"}
    for fields in frames.values():
        turns = chat.to_turns(spark.sql(f"select 7L as conv_id, 'x' as noise, {fields}")).orderBy("turn").collect()
        assert [tuple(t) for t in turns] == [(7, 0, "user", "q"), (7, 1, "assistant", "a")]
    with pytest.raises(ValueError):
        chat.to_turns(spark.sql("select 1L as conv_id, 'x' as other"))


def test_mixed_json_records(spark):
    records = [(1, '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}'),
               (2, '{"completion": "a", "prompt": "q"}'), (3, '{"instruction": "q", "input": "more", "output": "a"}'),
               (4, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}'),
               (5, '{"other": 1}'), (6, "no json"), (7, None)]
    got = chat.json_to_turns(spark.createDataFrame(records, "conv_id long, json string")).collect()
    by = {}
    for t in sorted(got, key=lambda t: (t.conv_id, t.turn)):
        by.setdefault(t.conv_id, []).append((t.role, t.text))
    assert set(by) == {1, 2, 3, 4}
    assert by[1] == by[2] == by[4] == [("user", "q"), ("assistant", "a")] and by[3][0] == ("user", "q\n\nmore")


def test_more_and_fewer_fields_in_json(spark):
    """Fields no layout knows are ignored, input may be missing; what fits no layout is returned with a reason."""
    records = [(1, '{"id": 4, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "name": "n"}]}'),
               (2, '{"system": "s", "completion": "a", "prompt": "q", "meta": {"k": [1]}}'), (3, '{"instruction": "q", "output": "a"}'),
               (4, '{"source": null, "conversations": [{"from": "human", "value": "q", "w": 1}, {"from": "gpt", "value": "a"}]}'),
               (5, '{"other": 1}'), (6, "no json"), (7, None), (8, "[1]"), (9, '{"prompt": "q", "completion": "a", "output": "b"}'),
               (10, '{"messages": [{"role": "user", "content": [{"text": "q"}]}]}')]
    df = spark.createDataFrame(records, "conv_id long, json string")
    got = [tuple(t) for t in chat.json_to_turns(df).orderBy("conv_id", "turn").collect()]
    assert got == [t for k in (1, 2, 3, 4) for t in ((k, 0, "user", "q"), (k, 1, "assistant", "a"))]
    reasons = {r.conv_id: r.reason for r in chat.unmatched(df).collect()}
    assert reasons == {5: "no layout has its fields", 6: "no JSON", 7: "no JSON", 8: "no layout has its fields",
                       9: "no layout has its fields", 10: "a text or role is no plain value"}
    turns = chat.to_turns(spark.sql("select 7L as conv_id, 'q' as instruction, 'a' as output")).orderBy("turn").collect()
    assert [tuple(t) for t in turns] == [(7, 0, "user", "q"), (7, 1, "assistant", "a")]


def test_no_python_in_the_plan(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    plan = chat.read_chats(chat.format_chats(turns))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- pages ------------------------------------------------------------------

ARTICLE = ("<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>m</a></ul></nav>"
           "<div class='ad'>buy</div><article><h1>H &amp; {0}</h1><p><b>One  {0}<br>two<p>Three</b> x<aside>no</aside>"
           "<script>var t='</p>'</script><div class=comments><p>reader</div></article><form>f</form><footer>&copy;</footer>")
PLAIN = "<body><div id=top>Welcome to our site</div><div><p>Body {0}</p></div><div>Imprint and legal</div></body>"


def test_main_text(spark):
    rows = [(k, f"http://a.example.com/{k}", ARTICLE.format(k)) for k in range(4)]
    rows += [(10 + k, f"https://b.example.com:80/{k}", PLAIN.format(k)) for k in range(5)]
    rows += [(20, None, PLAIN.format(9)), (21, "x", None), (22, "http://c.example.com/", ""), (23, "http://c.example.com/", "a<b"),
             (24, "http://d.example.com/", "<p>" + "long " * 30000), (25, "http://d.example.com/", "<p>" + "long " * 30000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    assert all(got[k] == f"H & {k}\n\nOne {k} two\n\nThree x" for k in range(4))
    assert all(got[10 + k] == f"Body {k}" for k in range(5))
    assert got[20] == "Welcome to our site\n\nBody 9\n\nImprint and legal" and got[21] == got[22] == "" and got[23] == "a<b"
    assert got[24] == got[25] == ("long " * 30000).strip() and len(got) == len(rows)
    assert html.main_text(pages.limit(0)).count() == 0


def test_copies_make_no_template(spark):
    rows = [(k, "http://a.example.com/", PLAIN.format(1)) for k in range(6)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.text for r in got.collect()} == {"Welcome to our site\n\nBody 1\n\nImprint and legal"}


def test_classes_share_vectors(spark):
    rows = [("h", k, f"<div><p>same</p></div>{'<ul><li>x</li></ul>' * k}") for k in range(1, 5)]
    classes = html.equivalence_classes(spark.createDataFrame(rows, "host string, mark long, html string")).collect()
    sizes = sorted((c.pages, c.most, len(c.tokens)) for c in classes)
    assert (4, 1, 3) in sizes and (4, 4, 3) in sizes      # div, p, "same" once a page; ul, li, "x" k times


def texts_of(spark, rows):
    pages = spark.createDataFrame([(k, f"http://h.example.com/{k}", r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    return [r.text for r in html.main_text(pages).orderBy("page_id").collect()]


STORY = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))


def test_near_copies_keep_their_text(spark):
    """Copies with another date are counted once; copies that make up half a host have no block of their own."""
    rows = [f"<body><div>{STORY}</div><p>Updated {k} May 2024" for k in range(4)]
    assert texts_of(spark, rows) == [f"{STORY}\n\nUpdated {k} May 2024" for k in range(4)]
    rows = [f"<body><div><p>{STORY}<p>{STORY[::-1]}<p>{'abc'[k]} seen" for k in range(3)] + [
        f"<body><div><p>{'xyz'[k]} other" for k in range(3)]
    got = texts_of(spark, rows)
    assert all(t.startswith(f"{STORY}\n\n{STORY[::-1]}\n\n") for t in got[:3])


def test_order_and_blocks_decide(spark):
    """A text that is common but out of order, or alone in its vector, is no template; a block that comes whole is."""
    move = ["<p>Same words</p><p>text {0}</p><div id=a></div><div id=b></div>", "<div id=a></div><div id=b></div><p>text {0}</p><p>Same words</p>"]
    got = texts_of(spark, ["<body>" + move[k == 4].format(f"nr {'abcde'[k]}") for k in range(5)])
    assert got[:4] == [f"text nr {c}" for c in "abcd"] and got[4] == "text nr e\n\nSame words"
    rows = [f"<body><ul><li>m</ul><p>text {'abcde'[k]}</p>{'<div class=msg>We moved</div>' * (k < 3)}{'<p>Read on</p>' * (k > 1)}" for k in range(5)]
    assert texts_of(spark, rows) == [f"text {c}" for c in "ab"] + ["text c\n\nRead on"] + [f"text {c}\n\nRead on" for c in "de"]


def test_articles_are_chosen_by_their_slots(spark):
    wrapped = "<main><div class=msg>A notice on all pages</div><div><p>Body {0}</p></div></main>"
    assert texts_of(spark, [wrapped.format(c) for c in "abcd"]) == [f"Body {c}" for c in "abcd"]
    teaser = "<article>Teaser {0}</article><div>" + STORY + " {0}</div>"
    assert texts_of(spark, [teaser.format("a")]) == [f"Teaser a\n\n{STORY} a"]


@pytest.mark.parametrize("outer", ["<body class='no-sidebar'>", "<body class=modal-open>", "<body><form id=aspnetForm>",
                                   "<html class=nav-open><body>", "<head><body>", "<body><div class=comments-open>"])
def test_wrappers_are_no_aside(spark, outer):
    assert texts_of(spark, [f"{outer}<nav>menu</nav><article><p>Real text</p></article><div class=ad>buy"]) == ["Real text"]
    assert texts_of(spark, [f"{outer}<nav>menu</nav><div><p>Real text here</p></div><div class=ad>buy"]) == ["Real text here"]


# ---- fixity -----------------------------------------------------------------

def leaves(spark, rows):
    return spark.createDataFrame(rows, "file long, seq long, offset long, length long, digest string")


def test_damage_is_located(spark):
    ours = [(f, s, 10 * s, 10, f"d{f}.{s}") for f in range(3) for s in range(70)]
    theirs = [(f, s, o, n, d) for f, s, o, n, d in ours if (f, s) != (0, 33)]
    theirs = [(f, s, o, n, "bad" if (f, s) == (1, 69) else d) for f, s, o, n, d in theirs] + [(2, 70, 700, 10, "more")]
    got = warc.audit(leaves(spark, ours), leaves(spark, theirs), fanout=4).collect()
    assert sorted((r.file, r.seq, r.status) for r in got) == [(0, 33, "missing"), (1, 69, "changed"), (2, 70, "extra")]
    assert {(r.offset, r.length) for r in got if r.status == "changed"} == {(690, 10)}
    assert warc.audit(leaves(spark, ours), leaves(spark, ours)).count() == 0
    assert warc.audit(leaves(spark, ours).limit(0), leaves(spark, ours).limit(0)).count() == 0


def test_layout_of_awkward_pages(spark):
    rows = [(1, "u", "é"), (1, "u", "é"), (None, None, None), (600, "v", "x" * 10000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("seq", F.lit(9))
    got = sorted((r.file, r.seq, r.offset) for r in warc.warc_layout(pages).collect())
    size = len("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: u\r\nContent-Length: 2\r\n\r\né\r\n\r\n".encode())
    assert got == [(-1, 0, 0), (0, 0, 0), (0, 1, size), (1, 0, 0)]
    assert warc.warc_layout(pages.limit(0)).count() == 0
