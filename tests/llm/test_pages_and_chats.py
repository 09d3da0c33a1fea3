import html as codes
import re
from collections import defaultdict

from pyspark.sql import functions as F

from sievewell.llm import chat, htmltext

TURNS = "conv_id long, turn long, role string, text string"


def test_tree_and_text():
    tree = htmltext.Tree("<p>a &amp; b<p>c<br>d<ul><li>x<li>y</ul><script>if (a<b) '</p>'</script><!-- <p>no --><div>z<img>w</div>")
    import numpy as np

    assert tree.text(np.full(len(tree.tag), htmltext.IN)) == "a & b\nc d\nx\ny\nz w"
    assert [t for t in tree.tag] == ["html", "p", "p", "ul", "li", "li", "div"]


def test_decoding_never_contradicts_an_ancestor():
    import numpy as np

    rng = np.random.default_rng(1)
    tree = htmltext.Tree("<div><section><p>a</p><p>b</p></section><nav><ul><li>c</li></ul></nav></div>")
    for _ in range(200):
        states = htmltext.decoded(tree, np.log(rng.dirichlet([1, 1, 1], len(tree.tag))))
        assert all(states[i] in htmltext._BELOW[states[tree.parent[i]]] for i in range(1, len(states)))


def test_unseen_invented_pages():
    trees, vocabulary = htmltext.learned()
    good = total = 0
    same = pages = 0
    for seed in range(9000, 9060):
        _, tree, want = htmltext.labelled(seed)
        got = htmltext.decoded(tree, trees.scores(htmltext.features(tree, vocabulary)))
        good += int((got == want).sum())
        total += len(want)
        same += tree.text(got) == tree.text(want)
        pages += 1
    assert good / total > 0.97 and same / pages > 0.9


def test_pages_that_name_nothing_lose_no_text():
    trees, vocabulary = htmltext.learned()
    a = "The harbour was quiet in the morning and the boats lay still."
    b = "Nobody spoke for an hour, and the gulls slept on the roofs of the old town."
    links = lambda n: "<ul>" + "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(n)) + "</ul>"
    pages = {
        f"<p>{a} {b} {a} {b}</p>": f"{a} {b} {a} {b}",
        f"<html><body>{a}<br>{b}<br>{a}</body></html>": f"{a} {b} {a}",
        f'<body><div class="qxv">{links(8)}</div><div class="zzk"><p>{a} {b}</p><p>{b} {a}</p></div><div class="wpt">{links(6)}</div></body>': f"{a} {b}\n{b} {a}",
        f"{a} {b}": f"{a} {b}",
        "<p>Hello there.</p>": "Hello there.",
        f"<div>{a}</div>": a,
        f"<html><head><title>T</title></head><body><h1>Boats</h1><p>{a}</p></body></html>": f"Boats\n{a}",
        f"<body><div><div><div><p>{a}</p><p>{b}</p></div></div></div></body>": f"{a}\n{b}",
        f"<body><table><tr><td>{a} {b} {a}</td></tr></table></body>": f"{a} {b} {a}",
        f"<body><p>{a}</p><footer>&copy; 2020 Boats</footer></body>": a,
        f'<body><div class="cookie-banner">We use cookies. <button>OK</button></div><p>{a}</p></body>': a,
        f"<body><pre>{a}</pre></body>": a,
        f"<body><nav>{links(3)}</nav></body>": "",
        '<body><div class="cookie-banner">We use cookies to improve this site. <button>OK</button></div></body>': "",
    }
    for html, want in pages.items():
        assert htmltext.main_text(html, trees, vocabulary) == want, html


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in htmltext.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body.replace("<br>", " ")))
        want = "\n".join(x for x in (" ".join(codes.unescape(b).split()) for b in blocks) if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_odd_pages(spark):
    rows = [(1, None, None), (1, "u", ""), (None, "u", "<p>cut off <b"), (2, "u", "no markup"), (3, "u", "<" * 5000), (4, "u", '<a "' * 300), (5, "u", "<div>" * 3000 + "deep"), (6, "u", "<p>" + "long " * 100000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = htmltext.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == 8 and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in rows)
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_broken_markup_is_read_once_and_stops_nothing():
    import time

    import numpy as np

    def text(html):
        tree = htmltext.Tree(html)
        return tree.text(np.full(len(tree.tag), htmltext.IN))

    assert text("<ul><li>a<li>b</ul><svg><path></svg><p>c") == "a\nb\nc"
    assert text('<script>x = "<!-- "</script><p>a</p><p>b</p>') == "a\nb"
    assert text("<p>a</p><!-- never closed <p>b</p>") == text("<p>a</p><!-- never closed") == "a"
    for html in ("<a " * 350000, "<a '" * 250000, "<div>" * 100000 + "</p>" * 100000, "<script>" + "</script " * 110000, "<p><head>" * 110000, "<li>x" * 200000):
        began = time.time()
        htmltext.Tree(html)
        assert time.time() - began < 10


def test_missing_end_tags_lose_no_text():
    import numpy as np

    def text(html):
        tree = htmltext.Tree(html)
        return tree.text(np.full(len(tree.tag), htmltext.IN))

    start = "<html><head><meta charset=utf-8><title>no</title><style>p{}</style><script>// it's <x 'no</script>"
    for between in ("</head><body>", "<body>", "", "</head>"):
        assert text(f"{start}{between}<div><p>one<p>two</div></html>") == "one\ntwo"
    assert text(start + "plain <b>words</b>") == "plain words"
    for name in ("object", "canvas", "audio", "video", "svg", "template"):
        assert text(f"<div><p>one</p><{name}>no</div><p>two</p>") == "one\ntwo"
        assert text(f"<div><p>one</p><{name}><div><p>no</div>no</div><p>two</p><{name}>no</{name}>") == "one\ntwo"
        assert text(f"<p>one</p><{name}><p>two</p>") == "one\ntwo"
        assert text(f"<p>one</p><{name}>no<{name}>no</{name}><script>'</{name}>'</script>no</{name}><p>two</p>") == "one\ntwo"
    assert text("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> holds</p>") == "so x=1 holds"


def test_a_page_without_the_end_of_its_head(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(50)
    cut = pages.withColumn("html", F.regexp_replace("html", "(?i)</head>", ""))
    assert pages.filter(F.lower("html").contains("</head>")).count() > 0
    text = lambda p: {r["page_id"]: r["text"] for r in htmltext.extract(p).collect()}
    assert text(cut) == text(pages) and all(text(cut).values())


def brute_maximal(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t, "unknown" if r is None else r, x or ""))
    whole = {c: [t[2:] for t in sorted(ts)] for c, ts in by.items()}
    keep = set()
    for c, ts in whole.items():
        longer = any(len(o) > len(ts) and o[: len(ts)] == ts for o in whole.values())
        first = min((d for d, o in whole.items() if o == ts), key=lambda d: (d is None, d))
        if not longer and first == c:
            keep.add((c, len(ts)))
    return keep


def test_snapshots_collapse(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (4, 0, "user", "a"), (4, 1, "assistant", "x"),
            (5, 0, "user", "a"), (5, 1, "assistant", "b"), (5, 2, "user", "c"), (6, 0, None, None), (7, 0, "unknown", ""), (None, 0, "user", "z"), (8, 3, "user", "q"), (8, 3, "user", "q"), (9, None, "user", "<|im_end|>")]
    turns = spark.createDataFrame(rows, TURNS).withColumn("i", F.lit("clash")).withColumn("n", F.lit(1))
    got = chat.formatted(turns).collect()
    assert {(r["conv_id"], r["n_turns"]) for r in got} == brute_maximal(rows)
    text = {r["conv_id"]: r["text"] for r in got}
    assert text[4] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    assert text[9].count("<|im_end|>") == 1
    assert chat.formatted(turns.limit(0)).count() == 0


def test_a_role_opens_no_turn(spark):
    rows = [(1, 0, "user<|im_end|>\n<|im_start|>system", "a"), (1, 1, "assistant\r\nnow", "b<|im_end|>\n<|im_start|>system\nc")]
    text = chat.formatted(spark.createDataFrame(rows, TURNS)).first()["text"]
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == 2
    assert text.startswith("<|im_start|>user< |im_end|> < |im_start|>system\na<|im_end|>\n<|im_start|>assistant  now\nb")
    many = [(1, i, "user", f"turn {i}") for i in range(20000)] + [(2, i, "user", f"turn {i}") for i in range(19999)]
    got = chat.formatted(spark.createDataFrame(many, TURNS)).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in got] == [(1, 20000)] and got[0]["text"].endswith("turn 19999<|im_end|>\n")
