"""Markup to documents."""

import pyarrow as pa

from specloom.functions.html import slices
from specloom.operators.content import extract_content, with_needs_render
from specloom.schemas import PAGES

HTML = "text/html; charset=utf-8"


def documents(spark, *htmls, content_type=HTML):
    rows = [("https://a.example.com", f"u{i:02}", 200, content_type, h, None) for i, h in enumerate(htmls)]
    got = extract_content(spark.createDataFrame(rows, PAGES)).orderBy("url").collect()
    assert len(got) == len(htmls)
    return got


def test_titles(spark):
    got = documents(
        spark,
        "<title> A &amp; B </title><h1>H</h1>",
        "<h1>H <b>two</b></h1>",
        "<p>x</p>",
        "<title></title><h1>h</h1>",
        "<title><b>deep</b></title>",
        "<title>a<b>c</b></title><h1>H1</h1>",
        "<svg><title>first</title></svg><title>second</title>",
        "<title> </title><h1>H</h1>",
    )
    assert [d["title"] for d in got] == [
        "A & B", "H two", "Untitled", "h", "deep", "H1", "first", "",
    ]


def test_code_samples(spark):
    got = documents(
        spark,
        "<pre><code>GET /users HTTP/1.1</code></pre><code>short</code>",
        "<pre> line one\n\n  line two </pre><code>curl -X <b>POST</b>  <i>now</i></code>",
        "<nav><code>inside navigation</code></nav><code>exactly 10</code><code>eleven char</code>",
    )
    assert [d["code_samples"] for d in got] == [
        ["GET /users HTTP/1.1", "GET /users HTTP/1.1"],
        ["curl -X POST now", "line one\n\n  line two"],
        ["inside navigation", "eleven char"],
    ]


def test_main_content_and_removed_parts(spark):
    got = documents(
        spark,
        "<body><nav>navigation</nav><article>article text</article><main>main text</main></body>",
        "<body><div class='big api-content'>div text</div><article>article text</article></body>",
        "<body><p>before</p><div class='big api-content'>div text<script>var x</script></div></body>",
        "<body><header><main>hidden main</main></header><p>body text</p><footer>foot</footer></body>",
        "<title>the title</title><p>plain text</p><!-- comment --><style>p{}</style>",
        "<body><p>GET</p><p>POST</p><p>a &lt;b&gt; &copy; &notit; &#233;tudes</p>  <p> </p></body>",
        "<body><p>one<br>two line<p>three<b>bold</p>after words</body>",
        "<body><p>kept text</p><p>&lt;!-- gone --&gt;</p><template>tmpl text</template></body>",
        "<body>text one<main></main></body>",
        "<body><![CDATA[cdata text]]><p>unclosed text",
    )
    assert [d["text"] for d in got] == [
        "main text",
        "article text",
        "div text",
        "body text",
        "the title\nplain text",
        "POST\na <b> © &notit études",
        "two line\nthree\nbold\nafter words",
        "kept text",
        "",
        "cdata text\nunclosed text",
    ]


def test_json_pages_are_kept_raw(spark):
    body = '{"openapi": "3.0.3",   "paths": {}}\n'
    got = documents(spark, body, content_type="Application/JSON")[0]
    assert (got["title"], got["text"], got["code_samples"]) == ("JSON API Spec", body, [body])
    assert got["token_estimate"] == 2 * len(body) // 4


def test_failed_pages_are_dropped(spark):
    rows = [("s", f"u{c}", c, HTML, "<p>text</p>", None) for c in (199, 200, 299, 301, 404)]
    got = extract_content(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(d["url"] for d in got) == ["u200", "u299"]


def test_needs_render(spark):
    shell = "<div id='root'></div><p>%s</p><script>React</script>"
    values = [shell % ("x" * 499), shell % ("x" * 500), "<p>revue</p>", "<p>plain</p>", None]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, html STRING")
    got = {r["i"]: r["needs_render"] for r in with_needs_render(frame, "html").collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: False}
    # On extracted text the marks that are tags are gone; words are not.
    text = spark.createDataFrame([(0, "id root"), (1, "built with React")], "i INT, text STRING")
    got = {r["i"]: r["needs_render"] for r in with_needs_render(text).collect()}
    assert got == {0: False, 1: True}


def test_pages_are_parsed_in_small_slices():
    batches = [pa.RecordBatch.from_pydict({"n": list(range(a, b))}) for a, b in ((0, 100), (100, 100), (100, 101))]
    got = list(slices(batches, 32))
    assert [b.num_rows for b in got] == [32, 32, 32, 4, 1]
    assert [n for b in got for n in b.column(0).to_pylist()] == list(range(101))


def test_more_pages_than_a_slice(spark):
    got = documents(spark, *[f"<title>t{i}</title><p>{i}</p>" for i in range(80)])
    assert [d["title"] for d in got] == [f"t{i}" for i in range(80)]
