from lodestar.llm import wrappers as W


def test_templates_of_one_host(spark):
    """Pages without an article element keep their text beside pages that have one."""
    side = "<div class='menu'><a href='/'>home</a></div>"
    rows, want = [], {}
    for i in range(24):
        own = f"Text number {i} of this page, long enough to be told from a menu."
        body = [f"<article><h1>T{i}</h1><p>{own}</p></article>", f"<div class='post'><h1>T{i}</h1><p>{own}</p></div>",
                f"<main><h1>T{i}</h1><p>{own}</p></main>", f"<div><h1>T{i}</h1><p>{own}</p></div>"][i % 4]
        rows.append((i, "http://one.org/x" if i % 8 < 4 else None, f"<body>{side}{body}</body>"))
        want[i] = own
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for mb in (32, 0):
        got = {r.page_id: r.text for r in W.extract(pages, broadcast_mb=mb).collect()}
        assert all(want[i] in got[i] and "home" not in got[i] for i in want), {i: got[i] for i in want if want[i] not in got[i]}


def test_ids_of_headings_and_sections():
    page = ("<article><h1 id='search'>Title</h1><p id='tags'>One</p><section id='related-work'><h2 id='discussion'>Two</h2><p>Three</p></section>"
            "<div class='related'>no</div></article><section id='comments'><p>nor this</p></section><div id='sidebar'>nor that</div>")
    tree = W.parse(page)
    assert W.Extractor(W.page_wrapper(tree)).text(tree) == "Title\n\nOne\n\nTwo\n\nThree"
