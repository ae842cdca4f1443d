"""Open lines of pages with an article: the template goes, the rest stays in page order."""

from cartograph.llm import html_text


def test_pages_with_articles_are_differenced(spark):
    def page(i, body):
        return (i, f"http://h.org/a/{i}", "<body><div>Welcome to the site</div>" + body + "<div>All rights reserved</div></body>")

    story = lambda i: f"story {i} told at length in a plain element " * 4
    rows = [page(i, f"<div>headline {i}</div><article><p>teaser {i}</article><div>{story(i)}</div><article><p>card {i}</article>") for i in range(4)]
    rows.append(page(4, f"<div>{story(4)}</div>"))  # its only neighbours have articles
    copy = f"<div>{story(9)}</div><article><p>{'copied text ' * 9}</article>"
    rows += [(8, "http://c.org/1", copy), (9, "http://c.org/2", copy)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(4):
        assert got[i] == f"headline {i}\nteaser {i}\n{story(i).strip()}\ncard {i}"
    assert got[4] == story(4).strip()
    assert got[8] == got[9] == f"{story(9).strip()}\n{('copied text ' * 9).strip()}"
