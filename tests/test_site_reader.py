"""Plain pages are cut up by a pattern: readers see what the tolerant parser shows them."""

import random

from corpusloom.operators import site as S

PLAIN = ['<section id="a">', "<section id=b class=\"x\">", "</section>", '<h2 class="sectiontitle">', "</h2>", '<h1 id="t">', "</h1>", "x &amp; y", "&am", "<p>", "</p>", "<br>", "<!-- c -->", "<!---->",
         "<script>v &amp; w</script>", "<title>t &amp; u</title>", '<div id="__toolbar">', "</div>", "<mark>m</mark>", "<head>", "</head>", "<body>", "é\n"]
SOUP = ["<", ">", '<P CLASS="q">', "<br/>", '<a href="a&amp;b">', "<!doctype html>", "<p id>", "<noscript>", "<p id='k'>", '<p id="a"id="b">', "</ p>", "<script>a<b</script>", "<textarea>", "<svg>"]


def test_plain_pages_are_read_as_by_the_parser():
    draw, plain = random.Random(3), 0
    for n in range(4000):
        page = "".join(draw.choices(PLAIN if n % 2 else PLAIN + SOUP, k=draw.randint(1, 12)))
        plain += S._WHOLE.match(page).end() == len(page)
        for make, seen in ((S._contents_reader(), lambda r: (r.done, r.top)), (lambda: S._text_reader()(S.TOOL_IDS), lambda r: (r.out, r.buffer, r.number))):
            got, want = make(), make()
            S._read(got, page)
            want.feed(page)
            want.close()
            assert seen(got) == seen(want), page
    assert plain > 2000
