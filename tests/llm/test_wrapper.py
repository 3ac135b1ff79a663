import random

from tabulon.llm import wrapper
from tabulon.llm.dom import Node, parse
from tabulon.llm.wrapper import Aligned, align, extract_main_text, induce, main_text, match, wrappers

EMPTY = {"region": [], "opened": [], "constant": [], "beside": []}


def page(k, body, menu="Home", extra=""):
    return f'<!DOCTYPE html><html lang="en"><head><title>t{k}</title><style>p{{a:b}}</style><script>var x="</p>{k}";</script></head><body><nav><ul><li><a href="/a">{menu}</a><li>{k}</ul></nav><!-- c {k} --><div class="ad ad-{k}">Buy {k}</div>{body}{extra}<footer>&copy; x</footer></body></html>'


def size(node):
    return 1 + sum(size(c) for c in node.children if isinstance(c, Node))


def brute_match(a, b):
    """The definition, without memo: the largest common top-down ordered subtree."""
    if a.label != b.label:
        return 0
    x, y = ([c for c in n.children if not isinstance(c, str)] for n in (a, b))
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + brute_match(x[i], y[j]))
    return 1 + m[-1][-1]


def test_tree_matching():
    rng = random.Random(1)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1) if depth else 'x'}</{t}>" for t in rng.choices(["div", "b", "ul"], k=rng.randint(0, 3)))

    for _ in range(40):
        a, b = parse(tree(3)), parse(tree(3))
        assert match(Aligned(a), b, {}) == brute_match(a, b)
        t = Aligned(a)
        align(t, b, {})
        assert match(t, a, {}) == size(a) and match(t, b, {}) == size(b)


def test_main_text_of_forms():
    article = "<article><h1>Ti&amp;tle</h1><p><b>One\n  two&nbsp;three<br></article>"
    assert main_text(page(1, article), EMPTY) == "Ti&tle\nOne two three"
    assert main_text("<p>a<p>b<div>c <i>d</i>e<ul><li>f<li>g</ul>", EMPTY) == "a\nb\nc de\nf\ng"
    assert main_text("<main><header>Title</header><p>x &lt;y&gt; &#233; &bogus; < 3</p><aside>no</aside><form>no</form></main><header>no</header>", EMPTY) == "Title\nx <y> é &bogus; < 3"
    assert main_text("", EMPTY) == "" and main_text("just text", EMPTY) == "just text"
    assert main_text('<div id="comments"><p>no</p></div><p>yes</p><div class="cookie-notice">no</div><section class="sidebar">no</section>', EMPTY) == "yes"
    assert main_text("<p>a</p><script>x < y", EMPTY) == "a" and main_text("<p>a<!-- b", EMPTY) == "a"
    assert main_text("<table><tr><td>1<td>2<tr><td>3</table>", EMPTY) == "1\n2\n3"
    assert main_text("<pre>a\n b</pre><p>" + "w " * 50_000, EMPTY).count("w") == 50_000


def test_induced_region_without_semantic_tags():
    def body(k):
        return f'<div id="x1"><div class="bar"><a href="/">Home page</a></div><div class="story"><p>Story number {k} has words {"and more " * k}.</p><p>The same closing sentence everywhere.</p><span>Print version</span></div><div class="low"><a href="/{k}">go {k}</a></div></div>'

    pages = [page(k, body(k)) for k in range(1, 7)]
    w = induce(pages)
    assert w["region"] == ["html", "body", "div.x", "div.story"]
    assert main_text(pages[2], w) == "Story number 3 has words and more and more and more ."
    assert induce([]) == EMPTY and induce([pages[0]])["constant"] == []


def test_copies_keep_their_text():
    body = "<article><h1>Same</h1><p>All of this is the same.</p></article>"
    pages = [page(k, body) for k in range(8)]
    assert main_text(pages[0], induce(pages)) == "Same\nAll of this is the same."


def test_table(spark):
    rows = [(k, f"https://h{k % 3}.example/{k}", page(k, f"<article><p>text {k} é</p></article>", menu=f"m{k}")) for k in range(30)]
    rows += [(100, None, "<p>no url</p>"), (101, "not a url", None), (102, "https://h1.example/", ""), (None, "https://h1.example/z", rows[1][2]), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").repartition(4)
    out = extract_main_text(df)
    assert out.columns == ["page_id", "url", "text"]
    want = [(k, u, "" if not h else "no url" if k == 100 else f"text {1 if k is None else k} é") for k, u, h in rows]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert extract_main_text(df.limit(0)).count() == 0


def test_labels_are_counted_over_all_pages(spark):
    """Eight pages propose labels; those that only a part of the host's pages have are content."""

    def body(k, label):
        return f"<article><p>Words of page {k} differ {k * 7}.</p><span>Print version</span><div>{label}</div></article>"

    rows = [(k, "https://a.example/", page(k, body(k, "Rubric"))) for k in range(8)] + [(k, "https://b.example/", page(k, body(k, f"Rubric {k}" if k < 40 else "Rubric"))) for k in range(8, 208)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    texts = {r.page_id: r.text for r in extract_main_text(df, slots=3).collect()}
    assert texts[2] == "Words of page 2 differ 14."  # three pages propose, all are counted
    texts = {r.page_id: r.text for r in extract_main_text(df).collect()}
    assert all(texts[k].startswith(f"Words of page {k} differ {k * 7}.") and "Print version" not in texts[k] for k in range(8, 208))
    # 168 of 200 pages have the same rubric: under the share, so it stays whatever the aligned pages show
    assert all(texts[k].endswith("\nRubric") for k in range(40, 208))
    assert wrappers(df.limit(0)).count() == 0


def test_deep_pages():
    for tag in ("div", "b", "article"):
        deep = f"<{tag}>" * 20_000 + "<p>deep text</p>" + f"</{tag}>" * 20_000 + "<p>after"
        assert main_text(deep, EMPTY).split("\n") == ["deep text", "after"][: 1 if tag == "article" else 2] and induce([deep, deep + "x"] * 2)


def test_without_broadcasts(spark, monkeypatch):
    rows = [(k, f"https://h{k % 3}.example/{k}", page(k, f"<article><p>text {k} é</p><span>Print version</span></article>")) for k in range(30)]
    df = spark.createDataFrame(rows * 2, "page_id long, url string, html string").repartition(4)
    want = sorted(map(tuple, extract_main_text(df).collect()))
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, extract_main_text(df).collect())) == want and want[0][2] == "text 0 é"


def test_marks_that_only_tell_of_a_part():
    for mark in ("layout has-sidebar", "content-with-sidebar", "no-sidebar", "post share-enabled"):
        assert main_text(f'<div class="{mark}"><p>Text.</p></div><p>more</p><div class="sidebar">no</div>', EMPTY) == "Text.\nmore"
    assert main_text('<div id="search-results"><article><p>Text.</p></article></div><p>other</p>', EMPTY) == "Text."
    assert main_text('<div id="search-results"><p>Text.</p><nav>no</nav></div>', EMPTY) == "Text."
    assert main_text('<p>yes</p><div id="comments"><article class="comment-body">no</article></div>', EMPTY) == "yes"
    assert main_text('<p>yes</p><div class="left-sidebar">no</div><div class="ad-box">no</div>', EMPTY) == "yes"


def test_titles_beside_the_main_block_stay():
    for outer, inner in (("<div id=content>", "<div class=body>"), ("<main>", "<article>")):
        pages = [page(k, f"{outer}<h1>Title {k}</h1>{inner}<p>{f'word{k} ' * 200}</p></{inner[1:].split()[0].strip('>')}></{outer[1:].split()[0].strip('>')}>") for k in range(1, 9)]
        assert main_text(pages[3], induce(pages)).startswith("Title 4\nword4 word4")


def test_text_beside_the_path_of_the_sample_stays():
    def body(k, more=""):
        return f'<div class="col"><div class="story"><p>Story {k} {"and more " * k}.</p></div>{more}<p class="note">Same note.</p></div>'

    w = induce([page(k, body(k)) for k in range(1, 9)])
    assert w["region"] == ["html", "body", "div.col", "div.story"]
    assert main_text(page(2, body(2)), w) == "Story 2 and more and more ."
    assert main_text(page(9, body(1, '<div class="extra"><p>A long report.</p></div>')), w) == "Story 1 and more .\nA long report."


def test_small_hosts_lose_their_labels(spark):
    """Hosts of 2 to 7 pages are sampled in whole, whatever the hashes are."""
    rows = [(100 * n + k, f"https://h{n}.example/", page(k, f"<article><p>Words {n} of page {k}.</p><span>Print version</span></article>")) for n in range(2, 8) for k in range(n)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    assert {r.page_id: r.text for r in extract_main_text(df).collect()} == {i: f"Words {i // 100} of page {i % 100}." for i, _, _ in rows}


def text_of(k, body):
    return f"<html><head><title>t{k}</title></head><body>{body}</body></html>"


def prose(k, n=40):
    return " ".join(f"w{k}x{j}" for j in range(n)) + "."


def test_constant_nodes_are_template_whatever_they_are():
    notice = "<p>We have changed our terms. Please read them before you go on.</p>"
    menu = "<table><tr><td><a href=/w>World</a></td><td>Sports</td></tr></table>"
    for head in (notice, menu, notice + menu, "<div>Edition: <b>Europe</b>, today.</div>"):
        pages = [text_of(k, f"<div id=c>{head}<h2>Title {k}</h2><p>{prose(k)}</p></div>") for k in range(8)]
        assert [main_text(p, induce(pages)) for p in pages] == [f"Title {k}\n{prose(k)}" for k in range(8)]


def test_varying_prose_stays_whatever_its_marks():
    pages = [text_of(k, f"<div class='related share'><h2>Title {k}</h2><p>{prose(k)}</p></div><p>Same line.</p>") for k in range(8)]
    assert [main_text(p, induce(pages)) for p in pages] == [f"Title {k}\n{prose(k)}" for k in range(8)]
    # a section with a layout's name and prose is opened; comments, adverts and links that vary aren't
    rest = "<div class='comments'><p>{c}</p></div><div class=ad>{c}</div><div class='search'><a href=/{k}>{c}</a></div>"
    pages = [text_of(k, f"<article><p>{prose(k)}</p><section class='search banner'><p>{prose(k + 100)}</p></section></article>" + rest.format(k=k, c=prose(k + 200, 300))) for k in range(8)]
    assert [main_text(p, induce(pages)) for p in pages] == [f"{prose(k)}\n{prose(k + 100)}" for k in range(8)]


def test_large_pages_are_samples_too():
    def body(k, n):
        return text_of(k, "<div class=top><p>Old news.</p></div><div class=s>" + "".join(f"<p>Paragraph {j} of {k}.</p>" for j in range(n)) + "</div>")

    for n in (30, 4100):
        pages = [body(k, n + k) for k in range(3)]
        w = induce(pages)
        assert w["region"] == ["html", "body", "div.s"]
        assert main_text(pages[1], w) == "\n".join(f"Paragraph {j} of 1." for j in range(n + 1))


def plain_texts(pages):
    """A plain form of the result for flat pages: per host, blocks of (place, text) that 90 % of its pages have are template; the rest, in order, is content."""
    import re

    blocks = [re.findall(r"<(p|h2|li)>(.*?)</\1>", p) for p in pages]
    n = {}
    for mine in blocks:
        for x in set(mine):
            n[x] = n.get(x, 0) + 1
    return ["\n".join(t for g, t in mine if n[g, t] < 0.9 * len(pages)) for mine in blocks]


def test_against_a_plain_form(spark):
    rng = random.Random(5)
    rows = []
    for host in range(6):
        fixed = [f"<{rng.choice(['p', 'h2', 'li'])}>Fixed line {host}.{j} stands here.</" for j in range(rng.randint(0, 4))]
        fixed = [x + x[1 : x.index(">")] + ">" for x in fixed]
        for k in range(rng.choice([3, 5, 12, 40])):
            own = [f"<p>{prose(1000 * host + 10 * k + j, 12)}</p>" for j in range(rng.randint(3, 6))]
            some = ["<p>A passage that some pages of the host quote.</p>"] * (rng.random() < 0.3)
            rows.append((len(rows), f"https://h{host}.example/{k}", text_of(k, "<div>" + "".join([*fixed[:2], *own, *some, *fixed[2:]]) + "</div>")))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    for host in range(6):
        mine = [r for r in rows if r[1].startswith(f"https://h{host}.")]
        assert [got[r[0]] for r in mine] == plain_texts([r[2] for r in mine])
