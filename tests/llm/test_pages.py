import random

import pytest

from strandloom.llm import pages as P


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@pytest.mark.parametrize("seed", range(200))
def test_alignment_is_longest(seed, monkeypatch):
    rnd = random.Random(seed)
    a, b = ([rnd.choice("abcde") for _ in range(rnd.randint(0, 25))] for _ in range(2))
    for split in (False, True):
        if split:
            monkeypatch.setattr(P, "_aligned", lambda a, b, f=P._aligned: f(a, b))
        got = [a[i] for i in P.common_lines(a, b)]
        it = iter(b)
        assert len(got) == lcs(a, b) and all(x in it for x in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Menu</a></li></ul></nav>
<header><h1>Site</h1></header><!-- ad --><div class="ad">Buy</div><article><header><h1>Head  &amp;\n line</h1></header><p><b>One.<br><p>Two &lt;b&gt; &eacute;<br>three</p><div class="ad-box">Ad<div>x</div></div>
<p hidden>no</p><ul><li>a<li>b</ul><aside>side</aside><form>f<input></form><section id="comments"><p>Nice!</p></section><p>Last&amp</p></article><footer>&copy; x</footer></body></html>"""


def test_article_blocks():
    lines, zones, has = P.lines_of(PAGE)
    assert has and [x for x, z in zip(lines, zones) if z == P.MAIN] == ["Head & line", "One.", "Two <b> é three", "a", "b", "Last&"]
    assert {"Menu", "Site", "Buy", "© x", "Nice!"} <= {x for x, z in zip(lines, zones) if z == P.CHROME}
    cut, zones, _ = P.lines_of(PAGE[: PAGE.index("three")] + "&am")
    assert [x for x, z in zip(cut, zones) if z == P.MAIN][-1] == "Two <b> é &am"
    assert P.lines_of("<article><p>a</p><p cla")[0] == ["a"] and P.lines_of("<p>1 < 2 <i>x</i>")[0] == ["1 < 2 x"]
    assert P.lines_of(None) == ([], [], False)


def test_differencing_decides_open_lines(spark):
    bare = "<div>Welcome</div><div>{}</div><p>Call us</p>"
    rows = [(i, f"http://h.example/{i:03}", bare.format(f"story {i}"), "x") for i in range(40)]
    rows += [(100, "http://one.example/", bare.format("alone"), "x"), (101, None, None, "x"), (102, "http://h.example/a", PAGE, "x"), (103, "http://h.example/a", PAGE, "x"), (104, "nonsense", "<article></article>", "x")]
    rows += [(105, "http://h.example/long", "<article>" + "<p>line</p>" * 20000 + "</article>", "x"), (None, "http://z.example", "<main>m</main>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = {r.page_id: r for r in P.main_texts(pages).collect()}
    assert len(got) == len(rows)
    assert all(got[i].text == f"story {i}" for i in range(40))
    assert got[100].text == "Welcome\nalone\nCall us" and got[101].text == "" and got[104].text == "" and got[None].text == "m"
    assert got[102].text == got[103].text == "Head & line\nOne.\nTwo <b> é three\na\nb\nLast&"
    assert got[105].n_chars == len(got[105].text) == 20000 * 5 - 1
    assert P.main_texts(pages.limit(0)).count() == 0


@pytest.mark.parametrize("tasks", [1, 3, 17, 60])
def test_neighbours_in_other_tasks_count(spark, tasks):
    """Hosts of two pages and one of forty: whatever the number of tasks, each page meets its nearest."""
    bare = "<div>Welcome {}</div><div>{}</div><p>Call us</p>"
    rows = [(i, f"http://h{i // 2:02}.example/{i}", bare.format(i // 2, f"story {i}")) for i in range(60)]
    rows += [(i, f"http://long.example/{i:03}", bare.format("", f"story {i}")) for i in range(60, 100)] + [(100, "http://z.example", bare.format("z", "alone"))]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        got = {r.page_id: r.text for r in P.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == {i: f"story {i}" for i in range(100)} | {100: "Welcome z\nalone\nCall us"}


@pytest.mark.parametrize("tasks", [2, 64])
def test_random_hosts_match_brute_force(spark, tasks):
    """Pages of lines that are distinct within a page and in one order on all pages: what two of them share is plain to see."""
    rnd = random.Random(6)
    rows = []
    for i in range(150):
        host, path = rnd.choice("aaaab"), "/".join(rnd.choice("xyz") for _ in range(rnd.randint(1, 5)))
        lines = sorted(rnd.sample(range(30), rnd.randint(0, 8)))
        main = rnd.random() < 0.3
        rows.append((i, f"http://{host}.example/{path}", "".join(f"<div>{x:02}</div>" for x in lines) + "<article><p>own</p></article>" * main, lines, main))
    order = sorted(rows, key=lambda r: (r[1].split("/")[2], r[1].split("example")[1], r[0]))
    want = {}
    for at, (i, url, _, lines, main) in enumerate(order):
        best, most = set(), -1
        for j in (at - 1, at + 1):
            if 0 <= j < len(order) and order[j][1].split("/")[2] == url.split("/")[2]:
                a, b = order[j][1].split("example")[1], url.split("example")[1]
                n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                if n > most:
                    best, most = set(order[j][3]), n
        want[i] = ("own" if main else "\n".join(f"{x:02}" for x in lines if x not in best), len(best & set(lines)))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        got = P.main_texts(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert {r.page_id: (r.text, r.n_shared) for r in got} == want
    assert sum(n for _, n in want.values()) > 50


def test_an_empty_article_leaves_the_rest(spark):
    rows = [(1, "http://a.example/1", "<article></article><p>story</p><div>frame</div>"), (2, "http://a.example/2", "<main> </main><p>other</p><div>frame</div>")]
    got = {r.page_id: r.text for r in P.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "story", 2: "other"}
